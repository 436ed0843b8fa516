"""Visual lines: from spans, without margin artefacts, merged where print or OCR split them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.config import TypographyConfig
from folioweave.functions import folds
from folioweave.functions import text as X

LINE = ["book_id", "line_id", "pdf_page", "text", "x0", "y0", "x1", "y1", "page_width", "page_height", "font_size", "height", "is_bold", "font_names"]


def line_rows(style_lines: DataFrame) -> DataFrame:
    """Lines of a style-line table: once for each id, with content, their text normalised.

    Rows with a null book, page or text are left out; extra columns are dropped.
    """
    kept = style_lines.where(X.has_content("text") & F.col("book_id").isNotNull() & F.col("pdf_page").isNotNull())
    return kept.select(*LINE).dropDuplicates(["line_id"]).withColumn("text", X.normalized("text"))


def spans_to_lines(spans: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """Lines from positioned spans, page by page.

    Spans with content, in order of (centre, x0), belong to the line before them while their centre is
    within a share of the line's median height of its median centre (heights count as 1 at least, the share as 1.5 points).
    A page's spans are parted where a centre lies beyond what the tallest span of the page could reach, and only
    the spans between two such places are folded in order.
    """
    bold = ((F.col("flags").bitwiseAND(F.lit(16))) != 0) | F.lower("font").contains("bold")
    clean = spans.withColumn("text", X.normalized("text")).where(X.has_content("text")).withColumn("bold", F.coalesce(bold, F.lit(False)))
    clean = clean.withColumn("c", (F.col("y0") + F.col("y1")) / 2).withColumn("h", F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")))
    reach = lambda h: F.greatest(F.lit(1.5), F.greatest(h, F.lit(1.0)) * config.line_y_tolerance_ratio)
    by = Window.partitionBy("book_id", "pdf_page").orderBy("c", "x0", "span_seq")
    apart = F.coalesce(F.col("c") - F.lag("c").over(by) > reach(F.max("h").over(Window.partitionBy("book_id", "pdf_page"))), F.lit(True))
    runs = clean.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(by))
    row = F.struct("n", "c", "h", "x0", "y0", "x1", "y1", "size", "text", "bold", "font")
    kind = runs.select(row.alias("r")).schema["r"].dataType.simpleString()
    fits = lambda g, s: F.abs(s["c"] - folds.median(folds.members(g, "c"))) <= reach(folds.median(folds.members(g, "h")))
    lines = runs.groupBy("book_id", "pdf_page", "run").agg(F.array_sort(F.collect_list(row)).alias("s")).select("book_id", "pdf_page", F.explode(folds.grouped(F.col("s"), kind, fits)).alias("g"))
    of = lambda k: folds.members(F.col("g"), k)
    across = F.array_sort(F.transform("g", lambda s: F.struct(s["x0"].alias("x"), s["n"].alias("n"), s["text"].alias("t"))))
    two = lambda c, name: F.round(c, 2).alias(name)
    order = Window.partitionBy("book_id", "pdf_page").orderBy(F.col("g")[0]["n"])
    return lines.select(
        "book_id", "pdf_page", F.row_number().over(order).alias("line_no"), F.array_join(F.transform(across, lambda x: x["t"]), " ").alias("text"),
        two(folds.low(of("x0")), "x0"), two(folds.low(of("y0")), "y0"), two(folds.high(of("x1")), "x1"), two(folds.high(of("y1")), "y1"),
        two(folds.median(of("size")), "font_size"), two(folds.median(of("h")), "height"), F.exists("g", lambda s: s["bold"]).alias("is_bold"),
        F.array_sort(F.array_distinct(F.filter(of("font"), lambda f: f != ""))).alias("font_names"),
    )


def center_ratio() -> Column:
    return F.when(F.col("page_height") > 0, (F.col("y0") + F.col("y1")) / 2 / F.col("page_height")).otherwise(0.0)


def with_margin_slot(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """Lines with ``side`` (top, bottom or null) and ``bucket`` of their place in the margin band."""
    y = center_ratio()
    side = F.when(y <= config.margin_band_ratio, "top").when(y >= 1 - config.margin_band_ratio, "bottom")
    return lines.withColumn("side", side).withColumn("bucket", F.when(side.isNotNull(), F.bround(y / config.margin_position_tolerance_ratio).cast("int")))


def margin_numbers(config: TypographyConfig = TypographyConfig()) -> Column:
    """Numbers of up to four digits in a line that may be page numbers."""
    runs = F.regexp_extract_all("text", F.lit(r"(?<!\d)\d{1,4}(?!\d)"), F.lit(0))
    return F.filter(F.transform(runs, lambda n: n.cast("int")), lambda n: (n >= 1) & (n <= config.margin_max_page_number))


def repeated_margin_lines(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """(book_id, side, bucket, key, count): texts repeated in one margin slot."""
    slots = with_margin_slot(lines, config).where("side is not null")
    return slots.groupBy("book_id", "side", "bucket", X.lowered("text").alias("key")).count().where(F.col("count") >= config.margin_min_repeated_lines)


def reliable_page_offsets(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """(book_id, offset, pdf_page): margin numbers whose offset to the page holds over enough consecutive pages.

    Runs are islands of page minus row number within (book, offset), a group of distinct pages.
    """
    slots = with_margin_slot(lines, config).where("side is not null")
    pages = slots.select("book_id", "pdf_page", F.explode(margin_numbers(config)).alias("n")).select("book_id", (F.col("pdf_page") - F.col("n")).alias("offset"), "pdf_page").distinct()
    by = Window.partitionBy("book_id", "offset").orderBy("pdf_page")
    runs = pages.withColumn("island", F.col("pdf_page") - F.row_number().over(by))
    size = F.count("*").over(Window.partitionBy("book_id", "offset", "island"))
    return runs.withColumn("run", size).where(F.col("run") >= config.margin_min_consecutive_pages).select("book_id", "offset", "pdf_page")


def without_margins(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """Lines less repeated margin texts and margin lines with a reliable page number."""
    slotted = with_margin_slot(lines, config)
    inner = slotted.where("side is null").select(*lines.columns)
    margin = slotted.where("side is not null").withColumn("key", X.lowered("text"))
    repeated = repeated_margin_lines(lines, config).select("book_id", "side", "bucket", "key")
    kept = margin.join(repeated, ["book_id", "side", "bucket", "key"], "left_anti")
    numbered = kept.select("book_id", "line_id", "pdf_page", F.explode(margin_numbers(config)).alias("n"))
    reliable = reliable_page_offsets(lines, config)
    bad = numbered.withColumn("offset", F.col("pdf_page") - F.col("n")).join(reliable, ["book_id", "offset", "pdf_page"], "left_semi").select("book_id", "line_id").distinct()
    return inner.unionByName(kept.join(bad, ["book_id", "line_id"], "left_anti").select(*lines.columns))


_ROW = ["y0", "x0", "line_id", "x1", "y1", "text", "font_size", "height", "is_bold", "font_names", "page_width", "page_height"]


def _joined(groups: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Lines of groups (an array ``g`` of rows in order): the first one's id, the common box, sizes by their median, texts from left to right."""
    g = F.col("g")
    of = lambda k: folds.members(g, k)
    across = F.array_sort(F.transform(g, lambda r: F.struct(r["x0"].alias("x"), r["y0"].alias("y"), r["line_id"].alias("i"), r["text"].alias("t"))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(g, lambda r: F.coalesce(r["font_names"], F.array().cast("array<string>"))))))
    one = F.size(g) == 1
    made = {
        "line_id": of("line_id")[0], "text": F.when(one, of("text")[0]).otherwise(X.normalized(F.array_join(F.transform(across, lambda x: x["t"]), " "))),
        "x0": folds.low(of("x0")), "y0": folds.low(of("y0")), "x1": folds.high(of("x1")), "y1": folds.high(of("y1")), "page_width": of("page_width")[0], "page_height": of("page_height")[0],
        "font_size": folds.median(of("font_size")), "height": folds.median(of("height")), "is_bold": F.when(one, of("is_bold")[0]).otherwise(F.exists(g, lambda r: F.coalesce(r["is_bold"], F.lit(False)))), "font_names": F.when(one, of("font_names")[0]).otherwise(names),
    }
    return groups.select(*[made[c].alias(c) if c in made else F.col(c) for c in [*LINE, *extra]])


def print_groups(y0: list[float], y1: list[float], x0: list[float], x1: list[float]) -> list[list[int]]:
    """Places of the lines of each group, for lines in order of (y0, x0).

    A group that ends at or above a line's head can take neither it nor a later one, so only the others are looked at.
    """
    groups, live = [], []
    for n, (top, foot, left, right) in enumerate(zip(y0, y1, x0, x1)):
        live = [g for g in live if g[1] > top]
        for g in reversed(live):
            if min(foot, g[1]) > max(top, g[0]) and all(right <= a or left >= b for a, b in g[3]):
                g[0], g[1] = min(g[0], top), max(g[1], foot)
                break
        else:
            g = [top, foot, [], []]
            groups.append(g[2])
            live.append(g)
        g[2].append(n)
        g[3].append((left, right))
    return groups


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _print_groups(runs: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in runs:
        yield pd.Series([print_groups(*[v.tolist() for v in run]) for run in zip(*columns)], dtype=object)


def merge_print_fragments(lines: DataFrame) -> DataFrame:
    """Pieces of one printed line put together: they overlap in height and not in width.

    In order of (y0, x0) a line joins the latest group on its page that it overlaps in height
    while lying beside every member. A line below all lines before it can join none of them, so a page
    falls into runs of lines that overlap in height, and a run of one line passes by the fold. A run with a
    coordinate missing is folded as an expression, by whose rules nulls and NaN are compared.
    """
    by = Window.partitionBy("book_id", "pdf_page").orderBy("y0", "x0", "line_id")
    below = F.coalesce(F.max("y1").over(by.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("y0"), F.lit(True))
    runs = lines.select(*LINE).withColumn("below", below).withColumn("run", F.sum(F.col("below").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(*_ROW)
    kind = runs.select(row.alias("r")).schema["r"].dataType.simpleString()

    def fits(g: Column, r: Column) -> Column:
        over = F.least(r["y1"], folds.high(folds.members(g, "y1"))) > F.greatest(r["y0"], folds.low(folds.members(g, "y0")))
        return over & F.forall(g, lambda m: (r["x1"] <= m["x0"]) | (r["x0"] >= m["x1"]))

    rows = F.array_sort(F.collect_list(row), lambda a, b: _before(a, b))
    merged = runs.groupBy("book_id", "pdf_page", "run").agg(rows.alias("rows"))
    missing = F.exists("rows", lambda r: reduce(lambda p, q: p | q, [r[k].isNull() | F.isnan(r[k]) for k in ("y0", "y1", "x0", "x1")]))
    told = merged.withColumn("missing", missing)
    plain = (F.size("rows") > 1) & ~F.col("missing")
    of = lambda k: F.when(plain, F.transform("rows", lambda r: r[k])).otherwise(F.array().cast("array<double>"))
    told = told.withColumn("places", _print_groups(of("y0"), of("y1"), of("x0"), of("x1")))
    groups = F.when(F.size("rows") == 1, F.array("rows")).when(F.col("missing"), folds.grouped(F.col("rows"), kind, fits, latest_only=False))
    groups = groups.otherwise(F.transform("places", lambda g: F.transform(g, lambda i: F.get("rows", i))))
    return _joined(told.select("book_id", "pdf_page", F.explode(groups).alias("g")))


def _before(a: Column, b: Column) -> Column:
    """Order of rows by y0, x0 and id."""
    key = lambda r: F.struct(r["y0"].alias("y"), r["x0"].alias("x"), r["line_id"].alias("i"))
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def merge_same_tier_lines(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """Neighbouring lines of one font tier and page joined while their gap is small (the older heading path).

    ``lines`` has a ``tier`` column. A line joins what was put together before it if it lies no farther below its foot
    than a share of the larger height; it may overlap it. Sizes and heights are those of the
    joined line and the next one in the middle, to two places, at every step. A change of tier parts a page into runs.
    """
    by = Window.partitionBy("book_id", "pdf_page").orderBy("y0", "x0", "line_id")
    changed = F.coalesce(F.lag("tier").over(by) != F.col("tier"), F.lit(True))
    runs = lines.select(*LINE, "tier").withColumn("changed", changed).withColumn("run", F.sum(F.col("changed").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(*_ROW, F.col("y1").alias("foot"), F.col("height").alias("tall"), F.col("font_size").alias("sized"))
    kind = runs.select(row.alias("r")).schema["r"].dataType.simpleString()
    mid = lambda a, b: F.round((a + b) / 2, 2)

    # every row keeps what was put together up to it: foot, tall and sized of the last one stand for the joined line
    def put(groups: Column, r: Column) -> Column:
        last = F.element_at(groups, -1)
        end = F.element_at(last, -1)
        joins = (F.size(groups) > 0) & F.coalesce(r["y0"] - end["foot"] <= F.greatest(end["tall"], r["height"]) * config.heading_merge_gap_ratio, F.lit(False))
        carried = r.withField("foot", F.greatest(end["foot"], r["y1"])).withField("tall", mid(end["tall"], r["height"])).withField("sized", mid(end["sized"], r["font_size"]))
        return F.when(joins, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.concat(last, F.array(carried))))).otherwise(F.concat(groups, F.array(F.array(r))))

    rows = F.array_sort(F.collect_list(row), lambda a, b: _before(a, b))
    folded = runs.groupBy("book_id", "pdf_page", "run", "tier").agg(rows.alias("rows")).select("book_id", "pdf_page", "tier", F.explode(F.aggregate("rows", F.array().cast(f"array<array<{kind}>>"), put)).alias("g"))
    end = F.element_at("g", -1)
    texts = X.normalized(F.array_join(F.transform("g", lambda r: r["text"]), " "))
    sized = folded.withColumn("__s", end["sized"]).withColumn("__h", end["tall"]).withColumn("__t", texts)
    return _joined(sized, ("tier", "__s", "__h", "__t")).withColumn("font_size", F.col("__s")).withColumn("height", F.col("__h")).withColumn("text", F.col("__t")).select(*LINE, "tier")
