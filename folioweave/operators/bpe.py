"""Headings by merging neighbouring lines of recurring size classes.

Lines of the body's class and smaller ones are separators. What lies between two of them on a page is
a run of heading lines; in every round the pair of class sequences that recurs most often in a book is merged
wherever it stands close enough. All books go through a round together, and a book leaves when no pair recurs often
enough, so the number of rounds is that of the book that merges longest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import TypographyConfig
from folioweave.functions import text as X
from folioweave.runtime import cut


def relative_spacing(upper_y0: Column, upper_height: Column, lower_y0: Column, lower_height: Column) -> Column:
    """Distance of two lines in heights of the larger one, null where the second does not lie below the first."""
    delta = lower_y0 - upper_y0
    return F.when(delta > 0, delta / F.greatest(upper_height, lower_height, F.lit(1e-6)))


def body_tier(lines: DataFrame) -> DataFrame:
    """(book_id, body_tier): the class with most lines, of equals the smaller print."""
    return lines.groupBy("book_id", "tier").agg(F.count("*").alias("n")).groupBy("book_id").agg(F.max(F.struct("n", "tier")).alias("m")).select("book_id", F.col("m.tier").alias("body_tier"))


def flagged(lines: DataFrame) -> DataFrame:
    """``lines`` (with a ``tier``) with ``is_body``: of the body's class or smaller print."""
    return lines.join(body_tier(lines), "book_id").withColumn("is_body", F.col("tier") >= F.col("body_tier")).drop("body_tier")


def body_spacing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((book_id, pdf_page, page_spacing), (book_id, book_spacing)): median relative spacing of neighbouring body lines.

    ``rows`` are those of :func:`flagged`. A page without two body lines one below the other has no row.
    """
    by = Window.partitionBy("book_id", "pdf_page").orderBy("y0", "x0", "line_id")
    gap = relative_spacing(F.lag("y0").over(by), F.lag("height").over(by), F.col("y0"), F.col("height"))
    gaps = rows.where("is_body").withColumn("gap", gap).where("gap is not null")
    middle = lambda name: F.percentile("gap", F.lit(0.5)).alias(name)
    return gaps.groupBy("book_id", "pdf_page").agg(middle("page_spacing")), gaps.groupBy("book_id").agg(middle("book_spacing"))


def _near(a: Column, b: Column, limit: Column) -> Column:
    gap = relative_spacing(a["y0"], a["height"], b["y0"], b["height"])
    return gap.isNotNull() & (gap <= limit)


def _pairs(runs: DataFrame) -> DataFrame:
    """(book_id, a, b, n, at): the pairs of class sequences that could be merged, how often, and where first."""
    t = F.col("tokens")
    two = F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.when(b.isNotNull() & _near(a, b, F.col("limit")), F.struct(a["seq"].alias("a"), b["seq"].alias("b"), a["n"].alias("n"))))
    each = runs.select("book_id", "pdf_page", F.explode(F.array_compact(two)).alias("p"))
    return each.groupBy("book_id", "p.a", "p.b").agg(F.count("*").alias("n"), F.min(F.struct("pdf_page", "p.n")).alias("at"))


def _merged(tokens: Column, a: Column, b: Column, limit: Column, kind: str) -> Column:
    """Tokens with the pair merged from left to right; what was merged in this round is not merged again."""

    def put(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & last["fresh"] & (last["seq"] == a) & (r["seq"] == b) & _near(last, r, limit)
        both = F.struct(
            last["n"].alias("n"), F.concat_ws(",", last["seq"], r["seq"]).alias("seq"), F.least(last["tier"], r["tier"]).alias("tier"), last["y0"].alias("y0"), last["x0"].alias("x0"), r["y1"].alias("y1"),
            (last["height"] + r["height"]).alias("height"), X.normalized(F.concat_ws(" ", last["text"], r["text"])).alias("text"), (last["lines"] + r["lines"]).alias("lines"), F.lit(False).alias("fresh"),
        )
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(r)))

    return F.transform(F.aggregate(tokens, F.array().cast(kind), put), lambda r: r.withField("fresh", F.lit(True)))


def bpe_headings(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """(book_id, title, pdf_page, tier, y0, x0, y1, merged_line_count, polluted, chunk_id, source) of the headings of every book.

    ``lines`` have a ``tier``. A pair is close enough up to the median spacing of its page's body lines, else of its
    book's, else 1. Of pairs that recur equally often the one that stands first goes first. A heading
    of more than ``bpe_max_node_words`` words is polluted. Titles without text are left out; an empty table gives no rows.
    """
    rows = cut(flagged(lines))
    page, book = body_spacing(rows)
    by = Window.partitionBy("book_id", "pdf_page").orderBy("y0", "x0", "line_id")
    ordered = rows.withColumn("n", F.row_number().over(by)).withColumn("run", F.sum(F.col("is_body").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    token = F.struct("n", F.col("tier").cast("string").alias("seq"), "tier", "y0", "x0", "y1", "height", X.normalized("text").alias("text"), F.lit(1).alias("lines"), F.lit(True).alias("fresh"))
    runs = ordered.where(~F.col("is_body")).groupBy("book_id", "pdf_page", "run").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    limit = F.coalesce("page_spacing", "book_spacing", F.lit(1.0))
    runs = cut(runs.join(page, ["book_id", "pdf_page"], "left").join(book, "book_id", "left").select("book_id", "pdf_page", "tokens", limit.alias("limit")))
    kind = runs.schema["tokens"].dataType.simpleString()
    # a single line has no neighbour to be merged with
    done, open_ = [runs.where(F.size("tokens") < 2)], runs.where(F.size("tokens") >= 2)
    for _ in range(config.bpe_max_iterations):
        best = _pairs(open_).groupBy("book_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "at", "a", "b")).alias("m")).where(F.col("m.minus") <= -config.bpe_min_pair_count)
        best = cut(best.select("book_id", "m.a", "m.b"))
        if best.isEmpty():
            break
        done.append(open_.join(best, "book_id", "left_anti"))
        open_ = cut(open_.join(best, "book_id").select("book_id", "pdf_page", _merged(F.col("tokens"), F.col("a"), F.col("b"), F.col("limit"), kind).alias("tokens"), "limit"))
    whole = reduce(DataFrame.unionByName, [*done, open_])
    t = whole.select("book_id", "pdf_page", F.explode("tokens").alias("t")).where("t.text <> ''")
    return t.select(
        "book_id", F.col("t.text").alias("title"), "pdf_page", "t.tier", "t.y0", "t.x0", "t.y1", F.col("t.lines").alias("merged_line_count"), (X.word_count("t.text") > config.bpe_max_node_words).alias("is_pollution"),
        F.col("t.n").cast("long").alias("chunk_id"), F.lit("bpe_typography").alias("source"),
    )
