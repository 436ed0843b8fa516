"""Plans of headings: levels, parents, page ranges, insertion and validation, by window functions.

A stack over a sequence of tiers is replaced by a last-seen vector: for every tier the position
of its latest item so far. Tiers are ranked within their book first, so the vector has as many
columns as the deepest book has distinct tiers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.config import OutlineQualityConfig
from folioweave.functions import text as X
from folioweave.runtime import cut


def _ranked(plan: DataFrame, tier: str) -> tuple[DataFrame, int]:
    # the depth decides the columns, so what the plan is made from is computed once, here
    plan = cut(plan)
    ranks = plan.select("book_id", tier).distinct().withColumn("__t", F.dense_rank().over(Window.partitionBy("book_id").orderBy(tier)))
    depth = ranks.agg(F.max("__t")).first()[0] or 1
    return plan.join(ranks, ["book_id", tier]), int(depth)


def _seen(depth: int, ahead: bool) -> list[Column]:
    """For every tier, the ``ord`` of its nearest item before (or after) this one."""
    # looking ahead is looking back in falling order; a frame that ends with the partition would be summed up anew for every row
    w = Window.partitionBy("book_id").orderBy(F.desc("ord") if ahead else "ord").rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min if ahead else F.max
    return [pick(F.when(F.col("__t") == t, F.col("ord"))).over(w).alias(f"__s{t}") for t in range(1, depth + 1)]


def _of(values: list[Column], pick) -> Column:
    return reduce(lambda a, b: pick(a, b), values) if len(values) > 1 else values[0]


def levels(plan: DataFrame, tier: str = "level") -> DataFrame:
    """``plan`` with ``depth`` (1 for a root): how many earlier items are still open at this one.

    An earlier item is open if nothing of its tier or a higher one came after it.
    """
    ranked, depth = _ranked(plan, tier)
    wide = ranked.select("*", *_seen(depth, False))
    opened = []
    for t in range(1, depth + 1):
        later = _of([F.coalesce(f"__s{s}", F.lit(-1)) for s in range(1, t)], F.greatest) if t > 1 else F.lit(-1)
        opened.append(F.when((F.col("__t") > t) & F.col(f"__s{t}").isNotNull() & (F.col(f"__s{t}") > later), 1).otherwise(0))
    return wide.withColumn("depth", 1 + reduce(lambda a, b: a + b, opened)).select(*plan.columns, "depth")


def parents(plan: DataFrame, tier: str = "level") -> DataFrame:
    """``plan`` with ``parent_ord``: the nearest earlier item of a higher tier, null for a root."""
    ranked, depth = _ranked(plan, tier)
    wide = ranked.select("*", *_seen(depth, False))
    return wide.withColumn("parent_ord", _of([F.when(F.col("__t") > t, F.col(f"__s{t}")) for t in range(1, depth + 1)] + [F.lit(None)], F.greatest)).select(*plan.columns, "parent_ord")


def nearest_above(plan: DataFrame) -> DataFrame:
    """(book_id, ord, above_ord): the nearest earlier item exactly one level up, null without one.

    Every item asks under the level above its own and answers under its own, so a window holds two
    levels of a book and no column depends on how deep the books are.
    """
    asks = plan.where("level > 1").select("book_id", (F.col("level") - 1).alias("k"), "ord", F.lit(None).cast("int").alias("own"))
    answers = plan.select("book_id", F.col("level").alias("k"), "ord", F.col("ord").cast("int").alias("own"))
    by = Window.partitionBy("book_id", "k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    asked = asks.unionByName(answers).withColumn("above_ord", F.last("own", ignorenulls=True).over(by)).where("own is null")
    return plan.select("book_id", "ord").join(asked.select("book_id", "ord", "above_ord"), ["book_id", "ord"], "left")


def ranges(plan: DataFrame, totals: DataFrame, tier: str = "level") -> DataFrame:
    """``plan`` with ``start_page`` and ``end_page``: up to the page before the next item of its tier or a higher one.

    The range never ends before it starts; without such an item it ends with the book
    (``totals``: book_id, total_pages).
    """
    ranked, depth = _ranked(plan, tier)
    wide = ranked.select("*", *_seen(depth, True))
    nxt = _of([F.when(F.col("__t") >= t, F.col(f"__s{t}")) for t in range(1, depth + 1)] + [F.lit(None)], F.least)
    wide = wide.withColumn("__n", nxt)
    at = plan.select("book_id", F.col("ord").alias("__n"), F.col("pdf_page").alias("__p"))
    return wide.join(at, ["book_id", "__n"], "left").join(totals, "book_id", "left").select(
        *[F.col(c) for c in plan.columns], F.col("pdf_page").alias("start_page"), F.greatest(F.col("pdf_page"), F.coalesce(F.col("__p") - 1, F.col("total_pages"))).cast("int").alias("end_page")
    )


def normalized_plan(plan: DataFrame) -> DataFrame:
    """The plan with pages of 1 or more and titles that aren't blank, once for each page and lower-case title, its levels without gaps."""
    clean = plan.where((F.col("pdf_page") >= 1) & (X.normalized("title") != ""))
    first = Window.partitionBy("book_id", "pdf_page", F.lower("title")).orderBy("ord")
    once = clean.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r").withColumn("level", F.greatest(F.lit(1), "level"))
    order = Window.partitionBy("book_id").orderBy("ord")
    return levels(once).withColumn("level", F.col("depth").cast("int")).drop("depth").withColumn("ord", F.row_number().over(order))


def plan_of_headings(headings: DataFrame, max_words: int = 30, pollution: float = 0.30) -> DataFrame:
    """Headings (tier, y0) as a plan: overlong ones one level lower, levels with too many of those left out."""
    order = Window.partitionBy("book_id").orderBy("pdf_page", "y0", "x0", "chunk_id")
    plan = headings.withColumn("ord", F.row_number().over(order)).withColumn("polluted", X.word_count("title") > max_words)
    deep = levels(plan, "tier").withColumn("level", (F.col("depth") + F.col("polluted").cast("int")).cast("int"))
    share = F.avg(F.col("polluted").cast("double")).over(Window.partitionBy("book_id", "level"))
    return deep.withColumn("__s", share).where(F.col("__s") <= pollution).select("book_id", "ord", "title", "level", "pdf_page", "source", F.lit(0.8).alias("confidence"))


def deepest_parent(pages: DataFrame, ranged: DataFrame) -> DataFrame:
    """``pages`` (book_id, pdf_page, ...) with the range that holds the page: the deepest, of those the latest to start, of those the last."""
    owned = ranged.select("book_id", F.explode(F.sequence("start_page", "end_page")).alias("pdf_page"), F.struct("level", "start_page", "ord").alias("k"))
    best = owned.groupBy("book_id", "pdf_page").agg(F.max("k").alias("k"))
    return pages.join(best, ["book_id", "pdf_page"], "left").select(*pages.columns, F.col("k.level").alias("parent_level"), F.col("k.ord").alias("parent_ord"))


def insert_fallback(plan: DataFrame, extra: DataFrame, totals: DataFrame) -> DataFrame:
    """The plan with further titles (book_id, pdf_page, y0, title, confidence), each one level below the range that holds its page.

    A title whose page no range holds is left out; so a book without a plan gets none.
    """
    order = Window.partitionBy("book_id").orderBy("pdf_page", "y0")
    late = deepest_parent(extra.withColumn("ord", F.row_number().over(order)), ranges(plan, totals))
    late = late.where("parent_ord is not null").select("book_id", "ord", "title", (F.col("parent_level") + 1).cast("int").alias("level"), "pdf_page", F.lit("geometry_position_fallback").alias("source"), "confidence", F.lit(1).alias("tag"))
    both = plan.select("book_id", "ord", "title", "level", "pdf_page", "source", "confidence", F.lit(0).alias("tag")).unionByName(late)
    by = Window.partitionBy("book_id").orderBy("pdf_page", "tag", "ord")
    return normalized_plan(both.withColumn("ord", F.row_number().over(by)).drop("tag"))


def validation(plan: DataFrame, totals: DataFrame) -> DataFrame:
    """(book_id, ord, warning) of every structural fault of a plan."""
    by = Window.partitionBy("book_id").orderBy("ord")
    seen = plan.join(totals, "book_id", "left").withColumn("__l", F.lag("level").over(by)).withColumn("__p", F.lag("pdf_page").over(by))
    faults = [
        (X.normalized("title") == "", "blank_title"),
        (F.col("level") < 1, "level_below_one"),
        (F.col("level") > F.col("__l") + 1, "level_jump"),
        ((F.col("pdf_page") < 1) | (F.col("pdf_page") > F.col("total_pages")), "page_out_of_range"),
        (F.col("pdf_page") < F.col("__p"), "page_goes_back"),
    ]
    return seen.select("book_id", "ord", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in faults]))).alias("warning"))


# Digits of every kind that make a title a mere number: decimal, raised, lowered, circled.
DIGITS = r"^[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]+$"


def quality(outline: DataFrame, totals: DataFrame, config: OutlineQualityConfig = OutlineQualityConfig()) -> DataFrame:
    """(book_id, items, low_quality, reasons, evidence) of stored outlines; books without one have no row.

    ``evidence`` has a sentence for each reason, in the same order; the mere numbers are the first five.
    """
    name = F.trim("title")
    numeric = name.rlike(DIGITS)
    numbers = F.slice(F.transform(F.array_sort(F.collect_list(F.when(numeric, F.struct(F.col("ord"), name.alias("t"))))), lambda x: x["t"]), 1, 5)
    by_book = outline.groupBy("book_id").agg(F.count("*").alias("items"), F.count_if(numeric).alias("numeric"), numbers.alias("numbers"))
    joined = by_book.join(totals, "book_id", "left")
    least, ratio = config.min_item_count, config.max_item_to_page_ratio
    rules = [
        (F.col("items") < least, "too_few_items", F.format_string(f"item_count=%d < min_item_count={least}", "items")),
        ((F.col("total_pages") > 0) & (F.col("items") >= F.col("total_pages") * ratio), "near_one_bookmark_per_page", F.format_string(f"item_count=%d >= total_pages(%d) * max_item_to_page_ratio({ratio})", "items", "total_pages")),
        (F.lit(config.flag_numeric_only_titles) & (F.col("numeric") > 0), "numeric_only_title", F.concat(F.lit("numeric_only_titles=['"), F.array_join("numbers", "', '"), F.lit("']"))),
    ]
    told = lambda k: F.array_compact(F.array(*[F.when(r[0], F.lit(r[k]) if k == 1 else r[k]) for r in rules]))
    return joined.withColumn("reasons", told(1)).withColumn("evidence", told(2)).select("book_id", "items", (F.size("reasons") > 0).alias("low_quality"), "reasons", "evidence")


def bookmark_sets(outline: DataFrame) -> DataFrame:
    """(book_id, meaningful, clean, has_letter): two levels or more; and the stricter conditions of a reference outline.

    Pages are compared with the page of the last item before that has one.
    """
    by = Window.partitionBy("book_id").orderBy("ord")
    keyword = F.lower("title").rlike(r"(?U)\b(?:chapter|section|appendix|part)\b|\d+\.\d+")
    before = F.last("pdf_page", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    agg = outline.withColumn("__p", before).groupBy("book_id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("title", F.lit("")) == "").alias("blank"), F.count("pdf_page").alias("paged"),
        F.count_if(F.col("pdf_page") >= F.col("__p")).alias("rising"), F.count_if(F.col("pdf_page").isNotNull() & F.col("__p").isNotNull()).alias("steps"),
        F.count_distinct("level").alias("levels"), F.coalesce(F.bool_or(keyword), F.lit(False)).alias("keyword"), F.coalesce(F.bool_or(F.col("title").rlike(r"\p{L}")), F.lit(False)).alias("has_letter"),
    )
    clean = (F.col("n") >= 10) & (F.col("blank") == 0) & (F.col("paged") >= 0.8 * F.col("n")) & (F.col("rising") >= 0.75 * F.col("steps")) & (F.col("levels") >= 2) & F.col("keyword")
    return agg.select("book_id", (F.col("levels") >= 2).alias("meaningful"), clean.alias("clean"), "has_letter")


def skip_reasons(outline: DataFrame) -> DataFrame:
    """(book_id, items): the books that a run which skips stored outlines leaves out, with how many items they have."""
    return outline.groupBy("book_id").agg(F.count("*").alias("items"))


def reuse_decision(quality_rows: DataFrame, warnings: DataFrame, skip_existing: bool = True, replace_low: bool = False) -> DataFrame:
    """(book_id, reuse, reason): whether a stored outline is used as it is, else why not, the graver reason first."""
    bad = warnings.select("book_id").distinct().withColumn("bad", F.lit(True))
    joined = quality_rows.join(bad, "book_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    reason = F.when(F.col("bad"), "invalid_structure").when(F.lit(not skip_existing), "skip_disabled").when(F.col("low_quality") & F.lit(replace_low), "low_quality_replace")
    return joined.select("book_id", reason.isNull().alias("reuse"), reason.alias("reason"))
