"""Outlines against references: matching, metrics, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions.similarity import blocked_pairs, with_similarity
from folioweave.functions.unicode import title_key


def scored_pairs(gold: DataFrame, pred: DataFrame, tolerance: int = 1, threshold: float = 0.7) -> DataFrame:
    """(book_id, gold_ord, pred_ord, similarity, page_gap, both levels and sources) of pairs near enough in page and alike in title."""
    g = gold.select("book_id", F.col("ord").alias("gold_ord"), F.col("title").alias("gold_title"), F.col("pdf_page").alias("gold_page"), F.col("level").alias("gold_level"), F.col("source").alias("gold_source"))
    p = pred.select("book_id", F.col("ord").alias("pred_ord"), F.col("title").alias("pred_title"), F.col("pdf_page").alias("pred_page"), F.col("level").alias("pred_level"), F.col("source").alias("pred_source"))
    pairs = blocked_pairs(g.where("gold_page is not null"), p.where("pred_page is not null"), ["book_id"], "gold_page", "pred_page", tolerance)
    return with_similarity(pairs, "gold_title", "pred_title").where(F.col("similarity") >= threshold).withColumn("page_gap", (F.col("pred_page") - F.col("gold_page")).cast("int"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches: the best score first, of equals the earlier reference row, then the earlier other row.

    A pair that is the best at both of its ends is taken by any greedy order, so the choice is
    made by rounds over all books at once, until no pair is left.
    """
    from folioweave.runtime import cut

    left = cut(pairs.select("book_id", F.col("gold_ord").cast("int").alias("gold_ord"), F.col("pred_ord").cast("int").alias("pred_ord"), "similarity", "page_gap"))
    done = None
    while True:
        order = [F.desc("similarity"), "gold_ord", "pred_ord"]
        a, b = Window.partitionBy("book_id", "gold_ord").orderBy(*order), Window.partitionBy("book_id", "pred_ord").orderBy(*order)
        won = cut(left.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).where("a = 1 and b = 1").drop("a", "b"))
        if won.limit(1).count() == 0:
            return won if done is None else done
        done = won if done is None else done.unionByName(won)
        left = cut(left.join(won.select("book_id", "gold_ord"), ["book_id", "gold_ord"], "left_anti").join(won.select("book_id", "pred_ord"), ["book_id", "pred_ord"], "left_anti"))


def metrics(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall, F1, Jaccard and the share of exact pages for each book that either side has."""
    g = gold.groupBy("book_id").agg(F.count("*").alias("gold"))
    p = pred.groupBy("book_id").agg(F.count("*").alias("predicted"))
    m = matches.groupBy("book_id").agg(F.count("*").alias("matched"), F.count_if(F.col("page_gap") == 0).alias("exact"))
    full = g.join(p, "book_id", "full").join(m, "book_id", "left").select("book_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gold", "predicted", "matched", "exact")])
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    hit = F.col("matched")
    return full.select(
        "book_id", "gold", "predicted", "matched", rate(hit, F.col("predicted")).alias("precision"), rate(hit, F.col("gold")).alias("recall"),
        rate(2 * hit, F.col("gold") + F.col("predicted")).alias("f1"), rate(hit, F.col("gold") + F.col("predicted") - hit).alias("jaccard"), rate(F.col("exact"), hit).alias("exact_page_rate"),
    )


def plan_difference(before: DataFrame, after: DataFrame, tolerance: int = 0, threshold: float = 0.7) -> DataFrame:
    """Counters for each book: added, removed, matched, unchanged (title, page and level alike), moved, level_changed, source_changed."""
    pairs = scored_pairs(before, after, tolerance, threshold)
    m = greedy_matches(pairs).join(pairs.select("book_id", F.col("gold_ord").cast("int").alias("gold_ord"), F.col("pred_ord").cast("int").alias("pred_ord"), "gold_level", "pred_level", "gold_title", "pred_title", "gold_source", "pred_source"), ["book_id", "gold_ord", "pred_ord"])
    moved, relevelled = F.col("page_gap") != 0, F.col("gold_level") != F.col("pred_level")
    same = ~moved & ~relevelled & (F.col("gold_title") == F.col("pred_title"))
    each = m.groupBy("book_id").agg(F.count("*").alias("matched"), F.count_if(same).alias("unchanged"), F.count_if(moved).alias("moved"), F.count_if(relevelled).alias("level_changed"), F.count_if(~F.col("gold_source").eqNullSafe(F.col("pred_source"))).alias("source_changed"))
    sides = before.groupBy("book_id").agg(F.count("*").alias("b")).join(after.groupBy("book_id").agg(F.count("*").alias("a")), "book_id", "full").join(each, "book_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return sides.select("book_id", (n("a") - n("matched")).alias("added"), (n("b") - n("matched")).alias("removed"), *[n(c).alias(c) for c in ("matched", "unchanged", "moved", "level_changed", "source_changed")])


def node_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book_id, added, removed, common) nodes by (level, start page, title key); null levels and pages are equal to each other."""
    key = ["book_id", "level", "start_page", "k"]
    sides = [d.select("book_id", "level", "start_page", title_key("title").alias("k")).distinct().withColumn("side", F.lit(n)) for n, d in ((1, a), (2, b))]
    each = sides[0].unionByName(sides[1]).groupBy(*key).agg(F.sum("side").alias("s"))
    return each.groupBy("book_id").agg(F.count_if(F.col("s") == 2).alias("added"), F.count_if(F.col("s") == 1).alias("removed"), F.count_if(F.col("s") == 3).alias("common"))
