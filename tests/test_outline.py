import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.functions.similarity import with_similarity
from folioweave.operators import evaluation as V
from folioweave.operators import outline as O

PLAN = "book_id string, ord int, title string, level int, pdf_page int, source string, confidence double"


def plan(spark, levels, book="b"):
    return spark.createDataFrame([(book, i + 1, f"t{i}", v, i + 1, "s", 1.0) for i, v in enumerate(levels)], PLAN)


VECTORS = [([1, 5, 5], [1, 2, 2]), ([2, 4], [1, 2]), ([3, 5], [1, 2]), ([4, 6], [1, 2]), ([5, 7], [1, 2]), ([1, 4, 6, 4, 1], [1, 2, 3, 2, 1])]


def test_levels_of_the_acceptance_vectors(spark):
    all_ = None
    for n, (raw, _) in enumerate(VECTORS):
        p = plan(spark, raw, f"b{n}")
        all_ = p if all_ is None else all_.unionByName(p)
    got = {}
    for r in O.normalized_plan(all_).orderBy("ord").collect():
        got.setdefault(r.book_id, []).append(r.level)
    assert got == {f"b{n}": want for n, (_, want) in enumerate(VECTORS)}


def test_levels_parents_ranges_against_a_stack(spark):
    rng = random.Random(5)
    books = {f"b{n}": [rng.randint(1, 6) for _ in range(rng.randint(1, 25))] for n in range(12)}
    p = None
    for b, lv in books.items():
        p = plan(spark, lv, b) if p is None else p.unionByName(plan(spark, lv, b))
    totals = p.groupBy("book_id").agg((F.max("pdf_page") + 3).alias("total_pages"))
    depth = {(r.book_id, r.ord): r.depth for r in O.levels(p).collect()}
    parent = {(r.book_id, r.ord): r.parent_ord for r in O.parents(p).collect()}
    end = {(r.book_id, r.ord): r.end_page for r in O.ranges(p, totals).collect()}
    for b, lv in books.items():
        stack = []
        for i, v in enumerate(lv):
            while stack and lv[stack[-1]] >= v:
                stack.pop()
            assert depth[(b, i + 1)] == len(stack) + 1
            assert parent[(b, i + 1)] == (stack[-1] + 1 if stack else None)
            stack.append(i)
            nxt = next((j for j in range(i + 1, len(lv)) if lv[j] <= v), None)
            assert end[(b, i + 1)] == (max(i + 1, nxt) if nxt is not None else len(lv) + 3)


def test_blank_titles_bad_pages_and_repeats_leave_the_plan(spark):
    rows = [("b", 1, "A", 1, 1, "s", 1.0), ("b", 2, "a", 2, 1, "s", 1.0), ("b", 3, " ", 1, 2, "s", 1.0), ("b", 4, "C", 1, 0, "s", 1.0), ("b", 5, None, 1, 3, "s", 1.0)]
    assert [r.title for r in O.normalized_plan(spark.createDataFrame(rows, PLAN)).collect()] == ["A"]
    assert O.normalized_plan(spark.createDataFrame([], PLAN)).count() == 0


@pytest.mark.parametrize("a,b,want", [("Alpha", "alpha", 1.0), ("Introduction", "1.1 Introduction to Finance", 1.0), ("", "x", 0.0), (None, "x", 0.0)])
def test_similarity(spark, a, b, want):
    assert with_similarity(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first().similarity == want


def test_unlike_titles_and_text_vectors(spark):
    one = spark.createDataFrame([("Chapter 1: Finance", "Appendix B: Glossary", "A\x08  \n B", "1.1 ﬁnance ............ 27")], "a string, b string, c string, d string")
    assert with_similarity(one, "a", "b").first().similarity < 0.5
    r = one.select(X.normalized("c").alias("c"), X.match_key("d").alias("d")).first()
    assert (r.c, r.d) == ("A B", "1 1 finance")
    depths = spark.createDataFrame([("3",), ("Chapter 4 Introduction",), ("2.3.1 Markov Chains",), ("No number",)], "t string").select(X.ocr_numbering_depth("t").alias("d"))
    assert [r.d for r in depths.collect()] == [0, 1, 3, -1]


def test_matches_are_one_to_one_and_near(spark):
    gold = spark.createDataFrame([("b", 1, "Alpha Beta", 1, 5, "s", 1.0), ("b", 2, "Alpha Beta", 1, 6, "s", 1.0)], PLAN)
    pred = spark.createDataFrame([("b", 1, "alpha beta", 1, 6, "s", 1.0), ("c", 1, "Other", 1, 1, "s", 1.0)], PLAN)
    m = V.greedy_matches(V.scored_pairs(gold, pred))
    assert [(r.gold_ord, r.pred_ord) for r in m.collect()] == [(1, 1)]
    got = {r.book_id: r for r in V.metrics(gold, pred, m).collect()}
    assert (got["b"].precision, got["b"].recall, got["b"].exact_page_rate) == (1.0, 0.5, 0.0) and got["c"].f1 == 0.0
