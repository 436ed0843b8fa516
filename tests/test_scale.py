import time
from difflib import SequenceMatcher

import numpy as np

from folioweave.config import TypographyConfig
from folioweave.functions.similarity import alike
from folioweave.operators import geometry as G
from folioweave.operators import lines as L
from folioweave.operators import outline as O
from folioweave.plans import pipeline as P
from tests.test_typography import LINE, golden


def test_print_fragments_of_a_crowded_page(spark):
    rng = np.random.default_rng(5)
    rows = sorted(((float(y), float(x), n, float(x + w), float(y + h)) for n, (y, x, w, h) in enumerate(zip(rng.integers(0, 300, 700), rng.integers(0, 90, 700), rng.integers(1, 30, 700), rng.integers(4, 12, 700)))))
    groups = []
    for y0, x0, n, x1, y1 in rows:
        for g in reversed(groups):
            if min(y1, max(m[4] for m in g)) > max(y0, min(m[0] for m in g)) and all(x1 <= m[1] or x0 >= m[3] for m in g):
                g.append((y0, x0, n, x1, y1))
                break
        else:
            groups.append([(y0, x0, n, x1, y1)])
    table = [("b", n, 1, f"t{n}", x0, y0, x1, y1, 100.0, 320.0, 10.0, 8.0, False, []) for y0, x0, n, x1, y1 in rows]
    got = L.merge_print_fragments(spark.createDataFrame(table, LINE)).collect()
    assert sorted((r.line_id, r.y1, len(r.text.split())) for r in got) == sorted((g[0][2], max(m[4] for m in g), len(g)) for g in groups)
    assert L.print_groups(*[[r[k] for r in rows] for k in (0, 4, 1, 3)]) == [[rows.index(m) for m in g] for g in groups]


def test_first_fit_looks_at_the_cells_around(spark):
    rng = np.random.default_rng(6)
    for tolerance in (1.0, 0.3):
        rows = np.unique(np.round(rng.uniform(0, 9, (600, 4)), 1), axis=0)
        boxes, want = [], []
        for v in rows:
            k = next((k for k, (a, b) in enumerate(boxes) if (np.maximum(b, v) - np.minimum(a, v) <= tolerance).all()), len(boxes))
            boxes[k : k + 1] = [(np.minimum(boxes[k][0], v), np.maximum(boxes[k][1], v)) if k < len(boxes) else (v, v)]
            want.append(k)
        assert G.first_fit(rows, tolerance) == want
    many = np.unique(np.round(rng.uniform(0, 40, (60_000, 4)), 3), axis=0)
    began = time.time()
    assert len(G.first_fit(many, 1.0)) == len(many) and time.time() - began < 30


def test_nearest_of_many_centres(spark):
    rng = np.random.default_rng(7)
    c = rng.uniform(0, 40, (40_000, 4))
    began = time.time()
    near = G.nearest_other(c)
    assert time.time() - began < 60
    for k in range(0, len(c), 4_000):
        d = np.abs(c - c[k]).max(axis=1)
        assert near[k] == np.delete(d, k).min()


def test_positions_alone_need_no_plan(spark, monkeypatch):
    lines = spark.createDataFrame(golden(), LINE)
    config = TypographyConfig(heading_candidate_mode="position")
    want = sorted(map(str, P.infer(lines, config).headings.collect()))
    monkeypatch.setattr(P.O, "normalized_plan", None)
    monkeypatch.setattr(P.G, "fallback_candidates", None)
    assert want and sorted(map(str, P.find_headings(lines, config)["headings"].collect())) == want


def test_alike_keys_against_every_pair():
    words, rng = ["chap", "intro", "of", "a", "seven", "eleven", "elevn", "data", "dat", "한글"], np.random.default_rng(8)

    def similarity(a, b):
        if not a or not b:
            return 0.0
        if a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a)):
            return 1.0
        x, y = set(a.split(" ")), set(b.split(" "))
        return max(SequenceMatcher(None, a, b).ratio(), 2.0 * len(x & y) / (len(x) + len(y)))

    for _ in range(60):
        ours, planned = ([" ".join(rng.choice(words, int(rng.integers(0, 5)))) for _ in range(n)] for n in (12, 9))
        for threshold in (0.0, 0.5, 0.8, 1.0):
            assert set(alike(ours, planned, threshold)) == {a for a in ours if any(similarity(a, b) >= threshold for b in planned)}


def test_ranges_look_ahead_without_a_frame_to_the_end(spark):
    plan = spark.createDataFrame([("b", n, 1 + n % 3, n) for n in range(1, 40)], "book_id string, ord int, level int, pdf_page int")
    ranged = O.ranges(plan, spark.createDataFrame([("b", 50)], "book_id string, total_pages int"))
    assert "unboundedfollowing" not in ranged._jdf.queryExecution().optimizedPlan().toString().lower()
    ends = {r.ord: r.end_page for r in ranged.collect()}
    assert all(ends[n] == next((m - 1 for m in range(n + 1, 40) if m % 3 <= n % 3), 50) for n in ends)
