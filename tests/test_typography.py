import numpy as np

from folioweave.config import TypographyConfig
from folioweave.operators import density as D
from folioweave.operators import geometry as G
from folioweave.operators import lines as L
from folioweave.plans import pipeline as P

LINE = "book_id string, line_id bigint, pdf_page int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, font_size double, height double, is_bold boolean, font_names array<string>"


def line(n, page, text, size, y, x=72.0):
    return ("b", n, page, text, x, float(y), x + 300, float(y) + size, 595.0, 842.0, float(size), float(size), False, ["F"])


def golden():
    rows, n = [], 0
    for page in range(1, 10):
        put = []
        if page % 3 == 1:
            k = page // 3 + 1
            put += [(f"Chapter {k} Title", 28, 67), (f"{k}.1 Section", 16, 142)]
        put += [(f"Note {page}", 10, 190)] + [("Body text line of the page here", 10, 250 + 15 * r) for r in range(15)]
        for text, size, y in put:
            n += 1
            rows.append(line(n, page, text, size, y))
    return rows


def test_golden_book(spark):
    plan = P.infer(spark.createDataFrame(golden(), LINE), TypographyConfig(min_tier_count=1, max_heading_tier=2)).plan.orderBy("ord").collect()
    got = [(r.title, r.level, r.pdf_page) for r in plan]
    want = []
    for k in (1, 2, 3):
        page = 3 * k - 2
        want += [(f"Chapter {k} Title", 1, page), (f"{k}.1 Section", 2, page)] + [(f"Note {p}", 3, p) for p in range(page, page + 3)]
    assert got == want


def test_empty_lines_give_an_empty_plan(spark):
    assert P.infer(spark.createDataFrame([], LINE)).plan.count() == 0


def test_weighted_valleys_are_those_of_the_full_list():
    rng = np.random.default_rng(1)
    full = np.round(np.concatenate([rng.normal(m, 0.4, 900) for m in (8, 10, 14, 20)]), 2)
    v, c = np.unique(full, return_counts=True)
    q1, q3 = np.percentile(full, [25, 75])
    assert abs(D._quantile(v, c.astype(float), 0.75) - q3) < 1e-9
    width = 0.9 * min(full.std(ddof=1), (q3 - q1) / 1.34) * len(full) ** -0.2
    grid = np.linspace(full.min(), full.max(), 2048)
    d = np.exp(-0.5 * ((grid[:, None] - full[None, :]) / width) ** 2).sum(axis=1)
    want = grid[1:-1][(d[:-2] > d[1:-1]) & (d[1:-1] < d[2:])]
    assert np.allclose(D.robust_valleys(v, c.astype(float)), want)


def test_margins_go_and_body_stays(spark):
    rows, n = [], 0
    for page in range(1, 13):
        for text, y in (("Running Title", 20), (f"{page + 3}", 30), ("Body words go here", 400), (f"{page + 3}", 300)):
            n += 1
            rows.append(line(n, page, text, 10, y))
    left = L.without_margins(spark.createDataFrame(rows, LINE)).collect()
    assert {r.text for r in left if r.y0 < 100} == set() and sum(r.y0 >= 100 for r in left) == 24


def test_position_clusters_against_first_fit(spark):
    rng = np.random.default_rng(2)
    rows = [("b", i, i % 7, [float(x) for x in rng.uniform(0, 6, 2)]) for i in range(80)]
    got = {r.chunk_id: r.cluster for r in G.position_clusters(spark.createDataFrame(rows, "book_id string, chunk_id bigint, pdf_page int, values array<double>")).collect()}
    boxes, want = [], {}
    for i, v in sorted(((r[1], tuple(r[3])) for r in rows), key=lambda x: x[1]):
        for k, members in enumerate(boxes):
            if all(max(x) - min(x) <= 1.0 for x in zip(*members, v)):
                members.append(v)
                break
        else:
            k = len(boxes)
            boxes.append([v])
        want[i] = k + 1
    assert got == want


def test_nearest_centres_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [("b", i, i, [float(x) for x in rng.uniform(0, 40, 2)], int(i)) for i in range(60)] + [("one", 1, 1, [1.0, 1.0], 1)]
    got = {(r.book_id, r.cluster): r.isolation_ratio for r in G.cluster_statistics(spark.createDataFrame(rows, "book_id string, chunk_id bigint, pdf_page int, values array<double>, cluster int")).collect()}
    c = np.array([r[3] for r in rows[:-1]])
    d = np.abs(c[:, None] - c[None]).max(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got.pop(("one", 1)) == 0 and np.allclose([got["b", i] for i in range(60)], d.min(axis=1) / 0.05)


def test_spans_become_lines(spark):
    kind = "book_id string, pdf_page int, span_seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, flags int"
    rows = [("b", 1, 1, "World", 50.0, 10.0, 90.0, 20.0, 10.0, "Sans-Bold", 0), ("b", 1, 2, "Hello", 10.0, 10.5, 45.0, 20.5, 10.0, "Serif", 0), ("b", 1, 3, "next", 10.0, 30.0, 45.0, 40.0, 10.0, None, 16), ("b", 1, 4, "...", 1.0, 30.0, 2.0, 40.0, 9.0, "x", 0)]
    got = L.spans_to_lines(spark.createDataFrame(rows, kind)).orderBy("line_no").collect()
    assert [(r.text, r.is_bold) for r in got] == [("Hello World", True), ("next", True)]
