"""Ordered folds against plain walks over random rows."""

import random
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from folioweave.config import TypographyConfig
from folioweave.operators import bpe as B
from folioweave.operators import geometry as G
from folioweave.operators import lines as L

LINE = "book_id string, line_id bigint, pdf_page int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, font_size double, height double, is_bold boolean, font_names array<string>"


def random_lines(seed, n=60, wide=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, h = rng.choice([10.0, 120.0, 240.0, 300.0]), round(rng.uniform(0, 200), 1), rng.choice([8.0, 10.0, 12.5])
        rows.append(("b", i, i % 3, f"w{i}", x, y, x + (280 if wide else rng.choice([60.0, 100.0, 150.0])), y + h, 600.0, 800.0, rng.choice([9.0, 10.0, 14.0]), h, rng.choice([True, False, None]), rng.choice([["A"], ["B", "A"], None])))
    return rows


def by_page(rows):
    for page in sorted({r[2] for r in rows}):
        yield sorted((r for r in rows if r[2] == page), key=lambda r: (r[5], r[4], r[1]))


def test_printed_lines_are_put_together(spark):
    rows = random_lines(1) + [("q", 900, 1, None or "solo", 1.0, 1.0, 2.0, 2.0, 1.0, 1.0, 9.0, 1.0, None, None)]
    want = set()
    for page in by_page(rows[:-1]):
        groups = []
        for r in page:
            hit = None
            for k, g in enumerate(groups):
                if min(r[7], max(m[7] for m in g)) > max(r[5], min(m[5] for m in g)) and all(r[6] <= m[4] or r[4] >= m[6] for m in g):
                    hit = k
            if hit is None:
                groups.append([r])
            else:
                groups[hit].append(r)
        for g in groups:
            across = sorted(g, key=lambda r: (r[4], r[5], r[1]))
            want.add((g[0][1], " ".join(r[3] for r in across), min(r[4] for r in g), max(r[7] for r in g), float(median(r[10] for r in g))))
    want.add((900, "solo", 1.0, 2.0, 9.0))
    got = L.merge_print_fragments(spark.createDataFrame(rows, LINE))
    assert {(r.line_id, r.text, r.x0, r.y1, r.font_size) for r in got.collect()} == want
    assert got.columns == L.LINE and L.merge_print_fragments(spark.createDataFrame([], LINE)).count() == 0


def test_lines_of_one_tier_are_joined_step_by_step(spark):
    rows = [r + (1 if r[10] > 12 else 2,) for r in random_lines(2, 45, wide=True)]
    want = []
    for page in by_page(rows):
        now = None
        for r in page:
            if now and now["tier"] == r[14] and r[5] - now["y1"] <= max(now["h"], r[11]) * 1.5:
                now |= {"text": now["text"] + " " + r[3], "y1": max(now["y1"], r[7]), "h": (now["h"] + r[11]) / 2, "size": (now["size"] + r[10]) / 2}
            else:
                now = {"id": r[1], "text": r[3], "y1": r[7], "h": r[11], "size": r[10], "tier": r[14]}
                want.append(now)
    got = L.merge_same_tier_lines(spark.createDataFrame(rows, LINE + ", tier int"), TypographyConfig(heading_merge_gap_ratio=1.5)).collect()
    near = lambda x: round(x, 1)
    assert sorted((r.line_id, r.text, near(r.y1), near(r.height)) for r in got) == sorted((w["id"], w["text"], near(w["y1"]), near(w["h"])) for w in want)


def test_spans_fall_into_lines(spark):
    rng = random.Random(3)
    rows = [("b", i % 2, i, f"s{i}", rng.uniform(0, 500), y, 0.0, y + h, 10.0, "F", 0) for i in range(40) for y, h in [(round(rng.uniform(0, 120), 2), rng.choice([6.0, 10.0, 16.0]))]]
    want = Counter()
    for page in (0, 1):
        groups = []
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: ((r[5] + r[7]) / 2, r[4], r[2])):
            c = (r[5] + r[7]) / 2
            if groups and abs(c - median((m[5] + m[7]) / 2 for m in groups[-1])) <= max(1.5, max(median(m[7] - m[5] for m in groups[-1]), 1.0) * 0.55):
                groups[-1].append(r)
            else:
                groups.append([r])
        want.update((page, n, " ".join(m[3] for m in sorted(g, key=lambda m: (m[4], (m[5] + m[7]) / 2)))) for n, g in enumerate(groups, 1))
    kind = "book_id string, pdf_page int, span_seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, flags int"
    got = L.spans_to_lines(spark.createDataFrame(rows, kind))
    assert Counter((r.pdf_page, r.line_no, r.text) for r in got.collect()) == want


def test_blocks_beside_the_body_size_are_joined(spark):
    rng = random.Random(4)
    rows = []
    for i in range(50):
        size = rng.choice([8.0, 10.0, 15.0, 20.0])
        y = round(rng.uniform(0, 400), 1)
        rows.append(("b", i, i % 3, 10.0, y, y + rng.choice([8.0, 30.0]), size, f"t{i}", 1, [size]))
    kind = "book_id string, chunk_id bigint, pdf_page int, x0 double, y0 double, y1 double, font_size double, text string, line_count int, sizes array<double>"
    blocks = spark.createDataFrame(rows, kind)
    profile = spark.createDataFrame([("b", [3], 10.0)], "book_id string, body_tiers array<int>, body_size double")
    spacing = spark.createDataFrame([("b", 12.0)], "book_id string, body_spacing double")
    cuts = spark.createDataFrame([("b", [9.0, 12.0, 18.0])], "book_id string, cuts array<double>")
    side = lambda s: 0 if 1 + sum(c > s for c in (9.0, 12.0, 18.0)) == 3 else -1 if s < 10 else 1
    want = []
    for page in range(3):
        out = []
        for r in sorted((r for r in rows if r[2] == page), key=lambda r: (r[4], r[3], r[1])):
            last = out[-1] if out else None
            if last and r[4] > last["y0"] and r[4] - last["y1"] <= 12 and side(last["size"]) and side(last["size"]) == side(r[6]):
                last["sizes"] += r[9]
                last |= {"y1": max(last["y1"], r[5]), "text": last["text"] + " " + r[7], "size": float(median(last["sizes"]))}
            else:
                out.append({"id": r[1], "y0": r[4], "y1": r[5], "text": r[7], "size": r[6], "sizes": list(r[9])})
        want += out
    got = G.merge_non_body(blocks, profile, spacing, cuts).collect()
    assert sorted((r.chunk_id, r.text, r.y1, r.font_size) for r in got) == sorted((w["id"], w["text"], w["y1"], w["size"]) for w in want)


def walk_pairs(tokens, page_spacing, book, least, rounds=50):
    """Tokens (page, body, seq, y0, height, text) merged pair by pair."""
    gap = lambda a, b: (b[3] - a[3]) / max(a[4], b[4], 1e-6) if b[3] > a[3] else None
    for _ in range(rounds):
        seen, at = Counter(), {}
        for i, (a, b) in enumerate(zip(tokens, tokens[1:])):
            if not a[1] and not b[1] and a[0] == b[0] and (g := gap(a, b)) is not None and g <= page_spacing.get(a[0], book):
                seen[(a[2], b[2])] += 1
                at.setdefault((a[2], b[2]), []).append(i)
        if not seen or seen.most_common(1)[0][1] < least:
            break
        starts, out, i = set(at[seen.most_common(1)[0][0]]), [], 0
        while i < len(tokens):
            if i in starts:
                a, b = tokens[i], tokens[i + 1]
                out.append((a[0], False, a[2] + b[2], a[3], a[4] + b[4], a[5] + " " + b[5]))
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return [(t[0], min(t[2]), t[5]) for t in tokens if not t[1]]


def test_pairs_of_size_classes_merge_as_walked(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        tier = rng.choice([1, 2, 3, 3])
        page, h = i // 24, {1: 20.0, 2: 14.0, 3: 10.0}[tier]
        y = (i % 24) * 12.0 + rng.choice([0.0, 3.0])
        rows.append(("b", i, page, f"w{i}", 10.0, y, 100.0, y + h, 600.0, 800.0, h, h, False, None, tier))
    lines = spark.createDataFrame(rows, LINE + ", tier int")
    ordered = sorted(rows, key=lambda r: (r[2], r[5], r[4], r[1]))
    spacing, everything = {}, []
    for page in range(10):
        body = [r for r in ordered if r[2] == page and r[14] >= 3]
        gaps = [(b[5] - a[5]) / max(a[11], b[11]) for a, b in zip(body, body[1:]) if b[5] > a[5]]
        everything += gaps
        if gaps:
            spacing[page] = median(gaps)
    tokens = [(r[2], r[14] >= 3, () if r[14] >= 3 else (r[14],), r[5], r[11], r[3]) for r in ordered]
    for least in (1, 3, 15):
        want = walk_pairs(tokens, spacing, median(everything), least)
        got = B.bpe_headings(lines, TypographyConfig(bpe_min_pair_count=least))
        assert sorted((r.pdf_page, r.tier, r.title) for r in got.collect()) == sorted(want)


def test_body_between_headings_blocks_a_merge_and_a_wide_gap_too(spark):
    def titles(*put):
        rows = [("b", n, 1, text, 72.0, float(y), 300.0, y + 10.0, 595.0, 842.0, float(size), 10.0, False, None, 1 if size > 12 else 2) for n, (text, size, y) in enumerate(put)]
        body = [("b", 100 + n, 1, "body", 72.0, 400.0 + 12 * n, 300.0, 410.0 + 12 * n, 595.0, 842.0, 10.0, 10.0, False, None, 2) for n in range(6)]
        return [r.title for r in B.bpe_headings(spark.createDataFrame(rows + body, LINE + ", tier int"), TypographyConfig(bpe_min_pair_count=1)).orderBy("y0").collect()]

    assert titles(("CHAPTER", 20, 100), ("text", 10, 110), ("One", 20, 120)) == ["CHAPTER", "One"]
    assert titles(("CHAPTER", 20, 100), ("One", 20, 111)) == ["CHAPTER One"]
    assert titles(("CHAPTER", 20, 100), ("One", 20, 180)) == ["CHAPTER", "One"]
    assert B.bpe_headings(spark.createDataFrame([], LINE + ", tier int")).count() == 0
