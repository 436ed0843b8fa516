import random

import pytest
from pyspark.sql import functions as F

from folioweave.llm import clustering as C
from folioweave.llm import linkage, mojibake, ocrnoise, packing, quality, splitting, tokenize

LONG = "word " * 30


def test_tokens_equal_the_library_on_hard_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", None, " ", "\n\n \t x", "a  b   c", "don't WE'LL it's", "안녕하세요 세계", "Привет, мир!", "naïve 𝑥 👩‍🏫", "x" * 300 + "=" * 500, "a b　c d", "<|endoftext|>", "12345678901234567890", "tab\tand\r\nline", LONG, "안녕하세요" * 90, "Donaudampfschifffahrtsgesellschaft" * 9, "." * 1001, " " * 777 + "x", "0123456789" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    for most in (10**5, 0):  # every word from the literal, every word folded in its text
        got = tokenize.encode(docs, "doc_id", "text", head_words=most)
        assert {r.doc_id: r.ids for r in got.collect()} == want
        n = tokenize.encode(docs, "doc_id", "text", count_only=True, head_words=most)
        assert {r.doc_id: r.n_tokens for r in n.collect()} == {k: len(v) for k, v in want.items()}
    back = tokenize.decode(got, "doc_id")
    assert {r.doc_id: r.text for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert tokenize.encode(docs.where("false"), "doc_id", "text").count() == 0


def test_bins_hold_everything_once(spark):
    rng = random.Random(1)
    sizes = [rng.randint(0, 300) for _ in range(400)] + [2500, 100, 100, None, -3]
    items = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size int")
    for caps in ((256,), (64, 128, 256)):
        rows = packing.pack(items, "id", "size", caps).collect()
        used, total = {}, {}
        for r in rows:
            used[r.bin_id] = used.get(r.bin_id, 0) + r.n_tokens
            total[r.id] = total.get(r.id, 0) + r.n_tokens
        assert all(used[r.bin_id] == r.bin_used <= r.bin_capacity and r.bin_capacity in caps for r in rows)
        assert total == {i: max(s or 0, 0) for i, s in enumerate(sizes)}
        assert sum(used.values()) >= 0.97 * sum({r.bin_id: r.bin_capacity for r in rows}.values())
    assert packing.pack(items.where("false"), "id", "size").count() == 0


def test_pieces_cover_the_text_and_overlap(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(n))
    rows = [("a", words(95) + "\n\n# Head\n\n" + words(80), 40, 5), ("b", "x " * 300, 50, 0), ("c", words(40), 40, 5), ("d", None, 40, 5), ("e", "", 40, 5), ("f", "w " * 41, 40, 5), ("g", words(9), 1, 5), ("a2", words(95), None, 5)]
    df = spark.createDataFrame(rows + rows[:1], "k string, t string, m int, o int").withColumn("pos", F.lit(1))
    got = {}
    for r in splitting.split(df, ["k"], "t", "m", "o").orderBy("piece").collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {"a", "b", "f", "g"}
    for k, t, m, o in rows:
        if k in got:
            w, end = t.split(), 0
            o = min(o, m // 2)
            for i, p in enumerate(got[k]):
                assert p.content.split() == w[p.start_word : p.start_word + p.n_words] and p.n_words <= m
                assert p.start_word == (0 if i == 0 else end - o)
                end = p.start_word + p.n_words
            assert end == len(w)
    assert splitting.split(df.where("false"), ["k"], "t", "m", "o").count() == 0


def test_pieces_reach_as_far_as_a_natural_boundary_allows(spark):
    text = " ".join(["w"] * 11) + " end. " + " ".join(["v"] * 5) + " stop. " + " ".join(["u"] * 30) + "\n\n```\n" + "code. " * 6 + "\n```\n\nlast words here"
    got = [r.n_words for r in splitting.split(spark.createDataFrame([("a", text, 20, 0)], "k string, t string, m int, o int"), ["k"], "t", "m", "o").orderBy("piece").collect()]
    # 12 and 18 are natural, 18 is farther; a run without any is cut at words; no cut inside the code
    assert got == [18, 20, 18, 3]


def test_a_first_piece_is_longer_than_the_overlap(spark):
    # the only natural boundary within reach of the text's begin lies within, or at the end of, the overlap
    rows = [("within", "a short one. " + "w " * 60, 20, 5), ("at", "just five words in here. " + "w " * 60, 20, 5), ("after", "one more than five in here. " + "w " * 60, 20, 5), ("half", "a b. " + "w " * 9, 4, 9)]
    got = {}
    for r in splitting.split(spark.createDataFrame(rows, "k string, t string, m int, o int"), ["k"], "t", "m", "o").orderBy("piece").collect():
        got.setdefault(r.k, []).append(r)
    for k, t, m, o in rows:
        w, o, end = t.split(), min(o, m // 2), 0
        for i, p in enumerate(got[k]):
            assert p.start_word == (end - o if i else 0) >= 0 and p.content.split() == w[p.start_word : p.start_word + p.n_words]
            assert o < p.n_words <= m
            end = p.start_word + p.n_words
        assert end == len(w)
    # a natural boundary beyond the overlap is taken as before
    assert got["after"][0].n_words == 6


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(12):
        x, y, r = rng.uniform(0, 40), g * 3.0, rng.uniform(0.8, 3)
        for _ in range(rng.randint(1, 9)):
            n += 1
            rows.append((f"b{g % 2}", n, x + rng.uniform(0, 0.4), y + rng.uniform(0, 0.4), r * (1 + rng.uniform(0, 0.03)), "z"))
    rows += rows[:5] + [("b0", 900, None, 1.0, 1.0, "z"), ("b0", 901, float("nan"), 1.0, 1.0, "z"), ("b0", 902, 1.0, 1.0, 0.0, "z")]
    axes = [C.Axis("x", 0.5), C.Axis("y", 0.5), C.Axis("r", 1.05, ratio=True)]
    members = C.clustered(spark.createDataFrame(rows, "b string, i bigint, x double, y double, r double, n string"), "i", "b", axes)
    good = sorted({r for r in rows if r[2] is not None and r[2] == r[2] and r[4] > 0}, key=lambda r: r[1])
    alike = lambda a, b: a[0] == b[0] and abs(a[2] - b[2]) <= 0.5 and abs(a[3] - b[3]) <= 0.5 and max(a[4], b[4]) <= 1.05 * min(a[4], b[4])
    want = set()
    for a in good:
        later = [b[1] for b in good if b[1] > a[1] and alike(a, b)]
        if later:
            want.add((a[1], min(later)))
    for id_range in (1 << 17, 4):
        assert {tuple(r) for r in C.consecutive(members, "i", ["b", "cluster"], id_range).collect()} == want
    assert C.clustered(members.drop("cluster").where("false"), "i", "b", axes).count() == 0


def test_cells_with_outliers_are_split(spark):
    rows = [("b", i, x, 1.0, 1.0) for i, x in enumerate([0.45] * 5 + [0.55] * 5 + [0.05, 0.95])]
    axes = [C.Axis("x", 0.5), C.Axis("y", 0.5), C.Axis("r", 1.05, ratio=True)]
    got = {r.i: r.cluster for r in C.clustered(spark.createDataFrame(rows, "b string, i bigint, x double, y double, r double"), "i", "b", axes).collect()}
    assert len({got[i] for i in range(10)}) == 1


def test_typical_members_have_the_strongest_flow(spark):
    # nine in the middle that are like all, two at either end that are only like the middle
    rows = [("b", i, x, 1.0, 1.0) for i, x in enumerate([0.3] * 9 + [0.01] * 2 + [0.74] * 2)]
    axes = [C.Axis("x", 0.5), C.Axis("y", 0.5), C.Axis("r", 1.05, ratio=True)]
    members = C.clustered(spark.createDataFrame(rows, "b string, i bigint, x double, y double, r double"), "i", "b", axes)
    best = max(C.described(members, "i", "b", axes).collect(), key=lambda r: r["size"])
    assert set(best.typical) <= set(range(9)) and len(best.typical) == 3


def test_encoding_chains_on_held_out_rows():
    clean = ["la méthode détermine la société", "según la energía y el diseño", "Größe und Übersicht", "температура и скорость", "압력을 다시 나눈다", "CORAÇÃO, PÃO, LÃ, MAÇÃ", "x² + y³ ≤ ½", "“quoted” — naïve"]
    judge = mojibake.Judge(mojibake.train(clean * 3))
    assert not any(judge.row(t)[0] for t in clean)
    for chain in (mojibake.CHAINS[0], mojibake.CHAINS[1], mojibake.CHAINS[3], mojibake.CHAINS[6]):
        for text in clean[:3]:
            bad = mojibake.garble(text, chain)
            found, back, whole, _ = judge.row(bad)
            assert found and whole and back == text
    assert judge.row("contr�le")[:3] == (True, "contr�le", False)


def test_titles_match_through_noise(spark):
    items = [(1, "b", "a", "Iriner Intervals", 5, 1, None, 9), (2, "b", "a", "Local Surfaces II .... 12", 6, 2, None, 9), (3, "b", "a", "Figure", 6, 1, "caption", 9), (4, "b", "a", None, 6, 1, None, 9), (5, "b", "z", "INNER INTERVALS", None, None, None, 9), (5, "b", "z", "INNER INTERVALS", None, None, None, 9)]
    outline = [(10, "b", 1, "1.1 Inner Intervals", 5, 1), (11, "b", 2, "Local Surfaces I", 6, 2), (12, "b", 3, "Local Surfaces II", 7, 2), (13, "b", 4, "Inner Intervals", 90, 1)]
    it = spark.createDataFrame(items, "id bigint, book string, arm string, title string, page int, level int, kind string, score int")
    ol = spark.createDataFrame(outline, "id bigint, book string, ord int, title string, page int, level int")
    got = {(r.item_id, r.outline_id) for r in linkage.link(it, ol).collect()}
    assert {(1, 10), (2, 12)} <= got and {i for i, _ in got} == {1, 2, 5}
    assert linkage.link(it.where("false"), ol).count() == 0


def test_kinds_of_documents(spark):
    texts = {
        "prose": "The method of the work is that it can be read by all who want to know more. It is not a list, but a text.",
        "list": "1.1 Alpha Beta ..... 4\n1.2 Gamma Delta ..... 9\n1.3 Epsilon Zeta ..... 12",
        "table": "| a | 1 | 2 |\n|---|---|---|\n| b | 3 | 4 |",
        "junk": ":#]`_{ &;~@`|`~:</%<}!_~^`]<>> ^%\\[~+=}!];@/&!>?:];.#=",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values(), None, "", " \n\t", "xx " * 50])], "id int, text string")
    table = quality.common_word_table(spark.createDataFrame([(w,) for w in "the of is it that can be by to not".split()], "w string"), "w")
    got = {r.id: r.kind for r in quality.classify(quality.statistics(docs, "id", "text", table), "id").collect()}
    assert [got[i] for i in range(8)] == ["prose", "list", "table", "junk", "blank", "blank", "blank", "junk"]


def test_noise_of_scanned_rows(spark):
    v = [(1, "b", 1, 0, 20.0, 800.0, "Running Title"), (2, "b", 1, 1, 100.0, 800.0, "the annual work goes on and the annual work is se-"), (3, "b", 1, 2, 120.0, 800.0, "cond to none"), (4, "b", 1, 3, 790.0, 800.0, "- 1 -"), (5, "b", 2, 0, 100.0, 800.0, "a second well-"), (6, "b", 2, 1, 120.0, 800.0, "known thing is well-known"), (7, "b", 2, 2, 140.0, 800.0, "the annua1 work"), (8, "b", 2, 3, 150.0, 800.0, None), (1, "b", 1, 0, 20.0, 800.0, "Running Title")]
    visual = spark.createDataFrame(v, "row_id bigint, book_id string, pdf_page int, row_seq int, y0 double, page_height double, text string")
    ocr = spark.createDataFrame([], "stat_id bigint, book_id string, pdf_page int, y_center_ratio double, text string")
    rep = spark.createDataFrame([(1, "r", 1, "CONTENTS"), (2, "r", 1, "Alpha . . . lO"), (3, "r", 1, None)], "sub_id bigint, report_id string, chapter int, raw_line string")
    got = {(r.source_table, r.row_id, r.noise) for r in ocrnoise.noise(ocrnoise.rows_of(visual, ocr, rep)).collect()}
    assert got == {("visual_rows", 1, "running_header"), ("visual_rows", 2, "hyphenated"), ("visual_rows", 4, "page_number"), ("visual_rows", 7, "misread"), ("subsection_report", 1, "running_header"), ("subsection_report", 2, "misread")}


def _misread(spark, texts):
    """Those of ``texts``, the rows of one page, that hold a misread word."""
    rows = spark.createDataFrame([(i, "b", 1, i, 300.0, 800.0, t) for i, t in enumerate(texts)], "row_id bigint, book_id string, pdf_page int, row_seq int, y0 double, page_height double, text string")
    ocr = spark.createDataFrame([], "stat_id bigint, book_id string, pdf_page int, y_center_ratio double, text string")
    rep = spark.createDataFrame([], "sub_id bigint, report_id string, chapter int, raw_line string")
    return {texts[r.row_id] for r in ocrnoise.noise(ocrnoise.rows_of(rows, ocr, rep)).where("noise = 'misread'").collect()}


def test_confusions_of_short_words_and_signs(spark):
    assert ocrnoise.originals("ze!gt")["zeigt"] == 1 and ocrnoise.originals("pr|sm")["prism"] == 1 and ocrnoise.originals("retum")["return"] == 1
    assert ocrnoise.originals("wbicb")["which"] == 2 and ocrnoise.originals("f00tn0te")["footnote"] == 3
    bad = ["the ze!gt turns", "they retum to it", "the tree wbicb grows", "a late f00tn0te here"]
    good = ["the zeigt turns", "they return to it", "the tree which grows", "a late footnote here"]
    assert _misread(spark, good * 30 + bad) == set(bad)


def test_a_lone_sentence_at_the_top_is_no_header(spark):
    rows = [(1, "b", 1, 0, 40.0, 800.0, "This sentence of the body goes on at the very top of a page."), (2, "b", 2, 0, 40.0, 800.0, "0f Linear Streams 2"), (3, "b", 3, 0, 40.0, 800.0, "Of Linear Streams 3"), (4, "b", 4, 0, 40.0, 800.0, "Pumps")]
    visual = spark.createDataFrame([(*r[:4], *r[4:]) for r in rows], "row_id bigint, book_id string, pdf_page int, row_seq int, y0 double, page_height double, text string")
    ocr = spark.createDataFrame([], "stat_id bigint, book_id string, pdf_page int, y_center_ratio double, text string")
    rep = spark.createDataFrame([], "sub_id bigint, report_id string, chapter int, raw_line string")
    got = {r.row_id for r in ocrnoise.noise(ocrnoise.rows_of(visual, ocr, rep)).where("noise = 'running_header'").collect()}
    assert got == {2, 3, 4}


def test_confusions_are_weighed_by_how_often_they_happen(spark):
    words = [("orchard", 4000), ("bridge", 4000), ("0rchard", 30), ("bridqe", 1), ("orch@rd", 2)]
    counts = spark.createDataFrame(words, "word string, n bigint")
    theta, rate = ocrnoise.confusion_probabilities(ocrnoise.misreadings(counts), counts)
    by = dict(zip(ocrnoise.CONFUSIONS, theta))
    assert by[("0", "o")] > by[("@", "a")] > by[("b", "h")] - 3 and by[("0", "o")] > by[("q", "g")] and 0 < rate < 0.02
    assert ocrnoise.used("f00tn0te", "footnote") == {12: 1.5} and ocrnoise.used("same", "other") is None


def test_rare_and_recurring_misreadings(spark):
    rows = ["the old orbits turn"] * 9 + ["the old memories stay"] * 20 + ["some quarries grow"] * 18 + ["same quarries grow"] * 20
    visual = spark.createDataFrame([(i, "b", 1, i, 300.0, 800.0, t) for i, t in enumerate(rows)] + [(900, "b", 1, 900, 300.0, 800.0, "the old orbifs turn")], "row_id bigint, book_id string, pdf_page int, row_seq int, y0 double, page_height double, text string")
    ocr = spark.createDataFrame([], "stat_id bigint, book_id string, pdf_page int, y_center_ratio double, text string")
    # one misread line that many rows share is seen once
    rep = spark.createDataFrame([(i, "r", 1, "Porous Memorics") for i in range(40)], "sub_id bigint, report_id string, chapter int, raw_line string")
    got = {(r.source_table, r.row_id) for r in ocrnoise.noise(ocrnoise.rows_of(visual, ocr, rep)).where("noise = 'misread'").collect()}
    assert got == {("visual_rows", 900)} | {("subsection_report", i) for i in range(40)}


def test_a_rare_original_wins_by_its_neighbours(spark):
    others = sorted(w for w, n in ocrnoise.originals("coif").items() if w not in ("calf", "coif"))[:10]
    rows = [w for w in others for _ in range(40)] + ["brown calf grazes"] * 30 + ["brown coif grazes"]
    visual = spark.createDataFrame([(i, "b", 1, i, 300.0, 800.0, t) for i, t in enumerate(rows)], "row_id bigint, book_id string, pdf_page int, row_seq int, y0 double, page_height double, text string")
    ocr = spark.createDataFrame([], "stat_id bigint, book_id string, pdf_page int, y_center_ratio double, text string")
    rep = spark.createDataFrame([], "sub_id bigint, report_id string, chapter int, raw_line string")
    text = " ".join(r.text for r in ocrnoise.paragraphs(ocrnoise.rows_of(visual, ocr, rep)).collect())
    assert text.count("brown calf grazes") == 31


def test_a_long_title_without_page_survives_four_errors(spark):
    good, bad = "Practical Geometry of Seasonal Markets Upper Vineyards", "Practical Geometry of Sessonal Marxets Uxper zineyards"
    it = spark.createDataFrame([(1, "b", "a", bad, None, 1, None), (2, "c", "a", bad, 5, 1, None)], "id bigint, book string, arm string, title string, page int, level int, kind string")
    ol = spark.createDataFrame([(10, "b", 1, good, 5, 1), (20, "c", 1, good, None, 1)], "id bigint, book string, ord int, title string, page int, level int")
    assert {(r.item_id, r.outline_id) for r in linkage.link(it, ol).collect()} == {(1, 10), (2, 20)}


def test_neighbour_scores_settle(spark):
    # pairs in threes of four, so that no support reaches its bound and changes go on along the chain
    at = [p for p in range(40) if p % 4 != 3]
    rows = [(p, 100 + p, "b", "a", p, p, 0.3 + 0.3 * (p == 0)) for p in at]
    edges = spark.createDataFrame(rows, "i bigint, o bigint, book string, arm string, pi int, po int, own double")
    got = {r.i: r.score for r in linkage.propagate(edges, 1e-9).collect()}
    for p, _, _, _, _, _, own in rows:
        support = min(1.0, sum(got.get(p + d, 0.0) for d in (-2, -1, 1, 2)) / 2)
        assert abs(got[p] - (0.8 * own + 0.2 * support)) < 1e-8
