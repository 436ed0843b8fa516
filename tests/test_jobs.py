"""Chapters, subsections, canonical candidates, previews, runs over books, command line, engines."""

import json

from pyspark.sql import functions as F

from folioweave import cli
from folioweave.config import MarkdownSplitConfig, ProcessingConfig
from folioweave.operators import contents as T
from folioweave.operators import export as E
from folioweave.operators import review as R
from folioweave.plans import jobs
from folioweave.plans import protocols as K
from tests.test_typography import LINE, golden

PLAN = "book_id string, ord int, title string, level int, pdf_page int, source string, confidence double"


def test_chapters_and_subsections(spark):
    body = "\n".join(f"line {n}" for n in range(9))
    pages = [
        (1, "Contents\nChapter 1 One 3\nChapter 2 Two 9\nChapter 3 Three 12"), (2, f"Chapter 1\nThe Old Bridge\n{body}"), (3, "1.1 Stones\ntext\n1.2\nThe Arch\n\n1.3 Has 3 numbers\n2.1 Elsewhere\n1.1 Stones"),
        (4, f"x\nchapter 2 Two Rivers 31\n{body}"), (5, f"제 3 장\n셋째 이야기\n{body}"), (6, "3.1 다리\n연습문제\n3.2 강"), (7, None),
    ]
    texts = spark.createDataFrame([("b", *p) for p in pages], "book_id string, pdf_page int, text string")
    found = T.chapter_candidates(texts)
    got = {(r.pdf_page, r.number): (r.title, r.score, r.toc_like) for r in found.collect()}
    assert got[(1, 1)][2] and got[(2, 1)] == ("The Old Bridge line", 9, False) and got[(4, 2)][0] == "Two Rivers" and got[(5, 3)][0] == "셋째 이야기 line"
    bounds = T.chapter_boundaries(found)
    assert [(r.number, r.start_page) for r in bounds.orderBy("number").collect()] == [(1, 2), (2, 4), (3, 5)]
    chapters = spark.createDataFrame([("b", 1, 2, 3), ("b", 3, 5, 7)], "book_id string, number int, start_page int, end_page int")
    subs = T.subsections(texts, chapters)
    assert [(r.number, r.title) for r in subs.orderBy("number").collect()] == [("1.1", "Stones"), ("1.2", "The Arch"), ("3.1", "다리")]
    allowed = spark.createDataFrame([("b", "1.2")], "book_id string, subsection string")
    assert [r.number for r in T.subsections(texts, chapters, allowed).collect()] == ["1.2"]
    assert T.chapter_boundaries(T.chapter_candidates(texts.where("false"))).count() == 0


def test_candidates_and_previews(spark):
    plan = spark.createDataFrame([("b", 1, "Straße", 1, 3, "t", 1.0), ("b", 2, "None", 1, 3, "t", 1.0)], PLAN)
    c = spark.createDataFrame([("b", "h", 4, "t", 3, "STRASSE"), ("b", "h", 2, "t", 3, "strasse "), ("b", "h", 1, "u", 3, "Straße")], "book_id string, artifact string, position int, source string, pdf_page int, title string")
    got = [(r.artifact, r.position, r.alternatives) for r in R.canonical_candidates(plan, c).orderBy("ord").collect()]
    assert got == [("h", 2, [4]), (None, None, [])]
    lines = spark.createDataFrame([("b", 1, 2.0, 0.0, 2, "two"), ("b", 1, 1.0, 0.0, 1, "one"), ("b", 2, 1.0, 0.0, 3, "y" * 900)], "book_id string, pdf_page int, y0 double, x0 double, line_id int, text string")
    p = {r.pdf_page: (r.preview, r.truncated) for r in R.page_previews(lines).collect()}
    assert p[1] == ("one two", False) and p[2] == ("y" * 800 + "…", True)


def test_split_documents_hold_headings_and_pages_once(spark):
    plan = spark.createDataFrame([("b", 1, "Ch One", 1, 1, "x", 0.5), ("b", 2, "Sec", 2, 2, "x", 0.5), ("b", 3, "Ch Two", 1, 4, "x", 0.5), ("b", 4, "Late", 2, 5, "x", 0.5), ("b", 5, "Ch Three", 1, 5, "x", 0.5)], PLAN)
    totals = spark.createDataFrame([("b", 6)], "book_id string, total_pages int")
    texts = spark.createDataFrame([("b", p, f"page {p} text") for p in range(1, 7) if p != 3], "book_id string, pdf_page int, text string")
    level = spark.createDataFrame([("b", 1)], "book_id string, chosen_level int")
    docs = {r.segment: r for r in E.split_documents(plan, totals, texts, level).collect()}
    page = "<!-- pdf_page {0} -->\n\npage {0} text".format
    assert docs[1].content_markdown == f"# Ch One\n\n{page(1)}\n\n## Sec\n\n{page(2)}\n" and docs[1].word_count == 11
    assert docs[2].content_markdown == f"# Ch Two\n\n{page(4)}\n\n## Late\n"
    assert docs[3].content_markdown == f"# Ch Three\n\n{page(5)}\n\n{page(6)}\n"
    deep = {r.segment: r.content_markdown for r in E.split_documents(plan, totals, texts, spark.createDataFrame([("b", 2)], "book_id string, chosen_level int")).collect()}
    assert deep[2] == f"# Ch One\n\n## Sec\n\n{page(2)}\n" and deep[4] == "# Ch Two\n\n## Late\n"
    nodes = {r.node_id: r for r in E.split_nodes(E.split_documents(plan, totals, texts, level)).collect()}
    assert nodes["n0003"].previous_id == "n0001" and nodes["n0003"].contained_ids == ["n0003", "n0004"] and nodes["n0003"].content_end_page == 4
    files = {r.node_id: r for r in E.split_markdown(E.split_nodes(E.split_documents(plan, totals, texts, level))).collect()}
    assert files["n0003"].file_name == "0002_L1_p0004_Ch-Two.md" and "- Previous: [[0001_L1_p0001_Ch-One|Ch One]]" in files["n0003"].markdown


def test_books_are_processed_and_failures_stay_their_own(spark):
    lines = spark.createDataFrame(golden(), LINE)
    stored = spark.createDataFrame([("s", i, f"Part {i}", 1 + i % 2, i) for i in range(1, 7)] + [("w", 1, "Lost", 1, 99)] + [("w", i, f"T {i}", 1, i) for i in range(2, 7)], "book_id string, ord int, title string, level int, pdf_page int")
    totals = spark.createDataFrame([("b", 9), ("s", 20), ("w", 20), ("n", 4)], "book_id string, total_pages int")
    texts = spark.createDataFrame([(b, p, f"words of page {p}") for b in "bs" for p in range(1, 10)], "book_id string, pdf_page int, text string")
    for config in (ProcessingConfig(), ProcessingConfig(markdown=MarkdownSplitConfig(enabled=False))):
        done = jobs.process(lines, stored, totals, texts, config)
        report = {r.book_id: r for r in done.report.collect()}
        assert {k: (r.reuse, r.state) for k, r in report.items()} == {"b": (False, "succeeded"), "s": (True, "succeeded"), "w": (False, "skipped"), "n": (False, "skipped")}
        assert report["w"].reason == "invalid_structure" and report["b"].reason == "no_stored_outline"
        files = {(r.book_id, r.file_name) for r in done.files.collect()}
        assert {b for b, _ in files} == {"b", "s"} and ("s", "toc.md") in files
    bad = spark.createDataFrame([("x", 1, "T", 1, 50, "s", 1.0), ("b", 1, "T", 1, 1, "s", 1.0)], PLAN)
    got = jobs.apply(bad, totals.unionByName(spark.createDataFrame([("x", 5)], totals.schema)), texts)
    assert {r.book_id: r.state for r in got.report.collect()} == {"x": "failed", "b": "succeeded"} and jobs.counts(got.report) == {"total": 2, "succeeded": 1, "failed": 1, "skipped": 0}


def test_command_line_answers_in_envelopes(spark, small_data, capsys):
    def run(*argv):
        code = cli.main(list(argv))
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    code, out = run("config", "explain", "markdown.max_words")
    assert code == 0 and out["ok"] and out["data"]["default"] == 10000
    code, out = run("config", "explain", "markdown.nonsense")
    assert code == 2 and out["error"]["kind"] == "input"
    code, out = run("inspect", small_data, "books", "--limit", "2")
    assert code == 0 and len(out["data"]["books"]) == 2
    code, out = run("inspect", small_data, "text", "--pages", "1-x")
    assert code == 2
    code, out = run("infer", "/nowhere")
    assert code == 2 and not out["ok"]
    assert cli.plain({"a": {2, 1}, "b": (1, None)}) == {"a": [1, 2], "b": [1, None]}


class Echo:
    engine_id, adapter_version = "echo", "1"

    def request_params(self):
        return {"x": 1}

    def recognise(self, image, pdf_page):
        if pdf_page == 2:
            raise ValueError("no words")
        return {"words": image.decode()}

    def to_words(self, answer):
        return []


def test_engines_retry_and_report(spark):
    K.register_engine("echo", Echo)
    images = spark.createDataFrame([("b", 1, "h1", b"one"), ("b", 2, "h2", b"two"), ("b", 3, "h3", b"three")], "book_id string, pdf_page int, sha256 string, image binary")
    none = spark.createDataFrame([], "cache_key string")
    first = K.recognised(images, none, K.engine("echo"), retries=1, wait=0.0).collect()
    assert {(r.pdf_page, r.answer is not None, r.attempts) for r in first} == {(1, True, 1), (2, False, 2), (3, True, 1)}
    cached = spark.createDataFrame([(r.cache_key,) for r in first if r.answer], "cache_key string")
    assert [r.pdf_page for r in K.recognised(images, cached, K.engine("echo"), retries=0).collect()] == [2]
    log = K.Recorded()
    K.Both(K.Silent(), log).on("page", n=1)
    assert log.rows(spark).first().event == "page" and isinstance(log, K.Listener)
