"""Page sources, artefacts of runs, findings and retries, canonical candidates, settings."""

import pytest
from pyspark.sql import functions as F

from folioweave.config import ConfigError, TypographyConfig, explain, validate
from folioweave.functions import text as X
from folioweave.operators import artifacts as A
from folioweave.operators import outline as O
from folioweave.operators import retry as Y
from folioweave.operators import review as R
from folioweave.sources import pages as S


def test_page_lists_and_ranges():
    assert S.page_list("1-3, 42,2") == [1, 2, 3, 42] and S.page_list(" ") is None
    assert S.page_range("7") == (7, 7) and S.page_range("3-5") == (3, 5) and S.page_range(None) is None
    for bad in ("0", "5-3", "a", "1-", "1-2-3"):
        with pytest.raises(S.InputError):
            S.page_list(bad)
    with pytest.raises(S.InputError):
        S.page_range("1,2")


def test_selected_pages_and_outline(spark):
    pages = spark.createDataFrame([("b", 1, "one"), ("b", 2, None), ("c", 1, "x")], "book_id string, pdf_page int, text string")
    totals = spark.createDataFrame([("b", 2), ("c", 1)], "book_id string, total_pages int")
    texts, faults = S.selected_pages(pages, totals, [2, 1, 2])
    assert {(r.book_id, r.pdf_page, r.char_count) for r in texts.collect()} == {("b", 1, 3), ("b", 2, 0), ("c", 1, 1)}
    assert [(r.book_id, r.pdf_page) for r in faults.collect()] == [("c", 2)]
    assert S.page_texts(pages, 1).count() == 2
    rows = spark.createDataFrame([("b", 5, " A \n B", 1, 0), ("b", 9, "C", 2, 4)], "book_id string, ord int, title string, level int, pdf_page int")
    assert [(r.ord, r.title, r.pdf_page) for r in S.stored_outline(rows).orderBy("ord").collect()] == [(1, "A B", None), (2, "C", 4)]
    both = spark.createDataFrame([(0,), (1,), (-1,)], "p int").select(S.page_to_index("p").alias("a"), S.index_to_page("p").alias("b")).collect()
    assert [(r.a, r.b) for r in both] == [(None, 1), (0, 2), (None, None)]
    s = {r.book_id: (r.text_pages, r.bookmarks) for r in S.book_summary(totals, pages, rows).collect()}
    assert s == {"b": (1, 2), "c": (1, 0)}


def test_json_that_is_missing_or_broken(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "bad.json").write_text('{"a": ')
    (tmp_path / "items.jsonl").write_text('{"title": "T", "ord": 1}\n\nnonsense\n')
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("good.json", "list.json", "bad.json", "none.json")], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.value.a if r.value else None, r.warning) for r in S.read_json(spark, paths, "a int").collect()}
    assert got == {"good.json": (1, None), "list.json": (None, "no JSON object"), "bad.json": (None, "no valid JSON"), "none.json": (None, "not readable: FileNotFoundError")}
    with pytest.raises(S.InputError):
        S.strict_json(spark, paths, "a int")
    assert S.strict_json(spark, paths.where("path like '%good%'"), "a int").first().value.a == 1
    items, faults = S.read_review_items(spark, str(tmp_path / "items.jsonl"))
    assert [r.title for r in items.collect()] == ["T"] and [(r.line, r.text) for r in faults.collect()] == [(3, "nonsense")]


def test_how_far_a_recognition_has_come(spark):
    jobs = spark.createDataFrame(
        [("a", None, 3, 2, True), ("b", [4, 2, 2], 9, 1, False), ("c", None, None, None, False), ("d", [0], 2, 0, True)],
        "job_id string, pages array<int>, total_pages int, completed_pages int, output_exists boolean",
    )
    cached = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("b", 4), ("b", None), ("d", 1), ("d", 2)], "job_id string, pdf_page int")
    raw = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("d",)] * 2, "job_id string")
    got = {r.job_id: r for r in A.ocr_status(jobs, cached, raw).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "complete", "b": "partial", "c": "missing", "d": "complete"}
    assert got["a"].duplicate_insertable_pages == [3] and got["a"].warnings == ["duplicate_pages"]
    assert got["b"].missing_completed_pages == [2] and got["b"].first_unprocessed_page == 2 and "unreadable_cache" in got["b"].warnings
    assert got["c"].warnings == ["unknown_target_pages"]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "job_id string, seq int, event string")
    for c in ("level", "message"):
        log = log.withColumn(c, F.lit(None).cast("string"))
    log = log.withColumn("pdf_page", F.lit(None).cast("int")).withColumn("elapsed_sec", F.lit(0.5))
    assert A.last_events(log).first().event == "y"


def test_totals_of_batches(spark):
    v = spark.createDataFrame([("a", True, True, None, False), ("b", False, False, None, False), ("c", None, None, "broken", False), ("d", True, True, None, True)], "book_id string, is_scanned boolean, target boolean, error string, output_exists boolean")
    assert A.classification_totals(v).first().asDict() == {"total_pdf_count": 4, "scanned_count": 2, "native_count": 2, "target_count": 2, "error_count": 1}
    plan = {r.book_id: r.action for r in A.overlay_plan(v).collect()}
    assert plan == {"a": "process", "b": "skipped", "c": "failed", "d": "skipped"}
    assert {r.book_id: r.action for r in A.overlay_plan(v, force=True, dry_run=True).collect()}["d"] == "dry_run"
    r = spark.createDataFrame([(True, 10, "processed", ["w"]), (False, 5, "skipped", None)], "target boolean, page_count int, status string, warnings array<string>")
    got = A.overlay_totals(r).first()
    assert (got.target_page_count, got.processed_count, got.skipped_count, got.warning_count, got.warning_pdf_count) == (10, 1, 1, 1, 1)


def test_confidence_and_written_outlines(spark):
    books = spark.createDataFrame([("a",), ("b",)], "book_id string")
    tiers = spark.createDataFrame([("a", 3), ("a", 2)], "book_id string, tier_count int")
    c = spark.createDataFrame([("a", 0.5), ("a", 0.6)], "book_id string, confidence double")
    got = {r.book_id: (r.line_extraction, r.tiering, r.heading_candidates, r.outline) for r in A.confidence_summary(books, books.where("book_id = 'a'"), tiers, c, c).collect()}
    assert got == {"a": (1.0, 0.75, 0.55, 0.55), "b": (0.0, 0.0, 0.0, 0.0)}
    kind = "book_id string, ord int, level int, title string, pdf_page int"
    x = spark.createDataFrame([("a", 1, 1, "T", 1), ("a", 2, 1, "U", 2)], kind)
    y = spark.createDataFrame([("a", 1, 1, "T", 1), ("a", 2, 1, "U", 3)], kind)
    assert A.outline_faults(x, x).count() == 0 and {r.side for r in A.outline_faults(x, y).collect()} == {"expected", "written"}


def test_findings_lead_to_retries(spark):
    found = spark.createDataFrame([("r", ["thin", "fragmented"], ["existing_outline"]), ("s", ["over_split"], ["typography"]), ("t", ["over_split"], ["typography"]), ("u", ["thin"], ["typography", "existing_outline"])], "run string, findings array<string>, sources array<string>")
    rows = Y.finding_rows(found, "run")
    assert {(r.run, r.code): (r.severity, r.cause) for r in rows.collect()}[("r", "thin")] == ("advisory", "reused_existing_outline")
    exports = spark.createDataFrame([("r", "/x/it's a.pdf", "split", 500), ("s", "b.pdf", "split", None), ("t", "c.pdf", "tree_graph", 500), ("u", None, "split", 1)], "run string, pdf_path string, export_mode string, max_words int")
    got = {(r.run, r.cause): r for r in Y.retries(rows, "run", exports).collect()}
    assert got[("r", "reused_existing_outline")].command == "process '/x/it'\"'\"'s a.pdf' --set processing.skip_existing_bookmarks=false"
    assert got[("s", "heading_candidates_too_permissive")].overrides == ["markdown.max_words=20000"]
    assert got[("t", "heading_candidates_too_permissive")].overrides == [] and got[("t", "heading_candidates_too_permissive")].argv is None
    assert got[("u", "sparse_heading_candidates")].argv is None and got[("u", "sparse_heading_candidates")].overrides == ["typography.heading_candidate_mode=position"]


def test_numbering_names_and_fragments(spark):
    t = spark.createDataFrame([("Chapter 4 Introduction",), ("Chapter IV",), ("chapter one",), ("Appendix A",), ("appendix 7",), ("제 3 장 서론",), ("2.3.1 Markov",), ("3",), ("3 Things",), ("3abc",), ("No number",), ("제3편",)], "t string")
    got = {r.t: (r.a, r.b) for r in t.select("t", X.numbering_depth("t").alias("a"), X.ocr_numbering_depth("t").alias("b")).collect()}
    assert got == {
        "Chapter 4 Introduction": (1, 1), "Chapter IV": (None, 1), "chapter one": (None, 1), "Appendix A": (1, 1), "appendix 7": (None, 1), "제 3 장 서론": (1, 1), "2.3.1 Markov": (3, 3),
        "3": (1, 0), "3 Things": (1, 1), "3abc": (None, -1), "No number": (None, -1), "제3편": (None, -1),
    }
    names = spark.createDataFrame([("A/B: c?",), ("CON",), ("   ",), ("ﬁne 　Ａ",), ("x" * 90,), (None,)], "t string").select(X.file_slug("t").alias("s")).collect()
    assert [r.s for r in names] == ["A-B-c", "_CON", "untitled", "fine-A", "x" * 64, "untitled"]
    f = spark.createDataFrame([("",), ("Intro",), ("| a | b c",), ("![image](x) two words",), ("<img> two words",), ("12",)], "t string").select(F.array_join(R.fragment_reasons("t"), "|").alias("r")).collect()
    assert [r.r for r in f] == ["empty", "single_token", "table_like", "image_placeholder", "", "no_word"]


def test_reference_outlines(spark):
    kind = "book_id string, ord int, title string, level int, pdf_page int"
    dep = [("d", i, f"Department {i}", 1 + i % 2, i) for i in range(11)]
    chap = [("c", i, f"Chapter {i}", 1 + i % 2, i if i % 6 else None) for i in range(11)]
    got = {r.book_id: r.clean for r in O.bookmark_sets(spark.createDataFrame(dep + chap, kind)).collect()}
    assert got == {"d": False, "c": True}
    plan = spark.createDataFrame([("b", 1, "One", 1, 5)], kind).withColumn("source", F.lit("x")).withColumn("confidence", F.lit(1.0))
    extra = spark.createDataFrame([("b", 2, 1.0, "before all", 0.6), ("b", 7, 1.0, "inside", 0.6), ("z", 1, 1.0, "no plan", 0.6)], "book_id string, pdf_page int, y0 double, title string, confidence double")
    totals = spark.createDataFrame([("b", 9), ("z", 9)], "book_id string, total_pages int")
    assert [(r.title, r.level) for r in O.insert_fallback(plan, extra, totals).orderBy("ord").collect()] == [("One", 1), ("inside", 2)]


def test_settings_tell_what_they_take():
    assert explain("typography.min_tier_count")["low"] == 1 and validate("[typography]\nmin_tier_count = 0\n") and not validate("[markdown]\nmax_words = 5\n")
    for bad in ({"min_tier_count": True}, {"body_font_text_coverage": 0}, {"heading_candidate_mode": "x"}, {"position_fallback_body_font_ratio_low": 2.0}):
        with pytest.raises(ConfigError):
            TypographyConfig(**bad)
