import pytest

from folioweave.config import ProcessingConfig
from folioweave.operators import scans as S
from folioweave.plans import runs
from folioweave.sources import files, sinks


def test_discovery_plans_and_markdown(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("b.PDF", "a.pdf", "x.txt", "sub/c.pdf"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = files.discover(spark, str(tmp_path / "in"), recursive=True, exclude=("a*",)).collect()
    assert [r.relative for r in found] == ["b.PDF", "sub/c.pdf"] and len(found[0].sha256) == 64
    (tmp_path / "p.json").write_text('{"title":"A","level":1,"pdf_page":2}\n{"title":" ","level":1,"pdf_page":2}\nnonsense\n')
    good, bad = files.read_plan(spark, str(tmp_path / "p.json"))
    assert good.count() == 1 and bad.count() == 2
    nodes = spark.createDataFrame([("b", "n0001-A.md", "# A")], "book_id string, file_name string, markdown string")
    assert [r.status for r in sinks.write_markdown(nodes, str(tmp_path / "out")).collect()] == ["written"]
    assert (tmp_path / "out" / "b" / "n0001-A.md").read_text() == "# A"


def test_globs_and_hashes(spark, tmp_path):
    (tmp_path / "out").mkdir()
    for name in ("Ab1.pdf", "b.pdf", "out/c.pdf"):
        (tmp_path / name).write_bytes(b"x")
    found = files.discover(spark, str(tmp_path), recursive=True, include=("a[a-c]?.pdf", "out/*"), skip="out", hashed=False)
    assert [r.relative for r in found.collect()] == ["Ab1.pdf"] and "sha256" not in found.columns
    with pytest.raises(ValueError):
        files.discover(spark, str(tmp_path), skip="./")
    (tmp_path / "r1").mkdir()
    for name in ("manifest.json", "markdown_manifest.json"):
        (tmp_path / "r1" / name).write_text("{}")
    best = files.first_manifest(files.manifest_candidates(spark, str(tmp_path))).collect()
    assert len(best) == 1 and best[0].path.endswith("markdown_manifest.json") and best[0].more


def test_kinds_of_plan_values(spark, tmp_path):
    rows = ['{"title": 5, "level": 1, "pdf_page": 2}', '{"title": "a", "level": true, "pdf_page": 2}', '{"title": "b", "level": 1, "pdf_page": 2.5}', '{"title": "c", "level": 1, "pdf_page": 2, "confidence": "high"}',
            '{"title": "d", "level": 1, "pdf_page": 2, "evidence": [1]}', '{"title": "e", "level": 1, "pdf_page": 2, "source": 3}', "[1]", '{"title": "ok", "level": 2, "pdf_page": 7, "confidence": 0.5, "evidence": ["x"], "source": "s"}']
    (tmp_path / "p.json").write_text("\n".join(rows))
    good, bad = files.read_plan(spark, str(tmp_path / "p.json"))
    assert [(r.title, r.level, r.evidence) for r in good.collect()] == [("ok", 2, ["x"])]
    assert sorted(r.error for r in bad.collect()) == sorted(["blank title", "level or page missing", "level or page missing", "confidence is no number", "evidence is no list of texts", "source is no text", "not a plan item"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, [1, 2])], "book_id string, n int, xs array<int>")
    sinks.write_report(df, str(tmp_path / "rep"), {"total": 1})
    assert spark.read.option("header", True).csv(str(tmp_path / "rep" / "report_csv")).first().xs == "[1,2]"
    assert spark.read.text(str(tmp_path / "rep" / "summary")).first().value == '{"total": 1}'
    sinks.write_stages({"x": df}, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "st" / "x")).count() == 1
    images = spark.createDataFrame([("b", 7, b"png")], "book_id string, pdf_page int, image binary")
    assert [(r.file_name, r.status) for r in sinks.write_images(images, str(tmp_path / "img")).collect()] == [("page_00007.png", "written")]
    assert (tmp_path / "img" / "b" / "page_00007.png").read_bytes() == b"png"
    old = spark.createDataFrame([("001_L1_p3_x.md",), ("nodes/0001_L1_p0003_x.md",), ("manifest.json",)], "relative string")
    assert sinks.legacy_files(old).count() == 2


def test_new_books_are_inferred_as_they_arrive(spark, tmp_path):
    from folioweave.streaming import ingest
    from tests.test_typography import LINE, golden

    spark.createDataFrame(golden(), LINE).write.parquet(str(tmp_path / "in"))
    lines = ingest.watch_lines(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = ingest.infer_new_books(lines, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(240)
    assert not query.isActive and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_words_of_a_scan(spark):
    words = spark.createDataFrame([("b", 1, "e", n, t, x, y, x + 30, y + 10, 1000.0) for n, t, x, y in ((0, "two", 50.0, 10.0), (1, "one", 10.0, 11.0), (2, "below", 10.0, 60.0))], "book_id string, pdf_page int, element_id string, word_seq int, text string, x0 double, y0 double, x1 double, y1 double, page_height double")
    rows = S.words_to_rows(words)
    assert [r.text for r in rows.orderBy("row").collect()] == ["one two", "below"]
    elements = spark.createDataFrame([("b", 1, "e", "one two below")], "book_id string, pdf_page int, element_id string, content string")
    assert S.overlay_modes(elements, rows).first().overlay_mode == "word"
    lines = spark.createDataFrame([("b", 1, "l", 0.0, 0.0, 100.0, 130.0), ("b", 1, "m", 0.0, 500.0, 9.0, 510.0)], "book_id string, pdf_page int, line_key string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([("b", 1, 10.0, 10.0, 20.0, 20.0, 9.0), ("b", 1, 10.0, 100.0, 20.0, 110.0, 11.0)], "book_id string, pdf_page int, x0 double, y0 double, x1 double, y1 double, size double")
    assert {r.line_key: r.inserted_size for r in S.inserted_sizes(lines, spans).collect()} == {"l": 10.0, "m": None}
    images = spark.createDataFrame([("b", 1, 0.0, 0.0, 100.0, 95.0, 100.0, 100.0), ("b", 2, -50.0, 0.0, 50.0, 50.0, 100.0, 100.0)], "book_id string, pdf_page int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    texts = spark.createDataFrame([("b", 1, 3, 400), ("b", 2, 0, 30)], "book_id string, pdf_page int, mode int, chars int")
    got = {r.pdf_page: (r.image_coverage_ratio, r.is_scan_like_page, r.reject_reasons) for r in S.page_signals(images, texts).collect()}
    assert got == {1: (0.95, True, []), 2: (0.25, False, ["low_image_coverage", "visible_text"])}


def test_runs(spark):
    assert runs.run_id("abcdef0123", ProcessingConfig()).count("-") == 2
    events = spark.createDataFrame([("r", "created", 1, None), ("r", "running", 2, None), ("r", "failed", 2, "x")], "run_id string, state string, at int, error string")
    assert runs.latest_states(events).first().state == "failed"
