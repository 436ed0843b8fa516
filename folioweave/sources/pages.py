"""Page texts, stored outlines, page lists and JSON artefacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.functions import text as X


class InputError(ValueError):
    """Something that the caller named isn't there or isn't what it should be."""


def page_list(text: str | None) -> list[int] | None:
    """Pages of a list such as ``1-3,42``: each once, in order; None where nothing is given."""
    if not (text or "").strip():
        return None
    pages: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        pages.update(range(*_bounds(part)))
    return sorted(pages)


def page_range(text: str | None) -> tuple[int, int] | None:
    """One page or one closed range; None where nothing is given."""
    if not (text or "").strip():
        return None
    first, beyond = _bounds(text.strip())
    return first, beyond - 1


def _bounds(part: str) -> tuple[int, int]:
    first, dash, last = part.partition("-")
    try:
        a, b = int(first), int(last if dash else first)
    except ValueError:
        raise InputError(f"{part!r} is no page and no range of pages") from None
    if a < 1 or b < a:
        raise InputError(f"{part!r} is no rising range of pages from 1 on")
    return a, b + 1


def page_to_index(page: Column | str) -> Column:
    """Place of a page counted from 0; pages below 1 have none."""
    p = F.col(page) if isinstance(page, str) else page
    return F.when(p >= 1, p - 1)


def index_to_page(index: Column | str) -> Column:
    i = F.col(index) if isinstance(index, str) else index
    return F.when(i >= 0, i + 1)


def page_texts(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(book_id, pdf_page, text, char_count) of each page, up to page ``most``; a null text is blank."""
    kept = pages.where(F.col("pdf_page") <= most) if most is not None else pages
    return kept.select("book_id", "pdf_page", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"))


def selected_pages(pages: DataFrame, totals: DataFrame, wanted: list[int]) -> tuple[DataFrame, DataFrame]:
    """(texts of the wanted pages, faults): a fault is a book and a wanted page beyond its last one."""
    numbers = sorted(set(wanted))
    asked = totals.select("book_id", "total_pages", F.explode(F.array(*[F.lit(n) for n in numbers]) if numbers else F.array().cast("array<int>")).alias("pdf_page"))
    faults = asked.where((F.col("pdf_page") < 1) | (F.col("pdf_page") > F.col("total_pages"))).select("book_id", "pdf_page", "total_pages")
    good = asked.where((F.col("pdf_page") >= 1) & (F.col("pdf_page") <= F.col("total_pages"))).select("book_id", "pdf_page")
    texts = good.join(pages.select("book_id", "pdf_page", "text"), ["book_id", "pdf_page"], "left")
    return page_texts(texts), faults


def stored_outline(rows: DataFrame) -> DataFrame:
    """(book_id, ord, title, level, pdf_page) of the outline in a file: titles normalised, pages below 1 null, numbered from 1."""
    order = Window.partitionBy("book_id").orderBy("ord")
    return rows.select("book_id", F.row_number().over(order).alias("ord"), X.normalized("title").alias("title"), "level", F.when(F.col("pdf_page") >= 1, F.col("pdf_page")).alias("pdf_page"))


def book_summary(totals: DataFrame, pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(book_id, total_pages, text_pages, char_count, bookmarks) of each book."""
    texts = page_texts(pages).groupBy("book_id").agg(F.count_if(F.col("char_count") > 0).alias("text_pages"), F.sum("char_count").alias("char_count"))
    marks = outline.groupBy("book_id").agg(F.count("*").alias("bookmarks"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return totals.join(texts, "book_id", "left").join(marks, "book_id", "left").select("book_id", "total_pages", n("text_pages"), n("char_count"), n("bookmarks"))


REVIEW_ITEM = "book_id string, ord int, title string, level int, pdf_page int, source string, signals array<string>"


def read_review_items(spark: SparkSession, path: str, schema: str = REVIEW_ITEM) -> tuple[DataFrame, DataFrame]:
    """(items, faults): review items in JSON lines, blank lines left out; a fault names its file, line and text."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    numbered = raw.withColumn("line", F.monotonically_increasing_id())
    start = F.min("line").over(Window.partitionBy("file"))
    rows = numbered.withColumn("line", (F.col("line") - start + 1).cast("int")).where(F.trim("value") != "")
    parsed = rows.withColumn("item", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("item").isNull() | F.col("item._corrupt_record").isNotNull()
    return parsed.where(~bad).select("item.*").drop("_corrupt_record"), parsed.where(bad).select("file", "line", F.col("value").alias("text"))


def read_json(spark: SparkSession, paths: DataFrame, schema: str) -> DataFrame:
    """``paths`` (path) with ``value`` and ``warning``: what each JSON file holds, or null and why.

    Files are read by the executors; one that is missing, no JSON or no object never ends the job.
    """
    texts = paths.mapInPandas(_file_texts, "path string, content string, error string")
    value = F.from_json("content", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = texts.withColumn("value", value)
    warning = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.trim("content").startswith("{"), "no JSON object").when(F.col("value._corrupt_record").isNotNull() | F.col("value").isNull(), "no valid JSON")
    fields = [f.name for f in read.schema["value"].dataType.fields if f.name != "_corrupt_record"]
    return read.withColumn("warning", warning).select("path", F.when(F.col("warning").isNull(), F.struct(*[F.col(f"value.{f}").alias(f) for f in fields])).alias("value"), "warning")


def _file_texts(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for path in pdf["path"]:
            try:
                with open(path.removeprefix("file://").removeprefix("file:"), encoding="utf-8") as f:
                    out.append((path, f.read(), None))
            except (OSError, UnicodeDecodeError) as e:
                out.append((path, None, f"not readable: {type(e).__name__}"))
        yield pd.DataFrame(out, columns=["path", "content", "error"])


def strict_json(spark: SparkSession, paths: DataFrame, schema: str) -> DataFrame:
    """The same, for manifests that must be there: the first fault is raised, told apart as unreadable, no JSON or no object."""
    read = read_json(spark, paths, schema)
    fault = read.where("warning is not null").orderBy("path").first()
    if fault is not None:
        raise InputError(f"{fault['path']}: {fault['warning']}")
    return read.select("path", "value")
