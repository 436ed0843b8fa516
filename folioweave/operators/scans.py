"""Scanned documents and OCR output: page signals, verdicts, rows, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as X

# A page is like a scan from this image share on and below so much visible text.
IMAGE_SHARE, VISIBLE_CHARS, SCAN_FRACTION = 0.85, 10, 0.9
VISIBLE_MODES = (0, 1, 2, 4, 5, 6)


def sampled_pages(books: DataFrame, most: int = 50) -> DataFrame:
    """(book_id, page_index): all pages of a short book, else evenly spread ones (total_pages)."""
    every = books.where("total_pages > 0").select("book_id", "total_pages", F.explode(F.sequence(F.lit(0), F.least("total_pages", F.lit(most)) - 1)).alias("i"))
    at = F.when(F.col("total_pages") <= most, F.col("i")).otherwise(F.floor(F.col("i") * F.col("total_pages") / most))
    return every.select("book_id", at.cast("int").alias("page_index")).distinct()


def page_signals(images: DataFrame, texts: DataFrame) -> DataFrame:
    """(book_id, pdf_page, image_coverage_ratio, visible_char_count, invisible_char_count, is_scan_like_page, reject_reasons).

    ``images`` has boxes with the page's size, ``texts`` (mode, chars). The share is that of the
    single largest image inside the page.
    """
    w = F.greatest(F.lit(0.0), F.least("x1", "page_width") - F.greatest("x0", F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least("y1", "page_height") - F.greatest("y0", F.lit(0.0)))
    img = images.groupBy("book_id", "pdf_page").agg(F.max(F.try_divide(w * h, F.col("page_width") * F.col("page_height"))).alias("c"))
    seen = F.col("mode").isin(*VISIBLE_MODES)
    txt = texts.groupBy("book_id", "pdf_page").agg(F.sum(F.when(seen, F.col("chars")).otherwise(0)).alias("v"), F.sum(F.when(seen, 0).otherwise(F.col("chars"))).alias("i"))
    full = img.join(txt, ["book_id", "pdf_page"], "full")
    out = full.select("book_id", "pdf_page", F.coalesce("c", F.lit(0.0)).alias("image_coverage_ratio"), F.coalesce("v", F.lit(0)).alias("visible_char_count"), F.coalesce("i", F.lit(0)).alias("invisible_char_count"))
    low, much = F.col("image_coverage_ratio") < IMAGE_SHARE, F.col("visible_char_count") >= VISIBLE_CHARS
    return out.withColumn("is_scan_like_page", ~low & ~much).withColumn("reject_reasons", F.array_compact(F.array(F.when(low, F.lit("low_image_coverage")), F.when(much, F.lit("visible_text")))))


def scan_verdicts(signals: DataFrame) -> DataFrame:
    """(book_id, pages, scan_fraction, visible_chars, is_scanned, reasons): enough scan-like pages and no visible text at all."""
    agg = signals.groupBy("book_id").agg(F.count("*").alias("pages"), F.avg(F.col("is_scan_like_page").cast("double")).alias("scan_fraction"), F.sum("visible_char_count").alias("visible_chars"))
    few, text = F.col("scan_fraction") < SCAN_FRACTION, F.col("visible_chars") > 0
    reasons = F.array_compact(F.array(F.when(few, F.format_string("scan_like_page_fraction=%.4f", "scan_fraction")), F.when(text, F.format_string("visible_chars=%d", "visible_chars"))))
    return agg.withColumn("is_scanned", ~few & ~text).withColumn("reasons", reasons)


def ocr_targets(verdicts: DataFrame, outlines: DataFrame, min_page_count: int = 1) -> DataFrame:
    """(book_id, target, reject_reason): scanned books without a meaningful outline; the first reason that holds."""
    full = verdicts.join(outlines.select("book_id", "meaningful"), "book_id", "left")
    reason = F.when(~F.col("is_scanned"), "not_scanned").when(F.col("pages") < min_page_count, "below_min_page_count").when(F.coalesce("meaningful", F.lit(False)), "meaningful_bookmarks")
    return full.select("book_id", reason.isNull().alias("target"), reason.alias("reject_reason"))


def words_to_rows(words: DataFrame, share: float = 0.006) -> DataFrame:
    """(book_id, pdf_page, element_id, row, text, box): words of an element in rows.

    In order of (centre, x0) a word goes on in the row of the word before it while their centres
    are within ``share`` of the page's height: islands of a lag, within one element.
    """
    c = (F.col("y0") + F.col("y1")) / 2
    by = Window.partitionBy("book_id", "pdf_page", "element_id").orderBy("c", "x0", "word_seq")
    marked = words.withColumn("c", c).withColumn("new", F.coalesce((F.abs(F.col("c") - F.lag("c").over(by)) > share * F.col("page_height")).cast("int"), F.lit(1)))
    rows = marked.withColumn("row", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("book_id", "pdf_page", "element_id", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def overlay_modes(elements: DataFrame, rows: DataFrame) -> DataFrame:
    """(book_id, pdf_page, element_id, overlay_mode): word if the words say the content, row if there are as many rows as content lines, else element."""
    said = rows.groupBy("book_id", "pdf_page", "element_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ").alias("said"), F.count("*").alias("n"))
    lines = F.size(X.text_lines("content"))
    full = elements.join(said, ["book_id", "pdf_page", "element_id"], "left")
    return full.select("book_id", "pdf_page", "element_id", F.when(X.normalized("said") == X.normalized("content"), "word").when(F.col("n") == lines, "row").otherwise("element").alias("overlay_mode"))


def page_statistics(lines: DataFrame, top: float = 0.33) -> DataFrame:
    """Lines, words, characters, heights, inserted sizes, large and numeric lines and element categories of each page of OCR lines.

    A line is large from its page's 90th percentile of height on, and ``top_region_large_line_count`` counts the large
    ones in the upper third; quantiles are linear. Categories are counted by element, and one without is ``unknown``. Null
    counts are 0; null heights and sizes take no part.
    """
    h, key = F.col("height_pt"), ["book_id", "pdf_page"]
    size = F.col("inserted_font_size_median_pt")
    limits = lines.groupBy(*key).agg(F.percentile(h, F.lit(0.9)).alias("cut"))
    wide = lines.join(limits, key)
    elements = lines.groupBy(*key, "element_id").agg(F.max("category").alias("category")).select(*key, F.when(F.coalesce("category", F.lit("")) == "", "unknown").otherwise(F.col("category")).alias("category"))
    cats = elements.groupBy(*key, "category").count().groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("category_counts"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stats = wide.groupBy(*key).agg(
        F.count("*").alias("line_count"), total("word_count").alias("word_count"), total("char_count").alias("char_count"),
        F.min(h).alias("line_height_min_pt"), *[F.percentile(h, F.lit(q)).alias(f"line_height_{n}_pt") for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))], F.max(h).alias("line_height_max_pt"),
        F.percentile(size, F.lit(0.5)).alias("inserted_font_size_median_pt"), F.max(size).alias("inserted_font_size_max_pt"),
        F.count_if(h >= F.col("cut")).alias("large_line_count"), F.count_if((h >= F.col("cut")) & (F.col("y_center_ratio") <= top)).alias("top_region_large_line_count"), F.count_if("is_numeric_only").alias("numeric_only_line_count"),
    )
    return stats.join(cats, key)


def element_statistics(lines: DataFrame) -> DataFrame:
    """(book_id, pdf_page, element_id, lines, words, chars, box) of OCR lines by element."""
    return lines.groupBy("book_id", "pdf_page", "element_id").agg(
        F.count("*").alias("lines"), F.sum(X.word_count("text")).alias("words"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.min("x0_pt").alias("x0"), F.min("y0_pt").alias("y0"), F.max("x1_pt").alias("x1"), F.max("y1_pt").alias("y1")
    )


def inserted_sizes(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(book_id, line_key, inserted_size): median size of the spans whose centre lies in the line's box.

    Boxes and centres meet on (book, page, band of 64 points), so a page's boxes are not all
    compared with all its spans.
    """
    band = 64
    boxes = lines.withColumn("b", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
    mid = spans.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).select("book_id", "pdf_page", "size", "cx", "cy", F.floor(F.col("cy") / band).alias("b"))
    hit = boxes.join(mid, ["book_id", "pdf_page", "b"]).where("cx between x0 and x1 and cy between y0 and y1")
    return lines.select("book_id", "line_key").join(hit.groupBy("book_id", "line_key").agg(F.percentile("size", F.lit(0.5)).alias("inserted_size")), ["book_id", "line_key"], "left")


def font_bounds(page_height: Column) -> tuple[Column, Column]:
    """Smallest and largest overlay size of a page of this height."""
    scale = F.greatest(F.lit(1.0), page_height / 792.0)
    return 3.0 * scale, 18.0 * scale


def scaled_box(x0: Column, y0: Column, x1: Column, y1: Column, sx: Column, sy: Column, least: float = 2.0) -> Column:
    """A pixel box in points, at least ``least`` wide and high."""
    return F.struct((x0 * sx).alias("x0"), (y0 * sy).alias("y0"), F.greatest(x1 * sx, x0 * sx + least).alias("x1"), F.greatest(y1 * sy, y0 * sy + least).alias("y1"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 24)


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    return wanted.join(cached.select("cache_key"), "cache_key", "left_anti")
