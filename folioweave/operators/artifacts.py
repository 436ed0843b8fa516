"""What runs leave behind: OCR caches and progress, batch totals, confidence, written outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS_FILES = ("ocr_page_stats.jsonl", "ocr_element_stats.jsonl", "ocr_line_stats.jsonl")


def target_pages(jobs: DataFrame) -> DataFrame:
    """(job_id, pdf_page, place): pages that a job is to recognise, each once and in order.

    ``jobs`` has ``pages`` (an array or null) and ``total_pages``; a list with a page below 1 counts as none, and without
    a list all pages of the file are meant. A job of unknown length without a list has no target.
    """
    listed = F.when(F.size("pages").isNotNull() & ~F.exists("pages", lambda p: p.isNull() | (p < 1)), F.array_sort(F.array_distinct("pages")))
    every = F.when(F.col("total_pages") >= 1, F.sequence(F.lit(1), F.col("total_pages")))
    return jobs.select("job_id", F.posexplode(F.coalesce(listed, every)).alias("place", "pdf_page")).select("job_id", "pdf_page", (F.col("place") + 1).alias("place"))


def ocr_status(jobs: DataFrame, cached: DataFrame, raw: DataFrame) -> DataFrame:
    """One row a job: how far its recognition has come, and what does not fit together.

    ``jobs`` has job_id, pages, total_pages, completed_pages and output_exists; ``cached`` (job_id, pdf_page) the
    pages that can be inserted, a null page where a file can't be read; ``raw`` (job_id) the provider's answers.
    ``complete`` needs the output and every target page; ``partial`` anything at all.
    """
    targets = target_pages(jobs)
    pages = cached.groupBy("job_id", "pdf_page").agg(F.count("*").alias("n"))
    there = pages.where("pdf_page >= 1")
    of_cache = pages.groupBy("job_id").agg(
        F.coalesce(F.sum(F.when(F.col("pdf_page") >= 1, F.col("n"))), F.lit(0)).alias("insertable_cache_count"), F.count_if(F.col("pdf_page") >= 1).alias("unique_insertable_page_count"),
        F.coalesce(F.sum(F.when(F.coalesce(F.col("pdf_page") < 1, F.lit(True)), F.col("n"))), F.lit(0)).alias("invalid_insertable_count"),
        F.array_sort(F.collect_list(F.when((F.col("n") > 1) & (F.col("pdf_page") >= 1), F.col("pdf_page")))).alias("duplicate_insertable_pages"),
    )
    left = targets.join(there.select("job_id", "pdf_page"), ["job_id", "pdf_page"], "left_anti")
    open_pages = left.groupBy("job_id").agg(F.count("*").alias("unprocessed_page_count"), F.min("pdf_page").alias("first_unprocessed_page"))
    done = jobs.select("job_id", F.coalesce("completed_pages", F.lit(0)).alias("done"))
    missing = left.join(done, "job_id").where("place <= done").groupBy("job_id").agg(F.array_sort(F.collect_list("pdf_page")).alias("missing_completed_pages"))
    counts = targets.groupBy("job_id").agg(F.count("*").alias("target_page_count"))
    raws = raw.groupBy("job_id").agg(F.count("*").alias("raw_cache_count"))
    out = jobs.select("job_id", "total_pages", F.coalesce("completed_pages", F.lit(0)).alias("progress_completed_pages"), F.coalesce("output_exists", F.lit(False)).alias("output_exists"))
    for part in (counts, of_cache, open_pages, missing, raws):
        out = out.join(part, "job_id", "left")
    numbers = ["target_page_count", "insertable_cache_count", "unique_insertable_page_count", "invalid_insertable_count", "unprocessed_page_count", "raw_cache_count"]
    none = F.array().cast("array<int>")
    out = out.na.fill(0, numbers).withColumns({c: F.coalesce(c, none) for c in ("duplicate_insertable_pages", "missing_completed_pages")})
    complete = F.col("output_exists") & (F.col("target_page_count") > 0) & (F.col("unprocessed_page_count") == 0)
    status = F.when(complete, "complete").when(F.col("total_pages").isNotNull() | (F.col("unique_insertable_page_count") > 0), "partial").otherwise("missing")
    warnings = [
        (F.col("target_page_count") == 0, "unknown_target_pages"), (F.col("invalid_insertable_count") > 0, "unreadable_cache"), (F.size("duplicate_insertable_pages") > 0, "duplicate_pages"),
        (F.size("missing_completed_pages") > 0, "completed_pages_without_cache"), (F.col("raw_cache_count") != F.col("unique_insertable_page_count"), "raw_and_insertable_differ"),
    ]
    return out.withColumn("status", status).withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in warnings])))


def last_events(log: DataFrame) -> DataFrame:
    """(job_id, event, level, pdf_page, message, elapsed_sec): the last event of each job's log (seq)."""
    e = F.struct("event", "level", "pdf_page", "message", "elapsed_sec")
    return log.groupBy("job_id").agg(F.max_by(e, "seq").alias("e")).select("job_id", "e.*")


def classification_totals(verdicts: DataFrame) -> DataFrame:
    """One row: files, scanned and native ones, targets and errors of a classification (is_scanned, target, error)."""
    scanned = F.coalesce("is_scanned", F.lit(False))
    return verdicts.agg(
        F.count("*").alias("total_pdf_count"), F.count_if(scanned).alias("scanned_count"), F.count_if(~scanned).alias("native_count"), F.count_if("target").alias("target_count"), F.count("error").alias("error_count")
    )


def overlay_plan(verdicts: DataFrame, force: bool = False, dry_run: bool = False) -> DataFrame:
    """``verdicts`` (target, output_exists, error) with ``action``: what a batch of overlays does with each file, decided before any is made.

    A file that failed to be classified fails; what is no target or already has an output is skipped, unless forced.
    """
    done = F.coalesce("output_exists", F.lit(False)) & F.lit(not force)
    action = F.when(F.col("error").isNotNull(), "failed").when(~F.coalesce("target", F.lit(False)), "skipped").when(done, "skipped").when(F.lit(dry_run), "dry_run").otherwise("process")
    return verdicts.withColumn("action", action)


def overlay_totals(results: DataFrame) -> DataFrame:
    """One row of totals of a batch of overlays (target, page_count, status, warnings)."""
    target = F.coalesce("target", F.lit(False))
    warned = F.coalesce(F.size("warnings"), F.lit(0))
    return results.agg(
        F.count("*").alias("total_pdf_count"), F.count_if(target).alias("target_count"), F.coalesce(F.sum(F.when(target, F.col("page_count"))), F.lit(0)).alias("target_page_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("processed", "dry_run", "skipped", "failed")],
        F.count_if(warned > 0).alias("warning_pdf_count"), F.coalesce(F.sum(F.greatest(warned, F.lit(0))), F.lit(0)).alias("warning_count"),
    )


def confidence_summary(books: DataFrame, lines: DataFrame, tiers: DataFrame, candidates: DataFrame, plan: DataFrame) -> DataFrame:
    """(book_id, line_extraction, tiering, heading_candidates, outline): how sure each stage of an inference is.

    Lines are there or not; tiering is a quarter of the larger number of size classes (``tiers``: book_id, tier_count, of
    fonts and heights), at most 1; the others are mean confidences, to four places, 0 without any.
    """
    mean = lambda df, name: df.groupBy("book_id").agg(F.round(F.avg("confidence"), 4).alias(name))
    has = lines.select("book_id").distinct().withColumn("line_extraction", F.lit(1.0))
    classes = tiers.groupBy("book_id").agg(F.least(F.lit(1.0), F.round(F.max("tier_count") / 4, 4)).alias("tiering"))
    out = books.select("book_id").distinct()
    for part in (has, classes, mean(candidates, "heading_candidates"), mean(plan, "outline")):
        out = out.join(part, "book_id", "left")
    return out.na.fill(0.0)


def outline_faults(expected: DataFrame, written: DataFrame) -> DataFrame:
    """(book_id, side, level, title, pdf_page, place): rows that only the plan or only the written outline has; none if they are equal.

    Rows are compared with their place in the order, so equal rows in another order are faults.
    """
    key = ["book_id", "place", "level", "title", "pdf_page"]
    a, b = (d.select("book_id", F.col("ord").alias("place"), "level", "title", "pdf_page") for d in (expected, written))
    return a.exceptAll(b).select(F.lit("expected").alias("side"), *key).unionByName(b.exceptAll(a).select(F.lit("written").alias("side"), *key))
