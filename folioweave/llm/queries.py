"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.llm import clustering, linkage, mojibake, ocrnoise, packing, quality, splitting, tokenize
from folioweave.runtime import load, once_per_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", ["doc_id", "text"])


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document; the table's key is unique, so nothing is shuffled."""
    return tokenize.encode(_documents(spark, sf_dir), "doc_id", "text").select("doc_id", "ids")


@query
def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum of every document's text as its ids give it back."""
    back = tokenize.decode(tokenize.encode(_documents(spark, sf_dir), "doc_id", "text"), "doc_id")
    return back.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


CAPACITIES = (256, 512, 1024, 2048)


@query
def p9_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's parts with the container of 2,048 tokens that holds them; a container that holds less is cut down to the next permitted length."""
    sizes = tokenize.encode(_documents(spark, sf_dir), "doc_id", "text", count_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITIES)


@query
def p9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, parts and tokens by permitted length."""
    return p9_bins(spark, sf_dir).groupBy("bin_capacity").agg(F.count_distinct("bin_id").alias("bins"), F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the list of common words is a fixed table of some two hundred rows
    common = quality.common_word_table(load(spark, sf_dir, "common_words", ["word"]), "word")
    return quality.classify(quality.statistics(_documents(spark, sf_dir), "doc_id", "text", common), "doc_id")


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't prose, with their kind."""
    # generated, so that the filter stays above it: pushed down, it would compute every statistic once more for each rule
    kinds = _quality(spark, sf_dir).select("doc_id", F.explode_outer(F.array("kind")).alias("kind"))
    return kinds.where("kind in ('list', 'table', 'junk')")


@query
def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, mean word length and symbol ratio of every document that isn't blank."""
    q = _quality(spark, sf_dir).where("kind <> 'blank'")
    return q.select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("symbol_ratio", 6).alias("symbol_ratio"))


@query
def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every document, with the rules it fails."""
    return _quality(spark, sf_dir)


STYLE = [clustering.Axis("x_unit", 0.5), clustering.Axis("y_unit", 0.5), clustering.Axis("font_ratio_to_body", 1.05, ratio=True)]


def _style_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "style_lines", ["book_id", "line_id", *[a.column for a in STYLE]])
    return clustering.clustered(lines, "line_id", "book_id", STYLE)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each style line with the next line of its group."""
    return clustering.consecutive(_style_clusters(spark, sf_dir), "line_id", ["book_id", "cluster"])


@query
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of two lines or more: size, centre and most typical lines."""
    return clustering.described(_style_clusters(spark, sf_dir), "line_id", "book_id", STYLE).drop("cluster")


@query
def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, first and last line of every group of two lines or more."""
    one = _style_clusters(spark, sf_dir).dropDuplicates(["line_id"]).groupBy("book_id", "cluster").agg(F.count("*").alias("size"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"))
    return one.where("size >= 2").drop("cluster")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = load(spark, sf_dir, "segments", ["run_id", "node_id", "export_mode", "content_markdown"])
    # the limits are a fixed table with a row for each export mode
    limits = load(spark, sf_dir, "split_limits", ["export_mode", "max_words", "overlap_words"])
    return splitting.split(seg.join(F.broadcast(limits), "export_mode"), ["run_id", "node_id"], "content_markdown", "max_words", "overlap_words")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that had to be cut."""
    return _pieces(spark, sf_dir).where("piece = 1 and n_pieces > 1").select("run_id", "node_id")


@query
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized segments."""
    return _pieces(spark, sf_dir)


@query
def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized segment: its words, and whether its pieces cover it, keep the limit and share the overlap."""
    p = _pieces(spark, sf_dir)
    seg = load(spark, sf_dir, "segments", ["run_id", "node_id", "export_mode"]).distinct()
    limits = load(spark, sf_dir, "split_limits", ["export_mode", "max_words", "overlap_words"])
    one = p.join(seg.join(F.broadcast(limits), "export_mode"), ["run_id", "node_id"])
    end = F.col("start_word") + F.col("n_words")
    by = Window.partitionBy("run_id", "node_id").orderBy("piece")
    shared = F.coalesce(F.lag(end).over(by) - F.col("start_word") == F.col("overlap_words"), F.col("start_word") == 0)
    counted = F.size(splitting.words_of(F.col("content"))) == F.col("n_words")
    each = one.select("run_id", "node_id", end.alias("end"), "start_word", (counted & (F.col("n_words") <= F.col("max_words"))).alias("within"), shared.alias("shared"))
    return each.groupBy("run_id", "node_id").agg(F.max("end").cast("long").alias("words"), (F.min("start_word") == 0).alias("whole"), F.bool_and("within").alias("within"), F.bool_and("shared").alias("shared"))


GARBLED = (("ocr_line_stats", "stat_id", "text"), ("bpe_headings", "heading_id", "title"))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, t, [k, c]).select(F.lit(t).alias("source_table"), F.col(k).alias("row_id"), F.col(c).alias("text")) for t, k, c in GARBLED]
    return mojibake.find(parts[0].unionByName(parts[1]), ["source_table", "row_id"], "text")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold wrongly decoded characters."""
    return _garbled(spark, sf_dir).select("source_table", "row_id")


@query
def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with their restored text and the encoding chain."""
    return _garbled(spark, sf_dir)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = load(spark, sf_dir, "items", ["source_item_id", "book_id", "arm", "title", "pdf_page", "predicted_level", "category"]).toDF("id", "book", "arm", "title", "page", "level", "kind")
    ol = load(spark, sf_dir, "existing_outline", ["outline_id", "book_id", "ord", "title", "pdf_page", "level"]).toDF("id", "book", "ord", "title", "page", "level")
    return linkage.link(it, ol)


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and outline rows that stand for the same heading."""
    return _links(spark, sf_dir).select(F.col("item_id").alias("source_item_id"), "outline_id")


@query
def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return _links(spark, sf_dir).withColumnRenamed("item_id", "source_item_id")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocrnoise.rows_of(
        load(spark, sf_dir, "visual_rows", ["row_id", "book_id", "pdf_page", "row_seq", "y0", "page_height", "text"]),
        load(spark, sf_dir, "ocr_line_stats", ["stat_id", "book_id", "pdf_page", "y_center_ratio", "text"]),
        load(spark, sf_dir, "subsection_report", ["sub_id", "report_id", "chapter", "raw_line"]),
    )


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of every kind in the rows of scanned pages and contents lists."""
    return ocrnoise.noise(_scanned(spark, sf_dir))


@query
def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as continuous paragraphs and contents entries."""
    return ocrnoise.paragraphs(_scanned(spark, sf_dir))
