"""Registered core queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.config import MarkdownSplitConfig, OutlineQualityConfig, TypographyConfig
from folioweave.functions import text as X
from folioweave.functions.similarity import blocked_pairs
from folioweave.operators import bpe as B
from folioweave.operators import contents as T
from folioweave.operators import density as D
from folioweave.operators import evaluation as V
from folioweave.operators import export as E
from folioweave.operators import geometry as G
from folioweave.operators import hierarchy as H
from folioweave.operators import intervals as I
from folioweave.operators import lines as L
from folioweave.operators import outline as O
from folioweave.operators import review as R
from folioweave.operators import scans as S
from folioweave.plans import pipeline as P
from folioweave.runtime import cut, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "segments", ["run_id", "node_id", "parent_id", "children_ids"])


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of the pages of each export and each report."""
    seg = load(spark, sf_dir, "segments", ["run_id", "content_start_page", "content_end_page"])
    rep = load(spark, sf_dir, "subsection_report", ["report_id", "start_page", "end_page"])
    ranges = seg.toDF("entity_id", "s", "e").withColumn("src", F.lit(0)).unionByName(rep.toDF("entity_id", "s", "e").withColumn("src", F.lit(1)))
    out = I.periods_and_gaps(ranges, ["src", "entity_id"], "s", "e")
    return out.select("entity_id", "kind", F.col("start_pos").cast("int").alias("start_page"), F.col("end_pos").cast("int").alias("end_page"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node of every export."""
    h = H.hierarchy(_segments(spark, sf_dir), "run_id", "node_id", "parent_id", "children_ids")
    return h.select("run_id", "node_id", "root_id", "depth")


@query
def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path and number of descendants of every node that is in a tree."""
    h = H.hierarchy(_segments(spark, sf_dir), "run_id", "node_id", "parent_id", "children_ids").where("state = 'tree'")
    links = h.select(F.col("run_id").alias("g"), "v", F.col("node_id").alias("node"), "p")
    p = H.paths(links).withColumnRenamed("g", "run_id")
    return h.join(p.hint("merge"), ["run_id", "v"]).select("run_id", "node_id", F.concat_ws("/", "path").alias("path"), "depth", "n_descendants")


@query
def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (ancestor, descendant) pairs of every export."""
    h = H.hierarchy(_segments(spark, sf_dir), "run_id", "node_id", "parent_id", "children_ids")
    return H.descendant_pairs(h, "run_id")


# ---- the reference's operators, over the tables of this project -----------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_rows(load(spark, sf_dir, "style_lines", L.LINE))


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the size class that the density of their book's sizes puts them in."""
    lines = _lines(spark, sf_dir)
    return D.with_tier(lines, D.font_cuts(lines), "font_size")


def _spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's spacing of body lines, from the gaps between them."""
    t = _tiered(spark, sf_dir)
    return D.gap_limit(D.body_gaps(t, D.font_profile(t)))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunks(_lines(spark, sf_dir), _spacing(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """Blocks of a candidate class with ``size_rank``, 1 for the largest class of their book that is one."""
    lines = _lines(spark, sf_dir)
    profile = D.font_profile(_tiered(spark, sf_dir))
    found = G.font_candidates(_chunks(spark, sf_dir), profile, D.font_cuts(lines), config)
    ranks = profile.select("book_id", F.posexplode("candidate_tiers").alias("n", "tier")).withColumn("size_rank", F.col("n") + 1).drop("n")
    return found.join(ranks, ["book_id", "tier"]).withColumnRenamed("text", "title")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored outlines as plans: rows with a page, in order."""
    rows = load(spark, sf_dir, "existing_outline", ["outline_id", "book_id", "ord", "title", "level", "pdf_page"]).dropDuplicates(["outline_id"]).where("pdf_page is not null and title is not null")
    order = Window.partitionBy("book_id").orderBy("ord", "outline_id")
    return rows.withColumn("ord", F.row_number().over(order)).select("book_id", "ord", "title", "level", "pdf_page", F.lit("existing_outline").alias("source"), F.lit(1.0).alias("confidence"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, total_pages): the last page of each book that any of its lines or outline rows is on."""
    rows = [load(spark, sf_dir, t, ["book_id", "pdf_page"]) for t in ("existing_outline", "style_lines", "ocr_line_stats", "visual_rows")]
    each = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return each.where("book_id is not null and pdf_page is not null").groupBy("book_id").agg(F.max("pdf_page").alias("total_pages"))


def _found(spark: SparkSession, sf_dir: str, arm: str) -> DataFrame:
    """The headings of one arm as a plan."""
    rows = load(spark, sf_dir, "items", ["source_item_id", "book_id", "arm", "title", "pdf_page", "predicted_level", "category"]).dropDuplicates(["source_item_id"])
    rows = rows.where((F.col("arm") == arm) & F.col("pdf_page").isNotNull() & F.col("title").isNotNull() & (F.coalesce("category", F.lit("")) != "caption"))
    order = Window.partitionBy("book_id").orderBy("pdf_page", "source_item_id")
    return rows.select("book_id", F.row_number().over(order).alias("ord"), "title", F.col("predicted_level").alias("level"), "pdf_page", F.lit(arm).alias("source"), F.lit(0.8).alias("confidence"))


ARMS = ("vision_pass", "stack_refine")


def _of_arms(spark: SparkSession, sf_dir: str, of_arm) -> DataFrame:
    """``of_arm(headings)`` of each arm's headings, one below the other, with ``arm``."""
    return reduce(DataFrame.unionByName, [of_arm(_found(spark, sf_dir, a)).withColumn("arm", F.lit(a)) for a in ARMS])


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "ocr_line_stats", ["stat_id", "book_id", "pdf_page", "text"]).dropDuplicates(["stat_id"])
    return rows.groupBy("book_id", "pdf_page").agg(F.coalesce(F.sum(X.word_count("text")), F.lit(0)).alias("words"))


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["stat_id", "book_id", "pdf_page", "element_id", "category", "text", "char_count", "word_count", "is_numeric_only", "inserted_font_size_median_pt", "x0_pt", "y0_pt", "x1_pt", "y1_pt", "height_pt", "y_center_ratio"]
    return load(spark, sf_dir, "ocr_line_stats", columns).dropDuplicates(["stat_id"])


@query
def inferred_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole inference: levelled headings of every book."""
    return P.infer(_lines(spark, sf_dir)).plan.select("book_id", "ord", "title", "level", "pdf_page", "source")


@query
def inferred_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.infer(_lines(spark, sf_dir)).warnings


@query
def position_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by repeated position alone."""
    return P.find_headings(_lines(spark, sf_dir), TypographyConfig(heading_candidate_mode="position"))["headings"].select("book_id", "chunk_id", "title", "pdf_page", "tier")


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, pdf_page, text): the OCR lines of each page in reading order, white space normalised."""
    lines = _ocr(spark, sf_dir).where("text is not null")
    return lines.groupBy("book_id", "pdf_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stat_id", X.normalized("text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))


@query
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", "text", X.word_count("text").alias("words"))


@query
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("book_id", "ord", X.match_key("title").alias("match_key"))


@query
def numbering_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return p.select("book_id", "ord", X.numbering_depth("title").cast("int").alias("depth"), X.ocr_numbering_depth("title").cast("int").alias("ocr_depth"))


@query
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.posexplode(X.text_lines("text")).alias("line_no", "line"))


@query
def title_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(X.title_shaped("text")).select("line_id")


@query
def repeated_margin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeated_margin_lines(_lines(spark, sf_dir)).select("book_id", "side", "bucket", "key", "count")


@query
def printed_page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reliable_page_offsets(_lines(spark, sf_dir), TypographyConfig(margin_min_consecutive_pages=2))


@query
def margin_removed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_margins(_lines(spark, sf_dir), TypographyConfig(margin_min_consecutive_pages=2)).select("book_id", "line_id")


@query
def font_tier_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.font_cuts(_lines(spark, sf_dir)).select("book_id", F.posexplode("cuts").alias("n", "cut")).select("book_id", "n", F.round("cut", 6).alias("cut"))


@query
def body_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spacing(spark, sf_dir).select("book_id", F.round("body_spacing", 6).alias("body_spacing"), F.round("continuation_upper", 6).alias("continuation_upper"))


@query
def height_tier_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.height_cuts(_lines(spark, sf_dir)).select("book_id", "cuts", "peaks", "raw_tiers")


@query
def height_tier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, peak and lines of every height class."""
    lines = _lines(spark, sf_dir)
    return D.tier_sets(lines, cut(D.height_cuts(lines)), "height")


@query
def font_tier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and lines of every size class."""
    lines = _lines(spark, sf_dir)
    t = D.tier_sets(lines, cut(D.font_cuts(lines)), "font_size")
    return t.select("book_id", "tier", F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"), "peak", "count")


@query
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tier_summary(_tiered(spark, sf_dir))


@query
def tier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tier_coverage(_tiered(spark, sf_dir)).select("book_id", "tier", "body")


@query
def font_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.font_profile(_tiered(spark, sf_dir)).select("book_id", "body_tiers", "candidate_tiers", "body_size")


@query
def body_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiered(spark, sf_dir)
    return D.body_gaps(t, D.font_profile(t)).groupBy("book_id").agg(F.count("*").alias("gaps"), F.percentile("value", F.lit(0.5)).alias("median_gap"))


@query
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("book_id", "chunk_id", "pdf_page", "x0", "y0", "line_count", "font_size")


@query
def anchor_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.anchor_patterns(_chunks(spark, sf_dir), _spacing(spark, sf_dir)).select("book_id", "chunk_id", *[F.round(F.col("values")[k], 6).alias(f"v{k}") for k in range(4)])


@query
def bpe_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's body class by count, and the relative spacing of its body lines."""
    rows = B.flagged(_tiered(spark, sf_dir))
    _, book = B.body_spacing(rows)
    return B.body_tier(_tiered(spark, sf_dir)).join(book, "book_id", "left").select("book_id", "body_tier", F.coalesce("book_spacing", F.lit(1.0)).alias("book_spacing"))


@query
def bpe_page_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = B.body_spacing(B.flagged(_tiered(spark, sf_dir)))
    return page


@query
def bpe_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by merged pairs of size classes; pairs count from two on, as these books are short."""
    return B.bpe_headings(_tiered(spark, sf_dir), TypographyConfig(bpe_min_pair_count=2)).select("book_id", "pdf_page", "title", "tier", "y0", "y1", "merged_line_count", "is_pollution")


@query
def bpe_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same headings as a plan."""
    found = B.bpe_headings(_tiered(spark, sf_dir), TypographyConfig(bpe_min_pair_count=2))
    return O.plan_of_headings(found).select("book_id", "ord", "title", "level", "pdf_page")


@query
def position_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cluster_statistics(G.position_clusters(G.anchor_patterns(_chunks(spark, sf_dir), _spacing(spark, sf_dir))))


@query
def heading_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.evidence_candidates(_tiered(spark, sf_dir))
    return e.select("book_id", "line_id", "confidence", F.array_join("evidence", "|").alias("evidence"))


@query
def strongest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strongest_per_page(G.evidence_candidates(_tiered(spark, sf_dir))).select("book_id", "pdf_page", "line_id")


@query
def page_cap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by size on the pages that hold at most two of them."""
    lines = _lines(spark, sf_dir)
    config = TypographyConfig(heading_candidate_mode="font", max_headings_per_page=2)
    return G.headings(_chunks(spark, sf_dir), D.font_profile(_tiered(spark, sf_dir)), D.font_cuts(lines), _spacing(spark, sf_dir), config).select("book_id", "chunk_id", "tier")


@query
def plan_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.normalized_plan(_plan(spark, sf_dir)).select("book_id", "ord", "title", "level", "pdf_page")


@query
def plan_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parents(_plan(spark, sf_dir)).select("book_id", "ord", "parent_ord")


@query
def plan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return O.ranges(p, _totals(spark, sf_dir)).select("book_id", "ord", "start_page", "end_page")


@query
def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return O.validation(p, _totals(spark, sf_dir))


@query
def deepest_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = O.ranges(_plan(spark, sf_dir), _totals(spark, sf_dir))
    return _of_arms(spark, sf_dir, lambda found: O.deepest_parent(found.select("book_id", "pdf_page").distinct(), ranged))


@query
def outline_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = O.quality(_plan(spark, sf_dir), _totals(spark, sf_dir), OutlineQualityConfig(max_item_to_page_ratio=0.2))
    return q.select("book_id", "items", "low_quality", F.array_join("reasons", "|").alias("reasons"), F.array_join("evidence", "|").alias("evidence"))


@query
def clean_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bookmark_sets(_plan(spark, sf_dir))


@query
def outline_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    t = _totals(spark, sf_dir)
    return O.reuse_decision(O.quality(p, t, OutlineQualityConfig(max_item_to_page_ratio=0.2)), O.validation(p, t), replace_low=True)


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return E.graph_nodes(p, _totals(spark, sf_dir)).drop("title", "ord", "source", "confidence")


@query
def page_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return E.ownership(E.graph_nodes(p, _totals(spark, sf_dir)))


@query
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    totals, words = _totals(spark, sf_dir), _page_words(spark, sf_dir)
    return reduce(DataFrame.unionByName, [E.coverage(E.graph_nodes(p, totals, mode), totals, words).withColumn("mode", F.lit(mode)) for mode in ("inclusive", "direct")])


@query
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return E.split_segments(p, _totals(spark, sf_dir), _page_words(spark, sf_dir))


@query
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return E.split_statistics(E.split_segments(p, _totals(spark, sf_dir), _page_words(spark, sf_dir)), 300)


@query
def split_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return E.split_level(E.split_segments(p, _totals(spark, sf_dir), _page_words(spark, sf_dir)), MarkdownSplitConfig(max_words=300))


@query
def ancestor_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ancestor_titles(_plan(spark, sf_dir)).select("book_id", "ord", F.array_join("ancestors", " > ").alias("ancestors"))


@query
def node_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = E.graph_nodes(_plan(spark, sf_dir), _totals(spark, sf_dir))
    return E.node_markdown(nodes, _page_texts(spark, sf_dir)).drop("ord", "children_ids")


def _split_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each book's split at the level that 300 words ask for, as nodes."""
    p, totals = cut(O.normalized_plan(_plan(spark, sf_dir))), cut(_totals(spark, sf_dir))
    level = E.split_level(E.split_segments(p, totals, _page_words(spark, sf_dir)), MarkdownSplitConfig(max_words=300))
    return E.split_nodes(E.split_documents(p, totals, _page_texts(spark, sf_dir), level))


@query
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, ranges, words and text of the documents of every book's split."""
    return _split_nodes(spark, sf_dir).select("book_id", "node_id", "ord", "level", "content_start_page", "content_end_page", "parent_id", "previous_id", "next_id", F.array_join("contained_ids", "|").alias("contained_ids"), "word_count", F.md5("content_markdown").alias("content_md5"), F.length("content_markdown").alias("content_length"))


@query
def split_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the split."""
    return E.split_markdown(_split_nodes(spark, sf_dir)).drop("ord", "children_ids")


@query
def toc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return E.toc_markdown(E.graph_nodes(p, _totals(spark, sf_dir)))


@query
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    nodes = E.graph_nodes(p, _totals(spark, sf_dir))
    return E.manifest(nodes, E.coverage(nodes, _totals(spark, sf_dir), _page_words(spark, sf_dir)))


@query
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = load(spark, sf_dir, "segments", ["run_id", "node_id", "parent_id", "children_ids", "previous_id", "next_id"]).dropDuplicates(["run_id", "node_id"])
    return E.graph_validation(seg, "run_id")


@query
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _plan(spark, sf_dir)
    matched = _of_arms(spark, sf_dir, lambda found: V.greedy_matches(V.scored_pairs(gold, found)))
    return matched.select("arm", "book_id", "gold_ord", "pred_ord", F.round("similarity", 6).alias("similarity"))


@query
def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _plan(spark, sf_dir)
    return _of_arms(spark, sf_dir, lambda found: V.metrics(gold, found, V.greedy_matches(V.scored_pairs(gold, found))))


@query
def plan_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.plan_difference(_found(spark, sf_dir, "vision_pass"), _found(spark, sf_dir, "stack_refine"), tolerance=1)


@query
def title_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs near in page whose title words overlap by more than half."""
    a = _plan(spark, sf_dir).select("book_id", F.col("ord").alias("a_ord"), F.col("pdf_page").alias("a_page"), X.match_key("title").alias("ka"))

    def near(found: DataFrame) -> DataFrame:
        b = found.select("book_id", F.col("ord").alias("b_ord"), F.col("pdf_page").alias("b_page"), X.match_key("title").alias("kb"))
        pairs = blocked_pairs(a, b, ["book_id"], "a_page", "b_page", 1).withColumn("dice", F.round(X.token_dice(F.col("ka"), F.col("kb")), 6))
        return pairs.where("dice > 0.5").select("book_id", "a_ord", "b_ord", "dice")

    return _of_arms(spark, sf_dir, near)


@query
def node_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_found(spark, sf_dir, arm).withColumnRenamed("pdf_page", "start_page") for arm in ("vision_pass", "stack_refine"))
    return V.node_set_difference(a, b)


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    per_page = _ocr(spark, sf_dir).groupBy("book_id", "pdf_page").agg(F.count("*").alias("lines"))
    # an item's candidates are the headings of both arms
    found = _of_arms(spark, sf_dir, lambda found: found)
    return R.attention(p, per_page, found)


@query
def attention_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("book_id", "ord", F.array_join("signals", "|").alias("signals"))


@query
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.priority(_reviewed(spark, sf_dir)).select("book_id", "rank", "ord")


@query
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    s = R.summary(_reviewed(spark, sf_dir), _totals(spark, sf_dir))
    return s.select("book_id", "items", "attention_items", "attention_ratio", "items_per_page")


@query
def density_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    return R.density(p, _totals(spark, sf_dir))


def _graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = load(spark, sf_dir, "segments", ["run_id", "node_id", "title", "level", "content_start_page", "content_end_page", "parent_id", "children_ids", "previous_id", "next_id", "word_count"]).dropDuplicates(["run_id", "node_id"])
    good = (F.col("content_end_page") >= F.col("content_start_page")) & F.col("content_start_page").isNotNull()
    pages = F.when(good, F.col("content_end_page") - F.col("content_start_page") + 1).otherwise(0)
    stats = R.node_statistics(seg, "run_id", pages)
    owned = seg.where(good).select("run_id", F.explode(F.sequence("content_start_page", "content_end_page")).alias("p")).groupBy("run_id", "p").agg(F.count("*").alias("n"))
    own = owned.groupBy("run_id").agg(F.max("p").alias("pages"), F.count("*").alias("assigned"), F.count_if(F.col("n") > 1).alias("duplicated_pages"))
    valid = E.graph_validation(seg, "run_id").select("run_id", (F.col("unreachable") == 0).alias("valid"))
    full = stats.join(own, "run_id", "left").join(valid, "run_id").na.fill(0, ["pages", "assigned", "duplicated_pages"])
    return full.withColumn("unassigned_ratio", F.round(F.coalesce(F.try_divide(F.col("pages") - F.col("assigned"), "pages"), F.lit(0.0)), 4))


@query
def node_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_stats(spark, sf_dir).select("run_id", "nodes", "mean_pages", "has_words", "words_median", "words_p90", "fragment_ratio")


@query
def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(_graph_stats(spark, sf_dir)).select("run_id", F.array_join("findings", "|").alias("findings"), "verdict")


@query
def title_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("book_id", "ord", F.array_join(R.fragment_reasons("title"), "|").alias("reasons")).where("reasons <> ''")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sweep(_candidates(spark, sf_dir), P.page_totals(_lines(spark, sf_dir)))


@query
def knob_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query
def plausible_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that give a sensible number of headings."""
    return R.plausible_settings(_sweep(spark, sf_dir)).select("book_id", *R.KNOBS, "candidate_count")


@query
def knob_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = cut(_sweep(spark, sf_dir))
    return reduce(DataFrame.unionByName, [R.knob_direction(swept, k) for k in R.KNOBS])


@query
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sampled_pages(_totals(spark, sf_dir))


@query
def ocr_page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_statistics(_ocr(spark, sf_dir)).drop("category_counts")


@query
def ocr_element_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.element_statistics(_ocr(spark, sf_dir))


@query
def scan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of OCR lines as signals: text that a viewer sees is that of numeric lines here."""
    o = _ocr(spark, sf_dir)
    images = o.groupBy("book_id", "pdf_page").agg(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.max(F.col("y_center_ratio") * 100).alias("y1")).withColumn("page_width", F.lit(100.0)).withColumn("page_height", F.lit(100.0))
    texts = o.select("book_id", "pdf_page", F.when(X.is_numeric_only("text"), 0).otherwise(3).alias("mode"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return S.scan_verdicts(S.page_signals(images, texts)).select("book_id", "pages", F.round("scan_fraction", 6).alias("scan_fraction"), "visible_chars", "is_scanned")


@query
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "subsection_report", ["sub_id", "raw_line"]).dropDuplicates(["sub_id"]).where("raw_line is not null")
    return T.entries(r).select("sub_id", "entry_no", "entry_title", "entry_page")


@query
def inferred_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contents row's page, taken from its neighbours in the chapter where it has none that the chapter holds."""
    r = load(spark, sf_dir, "subsection_report", ["sub_id", "report_id", "chapter", "start_page", "end_page", "page"]).dropDuplicates(["sub_id"])
    return T.filled_pages(r, ["report_id", "chapter"], "sub_id", "page").select("sub_id", "inferred_page")


@query
def chapter_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "subsection_report", ["sub_id", "report_id", "chapter", "start_page", "end_page", "page"]).dropDuplicates(["sub_id"])
    chapters = r.select("report_id", "chapter", "start_page", "end_page").distinct()
    return T.chapter_of_page(r.where("page is not null").select("report_id", "page").distinct(), chapters)


@query
def unwrapped_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", ["doc_id", "text"]).where("text is not null")
    return T.unwrapped(d.select(F.col("doc_id").cast("string").alias("book_id"), F.lit(1).alias("pdf_page"), "text")).drop("pdf_page")


@query
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.posexplode(T.text_pieces(F.col("text"))).alias("piece", "content"))


@query
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", *T.class_counts("text"))
