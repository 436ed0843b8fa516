"""Runs over many books at once: which plan each book gets, what is exported, and what failed.

A book's failure is a row with its error; the other books of the batch go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.config import ProcessingConfig
from folioweave.operators import export as E
from folioweave.operators import outline as O
from folioweave.plans import pipeline as P
from folioweave.runtime import cut


@dataclass
class Applied:
    """What applying plans gave: the plans as applied, the level of each split, nodes and files, and one row for each book."""

    plan: DataFrame
    levels: DataFrame
    nodes: DataFrame
    files: DataFrame
    report: DataFrame


def decide(stored: DataFrame, totals: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> DataFrame:
    """(book_id, reuse, reason): whether a book's stored outline is its plan; books without one are inferred."""
    quality = O.quality(stored, totals, config.outline_quality)
    decided = O.reuse_decision(quality, O.validation(stored, totals), config.skip_existing_bookmarks, config.outline_quality.replace_when_low_quality)
    return totals.select("book_id").join(decided, "book_id", "left").select("book_id", F.coalesce("reuse", F.lit(False)).alias("reuse"), F.when(F.col("reuse").isNull(), "no_stored_outline").otherwise(F.col("reason")).alias("reason"))


def chosen_plans(lines: DataFrame, stored: DataFrame, totals: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> tuple[DataFrame, DataFrame]:
    """(plan, decision) of every book: the stored outline where it is reused, else the inference over the book's lines.

    Only books that are not reused are inferred.
    """
    decision = cut(decide(stored, totals, config))
    kept = stored.join(decision.where("reuse"), "book_id", "left_semi").select("book_id", "ord", "title", "level", "pdf_page", F.lit("existing_outline").alias("source"), F.lit(1.0).alias("confidence"))
    inferred = P.infer(lines.join(decision.where("not reuse"), "book_id", "left_semi"), config.typography).plan
    return kept.unionByName(inferred.select(*kept.columns)), decision


def apply(plan: DataFrame, totals: DataFrame, page_texts: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> Applied:
    """Exports of valid plans. A plan with a fault, before or after it is cut to its split level, exports nothing and is reported.

    With ``markdown.enabled`` a book is split at the level that its word limit asks for and the plan keeps the items down to that level;
    else its whole tree is exported. A graph that does not hold together fails its book.
    """
    plan = cut(plan)
    faults = O.validation(plan, totals).groupBy("book_id").agg(F.array_sort(F.collect_set("warning")).alias("faults"))
    valid = plan.join(faults, "book_id", "left_anti")
    if config.markdown.enabled:
        words = page_texts.select("book_id", "pdf_page", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
        levels = cut(E.split_level(E.split_segments(valid, totals, words), config.markdown))
        applied = cut(valid.join(levels.select("book_id", "chosen_level"), "book_id").where("level <= chosen_level").drop("chosen_level"))
        nodes = cut(E.split_nodes(E.split_documents(valid, totals, page_texts, levels)))
        files = E.split_markdown(nodes)
        mode = ("bounded", "split")
    else:
        levels = valid.select("book_id").distinct().select("book_id", F.lit(None).cast("int").alias("chosen_level"), F.lit(False).alias("fallback"))
        applied = valid
        nodes = cut(E.graph_nodes(valid, totals, config.markdown_content_mode))
        files = E.node_markdown(nodes, page_texts, config.markdown_content_mode)
        mode = (config.markdown_content_mode, "tree_graph")
    again = O.validation(applied, totals).groupBy("book_id").agg(F.array_sort(F.collect_set("warning")).alias("later_faults"))
    broken = E.graph_validation(E.linked_nodes(nodes).select("book_id", "node_id", "parent_id", "children_ids", "previous_id", "next_id"), "book_id")
    broken = broken.where(" + ".join(c for c in broken.columns if c not in ("book_id", "nodes")) + " > 0").select("book_id", F.lit(True).alias("broken"))
    counts = nodes.groupBy("book_id").agg(F.count("*").alias("files"))
    report = plan.groupBy("book_id").agg(F.count("*").alias("source_items"))
    kept = applied.groupBy("book_id").agg(F.count("*").alias("applied_items"))
    for part in (kept, counts, levels, faults, again, broken):
        report = report.join(part, "book_id", "left")
    error = F.when(F.col("faults").isNotNull(), F.concat(F.lit("invalid plan: "), F.array_join("faults", ", "))).when(F.col("later_faults").isNotNull(), F.concat(F.lit("invalid applied plan: "), F.array_join("later_faults", ", "))).when(F.col("broken"), "graph does not hold together")
    report = cut(report.withColumn("error", error).withColumn("state", F.when(F.col("error").isNull(), "succeeded").otherwise("failed")))
    report = report.select("book_id", "state", "error", "source_items", F.coalesce("applied_items", F.lit(0)).alias("applied_items"), F.coalesce("files", F.lit(0)).alias("files"), "chosen_level", F.coalesce("fallback", F.lit(False)).alias("fallback"))
    good = report.where("state = 'succeeded'")
    toc = E.toc_markdown(nodes, *mode).select("book_id", F.lit("toc.md").alias("file_name"), F.col("toc").alias("markdown"))
    out = files.select("book_id", F.concat(F.lit("nodes/"), "file_name").alias("file_name"), "markdown").unionByName(toc)
    return Applied(applied.join(good, "book_id", "left_semi"), levels, nodes.join(good, "book_id", "left_semi"), out.join(good, "book_id", "left_semi"), report)


def process(lines: DataFrame, stored: DataFrame, totals: DataFrame, page_texts: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> Applied:
    """Plans chosen and applied; the report tells of each book whether its outline was reused and why not. Books without a plan are skipped."""
    plan, decision = chosen_plans(lines, stored, totals, config)
    done = apply(plan, totals, page_texts, config)
    report = decision.join(done.report, "book_id", "left").withColumn("state", F.coalesce("state", F.lit("skipped"))).withColumn("error", F.when(F.col("state") == "skipped", "no plan").otherwise(F.col("error")))
    return Applied(done.plan, done.levels, done.nodes, done.files, report)


def counts(report: DataFrame) -> dict[str, int]:
    """How many books a run finished, failed and skipped."""
    row = report.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("succeeded", "failed", "skipped")]).first()
    return row.asDict()
