"""From findings to what may be tried next: severities, causes, settings and the commands that set them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.config import MarkdownSplitConfig
from folioweave.operators.review import FINDINGS

# How grave each finding is, in the order in which findings are told.
SEVERITY = {"invalid_graph": "blocking", "uncovered": "blocking", "duplicated": "advisory", "thin": "advisory", "over_split": "advisory", "fragmented": "advisory"}
# What each finding comes from. A thin export of a stored outline has a cause of its own.
CAUSES = {
    "invalid_graph": "graph_contract_violation", "uncovered": "pages_outside_any_node", "duplicated": "pages_owned_by_multiple_nodes", "thin": "sparse_heading_candidates",
    "over_split": "heading_candidates_too_permissive", "fragmented": "non_heading_text_selected",
}
STORED = "reused_existing_outline"
# The settings that a cause may be met with; causes that aren't named have none.
OVERRIDES = {
    STORED: "processing.skip_existing_bookmarks=false", "sparse_heading_candidates": "typography.heading_candidate_mode=position",
    "non_heading_text_selected": "typography.heading_candidate_mode=position_and_font",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def finding_rows(found: DataFrame, group: str) -> DataFrame:
    """(group, place, code, severity, cause): one row for each of ``findings``, in their order.

    ``sources`` (an array) tells what the export was made from: a thin one of nothing but a stored outline is told so.
    """
    rows = found.select(group, F.posexplode("findings").alias("place", "code"), "sources")
    stored = (F.col("code") == "thin") & (F.array_distinct("sources") == F.array(F.lit("existing_outline")))
    cause = F.when(F.coalesce(stored, F.lit(False)), STORED).otherwise(_lookup(CAUSES, F.col("code")))
    return rows.select(group, F.array_position(F.array(*[F.lit(f) for f in FINDINGS]), F.col("code")).cast("int").alias("place"), "code", _lookup(SEVERITY, F.col("code")).alias("severity"), cause.alias("cause"))


def retries(findings: DataFrame, group: str, exports: DataFrame) -> DataFrame:
    """(group, place, cause, overrides, argv, command): a row for each cause, once, in the order of its first finding.

    ``exports`` has pdf_path, export_mode and max_words (null where the export does not tell: the default is
    doubled then). Causes without a setting have no overrides and no command; so has a permissive selection in a tree export, which no
    word limit changes. ``argv`` is for programs; ``command`` is the same for a POSIX shell.
    """
    first = findings.groupBy(group, "cause").agg(F.min("place").alias("place"))
    rows = first.join(exports.select(group, "pdf_path", "export_mode", "max_words"), group, "left")
    doubled = F.concat(F.lit("markdown.max_words="), (2 * F.coalesce("max_words", F.lit(MarkdownSplitConfig().max_words))).cast("string"))
    wide = (F.col("cause") == CAUSES["over_split"]) & ~F.col("export_mode").eqNullSafe("tree_graph")
    setting = F.when(wide, doubled).otherwise(_lookup(OVERRIDES, F.col("cause")))
    rows = rows.withColumn("overrides", F.array_compact(F.array(setting)))
    runs = (F.size("overrides") > 0) & F.col("pdf_path").isNotNull()
    argv = F.concat(F.array(F.lit("process"), F.col("pdf_path")), F.flatten(F.transform("overrides", lambda o: F.array(F.lit("--set"), o))))
    return rows.withColumn("argv", F.when(runs, argv)).select(group, "place", "cause", "overrides", "argv", F.array_join(F.transform("argv", quoted), " ").alias("command"))


def quoted(word: Column) -> Column:
    """A word as a POSIX shell needs it: as it is where nothing in it is special, else in single quotes."""
    plain = word.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
