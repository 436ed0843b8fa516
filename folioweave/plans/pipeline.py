"""The outline of every book from its positioned lines: the flagship plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.config import TypographyConfig
from folioweave.operators import density as D
from folioweave.operators import geometry as G
from folioweave.operators import lines as L
from folioweave.operators import outline as O
from folioweave.runtime import cut, cut_table


# Fixed value: so many books' names, a few MB, are sent to every executor; more are joined by shuffle.
BROADCAST_BOOKS = 50_000


@dataclass
class Inference:
    """All stages of one run over all books, each a table."""

    lines: DataFrame
    totals: DataFrame
    cuts: DataFrame
    profile: DataFrame
    spacing: DataFrame
    chunks: DataFrame
    headings: DataFrame
    font_plan: DataFrame
    fallback: DataFrame
    plan: DataFrame
    warnings: DataFrame


def page_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("book_id").agg(F.max("pdf_page").alias("total_pages"))


def find_headings(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> dict[str, DataFrame]:
    """The stages up to the headings by size or position, by name.

    The small tables for each book are materialised, since every later stage uses them. Lines and blocks are
    written as tables, as each stage reads columns of its own.
    """
    lines = cut_table(lines)
    totals = cut(page_totals(lines))
    body = cut_table(L.without_margins(lines, config))
    cuts = cut(D.font_cuts(body))
    tiered = D.with_tier(body, cuts, "font_size")
    profile = cut(D.font_profile(tiered, config.body_font_text_coverage))
    restored = cut_table(D.with_tier(L.merge_print_fragments(body), cuts, "font_size"))
    spacing = cut(D.gap_limit(D.body_gaps(restored, profile)))
    blocks = cut_table(G.merge_non_body(G.chunks(restored, spacing), profile, spacing, cuts))
    headings = cut(G.headings(blocks, profile, cuts, spacing, config))
    return {"lines": body, "totals": totals, "cuts": cuts, "profile": profile, "spacing": spacing, "chunks": blocks, "headings": headings}


def infer(lines: DataFrame, config: TypographyConfig = TypographyConfig()) -> Inference:
    """From lines to a validated plan. Books without a heading by size take the older evidence path."""
    found = find_headings(lines, config)
    body, headings, blocks = found["lines"], found["headings"], found["chunks"]
    profile, cuts, spacing, totals = found["profile"], found["cuts"], found["spacing"], found["totals"]
    font_plan = O.normalized_plan(O.plan_of_headings(headings, config.bpe_max_node_words, config.bpe_level_pollution_ratio))
    bare = cut(totals.select("book_id").join(headings.select("book_id").distinct(), "book_id", "left_anti"))
    if n := bare.count():
        alone = body.join(F.broadcast(bare) if n <= BROADCAST_BOOKS else bare, "book_id", "left_semi")
        font_plan = font_plan.unionByName(legacy_plan(D.with_tier(alone, cuts, "font_size"), config))
    font_plan = cut(font_plan)
    if config.position_fallback_enabled:
        fallback = G.fallback_candidates(blocks, profile, cuts, spacing, font_plan, config)
    else:
        fallback = blocks.where("false").select("book_id", "chunk_id", F.col("text").alias("title"), "pdf_page", "y0", "y1", F.lit(0).alias("support_pages"), F.lit(0.0).alias("isolation_ratio"), F.lit(0.0).alias("font_ratio"), F.lit(0.6).alias("confidence"))
    fallback = cut(fallback)
    plan = cut(O.insert_fallback(font_plan, fallback, totals))
    return Inference(**found, font_plan=font_plan, fallback=fallback, plan=plan, warnings=O.validation(plan, totals))


def legacy_plan(tiered: DataFrame, config: TypographyConfig = TypographyConfig()) -> DataFrame:
    """A plan from evidence: one candidate a page, its level from its numbering, else its tier, no deeper than one below the level before."""
    from pyspark.sql import Window

    best = G.strongest_per_page(G.evidence_candidates(L.merge_same_tier_lines(tiered, config), config))
    raw = best.withColumn("raw", F.least(F.greatest(F.coalesce("numbering_depth", "tier"), F.lit(1)), F.lit(6)))
    order = Window.partitionBy("book_id").orderBy("pdf_page", "y0", "line_id")
    ranked = cut(raw.withColumn("ord", F.row_number().over(order)))
    # the clamp depends on the level before it, so a book's levels are folded as one array of small numbers
    levels = ranked.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]).alias("raws"))
    clamp = F.aggregate("raws", F.array().cast("array<int>"), lambda acc, r: F.concat(acc, F.array(F.least(r, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1))))
    placed = levels.select("book_id", F.posexplode(clamp).alias("n", "level")).select("book_id", (F.col("n") + 1).alias("ord"), "level")
    plan = ranked.join(placed, ["book_id", "ord"]).select("book_id", "ord", "title", "level", "pdf_page", F.lit("typography").alias("source"), "confidence")
    return O.normalized_plan(plan)
