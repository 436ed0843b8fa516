"""Sweep-line merging of closed integer intervals into periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def periods_and_gaps(intervals: DataFrame, entity: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Continuous periods and the gaps between them, for every entity.

    Result: the entity columns, ``kind`` (``period`` or ``gap``), ``start_pos`` and ``end_pos``
    (closed, BIGINT).

    * An interval opens with +1 at its start and closes with -1 after its end. Deltas are summed
      by (entity, position) before anything is ordered, so repeated and nested rows cost nothing
      and at most ``block`` rows share one (entity, block) window, whatever the entity's share of
      the input is. The sums of the blocks are carried over by a second, coarse prefix sum.
    * Intervals that touch (end + 1 = start) are one period; there is no gap of no length.
    * Rows with a null entity part are kept under the null entity; a null bound, or an end before
      its start, leaves the row out. An entity with no valid interval yields no row, an empty
      table an empty result. Further columns of the input are ignored.
    """
    valid = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    keys = [f"__k{i}" for i in range(len(entity))]
    base = valid.select(
        *[F.col(e).alias(k) for e, k in zip(entity, keys)],
        F.col(start).cast("long").alias("__s"),
        (F.col(end).cast("long") + 1).alias("__e"),
    )
    events = (
        base.select(*keys, F.explode(F.array(F.struct(F.col("__s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("__e").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
        .groupBy(*keys, F.col("x.pos").alias("pos"))
        .agg(F.sum("x.d").alias("d"))
        .where("d <> 0")
        .withColumn("blk", F.floor(F.col("pos") / block))
    )
    by_block = Window.partitionBy(*keys, "blk").orderBy("pos")
    local = events.withColumn("local", F.sum("d").over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
    over_blocks = Window.partitionBy(*keys).orderBy("blk")
    carried = (
        events.groupBy(*keys, "blk")
        .agg(F.sum("d").alias("s"))
        .withColumn("before", F.coalesce(F.sum("s").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("s")
    )
    marks = (
        _same(local, carried, [*keys, "blk"])
        .withColumn("active", F.col("local") + F.col("before"))
        .where((F.col("active") == 0) | (F.col("active") == F.col("d")))
        .select(*keys, "blk", "pos", (F.col("active") > 0).alias("opens"))
    )
    following = Window.partitionBy(*keys).orderBy("blk")
    first = marks.groupBy(*keys, "blk").agg(F.min("pos").alias("f")).withColumn("next_first", F.lead("f").over(following)).drop("f")
    nxt = _same(marks.withColumn("nxt", F.lead("pos").over(by_block)), first, [*keys, "blk"])
    return (
        nxt.withColumn("nxt", F.coalesce("nxt", "next_first"))
        .where("nxt is not null")
        .select(
            *[F.col(k).alias(e) for k, e in zip(keys, entity)],
            F.when(F.col("opens"), "period").otherwise("gap").alias("kind"),
            F.col("pos").alias("start_pos"),
            (F.col("nxt") - 1).alias("end_pos"),
        )
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on null-safe equal keys, the left's columns first."""
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(right, on, "inner").drop(*[f"__r_{k}" for k in keys])
