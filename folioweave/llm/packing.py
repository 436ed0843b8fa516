"""Filling containers of fixed capacity: variable-capacity best fit on the size histogram.

Item sizes are whole numbers up to the largest capacity, so the histogram has a bounded number of
rows whatever the corpus holds. The bins are planned on it in the driver, each plan step opening
many equal bins at once, and the items then find their bin by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.runtime import cut

#: What a bin costs besides its capacity, in tokens.
BIN_COST = 64
#: Items of one size are ranked in parts of about so many rows.
RANK_PART = 200_000
#: Rank blocks for each size, over which the slots of the size are spread.
BLOCKS = 16


def plan_bins(histogram: dict[int, int], capacities: Sequence[int], bin_cost: int = BIN_COST) -> list[tuple[int, int, dict[int, int]]]:
    """(capacity, how many such bins, {size: items of it in each bin}) covering the histogram.

    The largest remaining size opens a bin. For each permitted capacity the bin is filled with
    the best-fitting (largest) remaining sizes; the capacity with the least cost for each token
    held is opened, of equals the larger one. A bin costs its capacity and ``bin_cost`` besides, so a short bin is opened where it
    saves more room than a further bin is worth. The same bin is repeated as long as the counts allow. At the end
    every bin is reduced to the smallest permitted capacity that holds its contents.
    """
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    order = sorted(left)
    caps = sorted(capacities)
    out = []
    while order:
        big = order[-1]
        best = None
        for cap in caps:
            if cap < big:
                continue
            need: dict[int, int] = {big: 1}
            room = cap - big
            while room > 0:
                at = bisect_right(order, room) - 1
                while at >= 0 and left[order[at]] - need.get(order[at], 0) <= 0:
                    at -= 1
                if at < 0:
                    break
                s = order[at]
                k = min(left[s] - need.get(s, 0), room // s)
                need[s] = need.get(s, 0) + k
                room -= k * s
            cost = (cap + bin_cost) / (cap - room)
            if best is None or cost <= best[0]:
                best = (cost, cap, need, room)
        _, cap, need, room = best
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                order.pop(bisect_right(order, s) - 1)
        out.append((next(c for c in caps if c >= cap - room), times, need))
    return out


def pack(items: DataFrame, key: str, size: str, capacities: Sequence[int] = (2048,)) -> DataFrame:
    """(key, part, n_tokens, bin_id, bin_capacity, bin_used), one row for each part of an item.

    Only an item larger than the largest capacity is divided: into full parts of that capacity
    and one remainder. ``key`` is unique. A size that is null, zero or negative takes no room: the
    item has one part of 0 tokens in bin 0, which exists even if nothing else does (capacity and
    use are then 0). Among items of one size any may take any place of that size; here they do in the order of
    their hash, so that the result is the same for every run. An empty table gives no rows.
    """
    spark = items.sparkSession
    cap = max(capacities)
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    parts = items.select(
        F.col(key),
        n.alias("n"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / cap) - 1, F.lit(0).cast("long")))).alias("part"),
    ).select(key, F.col("part").cast("int").alias("part"), F.least(F.lit(cap), F.col("n") - F.col("part") * cap).cast("int").alias("n_tokens"))
    parts = cut(parts)
    histogram = {r["n_tokens"]: r["count"] for r in parts.groupBy("n_tokens").count().collect()}
    plan = plan_bins(histogram, capacities)

    slots, seen, base = [], {}, 0
    for capacity, times, need in plan:
        used = sum(s * k for s, k in need.items())
        for s, k in need.items():
            lo = seen.get(s, 0)
            seen[s] = lo + k * times
            width = -(-histogram[s] // BLOCKS)
            for blk in range(lo // width, (seen[s] - 1) // width + 1):
                slots.append((s, blk, lo, seen[s], base, k, capacity, used))
        base += times
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("s", "blk", "lo", "hi", "base", "k", "cap", "used")])
    slots_df = spark.createDataFrame(slots, kind)
    counts = spark.createDataFrame([(s, -(-c // BLOCKS), max(1, c // RANK_PART)) for s, c in histogram.items() if s > 0], "s long, width long, spread long")

    # rank within a size: within hashed parts of it, each part starting where the former ends
    sized = parts.where("n_tokens > 0").join(F.broadcast(counts), F.col("n_tokens") == F.col("s"))
    sized = sized.withColumn("h", F.xxhash64(key, "part")).withColumn("p", F.pmod("h", "spread"))
    starts = sized.groupBy("s", "p").count()
    starts = starts.withColumn("start", F.sum("count").over(Window.partitionBy("s").orderBy("p")) - F.col("count")).drop("count")
    local = F.row_number().over(Window.partitionBy("s", "p").orderBy("h", key, "part"))
    ranked = sized.withColumn("r", local - 1).join(starts, ["s", "p"]).withColumn("r", F.col("r") + F.col("start"))
    ranked = ranked.withColumn("blk", F.floor(F.col("r") / F.col("width")))
    # the slots are as many as the plan's steps times the blocks: bounded by the largest capacity
    placed = ranked.join(F.broadcast(slots_df), ["s", "blk"]).where("r >= lo and r < hi")
    placed = placed.select(key, "part", "n_tokens", (F.col("base") + F.floor((F.col("r") - F.col("lo")) / F.col("k"))).alias("bin_id"), F.col("cap").cast("int").alias("bin_capacity"), F.col("used").cast("int").alias("bin_used"))
    first = (plan[0][0], sum(s * k for s, k in plan[0][2].items())) if plan else (0, 0)
    empty = parts.where("n_tokens = 0").select(key, "part", "n_tokens", F.lit(0).cast("long").alias("bin_id"), F.lit(first[0]).alias("bin_capacity"), F.lit(first[1]).alias("bin_used"))
    return placed.unionByName(empty)
