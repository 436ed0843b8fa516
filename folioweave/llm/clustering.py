"""Markov clustering of records that are alike in several numeric attributes.

A group of n records that are all alike has n squared links, so records are not linked. They
first fall into cells so small that all records of a cell are alike; the similarity graph is over cells.
A cell that is like another one only in part is halved, up to LEVELS times, so that as a rule all records of two cells
are alike or none are: then the flow matrix over cells is the exact quotient of the flow over records, as a
record's flow to every record of one cell is the same. Cells that are still alike in part at the last level are linked if
their middles are alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.runtime import cut

#: Ids of a group are put in order within ranges of so many ids, so that no group is one task.
ID_RANGE = 1 << 17
#: How often a cell may be halved in every attribute.
LEVELS = 2
#: Rounds after which a flow that still moves is an error; it settles in about a dozen.
MOST_ROUNDS = 200


@dataclass(frozen=True)
class Axis:
    """One attribute: alike means a difference of at most ``width``, or a quotient if ``ratio``."""

    column: str
    width: float
    ratio: bool = False


def usable(axes: list[Axis]) -> Column:
    """Records with all attributes there, and positive where a quotient is taken."""
    out = F.lit(True)
    for a in axes:
        c = F.col(a.column)
        out = out & c.isNotNull() & ~F.isnan(c)
        if a.ratio:
            out = out & (c > 0)
    return out


def _cells(records: DataFrame, axes: list[Axis]) -> list[Column]:
    """Numbers of the smallest cells; 2^LEVELS of them are as wide as alike records may differ."""
    out = []
    for i, a in enumerate(axes):
        pos = F.log(F.col(a.column)) / float(_log(a.width)) if a.ratio else F.col(a.column) / a.width
        out.append(F.floor(pos * (1 << LEVELS)).cast("int").alias(f"f{i}"))
    return out


def _log(x: float) -> float:
    import math

    # a hair narrower, so that rounding never puts two unlike records into one cell
    return math.log(x) * (1 - 1e-9)


def _all_alike(axes: list[Axis]) -> Column:
    """All records of two cells are alike: their common bounding box is no wider than allowed."""
    out = F.lit(True)
    for i, a in enumerate(axes):
        hi, lo = F.greatest(f"hi{i}", f"r_hi{i}"), F.least(f"lo{i}", f"r_lo{i}")
        out = out & ((hi <= lo * a.width) if a.ratio else (hi - lo <= a.width))
    return out


def _some_alike(axes: list[Axis]) -> Column:
    """Some records of two cells may be alike: their boxes are no farther apart than allowed."""
    out = F.lit(True)
    for i, a in enumerate(axes):
        upper, lower = F.greatest(f"lo{i}", f"r_lo{i}"), F.least(f"hi{i}", f"r_hi{i}")
        out = out & ((upper <= lower * a.width) if a.ratio else (upper - lower <= a.width))
    return out


def _middles_alike(axes: list[Axis]) -> Column:
    out = F.lit(True)
    for i, a in enumerate(axes):
        x, y = F.col(f"m{i}"), F.col(f"r_m{i}")
        out = out & ((F.greatest(x, y) <= F.least(x, y) * a.width) if a.ratio else (F.abs(x - y) <= a.width))
    return out


def cell_graph(records: DataFrame, group: str, axes: list[Axis]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (id, n), links (i, j) between alike cells, and (g, f0.., id): the cell that each smallest cell is part of.

    Neighbours are found by an equi-join on the first two numbers of the largest cells; each cell reaches the
    few columns next to its own, half of them, since a link is found once.
    """
    k = len(axes)
    fine = [f"f{i}" for i in range(k)]
    box = [e for i, a in enumerate(axes) for e in (F.min(a.column).alias(f"lo{i}"), F.max(a.column).alias(f"hi{i}"), F.sum(a.column).alias(f"s{i}"))]
    smallest = records.select(F.col(group).alias("g"), *_cells(records, axes), *[a.column for a in axes]).groupBy("g", *fine).agg(F.count("*").alias("n"), *box)
    smallest = cut(smallest.withColumn("level", F.lit(0)))
    near = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    for level in range(LEVELS + 1):
        keys = ["g", *[F.expr(f"shiftright({f}, {LEVELS})").alias(f"c{i}") for i, f in enumerate(fine)], *[F.expr(f"shiftright({f}, {LEVELS} - level)").alias(f"d{i}") for i, f in enumerate(fine)], "level"]
        sums = [e for i in range(k) for e in (F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"), (F.sum(f"s{i}") / F.sum("n")).alias(f"m{i}"))]
        names = ["g", *[f"c{i}" for i in range(k)], *[f"d{i}" for i in range(k)], "level"]
        cells = smallest.select(*keys, "n", *[f"{p}{i}" for i in range(k) for p in ("lo", "hi", "s")]).groupBy(*names).agg(F.sum("n").alias("n"), *sums)
        cells = cut(cells.withColumn("id", F.xxhash64("g", *[f"d{i}" for i in range(k)], "level")))
        reach = F.explode(F.array(*[F.struct((F.col("c0") + dx).alias("k0"), (F.col("c1") + dy).alias("k1"), F.lit(dx == 0 and dy == 0).alias("own")) for dx, dy in near]))
        kept = [c for c in cells.columns if c not in ("g", "n", "id", "c0", "c1", "level") and not c.startswith("d")]
        left = cells.withColumn("to", reach).select("g", F.col("to.k0").alias("k0"), F.col("to.k1").alias("k1"), F.col("to.own").alias("own"), F.col("id").alias("i"), *kept)
        right = cells.select("g", F.col("c0").alias("k0"), F.col("c1").alias("k1"), F.col("id").alias("j"), *[F.col(c).alias(f"r_{c}") for c in kept])
        close = F.lit(True)
        for i in range(2, k):
            close = close & (F.abs(F.col(f"c{i}") - F.col(f"r_c{i}")) <= 2)
        pairs = left.join(right, ["g", "k0", "k1"]).where(close & (~F.col("own") | (F.col("i") < F.col("j"))) & _some_alike(axes))
        pairs = cut(pairs.select("i", "j", _all_alike(axes).alias("all"), _middles_alike(axes).alias("middles")))
        mixed = pairs.where("not all")
        if level == LEVELS or mixed.isEmpty():
            break
        # only cells that are like another one in part are halved
        parts = mixed.select(F.col("i").alias("id")).unionByName(mixed.select(F.col("j").alias("id"))).distinct()
        halved = cells.join(parts, "id", "left_semi").select("g", *[f"d{i}" for i in range(k)], "level", F.lit(1).alias("more"))
        at = smallest
        for i, f in enumerate(fine):
            at = at.withColumn(f"d{i}", F.expr(f"shiftright({f}, {LEVELS} - level)"))
        on = ["g", *[f"d{i}" for i in range(k)], "level"]
        smallest = cut(at.join(halved, on, "left").withColumn("level", F.col("level") + F.coalesce("more", F.lit(0))).select(*smallest.columns))
    place = smallest.select("g", *fine, F.xxhash64("g", *[F.expr(f"shiftright({f}, {LEVELS} - level)") for f in fine], F.col("level")).alias("id"))
    return cells.select("id", "n"), pairs.where("all or middles").select("i", "j"), place


def markov_clusters(nodes: DataFrame, links: DataFrame, inflation: float = 2.0, prune: float = 1e-4, tolerance: float = 1e-6) -> DataFrame:
    """(id, cluster, flow) for every linked node (id, n) of an undirected graph (i, j).

    ``n`` is how many records a node stands for. The matrix holds the flow of one record of a
    column's node to one record of a row's node. A round squares it, raises the entries to
    ``inflation``, drops those under ``prune`` and scales the columns to 1 again, until nothing
    changes by ``tolerance``. Rows with flow on the diagonal are attractors; attractors that share a column are one system,
    named by its smallest id, and a node joins the system of its strongest flow. ``flow`` is what a record of the
    node receives from all records: the strongest ones represent their cluster.
    """
    both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j")))
    linked = both.select(F.col("j").alias("id")).distinct()
    size = cut(nodes.join(linked, "id").select("id", "n"))
    entries = both.unionByName(size.select(F.col("id").alias("i"), F.col("id").alias("j")))
    n_i = size.select(F.col("id").alias("i"), F.col("n").alias("ni"))

    def scaled(raw: DataFrame) -> DataFrame:
        whole = F.sum(F.col("p") * F.col("ni")).over(Window.partitionBy("j"))
        return raw.withColumn("p", F.col("p") / whole)

    m = cut(scaled(entries.withColumn("p", F.lit(1.0)).join(n_i, "i")))
    for _ in range(MOST_ROUNDS):
        mid = m.select("i", F.col("j").alias("k"), F.col("p").alias("pik"), F.col("ni"))
        low = m.select(F.col("i").alias("k"), "j", F.col("p").alias("pkj"), F.col("ni").alias("nk"))
        squared = mid.join(low, "k").groupBy("i", "j").agg(F.sum(F.col("pik") * F.col("pkj") * F.col("nk")).alias("p"), F.first("ni").alias("ni"))
        inflated = scaled(squared.withColumn("p", F.pow("p", F.lit(inflation)))).where(F.col("p") * F.col("ni") >= prune)
        new = scaled(inflated)
        old = m.select("i", "j", F.col("p").alias("was"))
        joined = cut(new.join(old, ["i", "j"], "full").withColumn("ni", F.coalesce("ni", F.lit(0))))
        moved = joined.agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("d")).first()["d"]
        m = joined.where("p is not null").select("i", "j", "p", "ni")
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"the flow still moves by {moved} after {MOST_ROUNDS} rounds")
    m = cut(m)
    attractors = m.where("i = j").select(F.col("i").alias("a"))
    system = m.join(attractors, m["j"] == attractors["a"]).join(attractors.select(F.col("a").alias("i")), "i").groupBy("a").agg(F.min("i").alias("cluster"))
    strongest = m.groupBy("j").agg(F.min_by("i", F.struct(-F.round(F.col("p") * F.col("ni"), 9), F.col("i"))).alias("a"))
    got = m.join(size.select(F.col("id").alias("j"), F.col("n").alias("nj")), "j").groupBy(F.col("i").alias("j")).agg(F.sum(F.col("p") * F.col("nj")).alias("flow"))
    return strongest.join(system, "a", "left").join(got, "j", "left").select(F.col("j").alias("id"), F.coalesce("cluster", "a").alias("cluster"), F.round(F.coalesce("flow", F.lit(0.0)), 9).alias("flow"))


def clustered(records: DataFrame, key: str, group: str, axes: list[Axis]) -> DataFrame:
    """(group, key, the attributes, cluster, flow): the cluster of every record that has all attributes.

    Rows repeated under one key keep their repetition here; null keys and groups, nulls and NaN
    in an attribute, and non-positive values under a quotient leave the row out. Extra columns
    are ignored. Records like no other have a cluster of one.
    """
    good = records.where(usable(axes) & F.col(key).isNotNull() & F.col(group).isNotNull()).select(group, key, *[a.column for a in axes])
    cells, links, place = cell_graph(good, group, axes)
    found = markov_clusters(cells, links)
    named = cut(place.join(found, "id", "left").select(F.col("g").alias(group), *[f"f{i}" for i in range(len(axes))], F.coalesce("cluster", "id").alias("cluster"), F.coalesce("flow", F.lit(1.0)).alias("flow")))
    placed = good.select("*", *_cells(good, axes))
    return placed.join(named, [group, *[f"f{i}" for i in range(len(axes))]]).drop(*[f"f{i}" for i in range(len(axes))])


def consecutive(members: DataFrame, key: str, cluster: list[str], id_range: int = ID_RANGE) -> DataFrame:
    """(key_a, key_b): each record with the next one of its cluster by key.

    A cluster is ordered in ranges of ids; the last record of a range is followed by the first of
    the next range that has any. Rows repeated under one key count once.
    """
    part = members.select(*cluster, key, F.floor(F.col(key) / id_range).alias("part"))
    near = Window.partitionBy(*cluster, "part").orderBy(key)
    # the last of a repeated key follows its copies and is the one that has a later neighbour
    inside = part.withColumn("next", F.lead(key).over(near)).where(F.col("next").isNull() | (F.col("next") > F.col(key)))
    has_next = inside.where("next is not null").select(F.col(key).alias(f"{key}_a"), F.col("next").alias(f"{key}_b"))
    ends = part.groupBy(*cluster, "part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    across = ends.withColumn("next", F.lead("lo").over(Window.partitionBy(*cluster).orderBy("part"))).where("next is not null")
    return has_next.unionByName(across.select(F.col("hi").alias(f"{key}_a"), F.col("next").alias(f"{key}_b")))


def described(members: DataFrame, key: str, group: str, axes: list[Axis], top: int = 3) -> DataFrame:
    """(group, cluster, size, typical, the mean attributes) of every cluster of two records or more.

    Its most typical records receive the strongest flow; of equals, as in a cluster whose records are all alike, those
    nearest to its mean, then those with smaller keys. They are chosen within hashed
    parts first, so that no cluster is ranked in one task.
    """
    own = members.select(group, "cluster", key, "flow", *[a.column for a in axes]).dropDuplicates([key])
    means = own.groupBy(group, "cluster").agg(F.count("*").alias("size"), *[F.avg(a.column).alias(f"mean_{a.column}") for a in axes]).where("size >= 2")
    dist = F.lit(0.0)
    for a in axes:
        scale = F.col(f"mean_{a.column}") * (a.width - 1) if a.ratio else F.lit(a.width)
        dist = dist + F.pow((F.col(a.column) - F.col(f"mean_{a.column}")) / scale, 2)
    near = own.join(means, [group, "cluster"]).withColumn("d", F.round(dist, 9)).withColumn("salt", F.pmod(F.hash(key), F.lit(64)))
    first = Window.partitionBy(group, "cluster", "salt").orderBy(F.desc("flow"), "d", key)
    best = Window.partitionBy(group, "cluster").orderBy(F.desc("flow"), "d", key)
    few = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top)
    names = few.groupBy(group, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("typical"))
    return means.join(names, [group, "cluster"])
