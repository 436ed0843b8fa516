"""Parent links to full hierarchies: cycles, depth, roots, paths, descendants.

The forest may be of any depth and any one group may hold most of the rows, so nothing walks a
chain link by link: pointers are squared, which covers 2^k links in k joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.runtime import cut

#: Children of one parent are ordered within this many hashed parts, so no parent is one task.
SPREAD = 64


def node_key(c: Column | str) -> Column:
    """How node references are compared: without case and outer blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def resolve_parents(nodes: DataFrame, group: str, node: str, parent: str, children: str) -> DataFrame:
    """(g, v, node, p): each node's key ``v`` and the key ``p`` of its parent, null for a root.

    The parent is what ``parent`` names; where that is null, the node whose ``children`` lists it
    (of several, the one with the smallest key). A name that is not in the group gives no parent.
    Of rows whose keys are equal the smallest spelling of ``node`` stands for the node. Rows with a
    null group or node id are left out; null or empty children lists list nobody.
    """
    base = nodes.where(F.col(node).isNotNull() & F.col(group).isNotNull()).select(
        F.col(group).alias("g"), node_key(node).alias("v"), F.col(node).alias("node"), node_key(parent).alias("named"), F.col(children).alias("kids")
    )
    own = base.groupBy("g", "v").agg(F.min("node").alias("node"), F.min("named").alias("named"))
    listed = (
        base.select("g", F.col("v").alias("lister"), F.explode("kids").alias("kid"))
        .select("g", "lister", node_key("kid").alias("v"))
        .groupBy("g", "v")
        .agg(F.min("lister").alias("lister"))
    )
    wanted = _beside(own, listed, ["g", "v"], "left").select("g", "v", "node", F.coalesce("named", "lister").alias("want"))
    there = own.select("g", F.col("v").alias("want"), F.lit(True).alias("there"))
    return _beside(wanted, there, ["g", "want"], "left").select("g", "v", "node", F.when(F.col("there"), F.col("want")).alias("p"))


def _beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and merge: loop tables grow with the data, so none is ever sent to the driver."""
    return left.join(right.hint("merge"), on, how)


def classify_cycles(links: DataFrame) -> DataFrame:
    """``links`` with ``state``: ``tree``, ``cycle`` or ``below_cycle``.

    Peeling the leaves m times leaves exactly the image of the m-fold parent map. The map is
    squared until its image is empty or, from one round to the next, as large as before: then the
    map only permutes it, so the image is the cycles; the nodes that still have an m-fold parent
    without being in it hang below one. The rounds follow the longest chain, not the largest group.
    """
    links = cut(links)
    jump = cut(links.where("p is not null").select("g", "v", F.col("p").alias("j")))
    left, before = jump.select("g", "j").distinct().count(), -1
    while left and left != before:
        jump = cut(_beside(jump, jump.select("g", F.col("v").alias("j"), F.col("j").alias("jj")), ["g", "j"]).select("g", "v", F.col("jj").alias("j")))
        before, left = left, jump.select("g", "j").distinct().count()
    endless = jump.select("g", "v", F.lit(1).alias("mark"))
    image = jump.select("g", F.col("j").alias("v"), F.lit(2).alias("mark"))
    marks = endless.unionByName(image).groupBy("g", "v").agg(F.max("mark").alias("mark"))
    state = F.when(F.col("mark") == 2, "cycle").when(F.col("mark") == 1, "below_cycle").otherwise("tree")
    return cut(_beside(links, marks, ["g", "v"], "left").select("g", "v", "node", "p", state.alias("state")))


def euler_intervals(tree: DataFrame) -> DataFrame:
    """(g, v, root, depth, entry, exit) of a forest (g, v, p).

    The tour of a tree has two elements for each node; each element knows only its successor.
    List ranking by pointer doubling gives every element its distance to the end of its tour and
    the sum of +1/-1 up to there: hence position, depth and the root that the tour ends at.
    A node's descendants are the nodes of its root with ``entry`` inside its interval.
    """
    kids = tree.where("p is not null").select("g", "v", "p", F.pmod(F.hash("v"), F.lit(SPREAD)).alias("b"))
    heads = kids.groupBy("g", "p", "b").agg(F.min("v").alias("head"))
    over = Window.partitionBy("g", "p").orderBy("b")
    heads = heads.withColumn("next_head", F.lead("head").over(over)).withColumn("rank", F.row_number().over(over))
    near = Window.partitionBy("g", "p", "b").orderBy("v")
    kids = _beside(kids.withColumn("near", F.lead("v").over(near)), heads, ["g", "p", "b"]).select("g", "v", F.coalesce("near", "next_head").alias("sib"))
    first = heads.where("rank = 1").select("g", F.col("p").alias("v"), F.col("head").alias("kid"))
    nodes = _beside(_beside(tree.select("g", "v", "p"), kids, ["g", "v"], "left"), first, ["g", "v"], "left")
    # an element is (v, 0) on entry and (v, 1) on exit; w counts the depth that is left to the end
    enter = nodes.select("g", "v", F.lit(0).alias("o"), F.coalesce("kid", "v").alias("nv"), F.when(F.col("kid").isNull(), 1).otherwise(0).alias("no"), F.lit(-1).alias("w"))
    leave = nodes.select("g", "v", F.lit(1).alias("o"), F.coalesce("sib", "p").alias("nv"), F.when(F.col("sib").isNotNull(), 0).otherwise(1).alias("no"), F.lit(1).alias("w"))
    one = F.lit(1).cast("long")
    tour = enter.unionByName(leave).select(
        "g", "v", "o", "nv", "no", F.when(F.col("nv").isNull(), 0).otherwise(one).alias("dist"), F.when(F.col("nv").isNull(), 0).otherwise(F.col("w").cast("long")).alias("sum"),
        F.when(F.col("nv").isNull(), F.col("v")).alias("end"),
    )
    tour = cut(tour)
    ranked, open_ = tour.where("nv is null"), tour.where("nv is not null")
    while not open_.isEmpty():
        # an element that has reached its end is written once and only read as a target from then on
        right = ranked.unionByName(open_).select("g", F.col("v").alias("nv"), F.col("o").alias("no"), F.col("nv").alias("n2"), F.col("no").alias("o2"), F.col("dist").alias("d2"), F.col("sum").alias("s2"), F.col("end").alias("e2"))
        moved = cut(
            _beside(open_, right, ["g", "nv", "no"]).select(
                "g", "v", "o", F.col("n2").alias("nv"), F.col("o2").alias("no"), (F.col("dist") + F.col("d2")).alias("dist"), (F.col("sum") + F.col("s2")).alias("sum"), F.coalesce("end", "e2").alias("end")
            )
        )
        ranked, open_ = ranked.unionByName(moved.where("nv is null")), moved.where("nv is not null")
    tour = ranked
    both = tour.groupBy("g", "v").agg(
        F.max(F.when(F.col("o") == 0, F.col("dist"))).alias("din"),
        F.max(F.when(F.col("o") == 1, F.col("dist"))).alias("dout"),
        F.max(F.when(F.col("o") == 1, F.col("sum"))).alias("depth"),
        F.max("end").alias("root"),
    )
    both = cut(both)
    span = both.where("v = root").select("g", "root", F.col("din").alias("whole"))
    return _beside(both, span, ["g", "root"]).select("g", "v", "root", "depth", (F.col("whole") - F.col("din")).alias("entry"), (F.col("whole") - F.col("dout")).alias("exit"))


def hierarchy(nodes: DataFrame, group: str, node: str, parent: str, children: str) -> DataFrame:
    """Every node with its root, depth and Euler interval.

    Result: the group column, ``node_id``, ``root_id``, ``depth``, ``state``, ``entry``, ``exit``,
    ``n_descendants`` and the keys ``v``, ``p``. For a node on a cycle ``root_id`` is ``cycle``, for
    one whose chain of parents runs into a cycle ``below_cycle``; both have depth -1 and null
    interval. Extra columns are ignored, repeated rows count once, an empty table gives no rows.
    """
    states = classify_cycles(resolve_parents(nodes, group, node, parent, children))
    tours = euler_intervals(states.where("state = 'tree'").select("g", "v", "p"))
    names = states.select("g", F.col("v").alias("root"), F.col("node").alias("root_name"))
    placed = _beside(_beside(states, tours, ["g", "v"], "left"), names, ["g", "root"], "left")
    return cut(placed).select(
        F.col("g").alias(group),
        F.col("node").alias("node_id"),
        F.when(F.col("state") == "tree", F.col("root_name")).otherwise(F.col("state")).alias("root_id"),
        F.coalesce(F.col("depth"), F.lit(-1)).cast("int").alias("depth"),
        "state",
        "entry",
        "exit",
        F.floor((F.col("exit") - F.col("entry") - 1) / 2).alias("n_descendants"),
        "v",
        "p",
    )


def paths(links: DataFrame) -> DataFrame:
    """(g, v, path): node names from the root down to ``v``, for acyclic links (g, v, node, p).

    Ancestor arrays are doubled as the parent map is squared; their total length is that of the
    result, and no group is gathered in one place.
    """
    up = cut(links.select("g", "v", "p", F.array("node").alias("path")))
    done, open_ = up.where("p is null"), up.where("p is not null")
    while not open_.isEmpty():
        right = done.unionByName(open_).select("g", F.col("v").alias("p"), F.col("p").alias("p2"), F.col("path").alias("above"))
        moved = cut(_beside(open_, right, ["g", "p"]).select("g", "v", F.col("p2").alias("p"), F.concat("above", "path").alias("path")))
        done, open_ = done.unionByName(moved.where("p is null")), moved.where("p is not null")
    return done.select("g", "v", "path")


def descendant_pairs(placed: DataFrame, group: str, block: int = 1 << 10) -> DataFrame:
    """(group, ancestor_id, descendant_id) for all proper descendants, from Euler intervals.

    Entries are cut into blocks; an ancestor reaches each block that its interval meets, so the
    join is on equal (group, root, block) and a row is only paired inside its own interval.
    """
    tree = placed.where("state = 'tree'")
    anc = tree.where("n_descendants > 0").select(
        group, "root_id", F.col("node_id").alias("ancestor_id"), F.col("entry").alias("a_in"), F.col("exit").alias("a_out"),
        F.explode(F.sequence(F.floor(F.col("entry") / block), F.floor(F.col("exit") / block))).alias("blk"),
    )
    des = tree.select(group, "root_id", F.col("node_id").alias("descendant_id"), "entry", F.floor(F.col("entry") / block).alias("blk"))
    return (
        _beside(anc, des, [group, "root_id", "blk"])
        .where((F.col("entry") > F.col("a_in")) & (F.col("entry") < F.col("a_out")))
        .select(group, "ancestor_id", "descendant_id")
    )
