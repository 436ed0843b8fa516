import random

from folioweave.operators import hierarchy as H

SCHEMA = "run string, node string, parent string, kids array<string>, v int, p int"


def place(spark, rows):
    return {(r.run, r.node_id): r for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA), "run", "node", "parent", "kids").collect()}


def test_cycles_case_blanks_lists_and_lost_parents(spark):
    rows = [
        ("r", "a", None, ["B "], 1, 1), ("r", "b", None, [], 1, 1), ("r", "c", " A", None, 1, 1), ("r", "c", " A", None, 1, 1), ("r", "d", "nowhere", None, 1, 1),
        ("r", "x", "y", None, 1, 1), ("r", "y", "x", None, 1, 1), ("r", "z", "x", None, 1, 1), ("r", "s", "s", None, 1, 1), ("r", None, "a", None, 1, 1), ("q", "a", None, None, 1, 1),
    ]
    got = place(spark, rows)
    root = {k: (r.root_id, r.depth) for k, r in got.items()}
    assert root == {
        ("r", "a"): ("a", 0), ("r", "b"): ("a", 1), ("r", "c"): ("a", 1), ("r", "d"): ("d", 0), ("r", "x"): ("cycle", -1), ("r", "y"): ("cycle", -1),
        ("r", "z"): ("below_cycle", -1), ("r", "s"): ("cycle", -1), ("q", "a"): ("a", 0),
    }
    assert got[("r", "a")].n_descendants == 2


def test_random_forest_against_walks(spark):
    rng = random.Random(3)
    rows, parent = [], {}
    for n in range(30):
        p = None if n == 0 or rng.random() < 0.05 else f"n{rng.randrange(max(0, n - 3), n)}"
        parent[f"n{n}"] = p
        rows.append(("r", f"n{n}", p, None, 0, 0))
    chain = lambda v: [v] + (chain(parent[v]) if parent[v] else [])
    placed = H.hierarchy(spark.createDataFrame(rows, SCHEMA), "run", "node", "parent", "kids")
    got = {r.node_id: r for r in placed.collect()}
    assert {v: (r.root_id, r.depth) for v, r in got.items()} == {v: (chain(v)[-1], len(chain(v)) - 1) for v in parent}
    pairs = {(r.ancestor_id, r.descendant_id) for r in H.descendant_pairs(placed, "run", block=16).collect()}
    assert pairs == {(a, v) for v in parent for a in chain(v)[1:]}
    links = placed.selectExpr("run as g", "v", "node_id as node", "p")
    assert {r.v: r.path for r in H.paths(links).collect()} == {v: chain(v)[::-1] for v in parent}


def test_empty_table(spark):
    assert H.hierarchy(spark.createDataFrame([], SCHEMA), "run", "node", "parent", "kids").count() == 0
