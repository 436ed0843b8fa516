import random

from folioweave.operators.intervals import periods_and_gaps

SCHEMA = "entity string, s int, e int, kind string"


def brute(rows):
    out = set()
    for entity in {r[0] for r in rows}:
        pages = sorted({p for r in rows if r[0] == entity and r[1] is not None and r[2] is not None and r[2] >= r[1] for p in range(r[1], r[2] + 1)})
        runs = []
        for p in pages:
            if runs and p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out |= {(entity, "period", a, b) for a, b in runs}
        out |= {(entity, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    return out


def test_against_brute_force_in_small_blocks(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-30, 60), None, "x") for _ in range(60)]
    rows = [(e, s, s + rng.randint(-3, 9), k) for e, s, _, k in rows] + [("a", None, 3, "x"), ("b", 2, None, "x"), ("only", 5, 4, "x")]
    rows += rows[:10]
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["entity"], "s", "e", block=8).collect()
    assert {(r.entity, r.kind, r.start_pos, r.end_pos) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_touching_ranges_and_empty_table(spark):
    got = periods_and_gaps(spark.createDataFrame([("a", 1, 3, ""), ("a", 4, 5, ""), ("a", 9, 9, "")], SCHEMA), ["entity"], "s", "e").collect()
    assert {(r.kind, r.start_pos, r.end_pos) for r in got} == {("period", 1, 5), ("gap", 6, 8), ("period", 9, 9)}
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), ["entity"], "s", "e").count() == 0
