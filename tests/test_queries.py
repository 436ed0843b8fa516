import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from folioweave.plans.oracle import ORACLE
from folioweave.plans.queries import QUERIES

def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small_data, name):
    con = duckdb.connect()
    for f in Path(small_data).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    df = QUERIES[name](spark, small_data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
