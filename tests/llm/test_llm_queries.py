from pathlib import Path

import duckdb
import pytest

from folioweave.llm.oracle import ORACLE
from folioweave.llm.queries import QUERIES
from tests.test_queries import plain


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
    assert want and sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_containers_are_full_and_hold_every_document(spark, small_data):
    rows = QUERIES["p9_bins"](spark, small_data).collect()
    used = {}
    for r in rows:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.n_tokens
    assert all(used[r.bin_id] == r.bin_used <= r.bin_capacity <= 2048 for r in rows)
    assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{small_data}/documents.parquet").count()
    assert len(used) <= -(-sum(used.values()) // 2048) + 1


def test_pieces_are_whole_where_a_text_begins_with_a_short_sentence(spark, tmp_path):
    code = "\n\n```\n" + "x = y\n" * 40 + "```\n\n"
    texts = ["short first." + code + "the end", "no code. " + "word " * 90, "within the limit"]
    spark.createDataFrame([("r", f"n{i}", "tree", t) for i, t in enumerate(texts)], "run_id string, node_id string, export_mode string, content_markdown string").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("tree", 30, 10)], "export_mode string, max_words int, overlap_words int").write.parquet(f"{tmp_path}/split_limits.parquet")
    con = duckdb.connect()
    for t in ("segments", "split_limits"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["p1_coverage"]).fetchall())
    assert want == [("r", "n0", 126, True, True, True), ("r", "n1", 92, True, True, True)]
    assert sorted(tuple(r) for r in QUERIES["p1_coverage"](spark, str(tmp_path)).collect()) == want
