import re

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
GROUPS = {"a": 19, "b": 31, "c": 20, "d": 22, "e": 3, "f": 26, "g": 3}


def test_every_operator_has_a_query():
    numbers = {m.group(1) for name in entry.queries() if (m := re.match(r"([a-g]\d+)_", name))}
    assert numbers == {f"{g}{i}" for g, n in GROUPS.items() for i in range(1, n + 1)}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a9_free_headers", "b17_invalid_citations", "c14_hybrid_search", "d12_graph_boost", "e3_full_audit", "f10_relaxed_keywords"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in check_oracle.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert check_oracle.rows(df.columns, [tuple(r) for r in df.collect()]) == check_oracle.rows(names, rel.fetchall())


def test_entry(spark):
    hits = entry.entry(spark)
    assert hits.columns == ["query_id", "doc_key", "rank", "snippet_chars", "snippet_md5"]
    ranks = hits.groupBy("query_id").agg({"rank": "max", "doc_key": "count"}).collect()
    assert ranks and all(r[1] == r[2] <= 8 for r in ranks)
