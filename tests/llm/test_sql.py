"""The queries of the training-data operators that have SQL, against it on the smallest tables."""

import os

import duckdb
import pytest

from axonlake.llm import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op11_codes", "op12_trie"}))  # these two are in test_codes_trie_packing
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
