"""The registered queries agree with their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from emberlode.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "customer")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is pd.NA or v is None:
        return None
    if isinstance(v, float):
        return None if v != v else int(v) if v.is_integer() else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[cols].itertuples(index=False)), key=repr)
    assert rows(got.toPandas()) == rows(want)


def test_token_matrices(spark):
    """The one query without SQL, against numpy."""
    import hashlib

    import numpy as np

    from emberlode.sources import providers

    model = providers.HashedStates(16)
    got = {r["doc_id"]: (r["n_tokens"], r["matrix_sha256"]) for r in QUERIES["token_matrices"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert set(QUERIES) - set(ORACLE_SQL) == {"token_matrices"} and len(got) == len(rows)
    for r in rows[:20]:
        ids = providers.token_ids(model.tokenise([r["text"] or ""])[0], False, 0, 2, 3, 4)
        m = model.states(np.array([ids]), np.ones((1, len(ids)), np.int8))[0]
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        q = np.clip(np.floor(m / np.float32(np.abs(m).max()) * 127 + 0.5), -127, 127).astype(np.int8)
        assert got[r["doc_id"]][0] == len(ids)
        assert got[r["doc_id"]][1] == hashlib.sha256(q.tobytes()).hexdigest() or len(ids) == 512


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
