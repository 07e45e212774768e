"""Many searches in one pass, sweeps of settings, and neighbours by cells, against the single forms and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlode.functions import pivots, vectors
from emberlode.operators import evaluate, many, ranking
from emberlode.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * 10
    v = np.concatenate([c + rng.standard_normal((150, 8)) for c in centres])
    v[5] = v[3]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    return v, spark.createDataFrame([*rows, (None, v[0].tolist()), (5000, None)], "id long, v array<double>").repartition(6).cache()


def brute(v, q, k):
    d = np.sqrt(((v - q) ** 2).sum(1))
    return [(int(i), round(float(d[i]), 9)) for i in np.lexsort((np.arange(len(v)), d))[:k]]


def test_nearest_many_equals_one_by_one(spark, cloud, monkeypatch):
    v, df = cloud
    queries = spark.createDataFrame([(f"q{i}", v[i * 97].tolist()) for i in range(9)] + [("none", None)], "query_id string, vector array<double>")
    for block in (1024, 4):
        monkeypatch.setattr(vectors, "QUERIES_A_SCAN", block)
        got = vectors.nearest_many(df, "id", "v", queries, 7).orderBy("query_id", "distance", "id").collect()
        assert len(got) == 63
        for i in range(9):
            assert [(r["id"], round(r["distance"], 9)) for r in got if r["query_id"] == f"q{i}"] == brute(v, v[i * 97], 7)
    assert vectors.nearest_many(df, "id", "v", queries.where("vector is null"), 3).count() == 0 and vectors.nearest_many(df.limit(0), "id", "v", queries, 3).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.nearest_many(df, "id", "v", spark.createDataFrame([("a", [1.0])], "query_id string, vector array<double>"), 3).collect()
    text = df.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), "v")
    assert {r["id"] for r in vectors.nearest_many(text, "id", "v", queries.limit(1), 2).collect()} == {f"k{i}" for i, _ in brute(v, v[0], 2)}


def test_cells_are_skipped_and_results_are_exact(spark, cloud):
    v, df = cloud
    around = pivots.pick(df, "id", "v", 24)
    rows = pivots.celled(df, "v", around).cache()
    known = pivots.cells(rows)
    for q in (v[10], v[700] + 0.1, np.zeros(8), np.full(8, 1e4)):
        got, counts = pivots.nearest(rows, known, around, "id", "v", q.tolist(), 10)
        assert [(r["id"], round(r["distance"], 9)) for r in got.collect()] == brute(v, q, 10)
        assert counts["rows"] == len(v) + 1  # the row without an id has a cell as well
    assert pivots.nearest(rows, known, around, "id", "v", v[10].tolist(), 10)[1]["read"] < 0.5 * len(v)
    got, counts = pivots.nearest(rows, known, around, "id", "v", v[0].tolist(), 5000)  # more than there are
    assert got.count() == len(v) and counts["read"] == counts["rows"]
    assert pivots.pick(df.limit(0), "id", "v", 4).shape == (0, 0)
    with pytest.raises(Exception, match="dimensions"):
        pivots.celled(df, "v", np.zeros((2, 3))).collect()


def test_many_searches_equal_single_ones(spark):
    chunks = fx.with_vectors(spark, SF).cache()
    v = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id in (3, 50, 120)").collect()}
    asked = [(3, ["The", "and", "the"], v[3], "FLOW"), (50, ["zzz"], v[50], "DEFINITION"), (120, ["with"], v[120], "GENERAL")]
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>, vector array<double>, intent string")
    got = many.search(chunks, queries, 8).collect()
    for i, terms, vec, intent in asked:
        # the definition filter is the caller's here, so the single search runs without it
        features = many.features(chunks, queries.where(F.col("query_id") == i), 500)
        text = ranking.bm25(chunks, "id", "content", terms, 500)
        both = many.bm25(chunks, "id", "content", queries.where(F.col("query_id") == i), 500)
        assert [(r["id"], round(r["score"], 9)) for r in both.orderBy(F.desc("score"), "id").collect()] == [(r["id"], round(r["score"], 9)) for r in text.collect()]
        if intent != "DEFINITION":
            want = [(r["id"], round(r["score"], 9), r["confidence"], r["rank"]) for r in ranking.search(chunks, terms, vec, 8, intent).collect()]
            assert sorted(((r["id"], round(r["score"], 9), r["confidence"], r["rank"]) for r in got if r["query_id"] == i), key=lambda x: x[-1]) == want
        assert features.count() <= 200
    with pytest.raises(ValueError):
        many.settings(spark, {"x": {"nothing": 1}})
    assert many.settings(spark, {"x": {"test": 0}}).first()["test"] == 0.5


def test_sweep_counts(spark, monkeypatch):
    """Made-up hits: what is dropped, lifted, better and worse."""
    rows = []

    def add(setting, q, *paths):
        rows.extend((setting, q, f"{setting}{q}{i}", p, 0, 9, 1.0, i) for i, p in enumerate(paths))

    add("a", 1, "X/new.ts", "b.ts", "c.ts", "old.ts"), add("\0a", 1, "old.ts", "b.ts", "c.ts", "x/new.ts")
    add("a", 2, "t.ts", "u.ts"), add("\0a", 2, "u.ts", "t.ts")
    add("a", 3, "v.ts"), add("\0a", 3, "v.ts")
    add("b", 1, "old.ts")
    made = spark.createDataFrame(rows, "setting string, query_id int, id string, path string, start_line int, end_line int, score double, rank int")
    monkeypatch.setattr(many, "hits", lambda found, tried: made)
    cases = spark.createDataFrame([(1, "x/NEW", None), (2, "u.ts|zz", None), (3, "v.ts", "v"), (4, "none", None)], "query_id int, expected string, avoid string")
    got = {r["setting"]: r.asDict() for r in many.sweep(None, many.settings(spark, {"a": {"rerank": True}, "b": {}}), cases).collect()}
    assert got["a"] == {"setting": "a", "mrr": (1 + 0.5) / 4, "recall": 0.5, "found": 2, "cases": 4, "drops": 1, "lifts": 1, "better": 1, "worse": 1, "unchanged": 1}
    assert got["b"] == {"setting": "b", "mrr": 0.0, "recall": 0.0, "found": 0, "cases": 4, "drops": 0, "lifts": 0, "better": 0, "worse": 0, "unchanged": 0}


def test_evaluation_runs_through_the_search(spark):
    chunks = fx.with_vectors(spark, SF).cache()
    some = fx.files(spark, SF).where("doc_id in (0, 7, 100)").join(spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    rows = some.select(F.col("doc_id").alias("query_id"), F.slice(ranking.tokens(F.col("content")), 1, 4).alias("terms"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("GENERAL").alias("intent"), "path").collect()
    queries = spark.createDataFrame(rows).drop("path")
    cases = spark.createDataFrame([(r["query_id"], r["path"], None) for r in rows], "case_id long, expected string, avoid string")
    at_once = evaluate.cases(many.search(chunks, queries, 20).select(F.col("query_id").alias("case_id"), "path", "rank"), cases)
    each = {}
    for r in rows:
        hits = ranking.search(chunks, r["terms"], r["vector"], 20).collect()
        each[r["query_id"]] = next((h["rank"] for h in hits if r["path"].lower() in h["path"].lower()), None)
    assert {r["case_id"]: r["rank"] for r in at_once.collect()} == each
    assert evaluate.summary(at_once).first()["mrr"] == pytest.approx(sum(1 / (x + 1) for x in each.values() if x is not None) / len(each))
