"""What only odd or large tables show: signs of zero, amounts that are shuffled, batches."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlode.operators import fulltext, index, many, ranking
from emberlode.plans import ORACLE_SQL, QUERIES
from emberlode.sources import providers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, column", [("l2_normalize", "unit"), ("pooled_vector", "pooled"), ("cosine", "cosine")])
def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path, name, column):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((6, 64))
    v[1, 5] = -1e-7
    v[2, [3, 19, 35, 51]] = 1e-7, -1e-7, -1e-7, -1e-7
    v[3] = v[0] * -1e-9 + np.roll(np.eye(1, 64)[0], 1) * v[0, 0] - np.eye(1, 64)[0] * v[0, 1]
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {r["vec_id"]: np.atleast_1d(r[column]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    zeros = 0
    for i, want in con.sql(f"SELECT vec_id, {column} FROM ({ORACLE_SQL[name]})").fetchall():
        want = np.atleast_1d(want)
        assert got[i].tolist() == want.tolist() and np.signbit(got[i]).tolist() == np.signbit(want).tolist()
        zeros += ((want == 0) & np.signbit(want)).sum()
    assert zeros


def test_texts_are_not_shuffled_to_find_candidates(spark):
    """With a join that can't be broadcast, only ids and vectors move; the texts stay where they are read."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("hybrid_search_rerank_off", "calibrate", "min_score"):
            df = QUERIES[name](spark, SF)
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "LeftOuter" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bm25_of_many_brings_k_rows_a_task(spark, monkeypatch):
    """What leaves the scan is k rows a query and task, however many documents have the terms; ties with the k-th go by id."""
    monkeypatch.setattr(many, "SLICE", 7)
    docs = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit("The common "), F.repeat(F.lit("word "), (F.col("id") % 3).cast("int")), F.lit("zz")).alias("content"))
    queries = spark.createDataFrame([(i, ["COMMON", "word", "common", "none"]) for i in range(5)] + [(8, []), (9, ["absent"])], "query_id long, terms array<string>")
    out = many.bm25(docs, "id", "content", queries, 6)
    want = [(r["id"], round(r["score"], 12)) for r in ranking.bm25(docs, "id", "content", ["common", "word", "none"], 6).collect()]
    got = out.collect()
    assert {r["query_id"] for r in got} == set(range(5))
    for i in range(5):
        assert [(r["id"], round(r["score"], 12)) for r in sorted(got, key=lambda r: (-r["score"], r["id"])) if r["query_id"] == i] == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan
    named = many.bm25(docs.select(F.concat(F.lit("k"), "id").alias("id"), "content"), "id", "content", queries.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "terms"), 2).collect()
    assert len(named) == 10 and {r["query_id"] for r in named} == {f"q{i}" for i in range(5)}


def test_token_matrices_are_made_a_few_at_a_time(spark):
    """However large Arrow's batches are, a worker holds the matrices of MATRICES texts; null and empty texts and the order of rows stay."""
    class Counting(providers.HashedStates):
        def tokenise(self, texts):
            assert len(texts) <= 256
            return super().tokenise(texts)

    df = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("w"), F.col("id"))).alias("t"))
    got = providers.token_columns(df, "t", lambda: Counting(8)).collect()
    assert [r["id"] for r in got] == list(range(1000)) and {len(r["doc_token_ids"]) for r in got} == {3, 4}


def test_blocks_are_packed_where_they_are_read(spark, monkeypatch):
    """No posting is shuffled by itself; rows of a range that come in several batches add up, and bounds still hold."""
    monkeypatch.setattr(fulltext, "SLICE", 5)
    docs = spark.range(0, 90, 1, 3).select(F.lit("s").alias("segment"), "id", ((F.col("id") * 37) % 90).alias("doc"), F.concat_ws(" ", F.array_repeat(F.lit("Aa"), (F.col("id") % 4).cast("int")), F.when(F.col("id") % 5 != 0, F.lit("b-c")), F.lit(None).cast("string")).alias("content"))
    made = fulltext.blocks(docs, bits=4)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    got = sorted((t, d, f, n) for r in made.collect() for t, d, f, n in zip([r["term"]] * r["n"], r["docs"], r["tfs"], r["lens"]))
    want = sorted((t, r["doc"], ws.count(t), len(ws)) for r in docs.collect() for ws in [r["content"].lower().replace("-", " ").split()] for t in set(ws))
    assert got == want
    for r in made.collect():
        assert {d >> 4 for d in r["docs"]} == {r["block"]} and r["docs"] == sorted(r["docs"]) and r["max_tf"] == max(r["tfs"]) and r["min_len"] == min(r["lens"])
    hits, counts = fulltext.top_k(made, ["aa", "c"], 5, 90, sum(n for _, _, _, n in {(None, d, None, n) for _, d, _, n in got}), first=1)
    best = [(r["id"], round(r["score"], 12)) for r in ranking.bm25(docs.drop("id").withColumnRenamed("doc", "id"), "id", "content", ["aa", "c"], 5).collect()]
    assert [(r["doc"], round(r["score"], 12)) for r in hits.orderBy(F.desc("score"), "doc").limit(5).collect()] == best and counts["read"] <= counts["ranges"]


def test_an_index_stores_a_text_once(spark, tmp_path, monkeypatch):
    """Display text and neighbours are made when they are asked for, in a segment that was rewritten as well; lengths are stored once a document, and searches equal the scan."""
    monkeypatch.setattr(index, "TASK_BYTES", 5000)
    monkeypatch.setattr(index, "FOLDER_BYTES", 15000)
    files = spark.range(0, 30, 1, 2).select(F.concat(F.lit("d/"), "id", F.lit(".md")).alias("path"), F.repeat(F.concat(F.lit("common word"), F.col("id") % 7, F.lit("\n")), (F.col("id") * 20).cast("int")).alias("content"))
    source = lambda rows: rows.select("path", "content", F.sha2("content", 256).alias("hash"), F.length("content").cast("double").alias("mtime_ms"), F.octet_length("content").cast("long").alias("size"))
    root = str(tmp_path / "i")
    index.build(spark, root, source(files))
    index.build(spark, root, source(files.withColumn("content", F.when(F.col("path").contains("1"), F.concat("content", F.lit("rare more"))).otherwise(F.col("content")))))
    now = index.open_index(spark, root)
    assert len(now.version["segments"]) == 2 and {s["gone"] for s in now.version["segments"]} == {0}
    for s in now.version["segments"]:
        stored = spark.read.parquet(now.store.at(f"{s['name']}/chunks")).columns
        assert not {"display_text", "context_prev", "context_next"} & set(stored) and "lens" not in spark.read.parquet(now.store.at(f"{s['name']}/postings")).columns
    rows = sorted((r for r in now.chunks().collect()), key=lambda r: (r["path"], r["chunk_index"]))
    assert len({r["path"] for r in rows}) == 30 and len(rows) > 150
    for before, r, after in zip([None, *rows], rows, [*rows[1:], None]):
        beside = lambda x, r=r: x["content"] if x and x["path"] == r["path"] else ""
        assert (r["display_text"], r["context_prev"], r["context_next"]) == (r["content"], beside(before), beside(after))
    by, some = {r["id"]: r for r in rows}, now.stored().where("chunk_index = 1 and path like '%2.md'").select("segment", "doc")
    got = now.fetch(some).collect()
    assert len(got) == some.count() > 1 and all(r[c] == by[r["id"]][c] for r in got for c in index.COLUMNS)
    hits, _ = now.text_hits(["rare", "word3"], 40, first=1)
    have = [(r["id"], round(r["score"], 9)) for r in hits.join(now.stored().select("segment", "doc", "id"), ["segment", "doc"]).orderBy(F.desc("score"), "id").limit(40).collect()]
    assert have == [(r["id"], round(r["score"], 9)) for r in ranking.bm25(now.stored(), "id", "content", ["rare", "word3"], 40).collect()]


def test_postings_are_shuffled_in_bundles(spark, tmp_path, monkeypatch):
    """A task sends one row a folder's file for BUNDLE bytes of postings, and all postings come back."""
    docs = spark.range(0, 3000, 1, 2).select(F.lit("s").alias("segment"), F.col("id").alias("doc"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("x"), "id")).alias("content"))
    rows = fulltext.blocks(docs).withColumn("file", fulltext.term_bucket(F.col("term"), 3))
    made = fulltext.bundled(rows, "file")
    assert made.count() == 6 and rows.count() > 3000
    key = lambda r: (r["term"], r["docs"][0])
    assert sorted(fulltext.unbundled(made, rows).collect(), key=key) == sorted(rows.collect(), key=key)
    monkeypatch.setattr(fulltext, "BUNDLE", 1)
    assert sorted(fulltext.unbundled(fulltext.bundled(rows, "file"), rows).collect(), key=key) == sorted(rows.collect(), key=key)
    fulltext.write(fulltext.blocks(docs), str(tmp_path / "p"), 8, 2)
    held = spark.read.parquet(str(tmp_path / "p"))
    sizes = [r["count"] for r in held.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8 and sum(sizes) == rows.count()
