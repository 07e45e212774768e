"""Fusion, cascade, boosts, diversity and calibration against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from emberlode import config
from emberlode.functions import vectors
from emberlode.operators import ranking


def test_intent_order_and_substrings(spark):
    qs = ["Where is X", "undefined thing", "how does it run", "usage of y", "system overview", "plain"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert [r[0] for r in df.select(ranking.intent(F.col("q"))).collect()] == ["DEFINITION", "DEFINITION", "FLOW", "USAGE", "ARCHITECTURE", "GENERAL"]


def test_fusion_order(spark):
    rng = random.Random(1)
    v, t = rng.sample(range(12), 8), rng.sample(range(12), 5)
    score = {}
    for ids in (v, t):
        for r, i in enumerate(ids):
            score[i] = score.get(i, 0) + 1 / (60 + r + 1)
    want = sorted(score, key=lambda i: -score[i])
    df = lambda ids: spark.createDataFrame([(i, r) for r, i in enumerate(ids)], "id int, rank int")
    assert [r["id"] for r in ranking.fuse(df(v), df(t)).collect()] == want


def greedy(hits, cap, k):
    seen, kept, out, per = set(), {}, [], {}
    for i, path, s, e in hits:
        if i in seen:
            continue
        seen.add(i)
        if any(max(0, min(e, y) - max(s, x)) > 0.5 * min(e - s, y - x) for x, y in kept.get(path, [])):
            continue
        kept.setdefault(path, []).append((s, e))
        if per.get(path, 0) < cap:
            per[path] = per.get(path, 0) + 1
            out.append(i)
    return out[:k]


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_and_cap_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    hits = [(rng.randrange(25), f"p{rng.randrange(3)}", s := rng.randrange(40), s + rng.randrange(12)) for _ in range(30)]
    where = {}
    hits = [(i, *where.setdefault(i, (p, s, e))) for i, p, s, e in hits]
    df = spark.createDataFrame([(*h, r) for r, h in enumerate(hits)], "id int, path string, start_line int, end_line int, rank int")
    got = [r["id"] for r in ranking.per_file(ranking.without_overlaps(df), 2, 10).orderBy("rank").collect()]
    assert got == greedy(hits, 2, 10)


def test_boost_by_hand(spark):
    rows = [
        ("a.ts", "function", "ORCHESTRATION", ["r"] * 16, False, False, "x" * 60, 1.1 * 1.5 * 1.1 * 1.25 * 1.4),
        ("a.ts", "function", "ORCHESTRATION", ["r"] * 16, True, False, "x" * 60, 0.99),
        ("docs/a.md", "block", "DOCS", [], False, False, "x" * 60, 0.6 * 0.6),
        ("src/tests/a.ts", "block", None, [], False, False, "x", 0.5 * 0.9),
        ("src/a.spec.tsx", "class", "DEFINITION", [], False, True, "x", 1.1 * 1.2 * 0.5),
        ("x/docs/y.ts", None, None, None, None, None, "x" * 60, 0.6),
    ]
    df = spark.createDataFrame(rows, "path string, chunk_type string, role string, referenced_symbols array<string>, is_anchor boolean, is_exported boolean, content string, want double")
    for r in df.withColumn("got", ranking.boost("FLOW")).collect():
        assert r["got"] == pytest.approx(r["want"]), r


def test_cascade_limits_and_missing_pooled(spark):
    df = spark.range(300).select("id", F.col("id").cast("int").alias("fused_rank"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("pooled_score"))
    got = [r["id"] for r in ranking.cascade(df).orderBy("stage_rank").collect()]
    assert len(got) == config.RERANK_TOP and got[0] == 198 and got[1] == 196


def test_calibration_and_min_score(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.2), (4, None)], "id int, score double")
    got = {r["id"]: r["confidence"] for r in ranking.calibrate(df.where("score is not null")).collect()}
    assert got == {1: "High", 2: "Medium", 3: "Low"}
    assert sorted(r["id"] for r in ranking.at_least(df, F.col("score"), 0.6).collect()) == [1, 4]


def test_zero_means_default():
    assert [config.factor(x, 0.5) for x in ("0", None, "x", "0.7", 0)] == [0.5, 0.5, 0.5, 0.7, 0.5]


def test_vectors_by_hand(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "id long, v array<double>")
    n = [r[0] for r in df.where("id < 3").select(vectors.l2_normalize(F.col("v"))).collect()]
    assert n[0] == pytest.approx([0.6, 0.8, 0.0]) and n[1] == [0.0, 0.0, 0.0]
    near = vectors.nearest(df, "id", "v", [3.0, 4.0, 0.0], 5).collect()
    assert [r["id"] for r in near] == [1, 2] and near[1]["distance"] == pytest.approx(5.0)


def test_maxsim_native_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    q, m = rng.standard_normal((3, 8)), rng.integers(-127, 128, (5, 8)).astype(np.int8)
    df = spark.createDataFrame([(1, bytearray(m.tobytes()), 0.5, [0, 1, 2, 3, 4]), (2, None, None, None)], "id int, t binary, s double, ids array<int>")
    got = {r["id"]: r["maxsim"] for r in vectors.maxsim(df, q, "t", "s", 8).collect()}
    want = float((q @ (m * 0.5 / 127).T).max(1).sum())
    assert got[1] == pytest.approx(want, rel=1e-5) and got[2] == 0
    nat = spark.createDataFrame([(q.tolist(), (m * 0.5 / 127).tolist())], "q array<array<double>>, m array<array<double>>")
    assert nat.select(vectors.maxsim_native(F.col("q"), F.col("m"))).first()[0] == pytest.approx(want)
    skip = {r["id"]: r["maxsim"] for r in vectors.maxsim(df, q, "t", "s", 8, token_ids="ids", skip=frozenset(range(5))).collect()}
    assert skip[1] == 0


def test_int8_rounds_halves_up(spark):
    df = spark.createDataFrame([([[127.0, 0.5, -0.5, -1.5]],), ([[0.0]],)], "r array<array<double>>")
    rows, scale = vectors.quantize_int8(F.col("r"))
    assert [tuple(x) for x in df.select(rows, scale).collect()] == [([[127, 1, 0, -1]], 127.0), ([[0]], 1.0)]


def test_streamed_overlaps_equal_the_fold(spark):
    rng = random.Random(7)
    rows = [(f"h{rng.randrange(900)}", rng.choice(["a", "b", "c", None]), i, s := rng.randrange(60), s + rng.choice([0, 0, 1, 5, 9, 30])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, path string, rank int, start_line int, end_line int").repartition(3)
    want = sorted(map(tuple, ranking.without_overlaps(df).collect()), key=str)
    assert sorted(map(tuple, ranking.without_overlaps_streamed(df).collect()), key=str) == want and 0 < len(want) < 900
    assert ranking.without_overlaps_streamed(df.limit(0)).count() == 0
