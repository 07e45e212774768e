"""Many searches in one pass: candidates of all queries from one scan, then settings tried on what was kept.

The queries are a stated list (cases of an evaluation, a batch of users); the scan keeps
a running best of every query. Everything after it has at most 2 x n rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import vectors
from . import ranking

#: Queries whose texts are scored by one scan (a task holds n hits of each), and rows that are scored at once.
QUERIES_A_SCAN, SLICE = 8192, 4096
#: What a setting says; see settings().
SETTING = "setting string, stage1 int, stage2 int, top int, blend double, rerank boolean, per_file int, k int, anchor double, test double, docs double, prose double, short double"
DEFAULT = {"stage1": config.STAGE1, "stage2": config.STAGE2, "top": config.RERANK_TOP, "blend": config.BLEND, "rerank": False, "per_file": config.PER_FILE, "k": 20, **ranking.FACTORS}


def settings(spark, named: dict[str, dict[str, object]]) -> DataFrame:
    """SETTING rows: each name's values over the defaults. stage2 of 0 or less skips the pooled stage; factors of 0 mean the default."""
    rows = []
    for name, given in named.items():
        if unknown := set(given) - set(DEFAULT):
            raise ValueError(f"no such setting: {sorted(unknown)}")
        at = DEFAULT | given
        at |= {f: config.factor(at[f], d) for f, d in ranking.FACTORS.items()}
        rows.append((name, *[at[c.split()[0]] for c in SETTING.split(", ")[1:]]))
    return spark.createDataFrame(rows, SETTING)


def _asked_counts(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, count) of a batch's asked tokens, by term and row, and the number of tokens of each row; batch(id, tokens)."""
    size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    asked = at >= 0
    key, n = np.unique(at[asked] * len(batch) + np.repeat(np.arange(len(batch)), size)[asked], return_counts=True)
    return key // len(batch), key % len(batch), n, size


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, none of them empty."""
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.slice(i, SLICE)


def bm25(df: DataFrame, id_col: str, text: str, queries: DataFrame, k: int, k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
    """(query_id, id, score): ranking.bm25's best k of every query of queries(query_id, terms).

    Two scans of the text, as there: statistics, a row an asked term, then scores. A task
    scores its rows for all queries and keeps the k best of each, so k rows a query and
    task are shuffled, of PARTS tasks at most. Like documents have like scores to the
    last bit: parts are added in the order of a query's terms. The terms of QUERIES_A_SCAN queries go to the tasks
    at once. Ids are unique; rows without one count but aren't found.
    """
    kind = "string" if df.schema[id_col].dataType.simpleString() == "string" else "bigint"
    query_kind = "string" if queries.schema["query_id"].dataType.simpleString() == "string" else "bigint"
    schema = f"query_id {query_kind}, id {kind}, score double"
    none = df.sparkSession.createDataFrame([], schema)
    rows = df.select(F.col(id_col).cast(kind).alias("id"), ranking.tokens(F.col(text)).alias("_t")).coalesce(vectors.PARTS)
    asked = [(r[0], r[1]) for r in queries.select(F.col("query_id").cast(query_kind), F.array_distinct(F.transform("terms", lambda t: F.lower(t)))).toLocalIterator() if r[1]]
    words = sorted({t for _, ts in asked for t in ts if t is not None})
    if not words:
        return none
    place, every = {t: i for i, t in enumerate(words)}, pa.array(words, pa.string())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, size = np.zeros(len(words), np.int64), 0, 0
        for x in _slices(batches):
            term, _, _, sizes = _asked_counts(x, every)
            n, docs, size = n + np.bincount(term, minlength=len(words)), docs + len(x), size + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(-2, len(words)), pa.int32()), pa.array([docs, size, *n.tolist()], pa.int64())], names=["term", "n"])

    # a row an asked term, and two
    known = {r["term"]: r["n"] for r in rows.mapInArrow(told, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs = known.get(-2, 0)
    avg = known[-1] / docs if docs and known[-1] else 1.0
    idf = [math.log(1 + (docs - known.get(i, 0) + 0.5) / (known.get(i, 0) + 0.5)) for i in range(len(words))]

    def block(some: list[tuple[object, list[str]]]) -> DataFrame:
        mine = sorted({place[t] for _, ts in some for t in ts if t is not None})
        near = {g: i for i, g in enumerate(mine)}
        wanted = [(q, [near[place[t]] for t in ts if t is not None]) for q, ts in some]
        terms, weight = pa.array([words[g] for g in mine], pa.string()), np.array([idf[g] for g in mine])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(wanted)
            for x in _slices(batches):
                x = x.filter(x.column(0).is_valid())
                if not len(x):
                    continue
                ids = x.column(0).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if kind == "string" else ids
                term, row, n, size = _asked_counts(x, terms)
                share = weight[term] * n * (k1 + 1) / (n + k1 * (1 - b + b * size[row] / avg))
                ends = np.searchsorted(term, np.arange(len(mine) + 1))
                for j, (_, at) in enumerate(wanted):
                    score = np.zeros(len(x))
                    for t in at:
                        score[row[ends[t] : ends[t + 1]]] += share[ends[t] : ends[t + 1]]
                    full = best[j] is not None and len(best[j][0]) == k
                    some_ = np.flatnonzero(score >= best[j][1][-1] if full else score > 0)
                    if not len(some_):
                        continue
                    if len(some_) > k:  # ties with the k-th stay
                        s = score[some_]
                        some_ = some_[s >= np.partition(s, len(s) - k)[len(s) - k]]
                    found, s = ids[some_], score[some_]
                    if best[j] is not None:
                        found, s = np.concatenate([best[j][0], found]), np.concatenate([best[j][1], s])
                    first = np.lexsort((found, -s))[:k]
                    best[j] = found[first], s[first]
            for (q, _), got in zip(wanted, best):
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(got[0]), pa.string() if query_kind == "string" else pa.int64()), pa.array(got[0].tolist(), pa.string() if kind == "string" else pa.int64()), pa.array(got[1], pa.float64())], names=["query_id", "id", "score"])

        return rows.mapInArrow(scan, schema)

    out = none
    for i in range(0, len(asked), QUERIES_A_SCAN):
        made = block(asked[i : i + QUERIES_A_SCAN])
        out = made if not i else out.unionByName(made)
    return vectors.best_of(out, ["query_id"], [F.desc("score"), F.asc("id")], k)


def candidates(chunks: DataFrame, queries: DataFrame, n: int, vectors_of: DataFrame | None = None) -> DataFrame:
    """query_id, id, fused, fused_rank: the first STAGE1 candidates of every query, or more if a setting asks (see features)."""
    vec = ranking.ranked(vectors.nearest_many(chunks if vectors_of is None else vectors_of, "id", "vector", queries.select("query_id", "vector"), n), F.asc("distance"), F.asc("id"), by=("query_id",))
    text = ranking.ranked(bm25(chunks, "id", "content", queries, n), F.desc("score"), F.asc("id"), by=("query_id",))
    return ranking.ranked(ranking.fuse(vec, text, by=("query_id",)), F.desc("fused"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), name="fused_rank", by=("query_id",))


def features(chunks: DataFrame, queries: DataFrame, n: int, stage1: int = config.STAGE1, vectors_of: DataFrame | None = None) -> DataFrame:
    """What any setting needs of each candidate: fused score and rank, pooled score, late interaction, and the chunk's structure.

    queries: query_id, terms array<string>, vector array<double>, intent string and, for
    reranking, tokens array<array<double>> (the query's unit token rows). chunks: see
    ranking.search; with token rows `rows` array<array<double>> (dequantised) and `pooled`
    if queries have tokens. vectors_of(id, vector, and rows and pooled): the chunks'
    vectors, each with its id, where they are a table of their own; then the texts are not
    joined to all of them. n: candidates of each retriever. Of a candidate's text its
    beginning is returned, which is what the boosts look at.
    """
    few = candidates(chunks, queries, n, vectors_of).where(F.col("fused_rank") < stage1)
    rows = ["id", "path", "start_line", "end_line", F.substring("content", 1, 50).alias("content"), "chunk_type", "role", "referenced_symbols", "is_anchor", "is_exported"]
    with_tokens = "tokens" in queries.columns
    states = ["rows", "pooled"] if with_tokens else []
    out = chunks.select(*rows, *(states if vectors_of is None else [])).join(few, "id")
    if states and vectors_of is not None:
        out = out.join(vectors_of.select("id", *states), "id", "left")
    # a row a query
    out = out.join(F.broadcast(queries.select("query_id", F.coalesce("intent", F.lit("GENERAL")).alias("intent"), *(["tokens"] if with_tokens else []))), "query_id")
    if not with_tokens:
        return out.withColumns({"pooled_score": F.lit(None).cast("double"), "late": F.lit(0.0)})
    width = F.size(F.get("tokens", F.lit(0)))
    mean = vectors.l2_normalize(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate("tokens", F.lit(0.0), lambda a, r: a + F.get(r, i)) / F.size("tokens")))
    pooled = F.when(F.col("pooled").isNotNull(), vectors.dot(F.col("pooled"), mean))
    late = F.coalesce(vectors.maxsim_native(F.col("tokens"), F.col("rows")), F.lit(0.0))
    return out.withColumns({"pooled_score": pooled, "late": late}).drop("rows", "pooled", "tokens")


BY = ("setting", "query_id")


def hits(found: DataFrame, tried: DataFrame) -> DataFrame:
    """setting, query_id, id, path, start_line, end_line, score, rank: every setting over the candidates' features, in one plan.

    tried: SETTING rows, a stated few. The steps are ranking.search's, by setting and query.
    """
    c = F.col
    x = found.crossJoin(F.broadcast(tried)).where(c("fused_rank") < c("stage1"))
    x = ranking.ranked(x, F.coalesce("pooled_score", F.lit(-1.0)).desc(), F.asc("fused_rank"), name="_two", by=BY)
    x = x.where((c("stage2") <= 0) | (c("_two") < c("stage2"))).withColumn("stage_rank", F.when(c("stage2") > 0, c("_two")).otherwise(c("fused_rank"))).where(c("stage_rank") < c("top"))
    base = F.when(c("rerank"), c("late")).otherwise(ranking.base_score(c("fused"), c("stage_rank")))
    factors = {f: c(f) for f in ranking.FACTORS}
    x = x.withColumn("score", (base + c("blend") * c("fused")) * ranking.boost(c("intent"), factors))
    x = ranking.ranked(x, F.desc("score"), F.asc("stage_rank"), by=BY).select(*BY, "id", "path", "start_line", "end_line", "score", "rank", "per_file", "k")
    x = ranking.ranked(ranking.without_overlaps(x, by=BY), F.asc("rank"), name="_n", by=(*BY, "path")).where(c("_n") < c("per_file"))
    x = ranking.ranked(x.withColumnRenamed("rank", "_r"), F.asc("_r"), by=BY).where(c("rank") < c("k"))
    return x.select(*BY, "id", "path", "start_line", "end_line", "score", "rank")


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, vectors_of: DataFrame | None = None, **setting: object) -> DataFrame:
    """ranking.search for every row of queries (see features): query_id, id, path, start_line, end_line, score, confidence, rank."""
    one = settings(chunks.sparkSession, {"one": setting | {"k": k}})
    out = ranking.calibrate(hits(features(chunks, queries, config.candidates(k), int(setting.get("stage1", config.STAGE1)), vectors_of), one), by=("query_id",))
    return out.select("query_id", "id", "path", "start_line", "end_line", F.col("calibrated").alias("score"), "confidence", "rank")


def contains_any(path: Column, names: Column) -> Column:
    """A path that has any of the names between bars in it, whatever its case."""
    return F.exists(F.split(F.lower(names), r"\|", -1), lambda x: (F.trim(x) != "") & F.contains(F.lower(path), F.trim(x)))


def sweep(found: DataFrame, tried: DataFrame, cases: DataFrame, recall_at: int = 10) -> DataFrame:
    """A row a setting over cases(query_id, expected, avoid): mrr, recall, found, cases, and against the same setting without reranking: drops, lifts, better, worse, unchanged.

    drops: the fused first hit's path is in none of the first three reranked paths.
    lifts: the reranked first hit's path is in none of the first three fused ones, but in
    a later one. better, worse, unchanged: rank of the first expected path, where both
    have one. A setting without reranking has no such diagnostics, only zeros.
    """
    from . import evaluate

    plain = tried.where("rerank").withColumns({"setting": F.concat(F.lit("\0"), "setting"), "rerank": F.lit(False)})
    made = hits(found, tried.unionByName(plain))
    each = cases.select("query_id", "expected", "avoid").crossJoin(F.broadcast(tried.select("setting")))
    key = F.concat_ws("\0", "setting", F.col("query_id").cast("string")).alias("case_id")
    mine = made.where(~F.col("setting").startswith("\0"))
    judged = evaluate.cases(mine.select(key, "path", "rank"), each.select(key, "expected", "avoid"), recall_at)
    judged = judged.withColumn("setting", F.substring_index("case_id", "\0", 1))
    scores = judged.groupBy("setting").agg(F.avg("rr").alias("mrr"), F.avg(F.col("recalled").cast("double")).alias("recall"), F.count_if("found").alias("found"), F.count(F.lit(1)).alias("cases"))
    # at most k hits a setting and case
    lists = made.join(cases.select("query_id", "expected"), "query_id").groupBy("setting", "query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.lower("path").alias("p")))), lambda s: s["p"]).alias("paths"),
        F.min(F.when(contains_any(F.col("path"), F.col("expected")), F.col("rank"))).alias("target"),
    )
    fused = lists.where(F.col("setting").startswith("\0")).select(F.substring("setting", 2, 1 << 20).alias("setting"), "query_id", F.col("paths").alias("before"), F.col("target").alias("was"))
    both = lists.join(fused, ["setting", "query_id"])
    holds = lambda some, x: F.exists(some, lambda p: F.contains(p, x))
    top, best = F.get("before", F.lit(0)), F.get("paths", F.lit(0))
    told = both.groupBy("setting").agg(
        F.count_if((top != "") & ~holds(F.slice("paths", 1, 3), top)).alias("drops"), F.count_if((best != "") & ~holds(F.slice("before", 1, 3), best) & holds("before", best)).alias("lifts"),
        F.count_if(F.col("target") < F.col("was")).alias("better"), F.count_if(F.col("target") > F.col("was")).alias("worse"), F.count_if(F.col("target") == F.col("was")).alias("unchanged"),
    )
    out = scores.join(told, "setting", "left")
    return out.select("setting", "mrr", "recall", "found", "cases", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("drops", "lifts", "better", "worse", "unchanged")])
