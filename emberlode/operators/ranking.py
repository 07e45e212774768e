"""Retrieval and ranking: full text, fusion, cascade, boosts, diversity, calibration.

Only candidate generation reads the whole table; what follows works on a few
hundred rows at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import paths

#: The intents, in order; the first pattern found anywhere in the lower-cased query decides.
INTENTS = (("DEFINITION", "where is|what is|define"), ("FLOW", "how does|how is|implementation"), ("USAGE", "example|how to use|usage"), ("ARCHITECTURE", "architecture|system|overview"))
#: Folders and names of tests, two patterns side by side.
TEST_PATH = r"(?i)(^|/)(__tests__|tests?|specs?|benchmark)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$"
DEFINED_TYPES = ("function", "class", "method", "interface", "type_alias")


def intent(query: Column) -> Column:
    out = F
    for name, pattern in INTENTS:
        out = out.when(F.lower(query).rlike(pattern), name)
    return out.otherwise("GENERAL")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+", -1), lambda t: t != "")


def defines(symbol: str) -> Column:
    return F.array_contains("defined_symbols", symbol)


def is_definition() -> Column:
    return (F.coalesce(F.col("role"), F.lit("")) == "DEFINITION") | (F.coalesce(F.size("defined_symbols"), F.lit(0)) > 0)


def references(symbol: str) -> Column:
    return F.array_contains("referenced_symbols", symbol)


def postings(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """A full-text index: (term, id, tf) and (id, len)."""
    t = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("t"))
    return t.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")), t.select("id", F.size("t").alias("len"))


def summed(at: Column, part: Column) -> Column:
    """Sum of a document's few parts in the order of its terms: like documents then have like scores to the last bit."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(at.alias("at"), part.alias("x")))), F.lit(0.0), lambda a, p: a + p["x"])


def bm25(df: DataFrame, id_col: str, text: str, terms: list[str], k: int | None = None, k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
    """(id, score) of the rows with any of the terms, by score then id; k limits it.

    Two scans of the text and no shuffle of postings: corpus statistics first (one
    row), then scores and a top-k.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    base = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("_t"))
    count = lambda t: F.size(F.filter("_t", lambda x: x == t))
    base = base.select("id", F.size("_t").alias("_len"), *[count(t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    s = base.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    avg = s["avg"] or 1.0
    parts = []
    for i in range(len(terms)):
        idf, tf = math.log(1 + (s["n"] - s[f"d{i}"] + 0.5) / (s[f"d{i}"] + 0.5)), F.col(f"_tf{i}")
        parts.append(F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / avg)))
    hits = base.where(reduce(lambda x, y: x | y, [F.col(f"_tf{i}") > 0 for i in range(len(terms))], F.lit(False)))
    out = hits.select("id", reduce(lambda x, y: x + y, parts, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(k) if k else out


def ranked(df: DataFrame, *order: Column, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 0 for a small candidate list (it is gathered in one task), or one for each value of by."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)) - 1)


def fuse(vector: DataFrame, text: DataFrame, k: int = config.RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two (id, rank) lists of candidates: id, fused, vec_rank, fts_rank; for each value of by.

    Ordered by falling score; ties by the order in which a reader of the first list and
    then the second meets them.
    """
    j = vector.select(*by, "id", F.col("rank").alias("vec_rank")).join(text.select(*by, "id", F.col("rank").alias("fts_rank")), [*by, "id"], "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    j = j.withColumn("fused", term("vec_rank") + term("fts_rank"))
    return j if by else j.orderBy(F.desc("fused"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"))


def cascade(df: DataFrame, stage1: int = config.STAGE1, stage2: int = config.STAGE2, top: int = config.RERANK_TOP) -> DataFrame:
    """df(fused_rank, pooled_score nullable): the first stage1 by fusion, of these stage2 by pooled score, then top."""
    one = df.where(F.col("fused_rank") < stage1)
    if stage2 > 0:
        one = ranked(one, F.coalesce("pooled_score", F.lit(-1.0)).desc(), F.asc("fused_rank"), name="stage_rank").where(F.col("stage_rank") < stage2)
    else:
        one = one.withColumn("stage_rank", F.col("fused_rank"))
    return one.where(F.col("stage_rank") < top)


def base_score(fused: Column, rank: Column) -> Column:
    """Without a reranker: the fused score, or 1 / (rank + 1) where it is 0."""
    return F.when(fused == 0, F.lit(1.0) / (rank + 1)).otherwise(fused)


def blend(base: Column, fused: Column, weight: float = config.BLEND) -> Column:
    return base + F.lit(weight) * fused


#: Factors that can be set; missing, unreadable and 0 mean these.
FACTORS = {"anchor": 0.99, "test": 0.5, "docs": 0.6, "prose": 0.6, "short": 0.9}


def boost(intent_name: str | Column = "GENERAL", factors: dict[str, str | float | Column | None] | None = None) -> Column:
    """Factor by structure: kind, role, references, intent, then docs, tests, prose files and tiny chunks. Intent and factors may be columns."""
    given = factors or {}
    f = {k: given[k] if isinstance(given.get(k), Column) else config.factor(given.get(k), v) for k, v in FACTORS.items()}
    c, one = F.col, F.lit(1.0)
    if_ = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), F.lit(x)).otherwise(one)
    kind = F.coalesce(c("chunk_type"), F.lit("")).isin(*DEFINED_TYPES)
    role = F.coalesce(c("role"), F.lit(""))
    refs = F.coalesce(F.size("referenced_symbols"), F.lit(0))
    wanted = {"DEFINITION": ("DEFINITION", 1.2), "FLOW": ("ORCHESTRATION", 1.4), "USAGE": ("IMPLEMENTATION", 1.2)}
    asked = reduce(lambda x, y: x * y, [if_((intent_name == i) & (role == r), x) for i, (r, x) in wanted.items()]) if isinstance(intent_name, Column) else if_(role == wanted[intent_name][0], wanted[intent_name][1]) if intent_name in wanted else one
    body = if_(kind, 1.1) * F.when(kind, F.when(role == "ORCHESTRATION", 1.5).when(role == "DEFINITION", 1.2).when(role == "IMPLEMENTATION", 1.1).otherwise(1.0)).otherwise(1.0)
    body = body * if_(refs > 5, 1.1) * if_(refs > 15, 1.25) * asked
    p = F.lower(F.coalesce(c("path"), F.lit("")))
    prose = p.rlike(r"\.(md|mdx|txt|json|lock)$") | p.contains("/docs/")
    every = if_(role == "DOCS", f["docs"]) * if_(p.rlike(TEST_PATH), f["test"]) * if_(prose, f["prose"]) * if_((F.length("content") < 50) & ~F.coalesce(c("is_exported"), F.lit(False)), f["short"])
    return F.when(F.coalesce(c("is_anchor"), F.lit(False)), F.lit(f["anchor"])).otherwise(body) * every


def without_overlaps(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy by rank: a hit goes if its id came before, or if it shares over half of the shorter range with a kept one of its path.

    df(id, path, rank, start_line, end_line), for each value of by. Paths are independent,
    so each is one fold over its hits in memory: in a search these are RERANK_TOP at most.
    """
    first = Window.partitionBy(*by, "id").orderBy("rank")
    df = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    hit = F.struct(F.col("rank").alias("rank"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("id"))
    shared = lambda x, y: F.greatest(F.lit(0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]))
    shorter = lambda x, y: F.least(x["e"] - x["s"], y["e"] - y["s"])
    groups = df.groupBy(*by, "path").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    kind = groups.schema["hits"].dataType
    kept = F.aggregate("hits", F.array().cast(kind), lambda a, x: F.when(F.exists(a, lambda y: shared(x, y) > 0.5 * shorter(x, y)), a).otherwise(F.concat(a, F.array(x))))
    ids = groups.select(*by, F.explode(kept).alias("h")).select(*by, "h.id")
    return df.join(ids, [*by, "id"], "left_semi")


def without_overlaps_streamed(df: DataFrame) -> DataFrame:
    """without_overlaps for a table of any size: the hits of a path stream by rank past its kept ranges.

    Kept ranges share at most half of the shorter, so a path has about as many as its
    file has lines, however many hits it has; ranges without length overlap nothing and
    aren't held.
    """
    import numpy as np
    import pyarrow as pa

    first = Window.partitionBy("id").orderBy("rank")
    names = df.columns
    rows = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").repartition("path").sortWithinPartitions("path", "rank", "start_line", "end_line", "id")

    def stream(batches):
        path, held, kept = None, np.zeros((64, 2), np.int64), 0
        at = [names.index(c) for c in ("path", "start_line", "end_line")]
        for b in batches:
            ok = np.zeros(len(b), bool)
            for i, (p, s, e) in enumerate(zip(*(b.column(c).to_pylist() for c in at))):
                if i == 0 and path is None or p != path:
                    path, kept = p, 0
                near = held[:kept]
                shared = np.minimum(e, near[:, 1]) - np.maximum(s, near[:, 0])
                if not (np.maximum(shared, 0) > 0.5 * np.minimum(e - s, near[:, 1] - near[:, 0])).any():
                    ok[i] = True
                    if e > s:
                        if kept == len(held):
                            held = np.concatenate([held, np.zeros_like(held)])
                        held[kept], kept = (s, e), kept + 1
            yield b.filter(pa.array(ok))

    return rows.mapInArrow(stream, df.schema)


def per_file(df: DataFrame, cap: int = config.PER_FILE, k: int | None = None) -> DataFrame:
    """The best cap hits of each path, then the best k of all."""
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("rank"))).where(F.col("_n") <= cap).drop("_n")
    return out.orderBy("rank").limit(k) if k else out


def calibrate(df: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Scores relative to the best (of each value of by), and a level of confidence."""
    top = F.max(score).over(Window.partitionBy(*(by or [F.lit(1)])))
    rel = F.when(top > 0, F.col(score) / top).otherwise(0.0)
    return df.withColumn("calibrated", rel).withColumn("confidence", F.when(F.col("calibrated") > 0.8, "High").when(F.col("calibrated") > 0.5, "Medium").otherwise("Low"))


def at_least(df: DataFrame, score: Column, least: float) -> DataFrame:
    """Rows of at least a score; rows without one stay."""
    return df.where(score.isNull() | (score >= least))


def predicates(path_prefix: str | None = None, defined: str | None = None, referenced: str | None = None, intent_name: str = "GENERAL") -> Column:
    """The filter that both retrievers apply."""
    out = F.lit(True)
    if path_prefix:
        out = out & paths.under(F.col("path"), path_prefix)
    if defined:
        out = out & defines(defined)
    elif intent_name == "DEFINITION":
        out = out & is_definition()
    if referenced:
        out = out & references(referenced)
    return out


def reranked(best: DataFrame, query: str, rerank: Callable[[str, list[str]], list[tuple[int, float]]]) -> DataFrame:
    """best(id, content, ...) with the base score of a reranking service; texts it gives no score have 0.

    best has RERANK_TOP rows at most, so their texts go through the driver.
    """
    from ..sources import providers

    rows = best.select("id", "content", "stage_rank").orderBy("stage_rank").limit(config.RERANK_TOP).collect()
    got = providers.scattered(providers.retried(lambda: rerank(query, [r["content"] or "" for r in rows])), len(rows))
    scores = best.sparkSession.createDataFrame([(r["id"], float(s)) for r, s in zip(rows, got)], f"id {best.schema['id'].dataType.simpleString()}, base double")
    return best.join(F.broadcast(scores), "id")


def search(chunks: DataFrame, terms: list[str], query_vector: list[float] | None, k: int = 10, intent_name: str = "GENERAL", path_prefix: str | None = None, defined: str | None = None, referenced: str | None = None, cap: int = config.PER_FILE, query_tokens: Sequence[Sequence[float]] | None = None, rerank: Callable[[str, list[str]], list[tuple[int, float]]] | None = None, query: str = "", factors: dict[str, str | float | None] | None = None, text_hits: DataFrame | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None, skip: frozenset[int] = frozenset(), vector_hits: DataFrame | None = None) -> DataFrame:
    """Hybrid search over chunks(id, path, content, start_line, end_line, vector, ...): hits by falling score.

    query_tokens: the query's token vectors; then chunks has pooled, colbert and
    colbert_scale, the second stage goes by the pooled vector and the base score is the
    late interaction. rerank: a service (query, texts) -> (index, score) pairs, in place
    of that. With neither, reranking is off. text_hits: (id, score) of a stored
    full-text index in place of a scan, vector_hits: (id, distance) of a vector search
    likewise. fetch: gives the rows of at most STAGE1 candidates (id); then chunks needs
    what is scanned alone, and it and the hits have only what the filters let through. skip: ids of tokens (doc_token_ids) that the late interaction leaves out.
    factors: see boost.
    Returns id, path, start_line, end_line, score (relative), confidence, rank from 0. A
    query of other dimensions than the table is an error; an empty table gives no rows.
    """
    import numpy as np

    from ..functions import vectors

    seen = chunks if fetch else chunks.where(predicates(path_prefix, defined, referenced, intent_name))
    n = config.candidates(k)
    if text_hits is None:
        text = bm25(seen, "id", "content", terms, n)
    else:
        text = (text_hits if fetch else text_hits.join(seen.select("id"), "id", "left_semi")).orderBy(F.desc("score"), "id").limit(n)
    text = ranked(text, F.desc("score"), F.asc("id")).select("id", "rank")
    if vector_hits is not None:
        vec = ranked(vector_hits.orderBy("distance", "id").limit(n), F.asc("distance"), F.asc("id")).select("id", "rank")
    elif query_vector is not None:
        vec = ranked(vectors.nearest(seen, "id", "vector", query_vector, n).select("id", "distance"), F.asc("distance"), F.asc("id")).select("id", "rank")
    else:
        vec = text.where("false")
    fused = ranked(fuse(vec, text), F.desc("fused"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), name="fused_rank")
    q = None if query_tokens is None else np.asarray(query_tokens, np.float64)
    names = ["id", "path", "start_line", "end_line", "content", "chunk_type", "role", "referenced_symbols", "is_anchor", "is_exported", *(["pooled", "colbert", "colbert_scale"] if q is not None else []), *(["doc_token_ids"] if skip else [])]
    # at most STAGE1 candidates by construction, used twice
    few = fused.where(F.col("fused_rank") < config.STAGE1).persist()
    light = (fetch(few.select("id")) if fetch else seen).select(*names)
    pooled = F.lit(None).cast("double")
    if q is not None:
        mean = q.mean(0)
        mean = mean / (np.linalg.norm(mean) or 1.0)
        pooled = vectors.dot(F.col("pooled").cast("array<double>"), F.array(*[F.lit(float(x)) for x in mean]))
    best = cascade(light.join(F.broadcast(few), "id").withColumn("pooled_score", pooled))
    if rerank is not None:
        best = reranked(best, query, rerank)
    elif q is not None:
        best = vectors.maxsim(best, q, "colbert", "colbert_scale", q.shape[1], out="base", token_ids="doc_token_ids" if skip else None, skip=skip)
    else:
        best = best.withColumn("base", base_score(F.col("fused"), F.col("stage_rank")))
    scored = best.withColumn("score", blend(F.col("base"), F.col("fused")) * boost(intent_name, factors))
    hits = ranked(scored, F.desc("score"), F.asc("stage_rank")).select("id", "path", "start_line", "end_line", "score", "rank")
    out = calibrate(per_file(without_overlaps(hits), cap, k))
    return out.select("id", "path", "start_line", "end_line", F.col("calibrated").alias("score"), "confidence", (F.row_number().over(Window.orderBy("rank")) - 1).alias("rank"))
