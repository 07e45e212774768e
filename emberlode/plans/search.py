"""Queries over vectors, full text and ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import paths, vectors
from ..operators import present, ranking
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = ["the", "and"]
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _vectors(spark, d).where("vec_id = 0").select("embedding").first()[0]]


def _round(x, digits: int) -> "F.Column":
    """F.round, but what rounds to 0 keeps its sign, as in the SQL."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def _rounded(c) -> "F.Column":
    return F.transform(c, lambda x: _round(x, 6))


_D = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2]))"
_L2 = "sqrt(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"


@query(f"WITH {_D} SELECT vec_id, list_transform(list_transform(v, lambda x: x * 3 / (3 * n)), lambda x: round(x, 6)) AS unit FROM (SELECT vec_id, v, {_NORM} AS n FROM e)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _vectors(spark, d).select("vec_id", _rounded(vectors.l2_normalize(tripled)).alias("unit"))


@query(f"WITH {_D} SELECT vec_id, round({_DOT} / ({_NORM} * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6) AS cosine FROM e, q")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    q = F.lit(_query_vector(spark, d))
    v = F.col("embedding")
    return _vectors(spark, d).select("vec_id", _round(vectors.dot(v, q) / (vectors.l2_norm(v) * vectors.l2_norm(q)), 6).alias("cosine"))


@query(f"WITH {_D} SELECT vec_id AS id, round({_L2}, 6) AS distance FROM e, q ORDER BY {_L2}, vec_id LIMIT 50")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(_vectors(spark, d), "vec_id", "embedding", _query_vector(spark, d), 50).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_D} SELECT vec_id AS id, round(abs(1 - {_DOT} / ({_NORM} * sqrt(list_sum(list_transform(q, lambda x: x * x))))), 6) AS distance FROM e, q ORDER BY 1 - {_DOT} / ({_NORM} * sqrt(list_sum(list_transform(q, lambda x: x * x)))), vec_id LIMIT 50")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(_vectors(spark, d), "vec_id", "embedding", _query_vector(spark, d), 50, "cosine").withColumn("distance", F.abs(F.round("distance", 6)))


_ROWS = "r AS (SELECT vec_id, [v[1:16], v[17:32], v[33:48], v[49:64]] AS m, list_max(list_transform(v, lambda x: abs(x))) AS top FROM e)"


@query(f"WITH {_D}, {_ROWS} SELECT vec_id, list_transform(m, lambda w: list_transform(w, lambda x: CAST(floor(x / top * 127 + 0.5) AS INTEGER))) AS rows, round(top, 6) AS scale FROM r")
def int8_quantize(spark: SparkSession, d: str) -> DataFrame:
    rows, scale = vectors.quantize_int8(vectors.token_rows(F.col("embedding"), 16))
    return _vectors(spark, d).select("vec_id", rows.alias("rows"), F.round(scale, 6).alias("scale"))


@query(f"""WITH {_D}, {_ROWS}, s AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (m[1][i] + m[2][i] + m[3][i] + m[4][i]) / 4) AS v FROM r)
    SELECT vec_id, list_transform(v, lambda x: round(x / n, 6)) AS pooled FROM (SELECT vec_id, v, {_NORM} AS n FROM s)""")
def pooled_vector(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", _rounded(vectors.pooled(vectors.token_rows(F.col("embedding"), 16), 16)).alias("pooled"))


@query(f"""WITH {_D}, {_ROWS}, z AS (SELECT vec_id, list_transform(m, lambda w: list_transform(w, lambda x: floor(x / top * 127 + 0.5) * top / 127)) AS m FROM r),
    qq AS (SELECT [q[1:16], q[17:32], q[33:48], q[49:64]] AS q FROM q)
    SELECT vec_id, round(list_sum(list_transform(qq.q, lambda a: list_max(list_transform(m, lambda b: list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])))))), 3) AS maxsim FROM z, qq""")
def maxsim(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    rows, scale = vectors.quantize_int8(vectors.token_rows(F.col("embedding"), 16))
    packed = _vectors(spark, d).select("vec_id", vectors.packed_int8(rows).alias("tokens"), scale.alias("scale"))
    out = vectors.maxsim(packed, np.array(_query_vector(spark, d), np.float32).reshape(4, 16), "tokens", "scale", 16)
    return out.select("vec_id", _round(F.col("maxsim"), 3).alias("maxsim"))


_BM25 = r"""tk AS (SELECT id, path, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM chunks),
    ln AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS f1, len(list_filter(t, lambda x: x = 'and')) AS f2 FROM tk),
    st AS (SELECT count(*) AS n, avg(n) AS a, sum(CASE WHEN f1 > 0 THEN 1 ELSE 0 END) AS d1, sum(CASE WHEN f2 > 0 THEN 1 ELSE 0 END) AS d2 FROM ln),
    sc AS (SELECT id, ln(1 + (st.n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * ln.n / a)) + ln(1 + (st.n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * ln.n / a)) AS s FROM ln, st WHERE f1 > 0 OR f2 > 0)"""


@query(f"WITH {fx.CHUNKS}, {_BM25} SELECT id, round(s, 6) AS score FROM sc ORDER BY s DESC, id LIMIT 100")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return ranking.bm25(fx.chunks(spark, d), "id", "content", TERMS, 100).withColumn("score", F.round("score", 6))


@query(f"WITH {fx.CHUNKS}, {_BM25.split(', ln AS')[0].split('ln AS')[0].rstrip().rstrip(',')}, u AS (SELECT id, unnest(t) AS term FROM tk) SELECT term, id, count(*) AS tf FROM u GROUP BY term, id")
def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    return ranking.postings(fx.chunks(spark, d), "id", "content")[0]


_INTENT = "CASE WHEN regexp_matches(lower(x), 'where is|what is|define') THEN 'DEFINITION' WHEN regexp_matches(lower(x), 'how does|how is|implementation') THEN 'FLOW' WHEN regexp_matches(lower(x), 'example|how to use|usage') THEN 'USAGE' WHEN regexp_matches(lower(x), 'architecture|system|overview') THEN 'ARCHITECTURE' ELSE 'GENERAL' END"
_HEADS = ["What is ", "how does it ", "an Example of ", "System of ", "undefined ", ""]


@query(f"WITH b AS (SELECT item_id, {_HEADS}[1 + item_id % 6] || text AS x FROM benchmark) SELECT item_id, {_INTENT} AS intent FROM b")
def intent(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("item_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", ranking.intent(F.concat(head, "text")).alias("intent"))


@query(f"WITH {fx.CHUNKS} SELECT id, path FROM chunks WHERE path LIKE 'src/te_ts/%'")
def path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).where(paths.under(F.col("path"), "src\\te_ts/")).select("id", "path")


@query(f"WITH {fx.CHUNKS} SELECT id, list_contains(defined_symbols, 'the') AS hit FROM chunks WHERE list_contains(defined_symbols, 'the') OR (doc_id % 2 = 0 AND (role = 'DEFINITION' OR len(defined_symbols) > 0))")
def filter_def(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).where(ranking.predicates(defined="the") | ((F.col("doc_id") % 2 == 0) & ranking.predicates(intent_name="DEFINITION"))).select("id", ranking.defines("the").alias("hit"))


@query(f"WITH {fx.CHUNKS} SELECT id FROM chunks WHERE list_contains(referenced_symbols, 'the')")
def filter_ref(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).where(ranking.predicates(referenced="the")).select("id")


_VEC = f"{_D}, vd AS (SELECT vec_id * 1000 AS id, {_L2} AS dist FROM e, q WHERE vec_id IN (SELECT doc_id FROM documents)), vr AS (SELECT id, row_number() OVER (ORDER BY dist, id) - 1 AS r FROM vd QUALIFY r < 500)"
_FUSED = f"""{fx.CHUNKS}, {_BM25}, {_VEC}, fr AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM sc QUALIFY r < 500),
    fu AS (SELECT coalesce(vr.id, fr.id) AS id, coalesce(1.0::DOUBLE / (61 + vr.r), 0) + coalesce(1.0::DOUBLE / (61 + fr.r), 0) AS fused, vr.r AS vec_rank, fr.r AS fts_rank FROM vr FULL OUTER JOIN fr ON vr.id = fr.id),
    fo AS (SELECT *, row_number() OVER (ORDER BY fused DESC, vec_rank ASC NULLS LAST, fts_rank ASC NULLS LAST) - 1 AS fused_rank FROM fu)"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = fx.chunks(spark, d)
    text = ranking.ranked(ranking.bm25(rows, "id", "content", TERMS, 500), F.desc("score"), F.asc("id"))
    vec = ranking.ranked(vectors.nearest(fx.vectors_of(spark, d), "id", "vector", _query_vector(spark, d), 500), F.asc("distance"), F.asc("id"))
    return rows, vec, text


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, vec, text = _lists(spark, d)
    return rows, ranking.ranked(ranking.fuse(vec, text), F.desc("fused"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), name="fused_rank")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"WITH {_FUSED} SELECT id, round(fused, 9) AS fused, vec_rank, fts_rank, fused_rank FROM fo")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return _long(_fused(spark, d)[1].withColumn("fused", F.round("fused", 9)), "vec_rank", "fts_rank", "fused_rank")


_STAGED = f"""{_FUSED}, s1 AS (SELECT fo.*, CASE WHEN c.doc_id % 3 = 0 THEN NULL ELSE c.doc_id % 97 END AS pooled_score, c.path, c.content, c.start_line, c.end_line, c.role, c.chunk_type, c.defined_symbols, c.referenced_symbols, c.is_anchor, c.is_exported FROM fo JOIN chunks c USING (id) WHERE fused_rank < 200),
    s2 AS (SELECT *, row_number() OVER (ORDER BY coalesce(pooled_score, -1) DESC, fused_rank) - 1 AS stage_rank FROM s1 QUALIFY stage_rank < 40), s3 AS (SELECT * FROM s2 WHERE stage_rank < 20)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    rows, fused = _fused(spark, d)
    pooled = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 97).cast("double"))
    # at most 1000 fused candidates
    cand = rows.join(F.broadcast(fused.where("fused_rank < 200")), "id").withColumn("pooled_score", pooled)
    return ranking.cascade(cand)


@query(f"WITH {_STAGED} SELECT id, fused_rank, stage_rank FROM s3")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    return _long(_staged(spark, d).select("id", "fused_rank", "stage_rank"), "fused_rank", "stage_rank")


@query(f"WITH {_STAGED} SELECT id, round(CASE WHEN fused = 0 THEN 1.0::DOUBLE / (stage_rank + 1) ELSE fused END, 9) AS base FROM s3")
def rerank_off(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d).select("id", F.round(ranking.base_score(F.col("fused"), F.col("stage_rank")), 9).alias("base"))


@query(f"WITH {_STAGED} SELECT id, round(1.0::DOUBLE / (stage_rank + 1) + 0.5 * fused, 9) AS blended FROM s3")
def blend(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d).select("id", F.round(ranking.blend(F.lit(1.0) / (F.col("stage_rank") + 1), F.col("fused")), 9).alias("blended"))


def _boost_sql(intent_name: str) -> str:
    role = {"DEFINITION": ("DEFINITION", 1.2), "FLOW": ("ORCHESTRATION", 1.4), "USAGE": ("IMPLEMENTATION", 1.2)}.get(intent_name, ("-", 1.0))
    return f"""(CASE WHEN is_anchor THEN 0.99::DOUBLE ELSE (CASE WHEN chunk_type IN ('function', 'class', 'method', 'interface', 'type_alias') THEN 1.1::DOUBLE * (CASE role WHEN 'ORCHESTRATION' THEN 1.5 WHEN 'DEFINITION' THEN 1.2 WHEN 'IMPLEMENTATION' THEN 1.1 ELSE 1 END) ELSE 1 END)
      * (CASE WHEN len(referenced_symbols) > 5 THEN 1.1::DOUBLE ELSE 1 END) * (CASE WHEN len(referenced_symbols) > 15 THEN 1.25::DOUBLE ELSE 1 END) * (CASE WHEN role = '{role[0]}' THEN {role[1]}::DOUBLE ELSE 1 END) END
      * (CASE WHEN role = 'DOCS' THEN 0.6::DOUBLE ELSE 1 END) * (CASE WHEN path LIKE '%/tests/%' THEN 0.5::DOUBLE ELSE 1 END) * (CASE WHEN path LIKE '%.md' THEN 0.6::DOUBLE ELSE 1 END) * (CASE WHEN length(content) < 50 AND NOT is_exported THEN 0.9::DOUBLE ELSE 1 END))"""


@query(f"WITH {fx.CHUNKS} SELECT id, round({_boost_sql('FLOW')}, 9) AS flow, round({_boost_sql('DEFINITION')}, 9) AS definition, round({_boost_sql('GENERAL')}, 9) AS general FROM chunks")
def structure_boost(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).select("id", *[F.round(ranking.boost(i), 9).alias(i.lower()) for i in ("FLOW", "DEFINITION", "GENERAL")])


# hits with overlapping ranges in few paths: every path keeps its windows, ranks spread by a multiplier
_HITS = "hits AS (SELECT id, lang || '/' || source AS path, id * 7919 % 100003 AS rank, doc_id % 40 AS start_line, doc_id % 40 + 1 + doc_id % 13 AS end_line, role, content, defined_symbols FROM (SELECT c.*, d.lang, d.source FROM chunks c JOIN documents d USING (doc_id)) x)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    where = F.regexp_extract("path", r"(?:src/tests|src)/(.*)/[^/]*$", 1)
    return fx.chunks(spark, d).select("id", where.alias("path"), F.pmod(F.col("id") * 7919, F.lit(100003)).alias("rank"), (i % 40).cast("int").alias("start_line"), (i % 40 + 1 + i % 13).cast("int").alias("end_line"), "role", "content", "defined_symbols")


@query(f"""WITH RECURSIVE {fx.CHUNKS}, {_HITS}, o AS (SELECT path, list({{'k': rank, 's': start_line, 'e': end_line, 'i': id}} ORDER BY rank) AS h FROM hits GROUP BY path),
    g AS (SELECT path, h, 1 AS n, [h[1]] AS kept FROM o
          UNION ALL SELECT path, h, n + 1, CASE WHEN len(list_filter(kept, lambda y: greatest(0, least(y.e, h[n + 1].e) - greatest(y.s, h[n + 1].s)) > 0.5 * least(y.e - y.s, h[n + 1].e - h[n + 1].s))) > 0 THEN kept ELSE list_append(kept, h[n + 1]) END FROM g WHERE n < len(h)),
    k AS (SELECT path, unnest(kept) AS x FROM g WHERE n = len(h)) SELECT x.i AS id, path, x.k AS rank FROM k""")
def overlap_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ranking.without_overlaps_streamed(_hits(spark, d).select("id", "path", "rank", "start_line", "end_line")).select("id", "path", "rank")


@query(f"WITH {fx.CHUNKS}, {_HITS}, n AS (SELECT *, (SELECT count(*) FROM hits b WHERE b.path = a.path AND b.rank < a.rank) AS before FROM hits a) SELECT id, path, rank FROM n WHERE before < 3 ORDER BY rank LIMIT 100")
def per_file_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.per_file(_hits(spark, d), 3, 100).select("id", "path", "rank")


_SCORED = f"{_STAGED}, scored AS (SELECT *, (CASE WHEN fused = 0 THEN 1.0::DOUBLE / (stage_rank + 1) ELSE fused END + 0.5 * fused) * {_boost_sql('FLOW')} AS score FROM s3)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fused")
    return _staged(spark, d).withColumn("score", ranking.blend(ranking.base_score(f, F.col("stage_rank")), f) * ranking.boost("FLOW"))


@query(f"WITH {_SCORED}, m AS (SELECT max(score) AS m FROM scored), c AS (SELECT id, CASE WHEN m > 0 THEN score / m ELSE 0 END AS x FROM scored, m) SELECT id, round(x, 9) AS calibrated, CASE WHEN x > 0.8 THEN 'High' WHEN x > 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM c")
def calibrate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.calibrate(_scored(spark, d)).select("id", F.round("calibrated", 9).alias("calibrated"), "confidence")


@query(f"WITH {_SCORED} SELECT id, CASE WHEN id % 2 = 0 THEN round(score, 9) END AS score FROM scored WHERE id % 2 <> 0 OR score >= 0.02")
def min_score(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("score")).alias("score"))
    return ranking.at_least(s, F.col("score"), 0.02).select("id", F.round("score", 9).alias("score"))


def _vector_hits(spark: SparkSession, d: str) -> DataFrame:
    """The search's nearest chunks, from the vectors alone: no text is joined to them."""
    return vectors.nearest(fx.vectors_of(spark, d), "id", "vector", _query_vector(spark, d), config.candidates(K))


_HYBRID = _STAGED.replace("CASE WHEN c.doc_id % 3 = 0 THEN NULL ELSE c.doc_id % 97 END AS pooled_score", "NULL AS pooled_score")


def _searched(staged: str, base: str, digits: int) -> str:
    return f"""WITH {staged}, sc2 AS (SELECT *, ({base} + 0.5 * fused) * {_boost_sql('FLOW')} AS score FROM s3),
    rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, stage_rank) AS rn FROM sc2),
    pf AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rn) AS pn FROM rk a WHERE NOT EXISTS (SELECT 1 FROM rk b WHERE b.path = a.path AND b.rn < a.rn AND greatest(0, least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line)) > 0.5 * least(a.end_line - a.start_line, b.end_line - b.start_line))),
    tk2 AS (SELECT * FROM pf WHERE pn <= 3 ORDER BY rn LIMIT 10), m AS (SELECT max(score) AS m FROM tk2)
    SELECT id, path, start_line, end_line, round(score / m, {digits}) AS score, CASE WHEN score / m > 0.8 THEN 'High' WHEN score / m > 0.5 THEN 'Medium' ELSE 'Low' END AS confidence, row_number() OVER (ORDER BY rn) - 1 AS rank FROM tk2, m"""


@query(_searched(_HYBRID, "fused", 6))
def hybrid_search_rerank_off(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search by fusion and boosts alone."""
    hits = ranking.search(fx.chunks(spark, d), TERMS, None, K, "FLOW", vector_hits=_vector_hits(spark, d))
    return _long(hits.withColumn("score", F.round("score", 6)), "rank")


_MEAN = "list_transform(range(1, 17), lambda i: (m[1][i] + m[2][i] + m[3][i] + m[4][i]) / 4)"
_TOKENS = f"""{_ROWS}, tokq AS (SELECT [q[1:16], q[17:32], q[33:48], q[49:64]] AS m FROM q), pq AS (SELECT {_MEAN} AS v FROM tokq),
    tokd AS (SELECT vec_id * 1000 AS id, {_MEAN} AS v, list_transform(m, lambda w: list_transform(w, lambda x: floor(x / top * 127 + 0.5) * top / 127)) AS z FROM r),
    tz AS (SELECT id, list_cosine_similarity(tokd.v, pq.v) AS ps, list_sum(list_transform(tokq.m, lambda a: list_max(list_transform(z, lambda b: list_dot_product(a, b))))) AS ms FROM tokd, tokq, pq)"""
_RERANKED = _STAGED.replace("CASE WHEN c.doc_id % 3 = 0 THEN NULL ELSE c.doc_id % 97 END AS pooled_score", "tz.ps AS pooled_score, coalesce(tz.ms, 0) AS ms").replace("JOIN chunks c USING (id) WHERE", "JOIN chunks c USING (id) LEFT JOIN tz USING (id) WHERE").replace(", s1 AS (", f", {_TOKENS}, s1 AS (")


@query(_searched(_RERANKED, "ms", 4))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: full text and vector candidates, fusion, pooled stage, late interaction, boosts, diversity, calibration."""
    v = _query_vector(spark, d)
    # tokens are made for the candidates alone
    hits = ranking.search(fx.chunks(spark, d), TERMS, None, K, "FLOW", vector_hits=_vector_hits(spark, d), query_tokens=[v[i : i + 16] for i in range(0, 64, 16)], fetch=lambda few: fx.tokens_of(spark, d, few))
    return _long(hits.withColumn("score", F.round("score", 4)), "rank")


@query(f"""WITH RECURSIVE {fx.CHUNKS}, {_HITS}, top AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank DESC, start_line, id) AS n FROM hits QUALIFY n <= 1000),
    o AS (SELECT path, list({{'s': start_line, 'e': end_line}} ORDER BY start_line, n) AS h FROM top GROUP BY path),
    g AS (SELECT path, h, 1 AS n, h[1].s AS s, h[1].e AS e, 1 AS c, 0 AS done FROM o
          UNION ALL SELECT path, h, n + 1, CASE WHEN h[n + 1].s <= e + 10 THEN s ELSE h[n + 1].s END, h[n + 1].e, CASE WHEN h[n + 1].s <= e + 10 THEN c + 1 ELSE 1 END, 0 FROM g WHERE n < len(h)),
    l AS (SELECT path, n, s, e, c, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS grp FROM g),
    t AS (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY start_line, n) AS n FROM top)
    SELECT l.path, CAST(arg_max(s, l.n) AS INTEGER) AS start_line, CAST(arg_max(e, l.n) AS INTEGER) AS end_line, CAST(max(c) AS INTEGER) AS n, sha256(string_agg(content, chr(10) || '   // ...' || chr(10) ORDER BY l.n)) AS content_sha256
    FROM l JOIN t ON t.path = l.path AND t.n = l.n GROUP BY l.path, grp""")
def stitch(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).withColumn("score", F.col("rank").cast("double"))
    return present.stitch(hits).select("path", "start_line", "end_line", "n", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH {fx.CHUNKS}, {_HITS}, p AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l, rank / 100003 AS sc FROM hits)
    SELECT path, (start_line + 1) || '-' || (end_line + 1) AS range, CASE role WHEN 'DEFINITION' THEN 'DEF' WHEN 'ORCHESTRATION' THEN 'ORCH' WHEN 'IMPLEMENTATION' THEN 'IMPL' WHEN 'DOCS' THEN 'DOCS' ELSE 'UNK' END AS role,
      CASE WHEN sc > 0.8 THEN 'H' WHEN sc > 0.5 THEN 'M' ELSE 'L' END AS conf, defined_symbols AS defined,
      CASE WHEN length(coalesce(l[1], defined_symbols[1], '')) > 140 THEN substring(coalesce(l[1], defined_symbols[1], ''), 1, 140) || '...' ELSE coalesce(l[1], defined_symbols[1], '') END AS preview, regexp_replace(regexp_replace(printf('%.3f', sc), '^0\\.', '.'), '\\.?0+$', '') AS score FROM p""")
def compact_hits(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("rank") / 100003.0
    hits = _hits(spark, d).withColumn("score", s).withColumn("confidence", F.when(s > 0.8, "High").when(s > 0.5, "Medium").otherwise("Low"))
    return present.compact(hits)
