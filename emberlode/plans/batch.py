"""Queries over many searches at once, stored postings, the symbol table and pruned neighbours."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pivots, vectors
from ..operators import evaluate, fulltext, index, many, ranking, store, symbols
from ..sources import providers
from . import fixtures as fx
from .search import _BM25, _D, _L2, TERMS, ORACLE_SQL as _SEARCH_SQL, _boost_sql, _query_vector, _vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, vec_id AS id, sqrt(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM e, q)
    SELECT query_id, id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 20""")
def knn_many(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 100, from one scan."""
    v = _vectors(spark, d)
    out = vectors.nearest_many(v, "vec_id", "embedding", v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 20)
    return out.withColumn("distance", F.round("distance", 6))


@query(_SEARCH_SQL["knn_l2"])
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """knn_l2 by cells around 64 pivots."""
    v = _vectors(spark, d)
    around = pivots.pick(v, "vec_id", "embedding", 64)
    rows = pivots.celled(v.select("vec_id", "embedding"), "embedding", around)
    return pivots.nearest(rows, pivots.cells(rows), around, "vec_id", "embedding", _query_vector(spark, d), 50)[0].withColumn("distance", F.round("distance", 6))


@query(f"WITH {fx.CHUNKS}, {_BM25} SELECT id, round(s, 6) AS score FROM sc ORDER BY s DESC, id LIMIT 100")
def fts_top_blocks(spark: SparkSession, d: str) -> DataFrame:
    """bm25 by posting blocks: only ranges that can reach the 100th score are scored."""
    docs = fx.chunks(spark, d).select(F.lit("all").alias("segment"), F.col("id").alias("doc"), "content")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(ranking.tokens(F.col("content")))).alias("terms")).first()
    # the asked terms' postings are read several times, as a stored index is
    made = fulltext.blocks(docs, bits=16).where(F.col("term").isin(TERMS)).persist(StorageLevel.MEMORY_AND_DISK)
    hits, _ = fulltext.top_k(made, TERMS, 100, stats["n"], stats["terms"] or 0)
    return hits.orderBy(F.desc("score"), "doc").limit(100).select(F.col("doc").alias("id"), F.round("score", 6).alias("score"))


@query(f"""WITH {fx.CHUNKS}, u AS (SELECT id AS doc, path, start_line, 'def' AS kind, unnest(defined_symbols) AS symbol FROM chunks UNION ALL SELECT id, path, start_line, 'ref', unnest(referenced_symbols) FROM chunks)
    SELECT symbol, kind, doc, path, start_line, CAST(count(*) AS INTEGER) AS n FROM u GROUP BY ALL""")
def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.chunks(spark, d).select(F.lit("all").alias("segment"), F.col("id").alias("doc"), "path", "start_line", "defined_symbols", "referenced_symbols")
    return symbols.entries(rows).drop("segment")


@query(f"WITH {fx.CHUNKS}, u AS (SELECT unnest(defined_symbols) AS symbol, path, start_line FROM chunks), g AS (SELECT symbol, count(*) AS n, min({{'path': path, 'line': start_line}}) AS a FROM u GROUP BY symbol) SELECT symbol, n, a.path AS path, a.line AS line FROM g WHERE contains(symbol, 'th') ORDER BY n DESC, symbol LIMIT 50")
def symbol_inventory(spark: SparkSession, d: str) -> DataFrame:
    """symbols by the symbol table, by part of a name."""
    rows = fx.chunks(spark, d).select(F.lit("all").alias("segment"), F.col("id").alias("doc"), "path", "start_line", "defined_symbols", "referenced_symbols")
    return symbols.inventory(symbols.entries(rows), "TH", limit=50)


@query()
def token_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Token matrices of all texts by the model without weights; held against numpy in the tests."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    out = providers.token_columns(docs, "text", lambda: providers.HashedStates(16))
    return out.select("doc_id", F.size("doc_token_ids").alias("n_tokens"), F.round("colbert_scale", 6).alias("scale"), F.sha2("colbert", 256).alias("matrix_sha256"))


# a search for each document whose number is a vector's and divisible by 100: its first words and its vector
_CASES = f"""{fx.CHUNKS}, em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    ca AS (SELECT doc_id AS case_id, path AS expected, list_distinct(t[1:4]) AS terms, em.v AS q FROM tok JOIN em ON em.vec_id = doc_id WHERE doc_id % 100 = 0),
    ct AS (SELECT case_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT case_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM (SELECT doc_id AS case_id, t[1:4] AS t FROM tok WHERE doc_id % 100 = 0))),
    ctk AS (SELECT id, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS t FROM chunks), cst AS (SELECT count(*) AS n, avg(len(t)) AS a FROM ctk),
    ctf AS (SELECT id, n, term, count(*) AS f FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM ctk) WHERE term IN (SELECT term FROM ct) GROUP BY ALL), cdf AS (SELECT term, count(*) AS df FROM ctf GROUP BY term),
    csc AS (SELECT case_id, id, list_reduce(list_concat([0::DOUBLE], list(ln(1 + (cst.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * ctf.n / a)) ORDER BY pos)), lambda x, y: x + y) AS s FROM ctf JOIN cdf USING (term) JOIN ct USING (term), cst GROUP BY case_id, id),
    cfr AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, id) - 1 AS r FROM csc QUALIFY r < 500),
    cvr AS (SELECT case_id, vec_id * 1000 AS id, row_number() OVER (PARTITION BY case_id ORDER BY sqrt(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), vec_id * 1000) - 1 AS r FROM em, ca WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY r < 500),
    cfu AS (SELECT coalesce(cvr.case_id, cfr.case_id) AS case_id, coalesce(cvr.id, cfr.id) AS id, coalesce(1.0::DOUBLE / (61 + cvr.r), 0) + coalesce(1.0::DOUBLE / (61 + cfr.r), 0) AS fused, cvr.r AS vr, cfr.r AS fr FROM cvr FULL OUTER JOIN cfr ON cvr.id = cfr.id AND cvr.case_id = cfr.case_id),
    cfo AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fused DESC, vr ASC NULLS LAST, fr ASC NULLS LAST) - 1 AS fused_rank FROM cfu QUALIFY fused_rank < 200)"""


def _case_rows(spark: SparkSession, d: str, tokens: bool) -> tuple[DataFrame, DataFrame]:
    """(queries, cases)"""
    v = _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = fx.files(spark, d).join(v, "doc_id").select(F.col("doc_id").alias("query_id"), F.slice(ranking.tokens(F.col("content")), 1, 4).alias("terms"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("GENERAL").alias("intent"), F.col("path").alias("expected"), F.lit(None).cast("string").alias("avoid"))
    if tokens:
        rows = rows.withColumn("tokens", vectors.token_rows(F.col("vector"), 16))
    return rows.drop("expected", "avoid"), rows.select("query_id", "expected", "avoid")


def _hits_sql(settings: str, late: str) -> str:
    """Hits of all settings (a VALUES list), as CTEs that end in ch(setting, case_id, path, rank)."""
    boost = _boost_sql("GENERAL").replace("0.5::DOUBLE", "test::DOUBLE").replace("THEN 0.6::DOUBLE ELSE 1 END) * (CASE WHEN path LIKE '%/tests/", "THEN docs::DOUBLE ELSE 1 END) * (CASE WHEN path LIKE '%/tests/")
    return f"""{late}, cs(setting, stage1, stage2, top, blend, rerank, per_file, k, test, docs) AS (VALUES {settings}),
    cx AS (SELECT * FROM cfe, cs WHERE fused_rank < stage1), c2 AS (SELECT *, row_number() OVER (PARTITION BY setting, case_id ORDER BY coalesce(pooled, -1) DESC, fused_rank) - 1 AS two FROM cx),
    c3 AS (SELECT *, CASE WHEN stage2 > 0 THEN two ELSE fused_rank END AS stage_rank FROM c2 WHERE (stage2 <= 0 OR two < stage2) AND CASE WHEN stage2 > 0 THEN two ELSE fused_rank END < top),
    c4 AS (SELECT *, row_number() OVER (PARTITION BY setting, case_id ORDER BY ((CASE WHEN rerank THEN late WHEN fused = 0 THEN 1.0::DOUBLE / (stage_rank + 1) ELSE fused END) + blend * fused) * {boost} DESC, stage_rank) - 1 AS rn FROM c3),
    c5 AS (SELECT *, row_number() OVER (PARTITION BY setting, case_id, path ORDER BY rn) AS pn FROM c4 a WHERE NOT EXISTS (SELECT 1 FROM c4 b WHERE b.setting = a.setting AND b.case_id = a.case_id AND b.path = a.path AND b.rn < a.rn AND greatest(0, least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line)) > 0.5 * least(a.end_line - a.start_line, b.end_line - b.start_line))),
    ch AS (SELECT setting, case_id, path, row_number() OVER (PARTITION BY setting, case_id ORDER BY rn) - 1 AS rank, k FROM c5 WHERE pn <= per_file QUALIFY rank < k)"""


_PLAIN = "cfe AS (SELECT cfo.*, c.path, c.content, c.start_line, c.end_line, c.role, c.chunk_type, c.referenced_symbols, c.is_anchor, c.is_exported, NULL::DOUBLE AS pooled, 0::DOUBLE AS late FROM cfo JOIN chunks c USING (id))"
_SQL_OF_CASES = f"WITH {_CASES}, " + _hits_sql("('one', 200, 40, 20, 0.5::DOUBLE, FALSE, 3, 20, 0.5::DOUBLE, 0.6::DOUBLE)", _PLAIN)


@query(_SQL_OF_CASES + """, t AS (SELECT ca.case_id, min(CASE WHEN contains(lower(path), lower(expected)) THEN rank END) AS r FROM ca LEFT JOIN ch USING (case_id) GROUP BY ca.case_id)
    SELECT case_id, r AS rank, CASE WHEN r IS NULL THEN 0 ELSE round(1.0::DOUBLE / (r + 1), 9) END AS rr, r IS NOT NULL AS found, r IS NOT NULL AND r < 10 AS recalled FROM t""")
def eval_search(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation over real searches: all cases from one pass, without reranking, 20 hits each."""
    queries, cases = _case_rows(spark, d, False)
    hits = many.search(fx.chunks(spark, d), queries, 20, fx.vectors_of(spark, d)).select(F.col("query_id").alias("case_id"), "path", "rank")
    out = evaluate.cases(hits, cases.withColumnRenamed("query_id", "case_id"))
    return out.select("case_id", F.col("rank").cast("long").alias("rank"), F.round("rr", 9).alias("rr"), "found", "recalled")


_SETTINGS = {
    "late": {"rerank": True},
    "off": {},
    "strong": {"rerank": True, "stage2": 80, "per_file": 50, "test": 0.85, "docs": 0.5, "blend": 0.25},
    "unstaged": {"rerank": True, "stage2": 0, "top": 40, "per_file": 1000},
}
_VALUES = ", ".join(
    f"('{n}', 200, {s.get('stage2', 40)}, {s.get('top', 20)}, {s.get('blend', 0.5)}::DOUBLE, {r}, {s.get('per_file', 3)}, 20, {s.get('test', 0.5)}::DOUBLE, {s.get('docs', 0.6)}::DOUBLE)"
    for name, s in _SETTINGS.items()
    for n, r in [(name, bool(s.get("rerank"))), *([("plain " + name, False)] if s.get("rerank") else [])]
)
_LATE = """cfe AS (SELECT cfo.*, c.path, c.content, c.start_line, c.end_line, c.role, c.chunk_type, c.referenced_symbols, c.is_anchor, c.is_exported,
      CASE WHEN em.v IS NOT NULL THEN list_cosine_similarity(list_transform(range(1, 17), lambda i: em.v[i] + em.v[i + 16] + em.v[i + 32] + em.v[i + 48]), list_transform(range(1, 17), lambda i: ca.q[i] + ca.q[i + 16] + ca.q[i + 32] + ca.q[i + 48])) END AS pooled,
      coalesce(CASE WHEN em.v IS NOT NULL THEN list_sum(list_transform([ca.q[1:16], ca.q[17:32], ca.q[33:48], ca.q[49:64]], lambda a: list_max(list_transform([em.v[1:16], em.v[17:32], em.v[33:48], em.v[49:64]], lambda b: list_dot_product(a, b))))) END, 0) AS late
    FROM cfo JOIN chunks c USING (id) JOIN ca USING (case_id) LEFT JOIN em ON em.vec_id * 1000 = c.id)"""


@query(f"WITH {_CASES}, " + _hits_sql(_VALUES, _LATE) + """, t AS (SELECT s.setting, ca.case_id, min(CASE WHEN contains(lower(path), lower(expected)) THEN rank END) AS r, list(lower(path) ORDER BY rank) FILTER (path IS NOT NULL) AS p FROM (SELECT DISTINCT setting FROM cs) s CROSS JOIN ca LEFT JOIN ch ON ch.case_id = ca.case_id AND ch.setting = s.setting GROUP BY s.setting, ca.case_id),
    b AS (SELECT t.setting, t.case_id, t.r, f.r AS fr, t.p, f.p AS fp FROM t LEFT JOIN t f ON f.setting = 'plain ' || t.setting AND f.case_id = t.case_id WHERE t.setting NOT LIKE 'plain %')
    SELECT setting, round(avg(CASE WHEN r IS NULL THEN 0 ELSE 1.0::DOUBLE / (r + 1) END), 9) AS mrr, round(avg(CASE WHEN r < 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall, count(r) AS found, count(*) AS cases,
      count(*) FILTER (fp IS NOT NULL AND NOT list_contains(list_transform(p[1:3], lambda x: contains(x, fp[1])), TRUE)) AS drops,
      count(*) FILTER (fp IS NOT NULL AND NOT list_contains(list_transform(fp[1:3], lambda x: contains(x, p[1])), TRUE) AND list_contains(list_transform(fp, lambda x: contains(x, p[1])), TRUE)) AS lifts,
      count(*) FILTER (r < fr) AS better, count(*) FILTER (r > fr) AS worse, count(*) FILTER (r = fr) AS unchanged FROM b GROUP BY setting""")
def rank_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A grid of settings over the candidates of all cases, kept once."""
    queries, cases = _case_rows(spark, d, True)
    m = vectors.token_rows(F.col("vector").cast("array<double>"), 16)
    v = fx.vectors_of(spark, d).select("id", "vector", m.alias("rows"), vectors.pooled(m, 16).alias("pooled"))
    out = many.sweep(many.features(fx.chunks(spark, d), queries, 500, vectors_of=v), many.settings(spark, _SETTINGS), cases)
    return out.withColumns({"mrr": F.round("mrr", 9), "recall": F.round("recall", 9)})


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, which goes with the driver's JVM; of this machine only in local mode, where none is set."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="emberlode-index-")
    made = store.Store(spark, where)
    root = made.at(made.new("index"))
    made._fs.mkdirs(made._path(root.rsplit("/", 1)[1]))
    made._fs.deleteOnExit(made._path(root.rsplit("/", 1)[1]))
    return root


@query("""WITH f AS (SELECT 'd/' || doc_id || '.md' AS path, coalesce(text, '') || CASE WHEN doc_id % 5 = 1 THEN chr(10) || 'more' ELSE '' END AS t FROM documents WHERE doc_id % 7 <> 0 AND strlen(coalesce(text, '')) > 0),
    l AS (SELECT path, sha256(t) AS hash, string_split(t, chr(10)) AS l FROM f), w AS (SELECT path, unnest(list_transform(range(0, len(l), 65), lambda i: array_to_string(l[i + 1:i + 75], chr(10)))) AS x FROM l),
    p AS (SELECT path, unnest(CASE WHEN length(x) > 2000 THEN list_transform(range(0, length(x), 1800), lambda i: substring(x, CAST(i + 1 AS BIGINT), 2000)) ELSE [x] END) AS x FROM w),
    n AS (SELECT path, count(*) AS n FROM p WHERE regexp_matches(x, '[^\\s\\x0B]') GROUP BY path)
    SELECT l.path, l.hash, coalesce(n.n, 0) AS n_chunks, CAST(1 AS BIGINT) AS n_anchors FROM l LEFT JOIN n USING (path)""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files, indexed in two builds: some are new in the second, some changed, some gone. What the index then has by file."""
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")

    def files(rows: DataFrame, content) -> DataFrame:
        return rows.select(F.concat(F.lit("d/"), i.cast("string"), F.lit(".md")).alias("path"), content.alias("content"), F.sha2(content.cast("binary"), 256).alias("hash"), F.when(i % 5 == 1, F.length(content)).otherwise(i).cast("double").alias("mtime_ms"), F.octet_length(content).cast("long").alias("size"))

    root, t = _folder(spark), F.col("text")
    index.build(spark, root, files(docs.where(i % 10 != 9), t))
    index.build(spark, root, files(docs.where(i % 7 != 0), F.when(i % 5 == 1, F.concat(t, F.lit("\nmore"))).otherwise(t)))
    rows = index.open_index(spark, root).chunks()
    return rows.groupBy("path").agg(F.max("hash").alias("hash"), F.count_if(~F.col("is_anchor")).alias("n_chunks"), F.count_if("is_anchor").alias("n_anchors"))
