"""Queries over symbols, sync snapshots and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, graph, index, ranking, sync
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SYMBOL = "the"
#: Defined by a chunk that references others, in every size of the tables.
CENTER = "thing"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {fx.CHUNKS}, u AS (SELECT unnest(defined_symbols) AS symbol, path, start_line FROM chunks),
    f AS (SELECT symbol, path, start_line, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY path, start_line) AS k FROM u)
    SELECT symbol, n, path, start_line AS line FROM f WHERE k = 1 ORDER BY n DESC, symbol LIMIT 100""")
def symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols(fx.chunks(spark, d), limit=100)


_NODE = "CASE WHEN len(defined_symbols) > 0 AND defined_symbols[1] <> '' THEN defined_symbols[1] WHEN parent_symbol <> '' THEN parent_symbol ELSE 'unknown' END"
_CALLERS = f"(SELECT {_NODE} AS symbol, path, start_line AS line, coalesce(role, 'IMPLEMENTATION') AS role, referenced_symbols AS calls, complexity FROM chunks WHERE list_contains(referenced_symbols, 'the') ORDER BY path, start_line LIMIT 100)"
_CENTER = "(SELECT 'thing' AS symbol, path, start_line AS line, referenced_symbols AS calls FROM chunks WHERE list_contains(defined_symbols, 'thing') ORDER BY path, start_line LIMIT 1)"


@query(f"WITH {fx.CHUNKS} SELECT * FROM {_CALLERS}")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(fx.chunks(spark, d), SYMBOL)


@query(f"WITH {fx.CHUNKS}, c AS {_CENTER} SELECT CAST(generate_subscripts(calls, 1) - 1 AS INTEGER) AS position, unnest(calls) AS callee FROM c")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(fx.chunks(spark, d), CENTER)


@query(f"""WITH {fx.CHUNKS}, c AS {_CENTER} SELECT 'caller' AS kind, symbol, path, line FROM {_CALLERS.replace("'the'", "'thing'")} UNION ALL SELECT 'center', symbol, path, line FROM c UNION ALL SELECT 'callee', unnest(calls), NULL, NULL FROM c""")
def one_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_hop(fx.chunks(spark, d), CENTER)


@query(r"WITH " + fx.CHUNKS + r""", w AS (SELECT id, path, len(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS n, len(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x = 'the')) AS f, list_contains(defined_symbols, 'the') AS d FROM chunks),
    a AS (SELECT avg(n) AS a FROM w), t AS (SELECT path, d, f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a)) AS s, id FROM w, a WHERE f > 0 ORDER BY s DESC, id LIMIT 10)
    SELECT path FROM t ORDER BY CASE WHEN d THEN 0 ELSE 1 END, s DESC, id LIMIT 1""")
def symbol_file(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.chunks(spark, d)
    return index.symbol_file(rows, ranking.bm25(rows, "id", "content", [SYMBOL], 10), SYMBOL)


# two snapshots of the same files: the cache misses some, has others changed, and knows files that are gone
_NOW = f"{fx.FILES}, now AS (SELECT path, sha256(content) AS hash, CAST(doc_id AS DOUBLE) AS mtime_ms, length(content) AS size, content FROM files WHERE doc_id % 10 <> 9)"
_CACHED = "cached AS (SELECT path, CASE WHEN doc_id % 4 = 1 THEN 'old' ELSE sha256(content) END AS hash, CAST(CASE WHEN doc_id % 4 IN (1, 2) THEN -1 ELSE doc_id END AS DOUBLE) AS mtime_ms, length(content) AS size FROM files WHERE doc_id % 5 <> 0)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, i = fx.files(spark, d), F.col("doc_id")
    h, n = F.sha2("content", 256), F.length("content").cast("long").alias("size")
    now = f.where(i % 10 != 9).select("path", h.alias("hash"), i.cast("double").alias("mtime_ms"), n, "content")
    cached = f.where(i % 5 != 0).select("path", F.when(i % 4 == 1, "old").otherwise(h).alias("hash"), F.when((i % 4).isin(1, 2), -1).otherwise(i).cast("double").alias("mtime_ms"), n)
    return now, cached


@query(f"WITH {_NOW}, {_CACHED} SELECT n.path, CASE WHEN c.path IS NULL THEN 'new' WHEN c.mtime_ms = n.mtime_ms AND c.size = n.size THEN 'unchanged' WHEN c.hash = n.hash THEN 'touched' ELSE 'changed' END AS state FROM now n LEFT JOIN cached c ON c.path = n.path")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.diff(*_snapshots(spark, d))


@query(f"WITH {_NOW}, {_CACHED} SELECT path FROM cached WHERE path NOT IN (SELECT path FROM now)")
def sync_stale(spark: SparkSession, d: str) -> DataFrame:
    return sync.stale(*_snapshots(spark, d))


@query(f"""WITH {_NOW}, {_CACHED}, o AS (SELECT c.path, c.hash, n.content IS NULL AS gone, n.path IS NOT NULL AND NOT (c.mtime_ms = n.mtime_ms AND c.size = n.size) AND c.hash <> n.hash AS changed FROM cached c LEFT JOIN now n ON n.path = c.path)
    SELECT path, hash FROM o WHERE NOT gone AND NOT changed UNION ALL SELECT path, hash FROM now WHERE path IN (SELECT path FROM o WHERE changed) OR path NOT IN (SELECT path FROM cached)""")
def sync_upsert(spark: SparkSession, d: str) -> DataFrame:
    now, cached = _snapshots(spark, d)
    todo = sync.diff(now, cached).where("state in ('new', 'changed')").select("path")
    new = now.join(todo, "path", "left_semi").select("path", "hash")
    return sync.upsert(cached.select("path", "hash"), new, sync.stale(now, cached))


@query(f"WITH {_NOW} SELECT count(*) AS processed, count(*) AS indexed, CAST(0 AS BIGINT) AS failed FROM now")
def sync_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return sync.dry_run(_snapshots(spark, d)[0])


# cases: each item looks for two sources; its hits are files of a residue class, by id
_CASES = f"{fx.FILES}, ex AS (SELECT item_id AS case_id, '/SRC' || item_id % 20 || '/|nowhere' AS expected, CASE WHEN item_id % 4 = 0 THEN 'src/tests' END AS avoid FROM benchmark), ht AS (SELECT item_id AS case_id, path, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS rank FROM benchmark JOIN files ON files.doc_id % 40 = benchmark.item_id % 40 QUALIFY rank < 20)"
_CASE_ROWS = """x AS (SELECT ex.case_id, min(CASE WHEN contains(lower(path), split_part(lower(expected), '|', 1)) THEN rank END) AS r, min(CASE WHEN avoid IS NOT NULL AND contains(lower(path), lower(avoid)) THEN rank END) AS b FROM ex LEFT JOIN ht ON ht.case_id = ex.case_id GROUP BY ex.case_id),
    cs AS (SELECT case_id, CASE WHEN r IS NOT NULL AND (b IS NULL OR b > r) THEN r END AS rank FROM x)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    b, f = spark.read.parquet(f"{d}/benchmark.parquet"), fx.files(spark, d)
    i = F.col("item_id")
    expected = b.select(i.alias("case_id"), F.concat(F.lit("/SRC"), (i % 20).cast("string"), F.lit("/|nowhere")).alias("expected"), F.when(i % 4 == 0, "src/tests").alias("avoid"))
    # the files of a residue are ranked once, then joined to its cases: 20 rows a case
    first = f.withColumn("m", F.col("doc_id") % 40).withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy("doc_id"))).where("r <= 20")
    hits = b.select(i.alias("case_id"), (i % 40).alias("m")).join(first, "m").withColumn("rank", F.col("r") - 1)
    return evaluate.cases(hits.select("case_id", "path", "rank"), expected)


@query(f"WITH {_CASES}, {_CASE_ROWS} SELECT case_id, rank, CASE WHEN rank IS NULL THEN 0 ELSE round(1.0::DOUBLE / (rank + 1), 9) END AS rr, rank IS NOT NULL AS found, rank IS NOT NULL AND rank < 10 AS recalled FROM cs")
def eval_case(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("case_id", F.col("rank").cast("long").alias("rank"), F.round("rr", 9).alias("rr"), "found", "recalled")


@query(f"WITH {_CASES}, {_CASE_ROWS} SELECT round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (rank + 1) END), 9) AS mrr, round(avg(CASE WHEN rank < 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall, count(rank) AS found, count(*) AS cases FROM cs")
def eval_mrr(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(_cases(spark, d)).select(F.round("mrr", 9).alias("mrr"), F.round("recall", 9).alias("recall"), "found", "cases")


@query("""WITH a AS (SELECT vec_id AS id, vec_id % 101 AS rank FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT vec_id AS id, (vec_id * 5) % 103 AS rank FROM embeddings WHERE vec_id % 4 <> 0)
    SELECT coalesce(a.id, b.id) AS id, a.rank AS before, b.rank AS after, CASE WHEN b.id IS NULL THEN 'dropped' WHEN a.id IS NULL THEN 'added' WHEN b.rank < a.rank THEN 'better' WHEN b.rank > a.rank THEN 'worse' ELSE 'unchanged' END AS change FROM a FULL OUTER JOIN b ON a.id = b.id""")
def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    return evaluate.rank_changes(v.where("id % 3 <> 0").withColumn("rank", F.col("id") % 101), v.where("id % 4 <> 0").withColumn("rank", F.col("id") * 5 % 103))


@query("SELECT sum(c_acctbal) AS baseline_total, sum(c_nationkey) AS tool_total, round(avg(c_acctbal), 6) AS baseline_avg, round(avg(c_nationkey), 6) AS tool_avg, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS tool_wins, sum(CASE WHEN c_acctbal <= 0 THEN 1 ELSE 0 END)::BIGINT AS baseline_wins FROM customer".replace("sum(c_acctbal) AS", "round(sum(c_acctbal), 2) AS").replace("sum(c_nationkey) AS", "CAST(sum(c_nationkey) AS BIGINT) AS"))
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_acctbal").alias("baseline"), F.col("c_nationkey").alias("tool"), F.when(F.col("c_acctbal") > 0, "tool").otherwise("baseline").alias("winner"))
    c = evaluate.comparison(runs)
    return c.withColumns({"baseline_total": F.round("baseline_total", 2), "baseline_avg": F.round("baseline_avg", 6), "tool_avg": F.round("tool_avg", 6)})
