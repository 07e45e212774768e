"""Queries over text: chunking, paths, display, skeleton text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import chunking, code, index, present
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {fx.CHUNKS} SELECT path, chunk_index, content, start_line, end_line FROM chunks")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.explode_pieces(fx.files(spark, d), chunking.line_pieces(F.col("content")), ["path"])


_CHARS = """chars AS (SELECT path, content, unnest(range(0, length(content), 1800)) AS i FROM files),
    pieces AS (SELECT path, i, substring(content, i + 1, 2000) AS c, length(substring(content, 1, i)) - length(replace(substring(content, 1, i), chr(10), '')) AS before FROM chars),
    kept AS (SELECT * FROM pieces WHERE regexp_matches(c, '\\S'))""".replace("\\\\", "\\")


@query(f"WITH {fx.FILES}, {_CHARS} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INTEGER) AS chunk_index, c AS content, CAST(before AS INTEGER) AS start_line, CAST(before + length(c) - length(replace(c, chr(10), '')) AS INTEGER) AS end_line FROM kept")
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return chunking.explode_pieces(fx.files(spark, d), chunking.char_pieces(F.col("content"), F.lit(0)), ["path"])


@query(f"""WITH {fx.FILES}, {_CHARS}, n AS (SELECT path, content, len(string_split(content, chr(10))) AS nl, length(content) AS nc FROM files),
    small AS (SELECT path, content, 0 AS s, nl - 1 AS e, 0 AS a, 0 AS b FROM n WHERE nl <= 75 AND nc <= 2000),
    long AS (SELECT k.path, c AS content, before AS s, before + length(c) - length(replace(c, chr(10), '')) AS e, i AS a, 0 AS b FROM kept k JOIN n USING (path) WHERE nl <= 75 AND nc > 2000),
    tall AS (SELECT path, nl, string_split(content, chr(10)) AS l, unnest(range(0, nl, 65)) AS i FROM n WHERE nl > 75),
    win AS (SELECT path, i, array_to_string(l[i + 1:i + 75], chr(10)) AS c, least(i + 75, nl) - 1 AS e FROM tall WHERE i = 0 OR least(i + 75, nl) - i >= 3),
    wide AS (SELECT path, i, c, unnest(range(0, length(c), 1800)) AS j FROM win WHERE length(c) > 2000),
    cut AS (SELECT path, i, j, substring(c, j + 1, 2000) AS p, i + length(substring(c, 1, j)) - length(replace(substring(c, 1, j), chr(10), '')) AS s FROM wide),
    rows AS (SELECT * FROM small UNION ALL SELECT * FROM long UNION ALL SELECT path, c, i, e, i, 0 FROM win WHERE length(c) <= 2000
             UNION ALL SELECT path, p, s, s + length(p) - length(replace(p, chr(10), '')), i, j FROM cut WHERE regexp_matches(p, '\\S'))
    SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY a, b) - 1 AS INTEGER) AS chunk_index, content, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line,
           CASE WHEN path LIKE '%.md' THEN 'DOCS' END AS role FROM rows""")
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.explode_pieces(fx.files(spark, d), chunking.split_pieces(F.col("content")), ["path"])
    return out.withColumn("role", index.doc_role(F.col("path"), F.lit(None).cast("string")))


@query(f"""WITH {fx.SYMBOLIC}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM symbolic),
    f AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE regexp_matches(x, '\\S')),
    p AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS pre, max(i) AS last FROM f WHERE n <= 30 AND before < 1200 GROUP BY doc_id)
    SELECT s.path, array_to_string(list_filter(['File: ' || s.path, CASE WHEN len(referenced_symbols) > 0 THEN 'Imports: ' || array_to_string(referenced_symbols, ', ') END,
      CASE WHEN len(defined_symbols) > 0 THEN 'Exports: ' || array_to_string(defined_symbols, ', ') END, 'Preamble:' || chr(10) || p.pre, '---', '(anchor)'], lambda z: z IS NOT NULL), chr(10) || chr(10)) AS content,
      CAST(coalesce(p.last, 0) AS INTEGER) AS end_line, -1 AS chunk_index, true AS is_anchor FROM symbolic s LEFT JOIN p USING (doc_id)""")
def anchor_chunk(spark: SparkSession, d: str) -> DataFrame:
    a = chunking.anchor(F.col("path"), F.col("content"), F.col("referenced_symbols"), F.col("defined_symbols"), F.array().cast("array<string>"))
    return fx.symbolic(spark, d).select("path", a.alias("a")).select("path", "a.content", "a.end_line", F.lit(-1).alias("chunk_index"), F.lit(True).alias("is_anchor"))


@query(f"""WITH {fx.CHUNKS} SELECT id, '// ' || path || chr(10) || CASE WHEN len(referenced_symbols) > 0 THEN array_to_string(list_transform(referenced_symbols, lambda r: CASE WHEN starts_with(r, 'import') THEN r ELSE 'import ' || r END), chr(10)) || chr(10) ELSE '' END
    || 'File: ' || path || ' > Symbol: ' || parent_symbol || chr(10) || content || CASE WHEN role IS NULL THEN '' ELSE chr(10) || role END AS display_text FROM chunks""")
def format_chunk(spark: SparkSession, d: str) -> DataFrame:
    crumbs = F.array(F.concat(F.lit("Symbol: "), F.col("parent_symbol")))
    return fx.chunks(spark, d).select("id", chunking.display_text(F.col("path"), F.col("referenced_symbols"), crumbs, F.col("content"), F.coalesce("role", F.lit(""))).alias("display_text"))


@query(f"WITH {fx.CHUNKS} SELECT id, coalesce((SELECT p.content FROM chunks p WHERE p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index - 1), '') AS context_prev, coalesce((SELECT p.content FROM chunks p WHERE p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index + 1), '') AS context_next FROM chunks c")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return index.neighbours(fx.chunks(spark, d), "content").select("id", "context_prev", "context_next")


@query(f"""WITH {fx.CHUNKS}, b AS (SELECT id, string_split(content, chr(10)) AS l FROM chunks),
    x AS (SELECT id, l, [i for i in range(1, len(l) + 1) if regexp_matches(l[i], '[^ \\t\\r]') AND NOT regexp_matches(l[i], '^[ \\t\\r]*(File:|Imports:|Exports:|//|---[ \\t\\r]*$|[(]anchor[)][ \\t\\r]*$|from )')] AS ok FROM b),
    y AS (SELECT id, l[coalesce(ok[1], 1):] AS r FROM x)
    SELECT id, regexp_replace(array_to_string(r[1:15], chr(10)) || CASE WHEN len(r) > 15 THEN chr(10) || '... (+' || (len(r) - 15) || ' more lines)' ELSE '' END, '^\\s+|\\s+$', '', 'g') AS text FROM y""")
def hit_snippet(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).select("id", chunking.snippet(F.col("content")).alias("text"))


@query(f"WITH {fx.FILES} SELECT path, sha256(content) AS hash FROM files")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return fx.files(spark, d).select("path", F.sha2("content", 256).alias("hash"))


@query(f"WITH {fx.FILES} SELECT path, strlen(content) AS size FROM files WHERE doc_id % 3 IN (0, 1, 2) AND strlen(content) > 0 AND strlen(content) <= 2097152")
def indexable_filter(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"))
    odd = f.select(F.concat("path", F.lit(".exe")).alias("path"), "size")
    return f.unionByName(odd).where(paths.indexable(F.col("path"), F.col("size")))


@query("SELECT doc_id, 'd/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.JSON' ELSE '.ts' END AS path FROM documents WHERE NOT (doc_id % 2 = 0 AND length(repeat(text, 10)) > 102400)")
def large_data_skip(spark: SparkSession, d: str) -> DataFrame:
    f = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".JSON").otherwise(".ts")).alias("path"), F.repeat("text", F.lit(10)).alias("content"))
    return f.where(~paths.is_large_data(F.col("path"), F.col("content"))).select("doc_id", "path")


@query(f"WITH {fx.FILES} SELECT path, CASE doc_id % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'markdown' END AS lang, CASE doc_id % 3 WHEN 1 THEN '#' ELSE '//' END AS comment FROM files")
def lang_by_ext(spark: SparkSession, d: str) -> DataFrame:
    lang = paths.language(F.col("path"))
    return fx.files(spark, d).select("path", lang.alias("lang"), paths.comment_prefix(lang).alias("comment"))


@query(f"WITH {fx.CHUNKS} SELECT path, content FROM chunks WHERE is_anchor AND path IN (SELECT min(path) FROM chunks WHERE is_anchor) ORDER BY start_line LIMIT 1")
def anchor_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = fx.chunks(spark, d).where("is_anchor")
    return a.orderBy("path", "start_line").limit(1).select("path", "content")


@query(f"""WITH {fx.SYMBOLIC} SELECT doc_id, CASE WHEN chunk_type <> 'block' THEN CASE WHEN complexity > 5 AND len(referenced_symbols) > 5 THEN 'ORCHESTRATION' ELSE 'DEFINITION' END WHEN doc_id % 6 = 0 THEN 'IMPORT' END AS role,
    regexp_replace(['Class: ', 'Method: ', 'Symbol: '][1 + doc_id % 3] || parent_symbol, '^(Class|Method|Function|Interface|Type): ', '') AS parent FROM symbolic""")
def role_classify(spark: SparkSession, d: str) -> DataFrame:
    node = F.when(F.col("doc_id") % 6 == 0, "import_statement").otherwise("expression")
    label = F.concat(F.element_at(F.array(F.lit("Class: "), F.lit("Method: "), F.lit("Symbol: ")), (F.col("doc_id") % 3 + 1).cast("int")), "parent_symbol")
    return fx.symbolic(spark, d).select("doc_id", code.role(F.col("chunk_type"), F.col("complexity"), F.col("referenced_symbols"), node).alias("role"), F.regexp_replace(label, r"^(Class|Method|Function|Interface|Type): ", "").alias("parent"))


@query(f"""WITH {fx.SYMBOLIC}, p AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN '#' ELSE '//' END AS c, list_filter([CASE WHEN len(referenced_symbols) > 0 THEN '→ ' || array_to_string(referenced_symbols[1:4], ', ') || CASE WHEN len(referenced_symbols) > 4 THEN ', ...' ELSE '' END END,
      CASE WHEN complexity > 1 THEN 'C:' || CAST(complexity AS INTEGER) END, CASE WHEN role = 'ORCHESTRATION' THEN 'ORCH' END], lambda x: x IS NOT NULL) AS parts FROM symbolic)
    SELECT doc_id, c || ' ' || CASE WHEN len(parts) = 0 THEN '...' ELSE array_to_string(parts, ' | ') END AS summary FROM p""")
def skeleton_summary(spark: SparkSession, d: str) -> DataFrame:
    prefix = paths.comment_prefix(paths.language(F.col("path")))
    return fx.symbolic(spark, d).select("doc_id", code.summary(F.col("referenced_symbols"), F.col("complexity"), F.coalesce("role", F.lit("")), prefix).alias("summary"))


@query(f"""WITH {fx.FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files),
    s AS (SELECT path, '// Skeleton unavailable: no parser' || chr(10) || '// File: ' || path || chr(10) || '// Showing first ' || least(30, len(l)) || ' lines' || CASE WHEN len(l) > 30 THEN ' (truncated)' ELSE '' END || chr(10) || chr(10) || array_to_string(l[1:30], chr(10))
      || CASE WHEN len(l) > 30 THEN chr(10) || chr(10) || '// ... ' || (len(l) - 30) || ' more lines' ELSE '' END AS skeleton FROM l)
    SELECT path, skeleton, CAST(ceil(length(skeleton) / 4.0) AS BIGINT) AS tokens FROM s""")
def skeleton_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = fx.files(spark, d).select("path", code.preview(F.col("path"), F.col("content"), F.lit("no parser")).alias("skeleton"))
    return s.withColumn("tokens", code.token_estimate(F.col("skeleton")))


@query(f"""WITH {fx.CHUNKS}, l AS (SELECT id, list_transform(string_split(content || chr(10) || '  x  File: y', chr(10)), lambda x: regexp_replace(regexp_replace(x, 'File:.*$', ''), '\\s+$', '')) AS l FROM chunks),
    k AS (SELECT id, list_filter(l, lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*(File:|Top comments:|Preamble:|[(]anchor[)]|Imports:|Exports:|---)')) AS k FROM l)
    SELECT id, list_transform(k, lambda x: CASE WHEN length(x) > 140 THEN substring(x, 1, 140) || ' ...' ELSE x END) AS lines FROM k""")
def clean_snippet(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).select("id", present.clean_lines(F.concat("content", F.lit("\n  x  File: y"))).alias("lines"))


@query(f"WITH {fx.CHUNKS} SELECT DISTINCT path FROM chunks")
def compact_paths(spark: SparkSession, d: str) -> DataFrame:
    return present.paths(fx.chunks(spark, d))
