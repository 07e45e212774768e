"""The driver's tables seen as a code corpus, in Spark and in SQL.

Documents are files, their line windows are chunks; symbols, roles and kinds are
cut from the text and the id so that every branch of the operators is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import chunking, ranking


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    path = F.concat(F.when(i % 7 == 0, "src/tests/").otherwise("src/"), "lang", F.lit("/"), "source", F.lit("/"), i.cast("string"), F.when(i % 3 == 0, ".ts").when(i % 3 == 1, ".py").otherwise(".md"))
    return d.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with symbol arrays, role, kind, parent, complexity and flags."""
    t, i = ranking.tokens(F.col("content")), F.col("doc_id")
    return files(spark, sf_dir).select(
        "doc_id", "path", "content", F.slice(t, 1, 3).alias("defined_symbols"), F.slice(t, F.lit(4), (i % 20).cast("int")).alias("referenced_symbols"),
        F.when(i % 5 == 0, "DEFINITION").when(i % 5 == 1, "ORCHESTRATION").when(i % 5 == 2, "IMPLEMENTATION").when(i % 5 == 3, "DOCS").alias("role"),
        F.when(i % 4 == 0, "function").when(i % 4 == 1, "class").when(i % 4 == 2, "block").otherwise("method").alias("chunk_type"),
        F.concat(F.lit("p"), (i % 6).cast("string")).alias("parent_symbol"), (i % 9).cast("double").alias("complexity"), (i % 2 == 0).alias("is_exported"), (i % 11 == 0).alias("is_anchor"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of the files with a number as id, and the vector whose number is the file's on its first chunk."""
    rows = symbolic(spark, sf_dir)
    keep = [c for c in rows.columns if c != "content"]
    made = chunking.explode_pieces(rows, chunking.line_pieces(F.col("content")), keep)
    return made.withColumn("id", F.col("doc_id") * 1000 + F.col("chunk_index"))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """with_vectors' rows that have a vector, without their texts: id, vector."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"))
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").join(d, "vec_id", "left_semi")
    return v.select((F.col("vec_id") * 1000).alias("id"), F.col("embedding").alias("vector"))


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") * 1000).alias("id"), F.col("embedding").alias("vector"))
    return chunks(spark, sf_dir).join(v, "id", "left")


def tokens_of(spark: SparkSession, sf_dir: str, few: DataFrame) -> DataFrame:
    """chunks() of few(id), at most a few hundred, and each one's vector as 4 tokens of 16: int8 matrix, scale and pooled vector."""
    m = vectors.token_rows(F.col("embedding"), 16)
    rows, scale = vectors.quantize_int8(m)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("id", F.col("vec_id") * 1000).join(F.broadcast(few), "id", "left_semi")
    v = v.select("id", vectors.packed_int8(rows).alias("colbert"), scale.alias("colbert_scale"), vectors.pooled(m, 16).alias("pooled"))
    return chunks(spark, sf_dir).join(F.broadcast(few), "id", "left_semi").join(v, "id", "left")


FILES = """files AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'src/tests/' ELSE 'src/' END || lang || '/' || source || '/' || doc_id ||
    CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.md' END AS path, coalesce(text, '') AS content FROM documents)"""
SYMBOLIC = (
    FILES
    + r""", tok AS (SELECT *, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM files),
    symbolic AS (SELECT doc_id, path, content, t[1:3] AS defined_symbols, CASE WHEN doc_id % 20 = 0 THEN [] ELSE t[4:3 + doc_id % 20] END AS referenced_symbols,
      CASE doc_id % 5 WHEN 0 THEN 'DEFINITION' WHEN 1 THEN 'ORCHESTRATION' WHEN 2 THEN 'IMPLEMENTATION' WHEN 3 THEN 'DOCS' END AS role,
      CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'block' ELSE 'method' END AS chunk_type,
      'p' || doc_id % 6 AS parent_symbol, CAST(doc_id % 9 AS DOUBLE) AS complexity, doc_id % 2 = 0 AS is_exported, doc_id % 11 = 0 AS is_anchor FROM tok)"""
)
CHUNKS = (
    SYMBOLIC
    + """, lns AS (SELECT *, string_split(content, chr(10)) AS l FROM symbolic),
    starts AS (SELECT *, unnest(range(0, len(l), 65)) AS i FROM lns),
    chunks AS (SELECT * EXCLUDE (content, l, i), CAST(i / 65 AS INTEGER) AS chunk_index, array_to_string(l[i + 1:i + 75], chr(10)) AS content, CAST(i AS INTEGER) AS start_line,
      CAST(least(i + 75, len(l)) - 1 AS INTEGER) AS end_line, doc_id * 1000 + CAST(i / 65 AS INTEGER) AS id FROM starts)"""
).replace("i / 65", "i // 65")
