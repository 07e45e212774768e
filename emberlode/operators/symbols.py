"""An inverted table of symbols, so that a definition or a call is found without a scan.

A row says that a chunk defines or references a symbol. Rows lie in folders by a hash
of the symbol and are sorted by it, so one symbol's are a few pages of one folder; a
symbol that very many chunks have fills several files of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "segment string, symbol string, kind string, doc long, path string, start_line int, n int"


def symbol_bucket(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def entries(chunks: DataFrame) -> DataFrame:
    """ENTRIES of chunks(segment, doc, path, start_line, defined_symbols, referenced_symbols): a row per chunk, kind (def, ref) and symbol, with how often."""
    rows = lambda column, kind: chunks.select("segment", "doc", "path", "start_line", F.lit(kind).alias("kind"), F.explode(column).alias("symbol"))
    every = rows("defined_symbols", "def").unionByName(rows("referenced_symbols", "ref"))
    return every.groupBy("segment", "symbol", "kind", "doc", "path", "start_line").agg(F.count(F.lit(1)).cast("int").alias("n"))


def write(made: DataFrame, where: str, tasks: int, buckets: int) -> None:
    rows = made.withColumn("bucket", symbol_bucket(F.col("symbol"), buckets))
    rows.repartitionByRange(tasks, "bucket", "symbol", "kind", "path", "start_line").sortWithinPartitions("bucket", "symbol", "kind", "path", "start_line").write.option("compression", "zstd").partitionBy("bucket").parquet(where)


def having(made: DataFrame, symbol: str, kind: str) -> DataFrame:
    """ENTRIES of one symbol and kind (def, ref)."""
    return made.where((F.col("symbol") == symbol) & (F.col("kind") == kind))


def inventory(made: DataFrame, pattern: str | None = None, path_prefix: str | None = None, limit: int | None = 20) -> DataFrame:
    """graph.symbols from the entries: symbol, n, path and line of the first."""
    from ..functions.paths import under

    e = made.where("kind = 'def'")
    e = e.where(under(F.col("path"), path_prefix)) if path_prefix else e
    e = e.where(F.contains(F.lower("symbol"), F.lit(pattern.lower()))) if pattern else e
    out = e.groupBy("symbol").agg(F.sum("n").alias("n"), F.min(F.struct("path", F.col("start_line").alias("line"))).alias("at")).select("symbol", "n", "at.path", "at.line").orderBy(F.desc("n"), "symbol")
    return out.limit(limit) if limit else out
