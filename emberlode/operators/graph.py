"""Symbols and one-hop calls over chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = ("symbol", "path", "line", "role", "calls", "complexity")


def symbols(chunks: DataFrame, pattern: str | None = None, path_prefix: str | None = None, limit: int | None = 20) -> DataFrame:
    """symbol, n, path and line of its first row: by falling count, then symbol.

    One aggregation with map-side combining; the first row is the least of (path, line).
    """
    from ..functions.paths import under

    rows = chunks.where(under(F.col("path"), path_prefix)) if path_prefix else chunks
    e = rows.select(F.explode("defined_symbols").alias("symbol"), F.struct("path", F.col("start_line").alias("line")).alias("at"))
    if pattern:
        e = e.where(F.contains(F.lower("symbol"), F.lit(pattern.lower())))
    out = e.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).select("symbol", "n", "at.path", "at.line").orderBy(F.desc("n"), "symbol")
    return out.limit(limit) if limit else out


def _nodes(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.try_element_at("defined_symbols", F.lit(1)), F.lit("")), F.nullif(F.col("parent_symbol"), F.lit("")), F.lit("unknown"))
    return rows.select(
        name.alias("symbol"), "path", F.col("start_line").alias("line"), F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("IMPLEMENTATION")).alias("role"),
        F.coalesce("referenced_symbols", F.array().cast("array<string>")).alias("calls"), F.coalesce("complexity", F.lit(0.0)).alias("complexity"),
    )


def callers(chunks: DataFrame, symbol: str, limit: int = 100) -> DataFrame:
    """Nodes whose references hold the symbol, ordered by path and line."""
    return _nodes(chunks.where(F.array_contains("referenced_symbols", symbol)).orderBy("path", "start_line").limit(limit))


def center(chunks: DataFrame, symbol: str) -> DataFrame:
    """The first node that defines the symbol, by path and line."""
    return _nodes(chunks.where(F.array_contains("defined_symbols", symbol)).orderBy("path", "start_line").limit(1)).withColumn("symbol", F.lit(symbol))


def callees(chunks: DataFrame, symbol: str) -> DataFrame:
    """position, callee: what the center references, repeats kept."""
    return center(chunks, symbol).select(F.posexplode("calls").alias("position", "callee"))


def one_hop(chunks: DataFrame, symbol: str) -> DataFrame:
    """kind (caller, center, callee), symbol, path, line."""
    return hops(callers(chunks, symbol), center(chunks, symbol))


def hops(up: DataFrame, c: DataFrame) -> DataFrame:
    """One table of callers, a center and what it calls."""
    some = lambda df, kind: df.select(F.lit(kind).alias("kind"), "symbol", "path", "line")
    down = c.select(F.explode("calls").alias("symbol")).select("symbol", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"))
    return some(up, "caller").unionByName(some(c, "center")).unionByName(some(down, "callee"))


def trace_text(rows: DataFrame) -> str:
    """A one-hop result (at most a few hundred rows) as text."""
    by: dict[str, list] = {"caller": [], "center": [], "callee": []}
    for r in rows.collect():
        by[r["kind"]].append(r)
    place = lambda r: f"{r['symbol']}  {r['path']}:{r['line'] + 1}" if r["path"] else r["symbol"]
    if not by["center"]:
        return "symbol not found"
    return "\n".join(["callers:", *[f"  {place(r)}" for r in by["caller"]], "symbol:", *[f"  {place(r)}" for r in by["center"]], "calls:", *[f"  {place(r)}" for r in by["callee"]]])
