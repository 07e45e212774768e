"""Retrieval quality: rank of the first expected path, MRR, Recall@k, rank changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cases(hits: DataFrame, expected: DataFrame, recall_at: int = 10) -> DataFrame:
    """case_id, rank, rr, found, recalled for each of expected(case_id, expected, avoid).

    hits(case_id, path, rank from 0). expected holds alternatives between bars; each is
    a part of a path, whatever its case. A path to avoid that ranks before the first
    expected one, or with none expected found, makes a miss.
    """
    j = expected.join(hits, "case_id", "left")
    has = lambda names: F.exists(F.split(F.lower(names), r"\|", -1), lambda x: (F.trim(x) != "") & F.contains(F.lower("path"), F.trim(x)))
    first = F.min(F.when(F.coalesce(has(F.col("expected")), F.lit(False)), F.col("rank")))
    bad = F.min(F.when(F.coalesce(has(F.col("avoid")), F.lit(False)), F.col("rank")))
    g = j.groupBy("case_id").agg(first.alias("_r"), bad.alias("_b"))
    ok = F.col("_r").isNotNull() & (F.col("_b").isNull() | (F.col("_b") > F.col("_r")))
    return g.select("case_id", F.when(ok, F.col("_r")).alias("rank"), F.when(ok, F.lit(1.0) / (F.col("_r") + 1)).otherwise(0.0).alias("rr"), ok.alias("found"), (ok & (F.coalesce("_r", F.lit(0)) < recall_at)).alias("recalled"))


def summary(case_rows: DataFrame) -> DataFrame:
    return case_rows.agg(F.avg("rr").alias("mrr"), F.avg(F.col("recalled").cast("double")).alias("recall"), F.count_if("found").alias("found"), F.count(F.lit(1)).alias("cases"))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, before, after, change (better, worse, unchanged, dropped, added) of two (id, rank) lists."""
    j = before.select("id", F.col("rank").alias("before")).join(after.select("id", F.col("rank").alias("after")), "id", "full_outer")
    kind = F.when(F.col("after").isNull(), "dropped").when(F.col("before").isNull(), "added").when(F.col("after") < F.col("before"), "better").when(F.col("after") > F.col("before"), "worse").otherwise("unchanged")
    return j.withColumn("change", kind)


def comparison(runs: DataFrame) -> DataFrame:
    """Totals, averages and wins of runs(baseline, tool, winner)."""
    return runs.agg(F.sum("baseline").alias("baseline_total"), F.sum("tool").alias("tool_total"), F.avg("baseline").alias("baseline_avg"), F.avg("tool").alias("tool_avg"), F.count_if(F.col("winner") == "tool").alias("tool_wins"), F.count_if(F.col("winner") == "baseline").alias("baseline_wins"))
