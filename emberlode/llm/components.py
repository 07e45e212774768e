"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Rounds


#: Edges that one task may hold; more go by rounds of stars.
SMALL = 1 << 18


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the edges and the least end that it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, least[end], low)
        new = new[new]
        if (new == least).all():
            return ids, ids[least]
        least = new


def _in_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        ids, least = _stars(*(np.concatenate(x) for x in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["id", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: Rounds, most: int = 50) -> DataFrame:
    """edges(u, v) -> (id, component) for every end, component the least id reachable.

    Each round aggregates by node and joins the result back; a node of many edges
    is pre-aggregated and its join can be split. Each round is written and the one
    before it dropped. Up to SMALL edges, counted first, are settled by one task.
    """
    e = rounds.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = _state(e)
    if before[0] <= SMALL:
        out = rounds.put(e.coalesce(1).mapInArrow(_in_a_task, "id long, component long"))
        rounds.drop(e)
        return out
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: smaller neighbours and the node itself go to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e, old = rounds.put(small.where("u > v").distinct()), e
        rounds.drop(old)
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # stars now: every end but a root stands once as u
    return rounds.put(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
