"""Exact nearest neighbours with pruning: cells around pivots, skipped by the triangle inequality.

Each vector belongs to the cell of its nearest pivot, and a cell knows the least and
the greatest distance of its vectors from the pivot. A query's distance from the pivot
then bounds its distance from all of them, so a cell that can't hold one of the k
nearest isn't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors


#: Vectors that are looked at for each pivot that is picked.
LOOKED_AT = 16


def pick(df: DataFrame, id_col: str, vector: str, n: int) -> np.ndarray:
    """n pivots, each the farthest from those before, among the LOOKED_AT * n vectors whose ids have the least hashes: the same at every run, and a bound of what the driver holds."""
    rows = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(LOOKED_AT * n).select(F.col(vector).cast("array<double>")).collect()
    if not rows:
        return np.zeros((0, 0))
    v = np.array([r[0] for r in rows], np.float64)
    some, away = [0], np.sqrt(((v - v[0]) ** 2).sum(1))
    while len(some) < n and away.max() > 0:
        some.append(int(away.argmax()))
        away = np.minimum(away, np.sqrt(((v - v[some[-1]]) ** 2).sum(1)))
    return v[some]


def celled(df: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """df with cell (the nearest pivot, the first of equals) and radius (the distance from it); null vectors have none of either."""
    names = df.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots**2).sum(1)
        for b in batches:
            v = b.column(names.index(vector))
            full = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            cell, radius = np.zeros(len(b), np.int32), np.zeros(len(b))
            if len(full):
                flat = v.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) != len(full) * pivots.shape[1]:
                    raise ValueError(f"a vector hasn't the {pivots.shape[1]} dimensions of the pivots")
                m = flat.reshape(len(full), -1)
                cell[full] = (norms - 2 * (m @ pivots.T)).argmin(1)
                radius[full] = np.sqrt(((m - pivots[cell[full]]) ** 2).sum(1))
            none = np.ones(len(b), bool)
            none[full] = False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32(), mask=none), pa.array(radius, pa.float64(), mask=none)], names=[*names, "cell", "radius"])

    return df.mapInArrow(assign, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, cell int, radius double")


def cells(rows: DataFrame) -> DataFrame:
    """cell, n, least, most of celled rows: one row a pivot at most."""
    return rows.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))


def nearest(rows: DataFrame, known: DataFrame, pivots: np.ndarray, id_col: str, vector: str, query: list[float], k: int) -> tuple[DataFrame, dict[str, int]]:
    """(vectors.nearest's k nearest by L2, counts) of celled rows; known: their cells().

    Cells are read by rising lower bound until they hold k rows; the k-th distance among
    these tells which others can still matter, and those are read. Rows stored in folders
    by cell are pruned by them. Counts: rows, read.
    """
    q = np.asarray(query, np.float64)
    # a row a pivot
    there = known.collect()
    if not there:
        return vectors.nearest(rows, id_col, vector, query, k), {"rows": 0, "read": 0}
    away = np.sqrt(((pivots[[r["cell"] for r in there]] - q) ** 2).sum(1))
    # distances are rounded: bounds are a hair wider
    low = np.maximum(0, np.maximum(away - [r["most"] for r in there], np.array([r["least"] for r in there]) - away)) * (1 - 1e-9) - 1e-9
    order = np.argsort(low, kind="stable")
    enough = int(np.searchsorted(np.cumsum([there[i]["n"] for i in order]), k)) + 1
    some = lambda which: rows.where(F.col("cell").isin([there[i]["cell"] for i in which]))
    near = vectors.nearest(some(order[:enough]), id_col, vector, query, k)
    last = near.agg(F.max("distance").alias("distance"), F.count(F.lit(1)).alias("n")).first()
    first = set(order[:enough].tolist())
    needed = [i for i in range(len(there)) if i in first or last["n"] < k or low[i] <= last["distance"]]
    counts = {"rows": sum(r["n"] for r in there), "read": sum(there[i]["n"] for i in needed)}
    return vectors.nearest(some(needed), id_col, vector, query, k), counts
