"""Vector kernels: JVM expressions for short vectors, numpy over Arrow for scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once a row, not at each element of a lambda that names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the null vector stays as it is."""
    unit = lambda v, n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return _once(a, lambda v: _once(l2_norm(v), lambda n: unit(v, n)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.transform(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), lambda d: d * d)))


def token_rows(a: Column, width: int) -> Column:
    """A flat vector cut into rows of width."""
    n = (F.size(a) / width).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, i * width + 1, width))


def quantize_int8(rows: Column) -> tuple[Column, Column]:
    """(rows of integers in -127..127, scale): scale is the largest absolute value, 1 for none; halves round up."""
    top = F.array_max(F.transform(F.flatten(rows), lambda x: F.abs(x.cast("double"))))
    scale = F.when(F.coalesce(top, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(top)
    whole = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x.cast("double") / scale * 127.0 + 0.5))).cast("int")
    return F.transform(rows, lambda r: F.transform(r, whole)), scale


def packed_int8(rows: Column) -> Column:
    """Rows of integers in -127..127 as bytes, row by row."""
    return F.unhex(F.array_join(F.transform(F.flatten(rows), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), ""))


def pooled(rows: Column, width: int) -> Column:
    """Mean of the rows, L2-normalised."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: _sum(F.transform(rows, lambda r: F.get(r, i).cast("double"))) / F.size(rows))
    return l2_normalize(mean)


def maxsim_native(query: Column, rows: Column) -> Column:
    """Sum over the query's rows of the greatest dot product with any row; 0 without rows."""
    best = lambda q: F.coalesce(F.array_max(F.transform(rows, lambda r: dot(q, r))), F.lit(0.0))
    return _sum(F.transform(query, best))


def maxsim(df: DataFrame, query: np.ndarray, tokens: str, scale: str, width: int, out: str = "maxsim", token_ids: str | None = None, skip: frozenset[int] = frozenset()) -> DataFrame:
    """df with the late-interaction score of its int8 token matrix (binary, row-major).

    Rows whose token id is in skip are left out when the ids match the rows. A null or
    empty matrix scores 0; a width that differs is cut to the smaller one.
    """
    q = np.atleast_2d(np.asarray(query, np.float32))
    names = df.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(names.index(token_ids)).to_pylist() if token_ids and skip else [None] * len(b)
            raws = [x.as_buffer() if x.is_valid else b"" for x in b.column(names.index(tokens))]
            parts = [np.frombuffer(x, np.int8)[: len(x) // width * width].reshape(-1, width) if len(x) else np.zeros((0, width), np.int8) for x in raws]
            parts = [m[[x not in skip for x in t]] if t is not None and len(t) == len(m) else m for m, t in zip(parts, ids)]
            res, size = np.zeros(len(b)), np.array([len(m) for m in parts], np.int64)
            full = np.flatnonzero(size)
            if len(full):  # one product for the batch, then the greatest by row
                w = min(width, q.shape[1])
                step = b.column(names.index(scale)).fill_null(1.0).to_numpy(zero_copy_only=False).astype(np.float32) / np.float32(127.0)
                all_ = np.concatenate(parts)[:, :w].astype(np.float32) * np.repeat(step, size)[:, None]
                res[full] = np.maximum.reduceat(q[:, :w] @ all_.T, (np.cumsum(size) - size)[full], axis=1).sum(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(res, pa.float64())], names=[*names, out])

    return df.mapInArrow(score, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double")


def nearest(df: DataFrame, id_col: str, vector: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(id, distance) of the k nearest rows, by distance then id; exact.

    A task keeps its k best over all its batches, so only k rows a task meet in the
    final top-k. Ids are numbers or strings. Null ids and vectors are left out; a vector
    of another length than the query's is an error.
    """
    q = np.asarray(query, np.float64)
    kind = df.schema[id_col].dataType.simpleString()
    kind = kind if kind == "string" else "bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best_d = None, np.zeros(0)
        for b in batches:
            v = b.column(1)
            if (pa.compute.list_value_length(v).to_numpy(zero_copy_only=False) != len(q)).any():
                raise ValueError(f"a vector hasn't the {len(q)} dimensions of the query")
            ids = b.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if kind == "string" else ids
            m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            if metric == "l2":
                d = np.sqrt(((m - q) ** 2).sum(1))
            else:
                norm = np.sqrt((m**2).sum(1)) * np.sqrt((q**2).sum())
                d = 1 - (m @ q) / np.where(norm == 0, 1, norm)
            ids, d = (ids, d) if best_ids is None else (np.concatenate([best_ids, ids]), np.concatenate([best_d, d]))
            best = np.lexsort((ids, d))[:k]
            best_ids, best_d = ids[best], d[best]
        if best_ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best_ids.tolist(), pa.string() if kind == "string" else pa.int64()), pa.array(best_d)], names=["id", "distance"])

    rows = df.select(F.col(id_col).cast(kind), F.col(vector).cast("array<double>")).where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    return rows.mapInArrow(scan, f"id {kind}, distance double").orderBy("distance", "id").limit(k)


#: Query vectors that one scan serves, and the most tasks that scan for many queries: each brings k rows a query to the final top-k.
QUERIES_A_SCAN, PARTS = 1024, 64


def best_of(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The best k rows of each value of by, of PARTS times k at most."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def nearest_many(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): nearest()'s k nearest rows for every row of queries(query_id, vector); exact, by L2.

    The query vectors go to the tasks in blocks of QUERIES_A_SCAN, each served by one
    scan: a batch's product with all of them bounds the distances, and only rows that may
    be among a query's best have theirs computed exactly. Null vectors, on either side,
    are left out; a vector of another length is an error.
    """
    kind = "string" if df.schema[id_col].dataType.simpleString() == "string" else "bigint"
    query_kind = "string" if queries.schema["query_id"].dataType.simpleString() == "string" else "bigint"
    rows = df.select(F.col(id_col).cast(kind), F.col(vector).cast("array<double>")).where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).coalesce(PARTS)
    schema = f"query_id {query_kind}, id {kind}, distance double"

    def block(ids: list, q: np.ndarray) -> DataFrame:
        norms = (q**2).sum(1)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q)
            for b in batches:
                if not len(b):
                    continue
                if (pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False) != q.shape[1]).any():
                    raise ValueError(f"a vector hasn't the {q.shape[1]} dimensions of the queries")
                own = b.column(0).to_numpy(zero_copy_only=False)
                own = own.astype(str) if kind == "string" else own
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                size = (m**2).sum(1)
                square = size[:, None] + norms - 2 * (m @ q.T)
                # what rounding may have done to the squares
                slack = 1e-9 * (float(size.max()) + norms)
                for j in range(len(q)):
                    col = square[:, j]
                    most = np.partition(col, k - 1)[k - 1] if len(col) > k else np.inf
                    if best[j] is not None and len(best[j][1]) == k:
                        most = min(most, best[j][1][-1] ** 2)
                    some = np.flatnonzero(col <= most + 2 * slack[j])
                    if not len(some):
                        continue
                    d, ids_ = np.sqrt(((m[some] - q[j]) ** 2).sum(1)), own[some]
                    if best[j] is not None:
                        ids_, d = np.concatenate([best[j][0], ids_]), np.concatenate([best[j][1], d])
                    first = np.lexsort((ids_, d))[:k]
                    best[j] = ids_[first], d[first]
            full = [(i, x) for i, x in zip(ids, best) if x is not None]
            if full:
                cols = [[i for i, x in full for _ in x[1]], [v for _, x in full for v in x[0].tolist()], [v for _, x in full for v in x[1].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string() if query_kind == "string" else pa.int64()), pa.array(cols[1], pa.string() if kind == "string" else pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "distance"])

        return rows.mapInArrow(scan, schema)

    out, ids, some = None, [], []

    def close(out: DataFrame | None) -> DataFrame:
        made = block(list(ids), np.array(some, np.float64))
        ids.clear(), some.clear()
        return made if out is None else out.unionByName(made)

    for r in queries.select(F.col("query_id").cast(query_kind), F.col("vector").cast("array<double>")).where("vector is not null").toLocalIterator():
        if some and len(r[1]) != len(some[0]):
            raise ValueError("the queries' vectors differ in length")
        ids.append(r[0]), some.append(list(r[1]))
        if len(some) == QUERIES_A_SCAN:
            out = close(out)
    out = close(out) if some else out
    if out is None:
        return df.sparkSession.createDataFrame([], schema)
    return best_of(out, ["query_id"], [F.asc("distance"), F.asc("id")], k)
