"""Fitting on a bounded sample of labelled rows, in one task, and scoring by the model.

The bound is the parameter train_rows: ids are taken in the order of their hash, and of
rows that share an id the one whose text has the least hash, so the sample is the same
however the tables are partitioned. Rows
whose crc32(doc_id as text) is divisible by 5 are never learnt.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Rounds, doc_blocks, in_holdout, text_buffer

#: rows -> one score a row
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]
SAMPLE = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("f", pa.binary())])


def fitted(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, features: Callable[[np.ndarray, np.ndarray], list[bytes]], fit: Callable[[np.ndarray, list[bytes]], Scorer], min_rows: int = 1, always: np.ndarray | None = None) -> Scorer:
    """The model that fit makes of the labels and features of at most train_rows rows, ordered by id.

    A document labelled more than once takes its largest label; null labels and
    ids are left out. Of rows that share an id one is learnt, so there are never more rows
    than ids. features: bytes and offsets of a block of texts -> one
    value a text, made on the executors. With min_rows over 1 a value is a set of
    64-bit hashes; those of fewer rows are counted out on the executors, but for
    the hashes in always. The sample is bounded, so one task holds it; the driver
    gets the model alone.
    """
    rounds = Rounds(docs.sparkSession)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & ~in_holdout("doc_id"))
    ids = ids.groupBy("doc_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    # an id's rows meet as the least of each task
    rows = rows.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("doc_id", "r.text", "_y")

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffer(b.column(1))
            out = [x for i, j in doc_blocks(off) for x in features(raw[off[i] : off[j]], off[i : j + 1] - off[i])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])

    made = rounds.put(rows.mapInArrow(feats, "doc_id long, y int, f binary"))
    known = None
    if min_rows > 1:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(0))]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["k", "n"])

        often = made.select("f").mapInArrow(each, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows).select("k").toArrow()
        known = np.union1d(often["k"].to_numpy().view(np.uint64), always if always is not None else np.zeros(0, np.uint64))

        def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = (np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(2))
                out = [x[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x].tobytes() if len(known) else b"" for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])

        sampled = made.mapInArrow(fewer, "doc_id long, y int, f binary")
    else:
        sampled = made

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), SAMPLE).sort_by([("doc_id", "ascending")])
        model = fit(np.array(got["y"].to_numpy(), np.int64), [x.as_py() or b"" for x in got["f"]])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    model = pickle.loads(sampled.coalesce(1).mapInArrow(learn, "model binary").toArrow()["model"][0].as_py()) if not sampled.isEmpty() else fit(np.zeros(0, np.int64), [])
    rounds.drop(made)
    return model


def scores(raw: np.ndarray, off: np.ndarray, score: Scorer) -> np.ndarray:
    """Scores of all rows of a buffer, block by block."""
    parts = [score(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in doc_blocks(off)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_table(docs: DataFrame, score: Scorer, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(*text_buffer(b.column(1)), score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(in_holdout("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def filter_table(docs: DataFrame, score: Scorer, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs whose score passes keep, with all their columns."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(scores(*text_buffer(b.column(at)), score))))

    return docs.mapInArrow(rows, docs.schema)
