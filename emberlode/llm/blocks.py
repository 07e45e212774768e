"""Counting by hash without a row for each occurrence.

The documents are dealt into batches by a hash of their id. A batch asks about
its distinct 64-bit keys in one block for each hash partition; the partition's
task answers every block with one value a key, in the block's order; the batch,
whose texts come from the same shuffle again, joins the answers to its
occurrences. A key stands once in a batch however often it occurs, so no key is
hot. Batches have about BATCH_BYTES of text and partitions the keys of as much, at
every size; with more and more of both a block thins out to the row of one key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import text_buffer

#: Text of a batch.
BATCH_BYTES = 4 << 20
BLOCK_SCHEMA = "p int, b int, keys binary, vals binary"
ANSWER_SCHEMA = "b int, p int, vals binary, total long"


def planes(x: np.ndarray) -> bytes:
    """Byte planes of an integer array: the shuffle's codec then finds the zeros."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)) if len(keys) else b""


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each key: key * parts / 2**64, so ascending keys have ascending partitions. parts is below 2**32."""
    low, n = np.uint64(0xFFFFFFFF), np.uint64(parts)
    return (((keys >> np.uint64(32)) * n + (((keys & low) * n) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def batch_of(docs: DataFrame, batches: int) -> Column:
    """The batch of each row of docs(doc_id, text): by id and text, so that rows which share an id, or have none, are spread."""
    return F.pmod(F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")), F.lit(batches)).cast("int")


def batched(docs: DataFrame, batches: int) -> DataFrame:
    """docs(doc_id, text) with the batch b, and the text as a zstd frame; null ids are a batch's rows as well.

    Texts are what the shuffle is made of and it is kept for every reader, so they
    cross it compressed.
    """

    def squeeze(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for r in rows:
            raw, off = text_buffer(r.column(2))
            data = pa.py_buffer(raw)
            z = [codec.compress(data.slice(int(i), int(j - i)), asbytes=True) if j > i else b"" for i, j in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(np.diff(off), pa.int64()), pa.array(z, pa.binary())], names=["b", "doc_id", "size", "z"])

    rows = docs.select(batch_of(docs, batches).alias("b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(squeeze, "b int, doc_id long, size long, z binary")


def batch_texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a batch's texts."""
    codec = pa.Codec("zstd")
    size = t["size"].to_numpy()
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = np.empty(int(off[-1]), np.uint8)
    for i, n, z in zip(off.tolist(), size.tolist(), t["z"]):
        if n:
            raw[i : i + n] = np.frombuffer(codec.decompress(z.as_buffer(), n), np.uint8)
    return raw, off


def n_batches(docs: DataFrame) -> int:
    """Batches, and hash partitions, for the texts of docs: by their bytes, not by the cluster's size."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, math.ceil(size / BATCH_BYTES))


def ask(b: int, keys: np.ndarray, vals: np.ndarray, parts: int) -> pa.Table:
    """One block for each partition that has any of the ascending, distinct keys, which have a value each."""
    part = partition_of(keys, parts)
    # by the keys that there are, not by the partitions
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    full, cuts = part[at[:-1]].tolist(), list(zip(at[:-1].tolist(), at[1:].tolist()))
    return pa.table({"p": pa.array(full, pa.int32()), "b": pa.array([b] * len(full), pa.int32()), "keys": pa.array([pack_sorted(keys[i:j]) for i, j in cuts], pa.binary()), "vals": pa.array([planes(vals[i:j]) for i, j in cuts], pa.binary())})


def answered(asked: DataFrame, kind, combine: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Answer all blocks of each partition.

    combine(group, key starts, values sorted by key, keys) -> for every asked key,
    in the order of the blocks, a small unsigned value; group maps places to keys.
    """

    def reply(t: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in t["keys"].to_pylist()]
        vals = np.concatenate([unplanes(x, kind) for x in t["vals"].to_pylist()])
        each = np.concatenate(keys)
        order = np.argsort(each, kind="stable")
        s = each[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
        of_sorted = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
        group = np.empty(len(s), np.int64)
        group[order] = of_sorted
        out = combine(group, first, vals, vals[order]) if len(s) else vals
        cut = np.cumsum([0, *map(len, keys)])
        return pa.table({"b": t["b"].cast(pa.int32()), "p": t["p"].cast(pa.int32()), "vals": pa.array([planes(out[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary()), "total": pa.array([0] * len(t), pa.int64())})

    return asked.groupBy("p").applyInArrow(reply, ANSWER_SCHEMA)


def collect_answers(t: pa.Table, kind) -> np.ndarray:
    """Answers of a batch in the order of its ascending keys."""
    if not len(t):
        return np.zeros(0, kind)
    t = t.sort_by("p")
    return np.concatenate([unplanes(x, kind) for x in t["vals"].to_pylist()])
