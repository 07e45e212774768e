"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / max_len) pieces of max_len tokens and
one piece for each binary digit of the rest. Every piece has a power of two of
tokens and is a sequence of its own, so no sequence crosses documents, none is
padded, and sequences of one length form a bucket. Nothing is shuffled: a piece
is made where its document is read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_LEN = 2048
END_ID = 1
#: Entries of a worker's cache of encoded chunks; it is emptied when full.
CACHE = 300_000
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class ChunkEncoder:
    """Byte-level BPE of whole texts, as bytes of little-endian 32-bit ids.

    The vocabulary file is the same vocabulary as the tokenizers JSON, as ranks.
    A single space between two characters that aren't white space always begins
    a new pre-token, so a text is cut there and each chunk is encoded once and
    then looked up.
    """

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", cache: int = CACHE):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.seen: dict[str, bytes] = {}
        self.cache = cache

    def _chunk(self, chunk: str) -> bytes:
        out = np.array(self.enc.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self.seen) >= self.cache:
                self.seen.clear()
            self.seen[chunk] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return np.array(self.enc.encode(text, allowed_special="all"), "<u4").tobytes()
        parts = text.split(" ")
        chunks, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if open_ or not p or p[0].isspace():
                chunks[-1] += " " + p
            else:
                chunks.append(" " + p)
            open_ = not p or p[-1].isspace()
        get, out = self.seen.get, []
        for c in chunks:
            ids = get(c)
            out.append(self._chunk(c) if ids is None else ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder() -> ChunkEncoder:
    return ChunkEncoder()


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; max_len is a power of two."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, max_len: int = MAX_LEN, with_ids: bool = True) -> DataFrame:
    """Cut every row of docs(doc_id, text) into bucketed sequences.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (binary,
    little-endian unsigned 32 bits; left out without with_ids), bucket (log2 of
    length), sequence_id, offset (always 0). Null or empty text gives the end id
    alone. A null doc_id stays null. Repeated rows are packed each on their own.
    An empty table gives no rows. Other columns are ignored.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + end)
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, max_len):
                    part = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(part), n, bytes(part) if with_ids else None)):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    out = out.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return out if with_ids else out.drop("ids")
