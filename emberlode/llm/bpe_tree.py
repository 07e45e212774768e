"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved down to leaves, wherever the middle falls; the leaves are encoded
on their own, in parallel tasks where the text is very long, and neighbours are joined
up the tree. Around each join a window of tokens is encoded anew; it grows until both
sides agree exactly, and then all outside the window stands.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, and of a part that a task encodes by itself.
LEAF, PART = 4096, 1 << 16
#: Tokens of the first window on either side of a join.
WINDOW = 8
#: Ids hashed at a time.
SLICE = 1 << 16
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The pattern looks at most so many characters ahead (an apostrophe and two letters).
AHEAD = 3


class TreeCodec:
    """Encodes and decodes whole texts as arrays of 32-bit ids."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", leaf: int = LEAF, window: int = WINDOW):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.bytes = [b""] * (max(max(ranks.values()), SPECIAL_ID) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.bytes[SPECIAL_ID] = SPECIAL.encode()
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.leaf, self.window = max(2 * len(SPECIAL), leaf), window

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return np.array(self.enc.encode(text, allowed_special="all") if SPECIAL in text else self.enc.encode_ordinary(text), np.uint32)
        cut = middle(text)
        return self.join(self.encode(text[:cut]), self.encode(text[cut:]))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two texts' concatenation from the ids of each; the cut isn't inside a special string."""
        if not len(left) or not len(right) or left[-1] == SPECIAL_ID or right[0] == SPECIAL_ID:
            return np.concatenate([left, right])
        n = self.window
        while True:
            i, begins = self._back(left, n)
            j, ends = self._on(right, n)
            a, b = left[i:], right[:j]
            made = self._agreed(a, b, begins, ends)
            if made is not None:
                new, used = made
                return np.concatenate([left[:i], new, right[used:]])
            n *= 2

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])

    def _back(self, ids: np.ndarray, n: int) -> tuple[int, bool]:
        """Where a window of n tokens at the end begins, and whether the text begins there.

        It begins with a whole character, not within reach of an apostrophe, and doesn't
        cross a special token.
        """
        i = max(0, len(ids) - n)
        if len(found := np.flatnonzero(ids[i:] == SPECIAL_ID)):
            return i + int(found[-1]) + 1, True
        while i and ids[i - 1] != SPECIAL_ID:
            near = self._text(ids[max(0, i - AHEAD) : i])[-AHEAD:] + self.bytes[ids[i]][:1]
            if near[-1] & 0xC0 != 0x80 and b"'" not in near:
                return i, False
            i -= 1
        return i, True

    def _on(self, ids: np.ndarray, n: int) -> tuple[int, bool]:
        """Where a window of n tokens at the start ends, and whether the text ends there."""
        j = min(len(ids), n)
        if len(found := np.flatnonzero(ids[:j] == SPECIAL_ID)):
            return int(found[0]), True
        while j < len(ids) and ids[j] != SPECIAL_ID:
            if self.bytes[ids[j]][0] & 0xC0 != 0x80:
                return j, False
            j += 1
        return j, True

    def _starts(self, text: str) -> np.ndarray:
        """Byte offsets at which the pattern's words begin."""
        return np.cumsum([0, *(len(w.group().encode()) for w in self.words.finditer(text))])

    def _agreed(self, a: np.ndarray, b: np.ndarray, begins: bool, ends: bool) -> tuple[np.ndarray, int] | None:
        """The window's ids anew and how many of b they replace, or None if the sides don't agree.

        Left: the window is encoded from where the text begins, or its first token is the
        old one. Before it nothing changes then: a word that holds the place is a run of
        one kind of characters, and merged tokens are right where every two neighbours are.
        Right: the text ends, or both ways of cutting words have a border in common, from
        which on they go alike; or all of b is inside one word, which the window's last
        word holds, and the last token is the old one.
        """
        ta, tb = self._text(a), self._text(b)
        whole = (ta + tb).decode("utf-8")
        new = np.array(self.enc.encode_ordinary(whole), np.uint32)
        if not begins and new[0] != a[0]:
            return None
        if ends:
            return new, len(b)
        size, at = len(ta) + len(tb), len(ta)
        tail = len("".join(whole[-AHEAD - 1 :]).encode())
        own, alone = self._starts(whole), self._starts(tb.decode("utf-8")) + at
        common = np.intersect1d(own, alone)
        common = common[common <= size - tail]
        if len(common):
            border = common[-1]
            keep = int(np.searchsorted(np.cumsum(self.size[new]), border, "right"))
            used = int(np.searchsorted(np.cumsum(self.size[b]), border - at, "right"))
            return new[:keep], used
        if len(alone) == 2 and own[-2] <= at and new[-1] == b[-1]:
            return new, len(b)
        return None

    def decode(self, ids: np.ndarray) -> str:
        return self._text(ids).decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text; a slice at a time."""
        listed, text, utf8 = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(ids), SLICE):
            part = ids[i : i + SLICE]
            listed.update(((i > 0) * "," + ",".join([self.decimal[x] for x in part.tolist()])).encode())
            text.update(utf8.decode(self._text(part)).encode())
        text.update(utf8.decode(b"", True).encode())
        return len(ids), listed.hexdigest(), text.hexdigest()


def middle(text: str) -> int:
    """Where a text is halved: not inside a special string."""
    cut = len(text) // 2
    at = text.find(SPECIAL, max(0, cut - len(SPECIAL) + 1), cut + len(SPECIAL) - 1)
    return cut if at < 0 or at == cut else at or len(SPECIAL)


def parts_of(text: str, most: int) -> list[str]:
    """The text halved until no part is longer than most."""
    todo, out = [text], []
    while todo:
        t = todo.pop()
        if len(t) <= max(most, 2 * len(SPECIAL)):
            out.append(t)
        else:
            cut = middle(t)
            todo += [t[cut:], t[:cut]]
    return out


def joined(codec: TreeCodec, parts: list[np.ndarray]) -> np.ndarray:
    """Neighbours joined level by level."""
    while len(parts) > 1:
        parts = [codec.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@lru_cache(maxsize=2)
def codec(leaf: int = LEAF, window: int = WINDOW) -> TreeCodec:
    return TreeCodec(leaf=leaf, window=window)


Finish = Callable[[TreeCodec, np.ndarray], tuple]


def _encoded(docs: DataFrame, finish: Finish, schema: str, kinds: list[pa.DataType], part: int, leaf: int, window: int) -> DataFrame:
    """finish's columns for the ids of every row of docs(doc_id, text)."""
    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def told(ids: list[np.ndarray], docs: pa.Array) -> pa.RecordBatch:
        cols = zip(*[finish(codec(leaf, window), x) for x in ids]) if ids else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([docs, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield told([codec(leaf, window).encode(t.as_py()) for t in b.column(1)], b.column(0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, md5, text in zip(b.column(0), b.column(1), b.column(2)):
                pieces = parts_of(text.as_py(), part)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, pa.int64()), pa.array([md5.as_py()] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string())], names=["doc_id", "md5", "no", "piece"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [codec(leaf, window).encode(t.as_py()).astype("<u4").tobytes() for t in b.column("piece")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("md5"), b.column("no"), b.column("copies"), pa.array(ids, pa.binary())], names=["doc_id", "md5", "no", "copies", "ids"])

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("no")
        ids = joined(codec(leaf, window), [np.frombuffer(x.as_buffer(), "<u4") for x in t["ids"]])
        out = told([ids], t["doc_id"].combine_chunks().slice(0, 1))
        return pa.Table.from_batches([out]).append_column("copies", t["copies"].slice(0, 1).combine_chunks())

    short = rows.where(F.length("text") <= part).mapInArrow(whole, f"doc_id long, {schema}")
    # very long texts: the parts are dealt one by one, those of repeated rows once
    long = rows.where(F.length("text") > part).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5"), "text").mapInArrow(cut, "doc_id long, md5 binary, no int, piece string")
    parts = long.groupBy("doc_id", "md5", "no").agg(F.max("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
    parts = parts.mapInArrow(each, "doc_id long, md5 binary, no int, copies long, ids binary")
    again = parts.groupBy("doc_id", "md5").applyInArrow(together, f"doc_id long, {schema}, copies long")
    return short.unionByName(again.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_"))


def encode(docs: DataFrame, part: int = PART, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32 bits) of every row of docs(doc_id, text).

    The special string is its one id. Null and empty texts have no ids. A null doc_id
    stays null, repeated rows come each, an empty table gives no rows, other columns are
    ignored. A text of more than `part` characters is halved into parts that tasks encode
    in parallel; one task then joins its ids, by windows at the borders.
    """
    return _encoded(docs, lambda _, ids: (len(ids), ids.astype("<u4").tobytes()), "n_tokens long, ids binary", [pa.int64(), pa.binary()], part, leaf, window)


def decode(rows: DataFrame) -> DataFrame:
    """doc_id, text of rows(doc_id, ids); bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec().decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(texts, "doc_id long, text string")


def round_trip(docs: DataFrame, part: int = PART, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids. Rows as in encode()."""
    return _encoded(docs, TreeCodec.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], part, leaf, window)
