"""Removal of repeated 50-byte strings by distributed prefix doubling.

A window is a 50-byte string of a text; its anchor is the 25-byte string of least
hash in it (the last of equals), so equal windows choose alike. Windows next to
each other with one anchor are a run, and only anchors that two documents share
take part. A run is a row with a rank that stands for the bytes which all its
windows have: at first the anchor's 25. A round pairs the rank of each row with
the bytes at the next offset, Spark groups the pairs and names each group anew, and
a row is through when its pair is in one document only (it drops out) or when all
rows of its group have the same windows (those of the least document stay, the
others are removed). Other rows are halved: the windows that begin nearer to the anchor
gain bytes at its end, the rest gain bytes before it. Ranks so stand for 25, 38, 44, 47, 49
and at last 50 bytes.

Ranks of the anchors are told apart by 128 bits, all later pairs by their bytes; that
the rows of a group have the same windows is told by 64 bits within the group.
Exact copies of a text, by id and digest, are found first and take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .textops import Rounds, gram_hash, mix, prefix_hash, span_hash

LENGTH = 50
STEP = 1 << 18
#: Low bits of a hash that give way to the place within a step of the text.
_PLACE = np.uint64((1 << 24) - 1)


class Runs:
    """The runs of a batch's texts: start, number of windows, anchor, row and key of each."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, out: np.ndarray, length: int):
        """out: rows that take no part."""
        self.raw, self.length, self.half = raw, length, length // 2
        width = length - self.half + 1
        runs: list[tuple[np.ndarray, ...]] = []
        for at in range(0, max(0, len(raw) - length + 1), STEP):
            h = gram_hash(prefix_hash(raw[at : at + STEP + length - 1]), self.half)
            v = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
            have = 1
            while have < width:  # minimum over a doubling span
                by = min(have, width - have)
                v = np.minimum(v[:-by], v[by:])
                have += by
            anchor = (_PLACE - (v & _PLACE)).astype(np.int64)
            place = np.arange(at, at + len(v))
            doc = np.searchsorted(off, place, "right") - 1
            ok = (place + length <= off[doc + 1]) & ~out[doc]
            turn = np.ones(len(v), bool)
            turn[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
            start = np.flatnonzero(turn)
            size = np.diff(np.append(start, len(v)))
            good = ok[start]
            start, size = start[good], size[good]
            runs.append((start + at, size, anchor[start] + at, doc[start], mix(h[anchor[start]])))
        join = lambda k, t: np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, t)
        self.start, self.size, self.anchor, self.doc, self.key = (join(k, np.int64 if k < 4 else np.uint64) for k in range(5))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and whether two rows of the batch have one."""
        order = np.argsort(self.key, kind="stable")
        k, d = self.key[order], self.doc[order]
        if not len(k):
            return k, np.zeros(0, np.uint8)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)).astype(np.uint8)

    def keep(self, on: np.ndarray) -> None:
        self.start, self.size, self.anchor, self.doc, self.key = self.start[on], self.size[on], self.anchor[on], self.doc[on], self.key[on]

    def second_key(self) -> np.ndarray:
        """Another 64 bits of each anchor, of its bytes by multilinear hashing."""
        h = np.zeros(len(self.anchor), np.uint64)
        for j, factor in enumerate(mix(np.arange(1, self.half + 1, dtype=np.uint64))):
            h += (self.raw[self.anchor + j].astype(np.uint64) + np.uint64(1)) * factor
        return mix(h)

    def whole(self) -> np.ndarray:
        """Hash of all bytes of each run and where its anchor lies."""
        h = np.zeros(len(self.start), np.uint64)
        for at in range(0, len(self.raw), STEP):
            i, j = np.searchsorted(self.start, [at, at + STEP])
            if i < j:
                s = self.start[i:j] - at
                h[i:j] = span_hash(prefix_hash(self.raw[at : at + STEP + 2 * self.length]), s, s + self.size[i:j] + self.length - 1)
        return mix(h + (self.anchor - self.start).astype(np.uint64) * np.uint64(1 << 32) + self.size.astype(np.uint64))


def _batch(t: pa.Table, extra: pa.Table, length: int):
    """Ids, texts, offsets, which rows are exact copies and which have an id, in an order that the shuffle doesn't change."""
    t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("size", "ascending"), ("z", "ascending")]))
    ids = t["doc_id"].combine_chunks()
    raw, off = blocks.batch_texts(t)
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    doc_id = ids.fill_null(0).to_numpy()
    # a copy is an id with a text: rows that share an id may differ
    told = extra.filter(pc.equal(extra["p"], -1))
    copies = set(zip(told["total"].to_pylist(), told["vals"].to_pylist()))
    copy = np.zeros(len(t), bool)
    for r in np.flatnonzero(np.isin(doc_id, told["total"].to_numpy()) & named & (np.diff(off) >= length)) if copies else ():
        copy[r] = (int(doc_id[r]), hashlib.md5(raw[off[r] : off[r + 1]]).digest()) in copies
    return doc_id, raw, off, copy, named


#: Windows lo to hi (bytes before the anchor) of a run, whose rank stands for what windows x to y share; same: through, and removed.
_ROW = "rank long, doc long, place long, lo int, hi int, x int, y int"


def _ranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """Rows with the rank of their pair; not those in one document only, nor those that stay for good.

    Groups are summed up before the shuffle; the join meets one row a group, so
    adaptive execution can split a frequent pair.
    """
    names = rows.groupBy(*pair).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("place").alias("named"), (F.min("whole") == F.max("whole")).alias("same")).where("least < most").drop("most")
    kept = [c for c in rows.columns if c not in ("rank", "whole", "k", "k2", "more")]
    return rows.join(names, pair).where("not same or doc > least").select(F.col("named").alias("rank"), *kept, "same")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows with half the windows each, and the bytes `more` that these share beyond the rank.

    before: the bytes from the first window's start to the rank's; after: those from
    the rank's end to the last window's.
    """
    rows = rows.withColumn("m", F.expr("(x + y) div 2").cast("int"))
    near = rows.where("lo <= m").withColumn("top", F.least("hi", "m")).selectExpr("rank", "doc", "place", "lo", "top AS hi", "x", "m AS y", "substring(after, 1, y - m) AS more", "substring(before, hi - top + 1, top - x) AS before", "substring(after, y - m + 1, m - lo) AS after")
    far = rows.where("hi > m").withColumn("low", F.greatest("lo", F.col("m") + 1)).selectExpr("rank", "doc", "place", "low AS lo", "hi", "m + 1 AS x", "y", "substring(before, hi - m, m + 1 - x) AS more", "substring(before, 1, hi - m - 1) AS before", "substring(after, 1, y - low) AS after")
    return near.unionByName(far).withColumn("whole", F.xxhash64("lo", "hi", "before", "after"))


def repeated(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a length-byte string that starts in a document with a smaller id.

    One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, with_text, kept_text (the remaining bytes without the parts
    of characters that a cut has split) and text_md5, which tells apart the texts of
    rows that share an id. Null text is empty. Rows with a null id
    are returned as they are and remove nothing. Of repeated rows with one id, none
    removes from the other. An empty table gives no rows; other columns are ignored.
    """
    if not 2 <= length <= 4096:
        raise ValueError("length must be 2 to 4096")
    n, rounds, width = blocks.n_batches(docs), Rounds(docs.sparkSession), length - length // 2 + 1
    texts = blocks.batched(docs, n)
    # exact copies: only the digest of each text is shuffled
    body = docs["text"].cast("string").cast("binary")
    digest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("k"), blocks.batch_of(docs, n).alias("b")).where((F.octet_length(body) >= length) & F.col("doc_id").isNotNull())
    least = digest.groupBy("k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = digest.join(least, "k").where("doc_id > least").select("b", F.lit(-1).alias("p"), F.col("k").alias("vals"), F.col("doc_id").alias("total")).distinct()

    def first(key, t: pa.Table, extra: pa.Table) -> pa.Table:
        _, raw, off, copy, named = _batch(t, extra, length)
        k, multi = Runs(raw, off, copy | ~named, length).keys()
        return blocks.ask(int(key[0].as_py()), k, multi, n)

    def shared(group, start, vals, by_key) -> np.ndarray:
        count = np.diff(np.append(start, len(by_key)))
        return ((count > 1) | (np.maximum.reduceat(by_key, start) > 0)).astype(np.uint8)[group]

    def anchors(key, t: pa.Table, extra: pa.Table) -> pa.Table:
        doc_id, raw, off, copy, named = _batch(t, extra, length)
        r = Runs(raw, off, copy | ~named, length)
        keys = r.keys()[0]
        answer = blocks.collect_answers(extra.filter(pc.greater_equal(extra["p"], 0)), np.uint8)
        r.keep(answer[np.searchsorted(keys, r.key)] > 0 if len(keys) else np.zeros(0, bool))
        hi = r.anchor - r.start
        cols = {"k": r.key.view(np.int64), "k2": r.second_key().view(np.int64), "whole": r.whole().view(np.int64), "doc": doc_id[r.doc].astype(np.int64), "place": (int(key[0].as_py()) << 32) + r.anchor}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()} | {"lo": pa.array(hi - r.size + 1, pa.int32()), "hi": pa.array(hi, pa.int32())})

    def surroundings(key, t: pa.Table, extra: pa.Table) -> pa.Table:
        """The bytes around the anchors of rows that go on."""
        _, raw, *_ = _batch(t, NO_COPIES, length)
        at = extra["place"].to_numpy() & 0xFFFFFFFF
        lo, hi, half = extra["lo"].to_numpy(), extra["hi"].to_numpy(), length // 2
        before = [raw[i:j].tobytes() for i, j in zip(at - hi, at)]
        after = [raw[i:j].tobytes() for i, j in zip(at + half, at + length - lo)]
        zero = pa.array(np.zeros(len(at), np.int32))
        return extra.select(["rank", "doc", "place", "lo", "hi"]).append_column("x", zero).append_column("y", pc.add(zero, pa.scalar(width - 1, pa.int32()))).append_column("before", pa.array(before, pa.binary())).append_column("after", pa.array(after, pa.binary()))

    def last(key, t: pa.Table, extra: pa.Table) -> pa.Table:
        doc_id, raw, off, copy, named = _batch(t, extra, length)
        found = extra.filter(pc.greater(extra["p"], 0))
        at, count = found["total"].to_numpy(), found["p"].to_numpy()
        # starts of windows are distinct over all rows, so the first ones are and the last ones are
        kind = np.int8 if length < 64 else np.int32
        change = np.zeros(len(raw) + 1, kind)
        change[at] += 1
        change[at + count - 1 + length] -= 1
        gone = np.cumsum(change[:-1], dtype=kind) > 0
        cols: list[list] = [[], [], [], [], [], [], []]
        for r, (i, j) in enumerate(zip(off[:-1], off[1:])):
            g = np.ones(j - i, bool) if copy[r] else gone[i:j]
            kept = raw[i:j][~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[:1].sum())
            for c, v in zip(cols, (int(doc_id[r]) if named[r] else None, j - i, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, hashlib.md5(raw[i:j]).digest() if with_text else None)):
                c.append(v)
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text_md5"])

    by_batch = lambda right: texts.groupBy("b").cogroup(right.groupBy("b"))
    batch = F.shiftright("place", 32).cast("int")
    answers = blocks.answered(by_batch(copies).applyInArrow(first, blocks.BLOCK_SCHEMA), np.uint8, shared)
    runs = rounds.put(by_batch(copies.unionByName(answers)).applyInArrow(anchors, "k long, k2 long, whole long, doc long, place long, lo int, hi int"))
    ranked = rounds.put(_ranked(runs, ["k", "k2"]))
    rounds.drop(runs)
    through, going = [ranked.where("same")], ranked.where("not same")
    for step in range((width - 1).bit_length()):
        if going.isEmpty():
            break
        if step == 0:
            going = rounds.put(by_batch(going.withColumn("b", batch)).applyInArrow(surroundings, f"{_ROW}, before binary, after binary"))
        ranked, done = rounds.put(_ranked(_halved(going), ["x", "rank", "more"])), going
        rounds.drop(done)
        through.append(ranked.where("same"))
        going = ranked.where("not same")
    known = copies
    for t in through:
        known = known.unionByName(t.select(batch.alias("b"), F.expr("hi - lo + 1").alias("p"), F.lit(None).cast("binary").alias("vals"), F.expr("(place & 4294967295L) - hi").alias("total")))
    out = by_batch(known).applyInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, text_md5 binary")
    return out if with_text else out.drop("kept_text", "text_md5")


NO_COPIES = pa.table({"p": pa.array([], pa.int32()), "vals": pa.array([], pa.binary()), "total": pa.array([], pa.int64())})
