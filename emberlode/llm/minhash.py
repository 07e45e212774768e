"""Near duplicates by min-max hashing.

A signature keeps the least and the greatest value of a document's shingles
under each permutation, two of its places for one evaluation. Places are banded;
texts that share a band are candidates and each link is confirmed on the full
shingle sets. Texts with one shingle set are one class from the start.

Buckets aren't expanded into pairs. First each bucket's pivot, the member that
meets most others, is compared with the rest, which settles most. In buckets that
still hold several components the members then are dealt anew, by shingles that
their pivot lacks: copies with many edits part there. A round compares the members
of such a bucket's smallest components with those outside their component and
takes them out of the bucket; buckets of one component are done. So a bucket of g
copies costs about g comparisons and no link is given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .textops import LOWER, Rounds, doc_blocks, mix, text_buffer, word_hashes

WORDS = 5
#: Percent of the union that the intersection must reach.
SIMILAR = 85
#: Places of a signature, and how often a link may share no band at most.
PLACES, MISS = 180, 1e-6
CHUNK = 2048
#: Members of a bucket that are compared with the rest in the first of the last rounds; each next round takes so many times more.
FIRST = 64
#: Parities of a set's sketch, and the columns that hold them.
SKETCH = 256
ODD = tuple(f"odd{i}" for i in range(SKETCH // 64))

_RNG = np.random.default_rng(20240229)
_MULT = (_RNG.integers(0, 1 << 32, PLACES // 2, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_XOR = _RNG.integers(0, 1 << 32, PLACES // 2, np.uint64).astype(np.uint32)[:, None]


def banding(similar: int) -> tuple[int, int]:
    """Bands and rows: the longest bands that miss a pair at similar percent with probability MISS at most.

    At 85 these are 30 bands of 6, which miss (1 - 0.85**6)**30 = 6.8e-7 of such
    pairs; at 80 they are 36 of 5, which miss 6.2e-7.
    """
    for rows in range(PLACES // 2, 0, -1):
        if (1 - (similar / 100) ** rows) ** (PLACES // rows) <= MISS:
            return PLACES // rows, rows
    raise ValueError(f"{PLACES} places don't find pairs at {similar} percent")


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each row; the whole sequence if it has fewer words."""
    h, at = word_hashes(LOWER[raw], off)
    c = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= words:
        s = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            s = s * c + h[k : len(h) - words + 1 + k]
        s = mix(s)
    out = []
    for i, j in zip(at[:-1], at[1:]):
        if j - i >= words:
            out.append(np.unique(s[i : j - words + 1]))
        elif j > i:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in h[i:j]:
                    x = x * c + v
                out.append(mix(np.array([x + np.uint64(j - i)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Least and greatest value of the set under each permutation; 32 bits each."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MULT), 0xFFFFFFFF, np.uint32)
    most = np.zeros(len(_MULT), np.uint32)
    for at in range(0, len(low), CHUNK):
        v = (low[at : at + CHUNK] ^ _XOR) * _MULT
        v ^= v >> np.uint32(15)
        np.minimum(least, v.min(axis=1), out=least)
        np.maximum(most, v.max(axis=1), out=most)
    return np.concatenate([least, most])


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value a band. A band takes minima and maxima of different permutations."""
    v = sig.reshape(2, -1).T.reshape(-1)  # min, max of permutation 0, of 1, ...
    v = v[: bands * rows].reshape(rows, bands).T.astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
    return h.view(np.int64)


def _sets_of(texts: DataFrame) -> DataFrame:
    """texts(node, text) -> node, shingles (ascending 64-bit values as bytes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffer(b.column(1))
            out = [s.tobytes() for i, j in doc_blocks(off) for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(rows, "node long, shingles binary")


def _signed(texts: DataFrame, similar: int) -> DataFrame:
    """texts(doc_id, th, text) -> doc_id, th, n_shingles, the set's 128-bit fingerprint (k1, k2), band values."""
    shape = banding(similar)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffer(b.column(2))
            n, k1, k2, bands = [], [], [], []
            for i, j in doc_blocks(off):
                for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i]):
                    n.append(len(s))
                    k1.append(mix(s).sum(dtype=np.uint64).astype(np.int64))
                    k2.append(mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64))
                    bands.append(band_hashes(signature(s), *shape) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "k1", "k2", "bands"])

    return texts.mapInArrow(rows, "doc_id long, th long, n_shingles long, k1 long, k2 long, bands array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(u, v, ...) with both sets, _su and _sv; a pivot of many pairs can be split."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("_sv"))
    return pairs.join(right, "v").join(left, "u")


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which values of x stand in y; both ascend and y isn't empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int(np.count_nonzero(_among(x, y)))
                ok.append(100 * both >= similar * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return _with_sets(pairs.select("u", "v"), sets).select("u", "v", "_su", "_sv").mapInArrow(rows, "u long, v long")


def prefix_length(n: int, least: int, similar: int) -> int:
    """So many shingles of a set of n, in an order that all share, hold one of any linked set of least or more."""
    partner = max(least, -(-n * similar // 100))
    return n - -(-(n + partner) * similar // (100 + similar)) + 1


def _dealt_anew(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(bucket, id, n, pos, sketch) by rare shingles, for pairs(u, v, least) of pivots and members; no link between two members of a pivot is lost.

    Under a pivot u shingles are ordered: first those that u lacks, then the rest,
    each by hash. Linked sets share one of their first n - o + 1 shingles, o being
    the intersection that the least size under u asks for; pos is the place of the
    shingle, from 0, for the closer bound of a pair, and sketch has the parities of
    the whole set's shingles by SKETCH last bits of their hash: two sets differ in as
    many shingles as parities at least. A member that isn't
    linked with u mostly begins with shingles of its edits, which few others have.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, v, least, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(y)
                known = _among(y, x)
                first = np.concatenate([y[~known], y[known]])[: prefix_length(n, least, similar)]
                bucket = mix(first ^ mix(np.array([u], np.int64).view(np.uint64)))
                odd = np.packbits(np.bincount((y % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)
                for at in range(0, len(bucket), 100_000):
                    part = bucket[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), v.as_py(), np.int64)), pa.array(np.full(len(part), n, np.int64)), pa.array(np.arange(at, at + len(part))), *(pa.array(np.full(len(part), x)) for x in odd)], names=["bucket", "id", "n", "pos", *ODD])

    dealt = _with_sets(pairs, sets).select("u", "v", "least", "_su", "_sv").mapInArrow(rows, f"bucket long, id long, n long, pos long, {', '.join(f'{c} long' for c in ODD)}")
    several = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    return dealt.join(several, "bucket")


def _open(members: DataFrame, settled: DataFrame) -> DataFrame:
    """members(bucket, id, n) of the buckets that hold several components, with the component."""
    now = members.join(settled.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    undone = now.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a < z").select("bucket")
    return now.join(undone, "bucket")


def _linked(full: DataFrame, texts: DataFrame, nodes: DataFrame, rounds: Rounds, similar: int) -> DataFrame | None:
    """(id, component) of the nodes that are linked with another; None if no two share a band."""
    reps = full.join(nodes, ["k1", "k2", "n_shingles", "doc_id", "th"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), "bands")
    banded = reps.select("id", "n", F.posexplode("bands").alias("pos", "band")).select(F.xxhash64("pos", "band").alias("bucket"), "id", "n")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = rounds.put(banded.join(sizes, "bucket").select("bucket", "id", "n", "size"))
    meets = rounds.put(members.groupBy("id").agg(F.sum("size").alias("meets")))
    if meets.isEmpty():
        return None
    asked = nodes.join(meets, nodes["node"] == meets["id"], "left_semi").select("doc_id", "th", "node")
    sets = rounds.put(_sets_of(texts.join(asked, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("node", "text")))
    # the member that meets most others is compared with the rest of its bucket
    pivot = members.join(meets, "id").groupBy("bucket").agg(F.max(F.struct("meets", "id", "n")).alias("p"))
    beside = members.join(pivot.select("bucket", F.col("p.id").alias("u"), F.col("p.n").alias("nu")), "bucket").where("id != u")
    near = lambda df: df.where(F.lit(100) * F.least("n", "nu") >= F.lit(similar) * F.greatest("n", "nu"))
    links = rounds.put(_confirmed(near(beside).select("u", F.col("id").alias("v")).distinct(), sets, similar))
    rounds.drop()
    settled = components(links, rounds)
    rounds.drop(links)
    still = _open(members.select("bucket", "id", "n"), settled)
    pivots = members.join(meets, "id").groupBy("bucket").agg(F.max(F.struct("meets", "id")).alias("p"), F.min("n").alias("least")).select("bucket", F.col("p.id").alias("u"), "least")
    anew = still.join(pivots, "bucket").where("id != u").groupBy("u", F.col("id").alias("v")).agg(F.min("least").alias("least"))
    members, old = rounds.put(_dealt_anew(anew, sets, similar)), members
    rounds.drop(old, meets)
    at_once = FIRST
    while True:
        open_, old = rounds.put(_open(members, settled)), members
        rounds.drop(old)
        if open_.isEmpty():
            return settled
        share = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("share"))
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("share", "id"))
        pivots = rounds.put(open_.join(share, ["bucket", "comp"]).withColumn("r", place).where(F.col("r") <= at_once).select("bucket", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("pos").alias("pu"), F.col("comp").alias("cu"), *(F.col(c).alias(f"{c}u") for c in ODD)))
        # linked sets share so many shingles that one stands this early in both
        shared = F.ceil((F.col("n") + F.col("nu")) * similar / F.lit(100.0 + similar) - F.lit(1e-9))
        early = (F.col("pos") <= F.col("n") - shared) & (F.col("pu") <= F.col("nu") - shared)
        differ = reduce(Column.__add__, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}u"))) for c in ODD))
        pairs = near(open_.join(pivots, "bucket").where("comp != cu")).where(early & (differ <= F.col("n") + F.col("nu") - 2 * shared))
        pairs = pairs.select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v")).distinct()
        links = rounds.put(_confirmed(pairs, sets, similar))
        # new links join components: only those change
        to = lambda c: settled.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        over = links.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        merged = components(over, rounds)
        all_ = settled.unionByName(links.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(settled, "id", "left_anti").select("id", F.col("id").alias("component")))
        settled, old = rounds.put(all_.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))), settled
        members = rounds.put(open_.drop("comp").join(pivots.select("bucket", F.col("u").alias("id")), ["bucket", "id"], "left_anti"))
        rounds.drop(old, open_, pivots, links, merged)
        at_once *= FIRST


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, with_hash: bool = False) -> DataFrame:
    """Group documents whose shingle sets are alike, directly or through others.

    One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (least
    doc_id reachable), kept (doc_id = component_id) and, with_hash, text_hash (xxhash64
    of the text), which tells apart the texts of rows that share an id. Null or empty text, and text
    without words, has no shingles and is its own component. Rows with a null id
    have a null component and are kept. Repeated rows with one id each get the
    component of their own text, whether their texts are equal or not. An empty table
    gives no rows; other columns are ignored.
    """
    rounds = Rounds(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    signed = rounds.put(_signed(texts, similar))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "th")).alias("rep")).select("k1", "k2", "n_shingles", "rep.*")
    # a node is the least id of a class; where an id stands for several classes, a hash
    often = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    nodes = classes.join(often, "doc_id", "left").select("k1", "k2", "n_shingles", "doc_id", "th", F.when(F.col("times").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "k1", "k2", F.lit("node"))).alias("node"))
    nodes = rounds.put(nodes)
    settled = _linked(full, texts.where("doc_id is not null"), nodes, rounds, similar)
    named = nodes.select("k1", "k2", "n_shingles", F.col("doc_id").alias("component_id"))
    if settled is not None:
        of = nodes.join(settled.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = rounds.put(of.join(least, "component").select("k1", "k2", "n_shingles", "component_id"))
        rounds.drop(settled)
    out = signed.drop("bands").join(named, ["k1", "k2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    more = [F.col("th").alias("text_hash")] if with_hash else []
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *more)
