"""Supervised subword embeddings for text quality.

Words, pairs of words and character 3- and 4-grams are hashed into rows of an
embedding table; a document is the average of its rows, a softmax over it gives
the score. Table and softmax are learnt by plain stochastic gradient descent in
numpy. With two classes a row matters only through its product with the
difference of the class vectors, so scoring looks up one float a feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .textops import gram_hash, mix, prefix_hash, word_hashes

TRAIN_ROWS = 3000
THRESHOLD = 0.3
BITS = 17
DIM = 8
GRAMS = (3, 4)
#: Hash of any pair of equal words: repetition looks alike whatever the word is.
_SAME = np.uint64(0x5BD1E9955BD1E995)


def features(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every feature of a block, family by family; rows ascend in each."""
    shift = np.uint64(64 - BITS)
    out = []
    h, at = word_hashes(raw, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    out.append(((mix(h) >> shift).astype(np.int64), row))
    same_row = row[1:] == row[:-1]
    pair = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1]) * np.uint64(3) + h[1:])[same_row]
    out.append(((mix(pair) >> shift).astype(np.int64), row[1:][same_row]))
    step = 1 << 21  # of a text of any length
    for at0 in range(0, len(raw), step):
        part = raw[at0 : at0 + step + max(GRAMS) - 1]
        p = prefix_hash(part)
        for n in GRAMS:
            if len(part) < n:
                continue
            g = gram_hash(p, n)[:step]
            r = np.searchsorted(off, np.arange(at0, at0 + len(g)), "right") - 1
            inside = np.arange(at0, at0 + len(g)) + n <= off[r + 1]
            out.append(((mix(g[inside] + np.uint64(n)) >> shift).astype(np.int64), r[inside]))
    return out


def bags(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Distinct buckets of each row and their counts, as two int32 arrays on end."""
    n = len(off) - 1
    f = features(raw, off)
    key = np.concatenate([r * (1 << BITS) + b for b, r in f])
    key, count = np.unique(key, return_counts=True)
    cut = np.searchsorted(key, np.arange(n + 1) << BITS)
    return [np.concatenate([key[i:j] & ((1 << BITS) - 1), count[i:j]]).astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])]


@dataclass
class Model:
    table: np.ndarray  # one float32 a bucket
    bias: float

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros(n), np.zeros(n)
        for b, r in features(raw, off):
            total += np.bincount(r, self.table[b], n)
            count += np.bincount(r, minlength=n)
        z = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(y: np.ndarray, bag: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 1.0, seed: int = 11) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling linearly to 0.

    The output's step is plain; a feature's is its gradient times 4 * sqrt(rate * features
    of the document), so that long documents teach their words as well as short ones.
    """
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    emb = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, b = np.zeros((2, DIM), np.float32), np.log([1 - prior, prior]).astype(np.float32)
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, c in bag]
    done, total = 0, epochs * n
    for _ in range(epochs):
        for d in rng.permutation(n):
            lr = rate * (1 - done / total)
            done += 1
            i, w = bag[d][0], shares[d]
            if not len(i):
                continue
            rows = emb[i]
            hid = w @ rows
            z = out @ hid + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[d])] -= 1
            grad = p @ out
            out -= lr * p[:, None] * hid
            b -= 0.1 * lr * p
            # a row's step is scaled by the document's size, as if each of its features had been one step
            emb[i] = rows - (lr * len(i)) ** 0.5 * w[:, None] * grad * 4
    diff = out[1] - out[0]
    return Model((emb @ diff).astype(np.float32), float(b[1] - b[0]))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    def learn(y: np.ndarray, raw: list[bytes]) -> Model:
        both = [np.frombuffer(x, np.int32) for x in raw]
        return fit((y > 0).astype(int), [(x[: len(x) // 2], x[len(x) // 2 :]) for x in both])

    return labelled.fitted(docs, labels, "quality", train_rows, bags, learn)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) for every row of docs.

    Learns from at most train_rows rows of labels(doc_id, quality). Null or empty
    text gets the model's bias. A null doc_id counts as not held out. Repeated
    rows are scored each, an empty table gives no rows, without labels every score
    is 0.5. Other columns are ignored.
    """
    return labelled.score_table(docs, train(docs, labels, train_rows), THRESHOLD)


def drop_poor(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows predicted poor, all columns kept."""
    return labelled.filter_table(docs, train(docs, labels, train_rows), lambda s: s >= THRESHOLD)
