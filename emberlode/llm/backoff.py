"""Language-model scores of a corpus by stupid backoff.

Counts of all words and of all runs of up to `order` words form a table
partitioned by hash; the runs of the documents are joined to it and the
logarithms are summed by document. A document's own occurrences are taken off the
counts, so a text isn't made likely by itself. With c the counts that are left, N
the words that are left and u the words before w, order - 1 of them or as many as
the text has,
    S(w | u) = c(u w) / c(u)               where c(u w) > 0,
               ALPHA * S(w | u without its first word)   otherwise, u having words,
               c(w) / N                    where u has none and c(w) > 0,
               ALPHA / (N + 1)             otherwise.
The tables and joins run in blocks (see blocks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .textops import LOWER, doc_blocks, mix, word_hashes

ALPHA = 0.4


def _grams(t: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words, and of the runs of 2 to order words that end at each (0 where the text has fewer), and word offsets of a batch."""
    raw, off = blocks.batch_texts(t)
    words, at = [], [np.zeros(1, np.int64)]
    for i, j in doc_blocks(off):
        h, a = word_hashes(LOWER[raw[off[i] : off[j]]], off[i : j + 1] - off[i])
        words.append(h | np.uint64(1))  # odd: a word
        at.append(a[1:] + at[-1][-1])
    w = np.concatenate(words) if words else np.zeros(0, np.uint64)
    off = np.concatenate(at)
    before = np.arange(len(w)) - np.repeat(off[:-1], np.diff(off))
    grams = [w]
    for k in range(1, order):
        run = np.zeros(len(w), np.uint64)
        run[1:] = mix(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) & ~np.uint64(1)  # even: a run
        run[before < k] = 0
        grams.append(run)
    return grams, off


def _own(row: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """For each place, how often its row holds its key."""
    _, inv, count = np.unique(row * keys + key, return_inverse=True, return_counts=True)
    return count[inv]


def lm_scores(docs: DataFrame, alpha: float = ALPHA, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_pairs_seen, n_words_seen, log_score of every row of docs(doc_id, text).

    Words are lower-cased (A-Z) and lie between white space. log_score is the sum
    of ln S over the words; n_pairs_seen counts those scored by a pair,
    n_words_seen by a word, and from order 3 on n_3grams_seen and so on, the longest
    first, those scored by a longer run. Null or empty text has no words and scores
    0. Repeated rows, and rows with a null id, are documents of their own and their
    counts count. An empty table gives no rows; other columns are ignored.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    names = [f"n_{k}grams_seen" for k in range(order, 2, -1)] + ["n_pairs_seen", "n_words_seen"]
    n = blocks.n_batches(docs)
    texts = blocks.batched(docs, n)
    total = docs.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0

    def keys_of(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([g[g != 0] for g in grams]), return_inverse=True, return_counts=True)

    def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        k, _, count = keys_of(_grams(t, order)[0])
        return blocks.ask(int(key[0].as_py()), k, count.astype(np.int64), n)

    def add(group, start, vals, by_key) -> np.ndarray:
        return np.add.reduceat(by_key, start)[group].astype(np.int64)

    def score(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        grams, off = _grams(t, order)
        k, inv, _ = keys_of(grams)
        count = blocks.collect_answers(answers, np.int64)
        rows = len(off) - 1
        size = np.diff(off)
        row = np.repeat(np.arange(rows), size)
        left = (total - size)[row].astype(float)
        # from words to longer runs: the longest that is seen gives S, each that is not costs alpha
        s, seen, context, at = np.log(alpha) - np.log(left + 1), np.zeros(len(row), np.int8), left, 0
        for length, g in enumerate(grams, 1):
            has = np.flatnonzero(g != 0)
            c = np.zeros(len(row))
            if len(has):
                of = inv[at : at + len(has)]
                c[has] = count[of] - _own(row[has], of, len(k))
            at += len(has)
            on = c > 0
            back = np.where(g != 0, np.log(alpha), 0.0) if length > 1 else 0.0
            s = np.where(on, np.log(np.maximum(c, 1) / np.maximum(context, 1)), s + back)
            seen[on] = length
            context = np.zeros(len(row))
            context[1:] = c[:-1]
        sums = lambda x: np.bincount(row, x, rows) if len(row) else np.zeros(rows)
        whole = lambda x: pa.array(np.rint(x).astype(np.int64))
        by = {name: whole(sums((seen == order - i).astype(float))) for i, name in enumerate(names)}
        return pa.table({"doc_id": t["doc_id"], "n_words": whole(size)} | by | {"log_score": pa.array(sums(s), pa.float64())})

    answers = blocks.answered(texts.groupBy("b").applyInArrow(ask, blocks.BLOCK_SCHEMA), np.int64, add)
    return texts.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, f"doc_id long, n_words long, {', '.join(f'{x} long' for x in names)}, log_score double")
