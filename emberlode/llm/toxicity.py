"""Counterfactual-regularised toxicity classifier.

A logistic model over the words and beginnings of words that a text holds, fitted by
proximal gradient steps with an L1 penalty, so that only words with real evidence
keep a weight. In each labelled sentence that names a group the term is swapped for
every other term of its set and for none: all its features go, its beginnings too, and
those of the other come where the sentence lacks them. Squared changes of the score
are penalised, as a mean by term, so a frequent term doesn't hide a rare one. Samples
of labelled sentences without a term get each term as a neutral mention: their score
must not change either. So naming a group neither raises nor lowers a score by itself.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .textops import LOWER, NOT_ALNUM, word_hashes

TRAIN_ROWS = 8000
THRESHOLD = 0.5
#: Labelled rows that a feature must be in.
MIN_ROWS = 3
#: Bytes of the word beginnings that are features, for inflected forms.
BEGINS = (4, 5, 6, 7, 8, 9)
#: Terms for groups of people, by set; a term is swapped within its set.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("american", "mexican", "chinese", "indian", "german", "french", "turkish", "russian"),
)


def term_columns(words: list[str]) -> list[np.ndarray]:
    """Hashes of all features of each word: the word and its beginnings."""
    raw = " ".join(words).encode()
    h, _ = word_hashes(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), NOT_ALNUM, BEGINS)
    return [c[c != 0] for c in h.T]


def identity_features() -> np.ndarray:
    """Features of all identity terms, ascending."""
    return np.unique(np.concatenate([c for g in IDENTITY_TERMS for c in term_columns(list(g))]))


def word_sets(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Distinct hashes of the words, and beginnings of words, of each row."""
    h, at = word_hashes(LOWER[raw], off, NOT_ALNUM, BEGINS)
    sets = (np.unique(h[:, i:j]) for i, j in zip(at[:-1], at[1:]))
    return [s[s != 0].tobytes() for s in sets]


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        z = np.full(n, self.bias)
        if len(self.words) and len(raw):
            every, at = word_hashes(LOWER[raw], off, NOT_ALNUM, BEGINS)
            found = []
            for h in every:
                i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                hit = np.flatnonzero(self.words[i] == h)
                row = np.searchsorted(at, hit, "right") - 1
                found.append(row * len(self.words) + i[hit])
            pair = np.unique(np.concatenate(found))
            z += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def counterfactuals(sets: list[np.ndarray], mentions: int, rng: np.random.Generator) -> list[tuple[list[int], list[int], float]]:
    """(features that come, features that go, weight) of each kind of swap in the rows; a term's weights sum to 1."""
    named = [term_columns(list(g)) for g in IDENTITY_TERMS]
    word = {int(c[0]): (g, k) for g, group in enumerate(named) for k, c in enumerate(group)}
    key = np.array(sorted(word), np.uint64)
    out: list[tuple[list[int], list[int], float]] = []
    kinds: dict[tuple[int, int], Counter] = defaultdict(Counter)
    plain = []
    for i, s in enumerate(sets):
        at = np.searchsorted(s, key)
        there = key[(at < len(s)) & (s[np.minimum(at, len(s) - 1)] == key)] if len(s) else key[:0]
        for h in there.tolist():
            g, k = word[h]
            for b, new in enumerate(named[g]):
                if b != k:
                    kinds[g, k][tuple(np.setdiff1d(new, s).tolist())] += 1
            kinds[g, k][()] += 1
        if not len(there):
            plain.append(i)
    for g, group in enumerate(named):
        for k, c in enumerate(group):
            if n := sum(kinds[g, k].values()):
                out += [(list(come), c.tolist(), m / n) for come, m in kinds[g, k].items()]
            some = rng.choice(plain, min(mentions, len(plain)), replace=False) if plain else []
            out += [(np.setdiff1d(c, sets[i]).tolist(), [], 1 / len(some)) for i in some]
    return out


def fit(y: np.ndarray, sets: list[np.ndarray], least: float = 3.0, swap: float = 1.0, steps: int = 400, min_rows: int = MIN_ROWS, mentions: int = 8, seed: int = 7) -> Model:
    """sets: ascending hashes of each row. least: evidence, in labels, that a word needs for a weight. swap: weight of the counterfactual penalty."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 2)
    if n == 0 or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    words, df = np.unique(np.concatenate(sets), return_counts=True)
    words = np.union1d(words[df >= min_rows], identity_features())
    m = len(words)
    # rows by columns, once in the order of rows and once in that of columns
    cols = []
    for s in sets:
        at = np.searchsorted(words, s)
        at = at[at < m]
        cols.append(at[words[at] == s[: len(at)]].astype(np.int32))
    size = np.array([len(c) for c in cols])
    col, row = np.concatenate(cols), np.repeat(np.arange(n, dtype=np.int32), size)
    by = np.argsort(col, kind="stable")
    down, cut = row[by], np.searchsorted(col[by], np.arange(m + 1))
    del by, row, cols
    some_rows, some_cols = np.flatnonzero(size), np.flatnonzero(np.diff(cut))
    row_at, col_at = (np.cumsum(size) - size)[some_rows], cut[:-1][some_cols]

    def across(w: np.ndarray) -> np.ndarray:
        z = np.zeros(n)
        if len(col):
            z[some_rows] = np.add.reduceat(w[col], row_at)
        return z

    def back(e: np.ndarray) -> np.ndarray:
        g = np.zeros(m)
        if len(down):
            g[some_cols] = np.add.reduceat(e[down], col_at)
        return g

    rng = np.random.default_rng(seed)
    swaps = counterfactuals(sets, mentions, rng) if swap else []
    pair = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
    pcol = np.searchsorted(words, np.array([x for a, b, _ in swaps for x in (*a, *b)], np.uint64))
    sign = np.array([x for a, b, _ in swaps for x in [1.0] * len(a) + [-1.0] * len(b)])
    share = swap * np.array([x for _, _, x in swaps])

    def pushed(w: np.ndarray) -> np.ndarray:
        """Half the gradient of the penalty."""
        if not len(swaps):
            return np.zeros(m)
        d = np.bincount(pair, sign * w[pcol], len(swaps)) * share
        return np.bincount(pcol, sign * d[pair], m)

    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    v, vb, t = w.copy(), b, 1.0
    # a step that the curvature of loss and penalty allows, by power iteration
    u, norm = rng.standard_normal(m), 1.0
    for _ in range(30):
        u = 0.25 / n * back(across(u)) + 2 * pushed(u)
        norm = np.linalg.norm(u)
        u /= norm or 1.0
    step = 1 / (1.1 * norm + 0.25)
    for _ in range(steps):
        e = (1 / (1 + np.exp(-np.clip(across(v) + vb, -40, 40))) - y) / n
        new = v - step * (back(e) + 2 * pushed(v))
        new = np.sign(new) * np.maximum(np.abs(new) - step * least / n, 0)
        nb = vb - step * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    on = np.flatnonzero(w)
    return Model(words[on], w[on], float(b))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    learn = lambda y, sets: fit((y > 0).astype(float), [np.frombuffer(s, np.uint64) for s in sets])
    return labelled.fitted(docs, labels, "toxic", train_rows, word_sets, learn, MIN_ROWS, identity_features())


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) for every row of docs.

    Learns from at most train_rows rows of labels(doc_id, toxic). Null or empty
    text gets the model's bias. A null doc_id counts as not held out. Repeated
    rows are scored each, an empty table gives no rows, without labels every score
    is a low prior. Other columns are ignored.
    """
    return labelled.score_table(docs, train(docs, labels, train_rows), THRESHOLD)


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept."""
    return labelled.filter_table(docs, train(docs, labels, train_rows), lambda s: s < THRESHOLD)
