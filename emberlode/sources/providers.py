"""Embedding and reranking services behind one interface, with a local embedder.

A provider is a function from texts to vectors. The hashing embedder needs no
model: it is for tests and for machines without one.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], np.ndarray]
BATCH, ATTEMPTS, IN_FLIGHT = 32, 3, 16
#: Texts whose token matrices are made before they leave the worker.
MATRICES = 256
#: Tokens of a text that the dense vector sees, of a late-interaction query and of a document.
DENSE_LEN, QUERY_LEN, DOC_LEN = 256, 32, 512


class TokenModel(Protocol):
    """A model that turns tokens into states; cls, query, doc, sep and mask are its ids for the marks."""

    cls: int
    query: int
    doc: int
    sep: int
    mask: int
    skip: frozenset[int]

    def tokenise(self, texts: list[str]) -> list[list[int]]:
        """Ids without marks, cut nowhere."""

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(texts, tokens, dimensions) of padded ids; mask is 0 at padding."""


def hashing_embedder(dim: int = 384) -> Embed:
    """Signed counts of hashed lower-case words, L2-normalised."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def retried(call: Callable[[], object], attempts: int = ATTEMPTS, wait: float = 0.5) -> object:
    """call's result; a failure with retry_after is waited for, others back off."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001  any failure of a remote service
            if i == attempts - 1:
                raise
            time.sleep(getattr(e, "retry_after", None) or wait * 2**i)
    raise AssertionError


def ordered(results: list[tuple[int, list[float]]], n: int, dim: int) -> np.ndarray:
    """An embedding service's (index, vector) results in input order, each L2-normalised and of dim numbers; 0 where there is none."""
    out = np.zeros((n, dim), np.float32)
    for i, v in results:
        if 0 <= i < n:
            out[i] = fitted(np.asarray([v], np.float32), dim)[0]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def fitted(v: np.ndarray, dim: int) -> np.ndarray:
    """Vectors padded with zeros or cut to a length."""
    return np.pad(v[:, :dim], ((0, 0), (0, max(0, dim - v.shape[1]))))


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked tokens, L2-normalised."""
    m = mask[..., None].astype(np.float32)
    v = (states * m).sum(1) / np.maximum(m.sum(1), 1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def service_embedder(call: Callable[[list[str]], list[tuple[int, list[float]]]], dim: int, in_flight: int = IN_FLIGHT) -> Embed:
    """An embedder over a service: call(texts) gives (index, vector) pairs in any order; several requests run at a time, each is retried."""

    def embed(texts: list[str]) -> np.ndarray:
        batches = [texts[i : i + BATCH] for i in range(0, len(texts), BATCH)]
        with ThreadPoolExecutor(max(1, min(in_flight, len(batches)))) as pool:
            parts = list(pool.map(lambda b: ordered(retried(lambda: call(b)), len(b), dim), batches))
        return np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)

    embed.asks_for = BATCH * in_flight  # what embed_column gives at once, so that requests overlap
    return embed


def padded(ids: list[list[int]], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) as rectangles."""
    width = max(map(len, ids), default=0)
    out, mask = np.full((len(ids), width), fill, np.int64), np.zeros((len(ids), width), np.int8)
    for row, seen, x in zip(out, mask, ids):
        row[: len(x)], seen[: len(x)] = x, 1
    return out, mask


def dense_embedder(model: TokenModel, most: int = DENSE_LEN) -> Embed:
    """Dense vectors of a token model: at most so many tokens, masked mean of the states, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        ids, mask = padded([x[:most] for x in model.tokenise(texts)], model.mask)
        return mean_pooled(model.states(ids, mask), mask)

    return embed


@dataclass
class HashedStates:
    """A token model without weights: a token's state is drawn from its id and leans to its neighbours'. For tests and for machines without a model."""

    dim: int = 48
    cls: int = 0
    query: int = 1
    doc: int = 2
    sep: int = 3
    mask: int = 4
    words: int = 1 << 15

    @cached_property
    def skip(self) -> frozenset[int]:
        """Tokens that documents aren't matched by: single marks of punctuation."""
        return frozenset(self._id(chr(c)) for c in range(33, 127) if not chr(c).isalnum())

    def _id(self, token: str) -> int:
        return 5 + zlib.crc32(token.encode()) % self.words

    def tokenise(self, texts: list[str]) -> list[list[int]]:
        return [[self._id(w) for w in re.findall(r"\w+|[^\w\s]", t.lower())] for t in texts]

    @cached_property
    def _table(self) -> np.ndarray:
        return np.random.default_rng(7).standard_normal((self.words + 5, self.dim)).astype(np.float32)

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        own = self._table[ids] * mask[..., None]
        out = own.copy()
        if own.shape[1] > 1:
            out[:, 1:] += 0.25 * own[:, :-1]
            out[:, :-1] += 0.25 * own[:, 1:]
        return out


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def query_tokens(model: TokenModel, text: str) -> np.ndarray:
    """A query's token vectors for the late interaction: marked, padded with masks, unit rows."""
    ids = np.array([token_ids(model.tokenise([text])[0], True, model.cls, model.query, model.sep, model.mask, QUERY_LEN)])
    return _units(model.states(ids, np.ones_like(ids, np.int8)))[0]


def token_matrix(states: np.ndarray) -> tuple[bytes, float, np.ndarray]:
    """(int8 rows, scale, pooled) of one text's token states: unit rows; the scale is the largest absolute value, halves round up; the pooled vector is the mean row, of unit length."""
    rows = _units(states.astype(np.float32))
    scale = float(np.abs(rows).max(initial=0.0)) or 1.0
    whole = np.clip(np.floor(rows / np.float32(scale) * 127 + 0.5), -127, 127).astype(np.int8)
    return whole.tobytes(), scale, _units(rows.mean(0)) if len(rows) else np.zeros(states.shape[1], np.float32)


TOKEN_COLUMNS = "colbert binary, colbert_scale double, pooled array<float>, doc_token_ids array<int>"


def token_columns(df: DataFrame, text: str, make: Callable[[], TokenModel]) -> DataFrame:
    """df with colbert, colbert_scale, pooled and doc_token_ids: the token matrices of its texts, in one Arrow stage.

    The model is made once a task and asked in batches of like length, so padding is
    short. MATRICES texts are held at a time, so a worker's memory follows these and not
    Arrow's batch. Null is an empty text; it has the rows of its marks.
    """
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in (b.slice(i, MATRICES) for b in batches for i in range(0, len(b), MATRICES)):
            texts = [t or "" for t in b.column(names.index(text)).to_pylist()]
            ids = [token_ids(x, False, model.cls, model.doc, model.sep, model.mask, doc_len=DOC_LEN) for x in model.tokenise(texts)]
            out: list = [None] * len(ids)
            order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                states = model.states(*padded([ids[i] for i in some], model.mask))
                for i, s in zip(some, states):
                    out[i] = token_matrix(s[: len(ids[i])])
            cols = [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.list_(pa.float32())), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, *[c.split()[0] for c in TOKEN_COLUMNS.split(", ")]])

    return df.mapInArrow(rows, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {TOKEN_COLUMNS}")


def embed_column(df: DataFrame, text: str, make: Callable[[], Embed], dim: int, out: str = "vector") -> DataFrame:
    """df with a vector; the model is made once a task and asked in batches."""
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = [t or "" for t in b.column(names.index(text)).to_pylist()]
            step = getattr(model, "asks_for", BATCH)
            parts = [fitted(np.asarray(retried(lambda i=i: model(texts[i : i + step])), np.float32), dim) for i in range(0, len(texts), step)]
            v = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], names=[*names, out])

    return df.mapInArrow(rows, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<float>")


def scattered(results: list[tuple[int, float]], n: int) -> list[float]:
    """Reranker results (index, score) in input order; 0 where there is none."""
    out = [0.0] * n
    for i, s in results:
        if 0 <= i < n:
            out[i] = s
    return out


def token_ids(ids: list[int], query: bool, cls: int, mark: int, sep: int, mask: int, query_len: int = 32, doc_len: int = 512) -> list[int]:
    """Late-interaction input: a marked query padded with masks, or a marked document cut to size."""
    if query:
        out = [cls, mark, *ids[: query_len - 3], sep]
        return out + [mask] * (query_len - len(out))
    return [cls, mark, *ids[: doc_len - 3], sep]
