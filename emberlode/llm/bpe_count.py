"""Token counts by heap-and-linked-list byte-pair merging, without ids.

A text's symbols form a linked list and every adjacent pair that is a piece
waits in a heap; the pair of the lowest rank (the leftmost of equals) is popped
and merged until none is left. The count is the number of initial symbols minus
the merges; a symbol outside the vocabulary counts its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MARK = "▁"
LIMIT = 4096
CACHE = 600_000
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class MergeCounter:
    """Counts the pieces of a BPE model; repeated units are looked up."""

    def __init__(self, name: str = "piece_bpe_32k.model", cache: int = CACHE):
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {p: -s for p, s in pieces}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece crosses a word's start: texts can't be cut there")
        # what the model's normaliser does to white space, seen from outside
        if sp.encode("a  b", out_type=str) == sp.encode("a b", out_type=str) or not sp.encode("a", out_type=str)[0].startswith(MARK):
            raise ValueError("only models that keep white space and add a first mark")
        self.seen: dict[str, int] = {}
        self.cache = cache

    def merge(self, unit: str) -> int:
        """Symbols left of one unit when no pair can be merged."""
        rank = self.rank
        if unit in rank and len(unit) == 1:
            return 1
        sym: list[str] = list(unit)
        n = len(sym)
        count = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in sym)
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(sym[i] + sym[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, size = heappop(heap)
            left = sym[i]
            if not left or (j := after[i]) >= n or len(left) + len(sym[j]) != size:
                continue  # one of the two has been merged since
            sym[i] = left = left + sym[j]
            sym[j] = ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(left + sym[k])) is not None:
                    heappush(heap, (r, i, len(left) + len(sym[k])))
            if (h := before[i]) >= 0 and (r := rank.get(sym[h] + left)) is not None:
                heappush(heap, (r, h, len(sym[h]) + len(left)))
        return count

    def _miss(self, unit: str) -> int:
        out = self.merge(MARK + unit)
        if len(unit) <= 64:
            if len(self.seen) >= self.cache:
                self.seen.clear()
            self.seen[unit] = out
        return out

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
            units = _UNITS.findall(MARK + text.replace(" ", MARK))
            return sum(self.seen[u[1:]] if u[1:] in self.seen and u[0] == MARK else self._miss(u[1:]) for u in units)
        get, total = self.seen.get, 0
        for unit in text.split(" "):
            n = get(unit)
            total += self._miss(unit) if n is None else n
        return total


@lru_cache(maxsize=2)
def counter(name: str = "piece_bpe_32k.model") -> MergeCounter:
    return MergeCounter(name)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, limit: int = LIMIT, model: str = "piece_bpe_32k.model") -> DataFrame:
    """n_bytes, n_tokens and over_limit of every row of docs(doc_id, text).

    Null or empty text counts 0. A null doc_id stays null, repeated rows are
    counted each, an empty table gives no rows, other columns are ignored.
    No shuffle; a worker keeps a bounded cache of counted units.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=COUNTS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
