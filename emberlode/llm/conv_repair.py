"""Repair of the turn structure of conversations at least cost.

Every row of a conversation is one symbol of a signature: its role's initial and its
fault. The signatures are dealt by range and walked in sorted order, which is the
preorder of their prefix trie: a stack holds the layers of the dynamic programme along
the current path, so a layer is computed once for all signatures that share the prefix,
and an answer is read off at a terminal node. The texts are sorted by conversation once
and stream past the edits, so no conversation is ever held as a whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated row that stays costs OPEN more.
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 3, 4, 3, 3
#: What costs more above the least cost is in no cheapest answer: two insertions lead from
#: anywhere to a whole pair, which can follow all that another state does but for one row.
SLACK = 2 * INSERT + DELETE
#: What has been put out: nothing, s, u (an a must follow), a whole pair.
START, SYSTEM, USER, PAIR = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
#: A row or an insertion may take the next role, if that is u or a.
NEXT = {START: USER, SYSTEM: USER, USER: PAIR, PAIR: USER}
LEGAL = ("su", "ua", "au")
#: Symbols: the initial (o: none of s, u, a), upper case if truncated; x must go.
GONE = "x"


def _text(column: str) -> Column:
    """Null is one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _plain(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), *more)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: conversations with one fault by crc32 of `conv_id:turn` modulo 20.

    0 drops the row (it stays with dropped true, so that its conversation is known), 1
    empties the text, 2 removes its .!?, 3 repeats the row, 4 makes it the user's. Null
    is one space, in the key, the role and the text; a turn stays null.
    """
    kind = (F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20).cast("int")
    out = _plain(rows, kind.alias("kind"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("_"))
    return out.drop("_")


def _same() -> Column:
    """Tells role and text apart by 128 bits."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows(conv_id, turn, role, text, dropped): counts of faults, and its signature.

    Rows go by turn (nulls first), then role and text. A row's first fault counts: blank,
    duplicate (role and text stood before), truncated (the last character that isn't
    white space is not .!?). A conversation whose rows are all dropped has zeros and an
    empty signature. Repeats are told by a window over (conversation, role and text), and
    the rows then stream by conversation: a task holds a byte a row of one of them.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    facts = rows.select("conv_id", "turn", "role", "dropped", F.when(F.col("dropped"), F.lit(None).cast("binary")).otherwise(_same()).alias("same"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    before = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("turn")) > 1
    facts = facts.select("conv_id", "turn", "role", "dropped", "same", F.substring("role", 1, 1).alias("initial"), F.when(F.col("blank"), 1).when(before, 2).when(F.col("open"), 3).otherwise(0).alias("fault"))
    facts = facts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "same")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, open_ = None, [], False
        for b in batches:
            for c, turn, dropped, first, fault in zip(*(x.to_pylist() for x in b.columns)):
                if not open_ or c != conv:
                    if open_:
                        out.append(one.row(conv))
                    conv, open_, one = c, True, _Facts()
                if not dropped:
                    one.add(turn, first, fault)
            yield _table(out, REPORT)
            out = []
        if open_:
            yield _table([one.row(conv)], REPORT)

    return facts.select("conv_id", "turn", "dropped", "initial", "fault").mapInArrow(told, REPORT)


class _Facts:
    """What the rows of one conversation say, in order."""

    def __init__(self) -> None:
        self.least = self.most = None
        self.turns, self.faults, self.illegal, self.last, self.signature = 0, [0, 0, 0, 0], 0, None, bytearray()

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        known = initial if initial and initial in "sua" else "o"
        self.signature += (GONE if fault in (1, 2) else known.upper() if fault == 3 else known).encode()

    def row(self, conv: int | None) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (conv, gaps, *self.faults[1:], self.illegal, self.signature.decode())


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows) if rows else [()] * len(cols), cols)], names=[n for n, _ in cols])


# A layer stands for all edit strings over the rows so far. Of those that end in each
# state with the row's own letter (arrived) and after insertions (left) it keeps the best:
#   arrived[state] = (cost, state of the layer before, letter, rank) or None
#   left[state] = (cost, arrived state, insertions) or None
# Costs are less the least cost, which is kept beside the layer, so there are few layers
# and a node of the trie refers to one of them.
# Two arrived strings have as many letters other than I and end in one, so neither begins
# the other: their order, the rank, stays the order of all that follows. Strings of one
# cost that end alike in insertions can't differ by those alone, since each costs.
Layer = tuple[tuple, tuple]


def _left(arrived: list) -> tuple[Layer, int]:
    least = min(a[0] for a in arrived if a)
    arrived = [(a[0] - least, *a[1:]) if a and a[0] - least <= SLACK else None for a in arrived]
    best: list = [None] * 4
    for at, a in enumerate(arrived):
        if a:
            state, cost = at, a[0]
            for n in range(4):
                key = (cost, a[3], n, at)
                if best[state] is None or key < best[state]:
                    best[state] = key
                state, cost = NEXT[state], cost + INSERT
    return (tuple(arrived), tuple(b and (b[0], b[3], b[2]) for b in best)), least


@lru_cache(maxsize=None)
def first_layer() -> Layer:
    return _left([(0, START, "", 0), None, None, None])[0]


@lru_cache(maxsize=1 << 16)
def next_layer(layer: Layer, symbol: str) -> tuple[Layer, int]:
    """The layer after one more row, and what its least cost adds."""
    arrived, left = layer
    initial, more = symbol.lower(), OPEN if symbol.isupper() else 0
    best: list = [None] * 4
    for state, way in enumerate(left):
        if way is None:
            continue
        cost, at, inserted = way
        moves = [("D", DELETE, state)]
        if symbol != GONE:
            moves.append(("R", REROLE + more, NEXT[state]))
            if (state, initial) in AFTER:
                moves.append(("K", KEEP + more, AFTER[state, initial]))
        for letter, price, to in moves:
            key = (cost + price, arrived[at][3], "I" * inserted + letter, state, letter)
            if best[to] is None or key < best[to]:
                best[to] = key
    order = sorted(k[1:3] for k in best if k)
    return _left([k and (k[0], k[3], k[4], order.index(k[1:3])) for k in best])


class Trie:
    """The path of the signature prefix trie that a sorted walk is on: a layer a node."""

    def __init__(self) -> None:
        self.signature, self.layers, self.costs, self.computed = "", [first_layer()], array("q", [0]), 0

    def answer(self, signature: str) -> tuple[int, str]:
        """Least cost and the ASCII-least cheapest edits of a signature; layers of the prefix shared with the last one stay."""
        same = _shared(self.signature, signature)
        del self.layers[same + 1 :], self.costs[same + 1 :]
        for symbol in signature[same:]:
            layer, more = next_layer(self.layers[-1], symbol)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + more)
            self.computed += 1
        self.signature = signature
        arrived, left = self.layers[-1]
        cost, _, _, state = min((left[s][0], arrived[left[s][1]][3], left[s][2], s) for s in (START, PAIR) if left[s])
        back = []
        for arrived, left in reversed(self.layers):
            _, at, inserted = left[state]
            back.append("I" * inserted + arrived[at][2][::-1])
            state = arrived[at][1]
        return self.costs[-1] + cost, "".join(back)[::-1]


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


ANSWER = REPORT + ", cost long, audit string"


def solve(reports: DataFrame) -> DataFrame:
    """reports of signatures() with cost and audit: the cheapest edits' initials in order.

    Dealt by range of (signature, conv_id): like signatures lie together and their
    answers are made once, yet a signature that a third of all conversations have fills
    many tasks.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, answer = Trie(), None, None
        for b in batches:
            costs, audits = [], []
            for s in b.column("signature").to_pylist():
                if s != last:
                    last, answer = s, trie.answer(s)
                costs.append(answer[0])
                audits.append(answer[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*b.schema.names, "cost", "audit"])

    return reports.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id").mapInArrow(walk, ANSWER)


class _Edits:
    """Applies a conversation's audit to its rows as they stream past."""

    def __init__(self, audit: str):
        self.audit, self.at, self.n, self.system = audit, 0, 0, 0

    def _out(self, role: str | None, text: str) -> tuple[str, str]:
        role = ("user", "assistant")[(self.n - self.system) % 2] if role is None else role
        self.n += 1
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.system += self.n == 0 and role[:1] == "s"
            yield self._out(role, text)
        elif letter == "R":
            yield self._out(None, text)


def _streams(rows: DataFrame, answers: DataFrame, schema: str, make, names: list[str]) -> DataFrame:
    """Each answer, then its conversation's rows in order; make(answer) has add(role, text) and end(), which give rows out."""
    none = lambda kind: F.lit(None).cast(kind)
    head = answers.select("conv_id", F.lit(0).alias("_k"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("_s"), none("string").alias("text"), F.struct(*names).alias("answer"))
    body = rows.where("not dropped").select("conv_id", F.lit(1).alias("_k"), "turn", "role", _same().alias("_s"), "text", F.lit(None).cast(head.schema["answer"].dataType).alias("answer"))
    every = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "_k", "turn", "role", "_s")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out: list[tuple] = []
            for conv, k, role, text, answer in zip(*(x.to_pylist() for x in b.columns)):
                if k == 0:
                    if now is not None:
                        out += now.end()
                    now = make(conv, answer)
                else:
                    out += now.add(role, text)
            yield _table(out, schema)
        if now is not None:
            yield _table(list(now.end()), schema)

    return every.select("conv_id", "_k", "role", "text", "answer").mapInArrow(edit, schema)


ROWS = "conv_id long, position long, role string, text string"
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TOLD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text: the rows of every conversation after its edits."""

    class Rows:
        def __init__(self, conv: int | None, answer: dict):
            self.conv, self.edits, self.n = conv, _Edits(answer["audit"]), 0

        def _numbered(self, out: Iterator[tuple[str, str]]) -> Iterator[tuple]:
            for role, text in out:
                yield self.conv, self.n, role, text
                self.n += 1

        def add(self, role: str, text: str) -> Iterator[tuple]:
            return self._numbered(self.edits.row(role, text))

        def end(self) -> Iterator[tuple]:
            return self._numbered(self.edits.inserted())

    return _streams(rows, answers, ROWS, Rows, ["audit"])


def digests(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers with repaired_sha256: that of the repaired `role:text`, joined by newlines, hashed as the rows stream past."""

    class Digest:
        def __init__(self, conv: int | None, answer: dict):
            self.conv, self.answer, self.edits, self.hash, self.n = conv, answer, _Edits(answer["audit"]), hashlib.sha256(), 0

        def _hashed(self, out: Iterator[tuple[str, str]]) -> None:
            for role, text in out:
                self.hash.update(("\n" * (self.n > 0) + f"{role}:{text}").encode())
                self.n += 1

        def add(self, role: str, text: str) -> tuple:
            self._hashed(self.edits.row(role, text))
            return ()

        def end(self) -> Iterator[tuple]:
            self._hashed(self.edits.inserted())
            yield (self.conv, *[self.answer[c] for c in TOLD], self.hash.hexdigest())

    return _streams(rows, answers, DIGESTS, Digest, TOLD)


def repair(conversations: DataFrame, damaged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, answers) of conversations(conv_id, turn, role, text), damaged first unless damaged says that they are.

    Each conversation's rows are kept, given to the user or assistant (3), deleted (4; blank
    and duplicate rows must go), or empty rows of either are inserted (3); a truncated row
    that stays costs 3. The result's role initials are (s?(ua)+)?, at least cost, of those
    the ASCII-least letters K, R, D, I. Null ids are one conversation; null roles and texts
    are one space; null turns come first; rows alike in turn go by role, then text. Empty
    tables give no rows; other columns are ignored. Texts and conversations may be of any
    length: rows stream, and only the audit, a letter or so a row, is held.
    """
    rows = _plain(conversations, F.lit(False).alias("dropped")) if damaged else damage(conversations)
    return rows, solve(signatures(rows))
