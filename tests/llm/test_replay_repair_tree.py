"""Filter audit, conversation repair and tree-joined BPE against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlode.llm import bpe_tree, conv_repair, filter_audit, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"

# filter audit


def fails(t, first):
    w = WORD.findall(t)
    tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": not first}
    return {k for k, v in tests.items() if v}


def audited(docs, labels):
    least, out = {}, defaultdict(Counter)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for i, t, lang in docs:
        bad = fails(t or "", i is None or least[t or ""] == i)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[lang or "", "".join(order), step]
                hit = f in bad
                c.update(dict(zip(names, (not gone and not hit, not gone and hit, gone and hit, bad == {f}, not gone and hit and i in good, not gone and hit and i in toxic))))
                gone |= hit
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    return {(*k, *[int(c[n]) for n in names], total[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_filter_audit(spark):
    long = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(20))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long + " #", "de"), (4, None, None), (5, "", ""), (6, "ONE two", "en"), (7, " \t\x0b\x1c a\x85b ", "en"), (8, "same " * 300, "en"), (None, long, "en"),
        (None, "one two", "fr"), (-5, "ONE two", "fr"), (9, "Ä É ß 漢字 " + long, "fr"), (9, "other of nine", "fr"), (10, "x" * 300_000 + " " + long, "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, None, 1), (5, 1, 1), (99, 1, 1), (None, 1, 1)]
    # extra columns with names that the operator uses
    rows = spark.createDataFrame([(*d, True, "p", 0, 7) for d in docs], "doc_id long, text string, lang string, A boolean, part string, fails int, good int").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(rows, told)
    got = out.collect()
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got} == audited(docs, labels) and len(got) == 600 * 4
    assert filter_audit.audit(rows.limit(0), told).count() == 0
    assert {tuple(r) for r in filter_audit.audit(rows, told.limit(0)).collect()} == audited(docs, [])


def test_filter_audit_counts_before_the_shuffle(spark):
    plan = queries.op11_filter_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan and not any(x in plan for x in ("Python", "Arrow", "CartesianProduct"))


def test_replay_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False, False, True), ("p", True, True, True, False), ("p", False, False, False, False), (None, None, True, True, True)], "part string, x boolean, y boolean, good boolean, toxic boolean")
    got = {tuple(r) for r in filter_audit.replay(rows, "xy").collect()}
    assert ("p", "xy", 1, 1, 2, 0, 1, 1, 1, 3) in got and ("p", "xy", 2, 1, 0, 1, 0, 0, 0, 1) in got and (None, "yx", 1, 0, 1, 0, 1, 1, 1, 2) in got and len(got) == 8
    for bad in ("", "xx", "abcdefgh", ["ab"]):
        with pytest.raises(ValueError):
            filter_audit.replay(rows, bad)


# conversation repair


def cheapest(rows):
    """(cost, letters, repaired) by searching all edits in order of (cost, letters); rows: (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, end, out = heappop(heap)
        if i == len(rows) and end in ("", "a"):
            return cost, letters, out
        if (i, end) in done:
            continue
        done.add((i, end))
        role = "a" if end == "u" else "u"
        name = {"u": "user", "a": "assistant"}[role]
        heappush(heap, (cost + 3, letters + "I", i, role, (*out, f"{name}:")))
        if i < len(rows):
            r, t, fault = rows[i]
            heappush(heap, (cost + 4, letters + "D", i + 1, end, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heappush(heap, (cost + 3 + more, letters + "R", i + 1, role, (*out, f"{name}:{t}")))
                if r[:1] == role or r[:1] == "s" and end == "":
                    heappush(heap, (cost + more, letters + "K", i + 1, r[:1], (*out, f"{r}:{t}")))
    raise AssertionError


def told(rows, ids):
    """Digest rows of damaged rows {conv: [(turn, role, text)]}."""
    for c in ids:
        mine, seen, marked = sorted(rows.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())), set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        n = Counter(f for *_, f in marked)
        turns = [t for t, *_ in mine if t is not None]
        cost, letters, out = cheapest(marked)
        yield (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(conversations):
    out = defaultdict(list)
    for c, turn, role, text in conversations:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out[c] += [] if k == 0 else [row, row] if k == 3 else [row]
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s", "User"]), rng.choice(["Hello there.", "no end", " ", "", "What?\n ", "a\x1c", "é!", "x" * 50_000])) for c in range(120) for t in range(rng.randrange(1, 12))]
    rows += [(1000, t, "user", f"turn {t}.") for t in range(700)] + [(1001, 2**40, "user", "far."), (1001, -5, "assistant", "near."), (1001, None, "system", "none."), (1001, None, "assistant", None), (1001, 3, None, "no role."), (None, 1, "user", "No id."), (None, None, None, None)]
    rows += [(1002, 1, "user", "Same."), (1002, 1, "user", "Same."), (1002, 1, "assistant", "Same."), (1003, None, "user", "a."), (1003, None, "user", "b.")]
    return rows


def test_conversation_repair(spark, conversations):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in conversations], "conv_id long, turn long, role string, text string, _k int, audit string, dropped boolean").repartition(5)
    rows, answers = conv_repair.repair(df)
    out = conv_repair.digests(rows, answers)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({r[0] for r in conversations}) and set(got) == set(told(damaged(conversations), {r[0] for r in conversations}))
    kept = defaultdict(list)
    for r in sorted(conv_repair.repaired(rows, answers).collect(), key=lambda r: r.position):
        assert r.position == len(kept[r.conv_id])
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(kept[r[0]]).encode()).hexdigest() == r[-1] for r in got)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in kept.values())
    assert conv_repair.digests(*conv_repair.repair(df.limit(0))).count() == 0


def test_all_dropped_and_damaged_already(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conv_repair.digests(*conv_repair.repair(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert [r.audit for r in conv_repair.digests(*conv_repair.repair(df, damaged=True)).collect()] == ["KI"]


SYMBOL = {"": lambda r: r, "truncated": lambda r: r.upper(), "blank": lambda r: "x"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from(["", "", "truncated", "blank"])), max_size=14))
def test_answers_are_the_cheapest_edits(rows):
    assert conv_repair.Trie().answer("".join(SYMBOL[f](r) for r, f in rows)) == cheapest([(r, "t", f) for r, f in rows])[:2]


def test_the_trie_shares_prefixes():
    rng = random.Random(1)
    words = sorted("".join(rng.choice("suaSUAox") for _ in range(rng.randrange(30))) for _ in range(400))
    walked = conv_repair.Trie()
    assert [walked.answer(w) for w in words] == [conv_repair.Trie().answer(w) for w in words]
    assert walked.computed == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    long = "ua" * 100_000 + "x"
    assert conv_repair.Trie().answer(long) == (4, "K" * 200_000 + "D") and conv_repair.next_layer.cache_info().currsize < 5000


# BPE by tree concatenation


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "don't", "x" * 7, "1", "234", "!", "!!", "é", "ß", "漢字", "😀", " hello", " world", "\t", "<|endoftext|>", "<|endof", "text|>", "l", "'ve", "　", "\xa0", "A", "ing"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.sampled_from([1, 2, 8]), st.sampled_from([26, 64]))
def test_joins_equal_the_library(tokenizer, parts, window, leaf):
    text = "".join(parts)
    codec = bpe_tree.codec(leaf, window)
    ids, want = codec.encode(text), tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and codec.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["x" * 50_000, "'" * 3000, " \n" * 9000, "漢字かな" * 9000, "!?" * 9000, "😀" * 5000, "a" * 4095 + "'" + "s" * 5000, "word " * 30_000], ids=range(8))
def test_long_unsplit_texts(tokenizer, text):
    codec = bpe_tree.codec(leaf=1000)
    assert codec.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe_tree.joined(codec, [codec.encode(t) for t in bpe_tree.parts_of(text, 700)]).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip_of_rows(spark, tokenizer):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(30).collect()]
    rows = [*real, (-1, None), (-2, ""), (-3, "a<|endoftext|>" * 40), (-4, "same long text, twice. " * 30), (-4, "same long text, twice. " * 30), (-4, "another with that id " * 30), (None, "no id at all " * 40), (-5, "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "m", 0) for r in rows], "doc_id long, text string, no int, md5 string, copies int").repartition(4)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(i, t or "", tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    want = Counter((i, len(n), sha(",".join(map(str, n))), sha(tokenizer.decode(n, skip_special_tokens=False))) for i, _, n in ids)
    for part in (bpe_tree.PART, 500):
        assert Counter(map(tuple, bpe_tree.round_trip(df, part=part, leaf=64).collect())) == want
    made = bpe_tree.encode(df, part=500)
    assert Counter((r.doc_id, r.n_tokens, r.ids) for r in made.collect()) == Counter((i, len(n), np.array(n, "<u4").tobytes()) for i, _, n in ids)
    assert Counter(map(tuple, bpe_tree.decode(made).collect())) == Counter((i, t) for i, t, _ in ids)
    assert bpe_tree.round_trip(df.limit(0)).count() == 0


def test_digests_in_slices(monkeypatch):
    codec = bpe_tree.codec()
    ids = codec.encode("slices cut é漢字😀 characters " * 20)
    want = codec.digests(ids)
    monkeypatch.setattr(bpe_tree, "SLICE", 3)
    assert codec.digests(ids) == want


@pytest.mark.parametrize("name", ["op3_line_rules", "op11_filter_audit", "op12_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
