"""The stored index: atomic versions, segments, posting blocks, symbols, the two-phase scan, token matrices."""

import json
import os
import shutil
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlode.operators import fulltext, graph, index, ranking, symbols
from emberlode.operators.store import Conflict, Store
from emberlode.sources import files, providers

SF = "/root/testdata/sf0.001"


def rows_of(spark, root):
    return Counter((r["path"], r["chunk_index"], r["content"], r["id"]) for r in index.open_chunks(spark, root).collect())


def source(spark, texts, at=1.0):
    import hashlib

    return spark.createDataFrame([(p, t, None if t is None else hashlib.sha256(t.encode()).hexdigest(), None if t is None else at, None if t is None else len(t)) for p, t in texts.items()], "path string, content string, hash string, mtime_ms double, size bigint")


def test_versions_are_whole_or_absent(spark, tmp_path):
    s = Store(spark, str(tmp_path / "i"))
    assert s.read()["version"] == 0 and s.versions() == []
    base = s.read()
    one = s.commit(base, files="files-" + "0" * 32)
    assert s.read() == one and one["version"] == 1
    with pytest.raises(Conflict):
        s.commit(base)
    assert s.read() == one and not [n for n in os.listdir(tmp_path / "i/versions") if n.startswith(".")]
    won, threads = [], []
    for i in range(8):  # one of many wins

        def race(i=i):
            try:
                won.append(s.commit(one, stats={"docs": i, "terms": 0}))
            except Conflict:
                pass

        threads.append(threading.Thread(target=race))
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and s.read() == won[0]


def test_versions_by_rename_where_there_are_no_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "_local", lambda self: False)
    s = Store(spark, str(tmp_path / "i"))
    one = s.commit(s.read())
    with pytest.raises(Conflict):
        s.commit(s.read(1) | {"version": 0})
    assert s.read() == one and not [n for n in os.listdir(tmp_path / "i/versions") if not n.endswith((".json", ".crc"))]


def test_lock(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with s.lock():
        with pytest.raises(TimeoutError), s.lock(tries=2, wait=0.01):
            pass
        with pytest.raises(TimeoutError):
            index.build(spark, str(tmp_path), source(spark, {"a.py": "x"}))
    assert not s.exists("LOCK")
    owner = {"id": "x", "host": __import__("socket").gethostname(), "pid": 999999999}
    (tmp_path / "LOCK").write_text(json.dumps(owner))
    with s.lock():
        (tmp_path / "LOCK").write_text(json.dumps(owner | {"host": "elsewhere"}))
    assert s.exists("LOCK")  # another's by now
    with pytest.raises(TimeoutError), s.lock(tries=1):
        pass


class Broken(Exception):
    pass


TEXTS = {f"src/f{i}.py": f"def fun{i}(a):\n    return help{i % 3}(a)\n" for i in range(6)} | {"n.md": "some words here\n" * 90}


def test_a_build_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch):
    root, fresh = str(tmp_path / "i"), str(tmp_path / "fresh")
    index.build(spark, root, source(spark, TEXTS))
    before = rows_of(spark, root)
    after = {k: v for k, v in TEXTS.items() if k != "src/f1.py"} | {"src/f2.py": "def other():\n    return 1\n", "src/new.ts": "export function neu() { return f(1); }\n"}
    index.build(spark, fresh, source(spark, after, 2.0))
    want = rows_of(spark, fresh)
    seen = source(spark, after, 2.0).cache()
    for owner, name, late in [(index, "_write_segment", False), (fulltext, "write", True), (symbols, "write", True), (Store, "commit", False), (Store, "commit", True), (Store, "clean", False)]:
        real, at = getattr(owner, name), str(tmp_path / f"{owner.__name__}.{name}{late}")
        shutil.copytree(root, at)

        def broken(*args, **kw):
            if late:
                real(*args, **kw)
            raise Broken

        monkeypatch.setattr(owner, name, broken)
        with pytest.raises(Broken):
            index.build(spark, at, seen)
        monkeypatch.setattr(owner, name, real)
        committed = name == "clean" or name == "commit" and late
        assert rows_of(spark, at) == (want if committed else before), (name, late)
        assert not [n for n in os.listdir(at) if n.startswith("staging")] and not os.path.exists(f"{at}/LOCK")
    # whatever a dead writer left, the next build gives the same as a fresh one
    at = str(tmp_path / "Store.commitFalse")
    assert index.build(spark, at, seen)["processed"] == 7 and rows_of(spark, at) == want


def test_two_writers_are_serialised(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    index.build(spark, root, source(spark, {"a.py": "x = 1"}))
    real = index._write_segment

    def overtaken(store, *args):
        monkeypatch.setattr(index, "_write_segment", real)
        monkeypatch.setattr(Store, "lock", lambda self: __import__("contextlib").nullcontext())
        index.build(spark, root, source(spark, {"a.py": "x = 1", "b.py": "y = 2"}))
        return real(store, *args)

    monkeypatch.setattr(index, "_write_segment", overtaken)
    with pytest.raises(Conflict):
        index.build(spark, root, source(spark, {"a.py": "x = 1", "c.py": "z = 3"}))
    assert {p for p, *_ in rows_of(spark, root)} == {"a.py", "b.py"}


def test_segments_stay_few_and_equal_a_fresh_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MERGE", 3)
    root, texts = str(tmp_path / "i"), dict(TEXTS)
    for i in range(4):
        texts[f"src/f{i}.py"] = f"def round{i}():\n    return shared{i}(help1)\n"
        if i == 2:
            del texts["n.md"]
        index.build(spark, root, source(spark, texts, float(i)))
    now = index.open_index(spark, root)
    assert len(now.version["segments"]) <= 4 and len(now.store.versions()) == 2
    index.build(spark, str(tmp_path / "fresh"), source(spark, texts))
    assert rows_of(spark, root) == rows_of(spark, str(tmp_path / "fresh"))
    live = now.chunks()
    n = live.select(F.size(ranking.tokens(F.col("content"))).alias("n")).agg(F.count("n"), F.sum("n")).first()
    assert (now.version["stats"]["docs"], now.version["stats"]["terms"]) == tuple(n)
    for terms in (["def", "return"], ["help1"], ["some", "words"], ["round3", "zzz"]):
        want = [(r["id"], round(r["score"], 9)) for r in ranking.bm25(live, "id", "content", terms, 50).collect()]
        assert [(r["id"], round(r["score"], 9)) for r in now.bm25(terms, 50).collect()] == want, terms
    held = {d for v in now.store.versions() for d in Store.folders(now.store.read(v))}
    assert {d for d in os.listdir(root) if "-" in d} == held
    # an unchanged source makes no version
    version = now.version["version"]
    assert index.build(spark, root, source(spark, texts, 3.0))["unchanged"] == len(texts) and index.open_index(spark, root).version["version"] == version


def test_one_edit_writes_one_small_segment(spark, tmp_path):
    root, texts = str(tmp_path / "i"), {f"d{i}.md": f"alpha beta word{i} " * 200 for i in range(60)}
    index.build(spark, root, source(spark, texts))
    big = index.open_index(spark, root).version["segments"][0]
    index.build(spark, root, source(spark, texts | {"d7.md": "gamma alone"}, 2.0))
    now = index.open_index(spark, root)
    assert now.version["segments"][0]["name"] == big["name"] and len(now.version["segments"]) == 2 and now.version["segments"][1]["docs"] == 2
    assert now.gone.count() == index.open_index(spark, root, 1).chunks().where("path = 'd7.md'").count() and now.bm25(["word7"], 9).count() == 0 and now.bm25(["gamma"], 9).count() > 0


def test_block_bounds_skip_blocks_and_keep_the_scan_s_result(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["common"] * int(rng.integers(1, 4)) + (["rare"] * int(rng.integers(1, 9)) if 3000 <= i < 3400 else []) + [f"w{rng.integers(50)}" for _ in range(int(rng.integers(5, 60)))])) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc long, content string").withColumn("segment", F.lit("s"))
    made = fulltext.blocks(docs, bits=6)
    n, total = docs.count(), docs.select(F.sum(F.size(ranking.tokens(F.col("content"))))).first()[0]
    for terms, share in ((["common", "rare"], 0.6), (["rare"], 1.1), (["w1", "common", "nothing"], 1.1)):
        hits, counts = fulltext.top_k(made, terms, 100, n, total, first=8)
        got = [(r["doc"], round(r["score"], 9)) for r in hits.orderBy(F.desc("score"), "doc").limit(100).collect()]
        assert got == [(r["id"], round(r["score"], 9)) for r in ranking.bm25(docs, "doc", "content", terms, 100).collect()]
        assert counts["read"] <= share * counts["ranges"], counts
    some = docs.where("doc % 7 = 0").select("segment", "doc")
    hits, _ = fulltext.top_k(made, ["rare"], 20, n, total, allowed=some, first=1)
    assert {r["doc"] % 7 for r in hits.collect()} == {0} and hits.count() >= 20
    assert fulltext.top_k(made, ["zzz"], 5, n, total)[1] == {"ranges": 0, "read": 0} and fulltext.top_k(made, [], 5, n, total)[0].count() == 0
    # a common term is many rows
    assert made.where("term = 'common'").count() > 100


def test_symbol_table_reads_one_folder_and_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FOLDER_BYTES", 40)
    root = str(tmp_path / "i")
    index.build(spark, root, source(spark, TEXTS))
    index.build(spark, root, source(spark, TEXTS | {"src/f0.py": "def fun0(b):\n    return fun1(help1(b))\n"}, 2.0))
    now = index.open_index(spark, root)
    assert now.version["segments"][0]["folders"] > 4
    chunks = now.chunks()
    for s in ("fun1", "help1", "fun0", "nothing"):
        assert now.callers(s).collect() == graph.callers(chunks, s).collect()
        assert sorted(map(tuple, now.one_hop(s).collect()), key=repr) == sorted(map(tuple, graph.one_hop(chunks, s).collect()), key=repr)
    assert now.symbols().collect() == graph.symbols(chunks).collect() and now.symbols("FUN1").count() == 1
    assert now.symbols(path_prefix="src/f2").collect() == graph.symbols(chunks, path_prefix="src/f2").collect() and now.symbols(path_prefix="src/f2").first()["symbol"] == "fun2"
    plan = spark._jvm.PythonSQLUtils.explainString(now.entries("fun1")._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,fun1)" in plan and "PartitionFilters: [isnotnull(bucket" in plan and "/chunks" not in plan
    got = {r["path"] for r in now.search("anything", 10, providers.hashing_embedder(384), referenced="fun1").collect()}
    assert got == {r["path"] for r in chunks.where(F.array_contains("referenced_symbols", "fun1")).collect()} or not got


def test_vectors_by_cells_equal_the_scan_and_read_less(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 12)) * 8
    texts = {f"d{i}.md": f"text {i % 9} {i}" for i in range(900)}

    def embed(some):
        r = [t.split() for t in some]
        return np.array([centres[int(x[x.index("text") + 1]) % 9] + np.random.default_rng(len(t) + int(x[x.index("text") + 2])).standard_normal(12) if "text" in x else np.zeros(12) for x, t in zip(r, some)], np.float32)

    root = str(tmp_path / "i")
    index.build(spark, root, source(spark, texts), lambda: embed, 12)
    index.build(spark, root, source(spark, {k: t for k, t in texts.items() if k != "d5.md"} | {"d7.md": "text 5 7777"}, 2.0), lambda: embed, 12)
    now = index.open_index(spark, root)
    rows = now.stored().select("segment", "doc", "path", "vector").collect()
    v = np.array([r["vector"] for r in rows], np.float64)
    for q in (centres[5], centres[0] + 0.5):
        got, counts = now.nearest(q.tolist(), 20)
        d = np.sqrt(((v - q) ** 2).sum(1))
        want = sorted((round(float(x), 9), r["segment"], r["doc"]) for x, r in zip(d, rows))[:20]
        assert sorted((round(r["distance"], 9), r["segment"], r["doc"]) for r in got.collect()) == want
        assert counts["read"] < 0.5 * counts["rows"], counts
    some = now.stored().where("path like 'd1%'").select("segment", "doc")
    keys = {(r["segment"], r["doc"]) for r in some.collect()}
    got = {(r["segment"], r["doc"]) for r in now.nearest(centres[5].tolist(), 20, some)[0].collect()}
    assert len(got) == 20 and got <= keys
    with pytest.raises(ValueError, match="dimensions"):
        now.nearest([1.0], 3)


def tree(root, texts):
    for p, t in texts.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t if isinstance(t, bytes) else t.encode())


def test_listing_equals_the_walk(spark, tmp_path):
    root = tmp_path / "t"
    tree(root, {"a.py": "x", "b.log": "x", ".git/HEAD": "x", "s/.gitignore": "skip/\n/only.ts\n*.tmp.py\n!a.tmp.py\n", "s/c.ts": "x", "s/skip/d.ts": "x", "s/only.ts": "x", "s/deep/only.ts": "x", "s/deep/a.tmp.py": "x", "s/deep/b.tmp.py": "x", "s/deep/.gitignore": "!skip/\nmore/", "s/deep/skip/x.py": "x", "s/deep/more/x.py": "x", "node_modules/e.js": "x", "big.json": b"x" * (2 << 20) + b"y", "g.md": "", "h.py": b"a\0b", "é/ü.py": "x", **{f"many/m{i}/f.py": "x" for i in range(200)}})
    os.symlink(root / "a.py", root / "z.py")
    os.symlink(root / "gone", root / "y.py")
    os.symlink(root / "s", root / "linked")
    want = {p for p in files.walk(str(root)) if os.path.isfile(root / p) and files.is_indexable(p, os.path.getsize(root / p))} - {"z.py"}
    got = files.listing(spark, str(root), str(tmp_path / "st"))
    assert {r["path"] for r in got.collect()} == want and "s/deep/a.tmp.py" in want and got.count() == len(want)
    state = {r["path"]: r["state"] for r in files.contents(spark, str(root), spark.createDataFrame([("a.py",), ("h.py",), ("none.py",)], "path string")).collect()}
    assert state == {"a.py": "ok", "h.py": "binary", "none.py": "gone"}
    assert files.listing(spark, str(tmp_path / "nothing"), str(tmp_path / "st2")).count() == 0


def test_a_file_is_read_once_and_an_unchanged_one_never(spark, tmp_path):
    root, at = tmp_path / "t", str(tmp_path / "i")
    tree(root, {"a.py": "def a():\n    return 1\n", "b.py": "def b():\n    return 2\n", "c.md": "words\n", "bin.py": b"\0\1"})

    class Counted(files.Tree):
        asked: list = []

        def contents(self, spark, names, n=None):
            self.asked.append(sorted(r["path"] for r in names.collect()))
            return super().contents(spark, names, n)

    go = lambda: index.build(spark, at, Counted(str(root)))
    assert go() == {"processed": 3, "indexed": 3, "unchanged": 0, "failed": 0, "removed": 0}
    assert go()["unchanged"] == 3 and Counted.asked == [["a.py", "b.py", "bin.py", "c.md"], []]
    os.utime(root / "a.py", (5, 5))
    (root / "b.py").write_text("def b():\n    return 3\n")
    os.unlink(root / "c.md")
    assert go() == {"processed": 2, "indexed": 1, "unchanged": 1, "failed": 0, "removed": 1} and Counted.asked[-1] == ["a.py", "b.py"]
    (root / "b.py").write_bytes(b"\0")  # binary by now: its rows go
    assert go()["removed"] == 1 and {p for p, *_ in rows_of(spark, at)} == {"a.py"}
    assert go()["removed"] == 0 and Counted.asked[-1] == []


def test_a_file_that_changes_while_it_is_read(tmp_path, monkeypatch):
    p = tmp_path / "x.py"
    p.write_text("one")
    real = open

    def slow(path, *a, **k):
        f = real(path, *a, **k)
        if path == str(p):
            os.utime(p, (9, 9))
        return f

    monkeypatch.setattr("builtins.open", slow)
    assert files.snapshot(str(p)) is None


def test_token_matrices_from_tree_to_hits(spark, tmp_path):
    model = providers.HashedStates(16)
    root = str(tmp_path / "i")
    texts = {"a.md": "apple tree, bark!", "b.md": "banana boat", "c.md": "cherry tree bark", "e.md": "x"}
    index.build(spark, root, source(spark, texts), lambda: providers.dense_embedder(providers.HashedStates(24)), 24, lambda: providers.HashedStates(16))
    now = index.open_index(spark, root)
    rows = now.chunks().collect()
    for r in rows:
        ids = providers.token_ids(model.tokenise([r["content"]])[0], False, 0, 2, 3, 4)
        m = model.states(np.array([ids]), np.ones((1, len(ids)), np.int8))[0]
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        assert r["doc_token_ids"] == ids and r["colbert_scale"] == pytest.approx(np.abs(m).max(), rel=1e-5)
        got = np.frombuffer(r["colbert"], np.int8).reshape(len(ids), 16)
        assert np.abs(got * r["colbert_scale"] / 127 - m).max() <= r["colbert_scale"] / 254 + 1e-6
        mean = m.mean(0) / np.linalg.norm(m.mean(0))
        assert np.allclose(r["pooled"], mean, atol=1e-5) and len(r["vector"]) == 24 and np.linalg.norm(r["vector"]) == pytest.approx(1, rel=1e-5)
    q = providers.query_tokens(model, "cherry bark")
    assert q.shape == (32, 16)
    hits = now.search("cherry bark", 10, providers.dense_embedder(providers.HashedStates(24)), model).collect()
    # the best by hand: late interaction without skipped tokens and boosts; fused ranks add 0.02 at most
    by = {r["id"]: r for r in rows}
    sim = {}
    for i, r in by.items():
        m = np.frombuffer(r["colbert"], np.int8).reshape(-1, 16).astype(float)[[t not in model.skip for t in r["doc_token_ids"]]] * r["colbert_scale"] / 127
        sim[i] = (q @ m.T).max(1).sum() * (0.99 * 0.6 if r["is_anchor"] else 0.36) * (0.9 if len(r["content"]) < 50 else 1)
    off = now.search("cherry bark", 10, providers.dense_embedder(providers.HashedStates(24))).collect()
    assert [r["id"] for r in hits] != [r["id"] for r in off] or len(hits) == len(off)
    assert hits[0]["id"] == max(sim, key=sim.get) and {r["path"] for r in hits} == set(texts)


def test_token_stage_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 2000)], "id int, t string")
    got = {r["id"]: r for r in providers.token_columns(df, "t", lambda: providers.HashedStates(8)).collect()}
    assert [len(got[i]["doc_token_ids"]) for i in (1, 2, 3)] == [3, 3, 512] and len(got[3]["colbert"]) == 512 * 8
    assert providers.token_columns(df.limit(0), "t", lambda: providers.HashedStates(8)).count() == 0
    raw, scale, pooled = providers.token_matrix(np.zeros((2, 4)))
    assert raw == bytes(8) and scale == 1.0 and not pooled.any()
    raw, scale, pooled = providers.token_matrix(np.zeros((0, 4)))
    assert raw == b"" and scale == 1.0 and len(pooled) == 4


def test_service_embedder_keeps_order_with_requests_in_flight():
    import time

    live, most = set(), []

    def call(texts):
        me = object()
        live.add(me)
        most.append(len(live))
        time.sleep(0.02)
        live.discard(me)
        return [(i, [float(t), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    texts = [str(i) for i in range(300)]
    got = providers.service_embedder(call, 2)(texts)
    want = np.array([[i, 1.0] for i in range(300)])
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True)) and max(most) > 1


def test_cancelled_search(spark, tmp_path):
    root = str(tmp_path / "i")
    index.build(spark, root, source(spark, {"a.md": "alpha"}))
    now = index.open_index(spark, root)
    hits = now.search("alpha", 5, job_group="one")
    assert hits.count() == 2  # the anchor and the text
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: (__import__("time").sleep(60) or b for b in it), "id long")
    stop = threading.Timer(1.5, lambda: spark.sparkContext.cancelJobGroup("one"))
    stop.start()
    with pytest.raises(Exception, match="(?i)cancel"):
        slow.collect()
    spark.sparkContext._jsc.clearJobGroup()
    assert index.open_index(spark, str(tmp_path / "none")).search("alpha", 5).count() == 0
