"""Sync, symbols, evaluation, presentation, files, parsing, streaming."""

import os

import pytest
from pyspark.sql import functions as F

from emberlode.operators import code, evaluate, graph, present, sync
from emberlode.sources import files, providers

META = "path string, hash string, mtime_ms double, size bigint"


def test_sync_states(spark):
    now = spark.createDataFrame([("a", "h", 1.0, 1), ("b", "h", 2.0, 1), ("c", "x", 2.0, 1), ("d", "h", 1.0, 1)], META)
    old = spark.createDataFrame([("a", "q", 1.0, 1), ("b", "h", 1.0, 1), ("c", "h", 1.0, 1), ("e", "h", 1.0, 1)], META)
    assert {r["path"]: r["state"] for r in sync.diff(now, old).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "new"}
    assert [r["path"] for r in sync.stale(now, old).collect()] == ["e"]
    rows = spark.createDataFrame([("c", 1), ("e", 2), ("a", 3)], "path string, v int")
    new = spark.createDataFrame([("c", 9)], "path string, v int")
    assert sorted(map(tuple, sync.upsert(rows, new, sync.stale(now, old)).collect())) == [("a", 3), ("c", 9)]


CHUNKS = "path string, start_line int, defined_symbols array<string>, referenced_symbols array<string>, parent_symbol string, role string, complexity double"


def test_graph(spark):
    df = spark.createDataFrame([("b", 0, ["Run"], ["go", "go"], "", "DEFINITION", 2.0), ("a", 3, [], ["Run"], "", "", None), ("a", 1, ["go", "Run"], ["x"], "P", None, 1.0)], CHUNKS)
    assert [tuple(r) for r in graph.symbols(df, pattern="RU").collect()] == [("Run", 2, "a", 1)]
    r = graph.callers(df, "Run").collect()
    assert [(x["symbol"], x["role"], x["complexity"]) for x in r] == [("unknown", "IMPLEMENTATION", 0.0)]
    assert [tuple(x) for x in graph.callees(df, "Run").collect()] == [(0, "x")]
    assert "a:4" in graph.trace_text(graph.one_hop(df, "Run"))
    assert graph.trace_text(graph.one_hop(df, "none")) == "symbol not found"


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "src/A.ts", 0), (1, "src/b.ts", 1), (2, "src/b.ts", 0), (2, "src/a.ts", 1)], "case_id int, path string, rank int")
    want = spark.createDataFrame([(1, "x|a.TS", None), (2, "a.ts", "b.ts"), (3, "q", None)], "case_id int, expected string, avoid string")
    got = evaluate.cases(hits, want)
    assert {r["case_id"]: (r["rank"], r["rr"]) for r in got.collect()} == {1: (0, 1.0), 2: (None, 0.0), 3: (None, 0.0)}
    assert evaluate.summary(got).first()["mrr"] == pytest.approx(1 / 3)


def test_stitch_can_shrink(spark):
    df = spark.createDataFrame([(1, "p", 0, 50, 0.9, "a"), (2, "p", 5, 10, 0.8, "b"), (3, "p", 21, 30, 0.7, "c"), (4, "p", 10, 12, 0.1, "d")], "id int, path string, start_line int, end_line int, score double, content string")
    got = [tuple(r) for r in present.stitch(df, limit=3).orderBy("start_line").select("start_line", "end_line", "n", "content").collect()]
    assert got == [(0, 10, 2, "a\n   // ...\nb"), (21, 30, 1, "c")]


def test_compact(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (1.25,), (0.0,), (None,)], "s double")
    assert [r[0] for r in df.select(present.compact_score(F.col("s"))).collect()][:3] == [".9", ".5", "1.25"]
    t = spark.createDataFrame([("File: x\n  code here  File: y\n\n---\n" + "z" * 150,)], "t string").select(present.clean_lines(F.col("t"))).first()[0]
    assert t == ["  code here", "z" * 140 + " ..."]


def test_walk_and_ignore(spark, tmp_path):
    for p, text in {"a.py": "x", "b.log": "x", ".git/HEAD": "x", "sub/c.ts": "x", "sub/skip/d.ts": "x", "sub/.gitignore": "skip/\n!*.log\n", "node_modules/e.js": "x", "big.bin": "x", "sub/f.log": "x", "g.md": "", "h.py": "a\0b"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    os.symlink(tmp_path / "a.py", tmp_path / "z.py")
    os.symlink(tmp_path / "gone", tmp_path / "y.py")
    assert set(files.walk(str(tmp_path))) >= {"a.py", "sub/c.ts"}
    assert not {"b.log", ".git/HEAD", "sub/skip/d.ts", "node_modules/e.js", "sub/f.log"} & set(files.walk(str(tmp_path)))
    got = {r["path"] for r in files.read_tree(spark, str(tmp_path), str(tmp_path.parent / "staging")).collect()}
    assert got == {"a.py", "sub/c.ts", "sub/.gitignore"}


PY = '''import os

# says hello
def hello(a):
    if a and os:
        print("world")
    return helper(a)


class Box:
    def get(self):
        return self.v

X = 1
'''
TS = """import x from 'y';
// adds
export function add(a: number) {
  if (a > 1 && b) { return f(a); }
  return "}";
}
class Store {
  read(k) { return this.db.get(k); }
}
const Z = 1;
"""


def test_parsers():
    py = code.definitions("a.py", PY)
    assert [(c.chunk_type, c.name, c.start_line, c.end_line) for c in py] == [("block", "", 0, 3), ("function", "hello", 3, 6), ("class", "Box", 9, 11), ("method", "get", 10, 11), ("block", "", 11, 14)]
    f = py[1]
    assert f.complexity == 2 and f.references == ["print", "helper"] and f.docstring == "# says hello" and not f.exported
    ts = code.definitions("a.ts", TS)
    assert [(c.chunk_type, c.name) for c in ts if c.name] == [("function", "add"), ("class", "Store"), ("method", "read"), ("function", "Z")]
    add = next(c for c in ts if c.name == "add")
    assert add.exported and add.complexity == 3 and add.end_line == 5 and add.references == ["f"]
    assert next(c for c in ts if c.name == "read").parent == "Store"
    assert code.definitions("a.yaml", "a: 1") == [] and code.definitions("b.py", "def (") == []


def test_skeletons(spark):
    df = spark.createDataFrame([("a.py", PY), ("a.ts", TS), ("n.md", "\n".join(map(str, range(40))))], "path string, content string")
    got = {r["path"]: r for r in code.skeletons(df).collect()}
    assert "# → print, helper | C:2" in got["a.py"]["skeleton"] and "world" not in got["a.py"]["skeleton"]
    assert "// → f | C:3" in got["a.ts"]["skeleton"] and "class Store" in got["a.ts"]["skeleton"]
    assert not got["n.md"]["success"] and got["n.md"]["skeleton"].endswith("// ... 10 more lines")
    assert {r["path"] for r in code.parse(df).collect()} == {"a.py", "a.ts"}


def test_providers(spark):
    df = providers.embed_column(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "t", lambda: providers.hashing_embedder(16), 24)
    v = {r["id"]: r["vector"] for r in df.collect()}
    assert len(v[1]) == 24 and sum(x * x for x in v[1]) == pytest.approx(1, rel=1e-5) and not any(v[2])
    assert providers.scattered([(2, 0.5), (0, 0.9)], 3) == [0.9, 0.0, 0.5]
    assert len(providers.token_ids([5] * 50, True, 1, 2, 3, 4)) == 32 and providers.token_ids([5], True, 1, 2, 3, 4) == [1, 2, 5, 3] + [4] * 28
    calls = []
    with pytest.raises(ValueError):
        providers.retried(lambda: calls.append(1) or (_ for _ in ()).throw(ValueError()), wait=0.001)
    assert len(calls) == 3
