"""The index build end to end, the stored full-text index, the search's stages, and what the parsers tell of files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlode.functions import vectors
from emberlode.operators import code, index, present, ranking
from emberlode.sources import files, providers

TS = """// top
import { a } from './a';
import b from 'b';
const LIMIT_ONE = 3;
const add = (x) => {
  if (x > 1) { return call(x); }
  return x;
};
export const hidden = () => 2;
let plain = 5;
export class Box {
  get(k) { for (const i of k) { use(i); } }
}
export { plain };
"""


def test_value_definitions_and_facts():
    found = {c.name: c for c in code.definitions("x.ts", TS) if c.name}
    assert set(found) == {"LIMIT_ONE", "add", "Box", "get"}
    assert found["add"].complexity == 2 and found["add"].references == ["call"] and (found["add"].start_line, found["add"].end_line) == (4, 7)
    assert found["Box"].exported and not found["add"].exported
    assert code.file_facts("x.ts", TS) == (["import { a } from './a';", "import b from 'b';"], ["hidden", "Box"], ["// top"])
    assert code.file_facts("x.md", TS) == ([], [], [])
    py = "# hi\nimport os\ndef f(x):\n    if x and y:\n        pass\n    elif z:\n        pass\n    try:\n        pass\n    except E:\n        pass\n    return 1 if x else 2\n"
    assert code.definitions("a.py", py)[-1].complexity == 3  # if, and the conditional
    assert code.file_facts("a.py", py) == (["import os"], [], ["# hi"])
    gaps = [c for c in code.definitions("g.ts", "let a = 1;\nfunction f() {\n}\nlet b = 2;\nfunction g() {\n}\n") if c.chunk_type == "block"]
    assert [(c.start_line, c.end_line) for c in gaps] == [(0, 1), (2, 4)]


def test_negated_rules():
    r = files.Rules(["*.log", "!keep.log", "build/"])
    assert r.match("a.log", False) and not r.match("keep.log", False) and r.match("build", True) and not r.match("build", False)


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.ts").write_text(TS)
    (tmp_path / "README.md").write_text("\n".join(f"line {i} about widgets" for i in range(100)))
    (tmp_path / "b.py").write_text("def alpha():\n    return beta()\n")
    return tmp_path


def test_build_edit_delete_rename_and_failed_reads(spark, tree, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("idx") / "i")
    made = lambda: {r["path"]: r["n"] for r in index.open_chunks(spark, root).groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    sync = lambda seen=None, **k: index.build(spark, root, files.Tree(str(tree)) if seen is None else seen, lambda: providers.hashing_embedder(32), 32, **k)
    assert sync(dry_run=True)["indexed"] == 3 and made() == {}
    assert sync() == {"processed": 3, "indexed": 3, "unchanged": 0, "failed": 0, "removed": 0}
    first = made()
    assert set(first) == {"src/x.ts", "README.md", "b.py"} and first["README.md"] == 3
    rows = index.open_chunks(spark, root)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] == index.CHUNKS.split(", ")
    anchor = rows.where("path = 'src/x.ts' and is_anchor").first()
    assert anchor["chunk_index"] == -1 and "Exports: hidden, Box" in anchor["content"] and "Top comments:\n// top" in anchor["content"] and "skeleton" in anchor["file_skeleton"]
    assert {r["role"] for r in rows.where("path = 'README.md' and not is_anchor").collect()} == {"DOCS"}
    one = rows.where("path = 'README.md' and chunk_index = 0").first()
    assert one["context_prev"] != "" and "line 99" in one["context_next"] and len(one["vector"]) == 32 and one["content"].startswith("// README.md")
    assert sync()["unchanged"] == 3
    # edit one, rename one; the third can't be read and keeps its rows
    (tree / "b.py").write_text("def gamma():\n    return 1\n")
    os.rename(tree / "src/x.ts", tree / "src/y.ts")
    seen = files.read_tree(spark, str(tree), str(tmp_path_factory.mktemp("w") / "walk")).withColumns({c: F.when(F.col("path") != "README.md", F.col(c)) for c in ("hash", "content", "mtime_ms", "size")})
    assert sync(seen) == {"processed": 3, "indexed": 2, "unchanged": 0, "failed": 1, "removed": 1}
    assert made() == {"src/y.ts": first["src/x.ts"], "README.md": 3, "b.py": first["b.py"]}
    assert index.open_chunks(spark, root).where(F.array_contains("defined_symbols", "alpha")).isEmpty()
    # a folder that a version names is missing: the index starts anew
    now = index.open_index(spark, root)
    now.store.delete(now.version["files"])
    os.unlink(tree / "README.md")
    assert sync()["indexed"] == 2 and set(made()) == {"src/y.ts", "b.py"}
    # search by the stored text index, skeletons of what it finds
    now = index.open_index(spark, root)
    assert {r["path"] for r in now.chunks().join(now.bm25(["gamma"], 5), "id").collect()} == {"b.py"}
    hits = now.search("gamma", 5, providers.hashing_embedder(32))
    assert hits.first()["path"] == "b.py"
    assert index.symbol_file(now.chunks(), now.bm25(["gamma"], 5), "gamma").first()["path"] == "b.py"
    assert "gamma" in now.skeleton("b.py").first()["skeleton"] and now.skeleton("gamma").first()["path"] == "b.py" and now.skeleton("how is gamma", embed=providers.hashing_embedder(32)).first()["path"] == "b.py"
    with pytest.raises(Exception, match="dimensions"):
        ranking.search(now.chunks(), ["gamma"], [1.0, 2.0], 5).collect()
    said = dict(present.listing(spark, {"chunks": f"{root}/versions", "none": f"{root}/none"}))
    assert said["none"] == "not created yet" and "just now" in said["chunks"]


def test_search_reranks(spark):
    rng = np.random.default_rng(5)
    tok = rng.standard_normal((12, 3, 4))
    rows = []
    for i, m in enumerate(tok):
        s = float(np.abs(m).max())
        mean = m.mean(0) / np.linalg.norm(m.mean(0))
        rows.append((f"c{i}", f"p{i}.ts", "word " * 20, 0, 9, m.reshape(-1)[:4].tolist(), "block", None, [], False, True, np.floor(m / s * 127 + 0.5).astype(np.int8).tobytes(), s, mean.tolist()))
    df = spark.createDataFrame(rows, "id string, path string, content string, start_line int, end_line int, vector array<double>, chunk_type string, role string, referenced_symbols array<string>, is_anchor boolean, is_exported boolean, colbert binary, colbert_scale double, pooled array<double>")
    q = rng.standard_normal((2, 4))
    got = [r["id"] for r in ranking.search(df, ["word"], [0.0] * 4, 12, query_tokens=q.tolist()).collect()]
    text_rank = {f"c{i}": n for n, i in enumerate(sorted(range(12), key=lambda i: f"c{i}"))}
    dist = {f"c{i}": np.linalg.norm(np.array(r[5])) for i, r in enumerate(rows)}
    vec_rank = {c: n for n, c in enumerate(sorted(dist, key=lambda c: (dist[c], c)))}
    deq = {r[0]: np.frombuffer(r[11], np.int8).reshape(-1, 4) * r[12] / 127 for r in rows}
    want = {c: (q @ m.T).max(1).sum() + 0.5 * (1 / (61 + text_rank[c]) + 1 / (61 + vec_rank[c])) for c, m in deq.items()}
    assert got == sorted(want, key=want.get, reverse=True)
    service = lambda query, texts: [(n, float(n)) for n in range(len(texts))][::-1][:-1]  # noqa: E731  out of order, one missing
    served = [r["id"] for r in ranking.search(df, ["word"], [0.0] * 4, 12, rerank=service, query="word").collect()]
    off = [r["id"] for r in ranking.search(df, ["word"], [0.0] * 4, 12).collect()]
    assert served == off[::-1]


def test_boost_lowers_paths_and_takes_factors(spark):
    df = spark.createDataFrame([("README.MD",), ("x/Docs/y.ts",), ("src/Tests/a.ts",)], "path string").selectExpr("path", "'block' chunk_type", "null role", "array('') referenced_symbols", "false is_anchor", "true is_exported", "repeat('x', 60) content")
    assert [round(r[0], 3) for r in df.select(ranking.boost()).collect()] == [0.6, 0.6, 0.5]
    assert [round(r[0], 3) for r in df.select(ranking.boost(factors={"test": "0.9", "prose": 0, "docs": "x"})).collect()] == [0.6, 0.6, 0.9]


def test_maxsim_of_awkward_rows(spark):
    m = np.array([[1, 0], [0, 2]], np.int8)
    df = spark.createDataFrame([(1, m.tobytes(), 127.0, [7, 8]), (2, None, 1.0, []), (3, b"", None, None), (4, m.tobytes(), None, [7, 7])], "id int, t binary, s double, ids array<int>")
    got = lambda **k: {r["id"]: round(r["maxsim"], 4) for r in vectors.maxsim(df, np.array([[1.0, 1.0]]), "t", "s", 2, **k).collect()}
    assert got() == {1: 2.0, 2: 0.0, 3: 0.0, 4: round(2 / 127, 4)}
    assert got(token_ids="ids", skip=frozenset({7})) == {1: 2.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_nearest_keeps_a_running_best_and_string_ids(spark):
    v = spark.createDataFrame([(f"k{i:03}", [float(i), 0.0]) for i in range(300)] + [(None, [0.0, 0.0]), ("null", None)], "id string, v array<float>").coalesce(1)
    assert [r["id"] for r in vectors.nearest(v, "id", "v", [100.0, 0.0], 3).collect()] == ["k100", "k099", "k101"]


def test_output_forms(spark):
    df = spark.createDataFrame([("tests/a.ts", "x\n" * 30, "function", 4, None, 3, 0.5), (None, None, None, None, None, None, 0.1)], "path string, content string, chunk_type string, start_line int, end_line int, num_lines int, score double")
    rows = present.text_hits(df)
    assert [(r["path"], r["start_line"], r["end_line"]) for r in rows.collect()] == [("tests/a.ts", 4, 6), ("Unknown path", 0, 0)]
    r = present.plain(rows).first()
    assert r["head"] == "tests/a.ts:5 [Definition,Test]" and r["body"].endswith("  ... (+10 more lines)")
    assert present.padded(rows.limit(1), {"path": 6, "score": 5}).split("\n") == ["path   score", "tests/   0.5"]
    assert [present.human_size(n) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"] and [present.age(s) for s in (5, 120, 7200, 200000)] == ["just now", "2m ago", "2h ago", "2d ago"]
    assert [index.target_kind(x) for x in ("src/a", "a.ts", "Box", "how does it")] == ["path", "path", "symbol", "query"]


def test_service_results_in_order():
    got = providers.ordered([(1, [3.0, 4.0, 0.0]), (0, [0.0, 2.0])], 3, 3)
    assert np.allclose(got, [[0, 1, 0], [0.6, 0.8, 0], [0, 0, 0]])
