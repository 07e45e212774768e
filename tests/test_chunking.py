"""Windows, anchors, display text and snippets, with values worked out by hand."""

from pyspark.sql import functions as F

from emberlode.operators import chunking


def pieces(spark, text, make):
    df = spark.createDataFrame([("f", text)], "path string, content string")
    return [tuple(r) for r in chunking.explode_pieces(df, make(F.col("content")), []).orderBy("chunk_index").select("start_line", "end_line", "content").collect()]


def test_line_windows_of_220_lines(spark):
    got = pieces(spark, "\n".join(f"line-{i}" for i in range(1, 221)), chunking.line_pieces)
    assert [(s, e) for s, e, _ in got] == [(0, 74), (65, 139), (130, 204), (195, 219)]
    assert got[1][2].startswith("line-66\n")


def test_a_last_window_inside_the_one_before_is_kept(spark):
    assert [(s, e) for s, e, _ in pieces(spark, "\n".join("x" * 70), chunking.line_pieces)] == [(0, 69), (65, 69)]


def test_char_windows(spark):
    got = pieces(spark, "a" * 3500, lambda c: chunking.char_pieces(c, F.lit(0)))
    assert [len(c) for _, _, c in got] == [2000, 1700]
    got = pieces(spark, "a\n" * 1000 + " " * 4000, lambda c: chunking.char_pieces(c, F.lit(5)))
    assert [(s, e, len(c)) for s, e, c in got] == [(5, 1005, 2000), (905, 1005, 2000)]


def test_split_by_size(spark):
    assert len(pieces(spark, "a\nb", chunking.split_pieces)) == 1
    tall = pieces(spark, "\n".join("x" * 132), chunking.split_pieces)
    assert [(s, e) for s, e, _ in tall] == [(0, 74), (65, 131)]  # a rest of 2 lines is dropped
    wide = pieces(spark, "\n".join(["y" * 100] * 100), chunking.split_pieces)
    assert all(len(c) <= 2000 for _, _, c in wide) and wide[-1][1] == 99


def test_anchor(spark):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame([("a.ts", "\n\nimport x\n\nconst y = 1\n")], "path string, content string")
    r = df.select(chunking.anchor(F.col("path"), F.col("content"), none, F.array(F.lit("value")), F.array(F.lit("// top"))).alias("a")).first()["a"]
    assert r["content"] == "File: a.ts\n\nExports: value\n\nTop comments:\n// top\n\nPreamble:\nimport x\nconst y = 1\n\n---\n\n(anchor)" and r["end_line"] == 4
    long = spark.createDataFrame([("b", "\n".join(["z" * 500] * 9))], "path string, content string")
    r = long.select(chunking.anchor(F.col("path"), F.col("content"), none, none, none).alias("a")).first()["a"]
    assert r["end_line"] == 2 and r["content"].count("z" * 500) == 3


def test_display_text(spark):
    df = spark.createDataFrame([("p.ts", ["a", "import b"], ["Function: f"], "code", ""), ("p.ts", [], ["File: p.ts", "Anchor"], "code", "// doc")], "p string, i array<string>, c array<string>, x string, d string")
    got = [r[0] for r in df.select(chunking.display_text(*map(F.col, "picxd"))).collect()]
    assert got == ["// p.ts\nimport a\nimport b\nFile: p.ts > Function: f\ncode", "// p.ts\nFile: p.ts > Anchor\ncode\n// doc"]


def test_snippet(spark):
    text = "// p.ts\nFile: p.ts\n\nimport {\n a\n} from 'x';\nfrom y import z\nconst one = 1;\n" + "\n".join(f"l{i}" for i in range(20))
    got = spark.createDataFrame([(text,), ("// only\n---",)], "t string").select(chunking.snippet(F.col("t"))).collect()
    assert got[0][0].startswith("const one = 1;\nl0") and got[0][0].endswith("l13\n... (+6 more lines)")
    assert got[1][0] == "// only\n---"


def test_capped(spark):
    df = spark.createDataFrame([(list("abcdefghijkl"),), (None,)], "s array<string>")
    a, b = [r[0] for r in df.select(chunking.capped(F.col("s"))).collect()]
    assert a[-1] == "... (+2 more)" and len(a) == 11 and b == []
