"""The index in step with a folder, through the stream of its listings."""

import os

from emberlode.operators import index
from emberlode.sources import files
from emberlode.streaming import live


class Flaky(files.Tree):
    """A folder in which some files can't be read."""

    broken: set = set()

    def contents(self, spark, names, n=None):
        from pyspark.sql import functions as F

        bad = F.col("path").isin(*self.broken) if self.broken else F.lit(False)
        got = super().contents(spark, names, n)
        return got.withColumns({c: F.when(~bad, F.col(c)) for c in ("content", "hash", "mtime_ms", "size")} | {"state": F.when(bad, "failed").otherwise(F.col("state"))})


def test_add_edit_delete_and_failed_reads_through_the_stream(spark, tmp_path):
    root, tree = str(tmp_path / "index"), tmp_path / "tree"
    tree.mkdir()
    source = Flaky(str(tree))
    run = lambda: live.maintain(spark, source, str(tmp_path / "log"), root, str(tmp_path / "cp")).awaitTermination()
    note = lambda at: live.note(spark, source, str(tmp_path / "log"), at * 1000)
    rows = lambda: {(r["path"], r["content"].split("\n")[-1]) for r in index.open_chunks(spark, root).where("not is_anchor").collect()}
    for p, t in {"a.md": "one", "b.md": "two", "c.md": "three"}.items():
        (tree / p).write_text(t)
    note(100), run()
    assert rows() == {("a.md", "one"), ("b.md", "two"), ("c.md", "three")}
    # add, edit, delete, and an edit that can't be read: its old rows stay
    (tree / "d.md").write_text("four")
    (tree / "a.md").write_text("one again")
    (tree / "c.md").write_text("three again")
    os.unlink(tree / "b.md")
    source.broken = {"c.md"}
    note(200), run()
    assert rows() == {("a.md", "one again"), ("c.md", "three"), ("d.md", "four")}
    # the next listing asks for it again; nothing else changes
    source.broken = set()
    note(300), run()
    assert rows() == {("a.md", "one again"), ("c.md", "three again"), ("d.md", "four")}
    version = index.open_index(spark, root).version["version"]
    note(400), run()
    assert index.open_index(spark, root).version["version"] == version
    # all go, and one comes back
    for p in ("a.md", "c.md", "d.md"):
        os.unlink(tree / p)
    note(500), run()
    assert rows() == set()
    (tree / "b.md").write_text("two")
    note(600), run()
    assert rows() == {("b.md", "two")}
