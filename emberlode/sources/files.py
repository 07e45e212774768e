"""A file tree as a DataFrame: walk, ignore rules, indexable and binary filters."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config

IGNORE_FILES = (".gitignore",)
FILES = "path string, content string, hash string, mtime_ms double, size bigint"


class Rules:
    """Ignore patterns of one folder, relative to it; of those that match, the last decides, and ! takes back.

    Rules of several folders only add up: a folder below can't take one back.
    """

    def __init__(self, patterns: list[str]):
        kept = [p.strip() for p in patterns if p.strip() and not p.strip().startswith("#")]
        self.tests = [(*self._compile(p.removeprefix("!").removeprefix("\\")), p.startswith("!")) for p in kept]

    @staticmethod
    def _compile(p: str) -> tuple[re.Pattern[str], bool]:
        folder = p.endswith("/")
        p = p.rstrip("/")
        rooted = "/" in p
        p = p.lstrip("/")
        out, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif p.startswith("/**", i) and i + 3 == len(p):
                out, i = out + "(?:/.*)?", i + 3
            elif p.startswith("**", i):
                out, i = out + ".*", i + 2
            elif p[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif p[i] == "?":
                out, i = out + "[^/]", i + 1
            elif p[i] == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                out, i = out + fnmatch.translate(p[i : j + 1])[4:-3], j + 1
            else:
                out, i = out + re.escape(p[i]), i + 1
        return re.compile(("" if rooted else "(?:.*/)?") + out + r"\Z"), folder

    def match(self, rel: str, is_dir: bool) -> bool:
        out = False
        for t, folder, back in self.tests:
            if (is_dir or not folder) and t.match(rel):
                out = not back
        return out


def walk(root: str, ignore: tuple[str, ...] = config.IGNORE, more: tuple[str, ...] = (".git",), ignore_files: tuple[str, ...] = IGNORE_FILES) -> Iterator[str]:
    """Paths of the files below root, relative to it; folders that can't be read are skipped."""
    base = Rules([*ignore, *more])

    def visit(rel: str, scopes: list[tuple[str, Rules]]) -> Iterator[str]:
        here = os.path.join(root, rel)
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return
        for name in ignore_files:
            try:
                with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                    scopes = [*scopes, (rel, Rules(f.read().splitlines()))]
            except OSError:
                pass
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if any(r.match(path[len(s) + 1 :] if s else path, is_dir) for s, r in scopes):
                continue
            if is_dir:
                yield from visit(path, scopes)
            else:
                yield path

    yield from visit("", [("", base)])


def is_indexable(path: str, size: int) -> bool:
    name = os.path.basename(path).lower()
    ext = os.path.splitext(name)[1]
    return (ext in config.EXTENSIONS or name in config.EXTENSIONS or name in config.BASENAMES) and 0 < size <= config.MAX_FILE_BYTES


def is_binary(data: bytes) -> bool:
    return not data or b"\0" in data[:1024]


def snapshot(path: str) -> tuple[bytes, float] | None:
    """Content and time of a file that didn't change while it was read; None if it can't be read."""
    try:
        a = os.stat(path)
        if a.st_size > config.MAX_FILE_BYTES:
            return None
        with open(path, "rb") as f:
            data = f.read()
        b = os.stat(path)
    except OSError:
        return None
    return (data, b.st_mtime * 1000) if (a.st_mtime_ns, a.st_size) == (b.st_mtime_ns, b.st_size) == (b.st_mtime_ns, len(data)) else None


FOUND = "path string, mtime_ms double, size bigint, real_path string"
READ = "path string, content string, hash string, mtime_ms double, size bigint, state string"
#: Folders that a task lists at a time, and files it reads.
FOLDERS_A_TASK, FILES_A_TASK = 64, 256
_FRONTIER = "rel string, scopes string"


def _scopes_of(packed: str) -> list[tuple[str, list[str]]]:
    return [(rel, patterns) for rel, patterns in json.loads(packed)]


def _list_folder(root: str, rel: str, packed: str, base: Rules, ignore_files: tuple[str, ...], rules) -> tuple[list[tuple], list[tuple]]:
    """(files, folders below) of one folder under the base rules, those of its ancestors' ignore files and its own."""
    scopes, here = _scopes_of(packed), os.path.join(root, rel)
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError:
        return [], []
    for name in ignore_files:
        try:
            with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                scopes.append((rel, f.read().splitlines()))
        except OSError:
            pass
    tests, files, folders = [("", base), *[(s, rules(tuple(p))) for s, p in scopes]], [], []
    for e in entries:
        path = f"{rel}/{e.name}" if rel else e.name
        is_dir = e.is_dir(follow_symlinks=False)
        if any(r.match(path[len(s) + 1 :] if s else path, is_dir) for s, r in tests):
            continue
        if is_dir:
            folders.append((path, json.dumps(scopes)))
            continue
        try:
            real = os.path.realpath(e.path)
            st = os.stat(real)
        except OSError:
            continue
        if os.path.isfile(real) and is_indexable(path, st.st_size):
            files.append((path, st.st_mtime * 1000, st.st_size, real))
    return files, folders


def listing(spark: SparkSession, root: str, staging: str, ignore: tuple[str, ...] = config.IGNORE, more: tuple[str, ...] = (".git",), ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """path, mtime_ms, size of the indexable files below root; nothing is read but ignore files.

    Breadth first: a row of the frontier is a folder with the rules that it inherits, the
    tasks list the folders of a level, and what they find is written under staging (a
    folder that driver and executors share, of this call alone). The driver holds a count
    a level and no names. Links to one file count once, by the least path, broken links
    not at all; linked folders aren't entered; folders that can't be read are skipped.
    """
    frontier = spark.createDataFrame([("", "[]")], _FRONTIER)
    kinds = "found boolean, path string, mtime_ms double, size bigint, real_path string, scopes string"
    level, pending = 0, 1

    def visit(batches):
        from functools import lru_cache

        import pyarrow as pa

        base, rules = Rules([*ignore, *more]), lru_cache(maxsize=1024)(lambda patterns: Rules(list(patterns)))
        fields = [pa.bool_(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in kinds.split(", ")]
        for b in batches:
            for rel, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, folders = _list_folder(root, rel, packed, base, ignore_files, rules)
                rows = [(True, *f, None) for f in files] + [(False, p, None, None, None, s) for p, s in folders]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names=names)

    while pending:
        at = f"{staging}/level={level}"
        frontier.repartition(-(-pending // FOLDERS_A_TASK)).mapInArrow(visit, kinds).write.parquet(at)
        frontier = spark.read.schema(kinds).parquet(at).where("not found").select(F.col("path").alias("rel"), "scopes")
        pending, level = frontier.count(), level + 1
    found = spark.read.schema(kinds).parquet(*[f"{staging}/level={i}" for i in range(level)]).where("found")
    first = found.groupBy("real_path").agg(F.min(F.struct("path", "mtime_ms", "size")).alias("f"))
    return first.select("f.path", "f.mtime_ms", "f.size")


def contents(spark: SparkSession, root: str, names: DataFrame, n: int | None = None) -> DataFrame:
    """READ of names(path) below root, read in the tasks (root must be a path that executors see).

    state: ok; binary (or empty: it has no content); failed (it can't be read or changed
    meanwhile: hash and content are null, it was seen all the same); gone. n: how many
    names there are, if known; else they are counted.
    """

    def read(batches):
        import pyarrow as pa

        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for p in b.column(0).to_pylist():
                got = snapshot(os.path.join(root, p))
                if got is None:
                    row = (p, None, None, None, None, "failed" if os.path.exists(os.path.join(root, p)) else "gone")
                else:
                    data, mtime = got
                    binary = is_binary(data)
                    row = (p, None if binary else data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest(), mtime, len(data), "binary" if binary else "ok")
                for c, v in zip(rows, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()))], names=[c.split()[0] for c in READ.split(", ")])

    n = names.count() if n is None else n
    return names.select("path").repartition(max(1, -(-n // FILES_A_TASK))).mapInArrow(read, READ)


class Tree:
    """A folder as the source of an index: a listing first, contents only of the files that are asked for."""

    def __init__(self, root: str, **rules: tuple[str, ...]):
        self.root, self.rules = root, rules

    def listing(self, spark: SparkSession, staging: str) -> DataFrame:
        return listing(spark, self.root, staging, **self.rules)

    def contents(self, spark: SparkSession, names: DataFrame, n: int | None = None) -> DataFrame:
        return contents(spark, self.root, names, n)


class Rows:
    """A DataFrame(path, content, hash, mtime_ms, size) as the source of an index; a null hash is a file that couldn't be read."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def listing(self, spark: SparkSession, staging: str) -> DataFrame:
        return self.rows.select("path", "mtime_ms", "size")

    def contents(self, spark: SparkSession, names: DataFrame, n: int | None = None) -> DataFrame:
        rows = self.rows.join(names.select("path"), "path", "left_semi")
        return rows.select("path", F.when(F.col("hash").isNotNull(), F.coalesce("content", F.lit(""))).alias("content"), "hash", "mtime_ms", "size", F.when(F.col("hash").isNull(), "failed").otherwise("ok").alias("state"))


def read_tree(spark: SparkSession, root: str, staging: str) -> DataFrame:
    """path, content, hash, mtime_ms, size of the indexable text files below root; a file that can't be read has nulls."""
    read = contents(spark, root, listing(spark, root, staging))
    return read.where("state in ('ok', 'failed')").drop("state")
