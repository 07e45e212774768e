"""The index: a tree's files to the chunks table, kept in step by segments.

    listing -> files that differ -> read once -> definitions or windows -> anchor -> vectors -> segment

Each build writes what is new or changed as a segment: chunks dealt and sorted by path
and numbered, a file's side by side in one part, posting blocks, symbols, and vectors by cells, none of which is changed later. What left is
named by (segment, number). Segments of like size are merged, and those of which a
fifth has left are rewritten, so a build's work follows what changed. A version
(store.Store) names the segments that count.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import paths, pivots
from ..sources import files as sources
from ..sources import providers
from . import chunking, code, fulltext, graph, ranking, symbols, sync
from .store import Store

#: Bytes of content for each task that makes a segment, and for each folder of terms or symbols.
TASK_BYTES, FOLDER_BYTES, MOST_FOLDERS = 16 << 20, 64 << 20, 4096
#: Of all files, which are read a few times and are most of an index's disk.
ZSTD = {"compression": "zstd"}
#: Segments of a tier (a power of ten of chunks) that are merged, and the share that has left at which one is rewritten.
MERGE, LEFT = 8, 0.2
CHUNKS = (
    "id string, path string, hash string, content string, display_text string, start_line int, end_line int, vector array<float>, chunk_index int, is_anchor boolean, context_prev string, context_next string, "
    "chunk_type string, complexity float, is_exported boolean, colbert binary, colbert_scale double, pooled array<float>, doc_token_ids array<int>, defined_symbols array<string>, referenced_symbols array<string>, "
    "imports array<string>, exports array<string>, role string, parent_symbol string, file_skeleton string"
)
COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
#: Texts that a chunk's row has over again: its own, and those of the chunks beside it. They are not stored.
AGAIN = ("display_text", "context_prev", "context_next")
KEPT = ", ".join(c for c in CHUNKS.split(", ") if c.split()[0] not in AGAIN)
#: A chunk in a segment: its number there, the number of its terms, and the folder of its part.
PLACE = "segment string, doc long, n_terms int, part int"
STORED = f"{KEPT}, {PLACE}"
FILES = "path string, hash string, mtime_ms double, size bigint, indexed boolean"
#: A segment's vectors, by the cell of their nearest pivot; a segment has about the root of its chunks of these, within bounds.
VECTORS = "segment string, doc long, vector array<float>, radius double, cell int"
MOST_PIVOTS = 1024
GONE = "segment string, doc long, path string"
GONE_TERMS = "segment string, term string, n long"

_PIECE = [("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("chunk_type", pa.string()), ("complexity", pa.float32()), ("is_exported", pa.bool_()), ("defined_symbols", pa.list_(pa.string())), ("referenced_symbols", pa.list_(pa.string())), ("role", pa.string()), ("parent_symbol", pa.string()), ("context", pa.list_(pa.string())), ("docstring", pa.string())]
PIECE = "content string, start_line int, end_line int, chunk_type string, complexity float, is_exported boolean, defined_symbols array<string>, referenced_symbols array<string>, role string, parent_symbol string, context array<string>, docstring string"


def analysed(files: DataFrame) -> DataFrame:
    """files(path, content, hash) with imports, exports, comments, file_skeleton and pieces (its definitions), in one stage."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(p or "", t or "") for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            told = [code.file_facts(*x) for x in texts]
            pieces = [[(c.content, c.start_line, c.end_line, c.chunk_type, float(c.complexity), c.exported, [c.name] if c.name else [], c.references, c.role, c.parent or None, c.context, c.docstring) for c in code.definitions(*x)] for x in texts]
            cols = [pa.array([t[i] for t in told], pa.list_(pa.string())) for i in range(3)]
            made = pa.array([[dict(zip((n for n, _ in _PIECE), p)) for p in ps] for ps in pieces], pa.list_(pa.struct(_PIECE)))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array([code.skeleton(*x) for x in texts], pa.string()), made], names=["path", "content", "hash", "imports", "exports", "comments", "file_skeleton", "pieces"])

    named = ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in PIECE.split(", "))
    return files.select("path", "content", "hash").mapInArrow(rows, f"path string, content string, hash string, imports array<string>, exports array<string>, comments array<string>, file_skeleton string, pieces array<struct<{named}>>")


def neighbours(chunks: DataFrame, text: str = "display_text") -> DataFrame:
    """chunks(path, chunk_index, ...) with the text of the chunk before and after in the file; empty at the ends."""
    w = Window.partitionBy("path").orderBy("chunk_index")
    return chunks.withColumns({"context_prev": F.coalesce(F.lag(text).over(w), F.lit("")), "context_next": F.coalesce(F.lead(text).over(w), F.lit(""))})


def _whole(rows: DataFrame) -> DataFrame:
    """CHUNKS rows of KEPT rows that have all chunks of their files, or at least those beside the ones asked for."""
    return neighbours(rows.withColumn("display_text", F.col("content"))).select(*COLUMNS, *[c for c in rows.columns if c not in COLUMNS])


def doc_role(path: Column, role: Column) -> Column:
    """Prose files are DOCS, whatever their chunks are."""
    return F.when(paths.is_doc(path), "DOCS").otherwise(role)


def _piece(p: Column, content: Column, start: Column, end: Column) -> Column:
    """A piece with another text and place."""
    changed = {"content": content, "start_line": start, "end_line": end}
    return F.struct(*[changed.get(n, p[n]).alias(n) for n, _ in _PIECE])


def _block(content: Column, start: Column, end: Column) -> Column:
    """A piece that defines nothing."""
    none = F.array().cast("array<string>")
    plain = {"content": content, "start_line": start.cast("int"), "end_line": end.cast("int"), "chunk_type": F.lit("block"), "complexity": F.lit(None).cast("float"), "is_exported": F.lit(False), "defined_symbols": none, "referenced_symbols": none, "role": F.lit(None).cast("string"), "parent_symbol": F.lit(None).cast("string"), "context": none, "docstring": F.lit("")}
    return F.struct(*[plain[n].alias(n) for n, _ in _PIECE])


def chunk_files(files: DataFrame, embed: Callable[[], providers.Embed] | None = None, dim: int = 384, tokens: Callable[[], providers.TokenModel] | None = None) -> DataFrame:
    """Rows of the chunks table for files(path, content, hash).

    A file with definitions gives them and what lies between, cut to size; others give
    line windows, and large data files none. Each file has an anchor of index -1. Null
    content is an empty file. embed makes the embedder in each task, tokens the token
    model; without them the vectors, or the token matrices, are null. All of it is one
    narrow pass: a file's chunks are made where the file is.
    """
    c = F.col
    a = analysed(files.select("path", F.coalesce("content", F.lit("")).alias("content"), "hash"))
    cut = F.flatten(F.transform("pieces", lambda p: F.transform(chunking.split_pieces(p["content"]), lambda q: _piece(p, q["content"], p["start_line"] + q["start_line"], p["start_line"] + q["end_line"]))))
    whole = F.flatten(F.transform(chunking.line_pieces(c("content")), lambda p: F.when(F.length(p["content"]) > config.CHUNK_CHARS, chunking.char_pieces(p["content"], p["start_line"])).otherwise(F.array(p))))
    windows = F.transform(F.filter(whole, lambda p: p["content"].rlike(r"\S")), lambda p: _block(p["content"], p["start_line"], p["end_line"]))
    none = F.slice(windows, 1, 0)
    a = a.withColumn("body", F.when(F.size("pieces") > 0, cut).when(paths.is_large_data(c("path"), c("content")), none).otherwise(windows))
    a = a.withColumn("made", chunking.anchor(c("path"), c("content"), c("imports"), c("exports"), c("comments")))
    a = a.withColumn("all", F.concat(F.array(_block(c("made.content"), F.lit(0), c("made.end_line"))), "body"))
    a = a.withColumn("shown", F.transform("all", lambda p, i: F.when(i == 0, p["content"]).otherwise(chunking.display_text(c("path"), c("imports"), p["context"], p["content"], p["docstring"]))))
    near = F.transform("all", lambda p, i: F.struct(p.alias("p"), F.get("shown", i).alias("shown"), F.when(i > 0, F.get("shown", i - 1)).alias("prev"), F.get("shown", i + 1).alias("next")))
    rows = a.select("path", "hash", "imports", "exports", "file_skeleton", F.posexplode(near).alias("_i", "_c")).withColumn("chunk_index", c("_i") - 1)
    first = c("_i") == 0
    rows = rows.select(
        "path", "hash", "imports", "exports", "chunk_index", first.alias("is_anchor"), F.when(first, c("file_skeleton")).alias("file_skeleton"), c("_c.shown").alias("content"), c("_c.shown").alias("display_text"),
        F.coalesce("_c.prev", F.lit("")).alias("context_prev"), F.coalesce("_c.next", F.lit("")).alias("context_next"), *[f"_c.p.{n}" for n, _ in _PIECE if n not in ("content", "role", "context", "docstring")],
        F.when(first, c("_c.p.role")).otherwise(doc_role(c("path"), c("_c.p.role"))).alias("role"), F.sha2(F.concat_ws("\0", "path", c("chunk_index").cast("string"), c("_c.shown")), 256).alias("id"),
    )
    rows = providers.embed_column(rows, "content", embed, dim) if embed else rows.withColumn("vector", F.lit(None).cast("array<float>"))
    rows = providers.token_columns(rows, "content", tokens) if tokens else rows.withColumns({n: F.lit(None).cast(k) for n, k in (x.split() for x in providers.TOKEN_COLUMNS.split(", "))} | {"colbert_scale": F.lit(1.0)})
    return rows.select(*[c(x.split()[0]).cast(x.split(" ", 1)[1]) for x in CHUNKS.split(", ")])


@dataclass
class Index:
    """One version of an index, opened for reading."""

    store: Store
    version: dict

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _read(self, kind: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        """A kind of all segments' rows; there are few segments."""
        out = self.spark.createDataFrame([], schema)
        for s in self.version["segments"] if segments is None else segments:
            if s.get(kind, True):
                rows = self.spark.read.schema(schema).parquet(self.store.at(f"{s['name']}/{kind}"))
                out = out.unionByName(rows.select(*out.columns))
        return out

    def _gone(self, kind: str, schema: str) -> DataFrame | None:
        live = [s["name"] for s in self.version["segments"]]
        names = [self.store.at(f"{g['name']}/{kind}") for g in self.version["gone"]]
        return self.spark.read.schema(schema).parquet(*names).where(F.col("segment").isin(live)) if names else None

    @property
    def gone(self) -> DataFrame | None:
        """(segment, doc, path) of chunks that have left living segments; None if none has."""
        return self._gone("docs", GONE)

    def _living(self, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        gone = self.gone if gone is None else gone
        return rows if gone is None else rows.join(gone.select(*fulltext.KEY), fulltext.KEY, "left_anti")

    def stored(self) -> DataFrame:
        """STORED rows that count."""
        return self._living(self._read("chunks", STORED))

    def chunks(self) -> DataFrame:
        """The chunks table. Who asks for a chunk's neighbours has its texts dealt by path once."""
        return _whole(self.stored()).select(*COLUMNS)

    def files(self) -> DataFrame:
        """What the last build knew of the files."""
        name = self.version["files"]
        return self.spark.read.schema(FILES).parquet(self.store.at(name)) if name else self.spark.createDataFrame([], FILES)

    def fetch(self, keys: DataFrame) -> DataFrame:
        """CHUNKS rows and their place of keys(segment, doc), a few thousand at most: reads the parts that hold them alone."""
        few = [(r["segment"], r["doc"]) for r in keys.select(*fulltext.KEY).collect()]
        out = self.spark.createDataFrame([], STORED)
        for s in self.version["segments"]:
            mine = sorted({d >> 33 for name, d in few if name == s["name"]})
            if mine:
                out = out.unionByName(self._read("chunks", STORED, [s]).where(F.col("part").isin(mine)))
        rows = lambda some: F.broadcast(self.spark.createDataFrame(some, "segment string, doc long"))
        beside = sorted({(name, d + i) for name, d in few for i in (-1, 0, 1)})
        return _whole(out.join(rows(beside), fulltext.KEY, "left_semi")).join(rows(few), fulltext.KEY, "left_semi")

    def _in_folders(self, kind: str, schema: str, bucket, made: Callable[[DataFrame, str], DataFrame] = lambda rows, segment: rows) -> list[DataFrame]:
        """By segment, made(rows of a kind from the folders that bucket(its number of folders) lists, its name)."""
        return [made(self._read(kind, schema + ", bucket int", [s]).where(F.col("bucket").isin(bucket(s["folders"]))).drop("bucket"), s["name"]) for s in self.version["segments"]]

    def _buckets(self, values: list[str]) -> Callable[[int], list[int]]:
        """Folder numbers of a few values."""
        df = self.spark.createDataFrame([(v,) for v in values] or [], "v string")
        hashes = [r[0] for r in df.select(F.xxhash64("v")).collect()]
        return lambda n: sorted({h % n for h in hashes})

    def postings(self, terms: list[str]) -> DataFrame:
        """fulltext.POSTINGS of terms, without lens."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        rows = self._in_folders("postings", fulltext.PACKED, self._buckets(terms), fulltext.unpacked)
        empty = self.spark.createDataFrame([], fulltext.POSTINGS).drop("lens")
        return reduce(DataFrame.unionByName, [r.where(F.col("term").isin(terms)) for r in rows], empty)

    def lengths(self) -> DataFrame:
        """fulltext.LENGTHS of all segments, with their segment."""
        made = [self._read("lengths", fulltext.LENGTHS, [s]).withColumn("segment", F.lit(s["name"])) for s in self.version["segments"] if s["postings"]]
        return reduce(DataFrame.unionByName, made, self.spark.createDataFrame([], fulltext.LENGTHS + ", segment string"))

    def entries(self, symbol: str) -> DataFrame:
        """Living symbol entries of one symbol, from its folders."""
        rows = self._in_folders("symbols", symbols.ENTRIES, self._buckets([symbol]))
        return self._living(reduce(DataFrame.unionByName, rows, self.spark.createDataFrame([], symbols.ENTRIES)).where(F.col("symbol") == symbol))

    def text_hits(self, terms: list[str], k: int, allowed: DataFrame | None = None, first: int = fulltext.FIRST) -> tuple[DataFrame, dict[str, int]]:
        """((segment, doc, score) of the documents that reach the k-th best BM25 score, counts of blocks)."""
        stats = self.version["stats"]
        return fulltext.top_k(self.postings(terms), terms, k, stats["docs"], stats["terms"], self.gone, self._gone("terms", GONE_TERMS), allowed, first, self.lengths())

    def bm25(self, terms: list[str], k: int) -> DataFrame:
        """(id, score) of the best k, by falling score, then id; of equals at the k-th place, the first by segment and number."""
        hits, _ = self.text_hits(terms, k)
        rows = [(r["segment"], r["doc"], r["score"]) for r in hits.orderBy(F.desc("score"), *fulltext.KEY).limit(k).collect()]
        best = self.spark.createDataFrame(rows, "segment string, doc long, score double")
        return self.fetch(best).select(*fulltext.KEY, "id").join(F.broadcast(best), fulltext.KEY).select("id", "score").orderBy(F.desc("score"), "id")

    def nearest(self, query: list[float], k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
        """((segment, doc, distance) of the k nearest living chunks by L2, exact; counts of rows and of rows read).

        Segment by segment, each reads the cells that can hold one of its k nearest.
        """
        out, counts = self.spark.createDataFrame([], "segment string, doc long, distance double"), {"rows": 0, "read": 0}
        for s in self.version["segments"]:
            if not s.get("vectors"):
                continue
            at = lambda kind, s=s: self.spark.read.parquet(self.store.at(f"{s['name']}/{kind}"))
            # a row a pivot
            around = np.array([r["vector"] for r in at("pivots").orderBy("cell").collect()])
            if len(query) != around.shape[1]:
                raise ValueError(f"a vector hasn't the {len(query)} dimensions of the query")
            rows = self._living(self._read("vectors", VECTORS, [s]))
            rows = rows.join(allowed.select(*fulltext.KEY), fulltext.KEY, "left_semi") if allowed is not None else rows
            found, n = pivots.nearest(rows, at("cells"), around, "doc", "vector", query, k)
            out = out.unionByName(found.select(F.lit(s["name"]).alias("segment"), F.col("id").alias("doc"), "distance"))
            counts = {c: counts[c] + n[c] for c in counts}
        return out.orderBy("distance", "segment", "doc").limit(k), counts

    def _allowed(self, path_prefix: str | None, defined: str | None, referenced: str | None, intent_name: str) -> DataFrame | None:
        """(segment, doc) that the search's filters let through; None if there are none. Symbols are looked up, not scanned for."""
        parts = []
        if defined:
            parts.append(symbols.having(self.entries(defined), defined, "def"))
        if referenced:
            parts.append(symbols.having(self.entries(referenced), referenced, "ref"))
        rest = ranking.predicates(path_prefix, None, None, "GENERAL" if defined else intent_name)
        if path_prefix or intent_name == "DEFINITION" and not defined:
            parts.append(self.stored().where(rest))
        keys = [p.select(*fulltext.KEY).distinct() for p in parts]
        out = keys[0] if keys else None
        for k in keys[1:]:
            out = out.join(k, fulltext.KEY, "left_semi")
        return out

    def search(self, query: str, k: int = 10, embed: providers.Embed | None = None, tokens: providers.TokenModel | None = None, path_prefix: str | None = None, defined: str | None = None, referenced: str | None = None, job_group: str | None = None, **more: object) -> DataFrame:
        """ranking.search over this version: id, path, start_line, end_line, score, confidence, rank.

        embed gives the query's dense vector and tokens its token vectors; without them
        the search goes by text, or without late interaction. Intent and terms follow
        from the query. Text hits come from the posting blocks, filters by symbol from the
        symbol table, rows of candidates from the parts that hold them, and the vector
        search reads cells that can matter. job_group: a name by which the jobs can be cancelled
        (Spark then fails the search).
        """
        if job_group:
            self.spark.sparkContext.setJobGroup(job_group, f"search {query}", interruptOnCancel=True)
        intent = self.spark.range(1).select(ranking.intent(F.lit(query)).alias("i")).first()["i"]
        terms = [t for t in re.split(r"[^\w]+", query.lower()) if t]
        allowed, n = self._allowed(path_prefix, defined, referenced, intent), config.candidates(k)
        allowed = allowed.persist(StorageLevel.MEMORY_AND_DISK) if allowed is not None else None
        text, _ = self.text_hits(terms, n, allowed)
        key = F.concat_ws(":", "segment", "doc")
        split = lambda df: df.select("*", F.substring_index("id", ":", 1).alias("segment"), F.substring_index("id", ":", -1).cast("long").alias("doc"))
        vector = self.nearest([float(x) for x in embed([query])[0]], n, allowed)[0].select(key.alias("id"), "distance") if embed else None
        rows: list[DataFrame] = []

        def fetch(candidates: DataFrame) -> DataFrame:
            got = self.fetch(split(candidates)).withColumnRenamed("id", "chunk_id").withColumn("id", key)
            rows.append(got)
            return got

        hits = ranking.search(
            text, terms, None, k, intent, vector_hits=vector, query_tokens=providers.query_tokens(tokens, query) if tokens else None, query=query,
            text_hits=text.select(key.alias("id"), "score"), fetch=fetch, skip=tokens.skip if tokens else frozenset(), **more,
        )
        names = rows[0].select("id", "chunk_id")
        out = hits.join(names, "id").select(F.col("chunk_id").alias("id"), *[c for c in hits.columns if c != "id"]).orderBy("rank")
        try:  # RERANK_TOP rows at most, so that what the search held can go
            return self.spark.createDataFrame(out.collect(), out.schema)
        finally:
            if allowed is not None:
                allowed.unpersist()

    def callers(self, symbol: str, limit: int = 100) -> DataFrame:
        """graph.callers by the symbol table."""
        some = symbols.having(self.entries(symbol), symbol, "ref").orderBy("path", "start_line").limit(limit)
        return graph.callers(self.fetch(some), symbol, limit)

    def center(self, symbol: str) -> DataFrame:
        some = symbols.having(self.entries(symbol), symbol, "def").orderBy("path", "start_line").limit(1)
        return graph.center(self.fetch(some), symbol)

    def one_hop(self, symbol: str) -> DataFrame:
        """graph.one_hop by the symbol table."""
        up = symbols.having(self.entries(symbol), symbol, "ref").orderBy("path", "start_line").limit(100)
        mid = symbols.having(self.entries(symbol), symbol, "def").orderBy("path", "start_line").limit(1)
        return graph.hops(graph.callers(self.fetch(up), symbol), graph.center(self.fetch(mid), symbol))

    def symbols(self, pattern: str | None = None, path_prefix: str | None = None, limit: int | None = 20) -> DataFrame:
        """graph.symbols by the symbol table."""
        return symbols.inventory(self._living(self._read("symbols", symbols.ENTRIES)), pattern, path_prefix, limit)

    def skeleton(self, target: str, limit: int = 3, **search: object) -> DataFrame:
        """path, skeleton by what the target is: a path, a symbol's file, or the best files of a query.

        Stored skeletons; a file without one shows its first lines from its anchor.
        """
        kind = target_kind(target)
        if kind == "path":
            best = self.spark.createDataFrame([(target.replace("\\", "/"), 0)], "path string, rank int")
        elif kind == "symbol":
            own = symbols.having(self.entries(target), target, "def").orderBy("path", "start_line").limit(1).select("path", F.lit(0).alias("rank"))
            best = symbol_file(self.chunks(), self.bm25([target], 10), target).select("path", F.lit(0).alias("rank")) if own.isEmpty() else own
        else:
            best = self.search(target, max(limit, 10), **search).select("path", "rank")
        found = skeletons_of(self.chunks(), best, limit)
        anchors = self.chunks().where("is_anchor").select("path", F.col("content").alias("anchor")).join(F.broadcast(found.select("path")), "path", "left_semi")
        shown = code.preview(F.col("path"), F.col("anchor"), F.lit("no definitions found"))
        return found.join(anchors, "path", "left").select("path", F.coalesce("skeleton", shown).alias("skeleton"), "rank").orderBy("rank", "path").select("path", "skeleton")


def open_index(spark: SparkSession, root: str, version: int | None = None) -> Index:
    """An index as of a version, or the newest; an empty one if there is none."""
    store = Store(spark, root)
    return Index(store, store.read(version))


def open_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks table of an index; empty if there is none."""
    return open_index(spark, root).chunks()


def _tasks(content_bytes: int) -> int:
    return max(1, math.ceil(content_bytes / TASK_BYTES))


def _dealt(rows: DataFrame, content_bytes: int, *order: str) -> DataFrame:
    """Rows of files by path, a file's in one task."""
    return rows.repartitionByRange(_tasks(content_bytes), "path").sortWithinPartitions("path", *order)


def _freed(spark: SparkSession) -> None:
    """Let the driver free the shuffle files of finished jobs, before the next ones need as much disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _write_segment(store: Store, rows: DataFrame, content_bytes: int, spent: str | None = None) -> dict | None:
    """A new segment of KEPT rows that are dealt (each made once, where its text is); None if there are none.

    spent: a folder that rows are made from and nothing else needs, which goes as soon as they are written.
    """
    name, spark = store.new("segment"), store.spark
    dealt = rows.select(*[c.split()[0] for c in KEPT.split(", ")], F.lit(name).alias("segment"), F.monotonically_increasing_id().alias("doc"), F.size(ranking.tokens(F.col("content"))).alias("n_terms"))
    dealt = dealt.withColumn("part", F.shiftright("doc", 33).cast("int"))
    dealt.sortWithinPartitions("part", "doc").write.options(**ZSTD).partitionBy("part").parquet(store.at(f"{name}/chunks"))
    if spent:
        store.delete(spent)
    _freed(spark)
    made = spark.read.schema(STORED).parquet(store.at(f"{name}/chunks"))
    s = made.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_terms").alias("terms"), F.max(F.size("defined_symbols")).alias("d"), F.max(F.size("referenced_symbols")).alias("r")).first()
    if not s["docs"]:
        store.delete(name)
        return None
    folders = min(MOST_FOLDERS, max(1, math.ceil(content_bytes / FOLDER_BYTES)))
    out = {"name": name, "docs": s["docs"], "terms": s["terms"] or 0, "bytes": content_bytes, "folders": folders, "gone": 0, "postings": bool(s["terms"]), "symbols": bool((s["d"] or 0) + (s["r"] or 0))}
    if out["postings"]:
        fulltext.write(fulltext.blocks(made), store.at(f"{name}/postings"), _tasks(content_bytes), folders)
        fulltext.lengths(made).write.options(**ZSTD).parquet(store.at(f"{name}/lengths"))
        _freed(spark)
    around = pivots.pick(made, "doc", "vector", max(1, min(MOST_PIVOTS, math.isqrt(s["docs"]))))
    out["vectors"] = bool(len(around))
    if out["vectors"]:
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(around)], "cell int, vector array<double>").write.parquet(store.at(f"{name}/pivots"))
        rows = pivots.celled(made.where("vector is not null").select("segment", "doc", "vector"), "vector", around)
        rows.repartitionByRange(_tasks(content_bytes), "cell", "doc").write.options(**ZSTD).partitionBy("cell").parquet(store.at(f"{name}/vectors"))
        pivots.cells(spark.read.schema(VECTORS).parquet(store.at(f"{name}/vectors"))).write.parquet(store.at(f"{name}/cells"))
    if out["symbols"]:
        symbols.write(symbols.entries(made), store.at(f"{name}/symbols"), _tasks(content_bytes // 4), folders)
    return out


def _tier(segment: dict) -> int:
    return int(math.log10(max(1, segment["docs"] - segment["gone"])))


def due(segments: list[dict]) -> list[dict]:
    """Segments to write anew as one: MERGE of a tier, and each of which a share has left."""
    by: dict[int, list[dict]] = {}
    for s in segments:
        by.setdefault(_tier(s), []).append(s)
    full = [s for some in by.values() if len(some) >= MERGE for s in some]
    return full or [s for s in segments if s["gone"] > LEFT * s["docs"]][:1]


def build(spark: SparkSession, root: str, source: sources.Tree | sources.Rows | DataFrame, embed: Callable[[], providers.Embed] | None = None, dim: int = 384, tokens: Callable[[], providers.TokenModel] | None = None, reset: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Bring the index at root in step with a source; counters of what was done.

    source lists its files (path, mtime_ms, size) and reads those that are asked for
    (sources.Tree, sources.Rows; a DataFrame is sources.Rows of it). Files whose time and
    size are known are not read; one that reads to the known hash only has its time
    noted; others are chunked anew. A file that can't be read counts as failed and its
    rows stay; binary files have none; files that aren't listed go. Everything is written
    to new folders and committed as one version, so a build that breaks off, wherever,
    leaves the version before, and the next build does it over. One writer at a time holds
    the lock; should two meet all the same, the later commit raises store.Conflict. An
    index with a missing folder starts anew. A dry run reads, writes no version and takes
    every file for new.
    """
    store = Store(spark, root)
    source = sources.Rows(source) if isinstance(source, DataFrame) else source
    with nullcontext() if dry_run else store.lock():
        try:
            return _build(store, source, store.new("staging"), embed, dim, tokens, reset, dry_run)
        finally:
            store.discard()


def _build(store: Store, source, staging: str, embed, dim: int, tokens, reset: bool, dry_run: bool) -> dict[str, int]:
    spark = store.spark
    base = store.read()
    old = Index(store, base)
    if dry_run or reset or not store.whole(base):
        old = Index(store, base | {"files": None, "segments": [], "gone": [], "stats": {"docs": 0, "terms": 0}})
    put = lambda df, name: (df.write.options(**ZSTD).parquet(store.at(f"{staging}/{name}")), spark.read.schema(df.schema).parquet(store.at(f"{staging}/{name}")))[1]
    cached = old.files()
    listed = put(source.listing(spark, store.at(f"{staging}/walk")), "listing")
    same = (F.col("l.mtime_ms") == F.col("c.mtime_ms")) & (F.col("l.size") == F.col("c.size"))
    known = listed.alias("l").join(cached.alias("c"), F.col("l.path") == F.col("c.path"), "left").select("l.path", F.coalesce(same, F.lit(False)).alias("same"))
    ask = put(known.where("not same").select("path"), "ask")
    n_ask = ask.count()
    got = put(source.contents(spark, ask, n_ask), "contents")  # each file is read once, here
    light, indexed = got.drop("content"), cached.where("indexed").drop("indexed")
    fine = sync.diff(light.where("state = 'ok'"), indexed).select("path", F.when(F.col("state") == "unchanged", "touched").otherwise(F.col("state")).alias("what"))
    state = put(light.join(fine, "path", "left").withColumn("what", F.coalesce("what", "state")), "state")
    n = {r["what"]: r["n"] for r in state.groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = cached.join(listed.select("path"), "path", "left_semi").join(light.select("path"), "path", "left_anti")
    failed = cached.join(light.where("state = 'failed'").select("path"), "path", "left_semi")
    now = kept.unionByName(failed).unionByName(state.where("state in ('ok', 'binary')").select("path", "hash", "mtime_ms", "size", (F.col("state") == "ok").alias("indexed")))
    now = put(now, "files")
    leaving = sync.stale(now.where("indexed"), indexed)
    changed = state.where("what in ('new', 'changed')").select("path")
    away = put(leaving.unionByName(state.where("what = 'changed'").select("path")), "away")
    fresh = n.get("new", 0) + n.get("changed", 0)
    unchanged = kept.where("indexed").count() + n.get("touched", 0)
    out = {"processed": unchanged + fresh + n.get("failed", 0), "indexed": fresh, "unchanged": unchanged, "failed": n.get("failed", 0), "removed": leaving.count()}
    moved = bool(set(n) - {"failed", "gone"}) or not sync.stale(now, cached).isEmpty()
    if dry_run or not (moved or reset or not base["version"]):
        return out
    if not old.version["segments"] and base["segments"]:
        base = base | {"segments": [], "gone": [], "stats": {"docs": 0, "terms": 0}}
    _freed(spark)
    segments, gone, stats = list(base["segments"]), list(base["gone"]), dict(base["stats"])
    if segments and not away.isEmpty():
        lost = put(old.stored().join(away, "path", "left_semi").select("segment", "doc", "path", "n_terms", "content"), "lost")
        by = {r["segment"]: r for r in lost.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("terms")).collect()}
        if by:
            name = store.new("gone")
            lost.select("segment", "doc", "path").write.parquet(store.at(f"{name}/docs"))
            lost.select("segment", F.explode(F.array_distinct(ranking.tokens(F.col("content")))).alias("term")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n")).write.options(**ZSTD).parquet(store.at(f"{name}/terms"))
            gone.append({"name": name, "segments": sorted(by)})
            segments = [s | {"gone": s["gone"] + (by[s["name"]]["n"] if s["name"] in by else 0)} for s in segments]
            stats = {"docs": stats["docs"] - sum(r["n"] for r in by.values()), "terms": stats["terms"] - sum(r["terms"] for r in by.values())}
        store.delete(f"{staging}/lost")
        _freed(spark)
    if fresh:
        size = int(state.where("what in ('new', 'changed')").agg(F.sum("size")).first()[0] or 0)
        # where none was touched, all that could be read is to be indexed, and no text is joined
        texts = got.join(changed, "path", "left_semi") if n.get("touched") else got.where("state = 'ok'")
        rows = chunk_files(_dealt(texts.select("path", "content", "hash"), size), embed, dim, tokens)
        made = _write_segment(store, rows, size, f"{staging}/contents")
        if made:
            segments.append(made)
            stats = {"docs": stats["docs"] + made["docs"], "terms": stats["terms"] + made["terms"]}
    while old_ones := due(segments):
        names = {s["name"] for s in old_ones}
        view = Index(store, base | {"segments": old_ones, "gone": [g for g in gone if names & set(g["segments"])]})
        size = sum(s["bytes"] for s in old_ones)
        made = _write_segment(store, _dealt(view.stored().drop(*[c.split()[0] for c in PLACE.split(", ")]), size, "chunk_index"), size)
        segments = [s for s in segments if s["name"] not in names] + ([made] if made else [])
    live = {s["name"] for s in segments}
    gone = [g for g in gone if live & set(g["segments"])]
    files = store.new("files")
    now.write.parquet(store.at(files))
    store.commit(base, files=files, segments=segments, gone=gone, stats=stats)
    store.clean()
    return out


def symbol_file(chunks: DataFrame, hits: DataFrame, symbol: str) -> DataFrame:
    """path of the best of hits(id, score) that defines a symbol, or else of the best hit."""
    best = hits.orderBy(F.desc("score"), "id").limit(10)
    rows = chunks.join(F.broadcast(best), "id").withColumn("_d", F.coalesce(F.array_contains("defined_symbols", symbol), F.lit(False)))
    return rows.orderBy(F.desc("_d"), F.desc("score"), "id").limit(1).select("path")


def target_kind(target: str) -> str:
    """What a skeleton is asked of: path, symbol or query."""
    return "path" if re.search(r"[/\\]|\.\w{1,10}$", target) else "symbol" if re.fullmatch(r"[A-Za-z_]\w*", target, re.A) else "query"


def skeletons_of(chunks: DataFrame, hits: DataFrame, limit: int = 3) -> DataFrame:
    """path, skeleton, rank of the best files of hits(path, rank), from the stored anchors; null where none was made."""
    best = hits.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path").limit(min(limit, 10))
    return F.broadcast(best).join(chunks.where("is_anchor").select("path", F.col("file_skeleton").alias("skeleton")), "path", "left").orderBy("rank", "path").select("path", "skeleton", "rank")
