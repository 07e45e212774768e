"""Keep an index in step with a folder by streaming its listings.

A listing writes what is in the folder now, without reading it, as one generation of a
log. The stream over the log keeps a state a path: when it was last seen. A path that a
later listing doesn't show times out and leaves. Each micro-batch brings the index in
step with the paths that it saw and those that left: what is new or differs is read,
what can't be read keeps its rows and is asked for again by the next listing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import index
from ..operators.store import Store
from ..sources import files, providers

LISTED = "path string, mtime_ms double, size bigint, at timestamp"
EVENTS = "path string, mtime_ms double, size bigint, here boolean"


def note(spark: SparkSession, source: files.Tree, log: str, at_ms: int | None = None) -> None:
    """Add a generation to the log: the folder's indexable files, at a time later than the generation before."""
    store = Store(spark, log)
    staging = store.new("staging")
    try:
        now = source.listing(spark, store.at(staging)).withColumn("at", F.timestamp_millis(F.lit(at_ms or int(time.time() * 1000))))
        # a row that is no path carries the time of an empty listing
        mark = spark.range(1).select(F.lit("").alias("path"), F.lit(None).cast("double").alias("mtime_ms"), F.lit(None).cast("long").alias("size"), F.timestamp_millis(F.lit(at_ms or int(time.time() * 1000))).alias("at"))
        made = store.at(f"{staging}/generation")
        now.select("path", "mtime_ms", "size", "at").unionByName(mark).write.parquet(made)
        # files come into the log whole: a rename each, under names of their own
        fs, path = store._fs, store._path
        fs.mkdirs(path("listed"))
        for s in fs.listStatus(path(f"{staging}/generation")):
            if s.getPath().getName().endswith(".parquet"):
                fs.rename(s.getPath(), path(f"listed/{uuid.uuid4().hex}.parquet"))
    finally:
        store.discard()


def listings(spark: SparkSession, log: str) -> DataFrame:
    return spark.readStream.schema(LISTED).parquet(f"{log}/listed")


def events(listed: DataFrame) -> DataFrame:
    """EVENTS of a stream of listings: every path seen as of its latest time, and each that a later listing lacks, once, with here false.

    State: a time a path, which leaves with the path. Late generations (older than one
    that a batch before has seen) are dropped by the watermark.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "mtime_ms": [None], "size": [None], "here": [False]}).astype({"mtime_ms": "float64", "size": "Int64"})
            return
        last = state.get[0] if state.exists else -1
        best = None
        for b in batches:
            row = b.loc[b["at"].idxmax()]
            if best is None or row["at"] > best["at"]:
                best = row
        at = int(best["at"].timestamp() * 1000)
        if at < last:
            return
        state.update((at,))
        # runs out as soon as a later listing has moved the watermark past it
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"path": [key[0]], "mtime_ms": [best["mtime_ms"]], "size": [best["size"]], "here": [True]}).astype({"size": "Int64"})

    return listed.withWatermark("at", "0 seconds").groupBy("path").applyInPandasWithState(follow, EVENTS, "seen long", "append", GroupStateTimeout.EventTimeTimeout)


class Seen:
    """An index's known files with a batch's events applied, as a source of its build."""

    def __init__(self, known: DataFrame, batch: DataFrame, source: files.Tree):
        self.known, self.batch, self.source = known, batch, source

    def listing(self, spark: SparkSession, staging: str) -> DataFrame:
        rest = self.known.select("path", "mtime_ms", "size").join(self.batch.select("path"), "path", "left_anti")
        return rest.unionByName(self.batch.where("here").select("path", "mtime_ms", "size"))

    def contents(self, spark: SparkSession, names: DataFrame, n: int | None = None) -> DataFrame:
        return self.source.contents(spark, names, n)


def maintain(spark: SparkSession, source: files.Tree, log: str, root: str, checkpoint: str, embed: Callable[[], providers.Embed] | None = None, dim: int = 384, tokens: Callable[[], providers.TokenModel] | None = None):
    """Start a query that applies the generations which the log has now to the index at root.

    A batch that runs again finds what it did and does nothing. Old versions and
    segments go as in any build.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # the events are of the stateful stage: computed once, for the counts and the build
        some = batch.where("path <> ''").persist()
        try:
            if not some.isEmpty():
                index.build(batch.sparkSession, root, Seen(index.open_index(batch.sparkSession, root).files(), some, source), embed, dim, tokens)
        finally:
            some.unpersist()

    return events(listings(spark, log)).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
