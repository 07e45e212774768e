"""What is shown of hits: stitched ranges, clean lines, compact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines that begin so are left out of a shown snippet.
NOISE = ("File:", "Top comments:", "Preamble:", "(anchor)", "Imports:", "Exports:", "---")


def stitch(hits: DataFrame, limit: int = 1000, gap: int = 10) -> DataFrame:
    """path, start_line, end_line, n, content: hits of a path in line order, merged while they begin within gap lines of the end.

    The end of a merged range is that of the hit merged last, so it may shrink; one
    fold a path over at most limit hits, the best by score.
    """
    w = Window.partitionBy("path").orderBy(F.desc("score"), "start_line", "id")
    top = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    item = F.struct("start_line", F.col("_n").alias("n"), "end_line", "content")
    g = top.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("h"))
    one = lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.lit(1).alias("n"), x["content"].alias("content"))
    empty = F.array().cast("array<struct<start_line:int,end_line:int,n:int,content:string>>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["start_line"].alias("start_line"), x["end_line"].alias("end_line"), (last["n"] + 1).alias("n"), F.concat(last["content"], F.lit("\n   // ...\n"), x["content"]).alias("content"))
        return F.when(F.size(a) == 0, F.array(one(x))).when(x["start_line"] <= last["end_line"] + gap, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(one(x))))

    return g.select("path", F.explode(F.aggregate("h", empty, step)).alias("r")).select("path", "r.*")


def clean_lines(snippet: Column, width: int = 140) -> Column:
    """Lines with text, without labels and glued file names, cut to a width."""
    lines = F.transform(F.split(snippet, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)File:.*$", ""), r"\s+$", ""))
    bare = lambda x: F.regexp_replace(x, r"^\s+", "")
    kept = F.filter(lines, lambda x: (bare(x) != "") & ~_starts(bare(x)))
    return F.transform(kept, lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit(" ..."))).otherwise(x))


def _starts(x: Column) -> Column:
    out = F.lit(False)
    for p in NOISE:
        out = out | x.startswith(p)
    return out


def compact_role(role: Column) -> Column:
    r = F.coalesce(role, F.lit(""))
    return F.when(r == "", "UNK").when(r.startswith("ORCH"), "ORCH").when(r.startswith("DEF"), "DEF").when(r.startswith("IMP"), "IMPL").otherwise(F.upper(F.substring(r, 1, 4)))


def compact_confidence(level: Column) -> Column:
    c = F.upper(F.substring(F.coalesce(level, F.lit("")), 1, 1))
    return F.when(c.isin("H", "M", "L"), c).otherwise("U")


def compact_score(score: Column) -> Column:
    """Three digits without a leading 0 and trailing zeros."""
    s = F.regexp_replace(F.format_string("%.3f", score), r"^0\.", ".")
    return F.when(score.isNull(), "").otherwise(F.regexp_replace(s, r"\.?0+$", ""))


def preview(text: Column, defined: Column, width: int = 140) -> Column:
    first = F.try_element_at(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(1))
    p = F.coalesce(first, F.try_element_at(defined, F.lit(1)), F.lit(""))
    return F.when(F.length(p) > width, F.concat(F.substring(p, 1, width), F.lit("..."))).otherwise(p)


def compact(hits: DataFrame) -> DataFrame:
    """path, range (from 1), role, confidence, score, defined, preview."""
    return hits.select(
        F.coalesce("path", F.lit("Unknown path")).alias("path"), F.concat((F.col("start_line") + 1).cast("string"), F.lit("-"), (F.col("end_line") + 1).cast("string")).alias("range"),
        compact_role(F.col("role")).alias("role"), compact_confidence(F.col("confidence")).alias("conf"), compact_score(F.col("score")).alias("score"),
        F.slice(F.coalesce("defined_symbols", F.array().cast("array<string>")), 1, 3).alias("defined"), preview(F.col("content"), F.col("defined_symbols")).alias("preview"),
    )


def paths(hits: DataFrame) -> DataFrame:
    return hits.select("path").distinct().orderBy("path")


def tsv(rows: DataFrame) -> str:
    """Rows of a limited result as tab-separated text with a head line."""
    cell = lambda v: ",".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v).replace("\t", " ").replace("\n", " ")
    return "\n".join(["\t".join(rows.columns), *["\t".join(map(cell, r)) for r in rows.collect()]])


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def text_hits(hits: DataFrame) -> DataFrame:
    """Display rows of hits(path, score, content, chunk_type, start_line, end_line, num_lines): a missing end follows the number of lines."""
    start = F.coalesce("start_line", F.lit(0))
    end = F.coalesce("end_line", start + F.greatest(F.lit(0), F.coalesce("num_lines", F.lit(1)) - 1))
    return hits.select(F.coalesce("path", F.lit("Unknown path")).alias("path"), "score", F.coalesce("content", F.lit("")).alias("content"), "chunk_type", start.alias("start_line"), end.alias("end_line"))


#: Folders and names of tests in plain output.
PLAIN_TEST = r"(?i)(^|/)(__tests__|tests?|specs?)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$"


def plain(hits: DataFrame, lines: int = 20, whole: bool = False) -> DataFrame:
    """head (path:line and tags) and body (cleaned lines, at most so many unless whole) of each hit; no limit by file."""
    tags = F.filter(F.array(F.when(F.col("chunk_type").rlike("function|class|method"), "Definition"), F.when(F.col("path").rlike(PLAIN_TEST), "Test")), lambda x: x.isNotNull())
    rows = clean_lines(F.col("content"))
    more = F.size(rows) - lines
    shown = rows if whole else F.when(more > 0, F.concat(F.slice(rows, 1, lines), F.array(F.concat(F.lit("... (+"), more.cast("string"), F.lit(" more lines)"))))).otherwise(rows)
    head = F.concat("path", F.lit(":"), F.greatest(F.lit(1), F.col("start_line") + 1).cast("string"), F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ","), F.lit("]"))).otherwise(""))
    return hits.select(head.alias("head"), F.array_join(F.transform(shown, lambda x: F.concat(F.lit("  "), x)), "\n").alias("body"))


def padded(rows: DataFrame, widths: dict[str, int], right: tuple[str, ...] = ("score",)) -> str:
    """Rows of a limited result as a table of fixed widths; longer cells are cut, empty lists are a dash."""
    cell = lambda v: ",".join(map(str, v)) or "-" if isinstance(v, list) else "" if v is None else str(v)
    fit = lambda c, v: (v[: widths[c]].rjust if c in right else v[: widths[c]].ljust)(widths[c])
    line = lambda r: " ".join(fit(c, cell(r[c])) for c in widths)
    return "\n".join([line({c: c for c in widths}), *[line(r.asDict()) for r in rows.select(*widths).collect()]])


def human_size(n: int) -> str:
    """Bytes as B, KB, MB or GB with one decimal from KB on."""
    if n < 1024:
        return f"{n} B"
    unit = min(3, (n.bit_length() - 1) // 10)
    return f"{n / 1024**unit:.1f} {('KB', 'MB', 'GB')[unit - 1]}"


def age(seconds: float) -> str:
    """The largest whole unit of days, hours and minutes."""
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if seconds >= size:
            return f"{int(seconds // size)}{unit} ago"
    return "just now"


def listing(spark, parts: dict[str, str], now: float | None = None) -> list[tuple[str, str]]:
    """(label, size and age, or that it isn't there yet) of the folders of an index, below it and through Spark's file systems."""
    import time

    jvm, out = spark.sparkContext._jvm, []
    for label, where in parts.items():
        path = jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out.append((label, "not created yet"))
            continue
        changed = fs.getFileStatus(path).getModificationTime() / 1000
        out.append((label, f"{human_size(fs.getContentSummary(path).getLength())}, {age((now or time.time()) - changed)}"))
    return out
