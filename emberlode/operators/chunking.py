"""Text to chunk rows: line and character windows, anchors, display text, snippets.

All of it is expressions inside the row and one explode, so chunking is a
narrow stage that follows the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

STRIDE_LINES = config.CHUNK_LINES - config.OVERLAP_LINES
STRIDE_CHARS = config.CHUNK_CHARS - config.OVERLAP_CHARS


def _starts(n: Column, stride: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _blank(x: Column) -> Column:
    return ~x.rlike(r"\S")


def line_pieces(text: Column, size: int = config.CHUNK_LINES, stride: int = STRIDE_LINES) -> Column:
    """Array of (content, start_line, end_line): windows of lines, the last one even if the one before holds it."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    return F.transform(_starts(n, stride), lambda i: F.struct(F.array_join(F.slice(lines, i + 1, size), "\n").alias("content"), i.alias("start_line"), (F.least(i + size, n) - 1).alias("end_line")))


def char_pieces(text: Column, first_line: Column, size: int = config.CHUNK_CHARS, stride: int = STRIDE_CHARS) -> Column:
    """Array of (content, start_line, end_line): windows of characters without blank ones."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    piece = lambda i, n: F.substring(text, i + 1, F.lit(n))
    none = F.array().cast("array<struct<content:string,start_line:int,end_line:int>>")

    def step(a: Column, i: Column) -> Column:
        """The line breaks of a stride are counted once, and carried on."""
        at = (first_line + a["lines"]).cast("int")
        return F.struct((a["lines"] + breaks(piece(i, stride))).alias("lines"), F.concat(a["made"], F.array(F.struct(piece(i, size).alias("content"), at.alias("start_line"), (at + breaks(piece(i, size))).alias("end_line")))).alias("made"))

    made = F.aggregate(_starts(F.length(text), stride), F.struct(F.lit(0).alias("lines"), none.alias("made")), step, lambda a: a["made"])
    return F.filter(made, lambda p: ~_blank(p["content"]))


def split_pieces(text: Column) -> Column:
    """A definition cut to size: whole, by characters, or by lines and then by characters."""
    lines = F.size(F.split(text, "\n", -1))
    by_lines = F.filter(line_pieces(text), lambda p: (p["start_line"] == 0) | (p["end_line"] - p["start_line"] >= 2))
    again = F.flatten(F.transform(by_lines, lambda p: F.when(F.length(p["content"]) > config.CHUNK_CHARS, char_pieces(p["content"], p["start_line"])).otherwise(F.array(p))))
    whole = F.array(F.struct(text.alias("content"), F.lit(0).alias("start_line"), (lines - 1).alias("end_line")))
    return F.when((lines <= config.CHUNK_LINES) & (F.length(text) <= config.CHUNK_CHARS), whole).when(lines <= config.CHUNK_LINES, char_pieces(text, F.lit(0))).otherwise(again)


def explode_pieces(df: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    """One row a piece with chunk_index from 0."""
    return df.select(*keep, F.posexplode(pieces).alias("chunk_index", "_p")).select(*keep, "chunk_index", "_p.content", "_p.start_line", "_p.end_line")


def anchor(path: Column, content: Column, imports: Column, exports: Column, comments: Column) -> Column:
    """(content, end_line) of a file's anchor: names, then a preamble of lines with text."""
    rows = F.filter(F.transform(F.split(content, "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda r: ~_blank(r["line"]))
    first = F.slice(rows, 1, config.PREAMBLE_LINES)
    # a line is in while the lines before it are short of the limit
    kept = F.aggregate(
        first,
        F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("chars"), F.lit(0).alias("last")),
        lambda a, r: F.when(a["chars"] >= config.PREAMBLE_CHARS, a).otherwise(F.struct(F.concat(a["lines"], F.array(r["line"])).alias("lines"), (a["chars"] + F.length(r["line"])).alias("chars"), r["i"].alias("last"))),
    )
    some = lambda label, x, sep: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(x, sep)))
    text = F.concat_ws("\n\n", F.concat(F.lit("File: "), path), some("Imports: ", imports, ", "), some("Exports: ", exports, ", "), some("Top comments:\n", comments, "\n"), some("Preamble:\n", kept["lines"], "\n"), F.lit("---"), F.lit("(anchor)"))
    return F.struct(text.alias("content"), kept["last"].alias("end_line"))


def display_text(path: Column, imports: Column, context: Column, content: Column, docstring: Column) -> Column:
    """Path, imports, breadcrumb, content, docstring, a line each."""
    label = F.concat(F.lit("File: "), F.when(path == "", F.lit("unknown")).otherwise(path))
    crumbs = F.when(F.exists(context, lambda c: c.startswith("File: ")), context).otherwise(F.concat(F.array(label), context))
    names = F.when(F.size(imports) > 0, F.array_join(F.transform(imports, lambda i: F.when(i.startswith("import"), i).otherwise(F.concat(F.lit("import "), i))), "\n"))
    return F.concat_ws("\n", F.concat(F.lit("// "), path), names, F.array_join(crumbs, " > "), content, F.when(docstring != "", docstring))


def snippet(text: Column, lines: int = 15) -> Column:
    """What a hit shows: the text from its first line of code, at most so many lines."""
    rows = F.split(text, "\n", -1)
    # state: (index of the first code line or -1, inside an import that goes on)
    state = F.aggregate(
        F.transform(rows, lambda x, i: F.struct(F.trim(F.regexp_replace(x, r"[\t\r]", " ")).alias("t"), i.alias("i"))),
        F.struct(F.lit(-1).alias("at"), F.lit(False).alias("open")),
        lambda a, r: F.when(a["at"] >= 0, a)
        .when((r["t"] == "") | r["t"].startswith("File:") | r["t"].startswith("Imports:") | r["t"].startswith("Exports:") | r["t"].isin("---", "(anchor)") | r["t"].startswith("//"), a)
        .when(a["open"], F.struct(a["at"].alias("at"), (~r["t"].endswith(";")).alias("open")))
        .when(r["t"].startswith("import "), F.struct(a["at"].alias("at"), (~r["t"].endswith(";")).alias("open")))
        .when(r["t"].startswith("from "), a)
        .otherwise(F.struct(r["i"].alias("at"), F.lit(False).alias("open"))),
    )
    body = F.slice(rows, F.greatest(state["at"], F.lit(0)) + 1, F.size(rows))
    more = F.size(body) - lines
    shown = F.array_join(F.slice(body, 1, lines), "\n")
    return F.regexp_replace(F.when(more > 0, F.concat(shown, F.lit("\n... (+"), more.cast("string"), F.lit(" more lines)"))).otherwise(shown), r"^\s+|\s+$", "")


def capped(symbols: Column, most: int = 10) -> Column:
    """A symbol list cut to most entries and a note of the rest."""
    n = F.coalesce(F.size(symbols), F.lit(0))
    return F.when(n > most, F.concat(F.slice(symbols, 1, most), F.array(F.concat(F.lit("... (+"), (n - most).cast("string"), F.lit(" more)"))))).otherwise(F.coalesce(symbols, F.array().cast("array<string>")))
