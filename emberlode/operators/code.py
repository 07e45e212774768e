"""Code structure: definitions, references, complexity, roles, skeletons.

Parsing runs in an Arrow stage with a parser by language: Python's own ast for
.py, a brace scanner for languages with braces. Neither gives the trees of other
parsers, and no such parity is claimed; a file without definitions falls back to
line windows.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES


@dataclass
class Chunk:
    content: str
    start_line: int
    end_line: int
    chunk_type: str
    name: str = ""
    context: list[str] = field(default_factory=list)
    complexity: int = 1
    exported: bool = False
    references: list[str] = field(default_factory=list)
    docstring: str = ""
    parent: str = ""
    body: tuple[int, int] | None = None  # first and last line of what a skeleton leaves out

    @property
    def role(self) -> str | None:
        return None if self.chunk_type == "block" else "ORCHESTRATION" if self.complexity > 5 and len(self.references) > 5 else "DEFINITION"


def _python(text: str) -> list[Chunk]:
    tree, lines, out = ast.parse(text), text.split("\n"), []

    def visit(node: ast.AST, trail: list[str]) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if trail and trail[-1].startswith("Class: ") else "function"
                start = min([n.lineno, *[d.lineno for d in n.decorator_list]]) - 1
                calls = [f.attr if isinstance(f, ast.Attribute) else f.id for c in sorted((c for c in ast.walk(n) if isinstance(c, ast.Call)), key=lambda c: (c.end_lineno, c.end_col_offset)) if isinstance(f := c.func, (ast.Attribute, ast.Name))]
                # an elif, an except, a match and `and` or `or` don't count
                branches = sum(isinstance(c, (ast.For, ast.AsyncFor, ast.While, ast.IfExp)) or isinstance(c, ast.If) and not lines[c.lineno - 1].lstrip().startswith("elif") for c in ast.walk(n))
                before = []
                i = start - 1
                while i >= 0 and lines[i].strip().startswith("#"):
                    before.insert(0, lines[i].strip())
                    i -= 1
                label = f"{'Class' if is_class else 'Method' if kind == 'method' else 'Function'}: {n.name}"
                parent = re.sub(r"^(Class|Method|Function|Interface|Type): ", "", trail[-1]) if trail else ""
                body = None if is_class else (n.body[0].lineno - 1, n.end_lineno - 1)
                out.append(Chunk("\n".join(lines[start : n.end_lineno]), start, n.end_lineno - 1, kind, n.name, [*trail, label], 1 + branches, False, calls, "\n".join(before), parent, body))
                visit(n, [*trail, label])
            else:
                visit(n, trail)

    visit(tree, [])
    return out


_HEAD = re.compile(
    r"^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:pub(?:\([a-z]+\))?\s+|public\s+)?(?:(?:async|static|private|protected|abstract|final|const|unsafe|inline|override|virtual)\s+)*"
    r"(?:(?P<kind>class|interface|enum|struct|trait|impl|namespace|function\*?|func|fn)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_$][\w$]*)|(?:[\w<>\[\],.*&]+\s+){0,6}(?P<method>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)[^;{}=]*(?=\{))",
    re.M,
)
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "function", "match", "with"}
_TYPES = {"class": "class", "struct": "class", "impl": "class", "trait": "interface", "interface": "interface", "enum": "type_alias", "namespace": "class"}


def _blanked(text: str) -> str:
    """The text with comments and literals as spaces, so that braces and words in them don't count."""
    hide = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", hide, text, flags=re.S)


#: Words that add to the complexity, by language; operators add in all of them.
_BRANCHES = {"rust": (), "go": ("if", "for")}
_VALUE = re.compile(r"^(?P<export>export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)", re.M)
#: A constant in capitals, and in _values the three marks of a value that is a definition.
_UPPER = re.compile(r"(?:^|\n)\s*(?:export\s+)?const\s+[A-Z0-9_]+\s*=")


def _values(text: str, bare: str) -> list[Chunk]:
    """Value definitions at the outermost level: arrow functions, function and class expressions, constants in capitals."""
    depth, level = 0, np.zeros(len(bare) + 1, np.int32)
    for i, c in enumerate(bare):
        depth += (c in "{([") - (c in "})]")
        level[i + 1] = depth
    out = []
    for m in _VALUE.finditer(bare):
        if level[m.start()] or m["export"]:  # an exported one is part of the text between
            continue
        end = m.end()
        while end < len(bare) and not (level[end] == 0 and (bare[end] == ";" or bare[end] == "\n" and not re.match(r"\s*[.?:=+&|]", bare[end:]) and not re.search(r"(?:[=(,+&|?:]|=>)\s*\Z", bare[m.start() : end][-40:]))):
            end += 1
        end = min(end + (end < len(bare) and bare[end] == ";"), len(text))
        part = text[m.start() : end]
        if not ("=>" in part or "function " in part or "class " in part or _UPPER.search(part)):
            continue
        s = text.count("\n", 0, m.start())
        inner = bare[m.start() : end]
        calls = [c for c in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", inner) if c not in _NOT_NAMES]
        branches = len(re.findall(r"\b(?:if|for|while|switch|catch)\b|&&|\|\||\?\?", inner))
        out.append(Chunk(part, s, s + part.count("\n"), "function", m["name"], [f"Function: {m['name']}"], 1 + branches, False, calls))
    return out


def file_facts(path: str, text: str) -> tuple[list[str], list[str], list[str]]:
    """Import statements, exported names and the comments of the first 10 lines of a file."""
    ext = re.search(r"[^/](\.[^./]*)$", path.lower())
    lang, parsed = LANGUAGES.get(ext[1] if ext else "", ("", False))
    if not parsed:
        return [], [], []
    top = "\n".join(text.split("\n")[:10])
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [], [], []
        imports = [ast.get_source_segment(text, n) or "" for n in ast.walk(tree) if isinstance(n, ast.Import)]
        return imports, [], [x.strip() for x in re.findall(r"^[ \t]*#[^\n]*", top, re.M)]
    bare = _blanked(text)
    imports = [text[m.start() : m.end()].strip() for m in re.finditer(r"^import\b[^;\n{]*(?:\{[^}]*\}[^;\n]*)?;?", bare, re.M)]
    exports = [m[1] or m[2] or m[3] for m in re.finditer(r"^export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:(?:class|interface|enum|type|function\*?)\s+([\w$]+)|(?:const|let|var)\s+([\w$]+)|([A-Za-z_$][\w$]*)\s*;?$)", bare, re.M)]
    comments = [m[0].strip() for m in re.finditer(r"//[^\n]*|/\*.*?\*/", text, re.S) if text.count("\n", 0, m.start()) < 10 and bare[m.start() : m.start() + 2] == "  "]
    return imports, exports, comments


def _braces(text: str, lang: str = "") -> list[Chunk]:
    bare, lines, out = _blanked(text), text.split("\n"), []
    words = _BRANCHES.get(lang, ("if", "for", "while", "switch", "catch"))
    branch = re.compile((rf"\b(?:{'|'.join(words)})\b|" if words else "") + r"&&|\|\||\?\?")
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    match: dict[int, int] = {}
    stack: list[int] = []
    for i, c in enumerate(bare):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            match[stack.pop()] = i
    line_of = lambda i: bisect.bisect_left(breaks, i)
    open_: list[tuple[int, str]] = []
    at = 0
    while m := _HEAD.search(bare, at):
        at = m.end()
        name = m["name"] or m["method"]
        brace = bare.find("{", m.end("name") if m["name"] else m.end())
        semi = bare.find(";", m.end())
        if name in _NOT_NAMES or brace < 0 or brace not in match or (m["name"] and 0 <= semi < brace):
            at = m.end("method") + 1 if m["method"] else m.end()
            continue
        end, begin = match[brace], m.start() + len(m[0]) - len(m[0].lstrip())
        while open_ and open_[-1][0] < begin:
            open_.pop()
        kind = _TYPES.get(m["kind"] or "", "")
        inside = bool(open_ and open_[-1][1].startswith(("Class: ", "Interface: ")))
        kind = kind or ("method" if inside else "function")
        body = bare[brace:end]
        calls = [c for c in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", body) if c not in _NOT_NAMES]
        branches = len(branch.findall(body))
        label = {"class": "Class", "interface": "Interface", "type_alias": "Type", "method": "Method"}.get(kind, "Function") + f": {name}"
        s, e = line_of(begin), line_of(end)
        before, i = [], s - 1
        while i >= 0 and lines[i].strip().startswith(("//", "*", "/*")):
            before.insert(0, lines[i].strip())
            i -= 1
        trail = [t for _, t in open_]
        parent = re.sub(r"^(Class|Method|Function|Interface|Type): ", "", trail[-1]) if trail else ""
        out.append(Chunk(text[begin : end + 1], s, e, kind, name, [*trail, label], 1 + branches, bool(m["export"]), calls, "\n".join(before), parent, (brace, end) if kind in ("method", "function") else None))
        open_.append((end, label))
        at = brace + 1
    if lang in ("typescript", "tsx", "javascript"):
        known = [(c.start_line, c.end_line) for c in out if len(c.context) == 1]
        out += [v for v in _values(text, bare) if not any(a <= v.start_line and v.end_line <= b for a, b in known)]
    return out


def definitions(path: str, text: str) -> list[Chunk]:
    """Definitions and the text between the outermost ones, by line; none if the file has no definition."""
    ext = re.search(r"[^/](\.[^./]*)$", path.lower())
    lang = LANGUAGES.get(ext[1] if ext else "", ("", False))
    if not lang[1] or lang[0] == "ruby":
        return []
    try:
        found = _python(text) if lang[0] == "python" else _braces(text, lang[0])
    except (SyntaxError, ValueError, RecursionError):
        return []
    if not found:
        return []
    lines, at, row, gaps = text.split("\n"), 0, 0, []
    outer = sorted((c for c in found if len(c.context) == 1), key=lambda c: c.start_line)
    for s, e in [*[(c.start_line, c.end_line) for c in outer], (len(lines), len(lines) - 1)]:
        between = "\n".join(lines[at:s])
        if between.strip():  # from the last row of the definition before to the first of the next
            gaps.append(Chunk(between, row, min(s, len(lines) - 1), "block"))
        at, row = max(at, e + 1), max(row, e)
    return sorted([*found, *gaps], key=lambda c: (c.start_line, c.end_line))


def skeleton(path: str, text: str, most: int = 4) -> str | None:
    """The file with the bodies of functions and methods replaced by a summary; None without definitions."""
    python = path.lower().endswith(".py")
    found = [c for c in definitions(path, text) if c.body]
    if not found:
        return None
    found.sort(key=lambda c: c.body[0])
    out, at = [], 0
    lines = text.split("\n")
    for c in found:
        if c.body[0] < at:
            continue  # inside a body that is left out already
        calls = [x for x in dict.fromkeys(c.references) if len(x) < 30]
        parts = ([f"→ {', '.join([*calls[:most], *(['...'] if len(calls) > most else [])])}"] if calls else []) + ([f"C:{c.complexity}"] if c.complexity > 1 else []) + (["ORCH"] if c.role == "ORCHESTRATION" else [])
        note = f"{'#' if python else '//'} {' | '.join(parts) if parts else '...'}"
        if python:
            out += [*lines[at : c.body[0]], f"    {note}", "    ..."]
            at = c.body[1] + 1
        else:
            out.append(text[at : c.body[0]] + "{\n    " + note + "\n  }")
            at = c.body[1] + 1
    body = "\n".join([*out, *lines[at:]]) if python else "".join(out) + text[at:]
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", body, flags=re.M)).strip()
    return f"{'#' if python else '//'} {path} (skeleton, ~{-(-len(body) // 4)} tokens)\n{body}"


CHUNKS = "path string, chunk_index int, content string, start_line int, end_line int, chunk_type string, complexity float, is_exported boolean, defined_symbols array<string>, referenced_symbols array<string>, role string, parent_symbol string, context array<string>, docstring string"
_FIELDS = [("path", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("chunk_type", pa.string()), ("complexity", pa.float32()), ("is_exported", pa.bool_()), ("defined_symbols", pa.list_(pa.string())), ("referenced_symbols", pa.list_(pa.string())), ("role", pa.string()), ("parent_symbol", pa.string()), ("context", pa.list_(pa.string())), ("docstring", pa.string())]


def parse(files: DataFrame) -> DataFrame:
    """Chunk rows of files(path, content) that have definitions; the others give none here."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _FIELDS]
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, c in enumerate(definitions(path or "", text or "")):
                    for col, v in zip(cols, (path, i, c.content, c.start_line, c.end_line, c.chunk_type, float(c.complexity), c.exported, [c.name] if c.name else [], c.references, c.role, c.parent or None, c.context, c.docstring)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])

    return files.select("path", "content").mapInArrow(rows, CHUNKS)


def skeletons(files: DataFrame) -> DataFrame:
    """path, skeleton, success; without definitions the first 30 lines and the reason."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [skeleton(p or "", t or "") for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.string())], names=["path", "content", "_s"])

    made = files.select("path", "content").mapInArrow(rows, "path string, content string, _s string")
    return made.select("path", F.coalesce("_s", preview(F.col("path"), F.col("content"), F.lit("no definitions found"))).alias("skeleton"), F.col("_s").isNotNull().alias("success"))


def preview(path: Column, content: Column, reason: Column, most: int = 30) -> Column:
    """What stands for a skeleton that can't be made."""
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    head = F.array(F.concat(F.lit("// Skeleton unavailable: "), reason), F.concat(F.lit("// File: "), path), F.concat(F.lit("// Showing first "), F.least(F.lit(most), n).cast("string"), F.lit(" lines"), F.when(n > most, " (truncated)").otherwise("")), F.lit(""))
    tail = F.when(n > most, F.array(F.lit(""), F.concat(F.lit("// ... "), (n - most).cast("string"), F.lit(" more lines")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.slice(lines, 1, most), tail), "\n")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def role(chunk_type: Column, complexity: Column, references: Column, node_type: Column) -> Column:
    """Definitions are DEFINITION, or ORCHESTRATION with over 5 branches and over 5 references; import nodes IMPORT."""
    is_def = chunk_type != "block"
    return F.when(is_def & (complexity > 5) & (F.size(references) > 5), "ORCHESTRATION").when(is_def, "DEFINITION").when(F.contains(node_type, F.lit("import")), "IMPORT")


def summary(references: Column, complexity: Column, role_: Column, prefix: Column, most: int = 4) -> Column:
    """The comment that stands for a body: some calls, the complexity, the role."""
    calls = F.when(F.size(references) > most, F.concat(F.slice(references, 1, most), F.array(F.lit("...")))).otherwise(references)
    parts = F.filter(F.array(F.when(F.size(references) > 0, F.concat(F.lit("→ "), F.array_join(calls, ", "))), F.when(complexity > 1, F.concat(F.lit("C:"), complexity.cast("int").cast("string"))), F.when(role_ == "ORCHESTRATION", F.lit("ORCH"))), lambda x: x.isNotNull())
    return F.concat(prefix, F.lit(" "), F.when(F.size(parts) == 0, F.lit("...")).otherwise(F.array_join(parts, " | ")))
