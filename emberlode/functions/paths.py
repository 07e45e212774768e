"""Path and file predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

#: Extension -> (language, has definitions of its own).
LANGUAGES = {
    ".ts": ("typescript", True), ".tsx": ("tsx", True), ".js": ("javascript", True), ".jsx": ("javascript", True), ".mjs": ("javascript", True), ".cjs": ("javascript", True),
    ".py": ("python", True), ".go": ("go", True), ".rs": ("rust", True), ".java": ("java", True), ".c": ("c", True), ".h": ("c", True),
    ".cpp": ("cpp", True), ".hpp": ("cpp", True), ".cc": ("cpp", True), ".cxx": ("cpp", True), ".cs": ("c_sharp", True), ".rb": ("ruby", True), ".php": ("php", True),
    ".json": ("json", False), ".yaml": ("yaml", False), ".yml": ("yaml", False), ".md": ("markdown", False), ".mdx": ("markdown", False),
    ".sh": ("bash", False), ".html": ("html", False), ".css": ("css", False),
}
HASH_COMMENTS = ("python", "ruby", "bash")
DASH_COMMENTS = ("sql", "lua")


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for a name that only begins with one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    pairs = [x for e, (name, _) in LANGUAGES.items() for x in (F.lit(e), F.lit(name))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("plaintext"))


def indexable(path: Column, size: Column) -> Column:
    """Files by extension or name, and of 1 byte to the limit."""
    known = extension(path).isin(*config.EXTENSIONS) | basename(path).isin(*config.BASENAMES, *[e for e in config.EXTENSIONS])
    return known & size.between(1, config.MAX_FILE_BYTES)


def is_doc(path: Column) -> Column:
    return extension(path).isin(*config.DOC_EXTENSIONS)


def is_large_data(path: Column, content: Column) -> Column:
    return extension(path).isin(*config.DATA_EXTENSIONS) & (F.length(content) > config.DATA_LIMIT)


def comment_prefix(lang: Column) -> Column:
    return F.when(lang.isin(*HASH_COMMENTS), "#").when(lang.isin(*DASH_COMMENTS), "--").otherwise("//")


def under(path: Column, prefix: str) -> Column:
    """Paths under a prefix; % and _ in it stay wildcards, and src/lib covers src/library."""
    return path.like(prefix.replace("\\", "/") + "%")
