"""Columns over text: tokens, hash slots, query expansion, paths and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is, by its least length.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]{1,}"
REFERENCE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]{2,}"

# Languages by suffix.
LANGUAGES = {
    ".py": "python", ".cpp": "cpp", ".cc": "cpp", ".h": "cpp", ".hpp": "cpp", ".c": "c", ".java": "java", ".go": "go",
    ".rs": "rust", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".md": "markdown",
}

# The words a query word brings with it.
EXPANSIONS = {
    "latency": ["p95", "throughput", "qps", "delay"],
    "symbol": ["identifier", "function", "method", "api"],
    "graph": ["dependency", "callgraph", "edge", "neighbor"],
    "index": ["hnsw", "ivf", "diskann", "bitmap"],
    "consistency": ["transaction", "outbox", "atomic", "sync"],
}

#: Slots of the hashed vectors.
SLOTS = 256


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tokens(text: Column) -> Column:
    """Lower-case tokens of at least two characters, in order, repeats kept; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), F.lower)


def reference_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of at least three characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE_TOKEN), 0), F.lower))


def expand(words: Column) -> Column:
    """The words, then for each occurrence of a trigger the words it brings with it."""
    brought = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    empty = F.array().cast("array<string>")
    return F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(brought, w), empty))))


def hash_slot(word: Column) -> Column:
    """The slot of a word: the first byte of its SHA-1, which is its first little-endian word modulo 256."""
    return F.conv(F.substring(F.sha1(word), 1, 2), 16, 10).cast("int")


def searchable(module: Column, path: Column, symbol: Column, text: Column) -> Column:
    """The text of a chunk that searches read; missing parts are skipped."""
    return F.concat_ws(" ", module, path, symbol, text)


def language_of(path: Column) -> Column:
    """The language by a path's suffix in any letter case, or null."""
    suffix = F.concat(F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1)))
    return F.when(F.contains(path, F.lit(".")), F.try_element_at(_literal_map(LANGUAGES), suffix))


def module_of(path: Column) -> Column:
    """The first segment of a path, or root where there is none."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def stem(path: Column) -> Column:
    """A file's name without directories and last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def lines(text: Column) -> Column:
    """The lines of a text as str.splitlines gives them, once carriage returns are folded to newlines."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\n\x0b\x0c\x1c\x1d\x1e\x85  ]")
    last_empty = F.element_at(parts, -1) == F.lit("")
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normal_path(path: Column) -> Column:
    """A relative path with single slashes, however it is spelled; null stays null."""
    slashes = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(slashes, r"/(?:\./)+", "/"), r"^(?:\./)+", ""), "^/|/$", "")


def normal_digest(digest: Column) -> Column:
    """A digest in lower case without an algorithm's name; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), r"^sha-?1[:=]", "")
    return F.when(bare != F.lit(""), bare)
