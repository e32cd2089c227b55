"""Files that nobody wrote by hand: generated by a tool, minified, vendored from elsewhere, or data saved as code.

Each chunk's token stream is fingerprinted by winnowing. A file whose fingerprints largely stand in several
repositories is a recurring one. Copies of our own files recur as third-party ones do, so among recurring files
a mark decides: a directory for third-party files, a party's notice or a licence's text, on the file or on a copy of
it in another repository. A file that recurs nowhere is vendored only by a strong mark: such a directory, or a
notice that names its makers; a licence alone says nothing of who wrote a file. Generated code and data
repeat few forms of tokens; a tool's notice stands in the comment that a file begins with; minified and
encoded text has lines without white space. Chunks give counts that are summed by file, so that no file's text
is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import write_table

#: Tokens in a fingerprinted run, and runs in a window of which the least hash is kept.
RUN, WINDOW = 12, 48
#: Tokens in a run of forms; below this share of different runs a file repeats itself as tools' output does.
FORM_RUN, FORM_SHARE = 16, 0.33
#: Runs among which forms are compared, so that long files are judged as short ones are.
FORM_BLOCK = 1000
#: Runs of forms that a file needs before their share says something.
FORM_LEAST = 60
#: Share of a file's fingerprints that must recur; in how many repositories, its own counted.
RECURRING, REPOSITORIES = 0.6, 2
#: Longest line that is read as a line; the share of a file's characters in dense lines beyond it.
LONG_LINE, DENSE_SHARE = 250, 0.6

# Directories that hold third-party files.
VENDOR_DIRECTORIES = (
    "vendor", "vendored", "third_party", "thirdparty", "third-party", "3rdparty", "external", "externals", "extern",
    "contrib", "deps", "node_modules", "bower_components", "site-packages", "subprojects", "Pods", "Godeps",
)
# What a tool's notice says.
GENERATED = re.compile(
    r"@generated\b|<auto-?generated>|\bauto[- ]?generated\b(?! (?:ids?|names?|keys?))|code generated by .*do not (?:edit|modify|change)"
    r"|(?:this (?:file|code|source|module)|file) (?:was |is |has been )?(?:automatically )?(?:produced|generated|created|written|emitted|built) (?:by|from|with)\b"
    r"|automatically (?:created|generated|produced|written)\b|machine[- ](?:written|generated|made)|^\W*generated (?:source|file|code|by|from|with|on|automatically)\b"
    r"|\bgenerated\b.*\b(?:do not|don't) (?:edit|modify|change|touch)|regenerate (?:it |this )?(?:with|by|using)",
    re.I,
)
# What a notice says that names the third party, and what any licence says.
THIRD_PARTY = re.compile(
    r"\bupstream\b|\bproject contributors\b|\(c\) \d{4}(?:-\d{4})? [\w-]+ (?:authors|contributors)"
    r"|copyright (?:\(c\) )?\d{4}(?:-\d{4})? the [\w-]+ (?:authors|contributors|project|developers)|part of the [\w-]+ (?:toolkit|library|project|framework|distribution)\b"
    r"|^\W*[\w-]+ (?:runtime|library|v?\d+\.\d+(?:\.\d+)?)\b.*(?:version|https?://|--)|/\*!",
    re.I,
)
LICENCE = re.compile(
    r"redistribut|permission (?:to use|is hereby|is granted)|\blicen[cs]ed? (?:under|v)|\bunder the [\w-]+ (?:licen[cs]e|terms)|licen[cs]e:|spdx-"
    r"|see (?:the )?(?:copying|licen[cs]e|notice)|\bcopying\.\w|all rights reserved",
    re.I,
)
OWN = re.compile(r"internal use|confidential|proprietary", re.I)

_token = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")
_comment_line = re.compile(r"\s*(?:#(?!\s*(?:include|define|pragma|if|ifdef|ifndef|endif|import)\b)|//|/\*|\*|--|<!--|;|%)")
_quoted = re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`")
_vendored = re.compile(r"(?:^|/)(?:%s)/[^/]+/" % "|".join(map(re.escape, VENDOR_DIRECTORIES)), re.I)
_versioned = re.compile(r"(?:^|/)(?:lib|libs|packages)/[^/]*(?:[-_]v?\d+(?:\.\d+)*|-src)/", re.I)

_index: dict[str, int] = {}
_hashes = np.zeros(1 << 16, np.uint64)
_forms = np.zeros(1 << 16, np.uint64)


def _token_ids(tokens: list[str]) -> np.ndarray:
    """Indexes of tokens into the tables of their hashes and forms, which grow as tokens are met."""
    global _hashes, _forms
    if len(_index) > 600_000:
        _index.clear()
    new = [t for t in set(tokens) if t not in _index]
    for t in new:
        i = _index[t] = len(_index)
        if i >= len(_hashes):
            _hashes, _forms = np.resize(_hashes, 2 * len(_hashes)), np.resize(_forms, 2 * len(_forms))
        _hashes[i] = xxhash.xxh3_64_intdigest(t)
        c = t[0]
        _forms[i] = 1 if c.isalpha() or c in "_$" else 2 if c.isdigit() else 3 + ord(c)
    return np.fromiter(map(_index.__getitem__, tokens), np.int64, len(tokens))


def _runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of so many values."""
    if len(values) < length:
        return np.empty(0, np.uint64)
    n = len(values) - length + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(length):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += values[i : i + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def fingerprints(text: str) -> tuple[np.ndarray, int, int]:
    """(winnowed hashes, runs of forms, different ones) of a text's tokens."""
    tokens = _token.findall(text)
    if not tokens:
        return np.empty(0, np.uint64), 0, 0
    ids = _token_ids(tokens)
    runs = _runs(_hashes[ids], RUN)
    if len(runs) > WINDOW:
        kept = np.unique(np.lib.stride_tricks.sliding_window_view(runs, WINDOW).min(axis=1))
    else:
        kept = np.unique(runs.min(keepdims=True)) if len(runs) else runs
    forms = _runs(_forms[ids], FORM_RUN)
    block = (np.arange(len(forms)) // FORM_BLOCK).astype(np.uint64)
    return kept, len(forms), len(np.unique(forms + block * np.uint64(0x9E3779B97F4A7C15)))


def notices(text: str) -> tuple[bool, bool, bool]:
    """(a tool's, a named third party's, any licence's) notice in the whole comment that a file begins with."""
    generated = third = licence = False
    block, at = False, 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line, at = text[at:stop], stop + 1
        if not line.strip():
            continue
        if not (block or _comment_line.match(line)):
            break
        block |= "/*" in line
        head, closed, code = line.rpartition("*/")
        if closed:
            block = False
            line = head + closed if code.strip() else line
        bare = _quoted.sub("", line)
        generated |= bool(GENERATED.search(bare))
        if not OWN.search(bare):
            third |= bool(THIRD_PARTY.search(bare))
            licence |= bool(LICENCE.search(bare))
    return generated, third, licence


def dense_characters(text: str) -> int:
    """Characters of long lines with hardly any white space."""
    total = 0
    for line in text.split("\n"):
        if len(line) > LONG_LINE and sum(line.count(c) for c in " \t") < 0.06 * len(line):
            total += len(line)
    return total


def vendored_path(path: str) -> bool:
    """Whether a path lies in a package below a directory for third-party files."""
    return bool(_vendored.search(path) or _versioned.search(path))


def chunk_marks(chunks: DataFrame) -> DataFrame:
    """One row of counts, notices and fingerprints for each distinct chunk with a path and a text."""
    names = ("_path", "repository", "markup", "characters", "dense", "runs", "forms", "generated", "third", "licence", "prints")
    shape = "_path string, repository string, markup boolean, characters bigint, dense bigint, runs bigint, forms bigint, generated boolean, third boolean, licence boolean, prints array<bigint>"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names[:-1]]
            flat, ends = [], [0]
            for path, language, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints, runs, forms = fingerprints(text)
                generated, third, licence = notices(text) if first <= 1 else (False, False, False)
                values = (
                    path, path.partition("/")[0] if "/" in path else "", path.lower().endswith(".md") or (language or "").lower() == "markdown",
                    len(text), dense_characters(text), runs, forms, generated, third or vendored_path(path), licence,
                )
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                flat.append(prints.view(np.int64))
                ends.append(ends[-1] + len(prints))
            types = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4, *[pa.bool_()] * 3]
            columns = [pa.array(r, t) for r, t in zip(rows, types, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, found], list(names))

    rows = chunks.filter("file_path IS NOT NULL AND chunk_text IS NOT NULL AND chunk_text <> ''").select(
        F.col("file_path").cast("string").alias("_path"),
        F.col("language").cast("string").alias("language"),
        F.coalesce("start_line", F.lit(1)).cast("int").alias("first"),
        F.col("chunk_text").cast("string").alias("_text"),
    )
    return rows.mapInArrow(mark, shape).dropDuplicates()


def not_by_hand(chunks: DataFrame, repositories: int = REPOSITORIES) -> DataFrame:
    """(_path, generated, minified, vendored, reason): files of which at least one of the three holds, by path.

    reason, of a vendored file: recurring, where its fingerprints stand in at least so many repositories, or marked.
    Files without any text give no row; rows with a null path are left out; repeated rows count once; a null
    start_line is a file's start; languages are read from the suffix first. Data saved as code counts as generated
    or, in long lines, as minified. Whole texts are read; extra columns are not. At least two repositories are needed.
    """
    if repositories < 2:
        raise ValueError("a file recurs in at least 2 repositories")
    marks = write_table(chunk_marks(chunks), "marks")
    files = marks.groupBy("_path").agg(
        F.first("repository").alias("repository"),
        F.max("markup").alias("markup"),
        *[F.sum(c).alias(c) for c in ("characters", "dense", "runs", "forms")],
        F.max("generated").alias("noticed"),
        F.max("third").alias("third"),
        (F.max("third") | F.max("licence")).alias("marked"),
    )
    judged = files.select(
        "_path",
        "repository",
        "third",
        "marked",
        (~F.col("markup") & (F.col("noticed") | (F.col("runs") >= FORM_LEAST) & (F.col("forms") < FORM_SHARE * F.col("runs")))).alias("generated"),
        (F.col("dense") >= DENSE_SHARE * F.col("characters")).alias("minified"),
    )
    prints = marks.select("_path", F.explode("prints").alias("print")).join(judged.select("_path", "repository", "marked"), "_path").distinct()
    # where each fingerprint stands: a row for each repository, whatever number of files it has there
    places = prints.groupBy("print", "repository").agg(F.max("marked").alias("marked"))
    spread = places.groupBy("print").agg(
        F.count("*").alias("_n"),
        F.min(F.when(F.col("marked"), F.col("repository"))).alias("_least"),
        F.max(F.when(F.col("marked"), F.col("repository"))).alias("_most"),
    ).filter(F.col("_n") >= repositories)
    elsewhere = (F.col("_least") != F.col("repository")) | (F.col("_most") != F.col("repository"))
    recurring = (
        prints.join(spread, "print", "left")
        .groupBy("_path")
        .agg(
            (F.count("_n") >= RECURRING * F.count("*")).alias("recurring"),
            (F.count_if(elsewhere) >= RECURRING * F.count("*")).alias("copied"),
        )
    )
    several = F.coalesce("recurring", F.lit(False)) & (F.col("marked") | F.coalesce("copied", F.lit(False)))
    return (
        judged.join(recurring, "_path", "left")
        .select("_path", "generated", "minified", (several | F.col("third")).alias("vendored"), F.when(several, "recurring").when(F.col("third"), "marked").alias("reason"))
        .filter("generated OR minified OR vendored")
    )
