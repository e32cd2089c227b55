"""Cutting oversized pieces of source files at natural boundaries: before outermost definitions and headings.

Texts are read in ranges of characters, each moved to the lines that begin in it, with a halo, so that no worker needs a
whole file. Whether a line lies inside a string, comment or fence depends on everything before it: each range gives, for
every lexical state it may begin in, the state it ends in; these tables are composed along the file, first within blocks
of ranges, then over blocks. With its true first state known, a range emits its boundaries; line numbers are prefix
sums. What is attached above a border is followed through the ranges before, a signature that goes on beyond the
halo through those after. Pieces are planned from the lines' lengths as they come, and emitted by offset from the ranges.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions.sizes import join_checked
from tesserine.session import write_table

#: Bytes of a range, and what it sees beyond its last line.
RANGE, HALO = 262_144, 16_384
#: Ranges that are cut at once, so that a giant text isn't counted through for each of them.
CUT = 64
#: Ranges whose state tables are composed in one group.
BLOCK = 512

# Languages by suffix, and the openers of constructs that may span lines with their closers.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "java": "java",
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "md": "markdown",
}
_SPANS = {
    "python": {'"""': r'(?<!\\)(?:\\\\)*"""', "'''": r"(?<!\\)(?:\\\\)*'''"},
    "javascript": {"`": r"(?<!\\)(?:\\\\)*`", "/*": r"\*/"},
    "java": {'"""': r'(?<!\\)(?:\\\\)*"""', "/*": r"\*/"},
    "go": {"`": "`", "/*": r"\*/"},
    "rust": {'"': r'(?<!\\)(?:\\\\)*"', 'r"': '"', 'r#"': '"#', 'r##"': '"##', "/*": r"\*/"},
    "c": {'R"(': r'\)"', "/*": r"\*/"},
    "markdown": {"```": r"(?m)^ {0,3}`{3,}[ \t]*$", "~~~": r"(?m)^ {0,3}~{3,}[ \t]*$"},
    "other": {"/*": r"\*/"},
}
_OPENERS = {
    "python": r"""#[^\n]*|(?P<open>\"\"\"|''')|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""",
    "javascript": r"""//[^\n]*|(?P<open>/\*|`)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""",
    "java": r"""//[^\n]*|(?P<open>/\*|\"\"\")|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'""",
    "go": r"""//[^\n]*|(?P<open>/\*|`)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'""",
    "rust": r"""//[^\n]*|(?P<open>/\*|\bb?r\#{0,2}"|")|'(?:[^'\\\n]|\\[^\n]{1,10}?)'""",
    "c": r"""//[^\n]*|(?P<open>/\*|R"\()|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'""",
    "markdown": r"""(?m)^ {0,3}(?P<open>`{3,}(?=[^`\n]*$)|~{3,})""",
    "other": r"""//[^\n]*|(?P<open>/\*)|"(?:[^"\\\n]|\\.)*\"""",
}
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|export|default|declare|async|pub(?:\([^)]*\))?|unsafe|const|extern(?: \"C\")?)\s+)*"
_DEFINITIONS = {
    "python": r"(?:async\s+def|def|class)\s+\w|[A-Za-z_]\w*\s*(?::[^=\n]+)?=\s*lambda\b",
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b\s*\*?\s*\w*\s*[(<]|class\b|(?:interface|type|enum|namespace)\s+\w)"
    r"|(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|class\b|(?:<[^>\n]*>)?\([^\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)"
    r"|(?:module\.)?exports(?:\.\w+)?\s*=\s*(?:async\s+)?function\b",
    "java": _MODIFIERS + r"(?:class|interface|enum|record|@interface)\s+\w",
    "go": r"func\b|type\s+\w|type\s*\(|var\s+\w+\s*=\s*func\b",
    "rust": _MODIFIERS + r"(?:async\s+)?(?:fn|struct|enum|trait|impl|union|type|macro_rules!)\b",
    "markdown": r" {0,3}#{1,6}(?:[ \t]|$)",
    "other": r"(?:function|class|struct|interface|type|impl|def|fn|func)\s+\w",
}
_C_TYPE = re.compile(r"(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class)?)\s+\w+[^;=()]*(?:\{[^;]*)?$")
_C_FUNCTION = re.compile(r"(?!(?:return|if|else|for|while|switch|case|do|goto|using|namespace|typedef|throw|delete|new)\b)[A-Za-z_][\w:<>,*&\s~\[\]]*?[\s*&~:]\w[\w:~]*\s*\([^;=]*(?:\)[^;=]*)?\{?[^;]*$")
_C_ALIAS = re.compile(r"(?:template\s*<[^>]*>\s*)?using\s+\w+\s*=|typedef\b")

_openers = {k: re.compile(v, re.S if k != "markdown" else 0) for k, v in _OPENERS.items()}
_closers = {k: {o: re.compile(c) for o, c in v.items()} for k, v in _SPANS.items()}
_definitions = {k: re.compile(v) for k, v in _DEFINITIONS.items()}
_underline = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_paragraph = re.compile(r"(?! {0,3}(?:#{1,6}(?:\s|$)|[-*+>|]|\d+[.)]|`{3}|~{3}))\s{0,3}\S")
_attached = {
    "python": re.compile(r"@|#"),
    "javascript": re.compile(r"@|//"),
    "java": re.compile(r"@(?!interface)|//"),
    "go": re.compile(r"//"),
    "rust": re.compile(r"#!?\[|//"),
    "c": re.compile(r"//|template\s*<|\[\[|__attribute__"),
    "other": re.compile(r"@|//|#"),
}


class Lexed(NamedTuple):
    """Lines that begin inside a construct, by whether it is a comment, and the state at the end."""

    comment: set[int]
    string: set[int]
    end: str


def language_of(path: str | None, language: str | None) -> str:
    """The lexical family of a file, by its suffix, else by its language."""
    suffix = (path or "").rpartition(".")[2].lower()
    if suffix in LANGUAGES:
        return LANGUAGES[suffix]
    named = (language or "").lower()
    return {"typescript": "javascript", "cpp": "c", "c++": "c"}.get(named, named if named in _DEFINITIONS or named == "c" else "other")


def states(language: str) -> list[str]:
    """The states a line may begin in: '' outside of everything, else the opener of what it lies in."""
    return ["", *_SPANS[language]]


def lex(text: str, language: str, state: str = "") -> Lexed:
    """Follow strings, comments and fences through a text that begins at a line's start in a state."""
    comment: set[int] = set()
    string: set[int] = set()
    opener, closers = _openers[language], _closers[language]
    at, line, opened = 0, 0, 0
    first = bool(state)
    while True:
        if not state:
            match = opener.search(text, at)
            if not match:
                return Lexed(comment, string, "")
            line += text.count("\n", at, match.end())
            at = match.end()
            token = match.group("open")
            if token:
                state = _normal(token, language)
                fence = token if language == "markdown" else ""
                if fence:  # the info string belongs to the opening line
                    stop = text.find("\n", at)
                    at = len(text) if stop < 0 else stop
                opened = line
            continue
        closer = closers[state]
        if language == "markdown" and not first and len(fence) > 3:
            closer = re.compile(rf"(?m)^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        match = closer.search(text, at)
        inside = comment if state == "/*" else string
        stop = match.end() if match else len(text)
        last = line + text.count("\n", at, stop)
        inside.update(range(opened + (not first), last + 1))
        if not match:
            return Lexed(comment, string, state)
        line, at, state, first = last, stop, "", False


def _normal(token: str, language: str) -> str:
    if language == "rust" and token.endswith('"') and token != '"':
        return token.removeprefix("b")
    if language == "markdown":
        return token[0] * 3
    return token


def boundaries(lines: list[str], language: str, lexed: Lexed) -> list[int]:
    """Indexes of the lines at which a cut is natural: definitions with what is attached above, or headings."""
    return sorted({b.top for b in boundary_pairs(lines, language, lexed) if not b.pending})


class Boundary(NamedTuple):
    """The first line of what is attached, the line of the definition or heading itself, and whether its brace is to come."""

    top: int
    at: int
    pending: bool = False


def boundary_pairs(lines: list[str], language: str, lexed: Lexed) -> list[Boundary]:
    """The boundaries of a text; pending ones count if the first brace or semicolon after the text opens a body."""
    found: list[Boundary] = []
    definition = _definitions.get(language)
    ends = _next_ends(lines) if language == "c" else []
    for i, line in enumerate(lines):
        if not line or i in lexed.string or i in lexed.comment:
            continue
        if language == "markdown" and i and _underline.match(line) and _paragraph.match(lines[i - 1]) and i - 1 not in lexed.string:
            found.append(Boundary(_run_top(lines, i, language, lexed), i))
            continue
        pending = False
        if language == "c":
            if line[0].isspace() or line[0] in "#}{/*":
                continue
            if _C_ALIAS.match(line):
                if "struct" not in line and "class" not in line and "using" not in line:
                    continue
            else:
                if not _C_TYPE.match(line):
                    pending = ends[i] == len(lines)
                    if not _c_function(lines, i, ends[i]):
                        continue
                if line.startswith("template") and line.rstrip().endswith(">"):
                    continue
        elif not definition.match(line):
            continue
        start = i
        if language != "markdown":
            start = _run_top(lines, i, language, lexed)
        found.append(Boundary(start, i, pending))
    return found


def _run_top(lines: list[str], end: int, language: str, lexed: Lexed) -> int:
    """The first of the lines directly before `end` that belong to what follows: comments and the like, or a paragraph."""
    top = end
    while top > 0:
        above = lines[top - 1]
        if top - 1 in lexed.string or not above.strip():
            break
        if language == "markdown":
            if not _paragraph.match(above):
                break
        else:
            in_comment = top - 1 in lexed.comment or above.lstrip().startswith("/*") and above.rstrip().endswith("*/") or above.startswith("/*")
            if not (in_comment and not _code_before(above) or _attached[language].match(above)):
                break
        top -= 1
    return top


def _code_before(line: str) -> bool:
    """Whether a line that ends or opens a block comment also holds code."""
    head, mark, tail = line.partition("*/")
    if mark and tail.strip():
        return True
    return "/*" in line and bool(line.partition("/*")[0].strip())


def _next_ends(lines: list[str]) -> list[int]:
    """For each line, the next one from it on with an opening brace or a semicolon; the number of lines if none has."""
    ends, at = [0] * len(lines), len(lines)
    for i in range(len(lines) - 1, -1, -1):
        if "{" in lines[i] or ";" in lines[i]:
            at = i
        ends[i] = at
    return ends


def _c_function(lines: list[str], i: int, end: int) -> bool:
    """Whether a function's body begins at the line: its arguments, then in line `end`, if it is there, a brace before any semicolon."""
    line = lines[i]
    if not _C_FUNCTION.match(line) or "=" in line[: line.find("(")]:
        return False
    if end == len(lines):
        return True
    return _opens(lines[end]) and not (end == i and "(" not in line.partition("{")[0])


def _opens(line: str) -> bool:
    """Whether a line has a brace before any semicolon."""
    body, brace, _ = line.partition("{")
    return bool(brace) and ";" not in body


def _ranges(rows: DataFrame, halo: int) -> DataFrame:
    """(.., start, own, last, slice): each row's text, as bytes, in ranges with halos; short texts are one range.

    rows have a number _row of their own. A range begins with the first line that begins in so many bytes, and ends where the next
    one begins, however far that is; start and own count bytes. A long text is cut in two steps, as each cut copies
    what it cuts from.
    """
    kept = [c for c in rows.columns if c != "_text"]
    raw = rows.withColumn("_raw", F.col("_text").cast("binary")).drop("_text").withColumn("_size", F.octet_length("_raw"))
    short = raw.filter(F.col("_size") <= RANGE).select(*kept, F.lit(0).alias("start"), F.col("_size").alias("own"), F.lit(True).alias("last"), F.col("_raw").alias("slice"))
    long = raw.filter(F.col("_size") > RANGE)
    block = CUT * RANGE

    def numbered(size, step: int):
        return F.explode(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")))

    def line_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the first line begins in each part, if one does before the text's end."""
        for batch in batches:
            at = []
            for part, size, own in zip(*(batch.column(c).to_pylist() for c in ("_part", "_size", "_own")), strict=True):
                newline = own.find(b"\n")
                first = 0 if part == 0 else None if newline < 0 else part * RANGE + newline + 1
                at.append(None if first is not None and first >= size else first)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_size"), pa.array(at, pa.int32())], ["_row", "_size", "at"])

    blocks = long.select("_row", "_size", "_raw", numbered(F.col("_size"), block).alias("_b"))
    blocks = blocks.select("_row", "_size", "_b", F.col("_raw").substr(F.col("_b") * block + 1, F.lit(block)).alias("_raw"))
    parts = blocks.select("_row", "_size", "_b", "_raw", numbered(F.octet_length("_raw"), RANGE).alias("_j"))
    parts = parts.select("_row", "_size", (F.col("_b") * CUT + F.col("_j")).alias("_part"), F.col("_raw").substr(F.col("_j") * RANGE + 1, F.lit(RANGE)).alias("_own"))
    starts = parts.mapInArrow(line_starts, "_row bigint, _size int, at int").filter("at IS NOT NULL")
    following = F.lead("at").over(W.partitionBy("_row").orderBy("at"))
    spans = starts.withColumn("_next", following).select("_row", "at", (F.coalesce("_next", "_size") - F.col("at")).alias("own"), F.col("_next").isNull().alias("last"))
    grouped = spans.groupBy("_row", F.floor(F.col("at") / block).cast("int").alias("_b")).agg(
        F.collect_list(F.struct("at", "own", "last")).alias("_spans"), F.max(F.col("at") + F.col("own")).alias("_to")  # at most CUT ranges
    )
    held = long.join(grouped, "_row").select(
        *kept, "_b", "_spans", F.col("_raw").substr(F.col("_b") * block + 1, F.col("_to") - F.col("_b") * block + halo).alias("_raw")
    )
    each = held.select(*kept, "_b", "_raw", F.explode("_spans").alias("_s"))
    slices = F.col("_raw").substr(F.col("_s.at") - F.col("_b") * block + 1, F.col("_s.own") + halo)
    return short.unionByName(each.select(*kept, F.col("_s.at").alias("start"), F.col("_s.own").alias("own"), F.col("_s.last").alias("last"), slices.alias("slice")))


def _decoded(raw: bytes, own: int) -> tuple[str, int]:
    """A range's text, and how many of its characters are its own; the halo may end within a character."""
    head = raw[:own].decode("utf-8", "replace")
    return head + raw[own:].decode("utf-8", "ignore"), len(head)


def _tables(followed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range: its lines, and for each state at its start the state at its end."""
        names = ("_path", "_language", "start", "own", "last", "slice")
        for batch in batches:
            counts, tables = [], []
            for path, language, start, size, last, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                family = language_of(path, language)
                own = text[:size].decode("utf-8", "replace")
                counts.append(own.count("\n"))
                known = states(family)
                if last and not start and not followed:
                    tables.append([0] * len(known))  # nothing asks for it
                else:
                    tables.append([known.index(lex(own, family, s).end) for s in known])
            columns = [batch.column(c) for c in ("_row", "_key", "_path", "_first", "start")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(tables, pa.list_(pa.int32()))], ["_row", "_key", "_path", "_first", "start", "lines", "table"]
            )

    return run


def _compose(tables: list[list[int]]) -> list[int]:
    whole = list(range(len(tables[0])))
    for table in tables:
        whole = [table[s] if s < len(table) else 0 for s in whole]
    return whole


def _first_states(tables: DataFrame) -> DataFrame:
    """(_key, _path, _first, start, state): each range's state at its start, by composing tables along the file."""
    order = W.partitionBy("_path").orderBy("_first", "_key", "start")
    numbered = tables.select("_path", "_first", "_key", "start", "table").withColumn("_n", F.row_number().over(order) - 1)
    blocked = numbered.withColumn("_block", F.floor(F.col("_n") / BLOCK)).drop("_n")

    def whole_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_first", "_key", "start"])
        return pd.DataFrame({"_path": group["_path"][:1], "_block": group["_block"][:1], "table": [_compose([list(t) for t in group["table"]])]})

    def along_blocks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        state, begin = 0, []
        for table in group["table"]:
            begin.append(state)
            state = list(table)[state]
        return pd.DataFrame({"_path": group["_path"], "_block": group["_block"], "begin": begin})

    def along_ranges(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_first", "_key", "start"])
        state, begin = int(group["begin"].iloc[0]), []
        for table in group["table"]:
            begin.append(state)
            state = list(table)[state]
        return pd.DataFrame({"_key": group["_key"], "_path": group["_path"], "_first": group["_first"], "start": group["start"], "state": begin})

    blocks = blocked.groupBy("_path", "_block").applyInPandas(whole_block, "_path string, _block bigint, table array<int>")
    begins = blocks.groupBy("_path").applyInPandas(along_blocks, "_path string, _block bigint, begin int")
    return (
        blocked.join(begins, ["_path", "_block"])
        .groupBy("_path", "_block")
        .applyInPandas(along_ranges, "_key string, _path string, _first int, start int, state int")
    )


#: What a range tells of a line: a boundary, one that begins in the ranges before, a heading if a paragraph ends there,
#: where the lines begin that belong to the next range's first (null: before this range), or whether its first brace
#: or semicolon opens a body (line 1) or not (line 0).
SURE, OPEN, UNDERLINE, RUN, ENDS = range(5)
_TOLD = "_row bigint, _key string, _first int, start int, kind int, line_no int, pending boolean, name string"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundaries of each range, as line numbers of the file, given its first state and first line."""
    names = ("_path", "_language", "_first", "start", "own", "last", "slice", "state", "before")
    for batch in batches:
        rows, told = [], []
        for n, (path, language, first, start, size, last, text, state, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
            family = language_of(path, language)
            text, size = _decoded(text, size)
            lexed = lex(text, family, states(family)[state])
            lines = text.split("\n")
            own = text.count("\n", 0, size) + (1 if last else 0)
            low, line, held = start > 0, first + before, len(told)
            for b in boundary_pairs(lines, family, lexed):
                if b.at < own and not (last and b.pending):
                    kind = OPEN if low and b.top == 0 and (b.at or family != "markdown") else SURE
                    told.append((kind, line + b.top, b.pending, symbol_of(lines, b, family)))
            if low and own and family == "markdown" and 0 not in lexed.string and _underline.match(lines[0]):
                told.append((UNDERLINE, line, False, None))
            if not last:
                top = _run_top(lines, own, family, lexed)
                told.append((RUN, None if low and top == 0 else line + top, False, None))
            if low and family == "c" and (end := next((x for x in lines[:own] if "{" in x or ";" in x), None)) is not None:
                told.append((ENDS, int(_opens(end)), False, None))
            rows.extend([n] * (len(told) - held))
        keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("_row", "_key", "_first", "start")]
        types = (pa.int32(), pa.int32(), pa.bool_(), pa.string())
        columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*keys, *columns], ["_row", "_key", "_first", "start", "kind", "line_no", "pending", "name"])


def _resolved(told: DataFrame) -> DataFrame:
    """(_row, _key, line_no, name): boundaries, of which those that begin or end in other ranges are followed through these."""
    whole = W.partitionBy("_row")
    before, after = (whole.orderBy(o).rangeBetween(W.unboundedPreceding, -1) for o in (F.col("start"), F.col("start").desc()))
    above = told.withColumns(
        {
            "_above": F.last(F.when(F.col("kind") == RUN, F.col("line_no")), ignorenulls=True).over(before),
            "_opens": F.last(F.when(F.col("kind") == ENDS, F.col("line_no")), ignorenulls=True).over(after),
        }
    )
    kept = above.filter((F.col("kind") <= OPEN) | (F.col("kind") == UNDERLINE) & (F.col("_above") < F.col("line_no")))
    kept = kept.filter(~F.col("pending") | (F.col("_opens") == 1))
    line = F.when(F.col("kind") == SURE, F.col("line_no")).otherwise(F.col("_above"))
    return kept.withColumn("line_no", line).filter("line_no > _first").groupBy("_row", "_key", "line_no").agg(F.min("name").alias("name"))


def _source(chunks: DataFrame) -> DataFrame:
    """(_key, _path, _language, _symbol, _first, _text) of the rows with an id and a text."""
    return chunks.filter("node_id IS NOT NULL AND chunk_text IS NOT NULL").select(
        F.col("node_id").cast("string").alias("_key"),
        F.col("file_path").cast("string").alias("_path"),
        F.col("language").cast("string").alias("_language"),
        F.col("symbol").cast("string").alias("_symbol"),
        F.coalesce("start_line", F.lit(1)).cast("int").alias("_first"),
        F.col("chunk_text").cast("string").alias("_text"),
    )


def _oversized(chunks: DataFrame, limit: int) -> DataFrame:
    """The rows longer than limit, each once, with a number _row that follows from id, path, line and text."""
    big = _source(chunks).filter(F.length("_text") > limit)
    once = big.groupBy("_key", "_path", "_first", "_text").agg(F.min("_language").alias("_language"), F.min("_symbol").alias("_symbol"))
    return write_table(once.withColumn("_row", F.xxhash64("_key", "_path", "_first", "_text")), "oversized")


def natural_lines(chunks: DataFrame, limit: int = 8000) -> DataFrame:
    """(_key, line_no): for each chunk longer than limit, the file's lines at which a cut is natural.

    A chunk's own first line is none. Chunks without text, id or path give none; a null start_line is 1;
    repeated rows count once; where rows of one file overlap, the earlier decides the state at the next.
    Lines, comments and signatures may be of any length. Extra columns are not read.
    """
    return _boundaries(chunks, _oversized(chunks, limit)).select("_key", "line_no").distinct()


def _boundaries(chunks: DataFrame, oversized: DataFrame) -> DataFrame:
    """(_row, _key, line_no, name) of the natural lines of oversized rows."""
    rows, big = _source(chunks).drop("_symbol").filter("_path IS NOT NULL"), oversized.drop("_symbol").filter("_path IS NOT NULL")
    inner = big.filter("_first > 1").groupBy("_path").agg(F.max("_first").alias("_upto"))
    narrow = rows.select("_key", "_path", "_first", F.length("_text").alias("_size"))
    before = write_table(join_checked(narrow, inner, "_path").filter("_first < _upto"), "before")
    # of rows that begin at one line the longest is followed, the others repeat its start
    longest = before.groupBy("_path", "_first").agg(F.max(F.struct("_size", "_key")).alias("_m"))
    starts = longest.select("_path", "_first", F.col("_m._key").alias("_key"))
    upto = starts.select("_path", "_first").union(inner.select("_path", F.col("_upto").alias("_first"))).distinct()
    following = upto.withColumn("_next", F.lead("_first").over(W.partitionBy("_path").orderBy("_first")))
    led = starts.join(following, ["_path", "_first"]).withColumn("_limit", (F.col("_next") - F.col("_first")).cast("int"))
    held = join_checked(rows, led.select("_key", "_path", "_first", "_limit"), ["_key", "_path", "_first"])
    # without what the next row of the file holds again
    ahead = F.expr(r"concat(substring_index(_text, '\n', _limit), '\n')")
    once = held.dropDuplicates(["_key", "_path", "_first"]).withColumn("_text", ahead).drop("_limit")
    leading = write_table(once.withColumn("_row", F.xxhash64("_key", "_path", "_first")), "leading")
    shape = "_row bigint, _key string, _path string, _first int, start int, lines bigint, table array<int>"
    carried = _ranges(leading, HALO).mapInArrow(_tables(True), shape)
    own = _ranges(big, HALO)
    counted = write_table(own.mapInArrow(_tables(False), shape), "range-tables")
    # the state at a row's first line, from the rows before it in its file
    firsts = _row_states(carried, big.filter("_first > 1").select("_key", "_path", "_first").distinct())
    within = _range_states(counted, firsts)
    placed = _placed(counted).select("_row", "start", "before").join(within, ["_row", "start"])
    return _resolved(own.join(placed, ["_row", "start"]).mapInArrow(_emit, _TOLD))


def _placed(counted: DataFrame) -> DataFrame:
    """Ranges with the number of lines before them."""
    order = W.partitionBy("_row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("lines").over(order), F.lit(0)).cast("int"))


def _row_states(carried: DataFrame, rows: DataFrame) -> DataFrame:
    """(_key, _path, _first, begin): the state at the first line of rows that begin inside a file."""
    ends = carried.select("_path", "_first", "_key", "start", "table")
    # an asked row's own table is the identity, long enough for any language
    identity = F.sequence(F.lit(0), F.lit(max(len(s) for s in _SPANS.values())))
    asked = rows.select("_path", "_first", "_key", F.lit(-1).alias("start"), identity.alias("table"))
    states_at = _first_states(ends.unionByName(asked))
    return states_at.filter("start = -1").select("_key", "_path", "_first", F.col("state").alias("begin"))


def _range_states(counted: DataFrame, firsts: DataFrame) -> DataFrame:
    """(_row, start, state): the state at each range's start, given the row's."""

    def along(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        state, begin = int(group["begin"].iloc[0]), []
        for table in group["table"]:
            begin.append(state)
            table = list(table)
            state = table[state] if state < len(table) else 0
        return pd.DataFrame({"_row": group["_row"], "start": group["start"], "state": begin})

    given = counted.join(firsts, ["_key", "_path", "_first"], "left").na.fill(0, ["begin"])
    several = counted.filter("start > 0").select("_row").distinct()
    single = given.join(several, "_row", "left_anti").select("_row", "start", F.col("begin").alias("state"))
    multiple = given.join(several, "_row", "left_semi")
    # the ranges of one text: at most its 2 GB divided by RANGE
    return single.unionByName(multiple.groupBy("_row").applyInPandas(along, "_row bigint, start int, state int"))


_symbol_names = {
    "python": re.compile(r"(?:async\s+def|def|class)\s+(\w+)|(\w+)\s*(?::[^=]+)?=\s*lambda"),
    "go": re.compile(r"func\s+(?:\([^)]*\)\s*)?(\w+)|type\s+(\w+)"),
    "markdown": re.compile(r"\s*#{1,6}\s+(.*?)\s*#*$"),
    "c": re.compile(r".*?(?:class|struct|union|enum)\s+(\w+)|[^(]*?([\w:~]+)\s*\("),
}
_any_symbol = re.compile(r".*?\b(?:function\*?|class|interface|type|enum|struct|trait|fn|impl(?:<[^>]*>)?|record|const|let|var)\s+([\w$]+)")


def symbol_of(lines: list[str], boundary: Boundary, language: str) -> str | None:
    """The name that a boundary's definition binds, or a heading's text."""
    if language == "markdown" and boundary.at > boundary.top:
        return " ".join(x.strip() for x in lines[boundary.top : boundary.at])
    match = _symbol_names.get(language, _any_symbol).match(lines[boundary.at])
    return next((g for g in match.groups() if g), None) if match else None


class Piece(NamedTuple):
    """A piece's first and last line, counted from 0, its offset and length in characters, and its symbol."""

    start: int
    end: int
    at: int
    size: int
    symbol: str | None


class Planner:
    """Plans the pieces of one text from its lines' lengths and cuts, which come in order; it keeps the lines of a piece.

    Each piece has at most limit characters and, but for the first, begins with up to `overlap` lines of the one
    before; it is cut before a line of `cuts` where one is in reach, else before the last line that fits. A line longer than the
    limit is cut by characters.
    """

    def __init__(self, limit: int, overlap: int) -> None:
        self.limit, self.overlap = limit, overlap
        self.lengths: list[int] = []
        self.base, self.offset = 0, 0  # the line that lengths begins with, and where it begins
        self.start = self.fresh = 0  # lines [start, fresh) are overlap
        self.cuts: dict[int, str | None] = {}
        self.symbol: str | None = None  # of the last cut that was passed

    def add_lines(self, lengths: list[int]) -> None:
        self.lengths.extend(lengths)

    def add_cut(self, line: int, symbol: str | None) -> None:
        self.cuts[line] = symbol

    def _length(self, line: int) -> int:
        return self.lengths[line - self.base]

    def _drop(self) -> None:
        """Forget lines and cuts before the next piece."""
        gone = self.start - self.base
        self.offset += sum(self.lengths[:gone]) + gone
        self.lengths = self.lengths[gone:]
        self.base = self.start
        for line in sorted(c for c in self.cuts if c <= self.start):
            symbol = self.cuts[line] if line == self.start else self.cuts.pop(line)
            self.symbol = symbol or self.symbol

    def _named(self, own: int, end: int) -> str | None:
        """The symbol of a piece's first own definition, else of the last one before it."""
        lines = sorted(c for c in self.cuts if c < end and self.cuts[c])
        before = next((self.cuts[c] for c in reversed(lines) if c < own), self.symbol)
        return next((self.cuts[c] for c in lines if c >= own), before)

    def plan(self, known: int | None = None) -> Iterator[Piece]:
        """The pieces that are settled by the lines before `known`, whose cuts were added; None: all lines are there."""
        n = self.base + len(self.lengths) if known is None else known
        while self.fresh < n:
            size = sum(self._length(i) + 1 for i in range(self.start, self.fresh)) - 1
            start = self.start
            while start < self.fresh and size + 1 + self._length(self.fresh) > self.limit:
                size -= self._length(start) + 1
                start += 1
            if self._length(self.fresh) > self.limit:
                self.start = start = self.fresh
                self._drop()
                length, name = self._length(start), self._named(start, start + 1)
                for i in range(0, length, self.limit):
                    yield Piece(start, start, self.offset + i, min(self.limit, length - i), name)
                self.start = self.fresh = start + 1
                self._drop()
                continue
            end, natural = self.fresh, 0
            while end < n and size + 1 + self._length(end) <= self.limit:
                size += self._length(end) + 1
                end += 1
                if end in self.cuts and end > self.fresh:
                    natural = end
            if end == n and known is not None:
                return
            if end < n and natural:
                end = natural
            self.start = start
            self._drop()
            taken = sum(self._length(i) + 1 for i in range(start, end)) - 1
            yield Piece(start, end - 1, self.offset, taken, self._named(self.fresh, end))
            self.fresh, self.start = end, min(end, max(end - self.overlap, start + 1))
            self._drop()


def _line_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, start, lengths) of each range: the lengths of the lines that begin in it."""
    for batch in batches:
        lengths = []
        for size, last, text in zip(*(batch.column(c).to_pylist() for c in ("own", "last", "slice")), strict=True):
            own = [len(x) for x in text[:size].decode("utf-8", "replace").split("\n")]
            lengths.append(own if last else own[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("start"), pa.array(lengths, pa.list_(pa.int32()))], ["_row", "start", "lengths"])


def _planned(limit: int, overlap: int):
    names = ["_row", "start", "piece", "first", "end", "at", "size", "name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the texts whose ranges and cuts come sorted by text and line, a range before its cuts."""
        row, planner, number, known = None, Planner(limit, overlap), 0, 0
        starts, bytes_at, offset = [], [], 0  # of the ranges: in characters and in bytes; and the next one's
        out: list[tuple] = []

        def settle(upto: int | None) -> None:
            nonlocal number
            for p in planner.plan(upto):
                at = bisect.bisect_right(starts, p.at) - 1
                out.append((row, bytes_at[at], number, p.start, p.end, p.at - starts[at], p.size, p.symbol))
                number += 1
            gone = max(0, bisect.bisect_right(starts, planner.offset) - 1)
            del starts[:gone], bytes_at[:gone]

        for batch in batches:
            for r, line, start, lengths, name in zip(*(batch.column(c).to_pylist() for c in ("_row", "line", "start", "lengths", "name")), strict=True):
                if r != row:
                    settle(None)
                    row, planner, number, known, offset = r, Planner(limit, overlap), 0, 0, 0
                    starts.clear()
                    bytes_at.clear()
                if lengths is None:
                    planner.add_cut(line, name)
                    continue
                settle(known)
                starts.append(offset)
                bytes_at.append(start)
                offset += sum(lengths) + len(lengths)
                planner.add_lines(lengths)
                known += len(lengths)
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], _PLAN)
            out.clear()
        settle(None)
        yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], _PLAN)

    return run


_PLAN = pa.schema(
    [("_row", pa.int64()), ("start", pa.int32()), *[(c, pa.int32()) for c in ("piece", "first", "end", "at", "size")], ("name", pa.string())]
)


def pieces(chunks: DataFrame, limit: int = 8000, overlap: int = 10) -> DataFrame:
    """(node_id, piece, start_line, end_line, symbol, chunk_text) of each chunk longer than limit.

    Pieces have at most limit characters, begin with up to 10 lines of the piece before, and are cut before natural
    boundaries where one is in reach. symbol is that of the piece's first own definition, else of the last one
    before it, else the chunk's own. Rows without text or id give none; those without a path are cut between lines;
    repeated rows count once. Plans need the lengths of the lines only; texts are taken from the ranges by offset.
    """
    big = _oversized(chunks, limit)
    cuts = _boundaries(chunks, big).join(big.select("_row", "_first"), "_row").select("_row", (F.col("line_no") - F.col("_first")).alias("line"), "name")
    ranges = _ranges(big.select("_row", "_text"), max(HALO, 4 * limit))  # a piece's bytes
    lengths = write_table(ranges.mapInArrow(_line_lengths, "_row bigint, start int, lengths array<int>"), "line-lengths")
    placed = _placed(lengths.withColumn("lines", F.size("lengths"))).select("_row", F.col("before").alias("line"), "start", "lengths", F.lit(None).cast("string").alias("name"))
    both = placed.unionByName(cuts.select("_row", "line", F.lit(None).cast("int").alias("start"), F.lit(None).cast("array<int>").alias("lengths"), "name"))
    ordered = both.repartition("_row").sortWithinPartitions("_row", "line", F.col("lengths").isNull())
    plan = ordered.mapInArrow(_planned(limit, overlap), "_row bigint, start int, piece int, first int, end int, at int, size int, name string")
    text = F.col("slice").cast("string").substr(F.col("at") + 1, F.col("size"))
    return (
        plan.join(ranges.select("_row", "start", "slice"), ["_row", "start"])
        .join(big.select("_row", "_key", "_first", "_symbol"), "_row")
        .select(
            F.col("_key").alias("node_id"),
            "piece",
            (F.col("_first") + F.col("first")).alias("start_line"),
            (F.col("_first") + F.col("end")).alias("end_line"),
            F.coalesce("name", "_symbol").alias("symbol"),
            text.alias("chunk_text"),
        )
    )
