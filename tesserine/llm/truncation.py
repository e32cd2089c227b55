"""Texts cut off before their end: by a field's length limit, or in mid-transfer.

Field limits show as spikes in a source's histogram of lengths, in characters or in bytes. A value at a
spike length is cut unless it ends as a text does: with terminal punctuation, a closed fence, or a word that
ends lines elsewhere. Away from spikes only stronger signs count: an open fence or code span, half a character,
an ellipsis in mid-sentence or after part of a word, a last word the collection never ends a line or sentence with.
How words end lines is counted over all documents, separately for prose and for lines such as items and titles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.functions.sizes import join_checked
from tesserine.session import write_table

#: Lengths to either side whose mean count a spike is tested against.
NEIGHBOURS = 25
#: A spike's count is at least this, and its Poisson tail below exp(-SURPRISE).
LEAST_COUNT, SURPRISE = 5, 16.0
#: Below this share of its occurrences at a line's (in prose also a sentence's) end, a last word marks a cut.
LINE_SHARE, PROSE_SHARE, LINE_SHARE_AT_LIMIT = 0.08, 0.5, 0.15

#: A last word that ends this share of all texts without punctuation is a custom, as of chats.
CUSTOM_SHARE = 0.005
#: Units that end in a marker are a custom from this share and count on, away from limits and at them, unless they begin longer words.
USUAL, ENOUGH = (0.5, 0.9), (3, 20)
#: Words whose reading a worker keeps; beyond it the memory is emptied, which changes no result.
MEMORY = 400_000
#: Stands for all pools, or all units.
ALL = "\x02"

# What shows a shortened text, and what ends a sentence.
MARKERS = ("…", "...", "[...]", "[…]", "(more)", "(truncated)", "[truncated]")
TERMINAL = ".!?。！？"

_COUNTS = ("n", "lines", "sentences", "markers", "finals")
_item = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s")
_heading = re.compile(r"\s*#{1,6}\s")
_trace = re.compile(r'\s*(?:at [\w$.<>]+|File "|Error in |Caused by)')
_reference = re.compile(r"\s*(?:--\s|[A-Z][\w-]*(?: \w+)?: \S+$)")
_cjk = re.compile("[぀-ヿ㐀-鿿가-힯]")
_digits = re.compile(r"\d+")
_inner = re.compile(r"\w", re.U)
_marker = re.compile(r"\s*(?:%s)$" % "|".join(map(re.escape, sorted(MARKERS, key=len, reverse=True))))


def _pool(line: str, single: bool) -> str:
    """Which lines a line is compared with."""
    if single or _item.match(line) or _heading.match(line) or _trace.match(line) or _reference.match(line):
        return "line"
    return "prose"


_read: dict[str, tuple[str, str, str | None]] = {}


def _reading(word: str) -> tuple[str, str, str | None]:
    """How a word ends (inside a line, at its end), and its form, or None where it is Chinese or Japanese."""
    known = _read.get(word)
    if known is None:
        body = word.rstrip(",;:!?.。！？，；：、…\"'“”»)]}")
        tail = word[len(body):]
        if "…" in tail or "..." in tail:
            ends = ("m", "m")
        elif any(c in TERMINAL for c in tail):
            ends = ("s", "s")
        else:
            ends = ("", "" if tail.strip("\"'“”»)]}") else "l")
        form = None if _cjk.search(body) else _digits.sub("9", body.lower()).strip("\"'“”»([{*_")
        if len(_read) > MEMORY:
            _read.clear()
        known = _read[word] = (*ends, form)
    return known


def _cjk_units(word: str, end: str) -> Iterator[tuple[str, str]]:
    """Pieces of two and three characters of a word without spaces, each with how it ends."""
    parts = re.split("[，；：、。！？]", word.rstrip(",;:!?.。！？，；：、…\"'“”»)]}"))
    for number, part in enumerate(parts):
        closing = end if number == len(parts) - 1 else "s"
        for size in (2, 3):
            for i in range(len(part) - size + 1):
                yield part[i : i + size], closing if i + size == len(part) else ""


def _units_of(word: str, end: str, form: str | None, before: str) -> Iterator[tuple[str, str]]:
    """A word's countable units, each with how it ends; numbers stand with the word before them."""
    if form is None:
        yield from _cjk_units(word, end)
    elif form:
        unit = f"{before} 9" if form == "9" else form
        yield unit, end
        yield f"{before}\t{unit}", end


def _kept(word: str, form: str | None, before: str) -> str:
    """What stands before the next word's units."""
    return word.rstrip(",;:!?.。！？，；：、…\"'“”»)]}")[-1:] if form is None else form or before


def _units(line: str) -> Iterator[tuple[str, str]]:
    """The countable units of a line, each with how it ends: '' inside, 's' sentence, 'l' line, 'm' marker.

    A unit counts alone and with the one before.
    """
    words = line.split()
    before = ""
    for at, word in enumerate(words):
        inner, final, form = _reading(word)
        yield from _units_of(word, final if at == len(words) - 1 else inner, form, before)
        before = _kept(word, form, before)


def _outside(lines: list[str]) -> tuple[list[str], bool]:
    """The lines outside code fences, and whether a fence is still open."""
    outside, fence = [], False
    for line in lines:
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and line.strip():
            outside.append(line)
    return outside, fence


class Ends:
    """Counts of units by pool: how often each occurs, and how often it ends a line, a sentence, a marker or a text."""

    def __init__(self) -> None:
        self.n = {pool: Counter() for pool in ("line", "prose", ALL)}
        self.ends = {(pool, end): Counter() for pool in self.n for end in "lsm"}
        self.finals: Counter = Counter()

    def add(self, text: str) -> None:
        """Add a text's units. Those that end the text itself count apart, as they are what is judged; references count whole."""
        lines = text.rstrip().split("\n")
        outside, _ = _outside(lines)
        for at, line in enumerate(outside):
            if _reference.match(line):
                self.n["line"].update((_shape(line), f"\x01{line.split()[0].lower()}"))
            pool = _pool(line, len(lines) == 1)
            last = at == len(outside) - 1 and line is lines[-1]
            words = line.split()
            inside: list[str] = []
            before = ""
            for word in words[:-1]:  # as _units, without its steps for each unit
                end, _, form = _reading(word)
                if form is None or end:
                    for unit, closing in _units_of(word, end, form, before):
                        inside.append(unit)
                        if closing:
                            self.ends[pool, closing][unit] += 1
                elif form:
                    unit = f"{before} 9" if form == "9" else form
                    inside += (unit, f"{before}\t{unit}")
                before = _kept(word, form, before)
            _, end, form = _reading(words[-1])
            for unit, closing in _units_of(words[-1], end, form, before):
                if last and closing == "l":
                    if "\t" not in unit:
                        self.finals.update((unit, ALL))
                    continue
                inside.append(unit)
                if closing:
                    self.ends[pool, closing][unit] += 1
            self.n[pool].update(inside)

    def rows(self) -> Iterator[tuple]:
        """(pool, unit, n, lines, sentences, markers, finals)."""
        for pool, counts in self.n.items():
            ends = [self.ends[pool, e] for e in "lsm"]
            for unit, n in counts.items():
                yield (pool, unit, n, *(e[unit] if unit in e else 0 for e in ends), 0)
        for unit, n in self.finals.items():
            yield ALL, unit, 0, 0, 0, 0, n


def ending(text: str) -> tuple[str, str, str, str]:
    """(verdict, pool, unit, other) of a text's end; verdict: 'whole', 'cut', or what counts decide.

    'word': by the last word (of Chinese or Japanese three characters, or two where those are rare; of single lines also as prose);
    'marker': by the last two words before an ellipsis, or the last one; 'form': by a reference's form.
    """
    stripped = text.rstrip()
    if not stripped:
        return "whole", "", "", ""
    if stripped.endswith("�"):
        return "cut", "", "", ""
    lines = stripped.split("\n")
    _, fence = _outside(lines)
    last = lines[-1]
    if last.lstrip().startswith(("```", "~~~")):
        return ("cut" if fence else "whole"), "", "", ""
    if fence:
        return "cut", "", "", ""
    pool = _pool(last, len(lines) == 1)
    if match := _marker.search(last):
        body = last[: match.start()]
        if body.count("`") % 2 or match.group().strip() not in ("…", "..."):
            return "cut", "", "", ""
        units = [u for u, _ in _units(body + "...")]
        return "marker", pool, units[-1] if units else "", units[-2] if len(units) > 1 else ""
    if last.count("`") % 2:
        return "cut", "", "", ""
    end = last[-1]
    if end in TERMINAL or end in "\"'”»>|*":
        return "whole", "", "", ""
    if _trace.match(last):
        return ("whole" if end == ")" else "cut"), "", "", ""
    if end in ")]}`" and (end == "`" or {")": "(", "]": "[", "}": "{"}[end] in last or re.search(r"[:;]-?\)$", last)):
        return "whole", "", "", ""
    if not _inner.search(last.split()[-1]):
        return ("whole" if ord(end) > 0x2000 else "cut"), "", "", ""
    if _reference.match(last):
        return "form", "line", _shape(last), "\x01" + last.split()[0].lower()
    body = last.split()[-1]
    if _cjk.search(body[-1]):
        return "word", pool, body[-3:], body[-2:]
    if _cjk.search(body):
        return "cut", "", "", ""
    units = [u for u, _ in _units(last) if "\t" not in u]
    unit = units[-1] if units else ""
    return "word", pool, unit, unit if len(lines) == 1 else ""


def _shape(line: str) -> str:
    """A reference's form: words alike but for a signature's; hexadecimal strings keep their length."""
    line = line.strip().lower()
    if line.startswith("--"):
        return "\x01" + line
    return "\x01" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\b[0-9a-f]{6,}\b", lambda m: f"{len(m.group())}", line))


def end_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(pool, unit, n, lines, sentences, markers, finals): how often each unit occurs and ends something, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pool", "unit", *_COUNTS]
        for batch in batches:
            counts = Ends()
            for t in batch.column(0).to_pylist():
                if t:
                    counts.add(t)
            rows = list(counts.rows())
            types = [pa.string(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names)

    partial = documents.select(F.col(text).cast("string")).mapInArrow(
        count, "pool string, unit string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    )
    return partial.groupBy("pool", "unit").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def endings(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, chars, bytes, content, verdict, pool, unit, other) of each row with a text."""
    rows = documents.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ending(t) for t in batch.column(4).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(5), *columns],
                ["_key", "_source", "chars", "bytes", "content", "verdict", "pool", "unit", "other"],
            )

    key_type = dict(rows.dtypes)["_key"]
    return (
        rows.filter("_text IS NOT NULL")
        .select("_key", "_source", F.length("_text").alias("chars"), F.octet_length("_text").alias("bytes"), "_text", F.xxhash64("_text").alias("content"))
        .mapInArrow(
            look,
            f"_key {key_type}, _source string, chars int, bytes int, content bigint, verdict string, pool string, unit string, other string",
        )
    )


def length_spikes(rows: DataFrame, length: str) -> DataFrame:
    """(_source, length, expected): lengths that far more different texts of a source have than their neighbours.

    A spike's count is tested against the mean of the lengths around it; texts under several keys count once.
    """
    histogram = rows.select("_source", length, "content").distinct().groupBy("_source", length).agg(F.count("*").alias("_n"))
    near = W.partitionBy("_source").orderBy(F.col(length).cast("long")).rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    expected = (F.sum("_n").over(near) - F.col("_n")) / (2 * NEIGHBOURS) + 0.02
    n = F.col("_n")
    surprise = n * F.log(n / F.col("expected")) - n + F.col("expected")
    return (
        histogram.withColumn("expected", expected)
        .filter((n >= LEAST_COUNT) & (n > F.col("expected")) & (surprise > SURPRISE))
        .select("_source", length, "expected")
    )


def word_parts(counts: DataFrame) -> DataFrame:
    """(unit): units that mostly end in a marker, of which longer words with the same beginning occur at least as often.

    A cut leaves parts of words before its marker, and in larger collections each part often enough to look like a custom.
    """
    units = counts.filter((F.col("pool") != ALL) & (F.col("n") > 0))
    marked = write_table(units.filter((F.col("n") >= ENOUGH[0]) & (F.col("markers") >= USUAL[0] * F.col("n"))).select("unit").distinct(), "marked-units")
    lengths = [r[0] for r in marked.select(F.length("unit")).distinct().collect()]
    if not lengths:
        return marked
    size = F.length("unit")
    starts = F.filter(F.lit(lengths), lambda at: (at <= size) & (at > F.instr("unit", "\t")))  # a pair's first word stays whole
    begun = units.select("unit", "n", F.explode(starts).alias("_at")).select(
        F.col("unit").substr(F.lit(1), F.col("_at")).alias("unit"),
        F.when(F.col("_at") == size, F.col("n")).otherwise(0).alias("_own"),
        F.when(F.col("_at") < size, F.col("n")).otherwise(0).alias("_longer"),
    )
    return join_checked(begun, marked, "unit").groupBy("unit").agg(F.sum("_own").alias("_own"), F.sum("_longer").alias("_longer")).filter("_longer >= _own").select("unit")


def truncated(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(_key, _source, at_limit, cut) of each row with a text: whether it was cut, and if its length is a limit.

    Null texts give no row; empty and blank ones are whole; a null source is a source of its own; rows are
    not merged, whatever repeats. Whole texts are read. Extra columns are not read.
    """
    ends = write_table(endings(documents, key, text, source), "endings")
    by_chars = length_spikes(ends, "chars").select(F.col("_source").alias("_s1"), F.col("chars").alias("_c1"))
    by_bytes = length_spikes(ends, "bytes").select(F.col("_source").alias("_s2"), F.col("bytes").alias("_c2"))
    marked = (
        ends.join(by_chars, F.col("_source").eqNullSafe(F.col("_s1")) & (F.col("chars") == F.col("_c1")), "left")
        .join(by_bytes, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("bytes") == F.col("_c2")), "left")
        .withColumn("at_limit", F.col("_c1").isNotNull() | F.col("_c2").isNotNull())
    )
    asked = F.col("verdict").isin("word", "marker", "form")
    open_ends, settled = marked.filter(asked), marked.filter(~asked)
    counts = write_table(end_counts(documents, text), "end-counts")
    others = counts.select(F.col("pool").alias("pool_2"), F.col("unit").alias("other"), *[F.col(c).alias(f"{c}_2") for c in _COUNTS])
    bare = counts.filter((F.col("pool") == ALL) & (F.col("unit") == ALL)).first()
    often = F.greatest(F.lit(2.0), F.lit(CUSTOM_SHARE * (bare["finals"] if bare else 0)))
    # at most 1 / CUSTOM_SHARE words
    customs = counts.filter((F.col("pool") == ALL) & (F.col("unit") != ALL) & (F.length("unit") > 1) & (F.col("finals") >= often))
    parts = write_table(word_parts(counts), "word-parts")
    judged = (
        open_ends.withColumn("pool_2", F.when(F.col("unit") == F.col("other"), "prose").otherwise(F.col("pool")))
        .join(counts, ["pool", "unit"], "left")
        .join(others, ["pool_2", "other"], "left")
        .join(F.broadcast(customs.select("unit", F.col("finals").alias("customary"))), "unit", "left")
        .na.fill(0, [*_COUNTS, *(f"{c}_2" for c in _COUNTS), "customary"])
    )
    for name in ("unit", "other"):
        judged = join_checked(judged, parts.select(F.col("unit").alias(name), F.lit(True).alias(f"part_{name}")), name, "left")

    def enough_ends(s: str):
        prose = F.col(f"pool{s}") == "prose"
        ends = F.col(f"lines{s}") + F.when(prose, F.col(f"sentences{s}")).otherwise(0)
        least = F.when(prose, PROSE_SHARE).when(F.col("at_limit"), LINE_SHARE_AT_LIMIT).otherwise(LINE_SHARE)
        return (F.col(f"n{s}") > 0) & (ends >= least * F.col(f"n{s}"))

    inner = F.col("n") - F.col("lines") - F.col("sentences")
    custom = ~F.col("at_limit") & (F.col("customary") > 0) & (F.col("customary") > 0.1 * inner)
    word = F.when(F.col("n") >= 8, enough_ends("")).otherwise(enough_ends("") | enough_ends("_2")) | custom
    usual, enough = (F.when(F.col("at_limit"), x[1]).otherwise(x[0]) for x in (USUAL, ENOUGH))

    def customary(end: str, n: str, part: str):
        return (F.col(n) >= enough) & (F.col(end) >= usual * F.col(n)) & F.col(part).isNull()

    cut = (
        F.when(F.col("verdict") == "marker", ~(customary("markers", "n", "part_unit") | customary("markers_2", "n_2", "part_other")))
        .when(F.col("verdict") == "form", F.col("n") < 0.05 * F.col("n_2"))
        .otherwise(~word)
    )
    return judged.select("_key", "_source", "at_limit", cut.alias("cut")).unionByName(
        settled.select("_key", "_source", "at_limit", (F.col("verdict") == "cut").alias("cut"))
    )


def cut_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, texts, cut, share): how many of each source's texts were cut."""
    rows = truncated(documents, key, text, source)
    return rows.groupBy(F.col("_source").alias("source")).agg(
        F.count("*").alias("texts"),
        F.count_if("cut").alias("cut"),
        F.round(F.avg(F.col("cut").cast("int")), 6).alias("share"),
    )
