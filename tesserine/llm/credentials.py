"""Credentials written into source code: where their values begin, and the text with only the values replaced.

A keyword automaton finds the lines worth reading; issuer formats, key names and the places where passwords
stand give candidate values; their structure decides (an issuer's length and alphabet and, where it publishes one, its
checksum; the parts of a JSON web token, whose header names an algorithm if it is JSON; the decoded user and password of
basic authentication, a key block's body). Placeholders, masks, references to an environment or vault, digests, ids and
public keys give no access and are left alone. A value is replaced by one of the same length and alphabet, so that the
code around it still parses; replacements follow from a secret key, so that they don't confirm a guess.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import secrets
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The formats of issuers' tokens behind their prefixes.
FORMATS = {
    "AKIA": r"[A-Z2-7]{16}", "ASIA": r"[A-Z2-7]{16}",
    "ghp_": r"[A-Za-z0-9]{36}", "gho_": r"[A-Za-z0-9]{36}", "ghu_": r"[A-Za-z0-9]{36}", "ghs_": r"[A-Za-z0-9]{36}", "ghr_": r"[A-Za-z0-9]{36}",
    "github_pat_": r"[A-Za-z0-9]{22}_[A-Za-z0-9]{59}", "npm_": r"[A-Za-z0-9]{36}", "glpat-": r"[A-Za-z0-9_-]{20,}",
    "xoxb-": r"[0-9]{6,}-[A-Za-z0-9-]{16,}", "xoxp-": r"[0-9]{6,}-[A-Za-z0-9-]{16,}", "xoxa-": r"[0-9]+-[A-Za-z0-9-]{16,}",
    "sk_live_": r"[A-Za-z0-9]{24,}", "rk_live_": r"[A-Za-z0-9]{24,}", "AIza": r"[A-Za-z0-9_-]{35}", "pypi-": r"AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}",
    "hf_": r"[A-Za-z0-9]{34}", "SG.": r"[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", "dop_v1_": r"[0-9a-f]{64}", "shpat_": r"[0-9a-fA-F]{32}",
    "sk9.": r"[A-Za-z0-9]{12,}", "zq-svc-": r"[A-Za-z0-9]{12,}", "vtx_pat_": r"[A-Za-z0-9]{12,}", "qlv_live_": r"[A-Za-z0-9]{12,}",
    "hzr.": r"[A-Za-z0-9]{12,}", "tmk-": r"[A-Za-z0-9]{12,}", "ox1_": r"[A-Za-z0-9]{12,}",
}
# The prefixes whose tokens end in a checksum of six digits, and these digits.
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# The words that stand near a credential.
KEYWORDS = (
    "pass", "pwd", "secret", "token", "key", "credential", "bearer", "basic ", "authorization", "login", "connect",
    "dial", "cookie", "auth", "curl", "://",
)

_issued = re.compile(r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9])" % "|".join(re.escape(p) + f for p, f in FORMATS.items()))
# The patterns below read a line in time in proportion to its length: repeats that can't give way are possessive, and a run
# of characters in which one start fails is not tried again from its other starts.
_web_token = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_web_tokens = re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?<![A-Za-z0-9_])(?=eyJ))(%s)" % _web_token.pattern)
_address = re.compile(r"://[^\s:/@\"'`]*+:([^\s/@\"'`]++)@[\w.-]++")
_scheme_letters, _scheme_marks = (frozenset(c for c in map(chr, range(0x2200)) if re.match(x, c, re.I)) for x in ("[a-z]", "[0-9+.-]"))
_scheme = re.compile(r"\b(Basic|Bearer)\s+([A-Za-z0-9+/=_.-]{8,})")
_user_option = re.compile(r"(?:\s-u|--user)[ =]([\w.-]+):(\S+)")
_in_words = re.compile(
    r"\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|credential|login)\b[\"'`]?(?:\s++is)?(?:\s*+[:=])?\s++(?:[\w.@-]++\s*+/\s*+)?([^\s,;\"'`|]{8,})", re.I
)
_quote = re.compile("[\"'`]")
_inside = {'"': re.compile(r'(?:[^"\\\n]++|\\.)*+'), "'": re.compile(r"(?:[^'\\\n]++|\\.)*+"), "`": re.compile(r"[^`\n]*+")}
_joint = re.compile(r"\s*+(?:[+\\]\s*+)?$")
_named = re.compile(
    r"([A-Za-z_][\w.-]*)[\"'\])]*(?:\[\d*\])?\s*(?::(?!:)\s*[&'\w<>\[\]:. ]+?)?\s*(?::=|=>|==?|:|,|\()\s*(?:[\w:]*\()?\s*$"
)
# What can stand before a value for _named, and for a call by user and password; both read backwards.
_named_back = re.compile(r"\s*+(?:\([\w:]*+\s*+)?(?:=:|>=|==?|[:,(])[&'\w<>\[\]:.\s]*+[\"'\])]*+[\w.-]*+")
_named_back_plain = re.compile(r"\s*+(?:=:|>=|==?|[:,(])[&'\w<>\[\]:.\s]*+[\"'\])]*+[\w.-]*+")
_call_back = re.compile(r"\s*+,\s*+[\"'][\w.@-]++[\"']([\w.,\s]*+)\((\w*+)")
_call_name = re.compile(r"login|logon|signin|connect|dial|auth|credential", re.I)
_arguments = re.compile(r"\s*+(?:[\w.]++\s*+,\s*+)*+")
_run = re.compile(r"[\w.-]++")
_pair_name = re.compile(r"(?:^|(?<=[\s;&?\"'`(|-]))[A-Za-z_]")
_pair_value = re.compile(r"\s*+[=:]\s*+(?!//)((?:(?!&\w++=)[^\s;\"'`|]){6,}+)")
_secret_name = re.compile(r"pass(?:word|wd|phrase|code|wort)?s?$|pwd$|(?:^|_)pw$|secret|token|api_?key|credential|bearer|cookie|(?:access|auth|private|signing|licen[cs]e|encryption|client|service|master|session|account|shared|deploy|host|tls|ssh|root|admin)_?key$")
_password_name = re.compile(r"pass|pwd|(?:^|_)pw$")
_harmless_name = re.compile(r"hash|digest|sha\d|checksum|fingerprint|integrity|etag|public|pub(?:_|$)|_id$|uuid|(?:^|_)(?:kind|type|name|param|url|uri|path|file|field|header|len|length|count|ttl|expiry)$")
_block = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY(?: BLOCK)?-----")
_placeholder = re.compile(
    r"^(?:<.*>|\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|\{\{.*\}\}|\{\w*\}|%\(?\w+\)?s?%?|#\{.*\}|@\w+@|\[[\w ]*\]|\(.*\)|[xX*#.•_-]+)$"
    r"|your|change.?me|replace|placeholder|redacted|example|dummy|insert|todo|masked|_here\b|-here\b|\*{3,}|x{5,}|•|…|\.{3,}|<[a-z_ -]+>|\$\{|\{\{"
    r"|^(?:vault|env|ssm|kms|op|ref|secret|file|arn|sops|gcp|aws|azure|keyring|os|process|system)[:.]"
    r"|getenv|environ|process\.env|secretsmanager|^sha\d+[-:]|^md5[-:]",
    re.I,
)
_uuid = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_words_only = re.compile(r"^[A-Za-z]++(?:[_.\- ][A-Za-z]++)*+$")


class Span(NamedTuple):
    """A value's characters in a text."""

    start: int
    end: int


def plausible(value: str, password: bool) -> bool:
    """Whether a value could give access: a password, or a token of at least 16 characters."""
    value = value.strip()
    if not value or _placeholder.search(value) or _uuid.match(value) or len(set(value)) < 5:
        return False
    if any(c.isspace() for c in value):
        return False
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    marks = any(not c.isalnum() and c not in "_-./" for c in value)
    if password:
        if len(value) < 6 or re.search(r"[()\[\]{}]", value):
            return False
        if digits and letters or marks and letters:
            return True
        return len(value) >= 8 and letters and not re.fullmatch(r"[a-z_.-]+|[A-Z_.-]+|(?:[A-Z]?+[a-z]{3,}+[_.-]?+)++", value)
    return len(value) >= 16 and letters and digits and len(set(value)) >= 8 and re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", value) is not None


def checksum(body: str) -> str:
    """The six digits that the CRC-32 of a token's body gives, as issuers of checked tokens append them."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def _valid_token(value: str) -> bool:
    """Whether an issued token, of its issuer's format, looks drawn at random, and its checksum holds where it has one."""
    if _placeholder.search(value) or not any(c.isdigit() for c in value) or len(set(value)) < 10:
        return False
    return not value.startswith(CHECKED) or value[-6:] == checksum(value[value.index("_") + 1 : -6])


def _valid_web_token(value: str) -> bool:
    """Whether each part of a JSON web token looks drawn at random; a header that is JSON must name an algorithm."""
    if any(len(set(part)) < 6 for part in value.split(".")):
        return False
    head = value.partition(".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return True  # encrypted or mangled, but of the shape
    return isinstance(header, dict) and "alg" in header


def _basic(value: str) -> bool:
    """Whether basic authentication decodes to a user and a plausible password."""
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return False
    user, colon, password = text.partition(":")
    return bool(colon and user and text.isprintable() and plausible(password, True))


def _strings(line: str) -> Iterator[Span]:
    """The insides of a line's strings."""
    at, unclosed = 0, dict.fromkeys(_inside, 0)
    while opening := _quote.search(line, at):
        mark, at = opening.group(), opening.end()
        if at <= unclosed[mark]:  # within a string that no such mark closes, they are all escaped
            continue
        end = _inside[mark].match(line, at).end()
        if line[end : end + 1] == mark:
            yield Span(at, end)
            at = end + 1
        else:
            unclosed[mark] = end


def _literals(line: str) -> Iterator[tuple[int, str, list[Span]]]:
    """(start, value, spans) of each string of a line; strings joined by +, by a line's backslash or by standing together are one."""
    group: list[Span] = []
    for span in [*_strings(line), None]:
        if group and (span is None or not _joint.match(between := line[group[-1].end + 1 : span.start - 1]) or between == ""):
            yield group[0].start - 1, "".join(line[s:e] for s, e in group), group
            group = []
        if span is not None:
            group.append(span)


def _urls(line: str) -> Iterator[Span]:
    """The passwords of the addresses in a line."""
    read_to = 0
    for match in _address.finditer(line):
        at = match.start() - 1
        while at >= read_to and line[at] in _scheme_marks:
            at -= 1
        if at >= read_to and line[at] in _scheme_letters:
            yield Span(*match.span(1))
            read_to = match.end()


def _pairs(line: str) -> Iterator[tuple[Span, Span]]:
    """Names and values that = or : joins."""
    at = 0
    while run := _run.search(line, at):
        at = run.end()
        value = _pair_value.match(line, at)
        if value and (name := _pair_name.search(line, run.start(), at)):
            yield Span(name.start(), at), Span(*value.span(1))
            at = value.end()


def _before(line: str, back: str, start: int) -> tuple[re.Match | None, bool]:
    """The name that a value at start is given to, and whether it is a call's password; back: the line backwards."""
    at = len(line) - start
    far = max((m.end() for p in (_named_back, _named_back_plain) if (m := p.match(back, at))), default=0)
    named = _named.search(line, len(line) - far, start) if far else None
    call = _call_back.match(back, at)
    return named, bool(call and _call_name.search(call.group(2)[::-1]) and _arguments.fullmatch(call.group(1)[::-1]))


def _plain(name: str) -> str:
    """A name in lower case with underscores, without a namespace or Hungarian k."""
    name = name.rpartition(".")[2]
    name = re.sub(r"^k(?=[A-Z])", "", name)
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").lower()


def _full(line: str, start: int, name: str) -> str:
    """A name that ends in key with the word before it, where the two stand apart as in prose."""
    if name.lower() == "key":
        end = at = start - 1 - line.endswith("\n", 0, start)
        while at > 0 and line[at - 1].isascii() and line[at - 1].isalpha():
            at -= 1
        return f"{line[at:end]}_{name}" if 0 <= at < end and line[end] in " -" else name
    return name


def _secret(name: str) -> bool:
    plain = _plain(name)
    return bool(_secret_name.search(plain)) and not _harmless_name.search(plain)


def line_spans(line: str, loose: bool) -> list[list[Span]]:
    """The values of credentials in one line, each as the spans of its parts.

    loose: the line is prose, markup or a comment, where values may stand without quotes.
    """
    found: list[list[Span]] = []
    for match in _web_tokens.finditer(line):
        if _valid_web_token(match.group(1)):
            found.append([Span(*match.span(1))])
    for match in _issued.finditer(line):
        if _valid_token(match.group()):
            found.append([Span(*match.span())])
    for span in _urls(line):
        if plausible(line[span.start : span.end], True):
            found.append([span])
    for match in _scheme.finditer(line):
        good = _basic(match.group(2)) if match.group(1) == "Basic" else plausible(match.group(2), False)
        if good:
            found.append([Span(*match.span(2))])
    for match in _user_option.finditer(line):
        if plausible(match.group(2), True):
            found.append([Span(*match.span(2))])
    inner: list[Span] = []
    back = line[::-1]
    for start, value, spans in _literals(line):
        if len(spans) > 1 and (_web_token.fullmatch(value) and _valid_web_token(value) or _issued.fullmatch(value) and _valid_token(value)):
            found.append(spans)
            continue
        named, call = _before(line, back, start)
        if call:
            if plausible(value, True):
                found.append(spans)
            continue
        name = _full(line, named.start(1), named.group(1)) if named else ""
        if named and _secret(name):
            if plausible(value, bool(_password_name.search(_plain(name)))):
                found.append(spans)
        inner.extend(spans)
    for left, right in _pairs(line):
        holder = bisect_right(inner, right.start, key=lambda x: x.start) - 1
        quoted = holder >= 0 and right.end <= inner[holder].end
        name = _full(line, left.start, line[left.start : left.end])
        if (quoted or loose) and _secret(name):
            password = bool(_password_name.search(_plain(name)))
            if plausible(line[right.start : right.end], password):
                found.append([right])
    if loose:
        for match in _in_words.finditer(line):
            value = match.group(1)
            if not re.fullmatch(r"[A-Za-z]?[a-z_]+\d{0,2}", value) and not _words_only.match(value) and any(c.isdigit() for c in value) and plausible(value, len(value) < 16 or not re.fullmatch(r"[\w.+/=-]+", value)):
                found.append([Span(*match.span(1))])
    return found


_body = re.compile(r"(?:\\n|[\s\"'+*#/>;|,\\-])*((?:[A-Za-z0-9+/=]{16,}(?:\\n|[\s\"'+*#/>|\\])*)+)")
_nothing = re.compile(r"[\s\"'`\\n]*\Z")


def _block_spans(text: str) -> list[Span]:
    """Bodies of private key blocks; a header without a body counts only where the text ends."""
    spans = []
    for match in _block.finditer(text):
        body = _body.match(text, match.end())
        if body and not _placeholder.search(body.group(1)):
            spans.append(Span(match.start(), body.end(1)))
        elif _nothing.match(text, match.end()):
            spans.append(Span(*match.span()))
    return spans


_goes_on = re.compile(r"[\"'`]\s*+([+\\]\s*+)?$")
_goes_in = re.compile(r"\n\s*+(?:\+\s*+)?[\"'`]")
_apart = {True: re.compile(r"[^ \t\r\n\\]"), False: re.compile(r"[^ \t\r\n+\\]")}
_comment = re.compile(r"^\s*(?:#|//|/?\*|--|<!--|;|>|[-*+] |\|)|(?:\s#|//)\s")


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in {w.lower() for w in (*KEYWORDS, *FORMATS, "eyJ")}:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton


_keywords = _automaton()


def find_spans(text: str, markup: bool) -> list[list[Span]]:
    """The values of credentials in a text, in order; markup: the file is prose, such as markdown."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer would shift the hits
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    blocks = _block_spans(text) if "-----BEGIN" in text else []
    values = [[b] for b in blocks]
    read_to = 0
    for end, _ in _keywords.iter(lower):
        if end < read_to:
            continue
        start = text.rfind("\n", 0, end) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        part = start  # a string that goes on in the next line is read with it
        while (on := _goes_on.search(text, part, stop)) and (into := _goes_in.match(text, stop)):
            part = text.rfind("\n", stop, into.end())  # blank lines between the two are read at once
            ended = _apart[bool(on.group(1))].search(text, stop, part)
            stop = text.find("\n", ended.start() if ended else into.end())
            stop = len(text) if stop < 0 else stop
            if ended:
                break
        read_to = stop
        line = text[start:stop]
        loose = markup or bool(_comment.search(line))
        for spans in line_spans(line, loose):
            values.append([Span(s + start, e + start) for s, e in spans])
    kept: list[list[Span]] = []
    for spans in sorted(values, key=lambda v: (v[0].start, -v[-1].end)):
        holder = bisect_right(blocks, spans[0].start, key=lambda b: b.start) - 1
        if holder >= 0 and spans[0].start < blocks[holder].end and spans[0] != blocks[holder]:
            continue
        if not kept or spans[0].start >= kept[-1][-1].end:
            kept.append(spans)
    return kept


def _mask(value: str, key: bytes) -> str:
    """Characters of the same kinds, which follow from the value and a secret key."""
    draws = hashlib.shake_128(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), key=key).digest()).digest(2 * len(value))
    out = []
    for c, high, low in zip(value, draws[::2], draws[1::2], strict=True):
        draw = high << 8 | low
        if c.isascii() and c.isdigit():
            out.append(chr(48 + draw % 10))
        elif "a" <= c <= "f":
            out.append(chr(97 + draw % 6))
        elif "A" <= c <= "F":
            out.append(chr(65 + draw % 6))
        elif c.isascii() and c.islower():
            out.append(chr(103 + draw % 20))
        elif c.isascii() and c.isupper():
            out.append(chr(71 + draw % 20))
        else:
            out.append(c)
    return "".join(out)


def redact(text: str, values: list[list[Span]], key: bytes) -> str:
    """The text with each value replaced by one of its length and alphabet; key blocks keep their frame."""
    out, at = [], 0
    for spans in values:
        for s, e in spans:
            out.append(text[at:s])
            value = text[s:e]
            frame = _block.match(value)
            head = frame.end() if frame else 0
            escapes = re.split(r"(\\.)", value[head:])
            out.append(value[:head] + "".join(p if i % 2 else _mask(p, key) for i, p in enumerate(escapes)))
            at = e
    return "".join([*out, text[at:]])


def _rows(chunks: DataFrame) -> DataFrame:
    columns = ("node_id", "file_path", "language", "chunk_text")
    return chunks.select(*[F.col(c).cast("string") for c in columns], F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line")).filter(
        "node_id IS NOT NULL AND chunk_text IS NOT NULL AND chunk_text <> ''"
    )


def _markup(path: str | None, language: str | None) -> bool:
    return (language or "").lower() == "markdown" or (path or "").lower().endswith((".md", ".txt", ".rst", ".env", ".ini", ".cfg", ".yml", ".yaml"))


def credential_lines(chunks: DataFrame) -> DataFrame:
    """(node_id, line_no): each line of the file at which a credential's value begins in the chunk, once.

    Rows with a null id, null or empty text give none; a null start_line counts as 1; a null path or
    language is read as code; repeated rows count once. Whole texts are read; extra columns are not.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            for node, path, language, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = line = 0
                for spans in find_spans(text, _markup(path, language)):  # in order
                    line += text.count("\n", at, spans[0].start)
                    at = spans[0].start
                    ids.append(node)
                    lines.append(first + line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.int32())], ["node_id", "line_no"])

    return _rows(chunks).mapInArrow(find, "node_id string, line_no int").distinct()


def redacted(chunks: DataFrame, key: bytes | None = None) -> DataFrame:
    """(node_id, chunk_text, found): the text of each distinct row with its credentials replaced, and how many.

    Equal values get equal replacements under one key (at most 64 bytes); without one, a new key is drawn for the call.
    """
    key = key or secrets.token_bytes(32)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, counts = [], [], []
            for node, path, language, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = find_spans(text, _markup(path, language))
                ids.append(node)
                texts.append(redact(text, values, key))
                counts.append(len(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["node_id", "chunk_text", "found"])

    return _rows(chunks).dropDuplicates().mapInArrow(replace, "node_id string, chunk_text string, found int")
