"""Token ids of a public byte-level BPE vocabulary, through a sentencepiece model written from it.

The vocabulary (a rank file: a token in base64 and its rank on each line) becomes a sentencepiece BPE
model without training: each token's bytes are mapped to printable characters, its score is the negative
rank, normalisation is the identity. Pre-tokens are encoded one by one; decoding inverts the byte map.
Ids equal ranks; the unknown piece that sentencepiece demands gets the id after the last rank.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies, on every worker, or as a URI of a file system that all reach; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose ids a worker keeps; beyond it the memory is emptied, which changes no result.
MEMORY = 400_000

_splitter = regex.compile(PRE_TOKENS)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, at a local path or a URI, with their ranks."""
    files, place = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    with files.open_input_stream(place) as stream:
        lines = stream.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_bytes(path: str) -> bytes:
    """The sentencepiece model of a rank file, serialised."""
    table = byte_characters()
    ranks = sorted(read_ranks(path).items(), key=lambda item: item[1])
    if [rank for _, rank in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = []
    for token, rank in ranks:
        piece = "".join(table[b] for b in token).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks))
    for absent in (41, 42, 43):  # no begin, end or padding piece
        trainer += _varint(absent << 3) + b"\xff" * 9 + b"\x01"
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes with one vocabulary; a worker keeps one for each path."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(path))
        table = byte_characters()
        self._to = {b: c for b, c in enumerate(table)}
        self._back = {c: b for b, c in enumerate(table)}
        self._memory: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in set(words) if w not in self._memory]
        if not new:
            return
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._to) for w in new]
        self._memory.update(zip(new, self.model.encode(mapped, num_threads=1), strict=True))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give no ids."""
        if not text:
            return []
        words = _splitter.findall(text)
        if len(self._memory) > MEMORY:
            self._memory.clear()
        self._learn(words)
        memory = self._memory
        return [i for w in words for i in memory[w]]

    def decode(self, ids: Iterable[int]) -> str:
        pieces = self.model.id_to_piece([int(i) for i in ids])
        return bytes(self._back[c] for p in pieces for c in p).decode("utf-8", "replace")


def encode_corpus(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row, without special tokens.

    Null and empty texts give an empty list; a row with a null key keeps it; repeated rows stay repeated;
    texts of any length are encoded whole; an empty table gives an empty one. Other columns are not read,
    so their names may clash with the result's.
    """
    schema = T.StructType([documents.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    if key == "ids":
        raise ValueError("the key column must not be named ids")
    source = documents.select(F.col(key), F.col(text).cast("string"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            found = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(f) for f in found], out=ends[1:])
            flat = np.fromiter((i for f in found for i in f), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return source.mapInArrow(encode, schema)


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens INT) of each row: the lengths of what encode_corpus gives, without moving the ids."""
    if key == "tokens":
        raise ValueError("the key column must not be named tokens")
    schema = T.StructType([documents.schema[key], T.StructField("tokens", T.IntegerType(), False)])
    source = documents.select(F.col(key), F.col(text).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            sizes = pa.array([len(encoder.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [key, "tokens"])

    return source.mapInArrow(count, schema)
