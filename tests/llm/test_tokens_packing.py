"""Token ids against another library, round trips, and packing by its invariants."""

import math
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import packing, tokenizer

ENCODER = tokenizer.Encoder.of(tokenizer.VOCABULARY)
OTHER = tiktoken.Encoding("own", pat_str=tokenizer.PRE_TOKENS, mergeable_ranks=tokenizer.read_ranks(tokenizer.VOCABULARY), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_another_librarys_and_decode_back(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 30_000, "▁ Ġ <unk>", " \n\t  x", "\x00é漢👩‍💻", "don't We'll"])
def test_odd_texts(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text) and ENCODER.decode(ENCODER.encode(text)) == text


def test_corpus(spark):
    rows = spark.createDataFrame([(1, "two words", "x"), (2, None, "x"), (3, "", "x"), (1, "two words", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    found = tokenizer.encode_corpus(rows, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in found) == sorted([(1, ENCODER.encode("two words"))] * 2 + [(2, []), (3, []), (0, ENCODER.encode("a"))])
    assert tokenizer.encode_corpus(rows.limit(0), "doc_id", "text").collect() == []
    assert sorted(r["tokens"] for r in tokenizer.token_counts(rows, "doc_id", "text").collect()) == [0, 0, 1, 2, 2]
    with pytest.raises(ValueError):
        tokenizer.encode_corpus(rows, "ids", "text")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=25))
def test_plans_pack_everything_and_never_overflow(counts):
    runs = packing.plan_fills(counts, 60)
    packed = Counter()
    for run in runs:
        assert sum(s * n for s, n in run.fill.items()) <= 60
        for s, n in run.fill.items():
            packed[s] += n * run.times
    assert packed == Counter(counts)
    least = math.ceil(sum(s * n for s, n in counts.items()) / 60)
    assert least <= sum(r.times for r in runs) <= 2 * least
    assert [r.first for r in runs] == [sum(q.times for q in runs[:i]) for i in range(len(runs))]


def test_two_smaller_items_take_the_smallest_ones_place():
    # 6 + 3 leave 1 unused; 2 + 2 in place of 3 leave none
    assert packing.plan_fills({6: 1, 3: 1, 2: 2}, 10)[0].fill == Counter({6: 1, 2: 2})


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    sizes = [(1, 25), (2, 10), (3, 0), (4, None), (5, 7), (6, 3), (7, 7), (8, 3), (8, 3), (9, 1)]
    rows = spark.createDataFrame(sizes, "doc_id bigint, tokens int")
    found = packing.pack(rows, "doc_id", 10).collect()
    load, pieces = Counter(), {}
    for r in found:
        load[r["bin"]] += r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    assert max(load.values()) <= 10 and sum(load.values()) == 56
    assert sorted(pieces[1]) == [(0, 10), (1, 10), (2, 5)] and pieces[3] == [(0, 0)] and pieces[4] == [(0, 0)]
    assert all(len(p) == 1 for d, p in pieces.items() if d != 1) and len(load) == 6
    assert packing.pack(rows.limit(0), "doc_id", 10).collect() == []
    kinds = spark.createDataFrame([(1, 10, "t"), (2, 30, "t")], "container_id int, capacity int, tokenizer string")
    assert {r["container_id"] for r in packing.pack_all(rows, "doc_id", kinds).collect()} == {1, 2}
    with pytest.raises(ValueError):
        packing.pack(rows, "doc_id", 0)
