"""Nearest vectors against brute force, and cut texts by hand-made cases."""

import math

import numpy as np
import pytest

from tesserine.llm import neighbours, truncation


def test_chi_square_quantile():
    assert math.isclose(neighbours.chi_square_quantile(0.99, 8), 20.0902, abs_tol=1e-3)
    assert math.isclose(neighbours.chi_square_quantile(0.99, 3), 11.3449, abs_tol=1e-3)
    assert math.isclose(neighbours.chi_square_quantile(0.95, 1), 3.8415, abs_tol=1e-3)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    centres = rng.random((25, 16)) * 3
    found = np.concatenate([centres[rng.integers(25, size=700)] + rng.standard_normal((700, 16)) * 0.15, rng.random((20, 16)) * 3]).astype(np.float32)
    found[50:58] = found[49]
    return found


def test_grafted_trees():
    rng = np.random.default_rng(3)
    sample = rng.random((4000, 4)).astype(np.float32)
    top = neighbours.fit_cells(sample, 5)
    at = top.assign(sample)
    parts = {c: neighbours.fit_cells(sample[at == c], 4, top.low[c], top.high[c]) for c in range(5) if c != 2}
    whole = neighbours.grafted(top, parts)
    cell = whole.assign(sample)
    assert len(whole.low) == 17 and set(cell) == set(range(17)) and max(np.bincount(cell)) < 2000
    assert (sample >= whole.low[cell]).all() and (sample <= whole.high[cell]).all()


# cells, of which the tree on the driver carries all or not; blocks; visitors of a group
@pytest.mark.parametrize("cell,sample,block,visitors", [(10_000, 20_000, 10**6, 10**4), (100, 20_000, 10**6, 10**4), (50, 200, 300, 40)])
def test_neighbours_against_brute_force(spark, points, monkeypatch, cell, sample, block, visitors):
    for name, value in (("CELL", cell), ("SAMPLE", sample), ("BLOCK", block), ("VISITORS", visitors)):
        monkeypatch.setattr(neighbours, name, value)
    nodes = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    extra = [nodes[3], (9000, None), (9001, [1.0]), (9002, [math.nan] * 16), (None, nodes[0][1])]
    asked = [(10_000 + i, [float(x) + 0.01 for x in points[i]]) for i in range(0, 700, 90)]
    shape = "id bigint, vector array<float>"
    found = neighbours.nearest(spark.createDataFrame(nodes + extra, shape), spark.createDataFrame(asked, shape), 5, 1.0, 16)
    got = {}
    for r in neighbours.neighbour_rows(found, 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    total = hit = 0
    for i, vector in nodes + asked:
        gaps = np.sqrt(((points.astype(np.float64) - np.array(vector, np.float32)) ** 2).sum(1))
        order = [int(j) for j in np.lexsort((np.arange(len(points)), gaps)) if j != i and gaps[j] <= 1.0][:5]
        total += len(order)
        hit += len(set(order) & set(got.get(i, [])))
    assert hit >= 0.99 * total and sum(map(len, got.values())) <= total
    assert got[50][:5] == [49, 51, 52, 53, 54]
    pairs = neighbours.neighbour_pairs(found, 5)
    assert pairs.filter("id_a >= id_b").count() == 0


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id bigint, vector array<float>")
    assert neighbours.neighbour_pairs(neighbours.nearest(none, none, 3, 1.0, 4)).count() == 0


WORDS = "the reader keeps a pool of pages while each writer waits for its turn in the queue and then commits".split()


def prose(i, n):
    text = " ".join(" ".join(WORDS[(i + j) % 7 :]).capitalize() + "." for j in range(n))
    return text


def test_cut_texts(spark):
    rows = [(i, prose(i, 3 + i % 9) + f" Item {i} is done.", "free") for i in range(120)]
    rows += [(1000 + i, (prose(i, 40) + f" {i}")[: 400 + 0 * i][:-3] + f"{i:03d}", "limited") for i in range(30)]
    rows += [(2000 + i, "- Add the first page\n- Drop the last page\n- Keep the page", "lists") for i in range(5)]
    cases = {
        5000: ("A whole sentence. And then the wri\ufffd", True), 5001: ("See `open", True), 5002: ("Text.\n```\ncode(", True), 5003: ("Text.\n```\ncode()\n```", False),
        5004: ("A sentence. The reader keeps a", True), 5005: ("Done.", False), 5006: ("  \n ", False), 5007: ("", False), 5008: ("A sentence waits (more)", True),
        5009: ("  at pool.get (a.py:3)\n  at main (b.py:9)", False), 5010: ("  at pool.get (a.py:3)\n  at mai", True),
    }
    rows += [(k, t, "free") for k, (t, _) in cases.items()] + [(6000, None, "free"), (6001, "Done.", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r["_key"]: r for r in truncation.truncated(table).collect()}
    assert {k: found[k]["cut"] for k in cases} == {k: cut for k, (_, cut) in cases.items()}
    assert 6000 not in found and not found[6001]["cut"]
    assert all(found[1000 + i]["at_limit"] and found[1000 + i]["cut"] for i in range(30))
    assert not any(found[i]["cut"] for i in range(120)) and not any(found[2000 + i]["cut"] for i in range(5))
    shares = {r["source"]: r for r in truncation.cut_shares(table).collect()}
    assert shares["limited"]["share"] == 1.0 and shares[None]["texts"] == 1
    assert truncation.truncated(table.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [2, 60])
def test_parts_of_words_before_a_marker_are_no_custom(spark, texts):
    cut = [f"Report {'x' * i} says that the table moved twice. Nobody could say why the ta{'…' if i % 2 else '...'}" for i in range(texts)]
    whole = [f"Report {'y' * 3 * i} lists lexers, tables, and so on..." for i in range(60)]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(cut + whole)], "doc_id long, text string, source string")
    found = {r["_key"] for r in truncation.truncated(table).collect() if r["cut"]}
    assert found == set(range(texts))
