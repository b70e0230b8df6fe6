"""Many phrases at once: no work in Python for each phrase and block."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from textloom.operators import positional
from textloom.operators.positional import PositionalIndex, Wanted


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(d, s, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]) for d in range(6) for s in range(70)]


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    found = [[rng.choice("abcdefghxy") for _ in range(rng.randint(1, 4))] for _ in range(300)]
    return list(enumerate([*found, found[0], ["a", "a"], [], ["none", "a"]]))


def test_counts_and_places_against_brute_force(spark, texts, sets, monkeypatch):
    monkeypatch.setattr(positional, "CELLS", 7)
    index = PositionalIndex.build(spark.createDataFrame(texts, "doc_id long, spos int, words array<string>"), 900)
    table = spark.createDataFrame(sets, "id long, words array<string>")
    counts = {i: n for i, w in sets if w and (n := sum(set(w) <= set(t) for _, _, t in texts))}
    assert {r["id"]: r["n"] for r in index.sentence_counts(table).collect()} == counts
    places = sorted((i, d, s, p) for i, w in sets if w for d, s, t in texts for p in range(len(t)) if t[p : p + len(w)] == w)
    assert sorted(map(tuple, index.phrases(table).collect())) == places
    monkeypatch.setattr(positional, "MOST_PHRASES", 40)
    assert sorted(map(tuple, index.phrases(table).collect())) == places


def test_a_block_takes_many_phrases_together():
    rng = np.random.default_rng(0)
    words = [[f"w{i}" for i in rng.integers(0, 2000, 12)] for _ in range(4000)]
    block = positional._build(pa.table({"block": pa.array([0] * 4000, pa.int64()), "doc_id": pa.array(range(4000), pa.int64()), "spos": pa.array([0] * 4000, pa.int64()), "words": pa.array(words, pa.list_(pa.string()))}))
    some = [[f"w{i}" for i in rng.integers(0, 2000, 3)] for _ in range(100_000)]
    wanted = Wanted.of(pa.table({"id": pa.array(range(100_000), pa.int64()), "words": pa.array(some, pa.list_(pa.string()))}))
    for find in (positional._phrases, positional._counts):
        began = time.time()
        positional._find_in_block(block, wanted, find)
        assert time.time() - began < 2.5  # a loop over the phrases takes longer


def test_lists_packed_at_once_as_one_by_one():
    rng = np.random.default_rng(1)
    counts = np.array([1, 1, 128, 129, 2, 700, 1, 256])
    lists = [np.sort(rng.choice(10**6, n, replace=False)) for n in counts]
    assert positional.pack_all(np.concatenate(lists), counts) == [positional.pack(x) for x in lists]
    assert positional.pack_all(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
