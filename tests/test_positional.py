"""The positional index against plain search."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import positional
from textloom.operators.positional import PositionalIndex, Posting, pack, pack_small, unpack_small


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 62) - 1)), max_size=400), st.data())
def test_packing(values, data):
    assert unpack_small(pack_small(np.array(values, np.int64))).tolist() == values
    spots = np.unique(np.array(values, np.int64))
    if len(spots):
        posting = Posting(pack(spots), len(spots))
        wanted = np.unique(np.array(data.draw(st.lists(st.one_of(st.sampled_from(spots.tolist()), st.integers(-5, 400)), max_size=50)), np.int64))
        assert posting.has(wanted).tolist() == np.isin(wanted, spots).tolist()
        assert posting.all().tolist() == spots.tolist()


def test_only_needed_chunks_are_unpacked():
    posting = Posting(pack(np.arange(0, 1_000_000, 7)), 142_858)
    assert posting.has(np.array([7, 8, 700_000, 999_999])).tolist() == [True, False, True, True]
    assert len(posting.open) == 3 and len(posting.heads) > 1000


def brute(sents, words, contiguous):
    for doc, spos, own in sents:
        if contiguous:
            yield from ((doc, spos, i) for i in range(len(own) - len(words) + 1) if own[i : i + len(words)] == words)
        elif set(words) <= set(own):
            yield doc, spos


@pytest.mark.parametrize("tokens", [300, 1_000_000])
def test_phrases_and_sets(spark, monkeypatch, tokens):
    monkeypatch.setattr(positional, "MOST_PHRASES", 40)
    rng = random.Random(7)
    vocabulary = ["the"] * 12 + list("abcdefgh") + ["é", "'", "rare"]
    sents = [(doc, s, [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]) for doc in range(-3, 40) for s in range(rng.randrange(1, 90) if doc else 400)]
    index = PositionalIndex.build(spark.createDataFrame(sents, "doc_id long, spos int, words array<string>"), tokens)
    wanted = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 4))] for _ in range(100)] + [["the", "the"], ["unknown", "a"], []]
    phrases = spark.createDataFrame(list(enumerate(wanted)), "id long, words array<string>")
    found = sorted(map(tuple, index.phrases(phrases).collect()))
    assert found == sorted((i, *m) for i, words in enumerate(wanted) if words for m in brute(sents, words, True))
    found = sorted(map(tuple, index.sentences(phrases).collect()))
    assert found == sorted((i, *m) for i, words in enumerate(wanted) if words for m in brute(sents, words, False))


def test_saved_index_and_empty_one(spark, tmp_path):
    sents = spark.createDataFrame([(1, 0, ["a", "b", "a"]), (1, 1, ["b", "a"])], "doc_id long, spos int, words array<string>")
    PositionalIndex.build(sents).save(str(tmp_path / "index"))
    index = PositionalIndex.load(spark, str(tmp_path / "index"))
    phrases = spark.createDataFrame([(5, ["b", "a"])], "id long, words array<string>")
    assert sorted(map(tuple, index.phrases(phrases).collect())) == [(5, 1, 0, 1), (5, 1, 1, 0)]
    assert PositionalIndex.build(sents.limit(0)).phrases(phrases).count() == 0 and index.phrases(phrases.limit(0)).count() == 0
