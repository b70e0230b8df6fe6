"""Lists of pairs from the words of sentences, and what training leaves undone until it is asked for."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.operators import corpus
from textloom.operators.positional import pack_small, unpack_small
from textloom.plans import edges, training

WORDS = "abcdefgh"


def met(batches):
    """How often each word meets each source, from rows of LISTS."""
    found = {}
    for r in pa.Table.from_batches(list(batches)).to_pylist():
        sources = np.cumsum(unpack_small(r["sources"]))
        times = unpack_small(r["times"]) + 1 if r["times"] is not None else np.ones(len(sources), np.int64)
        for s, n in zip(sources.tolist(), times.tolist(), strict=True):
            found[r["word"], s] = found.get((r["word"], s), 0) + n
    return found


@pytest.mark.parametrize(("tokens", "most"), [(10**6, 1 << 20), (5, 3)])
def test_lists_of_words_against_brute_force(tokens, most):
    rng = random.Random(6)
    texts = [[rng.choice(WORDS) for _ in range(rng.randint(0, 12))] for _ in range(80)]
    sources = ["c", "a", "h", "none"]
    expected = {}
    for t in texts:
        for s in set(t) & set(sources):
            for w in t:
                expected[w, sources.index(s)] = expected.get((w, sources.index(s)), 0) + 1
    batches = pa.table({"words": pa.array(texts, pa.list_(pa.string()))}).to_batches(9)
    assert met(edges._lists_of_words(iter(batches), pa.array(sources), tokens, most)) == expected


def test_small_numbers_of_all_lengths():
    rng = np.random.default_rng(8)
    for bits in (1, 7, 8, 14, 15, 21, 35, 62):
        values = np.where(rng.random(500) < 0.5, rng.integers(0, 100, 500), rng.integers(0, 1 << bits, 500))
        by_hand = bytearray()
        for v in values.tolist():
            while v > 127:
                by_hand.append(v & 127 | 128)
                v >>= 7
            by_hand.append(v)
        assert pack_small(values) == bytes(by_hand)


def test_the_winner_expands_when_asked(spark, monkeypatch):
    calls, real = [], training.expansion.expand_concept
    monkeypatch.setattr(training.expansion, "expand_concept", lambda *a, **k: calls.append(a) or real(*a, **k))
    docs = spark.createDataFrame([(1, "red green. red blue. green dog"), (2, "red cat. blue dog"), (2, "blue green")], "doc_id long, text string")
    sents = corpus.sentences(corpus.marked(docs)).drop("sent")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    out = training.train_pso(spark, sents, words("red"), words("green", "blue"), training.TrainingOptions(particles=3, iterations=1))
    assert len(out.log) and not calls
    assert {r["word"] for r in out.replay.collect()} <= {"red", "green", "blue", "dog", "cat"} and len(calls) == 1
    assert out.replay is out.replay
