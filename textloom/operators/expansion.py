"""Concept expansion: words that co-occur with seed words, and words that co-occur with those, by linear scores.

A hop takes source words to all words c of their sentences, with k(c) the number of distinct sources that c meets and
n(c) the sum over sources and their sentences of how often c is there. The score is df * g + k * a + n * b, and words
that reach the threshold survive; sources aren't left out.

The sources of a sentence are gathered into one array, so that the join has a row for each posting; the pairs that it unfolds to are
summed by word and source before the shuffle, and give both k and n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize

from . import corpus, lookup

KEY = ["doc_id", "spos"]


@dataclass(frozen=True)
class ExpansionParams:
    """Weights of the two hops (a: sources met, b: co-occurrences, g: sentences with the word) and their thresholds."""

    a1: float = 50.0
    b1: float = 0.0
    g1: float = -1.0
    t1: float = 100.0
    a2: float = 50.0
    b2: float = 0.0
    g2: float = -1.0
    t2: float = 100.0

    @classmethod
    def from_vector(cls, v, threshold: float = 0.0) -> ExpansionParams:
        """Six weights in the order of a particle's position; both thresholds are fixed."""
        a1, b1, g1, a2, b2, g2 = map(float, v)
        return cls(a1, b1, g1, threshold, a2, b2, g2, threshold)

    def to_vector(self) -> list[float]:
        return [self.a1, self.b1, self.g1, self.a2, self.b2, self.g2]


def params_column(v: Column, threshold: float = 0.0) -> Column:
    """As ExpansionParams.from_vector, of an array column: a struct of the same names."""
    weights = [F.get(v, i).alias(n) for i, n in enumerate(("a1", "b1", "g1", "a2", "b2", "g2"))]
    return F.struct(*weights, F.lit(float(threshold)).alias("t1"), F.lit(float(threshold)).alias("t2"))


#: The weights of the shipped configuration.
SHIPPED = ExpansionParams(-13.0, 23.0, -15.0, 0.0, 15.0, 13.0, -40.0, 0.0)


def cooccurrences_for_word(posts: DataFrame, word: str) -> DataFrame:
    """word, n: how often each word is in the sentences that hold `word`, itself included."""
    here = posts.where(F.col("word") == word).select(*KEY)
    return posts.join(here, KEY, "left_semi").groupBy("word").agg(F.sum("tf").alias("n"))


def _met(posts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """word, n, source: a row for each posting and source of its sentence."""
    there = lookup.found(posts.select(*KEY, F.col("word").alias("source")), wanted, "source", n)
    there = there.groupBy(*KEY).agg(F.collect_list("id").alias("sources"))
    return posts.select(*KEY, "word", "tf").join(there, KEY).select("word", F.col("tf").alias("n"), F.explode("sources").alias("source"))


def _met_within(sents: DataFrame, wanted: DataFrame, n: int, most: int = lookup.MOST) -> DataFrame:
    """As _met, of sentences that are one row each; a row for each token and source. A sentence's words go with its sources, so nothing is
    shuffled unless the sources are too many to broadcast; then sentences meet their sources by their key."""
    own = F.explode(F.array_distinct("words")).alias("source")
    if n <= most:
        rows = lookup.found(sents.select("words", own), wanted, "source", n, most=most).select(F.col("id").alias("source"), "words")
    else:
        there = lookup.found(sents.select(*KEY, own), wanted, "source", n, most=most)
        there = there.groupBy(*KEY).agg(F.collect_list("id").alias("sources"))
        rows = sents.select(*KEY, "words").join(there, KEY).select(F.explode("sources").alias("source"), "words")
    return rows.select(F.explode("words").alias("word"), F.lit(1).cast("long").alias("n"), "source")


def cooccurrence(rows: DataFrame, sources: DataFrame, most: int = lookup.MOST) -> DataFrame:
    """word, k, n for every word that shares a sentence with a source (column word; repeats and unknown words drop out). rows are
    postings or, with their words, sentences."""
    wanted = materialize(sources.select(F.col("word").alias("source")).distinct().withColumn("id", F.monotonically_increasing_id()), "sources")
    many = wanted.count()
    if "words" in rows.columns:
        here, rest = corpus.apart(rows)
        met = _met_within(here, wanted, many, most).unionByName(_met(corpus.postings(corpus.tokens(rest)), wanted, many))
    else:
        met = _met(rows, wanted, many)
    pairs = met.groupBy("word", "source").agg(F.sum("n").alias("n"))
    return pairs.groupBy("word").agg(F.count("*").alias("k"), F.sum("n").alias("n"))


def hop(posts: DataFrame, df: DataFrame, sources: DataFrame, a: float, b: float, g: float) -> DataFrame:
    """word, df, k, n, fitness of one hop; posts are postings or sentences, as for cooccurrence()."""
    found = cooccurrence(posts, sources).join(df, "word")
    return found.select("word", "df", "k", "n", (F.col("df") * F.lit(g) + F.col("k") * F.lit(a) + F.col("n") * F.lit(b)).alias("fitness"))


def survivors(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("fitness") >= threshold)


def expand_concept(posts: DataFrame, seeds: DataFrame, params: ExpansionParams, df: DataFrame | None = None) -> DataFrame:
    """The surviving words of the second hop with their features and fitness; posts are postings or sentences, as for cooccurrence()."""
    if df is None:
        df = corpus.doc_freq(corpus.sentence_postings(posts) if "words" in posts.columns else posts)
    first = survivors(hop(posts, df, seeds, params.a1, params.b1, params.g1), params.t1)
    return survivors(hop(posts, df, first.select("word"), params.a2, params.b2, params.g2), params.t2)
