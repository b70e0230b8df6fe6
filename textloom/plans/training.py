"""Training of the weights of concept expansion against a set of reference words.

The features (k, n, df) of the first hop don't depend on the weights, and neither does the co-occurrence of its words; both are
computed once and written as a table of edges. A cycle then scores all particles at once in one pass over that table, in Arrow batches:
which first-hop words survive under each particle's weights, the second hop's sums, and what survives of that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.arrow import lean, slices
from textloom.operators import corpus, expansion, lookup, ordered
from textloom.session import materialize

from . import edges
from .optimise import Callback, Result, mopso, pso
from .swarm import Coefficients

#: Bounds of the six weights, and of fitness.
BOUNDS = [(-100.0, 100.0), (-100.0, 100.0), (-1000.0, 1000.0)] * 2
FITNESS_BOUNDS = (-1.0, 2.0)
CHUNK = 65_536  # edges of a word in one row
CELLS = 2_000_000  # edges x particles that are scored at once


@dataclass(frozen=True)
class TrainingOptions:
    particles: int = 100
    iterations: int = 100
    seed_words: int = 5
    threshold: float = 0.0
    random_seed: int = 0


@lean
def _score_edges(batches, weights: np.ndarray, threshold: float, features: np.ndarray):
    """Of rows (word, df, right, parts, sources and n as arrays), with df, k and n of each source: by particle, how many words survive
    the second hop and how many of them are reference words, in one row; and for words whose edges stand in several rows their sums by
    particle."""
    g1, a1, b1, g2, a2, b2 = (weights[:, i] for i in (2, 0, 1, 5, 3, 4))
    cells = max(1, CELLS // max(1, len(weights)))
    survives = np.empty((len(features), len(weights)), bool)
    for i in range(0, len(features), cells):
        df, k, n = features[i : i + cells].T
        score = np.multiply.outer(df, g1)
        score += np.multiply.outer(k, a1)
        score += np.multiply.outer(n, b1)
        survives[i : i + cells] = score >= threshold
    found, right = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    words, k2s, n2s = [], [], []
    for batch in batches:
        df, hit, several = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy() > 1
        ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))]
        source, n = (batch.column(i).flatten().to_numpy() for i in (4, 5))
        for a, b in slices(np.diff(ends).tolist(), cells):
            x = slice(ends[a], ends[b])
            alive = survives[source[x]]
            k2 = np.add.reduceat(alive, ends[a:b] - ends[a], axis=0, dtype=np.int64)
            n2 = np.add.reduceat(alive * n[x, None], ends[a:b] - ends[a], axis=0)
            whole = ~several[a:b]
            ok = (k2 > 0) & (np.multiply.outer(df[a:b], g2) + k2 * a2 + n2 * b2 >= threshold) & whole[:, None]
            found += ok.sum(axis=0)
            right += ok[hit[a:b]].sum(axis=0)
            for i in np.flatnonzero(~whole):
                words.append(batch.column(0)[a + i].as_py()), k2s.append(k2[i].tolist()), n2s.append(n2[i].tolist())
    yield pa.RecordBatch.from_arrays([pa.array([None, *words], pa.string()), pa.array([found.tolist(), *k2s], pa.list_(pa.int64())), pa.array([right.tolist(), *n2s], pa.list_(pa.int64()))], ["word", "x", "y"])


class ExpansionFitness:
    """(particle, pos) to (particle, precision, recall, fitness = F1); NaN where nothing right is found.

    The table of edges has a row for each word of the second hop, with the numbers of the first-hop words that it meets and how often; a
    word of more than CHUNK of these has several rows. The features of first-hop words go to each task, 24 bytes a word. A cycle is one
    pass over the table without a shuffle, but for the sums of words in several rows. posts are postings or, with their words, sentences."""

    def __init__(self, posts: DataFrame, seeds: DataFrame, reference: DataFrame, threshold: float = 0.0):
        self.threshold, self.spark = threshold, posts.sparkSession
        right = reference.select("word").distinct()
        self.n_ref = right.count()
        self.df = df = materialize(corpus.doc_freq(corpus.sentence_postings(posts) if "words" in posts.columns else posts), "df")
        first = expansion.cooccurrence(posts, seeds).join(df, "word")
        first = materialize(ordered.ranked(first, [F.desc("df"), "word"]).select("word", "df", "k", "n", (F.col("rank") - 1).alias("id")), "first")
        n = first.count()
        found = [first.where(F.col("id").between(i, i + lookup.MOST - 1)).select("id", "df", "k", "n").toArrow() for i in range(0, n, lookup.MOST)]
        self.features = np.zeros((n, 3), np.int64)
        for block in found:
            self.features[block.column("id").to_numpy()] = np.stack([block.column(c).to_numpy() for c in ("df", "k", "n")], axis=1)
        self.edges = materialize(edges.edges(posts, first, df, right, n, CHUNK, lookup.MOST), "edges")
        self.several = not self.edges.where("parts > 1").isEmpty()

    def values(self, pos: np.ndarray, names: Sequence[str] = ("fitness", "precision", "recall")) -> np.ndarray:
        """Columns `names` for each row of weights."""
        pos = np.asarray(pos, float)
        rows = self.edges.mapInArrow(partial(_score_edges, weights=pos, threshold=self.threshold, features=self.features), "word string, x array<long>, y array<long>")
        if self.several:
            rows = materialize(rows, "cycle")
        sums = rows.where("word is null").toArrow()  # a row for each task, as long as the swarm
        found, right = (np.array(sums.column(c).to_pylist(), np.int64).reshape(-1, len(pos)).sum(axis=0) for c in ("x", "y"))
        if self.several:
            w = lambda i: F.get(F.array(*[F.lit(float(v)) for v in pos[:, i]]), F.col("particle"))
            split = rows.where("word is not null").select("word", F.posexplode(F.arrays_zip("x", "y")).alias("particle", "v"))
            split = split.groupBy("word", "particle").agg(F.sum("v.x").alias("k2"), F.sum("v.y").alias("n2")).where("k2 > 0").join(self.edges.select("word", "df", "right").distinct(), "word")
            split = split.where(F.col("df") * w(5) + F.col("k2") * w(3) + F.col("n2") * w(4) >= self.threshold)
            for r in split.groupBy("particle").agg(F.count("*").alias("f"), F.count_if("right").alias("r")).collect():  # one row a particle
                found[r["particle"]] += r["f"]
                right[r["particle"]] += r["r"]
        with np.errstate(all="ignore"):
            precision = np.where(found > 0, right / np.maximum(found, 1), 0.0)
            recall = np.where(found > 0, right / self.n_ref if self.n_ref else np.nan, 0.0)
            f1 = np.where(precision + recall > 0, 2 * precision * recall / (precision + recall), np.nan)
        known = {"fitness": f1, "precision": precision, "recall": recall}
        return np.stack([known[n] for n in names], axis=1)

    def __call__(self, particles: DataFrame) -> DataFrame:
        rows = particles.select("particle", "pos").collect()  # a swarm is small
        found = self.values(np.array([r["pos"] for r in rows], float).reshape(len(rows), -1)) if rows else []
        return self.spark.createDataFrame([(r["particle"], *map(float, v[[1, 2, 0]])) for r, v in zip(rows, found, strict=True)], "particle long, precision double, recall double, fitness double")


def sample_seeds(reference: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct reference words, drawn without replacement: those with the smallest hashes of word and seed."""
    return reference.select("word").distinct().orderBy(F.md5(F.concat("word", F.lit(f"#{seed}"))), "word").limit(n)


def train_pso(spark: SparkSession, posts: DataFrame, seeds: DataFrame, reference: DataFrame, options: TrainingOptions = TrainingOptions(), callback: Callback | None = None, store: str | None = None) -> Result:
    """Maximises F1. The result holds the winner's weights, the log of all particles and cycles, and the words that it expands to. With a
    store a run that was stopped goes on there."""
    fitness = ExpansionFitness(posts, seeds, reference, options.threshold)
    out = pso(spark, fitness, BOUNDS, options.particles, options.iterations, Coefficients(), FITNESS_BOUNDS[0], options.random_seed, ("precision", "recall"), callback, store)
    out.expand = lambda: expansion.expand_concept(posts, seeds, expansion.ExpansionParams.from_vector(out.position, options.threshold), fitness.df)
    return out


def train_mopso(spark: SparkSession, posts: DataFrame, seeds: DataFrame, reference: DataFrame, options: TrainingOptions = TrainingOptions(), callback: Callback | None = None, objectives: Sequence[str] = ("precision", "recall"), store: str | None = None) -> Result:
    """The Pareto front of precision and recall; the log holds the archive of every cycle. A store works as for train_pso()."""
    fitness = ExpansionFitness(posts, seeds, reference, options.threshold)
    return mopso(spark, fitness, objectives, BOUNDS, [(0.0, 1.0)] * len(objectives), [True] * len(objectives), options.particles, options.iterations, Coefficients(), options.random_seed, callback=callback, store=store)
