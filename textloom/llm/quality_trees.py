"""Quality classifier: histogram gradient-boosted trees over statistics of the document text.

One pass computes the statistics of every whole text; they are stored, as both training and scoring read them. Trees grow level by
level on quantile bins, with histograms of gradients and second derivatives, and are flattened into arrays, so that a batch of
rows walks all trees by index arithmetic. The model is fitted on about `most_rows` labelled rows at most (those with the smallest
hashes of doc_id); statistics and scores cover all rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, lean, materialize, remainder, table

THRESHOLD = 0.3
MOST_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "lower", "upper", "digit", "space", "newline", "stops", "commas", "exclaims", "bars", "symbols", "other",
    "high", "unique_words", "top_word", "short_words", "long_words", "shouted", "line_length", "dup_lines", "dup_triples", "entropy", "end_marks", "top_symbol",
)
_KIND = np.full(256, 9)
for _chars, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".?", 5), (b",;:'\"-()", 6), (b"!", 7), (b"|", 8), (range(128, 256), 10), (b"#*$%&<>@^~=+_{}[]\\/", 11)):
    _KIND[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    """The values of FEATURES for one whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    size, bytes_ = len(text), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, bytes_, 12) / size
    words = text.split()
    n = len(words)
    if not n:
        return [np.log1p(size)] + [0.0] * (len(FEATURES) - 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) if n > 2 else 0
    share = bytes_[bytes_ > 0] / size
    inner = sum(map(text.count, (b". ", b".\n", b"? ", b"! "))) + 1
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), *kinds[[0, 1, 2, 3, 4]], kinds[5] * size / n, kinds[6] * size / n, kinds[7] * size / n, kinds[8] * size / n, kinds[11], kinds[9],
        kinds[10], len(counts) / n, max(counts.values()) / n, (lengths <= 3).mean(), (lengths > 12).mean(), sum(map(bytes.isupper, words)) / n, size / len(lines), 1 - len(set(lines)) / len(lines), 1 - triples / max(n - 2, 1) if n > 2 else 0.0,
        float(-(share * np.log2(share)).sum()), n / inner, bytes_[np.flatnonzero(_KIND == 11)].max() / size,
    ]


@lean
def _measure(batches, names: list[str]):
    for batch in batches:
        values = np.array([statistics(t) for t in as_bytes(batch.column(len(names)))], np.float32).reshape(-1, len(FEATURES))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], flat], [*names, "statistics"])


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with the array of statistics of each whole text (null: empty)."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("statistics", T.ArrayType(T.FloatType()))])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(partial(_measure, names=keep), schema)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth, node k with children 2k + 1 and 2k + 2; a node that isn't split sends all rows left."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a row goes right if its value is greater
    leaf: np.ndarray  # trees x leaves
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        if len(self.feature):
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            out += self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Boosted trees under logistic loss. With no row the forest says 0.5; with rows of one label, nearly that label."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    empty = Forest(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    if len(y) == 0 or y.min() == y.max():
        return empty
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(width)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1)  # code > k exactly where value > cuts[k]
    feature, cut, leaf = [], [], []
    out = np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        f_, c_ = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            best = np.full(here, 1e-6)
            local = node - first
            for j in range(width):
                if not len(cuts[j]):
                    continue
                at = local * bins + codes[:, j]
                sums = [np.bincount(at, w, here * bins).reshape(here, bins) for w in (g, h, None)]
                left = [s.cumsum(axis=1) for s in sums]
                total = [s[:, -1:] for s in left]
                right = [t - s for t, s in zip(total, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
                gain = np.where((left[2] >= least) & (right[2] >= least), gain, 0)[:, : len(cuts[j])]
                k = gain.argmax(axis=1)
                top = gain[np.arange(here), k]
                for i in np.flatnonzero(top > best):
                    best[i], f_[first + i], c_[first + i] = top[i], j, cuts[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), f_[node]] > c_[node])
        at = node - inner
        values = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        out += values[at]
        feature.append(f_), cut.append(c_), leaf.append(values)
    return Forest(depth, np.array(feature), np.array(cut), np.array(leaf), bias)


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Forest:
    """Fits on the labelled rows of `measured` (doc_id, statistics), about `most_rows` at most; null labels are left out, a doc_id with
    several labels or texts counts once for each, and equal rows count once."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label"))
    joined = measured.select("doc_id", "statistics").join(known, "doc_id")
    total = joined.count()
    if total > most_rows:  # by hash of the whole row, so that what reaches the driver grows neither with the tables nor with a repeated doc_id
        joined = joined.where(F.pmod(F.xxhash64("doc_id", "statistics", "__label"), F.lit(1 << 30)) < int((1 << 30) * most_rows / total))
    rows = sorted(joined.distinct().collect(), key=lambda r: (r["doc_id"], r["__label"], r["statistics"]))
    x = np.array([r["statistics"] for r in rows], np.float32).reshape(-1, len(FEATURES))
    return grow(x, np.array([r["__label"] for r in rows], float))


@lean
def _score(batches, forest: Forest, names: list[str]):
    for batch in batches:
        x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, len(FEATURES))
        score = np.concatenate([forest.score(x[a : a + 2048]) for a in range(0, len(x), 2048)] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(score)], [*names, "score"])


def classify(measured: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """The columns `keep` with score, the probability of label 1."""
    schema = T.StructType([*[measured.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    return measured.select(*[F.col(f"`{c}`") for c in keep], "statistics").mapInArrow(partial(_score, forest=forest, names=keep), schema)


def in_training(modulus: int = 5) -> Column:
    return remainder("doc_id", modulus) != 0


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measure(table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    forest = train(measured, table(spark, sf_dir, "labels").where(in_training()))
    scored = classify(measured.withColumn("held_out", ~in_training()), forest, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
