"""Language identification with a string kernel.

The kernel of two texts counts the n-grams of one to three bytes (blended spectrum, presence only) that both hold, normalised by
the texts' own kernels. n-grams are hashed to DIMENSIONS places. Nystroem features are the kernel values with a set of landmark
texts, whitened by the landmarks' own kernel matrix; one-versus-rest ridge regression on them gives a weight vector for each
language. As the kernel is a dot product of presence vectors, landmarks, whitening and weights fold into one matrix of
DIMENSIONS x languages, and a batch of texts is scored by one matrix product.

The model is fitted on about `per_language` rows of each language, chosen by hash, and on about SAMPLE_BYTES of text at most. Everything else
reads whole texts of all rows, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, held, lean, materialize, remainder, slices, table

DIMENSIONS = 8192
BATCH_BYTES = 2_000_000
BATCH_ROWS = 512
SAMPLE_BYTES = 32_000_000
BROADCAST_LANGUAGES = 100_000  # shares of more languages are joined by a shuffle
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _fold() -> np.ndarray:
    """Bytes as the kernel sees them: ASCII letters in lower case, digits as one, control characters as a space."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[:32] = 32
    return fold


FOLD = _fold()


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace") if c > "\x7f")


def presence(texts: list[bytes], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each text: 1 where one of its n-grams is, scaled to length one. An empty text has a row of zeros."""
    out = np.zeros((len(texts), dimensions), np.float32)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = FOLD[np.frombuffer(b"".join(texts), np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * dimensions
    flat = out.reshape(-1)
    gram = codes.copy()
    for n in range(3):
        if n:
            gram = gram[:-1] * np.uint32(256) + codes[n:]
            inside = row[: len(gram)] == row[n:]
            at = row[: len(gram)][inside]
            values = gram[inside]
        else:
            at, values = row, gram
        place = ((values + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - (dimensions.bit_length() - 1))
        flat[at + place.astype(np.int64)] = 1
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    matrix: np.ndarray  # DIMENSIONS x languages
    sharpness: float

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure that is, from 0 to 1; `und` and 0 for a text without a letter."""
        margin = presence(texts, len(self.matrix)) @ self.matrix * self.sharpness
        margin -= margin.max(axis=1, keepdims=True)
        share = np.exp(margin)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        known = np.array([has_letter(t) for t in texts], bool)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
        return names, np.where(known, share[np.arange(len(texts)), best], 0.0)


def fit(texts: list[bytes], languages: list[str], landmarks: int = 24, ridge: float = 1e-2, sharpness: float = 4.0) -> Model | None:
    """Nystroem kernel ridge regression; `landmarks` of each language, the first of its texts. None without a text."""
    pairs = [(t, y) for t, y in zip(texts, languages, strict=True) if has_letter(t)]
    if not pairs:
        return None
    texts, labels = [t for t, _ in pairs], np.array([y for _, y in pairs])
    names = sorted(set(labels.tolist()))
    marks = presence([texts[i] for y in names for i in np.flatnonzero(labels == y)[:landmarks]]).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    whiten = marks.T @ (vectors[:, keep] / np.sqrt(values[keep]))  # DIMENSIONS x rank
    gram, cross, count = np.zeros((whiten.shape[1],) * 2), np.zeros((whiten.shape[1], len(names))), np.zeros(len(names))
    goal = np.where(labels[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([len(labels) / (len(names) * (labels == y).sum()) for y in labels])
    for a, b in slices([len(t) for t in texts], BATCH_BYTES, BATCH_ROWS):
        features = presence(texts[a:b]).astype(np.float64) @ whiten
        gram += (features * weight[a:b, None]).T @ features
        cross += (features * weight[a:b, None]).T @ goal[a:b]
        count += goal[a:b].sum(axis=0)
    weights = np.linalg.solve(gram + ridge * len(labels) / len(names) * 0.1 * np.eye(len(gram)), cross)
    return Model(names, (whiten @ weights).astype(np.float32), sharpness)


def training_rows(docs: DataFrame, training: Column, per_language: int) -> tuple[list[bytes], list[str]]:
    """About `per_language` distinct texts of each language and SAMPLE_BYTES of text at most (by expectation), among the rows where
    `training` holds: those whose hash lies under a share of all hashes that follows from the language's count of rows and bytes.

    Counts are sums by language, so a hot one gathers nowhere; each row decides for itself, and no ids travel."""
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total = counts.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.col("bytes") * F.least(F.lit(1.0), per_language / F.col("n"))).alias("taken")).first()
    fewer = min(1.0, SAMPLE_BYTES / total["taken"]) if total["taken"] else 1.0
    shares = counts.select(F.col("lang").alias("l"), (F.least(F.lit(1.0), per_language / F.col("n")) * fewer * float(1 << 30)).alias("share"))
    shares = materialize(shares, "shares")  # a row for each language
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_LANGUAGES else shares
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = usable.join(shares, F.col("lang") == F.col("l")).where(place < F.col("share")).select("doc_id", "lang", "text").distinct()
    found = sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return [r["text"].encode() for r in found], [r["lang"] for r in found]


@lean
def _predict(batches, model: Model | None, names: list[str]):
    held("kernel", lambda: None)  # what a worker kept for another operator goes
    for batch in batches:
        texts = as_bytes(batch.column(len(names)))
        for a, b in slices([len(t) for t in texts], BATCH_BYTES, BATCH_ROWS):
            found, score = model.predict(texts[a:b]) if model else ([UNDETERMINED] * (b - a), np.zeros(b - a))
            kept = [batch.column(i).slice(a, b - a) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))], [*names, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred and score. Null, empty or letterless texts: `und`, 0. Without a model (no
    usable training row) every row is `und`. Rows with the same doc_id are scored apart."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    columns = [F.col(f"`{c}`") for c in keep]
    return docs.select(*columns, F.col(f"`{text}`").alias("__text")).mapInArrow(partial(_predict, model=model, names=keep), schema)


PER_LANGUAGE = 600


def train(docs: DataFrame, training: Column | None = None, per_language: int = PER_LANGUAGE) -> Model | None:
    return fit(*training_rows(docs, F.lit(True) if training is None else training, per_language))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = train(docs, ~held_out)
    found = identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
