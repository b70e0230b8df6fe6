"""Best-fit packing of tokenised documents into sequences of bounded length.

Every piece of a document has a demand vector (tokens, documents, attention cost): (n, 1, n * n). Bins have a capacity in each
of the three; a piece goes to an open bin that has room in all three, chosen by the weighted norm of what would be left
("norm", vector best fit) or by the weighted dot product of demand and residual ("dot"); longest pieces first.

Pieces of the same length have the same vector, so the choice is made once for a length and a kind of bin, with multiplicities:
the driver sees a histogram of at most `capacity` lengths, however many documents there are, and makes a plan of a few thousand
placements. Executors then rank the pieces of each length and look their places up in the plan. A hot length is ranked in
salted parts, so that no task holds more than about ROWS_PER_PART pieces.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, held, lean, materialize, table

ROWS_PER_PART = 250_000
CACHE = 250_000
#: The pre-tokeniser's pattern and the one special token of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


# --------------------------------------------------------------------------------------------------------- tokenising
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCache(dict):
    """Ids of a chunk of text, as little-endian uint32. A chunk follows one space, unless it begins with a line feed."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self.encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pack(self, text: str) -> bytes:
        return np.asarray(self.encode(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.pack(chunk if chunk[:1] == "\n" else " " + chunk)
        if len(self) < CACHE and len(chunk) < 64:
            self[chunk] = ids
        return ids

    def whole(self, text: str) -> bytes:
        """Ids of a text. Where all white space is single spaces or line feeds between words, a space always opens a token of
        the pattern and a line feed is one, so chunks can be encoded apart; other texts are encoded as they are."""
        if SPECIAL in text:
            from tokenizers import Tokenizer

            if "special" not in self.__dict__:
                self.special = Tokenizer.from_file(self.path)
            return np.asarray(self.special.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.replace("\n", " ") != " ".join(text.split()):
            return self.pack(text)
        first, *chunks = text.replace("\n", " \n").split(" ")
        return self.pack(first) + b"".join(map(self.__getitem__, chunks))


@lean
def _pieces(batches, path: str, end: int, capacity: int):
    cache = held(f"chunks of {path}", lambda: ChunkCache(path))
    tail, width = np.asarray([end], "<u4").tobytes(), 4 * capacity
    for batch in batches:
        if len(cache) >= CACHE:
            cache.clear()
        source, piece, start, length, crc = [], [], [], [], []
        for i, raw in enumerate(as_bytes(batch.column(1))):
            ids = cache.whole(raw.decode("utf-8", "replace")) + tail
            cuts = [0, *range(len(ids) % width or width, len(ids), width), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                source.append(i)
                piece.append(k)
                start.append(a // 4)
                length.append((b - a) // 4)
                crc.append(zlib.crc32(ids[a:b]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def tokenize(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text counts as empty and yields the end id alone.

    A document over `capacity` ids is cut into pieces of that many; its first piece takes the remainder. Rows with the same
    doc_id are separate documents. `tokenizer` is the path of a byte-level BPE file on every node.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    run = partial(_pieces, path=tokenizer, end=end, capacity=capacity)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ------------------------------------------------------------------------------------------------------------ the plan
@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weights of the three dimensions. The defaults for documents and attention don't bind."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(histogram: dict[int, int], limits: Limits) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset), sorted by length and rank: the rank-th piece of a length goes
    to bin first_bin + (rank - first_rank) // per_bin, behind (rank - first_rank) % per_bin pieces of its own length."""
    cap = limits.vector()
    if limits.rule not in ("norm", "dot"):
        raise ValueError("rule: norm or dot")
    weights = np.asarray(limits.weights, float)
    residual = np.zeros((0, 3), np.int64)  # of each kind of open bin
    count, first = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, bins = [], 0
    for n in sorted(histogram, reverse=True):
        left, rank = histogram[n], 0
        need = np.array([n, 1, n * n], np.int64)
        if n < 0 or (need > cap).any():
            raise ValueError(f"a piece of {n} tokens fits no bin")
        while left:
            room = np.flatnonzero((residual >= need).all(axis=1))
            if len(room):
                if limits.rule == "norm":
                    score = ((((residual[room] - need) / cap) ** 2) * weights).sum(axis=1)
                else:
                    score = -((residual[room] / cap) * (need / cap) * weights).sum(axis=1)
                at = int(room[np.argmin(score)])
                state, have, base = residual[at].copy(), int(count[at]), int(first[at])
            else:
                at, state, have, base = -1, cap.copy(), left, bins
            fit = int((state // np.maximum(need, 1))[need > 0].min())
            each, take = (fit, min(have, left // fit)) if left >= fit else (left, 1)
            rows.append((n, rank, base, each, limits.tokens - int(state[0])))
            rank, left = rank + take * each, left - take * each
            if at < 0:
                bins += take
            else:  # the bins that were not used stay as they are
                count[at], first[at] = have - take, base + take
            residual = np.vstack([residual, state - each * need])
            count, first = np.append(count, take), np.append(first, base)
            keep = (count > 0) & (residual[:, 0] > 0) & (residual[:, 1] > 0)
            residual, count, first = residual[keep], count[keep], first[keep]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches, steps: np.ndarray, names: list[str]):
    key = steps[:, 0] * (1 << 44) + steps[:, 1]
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        length = columns["__pk_length"].to_numpy(zero_copy_only=False)
        rank = columns["__pk_rank"].to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
        _, start, base, each, offset = steps[at].T
        bin_, behind = np.divmod(rank - start, each)
        arrays = [columns[name] for name in names] + [pa.array(base + bin_, pa.int64()), pa.array(offset + behind * length, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, limits: Limits = Limits(), length: str = "length") -> DataFrame:
    """The rows of `pieces` with sequence_id and offset (columns of these names are replaced). A null length counts as 0 and
    takes no tokens, but a place among the documents of a bin. Pieces of equal length may stand in any order."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*names, F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("__pk_length"))
    histogram = {r[0]: r[1] for r in rows.groupBy("__pk_length").count().collect()}  # at most limits.tokens + 1 rows
    steps = plan(histogram, limits)
    parts = max(1, -(-max(histogram.values(), default=1) // ROWS_PER_PART))
    rows = rows.withColumn("__pk_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(parts)))
    keys = ["__pk_length", "__pk_part"]
    before = Window.partitionBy("__pk_length").orderBy("__pk_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count("*").alias("__pk_n")).select(*keys, F.coalesce(F.sum("__pk_n").over(before), F.lit(0)).alias("__pk_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`") for c in names])) - 1
    ranked = rows.withColumn("__pk_in", inside).join(starts, keys).withColumn("__pk_rank", (F.col("__pk_in") + F.col("__pk_before")).cast("long"))
    schema = T.StructType([*[pieces.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*[f"`{c}`" for c in names], "__pk_length", "__pk_rank").mapInArrow(partial(_place, steps=steps, names=names), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Tokenises and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(materialize(tokenize(docs, tokenizer, end, limits.tokens), "pieces"), limits)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
