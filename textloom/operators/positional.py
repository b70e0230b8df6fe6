"""A positional index: compressed postings with places, and phrases and sets of words looked up in it.

Sentences are dealt into blocks by a hash of document and stretch of sentences, so a block has about as many tokens as another, however
long a document or frequent a word is. Within a block each token has a number; the numbers of neighbours differ by one, and one number
is left out between sentences. A word's posting in a block is the ascending list of its numbers, in chunks of CHUNK differences of
variable length behind the first numbers of the chunks. A lookup unpacks the postings of the words of phrases that the block can hold, and
takes all phrases of a length together: places are led along the phrases, sentences are bits of a row for each word. The numbers give
document, sentence and position back by the block's own table, so no sentence is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import materialize

CHUNK = 128
TOKENS = 500_000  # of a block, about
STRETCH = 32  # sentences of a document that stay together
MOST_PHRASES = 500_000  # looked up in one pass
CELLS = 1 << 20  # words of 64 bits that are compared at once
SCHEMA = "block long, word string, n long, spots binary, docs binary, sposs binary, starts binary"


# ------------------------------------------------------------------------------------------------------------- packing
def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up, seven bits a byte, the last byte of each below 128."""
    values = values.astype(np.uint64)
    most = int(values.max(initial=0))
    if most < 128:
        return values.astype(np.uint8).tobytes()
    long = np.flatnonzero(values >= 128)  # the others are a byte each
    rest = values[long]
    sizes = np.ones(len(long), np.int64)
    for k in range(1, -(-most.bit_length() // 7)):
        sizes += rest >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(sizes - 1)
    out = np.empty(len(values) + int(ends[-1]), np.uint8)
    short = np.ones(len(out), bool)
    begins = long + ends - sizes + 1
    for k in range(int(sizes.max())):
        some = np.flatnonzero(sizes > k)
        more = np.where(sizes[some] > k + 1, 128, 0).astype(np.uint64)
        out[begins[some] + k] = ((rest[some] >> np.uint64(7 * k)) & np.uint64(127)) | more
        short[begins[some] + k] = False
    out[short] = values[values < 128]
    return out.tobytes()


def unpack_small(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    begins = np.append(0, ends[:-1] + 1)
    out = (raw[begins] & 127).astype(np.int64)
    some, k = np.flatnonzero(ends > begins), 0
    while len(some):  # those of more than k + 1 bytes
        k += 1
        out[some] |= (raw[begins[some] + k] & 127).astype(np.int64) << (7 * k)
        some = some[ends[some] > begins[some] + k]
    return out


def pack(values: np.ndarray) -> bytes:
    """Ascending whole numbers: how many chunks, their first numbers, where they end, and their differences."""
    chunks = [values[i : i + CHUNK] for i in range(0, len(values), CHUNK)]
    bodies = [pack_small(np.diff(c)) for c in chunks]
    heads = np.array([c[0] for c in chunks], "<i8")
    ends = np.cumsum([len(b) for b in bodies], dtype="<u4") if bodies else np.zeros(0, "<u4")
    return np.array([len(chunks)], "<u4").tobytes() + heads.tobytes() + ends.tobytes() + b"".join(bodies)


def pack_all(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """pack() of each of many lists that stand one behind another, their differences made at once."""
    if not len(values):
        return []
    begins = np.cumsum(counts) - counts
    steps = np.diff(values, prepend=0)
    first = (np.arange(len(values)) - np.repeat(begins, counts)) % CHUNK == 0
    body = pack_small(steps[~first])
    upto = np.r_[0, np.flatnonzero(np.frombuffer(body, np.uint8) < 128) + 1]  # where each difference ends
    upto = upto[np.cumsum(~first)]
    chunks = -(-counts // CHUNK)
    last = np.cumsum(chunks)
    base = np.where(begins > 0, upto[begins - 1], 0)
    ends = upto[np.r_[np.flatnonzero(first)[1:] - 1, len(values) - 1]] - np.repeat(base, chunks)
    heads, ends, number = values[first].astype("<i8").tobytes(), ends.astype("<u4").tobytes(), chunks.astype("<u4").tobytes()
    stops = upto[begins + counts - 1]
    rows = zip((last - chunks).tolist(), last.tolist(), base.tolist(), stops.tolist(), strict=True)
    return [number[4 * i : 4 * i + 4] + heads[8 * a : 8 * b] + ends[4 * a : 4 * b] + body[c:d] for i, (a, b, c, d) in enumerate(rows)]


class Posting:
    """A packed list, of which chunks are unpacked when they are needed."""

    def __init__(self, packed: bytes, n: int):
        k = int(np.frombuffer(packed, "<u4", 1)[0])
        self.n, self.packed, self.body = n, packed, 4 + 12 * k
        self.heads = np.frombuffer(packed, "<i8", k, 4)
        self.ends = np.frombuffer(packed, "<u4", k, 4 + 8 * k)
        self.open: dict[int, np.ndarray] = {}

    def chunk(self, i: int) -> np.ndarray:
        if i not in self.open:
            begin = int(self.ends[i - 1]) if i else 0
            steps = unpack_small(self.packed[self.body + begin : self.body + int(self.ends[i])])
            self.open[i] = self.heads[i] + np.append(0, np.cumsum(steps))
        return self.open[i]

    def all(self) -> np.ndarray:
        if self.n == 1:
            return self.heads
        return np.concatenate([self.chunk(i) for i in range(len(self.heads))])

    def has(self, wanted: np.ndarray) -> np.ndarray:
        """Which of ascending numbers are in the list. Skips from chunk to chunk by the heads."""
        at = np.searchsorted(self.heads, wanted, side="right") - 1
        found = np.zeros(len(wanted), bool)
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
        for begin, end in zip(begins, np.append(begins[1:], len(at)) if len(at) else [], strict=True):
            if at[begin] >= 0:
                values = self.chunk(int(at[begin]))
                place = np.minimum(np.searchsorted(values, wanted[begin:end]), len(values) - 1)
                found[begin:end] = values[place] == wanted[begin:end]
        return found


# -------------------------------------------------------------------------------------------------------------- build
def _build(block: pa.Table) -> pa.Table:
    """The postings of a block of sentences (block, doc_id, spos, words), and its table of sentences in a row without a word."""
    docs, sposs = block.column("doc_id").to_numpy(), block.column("spos").to_numpy()
    order = np.lexsort((sposs, docs))
    words = block.column("words").combine_chunks().take(pa.array(order))
    lengths = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    numbers = np.repeat(starts, lengths) + np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    by_word = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(flat.dictionary))
    lists = pack_all(numbers[by_word], counts)
    number = block.column("block")[0].as_py()
    raw = lambda a: np.ascontiguousarray(a, "<i8").tobytes()
    k = len(lists)
    return pa.table({
        "block": pa.array([number] * (k + 1), pa.int64()),
        "word": pa.array([*flat.dictionary.to_pylist(), None], pa.string()),
        "n": pa.array([*counts.tolist(), len(order)], pa.int64()),
        "spots": pa.array([*lists, None], pa.binary()),
        "docs": pa.array([None] * k + [raw(docs[order])], pa.binary()),
        "sposs": pa.array([None] * k + [raw(sposs[order])], pa.binary()),
        "starts": pa.array([None] * k + [raw(starts)], pa.binary()),
    })


@dataclass
class PositionalIndex:
    """blocks: block, word (null: the block's table of sentences), n (places), spots; docs, sposs and starts of the sentences."""

    blocks: DataFrame

    @classmethod
    def build(cls, sents: DataFrame, tokens: int = TOKENS) -> PositionalIndex:
        """From doc_id (long, not null), spos and words; one shuffle of the sentences."""
        rows = sents.select("doc_id", F.col("spos").cast("long").alias("spos"), "words")
        total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
        block = F.pmod(F.xxhash64("doc_id", F.floor(F.col("spos") / STRETCH)), F.lit(max(1, -(-total // tokens))))
        built = rows.withColumn("block", block).groupBy("block").applyInArrow(_build, SCHEMA)
        return cls(materialize(built, "positional"))

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(spark.read.schema(SCHEMA).parquet(path))

    def _look_up(self, sets: DataFrame, find: Callable, columns: str) -> DataFrame:
        """find() over the blocks, for sets (id, words) in passes of MOST_PHRASES; a pass reads the postings of its words alone."""
        sets = materialize(sets.select("id", "words").where(F.size("words") > 0), "phrases")
        passes = max(1, -(-sets.count() // MOST_PHRASES))
        found = []
        for i in range(passes):
            some = sets if passes == 1 else sets.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
            wanted = Wanted.of(some.toArrow())  # about MOST_PHRASES at most
            words = F.broadcast(some.select(F.explode("words").alias("word")).distinct())
            needed = self.blocks.join(words, "word", "left_semi").unionByName(self.blocks.where("word is null"))
            found.append(needed.groupBy("block").applyInArrow(_in_block(wanted, find), columns))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def phrases(self, phrases: DataFrame) -> DataFrame:
        """id, doc_id, spos, pos: all places at which the words of phrases (id long, words array<string>) stand one behind another in a
        sentence. A phrase without words stands nowhere; words are compared as they are."""
        return self._look_up(phrases, _phrases, "id long, doc_id long, spos long, pos long")

    def sentences(self, sets: DataFrame) -> DataFrame:
        """id, doc_id, spos of the sentences that hold all words of sets (id long, words array<string>), in any order."""
        return self._look_up(sets, _all_words, "id long, doc_id long, spos long")

    def sentence_counts(self, sets: DataFrame) -> DataFrame:
        """id, n: how many sentences sentences() would give, if any; a row for each block and set is what is shuffled."""
        return self._look_up(sets, _counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass
class Wanted:
    """Sets of words as arrays: words are known by their number in vocab, and those of set i are codes[ends[i] : ends[i + 1]]."""

    ids: np.ndarray
    vocab: pa.Array
    codes: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, sets: pa.Table) -> Wanted:
        words = sets.column("words").combine_chunks()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        flat = words.flatten().dictionary_encode("encode")
        ends = np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
        return cls(sets.column("id").to_numpy(), flat.dictionary, flat.indices.to_numpy(), ends)

    def within(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By length: ids of the sets all of whose words are among some, and their words' places in these, a row a set."""
        place = pc.index_in(self.vocab, words, skip_nulls=True).fill_null(-1).to_numpy().astype(np.int64)
        codes = place[self.codes] if len(place) else self.codes.astype(np.int64)
        sizes = np.diff(self.ends)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            table = codes[self.ends[rows][:, None] + np.arange(size)]
            there = (table >= 0).all(axis=1)
            if there.any():
                yield self.ids[rows[there]], table[there]


def _in_block(wanted: Wanted, find: Callable):
    return lambda block: _find_in_block(block, wanted, find)


def _find_in_block(block: pa.Table, wanted: Wanted, find: Callable) -> pa.Table:
    docs = sposs = starts = np.zeros(0, np.int64)
    words, packed, counts = [], [], []
    for word, n, spots, *tables in zip(*[block.column(c).to_pylist() for c in ("word", "n", "spots", "docs", "sposs", "starts")], strict=True):
        if word is None:
            docs, sposs, starts = (np.frombuffer(t, "<i8") for t in tables)
        else:
            words.append(word), packed.append(spots), counts.append(n)
    sets = list(wanted.within(pa.array(words, pa.string())))
    used = np.zeros(len(words), bool)
    for _, table in sets:
        used[table.ravel()] = True
    numbers = [Posting(packed[i], counts[i]).all() for i in np.flatnonzero(used)]
    codes = np.repeat(np.flatnonzero(used), [len(x) for x in numbers])
    numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    found = [x for ids, table in sets for x in find(ids, table, codes, numbers, starts)]
    joined = lambda i: np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64)
    if find is _counts:
        return pa.table({"id": joined(0), "n": joined(1)})
    at = joined(1)
    out = {"id": joined(0), "doc_id": docs[at], "spos": sposs[at]}
    return pa.table(out if find is _all_words else out | {"pos": joined(2)})


def _places(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an ascending array, and which are there."""
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def _phrases(ids: np.ndarray, table: np.ndarray, codes: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, sentence, position) of phrases of one length: all places of words at once are led along the phrases, a word at a time."""
    order = np.argsort(numbers, kind="stable")
    numbers, codes, width = numbers[order], codes[order], int(codes.max(initial=0)) + 1
    at, key, own = np.arange(len(numbers)), np.zeros(len(numbers), np.int64), np.zeros(len(table), np.int64)
    for k in range(table.shape[1]):
        own = own * width + table[:, k]
        heads, own = np.unique(own, return_inverse=True)
        goes = at + k < len(numbers)
        at, key = at[goes], key[goes]
        goes = numbers[at + k] == numbers[at] + k
        at, key = at[goes], key[goes]
        key, goes = _places(key * width + codes[at + k], heads)
        at, key = at[goes], key[goes]
    by = np.argsort(own, kind="stable")
    begins, ends = np.searchsorted(own[by], key, "left"), np.searchsorted(own[by], key, "right")
    several = ends - begins  # sets of the same words
    which = np.repeat(begins - np.cumsum(several) + several, several) + np.arange(several.sum())
    begin = np.repeat(numbers[at], several)
    sentence = np.searchsorted(starts, begin, side="right") - 1
    yield ids[by[which]], sentence, begin - starts[sentence]


def _held(ids: np.ndarray, table: np.ndarray, codes: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, bits) of sets of one length in slices: a bit for each sentence of the block that holds all words of a set. A word's bits
    are those of the sentences that hold it."""
    words, table = np.unique(table, return_inverse=True)
    table = table.reshape(len(ids), -1)
    row, goes = _places(codes, words)
    sentence = np.searchsorted(starts, numbers[goes], side="right") - 1
    bits = np.zeros((len(words), -(-len(starts) // 64) * 8), np.uint8)
    np.bitwise_or.at(bits, (row[goes], sentence >> 3), (128 >> (sentence & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    step = max(1, CELLS // max(1, bits.shape[1]))
    for a in range(0, len(ids), step):
        some = bits[table[a : a + step, 0]]
        for k in range(1, table.shape[1]):
            some &= bits[table[a : a + step, k]]
        yield ids[a : a + step], some


def _all_words(ids: np.ndarray, table: np.ndarray, *block: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, sentence) of sets of one length."""
    for some, bits in _held(ids, table, *block):
        row = np.flatnonzero(bits.any(axis=1))
        for i in row:
            sentence = np.flatnonzero(np.unpackbits(bits[i].view(np.uint8)))
            yield np.full(len(sentence), some[i], np.int64), sentence


def _counts(ids: np.ndarray, table: np.ndarray, *block: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, sentences) of sets of one length that are in a sentence."""
    for some, bits in _held(ids, table, *block):
        n = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        yield some[n > 0], n[n > 0]
