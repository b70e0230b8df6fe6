"""SentencePiece encoding and decoding over a relational lattice.

A text is written with meta symbols for spaces and one before it, and is cut into words between any two characters that no piece holds side
by side. As no piece holds a meta symbol behind another character, that is at each run of spaces, and before most punctuation. Pieces
don't cross these cuts, so the best segmentation of a text is that of its words, and each distinct word is segmented once.

Lattice. Substrings of a word, up to the longest piece, are exploded and equi-joined with the table of pieces; single characters
that aren't a piece stay as unknown edges. Edges are grouped by word, and a higher-order aggregate folds them in order of their
ends into the best score and edge of each place (Viterbi); a second one walks back. Of equal scores the longer last piece wins.
Unknown characters become the pieces of their UTF-8 bytes. What the fold holds of a place is of fixed size, so a word may have any length.

Documents get the ids of the most frequent words (at most HEAD words and HEAD_BYTES bytes, which every task holds) where they are read.
If there are other words, their ids come by a join on the word, and the documents that hold some are filled in from that. The pieces'
scores come from the model file, whatever kind of model wrote it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, lean, let, materialize, parts, table, trim
from .language_model import least_of_head

META = "▁"
HEAD = 4_000_000  # words
HEAD_BYTES = 160_000_000  # of words, ids and what finds them, at most
WRITTEN = 4 << 20  # bytes of a head that are written at once
HEAD_WORD = 10_000  # characters; longer words aren't in the head
READ = 4 << 20  # bytes of texts that are read at once
CHUNKS = 4_000_000  # words that are looked up at once
AT_ONCE = 500_000  # characters that are cut at once
WORDS_PER_PART = 40_000
TEXT_BLOCK = 256  # characters of a long word that are taken at once
LIST_BLOCK = 64
UNKNOWN = 1 << 22  # and more: code points of characters that aren't pieces
GAP = 0xFFFF  # stands for a word that the head lacks; ids have 16 bits where they are bytes
GAP_BYTES = GAP.to_bytes(2, "little")
#: Kinds of pieces in a model file.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


class Model:
    """Pieces of a model file: text, id and score, the ids of bytes, and which characters stand side by side in a piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces, self.bytes, self.text = [], {}, []
        for i, p in enumerate(model.pieces):
            self.text.append("" if p.type not in (NORMAL, USER_DEFINED) else p.piece)
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type in (NORMAL, USER_DEFINED):
                self.pieces.append((p.piece, i, float(p.score)))
        self.unknown = min(s for _, _, s in self.pieces) - 10
        if any(META in p.lstrip(META) or "\n" in p for p, _, _ in self.pieces):
            raise ValueError("the model has pieces across words")
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if self.longest > 127 or len(self.text) >= UNKNOWN:
            raise ValueError("the model has pieces of more than 127 characters, or too many")
        self.beside = {a + b for p, _, _ in self.pieces for a, b in zip(p, p[1:], strict=False)}

    def spelled(self) -> list[bytes]:
        """By id, the bytes that a piece stands for; of other pieces none."""
        meta = META.encode()
        by_id = {i: p.encode().replace(meta, b" ") for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in self.bytes.items()}
        return [by_id.get(i, b"") for i in range(len(self.text))]


class Cutter:
    """Cuts texts into words, many at a time: characters that pieces hold are numbered, and a bit for each pair of them tells whether they stand
    side by side in a piece."""

    def __init__(self, beside: set[str]):
        letters = sorted({c for pair in beside for c in pair})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        joined = np.array([self.number[ord(a)] * self.width + self.number[ord(b)] for a, b in beside], np.int64)
        self.joined = np.zeros(self.width**2 // 8 + 1, np.uint8)
        np.bitwise_or.at(self.joined, joined >> 3, (1 << (joined & 7)).astype(np.uint8))

    def opens(self, text: str) -> np.ndarray:
        """Whether a word begins at each character."""
        out = np.ones(len(text), bool)
        for a in range(0, len(text), AT_ONCE):
            part = text[max(a - 1, 0) : a + AT_ONCE]
            codes = self.number[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            pairs = codes[:-1].astype(np.int64) * self.width + codes[1:]
            out[max(a, 1) : a + AT_ONCE] = (self.joined[pairs >> 3] >> (pairs & 7).astype(np.uint8) & 1) == 0
        return out

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in order, as bytes, and how many there are up to the end of each text."""
        whole = "".join(texts)
        opens, ends = self.opens(whole), np.cumsum([len(t) for t in texts], dtype=np.int64)
        opens[ends[ends < len(whole)]] = True  # each text opens a word
        starts = np.flatnonzero(opens)
        upto = np.searchsorted(starts, ends)
        raw = whole.encode("utf-8", "surrogatepass")
        if len(raw) > len(whole):
            starts = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)[starts]
        offsets = np.append(starts, len(raw))
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), upto

    def cut(self, texts: list[str]) -> list[list[str]]:
        """Words of each text, which joined give the text; none of an empty one."""
        words, upto = self.words(texts)
        words = [w.decode("utf-8", "surrogatepass") for w in words.to_pylist()]
        return [words[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)] if texts else []


def meta(text: str) -> str:
    """A text with meta symbols for spaces and one before it; an empty text stays empty."""
    return META + text.replace(" ", META) if text else ""


def cut(text: str, beside: set[str]) -> list[str]:
    """Words of a text, which joined give the text with meta symbols for spaces and one before it; none of an empty text."""
    return Cutter(beside).cut([meta(text)])[0]


def _read(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@lean
def _count(batches, beside: set[str]):
    cutter = Cutter(beside)
    for batch in batches:
        for part in parts(batch, 0, READ):
            found = cutter.words([meta(_read(r)) for r in as_bytes(part.column(0))])[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])


def count_words(texts: DataFrame, model: Model) -> DataFrame:
    """wid, word, n over the single column of texts."""
    found = texts.mapInArrow(partial(_count, beside=model.beside), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(found.withColumn("wid", F.monotonically_increasing_id()), "words")


def _int_at(done: Column, block: Column, place: Column) -> Column:
    """Of a list of _pushed()."""
    n = F.shiftright(F.octet_length(done), 2)
    return F.when(place < n, F.conv(F.hex(F.substring(done, 4 * place + 1, F.lit(4))), 16, 10).cast("int")).otherwise(F.get(block, place - n))


def _pushed(done: Column, block: Column, value: Column) -> tuple[Column, Column]:
    """A growing list of integers, the last in an array and all before as bytes, four each: an aggregate copies arrays in its state at
    each step, but not bytes."""
    full = F.size(block) >= LIST_BLOCK
    packed = F.unhex(F.array_join(F.transform(block, lambda i: F.lpad(F.hex(i), 8, "0")), ""))
    return F.when(full, F.concat(done, packed)).otherwise(done), F.when(full, F.array(value)).otherwise(F.array_append(block, value))


def _best_path(edges: Column, longest: int) -> Column:
    """Edges (e, s, score, code) sorted by end and start, as the codes of the best path's edges in order.

    The state holds the end and best score reached, the best edge to it (length and code in one number), the scores of at least the
    `longest` ends before, the last first, and the best edges of all ends before."""
    none, ints = F.lit(b""), F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("e"), F.lit(0.0).alias("best"), F.lit(0).alias("edge"), F.array().cast("array<double>").alias("recent"), none.alias("done"), ints.alias("block"))

    def step(acc: Column, x: Column) -> Column:
        score = F.when(x["s"] == acc["e"], acc["best"]).otherwise(F.get(acc["recent"], acc["e"] - 1 - x["s"])) + x["score"]
        edge = F.shiftleft(x["e"] - x["s"], 24) + x["code"]
        recent = F.when(F.size(acc["recent"]) >= 2 * longest, F.slice(acc["recent"], 1, longest)).otherwise(acc["recent"])
        done, block = _pushed(acc["done"], acc["block"], acc["edge"])
        further = F.struct(x["e"].alias("e"), score.alias("best"), edge.alias("edge"), F.array_prepend(recent, acc["best"]).alias("recent"), done.alias("done"), block.alias("block"))
        better = F.struct(acc["e"].alias("e"), score.alias("best"), edge.alias("edge"), acc["recent"].alias("recent"), acc["done"].alias("done"), acc["block"].alias("block"))
        return F.when(x["e"] > acc["e"], further).when(score > acc["best"], better).otherwise(acc)

    def walk(acc: Column) -> Column:
        first = F.struct(acc["e"].alias("at"), none.alias("done"), ints.alias("block"))

        def up(state: Column, place: Column) -> Column:
            edge = F.when(place == acc["e"], acc["edge"]).otherwise(_int_at(acc["done"], acc["block"], place))
            done, block = _pushed(state["done"], state["block"], edge.bitwiseAND(F.lit((1 << 24) - 1)))
            return F.when(place == state["at"], F.struct((place - F.shiftright(edge, 24)).alias("at"), done.alias("done"), block.alias("block"))).otherwise(state)

        def codes(state: Column) -> Column:
            before = F.transform(F.sequence(F.shiftright(F.octet_length(state["done"]), 2) - 1, F.lit(0), F.lit(-1)), lambda k: _int_at(state["done"], state["block"], k))
            return F.concat(F.reverse(state["block"]), F.when(F.octet_length(state["done"]) > 0, before).otherwise(ints))

        return F.aggregate(F.sequence(acc["e"], F.lit(1), F.lit(-1)), first, up, codes)

    return F.aggregate(edges, start, step, walk)


def lattice(words: DataFrame, model: Model, parts: int) -> DataFrame:
    """wid, s, e, piece, word: all substrings, up to the longest piece, of words (wid long, word), spread over `parts` by wid. A long word is
    taken in blocks, and no row but its first character's carries it."""
    rows = words.select("wid", "word").repartition(parts, "wid")
    blocks = rows.select("wid", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(TEXT_BLOCK))).alias("b"))
    first = F.when(F.col("b") == 0, F.col("word")).alias("word")
    blocks = blocks.select("wid", first, "b", F.least(F.length("word") - F.col("b"), F.lit(TEXT_BLOCK)).alias("n"), F.substring("word", F.col("b") + 1, F.lit(TEXT_BLOCK + model.longest)).alias("part"))
    places = blocks.select("wid", "word", "b", "part", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    first = F.when(F.col("i") == 1, F.col("word")).alias("word")
    tails = places.select("wid", first, (F.col("b") + F.col("i") - 1).alias("s"), F.substring("part", F.col("i"), F.lit(model.longest)).alias("tail"))
    sized = tails.select("wid", "word", "s", "tail", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("l"))
    first = F.when(F.col("l") == 1, F.col("word")).alias("word")
    return sized.select("wid", "s", (F.col("s") + F.col("l")).alias("e"), F.substring("tail", F.lit(1), F.col("l")).alias("piece"), first)


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """word and ids (array<int>) of distinct words (wid long, word) of one character or more."""
    spark = words.sparkSession
    pieces = spark.createDataFrame(model.pieces, "piece string, id int, score double")  # of the model's fixed size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WORDS_PER_PART))
    edges = lattice(words, model, parts).join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | (F.col("e") - F.col("s") == 1))
    unknown = UNKNOWN + F.ascii("piece")  # a character that isn't a piece, by its code point
    edge = F.struct("e", "s", F.coalesce("score", F.lit(model.unknown)).alias("score"), F.coalesce("id", unknown).alias("code"))
    path = edges.groupBy("wid").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.first("word", True).alias("word"))
    path = path.select("word", _best_path(F.col("edges"), model.longest).alias("path"))
    table_ = F.array(*[F.lit(model.bytes[b]) for b in range(256)]) if len(model.bytes) == 256 else F.array(*[F.lit(0)] * 256)

    def bytes_of(code: Column) -> Column:
        """Pieces of the UTF-8 bytes of a code point."""
        c = code - UNKNOWN
        more = lambda k: F.shiftright(c, 6 * k).bitwiseAND(F.lit(63)) + 128
        utf8 = F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(F.shiftright(c, 6) + 192, more(0)))
        utf8 = utf8.when(c < 0x10000, F.array(F.shiftright(c, 12) + 224, more(1), more(0))).otherwise(F.array(F.shiftright(c, 18) + 240, more(2), more(1), more(0)))
        return F.transform(utf8, lambda b: F.get(table_, b))

    known = F.col("path")
    ids = F.when(F.exists(known, lambda i: i >= UNKNOWN), F.flatten(F.transform(known, lambda i: F.when(i < UNKNOWN, F.array(i)).otherwise(bytes_of(i))))).otherwise(known)
    return path.select("word", ids.alias("ids"))


def decode(ids: Column, model: Model) -> Column:
    """Text of an array of ids: bytes of pieces joined, the meta symbol as a space, without the space before the text."""
    hexes = F.split(F.lit(",".join(b.hex() for b in model.spelled())), ",")
    whole = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")), "UTF-8")
    return F.when(whole.startswith(" "), F.substr(whole, F.lit(2))).otherwise(whole)


def decoded(ids: pa.Array, ends: np.ndarray, spelled: pa.Array) -> Iterator[bytes]:
    """As decode(), of the lists of ids between one end and the next."""
    taken = spelled.take(ids)
    places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1][ends].tolist() if len(ids) else [0] * len(ends)
    whole = memoryview(taken.buffers()[2]) if places[-1] else memoryview(b"")
    for a, b in zip(places, places[1:], strict=False):
        yield bytes(whole[a:b]).removeprefix(b" ")


# ------------------------------------------------------------------------------------------------------------- documents
class Head:
    """Ids of words, in arrays that a task can hold: words by the order of their hashes, each compared in full when it is looked up."""

    def __init__(self, found: pa.Table):
        words = found["word"].combine_chunks().cast(pa.binary())
        hashes = np.concatenate([np.zeros(0, np.uint32), *(_hashes(words.slice(a, 100_000)) for a in range(0, len(words), 100_000))])  # as objects only some at a time
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.words, self.ids = words.take(pa.array(order)), found["ids"].combine_chunks().cast(pa.binary()).take(pa.array(order))

    def written(self) -> Iterator[bytes]:
        """The head as bytes for a file: five lengths, then its parts, each from a multiple of eight on."""
        whole = [memoryview(np.ascontiguousarray(x)).cast("B") for x in (self.hashes, *(_offsets(x).astype(np.int32) for x in (self.words, self.ids)), *(_joined(x) for x in (self.words, self.ids)))]
        yield np.array([len(x) for x in whole], "<i8").tobytes()
        for part in whole:
            for a in range(0, len(part), WRITTEN):
                yield bytes(part[a : a + WRITTEN])
            yield b"\0" * (-len(part) % 8)

    @classmethod
    def mapped(cls, path: str) -> Head:
        """A head in a file, mapped into memory, so that the workers of a machine share it."""
        with pa.memory_map(path) as file:
            held = file.read_buffer()
        at, own = 40, []
        for size in np.frombuffer(held, "<i8", 5).tolist():
            own.append(held.slice(at, size))
            at += size + -size % 8
        head = cls.__new__(cls)
        head.hashes = np.frombuffer(own[0], "<u4")
        head.words, head.ids = (pa.Array.from_buffers(pa.binary(), len(head.hashes), [None, own[k], own[k + 2]]) for k in (1, 2))
        return head

    def ids_of(self, words: pa.Array) -> pa.Array:
        """The ids (little-endian, 16 bits each) of each word (binary), null of a word that isn't there."""
        place = np.full(len(words), -1)
        hashes, last = _hashes(words), len(self.hashes) - 1
        todo = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[todo])
        while len(todo):  # words of equal hash stand side by side
            more = at <= last
            more[more] = self.hashes[at[more]] == hashes[todo[more]]
            todo, at = todo[more], at[more]
            same = pc.equal(self.words.take(pa.array(at)), words.take(pa.array(todo))).to_numpy(zero_copy_only=False).astype(bool)
            place[todo[same]] = at[same]
            todo, at = todo[~same], at[~same] + 1
        return self.ids.take(pa.array(place, mask=place < 0))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """As ids_of()."""
        return self.ids_of(pa.array(words, pa.binary())).to_pylist()


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, as_bytes(words)), np.uint64, len(words)).astype(np.uint32)


def _offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a binary array begins in _joined(), and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1]
    return ends - ends[0]


def _joined(values: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array, joined."""
    if not len(values) or values.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], kind)
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[values.offset] : ends[values.offset + len(values)]]


class Encoder:
    """Ids of texts: each distinct word of some texts is looked up once."""

    def __init__(self, head: Head, beside: set[str]):
        self.head, self.cutter = head, Cutter(beside)

    def read(self, texts: list[str]) -> list[tuple[bytes, list[str]]]:
        """Ids of each text, with GAPs, and the words that belong there."""
        words, upto = self.cutter.words([meta(t) for t in texts])
        own, sizes, lacking = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), CHUNKS):
            coded = words.slice(a, CHUNKS).dictionary_encode()
            found = self.head.ids_of(coded.dictionary.cast(pa.binary()))
            ids = found.fill_null(GAP_BYTES).cast(pa.large_binary()).take(coded.indices)
            own.append(_joined(ids).tobytes())
            sizes.append(np.diff(_offsets(ids)))
            if found.null_count:
                lacking.append(a + np.flatnonzero(found.is_null().take(coded.indices).to_numpy(zero_copy_only=False)))
        whole, places, gaps = b"".join(own), np.cumsum(np.concatenate(sizes)), np.concatenate(lacking)
        rest = [w.decode("utf-8", "surrogatepass") for w in words.take(pa.array(gaps)).to_pylist()]
        ends, rests = [0, *places[upto].tolist()], [0, *np.searchsorted(gaps, upto).tolist()]
        return [(whole[a:b], rest[c:d]) for a, b, c, d in zip(ends, ends[1:], rests, rests[1:], strict=False)]


def _mark(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _finished(batch: pa.RecordBatch, n: int, ids: list[bytes], texts: list[bytes] | None, spelled: pa.Array | None, marks: bool = False) -> list[pa.Array]:
    """Columns of the result: the first n of the batch, ids, and with texts (or marks of them) whether the ids decode to them."""
    flat = pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32))
    ends = np.cumsum([0, *(len(x) // 2 for x in ids)]).astype(np.int32)
    arrays = [*[batch.column(i) for i in range(n)], pa.ListArray.from_arrays(pa.array(ends), flat)]
    if texts is not None:
        same = (lambda d, t: _mark(d) == t) if marks else (lambda d, t: d == t)
        arrays.append(pa.array([same(d, t) for d, t in zip(decoded(flat, ends, spelled), texts, strict=True)], pa.bool_()))
    return arrays


@lean
def _encode(batches, head: str, beside: set[str], names: list[str], spelled: pa.Array | None, gaps: bool):
    """Documents with ids; with `gaps` as bytes with GAPs, and the words that belong there."""
    encoder = Encoder(Head.mapped(SparkFiles.get(head)), beside)
    for batch in batches:
        for part in parts(batch, len(names), READ):  # texts as objects only some at a time
            raws = as_bytes(part.column(len(names)))
            found = encoder.read([_read(r) for r in raws])
            if gaps:
                arrays = [*part.columns[: len(names)], pa.array([_mark(r) for r in raws], pa.binary()), pa.array([ids for ids, _ in found], pa.binary()), pa.array([rest for _, rest in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "mark", "own", "rest"])
            else:
                yield pa.RecordBatch.from_arrays(_finished(part, len(names), [ids for ids, _ in found], raws if spelled is not None else None, spelled), [*names, "ids", *["round_trip"] * (spelled is not None)])


@lean
def _fill(batches, names: list[str], spelled: pa.Array | None):
    """Puts the ids of words (found: by their order) in the place of GAPs."""
    for batch in batches:
        out = []
        for own, found in zip(as_bytes(batch.column(len(names) + 1)), batch.column(len(names) + 2).to_pylist(), strict=True):
            at = np.flatnonzero(np.frombuffer(own, "<u2") == GAP).tolist()
            if at:
                places = [0, *(2 * k + 2 for k in at)]
                own = b"".join([own[a : 2 * k] + bytes(x["ids"]) for a, k, x in zip(places, at, found, strict=False)]) + own[places[-1] :]
            out.append(own)
        texts = as_bytes(batch.column(len(names))) if spelled is not None else None
        yield pa.RecordBatch.from_arrays(_finished(batch, len(names), out, texts, spelled, True), [*names, "ids", *["round_trip"] * (spelled is not None)])


def _packed(ids: Column) -> Column:
    """An array of ids as bytes, little-endian, 16 bits each."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.concat(F.lpad(F.hex(i % 256), 2, "0"), F.lpad(F.hex(F.shiftright(i, 8)), 2, "0"))), ""))


def _share(spark: SparkSession, head: Head) -> str:
    """The name of a file with the head, which Spark brings to each executor once, also to one that joins later, and which all its workers
    map. It is written where the driver keeps the files that it serves, so that there is no second copy, and goes with the application."""
    name = f"head-{uuid.uuid4().hex}"
    path = f"{SparkFiles.getRootDirectory()}/{name}"
    with open(path, "wb") as out:
        out.writelines(head.written())
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, model: Model, keep: list[str], text: str = "text", head: int = HEAD, round_trip: bool = False) -> DataFrame:
    """The columns `keep` with ids (array<int>) of each whole text, one row for each row of docs; a null or empty text has none. With
    `round_trip` also whether the ids decode to the text: each text's ids are decoded as decode() does. A text that holds a
    meta symbol itself doesn't come back."""
    if len(model.text) >= 1 << 16:
        raise ValueError("the model has more than 65535 pieces")
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("body"))
    words = count_words(source.select("body"), model)
    encoded = encode_words(words.select("wid", "word"), model).select("word", _packed(F.col("ids")).alias("ids"))
    encoded = materialize(encoded, "encoded")
    known = frequent(encoded, words, head)
    spelled = pa.array(model.spelled(), pa.large_binary()) if round_trip else None
    n_known, table_ = known.num_rows, Head(known)
    del known
    trim()
    own = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    result = T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("round_trip", T.BooleanType())] * round_trip])
    shared = _share(docs.sparkSession, table_)
    del table_
    run = partial(_encode, head=shared, beside=model.beside, names=names)
    if n_known == words.count():
        found = source.mapInArrow(partial(run, spelled=spelled, gaps=False), result)
    else:
        schema = T.StructType([*own, T.StructField("mark", T.BinaryType()), T.StructField("own", T.BinaryType()), T.StructField("rest", T.ArrayType(T.StringType()))])
        rows = materialize(source.mapInArrow(partial(run, spelled=None, gaps=True), schema).withColumn("row", F.monotonically_increasing_id()), "parts")
        tails = rows.select("row", F.posexplode("rest").alias("pos", "word")).join(encoded, "word")
        tails = tails.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("found"))
        found = rows.join(tails, "row", "left").select(*names, "mark", "own", "found").mapInArrow(partial(_fill, names=names, spelled=spelled), result)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", *["round_trip"] * round_trip)


def frequent(encoded: DataFrame, words: DataFrame, head: int) -> pa.Table:
    """Rows of `encoded` for the most frequent words of up to HEAD_WORD characters, at most `head` and HEAD_BYTES, on the driver."""
    short = words.where(F.length("word") <= HEAD_WORD)
    size = short.agg(F.count("*"), F.sum(3 * F.octet_length("word") + 16)).first()  # an id of two bytes for each byte of a word at most
    share = min(1.0, HEAD_BYTES / size[1]) if size[1] else 1.0
    least = least_of_head(short, min(head, int(size[0] * share)))
    if least is None:
        return encoded.limit(0).toArrow()
    if least <= 1:  # all words
        return encoded.where(F.length("word") <= HEAD_WORD).toArrow()
    return encoded.join(short.where(F.col("n") >= least).select("word"), "word", "left_semi").toArrow()


def load(path: str | None = None) -> Model:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Model(path)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each whole text, their number and a hash of them, and whether they decode to the text."""
    found = encode(table(spark, sf_dir, "documents"), load(), ["doc_id"], round_trip=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.hash("ids").alias("ids_hash"), "round_trip", "ids")
