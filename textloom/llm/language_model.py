"""Scores of whole documents under a gated recurrent language model.

Counting. Each task counts its words, some megabytes of text at a time in arrays, and the sums are merged by word, so what is gathered grows with the corpus. The most frequent
words (at most HEAD) go to every task; counts of all other words reach a document through a join, so no table that grows with the
corpus is broadcast.

Model. A gated recurrent unit reads symbols: the WORDS most frequent words, the end of a text, and a bucket for the spelling of any other
word. The output is factored: a softmax over CLASSES classes of MEMBERS symbols, then one within the class. A word of a bucket has the
probability of the bucket times its smoothed share of the bucket's count, so the model is a proper distribution over all words.
Weights are trained by backpropagation truncated to WINDOW steps: they start from a bounded sample in one task, then ROUNDS rounds
share out all training documents, each of which is learnt whole in one round, by the task that holds it; weights are averaged.

Documents are laid end to end in slots that are read in step, in training and in scoring; slots that have ended drop out of the step, so
a long document holds none of the others up. The state is carried from window to window and reset where a document begins, so
each document is read whole.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, held, lean, materialize, remainder, slices, table

HEAD = 200_000
MEMBERS = 64
CLASSES = 32
WORDS = MEMBERS * (CLASSES - 1)  # the last class holds the end and the buckets
BUCKETS = 32
END = MEMBERS * (CLASSES - 1)
SYMBOLS = MEMBERS * CLASSES
HIDDEN = 24
WINDOW = 64
SLOTS = 256
OUTPUT_BLOCK = 2_048  # targets whose classes are scored at once, so that their logits stay in a core's cache
UPDATE_TOKENS = 4_096  # at least, between two updates of the weights
ROUNDS = 2
WARM_DOCUMENTS = 1_000
WARM_TOKENS = 1_600_000
WARM_PLACES = 1 << 30
READ = 4 << 20  # bytes of texts that a task takes at once
GROUP_BYTES = 12_000_000  # of symbols
SHARDS = 16  # of the weights, when those of all tasks are summed
CLOSING = np.isin(np.arange(256), list(b".,!?;:\"')*#$%&|"))  # marks that end a word


def words_of(raw: bytes, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z in lower case, of texts that are joined in `raw` and end at `ends`; and how many words there are
    up to the end of each text."""
    low = np.frombuffer(raw.lower(), np.uint8)
    solid = (low != 0x20) & ((low < 0x09) | (low > 0x0D))
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = ends[ends < len(low)]
    opens[inner] = solid[inner]  # each text opens a word
    starts = np.flatnonzero(opens)
    letters = low[solid]
    offsets = np.append(np.cumsum(solid, dtype=np.int64)[starts] - 1, len(letters))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), np.searchsorted(starts, ends)


def buckets(words: pa.Array) -> np.ndarray:
    """A bucket for the spelling of each word (binary): how it ends, whether it is ASCII, and its last letters; -1 of an empty word."""
    if not len(words):
        return np.zeros(0, np.int32)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if not len(letters):
        return np.full(len(words), -1, np.int32)
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    last = letters[ends - 1].astype(np.int32)
    mark = np.select([last == 0x2E, last == 0x2C, (last >= 0x61) & (last <= 0x7A) | (last > 0x7F)], [1, 2, 0], 3)
    beyond = np.append(0, np.cumsum(letters > 0x7F))
    solid = np.maximum.accumulate(np.where(CLOSING[letters], -1, np.arange(len(letters))))[ends - 1]  # the last letter that doesn't close a word, of this word or before
    core = sum(np.where(solid - k >= starts, letters[np.maximum(solid - k, 0)], 0).astype(np.int32) for k in (0, 1))
    return np.where(starts == ends, -1, mark * 8 + np.where(beyond[ends] > beyond[starts], 4, 0) + (core & 3)).astype(np.int32)


# -------------------------------------------------------------------------------------------------------------- counting
def _joined(batch: pa.RecordBatch, column: int):
    """Texts of a batch, READ bytes at a time: which rows they are, the texts joined, and where each ends."""
    texts = as_bytes(batch.column(column))
    sizes = [len(t) for t in texts]
    for a, b in slices(sizes, READ):
        yield a, b, b"".join(texts[a:b]), np.cumsum(sizes[a:b], dtype=np.int64)


@lean
def _count(batches):
    for batch in batches:
        for a, b, raw, ends in _joined(batch, 0):
            found = words_of(raw, ends)[0].value_counts()
            words, counts = found.field("values").cast(pa.binary()), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([b""], pa.binary())]), pa.concat_arrays([counts, pa.array([b - a], pa.int64())])], ["word", "n"])  # one end a text


@lean
def _bucketed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets(batch.column(0))), batch.column(1)], ["word", "bucket", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary, empty for the end), bucket and n, over the single column of `texts`."""
    found = texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(found.mapInArrow(_bucketed, "word binary, bucket int, n long"), "counts")


def least_of_head(counts: DataFrame, most: int) -> int | None:
    """The count from which on words (columns word, n) are at most `most`; found by bands of counts, of which there are a few hundred.
    None if even the most frequent are more."""
    band = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    bands = counts.groupBy(band.alias("b")).agg(F.count("*").alias("v"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for b, v, n in sorted(bands, reverse=True):
        if total + v > most:
            break
        total, least = total + v, n
    return least


def head_of(counts: DataFrame, most: int = HEAD) -> list:
    """The most frequent words, at most `most`, as rows, the most frequent first."""
    words = counts.where(F.length("word") > 0)
    least = least_of_head(words, most)
    if least is None:
        return []
    return sorted(words.where(F.col("n") >= least).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))


@dataclass
class Vocabulary:
    """What each task gets: the head with its counts, and sums over the buckets. All of bounded size."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    types: int
    ends: int
    bucket_mass: np.ndarray  # by bucket: sum of c + 0.1 over its words, and 0.1 for an unknown one

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @property
    def symbols(self) -> np.ndarray:
        """Symbol of each word of the head."""
        own = np.arange(len(self.words), dtype=np.int32)
        own[WORDS:] = END + 1 + buckets(pa.array(self.words[WORDS:], pa.binary()))
        return own


def vocabulary(counts: DataFrame) -> Vocabulary:
    head = head_of(counts)
    words, n = [bytes(r["word"]) for r in head], np.array([r["n"] for r in head], np.int64)
    mass, total, types, ends = np.full(BUCKETS, 0.1), 0, 0, 0
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # BUCKETS rows and the end's
        total, types = total + r["n"], types + r["v"]
        if r["bucket"] < 0:
            ends = r["n"]
        else:
            mass[r["bucket"]] += r["n"] + 0.1 * r["v"]
    np.subtract.at(mass, buckets(pa.array(words[:WORDS], pa.binary())), n[:WORDS] + 0.1)
    return Vocabulary(words, n, total, types if ends else 0, ends, np.maximum(mass, 0.1))


# ------------------------------------------------------------------------------------------------------------- the model
def columns(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns of a matrix at places that are in it."""
    return np.take(values, at, axis=1, mode="clip")


class Network:
    """Gated recurrent unit with class-factored output, in float32."""

    def __init__(self, known_words: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(HIDDEN)).astype(np.float32)
        self.p = {
            "embed": scale(SYMBOLS, HIDDEN), "input": scale(HIDDEN, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32), "state": scale(HIDDEN, 3 * HIDDEN),
            "class": 0.1 * scale(HIDDEN, CLASSES), "class_bias": np.zeros(CLASSES, np.float32), "member": 0.1 * scale(CLASSES, HIDDEN, MEMBERS), "member_bias": np.zeros((CLASSES, MEMBERS), np.float32),
        }
        used = np.zeros(SYMBOLS, bool)
        used[: min(known_words, WORDS)] = used[END : END + 1 + BUCKETS] = True
        self.member_mask = np.where(used, 0, -1e9).astype(np.float32).reshape(CLASSES, MEMBERS)
        self.class_mask = np.where(used.reshape(CLASSES, MEMBERS).any(axis=1), 0, -1e9).astype(np.float32)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.step, self.pending, self.waiting = 0, {}, 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in sorted(self.p):
            size = self.p[name].size
            self.p[name] = flat[at : at + size].reshape(self.p[name].shape).astype(np.float32)
            at += size

    def start_from(self, frequency: np.ndarray) -> None:
        """Output biases such that the untrained model is the unigram distribution of `frequency` over the symbols."""
        f = frequency.reshape(CLASSES, MEMBERS) + 0.5
        self.p["member_bias"] = np.log(f / f.sum(axis=1, keepdims=True)).astype(np.float32)
        self.p["class_bias"] = np.log(f.sum(axis=1) / f.sum()).astype(np.float32)

    def inputs(self) -> np.ndarray:
        """What each symbol adds to the gates."""
        return self.p["embed"] @ self.p["input"] + self.p["bias"]

    def read(self, x: np.ndarray, keep: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States behind each step of a window of input gates (T x B x 3H); keep is 0 where a document begins."""
        out, after = self.steps(lambda t: np.ascontiguousarray(x[t].T), keep, np.ascontiguousarray(state.T))
        return out.transpose(1, 2, 0), after.T

    def steps(self, inputs: Callable[[int], np.ndarray], keep: np.ndarray, state: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As read(), with the slots last (input gates of a step: 3H x B, state: H x B, states: H x T x B), so that each operation runs
        over whole rows of slots."""
        H = HIDDEN
        out, U = np.empty((H, *keep.shape), np.float32), np.ascontiguousarray(self.p["state"].T)
        for t in range(len(keep)):
            before = state * keep[t]
            g, x = U @ before, inputs(t)
            gates = x[: 2 * H]
            gates += g[: 2 * H]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:H], gates[H:]
            c = r * g[2 * H :]
            c += x[2 * H :]
            np.tanh(c, out=c)
            state = before - c
            state *= z
            state += c
            out[:, t] = state
            if tape is not None:
                tape.append((before, g[2 * H :], z, r, c))
        return out, state

    def output(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target symbol after its state (n x H); with grads also the gradient of the states."""
        logp, back = self.scored(np.ascontiguousarray(states.T), target, grads)
        return logp, None if back is None else back.T

    def bounded(self) -> bool:
        """Whether no logit, of states between -1 and 1, can be beyond what float32 can exponentiate."""
        classes = np.abs(self.p["class"]).sum(axis=0) + np.abs(self.p["class_bias"])
        members = np.abs(self.p["member"]).sum(axis=1) + np.abs(self.p["member_bias"])
        return max(classes.max(), members.max()) < 60

    def scored(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """As output(), of states with the targets last (H x n). Targets are taken in the order of their classes."""
        order = np.argsort((target // MEMBERS).astype(np.int16), kind="stable")
        states, target = columns(states, order), target[order]
        cls, member, rows = target // MEMBERS, target % MEMBERS, np.arange(len(target))
        ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()

        safe = self.bounded()

        def softmax(weights: np.ndarray, bias: np.ndarray, states: np.ndarray, hit: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Log probability of the row `hit` in each column, and with grads the gradient of the logits."""
            e = weights.T @ states
            e += bias[:, None]
            if not safe:
                e -= e.max(axis=0)
            logp = e[hit, i]
            np.exp(e, out=e)
            total = e.sum(axis=0)
            logp -= np.log(total)
            if grads is not None:
                e /= total
                e[hit, i] -= 1
            return logp, e

        logp, back = np.empty(len(target), np.float32), None
        if grads is not None:
            back = np.empty_like(states)
            grads |= {k: np.zeros_like(self.p[k]) for k in ("class", "class_bias", "member", "member_bias")}
        for a in range(0, len(target), OUTPUT_BLOCK):
            b = min(a + OUTPUT_BLOCK, len(target))
            logp[a:b], d = softmax(self.p["class"], self.p["class_bias"] + self.class_mask, states[:, a:b], cls[a:b], rows[: b - a])
            if grads is not None:
                grads["class"] += states[:, a:b] @ d.T
                grads["class_bias"] += d.sum(axis=1)
                back[:, a:b] = self.p["class"] @ d
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if a == b:
                continue
            inner, d = softmax(self.p["member"][k], self.p["member_bias"][k] + self.member_mask[k], states[:, a:b], member[a:b], rows[: b - a])
            logp[a:b] += inner
            if grads is not None:
                grads["member"][k], grads["member_bias"][k] = states[:, a:b] @ d.T, d.sum(axis=1)
                back[:, a:b] += self.p["member"][k] @ d
        place = np.empty(len(order), np.int64)
        place[order] = rows
        return logp[place], None if back is None else columns(back, place)

    def learn(self, ids: np.ndarray, keep: np.ndarray, target: np.ndarray, state: np.ndarray, rate: float) -> np.ndarray:
        """Truncated backpropagation over a window; targets under 0 are padding. Weights change once UPDATE_TOKENS have been read, or by
        update(). Gives the state behind the window."""
        tape: list = []
        if ids.size > SYMBOLS:
            table_ = np.ascontiguousarray(self.inputs().T)
            inputs = lambda t: columns(table_, ids[t])
        else:
            inputs = lambda t: np.ascontiguousarray((self.p["embed"][ids[t]] @ self.p["input"] + self.p["bias"]).T)
        states, after = self.steps(inputs, keep, np.ascontiguousarray(state.T), tape)
        live = np.flatnonzero(target.ravel() >= 0)
        n = len(live)
        if not n:
            return after.T
        H, U = HIDDEN, self.p["state"]
        grads: dict[str, np.ndarray] = {}
        flat = states.reshape(H, -1)
        if n == target.size:
            back = self.scored(flat, target.ravel(), grads)[1]
        else:
            back = np.zeros_like(flat)
            back[:, live] = self.scored(columns(flat, live), target.ravel()[live], grads)[1]
        back = back.reshape(states.shape)
        dx, befores, inner = np.empty((3 * H, *ids.shape), np.float32), np.empty_like(states), np.empty_like(states)  # inner: the candidate's part of the state's gates
        gates, dh = np.empty((3 * H, ids.shape[1]), np.float32), np.zeros((H, ids.shape[1]), np.float32)
        dz, dr, dg = gates[:H], gates[H : 2 * H], gates[2 * H :]
        for t in range(len(ids) - 1, -1, -1):
            before, gc, z, r, c = tape[t]
            befores[:, t] = before
            dh += back[:, t]
            open_ = 1 - z
            dc = dh * open_
            np.subtract(before, c, out=dz)
            dz *= dh
            dz *= z
            dz *= open_
            c *= c
            np.subtract(1, c, out=c)
            dc *= c
            np.multiply(dc, r, out=dg)
            np.multiply(dg, gc, out=dr)
            dr *= 1 - r
            dx[: 2 * H, t], dx[2 * H :, t], inner[:, t] = gates[: 2 * H], dc, dg
            dh *= z
            dh += U @ gates
            dh *= keep[t]
        dx, befores = dx.reshape(3 * H, -1), befores.reshape(H, -1)
        grads["state"] = np.concatenate([befores @ dx[: 2 * H].T, befores @ inner.reshape(H, -1).T], axis=1)
        symbols = ids.ravel().astype(np.int16)
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        seen = symbols[starts]
        by_symbol = np.add.reduceat(columns(dx, order), starts, axis=1)  # 3H x symbols that were read
        grads["input"], grads["bias"] = self.p["embed"][seen].T @ by_symbol.T, by_symbol.sum(axis=1)
        grads["embed"] = np.zeros_like(self.p["embed"])
        grads["embed"][seen] = by_symbol.T @ self.p["input"].T
        for k, g in grads.items():
            self.pending[k] = self.pending[k] + g if k in self.pending else g
        self.waiting += n
        if self.waiting >= UPDATE_TOKENS:
            self.update(rate)
        return after.T

    def update(self, rate: float) -> None:
        """One step of Adam by the mean gradient of the tokens read since the last."""
        if not self.waiting:
            return
        self.step += 1
        for k, g in self.pending.items():
            g = np.clip(g / self.waiting, -1, 1)
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)
        self.pending, self.waiting = {}, 0


@dataclass
class Layout:
    """Documents end to end in slots, the longest slot first: all slots' symbols in one array, where each begins and how long it is,
    the places where a document begins, and the document of each place."""

    symbols: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    begins: np.ndarray
    owner: np.ndarray


def lay_out(docs: list[np.ndarray], slots: int = SLOTS) -> Layout:
    """Documents (arrays of symbols that close with END), the longest first, each into the slot that is shortest so far."""
    sizes = np.array([len(d) for d in docs])
    heap = [(0, k) for k in range(min(slots, len(docs)))]
    content: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable"):
        used, k = heapq.heappop(heap)
        content[k].append(int(i))
        heapq.heappush(heap, (used + int(sizes[i]), k))
    lengths = np.array([sum(sizes[c]) for c in content])
    content = [content[k] for k in np.argsort(-lengths, kind="stable")]
    order = [i for c in content for i in c]
    lengths = -np.sort(-lengths, kind="stable")
    begins = np.zeros(int(sizes.sum()), bool)
    begins[np.cumsum(sizes[order]) - sizes[order]] = True
    return Layout(np.concatenate([docs[i] for i in order]).astype(np.int32), np.cumsum(lengths) - lengths, lengths, begins, np.repeat(order, sizes[order]).astype(np.int32))


def windows(laid: Layout):
    """For each window of steps: input symbols (the one before, or END where a document begins), keep, targets (-1: past the end of the
    slot) as steps x slots, of the slots that haven't ended, and the documents of the targets."""
    for t in range(0, int(laid.sizes[0]), WINDOW):
        width = int(np.searchsorted(-laid.sizes, -t, "left"))
        steps = t + np.arange(WINDOW)[:, None]
        live = steps < laid.sizes[None, :width]
        at = np.where(live, laid.starts[None, :width] + steps, 0)
        first = laid.begins[at] | ~live
        ids = np.where(first, END, laid.symbols[at - 1])
        yield ids, (~first).astype(np.float32), np.where(live, laid.symbols[at], -1), laid.owner[at]


def train_on(net: Network, docs: list[np.ndarray], rate: float, slots: int = SLOTS) -> int:
    """One pass over the documents, the state carried through each; gives the number of tokens."""
    if not docs:
        return 0
    laid = lay_out(docs, slots)
    state = np.zeros((len(laid.sizes), HIDDEN), np.float32)
    for ids, keep, here, _ in windows(laid):
        state = net.learn(ids, keep, here, state[: ids.shape[1]], rate)
    net.update(rate)
    return len(laid.symbols)


def log_likelihoods(net: Network, docs: list[np.ndarray], slots: int = 2 * SLOTS) -> np.ndarray:
    """Natural log probability of the symbols of each document, whole."""
    laid = lay_out(docs, slots)
    state, total = np.zeros((HIDDEN, len(laid.sizes)), np.float32), np.zeros(len(docs))
    inputs = np.ascontiguousarray(net.inputs().T)
    for ids, keep, here, owner in windows(laid):
        states, state = net.steps(lambda t, ids=ids: columns(inputs, ids[t]), keep, state[:, : ids.shape[1]])
        states, live = states.reshape(HIDDEN, -1), np.flatnonzero(here.ravel() >= 0)
        logp, _ = net.scored(states if len(live) == here.size else columns(states, live), here.ravel()[live])
        total += np.bincount(owner.ravel()[live], logp, len(docs))
    return total


# ----------------------------------------------------------------------------------------------------------- data to symbols
#: Of a document: its symbols (16 bits each), and its score apart from the network's part and from the words that the head lacks.
CODED = {
    "n_tokens": T.LongType(), "n_known": T.LongType(), "base_score": T.DoubleType(), "inner": T.DoubleType(),
    "tail": T.ArrayType(T.BinaryType()), "counts": T.ArrayType(T.IntegerType()), "symbols": T.BinaryType(),
}


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.get = vocab, vocab.index().get
        self.symbols = np.append(vocab.symbols, -1)
        self.logc = np.append(np.log10(vocab.counts + 0.1), 0.0)
        share = vocab.counts + 0.1
        inner = np.zeros(len(share))
        inner[WORDS:] = np.log10(share[WORDS:] / vocab.bucket_mass[self.symbols[:-1][WORDS:] - END - 1]) if len(share) > WORDS else 0
        self.inner = np.append(inner, 0.0)

    def encode(self, raw: bytes, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of texts that are joined in `raw` (ends: where each ends; one text by default): all symbols, each text's with its end; how many words
        there are up to the end of each text; each word's place among the distinct ones; these; and their places in the head (-1: not there)."""
        ends = np.array([len(raw)]) if ends is None else ends
        words, upto = words_of(raw, ends)
        coded = words.dictionary_encode()
        at = np.fromiter(map(self.get, as_bytes(coded.dictionary), repeat(-1)), np.int32, len(coded.dictionary))
        own = np.where(at < 0, END + 1 + buckets(coded.dictionary), self.symbols[at])
        codes = coded.indices.to_numpy()
        symbols = np.full(len(codes) + len(ends), END, np.int32)
        within = np.ones(len(symbols), bool)
        within[upto + np.arange(len(ends))] = False
        symbols[within] = own[codes]
        return symbols, upto, codes, coded.dictionary, at


def _encoder(blob: bytes) -> Encoder:
    return held(f"encoder {xxhash.xxh3_128_hexdigest(blob)}", lambda: Encoder(pickle.loads(blob)))


@lean
def _symbols(batches, vocab: bytes, names: list[str]):
    """Documents with the symbols of their texts and what their scores need besides the network."""
    encoder = _encoder(vocab)
    v = encoder.vocab
    norm = np.log10(v.total + 0.1 * (v.types + 1))
    end_logc = np.log10(v.ends + 0.1)
    log_mass = np.log10(v.bucket_mass)
    for batch in batches:
        for a, b, raw, ends in _joined(batch, len(names)):
            symbols, upto, codes, distinct, at = encoder.encode(raw, ends)
            docs = b - a
            n_words = np.diff(upto, prepend=0)
            owner = np.repeat(np.arange(docs), n_words)
            inner = np.where(at < 0, -log_mass[buckets(distinct)], encoder.inner[at])
            lacking = np.flatnonzero((at < 0)[codes])
            tails, counts = np.unique(owner[lacking] * len(distinct) + codes[lacking], return_counts=True)
            sizes = pa.array(np.searchsorted(tails, np.arange(docs + 1) * len(distinct)).astype(np.int32))
            tail = distinct.take(pa.array(tails % max(len(distinct), 1))).cast(pa.binary())
            n_known = n_words - np.bincount(owner[lacking], minlength=docs) + (v.ends > 0)
            base = np.bincount(owner, encoder.logc[at][codes], docs) + end_logc - (n_words + 1) * norm
            places = np.append(0, 2 * (upto + np.arange(1, docs + 1))).astype(np.int32)
            shown = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(places), pa.py_buffer(symbols.astype("<i2"))])
            lists = [pa.ListArray.from_arrays(sizes, tail), pa.ListArray.from_arrays(sizes, pa.array(counts.astype(np.int32)))]
            kept = [batch.column(i).slice(a, docs) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words + 1), pa.array(n_known), pa.array(base), pa.array(np.bincount(owner, inner[codes], docs).astype(float)), *lists, shown], [*names, *CODED])


def coded(docs: DataFrame, vocab: Vocabulary, in_training: Column, keep: list[str], text: str, doc_id: str, rounds: int = ROUNDS) -> DataFrame:
    """k0, k1, … (the columns `keep`), learn (whether in_training), warm and round (pseudo-random numbers under WARM_PLACES and `rounds`),
    row (a number) and CODED of each document, written once: the rounds of training and the scoring read symbols, not texts."""
    names = [f"k{i}" for i in range(len(keep))]
    dealt = lambda label, n: F.pmod(F.xxhash64(f"`{doc_id}`", f"`{text}`", F.lit(label)), F.lit(n)).alias(label)
    marks = [F.coalesce(in_training, F.lit(False)).alias("learn"), dealt("warm", WARM_PLACES), dealt("round", rounds)]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], *marks, F.col(f"`{text}`").alias("body"))
    fields = [*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in CODED.items()]]
    run = partial(_symbols, vocab=pickle.dumps(vocab), names=source.columns[:-1])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return materialize(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "coded")


def _groups(batches, column: int):
    """Rows of a batch with their documents' symbols, GROUP_BYTES of these at a time."""
    for batch in batches:
        raw = as_bytes(batch.column(column))
        for a, b in slices([len(r) for r in raw], GROUP_BYTES):
            yield batch.slice(a, b - a), [np.frombuffer(r, "<i2") for r in raw[a:b]]


@lean
def _train_round(batches, weights: dict, known: int, rate: float):
    """Learns the documents of a task; at the end its weights by the number of tokens, in SHARDS rows."""
    net, tokens = Network(known), 0
    net.p = {k: v.copy() for k, v in weights.items()}
    for _, docs in _groups(batches, 0):
        tokens += train_on(net, docs, rate)
    if tokens:
        parts = np.array_split(net.flat() * tokens, SHARDS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([tokens] * SHARDS, pa.int64())], ["shard", "weights", "tokens"])


@lean
def _warm_up(batches, weights: dict, known: int):
    """Learns a sample, some documents at a time; few tokens are read several times."""
    net, tokens = Network(known), 0
    net.p = {k: v.copy() for k, v in weights.items()}
    for _, docs in _groups(batches, 0):
        size = sum(map(len, docs))
        for rate in (0.02, 0.01, 0.005, 0.002)[: max(1, min(4, WARM_TOKENS // size))]:
            train_on(net, docs, rate, SLOTS // 2)
        tokens += size
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([net.flat().tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])


@lean
def _add(batches):
    """Sums of rows (shard, weights, tokens) by shard; holds one row a shard."""
    totals: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for shard, raw, n in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            part = np.frombuffer(raw, np.float64)
            total, tokens = totals.get(shard, (0.0, 0))
            totals[shard] = total + part, tokens + n
    for shard, (total, tokens) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["shard", "weights", "tokens"])


def train(training: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Trains on the texts (column `text`) of `training`, which also has doc_id."""
    return learnt(coded(training, vocab, F.lit(True), [], "text", "doc_id", rounds), vocab, rounds)


def learnt(documents: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Trains on the rows of coded() that are to be learnt: first on about WARM_DOCUMENTS of them in one
    task (WARM_TOKENS tokens at most, by expectation), then in parallel on all of them, each in one of the rounds; `seen` counts the
    tokens of these. A round's weights are the means over its tasks, summed by shard."""
    encoder, known = Encoder(vocab), len(vocab.words)
    net = Network(known)
    frequency = np.bincount(encoder.symbols[:-1], vocab.counts, SYMBOLS).astype(float)
    frequency[END] = vocab.ends
    frequency[END + 1 : END + 1 + BUCKETS] += np.maximum(vocab.bucket_mass - np.bincount(encoder.symbols[:-1][WORDS:] - END - 1, vocab.counts[WORDS:], BUCKETS), 0)
    net.start_from(frequency)
    net.seen = 0
    share = min(1.0, WARM_DOCUMENTS / max(vocab.ends, 1), WARM_TOKENS / max(vocab.total, 1))
    documents = documents.where("learn")
    warm = documents.where(F.col("warm") < int(share * WARM_PLACES)).select("symbols").repartition(1)  # a bounded sample in one task
    for r in warm.mapInArrow(partial(_warm_up, weights=net.p, known=known), "weights binary, tokens long").collect():
        net.load(np.frombuffer(r["weights"], np.float64))
    schema = "shard int, weights binary, tokens long"
    for k in range(rounds):
        part = documents.where(F.col("round") == k).select("symbols")
        run = partial(_train_round, weights=net.p, known=known, rate=0.008 / (k + 1))
        sums = materialize(part.mapInArrow(run, schema), "weights")
        merged = sums.mapInArrow(_add, schema).repartition(SHARDS, "shard").mapInArrow(_add, schema).collect()  # a row for each shard
        if merged:
            merged.sort(key=lambda r: r["shard"])
            net.load(np.concatenate([np.frombuffer(r["weights"], np.float64) for r in merged]) / merged[0]["tokens"])
            net.seen += merged[0]["tokens"]
    return net


# --------------------------------------------------------------------------------------------------------------- scoring
@lean
def _score(batches, weights: dict, known: int):
    """Scores in the place of inner scores and symbols, a batch's last columns."""
    net = Network(known)
    net.p = weights
    for batch in batches:
        names = [*batch.schema.names[:-2], "score"]
        for part, docs in _groups([batch], len(names)):
            score = log_likelihoods(net, docs) / np.log(10) + part.column(len(names) - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(score)], names)


def score_documents(docs: DataFrame, in_training: Column, keep: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns `keep` with n_tokens, n_known, train_tokens, base_score and score of each whole text (null: empty), learning
    from the rows where `in_training` holds. An empty text is its end alone. Rows with the same id are scored apart."""
    counts = count_words(docs.where(in_training).select(F.col(f"`{text}`")))
    vocab = vocabulary(counts)
    documents = coded(docs, vocab, in_training, keep, text, doc_id)
    net = learnt(documents, vocab)
    names = [f"k{i}" for i in range(len(keep))]
    source = documents.select(*names, "row", "n_tokens", "n_known", "base_score", "inner", "symbols")
    schema = T.StructType([*source.schema.fields[:-2], T.StructField("score", T.DoubleType())])
    rows = materialize(source.mapInArrow(partial(_score, weights=net.p, known=len(vocab.words)), schema), "scored")
    least = int(vocab.counts[-1]) if len(vocab.counts) else None
    rare = counts.where(F.length("word") > 0)  # words that the head lacks are no more frequent than its last
    rare = (rare.where(F.col("n") <= least) if least is not None else rare).select("word", "n")
    tails = documents.select("row", F.explode(F.arrays_zip("tail", "counts")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.counts").alias("tf"))
    found = tails.join(rare, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known"))
    out = rows.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 10) == 0
    scored = score_documents(docs.withColumn("held_out", held_out), ~held_out, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
