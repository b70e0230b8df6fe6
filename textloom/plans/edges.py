"""What training scores: for each word the first-hop words that it shares a sentence with, and how often.

A pair of a word and a source never is a row. A task reads sentences' words, or tokens sentence by sentence, with the numbers of those that are sources, and gives
for each slice of pairs a row for each word: its sources' numbers as packed differences, and how often each was met. Numbers go by falling
frequency, so most take one byte; a word that met each source once has no list of times. These rows are shuffled by word and sorted in their partitions, and merged there as a stream.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.arrow import lean, slices
from textloom.operators import corpus, scans
from textloom.operators.positional import pack_small, unpack_small

TOKENS = 800_000  # read before they are paired
PAIRS = 1 << 23  # made, or merged, at once
LISTS = "word string, df long, hit boolean, sources binary, times binary"
EDGES = "word string, df long, right boolean, parts long, sources array<int>, n array<long>"


def _packed(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """pack_small() of lists that stand one behind another, from `begins` on."""
    body = pack_small(values)
    upto = np.r_[0, np.flatnonzero(np.frombuffer(body, np.uint8) < 128) + 1].astype(np.int32)
    offsets = np.r_[upto[begins], upto[-1]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _pair(tokens: pa.Table, n_sources: int, most: int):
    """Lists of whole sentences' tokens (pos, word, tf, source)."""
    words = tokens.column("word").combine_chunks().dictionary_encode()
    source = tokens.column("source").fill_null(-1).to_numpy()
    tf = tokens.column("tf").to_numpy()
    sentence = np.cumsum(tokens.column("pos").to_numpy() == 0) - 1
    yield from _paired(words, source, tf, sentence, n_sources, most)


@lean
def _lists_of_words(batches, sources: pa.Array, tokens: int, most: int):
    """Of rows (words), a sentence each, and the sources by number: rows of LISTS."""
    for _, sizes, flat in scans.taken(batches, tokens):
        words = flat.dictionary_encode()
        source = pc.index_in(words.dictionary, sources).fill_null(-1).to_numpy().astype(np.int64)[words.indices.to_numpy()]
        yield from _paired(words, source, None, np.repeat(np.arange(len(sizes)), sizes), len(sources), most)


def _paired(words: pa.DictionaryArray, source: np.ndarray, tf: np.ndarray | None, sentence: np.ndarray, n_sources: int, most: int):
    """Lists of tokens, by ascending sentence; each is there once, or tf times."""
    code = words.indices.to_numpy()
    own = np.flatnonzero(source >= 0)
    met = np.sort(sentence[own] * n_sources + source[own])
    met = met[np.r_[True, met[1:] != met[:-1]]] if len(met) else met  # each source of a sentence once
    ends = np.searchsorted(met, np.arange(sentence[-1] + 2) * n_sources)
    met %= n_sources
    if tf is not None and tf.max() > 1:
        code, sentence = np.repeat(code, tf), np.repeat(sentence, tf)
    size = np.diff(ends)[sentence]
    upto = np.cumsum(size)
    done = 0
    while done < len(size):
        base = upto[done - 1] if done else 0
        a, done = done, max(done + 1, int(np.searchsorted(upto, base + most, "right")))
        many = size[a:done]
        total = int(upto[done - 1] - base)
        if not total:
            continue
        at = np.arange(total) + np.repeat(ends[sentence[a:done]] - (upto[a:done] - many - base), many)
        key = np.repeat(code[a:done].astype(np.int64), many) * n_sources + met[at]
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, times = key[first], np.diff(np.r_[first, total])
        word, number = np.divmod(key, n_sources)
        begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        steps = np.diff(number, prepend=0)
        steps[begins] = number[begins]
        none = pa.nulls(len(begins))
        often = np.maximum.reduceat(times, begins) > 1
        counts = np.diff(np.r_[begins, len(times)])[often]
        more = _packed(times[np.repeat(often, np.diff(np.r_[begins, len(times)]))] - 1, np.cumsum(counts) - counts).take(pa.array(np.cumsum(often) - 1, mask=~often))
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(word[begins])), none.cast(pa.int64()), none.cast(pa.bool_()), _packed(steps, begins), more], ["word", "df", "hit", "sources", "times"])


@lean
def _lists(batches, n_sources: int, tokens: int, most: int):
    """Of tokens (pos, word, tf, source), a sentence's one behind another: rows of LISTS."""
    held, n, last = [], 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        pos = batch.column("pos").to_numpy()
        if ((pos != 0) & (pos != np.r_[last, pos[:-1]] + 1)).any():
            raise ValueError("a sentence's tokens don't stand one behind another")
        last = pos[-1]
        held.append(batch)
        n += len(pos)
        if n >= tokens:
            table = pa.Table.from_batches(held)
            cut = n - 1 - int(np.argmax(table.column("pos").to_numpy()[::-1] == 0))  # where the last sentence begins
            if cut:
                yield from _pair(table.slice(0, cut), n_sources, most)
                held, n = table.slice(cut).combine_chunks().to_batches(), n - cut
    if n:
        yield from _pair(pa.Table.from_batches(held), n_sources, most)


def _unpacked(column: pa.Array) -> np.ndarray:
    if column.null_count == len(column):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return unpack_small(column.buffers()[2][offsets[0] : offsets[-1]].to_pybytes()) if offsets[-1] > offsets[0] else np.zeros(0, np.int64)


def _merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times


def _edges(words: list, df: np.ndarray, hit: np.ndarray, run: np.ndarray, number: np.ndarray, times: np.ndarray, base: int, chunk: int, more: int):
    """Rows of EDGES, of words by their run; those without a source have none."""
    begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[begins, len(run)])
    parts = -(-sizes // chunk)
    which = np.repeat(np.arange(len(begins)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    offsets = pa.array(np.r_[begins[which] + part * chunk, len(run)].astype(np.int32))
    at = run[begins][which]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((number + base).astype(np.int32), times)]
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array(df[at]), pa.array(hit[at]), pa.array(parts[which] + more), *lists], ["word", "df", "right", "parts", "sources", "n"])


@lean
def _merge(batches, n_sources: int, base: int, chunk: int, more: int, most: int):
    """Of LISTS sorted by word: rows of EDGES. Of a word only what is merged so far is held."""
    kept = None  # word, df, hit, numbers, times
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column("sources").buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column("sources").offset))
        for a, b in slices(sizes.tolist(), most):
            rows = batch.slice(a, b - a)
            names = rows.column("word")
            new = np.r_[not kept or names[0].as_py() != kept[0], pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            words = ([kept[0]] if kept else []) + names.filter(pa.array(new)).to_pylist()
            runs = np.cumsum(new) - (not kept)
            df, hit = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
            np.maximum.at(df, runs, rows.column("df").fill_null(0).to_numpy())
            np.logical_or.at(hit, runs, rows.column("hit").fill_null(False).to_numpy(zero_copy_only=False))
            steps = _unpacked(rows.column("sources"))
            ends = np.cumsum(sizes[a:b])
            raw = np.frombuffer(rows.column("sources").buffers()[2] or b"", np.uint8)
            start = np.frombuffer(rows.column("sources").buffers()[1], np.int32, 1, 4 * rows.column("sources").offset)[0]
            upto = np.r_[0, np.cumsum(raw[start : start + ends[-1]] < 128)]
            counts = upto[ends] - upto[ends - sizes[a:b]]
            times = np.ones(len(steps), np.int64)
            times[np.repeat(rows.column("times").is_valid().to_numpy(zero_copy_only=False), counts)] += _unpacked(rows.column("times"))
            total = np.cumsum(steps)
            begin = np.cumsum(counts) - counts
            before = np.r_[0, total][begin]
            key = total - np.repeat(before, counts) + np.repeat(runs, counts) * n_sources
            if kept:
                df[0], hit[0] = max(df[0], kept[1]), hit[0] or kept[2]
                key, times = np.r_[kept[3], key], np.r_[kept[4], times]
            key, times = _merged(key, times)
            end = int(np.searchsorted(key, (len(words) - 1) * n_sources))
            run, number = np.divmod(key[:end], n_sources)
            if end:
                yield _edges(words, df, hit, run, number, times[:end], base, chunk, more)
            kept = words[-1], df[-1], hit[-1], key[end:] - (len(words) - 1) * n_sources, times[end:]
    if kept and len(kept[3]):
        yield _edges([kept[0]], np.array([kept[1]]), np.array([kept[2]]), np.zeros(len(kept[3]), np.int64), kept[3], kept[4], base, chunk, more)


def _tokens(posts: DataFrame) -> DataFrame:
    """pos, word, tf of postings, those of a sentence one behind another. Rows of one key are one sentence."""
    whole = posts.dropna(subset=list(corpus.SENTENCE)).groupBy(*corpus.SENTENCE).agg(F.collect_list(F.struct("word", "tf")).alias("posts"))
    return whole.select(F.posexplode("posts").alias("pos", "p")).select("pos", "p.word", "p.tf")


def _in_order(block: DataFrame, size: int) -> pa.Array:
    """The words of sources 0 to size - 1."""
    table = block.toArrow()  # lookup.MOST rows at most
    place = np.empty(size, np.int64)
    place[table.column("source").to_numpy()] = np.arange(size)
    return table.column("word").combine_chunks().take(pa.array(place))


def edges(rows: DataFrame, sources: DataFrame, df: DataFrame, right: DataFrame, n: int, chunk: int, most: int) -> DataFrame:
    """EDGES of postings or sentences: for each word that meets a source (word, id from 0 to n - 1) the ids that it meets, in rows of `chunk`
    at most, and how often; parts is 1 where all of a word stands in one row. Up to `most` sources are broadcast at once; each block of
    as many is a pass over the rows."""
    known = df.join(right.select("word", F.lit(True).alias("hit")), "word", "left").select("word", "df", "hit", *[F.lit(None).cast("binary").alias(c) for c in ("sources", "times")])
    here, posts = corpus.apart(rows, None) if "words" in rows.columns else (None, rows)
    if here is not None:
        posts = corpus.postings(corpus.tokens(posts))
    found, blocks = None, range(0, n, most)
    for base in blocks:
        size = min(most, n - base)
        block = sources.where(F.col("id").between(base, base + size - 1)).select("word", (F.col("id") - base).alias("source"))
        met = _tokens(posts).join(F.broadcast(block), "word", "left").select("pos", "word", "tf", "source")
        lists = met.mapInArrow(partial(_lists, n_sources=size, tokens=TOKENS, most=PAIRS), LISTS).unionByName(known)
        if here is not None:
            lists = here.select("words").mapInArrow(partial(_lists_of_words, sources=_in_order(block, size), tokens=TOKENS, most=PAIRS), LISTS).unionByName(lists)
        merged = lists.repartition("word").sortWithinPartitions("word").mapInArrow(partial(_merge, n_sources=size, base=base, chunk=chunk, more=len(blocks) - 1, most=PAIRS), EDGES)
        found = merged if found is None else found.unionByName(merged)
    return found if found is not None else rows.sparkSession.createDataFrame([], EDGES)
