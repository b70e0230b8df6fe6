import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from textloom.llm import packing, pieces
from textloom.session import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BPE)
CACHE = packing.ChunkCache(BPE)
PARTS = ["a", "the", "é", " ", "  ", "\n", "\t", ".", "'s", "12", "漢", "\r\n", "😀", "<|endoftext|>", "-", "\x1c", " ", "Straße"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_ids_are_the_tokenizers(parts):
    text = "".join(parts)
    assert np.frombuffer(CACHE.whole(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12), st.sampled_from(["norm", "dot"]), st.integers(3, 64), st.integers(300, 4096))
def test_plan_fills_every_bin_within_its_capacities(histogram, rule, most_documents, attention):
    limits = packing.Limits(64, most_documents, max(attention, 4096), rule=rule)
    steps = packing.plan(histogram, limits)
    bins, placed = {}, {}
    for n, count in histogram.items():
        rows = steps[steps[:, 0] == n]
        for rank in range(count):
            _, start, base, each, offset = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
            b, behind = divmod(rank - start, each)
            bins.setdefault(base + b, []).append((offset + behind * n, n))
            placed[n] = placed.get(n, 0) + 1
    assert placed == histogram
    for content in bins.values():
        content.sort()
        assert content[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(content, content[1:]))
        assert sum(n for _, n in content) <= 64 and len(content) <= most_documents and sum(n * n for _, n in content) <= max(attention, 4096)


def test_plan_is_tight_and_small():
    rng = np.random.default_rng(0)
    histogram = {int(n): int(c) * 1_000_000 for n, c in zip(*np.unique(rng.integers(1, 1025, 5000), return_counts=True))}
    steps = packing.plan(histogram, packing.Limits())
    tokens = sum(n * c for n, c in histogram.items())
    used = int((steps[:, 2]).max())
    assert len(steps) < 20_000 and used <= 1.02 * tokens / 1024
    with pytest.raises(ValueError):
        packing.plan({65: 1}, packing.Limits(64))
    with pytest.raises(ValueError):
        packing.plan({}, packing.Limits(rule="other"))


ROWS = [(1, "one two three " * 900, "x"), (2, None, "x"), (3, "", None), (4, "short", "x"), (4, "short", "x"), (None, "no id", "x"), (5, "Ünïcode 漢字 " * 400, "x"), (6, "a <|endoftext|> b", "x")]


def test_packed_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, limits=packing.Limits(256)).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 256).all()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    want = []
    for i, text, _ in ROWS:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_hot_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 7)
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(10).alias("length"), F.lit("y").alias("sequence_id"))
    got = packing.pack(rows, packing.Limits(100, 4)).toPandas()
    assert got.sequence_id.nunique() == 25 and got.groupby("sequence_id").offset.apply(sorted).map(lambda x: x == [0, 10, 20, 30]).all()


# --------------------------------------------------------------------------------------------------------------- pieces
MODEL = pieces.load()
SCORES = {p: (i, s) for p, i, s in MODEL.pieces}


def brute(word):
    best, back = [0.0] + [None] * len(word), [None] * (len(word) + 1)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - MODEL.longest), e):
            i, score = SCORES.get(word[s:e], (-1 if e - s == 1 else None, MODEL.unknown))
            if i is not None and (best[e] is None or best[s] + score > best[e]):
                best[e], back[e] = best[s] + score, (s, i)
    out, e = [], len(word)
    while e:
        s, i = back[e]
        out += [i] if i >= 0 else [MODEL.bytes[b] for b in reversed(word[s:e].encode())]
        e = s
    return out[::-1]


TEXTS = ["Hello  world, the été\nfoo", "漢字 😀 x", None, "", " lead trail ", "a" * 90 + "字" + "b" * 40, "The and attion to thanedble the, anea.", "\n\n a \t b", "a     b", "x" * 300]


def whole(text):
    return brute(pieces.META + text.replace(" ", pieces.META)) if text else []


def test_encoding_is_the_best_path_and_decodes(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("row", F.lit(2))
    for head in (0, 3, 100):
        got = pieces.encode(docs, MODEL, ["doc_id"], head=head).withColumn("back", pieces.decode(F.col("ids"), MODEL)).collect()
        assert len(got) == len(TEXTS) + 1
        for r in got:
            assert r["ids"] == whole(TEXTS[r["doc_id"]]) and r["back"] == (TEXTS[r["doc_id"]] or "")


def test_same_as_the_library_on_words(spark):
    model = proto.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # segmentation by the best sum of scores
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = ["the", "thanedble", "internationalisation", "Straße", "anea.", "été", "retitioning"]
    rows = spark.createDataFrame([(i, pieces.META + w) for i, w in enumerate(words)], "wid long, word string")
    got = {r["word"][1:]: r["ids"] for r in pieces.encode_words(rows, MODEL).collect()}
    score = lambda ids: sum(model.pieces[i].score for i in ids)
    for w in words:
        assert score(got[w]) == pytest.approx(score(library.nbest_encode_as_ids(w, 2)[0]))
    assert library.decode(got["thanedble"]) == "thanedble"


def test_cuts_are_where_no_piece_goes_on():
    for t in [*TEXTS, "x\n▁y", "a▁b", "  ", "1,2;é漢字."]:
        words = pieces.cut(t or "", MODEL.beside)
        assert "".join(words) == (pieces.META + t.replace(" ", pieces.META) if t else "")
        assert all(a[-1] + b[0] not in MODEL.beside or b[0] == pieces.META for a, b in zip(words, words[1:]))
        assert all(w[i : i + 2] in MODEL.beside for w in words for i in range(len(w) - 1))
    assert pieces.Cutter(MODEL.beside).cut(["", "ab", "", "c\n"]) == [[], ["ab"], [], ["c", "\n"]]


def test_very_long_words(spark):
    rng = np.random.default_rng(0)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 60_000)) + "x" * 3_000 + "漢" * 300
    docs = spark.createDataFrame([(1, long), (2, "x" * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode(docs, MODEL, ["doc_id"], round_trip=True).collect()}
    assert got[1]["ids"] == whole(long) and got[1]["round_trip"] and got[2]["ids"] == whole("x" * 200_000)


def test_query_follows_from_whole_documents(spark, tmp_path):
    texts = [*TEXTS, "a\u2581b", " \u2581 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pieces.op4_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for head in (0, 3):
        for r in pieces.encode(docs, MODEL, ["doc_id"], head=head, round_trip=True).withColumn("back", pieces.decode(F.col("ids"), MODEL)).collect():
            text, own = texts[r["doc_id"]] or "", got[r["doc_id"]]
            assert (own["n_ids"], own["ids"], own["round_trip"]) == (len(r["ids"]), r["ids"], r["round_trip"])
            assert r["round_trip"] == (pieces.META not in text) == (r["back"] == text) and r["ids"] == whole(text)
    assert pieces.encode(docs.limit(0), MODEL, ["doc_id"], round_trip=True).count() == 0


def test_head_finds_words_of_equal_hash_and_forgets_chunks(monkeypatch, tmp_path):
    words = [b"a", b"bb", b"", b"ccc", "é".encode()]
    table = pa.table({"word": pa.array([w.decode() for w in words]), "ids": pa.array([bytes([i, 0]) * (i + 1) for i in range(len(words))], pa.binary())})
    expected = [bytes([i, 0]) * (i + 1) for i in range(len(words))]
    for modulus in (1 << 64, 2, 1):  # ever more words share a hash
        monkeypatch.setattr(pieces.xxhash, "xxh3_64_intdigest", lambda w, m=modulus: sum(w) % m)
        head = pieces.Head(table)
        assert head.find(words + [b"zz", b"b"]) == expected + [None, None]
        path = tmp_path / str(modulus)
        path.write_bytes(b"".join(head.written()))
        assert pieces.Head.mapped(str(path)).find(words + [b"zz", b"b"]) == expected + [None, None]
    monkeypatch.undo()
    (tmp_path / "none").write_bytes(b"".join(pieces.Head(table.slice(0, 0)).written()))
    assert pieces.Head(table.slice(0, 0)).find([b"a"]) == pieces.Head.mapped(str(tmp_path / "none")).find([b"a"]) == [None]
    texts = ["a bb ccc x", "bb\nbb  a", "", "é x ccc bb", "a", "x"] * 3
    ids = pa.array([b"\x07\x00"] * 4, pa.binary())
    head = pieces.Head(pa.table({"word": pa.array(["▁a", "▁bb", "bb", "▁"]), "ids": ids}))
    whole = pieces.Encoder(head, set()).read(texts)
    monkeypatch.setattr(pieces, "CHUNKS", 1)
    small = pieces.Encoder(head, set())
    assert [x for t in texts for x in small.read([t])] == whole


def test_words_go_through_the_lattice_once(spark):
    words = ["▁" + "ab" * 300, "漢", "▁a\U0001f600b", "x" * 256, "y" * 257]
    rows = spark.createDataFrame(list(enumerate(words)), "wid long, word string")
    carried = pieces.lattice(rows, MODEL, 2).where("word is not null").collect()
    assert sorted((r["wid"], r["word"], r["s"], r["e"]) for r in carried) == [(i, w, 0, 1) for i, w in enumerate(words)]
    found = pieces.encode_words(rows, MODEL)
    assert {r["word"] for r in found.collect()} == set(words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the pieces; not with the words again


def test_words_are_counted_where_they_are_read_and_the_head_has_one_copy(spark, monkeypatch):
    texts = [*TEXTS, "x\ny\u2581\u00e9\U0001f600 \u5b57\u5b57  ,.", "The and, and\n\nthe."]
    expected = [pieces.cut(t or "", MODEL.beside) for t in texts]
    written = [pieces.META + t.replace(" ", pieces.META) if t else "" for t in texts]
    for at_once in (1, 3, 1 << 20):  # blocks end anywhere
        monkeypatch.setattr(pieces, "AT_ONCE", at_once)
        assert pieces.Cutter(MODEL.beside).cut(written) == expected
    monkeypatch.undo()
    rows = [r for b in pieces._count(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["body"])]), MODEL.beside) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in rows} == Counter(w for ws in expected for w in ws) and len(rows) == len({r["word"] for r in rows})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(docs, MODEL, ["doc_id"]).collect()} == {i: whole(t) for i, t in enumerate(texts)}
    assert not list(Path(shared_dir(spark).removeprefix("file:"), "textloom").glob("head-*"))  # executors get it from the driver
