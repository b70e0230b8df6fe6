import html
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import cli
from textloom.operators import corpus
from textloom.sources import inputs, runs, xml_splits
from textloom.streaming import index

TOML = """
seed_terms = ["Portugal", "Italy"]
[hyper_parameter]
cooc1_word_frequency_boost = -13.0
cooc1_set_frequency_boost = 23.0
cooc1_global_term_frequency_boost_per_sentence = -15.0
cooc1_survivor_threshold = 0.0
cooc2_cooc1_frequency_boost = 15.0
cooc2_set_frequency_boost = 13.0
cooc2_global_term_frequency_boost_per_sentence = -40.0
cooc2_survivor_threshold = 0.0
"""


def test_config():
    seeds, params = inputs.read_config(TOML)
    assert seeds == ["Portugal", "Italy"] and params.to_vector() == [-13, 23, -15, 15, 13, -40] and params.t1 == params.t2 == 0


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<d><text>one &amp;amp; <i>two</i></text><text/><text x='1'>three<!-- c --><![CDATA[no]]></text></d>")
    (tmp_path / "b.xml").write_text("<text>four</text><other>five</other>")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.xml").write_text("<text>six</text>")
    rows = inputs.read_xml(spark, str(tmp_path), "text").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(0, "one &amp; two"), (1, "three"), (2, "four")]
    whole = inputs.read_xml_whole(spark, str(tmp_path), "text").orderBy("doc_id").collect()
    assert whole == rows
    assert [r["text"] for r in inputs.read_xml(spark, f"file:{tmp_path}", "text", limit=2).orderBy("doc_id").collect()] == ["one &amp; two", "three"]


PIECES = ("<text>", "</text>", "<text a='x>y'>", "<text/>", "<!-- <text> -->", "<![CDATA[ <text>no</text> ]]>", "<?pi <text> ?>", "<b>", "</b>", "hello ", "a &amp; b ", "< ", "é漢", "<!DOCTYPE x>", '<text\n b="<" >', "<textual>", "<!-- " + "<text>y</text>" * 6 + " -->", "<!-- ", "-->")


def ranges_of(doc, split):
    """Texts of a document in ranges, each entered where the one before lets it."""
    texts, resume = [], 0
    for begin in range(0, len(doc), split):
        end = min(begin + split, len(doc))
        first = xml_splits.Bytes(io.BytesIO(doc), len(doc), begin, end).find(b"<", begin)
        entry = begin if first < 0 or min(first, end) >= resume else max(resume, begin)
        if entry < end:
            for resume, text in xml_splits.elements(xml_splits.Bytes(io.BytesIO(doc), len(doc), begin, end), b"text", entry, end):  # noqa: B007
                texts += [] if text is None else [text]
    return texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.integers(1, 60))
def test_ranges_of_any_size_give_the_same_texts(pieces, split):
    doc = "".join(pieces).encode()
    assert ranges_of(doc, split) == ranges_of(doc, max(len(doc), 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([p for p in PIECES if "<" not in p[1:] or p.count("-->") > 0 or "[" in p or "?" in p][:-2]), max_size=25))
def test_ranges_read_what_the_whole_reader_reads(pieces):
    doc = "".join(pieces)
    assert [html.unescape(t.decode()) for t in ranges_of(doc.encode(), 7)] == inputs.xml_texts(doc, "text")


def test_one_large_file_is_many_tasks(spark, tmp_path):
    texts = [f"{i} " + "é<&> word " * (i % 50) for i in range(1500)]
    pages = [f"<p><!-- {'<text>no</text>' * (i % 9)} --><text i='{i}'>{html.escape(t, quote=False)}</text></p>\n" for i, t in enumerate(texts)]
    pages[700] = "<![CDATA[" + "<text>hidden</text> <!-- " * 3000 + "]]>" + pages[700]  # over several ranges
    (tmp_path / "big.xml").write_text("<d>" + "".join(pages) + "</d>")
    (tmp_path / "_SUCCESS").write_text("<text>no</text>")
    whole = xml_splits.read_xml_splits(spark, str(tmp_path), "text")
    cut = xml_splits.read_xml_splits(spark, str(tmp_path), "text", 20_000)
    assert [tuple(r) for r in whole.orderBy("doc_id").collect()] == list(enumerate(texts)) == [tuple(r) for r in cut.orderBy("doc_id").collect()]
    ranges = xml_splits.scan_ranges(spark, str(tmp_path), "text", 20_000)
    assert len(ranges) > 20 and sum(r["n"] for r in ranges) == len(texts) and any(r["entry"] > r["begin"] for r in ranges)
    scan = xml_splits._load(spark, str(tmp_path), "text", 20_000, "read")
    assert scan.rdd.getNumPartitions() == len(ranges)
    few = xml_splits.read_xml_splits(spark, str(tmp_path), "text", 20_000, limit=40)
    assert [r["text"] for r in few.orderBy("doc_id").collect()] == texts[:40]
    (tmp_path / "none").mkdir()
    assert xml_splits.read_xml_splits(spark, str(tmp_path / "none"), "text").count() == 0


def test_words_and_requests(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Rome\nNew York\nRome\n\n")
    words = inputs.read_words(spark, str(tmp_path / "w.txt"))
    assert [r["word"] for r in words.orderBy("place").collect()] == ["Rome", "New York", "Rome"]
    vocab = spark.createDataFrame([("Rome",)], "word string")
    assert corpus.lookup(words, vocab).count() == 2 and corpus.missing(words, vocab).count() == 1
    assert inputs.words_from(spark, ["Rome\n"], vocab).count() == 1
    with pytest.raises(ValueError):
        inputs.words_from(spark, ["Oslo\n"], vocab)
    assert [tuple(r) for r in inputs.pairs_request(spark, '{"pairs": [["a", "b"]]}').collect()] == [(0, "a", "b")]
    for body in ("x", "{}", '{"pairs": [1]}'):
        with pytest.raises(ValueError, match="Unable to parse JSON data"):
            inputs.pairs_request(spark, body)


def test_run_store(spark, tmp_path):
    runs.create_tables(spark)
    assert spark.table("batch").count() == 12 and spark.table("dat").count() == 0
    rows = [(2, 0, c, p, *[float(p)] * 6, float("nan") if p == 0 else c + p / 10, 0.5, 0.5) for c in range(3) for p in range(4)]
    dat = spark.createDataFrame(rows, runs.DAT_SCHEMA)
    runs.append(dat, str(tmp_path / "dat"), reset=True)
    back = spark.read.parquet(str(tmp_path / "dat"))
    assert back.where("fitness = 0").count() == 3
    assert {r["icycle"]: round(r["avg_fitness"], 6) for r in runs.avg_by_cycle(back).collect()} == {0: 0.15, 1: 0.9, 2: 1.65}
    assert runs.max_by_run(back, 2).first()["max_fitness"] == 2.3
    best = runs.best_by_batch(back, runs.batches(spark), [2, 17], 2).first()
    assert (best["batch_id"], best["ncorpus"], best["irun"]) == (2, 10000, 0)
    won = runs.winner(back).first()
    assert (won["iparticle"], won["fitness"], won["pos1"]) == (3, 2.3, 3.0)
    assert sum(r["share"] for r in runs.histogram(back).collect()) == pytest.approx(1)
    assert runs.positions(back, 2, 0, [1]).count() == 4 and runs.final_front(back, 2).count() == 4
    with pytest.raises(ValueError):
        runs.append(spark.createDataFrame([(*rows[0][:2], None, *rows[0][3:])], runs.DAT_SCHEMA), str(tmp_path / "dat"))


def test_keys_and_summaries(spark):
    batch = runs.batches(spark)
    assert runs.checked_batches(batch).count() == len(runs.BATCHES)
    with pytest.raises(ValueError, match="unique"):
        runs.checked_batches(batch.union(batch.limit(1)))
    with pytest.raises(ValueError, match="null"):
        runs.checked_batches(batch.withColumn("nseed", F.lit(None).cast("int")))
    dat = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 6.0), (1, 1, None)], "irun int, icycle int, fitness double")
    assert tuple(runs.summary(dat).first())[:2] == (3, 3.0) and runs.summary(dat).first()["middle"] == 2.0
    assert runs.summary(dat.limit(0)).first()["records"] == 0
    assert [tuple(r) for r in runs.blocks(dat).orderBy("irun").collect()] == [(0, 2, 2), (1, 1, 2)]


def test_log(spark, tmp_path):
    line = lambda f: "\t".join(["1", "2", "3", "4", "5", "6", f, *["0"] * 13, "0.5", "NaN"])
    (tmp_path / "log").write_text("\n".join([line("0.1"), line("NaN"), "", "", line("0.3"), line("0.4"), ""]))
    rows = runs.read_swarm_log(spark, str(tmp_path / "log"), 2).orderBy("icycle", "iparticle").collect()
    assert [(r["icycle"], r["iparticle"], r["fitness"], r["precision"], r["recall"]) for r in rows] == [(0, 0, 0.1, 0.5, 0), (0, 1, 0, 0.5, 0), (1, 0, 0.3, 0.5, 0), (1, 1, 0.4, 0.5, 0)]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} shared. other") for i in range(6)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = index.write_index(index.stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "postings"))
    assert got.drop("batch").exceptAll(corpus.postings(corpus.tokens(corpus.sentences(docs)))).count() == 0 and got.count() == 6 * 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text("".join(f"<text>{t}</text>" for t in ("Rome is the capital of Italy.", "Paris is the capital of France.", "''Oslo'' is the capital of Norway.", "left out")))
    at = ["-b", str(tmp_path / "index")]
    cli.main([*at, "-x", str(tmp_path / "xml"), "--xl", "4", "--xp", "wikitext::strip_markup"])
    cli.main([*at, "-s"])
    saved = corpus.Corpus.load(spark, str(tmp_path / "index"))
    assert saved.sentences.count() == 3  # a limit of 4 takes 3
    (tmp_path / "c.toml").write_text(TOML.replace('["Portugal", "Italy"]', '["Rome", "Atlantis"]').replace("-15.0", "0.0").replace("-40.0", "0.0").replace("-13.0", "1.0"))
    cli.main([*at, "-c", str(tmp_path / "c.toml")])
    assert "Italy" in capsys.readouterr().out.split()
    (tmp_path / "p.json").write_text(json.dumps({"pairs": [["Rome", "Italy"], ["Paris", "France"]]}))
    cli.main([*at, "-r", str(tmp_path / "p.json")])
    (tmp_path / "ref.txt").write_text("Rome\nParis\nOslo\nLondon\n")
    cli.main([*at, "-t", str(tmp_path / "ref.txt"), "--tnparticles", "2", "--tniter", "1", "--tnbwords", "2", "--to", str(tmp_path / "log")])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
