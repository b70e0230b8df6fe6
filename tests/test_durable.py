"""What is kept and told: saved indexes, logs in blocks, the store's SQL, channels, resumed training, tables made once."""

import contextlib
import io
import logging
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.channel import Channel, Counted
from textloom.operators import corpus, relations
from textloom.plans import optimise, swarm
from textloom.sources import inputs, runs


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_saved_index_finds_words_without_a_shuffle(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    built = corpus.build(docs)
    built.save(str(tmp_path / "index"), 8)
    saved = corpus.Corpus.load(spark, str(tmp_path / "index"))
    assert all(len([f for f in os.listdir(tmp_path / "index" / t) if f.endswith(".parquet")]) == 8 for t in corpus.BY_WORD)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file is a task
    try:
        assert saved.sentences_of("the").rdd.getNumPartitions() == 1 and saved.postings.rdd.getNumPartitions() == 8
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert saved.sentences_of("the").count() == built.sentences_of("the").count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(saved.vocab.join(saved.df, "word"))
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" not in plan_of(saved.df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    corpus.check_sound(saved.vocab, saved.postings)
    corpus.build(docs.limit(3)).save(str(tmp_path / "index"), 4)
    assert corpus.Corpus.load(spark, str(tmp_path / "index")).sentences.select("doc_id").distinct().count() == 3
    with pytest.raises(ValueError):
        built.save("")


@pytest.mark.parametrize("split", ["3000", "1000", "128m"])
def test_logs_in_blocks(spark, tmp_path, split):
    rng = np.random.default_rng(1)
    for name, cycles in (("a.tsv", 30), ("b.tsv", 4)):
        blocks = []
        for c in range(cycles):
            rows = [[c + p / 100] * 6 + [float("nan") if p == 1 else c * 1000.0 + p] + [0.0] * 13 + [0.5, 0.25] for p in range(rng.integers(1, 12))]
            blocks.append("".join("\t".join("NaN" if v != v else repr(v) for v in r) + "\n" for r in rows) + "\n\n")
        (tmp_path / name).write_text("".join(blocks))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = runs.read_log_blocks(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, cycles in (("a.tsv", 30), ("b.tsv", 4)):
        own = got[got.file.str.endswith(name)]
        assert sorted(own.icycle.unique()) == list(range(cycles))
        assert ((own.fitness == own.icycle * 1000 + own.iparticle) | ((own.iparticle == 1) & (own.fitness == 0))).all()
        assert np.allclose(own.pos1, own.icycle + own.iparticle / 100) and (own.recall == 0.25).all()
        assert all(sorted(g.iparticle) == list(range(len(g))) for _, g in own.groupby("icycle"))


def test_written_logs_come_back_in_blocks(spark, tmp_path):
    log = pd.DataFrame([{"icycle": c, "iparticle": p, **{k: float(c + p) for k in runs.LOG_COLUMNS}} for c in range(5) for p in range(3 + c)])
    runs.write_log(log, str(tmp_path / "swarm.tsv"))
    back = runs.read_log_blocks(spark, str(tmp_path / "swarm.tsv")).orderBy("icycle", "iparticle").toPandas()
    assert back.icycle.tolist() == log.icycle.tolist() and back.iparticle.tolist() == log.iparticle.tolist() and np.allclose(back.fitness, log.fitness)


def test_sql_over_the_store(spark):
    rows = [(b, r, c, p, *[float(p)] * 6, c + p / 10, 0.5, 0.5) for b in (2, 99) for r in range(2) for c in range(3) for p in range(4)]
    runs.open_store(spark, spark.createDataFrame(rows, runs.DAT_SCHEMA))
    best = runs.ask(spark, "best_by_corpus", batches=[2, 99, 17], cycle=2).collect()
    assert [tuple(r) for r in best] == [(99, None, 1, 2.3), (2, 10000, 1, 2.3)]
    assert sum(r["share"] for r in runs.ask(spark, "shares", batch=2, cycle=1, width=0.05).collect()) == pytest.approx(1)
    assert runs.ask(spark, "SELECT count(*) AS n FROM dat JOIN batch USING (batch_id) WHERE icycle = :cycle", cycle=0).first()["n"] == 8
    kept = runs.ask(spark, "SELECT sum(fitness) AS s FROM dat")
    runs.close_store(spark)
    assert kept.first()["s"] == pytest.approx(4 * (3 * 4 + 3 * 0.6))
    assert {s for s in runs.STATEMENTS if "dat" not in runs.STATEMENTS[s]} == set()


def test_a_channel_outlives_its_receiver(caplog):
    got = []

    def receiver(line):
        if len(got) == 2:
            raise ConnectionError("gone")
        got.append(line)

    channel = Channel(receiver)
    with caplog.at_level(logging.INFO, "textloom"):
        for i in range(5):
            channel.send(f"line {i}")
    assert got == ["line 0\n", "line 1\n"] and not channel.valid and isinstance(channel.failed, ConnectionError)
    assert [r.message for r in caplog.records if r.message.startswith("line")] == [f"line {i}" for i in range(5)]
    assert sum("failed" in r.message for r in caplog.records) == 1 and not Channel().valid


def test_counters_are_observed_on_the_way(spark):
    lines = []
    counted = Counted(spark.range(100), "numbers", F.count("*").alias("all"), F.count_if(F.col("id") % 2 == 0).alias("even"))
    assert counted.rows.where("id > 97").count() == 2
    assert counted.report(Channel(lines.append)) == {"all": 100, "even": 50} and lines == ["numbers: all 100, even 50\n"]


def test_progress_of_relations_and_the_article(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Rome is the capital of Italy today.", "Paris is the capital of France now.", "So Oslo is the capital of Norway."] * 2)], "doc_id long, text string")
    built = corpus.build(docs)
    lines = []

    def broken(line):
        lines.append(line)
        raise OSError("closed")

    pairs = inputs.pairs_request(spark, '{"pairs": [["Rome", "Italy"], ["Paris", "France"]]}')
    relations.relate(built.sentences, built.tokens, built.postings, pairs, Channel(broken)).collect()
    assert len(lines) == 1 and lines[0] == "patterns of pairs: pattern_count 4\n"
    assert relations.bind_article(built.vocab) == "the"
    with pytest.raises(ValueError, match="lacks 'der'"):
        relations.bind_article(built.vocab, "der")
    sents = spark.createDataFrame([(0, 0, ["A", "x", "y", "der", "B"])], "doc_id long, spos int, words array<string>")
    found = spark.createDataFrame([(["x", "y"], True)], "infix array<string>, forward boolean")
    assert [r["w2"] for r in relations.pattern_matches(sents, found, "der").collect()] == ["B"] and [r["w2"] for r in relations.pattern_matches(sents, found).collect()] == ["der"]


class Stopped(Exception):
    pass


def test_stopped_training_goes_on(spark, tmp_path):
    sine = lambda p: p.select("particle", (4 * F.pow(F.sin(F.get("pos", 0)), 2) + F.when(F.col("particle") == 1, float("nan")).otherwise(0.0)).alias("fitness"))
    pair = lambda p: p.select("particle", F.get("pos", 0).alias("a"), F.get("pos", 1).alias("b"))
    c = swarm.Coefficients(0.6, 0.6, 0.3)
    run = lambda store, callback=None: optimise.pso(spark, sine, [(0, 6), (0, 6)], 8, 5, c, 0.0, seed=4, store=store, callback=callback)
    two = lambda store, callback=None: optimise.mopso(spark, pair, ["a", "b"], [(-9, 9)] * 2, [(-9, 9)] * 2, [True, True], 8, 4, c, seed=4, store=store, callback=callback)

    def stop(cycle, rows):
        if cycle == 2:
            raise Stopped

    for name, train in (("one", run), ("two", two)):
        whole, store = train(None), str(tmp_path / name)
        with pytest.raises(Stopped):
            train(store, stop)
        assert sorted(os.listdir(store)) == ["cycle=0", "cycle=1", "cycle=2"]
        os.makedirs(f"{store}/cycle=3/_temporary")  # a write that was cut off
        seen = []
        resumed = train(store, lambda cycle, rows: seen.append(cycle))  # noqa: B023
        assert seen[0] == 3 and resumed.position == whole.position
        pd.testing.assert_frame_equal(resumed.log, whole.log, check_dtype=False)
        again = train(store, lambda *a: pytest.fail("nothing is left to do"))
        pd.testing.assert_frame_equal(again.log, whole.log, check_dtype=False)
        assert again.position == whole.position


def test_once_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    made = []

    def table():
        return session.once(spark, "numbers", path, lambda: made.append(1) or spark.read.parquet(path))

    spark.range(5).write.parquet(path)
    assert table().count() == table().count() == 5 and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(path)
    assert table().count() == 7 and len(made) == 2


def test_requests_in_a_column(spark):
    rows = spark.createDataFrame([(1, '{"pairs": [["a", "b"], ["c", "d"]]}'), (2, '{"pairs": []}')], "id int, value string")
    assert [tuple(r) for r in inputs.pair_requests(rows, "value", "id").collect()] == [(1, 0, "a", "b"), (1, 1, "c", "d")]
    for body in ("x", "{}", '{"pairs": [["a"]]}'):
        with pytest.raises(Exception, match="Unable to parse JSON data"):
            inputs.pair_requests(spark.createDataFrame([(body,)], "value string")).collect()
