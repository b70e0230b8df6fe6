import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, expansion, lookup
from textloom.plans import edges, optimise, swarm, training
from textloom.sources import runs


def sine(particles):
    return particles.select("particle", (4 * F.pow(F.sin(F.get("pos", 0)), 2) + 4 * F.pow(F.sin(F.get("pos", 1)), 2)).alias("fitness"))


def test_pso_finds_the_maximum(spark):
    out = optimise.pso(spark, sine, [(0, 6), (0, 6)], 30, 12, swarm.Coefficients(0.6, 0.6, 0.3), 0.0, seed=1)
    best = 4 * np.sin(out.position[0]) ** 2 + 4 * np.sin(out.position[1]) ** 2
    assert best > 7.5
    assert out.log[["pos1", "pos2"]].to_numpy().min() >= 0 and out.log[["pos1", "pos2"]].to_numpy().max() <= 6
    assert (out.log.groupby("iparticle").pbest_fitness.diff().dropna() >= 0).all() and out.log.icycle.max() == 12
    again = optimise.pso(spark, sine, [(0, 6), (0, 6)], 30, 2, seed=1).log
    assert again.equals(optimise.pso(spark, sine, [(0, 6), (0, 6)], 30, 2, seed=1).log)


def test_mopso_keeps_a_front(spark):
    identity = lambda p: p.select("particle", F.get("pos", 0).alias("a"), F.get("pos", 1).alias("b"))
    out = optimise.mopso(spark, identity, ["a", "b"], [(-100, 100)] * 2, [(-10, 10)] * 2, [True, True], 20, 4)
    f = out.archive[["a", "b"]].to_numpy()
    assert not any((f >= x).all(axis=1)[i] and (f > x).any(axis=1)[i] for x in f for i in range(len(f)))
    tops = [g[["a", "b"]].sum(axis=1).max() for _, g in out.log.groupby("icycle")]
    assert tops == sorted(tops)
    far = optimise.mopso(spark, identity, ["a", "b"], [(-100, 100)] * 2, [(-100, 100)] * 2, [True, True], 20, 6, swarm.Coefficients(1.5, 1.5, 0.9), seed=3).log
    moved = far[(far[["vel1", "vel2"]] != 0).any(axis=1)]
    assert len(moved) and (far[far.icycle == 0][["vel1", "vel2"]] == 0).all().all()
    assert np.allclose(far[["pbest1", "pbest2"]], far[["pbest_a", "pbest_b"]])  # the identity of the best position
    assert not np.allclose(moved[["vel1", "vel2"]], moved[["pos1", "pos2"]])


def test_steps(spark):
    nan = float("nan")
    rows = [(0, [1.0], [0.5], [3.0], 0.2, 0.1), (1, [2.0], [0.0], [0.0], 0.9, 0.95), (2, [-5.0], [0.0], [9.0], nan, 0.0), (3, [4.0], [1.0], [4.0], 0.9, 0.9)]
    s = spark.createDataFrame(rows, "particle long, pos array<double>, vel array<double>, pbest array<double>, fitness double, pbest_fitness double")
    best = {r["particle"]: (r["pbest"], r["pbest_fitness"]) for r in swarm.personal_best(s).collect()}
    assert best == {0: ([1.0], 0.2), 1: ([0.0], 0.95), 2: ([9.0], 0.0), 3: ([4.0], 0.9)}
    assert swarm.leader(s).first()["leader"] == 3  # the last of equals, never a NaN
    assert swarm.leader(s.where("particle = 2")).first()["leader"] == 0
    lead = s.where("particle = 3").select(F.col("pos").alias("lpos"))
    half = F.array(F.lit(0.5))
    moved = {r["particle"]: (r["vel"][0], r["pos"][0]) for r in swarm.move(s, lead, swarm.Coefficients(0.2, 0.2, 0.02), [(-4.0, 4.0)], half, half).collect()}
    assert moved[0] == pytest.approx((0.02 * 0.5 + 0.1 * 2 + 0.1 * 3, 1 + 0.51))
    assert moved[2][1] == pytest.approx(-5 + 0.1 * 14 + 0.1 * 9)
    assert swarm.initial(spark, 3, [(0, 1), (5, 6)], 7).where("pos[0] between 0 and 1 and pos[1] between 5 and 6").count() == 3
    archive = spark.createDataFrame([([1.0, 2.0], 1, 0.25), ([3.0, 4.0], 2, 0.75)], "pos array<double>, rank int, weight double")
    drawn = swarm.draw_leaders(archive, s, 2).collect()
    assert all(r["lpos"][0] in (1, 3) and r["lpos"][1] in (2, 4) for r in drawn)
    p = spark.createDataFrame([(0, [1.0], [0.0], [5.0, 5.0], [4.0, 4.0]), (1, [1.0], [0.0], [5.0, 1.0], [4.0, 4.0]), (2, [1.0], [0.0], [1.0, 1.0], [4.0, 4.0])], "particle long, pos array<double>, pbest array<double>, fitness array<double>, pbest_fitness array<double>")
    assert [r["pbest"] for r in swarm.personal_best_pareto(p, [True, True]).orderBy("particle").collect()] == [[1.0], [1.0], [0.0]]


def test_scores_of_words_in_several_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 12))) for i in range(60)]
    posts = corpus.postings(corpus.tokens(corpus.sentences(spark.createDataFrame(docs, "doc_id long, text string")))).persist()
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    pos = rng.uniform(*np.array(training.BOUNDS).T, (40, 6)) * [1, 1, 0.02, 1, 1, 0.02]
    whole = training.ExpansionFitness(posts, words("w1", "w2"), words("w3", "w4", "none")).values(pos)
    monkeypatch.setattr(training, "CHUNK", 5)
    split = training.ExpansionFitness(posts, words("w1", "w2"), words("w3", "w4", "none"))
    assert split.several and np.array_equal(split.values(pos), whole, equal_nan=True)
    for p, (f1, precision, recall) in list(zip(pos, whole))[:4]:
        got = {r["word"] for r in expansion.expand_concept(posts, words("w1", "w2"), expansion.ExpansionParams.from_vector(p)).collect()}
        tp = len(got & {"w3", "w4"})
        assert (precision, recall) == pytest.approx((tp / len(got) if got else 0, tp / 3))
        assert np.isnan(f1) if not tp else f1 == pytest.approx(2 * tp / (len(got) + 3))


def test_training(spark, tmp_path):
    docs = spark.createDataFrame([(0, "red green blue. red green one. two three. blue four"), (1, "green blue red. one two. five six")], "doc_id long, text string")
    posts = corpus.postings(corpus.tokens(corpus.sentences(docs))).persist()
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    options = training.TrainingOptions(particles=6, iterations=2, random_seed=3)
    out = training.train_pso(spark, posts, words("red"), words("red", "green", "blue"), options)
    assert len(out.log) == 18 and len(out.position) == 6
    replay = {r["word"] for r in out.replay.collect()}
    last = out.log[out.log.icycle == 2]
    lead = last[last.fitness == last.fitness.max()].iloc[-1]
    tp = len(replay & {"red", "green", "blue"})
    assert lead.recall == pytest.approx(tp / 3)
    two = training.train_mopso(spark, posts, words("red"), words("red", "green", "blue"), options)
    rows = runs.from_log(two.log, spark, 4, 0)
    runs.append(rows, str(tmp_path / "dat"), reset=True)
    assert spark.read.parquet(str(tmp_path / "dat")).where("fitness = -1 and iparticle = -1").count() == len(two.log)
    full = runs.full_log(two.log, spark)
    assert len(full.columns) == 23 and full.count() == len(two.log)
    runs.write_log(out.log, str(tmp_path / "swarm.tsv"))
    back = runs.read_swarm_log(spark, str(tmp_path / "swarm.tsv"), 6).orderBy("icycle", "iparticle").toPandas()
    assert len(runs.full_log(out.log, spark).columns) == 24 and np.allclose(back[runs.POSITIONS], out.log[runs.POSITIONS]) and back.icycle.tolist() == out.log.icycle.tolist()
    assert np.allclose(back.fitness, out.log.fitness.fillna(0))


@pytest.mark.parametrize("most", [500_000, 60])
def test_edges_of_odd_sentences(spark, monkeypatch, most):
    """Lists of sources in place of rows of pairs: as a count by hand, from sentences and from postings, cut small at every step."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{k}" for k in rng.zipf(1.4, n) % 300)
    rows = [(i, ". ".join(text(9) for _ in range(5))) for i in range(40)] + [(40, text(900)), (7, text(30)), (7, "w1 w2 w2"), (None, "w1 lost"), (None, "w1 lost"), (41, None), (42, "")]
    sents = corpus.sentences(corpus.marked(spark.createDataFrame(rows, "doc_id long, text string"))).persist()
    posts = corpus.postings(corpus.tokens(sents)).persist()
    monkeypatch.setattr(edges, "TOKENS", 200), monkeypatch.setattr(edges, "PAIRS", 1000), monkeypatch.setattr(lookup, "MOST", most)
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    for chunk, given in ((65_536, sents), (5, posts)):
        monkeypatch.setattr(training, "CHUNK", chunk)
        fitness = training.ExpansionFitness(given, words("w1", "w33"), words("w2", "none"))
        first = {r["id"]: r["word"] for r in expansion.cooccurrence(posts, words("w1", "w33")).join(corpus.doc_freq(posts), "word").orderBy(F.desc("df"), "word").select("word").rdd.zipWithIndex().map(lambda x: {"id": x[1], "word": x[0][0]}).collect()}
        names, want, here = set(first.values()), {}, {}
        for r in posts.where("doc_id is not null").collect():
            here.setdefault((r["doc_id"], r["spos"]), []).append((r["word"], r["tf"]))
        for s in here.values():
            for w, tf in s:
                for v, _ in s:
                    if v in names:
                        want[w, v] = want.get((w, v), 0) + tf
        rows = fitness.edges.collect()
        got = [((r["word"], first[i]), n) for r in rows for i, n in zip(r["sources"], r["n"], strict=True)]
        assert len(got) == len(want) and dict(got) == want
        assert all(len(r["sources"]) <= chunk for r in rows) and {r["word"] for r in rows if r["right"]} == {"w2"}
        df = dict(map(tuple, corpus.doc_freq(posts).collect()))
        assert all(r["df"] == df[r["word"]] for r in rows)
        times = [r["word"] for r in rows]
        assert all((r["parts"] > 1) or times.count(r["word"]) == 1 for r in rows)
        assert most == 60 or chunk == 5 or len(rows) == len({w for w, _ in want})


def test_pairs_are_never_rows():
    """A slice gives a row for each word, however many sources it meets, in about a byte or two for each."""
    n = 300
    tokens = pa.record_batch({"pos": pa.array(list(range(n)) * 3, pa.int32()), "word": [f"w{i}" for i in range(n)] * 3, "tf": [1] * 3 * n, "source": [i if i % 2 else None for i in range(n)] * 3})
    out = pa.Table.from_batches(list(edges._lists([tokens], n, 1000, 1 << 20)))
    assert out.num_rows == n and set(map(len, out.column("sources").to_pylist())) == {n // 2}
    with pytest.raises(ValueError, match="one behind another"):
        list(edges._lists([tokens.take(pa.array([0, 2, 1]))], n, 1000, 1 << 20))
