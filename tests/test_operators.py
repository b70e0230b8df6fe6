import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import corpus, expansion, metrics, pareto, relations

DOCS = [
    (0, "Rome is the capital of Italy. Paris is the capital of France!\nBerlin, the capital of Germany"),
    (1, "Paris is the capital of France. Rome, the capital of Italy. Madrid is the capital of Spain."),
    (2, "the the of of. Lisbon is the capital of the republic"),
    (3, None),
    (4, ""),
    (5, "Rome is the capital of Italy. Oslo is the capital of Norway. Athens, the capital of Greece."),
]


@pytest.fixture(scope="module")
def built(spark):
    return corpus.build(spark.createDataFrame(DOCS, "doc_id long, text string"))


@pytest.fixture(scope="module")
def sents(built):
    found = {(r["doc_id"], r["spos"]): r["words"] for r in built.sentences.collect()}
    return dict(sorted(found.items()))


def test_index(built, sents):
    assert len(sents) == 3 + 3 + 2 + 3
    posts = {(r["doc_id"], r["spos"], r["word"]): (r["tf"], r["first_pos"]) for r in built.postings.collect()}
    assert posts == {(*k, w): (n, ws.index(w)) for k, ws in sents.items() for w, n in Counter(ws).items()}
    order = list(dict.fromkeys(w for ws in sents.values() for w in ws))
    assert [r["word"] for r in built.vocab.orderBy("word_id").collect()] == order
    corpus.check_sound(built.vocab, built.postings)
    with pytest.raises(ValueError):
        corpus.check_sound(built.vocab, built.postings.where("word <> 'Rome'"))
    decoded = {(r["doc_id"], r["spos"]): r["sentence"] for r in corpus.decode(built.tokens).collect()}
    assert decoded == {k: " ".join(w) for k, w in sents.items()}


def test_limit(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert [corpus.limited(docs, n, c).count() for n, c in ((None, True), (3, False), (3, True), (0, True), (99, True))] == [6, 3, 2, 0, 6]
    assert [corpus.parse_limit(x) for x in ("7", "x", None)] == [7, None, None]


def test_save_and_load(spark, built, tmp_path):
    built.save(str(tmp_path))
    again = corpus.Corpus.load(spark, str(tmp_path))
    assert again.postings.count() == built.postings.count()
    assert again.word(0).first()["word"] == "Rome"
    assert again.sentences_of("Rome").count() == 3
    assert again.sentence(0, 0).count() == 1
    with pytest.raises(ValueError):
        built.save("")


def hop_model(sents, sources, a, b, g):
    df, k, n = Counter(), defaultdict(set), Counter()
    for ws in sents.values():
        df.update(set(ws))
        for s in set(ws) & set(sources):
            for w in ws:
                k[w].add(s)
                n[w] += 1
    return {w: (df[w], len(k[w]), n[w], df[w] * g + len(k[w]) * a + n[w] * b) for w in n}


@pytest.mark.parametrize("params", [expansion.ExpansionParams(5, 1, -1, 3, 2, 1, -3, 0), expansion.ExpansionParams(), expansion.SHIPPED])
def test_expansion(spark, built, sents, params):
    seeds = spark.createDataFrame([("Rome",), ("Paris",), ("nowhere",), ("Rome",)], "word string")
    first = hop_model(sents, {"Rome", "Paris"}, params.a1, params.b1, params.g1)
    alive = {w for w, x in first.items() if x[3] >= params.t1}
    second = {w: x for w, x in hop_model(sents, alive, params.a2, params.b2, params.g2).items() if x[3] >= params.t2}
    got = {r["word"]: (r["df"], r["k"], r["n"], r["fitness"]) for r in expansion.expand_concept(built.postings, seeds, params).collect()}
    assert got == second
    one = {r["word"]: r["n"] for r in expansion.cooccurrences_for_word(built.postings, "Rome").collect()}
    assert one == {w: x[2] for w, x in hop_model(sents, {"Rome"}, 0, 0, 0).items()}


def test_params():
    p = expansion.ExpansionParams.from_vector([1, 2, 3, 4, 5, 6], 0.5)
    assert p.to_vector() == [1, 2, 3, 4, 5, 6] and p.t1 == p.t2 == 0.5


def relation_model(sents, pairs):
    patterns, last = [], lambda ws, w: max(i for i, x in enumerate(ws) if x == w)
    for idx, (a, b) in enumerate(pairs):
        for key, ws in sents.items():
            if a in ws and b in ws:
                p, q = last(ws, a), last(ws, b)
                lo, hi = sorted((p, q))
                patterns.append((idx, key, ws[lo - 1] if lo else None, tuple(ws[lo + 1 : hi]), ws[hi + 1] if hi + 1 < len(ws) else None, p < q))
    groups = defaultdict(list)
    for p in patterns:
        groups[p[3]].append(p)
    scores = {}
    for infix, ps in groups.items():
        size = -40 if len(infix) <= 1 or len(infix) >= 5 else 0
        scores[infix] = (size + 10 * len({p[0] for p in ps}) - 2 * len(ps), min(ps, key=lambda p: (p[0], p[1]))[5])
    return patterns, scores


def test_relations(spark, built, sents):
    pairs = [("Rome", "Italy"), ("Paris", "France"), ("Berlin", "Germany")]
    table = relations.seed_pairs(spark, pairs)
    relations.check_known(built.postings, table)
    patterns, scores = relation_model(sents, pairs)
    found = relations.patterns(built.sentences, relations.pair_sentences(built.tokens, table))
    assert sorted((r["pair_idx"], r["doc_id"], r["spos"], tuple(r["infix"]), r["forward"]) for r in found.collect()) == sorted((p[0], *p[1], p[3], p[5]) for p in patterns)
    scored = relations.score_patterns(found)
    assert {tuple(r["infix"]): (r["fitness"], r["forward"]) for r in scored.collect()} == scores
    good = relations.pattern_survivors(scored)
    assert {tuple(r["infix"]) for r in good.collect()} == {k for k, v in scores.items() if v[0] >= 12}
    matches = relations.pattern_matches(built.sentences, good)
    got = {(r["w1"], r["w2"]) for r in matches.collect()}
    assert ("Oslo", "Norway") in got and ("Madrid", "Spain") in got
    assert ("Lisbon", "republic") in got  # "the" behind the pattern gives way
    assert not any("the" in p for p in got)
    with pytest.raises(ValueError):
        relations.seed_pairs(spark, [("a", "a")])
    with pytest.raises(ValueError):
        relations.check_known(built.postings, relations.seed_pairs(spark, [("Rome", "Atlantis")]))


def test_relation_pairs(spark):
    matches = spark.createDataFrame([(["a", "b"], "x", "y"), (["c", "d"], "x", "y"), (["a", "b"], "x", "z"), (["a", "b"], "x", "z"), (["c"], "x", "w"), (["d"], "x", "w"), (["e"], "x", "w")], "infix array<string>, w1 string, w2 string")
    df = spark.createDataFrame([(w, 5) for w in "xyzw"], "word string, df long")
    scored = relations.score_pairs(matches, df, 10)
    assert {(r["w1"], r["w2"]): r["fitness"] for r in scored.collect()} == {("x", "y"): 20, ("x", "z"): 10, ("x", "w"): 30}
    assert [tuple(r) for r in relations.grouped(relations.pair_survivors(scored)).collect()] == [("x", ["w", "y"])]
    assert [r["w2"] for r in relations.ranked(scored).orderBy("rank").collect()] == ["w", "y", "z"]


def test_precision_recall(spark):
    words = lambda xs: spark.createDataFrame([(str(x),) for x in xs], "word string")
    row = metrics.precision_recall(words([2, 4, 7, 8, 10, 23, 123, 2]), words([1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 0])).first()
    assert (row["precision"], row["recall"]) == (pytest.approx(4 / 7), pytest.approx(4 / 10))
    none = metrics.f1(metrics.precision_recall(words([]), words([1]))).first()
    assert (none["precision"], none["recall"]) == (0, 0) and np.isnan(none["f1"])
    assert metrics.f1(metrics.precision_recall(words([1]), words([2])), nan_as_zero=True).first()["f1"] == 0
    assert np.isnan(metrics.precision_recall(words([1]), words([])).first()["recall"])


def better(x, y, up):
    pairs = [(a, b) if m else (b, a) for a, b, m in zip(x, y, up, strict=True)]
    return all(a >= b for a, b in pairs) and any(a > b for a, b in pairs)


def test_dominates(spark):
    cases = [((90, 90), (80, 80), True), ((80, 80), (90, 90), False), ((90, 80), (80, 90), False), ((5, 5), (5, 5), False), ((float("nan"), 9), (1, 1), False), ((5, 6), (5, 5), True)]
    rows = spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y, _) in enumerate(cases)], "i int, a double, b double, c double, d double")
    got = {r["i"]: r["v"] for r in rows.select("i", pareto.dominates([F.col("a"), F.col("b")], [F.col("c"), F.col("d")], [True, True]).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, _, v in cases]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=30))
def test_local_front(points):
    keep = pareto.local_front(np.array(points, float))
    assert keep.tolist() == [not any(better(q, p, [True] * 3) for q in points) for p in points]


def test_front_and_crowding(spark):
    rng = np.random.default_rng(3)
    points = [(i, *map(float, rng.integers(0, 9, 2))) for i in range(60)]
    rows = spark.createDataFrame(points, "id int, x double, y double").repartition(5)
    for up in itertools.product([True, False], repeat=2):
        want = {p[0] for p in points if not any(better(q[1:], p[1:], up) for q in points)}
        assert {r["id"] for r in pareto.pareto_front(rows, ["x", "y"], up).collect()} == want
    front = spark.createDataFrame([(0, 0.0, 9.0), (1, 2.0, 5.0), (2, 3.0, 4.0), (3, 9.0, 0.0)], "id int, x double, y double")
    got = {r["id"]: r for r in pareto.leader_weights(pareto.crowding_distance(front, ["x", "y"], [(0, 10), (0, 10)], "id"), "id").collect()}
    assert got[1]["distance"] == pytest.approx(0.3 + 0.5) and got[2]["distance"] == pytest.approx(0.7 + 0.5)
    assert got[0]["distance"] == got[3]["distance"] == 1.7976931348623157e308
    assert [got[i]["rank"] for i in range(4)] == [3, 1, 2, 4] and got[3]["weight"] == pytest.approx(0.4)
    single = pareto.crowding_distance(front.where("id = 1"), ["x", "y"], [(0, 10), (0, 10)], "id").first()
    assert single["distance"] == 1.7976931348623157e308


def test_first_places_are_hashed(spark):
    """Ids at both ends and null: as the least of a struct gives them, without a sort of all tokens."""
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    rows = [(i, s, p, w) for i in ids for s in (0, 3, (1 << 31) - 1) for p, w in ((0, f"own{i}"), ((1 << 31) - 1, "a"), (2, "b" if i else "c"), (1, f"at{s}"))]
    toks = spark.createDataFrame(rows, "doc_id long, spos int, pos int, word string")
    want = toks.groupBy("word").agg(F.min(F.struct("doc_id", "spos", "pos")).alias("first")).select("word", "first.*")
    got = corpus.first_places(toks)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    named = corpus.first_places(toks.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert dict(named.dtypes)["doc_id"] == "string" and named.count() == want.count()


def test_buckets_grow_with_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "BUCKET_ROWS", 3)
    corpus.build(spark.createDataFrame([(1, "one two three four. five six seven. one two three four five six seven eight nine")], "doc_id long, text string")).save(f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/layout").first()["buckets"] == 6
    assert corpus.Corpus.load(spark, f"{tmp_path}/i").df.where("word = 'two' and df = 2").count() == 1
