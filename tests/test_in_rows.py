"""What is answered in the row of a sentence equals what a shuffle of its tokens gives, for odd documents too."""

import pytest

from textloom.operators import corpus, expansion, lookup, relations

LONG_TEXT = " ".join(f"w{i % 700}" for i in range(1500)) + " the end"
DOCS = [(1, "The cat sat on the mat. A cat of the mat!"), (2, "one, two, two of the two"), (2, "two again of the one"), (None, "the lost of one"), (None, "the lost of one"), (3, None), (4, ""), (5, LONG_TEXT), (6, "the a of b. the a of c. cat of the one")]


@pytest.fixture(scope="module")
def sents(spark):
    return corpus.sentences(corpus.marked(spark.createDataFrame(DOCS, "doc_id long, text string"))).persist()


def same(a, b):
    assert a.columns == b.columns and [t for _, t in a.dtypes] == [t for _, t in b.dtypes]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_only_documents_with_an_id_of_their_own_are_alone(sents):
    assert {r["doc_id"] for r in sents.where("alone").collect()} == {1, 5, 6} and {r["doc_id"] for r in sents.where("not alone").collect()} == {2, None}


def test_repeated_ids_in_great_number(spark, sents, monkeypatch):
    monkeypatch.setattr(corpus, "BROADCAST_IDS", 0)
    same(corpus.sentences(corpus.marked(spark.createDataFrame(DOCS, "doc_id long, text string"))), sents)


def test_postings(sents):
    same(corpus.sentence_postings(sents), corpus.postings(corpus.tokens(sents)))
    assert shuffles(corpus.sentence_postings(sents)) == 1  # that of the rest


@pytest.mark.parametrize("most", [lookup.MOST, 1])
def test_cooccurrence(spark, sents, most, monkeypatch):
    monkeypatch.setattr(lookup, "MOST", most)
    posts = corpus.postings(corpus.tokens(sents))
    for words in (["the", "cat", "cat", "none"], ["two", "w3", "w699", "the"], []):
        sources = spark.createDataFrame([(w,) for w in words], "word string")
        want = {}
        rows = posts.collect()
        for x in rows:
            if x["word"] in words and x["doc_id"] is not None:
                for y in rows:
                    if (y["doc_id"], y["spos"]) == (x["doc_id"], x["spos"]):
                        want.setdefault(y["word"], [set(), 0])
                        want[y["word"]][0].add(x["word"])
                        want[y["word"]][1] += y["tf"]
        for given in (sents, posts):
            got = {r["word"]: (r["k"], r["n"]) for r in expansion.cooccurrence(given, sources, most).collect()}
            assert got == {w: (len(k), n) for w, (k, n) in want.items()}


def test_found_by_marks(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('w', id % 5000) word")
    table = spark.range(100).selectExpr("concat('w', id * 7) word")
    assert lookup.likely(rows, table, "word").count() < 1000
    for how in ("inner", "left_semi"):
        same(lookup.found(rows, table, "word", 100, how, most=0), lookup.found(rows, table, "word", 100, how))


def test_pairs_and_patterns(spark, sents):
    pairs = relations.seed_pairs(spark, [("the", "of"), ("of", "the"), ("cat", "mat"), ("the", "of")])
    toks = corpus.tokens(sents)
    same(relations.sentences_of_pairs(sents, pairs), relations.pair_sentences(toks, pairs))
    same(relations.patterns_of_pairs(sents, pairs), relations.patterns(sents, relations.pair_sentences(toks, pairs)))
    assert shuffles(relations._pairs_in_rows(corpus.apart(sents)[0], pairs)) == 0


def test_long_sentences_are_answered_in_their_rows(spark):
    long = spark.createDataFrame([(1, "the b " + LONG_TEXT + " of it"), (2, "the a of b")], "doc_id long, text string")
    here, rest = corpus.apart(corpus.sentences(corpus.marked(long)), None)
    assert here.where(f"size(words) > {corpus.LONG}").count() == 1 and rest.isEmpty()
    pairs = relations.seed_pairs(spark, [("the", "of"), ("of", "the"), ("w3", "w699"), ("the", "none")])
    for found, want in ((relations.sentences_of_pairs(here, pairs), relations.pair_sentences(corpus.tokens(here), pairs)), (relations.patterns_of_pairs(here, pairs), relations.patterns(here, relations.pair_sentences(corpus.tokens(here), pairs)))):
        same(found, want)
    from_rows = relations.patterns_of_pairs(corpus.sentences(corpus.marked(long)), pairs)
    plan = from_rows._jdf.queryExecution().optimizedPlan().toString()
    assert "> 512" in plan and "<= 512" not in plan  # long ones are unfolded in place, none go the way of tokens
