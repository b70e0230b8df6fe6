"""Relation extraction from seed word pairs: infix patterns of the pairs' sentences, and the pairs that good patterns yield.

Input pairs are a small table (pair_idx, w1, w2); a pair that is listed twice counts twice. Pairs of a word with itself, and words
that the corpus lacks, are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.channel import Channel, Counted
from textloom.session import materialize

from . import corpus, lookup, ordered

KEY = ["doc_id", "spos"]
#: Scores and thresholds of patterns and pairs.
PATTERN_SHORT, PATTERN_LONG, PATTERN_BAD_SIZE = 1, 5, -40
PATTERN_PER_PAIR, PATTERN_PER_MATCH, PATTERN_THRESHOLD = 10, -2, 12
PAIR_PER_PATTERN, PAIR_FREQUENCY, PAIR_THRESHOLD = 10, -0.1, 20
ARTICLE = "the"


def seed_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    if any(a == b for a, b in pairs):
        raise ValueError("a pair needs two different words")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_idx int, w1 string, w2 string")


def check_known(posts: DataFrame, pairs: DataFrame) -> None:
    words = pairs.select(F.explode(F.array("w1", "w2")).alias("word")).distinct()
    unknown = [r["word"] for r in words.join(posts.select("word"), "word", "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"words that the corpus lacks: {unknown}")


def pair_sentences(toks: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_idx, w1, w2, doc_id, spos with the last position of each word, for sentences that hold both."""
    words = pairs.select(F.explode(F.array("w1", "w2")).alias("word")).distinct()
    last = toks.join(F.broadcast(words), "word", "left_semi").groupBy(*KEY, "word").agg(F.max("pos").alias("last"))  # few
    left = last.select(*KEY, F.col("word").alias("w1"), F.col("last").alias("p1")).join(F.broadcast(pairs), "w1")
    right = last.select(*KEY, F.col("word").alias("w2"), F.col("last").alias("p2"))
    return left.join(right, [*KEY, "w2"]).select("pair_idx", "w1", "w2", *KEY, "p1", "p2")


def _pairs_in_rows(sents: DataFrame, pairs: DataFrame) -> DataFrame:
    """As pair_sentences, with the words, of sentences that are one row each: without a shuffle. A long sentence is unfolded for
    words of pairs alone, as each row that it gives has all its words."""
    last = lambda w: (F.size("words") - F.array_position(F.reverse("words"), F.col(w))).cast("int")
    firsts = F.broadcast(pairs.agg(F.collect_set("w1").alias("firsts")))  # one row
    own = F.when(F.size("words") > corpus.LONG, F.array_intersect("words", "firsts")).otherwise(F.array_distinct("words"))
    rows = sents.crossJoin(firsts).select(*KEY, "words", F.explode(own).alias("w1")).join(F.broadcast(pairs), "w1")  # few
    rows = rows.where(F.array_contains("words", F.col("w2")))
    return rows.select("pair_idx", "w1", "w2", *KEY, last("w1").alias("p1"), last("w2").alias("p2"), "words")


def sentences_of_pairs(sents: DataFrame, pairs: DataFrame) -> DataFrame:
    """As pair_sentences(tokens(sents), pairs), without a shuffle for sentences that are one row each, however long."""
    here, rest = corpus.apart(sents, None)
    return _pairs_in_rows(here, pairs).drop("words").unionByName(pair_sentences(corpus.tokens(rest), pairs))


def patterns_of_pairs(sents: DataFrame, pairs: DataFrame) -> DataFrame:
    """As patterns(sents, pair_sentences(tokens(sents), pairs)), without a shuffle for sentences that are one row each, however
    long."""
    here, rest = corpus.apart(sents, None)
    return _cut(_pairs_in_rows(here, pairs)).unionByName(patterns(rest, pair_sentences(corpus.tokens(rest), pairs)))


def patterns(sents: DataFrame, found: DataFrame) -> DataFrame:
    """One pattern for each pair and sentence: the tokens around and between the last places of its words."""
    return _cut(found.join(sents.select(*KEY, "words"), KEY))


def _cut(rows: DataFrame) -> DataFrame:
    low, high = F.least("p1", "p2"), F.greatest("p1", "p2")
    return rows.select(
        "pair_idx",
        *KEY,
        F.get("words", low - 1).alias("prefix"),
        F.slice("words", low + 2, high - low - 1).alias("infix"),
        F.get("words", high + 1).alias("suffix"),
        (F.col("p1") < F.col("p2")).alias("forward"),
    )


def score_patterns(found: DataFrame) -> DataFrame:
    """By infix: k (pairs), n (matches), fitness, prefix and suffix where all matches agree, and the direction of the first match in
    the order of pair, document and sentence."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    agreed = lambda c: F.when(F.min(filled(c)) == F.max(filled(c)), F.min(c)).alias(c)
    grouped = found.groupBy("infix").agg(
        F.countDistinct("pair_idx").alias("k"),
        F.count("*").alias("n"),
        agreed("prefix"),
        agreed("suffix"),
        F.min_by("forward", F.struct("pair_idx", *KEY)).alias("forward"),
    )
    size = F.when((F.size("infix") <= PATTERN_SHORT) | (F.size("infix") >= PATTERN_LONG), PATTERN_BAD_SIZE).otherwise(0)
    return grouped.withColumn("fitness", (size + PATTERN_PER_PAIR * F.col("k") + PATTERN_PER_MATCH * F.col("n")).cast("long"))


def pattern_survivors(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("fitness") >= PATTERN_THRESHOLD)


def bind_article(vocab: DataFrame, word: str = ARTICLE) -> str:
    """The word that gives way to the next on the right of a pattern, if the dictionary has it; else an error."""
    if vocab.where(F.col("word") == word).isEmpty():
        raise ValueError(f"the dictionary lacks {word!r}, which relations need; build the index from texts that have it, or name another article")
    return word


def pattern_matches(sents: DataFrame, found: DataFrame, article: str = ARTICLE) -> DataFrame:
    """infix, doc_id, spos, w1, w2 for sentences where the pattern stands at the first place of its first token. A right word that is
    the article gives way to the next token. Matches without a word on either side drop out, and patterns without a token match nothing.

    From the first place of each word of a sentence that begins a pattern, runs of as many tokens as patterns have are joined with the
    patterns by value: a frequent first word costs a row a sentence and length, however many patterns it begins."""
    found = materialize(found.where(F.size("infix") > 0).select("infix", "forward"), "patterns")
    lengths = sorted(r[0] for r in found.select(F.size("infix")).distinct().collect())
    begins = found.select(F.get("infix", 0).alias("word")).distinct()
    places = sents.select(*KEY, "words", F.posexplode("words").alias("at", "word")).where(F.array_position("words", F.col("word")) == F.col("at") + 1)
    after = lambda n: F.get("words", F.col("at") + n)
    right = lambda n: F.when(after(n) == article, after(n + 1)).otherwise(after(n))
    run = lambda n: F.struct(F.slice("words", F.col("at") + 1, n).alias("infix"), right(n).alias("right"))
    runs = F.array(*[F.when(F.size("words") >= F.col("at") + n, run(n)) for n in lengths]) if lengths else F.array().cast("array<struct<infix:array<string>,right:string>>")
    many = found.count()
    begins = materialize(begins, "begins")
    rows = lookup.found(places, begins, "word", begins.count(), "left_semi").select(*KEY, F.get("words", F.col("at") - 1).alias("left"), F.explode(runs).alias("run")).where("left is not null and run.right is not null")
    rows = lookup.found(rows.select(*KEY, "left", "run.infix", "run.right"), found, "infix", many)
    return rows.select("infix", *KEY, F.when(F.col("forward"), F.col("left")).otherwise(F.col("right")).alias("w1"), F.when(F.col("forward"), F.col("right")).otherwise(F.col("left")).alias("w2"))


def score_pairs(matches: DataFrame, df: DataFrame, n_sentences: int) -> DataFrame:
    """w1, w2, patterns, fitness. The frequency term is truncated to a whole number, which makes it 0 for all words."""
    grouped = matches.groupBy("w1", "w2").agg(F.countDistinct("infix").alias("patterns"))
    term = lambda c: (F.col(c) * F.lit(PAIR_FREQUENCY / n_sentences)).cast("float").cast("smallint").cast("long")
    known = grouped.join(df.select(F.col("word").alias("w1"), F.col("df").alias("df1")), "w1").join(df.select(F.col("word").alias("w2"), F.col("df").alias("df2")), "w2")
    return known.select("w1", "w2", "patterns", (term("df1") + term("df2") + PAIR_PER_PATTERN * F.col("patterns")).alias("fitness"))


def pair_survivors(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("fitness") >= PAIR_THRESHOLD)


def grouped(pairs: DataFrame) -> DataFrame:
    """w1 with its w2 in order of falling fitness, then word."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("fitness")).alias("f"), "w2")))
    return pairs.groupBy("w1").agg(F.transform(ordered, lambda x: x["w2"]).alias("w2s"))


def relate(sents: DataFrame, toks: DataFrame, posts: DataFrame, pairs: DataFrame, channel: Channel | None = None, article: str = ARTICLE) -> DataFrame:
    """All stages once: surviving pairs with fitness. Each stage's counters go to the channel as they are observed."""
    channel = channel or Channel()
    df = posts.groupBy("word").agg(F.count("*").alias("df"))
    found = Counted(patterns_of_pairs(sents, pairs) if corpus.ALONE in sents.columns else patterns(sents, pair_sentences(toks, pairs)), "patterns of pairs", F.count("*").alias("pattern_count"))
    scored = Counted(score_patterns(found.rows), "patterns", F.count("*").alias("distinct"), F.count_if(F.col("fitness") >= PATTERN_THRESHOLD).alias("survivors"))
    good = materialize(pattern_survivors(scored.rows), "patterns")
    found.report(channel)
    scored.report(channel)
    matches = Counted(pattern_matches(sents, good, article), "matches of patterns", F.count("*").alias("wpair_count"))
    rated = Counted(score_pairs(matches.rows, df, sents.count()), "pairs", F.count("*").alias("distinct"), F.count_if(F.col("fitness") >= PAIR_THRESHOLD).alias("survivors"))
    kept = materialize(pair_survivors(rated.rows), "pairs")
    matches.report(channel)
    rated.report(channel)
    return kept


def ranked(pairs: DataFrame) -> DataFrame:
    """pairs with their rank by falling fitness, then words, without a sort in one task."""
    return ordered.ranked(pairs, [F.desc("fitness"), "w1", "w2"])
