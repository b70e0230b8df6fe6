"""Corpus build: documents to sentences, tokens, dictionary and inverted index, as DataFrames.

A sentence's key is (doc_id, spos). The composite key replaces a running number, which would need a global sort; words are joined by
themselves, and numbers are given only where a dictionary is asked for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as text_functions
from textloom.functions.unicode import unicode_sentences

from textloom.session import materialize

from .ordered import first_rows, ranked

SENTENCE = ("doc_id", "spos")
ALONE = "alone"
LONG = 512  # words of a sentence that are counted in its own row
BROADCAST_IDS = 500_000
BUCKET_ROWS = 1_000_000  # of a saved table, about, so that a task sorts its bucket in memory
BY_WORD = ("postings", "vocab")


def marked(docs: DataFrame) -> DataFrame:
    """docs with `alone`: whether no other row has the same doc_id; a row without one isn't alone. Of such documents each sentence is
    one row, so what is asked of a sentence can be answered in its row. Only ids are shuffled, unless very many are repeated."""
    again = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    n, known = again.count(), F.col("doc_id").isNotNull()
    if not n:
        return docs.withColumn(ALONE, known)
    again = again.select(F.col("doc_id").alias("__again"))
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    found = docs.join(again, F.col("doc_id") == F.col("__again"), "left")
    return found.withColumn(ALONE, known & F.col("__again").isNull()).drop("__again")


def sentences(docs: DataFrame, text: str = "text", preprocessor: str | None = None, profile: str = "portable") -> DataFrame:
    """doc_id, spos (from 0), sent and words; with the unicode profile also start, the code points before it. A null text has no
    sentence. `alone` is kept where docs have it (see marked)."""
    body = text_functions.preprocess(F.col(text), preprocessor)
    if profile == "unicode":
        return docs.select("doc_id", F.posexplode(unicode_sentences(body)).alias("spos", "s")).select("doc_id", "spos", "s.start", "s.sent", "s.words")
    kept = [c for c in (ALONE,) if c in docs.columns]
    cut = docs.select("doc_id", *kept, F.posexplode(text_functions.sentences(body)).alias("spos", "sent"))
    return cut.withColumn("words", text_functions.words(F.col("sent")))


def tokens(sents: DataFrame) -> DataFrame:
    """doc_id, spos, pos (from 0), word."""
    return sents.select(*SENTENCE, F.posexplode("words").alias("pos", "word"))


def postings(toks: DataFrame) -> DataFrame:
    """The inverted index: one row for each word and sentence, with tf and the first position."""
    return toks.groupBy(*SENTENCE, "word").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def apart(sents: DataFrame, most: int | None = LONG) -> tuple[DataFrame, DataFrame]:
    """Sentences that are one row each and not very long (any length, if most is None), and all others. Those of documents that weren't
    marked are all in the second."""
    if ALONE not in sents.columns:
        return sents.where(F.lit(False)), sents
    here = F.col(ALONE) if most is None else F.col(ALONE) & (F.size("words") <= most)
    return sents.where(here), sents.where(~here)


def sentence_postings(sents: DataFrame) -> DataFrame:
    """As postings(tokens(sents)), without a shuffle for sentences that are one row each (see apart)."""
    here, rest = apart(sents)
    rows = here.select(*SENTENCE, "words", F.explode(F.array_distinct("words")).alias("word"))
    tf = (F.size("words") - F.size(F.array_remove("words", F.col("word")))).cast("long")
    rows = rows.select(*SENTENCE, "word", tf.alias("tf"), (F.array_position("words", F.col("word")) - 1).cast("int").alias("first_pos"))
    return rows.unionByName(postings(tokens(rest)))


def doc_freq(posts: DataFrame) -> DataFrame:
    """In how many sentences each word is."""
    return posts.groupBy("word").agg(F.count("*").alias("df"))


def first_places(toks: DataFrame) -> DataFrame:
    """word with its first doc_id (null before all), spos and pos. Where doc_id is a whole number the place is one number of 126 bits, so
    that it is aggregated by hash; the least of a struct would have all tokens sorted."""
    if not isinstance(toks.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        first = toks.groupBy("word").agg(F.min(F.struct(*SENTENCE, "pos")).alias("first"))
        return first.select("word", F.col("first.doc_id").alias("doc_id"), F.col("first.spos").alias("spos"), F.col("first.pos").alias("pos"))
    whole = lambda c: c.cast("decimal(38,0)")
    high, low = F.lit(1 << 62).cast("decimal(19,0)"), F.shiftleft(F.col("spos").cast("long"), 31).bitwiseOR(F.col("pos").cast("long"))
    shift = F.lit(str((1 << 63) + 1)).cast("decimal(20,0)")
    doc = F.coalesce(F.col("doc_id").cast("long").cast("decimal(20,0)") + shift, F.lit(0).cast("decimal(20,0)"))
    first = toks.groupBy("word").agg(F.min(whole(doc * high) + low.cast("decimal(19,0)")).alias("at"))
    first = first.withColumn("low", F.col("at") % high)
    doc = whole(whole(F.col("at") - F.col("low")) / high)
    place = F.col("low").cast("long")
    kind = lambda c: toks.schema[c].dataType
    return first.select(
        "word",
        F.when(doc > 0, (doc - shift).cast(kind("doc_id"))).alias("doc_id"),
        F.shiftright(place, 31).cast(kind("spos")).alias("spos"),
        place.bitwiseAND(F.lit((1 << 31) - 1)).cast(kind("pos")).alias("pos"),
    )


def vocabulary(toks: DataFrame) -> DataFrame:
    """word_id (dense, from 0, by first appearance in document, sentence, position order), word, and that first place.

    Numbers are ranks of the first places in ranges of their order, so no task sorts all words.
    """
    first = first_places(toks)
    return ranked(first, [*SENTENCE, "pos"]).select((F.col("rank") - 1).alias("word_id"), "word", "doc_id", "spos", "pos")


def decode(toks: DataFrame) -> DataFrame:
    """Sentences back from tokens: doc_id, spos, words joined by a space in order of position."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return toks.groupBy(*SENTENCE).agg(F.array_join(ordered, " ").alias("sentence"))


def corpus_counts(sents: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: n_sentences, n_words (distinct), n_postings."""
    left = sents.agg(F.count("*").alias("n_sentences"))
    right = posts.agg(F.countDistinct("word").alias("n_words"), F.count("*").alias("n_postings"))
    one = F.lit(1).alias("k")
    return left.select("*", one).join(right.select("*", one), "k").drop("k")


def unsound(vocab: DataFrame, posts: DataFrame) -> DataFrame:
    """Words of the dictionary that have no posting; a sound index has none."""
    return vocab.select("word").join(posts.select("word"), "word", "left_anti")


def check_sound(vocab: DataFrame, posts: DataFrame) -> None:
    missing = [r["word"] for r in unsound(vocab, posts).limit(20).collect()]
    if missing:
        raise ValueError(f"words without postings: {missing}")


def limited(docs: DataFrame, limit: int | None, compat_limit: bool = False) -> DataFrame:
    """The first `limit` documents by doc_id, found by counts of the keys and without a sort. With compat_limit a limit of L takes
    L - 1, as the reader of old did."""
    if limit is None:
        return docs
    return first_rows(docs, "doc_id", max(limit - 1, 0) if compat_limit else limit)


def parse_limit(text: str | None) -> int | None:
    """An unparsable limit means none."""
    try:
        return int(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def buckets_for(spark: SparkSession, rows: int) -> int:
    """Of a saved table of so many rows: as many as shuffles have partitions, or more if a bucket had more than BUCKET_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def _table_name(path: str, table: str) -> str:
    return f"textloom_{hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()[:16]}_{table}"


@dataclass
class Corpus:
    """The tables of an index."""

    sentences: DataFrame
    tokens: DataFrame
    postings: DataFrame
    vocab: DataFrame

    @property
    def df(self) -> DataFrame:
        """Frequencies; of a saved index they are counted where its postings lie."""
        return doc_freq(self.postings)

    def save(self, path: str, buckets: int | None = None) -> None:
        """A Parquet folder for each table. Postings and dictionary are in buckets by word and sorted by it, so that a word
        is found in one file and joins on the word need no shuffle."""
        if not path:
            raise ValueError("an output folder is needed")
        path, spark = path.rstrip("/"), self.sentences.sparkSession
        n = buckets
        for f in fields(self):
            rows = getattr(self, f.name)
            if f.name in BY_WORD:
                n = n or buckets_for(spark, spark.read.parquet(f"{path}/tokens").count())  # postings aren't more
                name = _table_name(path, f.name)
                spark.sql(f"DROP TABLE IF EXISTS {name}")
                write = rows.repartition(n, "word").write.mode("overwrite").format("parquet").option("path", f"{path}/{f.name}")
                write.bucketBy(n, "word").sortBy("word").saveAsTable(name)
            else:
                rows.write.mode("overwrite").parquet(f"{path}/{f.name}")
        spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        """The tables of a saved index. Those in buckets are made known to the session's catalog, by names from the path."""
        path = path.rstrip("/")
        n = spark.read.parquet(f"{path}/layout").first()["buckets"]
        tables = {}
        for f in fields(cls):
            plain = spark.read.parquet(f"{path}/{f.name}")
            if f.name in BY_WORD:
                name = _table_name(path, f.name)
                columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in plain.schema)
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (word) SORTED BY (word) INTO {n} BUCKETS LOCATION '{path}/{f.name}'")
                spark.sql(f"REFRESH TABLE {name}")
                tables[f.name] = spark.table(name)
            else:
                tables[f.name] = plain
        return cls(**tables)

    def word(self, word_id: int) -> DataFrame:
        return self.vocab.where(F.col("word_id") == word_id).select("word")

    def sentence(self, doc_id: int, spos: int) -> DataFrame:
        return self.sentences.where((F.col("doc_id") == doc_id) & (F.col("spos") == spos))

    def sentences_of(self, word: str) -> DataFrame:
        return self.postings.where(F.col("word") == word).select(*SENTENCE)


def build(docs: DataFrame, preprocessor: str | None = None, limit: int | None = None, compat_limit: bool = False, profile: str = "portable") -> Corpus:
    """All tables of an index over doc_id and text."""
    sents = sentences(limited(docs, limit, compat_limit), preprocessor=preprocessor, profile=profile)
    toks = tokens(sents)
    return Corpus(sents, toks, postings(toks), vocabulary(toks))


def lookup(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms (column word) that the dictionary has, order and repeats kept as rows."""
    return terms.join(vocab.select("word"), "word", "left_semi")


def missing(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms that the dictionary lacks."""
    return terms.join(vocab.select("word"), "word", "left_anti")
