"""A training-data pipeline: each stage takes what its predecessor kept, and its decisions take effect.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents. Every stage's result is written as Parquet and read again as the next one's docs.

Nulls: a null or letterless text has no language and goes in the first stage. Rows are told apart by doc_id, which may be null, and text:
rows that repeat both are one document, rows that share a doc_id and differ in text are several. Other columns pass through untouched, but
for the names __id, __hash and __order, which are taken. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, langid, packing, quality_rules
from textloom.llm.common import materialize, table
from textloom.session import ship

SHINGLE, SIMILARITY = 5, 80  # words of a shingle, and percent from which two documents are near duplicates
LEAST_SCORE = 0.3  # language scores under this are guesses among several languages
BROADCAST_ROWS = 200_000
ID, HASH, ORDER = "__id", "__hash", "__order"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of their doc_id, which may be null, and text; rows that share it are copies of one document."""
    return docs.withColumns({ID: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), HASH: F.xxhash64("text")})


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs (keyed) less the rows whose key is in `rejected`; broadcast if it is small, by a count."""
    rejected = materialize(rejected.select(ID, HASH).distinct(), "rejected")
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    return docs.join(rejected, [ID, HASH], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language can't be told."""
    ship(spark)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    names = [f"d{i}" for i in range(len(docs.columns))]  # columns of docs may be named as the operator's
    found = langid.identify(docs.toDF(*names), model, names, names[docs.columns.index("text")])
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose distributions are far from their language's."""
    ship(spark)
    keyed = _keyed(docs)
    verdicts = quality_rules.check_rules(keyed, [ID, HASH])
    return _without(keyed, verdicts.where(~F.col("kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id (and of several texts under it, or under none,
    that with the smallest hash); rows that repeat it are one."""
    ship(spark)
    keyed = _keyed(docs)
    order = F.concat_ws(":", F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.lpad((F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(0)) + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.hex(HASH))
    keyed = keyed.withColumn(ORDER, order)
    verdicts = materialize(jaccard_join.Join(keyed, [ORDER, ID, HASH], SIMILARITY, SHINGLE).classified(ORDER), "near")
    kept = _without(keyed, verdicts.where(F.col("component_id") != F.col(ORDER)))
    repeated = materialize(kept.groupBy(ID, HASH).count().where("count > 1").select(ID, HASH), "repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if repeated.isEmpty():
        return kept.select(*columns)
    once = kept.join(repeated, [ID, HASH], "left_semi").dropDuplicates([ID, HASH])
    return _without(kept, repeated).unionByName(once).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None  # byte-level BPE and packing aren't expressible in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
