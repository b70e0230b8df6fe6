"""Incremental index: each micro-batch of documents adds its postings; document frequencies are sums over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import corpus


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write_index(docs: DataFrame, out: str, checkpoint: str, preprocessor: str | None = None) -> StreamingQuery:
    """Writes sentences, and postings partitioned by micro-batch, until the source is read up. A batch that is repeated after a failure
    replaces its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        sents = corpus.sentences(batch, preprocessor=preprocessor)
        sents.write.mode("overwrite").parquet(f"{out}/sentences/batch={number}")
        corpus.postings(corpus.tokens(sents)).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(docs: DataFrame) -> DataFrame:
    """A running count of words over the stream; for output mode complete or update."""
    words = F.explode(F.flatten(F.transform(corpus.text_functions.sentences(F.col("text")), corpus.text_functions.words)))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
