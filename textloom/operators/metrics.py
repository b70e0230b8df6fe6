"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(retrieved: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision and recall of the words retrieved against reference (column word), both without repeats; with `by` for each group of
    retrieved. Nothing retrieved gives 0 and 0; an empty reference gives a recall of NaN."""
    by = by or []
    right = reference.select("word").distinct().withColumn("hit", F.lit(1))
    counts = retrieved.select(*by, "word").distinct().join(right, "word", "left").groupBy(*by).agg(F.count("*").alias("n_ret"), F.count("hit").alias("tp"))
    total = reference.select("word").distinct().agg(F.count("*").alias("n_ref")).withColumn("one", F.lit(1))
    rows = counts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
    none = F.col("n_ret") == 0
    precision = F.when(none, 0.0).otherwise(F.try_divide(F.col("tp").cast("double"), F.col("n_ret").cast("double")))
    recall = F.when(none, 0.0).when(F.col("n_ref") == 0, float("nan")).otherwise(F.try_divide(F.col("tp").cast("double"), F.col("n_ref").cast("double")))
    return rows.select(*by, "n_ret", "n_ref", "tp", precision.alias("precision"), recall.alias("recall"))


def f1(rows: DataFrame, nan_as_zero: bool = False) -> DataFrame:
    """f1 of precision and recall: NaN where both are 0, or 0 as the run store keeps it."""
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0 if nan_as_zero else float("nan"))))
