"""Joins of many rows with a table of wanted keys, so that what is shuffled grows with the rows that are found and not with all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 500_000  # keys that are broadcast
SLOTS = 1 << 20  # of 64 bits each


def _marks(table: DataFrame, key: str) -> DataFrame:
    """A bit for each hash of a key, in SLOTS rows at most."""
    h = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
    return table.groupBy(F.pmod(h, F.lit(SLOTS)).alias("__slot")).agg(F.bit_or(bit).alias("__bits"))


def likely(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows whose key may be in the table: all that are, and few others. No shuffle of rows."""
    h = F.xxhash64(key)
    marked = rows.withColumn("__slot", F.pmod(h, F.lit(SLOTS))).join(F.broadcast(_marks(table, key)), "__slot")  # SLOTS rows at most
    bit = F.pmod(F.shiftright(F.xxhash64(key), 20), F.lit(64)).cast("int")
    return marked.where(F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1).drop("__slot", "__bits")


def found(rows: DataFrame, table: DataFrame, key: str, n: int, how: str = "inner", most: int = MOST) -> DataFrame:
    """rows joined with a table of n rows on a key, inner or left_semi; the table should be written before. Up to `most` rows it is broadcast;
    beyond, rows that can't be in it go before the shuffle."""
    if n <= most:
        return rows.join(F.broadcast(table), key, how)
    return likely(rows, table, key).join(table, key, how)
