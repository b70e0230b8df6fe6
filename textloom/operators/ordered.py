"""Global order without a global sort in one task: ranks, neighbours and the first rows of a table.

Rows are dealt into ranges of the order and sorted within, written once with the number of their range, and a table of a row for each
range (how many rows, the first and the last of them) is all that ties the ranges together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize

RANGE, PLACE = "__range", "__place"
BUCKETS = 1024  # of each round of the search for a rank


def in_ranges(rows: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """rows, written in ranges of the order, with their range and their place in it (from 0). Rows that are equal in the order are in
    one range, so the order should be a key."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    cut = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PLACE, at)
    bits = F.lit(33)
    cut = cut.withColumn(RANGE, F.shiftright(F.col(PLACE), 33).cast("int")).withColumn(PLACE, F.col(PLACE) - F.col(RANGE).cast("long") * F.pow(F.lit(2), bits).cast("long"))
    return materialize(cut, "ranges")


def _summary(cut: DataFrame, columns: Sequence[str] = ()) -> list:
    """Of each range that has rows, in order: its number, rows, and the first and last values of the columns."""
    edge = [f(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col(PLACE)).alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))] if columns else []
    return cut.groupBy(RANGE).agg(F.count("*").alias("n"), *edge).orderBy(RANGE).collect()  # a row for each range


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """rows with their rank (long, from 1) in an order that is a key."""
    cut = in_ranges(rows, order, ranges)
    found, start = [], 0
    for r in _summary(cut):
        found.append((r[RANGE], start))
        start += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(found, f"{RANGE} int, __start long"))  # a row for each range
    return cut.join(starts, RANGE).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__start") + F.col(PLACE) + 1).alias(name))


def with_neighbours(rows: DataFrame, order: Sequence[Column | str], columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows with before_<c> and after_<c>: the columns' values in the row before and behind in an order that is a key, null at its ends.
    Inside a range they come from a window over the range, at its borders from the neighbouring ranges' last and first rows."""
    cut = in_ranges(rows, order, ranges)
    found = _summary(cut, columns)
    halo = []
    for i, r in enumerate(found):
        before, after = found[i - 1]["last"] if i else None, found[i + 1]["first"] if i + 1 < len(found) else None
        halo.append((r[RANGE], before, after))
    kinds = ", ".join(f"`{c}`: {cut.schema[c].dataType.simpleString()}" for c in columns)
    borders = F.broadcast(rows.sparkSession.createDataFrame(halo, f"{RANGE} int, __b struct<{kinds}>, __a struct<{kinds}>"))  # a row for each range
    w = Window.partitionBy(RANGE).orderBy(PLACE)
    most = F.count("*").over(Window.partitionBy(RANGE)) - 1
    near = {}
    for c in columns:
        near[f"before_{c}"] = F.when(F.col(PLACE) == 0, F.col("__b")[c]).otherwise(F.lag(f"`{c}`").over(w))
        near[f"after_{c}"] = F.when(F.col(PLACE) == most, F.col("__a")[c]).otherwise(F.lead(f"`{c}`").over(w))
    return cut.join(borders, RANGE).withColumns(near).drop(RANGE, PLACE, "__b", "__a")


def threshold(rows: DataFrame, key: str, n: int) -> tuple[int | None, int]:
    """(value, of which): the n-th smallest value of a whole-number key (a null is the smallest), and how many of the rows that have it
    are among the first n. With fewer rows, the largest value and all its rows. Found by counts of ever smaller buckets of the key:
    each round reads the key alone and brings BUCKETS counts to the driver."""
    k = F.col(f"`{key}`").cast("long")
    stats = rows.agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count("*").alias("n"), F.count(k).alias("known")).first()
    nulls, n = stats["n"] - stats["known"], min(n, stats["n"])
    if n <= nulls:
        return None, n
    left, low, high = n - nulls, stats["low"], stats["high"]
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        inside = rows.where(k.between(low, high))
        # whole numbers of up to 64 bits: the division is by decimals, as a difference may pass a long
        bucket = F.floor((k.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        for b, count in sorted(map(tuple, inside.groupBy(bucket.alias("b")).count().collect())):
            if left <= count:
                break
            left -= count
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low, left


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest key (a whole number; nulls first), in any order; of rows that share the last key as many as it takes."""
    if n <= 0:
        return rows.limit(0)
    value, some = threshold(rows, key, n)
    k = F.col(f"`{key}`").cast("long")
    if value is None:
        return rows.where(k.isNull()).limit(some)
    return rows.where(k.isNull() | (k < value)).unionByName(rows.where(k == value).limit(some))
