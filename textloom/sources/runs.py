"""The store of tuning runs: tables batch and dat, logs of older tools, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import materialize

BROADCAST_SPLITS = 200_000
BATCH_SCHEMA = "batch_id int, tpso int, tfitness int, tcorpus int, ncorpus int, nparticles int, ncycles int, nseed int, tseed int, nruns int"
#: The experiments on record.
BATCHES = (
    (0, 0, 0, 0, 10000, 100, 50, 11, 0, 50),
    (1, 0, 0, 0, 10000, 100, 50, 5, 0, 100),
    (2, 0, 0, 0, 10000, 100, 50, 5, 1, 50),
    (3, 0, 0, 0, 10000, 100, 50, 8, 0, 50),
    (10, 0, 0, 0, 500, 100, 50, 5, 1, 1),
    (11, 0, 0, 0, 1000, 100, 50, 5, 1, 1),
    (12, 0, 0, 0, 5000, 100, 50, 5, 1, 1),
    (13, 0, 0, 0, 10000, 100, 50, 5, 1, 1),
    (14, 0, 0, 0, 50000, 100, 50, 5, 1, 1),
    (15, 0, 0, 0, 100000, 100, 50, 5, 1, 1),
    (16, 0, 0, 0, 500000, 100, 50, 5, 1, 1),
    (17, 0, 0, 0, 1000000, 100, 50, 5, 1, 1),
)
POSITIONS = [f"pos{i}" for i in range(1, 7)]
DAT_SCHEMA = "batch_id int, irun int, icycle int, iparticle int, " + ", ".join(f"{p} double" for p in POSITIONS) + ", fitness double, `precision` double, recall double"


def batches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BATCHES), BATCH_SCHEMA)


def nan_to_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Drops and creates batch, fills it, and creates dat if there is none. batch_id is the key of batch, no column of either table
    may be null; dat has no key."""
    spark.sql(f"DROP TABLE IF EXISTS {database}.batch")
    checked_batches(batches(spark)).write.mode("overwrite").saveAsTable(f"{database}.batch")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.dat ({DAT_SCHEMA}) USING parquet")


def repeated_keys(batch: DataFrame) -> DataFrame:
    """batch_id, n of keys that several rows have."""
    return batch.groupBy("batch_id").agg(F.count("*").alias("n")).where("n > 1")


def null_rows(rows: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    return rows.where(" or ".join(f"`{c}` is null" for c in rows.columns))


def checked_batches(batch: DataFrame) -> DataFrame:
    """batch, if its keys are unique and no column is null; else an error."""
    twice = [r["batch_id"] for r in repeated_keys(batch).limit(20).collect()]
    if twice:
        raise ValueError(f"batch_id is not unique: {twice}")
    if not null_rows(batch).isEmpty():
        raise ValueError("a null in the rows of batch")
    return batch


def append(dat: DataFrame, path: str, reset: bool = False) -> None:
    """Adds rows to the store, partitioned by batch, a NaN as 0; a null in any column is an error. With reset the store is replaced."""
    clean = dat.select(*[nan_to_zero(F.col(c)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in dat.dtypes])
    if not null_rows(clean).isEmpty():
        raise ValueError("a null in the rows of a run")
    clean.write.mode("overwrite" if reset else "append").partitionBy("batch_id").parquet(path)


def from_log(log: pd.DataFrame, spark: SparkSession, batch_id: int, irun: int) -> DataFrame:
    """Rows of dat from the log of a training run; an archive's log has no single fitness (-1) and no particle numbers (-1)."""
    out = log.copy()
    single = "fitness" in out
    if not single:
        out["fitness"], out["iparticle"] = -1.0, -1
    out["batch_id"], out["irun"] = batch_id, irun
    columns = ["batch_id", "irun", "icycle", "iparticle", *POSITIONS, "fitness", "precision", "recall"]
    return spark.createDataFrame(out[columns], DAT_SCHEMA)


LOG_COLUMNS = [*POSITIONS, "fitness", *[f"vel{i}" for i in range(1, 7)], *[f"pbest{i}" for i in range(1, 7)], "pbest_fitness", "precision", "recall"]
ARCHIVE_COLUMNS = ["icycle", *POSITIONS, "precision", "recall", *[f"vel{i}" for i in range(1, 7)], *[f"pbest{i}" for i in range(1, 7)], "pbest_precision", "pbest_recall"]


def full_log(log: pd.DataFrame, spark: SparkSession) -> DataFrame:
    """All columns of a training log, as a table: cycle and particle with the 22 of a swarm, or the 23 of an archive."""
    columns = ["icycle", "iparticle", *LOG_COLUMNS] if "fitness" in log else ARCHIVE_COLUMNS
    whole = ("icycle", "iparticle")
    schema = ", ".join(f"`{c}` {'int' if c in whole else 'double'}" for c in columns)
    return spark.createDataFrame([tuple(int(v) if c in whole else float(v) for c, v in zip(columns, r, strict=True)) for r in log[columns].itertuples(index=False)], schema)


def write_log(log: pd.DataFrame, path: str) -> None:
    """A training log as tab-separated text: 22 columns of all particles, or 23 of the archive; two blank lines behind each cycle."""
    columns = LOG_COLUMNS if "fitness" in log else ARCHIVE_COLUMNS
    with open(path, "w", encoding="utf-8") as out:
        for _, cycle in log.groupby("icycle"):
            for row in cycle[columns].itertuples(index=False):
                out.write("\t".join("NaN" if v != v else str(v) for v in row) + "\n")
            out.write("\n\n")


def read_swarm_log(spark: SparkSession, path: str, population: int = 50) -> DataFrame:
    """file, icycle, iparticle, pos1..6, fitness, precision, recall of tab-separated logs of 22 columns: blank lines drop out, NaN is 0,
    and cycle and particle follow from the place of the row in its file. A log is read whole, as one run's is small."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    lines = files.select("file", F.posexplode("lines").alias("at", "line"))
    return reshape_log(lines.select("file", (F.col("at") + 1).alias("nr"), F.split("line", "\t").alias("f")), population, "file")


def read_log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The same from the blocks of a log, which two blank lines end: the cycle is the number of the block in its file, the particle the
    line's in its block, whatever the population. Files are split at the ends of blocks, so a log may be of any size; a block is one row."""
    blocks = spark.read.text(path, lineSep="\n\n\n").where(F.trim(F.col("value"), F.lit(" \n\r\t")) != "")
    meta = F.col("_metadata")
    blocks = blocks.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = materialize(blocks, "blocks")  # a split's rows have ids without gaps
    splits = blocks.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    splits = materialize(splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "splits")
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    cycle = (F.col("base") + F.col("at") - F.col("first")).cast("int")
    lines = blocks.join(splits, ["file", "start"]).select("file", cycle.alias("icycle"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("iparticle", "line"))
    return _log_columns(lines.withColumn("f", F.split("line", "\t")), "file", "icycle", "iparticle")


def _log_columns(rows: DataFrame, *keep) -> DataFrame:
    """The columns `keep`, and those of a training log from its fields (f array of text); a NaN or no number is 0."""
    at = lambda i: nan_to_zero(F.get("f", i - 1).try_cast("double"))
    return rows.select(*keep, *[at(i).alias(f"pos{i}") for i in range(1, 7)], at(7).alias("fitness"), at(21).alias("precision"), at(22).alias("recall"))


def reshape_log(rows: DataFrame, population: int, *keep: str) -> DataFrame:
    """As read_swarm_log, from rows (nr from 1, f array of text); the columns `keep` stay."""
    place = F.col("nr") - 1
    return _log_columns(rows, *keep, F.floor(place / population).cast("int").alias("icycle"), (place % population).cast("int").alias("iparticle"))


#: The store's questions as SQL over the views batch and dat, with named parameters.
STATEMENTS = {
    "average_by_cycle": "SELECT icycle, avg(fitness) AS avg_fitness FROM dat WHERE batch_id = :batch GROUP BY icycle",
    "best_by_run": "SELECT irun, max(fitness) AS max_fitness FROM dat WHERE batch_id = :batch AND icycle = :cycle GROUP BY irun",
    "best_by_corpus": """SELECT d.batch_id, max(b.ncorpus) AS ncorpus, max_by(d.irun, struct(d.fitness, d.irun)) AS irun, max(d.fitness) AS max_fitness
        FROM dat d LEFT JOIN batch b ON d.batch_id = b.batch_id WHERE array_contains(:batches, d.batch_id) AND d.icycle = :cycle GROUP BY d.batch_id ORDER BY ncorpus""",
    "places_in_cycle": "SELECT iparticle, pos1, pos2, pos3, pos4, pos5, pos6 FROM dat WHERE batch_id = :batch AND irun = :run AND icycle = :cycle",
    "path_of_particle": "SELECT icycle, pos1, pos2, pos3, pos4, pos5, pos6 FROM dat WHERE batch_id = :batch AND irun = :run AND iparticle = :particle",
    "places_in_run": "SELECT icycle, iparticle, pos1, pos2, pos3, pos4, pos5, pos6 FROM dat WHERE batch_id = :batch AND irun = :run",
    "front_of_cycle": "SELECT `precision`, recall FROM dat WHERE batch_id = :batch AND icycle = :cycle",
    "shares": """SELECT floor(fitness / :width) * :width + :width / 2 AS bin, count(*) / any_value(total) AS share
        FROM (SELECT fitness, count(*) OVER (PARTITION BY batch_id) AS total FROM dat WHERE batch_id = :batch AND icycle = :cycle) GROUP BY 1""",
}


def open_store(spark: SparkSession, dat: DataFrame, batch: DataFrame | None = None) -> None:
    """Makes a store's tables the views dat and batch of the session, for any SQL and for ask()."""
    dat.createOrReplaceTempView("dat")
    (batches(spark) if batch is None else batch).createOrReplaceTempView("batch")


def close_store(spark: SparkSession) -> None:
    """Takes the views away again; answers that were asked for stay valid."""
    spark.catalog.dropTempView("dat")
    spark.catalog.dropTempView("batch")


def ask(spark: SparkSession, statement: str, **parameters) -> DataFrame:
    """The answer to one of STATEMENTS, by name, or to any SQL over the views, with named parameters; a list becomes an array."""
    bound = {k: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v for k, v in parameters.items()}
    return spark.sql(STATEMENTS.get(statement, statement), args=bound)


def avg_by_cycle(dat: DataFrame) -> DataFrame:
    return dat.groupBy("icycle").agg(F.avg("fitness").alias("avg_fitness"))


def max_by_run(dat: DataFrame, cycle: int) -> DataFrame:
    return dat.where(F.col("icycle") == cycle).groupBy("irun").agg(F.max("fitness").alias("max_fitness"))


def best_by_batch(dat: DataFrame, batch: DataFrame, ids: list[int], cycle: int) -> DataFrame:
    """batch_id, ncorpus, irun of the best row (the last run of equals), max_fitness, in order of corpus size."""
    rows = dat.where(F.col("batch_id").isin(ids) & (F.col("icycle") == cycle)).join(batch, "batch_id", "left")
    best = rows.groupBy("batch_id").agg(F.max("ncorpus").alias("ncorpus"), F.max(F.struct("fitness", "irun")).alias("b"))
    return best.select("batch_id", "ncorpus", F.col("b.irun").alias("irun"), F.col("b.fitness").alias("max_fitness")).orderBy("ncorpus")


def histogram(dat: DataFrame, column: str = "fitness", width: float = 0.05) -> DataFrame:
    """bin (its middle) and share of the rows."""
    n = dat.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    bins = dat.groupBy((F.floor(F.col(column) / width) * width + width / 2).alias("bin")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return bins.join(F.broadcast(n), "one").select("bin", (F.col("n") / F.col("total")).alias("share"))  # one row


def winner(dat: DataFrame) -> DataFrame:
    """By run: the best particle of the last cycle, with its position, fitness, precision and recall."""
    place = F.struct("icycle", "fitness", "iparticle")  # the largest is in the last cycle
    best = dat.groupBy("irun").agg(F.max_by(F.struct("iparticle", *POSITIONS, "fitness", "precision", "recall"), place).alias("b"))
    return best.select("irun", "b.*")


def summary(dat: DataFrame, column: str = "fitness") -> DataFrame:
    """One row of statistics of a column: records, mean, population standard deviation, smallest, largest, and quartiles (by linear
    interpolation). Without records all but the count are null."""
    c = F.col(column)
    quartile = lambda q, name: F.percentile(c, F.lit(q)).alias(name)
    return dat.agg(F.count(c).alias("records"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), quartile(0.25, "lower"), quartile(0.5, "middle"), quartile(0.75, "upper"))


def blocks(dat: DataFrame) -> DataFrame:
    """irun, blocks (cycles on record) and records of each run."""
    return dat.groupBy("irun").agg(F.countDistinct("icycle").alias("blocks"), F.count("*").alias("records"))


def positions(dat: DataFrame, batch_id: int, irun: int, cycles: list[int]) -> DataFrame:
    """The swarm's places in some cycles, ready to plot."""
    return dat.where((F.col("batch_id") == batch_id) & (F.col("irun") == irun) & F.col("icycle").isin(cycles)).select("icycle", "iparticle", *POSITIONS)


def final_front(dat: DataFrame, batch_id: int, columns: Sequence[str] = ("precision", "recall")) -> DataFrame:
    """The columns (precision and recall) of the last cycle of an archive."""
    rows = dat.where(F.col("batch_id") == batch_id)
    last = rows.agg(F.max("icycle").alias("icycle"))
    return rows.join(F.broadcast(last), "icycle", "left_semi").select(*columns)  # one row
