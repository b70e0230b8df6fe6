"""Documents, word lists, requests and configurations."""

from __future__ import annotations

import html
import json
import re
import sys
import tomllib
from collections.abc import Iterable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.expansion import ExpansionParams

from .xml_splits import read_xml_splits

_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([^\s/>\"'<]+)(?:[^<>\"'/]|/(?!>)|\"[^\"<]*\"|'[^'<]*')*(/?)>", re.S)


def xml_texts(content: str, tag: str) -> list[str]:
    """The text of each element `tag`: text events alone, of nested elements too, with entities decoded once. Empty elements of the
    form <tag/>, and what stands in CDATA sections, count for nothing."""
    found, inside, parts, at = [], False, [], 0
    for m in _MARKUP.finditer(content):
        if inside:
            parts.append(content[at : m.start()])
        at = m.end()
        if m[2] == tag and not m[3]:
            if m[1]:
                if inside:
                    found.append(html.unescape("".join(parts)))
                inside = False
            else:
                inside, parts = True, []
    return found


def _parse_xml(batches, tag: str):
    for batch in batches:
        path, place, text = [], [], []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, t in enumerate(xml_texts(content.decode("utf-8", "replace"), tag)):
                path.append(name)
                place.append(i)
                text.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(place, pa.int64()), pa.array(text, pa.string())], ["path", "place", "text"])


def read_xml(spark: SparkSession, folder: str, tag: str, limit: int | None = None) -> DataFrame:
    """The same in byte ranges of the files, whatever their size; with a limit the first so many documents."""
    return read_xml_splits(spark, folder, tag, limit=limit)


def numbered(rows: DataFrame) -> DataFrame:
    """doc_id (dense, from 0, by path and place) and text."""
    starts = rows.groupBy("path").agg(F.count("*").alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = starts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "path").select((F.col("start") + F.col("place")).alias("doc_id"), "text")


def read_xml_whole(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """doc_id, text of the elements `tag` of the files in a folder (not in folders below), in order of file name, through Spark's own
    reader, so from any store that Spark reads. A file is one row and may have 2 GB at most; read_xml() has no such limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "content")
    return numbered(parse_xml(files, tag))


def parse_xml(files: DataFrame, tag: str) -> DataFrame:
    """path, place (from 0), text of the elements `tag` of files (path string, content binary)."""
    return files.select("path", "content").mapInArrow(partial(_parse_xml, tag=tag), "path string, place long, text string")


def read_xml_rows(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """The same by Spark's own XML source, which splits large files; for flat dumps whose elements hold escaped text only."""
    rows = spark.read.format("xml").option("rowTag", tag).schema("_VALUE string").load(folder)
    rows = rows.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("m"), F.col("_VALUE").alias("text"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("m")) - 1
    return numbered(rows.withColumn("place", place.cast("long")).drop("m"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """place, word: one term a line, the whole line, order and repeats kept."""
    return word_lines(spark.read.text(path, wholetext=True))


def word_lines(files: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, place (from 0) and word of the lines that aren't empty of texts (column value)."""
    return files.select(*keep, F.posexplode(F.split("value", "\r?\n")).alias("place", "word")).where("word <> ''")


def words_from(spark: SparkSession, lines: Iterable[str] | None, vocab: DataFrame) -> DataFrame:
    """Terms of a stream of lines (standard input by default); a term that the dictionary lacks is an error."""
    terms = spark.createDataFrame([(i, w.rstrip("\n")) for i, w in enumerate(lines if lines is not None else sys.stdin)], "place int, word string")
    unknown = [r["word"] for r in terms.join(vocab.select("word"), "word", "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"words that the corpus lacks: {unknown}")
    return terms


def pairs_request(spark: SparkSession, body: str) -> DataFrame:
    """{"pairs": [["a", "b"], ...]} as pair_idx, w1, w2."""
    try:
        pairs = json.loads(body)["pairs"]
        rows = [(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("Unable to parse JSON data.") from error
    return spark.createDataFrame(rows, "pair_idx int, w1 string, w2 string")


def pair_requests(requests: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """The columns `keep`, pair_idx, w1, w2 of {"pairs": [["a", "b"], ...]} in a column of requests. A request that can't be read, or a
    pair of other than two words, is an error of the row."""
    parsed = F.from_json(column, "struct<pairs: array<array<string>>>")["pairs"]
    rows = requests.select(*keep, F.posexplode(F.when(parsed.isNull(), F.raise_error(F.lit("Unable to parse JSON data."))).otherwise(parsed)).alias("pair_idx", "pair"))
    word = lambda i: F.when(F.size("pair") == 2, F.get("pair", i)).otherwise(F.raise_error(F.lit("Unable to parse JSON data.")))
    return rows.select(*keep, "pair_idx", word(0).alias("w1"), word(1).alias("w2"))


def set_request(requests: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """The columns `keep` and word of {"set": ["a", ...]} in a column of requests, one row a word."""
    parsed = F.from_json(column, "struct<set: array<string>>")
    return requests.select(*keep, F.explode(parsed["set"]).alias("word"))


def read_config(text: str) -> tuple[list[str], ExpansionParams]:
    """Seed terms and weights of a TOML configuration."""
    config = tomllib.loads(text)
    h = config["hyper_parameter"]
    names = ("word_frequency_boost", "set_frequency_boost", "global_term_frequency_boost_per_sentence", "survivor_threshold")
    first = [float(h[f"cooc1_{n}"]) for n in names]
    second = [float(h["cooc2_cooc1_frequency_boost"]), *[float(h[f"cooc2_{n}"]) for n in names[1:]]]
    return list(config["seed_terms"]), ExpansionParams(*first, *second)
