"""Document fingerprints: Merkle trees over the sections, paragraphs and sentences of a text.

A text is cut without a rest: into paragraphs (lines with the line feeds behind them), paragraphs into leaves (sentences with the white
space behind them, of at most LEAF code points), and paragraphs are gathered to sections. A leaf's hash is that of its text, any other
node's that of its children's hashes, so equal roots mean equal texts, and two texts differ below differing branches alone. Where a
section ends depends on its own paragraphs only (a blank line, a heading behind it, or the paragraph's hash), so an edit moves no
border but those next to it.

A fingerprint is the tree as text: the root's hash, then each section `/`, paragraph `-` and leaf `.` with 8 hexadecimal digits of its
hash and its length. likeness() and differences() read two of them from the root down and never look below equal branches.

Fingerprints are made row by row. The comparison with the next document deals rows into ranges of the key, each with a copy of the first
row of the range behind it, and streams through them in order: one shuffle of the texts, and two documents in a task's hands at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, parts, table

LEAF = 240
BATCH = 8 << 20
RANGES = 16  # ranges of the key for each partition of a shuffle
MOST_RANGES = 128 * 128
KNOWN = 20_000
PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
PIECE = re.compile(rf"[^.!?]{{0,{LEAF}}}[.!?]+[ \t\n\x0b\x0c\r]*|[^.!?]{{1,{LEAF}}}")
SECTION_ENDS = ("0", "1")  # first digits of the hash of a paragraph that ends its section


# --------------------------------------------------------------------------------------------------------------- trees
def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


class Hashes(dict):
    """The hash of a leaf by its text. Texts that are compared share leaves, so the last ones are remembered."""

    def __missing__(self, leaf: str) -> str:
        if len(self) >= KNOWN:
            self.clear()
        self[leaf] = found = digest(leaf)
        return found


def fingerprint(text: str, leaf_hash: Callable[[str], str] = digest) -> str:
    """The Merkle tree of a text, as text; an empty one has a root alone."""
    sections: list[tuple[str, str]] = []  # hash and text of each
    hashes, inner, size = [], [], 0  # of the section at hand
    roots = []

    def close() -> None:
        nonlocal hashes, inner, size
        if hashes:
            own = digest("".join(hashes))
            roots.append(own)
            sections.append(f"/{own[:8]}{size}" + "".join(inner))
        hashes, inner, size = [], [], 0

    for paragraph in PARAGRAPH.findall(text):
        pieces = PIECE.findall(paragraph)
        leaves = [leaf_hash(piece) for piece in pieces]
        own = digest("".join(leaves))
        if paragraph[0] == "#":
            close()
        hashes.append(own)
        inner.append(f"-{own[:8]}{len(paragraph)}" + "".join([f".{h[:8]}{len(p)}" for h, p in zip(leaves, pieces, strict=True)]))
        size += len(paragraph)
        if own[0] in SECTION_ENDS or paragraph.endswith("\n\n"):
            close()
    close()
    return digest("".join(roots)) + "".join(sections)


def _children(node: str, mark: str) -> list[str]:
    """The subtrees of a node's text one level below, each with its hash and length first."""
    return node.split(mark)[1:]


def _name(node: str) -> str:
    """Hash and length of a subtree, which stand before its own children."""
    end = len(node)
    for mark in "-.":
        at = node.find(mark, 0, end)
        end = at if at >= 0 else end
    return node[:end]


def _size(name: str) -> int:
    return int(name[8:])


def common(a: str, b: str) -> int:
    """Code points below branches that both fingerprints have, wherever they stand; repeated branches count as often as in both."""
    if a == b:
        return sum(_size(_name(s)) for s in _children(a, "/"))
    left, right, total = [a], [b], 0
    for mark in "/-.":
        nodes = [[c for node in side for c in _children(node, mark)] for side in (left, right)]
        names = [list(map(_name, side)) for side in nodes]
        both = Counter(names[0]) & Counter(names[1])
        total += sum(_size(name) * n for name, n in both.items())
        left, right = (_without(side, own, both) for side, own in zip(nodes, names, strict=True))
    return total


def _without(nodes: list[str], names: list[str], taken: Counter) -> list[str]:
    left, rest = Counter(taken), []
    for node, name in zip(nodes, names, strict=True):
        if left[name] > 0:
            left[name] -= 1
        else:
            rest.append(node)
    return rest


def length(a: str) -> int:
    return sum(_size(_name(s)) for s in _children(a, "/"))


def likeness(a: str, b: str) -> float:
    """Twice the common code points by those of both texts, from 0 to 1; 1 for equal fingerprints alone."""
    if a == b:
        return 1.0
    whole = length(a) + length(b)
    found = 2.0 * common(a, b) / whole if whole else 0.0
    return min(found, 0.999999)  # the same branches in another order aren't the same text


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Where a differs from b: (start, length) in code points of a, in order, neighbours joined. Branches of a that b has aren't
    looked into."""
    if a == b:
        return []
    left, right = [(0, a)], [b]
    for mark in "/-.":
        have = Counter()
        nodes = [c for node in right for c in _children(node, mark)]
        have.update(map(_name, nodes))
        rest, met = [], Counter()
        for start, node in left:
            for child in _children(node, mark):
                name = _name(child)
                met[name] += 1
                if met[name] > have[name]:
                    rest.append((start, child))
                start += _size(name)
        right = _without(nodes, list(map(_name, nodes)), Counter({n: min(k, met[n]) for n, k in have.items()}))
        left = rest
    spans: list[list[int]] = []
    for start, leaf in left:
        if spans and sum(spans[-1]) == start:
            spans[-1][1] += _size(leaf)
        else:
            spans.append([start, _size(leaf)])
    return [(start, n) for start, n in spans]


# ---------------------------------------------------------------------------------------------------------- operators
@lean
def _prints(batches, kept: int):
    known = Hashes()
    for batch in batches:
        for part in parts(batch, kept):
            texts = [t or "" for t in part.column(kept).to_pylist()]
            columns = [*part.columns[:kept], pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t, known.__getitem__) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(kept + 2)])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with n_chars and fingerprint of each row's whole text; a null counts as empty, whose fingerprint is a root
    alone. Equal texts have equal fingerprints, wherever they are. Other columns are dropped, an empty table gives an empty result."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    kinds = [docs.schema[c].dataType for c in keep] + [T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])
    return rows.mapInArrow(partial(_prints, kept=len(keep)), schema).toDF(*keep, "n_chars", "fingerprint")


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])


@F.pandas_udf(T.StructType([T.StructField("likeness", T.DoubleType()), T.StructField("differences", T.ArrayType(SPAN))]))
def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """likeness and differences (of the first) of two columns of fingerprints; a null counts as an empty text's."""
    pairs = [(x or EMPTY, y or EMPTY) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"likeness": [likeness(x, y) for x, y in pairs], "differences": [[{"start": s, "length": n} for s, n in differences(x, y)] for x, y in pairs]})


EMPTY = fingerprint("")


def _range_of(key: Column, starts: list[int]) -> Column:
    """The last of `starts` (ascending) that isn't above key, by its number: first among every 128th, then among the 128 behind it."""
    groups = [starts[i : i + 128] for i in range(0, len(starts), 128)]
    whole = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    group = F.greatest(F.size(F.filter(whole([g[0] for g in groups]), lambda s: s <= key)) - 1, F.lit(0))
    inside = F.size(F.filter(F.get(F.array(*map(whole, groups)), group), lambda s: s <= key)) - 1
    return group * 128 + F.greatest(inside, F.lit(0))


@lean
def _stream(batches, schema: pa.Schema):
    """Through rows (range, copy, key, text) in order: each row that isn't a copy, with its next."""
    known, before, held, size = Hashes(), None, [], 0
    for batch in batches:
        for part in parts(batch, 3):
            for at, copy, key, text in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                text = text or ""
                now = (at, copy, key, text, fingerprint(text, known.__getitem__))
                if before and before[0] == at and not before[1]:
                    row = _with_next(before, now, known)
                    held.append(row)
                    size += len(row[3]) + len(row[4])
                    if size > BATCH:
                        yield _batch(held, schema)
                        held, size = [], 0
                before = now
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _with_next(row: tuple, after: tuple, known: Hashes) -> tuple:
    _, _, key, text, own = row
    half = len(text) // 2
    edited = text[: len(text) - half] + after[3][:half]
    other = fingerprint(edited, known.__getitem__)
    return key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, after[4])


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row: its text, the same with
    the last half replaced by the beginning of the next row's, and the next row's, compared by their fingerprints.

    Rows are in order of the key (a whole number; null is the least), rows of one key by text; behind the last comes the first, which
    may be the same. A null text counts as empty. Other columns are dropped; an empty table gives an empty result. Rows of one key are
    one task's work, as they have to be in order; a task holds two texts at a time.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{key}`").cast("long"), least).alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(RANGES * tasks, MOST_RANGES)
    found = rows.select(F.percentile_approx("k", [i / n for i in range(n)], 20 * n)).first()[0]
    starts = sorted(set(found or [0]))
    at = _range_of(F.col("k"), starts).cast("long")
    first = F.element_at(F.lit(starts), (at + 1).cast("int")) == F.col("k")
    own, copy = F.struct(at.alias("at"), F.lit(False).alias("copy")), F.struct(F.pmod(at - 1, F.lit(len(starts))).alias("at"), F.lit(True).alias("copy"))
    places = F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own)))
    dealt = rows.select(places.alias("p"), "key", "k", "t").select("p.at", "p.copy", "key", "k", "t")
    dealt = dealt.repartition(tasks, "at").sortWithinPartitions("at", "copy", "k", "t").select("at", "copy", "key", "t")
    kinds = [("key", docs.schema[key].dataType), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    schema = T.StructType([T.StructField(c, k) for c, k in kinds])
    from pyspark.sql.pandas.types import to_arrow_schema

    return dealt.mapInArrow(partial(_stream, schema=to_arrow_schema(schema)), schema).withColumnRenamed("key", key)


def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, source: str) -> str:
    """Leaves, and the fingerprint of each text, of `source` (id, t): tables {name}_leaf (id, h, n) and {name} (id, fp)."""
    md5 = lambda what, by, order: f"md5(string_agg({what}, '' ORDER BY {order}))"
    return rf"""{name}_p AS (SELECT id, i, p, regexp_extract_all(p, '[^.!?]{{0,{LEAF}}}[.!?]+[ \t\n\x0b\x0c\r]*|[^.!?]{{1,{LEAF}}}') AS ls FROM (SELECT id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT id, regexp_extract_all(t, '[^\n]*\n+|[^\n]+') AS ps FROM {source}))),
{name}_l AS MATERIALIZED (SELECT id, i, unnest(range(len(ls))) AS j, md5(unnest(ls)) AS h, length(unnest(ls)) AS n FROM {name}_p),
{name}_h AS (SELECT id, i, md5(string_agg(h, '' ORDER BY j)) AS h, string_agg('.' || h[1:8] || n, '' ORDER BY j) AS body FROM {name}_l GROUP BY ALL),
{name}_b AS (SELECT id, i, h, body, p, (h[1:1] IN ('0', '1') OR suffix(p, chr(10) || chr(10)))::INT AS ends, (p[1:1] = '#')::INT AS heads FROM {name}_h JOIN {name}_p USING (id, i)),
{name}_s AS (SELECT *, sum(greatest(coalesce(before, 0), heads)) OVER (PARTITION BY id ORDER BY i) AS s FROM (SELECT *, lag(ends) OVER (PARTITION BY id ORDER BY i) AS before FROM {name}_b)),
{name}_x AS (SELECT id, s, md5(string_agg(h, '' ORDER BY i)) AS h, sum(length(p))::BIGINT AS n, string_agg('-' || h[1:8] || length(p) || body, '' ORDER BY i) AS body FROM {name}_s GROUP BY ALL),
{name} AS MATERIALIZED (SELECT id, coalesce(fp, md5('')) AS fp FROM {source} LEFT JOIN (SELECT id, md5(string_agg(h, '' ORDER BY s)) || string_agg('/' || h[1:8] || n || body, '' ORDER BY s) AS fp FROM {name}_x GROUP BY id) USING (id))"""


def _sql() -> str:
    """The trees cut and hashed anew, and likeness as twice the common leaves, counted as a multiset, by the leaves of both."""
    shared = lambda a, b, on: f"SELECT x.id, sum(x.n * least(x.c, y.c))::DOUBLE AS m FROM {a} x JOIN {b} y ON {on} AND x.h = y.h AND x.n = y.n GROUP BY x.id"
    near = lambda fp, m, n: f"CASE WHEN o.fp = {fp} THEN 1.0 ELSE least(2 * coalesce({m}, 0) / greatest(d.n + {n}, 1), 0.999999) END::DOUBLE"
    return f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS id, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT d.*, coalesce(lead(id) OVER (ORDER BY id), 1) AS nid FROM d),
ed AS (SELECT nx.id, nx.nid, substring(nx.t, 1, nx.n - nx.n // 2) || substring(b.t, 1, nx.n // 2) AS t FROM nx JOIN d b ON b.id = nx.nid),
{_tree_sql("o", "d")},
{_tree_sql("e", "ed")},
ol AS MATERIALIZED (SELECT id, h[1:8] AS h, n, count(*) AS c FROM o_l GROUP BY ALL),
el AS (SELECT id, h[1:8] AS h, n, count(*) AS c FROM e_l GROUP BY ALL),
ny AS (SELECT nx.id, h, ol.n, c FROM nx JOIN ol ON ol.id = nx.nid),
me AS ({shared("ol", "el", "x.id = y.id")}),
mn AS ({shared("ol", "ny", "x.id = y.id")})
SELECT d.doc_id, d.n AS n_chars, sha256(ed.t) AS edited_sha256, o.fp AS fingerprint, e.fp AS edited_fingerprint, {near("e.fp", "me.m", "length(ed.t)")} AS near_edited, {near("p.fp", "mn.m", "b.n")} AS near_next
FROM nx d JOIN ed USING (id) JOIN o USING (id) JOIN e USING (id) JOIN d b ON b.id = d.nid JOIN o p ON p.id = d.nid LEFT JOIN me ON me.id = d.id LEFT JOIN mn ON mn.id = d.id"""


ORACLE_SQL = _sql()
