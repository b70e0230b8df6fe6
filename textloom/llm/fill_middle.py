"""Fill-in-middle transformation of documents on ropes.

A text is a rope: a height-balanced tree over leaves of text, each node with the units and the code points below it. A unit is what a
pattern matches (a code point by default; a word or a line as well), so a tree can be cut at a unit rank or at a code-point
rank along one path. A document is cut at two unit ranks and its parts are joined in another order behind sentinels; the inverse finds
the sentinels and cuts the transformed tree there. Parts share their subtrees, nothing is copied but the cut leaves.

Every document is transformed within its row: no shuffle, so neither a hot source nor a group of copies gathers anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, parts, table

CODE_POINT = "(?s:.)"
WORD = r"\s*\S+"
LINE = r"[^\n]*\n|[^\n]+"
LEAF = 512  # code points of a leaf at most, where a unit isn't longer
#: The sentinels in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


# --------------------------------------------------------------------------------------------------------------- ropes
class Rope:
    """A node: a leaf with its text, or two subtrees. Empty ropes are leaves without text."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str | None, left: Rope | None, right: Rope | None, units: int, chars: int, height: int):
        self.text, self.left, self.right, self.units, self.chars, self.height = text, left, right, units, chars, height

    def __str__(self) -> str:
        return "".join(leaf.text for leaf in self.leaves())

    def leaves(self) -> Iterator[Rope]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            if node.text is None:
                waiting += (node.right, node.left)
            else:
                yield node


EMPTY = Rope("", None, None, 0, 0, 0)


def leaf(text: str, units: int) -> Rope:
    return Rope(text, None, None, units, len(text), 0) if text else EMPTY


def _node(left: Rope, right: Rope) -> Rope:
    return Rope(None, left, right, left.units + right.units, left.chars + right.chars, max(left.height, right.height) + 1)


def _balanced(left: Rope, right: Rope) -> Rope:
    """A node over two trees whose heights differ by two at most."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return _node(left.left, _node(left.right, right))
        return _node(_node(left.left, left.right.left), _node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return _node(_node(left, right.left), right.right)
        return _node(_node(left, right.left.left), _node(right.left.right, right.right))
    return _node(left, right)


def concat(left: Rope, right: Rope) -> Rope:
    """The two joined, in as many steps as their heights differ by."""
    if not left.chars:
        return right
    if not right.chars:
        return left
    if left.height > right.height + 1:
        return _balanced(left.left, concat(left.right, right))
    if right.height > left.height + 1:
        return _balanced(concat(left, right.left), right.right)
    return _node(left, right)


def rope(text: str, unit: str = CODE_POINT, most: int = LEAF) -> Rope:
    """A balanced rope of a text. Units are the pattern's matches from left to right; what stands between matches belongs to the
    unit behind it, a rest at the end to the last unit (a text without a match is one unit)."""
    if unit == CODE_POINT:
        level = [leaf(text[i : i + most], min(most, len(text) - i)) for i in range(0, len(text), most)]
    else:
        ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()] or [len(text)]
        ends[-1] = len(text)
        level, begin, count = [], 0, 0
        for i, end in enumerate(ends):
            count += 1
            if i + 1 == len(ends) or ends[i + 1] - begin > most:
                level.append(leaf(text[begin:end], count))
                begin, count = end, 0
    while len(level) > 1:  # pairs of neighbours, so that heights differ by one at most
        level = [concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level and text else EMPTY


def _at_unit(node: Rope, rank: int, unit: str) -> int:
    """How many code points of a leaf its first `rank` units take."""
    if node.units == node.chars:
        return rank
    ends = [m.end() for m in re.finditer(unit, node.text) if m.end() > m.start()][:rank]
    return ends[-1] if ends else 0


def split_units(node: Rope, rank: int, unit: str = CODE_POINT) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.units:
        return node, EMPTY
    if node.text is not None:
        at = _at_unit(node, rank, unit)
        return leaf(node.text[:at], rank), leaf(node.text[at:], node.units - rank)
    if rank < node.left.units:
        a, b = split_units(node.left, rank, unit)
        return a, concat(b, node.right)
    a, b = split_units(node.right, rank - node.left.units, unit)
    return concat(node.left, a), b


def split_chars(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` code points, and the rest, of a rope whose units are code points."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.chars:
        return node, EMPTY
    if node.text is not None:
        return leaf(node.text[:rank], rank), leaf(node.text[rank:], node.chars - rank)
    if rank < node.left.chars:
        a, b = split_chars(node.left, rank)
        return a, concat(b, node.right)
    a, b = split_chars(node.right, rank - node.left.chars)
    return concat(node.left, a), b


# ------------------------------------------------------------------------------------------------------- transformation
def rearrange(whole: Rope, first: int, second: int, form: str, unit: str = CODE_POINT) -> tuple[Rope, Rope, Rope]:
    """The transformed rope, its prefix and its middle, of a rope cut behind `first` and `second` units (first <= second)."""
    rest, suffix = split_units(whole, second, unit)
    prefix, middle = split_units(rest, first, unit)
    order = ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
    out = EMPTY
    for mark, part in order:
        out = concat(concat(out, leaf(mark, 1)), part)
    return out, prefix, middle


def invert(output: str, form: str) -> str:
    """The text that an output came from. Parts hold no sentinel, and none can arise where a part meets one, so each sentinel is
    found at its first place."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    second = output.find(two, len(one))
    third = output.find(MIDDLE, second + len(two))
    if not output.startswith(one) or second < 0 or third < 0:
        raise ValueError(f"not of the form {form}")
    head, middle = split_chars(rope(output), third)
    a, b = split_chars(head, second)
    a, b, middle = (split_chars(part, 3)[1] for part in (a, b, middle))
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return str(concat(concat(prefix, middle), suffix))


def _strings(column) -> list[str]:
    return [v or "" for v in column.to_pylist()]


@lean
def _transform(batches, kept: int, schema: pa.Schema, rate: int, spm: int, unit: str):
    for batch in batches:
        for part in parts(batch, kept):
            rows = [[] for _ in range(5)]
            for text, *h in zip(_strings(part.column(kept)), *[part.column(kept + 1 + i).to_pylist() for i in range(4)], strict=True):
                whole = rope(text, unit)
                n = whole.units
                if not text or h[2] % 100 >= rate or any(s in text for s in SENTINELS):
                    row = (n, "plain", None, None, text)
                else:
                    form = "spm" if h[3] % 100 < spm else "psm"
                    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    out, prefix, middle = rearrange(whole, first, second, form, unit)
                    row = (n, form, prefix.chars, middle.chars, str(out))
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            made = [pa.array(c, schema.field(kept + i).type) for i, c in enumerate(rows)]
            yield pa.RecordBatch.from_arrays(part.columns[:kept] + made, names=[f"c{i}" for i in range(kept + len(made))])


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of `seed:key`; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20, unit: str = CODE_POINT) -> DataFrame:
    """The columns `keep`, then n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if
    plain) and output, for every row of docs.

    `rate` percent of the texts are rearranged, `spm` percent of these with the suffix first; where they are cut depends on seed and key
    alone, so equal rows get equal results. A null or empty text, and one that holds a sentinel, stays plain.
    The columns of `keep` pass through, whatever their names and nulls; other columns are dropped. An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*columns, F.col(f"`{text}`").cast("string").alias("t"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(f"`{key}`"), seed))])
    made = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    kept = [(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField(f"c{i}", kind) for i, (_, kind) in enumerate([*kept, *made])])
    arrow = pa.schema([pa.field("x", pa.null())] * len(keep) + [pa.field(n, pa.string() if isinstance(k, T.StringType) else pa.int64()) for n, k in made])
    out = rows.mapInArrow(partial(_transform, kept=len(keep), schema=arrow, rate=rate, spm=spm, unit=unit), schema)
    return out.toDF(*keep, *[n for n, _ in made])


@lean
def _restore(batches, at: int, by: int):
    for batch in batches:
        for part in parts(batch, at):
            texts = pa.array(list(map(invert, _strings(part.column(at)), _strings(part.column(by)))), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[f"c{i}" for i in range(part.num_columns + 1)])


def restore(rows: DataFrame) -> DataFrame:
    """rows (output and form among its columns) with one more, restored: the text that output came from. A null form is an error, as
    is an output without its sentinels; a null output counts as empty."""
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*rows.schema, T.StructField("", T.StringType())])])
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    out = plain.mapInArrow(partial(_restore, at=rows.columns.index("output"), by=rows.columns.index("form")), schema)
    return out.toDF(*rows.columns, "restored")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_middle(table(spark, sf_dir, "documents"), ["doc_id"]))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<S>' || substring(t, b + 1) AS s, '<M>' || substring(t, a + 1, b - a) AS m FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
