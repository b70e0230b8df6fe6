"""The text of an element of large XML files, read in byte ranges.

A Python data source deals a file out in ranges, of which a task reads as many as TASK bytes hold. A range owns the elements whose start tag begins in it: its reader goes from the first
`<` that it owns to the range's end, and beyond that for as long as its last element needs. Tags hold no `<`, so a range that begins
inside a tag finds the next one by itself; only a comment, a CDATA section or a processing instruction that reaches over the border
could hide one. A first pass over the ranges therefore tells for each where the last piece of markup that begins in it ends, and how
many elements it owns; ranges whose first `<` lies inside their neighbour's last piece are scanned anew from its end. The counts number the
documents densely, by file and place, without a sort, and a limit on documents takes away the ranges behind it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.arrow import slices

SPLIT = 64 << 20
STEP = 1 << 20
OUT = 8 << 20
TASK = 16 << 20  # bytes of the ranges that one task reads in turn
TASKS = 64  # into which smaller folders are dealt
BROADCAST_RANGES = 200_000
TAG = re.compile(rb"""<(/?)([^\s/>"'<]+)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>""")
LOOSE_TAG = re.compile(rb"<(/?)([^\s/><]+)([^<>]*)>")  # where quotes don't pair
#: Markup in which a `<` may stand, by its beginning and end.
SECTIONS = ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>"), (b"<!", b">"))


class Bytes:
    """The bytes of a file from `begin` on, read as far as asked for."""

    def __init__(self, file, size: int, begin: int, upto: int):
        self.file, self.size, self.base, self.data, self.step = file, size, begin, b"", STEP
        file.seek(begin)
        self.fill(upto)

    def fill(self, upto: int) -> bool:
        """Reads up to a place in the file at least, or to its end; false if there was nothing more."""
        have = self.base + len(self.data)
        if have >= self.size:
            return False
        self.data += self.file.read(min(max(upto, have + self.step), self.size) - have)
        self.step *= 2
        return True

    def find(self, what: bytes, at: int) -> int:
        """The first place of `what` from `at` on; -1 if there is none in the file."""
        while True:
            found = self.data.find(what, at - self.base)
            if found >= 0:
                return self.base + found
            at = max(at, self.base + len(self.data) - len(what) + 1)
            if not self.fill(0):
                return -1

    def cut(self, a: int, b: int) -> bytes:
        return self.data[a - self.base : b - self.base]


@dataclass
class Markup:
    begin: int
    end: int
    name: bytes | None = None  # of a tag
    closes: bool = False
    empty: bool = False


def markup(source: Bytes, at: int) -> Iterator[Markup]:
    """The pieces of markup from `at` on, which isn't inside one. Markup without an end reaches to the end of the file; a `<` that opens
    nothing is text."""
    while True:
        at = source.find(b"<", at)
        if at < 0:
            return
        if source.base + len(source.data) < at + 16:
            source.fill(at + 16)
        head = source.cut(at, at + 16)
        for opens, closes in SECTIONS:
            if head.startswith(opens):
                end = source.find(closes, at + len(opens))
                end = source.size if end < 0 else end + len(closes)
                yield Markup(at, end)
                at = end
                break
        else:
            after = source.find(b"<", at + 1)
            stop = (source.size if after < 0 else after) - source.base
            found = TAG.match(source.data, at - source.base, stop) or LOOSE_TAG.match(source.data, at - source.base, stop)
            if not found:
                at += 1
                continue
            end = source.base + found.end()
            yield Markup(at, end, found[2], bool(found[1]), found[3].endswith(b"/"))
            at = end


def elements(source: Bytes, tag: bytes, begin: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(resume, text) of a range: one for each element that begins in it, then one without text. Text is what stands between pieces of
    markup inside the element, nested ones too; a start tag inside an element begins it anew, one of the form <tag/> counts for
    nothing. `resume` is where the range's last piece of markup ends, its own end at least."""
    resume, parts, at = end, None, 0
    for m in markup(source, begin):
        if m.begin < end:
            resume = max(end, m.end)
        elif parts is None:
            break
        if parts is not None:
            parts.append(source.cut(at, m.begin))
        at = m.end
        if m.name == tag and not m.empty:
            if m.closes and parts is not None:
                yield resume, b"".join(parts)
            parts = [] if m.begin < end and not m.closes else None
    yield resume, None


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if not urlparse(path).scheme:
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Range:
    path: str
    size: int
    begin: int
    end: int
    entry: int


@dataclass
class Ranges(InputPartition):
    """What one task reads, a range after the other."""

    ranges: list[Range]


class SplitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tag, self.split, self.scan = options["path"], options["tag"].encode(), int(options["split"]), options["mode"] == "scan"
        self.entries = json.loads(options.get("entries", "{}"))  # where ranges are entered that aren't entered at their beginning
        self.only = json.loads(options["only"]) if "only" in options else None

    def partitions(self) -> list[Ranges]:
        store, path = file_system(self.path)
        files = [f for f in store.get_file_info(pa.fs.FileSelector(path, recursive=False)) if f.type == pa.fs.FileType.File and f.base_name[0] not in "._"]
        found = []
        for f in sorted(files, key=lambda f: f.base_name):
            for begin in range(0, f.size, self.split):
                key = f"{f.base_name}:{begin}"
                if self.only is None or key in self.only:
                    found.append(Range(f.base_name, f.size, begin, min(begin + self.split, f.size), self.entries.get(key, begin)))
        self.entries, self.only = {}, None  # the ranges have them; tasks needn't carry those of all others
        most = min(TASK, max(self.split, sum(r.end - r.begin for r in found) // TASKS))
        return [Ranges(found[a:b]) for a, b in slices([r.end - r.begin for r in found], most)] or [Ranges([])]

    def read(self, task: Ranges):
        store, folder = file_system(self.path)
        for part in task.ranges:
            yield from self._read(store, folder, part)

    def _read(self, store: pa.fs.FileSystem, folder: str, part: Range):
        with store.open_input_file(f"{folder.rstrip('/')}/{part.path}") as file:
            # a scan looks for the first `<` of the range itself too, which may lie before its entry
            source = Bytes(file, part.size, part.begin, part.end)
            at = source.find(b"<", part.begin)
            n, held, size = 0, [], 0
            for resume, text in elements(source, self.tag, part.entry, part.end):
                if text is None:
                    if self.scan:
                        yield part.path, part.begin, part.end, part.end if at < 0 else min(at, part.end), resume, n
                elif not self.scan:
                    held.append(html.unescape(text.decode("utf-8", "replace")))
                    size += len(text)
                    if size > OUT:
                        yield self._batch(part, n + 1 - len(held), held)
                        held, size = [], 0
                n += text is not None
            if held:
                yield self._batch(part, n - len(held), held)

    def _batch(self, part: Range, first: int, texts: list[str]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([part.begin] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(texts, pa.string())], names=["path", "begin", "place", "text"])


class XmlSplits(DataSource):
    """Options: path (folder), tag, split (bytes of a range), mode (scan or read), entries and only (see read_xml_splits)."""

    @classmethod
    def name(cls) -> str:
        return "xml_splits"

    def schema(self) -> str:
        scan = self.options["mode"] == "scan"
        return "path string, begin long, end long, first long, resume long, n long" if scan else "path string, begin long, place long, text string"

    def reader(self, schema) -> SplitReader:
        return SplitReader(self.options)


def _load(spark: SparkSession, folder: str, tag: str, split: int, mode: str, **options: str) -> DataFrame:
    spark.dataSource.register(XmlSplits)
    return spark.read.format("xml_splits").options(path=folder, tag=tag, split=str(split), mode=mode, **options).load()


def scan_ranges(spark: SparkSession, folder: str, tag: str, split: int = SPLIT) -> list[dict]:
    """A row of numbers for each range, by file and place: path, begin, end, entry, n (elements that it owns) and base (those of all
    ranges before it). The driver holds these rows, one for `split` bytes."""
    rows = [r.asDict() for r in _load(spark, folder, tag, split, "scan").collect()]
    rows.sort(key=lambda r: (r["path"], r["begin"]))
    known = {(r["path"], r["begin"], r["begin"]): (r["resume"], r["n"]) for r in rows}  # by range and entry
    while True:
        anew, file, resume, base = {}, None, 0, 0
        for r in rows:
            resume = resume if file == r["path"] else 0
            file, entry = r["path"], max(resume, r["begin"])
            entry = r["begin"] if r["first"] >= entry else entry
            if entry >= r["end"]:  # inside a piece of markup from end to end
                n = 0
            elif (file, r["begin"], entry) in known:
                resume, n = known[file, r["begin"], entry]
            else:
                anew[f"{file}:{r['begin']}"] = entry
                resume, n = known[file, r["begin"], r["begin"]]  # a guess for this round
            r |= {"entry": min(entry, r["end"]), "n": n, "base": base}
            base += n
        if not anew:
            return rows
        for r in _load(spark, folder, tag, split, "scan", entries=json.dumps(anew), only=json.dumps(sorted(anew))).collect():
            known[r["path"], r["begin"], anew[f"{r['path']}:{r['begin']}"]] = r["resume"], r["n"]


def read_xml_splits(spark: SparkSession, folder: str, tag: str, split: int = SPLIT, limit: int | None = None) -> DataFrame:
    """doc_id (dense, from 0, by file name and place) and text of the elements `tag` of the files in a folder (not in folders below; names
    with a leading dot or underscore don't count). Files are UTF-8, on any store that pyarrow opens. With a limit the first so many
    documents; ranges behind them aren't read again."""
    ranges = scan_ranges(spark, folder, tag, split)
    options = {"entries": json.dumps({f"{r['path']}:{r['begin']}": r["entry"] for r in ranges if r["entry"] != r["begin"]})}
    if limit is not None:
        ranges = [r for r in ranges if r["base"] < limit and r["n"]]
        options["only"] = json.dumps([f"{r['path']}:{r['begin']}" for r in ranges])
    starts = spark.createDataFrame([(r["path"], r["begin"], r["base"]) for r in ranges], "path string, begin long, base long")
    starts = F.broadcast(starts) if len(ranges) <= BROADCAST_RANGES else starts
    rows = _load(spark, folder, tag, split, "read", **options).join(starts, ["path", "begin"])
    docs = rows.select((F.col("base") + F.col("place")).alias("doc_id"), "text")
    return docs if limit is None else docs.where(F.col("doc_id") < limit)
