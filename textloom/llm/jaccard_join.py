"""N-gram Jaccard self-join of documents, with set-relation skipping, and its connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. Rows with equal sets are one class from the start, and all
later work is on classes, so copies are never paired.

Index. Shingles have one global order, rare ones first: by the load of their bucket in a counting sketch of fixed size over all
classes, then by hash. Two sets that link share a shingle of their prefixes (the first n - ceil(t * n) + 1 of n), so the inverted
lists hold prefixes only, as (shingle, class, size, position).

Index-level skipping. Lists are sorted by size and position and cut into blocks; a set skips the blocks whose sizes or positions
can't leave the overlap that the threshold needs.

Answer-level skipping. Each list is first answered for one set, its pivot: the others of the list are verified against it, and
those that link have its answers. Only members of a list that are still in different components are then paired among each
other, as a set's links to its pivot's links change no component. Answers of such a pair are derived from the pivot's: what both share
with the pivot bounds what they share with each other from both sides, so a pair links, or doesn't, without its sets being read where the
bounds decide (derived()). The result is exact: classes end in one component exactly if a chain of links joins them.

Parities. Each class has a bit string of fixed size in which each member of the set flips one bit. Two sets differ in at least as many
members as their strings differ in bits, so most pairs that don't link are dropped without their sets, and dropping them is exact.

Pairs that are left are verified on whole sets, fetched for classes that are in a pair. Only counts reach the driver.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, held, lean, materialize, table

BUCKETS = 1 << 18
SHARDS = 16  # of the sketch, when the tasks' loads are summed
BLOCK = 64
BROADCAST_ROWS = 400_000
PARITY_BITS = 512
FLUSH = 200_000
WORDS = 250_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = value
        return value


def shingle_set(text: bytes, k: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words one hash of them all; without a word none."""
    words = text.lower().split()  # of bytes: A-Z, and white space as in [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(held("word hashes", _Hashes).__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        mixed = np.full(n, width, np.uint64)
        for i in range(width):
            mixed = (mixed ^ ids[i : i + n]) * _MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
        mixed *= _FINISH
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)))))


def parity(shingles: np.ndarray) -> bytes:
    """Bit i is set if an odd number of members fall on it."""
    flips = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(a, b, percent: int):
    """Least overlap with which sets of sizes a and b link: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


# ------------------------------------------------------------------------------------------------- sets, sketch and index
@lean
def _signatures(batches, k: int, names: list[str]):
    """Rows of the documents; at the end SHARDS rows with the loads that the task's classes put on the sketch's buckets."""
    loads, seen, kinds = np.zeros(BUCKETS, np.int64), set(), None
    for batch in batches:
        size, sig, put, bits = [], [], [], []
        for text in as_bytes(batch.column(len(names))):
            s = shingle_set(text, k)
            size.append(len(s))
            sig.append(signature(s))
            bits.append(parity(s))
            if sig[-1] not in seen:
                if len(seen) < 1_000_000:  # beyond, some copies add to the loads, which only order the shingles
                    seen.add(sig[-1])
                put.append((s >> np.uint64(46)).astype(np.int64))
        if put:
            loads += np.bincount(np.concatenate(put), minlength=BUCKETS)
        kept = [batch.column(i) for i in range(len(names))]
        kinds = [c.type for c in kept]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(size, pa.int64()), pa.array(sig, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(size), pa.binary())], [*names, "n_shingles", "sig", "bits", "loads"])
    if kinds is not None:
        nulls = [pa.nulls(SHARDS, t) for t in [*kinds, pa.int64()]]
        parts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(loads, SHARDS)]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(SHARDS), pa.int64()), pa.nulls(SHARDS, pa.binary()), pa.array(parts, pa.binary())], [*names, "n_shingles", "sig", "bits", "loads"])


@lean
def _add_loads(batches):
    """Sums of rows (shard, loads) by shard; holds one row a shard."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            totals[shard] = totals.get(shard, 0) + np.frombuffer(zlib.decompress(raw), "<i8")
    for shard, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], ["shard", "loads"])


@lean
def _prefixes(batches, k: int, percent: int, rank: np.ndarray):
    seen: set[int] = set()
    for batch in batches:
        shingle, sig, size, place = [], [], [], []
        for text in as_bytes(batch.column(0)):
            s = shingle_set(text, k)
            if not len(s):
                continue
            own = signature(s)
            if own in seen:
                continue
            if len(seen) < 1_000_000:  # beyond, an entry may come twice; lists drop repeated entries
                seen.add(own)
            p = prefix_length(len(s), percent)
            first = np.lexsort((s, rank[(s >> np.uint64(46)).astype(np.int64)]))[:p]
            shingle.append(s[first].view(np.int64))
            sig.append(np.full(p, own, np.int64))
            size.append(np.full(p, len(s), np.int32))
            place.append(np.arange(p, dtype=np.int32))
        if shingle:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shingle, sig, size, place)], ["shingle", "sig", "n", "pos"])


@lean
def _shared(batches):
    """Of entries sorted by shingle: those of lists with two classes or more, each once."""
    names = ["shingle", "sig", "n", "pos"]
    held: list[np.ndarray] = []
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(4)]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.searchsorted(now[0], now[0][-1], "left")  # the last list may go on in the next batch
        held, now = [c[last:] for c in now], [c[:last] for c in now]
        yield from _shared_of(now, names)
    if held:
        yield from _shared_of(held, names)


def _shared_of(columns, names):
    shingle, sig = columns[:2]
    if not len(shingle):
        return
    fresh = np.r_[True, (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])]
    columns = [c[fresh] for c in columns]
    starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
    sizes = np.diff(np.r_[starts, len(columns[0])])
    many = np.repeat(sizes > 1, sizes)
    if many.any():
        yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in columns], names)


# ------------------------------------------------------------------------------------------------- pairs and verification
def list_pairs(sig, n, pos, component, bits, percent: int):
    """Pairs of one list, sorted by size and position, that are in different components and may link. bits: rows of uint64."""
    blocks = range(0, len(sig), BLOCK)
    least_pos = [pos[b : b + BLOCK].min() for b in blocks]
    top_size = [n[min(b + BLOCK, len(n)) - 1] for b in blocks]
    for i in range(len(sig) - 1):
        limit = np.searchsorted(n, n[i] * 100 // percent, "right")
        parts = []
        for k in range((i + 1) // BLOCK, -(-limit // BLOCK)):
            low, high = max(i + 1, k * BLOCK), min(limit, (k + 1) * BLOCK)
            if low >= high or 1 + min(n[i] - pos[i] - 1, top_size[k] - least_pos[k] - 1) < needed(n[i], n[low], percent):
                continue  # no set of the block leaves enough behind this position
            parts.append(np.arange(low, high))
        if not parts:
            continue
        j = np.concatenate(parts)
        need = needed(n[i], n[j], percent)
        left = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
        keep = (left >= need) & (component[j] != component[i])
        j, need = j[keep], need[keep]
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= n[i] + n[j] - 2 * need]
        if len(j):
            yield np.full(len(j), sig[i]), sig[j]


def derived(na, nb, pa_, pb, n_pivot, percent: int):
    """(may link, does link) of pairs of sets of sizes na and nb that share pa_ and pb members with a pivot of n_pivot members: two sets
    share at most the lesser of what they share with it and of what they don't, and at least what they must both share with it."""
    need = needed(na, nb, percent)
    return np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb) >= need, pa_ + pb - n_pivot >= need


@lean
def _join_lists(batches, percent: int):
    """Entries (shingle, n, pos, sig, component, shared, n_pivot, bits) sorted by shingle, n, pos, sig: pairs within each list, and whether
    they are known to link. shared: with the list's pivot, -1 if that isn't known. A list may span batches."""
    held: list[np.ndarray] = []

    def out(a, b, sure):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, sure)], ["a", "b", "sure"])

    def run(columns):
        a, b, sure, size = [], [], [], 0
        starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(columns[0])], strict=True):
            n, pos, sig, component, shared, n_pivot, bits = (c[lo:hi] for c in columns[1:])
            n, shared = n.astype(np.int64), shared.astype(np.int64)
            for x, y in list_pairs(np.arange(len(sig)), n, pos.astype(np.int64), component, bits, percent):
                known = (shared[x] >= 0) & (shared[y] >= 0)
                may, does = derived(n[x], n[y], shared[x], shared[y], int(n_pivot[0]), percent)
                keep = ~known | may
                x, y, does = x[keep], y[keep], (does & known)[keep]
                a.append(np.minimum(sig[x], sig[y]))
                b.append(np.maximum(sig[x], sig[y]))
                sure.append(does)
                size += len(x)
                if size > FLUSH:
                    yield out(a, b, sure)
                    a, b, sure, size = [], [], [], 0
        if size:
            yield out(a, b, sure)

    for batch in batches:
        bits = np.frombuffer(b"".join(as_bytes(batch.column(7))), np.uint64).reshape(-1, PARITY_BITS // 64)
        now = [*[batch.column(i).to_numpy() for i in range(7)], bits]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.searchsorted(now[0], now[0][-1], "left")
        held, now = [c[last:] for c in now], [c[:last] for c in now]
        if len(now[0]):
            yield from run(now)
    if held and len(held[0]):
        yield from run(held)


@lean
def _may_link(batches, percent: int):
    """Pairs (a, b, na, nb, x, y) whose parities leave enough overlap."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        x, y = (np.frombuffer(b"".join(as_bytes(batch.column(i))), np.uint64).reshape(-1, PARITY_BITS // 64) for i in (4, 5))
        keep = np.bitwise_count(x ^ y).sum(axis=1) <= na + nb - 2 * needed(na, nb, percent)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


@lean
def _sets(batches, k: int):
    seen: set[int] = set()
    for batch in batches:
        sig, members = [], []
        for text in as_bytes(batch.column(0)):
            s = shingle_set(text, k)
            own = signature(s)
            if own not in seen:
                if len(seen) < 1_000_000:
                    seen.add(own)
                sig.append(own)
                members.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(members, pa.binary())], ["sig", "members"])


@lean
def _verify(batches, percent: int):
    for batch in batches:
        a, b = as_bytes(batch.column(2)), as_bytes(batch.column(3))
        keep, shared = [], []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(both)
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(keep, pa.bool_())], ["a", "b", "shared", "linked"])


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a, b), long columns.

    Each step hooks every root to its smallest neighbour, shortens the chains of hooks, and contracts the edges; roots with an
    edge left at least halve. Tables are written to the shared folder after each step; only counts reach the driver.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.withColumn("component", F.col("node")), "labels")
    now = edges.select("a", "b").where("a <> b")
    for _ in range(steps):
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        hooks = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # chains of hooks only go down, so doubling ends them
            up = hooks.select(F.col("a").alias("q"), F.col("p").alias("pp"))
            joined = hooks.join(up, F.col("p") == F.col("q")).select("a", "pp", (F.col("p") != F.col("pp")).alias("moved"))
            joined = materialize(joined, "hooks")
            hooks = joined.select("a", F.col("pp").alias("p"))
            if joined.where("moved").isEmpty():
                break
        at = lambda name, out: hooks.select(F.col("a").alias(name), F.col("p").alias(out))
        labels = labels.join(at("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = materialize(labels, "labels")
        now = now.join(at("a", "ra"), "a").join(at("b", "rb"), "b").where("ra <> rb")
        now = materialize(now.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {steps} steps on {spark.sparkContext.appName}")


def small(rows: DataFrame) -> DataFrame:
    """rows of a few long columns, to broadcast if a count finds at most BROADCAST_ROWS of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


class Join:
    """One run of the join over `docs`: rows, links and classes. `percent`: a pair links from this Jaccard similarity on."""

    def __init__(self, docs: DataFrame, keep: list[str], percent: int = 85, k: int = 4, text: str = "text"):
        if not 0 < percent <= 100:
            raise ValueError("percent: 1 to 100")
        self.percent, self.k, self.keep, self.spark = percent, k, keep, docs.sparkSession
        long = T.LongType()
        self.texts = docs.select(F.xxhash64(*[F.col(f"`{c}`") for c in keep]).alias("key"), F.col(f"`{text}`").alias("body"))
        schema = T.StructType([*[T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], T.StructField("n_shingles", long), T.StructField("sig", long), T.StructField("bits", T.BinaryType()), T.StructField("loads", T.BinaryType())])
        names = [f"k{i}" for i in range(len(keep))]
        source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("body"))
        both = materialize(source.mapInArrow(partial(_signatures, k=k, names=names), schema), "signatures")
        self.names = names
        self.rows = both.where(F.col("loads").isNull()).drop("loads")
        self._classes: DataFrame | None = None
        put = both.where(F.col("loads").isNotNull()).select(F.col("sig").alias("shard"), "loads")
        summed = put.mapInArrow(_add_loads, "shard long, loads binary").repartition(SHARDS, "shard").mapInArrow(_add_loads, "shard long, loads binary").collect()
        summed = [np.frombuffer(zlib.decompress(r["loads"]), "<i8") for r in sorted(summed, key=lambda r: r["shard"])]  # a row for each shard
        self.loads = np.concatenate(summed) if summed else np.zeros(BUCKETS, np.int64)

    def lists(self) -> DataFrame:
        """The inverted lists with two classes or more: shingle, sig, n, pos."""
        schema = "shingle long, sig long, n int, pos int"
        rank = np.minimum(self.loads, np.iinfo(np.int32).max).astype(np.int32)
        entries = self.texts.select("body").mapInArrow(partial(_prefixes, k=self.k, percent=self.percent, rank=rank), schema)
        grouped = entries.repartition(self._parts(), "shingle").sortWithinPartitions("shingle", "sig")
        return materialize(grouped.mapInArrow(_shared, schema), "lists")

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def classes(self) -> DataFrame:
        """sig, key (of one of its rows), n, bits, one row for each class."""
        if self._classes is None:
            picked = F.min(F.struct(F.xxhash64(*self.names).alias("key"), F.col("n_shingles").alias("n"), "bits"))
            grouped = self.rows.where("n_shingles > 0").groupBy("sig").agg(picked.alias("c")).select("sig", "c.key", "c.n", "c.bits")
            self._classes = materialize(grouped, "classes")
        return self._classes

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their parities let link."""
        side = lambda s, n, x: self.classes().select(F.col("sig").alias(s), F.col("n").alias(n), F.col("bits").alias(x))
        both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")
        return both.mapInArrow(partial(_may_link, percent=self.percent), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of classes with how many members they share and whether they link, by their whole sets."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        owners = materialize(self.classes().join(small(wanted), "sig", "left_semi").select("sig", "key"), "owners")
        keys, sigs = small(owners.select("key").distinct()), small(owners.select("sig"))
        found = self.texts.join(keys, "key", "left_semi").select("body").mapInArrow(partial(_sets, k=self.k), "sig long, members binary")
        sets = materialize(found.join(sigs, "sig", "left_semi"), "sets")

        def side(name: str, members: str) -> DataFrame:
            """The sets that stand on this side of a pair; no others are shuffled for it."""
            return sets.join(small(pairs.select(F.col(name).alias("sig")).distinct()), "sig", "left_semi").select(F.col("sig").alias(name), F.col("members").alias(members))

        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        return materialize(both.mapInArrow(partial(_verify, percent=self.percent), "a long, b long, shared int, linked boolean"), "verified")

    def may_link(self, a: str, b: str):
        """Size and position conditions on two entries of one list, as columns."""
        field = lambda s, c: F.col(f"{s}.{c}")
        na, nb = field(a, "n").cast("long"), field(b, "n").cast("long")
        need = F.ceil(self.percent * (na + nb) / F.lit(100 + self.percent))
        left = 1 + F.least(na - field(a, "pos") - 1, nb - field(b, "pos") - 1)
        return (100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)) & (left >= need)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) between classes that join every two classes which a chain of links joins, and their components."""
        lists = self.lists()
        pivots = lists.groupBy("shingle").agg(F.min(F.struct("pos", "sig", "n")).alias("u"))
        star = lists.withColumn("v", F.struct("pos", "sig", "n")).join(pivots, "shingle").where((F.col("v.sig") != F.col("u.sig")) & self.may_link("u", "v"))
        star = materialize(star.select(F.least("u.sig", "v.sig").alias("a"), F.greatest("u.sig", "v.sig").alias("b")).distinct(), "star")
        checked = self.verified(materialize(self.possible(star), "possible"))
        found = checked.where("linked").select("a", "b")
        labels = components(found)
        named = lists.join(small(labels.withColumnRenamed("node", "sig")), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        named = materialize(named, "named")
        apart = named.groupBy("shingle").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("shingle")
        entries = named.join(apart, "shingle", "left_semi").join(pivots.select("shingle", F.col("u.sig").alias("p"), F.col("u.n").alias("n_pivot")), "shingle")
        near = checked.select("a", "b", "shared")
        entries = entries.withColumns({"a": F.least("p", "sig"), "b": F.greatest("p", "sig")}).join(near, ["a", "b"], "left")
        entries = entries.withColumn("shared", F.when(F.col("p") == F.col("sig"), F.col("n")).otherwise(F.coalesce("shared", F.lit(-1))))
        entries = entries.join(self.classes().select("sig", "bits"), "sig").select("shingle", "n", "pos", "sig", "component", "shared", "n_pivot", "bits")
        entries = entries.repartition(self._parts(), "shingle").sortWithinPartitions("shingle", "n", "pos", "sig")
        rest = entries.mapInArrow(partial(_join_lists, percent=self.percent), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")).join(star, ["a", "b"], "left_anti")
        rest = materialize(rest, "rest")
        if rest.isEmpty():
            return found, labels
        more, open_ = rest.where("sure").select("a", "b"), rest.where("not sure").select("a", "b")
        if not open_.isEmpty():
            more = more.union(self.verified(open_).where("linked").select("a", "b"))
        if more.isEmpty():
            return found, labels
        every = materialize(found.union(more), "links")
        return every, components(every)

    def classified(self, doc_id: str = "doc_id") -> DataFrame:
        """The columns `keep` with n_shingles and component_id, the smallest doc_id reachable by links (own if there are none).
        Rows without a word link with nothing. Rows with the same doc_id are separate documents."""
        own = F.col(self.names[self.keep.index(doc_id)])
        filled = self.rows.where("n_shingles > 0").drop("bits")
        labels = self.links()[1].withColumnRenamed("node", "sig")
        classes = filled.groupBy("sig").agg(F.min(own).alias("least")).join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        classes = materialize(classes, "classes")
        ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
        named = materialize(classes.join(ids, "component").select("sig", "component_id"), "named")
        out = [F.col(n).alias(c) for n, c in zip(self.names, self.keep, strict=True)]
        linked = filled.join(named, "sig").select(*out, "n_shingles", "component_id")
        return linked.union(self.rows.where("n_shingles = 0").select(*out, "n_shingles", own.alias("component_id")))


def near_duplicates(docs: DataFrame, keep: list[str], percent: int = 85, k: int = 4) -> DataFrame:
    return Join(docs, keep, percent, k).classified()


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_shingles", "component_id")


#: The same in DuckDB SQL, by all pairs that share a shingle; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE j_words AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
j_sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM j_words),
j_each AS (SELECT rid, len(g) AS n, unnest(g) AS x FROM j_sets),
j_pairs AS (SELECT a.rid AS ra, b.rid AS rb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM j_each a JOIN j_each b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid),
j_links AS (SELECT ra, rb FROM j_pairs WHERE 100 * c >= 85 * (na + nb - c)),
j_reach AS (SELECT rid AS r, rid AS o FROM j_sets UNION SELECT r, rb AS o FROM j_reach JOIN j_links ON o = ra)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(t.doc_id) AS component_id FROM j_sets s JOIN j_reach ON s.rid = r JOIN j_sets t ON t.rid = o GROUP BY s.rid, s.doc_id, s.g"""
