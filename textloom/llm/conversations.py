"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?` by the initials of its roles.

The edits of a conversation are the edges of an implicit lattice of nodes (turn index, grammar state): keep, rerole and delete advance
by a turn, insert stays. Dijkstra's search over it has the priority key (cost, audit), the audit being the edits' initials so far, and
stops at the first accepting end node that it pops; so of equal costs the audit that is least in ASCII wins. A turn matters to the
search by one symbol only (role initial, whether it must go, whether it is truncated), so equal conversations are searched once a worker.

A long conversation is searched in blocks of BLOCK turns, each from all states that the one before ended in. That is exact: of two
audits that lead to the same node at the same cost neither is the beginning of the other, so their order can't change later, and
the order of the blocks' starts is carried in a single character. Keys thus stay short, and time is linear in the turns.

Spark deals turns by conversation and sorts them; a task then streams through its conversations. Turns of the one at hand that pass
SPOOL characters go to an unnamed temporary file of the task, so memory doesn't grow with a conversation's texts. The digest of a
repaired conversation is a SHA-256 over its turns in order, so a conversation's turns are one task's work, whatever its length.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, remainder, table

BLOCK = 256
SPOOL = 8 << 20
OUT = 4 << 20
#: White space, sentence ends and the costs of edits.
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
OTHER = (2, 2, 3, 2)  # the state after a rerole or an insert: a user turn, behind a user an assistant turn
ROLE = {2: "user", 3: "assistant"}
ACCEPTING = frozenset((0, 3))
LEGAL = {"su", "ua", "au"}
MUST_GO = "-"


# -------------------------------------------------------------------------------------------------------------- search
def search(symbols: str, starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """From states with (cost, audit), through a block of symbols: (cost, audit) of each state behind it, or with `last` of the first
    accepting state popped there."""
    heap = [(cost, audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(heap)
    done, ends = set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        other = OTHER[state]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, other))
        if i == len(symbols):
            if not last:
                ends[state] = (cost, audit)
            elif state in ACCEPTING:
                return {state: (cost, audit)}
            continue
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        symbol = symbols[i]
        if symbol != MUST_GO:
            more = cost + TRUNCATED * symbol.isupper()
            heapq.heappush(heap, (more + REROLE, audit + "R", i + 1, other))
            kept = KEEP.get((state, symbol.lower()))
            if kept is not None:
                heapq.heappush(heap, (more, audit + "K", i + 1, kept))
    return ends


def cheapest(symbols: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, by blocks. An audit at a border is a character that orders what its last turn's edit
    ends, and the inserts behind that; the rest is linked, and joined at the end."""
    starts, links = {0: (0, "\0")}, [None]
    for at in range(0, max(len(symbols), 1), block):
        last = at + block >= len(symbols)
        found = search(symbols[at : at + block], starts, last)
        if last:
            ((cost, audit),) = found.values()
            pieces, link = [audit[1:]], links[ord(audit[0])]
            while link is not None:
                pieces.append(link[0])
                link = link[1]
            return cost, "".join(reversed(pieces))
        cores = sorted({audit.rstrip("I") for _, audit in found.values()})
        starts = {state: (cost, chr(cores.index(core := audit.rstrip("I"))) + "I" * (len(audit) - len(core))) for state, (cost, audit) in found.items()}
        links = [(core[1:], links[ord(core[0])]) for core in cores]
    raise AssertionError("unreachable")


_short = lru_cache(1 << 16)(cheapest)


def edits(symbols: str, audit: str) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, turn index, role) of an audit: the index is null for an insert, the role for what keeps its own or goes."""
    state, i = 0, 0
    for edit in audit:
        if edit == "I":
            state = OTHER[state]
            yield edit, None, ROLE[state]
            continue
        if edit == "R":
            state = OTHER[state]
            yield edit, i, ROLE[state]
        else:
            if edit == "K":
                state = KEEP[state, symbols[i].lower()]
            yield edit, i, None
        i += 1


# ------------------------------------------------------------------------------------------------------- conversations
class Turns:
    """(turn, role, text) of a conversation; the part beyond SPOOL characters is in an unnamed temporary file."""

    def __init__(self):
        self.held, self.size, self.file = [], 0, None

    def add(self, row: tuple) -> None:
        self.held.append(row)
        self.size += len(row[1]) + len(row[2]) + 16
        if self.size > SPOOL:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.held

    def close(self) -> None:
        if self.file:
            self.file.close()


@dataclass
class Conversation:
    """What is known of a conversation's turns so far, in their order."""

    conv_id: object
    turns: Turns
    symbols: list[str]
    seen: set[bytes]
    counts: dict[str, int]
    least: int | None = None
    most: int | None = None
    distinct: int = 0
    before: str | None = None

    @classmethod
    def of(cls, conv_id) -> Conversation:
        return cls(conv_id, Turns(), [], set(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        initial, body = role[:1], text.rstrip(WHITE)
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in LEGAL
        self.before = initial
        key = hashlib.blake2b(f"{len(role)} {role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        symbol = initial if initial in ("s", "u", "a") else "x"
        if not body:
            fault, symbol = "blank", MUST_GO
        elif key in self.seen:
            fault, symbol = "duplicate", MUST_GO
        elif body[-1] not in ENDS:
            fault, symbol = "truncated", symbol.upper()
        else:
            fault = None
        if fault:
            self.counts[fault] += 1
        self.seen.add(key)
        self.symbols.append(symbol)
        self.turns.add((turn, role, text))

    def repaired(self) -> tuple[int, str, Iterator[tuple]]:
        """Cost, audit, and (edit, turn, role before, text before, role after, text after) of each edit; what goes has no role after,
        what is inserted none before."""
        symbols = "".join(self.symbols)
        cost, audit = (_short if len(symbols) <= 64 else cheapest)(symbols)

        def rows():
            turns = iter(self.turns)
            for edit, i, role in edits(symbols, audit):
                turn, old, text = (None, None, None) if i is None else next(turns)
                if edit == "D":
                    yield edit, turn, old, text, None, None
                else:
                    yield edit, turn, old, text, role or old, text or ""

        return cost, audit, rows()


def _conversations(batches) -> Iterator[Conversation]:
    """From batches sorted by conversation and turn. A row without role and text only names its conversation."""
    now: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                    now.turns.close()
                now = Conversation.of(conv_id)
            if role is not None or text is not None:
                now.add(turn, " " if role is None else role, text or "")
    if now is not None:
        yield now
        now.turns.close()


def _packed(rows, schema: pa.Schema):
    """Rows (tuples) as record batches of about OUT characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _report(found: Conversation) -> tuple:
    cost, audit, rows = found.repaired()
    digest, first = hashlib.sha256(), True
    for _, _, _, _, role, text in rows:
        if role is not None:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    gaps = 0 if found.least is None else found.most - found.least + 1 - found.distinct
    return found.conv_id, gaps, *found.counts.values(), cost, audit, digest.hexdigest()


def _turns(found: Conversation) -> Iterator[tuple]:
    place = 0
    for edit, turn, old, text, role, new in found.repaired()[2]:
        yield found.conv_id, None if role is None else place, edit, turn, old, text, role, new
        place += role is not None


@lean
def _reports(batches, schema: pa.Schema):
    yield from _packed((_report(c) for c in _conversations(batches)), schema)


@lean
def _all_turns(batches, schema: pa.Schema):
    yield from _packed((row for c in _conversations(batches) for row in _turns(c)), schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by conversation, in order of turn (nulls first); turns of the same number by role and text, so that repeats are neighbours."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _run(rows: DataFrame, body, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(n, k) for n, k in columns]])
    return _dealt(rows).mapInArrow(partial(body, schema=_arrow(schema)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): gaps (numbers missing between the least and the largest turn,
    nulls aside), blank, duplicate and truncated (turns by their first fault), illegal (neighbours out of grammar), cost, audit, and
    repaired_sha256 of the repaired turns.

    A null conv_id is a conversation of its own, a null turn comes first, a null role is one space, a null text is empty; a row with
    neither role nor text only names its conversation, and one that has no other row is empty: zeros, no audit. A role that doesn't
    begin with s, u or a can't be kept, nor can an empty one. Turns of one number go by role and text; a repeated row is a duplicate
    of the first. Texts may be of any length, a conversation too. Other columns are dropped; an empty table gives an empty result.
    """
    return _run(rows, _reports, [*[(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", T.StringType()), ("repaired_sha256", T.StringType())])


def repair(rows: DataFrame) -> DataFrame:
    """A row for each edit of the same repair: place (from 0, in the repaired conversation; null for what is deleted), edit (K, R, D
    or I), turn, old_role and old_text (null for an insert), role and text (null for a delete). Nulls and ties as in repair_report()."""
    text = [(n, T.StringType()) for n in ("old_role", "old_text", "role", "text")]
    return _run(rows, _all_turns, [("place", T.LongType()), ("edit", T.StringType()), ("turn", T.LongType()), *text])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations (nulls: one space), damaged by crc32(`conv_id:turn`) % 20: 0 drops a row (role and
    text become null), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.concat(space("conv_id"), F.lit(":"), space("turn")).alias("key"))
    code = remainder("key", 20)
    role = F.when(code == 0, F.lit(None)).when(code == 4, "user").otherwise(F.col("role"))
    text = F.when(code == 0, F.lit(None)).when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("again")).drop("again")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))


_I = "(SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) v(a, b, ins))"
_SAME = "o.conv_id IS NOT DISTINCT FROM s.conv_id"
#: The lattice as a recursion over turns: inserts, then an edit of the turn; of the ways to a state the least by (cost, audit) goes on.
ORACLE_SQL = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32_key FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS crc32_key FROM conversations)),
tb AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT for k in range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i)),
tv AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM tb),
cd AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(crc32_key, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b: xor(t[(xor(c, b) % 256 + 1)::INT], c // 256)), 4294967295::UBIGINT) % 20 AS code FROM src, tv),
dm AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS again FROM cd WHERE code <> 0),
od AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r1 FROM dm),
ft AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(r1) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM od),
fl AS (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS dup, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS trunc FROM ft),
ct AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || r1 NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM fl GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM ct
  UNION ALL
  SELECT conv_id, i, state, k.cost, k.audit FROM (SELECT s.conv_id, s.i + 1 AS i, e.state, min({{'cost': s.cost + 5 * length(ins) + e.cost, 'audit': s.audit || ins || e.edit}}) AS k
    FROM walk s JOIN fl o ON {_SAME} AND o.i = s.i + 1 JOIN {_I} x ON x.a = s.state,
    LATERAL (SELECT x.b AS state, 2 AS cost, 'D' AS edit
      UNION ALL SELECT CASE x.b WHEN 2 THEN 3 ELSE 2 END, 1 + CASE WHEN o.trunc THEN 5 ELSE 0 END, 'R' WHERE NOT (o.blank OR o.dup)
      UNION ALL SELECT CASE o.r1 WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN o.trunc THEN 5 ELSE 0 END, 'K' WHERE NOT (o.blank OR o.dup) AND ((o.r1 = 's' AND x.b = 0) OR (o.r1 = 'u' AND x.b IN (0, 1, 3)) OR (o.r1 = 'a' AND x.b = 2))) e
    GROUP BY s.conv_id, s.i, e.state)),
best AS (SELECT s.conv_id, min({{'cost': s.cost + 5 * length(ins), 'audit': s.audit || ins}}) AS k FROM walk s JOIN ct o ON {_SAME} AND s.i = o.n JOIN {_I} x ON x.a = s.state WHERE x.b IN (0, 3) GROUP BY s.conv_id),
ed AS (SELECT conv_id, p, k.audit[p] AS e, length(replace(k.audit[1:p], 'I', '')) AS i, k.audit[1:p - 1] AS past FROM best, range(1, length(k.audit) + 1) r(p)),
rl AS (SELECT ed.*, o.role, o.text, length(replace(past, 'D', '')) AS kept FROM ed LEFT JOIN fl o ON ed.conv_id IS NOT DISTINCT FROM o.conv_id AND ed.i = o.i AND ed.e <> 'I' WHERE e <> 'D'),
nw AS (SELECT *, first_value(coalesce(left(role, 1), '') = 's' AND e = 'K') OVER (PARTITION BY conv_id ORDER BY p) AS sys FROM rl),
tx AS (SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (kept - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body FROM nw GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.k.cost, 0)::BIGINT AS cost, coalesce(b.k.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM ids s LEFT JOIN ct o ON {_SAME} LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN tx t ON t.conv_id IS NOT DISTINCT FROM s.conv_id
"""
