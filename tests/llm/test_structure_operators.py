"""Conversation repair, Merkle fingerprints and fill-in-middle, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import conversations, fill_middle, fingerprints
from textloom.llm.common import table

CLASH = ("n", "k", "t", "k0", "c0", "key", "at", "copy", "text2", "form", "output", "place", "audit", "fingerprint")


def clashing(rows):
    return rows.withColumns({c: F.lit("z") for c in CLASH})


# ----------------------------------------------------------------------------------------------------- conversations
def every_repair(symbols, at=0, state=0, cost=0, audit="", inserted=0):
    """All (cost, audit) of edits that end well, with at most three inserts in a row."""
    if at == len(symbols) and state in (0, 3):
        yield cost, audit
    other = 3 if state == 2 else 2
    if inserted < 3:
        yield from every_repair(symbols, at, other, cost + 5, audit + "I", inserted + 1)
    if at < len(symbols):
        s, more = symbols[at], 5 if symbols[at].isupper() else 0
        yield from every_repair(symbols, at + 1, state, cost + 2, audit + "D")
        if s != "-":
            yield from every_repair(symbols, at + 1, other, cost + 1 + more, audit + "R")
            kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((s.lower(), state))
            if kept is not None:
                yield from every_repair(symbols, at + 1, kept, cost + more, audit + "K")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="suaxSUAX-", max_size=4))
def test_search_finds_the_least_of_all_repairs(symbols):
    assert conversations.cheapest(symbols) == min(every_repair(symbols))


def test_blocks_change_nothing():
    rng = random.Random(3)
    for _ in range(500):
        symbols = "".join(rng.choice("suaxSUAX-uauaUA") for _ in range(rng.randrange(40)))
        whole = conversations.cheapest(symbols)
        assert all(conversations.cheapest(symbols, b) == whole for b in (1, 2, 3, 7, 16))


def brute_report(rows):
    """rows: (turn, role, text) of a conversation after damage, in order."""
    counts, seen, symbols = Counter(), set(), ""
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not body:
            counts["blank"] += 1
            symbol = "-"
        elif (role, text) in seen:
            counts["duplicate"] += 1
            symbol = "-"
        elif body[-1] not in ".!?":
            counts["truncated"] += 1
            symbol = symbol.upper()
        seen.add((role, text))
        symbols += symbol
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = conversations.cheapest(symbols)
    turns = [t for t, _, _ in rows if t is not None]
    left, out, want = list(rows), [], ""
    for edit in audit:
        turn = left.pop(0) if edit != "I" else None
        if edit != "D":
            role = turn[1] if edit == "K" else ("assistant" if want == "u" else "user")
            want = role[:1]
            out.append(f"{role}:{turn[2] if turn else ''}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_damage(rows):
    for conv, turn, role, text in rows:
        conv_id, role, text = (" " if v is None else v for v in (conv, role, text))
        code = zlib.crc32(f"{conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        for _ in range({0: 0, 3: 2}.get(code, 1)):
            yield conv, turn, "user" if code == 4 else role, text


def by_conversation(rows, ids):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    return {i: brute_report([r[1:] for r in sorted((r for r in rows if r[0] == i), key=order)]) for i in ids}


def test_reports_like_brute_force(spark, data):
    rows = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, data).collect()}
    assert got == by_conversation(list(brute_damage(rows)), {r[0] for r in rows})


ODD = [
    (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, None, None), (1, None, "user", None), (1, None, "", "no role."), (1, 4, "tool", "x" * 200_000), (1, 4, "assistant", "tie."), (1, 4, "assistant", "tie."),
    (2, 7, None, "Null role!"), (2, -3, "system", "  \n "), (2, -3, "system", "Be kind."), (3, 1, "user", "Étè 漢字?"), (3, 2, "assistant", "."), (3, 3, "User", "Upper."), (4, 5, "assistant", "alone"),
]


def test_repair_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPOOL", 50)
    rows = clashing(spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").where("conv_id is not null or turn is not null"))
    plain = [(c, t, " " if r is None else r, x or "") for c, t, r, x in ODD if (r, x) != (None, None)]
    want = by_conversation(plain, {r[0] for r in ODD})
    assert {r[0]: tuple(r)[1:] for r in conversations.repair_report(rows).collect()} == want
    both = conversations.damage(rows)
    assert {r[0]: tuple(r)[1:] for r in conversations.repair_report(both).collect()} == by_conversation(list(brute_damage([o for o in ODD if (o[0], o[1]) != (None, None)])), {r[0] for r in ODD})
    gone = spark.createDataFrame([(9, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert tuple(conversations.repair_report(gone).first()) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_report(rows.limit(0)).count() == 0


def test_repaired_turns_make_the_digest(spark, data):
    rows = conversations.damage(table(spark, data, "conversations"))
    report = {r["conv_id"]: r for r in conversations.repair_report(rows).collect()}
    turns = conversations.repair(rows).collect()
    for conv, r in report.items():
        own = sorted((t for t in turns if t["conv_id"] == conv and t["place"] is not None), key=lambda t: t["place"])
        assert [t["place"] for t in own] == list(range(len(own)))
        roles = "".join(t["role"][0] for t in own)
        assert roles == "" or roles.removeprefix("s").replace("ua", "") == "" != roles.removeprefix("s")
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in own).encode()).hexdigest() == r["repaired_sha256"]
        assert Counter(t["edit"] for t in turns if t["conv_id"] == conv) == Counter(r["audit"])


# ------------------------------------------------------------------------------------------------------ fingerprints
def leaves(text):
    return [piece for p in fingerprints.PARAGRAPH.findall(text) for piece in fingerprints.PIECE.findall(p)]


PROSE = st.text(alphabet="ab .!\n#é漢", max_size=120)


@settings(max_examples=200, deadline=None)
@given(PROSE, PROSE)
def test_trees_keep_every_character_and_tell_texts_apart(a, b):
    assert "".join(leaves(a)) == a
    x, y = map(fingerprints.fingerprint, (a, b))
    assert (x == y) == (a == b) and fingerprints.length(x) == len(a)
    shared = sum(len(p) * n for p, n in (Counter(leaves(a)) & Counter(leaves(b))).items())
    assert fingerprints.common(x, y) == shared == fingerprints.common(y, x)
    if a != b:
        assert fingerprints.likeness(x, y) == pytest.approx(2 * shared / (len(a) + len(b)), abs=2e-6)


def test_differences_are_where_an_edit_was_made():
    rng = random.Random(5)
    text = "".join(" ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 12))) + rng.choice((". ", "!\n", ".\n\n")) for _ in range(300))
    at = len(text) // 3
    edited = text[:at] + "INSERTED" + text[at:]
    spans = fingerprints.differences(fingerprints.fingerprint(edited), fingerprints.fingerprint(text))
    assert len(spans) == 1 and spans[0][0] <= at <= at + 8 <= sum(spans[0]) and spans[0][1] < 600
    assert fingerprints.likeness(fingerprints.fingerprint(edited), fingerprints.fingerprint(text)) > 0.95
    whole = fingerprints.fingerprint(text)
    assert fingerprints.differences(whole, whole) == [] and fingerprints.differences(whole, fingerprints.EMPTY) == [(0, len(text))]


@settings(max_examples=100, deadline=None)
@given(PROSE, PROSE)
def test_what_is_outside_the_differences_is_in_both(a, b):
    spans = fingerprints.differences(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    gone = {i for s, n in spans for i in range(s, s + n)}
    assert len(a) - len(gone) == fingerprints.common(*map(fingerprints.fingerprint, (a, b))) or a == b


ROWS = [(5, "Five. Is here!\nAnd more."), (None, "no id."), (1, None), (2, ""), (2, "Two."), (2, "Two."), (9, "word " * 60_000), (7, "x" * 5000), (8, "x" * 5000), (3, "é漢. " * 50), (10, "Five. Is here!\nAnd more.")]


def brute_next(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        dice = lambda a, b: 1.0 if a == b else min(2 * sum(len(p) * n for p, n in (Counter(leaves(a)) & Counter(leaves(b))).items()) / max(len(a) + len(b), 1), 0.999999)
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(edited), dice(t, edited), dice(t, u)


def sort_key(r):
    return [(v is not None, v or 0) if not isinstance(v, str) else v for v in r]


@pytest.mark.parametrize("ranges", [1, 4, 64])
@pytest.mark.parametrize("count", [1, 2, len(ROWS)])
def test_next_documents_like_brute_force(spark, monkeypatch, ranges, count):
    monkeypatch.setattr(fingerprints, "MOST_RANGES", ranges)
    rows = clashing(spark.createDataFrame(ROWS[:count], "doc_id long, text string").repartition(3))
    got = sorted((tuple(r) for r in fingerprints.with_next(rows).collect()), key=sort_key)
    assert got == sorted(brute_next(ROWS[:count]), key=sort_key)


def test_many_ranges_have_all_rows_once(spark):
    rows = [(i * i % 4001, f"Text {i}. " * (i % 7)) for i in range(2500)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_next(rows))
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_of_odd_rows_and_comparison(spark):
    rows = clashing(spark.createDataFrame(ROWS, "doc_id long, text string"))
    got = fingerprints.fingerprints(rows, ["doc_id", "c0"]).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["fingerprint"], r["c0"]) for r in got) == sorted((i or -1, len(t or ""), fingerprints.fingerprint(t or ""), "z") for i, t in ROWS)
    assert fingerprints.fingerprints(rows.limit(0), ["doc_id"]).count() == 0
    a, b = fingerprints.fingerprint("One. Two. Three."), fingerprints.fingerprint("One. 2. Three.")
    pairs = spark.createDataFrame([(a, b), (a, a), (None, a), (None, None)], "a string, b string")
    found = [r["c"] for r in pairs.select(fingerprints.compare("a", "b").alias("c")).collect()]
    assert [[(d["start"], d["length"]) for d in c["differences"]] for c in found] == [[(5, 5)], [], [], []]
    assert found[0]["likeness"] == pytest.approx(2 * 11 / 30) and [c["likeness"] for c in found[1:]] == [1.0, 0.0, 1.0]


# -------------------------------------------------------------------------------------------------------- fill middle
def depth_is_balanced(node):
    return node.text is not None or (abs(node.left.height - node.right.height) <= 1 and depth_is_balanced(node.left) and depth_is_balanced(node.right))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n<é漢𝄞", max_size=200), st.data(), st.sampled_from((fill_middle.CODE_POINT, fill_middle.WORD, fill_middle.LINE)))
def test_ropes_split_and_join_like_strings(text, data, unit):
    whole = fill_middle.rope(text, unit, 4)
    assert str(whole) == text and whole.chars == len(text) and depth_is_balanced(whole)
    if unit == fill_middle.LINE:
        assert whole.units == len(text.splitlines()) or not text or any(c in text for c in "\x0b\x0c")
    rank = data.draw(st.integers(0, whole.units))
    a, b = fill_middle.split_units(whole, rank, unit)
    assert (a.units, b.units) == (rank, whole.units - rank) and str(a) + str(b) == text and depth_is_balanced(a) and depth_is_balanced(b)
    swapped = fill_middle.concat(b, a)
    assert str(swapped) == str(b) + str(a) and depth_is_balanced(swapped) and swapped.units == whole.units
    if unit == fill_middle.CODE_POINT:
        assert str(a) == text[:rank] and [str(x) for x in fill_middle.split_chars(swapped, rank)] == [str(swapped)[:rank], str(swapped)[rank:]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<PSM>ab é", max_size=60), st.data(), st.sampled_from(("psm", "spm")), st.sampled_from((fill_middle.CODE_POINT, fill_middle.WORD)))
def test_inverse_gives_the_text_back(text, data, form, unit):
    if any(s in text for s in fill_middle.SENTINELS):
        return
    whole = fill_middle.rope(text, unit, 8)
    first, second = sorted((data.draw(st.integers(0, whole.units)), data.draw(st.integers(0, whole.units))))
    out, prefix, middle = fill_middle.rearrange(whole, first, second, form, unit)
    if unit == fill_middle.CODE_POINT:
        p, m, s = text[:first], text[first:second], text[second:]
        assert (str(prefix), str(middle)) == (p, m)
        assert str(out) == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fill_middle.invert(str(out), form) == text


def test_fill_middle_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "has <S> in it"), (None, "no id " * 40), (4, "é漢𝄞" * 100_000), (4, "é漢𝄞" * 100_000), *[(i, "plain text here") for i in range(10, 400)]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    made = fill_middle.fill_middle(docs, ["doc_id", "n", "text"])
    assert made.columns == ["doc_id", "n", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = fill_middle.restore(fill_middle.fill_middle(docs, ["doc_id", "text"])).collect()
    assert len(back) == len(rows) and all(r["restored"] == (r["text"] or "") for r in back)
    forms = Counter(r["form"] for r in back if r["doc_id"] and r["doc_id"] >= 10)
    assert forms["plain"] / 390 == pytest.approx(0.1, abs=0.06) and forms["spm"] / (390 - forms["plain"]) == pytest.approx(0.2, abs=0.08)
    assert {r["form"] for r in back if r["doc_id"] in (1, 2, 3)} == {"plain"} and len({r["output"] for r in back if r["doc_id"] == 4}) == 1
    for r in back:
        x = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h, t = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)], r["text"] or ""
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        if r["form"] != "plain":
            assert (r["n"], r["prefix_chars"], r["middle_chars"]) == (len(t), a, b - a)
    assert fill_middle.fill_middle(docs.limit(0), ["doc_id"]).count() == 0
    words = fill_middle.restore(fill_middle.fill_middle(docs, ["text"], rate=100, unit=fill_middle.WORD)).collect()
    assert all(r["restored"] == (r["text"] or "") for r in words) and math.isclose(sum(r["n"] == 3 for r in words), 390, abs_tol=1)


def test_inverse_refuses_what_has_no_sentinels(spark):
    with pytest.raises(ValueError):
        fill_middle.invert("<P>a<M>b", "psm")
