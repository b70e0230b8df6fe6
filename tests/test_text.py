import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text, unicode
from textloom.operators import corpus

LINES = "*{{cite journal|last=A|pages=101–120 |ref=harv}}\n* {{cite book |last=B}}\n* {{cite book |publisher=[[C]]|ref=harv}}"
#: Inputs and what markup removal leaves of them.
GOLDEN = [
    (LINES, "\n\n"),  # each line goes, the line feeds between them stay
    ("abcd; efg\n", "abcd; efg\n"),
    ("\n; abcdefg\n", "\n"),
    ("\n  ; abcdefg\n", "\n"),
    ("\n     ** this is an item\n", "\n"),
    ("\n     ; this is an item\n", "\n"),
    ("\n** this is an item\n", "\n"),
    ("\n## this is an item\n", "\n"),
    ("ab[[cd|ef]]hi", "abefhi"),
    ("ab[[cd]]hi", "abcdhi"),
    ("ab[[#cd|ef]]hi", "abefhi"),
    ("ab[[cd|ef]]hi[[#jkl]]mn[[o|pq]]rs", "abefhijklmnpqrs"),
    ("ab[[File:cd|ef]]hi", "abhi"),
    ("ab[[:File:cd|ef]]hi", "abhi"),
    ("ab[[Media:cd|ef]]hi", "abhi"),
    ("ab[[:Media:cd|ef]]hi", "abhi"),
    ("{{abc}}efg{{hij}}", "efg"),
    ("{|abc|ijk|}efg{|hij|}", "efg"),
    ("= abcd =", ""),
    ("=== abcd ===", ""),
    ("==== abcd ====", ""),
    ("===== abcd =====", ""),
    ("--------\n", "\n"),
    ("&lt;!--abc--&gt;def<!--hij-->", "def"),
    ("&quot;abc&quot;", "abc"),
    ("<foo>abcde fghi</foo>", ""),
    ('<small font-size="12">abcde fghi</small>', "abcde fghi"),
    ('<big font-size="12">abcde fghi</big>', "abcde fghi"),
    ('<blockquote font-size="12">abcde fghi</blockquote>', "abcde fghi"),
    ('<poem font-size="12">abcde fghi</poem>', "abcde fghi"),
    ('<big>foo <small font-size="12">bar</small> baz</big>', "foo bar baz"),
    ("<nowiki/>", ""),
    ("<nowiki />", ""),
    ("ab[[File:x]] keep [[y]] z", "ab z"),
    ("a = b = c", "a  c"),
    ("x < y and <br/> z", "x  z"),
]


def test_strip_markup(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", text.strip_markup(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [b for _, b in GOLDEN]


def test_preprocessors(spark):
    row = spark.createDataFrame([("''a''",)], "t string").select(text.preprocess(F.col("t"), "wikitext::strip_markup"), text.preprocess(F.col("t"), "unknown"), text.preprocess(F.col("t"), None)).first()
    assert tuple(row) == ("a", "''a''", "''a''")


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("One two. Three!\nFour, five?  ...", [["One", "two"], ["Three"], ["Four", ",", "five"]]),  # marks before white space are the break and drop out
        ("a.b c!d\te?", [["a", ".", "b", "c", "!", "d", "e", "?"]]),  # without white space behind it a mark is a token
        ("a?! b...\tc", [["a"], ["b"], ["c"]]),
        ("a\n\n\nb\f c", [["a"], ["b", "c"]]),  # line feeds break alone, other white space does not
        (None, []),
        ("", []),
        ("--- !!!", []),
        ("État 12é.", [["État", "12é", "."]]),
    ],
)
def test_portable_profile(spark, body, expected):
    row = spark.createDataFrame([(body,)], "t string").select(F.transform(text.sentences(F.col("t")), text.words)).first()
    assert row[0] == expected


# ------------------------------------------------------------------------------------------------------- Unicode profile
def joined_sentences(kinds, at):
    """The sentence rules, one by one, for a place `at` between two characters: is it inside a sentence?"""
    left, right = kinds[:at], kinds[at]
    if left[-1] == "C" and right == "F":
        return True
    if left[-1] in "CFE":
        return False
    if right == "x":
        return True
    base = [k for i, k in enumerate(left) if k != "x" or i == 0 or all(x == "x" for x in left[max(j for j in range(i + 1) if j == 0 or left[j - 1] in "CFE") : i + 1])]
    rest = [k for k in kinds[at:] if k != "x"]
    word = "".join(base)
    if word.endswith("A") and rest[0] == "N":
        return True
    if re.search("[UL]A$", word) and rest[0] == "U":
        return True
    if re.search("AK*P*$", word) and re.match("[^TULCFEAS]*L", "".join(rest)):
        return True
    if re.search("[AS]K*P*$", word) and rest[0] in "JAS":
        return True
    if re.search("[AS]K*$", word) and rest[0] in "KPCFE":
        return True
    if re.search("[AS]K*P*$", word) and rest[0] in "PCFE":
        return True
    return not re.search("[AS]K*P*$", word)


def joined_words(kinds, pictures, at):
    """The word rules, one by one."""
    a, b = kinds[at - 1], kinds[at]
    if (a, b) == ("C", "F"):
        return True
    if a in "CFE" or b in "CFE":
        return False
    if (a == "z" and pictures[at]) or a + b == "WW" or b in "xz":
        return True
    left = []
    for i, k in enumerate(kinds[:at]):
        if k not in "xz" or i == 0 or kinds[i - 1] in "CFE":
            left.append("o" if k in "xz" else k)
    right = [k for i, k in enumerate(kinds[at:]) if i == 0 or k not in "xz" or kinds[at + i - 1] in "CFE"] + ["", ""]
    l2, l1, r1, r2 = ([""] + left)[-2], left[-1], right[0], right[1]
    letter = ("A", "H")
    return bool(
        (l1 in letter and r1 in letter)
        or (l1 in letter and r1 in ("M", "B", "Q") and r2 in letter)
        or (l2 in letter and l1 in ("M", "B", "Q") and r1 in letter)
        or (l1 == "H" and (r1 == "Q" or (r1 == "D" and r2 == "H")))
        or (l2 == "H" and l1 == "D" and r1 == "H")
        or (l1 in (*letter, "N") and r1 in (*letter, "N"))
        or (l2 == "N" and l1 in ("U", "B", "Q") and r1 == "N")
        or (l1 == "N" and r1 in ("U", "B", "Q") and r2 == "N")
        or (l1 == r1 == "K")
        or (l1 in (*letter, "N", "K", "_") and r1 == "_")
        or (l1 == "_" and r1 in (*letter, "N", "K"))
        or (l1 == r1 == "G" and (len(left) - len("".join(left).rstrip("G"))) % 2 == 1)
    )


@example('3\u200d😀3')
@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab.CD!?3,;: _\"')(\n\r\t\u2028א׳ア\u0301\u200d😀ℹ🇫🇷-é\xad漢。·‘’", max_size=14))
def test_boundaries_follow_each_rule(t):
    for name, cuts in (("Sentence_Break", unicode.sentence_cuts(t)), ("Word_Break", unicode.word_cuts(t))):
        kinds = [chr(k) for k in unicode._letters(t, name)]
        pictures = [c in "😀ℹ" for c in t]
        inside = [joined_sentences(kinds, i) if name == "Sentence_Break" else joined_words(kinds, pictures, i) for i in range(1, len(t))]
        assert cuts == [i for i in range(1, len(t)) if not inside[i - 1]] + ([len(t)] if t else [])


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("Dr. Who left. Then came 3.5 m. of it.", ["Dr. ", "Who left. ", "Then came 3.5 m. of it."]),  # a lower-case letter behind goes on, a digit as well
        ("He said: “No.” (Why?) Yes", ["He said: “No.” ", "(Why?) ", "Yes"]),  # closers and spaces stay with the mark
        ("The U.S.A. won. X.Y", ["The U.S.A. won. ", "X.Y"]),  # a stop between letters and an upper-case one doesn't end
        ("One?! Two... three. ... Four", ["One?! ", "Two... three. ... ", "Four"]),
        ("a. , b! - c", ["a. , b! - c"]),  # a comma or dash goes on
        ("a.\r\nb\u2029c", ["a.\r\n", "b\u2029", "c"]),
        ("次。文", ["次。", "文"]),
        ("E.\u0301 F", ["E.\u0301 ", "F"]),  # a mark on the stop doesn't hide it
        ("", []),
    ],
)
def test_sentences_by_hand(body, expected):
    assert list(unicode.pieces(body, unicode.sentence_cuts(body))) == expected


def test_words_by_hand():
    cut = lambda t: list(unicode.pieces(t, unicode.word_cuts(t)))
    assert cut("It's 3,000.5 a_b1; can't-do") == ["It's", " ", "3,000.5", " ", "a_b1", ";", " ", "can't", "-", "do"]
    assert cut("a  b\t\r\n") == ["a", "  ", "b", "\t", "\r\n"]
    assert cut("3\u200d😀3\u200dℹa") == ["3\u200d😀", "3\u200dℹa"]
    assert cut("👩\u200d🔬🇫🇷🇩 ア_ア") == ["👩\u200d🔬", "🇫🇷", "🇩", " ", "ア_ア"]


def test_unicode_profile(spark):
    docs = spark.createDataFrame([(1, "It's  fine. Go\tthere! ..."), (2, None), (3, "..."), (4, "a" * 300_000 + ". B")], "doc_id long, text string")
    rows = corpus.sentences(docs, profile="unicode").orderBy("doc_id", "spos").collect()
    assert [(r["doc_id"], r["spos"], r["start"], r["words"]) for r in rows[:2]] == [(1, 0, 0, ["It's", "  ", "fine", "."]), (1, 1, 12, ["Go", "\t", "there", "!", ".", ".", "."])]
    assert [(r["doc_id"], r["start"]) for r in rows[2:]] == [(4, 0), (4, 300_002)] and len(rows[2]["sent"]) == 300_002
