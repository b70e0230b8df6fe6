"""Sentence and word boundaries by the default rules of Unicode text segmentation (UAX #29).

A text is first written in property letters, one for each character, through a table over all code points. The rules then are a regular
language over those letters, so a compiled automaton finds all boundaries in one pass. Characters that the rules ignore behind
another (Extend, Format) are taken out of the letters before and stay with the character in front of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.arrow import lean, slices

OTHER, IGNORED = "o", "x"
#: Letters of the property values of Sentence_Break and Word_Break.
SENTENCE_LETTERS = {"CR": "C", "LF": "F", "Sep": "E", "Sp": "P", "Lower": "L", "Upper": "U", "OLetter": "T", "Numeric": "N", "ATerm": "A", "STerm": "S", "Close": "K", "SContinue": "J", "Extend": IGNORED, "Format": IGNORED}
WORD_LETTERS = {"CR": "C", "LF": "F", "Newline": "E", "ALetter": "A", "Hebrew_Letter": "H", "Numeric": "N", "Katakana": "K", "ExtendNumLet": "_", "MidLetter": "M", "MidNum": "U", "MidNumLet": "B", "Single_Quote": "Q", "Double_Quote": "D", "Regional_Indicator": "G", "WSegSpace": "W", "ZWJ": "z", "Extend": IGNORED, "Format": IGNORED}

#: Where a sentence ends: behind a paragraph separator (SB3, SB4), and behind a terminator with its closers and spaces (SB9 to SB11),
#: unless a separator or more of the terminator follows (SB8a), and for a full stop not before a digit (SB6), between a letter and an
#: upper-case one (SB7), or where a lower-case letter is the next letter (SB8).
SENTENCE_END = re.compile(
    r"CF|[CFE]"
    r"|SK*+P*+(?![JASCFE])"
    r"|(?:(?<![UL])A(?!N)|(?<=[UL])A(?![NU]))K*+P*+(?![JASCFE])(?![^TULCFEAS]*+L)"
)
#: A run of letters and digits (WB5 to WB12), or of katakana (WB13); what joins inside needs its like on both sides.
_RUN = r"(?:(?:[AHa](?:[MBQ](?=[AHa]))?|(?<=H)D(?=H)|N(?:[UBQ](?=N))?)+|K+)"
#: Runs joined by connectors (WB13a, WB13b), and a quote behind a Hebrew letter (WB7a).
_RUNS = rf"{_RUN}(?:_+{_RUN})*_*(?:(?<=H)Q)?"
#: A piece between word boundaries: a separator (WB3), spaces (WB3d; w is a space with ignored characters behind it), runs, pairs of regional
#: indicators (WB15, WB16), or any other character; and the pictographs behind a joiner (WB3c; g, or a where it is a letter too).
WORD_PIECE = re.compile(rf"(?:CF|W*w|W+|_*{_RUNS}|_+|GG?|.)(?:g|(?=a){_RUNS})*", re.S)
GLUED, GLUED_LETTER = "g", "a"


@lru_cache
def _table(name: str) -> np.ndarray:
    """A letter (its code) for each code point."""
    import regex

    letters = SENTENCE_LETTERS if name == "Sentence_Break" else WORD_LETTERS
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, ord(OTHER), np.uint8)
    patterns = {letter: regex.compile(rf"\p{{{name}={value}}}+") for value, letter in letters.items() if letter != IGNORED}
    found = [(regex.compile(rf"[\p{{{name}=Extend}}\p{{{name}=Format}}]+"), IGNORED), *[(p, letter) for letter, p in patterns.items()]]
    for pattern, letter in found:
        for m in pattern.finditer(every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            table[first : last + 1] = ord(letter)
    return table


@lru_cache
def _pictographs() -> np.ndarray:
    import regex

    found = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{Extended_Pictographic}+", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))):
        found[ord(m[0][0]) : ord(m[0][-1]) + 1] = True
    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _letters(text: str, name: str) -> np.ndarray:
    return _table(name)[_codes(text)]


def _attached(letters: np.ndarray, ignored: np.ndarray, breaks: str) -> np.ndarray:
    """Which of the ignored characters stay with the one in front: all but those at the start, or right behind a separator; the first
    of these stands for itself."""
    if not ignored.any():
        return ignored
    separator = np.isin(letters, np.frombuffer(breaks.encode(), np.uint8))
    before = np.concatenate([[True], separator[:-1]])
    return ignored & ~before


def sentence_cuts(text: str) -> list[int]:
    """Ends of the sentences of a text in code points, in order; an empty text has none."""
    if not text:
        return []
    letters = _letters(text, "Sentence_Break")
    ignored = letters == ord(IGNORED)
    gone = _attached(letters, ignored, "CFE")
    if gone.any():
        at = np.flatnonzero(~gone)
        ends = np.append(at[1:], len(text))
        cuts = ends[[m.end() - 1 for m in SENTENCE_END.finditer(letters[at].tobytes().decode("ascii"))]].tolist()
    else:
        cuts = [m.end() for m in SENTENCE_END.finditer(letters.tobytes().decode("ascii"))]
    return cuts if cuts and cuts[-1] == len(text) else [*cuts, len(text)]


def word_cuts(text: str) -> list[int]:
    """Ends of the pieces between word boundaries, in order; an empty text has none."""
    if not text:
        return []
    letters = _letters(text, "Word_Break")
    ignored = (letters == ord(IGNORED)) | (letters == ord("z"))
    if not ignored.any():
        return [m.end() for m in WORD_PIECE.finditer(letters.tobytes().decode("ascii"))]
    gone = _attached(letters, ignored, "CFE")
    glued = np.concatenate([[False], letters[:-1] == ord("z")])
    if glued.any():
        glued &= _pictographs()[_codes(text)]
    letters = np.where(ignored & ~gone, ord(OTHER), letters)
    letters = np.where(glued, np.where(letters == ord("A"), ord(GLUED_LETTER), ord(GLUED)), letters).astype(np.uint8)
    letters[(letters == ord("W")) & np.append(gone[1:], False)] = ord("w")
    at = np.flatnonzero(~gone)
    ends = np.append(at[1:], len(text))
    return ends[[m.end() - 1 for m in WORD_PIECE.finditer(letters[at].tobytes().decode("ascii"))]].tolist()


def pieces(text: str, cuts: list[int]) -> Iterator[str]:
    begin = 0
    for end in cuts:
        yield text[begin:end]
        begin = end


def segments(text: str | None) -> list[dict]:
    """The sentences that hold a letter or digit: start (code points before it), sent, and its pieces but single spaces. Words are
    sought within a sentence; the letters of a text without ignored characters are made once."""
    text = text or ""
    letters = _letters(text, "Word_Break").tobytes().decode("ascii") if text else ""
    simple = IGNORED not in letters and "z" not in letters
    found, start = [], 0
    for end in sentence_cuts(text):
        sent = text[start:end]
        if any(map(str.isalnum, sent)):
            cuts = [m.end() for m in WORD_PIECE.finditer(letters[start:end])] if simple else word_cuts(sent)
            found.append({"start": start, "sent": sent, "words": [w for w in pieces(sent, cuts) if w != " "]})
        start = end
    return found


SENTENCE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("sent", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


ARROW_SENTENCES = pa.list_(pa.struct([("start", pa.int32()), ("sent", pa.string()), ("words", pa.list_(pa.string()))]))
SLICE = 1 << 20  # bytes of text whose sentences are Python objects at once


def segment_array(texts: pa.Array) -> pa.Array:
    """segments() of each text, as Arrow; sentences are turned into Arrow a slice of SLICE bytes at a time."""
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    found = [pa.array([segments(t) for t in texts.slice(a, b - a).to_pylist()], ARROW_SENTENCES) for a, b in slices(sizes, SLICE)]
    return pa.concat_arrays(found) if found else pa.array([], ARROW_SENTENCES)


@F.arrow_udf(T.ArrayType(SENTENCE))
@lean
def unicode_sentences(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """segments() of each text, by Arrow batches; a null has none."""
    for batch in texts:
        yield segment_array(batch)
