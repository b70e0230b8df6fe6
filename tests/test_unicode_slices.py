"""How much of a batch is Python objects at once."""

import pyarrow as pa

from textloom.functions import unicode


def test_sentences_of_few_texts_are_objects_at_once(monkeypatch):
    texts = ["One. Two words here!", None, "", "x" * 50, "Ünï cødé. 3.5 is one?"] * 40
    held, most = [], []
    real = unicode.segments
    monkeypatch.setattr(unicode, "SLICE", 200)
    monkeypatch.setattr(unicode, "segments", lambda t: held.append(len((t or "").encode())) or real(t))
    array = pa.array
    monkeypatch.setattr(unicode.pa, "array", lambda *a: most.append(sum(held)) or held.clear() or array(*a))
    got = unicode.segment_array(array(texts))
    monkeypatch.undo()
    assert got.to_pylist() == [unicode.segments(t) for t in texts] and max(most) <= 200 and len(most) > 10
    assert unicode.segment_array(pa.array([], pa.string())).to_pylist() == []
