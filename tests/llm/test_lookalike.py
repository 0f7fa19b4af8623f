from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrand.llm import lookalike as L

form = L.Transducer(L.compiled())


@pytest.mark.parametrize(
    ("a", "b"),
    [("ｶﾞ", "ガ"), ("ＡＢＣ１", "ABC1"), ("é", "é"), ("한글", unicodedata.normalize("NFD", "한글")), ("a​b", "ab"), ("a­b﻿", "ab"), ("a b", "a b"), ("a　b", "a b"),
     ("ﬁeld", "field"), ("сору", "copy"), ("Βоx", "Box"), ("ϲopy", "copy"), ("Ångström", "Ångström"), ("e​́", "é"), ("ậ", "ậ"), ("x️", "x")],
)
def test_look_the_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("a b", "ab"), ("O", "0"), ("l", "1"), ("I", "l"), ("З", "3"), ("ñ", "n"), ("а", "А"), ("-", "_")])
def test_stay_apart(a, b):
    assert form(a) != form(b)


def test_defined_results():
    assert form(None) is None and form("") == "" and form("​﻿") == "" and len(form("ё" * 200_000)) == 200_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_idempotent(text):
    assert form(form(text)) == form(text)


def test_conflicts_are_refused(monkeypatch):
    for rows in ((("ab", "хх"),), (("a", "x"),), (("ф", "а"),)):
        monkeypatch.setattr(L, "LOOKALIKES", rows)
        L.letters.cache_clear()
        with pytest.raises(L.Conflict):
            L.letters()
    monkeypatch.undo()
    L.letters.cache_clear()


def test_the_published_list(spark):
    """Letters of further scripts, as far as case, accents, digits and letters of one script stay apart."""
    more = L.published(spark)
    wide = L.Transducer(L.compiled(more))
    assert len(more) > 150
    for other, latin in zip("ᎪᎢꓮⲟⲣⵔꓐꓑⲤ", "ATAopOBPC", strict=True):
        assert wide(other) == latin, other
    for a, b in (("ɑ", "a"), ("ɡ", "g"), ("ı", "i"), ("ا", "l"), ("σ", "o"), ("Ь", "b"), ("٥", "o"), ("ه", "ہ"), ("১", "9")):
        assert wide(a) != wide(b), (a, b)
    for text in ("ⲟ́", "Ꭺ​́"):
        assert wide(text) == wide(wide(text))


def test_a_wrong_list_is_refused():
    for more in ({"Ꭺ": "a"}, {"Ꭺ": "4"}, {"é": "e", "e": "é"}):
        with pytest.raises(L.Conflict):
            L.compiled(more)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("eaｅＡе\u0301\u0323\u0327\u200b\u00ad\ufeffｶﾞ가각ﾡￂㄱㅏ\u3099ﬁ \u00a0Åक़\u093c\u0dd9\u0dcf\u1161"), max_size=12))
def test_one_pass_gives_composed_text(text):
    whole = "".join(L._target(c, L.letters()) for c in text)
    assert form(text) == unicodedata.normalize("NFC", whole)
    assert form(form(text)) == form(text)


def test_pairs_and_classes(spark):
    rows = [("f", "copy"), ("f", "сору"), ("f", "ｃopy"), ("f", "Copy"), ("f", "copy"), ("g", "copy"), (None, "copy"), ("f", None), ("f", "x y"), ("f", "x y"), ("f", "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "folder string, path string, form int")
    pairs = sorted(map(tuple, L.lookalike_pairs(df).collect()))
    trio = sorted(["copy", "сору", "ｃopy"], key=lambda p: p.encode())
    assert pairs == sorted([("f", trio[0], trio[1]), ("f", trio[0], trio[2]), ("f", trio[1], trio[2]), ("f", "x y", "x y")])
    links = {(r["folder"], r["path"]): r["n_links"] for r in L.lookalike_classes(df).collect()}
    assert links[("f", "copy")] == 2 and links[("g", "copy")] == 0 and links[("f", "")] == 0
    assert L.lookalike_pairs(df.limit(0)).count() == 0
