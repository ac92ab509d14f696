from fractions import Fraction

from hypothesis import given
from hypothesis import strategies as st

from vinterra.llm import license_scan as L


def brute(text, templates=L.TEMPLATES):
    """Every unit against every template, without size bounds."""
    out = []
    for kind, unit in L.units(text) if text else ():
        a = L.bigrams(L.norm_words(unit))
        for name, t in templates:
            b = L.bigrams(L.norm_words(t))
            dice = Fraction(2 * len(a & b), len(a) + len(b)) if a else Fraction(0)
            if dice >= L.THRESHOLD:
                out.append((dice, len(b), name, kind, len(a)))
    return out


words = st.sampled_from("licensed under the mit license released apache version 2 0 cc by nc 4 foo bar".split())
texts = st.lists(st.lists(words, max_size=12).map(" ".join), max_size=5).map("\n".join)


@given(texts)
def test_size_bounds_lose_nothing(text):
    want = brute(text)
    _, _, best, kind, names = L.scan_text(L.Matcher(L.TEMPLATES), text)
    assert names == sorted({w[2] for w in want})
    if want:
        top = max((w[0], w[1]) for w in want)
        assert (Fraction(2 * best[0], best[1] + best[2]), best[2]) == top
        assert best[3] == min(w[2] for w in want if w[:2] == top)
    else:
        assert best is None and kind is None


def test_size_bounds_prune():
    m = L.Matcher(L.TEMPLATES)
    compared, found = m.compare(L.norm_words("one two three four five six seven"))
    assert 0 < compared < len(L.TEMPLATES) and found == []


def test_scan_finds_notices_in_every_kind_of_unit(spark):
    mit = dict((len(t), t) for n, t in L.TEMPLATES if n == "MIT")
    full = mit[max(mit)]
    rows = [
        (1, full.upper()),
        (2, "some words before\n\n" + full.replace(". ", ".\n") + "\n\nafter it all"),
        (3, "intro text here\nReleased under the MIT  license!\nmore text"),
        (4, "nothing about that"),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
    ]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].license, got[i].unit) for i in (1, 2, 3, 4)] == [("MIT", "text"), ("MIT", "paragraph"), ("MIT", "line"), (None, None)]
    assert got[5].licenses == "Apache-2.0,CC-BY-NC-4.0" and got[4].licenses == ""


def test_odd_rows(odd_docs, no_docs):
    got = L.scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_units == 0 and r.license is None for r in got if r.doc_id in (4, 5, 6))
    assert L.scan(no_docs).collect() == []
    assert all(r.license is None for r in L.scan(odd_docs, templates=[]).collect())
