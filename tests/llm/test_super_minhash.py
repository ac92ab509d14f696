import random
from collections import Counter

import numpy as np
import pytest

from vinterra.llm import super_minhash as S
from vinterra.llm.words_np import mix


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def set_of(text):
    w = lower(text or "").encode().split()  # ASCII white space only
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute(rows):
    """Rows ``(doc_id, text)``: all pairs compared."""
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def plain_signature(elements, slots):
    """The textbook form: one element after the other, no early stop."""
    least = [0xFFFFFFFF] * slots
    for e in elements.tolist():
        state, order = np.array([e], np.uint64), list(range(slots))
        for rank in range(slots):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            x = int(state[0])
            pick = rank + ((x >> 32) * (slots - rank) >> 32)
            order[rank], order[pick] = order[pick], order[rank]
            least[order[rank]] = min(least[order[rank]], rank << 25 | x & 0x1FFFFFF)
    return least


@pytest.mark.parametrize("n", [1, 3, 79, 80, 81, 500, 2 * S.CHUNK + 5])
def test_early_stopping_changes_nothing(n):
    elements = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(77))
    assert S.super_minhash(elements).tolist() == plain_signature(elements, S.SLOTS)


def test_estimates_vary_less_than_with_independent_values():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)  # fewer elements than slots
        a, b = S.super_minhash(pool[:50]), S.super_minhash(pool[10:])
        errors.append((a == b).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / S.SLOTS
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.75 * independent


def edited(rng, words, n):
    words = list(words)
    for p in rng.sample(range(len(words)), n):
        words[p] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_all_links_near_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        for k in range(8):
            text = edited(rng, base, min(k, len(base) // 60 + 1)) if k else " ".join(base)
            rows.append((len(rows), text.upper() if k == 1 else text.replace(" ", " \n\t" if k == 2 else " ")))
    rng.shuffle(rows)
    expected = brute(rows)
    assert found(S.near_duplicates(docs_of(spark, rows))) == expected
    assert 25 < sum(n for k, n in expected.items() if k[3]) < 180


def test_chains_and_groups_over_many_blocks(spark, monkeypatch):
    # a chain in which only neighbours are linked, and a large group of edits of one text
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = random.Random(4)
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[i * 8 : i * 8 + 200])) for i in range(25)]
    base = [f"b{i}" for i in range(150)]
    rows += [(2000 + i, edited(rng, base, 1 + i % 5)) for i in range(60)] + [(5000, " ".join(base))]
    rows += [(3000 + i, " ".join(base)) for i in range(40)]
    assert found(S.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_buckets_that_span_components(spark, monkeypatch):
    # everything shares a bucket: the second verification has to find all links by itself
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, edited(rng, base, 1 + i % 7)) for i in range(40)]
    monkeypatch.setattr(S, "_partners", lambda shared: shared.select("node", shared["node"].alias("hub")).limit(0))
    assert found(S.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_held_sets_stay_bounded():
    texts = [" ".join(f"t{k}w{i}" for i in range(50)).encode() for k in range(6)]
    sets = S.HeldSets(texts, limit=100)
    assert all(sets[i] == S.shingles(texts[i]) and sets.size <= 100 for i in [0, 1, 2, 3, 4, 5, 0, 1])


def test_union_find():
    u = S.UnionFind()
    assert u.union(3, 2) and u.union(5, 3) and not u.union(2, 5)
    assert u.find(5) == 2 and u.find(9) == 9


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = found(S.near_duplicates(odd_docs))
    # a null id is kept only if its component has no id
    expected = Counter((d, n, c, (d == c) if d is not None or c is not None else True) for d, n, c, k in brute(rows).elements())
    assert got == expected


def test_short_texts_and_ids(spark):
    top = (1 << 63) - 1
    rows = [(top, "a b c"), (5, "A  b\nc"), (4, "a b"), (None, "only null ids"), (None, "only NULL ids"), (top, "alone here"), (-3, ""), (-4, None), (1, " \t")]
    got = {(r.doc_id, r.component_id, r.kept) for r in S.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(top, 5, False), (5, 5, True), (4, 4, True), (None, None, True), (top, top, True), (-3, -3, True), (-4, -4, True), (1, 1, True)}


def test_empty_table(spark, no_docs):
    out = S.near_duplicates(no_docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and not out.count()


def test_query_matches_brute_force(spark):
    from vinterra.llm.queries import op12_super_minhash

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert found(op12_super_minhash(spark, d)) == brute(rows)
