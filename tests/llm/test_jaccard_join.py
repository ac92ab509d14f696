import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from vinterra.llm import jaccard_join as J


def brute(rows):
    """doc_id -> (class, copy_of, links) by comparing every pair of different texts."""
    far = J.NO_ID
    rep = {}
    for d, t in rows:
        rep[t or ""] = min(rep.get(t or "", far), far if d is None else d)
    texts = sorted(rep, key=lambda t: (rep[t], t))
    sets = {t: J.shingles(t.encode()) for t in texts}
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = Counter()
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= J.THRESHOLD:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    low = {}
    for t in texts:
        low[find(t)] = min(low.get(find(t), far), rep[t])
    show = lambda x: None if x == far else x
    return Counter((d, show(low[find(t or "")]), show(rep[t or ""]), links[t or ""]) for d, t in rows)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, size):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, d = [], 0
    while d < size:
        base = rnd.choices(vocabulary, k=rnd.choice([3, 5, 9, 40, 120, 300]))
        for _ in range(rnd.choice([1, 1, 1, 2, 5, 12])):
            rows.append((d, edited(rnd, base, rnd.choice([0, 0, 1, 2, 3, 6]))))
            d += 1
    rnd.shuffle(rows)
    return rows


def found(df):
    return Counter((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_links_match_all_pairs(spark, seed):
    rows = corpus(seed, 300)
    assert found(J.links(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_group_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, edited(rnd, base, rnd.choice([1, 2, 3]))) for i in range(150)]
    assert found(J.links(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_chain_of_links_is_one_class(spark):
    # neighbours are similar, ends are not: components need several rounds
    words = [f"v{i}" for i in range(400)]
    rows = [(50 - i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]
    got = J.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {21} and found(J.links(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(rows)
    assert found(J.links(odd_docs)) == want
    one = J.keep_one(odd_docs)
    assert one.columns == odd_docs.columns
    classes = {w[1] for w in want}
    kept = one.collect()
    assert len(kept) == len(brute_classes(rows)) and {r.doc_id for r in kept} <= classes | {7}
    assert J.links(no_docs).collect() == [] and J.keep_one(no_docs).collect() == []


def brute_classes(rows):
    """Texts of one representative per component."""
    texts = sorted({t or "" for _, t in rows})
    sets = [J.shingles(t.encode()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    left, right = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    return set(J.stars(len(texts), left, right))


def test_posterior_bounds():
    need = J.least_matches()
    assert need == sorted(need) and 0 < need[-1] < J.VALUES * 0.8
    # P(Binomial(n + 1, t) <= m) by simulation for a loose tolerance
    rnd = np.random.default_rng(0)
    draws = rnd.binomial(17, 0.8, 200_000)
    m = J.least_matches(16, 16, Fraction(4, 5), 0.05)[0]
    assert (draws <= m).mean() >= 0.045 and (draws <= m - 1).mean() <= 0.055


def test_pruning_keeps_true_pairs_and_drops_others():
    rnd = random.Random(2)
    signer = J.Signer()
    base = [f"v{i}" for i in range(300)]
    near = [edited(rnd, base, 2) for _ in range(20)]
    far = [edited(rnd, base, 60) for _ in range(20)]
    signed = [signer.sign(t.encode()) for t in near + far]
    sig = np.stack([s[1] for s in signed])
    bands = np.zeros((40, J.BANDS), np.int64)
    left, right = np.triu_indices(40, 1)
    a, b = J.surviving_pairs(bands, sig, 0, left, right, J.least_matches())
    pairs = set(zip(a.tolist(), b.tolist()))
    sets = [J.shingles(t.encode()) for t in near + far]
    true = {(i, j) for i, j in zip(left.tolist(), right.tolist()) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(true) > 100 and true <= pairs
    assert max(map(max, pairs)) < 20  # no pair with one of the far texts is left to verify


def test_shared_counts_by_matrix_and_by_sets():
    rnd = random.Random(3)
    sets = [{b"%d" % rnd.randrange(60) for _ in range(rnd.randrange(0, 50))} for _ in range(12)]
    left, right = np.triu_indices(12, 1)
    want = [len(sets[i] & sets[j]) for i, j in zip(left.tolist(), right.tolist())]
    assert J.shared_counts(sets, left, right).tolist() == want
    assert J.shared_counts(sets, left[:5], right[:5]).tolist() == want[:5]
