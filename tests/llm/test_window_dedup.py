import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from vinterra.llm import window_dedup as D
from vinterra.llm.words_np import Hasher, sliding_min


def brute(rows, window):
    far = float("inf")
    docs = [(far if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, far), d)
    out = []
    for (d, w), (raw, _) in zip(docs, rows):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rnd = random.Random(seed)
    passages = [[f"p{i}x{j}" for j in range(rnd.randrange(8, 40))] for i in range(8)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            words += p[a : a + rnd.randrange(1, 40)] if rnd.random() < 0.7 else [f"u{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 30))]
        rows.append((d, "  ".join(words)))
        if rnd.random() < 0.2:
            rows.append((d + 1000, "\n".join(words)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_small_windows_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(D.remove_repeats(df, window=10, anchor=3)) == brute(rows, 10)


def test_production_window_and_kept_text(spark):
    rnd = random.Random(9)
    shared = [f"s{i}" for i in range(70)]
    rows = [(d, " ".join([f"a{rnd.random()}" for _ in range(30)] + shared + [f"b{rnd.random()}" for _ in range(20)])) for d in range(40)]
    rows.append((50, " ".join(shared[:49])))  # too short to be a window
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.remove_repeats(df)
    assert found(got) == brute(rows, 50)
    for r in got.collect():
        words = dict(rows)[r.doc_id].split()
        want = words if r.doc_id in (0, 50) else words[:30] + words[100:]
        assert bytes(r.kept).decode().split() == want
        assert [tuple(s) for s in r.spans or []] == ([] if r.doc_id in (0, 50) else [(30, 100)])


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(D.remove_repeats(odd_docs)) == brute(rows, 50)
    assert D.remove_repeats(no_docs).collect() == []


def test_hashes():
    h = Hasher()
    words, starts = h.words(np.frombuffer("ab  c\x0bab é".encode(), np.uint8))
    assert starts.tolist() == [0, 4, 6, 9] and words[0] == words[2] and len(set(words.tolist())) == 3
    assert len(h.words(np.frombuffer(b" \n", np.uint8))[0]) == 0
    seq, _ = h.words(np.frombuffer(b"x y z q x y z p x y z q", np.uint8))
    three = h.windows(seq, 3)
    assert three[0] == three[4] == three[8] and len(set(three.tolist())) == 7
    assert len(h.windows(seq, 13)) == 0 and len(h.windows(seq, 12)) == 1
    assert h.whole(seq[:4]) == h.whole(seq[8:]) != h.whole(seq[4:8])
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 7, 35, 50):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(51 - w)]


def test_intervals_merge():
    assert D.intervals(np.array([9, 1, 2, 12, 30]), 5) == [(1, 7), (9, 17), (30, 35)]
    assert D.intervals(np.array([1, 6, 12]), 5) == [(1, 11), (12, 17)]
    assert D.intervals(np.array([], np.int64), 5) == []


def test_many_texts_without_an_id_share_no_list(spark):
    # half of the rows have no id and texts of their own, all with a passage of a numbered document
    rnd = random.Random(8)
    shared = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join([f"n{i}x{j}" for j in range(20)] + shared)) for i in range(15)]
    rows += [(None, " ".join([f"o{i}x{j}" for j in range(rnd.randrange(5, 40))] + shared[rnd.randrange(8) :])) for i in range(40)]
    rows += [rows[-1], rows[-1], (3, rows[20][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(D.remove_repeats(df, window=12, anchor=4)) == brute(rows, 12)
