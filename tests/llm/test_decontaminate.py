import hashlib
import random
import re
from collections import Counter

import pytest

from vinterra.llm import decontaminate as D
from vinterra.llm.common import written

ITEMS = "item_id long, text string, items string, h long"


def norm(text):
    text = (text or "").translate(str.maketrans(D.UPPER, D.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = norm(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[p : p + n]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w = norm(t)
        hit, met = set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                found = grams.get(tuple(w[p : p + n]))
                if found:
                    hit |= set(range(p, p + n))
                    met |= found
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.collect()))


def cases(spark, seed, short):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(13, 30)))) for i in range(12)]
    if short:
        items += [(20, "V1, v2!"), (21, "v3"), (22, ""), (23, None), (None, "v4 v5 v6"), (20, "v7 v8 v9 v1"), (24, "Ünï v2")]
    docs = []
    for d in range(60):
        words = rnd.choices(vocabulary, k=rnd.randrange(0, 300))
        for _ in range(rnd.randrange(0, 3)):
            src = rnd.choice([t.split() for _, t in items if t])
            a = rnd.randrange(len(words) + 1)
            words[a:a] = src[: rnd.randrange(1, len(src) + 1)]
        docs.append((d, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words).replace("v9 ", "v9-\n")))
    return docs, items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 8_000])
def test_hits_match_brute_force(spark, monkeypatch, short, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    plans = []

    def kept(df, name):
        if name == "benchmark-slice":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(D, "written", kept)
    docs, items = cases(spark, int(short), short)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS))
    assert found(got) == brute(docs, items)
    assert (len(plans) > 2) == (limit < 10_000)
    # the documents are not shuffled, whatever the size of the benchmark
    assert all("BroadcastHashJoin" in p and "Exchange hash" not in p and "SortMergeJoin" not in p for p in plans)


def test_removal_keeps_clean_documents(spark):
    docs, items = cases(spark, 3, False)
    want = {r[0] for r in brute(docs, items) if not r[5]}
    got = D.remove_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS))
    assert {r.doc_id for r in got.collect()} == want and 0 < len(want) < len(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    items = [(1, rows[0].text), (2, None), (3, "one"), (4, "Ünïcödé \U0001f600")]
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS)
    assert found(D.contamination(odd_docs, bench)) == brute([(r.doc_id, r.text) for r in rows], items)
    clean = D.remove_contaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    bad = Counter(r[0] for r in brute([(r.doc_id, r.text) for r in rows], items).elements() if r[5])
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in rows) - bad
    none = spark.createDataFrame([], ITEMS)
    assert not any(r.contaminated for r in D.contamination(odd_docs, none).collect())
    assert D.remove_contaminated(odd_docs, none).count() == len(rows)
    assert D.contamination(no_docs, bench).collect() == [] and D.remove_contaminated(no_docs, bench).collect() == []


def test_plan_has_no_python_and_broadcasts_the_windows(spark, odd_docs):
    bench = spark.createDataFrame([(1, odd_docs.first().text, "x", 1)], ITEMS)
    plan = D.hits(odd_docs, bench, "doc_id", "text", "item_id", "text")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
