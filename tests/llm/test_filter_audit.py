import re
from collections import Counter
from itertools import permutations

from vinterra.llm import filter_audit as A

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Rows ``(doc_id, lang, text)`` and ``(doc_id, quality, toxic)``: every order applied to every document."""
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    ids = {}
    for d, _, t in docs:
        ids.setdefault(t or "", []).append(d)
    judged = {}
    for d, lang, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(x is not None and x < d for x in ids[t]),
        }
        judged.setdefault(lang or "", []).append((d, fails))
    out = []
    for part, rows in judged.items():
        found, total = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                total[f] += len(gone)
                counts = [
                    len(stay), len(gone), sum(r[1][f] for r in rows) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                ]
                found.append((f, (part, "".join(order), step, *counts)))
                left = stay
        out += [(*row, total[f]) for f, row in found]
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_filters_that_overlap(spark):
    fine = " ".join(f"w{i}" for i in range(120))
    texts = [fine, fine + " #", "SHOUT " * 120, "short", "", fine.upper(), "a b " * 60, "ÄÖÜ " * 20 + "A$", fine + " \x1f x", None]
    rows = [(i, ("en", "fr", None, "")[i % 4], texts[i % len(texts)] if i % 3 else texts[0]) for i in range(60)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 60, 3)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (999, 1, 1)]
    got = found(A.audit_filters(docs_of(spark, rows), labels_of(spark, labels)))
    assert got == brute(rows, labels)
    assert len(got) == 3 * 600 and {k[0] for k in got} == {"en", "fr", ""}


def test_edges_of_the_limits(spark):
    distinct = lambda n, of: " ".join(f"w{i % of}" for i in range(n))
    texts = [distinct(99, 99), distinct(100, 100), distinct(100, 80), distinct(100, 79), "A" + "a" * 9, "AA" + "a" * 9, "Ä" * 9 + "A", "€|"]
    rows = [(i, "en", t) for i, t in enumerate(texts)]
    assert found(A.audit_filters(docs_of(spark, rows), labels_of(spark, [(0, 1, 0)]))) == brute(rows, [(0, 1, 0)])


def test_copies_across_parts_and_null_ids(spark):
    # a hot text in several parts, with repeated and missing ids; the smallest id is in another part
    rows = [(i // 2 + 5, "en", "hot text") for i in range(40)] + [(4, "fr", "hot text"), (4, "fr", "hot text"), (None, "en", "hot text"), (None, "en", "hot text")]
    rows += [(None, "de", "nobody"), (None, "de", "nobody"), (9, "de", "nobody"), (10, "de", "nobody")]
    labels = [(4, 1, 0), (5, 1, 1), (9, 0, 1), (10, 1, 1)]
    assert found(A.audit_filters(docs_of(spark, rows), labels_of(spark, labels))) == brute(rows, labels)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.lang, r.text) for r in odd_docs.select("doc_id", "lang", "text").collect()]
    labels = [(2, 1, 1), (7, 1, 0), (None, 1, 1)]
    assert found(A.audit_filters(odd_docs, labels_of(spark, labels))) == brute(rows, labels)


def test_empty_tables(spark, no_docs, odd_docs):
    none = labels_of(spark, [])
    assert A.audit_filters(no_docs, none).columns == list(COLUMNS) and not A.audit_filters(no_docs, none).count()
    rows = [(r.doc_id, r.lang, r.text) for r in odd_docs.select("doc_id", "lang", "text").collect()]
    assert found(A.audit_filters(odd_docs, none)) == brute(rows, [])


def test_query_matches_brute_force(spark):
    from vinterra.llm.queries import op11_filter_interactions

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    assert found(op11_filter_interactions(spark, d)) == brute(rows, labels)
