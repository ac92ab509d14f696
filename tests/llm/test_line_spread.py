import hashlib
from collections import Counter, defaultdict

from vinterra.llm import line_spread as L

BLANK = " \t\r\x0b\x0c"


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(BLANK):
                sites[line.strip(BLANK)].add(site)
    bad = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for d, text, _ in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for x in lines if x.strip(BLANK) not in bad or not x.strip(BLANK))
        out.append((d, sum(bool(x.strip(BLANK)) for x in lines), sum(x.strip(BLANK) in bad for x in lines), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in df.collect())


def test_spread_near_the_threshold_is_exact(spark):
    # line k stands on exactly k sites; the hot line on all, a third of the rows
    rows = []
    for k in range(1, 60):
        for s in range(k):
            rows.append((len(rows), f"own {len(rows)}\nline on {k}\n {'hot line' if s % 3 == 0 else ''}", f"s{s}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for t in (2, 6, 30):
        assert found(L.remove_boilerplate(df, min_sites=t)) == brute(rows, t)


def test_kept_text_and_sketch_merge(spark):
    rows = [(i, f"menu\nabout {i}\n  menu \n", f"s{i % 8}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in L.remove_boilerplate(df).collect()}
    assert got[3].kept == "about 3\n" and (got[3].n_lines, got[3].n_removed) == (3, 2)
    lines = L.lines_of(df)
    assert L.spread(lines).selectExpr("hll_sketch_estimate(sketch) AS n").collect()[0].n == 8


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert found(L.remove_boilerplate(odd_docs, min_sites=2)) == brute(rows, 2)
    assert L.remove_boilerplate(no_docs).collect() == []
