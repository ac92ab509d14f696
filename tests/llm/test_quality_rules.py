import re
from collections import Counter

from pyspark.sql import functions as F

from vinterra.llm import quality_rules as Q


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(tri).items() if n > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, g in enumerate(tri) if g in often for k in range(3)}),
    }


TEXTS = [
    "a b c a b c a b",
    "a b",
    "x x x x x",
    "one two three four one two three",
    "# $ % | <tag>\n& * x\n\n# $ % | <tag>\r\n# $ % | <tag>",
    "\x1cfoo bar \U0001f600 é",
    "a  b\ta\nb a b",
]


def test_counts_match_brute_force(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()] + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in Q.with_counts(df, "t").collect():
        want = brute_counts(texts[r.i])
        assert {k: r[k] for k in want} == want, texts[r.i]


def brute_bucket(v):
    k = max(v.bit_length() - Q.PRECISION, 0)
    return v >> k << k


def test_sketch_is_mergeable_and_close(spark):
    df = spark.range(4000).select(
        F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").alias("source"), F.lit(9).alias("n_words"),
        *[(F.pmod(F.xxhash64("id", F.lit(m)), F.lit(1_000_000))).alias(m) for m in Q.MARGINS],
    )
    whole = {tuple(r) for r in Q.sketch(df).collect()}
    half = F.col("symbols_ppm") % 2 == 0
    parts = Q.merge_sketches(Q.sketch(df.where(half)), Q.sketch(df.where(~half)))
    assert {tuple(r) for r in parts.collect()} == whole
    limits = {(r.lang, r.source): r for r in Q.fences(Q.sketch(df)).collect()}
    rows = df.select("source", "symbols_ppm").collect()

    def quartiles(v):
        v = sorted(v)
        q1, q3 = (brute_bucket(v[-(-k * len(v) // 4) - 1]) for k in (1, 3))
        assert q3 <= v[-(-3 * len(v) // 4) - 1] <= q3 * (1 + 2 ** (1 - Q.PRECISION))
        return q1, q3

    whole = quartiles(r[1] for r in rows)  # one language, so its quartiles are these as well
    for source in ("hot", None):
        v = [r[1] for r in rows if r[0] == source]
        q1, q3 = ((len(v) * own + Q.BACKING * wide) // (len(v) + Q.BACKING) for own, wide in zip(quartiles(v), whole))
        assert limits["en", source].symbols_ppm_high == q3 + Q.SPREAD * (q3 - q1) + Q.MARGINS["symbols_ppm"][0]


def good(i):
    return " ".join(f"w{i}x{j}" for j in range(80))


def test_thresholds_follow_the_group(spark):
    # symbols are usual in one source and rare in the other
    n = 1600
    rows = [(i, good(i) + (" | #" * 10 if i % 2 else ""), "en", "code" if i % 2 else "news") for i in range(n)]
    rows += [(n, good(n) + " | #" * 20, "en", "news"), (n + 1, good(n + 1) + " $$$$$$" * 60, "en", "code"), (n + 2, "short", "en", "news")]
    rows.append((n + 3, rows[n][1], "en", "code"))  # kept here, not there
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.verdicts(docs).collect()}
    assert not kept[n] and not kept[n + 1] and not kept[n + 2]
    assert all(kept[i] for i in range(n)) and kept[n + 3]
    assert sorted(r.doc_id for r in Q.keep_good(docs).collect()) == [*range(n), n + 3]


def test_small_groups_lean_on_the_language_and_the_corpus(spark):
    junk = " ".join(["$$$$ ####"] * 3 + [f"u{j}" for j in range(60)])
    rows = [(i, good(i), "en", "news") for i in range(200)]
    # a source of three with two bad texts; a language of its own with one of two
    rows += [(300, good(300), "en", "tiny"), (301, junk, "en", "tiny"), (302, junk + " x", "en", "tiny")]
    rows += [(310, good(310), None, None), (311, junk + " y", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.verdicts(docs).collect() if r.kept}
    assert kept == {*range(200), 300, 310}


def test_rows_failing_the_base_rules_do_not_widen_the_fences(spark):
    # most of the group repeats itself and is full of symbols; the rest is judged without it
    rows = [(i, "$$$ ### " * 60, "en", "s") for i in range(300)] + [(i, good(i), "en", "s") for i in range(300, 400)]
    rows.append((400, good(400) + " $$$$$$" * 20, "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in Q.verdicts(docs).collect() if r.kept} == set(range(300, 400))


def test_odd_rows(odd_docs, no_docs):
    got = Q.verdicts(odd_docs).collect()
    want = odd_docs.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in want)
    assert not any(r.kept for r in got if r.n_words < 50)
    kept = Q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert Q.verdicts(no_docs).collect() == [] and Q.keep_good(no_docs).collect() == []


def test_no_python_in_the_plan(odd_docs):
    plan = Q.keep_good(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
