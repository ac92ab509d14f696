import math

from vinterra.llm import token_lengths as L

SF = "/root/testdata/sf0.001"


def test_lengths_and_sums_match_brute_force(spark, odd_docs):
    encode = L.encoder().encode_ordinary
    want = sorted(len(encode(r.text)) if r.text else 0 for r in odd_docs.collect())
    lengths = L.encoded_lengths(odd_docs)
    assert lengths.columns == ["doc_id", "n_tokens"]
    hist = L.histogram(lengths)
    sums = {r.n_tokens: r for r in L.suffix_sums(hist).collect()}
    assert sorted(sums) == sorted(set(want))
    for x, r in sums.items():
        assert r.n_docs == want.count(x)
        assert r.docs_at_least == sum(w >= x for w in want) and r.tokens_at_least == sum(w for w in want if w >= x)
        assert r.docs_up_to == sum(w <= x for w in want) and r.tokens_up_to == sum(w for w in want if w <= x)
        assert r.docs_cut == sum(w > x for w in want) and r.truncated_tokens == sum(min(w, x) for w in want)
    limits = [0, 1, 7, 50, 100_000]
    for r in L.at_limits(hist, limits).collect():
        x = r.context_limit
        assert (r.n_docs, r.total_tokens, r.truncated_tokens, r.docs_cut) == (len(want), sum(want), sum(min(w, x) for w in want), sum(w > x for w in want))
    got = {r.probability: r.n_tokens for r in L.quantiles(L.suffix_sums(hist), [0.25, 0.5, 1.0]).collect()}
    assert got == {p: want[math.ceil(p * len(want)) - 1] for p in (0.25, 0.5, 1.0)}


def test_parts_of_a_long_text_have_the_same_tokens():
    encode = L.encoder().encode_ordinary
    text = " ".join(f"word{chr(97 + i % 26)}  x{i}'s\n" if i % 5 else "plain words here" for i in range(3000))
    cut = list(L.parts(text, 500))
    assert len(cut) > 10 and "".join(cut) == text
    assert sum((encode(p) for p in cut), []) == encode(text)
    assert list(L.parts("x" * 1000, 100)) == ["x" * 1000]


def test_long_runs_of_white_space():
    enc = L.encoder()
    for blank in (" ", "\n", "\t ", "\u3000", "\r\n"):
        run = blank * 700
        for text in (run, run + "x", "x" + run, f"a{run}b {run}'s{run} 9", f"{run}\x1f{run}"):
            assert L.n_tokens(enc, text) == len(enc.encode_ordinary(text)), repr(text[:5])
    assert L.n_tokens(enc, "x" + "\n" * 1_000_000 + "y") > 1000
    assert L.n_tokens(enc, "a" * 300_000) == len(enc.encode_ordinary("a" * 300_000))
    assert L.n_tokens(enc, "") == 0


def test_special_token_names_are_text():
    assert len(L.encoder().encode_ordinary("<|endoftext|>")) > 1


def test_empty_table(no_docs):
    assert L.suffix_sums(L.histogram(L.encoded_lengths(no_docs))).collect() == []


def test_registered_query(spark):
    from vinterra.llm.queries import queries

    encode = L.encoder().encode_ordinary
    want = [len(encode(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries()["op7_length_histogram"](spark, SF).collect()
    assert sum(r.n_docs for r in got) == len(want)
    assert all(r.truncated_tokens == sum(min(w, r.n_tokens) for w in want) for r in got)
