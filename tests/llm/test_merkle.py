import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vinterra.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """Rows of ``(doc_id, source, lang, n_chars, text)`` by the plain definition."""
    first = lambda x: (x is not None, x)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for lang, held in groups.items():
        held.sort(key=lambda r: (first(r[0]), leaf_of(*r)))
        trees[lang] = (held, levels_of([leaf_of(*r) for r in held]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels_of([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        held, tree = trees[lang]
        for i, r in enumerate(held):
            steps = []
            for levels, at in ((tree, i), (top, k)):
                for level in levels[:-1]:
                    steps.append([(x < at, level[x]) for x in [at ^ 1] if x < len(level)])
                    at >>= 1
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                seen = (*r[:3], r[3] + 1, r[4])
            node = leaf_of(*seen)
            for step in steps:
                node = H(node) if not step else H(step[0][1], node) if step[0][0] else H(node, step[0][1])
            root = top[-1][0]
            out.append((r[0], leaf_of(*r), tree[-1][0], root, H(*[s[0][1] for s in steps if s]), node, node == root))
    return Counter(out)


def audited(df, levels=2):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    grown = F.col("n_chars").cast("decimal(20,0)") + 1
    return M.audit(M.manifest(df, found={"n_chars": grown}, where_found=tampered, levels=levels))


def found(df):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())


def fields(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@given(st.integers(1, 200))
def test_postorder_positions_are_closed_form(n):
    leaves = [H(str(i)) for i in range(n)]
    log, tree = M.postorder(leaves, M.height_of(n)), levels_of(leaves)
    assert len(log) == sum(map(len, tree)) and log[-1] == tree[-1][0]
    for h, level in enumerate(tree):
        assert [log[p] for p in M.positions(h, np.arange(len(level), dtype=np.int64), np.int64(n))] == level


def test_an_open_block_reaches_the_height_of_its_neighbours():
    assert M.postorder(["aa"], 2) == ["aa", H("aa"), H(H("aa"))]
    assert M.postorder(["aa", "bb", "cc"], 2) == ["aa", "bb", H("aa", "bb"), "cc", H("cc"), H(H("aa", "bb"), H("cc"))]


@pytest.mark.parametrize("levels", [1, 3])
def test_many_rounds(spark, levels):
    rows = [(i, "s", "en" if i % 5 else "fr", i * 3 if i % 4 else None, f"text {i}") for i in range(70)]
    rows += [(100, "s", "x", 1, "alone"), (101, None, None, None, None), (102, "s", "", 2, "empty group")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = found(audited(df, levels))
    assert got == brute(rows)
    hit = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert {k[0] for k in got if not k[-1]} == hit and hit


def test_append_log_has_no_gaps_and_is_the_postorder(spark):
    rows = [(i, "s", "en" if i < 45 else "fr", 1, f"text {i}") for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = M.manifest(df, levels=2)
    logs = {}
    for r in M.append_log(m.groups).collect():
        logs.setdefault(r.tree, []).append((r.pos, r.digest.hex()))
    assert set(logs) == {"ven", "vfr"}
    for tree, entries in logs.items():
        leaves = [leaf_of(*r) for r in rows if "v" + r[2] == tree]
        assert [p for p, _ in sorted(entries)] == list(range(len(entries)))
        assert [d for _, d in sorted(entries)] == M.postorder(leaves, M.height_of(len(leaves)))


def test_odd_rows(spark, odd_docs):
    assert found(audited(odd_docs)) == brute(fields(odd_docs))


def test_largest_number_grows_and_null_ids_differ_by_leaf(spark):
    rows = [((1 << 63) - 1, "s", "en", (1 << 63) - 1, "a"), (None, "s", "en", 1, "b"), (None, "s", "en", 1, "a"), (-5, "s", "en", 1, "ünï")]
    rows += [(i, "s", "en", (1 << 63) - 1, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = found(audited(df))
    assert got == brute(rows) and not all(k[-1] for k in got)


def test_a_hot_row_is_repeated_without_harm(spark):
    rows = [(7, "s", "en", 3, "hot")] * 40 + [(i, "s", "en", 3, f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(audited(df)) == brute(rows)


def test_empty_table(spark, no_docs):
    out = audited(no_docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and not out.count()


def test_query_matches_brute_force(spark):
    from vinterra.llm.queries import op13_merkle_manifest

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(op13_merkle_manifest(spark, "/root/testdata/sf0.001")) == brute(fields(df))
