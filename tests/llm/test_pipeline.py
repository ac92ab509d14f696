import math
import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vinterra.llm import jaccard_join, mixing, queries

from test_decontaminate import brute as brute_hits
from test_jaccard_join import brute as brute_links

SF = "/root/testdata/sf0.001"


def oracle(key, documents=None):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{documents if documents and t == 'documents' else f'{SF}/{t}.parquet'}')")
    out = con.execute(queries.oracles()[key])
    names = [d[0] for d in out.description]
    return [dict(zip(names, r)) for r in out.fetchall()]


@pytest.mark.parametrize("key", sorted(queries.oracles()))
def test_queries_match_their_sql(spark, key):
    got = [r.asDict() for r in queries.queries()[key](spark, SF).collect()]
    show = lambda rows: Counter(tuple(sorted(r.items())) for r in rows)
    assert show(got) == show(oracle(key)) and got


def test_every_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = []
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), "test-stage")
        steps.append(docs.collect())
    good, single, clean, mixed, placed = steps
    assert all(list(s[0].asDict()) == columns for s in steps[:4])
    assert {r.doc_id for r in good} == {r["doc_id"] for r in oracle("op2_adaptive_quality") if r["kept"]}
    links = brute_links([(r.doc_id, r.text) for r in good])
    assert Counter(r.doc_id for r in single) == Counter({c for _, c, _, _ in links})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in single], items) if not r[5]}
    assert {r.doc_id for r in clean} == want
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, clean))
    assert sorted(r.doc_id for r in placed) == sorted(want)


def test_slots_of_every_shard_follow_the_mixing_order(spark, tmp_out):
    def stored(docs, name):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs.write.option("maxRecordsPerFile", 9).parquet(f"{tmp_out}/{name}")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        return spark.read.parquet(f"{tmp_out}/{name}")

    columns = "doc_id", "text", "source"
    many = spark.read.parquet(f"{SF}/documents.parquet").select(*columns)
    many = many.unionByName(many.withColumn("doc_id", F.col("doc_id") + 100_000))
    mixed = stored(mixing.interleave(many, block_rows=2), "mixed")
    place = {r.doc_id: (r.slot, r.in_block) for r in mixing.schedule(many, block_rows=2).collect()}
    backwards = stored(mixed.orderBy(F.udf(lambda i: -place[i][0] * 2 - place[i][1], "long")("doc_id")), "backwards")
    names = [f.rsplit("/", 1)[1] for f in mixed.inputFiles()]
    assert len({n[:10] for n in names}) > 1 and any("-c001." in n for n in names)
    runs = []
    for docs in (mixed, backwards):
        shards = defaultdict(list)
        for r in P.shard(spark, docs, SF).orderBy("shard", "slot").collect():
            assert r.slot == len(shards[r.shard])
            shards[r.shard].append(r.doc_id)
        runs.append(dict(shards))
    assert sum(map(len, runs[0].values())) == many.count()
    assert all(ids == sorted(ids, key=place.get) for ids in runs[0].values())
    assert {s: ids[::-1] for s, ids in runs[1].items()} == runs[0]  # the order of stage 4 is what decides


def test_run_over_odd_rows(spark, odd_docs, no_docs, tmp_out):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        os.makedirs(f"{tmp_out}/{name}")
        docs.write.parquet(f"{tmp_out}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_out}/{name}/benchmark.parquet")
        got = P.run(spark, f"{tmp_out}/{name}").collect()
        assert len(got) == len({r.doc_id for r in got})
        assert math.isclose(len(got), 3, abs_tol=2) if name == "odd" else got == []


def test_entry_lists_the_corpus_queries():
    import __spark_entry__ as entry

    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(queries.oracles()) <= set(entry.oracle_sql())
    assert len([k for k in queries.queries() if k.startswith("op")]) == 13
    assert jaccard_join.THRESHOLD == 0.8 or float(jaccard_join.THRESHOLD) == 0.8


def test_run_leaves_its_result_alone(spark):
    from vinterra.llm import common

    other = common.written(spark.range(3), "other")
    mark = common.scratch_mark()
    got = P.run(spark, SF)
    assert got.count() > 0 and len(common._scratch) == mark + 1
    assert f"/{common._scratch[-1].rsplit('/', 1)[1]}/" in got.inputFiles()[0] and other.count() == 3
    common.drop_scratch(spark, mark)
    assert common.scratch_mark() == mark
