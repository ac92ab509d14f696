import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vinterra.llm import resharding as R


def moved_at_best(supply, capacity):
    """Fewest bytes moved when byte i of an old shard may stay only in the new shard of its number."""
    stay = sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))
    return sum(supply) - stay


@pytest.mark.parametrize("seed", range(8))
def test_flow_ships_everything_at_least_cost(seed):
    rnd = random.Random(seed)
    supply = [rnd.randrange(0, 400) for _ in range(rnd.randrange(1, 7))]
    n_new = rnd.randrange(1, 8)
    capacity = R.equal_capacities(sum(supply), n_new)
    flow = R.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == supply
    assert [sum(c) for c in zip(*flow)] == capacity
    assert sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j) == moved_at_best(supply, capacity)


def test_flow_with_other_prices_matches_brute_force():
    supply, capacity = [2, 3], [2, 2, 1]
    price = [[4, 1, 3], [2, 5, 1]]
    flow = R.min_cost_flow(supply, capacity, lambda i, j: price[i][j])
    cost = sum(f * price[i][j] for i, r in enumerate(flow) for j, f in enumerate(r))
    units = [0, 0, 1, 1, 1]
    seats = [j for j, c in enumerate(capacity) for _ in range(c)]
    assert cost == min(sum(price[u][s] for u, s in zip(units, p)) for p in itertools.permutations(seats))
    with pytest.raises(ValueError):
        R.min_cost_flow([3], [2], lambda i, j: 0)


def test_blocks_fill_capacities():
    rnd = random.Random(1)
    blocks = [(o, b, rnd.randrange(50, 150)) for o in range(3) for b in range(200 if o else 900)]
    to = R.plan_transfers(blocks, 5)
    size = Counter()
    for o, b, s in blocks:
        size[to[o, b]] += s
    assert max(size.values()) - min(size.values()) <= 150
    supply = [sum(s for o, _, s in blocks if o == i) for i in range(3)]
    moved = sum(s for o, b, s in blocks if to[o, b] != o)
    best = moved_at_best(supply, R.equal_capacities(sum(supply), 5))
    assert best - 300 <= moved <= best + 5 * 150


def test_layout_of_odd_rows(spark, odd_docs):
    layout = R.reshard(odd_docs, F.xxhash64("source"), 3, 4)
    got = R.layout_digest(layout).collect()
    want = Counter()
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        want[r.doc_id, len(raw) + 1, zlib.crc32(raw)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(0 <= r.shard < 4 and r.law == "bytes" and r.grown_shard is None for r in got)
    assert layout.select("doc.*").columns == odd_docs.columns


def test_shards_without_a_transfer_keep_their_files(spark, tmp_out):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('x', 9) AS text", "cast(id % 4 AS int) AS home")
    layout = R.reshard(docs, F.col("home"), 4, 4, path=tmp_out + "/shards", capacity=[100, 100, 110, 90])
    got = R.layout_digest(layout).collect()
    assert len(got) == 40 and sum(r.moved for r in got) == 1
    written = {r.shard for r in spark.read.parquet(tmp_out + "/shards").select("shard").distinct().collect()}
    assert written == {2, 3}


def test_file_groups_are_as_many_as_the_bytes_ask_for(spark, tmp_out):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id % 1000, repeat('x', 40)) AS text", "id % 2 AS source")
    # two blocks per old shard, and far more files than blocks
    layout = R.reshard(docs, F.xxhash64("source"), 2, 3, path=tmp_out + "/shards", blocks_per_shard=2, file_bytes=2000)
    got = R.layout_digest(layout).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = R.layout_digest(R.reshard(docs, F.xxhash64("source"), 2, 3, blocks_per_shard=2, file_bytes=2000)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_table(no_docs):
    assert R.layout_digest(R.reshard(no_docs, F.xxhash64("source"), 3, 4)).collect() == []


def test_registered_query(spark):
    from vinterra.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    got = queries()["op6_flow_resharding"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert set(size) == set(range(16))
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in got)
