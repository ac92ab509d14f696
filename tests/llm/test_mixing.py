import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from vinterra.llm import mixing as M


def brute_phase(q):
    """Slot by slot: of the released blocks, the one with the earliest deadline."""
    n = sum(q.values())
    done = dict.fromkeys(q, 0)
    out = []
    for t in range(n):
        ready = [s for s in q if done[s] < q[s] and done[s] * n // q[s] <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * n // q[s]), s))
        done[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_period_is_pfair(seed):
    rnd = random.Random(seed)
    weights = {f"s{i}": rnd.random() + 0.01 for i in range(rnd.randrange(1, 9))}
    q = M.quantised(weights, 200)
    assert sum(q.values()) == 200 and min(q.values()) >= 1
    order = M.period_slots(q)
    assert order == brute_phase(q)
    done = Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - Fraction(q[x] * t, 200)) < 1 for x in q)


def test_phases_place_every_block_once():
    blocks = {"a": 1700, "b": 30, "c": 400, "d": 0}
    rows = M.phases(blocks, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 1.0}, 100)
    slots = []
    for source, _, first, n, q, period, start, at in rows:
        assert len(at) == q
        slots += [start + k // q * period + at[k % q] for k in range(n)]
    assert sorted(slots) == list(range(2130))
    for s, n in blocks.items():
        mine = sorted((r[2], r[3]) for r in rows if r[0] == s)
        assert sum(m[1] for m in mine) == n
        assert all(a + k == b for (a, k), (b, _) in zip(mine, mine[1:]))


def test_schedule_of_a_hot_source(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    got = M.schedule(docs, block_rows=8, buckets=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert len({(r.slot, r.in_block) for r in got}) == 3000
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    # in the first phase each source is within a block of its share at every slot
    first = sorted({(r.slot, r.source, r.weight) for r in got if r.phase == 0})
    done, weight = Counter(), {s: w for _, s, w in first}
    for t, s, _ in first:
        done[s] += 1
        assert all(abs(done[x] - w * (t + 1)) < 1 + 1e-9 for x, w in weight.items())


def test_odd_rows_stay_whole(odd_docs):
    got = M.schedule(odd_docs, block_rows=2).collect()
    want = odd_docs.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in want)
    mixed = M.interleave(odd_docs, block_rows=2)
    assert mixed.columns == odd_docs.columns
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, want))


def test_named_weights_and_empty_table(spark, odd_docs, no_docs):
    weights = {"a": 4.0, "b": 2.0, "c": 1.0, None: 1.0}
    got = M.schedule(odd_docs, weights=weights, block_rows=1).where("phase = 0").collect()
    share = {r.source: r.weight for r in got}
    assert share["a"] > share["b"] > share["c"]
    assert M.schedule(no_docs).collect() == [] and M.interleave(no_docs).collect() == []


def test_thousands_of_sources(spark):
    docs = spark.range(15_000).selectExpr("id AS doc_id", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5000 END) AS source")
    got = M.schedule(docs, block_rows=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(15_000))
    assert len({r.source for r in got}) > 3000
    slots = {r.slot: (r.source, r.block) for r in got}
    assert sorted(slots) == list(range(len(slots))) == list(range(len(set(slots.values()))))
    assert all(r.release <= r.slot < r.deadline for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_every_phase_starts_anew_with_the_weights_left(seed):
    rnd = random.Random(seed)
    blocks = {f"s{i}": rnd.randrange(0, 30) for i in range(7)}
    weights = {s: rnd.choice([0.0, rnd.random(), 1 / 3, 2.0]) for s in blocks}
    rows = list(M.block_slots(blocks, weights))
    left, at = {s: n for s, n in blocks.items() if n}, 0
    while left:
        q = M.whole_weights({s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1))
        for s in itertools.islice(endless(q), sum(left.values())):
            assert rows[at][0] == s
            left[s] -= 1
            at += 1
            if not left[s]:
                del left[s]
                break
    assert at == len(rows) == sum(blocks.values())


def endless(q):
    """Slot by slot: of the released blocks, the one with the earliest deadline."""
    n, done = sum(q.values()), dict.fromkeys(q, 0)
    for t in itertools.count():
        ready = [s for s in q if done[s] * n // q[s] <= t]
        s = min(ready, key=lambda s: (-((done[s] + 1) * n // -q[s]), s))
        done[s] += 1
        yield s


def drift(rows, weights):
    """Largest distance of any source from its exact share, in blocks, at any slot of the first phase."""
    total = sum(map(Fraction, weights.values()))
    done, worst = Counter(), 0
    for s, phase, *_, slot in rows:
        if phase:
            break
        done[s] += 1
        worst = max(worst, *(abs(done[x] - Fraction(weights[x]) * (slot + 1) / total) for x in weights))
    return worst


@pytest.mark.parametrize("weights", [
    {"a": 0.9, **{f"s{i}": 0.1 / 19 for i in range(19)}},
    {"a": 0.5, **{f"s{i}": 0.5 / 99 for i in range(99)}},
    {"a": 0.9997, "b": 0.0003},
    {"a": 1 / 3, "b": 0.123456789, "c": 2**0.5},
])
def test_blocks_follow_the_given_weights_exactly(weights):
    rows = list(M.block_slots(dict.fromkeys(weights, 3000), weights))
    assert drift(rows, weights) < 1
    assert all(r[4] <= r[6] < r[5] for r in rows) and [r[6] for r in rows] == list(range(3000 * len(weights)))
    assert Counter(r[0] for r in rows) == dict.fromkeys(weights, 3000)
    assert len({(r[0], r[2]) for r in rows}) == len(rows)


def test_scheduled_rows_keep_the_given_weights(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE_BLOCKS", 700)  # several pieces
    weights = {"0": 0.9, **{str(i): 0.1 / 19 for i in range(1, 20)}}
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(CASE WHEN id < 2000 THEN 0 ELSE id % 20 END AS string) AS source")
    got = sorted(M.schedule(docs, weights=weights, block_rows=1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(4000))
    assert sum(r.phase == 0 for r in got) > 1900
    assert drift([(r.source, r.phase, r.slot) for r in got], weights) < 1


def test_weight_nought_comes_last_and_wrong_weights_are_refused():
    rows = list(M.block_slots({"a": 3, "b": 2, "c": 2}, {"a": 1.0, "b": 0.0, "c": 0}))
    assert "".join(r[0] for r in rows) == "aaabcbc"
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            list(M.block_slots({"a": 1, "b": 1}, {"a": 1.0, "b": wrong}))
    assert list(M.block_slots({}, {})) == []
