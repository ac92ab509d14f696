"""Partial-ratio semi-join -- fixture, exact scores, blocking = brute force."""

import os
import random

import pytest

from data_dirs import SF001
from vinterra.operators.fuzzy import _candidates, exceeds, fuzzy_matches, fuzzy_semi_join, partial_ratio
from vinterra.plans.q_spatial import polygons, wine_names
from vinterra.operators.polygons import with_clean_name


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def _partial_ratio_naive(s1, s2):
    """Every substring of the longer string no longer than the shorter one, for equal lengths of either."""
    if not s1 or not s2:
        return 100.0 if s1 == s2 else 0.0
    if len(s1) == len(s2):
        return max(_naive_one_way(s1, s2), _naive_one_way(s2, s1))
    return _naive_one_way(*sorted((s1, s2), key=len))


def _naive_one_way(s1, s2):
    m, n = len(s1), len(s2)
    wins = [s2[:i] for i in range(1, m)] + [s2[i:i + m] for i in range(n - m + 1)] + [s2[i:] for i in range(max(n - m + 1, 1), n)]
    return max(200.0 * _lcs_dp(s1, w) / (m + len(w)) for w in wins)


def test_fixture_scores():
    assert partial_ratio("bordeaux", "Bordeaux Supérieur") == pytest.approx(87.5)
    assert partial_ratio("champagne", "Champagne Blanc") == pytest.approx(88.888888, abs=1e-4)
    assert partial_ratio("unknown", "Bordeaux Supérieur") < 30


def test_scores_match_naive_dp():
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 25)))
        assert partial_ratio(a, b) == pytest.approx(_partial_ratio_naive(a, b))
        for t in (60, 85):
            assert exceeds(a, b, t) == (_partial_ratio_naive(a, b) > t + 1e-9)


def test_semi_join_fixture(spark):
    polys = spark.createDataFrame([("bordeaux", 1.0, 44.0), ("champagne", 3.0, 49.0), ("unknown", 0.0, 0.0)],
                                  "denom_clean string, x double, y double")
    wines = spark.createDataFrame([("Bordeaux Supérieur",), ("Champagne Blanc",)], "Wine string")
    assert sorted(r.denom_clean for r in fuzzy_semi_join(polys, "denom_clean", wines, "Wine", 70).collect()) == ["bordeaux", "champagne"]


@pytest.mark.parametrize("threshold", [60, 85, 95])
def test_blocking_is_lossless(spark, threshold):
    needles = with_clean_name(polygons(spark, SF001)).where("denom_clean IS NOT NULL")
    hays = wine_names(spark, SF001)
    got = {(r.n, r.h) for r in fuzzy_matches(needles, "denom_clean", hays, "Wine", threshold).collect()}
    ns = {r[0] for r in needles.select("denom_clean").distinct().collect()}
    hs = {r[0] for r in hays.distinct().collect()}
    truth = {(n, h) for n in ns for h in hs if exceeds(n, h, threshold)}
    assert got == truth and len(truth) > 0


def test_low_threshold_rejected(spark):
    df = spark.createDataFrame([("a",)], "n string")
    with pytest.raises(ValueError):
        fuzzy_matches(df, "n", df, "n", 40)


def test_equal_lengths_are_tried_both_ways():
    assert partial_ratio("abcY", "aXbc") == partial_ratio("aXbc", "abcY") == pytest.approx(85.714285, abs=1e-5)
    assert exceeds("abcY", "aXbc", 85) and exceeds("aXbc", "abcY", 85)
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        a, b = ("".join(rng.choice("abc") for _ in range(n)) for _ in range(2))
        assert partial_ratio(a, b) == pytest.approx(_partial_ratio_naive(a, b))


@pytest.mark.parametrize("threshold", [50, 70, 85, 99, 100])
def test_pairs_of_odd_strings_match_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    words = ["", "abcY", "aXbc", "Y", None, "a b", "abcabcabc"] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    left = spark.createDataFrame([(w,) for w in words[:40]], "n string")
    right = spark.createDataFrame([(w,) for w in words[3:] + ["", "aXbc"]], "h string")
    got = sorted((r.n, r.h) for r in fuzzy_matches(left, "n", right, "h", threshold).collect())
    want = {(n, h) for n in words[:40] for h in words[3:] + ["", "aXbc"] if n is not None and h is not None and _partial_ratio_naive(n, h) > threshold + 1e-9}
    assert got == sorted(want)


def test_short_names_meet_few_candidates(spark):
    """Names of 3 to 6 letters of a skewed alphabet: nearly every candidate is a match, far below all pairs."""
    rng = random.Random(11)
    letters = "eeeeaaaiiorrnnssttlldcmupgbvhfqyxjkwz"
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    needles = sorted({word(3, 6) for _ in range(600)})
    hays = sorted({"chateau " + word(3, 12) + " " + word(3, 8) for _ in range(1500)} | {word(6, 9) for _ in range(500)})
    nd = spark.createDataFrame([(x,) for x in needles], "s string")
    hs = spark.createDataFrame([(x,) for x in hays], "l string")
    cand = {tuple(r) for r in _candidates(nd, hs, 85).collect()}
    want = {(n, h) for n in needles for h in hays if exceeds(n, h, 85)}
    assert want <= cand and len(want) > 1000
    assert len(cand) <= 1.2 * len(want) and len(cand) <= 0.01 * len(needles) * len(hays), (len(cand), len(want))


@pytest.mark.parametrize("threshold", [85, 99])
def test_long_names_match_all_pairs(spark, threshold):
    """Pieces longer than a join key, edits at the ends and inside."""
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 130))) for _ in range(25)]

    def edit(x):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice(["", "z", "zz"]) + x[i + 1 :]
        return x[rng.randint(0, 3) :]

    left, right = [edit(x) for x in base], [edit(x) + rng.choice(["", " tail", " a longer tail"]) for x in base]
    got = sorted((r.n, r.h) for r in fuzzy_matches(spark.createDataFrame([(x,) for x in left], "n string"), "n",
                                                  spark.createDataFrame([(x,) for x in right], "h string"), "h", threshold).collect())
    want = sorted({(n, h) for n in left for h in right if _partial_ratio_naive(n, h) > threshold + 1e-9})
    assert got == want and want


def test_tasks_need_no_copy_of_the_package(tmp_out):
    """Run from another folder, with the package on the driver's path only."""
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from vinterra.session import local_session
from vinterra.operators.fuzzy import fuzzy_matches
from vinterra.operators.polygons import simplify_polygons
spark = local_session(2)
df = spark.createDataFrame([("bordeaux",), ("qqqq",)], "n string")
wines = spark.createDataFrame([("Bordeaux rouge",)], "h string")
print([tuple(r) for r in fuzzy_matches(df, "n", wines, "h", 70).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], cwd=tmp_out, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip() == "[('bordeaux', 'Bordeaux rouge')]", out.stderr[-800:]
