"""Fuzzy semi-join on partial-ratio similarity.

``partial_ratio(a, b)``: the shorter string s (length m) is compared with
every window of the longer one (full windows of length m, and the shorter
prefix/suffix windows at its ends); a window's score is the normalised Indel
similarity ``200 * LCS / (m + len(window))``; the result is the best score.
Strings of equal length are tried both ways round, since only one of them is
cut into windows.

Blocking (lossless): a window scoring above ``t`` is within Indel distance
``d < 2m(100 - t)/100`` of s.  Cutting s into ``D + 1`` near-equal pieces, with
``D`` the largest integer below that bound, at least one piece survives the
``<= D`` edits and occurs verbatim in the window.  So candidate pairs are
found with equi-joins of pieces of the shorter string against same-length
q-grams of the longer one, for two kinds of windows apart:

* A full window has length m, so its Indel distance is even: one edit fewer is
  allowed if ``D`` is odd, and pieces are fewer and longer.  At 85, names of 3 to 6
  characters are one piece: only names that contain them are met.
* A shorter window is a prefix or a suffix of the longer string.  A piece moves by at
  most ``D`` places in it, so the place, counted from that end, is part of the
  join key.  Up to ``_CHECKED`` edits the built-in ``levenshtein`` (never above the
  Indel distance) of the possible windows is checked as well.

Of a long piece the last ``_MAX_GRAM`` characters are the key (names differ at their
ends), and the whole piece is looked for after the join.  Only candidates are scored
exactly (bit-parallel LCS in a pandas UDF: there is no Indel/LCS function in Spark SQL,
and ``levenshtein`` counts a substitution as one edit, not two).  Before that a JVM
filter uses the edit bound once more: each edit breaks at most two of the shorter
string's bigrams, so at least ``m - 1 - 2D`` of them must occur in the longer one.
Thresholds below 50 make the bound reach m (no piece is guaranteed) and would
need every pair compared; they are rejected rather than run as a cross join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------
DEFAULT_THRESHOLD = 85
# ------------------------------------------------------------------------------------------
# longest join key cut from a piece, in characters
_MAX_GRAM = 8
# edits up to which the windows at the ends are checked before scoring
_CHECKED = 3


def _lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _windows(s2: str, m: int):
    """Windows of ``s2`` compared with a string of length ``m``: the shorter
    prefixes, every full window, the shorter suffixes."""
    n = len(s2)
    for i in range(1, m):
        yield s2[:i]
    for i in range(n - m + 1):
        yield s2[i : i + m]
    for i in range(max(n - m + 1, 1), n):
        yield s2[i:]


def partial_ratio(s1: str, s2: str) -> float:
    """Best normalised Indel similarity (0-100) of the shorter string against
    the windows of the longer one; both ways round if they are equally long."""
    if len(s1) == len(s2):
        return max(_one_way_ratio(s1, s2), _one_way_ratio(s2, s1))
    return _one_way_ratio(*sorted((s1, s2), key=len))


def _one_way_ratio(s1: str, s2: str) -> float:
    m = len(s1)
    if m == 0:
        return 100.0 if not s2 else 0.0
    if s1 in s2:
        return 100.0
    return max((200.0 * _lcs_len(s1, w) / (m + len(w)) for w in _windows(s2, m)), default=0.0)


def _piece_bounds(m: int, threshold: int) -> list[tuple[int, int]]:
    """(start, end) of the D + 1 near-equal pieces of a string of length m."""
    d = -(-2 * m * (100 - threshold) // 100) - 1      # largest integer below 2m(100-t)/100
    n_pieces = min(d + 1, m)
    return [(i * m // n_pieces, (i + 1) * m // n_pieces) for i in range(n_pieces)]


def exceeds(s1: str, s2: str, threshold: int) -> bool:
    """``partial_ratio(s1, s2) > threshold`` decided in exact integer arithmetic.

    Only windows containing a verbatim piece of the shorter string are scored:
    any window above the threshold contains one (the blocking argument, applied
    per pair), so a pair without a piece occurrence is rejected at once."""
    if len(s1) == len(s2):
        return _one_way_exceeds(s1, s2, threshold) or _one_way_exceeds(s2, s1, threshold)
    return _one_way_exceeds(*sorted((s1, s2), key=len), threshold)


def _one_way_exceeds(s1: str, s2: str, threshold: int) -> bool:
    m, n = len(s1), len(s2)
    if m == 0:
        return (100 if not s2 else 0) > threshold
    if s1 in s2:
        return 100 > threshold
    if threshold < 50:
        return any(200 * _lcs_len(s1, w) > threshold * (m + len(w)) for w in _windows(s2, m))
    starts: set[int] = set()       # full windows s2[s:s+m]
    prefixes: set[int] = set()     # s2[:i], i < m
    suffixes: set[int] = set()     # s2[j:], n - j < m
    for a, b in _piece_bounds(m, threshold):
        piece, size = s1[a:b], b - a
        if size == 0:
            continue
        p = s2.find(piece)
        while p >= 0:
            starts.update(range(max(p + size - m, 0), min(p, n - m) + 1))
            prefixes.update(range(max(p + size, 1), m))
            suffixes.update(range(max(n - m + 1, 1), p + 1))
            p = s2.find(piece, p + 1)
    for i in sorted(prefixes):
        if i < m and 200 * _lcs_len(s1, s2[:i]) > threshold * (m + i):
            return True
    for st in sorted(starts):
        if 200 * _lcs_len(s1, s2[st : st + m]) > threshold * 2 * m:
            return True
    for j in sorted(suffixes):
        if 200 * _lcs_len(s1, s2[j:]) > threshold * (m + n - j):
            return True
    return False


def max_edits_below(length: Column, threshold: int) -> Column:
    """Largest integer strictly below ``length * (100 - t)/100``, ``length`` being that of both strings together."""
    return F.ceil(length * F.lit(100 - threshold) / F.lit(100.0)).cast("int") - 1


def max_piece_length(threshold: int) -> int:
    """Upper bound of the key lengths for any string length at ``threshold``: a string of one piece has no edit to
    spare in a full window, so it is at most ``100 / (100 - t)`` long."""
    return min(-(-100 // (100 - threshold)), _MAX_GRAM)


def _pieces(s: Column, m: Column, n_pieces: Column) -> Column:
    """``n_pieces`` near-equal consecutive pieces of ``s`` with their keys and the places of these, from 0."""
    def cut(i: Column) -> Column:
        start, end = F.floor(i * m / n_pieces).cast("int"), F.floor((i + 1) * m / n_pieces).cast("int")
        key = F.greatest(start, end - _MAX_GRAM)
        return F.struct(
            F.substring(s, start + 1, end - start).alias("piece"), F.substring(s, key + 1, end - key).alias("gram"),
            (end - key).alias("q"), key.alias("at"),
        )

    return F.transform(F.sequence(F.lit(0), n_pieces - 1), cut)


def _grams(long: DataFrame, longest: int) -> DataFrame:
    """``l, q, gram, at``: every substring of 1 .. ``longest`` characters with its place, from 0."""
    sized = long.select("l", F.length("l").alias("_n"), F.explode(F.array(*[F.lit(q) for q in range(1, longest + 1)])).alias("q"))
    placed = sized.where(F.col("_n") >= F.col("q")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("q"))).alias("at"))
    return placed.select("l", "_n", "q", F.substring("l", F.col("at") + 1, F.col("q")).alias("gram"), "at")


def _inside(short: DataFrame, grams: DataFrame, threshold: int) -> DataFrame:
    """Pairs that may match in a full window."""
    m = F.length("s")
    d = max_edits_below(2 * m, threshold)
    pieces = short.select("s", F.explode(_pieces(F.col("s"), m, d - F.pmod(d, F.lit(2)) + 1)).alias("p"))
    pieces = pieces.select("s", m.alias("_m"), "p.piece", "p.gram", "p.q").distinct()
    pairs = pieces.join(grams.select("l", "_n", "q", "gram"), ["q", "gram"])
    return pairs.where((F.col("_m") <= F.col("_n")) & F.contains("l", "piece")).select("s", "l").distinct()


def _at_the_ends(short: DataFrame, grams: DataFrame, threshold: int) -> DataFrame:
    """Pairs that may match in a prefix or a suffix shorter than the shorter string."""
    m, n = F.length("s"), F.col("_n")
    d = max_edits_below(2 * m - 1, threshold)
    cut = short.where(d >= 1).select("s", m.alias("_m"), d.alias("_d"), F.explode(_pieces(F.col("s"), m, d + 1)).alias("p"))
    # places are counted from the start (side 1), and to the end (side -1)
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("p.at").alias("at")),
        F.struct(F.lit(-1).alias("side"), (F.col("_m") - F.col("p.at") - F.col("p.q")).alias("at")),
    )
    keys = cut.select("s", "_m", "_d", "p.q", "p.gram", F.inline(sides))
    keys = keys.select(
        "s", "_m", "_d", "q", "gram", "side",
        F.explode(F.sequence(F.greatest(F.col("at") - F.col("_d"), F.lit(0)), F.col("at") + F.col("_d"))).alias("at"),
    ).distinct()
    both = F.array(
        F.struct(F.lit(1).alias("side"), F.col("at").alias("_at")), F.struct(F.lit(-1).alias("side"), (n - F.col("at") - F.col("q")).alias("_at"))
    )
    ends = grams.select("l", "_n", "q", "gram", F.inline(both)).withColumnRenamed("_at", "at")
    pairs = keys.join(ends, ["q", "gram", "side", "at"]).where(F.col("_m") <= n).select("s", "l", "_m", "_n", "_d", "side").distinct()
    start = lambda w: F.when(F.col("side") == 1, F.lit(1)).otherwise(n - w + 1)
    close = F.exists(
        F.sequence(F.greatest(F.col("_m") - F.col("_d"), F.lit(1)), F.greatest(F.col("_m") - 1, F.lit(1))),
        lambda w: F.levenshtein("s", F.substring("l", start(w), w)) <= F.col("_d"),
    )
    return pairs.where((F.col("_d") > _CHECKED) | close).select("s", "l")


def _candidates(short: DataFrame, long: DataFrame, threshold: int) -> DataFrame:
    """Pairs (s, l) with len(s) <= len(l) that can score above ``threshold``."""
    m = F.length("s")
    d = max_edits_below(2 * m, threshold)
    blocked = short.where((m > 0) & (d + 1 <= m))
    grams = _grams(long, max_piece_length(threshold))
    pairs = _inside(blocked, grams, threshold).unionByName(_at_the_ends(blocked, grams, threshold)).distinct()
    bigrams = F.transform(F.sequence(F.lit(1), m - 1), lambda i: F.substring("s", i, F.lit(2)))
    kept = F.size(F.filter(bigrams, lambda g: F.contains(F.col("l"), g)))
    needed = m - 1 - 2 * d
    return pairs.where((needed <= 0) | (kept >= needed))


def fuzzy_matches(needles: DataFrame, needle_col: str, haystacks: DataFrame, hay_col: str,
                  threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Distinct (needle, haystack) pairs with ``partial_ratio > threshold``."""
    if threshold < 50:
        raise ValueError("thresholds below 50 have no lossless blocking; not supported")
    if threshold >= 100:  # no score is above 100
        return needles.sparkSession.createDataFrame([], "n string, h string")
    nd = needles.select(F.col(needle_col).alias("n")).where(F.col("n").isNotNull()).distinct()
    hs = haystacks.select(F.col(hay_col).alias("h")).where(F.col("h").isNotNull()).distinct()
    # shorter-or-equal needle: pieces of the needle against grams of the haystack
    c1 = _candidates(nd.select(F.col("n").alias("s")), hs.select(F.col("h").alias("l")), threshold).select(
        F.col("s").alias("n"), F.col("l").alias("h")
    )
    # longer or equal needle: roles swap, pieces of the haystack against grams of the needle
    c2 = _candidates(hs.select(F.col("h").alias("s")), nd.select(F.col("n").alias("l")), threshold).select(
        F.col("l").alias("n"), F.col("s").alias("h")
    )
    # two empty strings have no pieces but are equal
    empty = nd.where(F.col("n") == "").join(hs, F.col("n") == F.col("h"))
    cand = c1.unionByName(c2).distinct().unionByName(empty)

    @F.pandas_udf(T.BooleanType())
    def _score(n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([exceeds(a, b, threshold) for a, b in zip(n, h)], dtype=bool)

    return cand.where(_score("n", "h"))


def fuzzy_semi_join(left: DataFrame, key: str, haystacks: DataFrame, hay_col: str,
                    threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Rows of ``left`` whose ``key`` matches any haystack (``left_semi``)."""
    matched = fuzzy_matches(left, key, haystacks, hay_col, threshold).select(F.col("n").alias(key)).distinct()
    return left.join(matched, key, "left_semi")
