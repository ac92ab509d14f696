"""Quality rules with adaptive thresholds per language and source.

Four shares of each text (symbols, characters in duplicate lines, repeated words, mean word length) are put into
quantile sketches per (lang, source).  A sketch is a log-linear histogram: a value keeps its
``PRECISION`` leading bits, which bounds the relative error, and sketches merge by adding counts,
so Spark builds them with one partial aggregation.  Rows that fail the base rules are not sketched: junk
does not widen its own fence.  The quartiles read from a sketch give the
group's own fences, ``quartile +- SPREAD * (q75 - q25) +- margin``; they replace fixed cutoffs.
The verdict joins the fences back to the rows null-safe on (lang, source).

A small group says little about itself, so its quartiles lean on those of the merged sketch of its
language as if ``BACKING`` rows of it had been added, and these lean likewise on the sketch of the whole
corpus.  A group of many rows is judged by its own habits.

Only DataFrame functions are used.  A few fixed base rules reject texts that no group's habits
excuse: fewer than 50 words, or over half of the words in repeated three-word windows.

Defined results: null and empty texts have no words and fail the base rules; null lang or source
is a group of its own; repeated rows are judged alike and each counts in the sketch; an empty table
gives an empty result; extra columns do not take part.  A corpus of one document has its fences around
its only value; a group without a row that passes the base rules has no fence and keeps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from vinterra.llm.common import same_row, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Leading bits that a sketch keeps of a value: a relative error below 1/128.
PRECISION = 8
SPREAD = 3
#: Rows of the wider sketch that back a group's quartiles.
BACKING = 64
#: metric -> (least width of the upper fence above q75, of the lower one below q25; None: no lower fence)
MARGINS = {
    "symbols_ppm": (30_000, None),
    "dup_chars_ppm": (200_000, None),
    "repeats_ppm": (300_000, None),
    "word_length_milli": (1_000, 1_000),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the counts of the text column: ``COUNTS``, and the characters of its
    lines with a word (``line_chars``) and of those that repeat an earlier one (``dup_chars``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each helper column that is used more than once has a projection of its own.
    df = df.select("*", words(text).alias("_w"), lines.alias("_l"))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_h",
        F.when(
            F.col("n_words") > 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        ),
    )
    # Equal windows have equal hashes, so only texts with equal hashes need their windows sorted.
    grams = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("p")
            ),
        )
    )
    df = df.withColumn("_g", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), grams))
    twice = F.filter(
        "_g",
        lambda x, i: (F.get("_g", i - 1)["g"] == x["g"]) | (F.get("_g", i + 1)["g"] == x["g"]),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    return df.select(
        "*",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.length(F.array_join("_l", "")).cast("long").alias("line_chars"),
        (F.length(F.array_join("_l", "")) - F.length(F.array_join(F.array_distinct("_l"), ""))).cast("long").alias("dup_chars"),
        F.when(F.col("_g").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    ).drop("_w", "_l", "_h", "_g")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _shares() -> dict[str, Column]:
    return {
        "symbols_ppm": F.expr("1000000 * n_symbols div greatest(word_chars, 1)"),
        "dup_chars_ppm": F.expr("1000000 * dup_chars div greatest(line_chars, 1)"),
        "repeats_ppm": F.expr("1000000 * n_repeat_words div greatest(n_words, 1)"),
        "word_length_milli": F.expr("1000 * word_chars div greatest(n_words, 1)"),
    }


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Row identity, group, counts and shares of every document."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.col(text_col).alias("text"),
    )
    return with_counts(base, "text").drop("text").withColumns(_shares()).withColumn("base_failed", base_failed())


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, metric, bucket, n`` over all documents that have a word."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in MARGINS]))
    cell = measured.where("n_words > 0").select("lang", "source", cells.alias("c")).select("lang", "source", "c.*")
    cell = cell.withColumn("cut", F.greatest(F.length(F.bin("v")) - PRECISION, F.lit(0)))
    bucket = F.expr("shiftleft(shiftright(v, cut), cut)").alias("bucket")
    return cell.select("lang", "source", "metric", bucket).groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(one: DataFrame, other: DataFrame) -> DataFrame:
    """The sketch of both corpora together."""
    return one.unionByName(other).groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def _quartiles(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows ``n`` and quartiles of the sketches merged by ``keys``; at most a few thousand buckets per key and metric."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    run = merged.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})

    def quartile(metric: str, k: int) -> Column:
        return F.min(F.when((F.col("metric") == metric) & (4 * F.col("up_to") >= k * F.col("total")), F.col("bucket")))

    return run.groupBy(*keys).agg(F.max("total").alias("n"), *[quartile(m, k).alias(f"{m}_q{k}") for m in MARGINS for k in (1, 3)])


def _lean(n: Column, own: Column, wider: Column) -> Column:
    """``own`` of ``n`` rows backed by ``wider`` of ``BACKING`` rows, rounded down."""
    exact = [c.cast("decimal(18,0)") for c in (n, own, wider)]
    total = exact[0] * exact[1] + F.lit(BACKING).cast("decimal(4,0)") * exact[2]
    return F.call_function("div", total, n + F.lit(BACKING)).cast("long")


def fences(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): ``<metric>_low`` and ``<metric>_high``."""
    names = [f"{m}_q{k}" for m in MARGINS for k in (1, 3)]
    whole = _quartiles(sketches, ()).first()  # one row of nine numbers
    by_lang = _quartiles(sketches, ("lang",)).select(
        F.col("lang").alias("l_lang"), *[_lean(F.col("n"), F.col(q), F.lit(whole[q] or 0)).alias(f"l_{q}") for q in names]
    )
    own = _quartiles(sketches, ("lang", "source"))
    backed = own.join(by_lang, own["lang"].eqNullSafe(by_lang["l_lang"])).select(
        "lang", "source", *[_lean(F.col("n"), F.col(q), F.col(f"l_{q}")).alias(q) for q in names]
    )
    cols = []
    for m, (above, below) in MARGINS.items():
        q1, q3 = F.col(f"{m}_q1"), F.col(f"{m}_q3")
        cols.append((q3 + SPREAD * (q3 - q1) + above).alias(f"{m}_high"))
        if below is not None:
            cols.append((q1 - SPREAD * (q3 - q1) - below).alias(f"{m}_low"))
    return backed.select("lang", "source", *cols)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with the verdict ``kept``."""
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    on = measured["lang"].eqNullSafe(limits["f_lang"]) & measured["source"].eqNullSafe(limits["f_source"])
    inside = F.lit(True)
    for m, (_, below) in MARGINS.items():
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
        if below is not None:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return measured.join(limits, on, "left").select(*[measured[c] for c in measured.columns], kept.alias("kept"))


def verdicts(docs: DataFrame, **columns) -> DataFrame:
    """One row per document: counts, shares, ``base_failed`` and ``kept``."""
    measured = written(measure(docs, **columns), "quality-measures")
    sketches = written(sketch(measured.where("not base_failed")), "quality-sketch")
    return judge(measured, written(fences(sketches), "quality-fences"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    keys = ("doc_id", "text_key", "lang", "source")
    judged = verdicts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    bad = written(judged.where("not kept").select(*keys).distinct(), "quality-rejected")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    return rows.join(bad, same_row(rows, bad, keys), "left_anti").select("doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
h AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM g),
r AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE c > 1) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(array_to_string(l, ''))::BIGINT AS line_chars,
         (length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), '')))::BIGINT AS dup_chars,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
m AS (
  SELECT *, 1000000 * n_symbols // greatest(word_chars, 1) AS symbols_ppm,
         1000000 * dup_chars // greatest(line_chars, 1) AS dup_chars_ppm,
         1000000 * n_repeat_words // greatest(n_words, 1) AS repeats_ppm,
         1000 * word_chars // greatest(n_words, 1) AS word_length_milli,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
u AS (
  SELECT lang, source, 'symbols_ppm' AS metric, symbols_ppm AS v FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_chars_ppm', dup_chars_ppm FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats_ppm', repeats_ppm FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length_milli', word_length_milli FROM m WHERE NOT base_failed),
s AS (
  SELECT lang, source, metric, (v >> k) << k AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 8, 0)::BIGINT AS k FROM u) GROUP BY ALL),
e AS (
  SELECT 0 AS scope, lang, source, metric, bucket, n FROM s
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM s GROUP BY ALL),
a AS (
  SELECT *, sum(n) OVER (PARTITION BY scope, lang, source, metric ORDER BY bucket) AS up_to,
         sum(n) OVER (PARTITION BY scope, lang, source, metric) AS total FROM e),
o AS (
  SELECT scope, lang, source, metric, max(total)::HUGEINT AS n, min(bucket) FILTER (4 * up_to >= total) AS q1,
         min(bucket) FILTER (4 * up_to >= 3 * total) AS q3
  FROM a GROUP BY ALL),
lq AS (
  SELECT x.lang, x.metric, (x.n * x.q1 + 64 * y.q1) // (x.n + 64) AS q1, (x.n * x.q3 + 64 * y.q3) // (x.n + 64) AS q3
  FROM o x JOIN o y USING (metric) WHERE x.scope = 1 AND y.scope = 2),
q AS (
  SELECT x.lang, x.source, x.metric, ((x.n * x.q1 + 64 * y.q1) // (x.n + 64))::BIGINT AS q1,
         ((x.n * x.q3 + 64 * y.q3) // (x.n + 64))::BIGINT AS q3
  FROM o x JOIN lq y ON x.lang IS NOT DISTINCT FROM y.lang AND x.metric = y.metric WHERE x.scope = 0),
f AS (
  SELECT lang, source,
         max(q3 + 3 * (q3 - q1) + 30000) FILTER (metric = 'symbols_ppm') AS f1,
         max(q3 + 3 * (q3 - q1) + 200000) FILTER (metric = 'dup_chars_ppm') AS f2,
         max(q3 + 3 * (q3 - q1) + 300000) FILTER (metric = 'repeats_ppm') AS f3,
         max(q3 + 3 * (q3 - q1) + 1000) FILTER (metric = 'word_length_milli') AS f4,
         max(q1 - 3 * (q3 - q1) - 1000) FILTER (metric = 'word_length_milli') AS f5
  FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols_ppm <= f1 AND dup_chars_ppm <= f2 AND repeats_ppm <= f3
         AND word_length_milli <= f4 AND word_length_milli >= f5, false) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""
