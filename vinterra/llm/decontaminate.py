"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Benchmark items become windows of 13 normalised words (a shorter item is one window).  The set of
windows is broadcast behind a check of its size; every window of every document is hashed in a
scan, looked up, and verified word by word inside the join, so only true hits leave the scan.
Hits aggregate per document: words covered, items met.  Beyond the size check the set is cut by hash into
slices that pass it, and the documents are scanned once per slice: words are never shuffled, and the
cost grows with the benchmark alone.

Only DataFrame functions are used.

Normalisation: A-Z become lower case; words are runs of characters outside ASCII except digits and
lower-case letters.

Defined results: a null text has no words, and no hits; a null item text is no window; items of one
id count as one item, a null id is the item ``null``; repeated documents get the same result each;
a null doc_id is a value like any other; empty tables give no hits; extra columns are carried by
``remove_contaminated`` and not read by ``contamination``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import same_row, written

N_WORDS = 13
#: Largest set of benchmark windows that is broadcast at once, in bytes of their words and item names.
BROADCAST_BYTES = 256 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def norm_words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN), "")


def _gram_hash(words: str, start: Column, length: int) -> Column:
    """Hash of ``length`` words from the 0-based ``start``; words past the end do not count."""
    return F.xxhash64(*[F.get(words, start + k) for k in range(length)])


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N_WORDS) -> DataFrame:
    """Distinct windows ``len, h, gram`` with the sorted names of the items that hold them."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item")
    w = items.select(name, norm_words(text_col).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
    return (
        w.select("item", "len", F.explode(grams).alias("gram"))
        .groupBy("len", "gram")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("h", _gram_hash("gram", F.lit(0), n))
    )


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, n: int = N_WORDS) -> DataFrame:
    """``doc_id, text_key, n_hit, items`` of every distinct document with a hit."""
    grams = written(benchmark_windows(items, item_id, item_text, n), "benchmark-windows")
    row_bytes = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * F.size("items") + 64
    stats = grams.groupBy("len").agg(F.sum(row_bytes).alias("b")).collect()
    lengths = sorted(r.len for r in stats)  # at most n
    total = sum(r.b for r in stats)
    # twice as many slices as the mean needs, so that none is above the limit for an uneven hash
    n_slices = 1 if total <= BROADCAST_BYTES else -(-2 * total // BROADCAST_BYTES)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), norm_words(text_col).alias("w"))
    # Positions are exploded and hashed in the same compiled stage; the words are not copied.
    shortest = lengths[0] if lengths else n
    scan = base.where(F.size("w") >= shortest).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - shortest)).alias("pos"))
    if len(lengths) == 1:
        scan = scan.select("*", F.lit(shortest).alias("len"), _gram_hash("w", F.col("pos"), shortest).alias("h"))
    else:
        each = [F.struct(F.lit(k).alias("len"), _gram_hash("w", F.col("pos"), k).alias("h")) for k in lengths or [n]]
        scan = scan.select("*", F.inline(F.array(*each)))
    match = (
        (F.col("s.h") == F.col("b.h"))
        & (F.col("s.len") == F.col("b.len"))
        & (F.slice(F.col("s.w"), F.col("s.pos") + 1, F.col("s.len")) == F.col("b.gram"))
    )

    def found_in(part: Column) -> DataFrame:
        one = scan.where(part).alias("s").join(F.broadcast(grams.where(part)).alias("b"), match)
        return one.select("doc_id", "text_key", "pos", F.col("s.len").alias("len"), "items")

    # every slice's hits are written before the next scan, so one set at a time is held
    slices = [F.pmod(F.col("h"), F.lit(n_slices)) == i for i in range(n_slices)]
    found = found_in(F.lit(True)) if n_slices == 1 else reduce(DataFrame.unionByName, [written(found_in(x), "benchmark-slice") for x in slices])
    covered = F.flatten(
        F.transform(F.collect_set(F.struct("pos", "len")), lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))
    )
    return found.groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    met = written(hits(docs, items, id_col, text_col, item_id, item_text), "benchmark-hits")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.size(norm_words(text_col)).cast("long").alias("n_words"),
    )
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return rows.join(met, same_row(rows, met), "left").select(
        rows["doc_id"],
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    met = written(hits(docs, items, id_col, text_col, item_id, item_text), "benchmark-hits")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    joined = rows.join(met.select("doc_id", "text_key", "n_hit"), same_row(rows, met), "left")
    # the words of a document are counted only where it has hits
    clean = F.when(F.col("n_hit").isNull(), True).otherwise(ONE_IN * F.col("n_hit") < F.size(norm_words(f"doc.`{text_col}`")))
    return joined.where(clean).select("doc.*")


ORACLE = r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, w[p : p + least(len(w), 13) - 1] AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
x AS (
  SELECT doc_id, p, n, w[p : p + n - 1] AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT DISTINCT x.doc_id, x.p, x.n, g.item FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
