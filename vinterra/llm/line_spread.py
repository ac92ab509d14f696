"""Line deduplication by distinct-site spread.

1. The distinct lines of each document are hashed.  One aggregation per line hash builds a
   HyperLogLog sketch of the sites that hold it; sketches merge, so a line that stands on a third of
   all pages is combined before the shuffle.
2. Lines whose estimate is clearly above the threshold are boilerplate, clearly below are not; for
   those near it the distinct sites are counted exactly.
3. Boilerplate lines are cut from every document.

Lines are compared without white space at their ends; lines without a word are never removed.

Defined results: null and empty texts have no lines with a word and stay empty; a null site is one
site of its own; repeated rows get the same result each; an empty table gives an empty one; extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import record_batches, same_row, written

#: A line on at least so many sites is boilerplate.
MIN_SITES = 6
#: log2 of the sketch's registers, and the share by which an estimate may err (over five standard errors).
LG_K = 10
ERROR = 0.2
BLANK = " \t\r\x0b\x0c"


def line_hashes(text: Column) -> Column:
    """Hash of each line, null for lines without a word."""
    trimmed = lambda x: F.btrim(x, F.lit(BLANK))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(F.length(trimmed(x)) > 0, F.xxhash64(trimmed(x))))


def _site(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``doc_id, text_key, site, h``: the distinct lines of each document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        _site(F.col(site_col)).alias("site"),
        F.explode(F.array_distinct(F.array_compact(line_hashes(F.col(text_col))))).alias("h"),
    )


def spread(lines: DataFrame) -> DataFrame:
    """``h, sketch``: sketches of parts of a corpus merge with ``hll_union_agg``."""
    one_site = F.min("site") == F.max("site")
    return (
        lines.groupBy("h")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), one_site.alias("one_site"))
        .where(~F.col("one_site"))
        .drop("one_site")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h, n_sites, exact`` of the lines on at least ``min_sites`` sites.

    ``n_sites`` is the exact count where the sketch was near the threshold, else the estimate.
    """
    if min_sites < 2:
        raise ValueError("a spread needs at least two sites")
    guess = written(spread(lines).select("h", F.hll_sketch_estimate("sketch").alias("n_sites")), "line-spread")
    low, high = min_sites * (1 - ERROR) - 1, min_sites * (1 + ERROR) + 1
    near = guess.where((F.col("n_sites") >= low) & (F.col("n_sites") <= high)).select("h")
    counted = lines.select("h", "site").join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_sites"))
    sure = guess.where(F.col("n_sites") > high).select("h", F.col("n_sites").cast("long").alias("n_sites"), F.lit(False).alias("exact"))
    return sure.unionByName(counted.where(F.col("n_sites") >= min_sites).select("h", "n_sites", F.lit(True).alias("exact")))


RESULT = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept string"


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, with_text: bool = True
) -> DataFrame:
    """One row per document: lines with a word, lines removed, and the text left.

    ``kept`` (null if ``with_text`` is false) are the other lines joined by line feeds.
    """
    lines = written(lines_of(docs, id_col, text_col, site_col), "line-hashes")
    common = written(boilerplate(lines, min_sites).select("h"), "line-boilerplate")
    held = lines.select("doc_id", "text_key", "h").distinct().join(common, "h")
    held = held.groupBy("doc_id", "text_key").agg(F.collect_set("h").alias("bad"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    marked = rows.join(held, same_row(rows, held), "left").select(rows["doc_id"], "text", line_hashes(F.col("text")).alias("hs"), "bad")

    names = [x.split()[0] for x in RESULT.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])))

    def cut(batches):
        for batch in batches:
            for d, text, hs, bad in zip(*batch.columns):
                text, hs, bad = text.as_py(), hs.as_py(), set(bad.as_py() or ())
                kept, gone = text, 0
                if bad:
                    kept = "\n".join([x for x, h in zip(text.split("\n"), hs) if h not in bad])
                    gone = sum(h in bad for h in hs)
                n = sum(h is not None for h in hs)
                yield d.as_py(), n, gone, hashlib.sha256(kept.encode()).hexdigest(), kept if with_text else None

    return marked.mapInArrow(lambda batches: record_batches(cut(batches), schema), RESULT)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS site, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, site, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM x),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 6),
n AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (k IN (SELECT k FROM b)) AS n_removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM b)) AS kept
      FROM t GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n
"""
