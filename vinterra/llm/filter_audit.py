"""Audit of how filters interact: contingency tensors and their contractions.

Five filters judge every document.  What any order of them removes, at any step, follows from how many
documents of a part fail each combination of filters: 32 counts.

1. One pass over the texts gives each document its flags; it carries on a digest, never the text.
2. Copies: the rows of a text are combined by digest, part and labels before the smallest id is found,
   so a text that a third of all rows hold is a few rows after the map-side aggregation.
3. The counts per part and combination are reshaped to a 2 x 2 x 2 x 2 x 2 tensor (pass, fail along each
   axis).  Every column of the result is a contraction of it: a vector per axis selects pass, fail or
   all, for each of the 120 orders and five steps at once.

Filters (a document fails if): ``A`` under 100 words; ``B`` distinct words under 80 % of the words;
``C`` characters A-Z over 10 % of the code points; ``D`` holds one of ``#$%&*|``; ``E`` identical to the
text of a smaller id anywhere in the table.

Defined results: null text is the empty text (fails A, and E if an empty text has a smaller id); a null
part is the part of the empty string; a null id is neither smaller nor larger than another, so its row
is no copy and makes none; rows with equal id and text are not copies of each other; a document counts
as good or toxic if any label row of its id says so; labels without an id belong to no document; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import written

FILTERS = "ABCDE"
#: Fixed values of the filters.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 100, 80, 10
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
MEASURES = ("docs", "good", "toxic")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_flags(text: str) -> int:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    data = text.encode()
    words = data.split()
    capitals, marks = (len(data) - len(data.translate(None, chars)) for chars in (CAPITALS, MARKS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PCT * len(words),
        100 * capitals > MAX_CAPITALS_PCT * len(text),
        marks > 0,
    )
    return sum(bit << k for k, bit in enumerate(fails))


def flagged(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``id, part, digest, flags`` of every document."""

    def judge(batches):
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1)
            flags, digests = [], []
            for t in batch.column(2):
                text = t.as_py()
                flags.append(text_flags(text))
                digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([ids, parts, pa.array(digests, pa.binary()), pa.array(flags, pa.int32())], ["id", "part", "digest", "flags"])

    columns = [
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ]
    return docs.select(*columns).mapInArrow(judge, "id long, part string, digest binary, flags int")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1).  Rows without an id are dealt out by digest."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    )
    said = said.withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    joined = rows.withColumn("spread", spread).join(said, ["id", "spread"], "left").drop("spread")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def contingency(rows: DataFrame) -> DataFrame:
    """``part, flags`` (five bits) and the counts ``docs, good, toxic``."""
    kind = ["digest", "part", "flags", "good", "toxic"]
    rows = rows.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    held = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min("id").alias("least"),
        F.min_by("n", F.when(F.col("id").isNotNull(), F.col("id"))).alias("n_least"),
    )
    held = written(held, "filter-texts")  # a row per text, part and labels
    often = held.groupBy("digest").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("kinds"))
    held = held.join(often.where("kinds > 1").drop("kinds"), "digest", "left")
    first = F.coalesce("first", "least") == F.col("least")
    originals = F.col("n_null") + F.when(first, F.col("n_least")).otherwise(F.lit(0))
    split = held.select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("flags", originals.alias("docs")), F.struct((F.col("flags") + 16).alias("flags"), (F.col("n") - originals).alias("docs")))).alias("f"),
    ).select("part", "f.flags", "f.docs", (F.col("f.docs") * F.col("good")).alias("good"), (F.col("f.docs") * F.col("toxic")).alias("toxic"))
    return split.groupBy("part", "flags").agg(*[F.sum(c).alias(c) for c in MEASURES])


def tensors(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts (measure x combination) as tensors with one axis per filter: 0 pass, 1 fail."""
    out = np.zeros((len(counts), 32), np.int64)
    out[:, flags] = counts
    # bit 0 is filter A: the last axis of a row-major reshape
    return out.reshape(len(counts), 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)


def selections(pick) -> np.ndarray:
    """Per order and step, the vector of each axis; ``pick(axis's place in the order, step)`` names it."""
    out = np.empty((len(ORDERS), len(FILTERS), len(FILTERS), 2), np.int64)
    for o, order in enumerate(ORDERS):
        for step in range(len(FILTERS)):
            for axis, name in enumerate(FILTERS):
                out[o, step, axis] = pick(order.index(name), step)
    return out


def contract(tensor: np.ndarray, selected: np.ndarray) -> np.ndarray:
    """Sum of the tensor's cells that the axes' vectors select, per order and step."""
    axes = [selected[:, :, k] for k in range(len(FILTERS))]
    return np.einsum("abcde,nsa,nsb,nsc,nsd,nse->ns", tensor, *axes, optimize=True)


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, order and step: what the step keeps, removes and wastes.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def audit(key: tuple, rows: pa.Table) -> pa.Table:
        docs, good, toxic = tensors(rows["flags"].to_numpy(), np.stack([rows[m].to_numpy() for m in MEASURES]))
        reached = selections(lambda place, step: PASS if place < step else FAIL if place == step else ALL)
        removed = contract(docs, reached)
        own = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # the step's filter
        columns = {
            "kept": contract(docs, selections(lambda place, step: PASS if place <= step else ALL)),
            "removed": removed,
            "redundant": contract(docs, selections(lambda place, step: FAIL if place == step else ALL)) - removed,
            "unique_fails": contract(docs, selections(lambda place, step: FAIL if place == step else PASS)),
            "good_lost": contract(good, reached),
            "toxic_lost": contract(toxic, reached),
            "shapley": np.bincount(own.ravel(), removed.ravel().astype(np.float64), len(FILTERS)).astype(np.int64)[own],
        }
        steps = len(FILTERS)
        out = [pa.array(key[0].as_py() for _ in range(removed.size)), pa.array(np.repeat(ORDERS, steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS)))]
        return pa.Table.from_arrays([*out, *[pa.array(columns[n].ravel()) for n in names]], ["part", "filter_order", "step", *names])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names)
    return counts.groupBy("part").applyInArrow(audit, schema)


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """Interactions of the five filters on ``docs``, per value of ``part_col``."""
    return interactions(contingency(labelled(flagged(docs, part_col=part_col), labels)))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM t GROUP BY t),
w AS (SELECT doc_id, part, t, first, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t JOIN m USING (t)),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, [
    len(w) < 100,
    100 * len(list_distinct(w)) < 80 * len(w),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > first, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: chr(64 + i)), '') AS filter_order, o, i AS step, o[i] AS own FROM o, x),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS now,
    len(list_filter(o[1 : step - 1], lambda i: fails[i])) > 0 AS before, len(list_filter(fails, lambda v: v)) AS n_fails
  FROM c, s),
a AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT before AND NOT now), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT before AND now), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE before AND now), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE now AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT before AND now), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT before AND now), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a
"""
