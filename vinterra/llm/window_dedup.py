"""Substring deduplication: Rabin-Karp hashes of every 50-word window, counted in Spark.

A word is removed if a window that covers it also starts in a document with a smaller id.

Counting a row per window would shuffle more than the corpus itself, so windows are first grouped
by their minimiser: the least hash among the ``WINDOW - ANCHOR + 1`` runs of ``ANCHOR`` words in
the window.  Equal windows have equal minimisers, and neighbouring windows mostly share theirs, so
a document has few distinct ones.

1. Distinct minimisers per document are aggregated to (smallest, largest document).  Those of one
   document only are dropped, and with them all windows that cannot repeat: nothing is lost.  The
   hash of the whole word sequence joins them, so an exact copy of a smaller document is settled
   here.
2. The remaining minimisers go back to their documents.  Windows under them are hashed, and Spark
   aggregates each window hash to its smallest document.
3. Windows of later documents join that table; their start positions come back per document,
   merge into maximal intervals, and the intervals are cut out.

Both joins are on hashes, so AQE can split a passage that a third of the documents share; the
aggregates combine before the shuffle.  A hash has 64 bits; nothing else is approximate.

Defined results: null and empty texts have no words and keep none; a null id counts as larger than
any other, and null ids are equal to each other; rows of one id are not compared with each other;
repeated rows get the same result each; an empty table gives an empty one; extra columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import record_batches, written
from vinterra.llm.super_minhash import SALTS, each_salt, salt_bit
from vinterra.llm.words_np import Hasher, sliding_min

WINDOW = 50
ANCHOR = 16
NO_ID = (1 << 63) - 1


def hashed_words(hasher: Hasher, text: bytes | None):
    return hasher.words(np.frombuffer(text or b"", np.uint8))[0]


def minimisers(hasher: Hasher, words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Minimiser of each window (empty if the text is shorter than one)."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    return sliding_min(hasher.windows(words, anchor), window - anchor + 1).view(np.int64)


def whole_key(hasher: Hasher, words: np.ndarray) -> int:
    return int(np.array([hasher.whole(words)], np.uint64).view(np.int64)[0])


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal removal intervals ``[from, to)`` of windows at these starts."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    first = starts[np.concatenate([[0], breaks + 1])]
    last = starts[np.concatenate([breaks, [len(starts) - 1]])]
    return [(int(a), int(b) + window) for a, b in zip(first, last)]


def cut(text: bytes | None, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """``(words, words removed, kept words joined by a space)``."""
    words = (text or b"").split()
    kept, at, gone = [], 0, 0
    for a, b in spans:
        kept += words[at:a]
        gone += b - a
        at = b
    return len(words), gone, b" ".join(kept + words[at:])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_ = F.col(id_col).cast("long")
    return docs.select(F.coalesce(id_, F.lit(NO_ID)).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``m, d, t``: distinct minimisers of each document (id and text hash), and the hash of its whole word sequence."""

    def find(batches):
        hasher = Hasher()
        for batch in batches:
            ms, ds, ts, held = [], [], [], 0
            for d, t, text in zip(*batch.columns):
                words = hashed_words(hasher, text.as_py())
                if len(words) < window:
                    continue
                m = np.unique(minimisers(hasher, words, window, anchor))
                ms += [m, np.array([whole_key(hasher, words)], np.int64)]
                ds.append(np.full(len(m) + 1, d.as_py(), np.int64))
                ts.append(np.full(len(m) + 1, t.as_py(), np.int64))
                held += len(m)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ms, ds, ts)], ["m", "d", "t"])
                    ms, ds, ts, held = [], [], [], 0
            if ms:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ms, ds, ts)], ["m", "d", "t"])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(find, "m long, d long, t long")


CANDIDATES = "d long, key long, n_words long, n_removed long, kept_sha256 string, kept binary, text binary, h array<long>, at array<int>"


def _candidates(marked: DataFrame, window: int, anchor: int, with_text: bool) -> DataFrame:
    """Per document: its result if that is settled, else its text; and its windows that may repeat.

    ``at`` holds the start of a window if a smaller document may hold it too, else -1.
    """
    schema = pa.schema(
        [("d", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
         ("kept", pa.binary()), ("text", pa.binary()), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]
    )
    none = np.zeros(0, np.int64)

    def one(hasher, d, text, early, late):
        words = hashed_words(hasher, text)
        key = whole_key(hasher, words)
        if len(words) >= window and (late == key).any():
            return d, key, len(words), len(words), hashlib.sha256(b"").hexdigest(), b"" if with_text else None, None, none, none
        h, at = none, none
        if len(early) or len(late):
            m = minimisers(hasher, words, window, anchor)
            later = np.isin(m, late)
            which = np.flatnonzero(later | np.isin(m, early))
            h = hasher.windows(words, window).view(np.int64)[which]
            at = np.where(later[which], which, -1).astype(np.int32)
        if (at >= 0).any():
            return d, key, len(words), None, None, None, text, h, at
        n, gone, kept = cut(text, [])
        return d, key, n, gone, hashlib.sha256(kept).hexdigest(), kept if with_text else None, None, h, at

    def rows(batches):
        hasher = Hasher()
        for batch in batches:
            for d, text, early, late in zip(*batch.columns):
                marks = (x.values.to_numpy() if x.is_valid else none for x in (early, late))
                yield one(hasher, d.as_py(), text.as_py(), *marks)

    return marked.mapInArrow(lambda batches: record_batches(rows(batches), schema), CANDIDATES)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept, spans``.

    ``spans`` are the removed word intervals of documents that lose a part (null for those that lose
    all or nothing); ``kept`` is the text left, or null if ``with_text`` is false.
    """
    narrow = _narrow(docs, id_col, text_col)
    anchors = written(_anchors(narrow, window, anchor), "window-anchors")
    shared = anchors.groupBy("m").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    met = anchors.join(shared, "m")
    # per text, as a missing or repeated id may stand on any number of rows; repeated rows add nothing to a set
    marks = met.groupBy("d", "t").agg(
        F.collect_set(F.when(F.col("d") == F.col("first"), F.col("m"))).alias("early"),
        F.collect_set(F.when(F.col("d") > F.col("first"), F.col("m"))).alias("late"),
    )
    marked = narrow.join(marks, ["d", "t"], "left").select("d", "text", "early", "late")
    found = written(_candidates(marked, window, anchor, with_text), "window-candidates")
    # a hash is met by key and salt, for the salts it occurs with: a passage of very many documents is spread
    salt = F.pmod(F.xxhash64("d", "key"), F.lit(SALTS)).cast("int").alias("salt")
    firsts = found.select("d", salt, F.explode("h").alias("h")).groupBy("h")
    firsts = firsts.agg(F.min("d").alias("first"), F.max("d").alias("last"), F.bit_or(salt_bit("salt")).alias("salts"))
    firsts = firsts.where("first < last").select("h", "first", each_salt("salts").alias("salt"))
    later = found.where("text is not null").select("d", "key", salt, F.explode(F.arrays_zip("h", "at")).alias("x"))
    later = later.select("d", "key", "salt", "x.h", "x.at").where("at >= 0")
    gone = later.join(firsts, ["h", "salt"]).where("first < d").groupBy("d", "key").agg(F.collect_set("at").alias("starts"))
    open_ = found.where("text is not null").select("d", "key", "text").join(gone, ["d", "key"], "left").select("d", "text", "starts")
    settled = found.where("text is null").select("d", "n_words", "n_removed", "kept_sha256", "kept")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
         ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    )

    def rows(batches):
        for batch in batches:
            for d, text, starts in zip(*batch.columns):
                spans = intervals(starts.values.to_numpy(), window) if starts.is_valid else []
                n, lost, kept = cut(text.as_py(), spans)
                yield d.as_py(), n, lost, hashlib.sha256(kept).hexdigest(), kept if with_text else None, [{"start": a, "end": b} for a, b in spans]

    cut_ = open_.mapInArrow(lambda batches: record_batches(rows(batches), schema), RESULT)
    settled = settled.select(F.col("d").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"))
    out = cut_.unionByName(settled)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (h) WHERE first < doc_id),
u AS (SELECT doc_id, q, w[q] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM u ANTI JOIN r USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
