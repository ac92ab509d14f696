"""Token counts: an exact histogram of encoded lengths answers every context limit.

Each task encodes its texts with a public byte-level BPE vocabulary; documents aggregate to one
row per encoded length.  Suffix sums over that histogram give, for any limit ``L``: documents and
tokens at or above it, the total cut at ``L`` tokens per document, and quantiles.

Suffix sums run in two levels (runs of ``RUN`` lengths, then inside a run), so no task sees the
whole histogram of a corpus with many lengths.

Defined results: a null or empty text has length 0; repeated rows count each time; an empty table
gives an empty histogram; other columns are not read.  Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinterra.llm.common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits a text before merging (fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUN = 4096
#: A text above this many characters is encoded in parts.
PART_CHARS = 200_000
#: A place where the pattern always begins a new piece: one space after a letter, before a letter.
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

#: Long runs of (Unicode) white space: the pattern's matcher would overflow its stack on them.
BLANK_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{257,}")


def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS):
    """Pieces of a very long text, cut only where the tokens stay the same."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def n_tokens(encoding, text: str) -> int:
    """Number of tokens of a text of any length.

    The pattern makes one piece of a run of white space without its last character (which may
    belong to the next piece) or, at the end of a text, of the whole run; long runs are encoded so.
    """
    total = at = 0
    for run in BLANK_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += sum(len(encoding.encode_ordinary(p)) for p in parts(text[at : run.start()]))
        total += len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + sum(len(encoding.encode_ordinary(p)) for p in parts(text[at:]))


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every row."""

    def count(batches):
        encoding = encoder(vocabulary)
        for batch in batches:
            lengths = [n_tokens(encoding, t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: histograms of parts of a corpus merge by adding ``n_docs``."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per occurring length, taken as a context limit.

    ``docs_at_least``, ``tokens_at_least``: documents of at least that length and their tokens;
    ``docs_up_to``, ``tokens_up_to``: the others and this length;
    ``truncated_tokens``: total if every document is cut at the limit;
    ``docs_cut``: documents longer than the limit.  All exact.
    """
    hist = written(hist, "length-histogram")  # read three times below; the corpus is encoded once
    h = hist.withColumns({"run": F.floor(F.col("n_tokens") / RUN), "n": F.col("n_docs"), "t": F.col("n_docs") * F.col("n_tokens")})
    runs = h.groupBy("run").agg(F.sum("n").alias("run_n"), F.sum("t").alias("run_t"))
    later = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    runs = runs.select(
        "run",
        F.coalesce(F.sum("run_n").over(later), F.lit(0)).alias("later_n"),
        F.coalesce(F.sum("run_t").over(later), F.lit(0)).alias("later_t"),
        F.sum("run_n").over(every).alias("all_n"),
        F.sum("run_t").over(every).alias("all_t"),
    )
    inside = Window.partitionBy("run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(runs, "run").select(
        "n_tokens",
        "n_docs",
        (F.col("later_n") + F.sum("n").over(inside)).alias("docs_at_least"),
        (F.col("later_t") + F.sum("t").over(inside)).alias("tokens_at_least"),
        "all_n",
        "all_t",
    )
    cut = F.col("docs_at_least") - F.col("n_docs")
    up_to = F.col("all_t") - F.col("tokens_at_least") + F.col("n_docs") * F.col("n_tokens")
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_n") - cut).alias("docs_up_to"),
        up_to.alias("tokens_up_to"),
        cut.alias("docs_cut"),
        (up_to + cut * F.col("n_tokens")).alias("truncated_tokens"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, n_docs, total_tokens, truncated_tokens, docs_cut`` for any limits, in one pass."""
    n, length = F.col("n_docs"), F.col("n_tokens")
    per = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    return (
        hist.select("n_docs", "n_tokens", per)
        .groupBy("context_limit")
        .agg(
            F.sum(n).alias("n_docs"),
            F.sum(n * length).alias("total_tokens"),
            F.sum(n * F.least(length, F.col("context_limit"))).alias("truncated_tokens"),
            F.sum(F.when(length > F.col("context_limit"), n).otherwise(0)).alias("docs_cut"),
        )
    )


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """``probability, n_tokens``: the smallest length with at least that share of documents up to it."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("probability")
    total = F.col("docs_up_to") + F.col("docs_cut")
    return (
        sums.select("n_tokens", (F.col("docs_up_to") / total).alias("share"), p)
        .where(F.col("share") >= F.col("probability"))
        .groupBy("probability")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
