"""Token counts: an exact histogram of encoded lengths and what it answers.

The texts are encoded once.  Only the histogram, one row per length that
occurs, is kept; sums over it give totals, quantiles and truncated totals for
every context limit without another look at the texts.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, map_texts

# The split pattern that belongs to the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the pattern's \s means it.  The pattern looks ahead, so a long run
# of it would exhaust the stack of the encoder's regular expressions.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 1000
# Lengths are summed in chunks of this many values of the length.
CHUNK = 512


def rank_encoder(vocabulary: bytes, pattern: str = PATTERN):
    """A maker of functions from texts to token counts, from a rank file.

    The file's bytes (a few MB) travel with the task, so executors need not see
    the driver's folders.  A run of ``LONG_RUN`` or more white spaces is taken
    out of the text before it is split, with what the pattern would make of it:
    one piece, but for the last white space where a word follows.  With another
    pattern texts are encoded as they are."""
    def make():
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        runs = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")

        def count(text: str) -> int:
            if pattern != PATTERN:
                return len(encoding.encode_ordinary(text))
            n, at = 0, 0
            for run in runs.finditer(text):
                end = run.end() - (run.end() < len(text))
                n += len(encoding.encode_ordinary(text[at:run.start()])) + len(whole.encode_ordinary(text[run.start():end]))
                at = end
            return n + len(encoding.encode_ordinary(text[at:]))
        return lambda texts: {"n_tokens": [count(t) if t else 0 for t in texts]}
    return make


def token_lengths(docs: DataFrame, vocabulary_path: str, keep: list[str] = (), text: str = "text",
                  pattern: str = PATTERN) -> DataFrame:
    """``keep`` and ``n_tokens`` of each whole text; null and empty texts have 0.
    Runs of white space may be of any length."""
    make = rank_encoder(Path(vocabulary_path).read_bytes(), pattern)
    return map_texts(docs, list(keep), text, "n_tokens long", make)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: one row per length, counted map-side first."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """What each length would give as a context limit.

    Per ``context_limit`` (a length that occurs): ``n_docs`` of that length,
    ``docs_within`` and ``docs_longer``, ``tokens_within`` (of documents that
    fit), ``tokens_truncated`` (all documents, cut at the limit),
    ``tokens_total`` and ``quantile`` (share of documents that fit).  Suffix
    sums: inside a chunk of lengths, then over the one row per chunk.  An empty
    histogram gives no rows.  ``histogram`` is read twice: pass a kept table.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / CHUNK).alias("chunk"),
                         (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    above = Window.orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = (h.groupBy("chunk").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
              .select(F.col("chunk").alias("c"),
                      F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
                      F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
                      F.sum("d").over(Window.orderBy("chunk").rowsBetween(
                          Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
                      F.sum("t").over(Window.orderBy("chunk").rowsBetween(
                          Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens")))
    longer = (Window.partitionBy("chunk").orderBy(F.col("n_tokens").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = h.select("*", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_in"),
                      F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_in"))
    docs_longer = F.col("docs_in") + F.col("docs_above")
    tokens_longer = F.col("tokens_in") + F.col("tokens_above")
    return inside.join(chunks, F.col("chunk") == F.col("c")).select(
        F.col("n_tokens").alias("context_limit"), "n_docs",
        (F.col("all_docs") - docs_longer).alias("docs_within"),
        docs_longer.alias("docs_longer"),
        (F.col("all_tokens") - tokens_longer).alias("tokens_within"),
        (F.col("all_tokens") - tokens_longer + docs_longer * F.col("n_tokens")).alias("tokens_truncated"),
        F.col("all_tokens").alias("tokens_total"),
        ((F.col("all_docs") - docs_longer) / F.col("all_docs")).alias("quantile"))


def token_report(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Encode all texts once, then :func:`context_report`."""
    scratch = Scratch(docs.sparkSession, "tokencount")
    lengths = token_lengths(docs, vocabulary_path, [], text)
    return context_report(scratch.keep(length_histogram(lengths), "histogram"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, tokens_truncated, docs_longer`` for any given limits."""
    spark = histogram.sparkSession
    asked = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])).alias("context_limit")
    rows = histogram.select("n_tokens", "n_docs", asked)
    got = rows.groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_truncated"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_longer"))
    every = spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    return every.join(got, "context_limit", "left").na.fill(0)
