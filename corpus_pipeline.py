"""A corpus made ready for training: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of their input, whatever these are.  Rows with null or empty
texts, repeated rows and empty tables go through every stage; what becomes of
them is said there.  Whoever writes a stage's DataFrame, its texts go to Python
workers in batches of few rows (``in_small_batches``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import languageid, mixing, sentencepiece, simhash, suffixes
from spanwright.llm.queries import TOKENIZERS
from spanwright.llm.store import Scratch, in_small_batches, released


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain.  Null and empty texts, texts without
    a letter and near ties go; without a labelled row all go."""
    return in_small_batches(languageid.accepted(docs, languageid.train(docs, F.lit(True))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours: the smallest id.
    Empty texts are one group; rows without an id stay."""
    return in_small_batches(simhash.one_per_group(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur again.
    Characters that such a string cuts in two go whole; ``n_chars``, if there
    is one, is counted anew.  A text of which nothing is left is empty, not
    dropped; a null text is empty."""
    plain = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    name = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    others = [c for c in plain.columns if c != name["text"]]
    got = suffixes.without_repeats(plain, others, name["doc_id"], name["text"], with_text=True)
    got = got.withColumnRenamed("kept", name["text"])
    if "n_chars" in name:
        got = got.withColumn(name["n_chars"], F.length(name["text"]).cast(dict(docs.dtypes)["n_chars"]))
    return in_small_batches(got.select(*plain.columns).toDF(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, rounded to whole
    copies, in training order."""
    return mixing.trained_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, in training order, with its ``copy`` and
    ``position``; null and empty texts have none.  Files are not read in order,
    so the order is made here."""
    column = {c: F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)}
    rows = mixing.placed(docs).select(column["doc_id"], column["source"], "copy", "position", column["text"])
    return in_small_batches(sentencepiece.encode(rows, os.path.join(TOKENIZERS, "piece_bpe_32k.model"), ["doc_id", "source", "copy", "position"]))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# Compression, fingerprints and token ids have no SQL; tests/llm compares the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        # Once a stage is written, neither its input nor its operators' tables are read again.
        with released(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name, texts=True)
        if before:
            scratch.free(docs, before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
