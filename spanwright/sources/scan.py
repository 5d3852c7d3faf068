"""Reading corpora, lines, index pages and mails; writing results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S

# Which files each kind of run looks at.
SUFFIXES = {
    "c": [".c", ".h"],
    "wrap": [".c", ".cc", ".h", ".def", ".md"],
    "rename": [".c", ".h", "gsstruct.def"],
    "options": [".opt"],
}
SKIPPED = {"wrap": ["/target.def"]}


def wanted(path: Column, kind: str, skip_tests: bool = False) -> Column:
    """Suffix filter of a kind of run, without the ``testsuite`` folders."""
    return has_suffix(path, SUFFIXES[kind], SKIPPED.get(kind, ()),
                      ["testsuite"] if skip_tests else ())


def spread(df: DataFrame) -> DataFrame:
    """Give each core a share of a small table.

    A file of few row groups is read by few tasks, which is slow for work on
    texts.  A table with a split for each core is left as it is, so what is
    shuffled here is less than a split a core.  ``df`` is a scan: counting its
    splits runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def has_suffix(path: Column, suffixes, skipped=(), pruned=()) -> Column:
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | path.endswith(s)
    for s in skipped:
        keep = keep & ~path.endswith(s)
    for folder in pruned:
        keep = keep & ~path.rlike(f"(^|/){re.escape(folder)}/")
    return keep


def _below(path: Column, root: str | None) -> Column:
    """The path below a folder, however the scheme of the two is written."""
    if not root:
        return path
    inside = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    return F.regexp_extract(path, f"\\Q{inside}/\\E(.*)$", 1)


def listing(spark: SparkSession, folder: str, glob: str | None = None, root: str | None = None) -> DataFrame:
    """Files below a folder as ``path, size``; no file is opened for it."""
    options = {"recursiveFileLookup": True} | ({"pathGlobFilter": glob} if glob else {})
    files = spark.read.format("binaryFile").options(**options).load(folder)
    return files.select(_below(F.col("_metadata.file_path"), root).alias("path"), F.col("_metadata.file_size").alias("size"))


def read_corpus(spark: SparkSession, folder: str, glob: str | None = None,
                keep: Column | None = None, root: str | None = None) -> DataFrame:
    """Files below a folder as ``path, text``, one row per file.

    ``glob`` and ``keep``, a filter on the ``path`` and ``size`` of files, are
    looked at when the folder is listed: only files that pass are opened.
    With ``root``, a folder above the files, paths are relative to it, as rule
    lists with bare file names need.
    """
    options = {"wholetext": True, "recursiveFileLookup": True}
    if glob:
        options["pathGlobFilter"] = glob
    df = spark.read.text(folder, **options).select(
        _below(F.col("_metadata.file_path"), root).alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    return (df if keep is None else df.where(keep)).select("path", "text")


def lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row per line: ``keep, line_no`` (from 1), ``start_off, end_off, line``."""
    return (S.unnest_fields(df, keep, S.line_spans(F.col(text)))
            .withColumnRenamed("start", "start_off").withColumnRenamed("end", "end_off"))


def as_corpus(df: DataFrame, path: Column, text: Column, keep: list[str] = ()) -> DataFrame:
    """Any table with a text as ``path, folder, ext, text``."""
    return df.select(*keep, path.alias("path"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"),
                     F.regexp_extract(path, r"(\.[^./]*)$", 1).alias("ext"), text.alias("text"))


ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
MAIL_ROW = (r'(?is)<tr\b[^>]*>.*?<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
            r'.*?<td\b[^>]*align\s*=\s*"right"[^>]*>(.*?)</td>')


def index_rows(df: DataFrame, keep: list[str], html: str, pattern: str = ANCHOR,
               fields: tuple[str, ...] = ("href", "subject")) -> DataFrame:
    """Rows of an index page in chronological order, the last of the page
    first: ``keep, ord`` and the groups of the pattern."""
    segs = S.segments(F.col(html), pattern, len(fields))
    return (S.unnest(df, keep, F.reverse(segs), "e", "ord")
            .select(*keep, "ord", *[F.col(f"e.g{i + 1}").alias(f) for i, f in enumerate(fields)]))


def mail_index(df: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Mails of an archive page: ``keep, ord, href, subject, sender``."""
    return index_rows(df, keep, html, MAIL_ROW, ("href", "subject", "sender"))


def mail_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``headers``, ``body`` and ``subject`` of a mail.  A folded subject
    keeps its newlines; body and subject are null where there is none."""
    parts = F.split(F.col(text), "\n\n", 2)
    subject = r"(?im)^Subject:[ \t]*((?:.*)(?:\n[ \t].*)*)"
    headers = F.element_at(parts, 1)
    return (df.withColumn("headers", headers)
            .withColumn("body", F.try_element_at(parts, F.lit(2)))
            .withColumn("subject", F.when(headers.rlike(subject), F.regexp_extract(headers, subject, 1))))


def write_changed(df: DataFrame, before: str, after: str, folder: str,
                  partition_by: list[str] = ()) -> None:
    """Changed texts to a new place, as parquet; an existing folder is an error.

    With ``partition_by`` the rows are rebalanced first: folders get few files,
    and the rows of a large folder are split over many tasks.
    """
    changed = df.where(~F.col(before).eqNullSafe(F.col(after)))
    if partition_by:
        changed = changed.hint("rebalance", *[F.col(c) for c in partition_by])
    changed.write.mode("errorifexists").partitionBy(*partition_by).parquet(folder)


def write_named(df: DataFrame, path: str, text: str, folder: str) -> None:
    """Texts under their base names in another folder: parquet of ``name, text``."""
    (df.select(F.regexp_extract(F.col(path), r"([^/]*)$", 1).alias("name"), F.col(text).alias("text"))
     .write.mode("errorifexists").parquet(folder))


def write_logs(parts: DataFrame, owner: str, folder: str) -> None:
    """Logs as text, one folder per owner.  Parts are range-sorted, so a long
    log spreads over files whose names keep its order.  The writer ends each
    part with a newline, so the one that a part has goes."""
    (parts.repartitionByRange(owner, "part").sortWithinPartitions(owner, "part")
     .select(owner, F.regexp_replace("text", r"\n\z", "").alias("text")).write.mode("errorifexists").partitionBy(owner).text(folder))


def load_lookup(df: DataFrame, members: str, values: list[str], key: str) -> DataFrame:
    """One row per key from rows that share values: ``members`` is an array of
    keys; the least values of a key count."""
    return (df.select(F.explode(members).alias(key), F.struct(*values).alias("__v"))
            .groupBy(key).agg(F.min("__v").alias("__v")).select(key, "__v.*"))
