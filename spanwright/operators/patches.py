"""Patch mails, diffs and archives: parsing into rows, then joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from . import ordered, prefixes
from .quality import checked, problem
from .sizing import lookup_join

SUBJECT = r"(?s)^\[PATCH ([0-9]+)/([0-9]+)\] (.+)"


def with_subject(df: DataFrame, subject: str) -> DataFrame:
    """Adds ``patch_no``, ``total`` and ``summary`` of ``[PATCH n/m] summary``;
    all null for another subject."""
    part = lambda i: F.nullif(F.regexp_extract(F.col(subject), SUBJECT, i), F.lit(""))
    return (df.withColumn("patch_no", part(1).cast("int")).withColumn("total", part(2).cast("int"))
            .withColumn("summary", F.regexp_replace(part(3), r"\n", "")))


def split_at(text: Column, separator: str) -> tuple[Column, Column]:
    """Text before and after the first separator; after is null without one."""
    at = F.instr(text, separator)
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    after = F.when(at > 0, F.substring(text, at + len(separator), F.length(text)))
    return before, after


def section_lines(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Body lines of a patch mail with their ``section`` and ``kind``.

    A line ``folder/`` opens the section of the folder, ``Conflicts:`` opens
    the conflicts, and lines before any are leading text.  The opening lines
    are dropped.  A folder that is named again goes on with its section.
    """
    folder = F.nullif(F.regexp_extract(F.col(line), r"^(\S*)/$", 1), F.lit(""))
    opener = (F.when(F.col(line) == "Conflicts:", F.struct(F.lit("conflicts").alias("kind"),
                                                           F.lit("").alias("section")))
              .when(folder.isNotNull() | (F.col(line) == "/"),
                    F.struct(F.lit("section").alias("kind"), F.coalesce(folder, F.lit("")).alias("section"))))
    marked = lines.withColumn("__opener", opener)
    carried = ordered.carry_forward(marked, keys, order, {"__at": F.col("__opener")})
    return (carried.where(F.col("__opener").isNull())
            .withColumn("kind", F.coalesce("__at.kind", F.lit("leading")))
            .withColumn("section", F.coalesce("__at.section", F.lit("")))
            .drop("__opener", "__at"))


def sections(lines: DataFrame, keys: list[str], order: str, line: str,
             part_rows: int = 4096) -> DataFrame:
    """Sections as texts, ``keys, kind, section, part, text``."""
    return ordered.ordered_parts(section_lines(lines, keys, order, line),
                                 keys + ["kind", "section"], order, F.col(line), "\n", part_rows).drop("first")


# Kinds of diff lines and the prefix that tells them.
DIFF_KINDS = [
    ("file", "diff --git"), ("index", "index "), ("new", "new file mode"),
    ("deleted", "deleted file mode"), ("old_path", "--- a/"), ("new_path", "+++ b/"),
    ("no_path", "--- /dev/null"), ("no_path", "+++ /dev/null"), ("hunk", "@"),
]


def line_kind(line: Column) -> Column:
    kind = F.lit("body")
    for name, prefix in reversed(DIFF_KINDS):
        kind = F.when(line.startswith(prefix), F.lit(name)).otherwise(kind)
    return kind


def diff_lines(lines: DataFrame, keys: list[str], order: str, line: str, repeats: bool = False,
               chunk_rows: int | None = None) -> DataFrame:
    """Lines of diffs with ``kind``, ``block`` (the line that opened the file,
    null in the preamble), ``path`` and ``status`` as they stand at the line.

    Indented lines of the preamble are ``message``, the others ``preamble``.
    In a new or deleted file hunk lines count as body.  With ``repeats`` the
    column of that name is true for a hunk whose scope is that of the hunk
    before it in the file.  All come from one pass over the lines.
    """
    text = F.col(line)
    raw = lines.withColumn("__kind", line_kind(text))
    kind = F.col("__kind")
    # A new file resets path, status and hunk: the struct is set, its field is null.
    opens = kind == "file"
    path = F.when(opens, F.lit(None)).otherwise(F.expr(f"substring(`{line}`, 7)"))
    status = F.when(opens, F.lit("changed")).otherwise(kind)
    scope = context_scope(F.regexp_extract(text, HUNK, 5))
    # Where a hunk line counts, all hunk lines before it in the file do: a file
    # that has become new or deleted stays so.
    hunk = F.when(opens, F.lit(None)).when(kind == "hunk", scope)
    known = ordered.carry_once(raw, keys, order, {
        "block": F.when(opens, F.col(order)),
        "__path": F.when(kind.isin("file", "old_path", "new_path"), F.struct(path.alias("v"))),
        "__status": F.when(kind.isin("file", "new", "deleted"), status)},
        {"__hunk": F.when(kind.isin("file", "hunk"), F.struct(hunk.alias("v")))} if repeats else {}, chunk_rows)
    inside = F.col("block").isNotNull()
    done = (known
            .withColumn("path", F.when(inside, F.col("__path.v")))
            .withColumn("status", F.when(inside, F.col("__status")))
            .withColumn("kind", F.when(~inside, F.when(text.startswith(" "), "message").otherwise("preamble"))
                        .when((kind == "hunk") & (F.col("status") != "changed"), "body").otherwise(kind)))
    if repeats:
        done = done.withColumn("repeats", (F.col("kind") == "hunk") & F.coalesce(F.col("__hunk.v") == scope, F.lit(False)))
    return done.drop("__kind", "__status", "__path", "__hunk")


HUNK = r"^@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@ ?(.*)$"


def with_hunk(df: DataFrame, line: str) -> DataFrame:
    """Adds ``old_start, old_len, new_start, new_len, scope`` of a hunk header.
    A length that is left out is 1."""
    number = lambda i: F.nullif(F.regexp_extract(F.col(line), HUNK, i), F.lit("")).cast("int")
    length = lambda i: F.when(F.col(line).rlike(HUNK), F.coalesce(number(i), F.lit(1)))
    return (df.withColumn("old_start", number(1)).withColumn("old_len", length(2))
            .withColumn("new_start", number(3)).withColumn("new_len", length(4))
            .withColumn("scope", context_scope(F.regexp_extract(F.col(line), HUNK, 5))))


def context_scope(context: Column) -> Column:
    """Scope named by the text after a hunk header: ``struct x`` whole, the
    second word after ``proc``, else the first word, or ``UNKNOWN``."""
    parts = F.split(context, " ")
    first = F.element_at(parts, 1)
    return (F.when(F.coalesce(context, F.lit("")) == "", F.lit("UNKNOWN"))
            .when(first == "struct", context)
            .when(first == "proc", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("UNKNOWN")))
            .otherwise(first))


def drop_repeats(df: DataFrame, keys: list[str], order: str, value: str,
                 chunk_rows: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before in the key; the first stays."""
    return (ordered.lag(df, keys, order, F.col(value), "__before", chunk_rows)
            .where(F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col(value)))
            .drop("__before"))


def status_text(status: Column, path: Column, new: str = "new", deleted: str = "deleted") -> Column:
    """``New file.``, ``Deleted test.`` and so on; null for a changed file."""
    thing = F.when(path.contains("testsuite"), "test.").otherwise("file.")
    return (F.when(status == new, F.concat(F.lit("New "), thing))
            .when(status == deleted, F.concat(F.lit("Deleted "), thing)))


def owner_headers(files: DataFrame, keys: list[str], order: str, owner: str,
                  chunk_rows: int | None = None) -> DataFrame:
    """Adds ``header``, ``owner/ChangeLog:`` where the owner changes."""
    return (ordered.lag(files, keys, order, F.col(owner), "__before", chunk_rows)
            .withColumn("header", F.when(
                F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col(owner)),
                F.concat(F.col(owner), F.lit("/ChangeLog:"))))
            .drop("__before"))


def match_mails(patches: DataFrame, mails: DataFrame, patch: str, summary: str, subject: str,
                order: str, total: int | None = None) -> DataFrame:
    """First mail, by ``order``, whose subject is ``[PATCH n/total] `` and then
    text that starts with the summary of the patch, as the struct ``mail``.

    Both sides lose their prefix and are sorted together once
    (:func:`prefixes.first_below`).  Patches without a mail have a ``problem``.
    """
    series = r"[0-9]+" if total is None else str(total)
    pattern = rf"(?s)^(\[PATCH [0-9]+/{series}\] )(.*)"
    text = F.col(subject)
    others = [c for c in mails.columns if c != subject]
    series_mails = mails.where(text.rlike(pattern)).select(
        *others, F.regexp_extract(text, pattern, 1).alias("__start"), F.regexp_extract(text, pattern, 2).alias(summary))
    found = prefixes.first_below(patches, series_mails.select(
        F.struct(*others).alias("__mail"), F.col(order).alias("__ord"), "__start", summary), summary, "__ord")
    whole = [F.concat("found.__start", F.col("found")[summary]).alias(c) if c == subject else F.col("found.__mail")[c].alias(c)
             for c in mails.columns]
    joined = found.select(*patches.columns, F.when(F.col("found").isNotNull(), F.struct(*whole)).alias("mail"))
    return checked(joined, (F.col("mail").isNull(), "no mail for this patch"))


def first_with(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """First row by ``order`` for each value: ``name, first``."""
    return df.groupBy(value.alias(name)).agg(F.min(order).alias("first"))


def with_lookup(df: DataFrame, table: DataFrame, on: list[str], required: list[str],
                spread_by: list[str] | None = None) -> DataFrame:
    """Left join with a lookup; ``problem`` names the first required column
    that is missing or empty."""
    joined = lookup_join(df, table, on, "left", spread_by)
    return joined.withColumn("problem", problem(*[
        (F.col(c).isNull() | (F.col(c).cast("string") == ""), f"{c} not found") for c in required]))


def annotation(subject: Column, mail_url: Column, source: str, reviewer: str,
               approval: Column, approval_url: Column) -> Column:
    """Message that ties a patch to its first mail and quotes the approval."""
    return F.concat_ws(
        "\n", F.lit("This corresponds to:"), F.concat(F.lit("  "), subject),
        F.concat(F.lit("  "), mail_url), F.lit(f"from the original {source}"), F.lit(""),
        F.lit(f"That earlier patch was approved by {reviewer}:"), T.quoted(approval),
        F.concat(F.lit("in "), approval_url), F.lit(""), F.lit(""))


def series_gaps(found: DataFrame, number: str, first: Column, last: Column) -> DataFrame:
    """Numbers of ``first..last`` that are missing or repeated: ``number, n``.

    The expected numbers are generated by Spark; ``first`` and ``last`` are
    aggregates or literals.
    """
    bounds = found.agg(first.cast("bigint").alias("lo"), last.cast("bigint").alias("hi"))
    # One task makes the starts of blocks; the blocks are filled by all tasks.
    starts = bounds.select("hi", F.explode(F.sequence(
        "lo", "hi", F.lit(1 << 16).cast("bigint"))).alias("at")).repartition("at")
    expected = starts.select(F.explode(F.sequence(
        "at", F.least(F.col("at") + (1 << 16) - 1, F.col("hi")))).alias("number"))
    counted = (found.select(F.col(number).cast("bigint").alias("number"))
               .groupBy("number").agg(F.count("*").alias("n")))
    return (expected.join(counted, "number", "left")
            .select("number", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
            .where("n != 1"))
