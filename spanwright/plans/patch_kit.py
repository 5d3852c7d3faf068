"""Whole run over a patch series: mails, approvals and annotated patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import patches as P
from ..operators import quality
from ..operators.changelog import owners
from ..operators.sizing import checkpointed, lookup_join
from ..sources import scan


def annotate(patches: DataFrame, mails: DataFrame, approvals: DataFrame, index_url: str, total: int,
             source: str, reviewer: str, skip: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Patches ``path, content`` with the message that ties each to its first
    mail ``ord, subject, href`` and its approval ``subject, url, text``.

    Set apart with the reason: patches without a mail or without an approval.
    """
    parsed = P.with_subject(scan.mail_parts(patches, "content"), "subject")
    for part in skip:
        parsed = parsed.where(~F.coalesce(F.col("subject").contains(part), F.lit(False)))
    mailed = P.match_mails(parsed, mails, "path", "summary", "subject", "ord", total)
    keyed = quality.sound(mailed).withColumn("mail_subject", F.col("mail.subject"))
    table = approvals.select(F.col("subject").alias("mail_subject"), F.col("url").alias("approval_url"),
                             F.col("text").alias("approval"))
    known = P.with_lookup(keyed, table, ["mail_subject"], ["approval_url", "approval"], ["path"])
    message = P.annotation(F.col("mail_subject"), T.absolute_url(F.lit(index_url), F.col("mail.href")),
                           source, reviewer, F.col("approval"), F.col("approval_url"))
    done = known.where("problem IS NULL").select(
        "path", "subject", "patch_no", "summary",
        F.concat(F.col("headers"), F.lit("\n\n"), message, F.coalesce("body", F.lit(""))).alias("content"))
    columns = ["path", "subject", "problem"]
    return done, known.where("problem IS NOT NULL").select(*columns).union(mailed.where("problem IS NOT NULL").select(*columns))


def log_sections(patches: DataFrame) -> DataFrame:
    """Log sections of patches ``path, content``: ``path, kind, section, part, text``."""
    before, _ = P.split_at(F.col("body"), "\n---\n")
    bodies = scan.mail_parts(patches, "content").select("path", before.alias("text"))
    lines = scan.lines(bodies, ["path"], "text")
    return P.sections(lines, ["path"], "line_no", "line")


def draft(diffs: DataFrame, dirs: DataFrame, keep_repeats: bool = False) -> DataFrame:
    """Log draft of diffs ``diff_id, text``: rows of files and hunks with
    ``owner_dir``, ``status_text`` and ``scope``.

    The diffs are read once; files and hunks come from one aggregation over the
    parsed lines, and owners are looked up for distinct paths."""
    lines = scan.lines(diffs, ["diff_id"], "text")
    parsed = P.with_hunk(P.diff_lines(lines, ["diff_id"], "line_no", "line", repeats=True), "line")
    is_hunk = F.col("kind") == "hunk"
    wanted = is_hunk if keep_repeats else is_hunk & ~F.col("repeats")
    is_file = F.col("path").isNotNull() & F.col("kind").isin("old_path", "new_path")
    # A file is all its path lines; a hunk is its own line.
    rows = checkpointed(parsed.where(is_file | wanted).groupBy(
        "diff_id", "block", "path", F.when(is_hunk, F.col("line_no")).alias("hunk_line")).agg(
        F.min("line_no").alias("line_no"), F.max("status").alias("status"),
        F.max(F.when(is_hunk, F.col("scope"))).alias("scope")).drop("hunk_line"))
    owned = checkpointed(owners(rows.select("path").distinct(), "path", dirs).drop("problem"))
    placed = lookup_join(rows, owned, ["path"], "left", ["diff_id", "line_no"])
    return placed.select("diff_id", "block", "path", "line_no", "status", "scope", "owner_dir", "rel_path", F.when(
        F.col("scope").isNull(), P.status_text(F.col("status"), F.col("path"))).alias("status_text")).orderBy("diff_id", "line_no")
