"""Summaries of changes: owners, texts per scope, entries and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import texts as T
from . import ordered
from .quality import checked
from .sizing import checkpointed, lookup_join

LIKEWISE = "Likewise."


def owners(df: DataFrame, path: str, dirs: DataFrame) -> DataFrame:
    """Longest folder of ``dirs(dir)`` above each path: adds ``owner_dir`` and
    ``rel_path``; paths without an owner have a ``problem``.

    A path has few parent folders, so they are spelled out and joined by
    equality instead of comparing each path with each folder.  Distinct folders
    are joined, not files, so a folder with many files is looked up once.
    """
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    keyed = df.withColumn("__folder", folder)
    folders = keyed.select("__folder").distinct()
    steps = F.split("__folder", "/")
    parents = S.unnest(folders, ["__folder"], S.let(steps, lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))), "dir").drop("nth")
    owned = (lookup_join(parents, dirs.select("dir").distinct(), ["dir"], "inner",
                         spread_by=["__folder"])
             .groupBy("__folder").agg(F.max_by("dir", F.length("dir")).alias("owner_dir")))
    placed = (lookup_join(keyed, owned, ["__folder"], "left", spread_by=[path])
              .drop("__folder")
              .withColumn("rel_path", F.expr(f"substring(`{path}`, length(owner_dir) + 2)")))
    return checked(placed, (F.col("owner_dir").isNull(), "no owner folder"))


def scope_texts(df: DataFrame, keys: list[str], scope: str, order: str, text: str,
                part_rows: int = 4096) -> DataFrame:
    """Texts of a (key, scope) joined by two blanks, with ``first_ord``, the
    place of the scope among its siblings; long ones come in parts."""
    group = keys + [scope]
    # Several steps follow; each would read the input again.
    parts = checkpointed(ordered.ordered_parts(df, group, order, F.col(text), "  ", part_rows))
    marked = ordered.lag(parts, group, "part", F.col("part"), "__before")
    return ordered.carry_forward(marked, group, "part", {"first_ord": F.when(
        F.col("__before").isNull(), F.col("first"))}).select(*group, "part", "first_ord", "text")


def unfinished(text: Column) -> tuple[Column, str]:
    """A log text must end with a full stop."""
    return ~text.endswith("."), "text does not end with a full stop"


def name_sentences(df: DataFrame, keys: list[str], name: str, one: str, many: str) -> DataFrame:
    """Distinct names per key, sorted, in a sentence for one or for many.

    Names are made distinct by a partial aggregation on (key, name) first, so
    a key with many rows is small when it is collected.  Names come from a rule
    list, which bounds the array.
    """
    return (df.select(*keys, name).distinct().groupBy(*keys)
            .agg(F.sort_array(F.collect_list(name)).alias("names"))
            .withColumn("text", T.sentence(F.col("names"), one, many)))


def scopes_by_last(df: DataFrame, keys: list[str], scope: str, at: str,
                   descending: bool = False) -> DataFrame:
    """Scopes in the order of their last hit."""
    order = [F.col("last_at").desc() if descending else F.col("last_at").asc(), F.col(scope)]
    return df.groupBy(*keys, scope).agg(F.max(at).alias("last_at")).orderBy(*keys, *order)


def likewise(df: DataFrame, keys: list[str], order: str, text: str, out: str = "short",
             chunk_rows: int | None = None) -> DataFrame:
    """A text equal to the one before it in the key becomes ``Likewise.``."""
    return (ordered.lag(df, keys, order, F.col(text), "__before", chunk_rows)
            .withColumn(out, F.when(F.col("__before").isNotNull()
                                    & F.col("__before.v").eqNullSafe(F.col(text)), F.lit(LIKEWISE))
                        .otherwise(F.col(text)))
            .drop("__before"))


def entry_lines(df: DataFrame, keys: list[str], file: str, scope: str, order: str,
                text: str, out: str = "entry") -> DataFrame:
    """``* file (scope): text`` for the first entry of a file, then
    ``(scope): text``; no scope in the first gives ``* file: text``."""
    marked = ordered.lag(df, keys + [file], order, F.col(order), "__before")
    scoped = F.concat(F.lit("("), F.col(scope), F.lit("): "), F.col(text))
    return marked.withColumn(out, F.when(
        F.col("__before").isNull(),
        F.when(F.coalesce(F.col(scope), F.lit("")) != "", F.concat(F.lit("* "), F.col(file), F.lit(" "), scoped))
        .otherwise(F.concat(F.lit("* "), F.col(file), F.lit(": "), F.col(text))))
        .otherwise(scoped)).drop("__before")


def header_line(date: Column, name: Column, email: Column) -> Column:
    return F.concat(date, F.lit("  "), name, F.lit("  <"), email, F.lit(">"))


def directory_logs(entries: DataFrame, owner: str, order: str, entry: str, header: Column,
                   intro: Column, old: DataFrame | None = None,
                   part_rows: int = 4096) -> DataFrame:
    """Log text per folder, in parts: part 0 opens with the header, and the
    old text ``old(owner, old_text)`` follows as the last part.

    Folders without entries do not appear.  Parts of a folder, in order, are
    its log; no folder is collected whole.
    """
    parts = checkpointed(ordered.ordered_parts(entries, [owner], order, F.col(entry), "\n", part_rows).drop("first"))
    opened = ordered.lag(parts, [owner], "part", F.col("part"), "__before").withColumn("text", F.when(
        F.col("__before").isNull(),
        F.concat(header, F.lit("\n\n"), intro, F.lit("\n"), F.col("text"), F.lit("\n")))
        .otherwise(F.concat(F.col("text"), F.lit("\n")))).drop("__before")
    if old is None:
        return opened
    ends = parts.groupBy(owner).agg((F.max("part") + 1).alias("part"))
    kept = (ends.join(old, owner, "inner")
            .select(owner, "part", F.concat(F.lit("\n"), F.col("old_text")).alias("text")))
    return opened.unionByName(kept)


DATED_LINE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\s.*$"


def log_entries(lines: DataFrame, keys: list[str], order: str, line: str,
                is_header: Column | None = None, part_rows: int = 4096) -> DataFrame:
    """Entries of a log: ``keys, entry_at, part, header, body``.

    A header line opens an entry, other lines belong to the header before
    them, and lines before the first header are dropped.  ``entry_at`` is the
    line of the header.  The last entry is kept.  A body of more lines comes in
    parts of ``part_rows`` lines; the parts in order are the body.
    """
    opens = F.col(line).rlike(DATED_LINE) if is_header is None else is_header
    numbered = checkpointed(ordered.running_sum(lines, keys, order, F.lit(1), "__n"))
    opener = F.when(opens, F.struct(F.col(order).alias("at"), F.col(line).alias("header"), F.col("__n").alias("n")))
    inside = ordered.carry_forward(numbered, keys, order, {"__open": opener}).where("__open is not null")
    placed = inside.select(*keys, F.col("__open.at").alias("entry_at"), F.col("__open.header").alias("header"),
                           F.col(order).alias("__at"), F.col(line).alias("__line"),
                           F.greatest(F.col("__n") - F.col("__open.n") - 1, F.lit(0)).alias("__n"))
    bodies = F.when(F.col("__at") != F.col("entry_at"), F.struct("__at", "__line"))
    return (
        placed.groupBy(*keys, "entry_at", "header",
                       ordered.chunk_of(F.col("__n"), part_rows).alias("part"))
        .agg(F.sort_array(F.collect_list(bodies)).alias("__body"))
        .select(*keys, "entry_at", "part", "header",
                F.array_join(F.transform("__body", lambda b: b["__line"]), "\n").alias("body")))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, by partial aggregation."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
            .select(*keys, *[F.col("__row")[c].alias(c) for c in others]).select(*df.columns))


def messages(entries: DataFrame, file: str, order: str, body: str, log_name: str = "ChangeLog") -> DataFrame:
    """Message of the newest entry (the first of its file): the folder of the
    log, then the body, all its parts.  ``file, message``."""
    if "part" in entries.columns:
        newest_at = entries.groupBy(F.col(file).alias("__file")).agg(F.min(order).alias("__first"))
        entries = entries.join(newest_at, (F.col(file) == F.col("__file")) & (F.col(order) == F.col("__first")))
        first = ordered.whole_texts(entries, [file], body, "\n").withColumnRenamed(body, "__body")
    else:
        first = entries.groupBy(file).agg(F.min_by(body, order).alias("__body"))
    folder = F.regexp_replace(F.col(file), f"{log_name}$", "")
    return first.select(file, F.concat(folder, F.lit("\n"), F.col("__body")).alias("message"))


def with_old_log(sections: DataFrame, key: str, logs: DataFrame, old: str, header: Column,
                 summary: Column, text: Column, default: str, out: str = "log") -> DataFrame:
    """New log: header, summary, section text (all its parts), then the old log
    or ``default``."""
    if "part" in sections.columns:
        sections = ordered.whole_texts(sections, [c for c in sections.columns if c not in ("part", "text")], "text", "\n")
    return lookup_join(sections, logs, [key], "left").withColumn(out, F.concat(
        header, F.lit("\n\n\t"), summary, F.lit("\n\n"), T.trimmed_right(text), F.lit("\n\n"),
        F.coalesce(F.col(old), F.lit(default))))
