"""Whole runs: hits by scope, guarded renames and rewrites with their log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import changelog as L
from ..operators import context as C
from ..operators import rewrite as R
from . import refactor as P
from .registry import Tables, query
from .texts import TAG_SCOPES, matches_sql


def scope_report(pages: DataFrame, pattern: str = "tion") -> DataFrame:
    """Per page and scope the hits, the line of the first, and the log text,
    shortened where it repeats the one before in the page."""
    found = pages.select("page_id", "html", S.spans(F.col("html"), pattern).alias("found"))
    placed = found.transform(C.with_line("html")).transform(C.with_scope("html", TAG_SCOPES))
    hits = S.unnest_fields(placed, ["page_id"], "found")
    counted = hits.groupBy("page_id", "scope").agg(
        F.count("*").alias("hits"), F.min("start").alias("first_start"),
        F.min(F.col("line_no").cast("bigint")).alias("first_line"))
    logged = counted.withColumn("text", F.concat(F.lit("Found "), F.col("hits").cast("string"), F.lit(" hits.")))
    return L.likewise(logged, ["page_id"], "first_start", "text")


@query("scope_report", r"""
WITH m AS (SELECT m.page_id, start, substr(html, 1, start) AS prefix
           FROM (""" + matches_sql("pages", "page_id", "html", "tion") + r""") m JOIN pages USING (page_id)),
     s AS (SELECT page_id, start, length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS line_no,
                  coalesce('block ' || regexp_extract_all(prefix, '<(article|footer)\b[^>]*>', 1)[-1],
                           regexp_extract_all(prefix, '<(h1|p|nav|title)\b[^>]*>', 1)[-1]) AS scope FROM m),
     c AS (SELECT page_id, scope, count(*)::BIGINT AS hits, min(start) AS first_start, min(line_no)::BIGINT AS first_line,
                  'Found ' || count(*) || ' hits.' AS text FROM s GROUP BY page_id, scope)
SELECT *, CASE WHEN lag(text) OVER (PARTITION BY page_id ORDER BY first_start) = text THEN 'Likewise.' ELSE text END AS short FROM c""")
def flagship(t: Tables) -> DataFrame:
    return scope_report(t.spread("pages"))


_NAMES = {"the": "THE", "of": "of_x *", "que": "que_y"}
# Texts are cut at their quotes; the documents hold no escaped quote and no comment.
_OUTSIDE_SQL = r"""array_to_string(list_transform(string_split(text, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN
  regexp_replace(regexp_replace(regexp_replace(x, '\bthe\b', 'THE', 'g'), '\bof\b ?', 'of_x *', 'g'), '\bque\b', 'que_y', 'g')
  ELSE x END), '"')"""


@query("run_rename", f"SELECT doc_id, {_OUTSIDE_SQL} AS edited FROM documents")
def run_rename(t: Tables) -> DataFrame:
    docs = t.spread("documents").select("doc_id", "text", F.concat("source", F.lit("/a.c")).alias("path"))
    return P.rename_once(docs, "path", "text", _NAMES, log=False).select("doc_id", "edited")


_RUN = P.Refactoring([R.Template("suffix", "([a-z])tion", "{1}sion", 1), R.Template("blank", "the (?=the )", "")],
                     [P.Phrase(["suffix"], "Change {1}.", "Change {1}."), P.Phrase(["blank"], "Drop {1}.", "Drop {1}.")],
                     skip_strings=False)


def _run(t: Tables, log: bool) -> DataFrame:
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".def"))
    docs = t.spread("documents").select("doc_id", "text", path.alias("path"))
    return P.refactor(docs, "path", "text", _RUN, log)


_SETTLED_SQL = r"""regexp_replace(regexp_replace(regexp_replace(text, '([a-z])tion', '\1sion', 'g'),
  '([a-z])tion', '\1sion', 'g'), '(the )+the ', 'the ', 'g')"""


@query("run_rewrite", f"SELECT doc_id, {_SETTLED_SQL} AS edited, NULL::VARCHAR AS problem FROM documents")
def run_rewrite(t: Tables) -> DataFrame:
    return _run(t, False).select("doc_id", "edited", "problem")


# Definition files have no scopes, so a file has one entry with a sentence per rule that hit it.
@query("run_log", r"""
WITH e AS (SELECT source AS owner_dir, 'd' || doc_id || '.def' AS file,
                  concat_ws('  ', CASE WHEN regexp_matches(text, '[a-z]tion') THEN 'Change suffix.' END,
                            CASE WHEN contains(text, 'the the ') THEN 'Drop blank.' END) AS text
           FROM documents WHERE regexp_matches(text, '[a-z]tion') OR contains(text, 'the the ')),
     l AS (SELECT *, '* ' || file || ': ' || CASE WHEN lag(text) OVER (PARTITION BY owner_dir ORDER BY file) = text
                  THEN 'Likewise.' ELSE text END AS entry FROM e),
     n AS (SELECT *, (row_number() OVER (PARTITION BY owner_dir ORDER BY file) - 1) // 4096 AS part FROM l)
SELECT owner_dir, part, CASE WHEN part = 0 THEN '2026-01-01  A Writer  <writer@example.org>' || chr(10) || chr(10)
       || 'Made by a script.' || chr(10) ELSE '' END || string_agg(entry || chr(10), '' ORDER BY file) AS text
FROM n GROUP BY owner_dir, part""")
def run_log(t: Tables) -> DataFrame:
    header = L.header_line(F.lit("2026-01-01"), F.lit("A Writer"), F.lit("writer@example.org"))
    dirs = t.documents.select(F.col("source").alias("dir")).distinct()
    # Each source is a folder, so no file is without owner.  The parts of a log, in order, are its text.
    logs, _ = P.change_logs(_run(t, True), "path", dirs, _RUN.phrases, header, F.lit("Made by a script."))
    return logs
