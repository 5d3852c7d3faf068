"""Scans, matches, context and rewrites over ``documents`` and ``pages``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import rules
from ..functions import spans as S
from ..functions import texts as T
from ..operators import context as C
from ..operators import match as M
from ..operators import patches as P
from ..operators import rewrite as R
from ..operators import sizing
from ..sources import scan
from .registry import Tables, query

# SQL for the pieces that several queries share.
LINES_SQL = """
  SELECT doc_id, line_no, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_off
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no
        FROM documents)"""


def matches_sql(table: str, key: str, text: str, pattern: str) -> str:
    """Matches with offsets: pieces between matches and matches, side by side."""
    return f"""
  SELECT {key}, nth, matched, "end" - length(matched) AS start, "end"
  FROM (SELECT *, sum(length(gap) + length(matched)) OVER (PARTITION BY {key} ORDER BY nth)::BIGINT AS "end"
        FROM (SELECT {key},
                     unnest(regexp_extract_all({text}, '{pattern}')) AS matched,
                     unnest(string_split_regex({text}, '{pattern}')[:len(regexp_extract_all({text}, '{pattern}'))]) AS gap,
                     generate_subscripts(regexp_extract_all({text}, '{pattern}'), 1)::BIGINT - 1 AS nth
              FROM {table}))"""


@query("s1_corpus_scan", """
SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS folder,
       '.txt' AS ext, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM documents""")
def corpus_scan(t: Tables):
    d = t.documents
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan.as_corpus(d, path, F.col("text"), ["doc_id"]).select(
        "doc_id", "path", "folder", "ext", F.length("text").cast("bigint").alias("n_chars"),
        F.md5("text").alias("digest"))


@query("s2_path_filter", """
SELECT page_id, url FROM pages
WHERE (url LIKE '%.html' OR url LIKE '%/' OR url LIKE '%#top') AND url NOT LIKE '%5/' AND url NOT LIKE '%/de/%'""")
def path_filter(t: Tables):
    keep = scan.has_suffix(F.col("url"), [".html", "/", "#top"], ["5/"], ["de"])
    return t.pages.select("page_id", "url").where(keep)


@query("s3_lines", f"""
SELECT doc_id, line_no, start_off, start_off + length(line) AS end_off, line FROM ({LINES_SQL})""")
def lines(t: Tables):
    return scan.lines(t.documents, ["doc_id"], "text").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "start_off", "end_off", "line")


@query("s4_index_rows", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a>', 1) AS hrefs,
                  regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a>', 2) AS names FROM pages)
SELECT page_id, (len(hrefs) - i)::BIGINT AS ord, hrefs[i] AS href, names[i] AS subject
FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM a)""")
def index_rows(t: Tables):
    return scan.index_rows(t.pages, ["page_id"], "html", r'<li><a href="([^"]*)">(.*?)</a>').select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), "href", "subject")


@query("s4_anchors", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs FROM pages)
SELECT page_id, len(hrefs)::BIGINT AS n, hrefs[-1] AS first_href FROM a WHERE len(hrefs) > 0""")
def anchors(t: Tables):
    rows = scan.index_rows(t.pages, ["page_id"], "html")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min_by("href", "ord").alias("first_href"))


@query("s5_mail_parts", """
SELECT doc_id, ltrim(split_part(text, chr(10), 1), ' ' || chr(9)) AS subject,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body
FROM documents""")
def mail_parts(t: Tables):
    first, rest = P.split_at(F.col("text"), "\n")
    mail = F.concat(F.lit("From: "), F.col("source"), F.lit("\nSubject: "), first, F.lit("\n\n"),
                    F.coalesce(rest, F.lit("")))
    return scan.mail_parts(t.documents.select("doc_id", mail.alias("mail")), "mail").select(
        "doc_id", "subject", "body")


@query("s6_write_changed", """
SELECT source, count(*)::BIGINT AS n_files, sum(length(replace(text, 'tion', 'sion!')))::BIGINT AS n_chars
FROM documents WHERE text LIKE '%tion%' GROUP BY source""")
def write_changed(t: Tables):
    folder = f"{sizing.shared_folder(t.spark)}/changed-{uuid.uuid4().hex}"
    after = t.documents.select("doc_id", "source", "text", F.replace(
        "text", F.lit("tion"), F.lit("sion!")).alias("after"))
    scan.write_changed(after, "text", "after", folder, ["source"])
    return t.spark.read.parquet(folder).groupBy("source").agg(
        F.count("*").alias("n_files"), F.sum(F.length("after")).alias("n_chars"))


@query("s7_lookup", """
SELECT doc_id, (min((quality, toxic))).quality AS quality, (min((quality, toxic))).toxic AS toxic
FROM (SELECT unnest([doc_id, doc_id + 1, doc_id + 2]) AS doc_id, {'quality': quality, 'toxic': toxic} AS v,
             quality, toxic FROM labels) GROUP BY doc_id""".replace("(min((quality, toxic))).quality", "min(v).quality").replace(
    "(min((quality, toxic))).toxic", "min(v).toxic"))
def lookup(t: Tables):
    shared = t.labels.select(F.sequence("doc_id", F.col("doc_id") + 2).alias("members"), "quality", "toxic")
    return scan.load_lookup(shared, "members", ["quality", "toxic"], "doc_id")


_WORDS = {"the": "THE", "of": "of_x *", "and": "and_y", "que": "que_z *", "der": "der_w"}


@query("s8_rule_usage", """
WITH r(rule_id, old, new) AS (VALUES (1::BIGINT, 'the', 'THE'), (2::BIGINT, 'of', 'of_x *'), (3::BIGINT, 'and', 'and_y'),
                              (4::BIGINT, 'que', 'que_z *'), (5::BIGINT, 'der', 'der_w')),
     w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[_a-zA-Z0-9]+')) AS old FROM documents)
SELECT rule_id, old, new, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_hits
FROM w JOIN r USING (old) GROUP BY ALL""")
def rule_usage(t: Tables):
    table = rules.rename_table(t.spark, _WORDS)
    counts = M.dictionary_counts(t.spread("documents"), "text", ["doc_id"], table, "old")
    used = counts.groupBy("old").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_hits"))
    return sizing.lookup_join(used, table, ["old"], "inner").select("rule_id", "old", "new", "n_docs", "n_hits")


@query("m1_matches", f"""SELECT doc_id, nth, start, "end", matched FROM ({matches_sql('documents', 'doc_id', 'text', 'tion')})""")
def matches(t: Tables):
    return M.matches(t.spread("documents"), "text", "tion", ["doc_id"]).withColumn("nth", F.col("nth").cast("bigint"))


@query("m1_multiline", r"""
SELECT doc_id, nth, start, "end", matched FROM (""" + matches_sql(
    "documents", "doc_id", "text", r"(?ms)^[A-Z][a-z]+ .{5,40}?\.$") + ")")
def matches_multiline(t: Tables):
    return M.matches(t.spread("documents"), "text", M.multiline(r"^[A-Z][a-z]+ .{5,40}?\.$"), ["doc_id"]).withColumn(
        "nth", F.col("nth").cast("bigint"))


@query("m1_first_last", """
SELECT doc_id, (strpos(text, 'tion') - 1)::BIGINT AS first_start,
       (length(text) - strpos(reverse(text), 'noit') - 3)::BIGINT AS last_start
FROM documents WHERE text LIKE '%tion%'""")
def first_last(t: Tables):
    df = t.spread("documents").select("doc_id", M.first_match(F.col("text"), "tion").alias("f"),
                            M.last_match(F.col("text"), "tion").alias("l"))
    return df.where("f is not null").select(
        "doc_id", F.col("f.start").alias("first_start"), F.col("l.start").alias("last_start"))


@query("m2_named_groups", r"""
SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)(/[^?#]*)?', 1) AS scheme,
       regexp_extract(url, '^(https?)://([^/?#]+)(/[^?#]*)?', 2) AS host,
       regexp_extract(url, '^(https?)://([^/?#]+)(/[^?#]*)?', 3) AS path
FROM pages WHERE regexp_matches(url, '^(https?)://([^/?#]+)(/[^?#]*)?')""")
def named_groups(t: Tables):
    return M.matches(t.pages, "url", r"^(https?)://([^/?#]+)(/[^?#]*)?", ["page_id"],
                     {"scheme": 1, "host": 2, "path": 3}).select("page_id", "scheme", "host", "path")


@query("m3_identifiers", f"""
SELECT doc_id, start, "end" FROM ({matches_sql('documents', 'doc_id', 'text', chr(92) + 'bthe' + chr(92) + 'b')})""")
def identifiers(t: Tables):
    return M.matches(t.spread("documents"), "text", M.identifier("the"), ["doc_id"]).select("doc_id", "start", "end")


@query("m3_consuming", f"""
SELECT doc_id, start + 1 AS start, "end" - 1 AS "end"
FROM ({matches_sql('documents', 'doc_id', 'text', '[^_a-zA-Z0-9]the[^_a-zA-Z0-9]')})""")
def identifiers_consuming(t: Tables):
    return M.consuming_matches(t.spread("documents"), "text", "the", ["doc_id"]).select("doc_id", "start", "end")


def _benchmark_words(t: Tables):
    words = F.regexp_extract_all("text", F.lit(M.TOKEN), F.lit(0))
    return S.unnest(t.benchmark, [], words, "name").select("name")


@query("m4_dictionary_counts", """
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[_a-zA-Z0-9]+')) AS name FROM benchmark),
     w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[_a-zA-Z0-9]+')) AS name FROM documents)
SELECT doc_id, name, count(*)::BIGINT AS n FROM w JOIN d USING (name) GROUP BY ALL""")
def dictionary_counts(t: Tables):
    return M.dictionary_counts(t.spread("documents"), "text", ["doc_id"], _benchmark_words(t), "name").select(
        "doc_id", "name", "n")


@query("m4_dictionary_places", f"""
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[_a-zA-Z0-9]+')) AS name FROM benchmark)
SELECT doc_id, matched AS name, start, "end"
FROM ({matches_sql('documents', 'doc_id', 'text', '[_a-zA-Z0-9]+')}) m JOIN d ON d.name = m.matched""")
def dictionary_places(t: Tables):
    return M.dictionary_matches(t.spread("documents"), "text", ["doc_id"], _benchmark_words(t), "name").select(
        "doc_id", "name", "start", "end")


_IN_LINES_SQL = f"""
  SELECT doc_id, line_no, line, start_off + "end" - 4 AS start, gap FROM (
    SELECT *, sum(length(gap) + 4) OVER (PARTITION BY doc_id, line_no ORDER BY k)::BIGINT AS "end" FROM (
      SELECT doc_id, line_no, line, start_off, unnest(string_split(line, 'tion')) AS gap,
             generate_subscripts(string_split(line, 'tion'), 1) AS k, len(string_split(line, 'tion')) AS n
      FROM ({LINES_SQL})) WHERE k < n)"""


@query("m5_guards", f"""
SELECT doc_id, start, line_no FROM ({_IN_LINES_SQL})
WHERE gap NOT LIKE '%s' AND line NOT LIKE 'The%' AND line NOT LIKE '%ingth%' AND line NOT LIKE '%ti.'
  AND line <> 'Of.' AND line NOT LIKE '#define tion%'
  AND trim(line) NOT IN (SELECT trim(unnest(string_split(text, chr(10)))) FROM benchmark)""")
def guards(t: Tables):
    placed = t.spread("documents").select("doc_id", "text", S.spans(
        F.col("text"), M.not_preceded_by("s", "tion")).alias("found")).transform(C.with_line("text"))
    sound = S.unnest_fields(placed, ["doc_id"], M.filtered(
        F.col("found"), lambda m: M.line_starts(m, "The"), lambda m: M.line_has(m, "ingth"),
        lambda m: M.line_ends(m, "ti."), lambda m: M.line_is(m, "Of."), M.line_defines))
    excluded = S.unnest(t.benchmark, [], F.split("text", "\n", -1), "line").select("line")
    return M.drop_excluded_lines(sound, excluded).select(
        "doc_id", "start", F.col("line_no").cast("bigint").alias("line_no"))


@query("c1_lines_of_matches", f"""SELECT doc_id, start, line_no, line FROM ({_IN_LINES_SQL})""")
def lines_of_matches(t: Tables):
    placed = t.spread("documents").select(
        "doc_id", "text", S.spans(F.col("text"), "tion").alias("found")).transform(C.with_line("text"))
    return S.unnest_fields(placed, ["doc_id"], "found").select(
        "doc_id", "start", F.col("line_no").cast("bigint").alias("line_no"), "line")


_PAGE_AD_SQL = f"""SELECT m.*, substr(html, 1, start) AS prefix, html
  FROM ({matches_sql('pages', 'page_id', 'html', 'ad')}) m JOIN pages USING (page_id)"""


@query("c2_comments", f"""
SELECT page_id, start, strpos(prefix, '<!--') > 0
       AND strpos('<!--' || string_split(prefix, '<!--')[-1], '-->') = 0 AS in_comment
FROM ({_PAGE_AD_SQL})""")
def comments(t: Tables):
    df = t.spread("pages").select("page_id", "html", S.spans(F.col("html"), "ad").alias("found"))
    flagged = df.transform(C.with_comment("html", opening="<!--", closing="-->", line_mark=None, line_prefix=None))
    return S.unnest_fields(flagged, ["page_id"], "found").select("page_id", "start", "in_comment")


@query("c3_strings", f"""
SELECT page_id, start, (length(prefix) - length(replace(prefix, '"', ''))) % 2 = 1 AS in_string
FROM ({_PAGE_AD_SQL})""")
def strings(t: Tables):
    df = t.spread("pages").select("page_id", "html", S.spans(F.col("html"), "ad").alias("found"))
    flagged = df.transform(C.with_string("html", comments=False))
    return S.unnest_fields(flagged, ["page_id"], "found").select("page_id", "start", "in_string")


# The documents hold no escaped quote, so the parity of the quotes decides.
@query("c3_strings_and_comments", f"""
WITH m AS (SELECT l.*, substr(text, 1, start::BIGINT) AS prefix FROM ({_IN_LINES_SQL}) l JOIN documents USING (doc_id))
SELECT doc_id, start, line LIKE '%//%' OR line LIKE ';%' OR (strpos(prefix, '/*') > 0
       AND strpos('/*' || string_split(prefix, '/*')[-1], '*/') = 0) AS in_comment,
       (length(prefix) - length(replace(prefix, '"', ''))) % 2 = 1 AS in_string FROM m""")
def strings_and_comments(t: Tables):
    df = t.spread("documents").select("doc_id", "text", S.spans(F.col("text"), "tion").alias("found"))
    flagged = df.transform(C.chain(C.with_line("text"), C.with_comment("text"), C.with_string("text")))
    return S.unnest_fields(flagged, ["doc_id"], "found").select("doc_id", "start", "in_comment", "in_string")


TAG_SCOPES = [C.ScopeRule(r"<(article|footer)\b[^>]*>", "block {1}"),
              C.ScopeRule(r"<(h1|p|nav|title)\b[^>]*>")]


@query("c4_scopes", r"""
WITH m AS (SELECT m.page_id, start, substr(html, 1, start) AS prefix
           FROM (""" + matches_sql("pages", "page_id", "html", "tion") + r""") m JOIN pages USING (page_id))
SELECT page_id, start,
       coalesce('block ' || regexp_extract_all(prefix, '<(article|footer)\b[^>]*>', 1)[-1],
                regexp_extract_all(prefix, '<(h1|p|nav|title)\b[^>]*>', 1)[-1]) AS scope FROM m""")
def scopes(t: Tables):
    df = t.spread("pages").select("page_id", "html", S.spans(F.col("html"), "tion").alias("found"))
    return S.unnest_fields(df.transform(C.with_scope("html", TAG_SCOPES)), ["page_id"], "found").select(
        "page_id", "start", "scope")


@query("c5_annotations", """
SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain, length(html)::BIGINT AS n_blanked,
       replace(regexp_replace(html, '<[^>]*>', '', 'g'), ' ', '') AS squeezed FROM pages""")
def annotations(t: Tables):
    tag = "<[^>]*>"
    df = t.spread("pages").select("page_id", C.removed(F.col("html"), tag).alias("plain"),
                        C.blanked(F.col("html"), tag).alias("blanked"))
    return df.select("page_id", "plain", F.length("blanked").cast("bigint").alias("n_blanked"),
                     F.replace("blanked", F.lit(" "), F.lit("")).alias("squeezed"))


@query("c6_fixed_scopes", """
WITH f(scope, path, fixed) AS (VALUES ('en', 'src1', 'english'), ('fr', 'src2', NULL), ('es', 'src3', 'spanish'))
SELECT doc_id, source, CASE WHEN f.path IS NOT NULL THEN fixed ELSE lang END AS scope,
       CASE WHEN f.path IS NULL AND lang IN ('es') THEN 'scope is not a definition' END AS problem
FROM documents LEFT JOIN f ON lang = scope AND source = path""")
def fixed_scopes(t: Tables):
    fixes = t.spark.createDataFrame([("en", "src1", "english"), ("fr", "src2", None), ("es", "src3", "spanish")],
                                    "scope string, path string, fixed string")
    df = t.documents.select("doc_id", "source", F.col("lang").alias("scope"))
    return C.fixed_scopes(df, "scope", "source", fixes, ["es"]).select("doc_id", "source", "scope", "problem")


@query("r1_rename", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\bthe\b', 'THE', 'g'), '\bof\b ?', 'of_x *', 'g'), '\band\b', 'and_y', 'g'), '\bque\b ?', 'que_z *', 'g'),
  '\bder\b', 'der_w', 'g') AS renamed FROM documents""")
def rename(t: Tables):
    return t.spread("documents").select("doc_id", R.rename_identifiers(F.col("text"), _WORDS).alias("renamed"))


@query("r1_rename_by_table", f"""
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[_a-zA-Z0-9]+')) AS old FROM benchmark),
     p AS (SELECT doc_id, unnest(string_split_regex(text, '[_a-zA-Z0-9]+')) AS gap,
                  unnest(list_append(regexp_extract_all(text, '[_a-zA-Z0-9]+'), '')) AS tok,
                  generate_subscripts(string_split_regex(text, '[_a-zA-Z0-9]+'), 1) AS k FROM documents)
SELECT doc_id, string_agg(gap || CASE WHEN d.old IS NULL THEN tok ELSE upper(tok) || '_' END, '' ORDER BY k) AS renamed
FROM p LEFT JOIN d ON d.old = p.tok GROUP BY doc_id""")
def rename_by_table(t: Tables):
    table = _benchmark_words(t).distinct().select(
        F.col("name").alias("old"), F.concat(F.upper("name"), F.lit("_")).alias("new"))
    return R.rename_by_table(t.spread("documents").select("doc_id", "text"), "doc_id", "text", table).select(
        "doc_id", "renamed")


@query("r2_templates", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-z])tion', '\1sion', 'g'),
       '([a-z])tion', '\1sion', 'g'), 'é+', 'é', 'g') AS expanded, TRUE AS settled FROM documents""")
def templates(t: Tables):
    rule_list = [R.Template("suffix", "([a-z]+)tion", "{1}sion", 1), R.Template("accent", "(é)é", "{1}", 1)]
    return R.expand_templates(t.spread("documents").select("doc_id", "text"), "text", rule_list).select(
        "doc_id", "expanded", "settled")


@query("r3_strip_prefix", r"""
SELECT page_id, regexp_replace(url, '(://)(m|blog|www)\.', '\1', 'g') AS url FROM pages""")
def strip_prefix(t: Tables):
    return t.pages.select("page_id", R.strip_prefix(F.col("url"), "://", r"(?:m|blog|www)\.").alias("url"))


@query("r4_wrap", r"""
SELECT doc_id, regexp_replace(text, '\b(the|de|of)\b', 'OPT (\1)', 'g') AS wrapped, TRUE AS idempotent FROM documents""")
def wrap(t: Tables):
    names = ["the", "de", "of"]
    once = t.spread("documents").select("doc_id", R.wrap_identifiers(F.col("text"), names, "OPT").alias("wrapped"))
    return once.withColumn("idempotent", R.wrap_identifiers(F.col("wrapped"), names, "OPT") == F.col("wrapped"))


# Every hundredth text has an edit too many, which overlaps the others or leaves the text.
@query("r5_apply_edits", """
SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN text ELSE replace(text, 'tion', '<TI>') END AS edited,
       CASE WHEN doc_id % 100 = 7 THEN 'edits overlap or leave the text' END AS problem FROM documents""")
def apply_edits(t: Tables):
    docs = t.spread("documents").select("doc_id", "text")
    edits = M.matches(docs, "text", "tion", ["doc_id"]).select("doc_id", "start", "end", F.lit("<TI>").alias("repl"))
    beyond = docs.where("doc_id % 100 = 7").select("doc_id", F.length("text").cast("bigint").alias("start"), (
        F.length("text") + 1).cast("bigint").alias("end"), F.lit("").alias("repl"))
    return R.apply_edits(docs, "doc_id", "text", edits.unionByName(beyond)).select("doc_id", "edited", "problem")


@query("r6_touched_lines", f"""
SELECT doc_id, line_no, replace(replace(line, 'tion', 'sion!'), 'the', '') AS line,
       line LIKE '%tion%' AS touched FROM ({LINES_SQL})""")
def touched_lines(t: Tables):
    found = t.spread("documents").select("doc_id", "text", S.spans(F.col("text"), "the|tion").alias("found"))
    edits = found.withColumn("edits", F.transform("found", lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        F.when(m["matched"] == "the", "").otherwise("sion!").alias("repl"))))
    edited = edits.withColumn("edited", S.splice(F.col("text"), F.col("edits")))
    return S.unnest_fields(R.touched_lines(edited, "edited", "edits"), ["doc_id"], "lines").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "touched")


@query("r7_line_changes", """
WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
     a AS (SELECT doc_id, unnest(string_split(replace(text, 'tion', 'sion!'), chr(10))) AS line FROM documents)
SELECT doc_id, line, 'removed' AS change, count(*)::BIGINT AS n
FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL
UNION ALL
SELECT doc_id, line, 'added', count(*)::BIGINT FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL""")
def line_changes(t: Tables):
    both = t.spread("documents").select("doc_id", "text", F.replace("text", F.lit("tion"), F.lit("sion!")).alias("after"))
    return R.line_changes(both, ["doc_id"], "text", "after")


@query("r8_indents", f"""
WITH m AS (SELECT doc_id, line_no, repeat(' ', ((doc_id + line_no * 5) % 27)::INT) || line
                  || CASE WHEN line_no % 50 = 0 THEN chr(9) ELSE '' END AS made FROM ({LINES_SQL}))
SELECT doc_id, line_no, CASE WHEN NOT contains(made, chr(9)) THEN repeat(chr(9), ((length(made) - length(ltrim(made))) // 8)::INT)
       || repeat(' ', ((length(made) - length(ltrim(made))) % 8)::INT) || ltrim(made) END AS tabbed,
       CASE WHEN NOT contains(made, chr(9)) THEN TRUE END AS restored,
       CASE WHEN contains(made, chr(9)) THEN 'line holds a tab' END AS problem FROM m""")
def indents(t: Tables):
    made = scan.lines(t.spread("documents"), ["doc_id"], "text").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.concat(F.repeat(F.lit(" "), ((F.col("doc_id") + F.col("line_no") * 5) % 27).cast("int")),
                 F.col("line"), F.when(F.col("line_no") % 50 == 0, "\t").otherwise("")).alias("made"))
    tabbed = R.indented(made, "made", "tabbed")
    return tabbed.select("doc_id", "line_no", "tabbed",
                         (T.tabs_to_spaces(F.col("tabbed")) == F.col("made")).alias("restored"), "problem")


@query("r9_long_lines", f"""
SELECT doc_id, count(*)::BIGINT AS n_long, max(length(line))::BIGINT AS longest
FROM ({LINES_SQL}) WHERE length(line) > 80 GROUP BY doc_id""")
def long_lines(t: Tables):
    return R.long_lines(t.spread("documents"), ["doc_id"], "text").withColumn("longest", F.col("longest").cast("bigint"))
