"""Change summaries, patches and archives over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import rules
from ..functions import spans as S
from ..functions import texts as T
from ..operators import changelog as L
from ..operators import match as M
from ..operators import ordered
from ..operators import patches as P
from ..operators import sizing
from ..sources.logstore import LogStore, section_parts
from .registry import Tables, query

_PATHS_SQL = r"SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"
_DIRS_SQL = f"""
  SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) AS dir FROM ({_PATHS_SQL}) WHERE path NOT LIKE '%example.org/%'
  UNION SELECT DISTINCT regexp_extract(path, '^([^/]*/(en|fr))/', 1) FROM ({_PATHS_SQL})
  WHERE regexp_matches(path, '^([^/]*/(en|fr))/') AND path NOT LIKE '%example.org/%'"""


def _paths(t: Tables):
    return t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


def _dirs(t: Tables):
    paths = _paths(t).where(~F.col("path").contains("example.org/"))
    hosts = paths.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("dir"))
    langs = paths.select(F.regexp_extract("path", "^([^/]*/(en|fr))/", 1).alias("dir"))
    return hosts.union(langs.where("dir != ''")).distinct()


_OWNED_SQL = f"""
  SELECT page_id, path, max_by(dir, length(dir)) AS owner_dir
  FROM ({_PATHS_SQL}) LEFT JOIN ({_DIRS_SQL}) ON starts_with(path, dir || '/') GROUP BY page_id, path"""


@query("l1_owners", f"""
SELECT page_id, owner_dir, CASE WHEN owner_dir IS NULL THEN 'no owner folder' END AS problem FROM ({_OWNED_SQL})""")
def owner_dirs(t: Tables):
    return L.owners(_paths(t), "path", _dirs(t)).select("page_id", "owner_dir", "problem")


@query("l2_relative_paths", f"""
SELECT page_id, owner_dir, substr(path, length(owner_dir) + 2) AS rel_path,
       CASE WHEN owner_dir IS NULL THEN 'no owner folder' END AS problem FROM ({_OWNED_SQL})""")
def relative_paths(t: Tables):
    return L.owners(_paths(t), "path", _dirs(t)).select("page_id", "owner_dir", "rel_path", "problem")


# The text of a key is joined whole.  Its ``part`` is 0; more than a value of
# Spark can hold goes on in parts 1, 2, ... (see ``ordered.filled_rows``).
@query("l3_scope_texts", """
SELECT conv_id, role, 0::BIGINT AS part, min(turn) AS first_ord, string_agg(text, '  ' ORDER BY turn) AS text, bool_and(text LIKE '%.') AS finished
FROM conversations GROUP BY conv_id, role""")
def scope_texts(t: Tables):
    broken, _ = L.unfinished(F.col("text"))
    parts = L.scope_texts(t.conversations, ["conv_id"], "role", "turn", "text")
    texts = ordered.filled_rows(parts, ["conv_id", "role", "first_ord"], "text", "  ")
    checks = t.conversations.groupBy("conv_id", "role").agg((F.count_if(broken) == 0).alias("finished"))
    return texts.join(checks, ["conv_id", "role"])


@query("l4_name_sentences", """
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'Remove usage of ' || min(o_orderpriority) || ' macro.'
  ELSE 'Remove uses of macros: ' || string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) || '.' END AS text
FROM orders GROUP BY o_custkey""")
def name_sentences(t: Tables):
    return L.name_sentences(t.orders, ["o_custkey"], "o_orderpriority", "Remove usage of {1} macro.",
                            "Remove uses of macros: {1}.").select("o_custkey", "text")


@query("l6_likewise", """
SELECT doc_id, CASE WHEN lag(lang) OVER (PARTITION BY source ORDER BY doc_id) = lang THEN 'Likewise.' ELSE lang END AS short
FROM documents""")
def likewise(t: Tables):
    return L.likewise(t.documents.select("doc_id", "source", "lang"), ["source"], "doc_id", "lang").select(
        "doc_id", "short")


@query("l7_entry_lines", """
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 THEN '(' || scope || '): ' || text
  WHEN scope <> '' THEN '* ' || source || ' (' || scope || '): ' || text ELSE '* ' || source || ': ' || text END AS entry
FROM (SELECT doc_id, source, CASE WHEN lang = 'en' THEN '' ELSE lang END AS scope, n_chars || ' characters.' AS text
      FROM documents)""")
def entry_lines(t: Tables):
    df = t.documents.select("doc_id", "source", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("scope"),
                            F.concat(F.col("n_chars").cast("string"), F.lit(" characters.")).alias("text"))
    return L.entry_lines(df, [], "source", "scope", "doc_id", "text").select("doc_id", "entry")


@query("l8_directory_logs", """
SELECT source, 0::BIGINT AS part, '2026-01-01  A Writer  <writer@example.org>' || chr(10) || chr(10) || 'Made by a script.' || chr(10)
       || string_agg('(' || doc_id || '): ' || lang || '.', chr(10) ORDER BY doc_id) || chr(10)
       || CASE WHEN source LIKE 'src1%' THEN chr(10) || 'Old log of ' || source || '.' ELSE '' END AS text
FROM documents GROUP BY source""")
def directory_logs(t: Tables):
    entries = t.documents.select("source", "doc_id", F.concat(
        F.lit("("), F.col("doc_id").cast("string"), F.lit("): "), F.col("lang"), F.lit(".")).alias("entry"))
    old = (t.documents.where(F.col("source").startswith("src1")).select("source").distinct()
           .withColumn("old_text", F.concat(F.lit("Old log of "), F.col("source"), F.lit("."))))
    header = L.header_line(F.lit("2026-01-01"), F.lit("A Writer"), F.lit("writer@example.org"))
    parts = L.directory_logs(entries, "source", "doc_id", "entry", header, F.lit("Made by a script."), old)
    return ordered.filled_rows(parts, ["source"], "text", "")


@query("l9_log_entries", """
WITH e AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS entry_at
           FROM conversations)
SELECT conv_id, entry_at, 0::BIGINT AS part, max(CASE WHEN turn = entry_at THEN text END) AS header,
       coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn <> entry_at), '') AS body
FROM e WHERE entry_at IS NOT NULL GROUP BY ALL""")
def log_entries(t: Tables):
    parts = L.log_entries(t.conversations, ["conv_id"], "turn", "text", F.col("role") == "user")
    return ordered.filled_rows(parts, ["conv_id", "entry_at", "header"], "body", "\n")


@query("l10_newest", """
SELECT o_custkey, o_orderkey, 'customer ' || o_custkey || '/' || chr(10) || o_orderstatus || ' ' || o_orderpriority AS message
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def newest(t: Tables):
    latest = L.newest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"),
                      ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", F.concat(
        F.lit("customer "), F.col("o_custkey").cast("string"), F.lit("/\n"), F.col("o_orderstatus"), F.lit(" "),
        F.col("o_orderpriority")).alias("message"))


@query("l11_with_old_log", r"""
WITH old AS (SELECT doc_id, 'quality ' || quality AS text FROM labels WHERE quality IS NOT NULL)
SELECT doc_id, 1::BIGINT AS generation, 0::BIGINT AS part, '2026-01-01  A Writer  <writer@example.org>' || chr(10) || chr(10) || chr(9)
       || source || chr(10) || chr(10) || regexp_replace(text, '\s+$', '') || chr(10) || chr(10) AS text FROM documents
UNION ALL SELECT doc_id, 0, 0, text FROM old
UNION ALL SELECT DISTINCT doc_id, 1, 1, '""" + rules.DEFAULT_LOG + """' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM old)""")
def with_old_log(t: Tables):
    """Logs that patches add to: the new parts are written before the old ones,
    which stay as they are; read back, the store gives the whole logs."""
    store = LogStore(t.spark, f"{sizing.shared_folder(t.spark)}/store-{uuid.uuid4().hex}", "doc_id")
    store.append(t.labels.where("quality IS NOT NULL").select("doc_id", F.lit(0).alias("part"), F.concat(
        F.lit("quality "), F.col("quality").cast("string")).alias("text")))
    header = L.header_line(F.lit("2026-01-01"), F.lit("A Writer"), F.lit("writer@example.org"))
    store.append(section_parts(t.documents.select("doc_id", "source", "text"), "doc_id", header, F.col("source"), F.col("text")),
                 rules.DEFAULT_LOG)
    return store.read()


@query("p1_subjects", r"""
WITH s AS (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS n, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 7 <> 0 AND title <> '' THEN n::INT END AS patch_no,
       CASE WHEN page_id % 7 <> 0 AND title <> '' THEN 999 END AS total,
       CASE WHEN page_id % 7 <> 0 AND title <> '' THEN title END AS summary FROM s""")
def subjects(t: Tables):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    subject = F.concat(F.when(F.col("page_id") % 7 == 0, "Re: ").otherwise(""), F.lit("[PATCH "),
                       F.regexp_extract("url", "/([0-9]+)", 1), F.lit("/999] "),
                       F.substring(title, F.lit(1), F.lit(3)), F.lit("\n"), F.substring(title, F.lit(4), F.length(title)))
    df = t.pages.select("page_id", title.alias("title"), subject.alias("subject"))
    df = df.withColumn("subject", F.when(F.col("title") == "", "").otherwise(F.col("subject")))
    return P.with_subject(df, "subject").select("page_id", "patch_no", "total", "summary")


@query("p2_split_body", """
SELECT doc_id, split_part(text, chr(10), 1) AS before,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS after FROM documents""")
def split_body(t: Tables):
    before, after = P.split_at(F.col("text"), "\n")
    return t.documents.select("doc_id", before.alias("before"), after.alias("after"))


@query("p3_sections", """
WITH c AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS opener
           FROM conversations)
SELECT conv_id, CASE WHEN opener IS NULL THEN 'leading' WHEN opener % 4 = 2 THEN 'conflicts' ELSE 'section' END AS kind,
       CASE WHEN opener IS NULL OR opener % 4 = 2 THEN '' ELSE 'turn' || (opener % 3) END AS section, 0::BIGINT AS part,
       string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS text
FROM c WHERE role <> 'user' GROUP BY ALL""")
def sections(t: Tables):
    opener = F.when(F.col("turn") % 4 == 2, "Conflicts:").otherwise(
        F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string"), F.lit("/")))
    lines = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", opener).otherwise(
        F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))
    return ordered.filled_rows(P.sections(lines, ["conv_id"], "turn", "line"), ["conv_id", "kind", "section"], "text", "\n")


_DIFF_SQL = """
  SELECT user_id, event_id, event_type, CASE event_type WHEN 'signup' THEN 'diff --git a/x b/x'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'new file mode 100644' ELSE 'deleted file mode 100644' END
    WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN '--- a/gcc/f' || (event_id % 10) || '.c'
      WHEN 1 THEN '+++ b/gcc/f' || (event_id % 10) || '.c' ELSE '+++ /dev/null' END
    WHEN 'view' THEN '@@ -1,2 +3,4 @@ f' || event_id
    ELSE CASE event_id % 2 WHEN 0 THEN ' context' ELSE 'index 12..34' END END AS line FROM events"""


def _diff(t: Tables):
    e, n = F.col("event_type"), F.col("event_id")
    numbered = lambda a, m, b: F.concat(F.lit(a), (n % m).cast("string"), F.lit(b))
    line = (F.when(e == "signup", "diff --git a/x b/x")
            .when(e == "error", F.when(n % 2 == 0, "new file mode 100644").otherwise("deleted file mode 100644"))
            .when(e == "click", F.when(n % 3 == 0, numbered("--- a/gcc/f", 10, ".c"))
                  .when(n % 3 == 1, numbered("+++ b/gcc/f", 10, ".c")).otherwise("+++ /dev/null"))
            .when(e == "view", F.concat(F.lit("@@ -1,2 +3,4 @@ f"), n.cast("string")))
            .otherwise(F.when(n % 2 == 0, " context").otherwise("index 12..34")))
    return t.events.select("user_id", "event_id", line.alias("line"))


@query("p4_diff_lines", f"""
WITH b AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS block
           FROM ({_DIFF_SQL})),
     c AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^(--- a/|[+]{{3}} b/)') THEN substr(line, 7) END IGNORE NULLS)
                       OVER w AS path,
                  last_value(CASE WHEN line LIKE 'new file%' THEN 'new' WHEN line LIKE 'deleted file%' THEN 'deleted' END IGNORE NULLS)
                       OVER w AS mode FROM b
           WINDOW w AS (PARTITION BY user_id, block ORDER BY event_id))
SELECT user_id, event_id, line, block, CASE WHEN block IS NOT NULL THEN path END AS path,
  CASE WHEN block IS NOT NULL THEN coalesce(mode, 'changed') END AS status,
  CASE WHEN block IS NULL THEN CASE WHEN line LIKE ' %' THEN 'message' ELSE 'preamble' END
       WHEN line LIKE 'diff%' THEN 'file' WHEN line LIKE 'index%' THEN 'index' WHEN line LIKE 'new file%' THEN 'new'
       WHEN line LIKE 'deleted file%' THEN 'deleted' WHEN line LIKE '--- a/%' THEN 'old_path'
       WHEN line LIKE '+++ b/%' THEN 'new_path' WHEN line LIKE '%/dev/null' THEN 'no_path'
       WHEN line LIKE '@%' AND mode IS NULL THEN 'hunk' ELSE 'body' END AS kind
FROM c""")
def diff_lines(t: Tables):
    return P.diff_lines(_diff(t), ["user_id"], "event_id", "line")


@query("p5_hunks", """
SELECT p_partkey, p_size AS old_start, CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE 1 END AS old_len,
       p_size + 2 AS new_start, 7 AS new_len,
       CASE p_size % 4 WHEN 0 THEN 'struct ' || p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN 'UNKNOWN'
         ELSE split_part(p_name, ' ', 1) END AS scope FROM part""")
def hunks(t: Tables):
    size, name = F.col("p_size"), F.col("p_name")
    context = (F.when(size % 4 == 0, F.concat(F.lit(" struct "), name)).when(size % 4 == 1, F.concat(F.lit(" proc "), name))
               .when(size % 4 == 2, "").otherwise(F.concat(F.lit(" "), name)))
    line = F.concat(F.lit("@@ -"), size.cast("string"),
                    F.when(size % 2 == 0, F.concat(F.lit(","), (size + 1).cast("string"))).otherwise(""),
                    F.lit(" +"), (size + 2).cast("string"), F.lit(",7 @@"), context)
    return P.with_hunk(t.part.select("p_partkey", line.alias("line")), "line").drop("line")


@query("p6_drop_repeats", """
SELECT user_id, event_id, event_type FROM events
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type""")
def drop_repeats(t: Tables):
    return P.drop_repeats(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("p7_status_text", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'New ' || thing WHEN o_orderstatus = 'P' THEN 'Deleted ' || thing END AS text
FROM (SELECT *, CASE WHEN o_orderpriority LIKE '5%' THEN 'test.' ELSE 'file.' END AS thing FROM orders)""")
def status_text(t: Tables):
    path = F.when(F.col("o_orderpriority").startswith("5"), "gcc/testsuite/a.c").otherwise("gcc/a.c")
    return t.orders.select("o_orderkey", P.status_text(F.col("o_orderstatus"), path, "F", "P").alias("text"))


@query("p8_owner_headers", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, host, CASE WHEN lag(host) OVER (ORDER BY page_id) IS DISTINCT FROM host THEN host || '/ChangeLog:' END AS header FROM h""")
def owner_headers(t: Tables):
    hosts = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return P.owner_headers(hosts, [], "page_id", "host")


@query("p9_mail_matches", """
WITH f AS (SELECT doc_id, lang, split_part(text, chr(10), 1) AS line FROM documents),
     m AS (SELECT s.line, min(f.doc_id) AS first_doc FROM (SELECT DISTINCT line FROM f) s
           JOIN f ON starts_with(f.line, s.line) AND f.lang <> 'es' GROUP BY s.line)
SELECT doc_id, first_doc, CASE WHEN first_doc IS NULL THEN 'no mail for this patch' END AS problem
FROM f LEFT JOIN m USING (line)""")
def mail_matches(t: Tables):
    first, _ = P.split_at(F.col("text"), "\n")
    heads = t.spread("documents").select("doc_id", "lang", first.alias("summary"))
    # Spanish texts stand for answers, which are not mails of the series.
    mails = heads.select(F.col("doc_id").alias("ord"), F.concat(
        F.when(F.col("lang") == "es", "Re: ").otherwise(""), F.lit("[PATCH "), F.col("doc_id").cast("string"),
        F.lit("/89] "), F.col("summary")).alias("subject"))
    return P.match_mails(heads, mails, "doc_id", "summary", "subject", "ord", 89).select(
        "doc_id", F.col("mail.ord").alias("first_doc"), "problem")


@query("p9_first_by_line", """
SELECT split_part(text, chr(10), 1) AS line, min(doc_id) AS first FROM documents GROUP BY ALL""")
def first_by_line(t: Tables):
    first, _ = P.split_at(F.col("text"), "\n")
    return P.first_with(t.documents, first, "doc_id", "line")


@query("p10_approvals", """
SELECT doc_id, quality, toxic, CASE WHEN quality IS NULL THEN 'quality not found' END AS problem
FROM documents LEFT JOIN labels USING (doc_id)""")
def approvals(t: Tables):
    return P.with_lookup(t.documents.select("doc_id"), t.labels, ["doc_id"], ["quality", "toxic"])


@query("p11_absolute_urls", r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href,
                  generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), 1)::BIGINT AS k FROM pages)
SELECT page_id, k, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS from_root,
       regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || substr(href, 2) AS from_folder FROM a""")
def absolute_urls(t: Tables):
    links = S.unnest(t.pages, ["page_id", "url"], F.regexp_extract_all(
        "html", F.lit('<li><a href="([^"]*)">'), F.lit(1)), "href", "k")
    below = F.substring(F.col("href"), F.lit(2), F.length("href"))
    return links.select("page_id", (F.col("k") + 1).cast("bigint").alias("k"),
                        T.absolute_url(F.col("url"), F.col("href")).alias("from_root"),
                        T.absolute_url(F.col("url"), below).alias("from_folder"))


@query("p12_annotations", r"""
SELECT conv_id, turn, concat_ws(chr(10), 'This corresponds to:', '  ' || role, '  https://example.org/' || conv_id,
  'from the original series', '', 'That earlier patch was approved by a reviewer:',
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: '> ' || regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)),
  'in https://example.org/' || turn, '', '') || text AS body FROM conversations""")
def annotations(t: Tables):
    site = F.lit("https://example.org/")
    message = P.annotation(F.col("role"), F.concat(site, F.col("conv_id").cast("string")), "series", "a reviewer",
                           F.col("text"), F.concat(site, F.col("turn").cast("string")))
    return t.conversations.select("conv_id", "turn", F.concat(message, F.col("text")).alias("body"))


@query("p13_series_gaps", """
SELECT number, count(doc_id)::BIGINT AS n
FROM (SELECT unnest(range((SELECT min(doc_id) FROM labels), (SELECT max(doc_id) + 1 FROM labels))) AS number)
LEFT JOIN labels ON doc_id = number GROUP BY number HAVING count(doc_id) <> 1""")
def series_gaps(t: Tables):
    return P.series_gaps(t.labels, "doc_id", F.min("doc_id"), F.max("doc_id"))


@query("l5_scopes_by_last", r"""
SELECT page_id, matched AS tag, max(start)::BIGINT AS last_at FROM (
  SELECT page_id, matched, "end" - length(matched) AS start FROM (
    SELECT *, sum(length(gap) + length(matched)) OVER (PARTITION BY page_id ORDER BY nth) AS "end" FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<[a-z0-9]+')) AS matched,
             unnest(string_split_regex(html, '<[a-z0-9]+')[:len(regexp_extract_all(html, '<[a-z0-9]+'))]) AS gap,
             generate_subscripts(regexp_extract_all(html, '<[a-z0-9]+'), 1) AS nth FROM pages)))
GROUP BY ALL""")
def scopes_by_last(t: Tables):
    tags = M.matches(t.pages, "html", "<[a-z0-9]+", ["page_id"]).withColumnRenamed("matched", "tag")
    return L.scopes_by_last(tags, ["page_id"], "tag", "start")
