"""Whole runs over the given tables: patch kit, draft, catalogue, class rename, conversion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import changelog as L
from ..operators import context as C
from ..operators import ordered, sizing
from ..sources import scan
from . import conversion, patch_kit
from . import options as O
from . import refactor as P
from .registry import Tables, query


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_KIT_SQL = """
  WITH d AS (SELECT doc_id, lang, source, 'doc ' || doc_id || ' ' || lang AS summary,
                    '[PATCH ' || doc_id || '/89] doc ' || doc_id || ' ' || lang || ' and more' AS mail FROM documents)
  SELECT d.*, quality, 'From: ' || source || chr(10) || 'Subject: [PATCH ' || d.doc_id || '/9] ' || summary AS head,
         CASE WHEN d.doc_id % 5 = 0 THEN 'no mail for this patch' WHEN quality IS NULL THEN 'approval_url not found' END AS problem
  FROM d LEFT JOIN labels USING (doc_id)"""


@query("run_patch_kit", f"""
SELECT doc_id::VARCHAR AS path, problem, CASE WHEN problem IS NULL THEN concat_ws(chr(10), head, '', 'This corresponds to:',
  '  ' || mail, '  https://example.org/list/m' || doc_id || '.html', 'from the original kit', '',
  'That earlier patch was approved by R:', '> quality ' || quality, 'in https://example.org/ok/' || doc_id, '', '') || source END AS content
FROM ({_KIT_SQL})""")
def run_patch_kit(t: Tables) -> DataFrame:
    """Patches with their first mail and their approval, or what they lack."""
    d = t.documents.select("doc_id", "lang", "source")
    n, summary = F.col("doc_id"), _text("doc ", F.col("doc_id"), " ", F.col("lang"))
    patches = d.select(n.cast("string").alias("path"), _text(
        "From: ", F.col("source"), "\nSubject: [PATCH ", n, "/9] ", summary, "\n\n", F.col("source")).alias("content"))
    mail = _text("[PATCH ", n, "/89] ", summary, " and more")
    mails = d.where(n % 5 != 0).select(n.alias("ord"), mail.alias("subject"), _text("m", n, ".html").alias("href"))
    approvals = t.labels.join(d, "doc_id").select(mail.alias("subject"), _text("https://example.org/ok/", n).alias("url"),
                                                  _text("quality ", F.col("quality")).alias("text"))
    done, bad = patch_kit.annotate(patches, mails, approvals, "https://example.org/list/index.html", 89, "kit", "R")
    return (done.select("path", F.lit(None).cast("string").alias("problem"), "content")
            .unionByName(bad.select("path", "problem", F.lit(None).cast("string").alias("content"))))


@query("run_draft", """
WITH d AS (SELECT doc_id, source || '/' || lang || '.c' AS path, source, lang,
                  CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' ELSE 'changed' END AS status FROM documents)
SELECT doc_id::VARCHAR AS diff_id, path, status, CASE WHEN lang <> 'es' THEN source END AS owner_dir, NULL AS scope,
       CASE status WHEN 'new' THEN 'New file.' WHEN 'deleted' THEN 'Deleted file.' END AS status_text FROM d
UNION ALL
SELECT doc_id::VARCHAR, path, status, CASE WHEN lang <> 'es' THEN source END, 'f' || doc_id, NULL FROM d WHERE status = 'changed'""")
def run_draft(t: Tables) -> DataFrame:
    """Files and hunks of diffs with owner, status and scope."""
    n, lang = F.col("doc_id"), F.col("lang")
    # Spanish files are in a folder without a log.
    folder = _text(F.col("source"), F.when(lang == "es", "x").otherwise(""))
    path = _text(folder, "/", lang, ".c")
    new, deleted = n % 3 == 0, n % 3 == 1
    diff = _text("commit ", n, "\n    Fix it\ndiff --git a/", path, " b/", path,
                 F.when(new, "\nnew file mode 100644").when(deleted, "\ndeleted file mode 100644").otherwise(""),
                 F.when(new, "\n--- /dev/null").otherwise(_text("\n--- a/", path)),
                 F.when(deleted, "\n+++ /dev/null").otherwise(_text("\n+++ b/", path)),
                 "\n@@ -1,2 +1,3 @@ f", n, " (x)\n+more\n@@ -9,2 +9,3 @@ f", n, " (x)\n context")
    dirs = t.documents.select(F.col("source").alias("dir")).distinct()
    drafted = patch_kit.draft(t.documents.select(n.cast("string").alias("diff_id"), diff.alias("text")), dirs)
    return drafted.select("diff_id", F.regexp_replace("path", "x/es[.]c$", "/es.c").alias("path"), "status", "owner_dir",
                          "scope", "status_text")


_OPTION_SQL = """
  SELECT p_partkey, 'p' || p_partkey || '.opt' AS path, p_size, 'flag_' || p_partkey AS var FROM part"""


@query("run_catalogue", f"""
SELECT path, 'option' AS what, 'f' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'Common' ELSE 'Target' END AS detail,
       'Help.' || chr(10) || 'More ' || p_size AS helptext, NULL AS problem FROM ({_OPTION_SQL}) WHERE p_size % 5 <> 0
UNION ALL SELECT path, 'variable', 'v' || p_partkey, 'int *', NULL, NULL FROM ({_OPTION_SQL}) WHERE p_size % 3 <> 0
UNION ALL SELECT path, 'problem', NULL, NULL, NULL, 'more than one kind' FROM ({_OPTION_SQL}) WHERE p_size % 5 = 0
UNION ALL SELECT path, 'problem', NULL, NULL, NULL, 'a variable record needs two lines' FROM ({_OPTION_SQL}) WHERE p_size % 3 = 0""")
def run_catalogue(t: Tables) -> DataFrame:
    """Option files as typed options and variables, or what is wrong with them."""
    n, size = F.col("p_partkey"), F.col("p_size")
    text = _text("; a comment\nf", n, "=\n", F.when(size % 2 == 0, "Common").otherwise("Target"), " Var(flag_", n, ", 0)",
                 F.when(size % 5 == 0, " Warning Optimization").otherwise(""), "\nHelp.\nMore ", size, "\n\nVariable\n",
                 F.when(size % 3 == 0, "").otherwise(_text("int *v", n, " = 4\n")))
    found = O.catalogue(t.part.select(_text("p", n, ".opt").alias("path"), text.alias("text")))
    none = F.lit(None).cast("string")
    return (found.options.select("path", F.lit("option").alias("what"), "name", F.col("availability").alias("detail"), "helptext",
                                 none.alias("problem"))
            .unionByName(found.variables.select("path", F.lit("variable").alias("what"), "name", F.col("type_").alias("detail"),
                                                none.alias("helptext"), none.alias("problem")))
            .unionByName(found.problems.select("path", F.lit("problem").alias("what"), none.alias("name"), none.alias("detail"),
                                               none.alias("helptext"), "problem")))


@query("run_class_rename", r"""
WITH d AS (SELECT doc_id, replace(text, 'the', 'gimple_cond') AS text FROM documents)
SELECT doc_id, regexp_replace(text, '\bgimple_cond\b ?', 'gcond *', 'g') AS edited,
       len(regexp_extract_all(text, '\bgimple_cond\b'))::BIGINT AS n_hits FROM d""")
def run_class_rename(t: Tables) -> DataFrame:
    """Statement classes renamed, wherever they stand."""
    path = _text("src/d", F.col("doc_id"), ".def")
    docs = t.spread("documents").select("doc_id", F.replace("text", F.lit("the"), F.lit("gimple_cond")).alias("text"), path.alias("path"))
    done = P.rename_once(docs, "path", "text", rules.statement_class_renames(), code_only=False, log=False)
    return done.select("doc_id", "edited", F.size("hits").cast("bigint").alias("n_hits"))


@query("run_scope_fixes", """
WITH f(scope, path, fixed) AS (VALUES ('phi', 'gimple-iterator.h', 'gimple_phi_iterator::phi'), ('Copyright', 'coretypes.h', NULL),
                                      ('land', 'gimple.h', 'gimple_statement_catch'))
SELECT doc_id, path, CASE WHEN f.path IS NOT NULL THEN fixed ELSE s.scope END AS scope,
       CASE WHEN f.path IS NULL AND s.scope IN ('phi', 'Copyright', 'land') THEN 'scope is not a definition' END AS problem
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'phi' WHEN 1 THEN 'Copyright' WHEN 2 THEN 'land' ELSE lang END AS scope,
             CASE doc_id % 3 WHEN 0 THEN 'gimple-iterator.h' WHEN 1 THEN 'coretypes.h' ELSE 'gimple.h' END AS path FROM documents) s
LEFT JOIN (SELECT * FROM f UNION ALL SELECT 'Copyright', 'gimple-iterator.h', 'gimple_phi_iterator::phi') f USING (scope, path)""")
def run_scope_fixes(t: Tables) -> DataFrame:
    """Scopes of a class rename put right by file, with the deny-list."""
    n = F.col("doc_id")
    scope = F.when(n % 4 == 0, "phi").when(n % 4 == 1, "Copyright").when(n % 4 == 2, "land").otherwise(F.col("lang"))
    path = F.when(n % 3 == 0, "gimple-iterator.h").when(n % 3 == 1, "coretypes.h").otherwise("gimple.h")
    df = t.documents.select("doc_id", path.alias("path"), scope.alias("scope"))
    return C.fixed_scopes(df, "scope", "path", rules.scope_fixes(t.spark), rules.SCOPES_DENIED).select(
        "doc_id", "path", "scope", "problem")


# Accessors stand before some prefix of the catalogue, one of them with its
# special name, before the fallback, or before none.
_PREFIXES = ["gimple_asm_", "gimple_cond_", "gimple_omp_", "gimple_wce_"]


@query("run_conversion", f"""
WITH a AS (SELECT {_PREFIXES}[p_partkey % 5 + 1] AS prefix, p_size % 4 < 2 AS done FROM part WHERE p_partkey % 5 < 4)
SELECT prefix, count(*) FILTER (done)::BIGINT AS done, count(*) FILTER (NOT done)::BIGINT AS todo,
       (count(*) FILTER (done) * 100 // count(*))::BIGINT AS percentage FROM a GROUP BY prefix""")
def run_conversion(t: Tables) -> DataFrame:
    """Progress of accessor declarations, one a part, by prefix; the first line
    of a symbol counts."""
    n, done = F.col("p_partkey"), F.col("p_size") % 4 < 2
    name = _text(F.get(F.array(*map(F.lit, [*_PREFIXES, "gimple_none_"])), (n % 5).cast("int")), "x", n)
    kinds = F.array(F.when(done, "const gimple_asm *s").otherwise("const_gimple g"), F.when(done, "const_gimple g").otherwise("gimple_asm *s"))
    each = t.part.select(n, name.alias("name"), F.posexplode(kinds).alias("nth", "kind"))
    lines = each.select((n * 2 + F.col("nth")).alias("line_no"), _text(F.col("name"), " (", F.col("kind"), ")").alias("line"))
    codes = t.spark.createDataFrame([("gimple_asm",), ("gimple_cond",), ("gimple_with_cleanup_expr",)], "printable_name string")
    stats, _ = conversion.progress(conversion.accessors(lines), codes)
    return stats


@query("run_report", """
SELECT unnest(['builders_todo', 'accessors_todo', 'builders_done', 'accessors_done', 'accessors_exempt']) AS title,
       unnest([count(*) FILTER (doc_id % 6 = 0), count(*) FILTER (doc_id % 6 = 2), count(*) FILTER (doc_id % 6 = 1),
               count(*) FILTER (doc_id % 6 = 3), least(1, count(*) FILTER (doc_id % 6 = 4))])::BIGINT AS n
FROM (SELECT DISTINCT doc_id FROM documents)""")
def run_report(t: Tables) -> DataFrame:
    """The five counters of the conversion report, over one declaration a document."""
    n = F.col("doc_id")
    lines = [_text("gimple gimple_build_x", n, " (void);"), _text("gimple_cond gimple_build_y", n, " (tree, tree)"),
             _text("gimple_cond_lhs", n, " (const_gimple gs)"), _text("gimple_asm_string", n, " (gimple_asm *s);"),
             F.lit("gimple_bb (const_gimple g)"), _text("no declaration ", n)]
    headers = t.documents.select(n.alias("line_no"), F.get(F.array(*lines), F.pmod(n, F.lit(6)).cast("int")).alias("line"))
    return conversion.counters(conversion.accessors(headers))


@query("run_logs_written", """
WITH h AS (SELECT DISTINCT source FROM documents),
     l AS (SELECT source, NULL AS doc_id, k, line FROM h, (VALUES (1, '2026-01-01  A Writer  <writer@example.org>'), (2, ''),
             (3, 'Made by a script.')) v(k, line)
           UNION ALL SELECT source, doc_id, 4, '(' || doc_id || '): ' || lang || '.' FROM documents)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS line_no, line FROM l""")
def run_logs_written(t: Tables) -> DataFrame:
    """Logs written as text and read back line by line, file by file in order."""
    folder = f"{sizing.shared_folder(t.spark)}/logs-{uuid.uuid4().hex}"
    entries = t.documents.select("source", "doc_id", _text("(", F.col("doc_id"), "): ", F.col("lang"), ".").alias("entry"))
    header = L.header_line(F.lit("2026-01-01"), F.lit("A Writer"), F.lit("writer@example.org"))
    parts = L.directory_logs(entries, "source", "doc_id", "entry", header, F.lit("Made by a script."))
    scan.write_logs(parts, "source", folder)
    # Within a split of a file the lines come in order, and the number grows.
    lines = t.spark.read.text(folder, recursiveFileLookup=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), "/source=([^/]*)/", 1).alias("source"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    found = ordered.dense_order(lines, ["source", "file", "block", "at"])
    sizing.remove_folder(t.spark, folder)
    numbered = ordered.running_sum(found, ["source"], "ord", F.lit(1), "line_no")
    return numbered.select("source", "line_no", "line")


# Documents of a written file.
_FILE_DOCS = 16384


@query("run_corpus_scan", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) AS line, CASE WHEN lang = 'es' THEN 'gcc/testsuite' ELSE 'gcc' END
             || '/source=' || coalesce(nullif(source, ''), '__HIVE_DEFAULT_PARTITION__') || '/block=' || (doc_id // {_FILE_DOCS}) AS folder FROM documents),
     f AS (SELECT folder, sum(strlen(line))::BIGINT AS size, string_agg(line, '' ORDER BY doc_id) AS text FROM d GROUP BY folder)
SELECT folder, size, CASE WHEN folder NOT LIKE '%/testsuite/%' AND size < 16777216 THEN md5(text) END AS digest,
       CASE WHEN folder NOT LIKE '%/testsuite/%' AND size < 16777216 THEN length(text)::BIGINT END AS n_chars FROM f""")
def corpus_scan(t: Tables) -> DataFrame:
    """A corpus written as a tree of files, listed, and read without its test
    folders and its largest files, which are not opened.  The tree goes at the end."""
    root = f"{sizing.shared_folder(t.spark)}/tree-{uuid.uuid4().hex}"
    block = F.floor(F.col("doc_id") / _FILE_DOCS)
    docs = t.documents.select("source", block.alias("block"), "doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    for folder, part in (("gcc", ~F.col("lang").eqNullSafe("es")), ("gcc/testsuite", F.col("lang") == "es")):
        # A group is one file, its documents in order.
        (docs.where(part).repartition("source", "block").sortWithinPartitions("source", "block", "doc_id")
         .select("source", "block", "text").write.mode("append").partitionBy("source", "block").text(f"{root}/{folder}"))
    keep = scan.has_suffix(F.col("path"), [".txt"], pruned=["testsuite"]) & (F.col("size") < 1 << 24)
    texts = scan.read_corpus(t.spark, root, "*.txt", keep, root).select(
        "path", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))
    files = scan.listing(t.spark, root, "*.txt", root)
    found = sizing.checkpointed(files.join(texts, "path", "left").select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "size", "digest", "n_chars"))
    sizing.remove_folder(t.spark, root)
    return found
