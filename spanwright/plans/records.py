"""Option records, inventory, hierarchy and move plan over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import spans as S
from ..operators import hierarchy as H
from ..operators import inventory as A
from ..operators import ordered
from ..operators import records as O
from ..operators import sizing
from .registry import Tables, query

_BLANKS_SQL = """
  SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS blank
  FROM events WHERE event_type <> 'signup'"""


# A record is joined whole; its ``part`` is 0 (see ``ordered.filled_rows``).
@query("o1_records", f"""
SELECT user_id, coalesce(blank, -1) AS record, 0::BIGINT AS part,
       string_agg(event_type, '|' ORDER BY event_id) AS joined
FROM ({_BLANKS_SQL}) WHERE event_type <> 'error' GROUP BY ALL""")
def records(t: Tables):
    line = (F.when(F.col("event_type") == "error", "  ").when(F.col("event_type") == "signup", "; comment only")
            .otherwise(F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, ";note  ").otherwise(" "))))
    lines = t.events.select("user_id", "event_id", line.alias("line"))
    parts = O.records(lines, ["user_id"], "event_id", "line").select(
        "user_id", "record", "part", F.array_join("lines", "|").alias("joined"))
    return ordered.filled_rows(parts, ["user_id", "record"], "joined", "|")


@query("o1_strict_records", f"""
SELECT user_id, coalesce(blank, -1) AS record, count(*)::BIGINT AS n_lines
FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_blank
      FROM ({_BLANKS_SQL})) WHERE event_type <> 'error' AND event_id < last_blank GROUP BY ALL""")
def strict_records(t: Tables):
    line = (F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "signup", ";")
            .otherwise(F.col("event_type")))
    lines = t.events.select("user_id", "event_id", line.alias("line"))
    return (O.record_lines(lines, ["user_id"], "event_id", "line", strict_eof=True)
            .groupBy("user_id", "record").agg(F.count("*").alias("n_lines")))


@query("o2_properties", r"""
WITH q AS (SELECT page_id, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS items FROM pages
           WHERE regexp_matches(url, '\?[^#]+'))
SELECT page_id, k::BIGINT AS k, CASE WHEN k = 0 THEN 'Common' ELSE 'Var(' || split_part(items[k], '=', 1) || ', ' || split_part(items[k], '=', 2) || ')' END AS prop
FROM (SELECT *, unnest(range(0, len(items) + 1)) AS k FROM q)""")
def properties(t: Tables):
    params = F.regexp_extract("url", r"\?([^#]*)", 1)
    line = F.concat(F.lit("Common "), F.replace(
        F.regexp_replace(params, "([^&=]*)=([^&]*)", "Var($1,   $2)"), F.lit("&"), F.lit("  ")))
    df = t.pages.where(F.col("url").rlike(r"\?[^#]+")).select("page_id", line.alias("line"))
    return S.unnest(df, ["page_id"], O.properties(F.col("line")), "prop", "k").select(
        "page_id", F.col("k").cast("bigint").alias("k"), "prop")


@query("o3_options", """
WITH k AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)
SELECT event_id, 'f' || event_type AS name, CASE k % 3 WHEN 0 THEN 'Common' WHEN 1 THEN 'Target' END AS availability,
  CASE WHEN k % 10 = 0 THEN 'Warning' WHEN k % 5 = 1 THEN 'Optimization' END AS kind, k % 2 = 0 AS driver, TRUE AS report,
  CASE WHEN k % 7 <> 0 THEN 'flag_' || k END AS var, CASE WHEN k % 4 = 0 THEN k || ' + (1)' END AS init,
  'Help ' || event_type || chr(10) || 'more' AS helptext,
  CASE WHEN k % 10 = 0 THEN 'more than one kind' END AS problem FROM k""")
def options(t: Tables):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    word = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    s = k.cast("string")
    props = F.concat_ws(
        " ", F.when(k % 3 == 0, "Common Target").when(k % 3 == 1, "Target Common").otherwise("C ObjC"),
        word(k % 10 == 0, F.lit("Warning Optimization")), word(k % 5 == 1, F.lit("Optimization")),
        word(k % 2 == 0, F.lit("Driver")), F.lit("Report"),
        word(k % 7 != 0, F.lit("Var(flag_"), s, F.lit(", 0)")), word(k % 4 == 0, F.lit("Init("), s, F.lit(" + (1))")))
    lines = F.array(F.concat(F.lit("-f"), F.col("event_type"), F.lit("=")), props,
                    F.concat(F.lit("Help "), F.col("event_type")), F.lit("more"))
    return O.options(t.events.select("event_id", lines.alias("lines"))).drop("lines")


@query("o4_declarations", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || ' ' || split_part(p_name, ' ', 1) WHEN 1 THEN 'int *' WHEN 3 THEN p_type || ' ' || split_part(p_name, ' ', 1) END AS type_,
  CASE p_size % 4 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN replace(p_name, ' ', '_') WHEN 3 THEN split_part(p_name, ' ', 2) END AS name
FROM part""")
def declarations_of_variables(t: Tables):
    size, name = F.col("p_size"), F.col("p_name")
    one_word = F.replace(name, F.lit(" "), F.lit("_"))
    line = (F.when(size % 4 == 0, F.concat("p_brand", F.lit(" "), name))
            .when(size % 4 == 1, F.concat(F.lit("int *"), one_word, F.lit("[3]")))
            .when(size % 4 == 2, one_word).otherwise(F.concat("p_type", F.lit("  "), name, F.lit(" = 4"))))
    return O.with_declaration(t.part.select("p_partkey", line.alias("line")), "line").drop("line")


@query("o5_dispatch", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'variable' WHEN 'click' THEN 'variable' WHEN 'error' THEN 'dropped' ELSE 'option' END AS tag,
  CASE event_type WHEN 'click' THEN 'a variable record needs two lines' END AS problem FROM events""")
def dispatch(t: Tables):
    e = F.col("event_type")
    lines = (F.when(e == "signup", F.array(F.lit("Variable"), F.lit("int x"))).when(e == "click", F.array(F.lit("TargetVariable")))
             .when(e == "error", F.array(F.lit("###"), F.lit("Driver"))).otherwise(F.array(e, F.lit("Driver"))))
    return O.with_tag(t.events.select("event_id", lines.alias("lines"))).drop("lines")


@query("o6_names", """
SELECT c_nationkey::VARCHAR AS name FROM customer WHERE c_nationkey IS NOT NULL
UNION SELECT s_nationkey::VARCHAR FROM supplier WHERE s_nationkey IS NOT NULL""")
def names(t: Tables):
    return O.names(t.customer.select(F.col("c_nationkey").cast("string").alias("name")),
                   t.supplier.select(F.col("s_nationkey").cast("string").alias("name")), "name")


@query("a1_declarations", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS n FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lang END AS returntype, 'page_' || n AS symbol,
  CASE page_id % 3 WHEN 0 THEN 'const char *|unsigned int' WHEN 1 THEN 'const struct ' || lang || ' *|int' ELSE '' END AS paramtypes
FROM p WHERE page_id % 5 <> 4""")
def declarations(t: Tables):
    n, lang, number = F.col("page_id"), F.regexp_extract("url", "/([a-z]{2})/", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    params = (F.when(n % 3 == 0, "const char *, unsigned int x);")
              .when(n % 3 == 1, F.concat(F.lit("const struct "), lang, F.lit(" *s, int count,"))).otherwise("void);"))
    line = F.concat(F.when(n % 2 == 0, F.concat(lang, F.lit(" "))).otherwise(""),
                    F.when(n % 5 == 4, "other_").otherwise("page_"), number, F.lit(" ("), params)
    found = A.declarations(t.pages.select("page_id", line.alias("line")), "line", "page_")
    return found.select("page_id", "returntype", "symbol", F.array_join("paramtypes", "|").alias("paramtypes"))


@query("a2_name_predicates", """
SELECT p_partkey, p_type LIKE 'S%' AS is_builder, p_type LIKE '%M%' AND p_type LIKE 'M%' OR p_type LIKE 'P%' AS is_other,
       p_type LIKE 'S%' AND p_type NOT LIKE 'ST%' AS is_accessor FROM part""")
def name_predicates(t: Tables):
    kind = F.col("p_type")
    return t.part.select("p_partkey", A.has_prefix(kind, "S").alias("is_builder"),
                         (A.has_prefix(kind, "M") | A.has_prefix(kind, "P")).alias("is_other"),
                         A.has_prefix(kind, "S", "ST").alias("is_accessor"))


@query("a3_distinct_by_symbol", """
SELECT split_part(text, chr(10), 1) AS symbol, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY ALL""")
def distinct_by_symbol(t: Tables):
    heads = t.documents.select(F.substring_index("text", "\n", 1).alias("symbol"), "doc_id", "lang")
    return A.distinct_by(heads, "symbol", "doc_id")


@query("a4_exempt", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def exempt(t: Tables):
    return A.without_listed(t.documents.select("doc_id", "lang"), t.labels.where("quality = 1"), ["doc_id"])


@query("a4_listed", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def listed(t: Tables):
    return A.only_listed(t.documents.select("doc_id", "lang"), t.labels.where("quality = 1"), ["doc_id"])


@query("a5_report", """
SELECT 'english' AS title, count(*)::BIGINT AS n FROM documents WHERE lang = 'en'
UNION ALL SELECT 'long_texts', count(*) FROM documents WHERE n_chars > 2000
UNION ALL SELECT 'with_tion', count(*) FROM documents WHERE text LIKE '%tion%'
UNION ALL SELECT 'short_french', count(*) FROM documents WHERE lang = 'fr' AND n_chars < 500""")
def report(t: Tables):
    lang, size = F.col("lang"), F.col("n_chars")
    return A.report(t.documents, english=lang == "en", long_texts=size > 2000,
                    with_tion=F.col("text").contains("tion"), short_french=(lang == "fr") & (size < 500))


_PREFIXES_SQL = """
  SELECT DISTINCT split_part(p_name, ' ', 1) || '_' AS prefix FROM part WHERE p_name NOT LIKE 'hot%' AND p_name NOT LIKE 'blue%'
  UNION SELECT DISTINCT substr(replace(p_name, ' ', '_'), 1, strpos(p_name, ' ') + 1) FROM part WHERE p_name LIKE 'small%'"""


@query("a6_classify", f"""
SELECT p_partkey, coalesce(max_by(prefix, length(prefix)), CASE WHEN p_name LIKE 'hot%' THEN 'hot_' END) AS prefix,
       CASE WHEN max(prefix) IS NULL AND p_name NOT LIKE 'hot%' THEN 'no prefix' END AS problem
FROM part LEFT JOIN ({_PREFIXES_SQL}) ON starts_with(replace(p_name, ' ', '_'), prefix) GROUP BY p_partkey, p_name""")
def classify(t: Tables):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    first = t.part.where("p_name NOT LIKE 'hot%' AND p_name NOT LIKE 'blue%'").select(
        F.concat(F.substring_index("p_name", " ", 1), F.lit("_")).alias("prefix"))
    longer = t.part.where("p_name LIKE 'small%'").select(
        F.substring(name, F.lit(1), F.instr("p_name", " ") + 1).alias("prefix"))
    return A.classify(t.part.select("p_partkey", name.alias("symbol")), "symbol",
                      first.union(longer), "prefix", ["hot_"]).drop("symbol")


@query("a7_without_const", """
SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'non_const_' || p_brand ELSE p_brand END AS kind FROM part""")
def without_const(t: Tables):
    size = F.col("p_size") % 5
    made = F.concat(F.when(size == 0, "const_").when(size == 1, "const ").when(size == 2, "const_const ")
                    .when(size == 4, "non_const_").otherwise(""), F.col("p_brand"))
    return t.part.select("p_partkey", A.without_const(made).alias("kind"))


_PROGRESS_SQL = """
  SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R')::BIGINT AS done, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS todo,
         (count(*) FILTER (l_returnflag = 'R') * 100 // count(*))::BIGINT AS percentage FROM lineitem GROUP BY l_suppkey"""


@query("a8_progress", _PROGRESS_SQL)
def progress(t: Tables):
    return A.progress(t.lineitem, ["l_suppkey"], F.col("l_returnflag") == "R")


@query("a9_complete", """
SELECT l_suppkey, l_partkey, count(*)::BIGINT AS done, 0::BIGINT AS todo, 100::BIGINT AS percentage
FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_returnflag <> 'R') = 0""")
def complete(t: Tables):
    keys = ["l_suppkey", "l_partkey"]
    return A.complete_groups(A.progress(t.lineitem, keys, F.col("l_returnflag") == "R"), keys)


@query("a10_ranked", _PROGRESS_SQL)
def ranked(t: Tables):
    return A.ranked(A.progress(t.lineitem, ["l_suppkey"], F.col("l_returnflag") == "R"), ["l_suppkey"])


@query("a10_top", f"SELECT * FROM ({_PROGRESS_SQL}) ORDER BY percentage DESC, l_suppkey DESC, done DESC, todo DESC LIMIT 20")
def top(t: Tables):
    return A.ranked(A.progress(t.lineitem, ["l_suppkey"], F.col("l_returnflag") == "R"), ["l_suppkey"], 20)


@query("a11_catalogue", r"""
SELECT page_id, generate_subscripts(regexp_extract_all(html, '<(\w+)([^>]*)>', 1), 1)::BIGINT - 1 AS ord,
       unnest(regexp_extract_all(html, '<(\w+)([^>]*)>', 1)) AS tag, unnest(regexp_extract_all(html, '<(\w+)([^>]*)>', 2)) AS attrs FROM pages""")
def catalogue(t: Tables):
    return A.catalogue(t.pages, ["page_id"], "html", r"<(\w+)([^>]*)>", ["tag", "attrs"]).withColumn(
        "ord", F.col("ord").cast("bigint"))


@query("a12_chained_lookup", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def chained_lookup(t: Tables):
    return A.chained_lookup(t.customer.select("c_custkey", "c_nationkey"), [
        (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]).select(
        "c_custkey", "n_name", "r_name")


_EDGES_SQL = """
  SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer
  UNION SELECT 'N' || n_nationkey, replace(r_name, ' ', '_') FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT replace(r_name, ' ', '_'), NULL FROM region"""


def _class_texts(t: Tables):
    declare = lambda child, parent: F.concat(F.lit("struct GTY((tag (X)))\n  "), child, F.lit(" : public "), parent, F.lit("\n{"))
    customers = t.customer.select(declare(F.concat(F.lit("C"), F.col("c_custkey").cast("string")),
                                          F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("text"))
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return customers.union(joined.select(
        declare(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")),
                F.replace("r_name", F.lit(" "), F.lit("_")))))


def _edges(t: Tables):
    roots = t.region.select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("child"), F.lit(None).cast("string").alias("parent"))
    return A.class_edges(_class_texts(t), "text", roots)


_CLOSURE_SQL = """
  WITH RECURSIVE e AS (""" + _EDGES_SQL + """),
    up(node, ancestor, depth) AS (SELECT child, child, 0 FROM e UNION ALL
      SELECT node, parent, depth + 1 FROM up JOIN e ON child = ancestor WHERE parent IS NOT NULL)
  SELECT node, ancestor, depth FROM up"""


@query("a13_class_edges", _EDGES_SQL)
def class_edges(t: Tables):
    return _edges(t)


@query("a14_ancestors", f"""
SELECT node, string_agg(ancestor, '/' ORDER BY depth DESC) AS path FROM ({_CLOSURE_SQL}) GROUP BY node""")
def ancestors(t: Tables):
    return A.ancestors(H.related(_edges(t))).select("node", F.array_join("path", "/").alias("path"))


@query("a15_descendants", f"SELECT ancestor AS node, node AS descendant, depth FROM ({_CLOSURE_SQL})")
def descendants(t: Tables):
    return A.descendants(H.related(_edges(t)))


@query("a16_castable", f"""
SELECT c_custkey, ancestor FROM customer JOIN ({_CLOSURE_SQL}) ON node = 'N' || c_nationkey""")
def castable(t: Tables):
    codes = t.customer.select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("struct"))
    return H.castable(codes, _edges(t), "struct", "c_custkey").select("c_custkey", "ancestor")


@query("a17_names", """
WITH s AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'gimple_statement_base' WHEN 1 THEN 'gimple_statement_with_ops'
    WHEN 2 THEN 'gimple_statement_omp' WHEN 3 THEN 'other_' || lower(p_type) ELSE 'gimple_statement_' || lower(p_type) END AS struct,
    CASE p_size % 3 WHEN 0 THEN 'gimple_with_cleanup_expr' ELSE 'gimple_' || lower(p_type) END AS kind FROM part)
SELECT p_partkey, CASE struct WHEN 'gimple_statement_base' THEN 'gsbase' WHEN 'gimple_statement_with_ops' THEN 'gsops'
    WHEN 'gimple_statement_omp' THEN 'omp' ELSE CASE WHEN struct LIKE 'gimple%' THEN 'gimple_' || substr(struct, 18) END END AS union_field,
  CASE WHEN struct LIKE 'gimple%' THEN substr(struct, 18) || '_stmt' END AS instance_name,
  CASE kind WHEN 'gimple_with_cleanup_expr' THEN 'gimple_wce_' ELSE kind || '_' END AS accessor_prefix FROM s""")
def naming(t: Tables):
    size, kind = F.col("p_size"), F.lower("p_type")
    struct = (F.when(size % 8 == 0, "gimple_statement_base").when(size % 8 == 1, "gimple_statement_with_ops")
              .when(size % 8 == 2, "gimple_statement_omp").when(size % 8 == 3, F.concat(F.lit("other_"), kind))
              .otherwise(F.concat(F.lit("gimple_statement_"), kind)))
    code = F.when(size % 3 == 0, "gimple_with_cleanup_expr").otherwise(F.concat(F.lit("gimple_"), kind))
    return t.part.select("p_partkey", A.union_field(struct).alias("union_field"),
                         A.instance_name(struct).alias("instance_name"), A.accessor_prefix(code).alias("accessor_prefix"))


# A field with flags is written with one blank on each side of the bars.
_FIELD_SQL = r"""CASE WHEN len(f) = 3 THEN array_to_string(list_transform(string_split(
  regexp_replace(replace(f[{}], chr(10), ' '), '^\s+|\s+$', '', 'g'), '|'), lambda x: trim(x)), ' | ') END"""


@query("a18_initializers", f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS sentence,
                  generate_subscripts(string_split(text, '.'), 1)::BIGINT - 1 AS nth FROM documents),
     g AS (SELECT doc_id, nth, string_split(sentence, ',') AS f FROM s),
     f AS (SELECT doc_id, nth, CASE WHEN len(f) = 4 AND regexp_matches(f[4], '^\\s*$') THEN f[:3] ELSE f END AS f FROM g)
SELECT doc_id, nth, {_FIELD_SQL.format(1)} AS kind, {_FIELD_SQL.format(2)} AS name, {_FIELD_SQL.format(3)} AS gate,
       CASE WHEN len(f) <> 3 THEN 'wrong number of fields' END AS problem FROM f""")
def initializers(t: Tables):
    names_ = ["kind", "name", "gate"]
    sentences = S.unnest(t.spread("documents"), ["doc_id"], F.split("text", "[.]", -1), "fields", "nth")
    return A.initializers(sentences, "fields", names_).select(
        "doc_id", F.col("nth").cast("bigint").alias("nth"), *names_, "problem")


@query("a18_passes", """
SELECT p_partkey, 'pass_' || p_partkey AS passname, '"p' || p_partkey || '"' AS name, 'OPTGROUP_A | OPTGROUP_' || p_size AS optinfo_flags,
       CASE WHEN p_size % 4 = 0 THEN 'NULL' ELSE 'gate_' || p_size END AS gate, p_size % 4 <> 0 AS has_gate,
       CASE WHEN p_size % 5 = 0 THEN 'sub is not NULL' END AS problem FROM part""")
def passes(t: Tables):
    n, size = F.col("p_partkey").cast("string"), F.col("p_size")
    gate = F.when(size % 4 == 0, "NULL").otherwise(F.concat(F.lit("gate_"), size.cast("string")))
    text = F.concat(F.lit("static struct gimple_opt_pass pass_"), n, F.lit(' =\n{\n {\n  GIMPLE_PASS,\n  "p'), n,
                    F.lit('",\t/* name */\n  OPTGROUP_A\n    | OPTGROUP_'), size.cast("string"), F.lit(",\n  "), gate, F.lit(",\n  run,\n  "),
                    F.when(size % 5 == 0, "below").otherwise("NULL"),
                    F.lit(",\n  NULL,\n  0,\n  TV_NONE,\n  0,\n  0,\n  0,\n  0,\n  TODO_a,\n }\n};\n"))
    found = A.catalogue(t.part.select("p_partkey", text.alias("text")), ["p_partkey"], "text", rules.PASS_INITIALIZER,
                        ["static", "passkind", "passname", "fields"])
    parsed = A.initializers(found, "fields", rules.PASS_FIELDS, rules.PASS_FIXED)
    return parsed.select("p_partkey", "passname", F.col("name"), "optinfo_flags", "gate", A.has_value(F.col("gate")).alias("has_gate"), "problem")


@query("a18_summaries", """
SELECT p_partkey, 'gen_' || p_size AS generate_summary, '{}' AS write_summary, 'NULL' AS variable_transform,
       CASE WHEN p_size % 3 <> 0 THEN 'w_' || p_size END AS extra_write, CASE WHEN p_size % 3 = 0 THEN 'wrong number of fields' END AS problem FROM part""")
def summaries(t: Tables):
    size = F.col("p_size").cast("string")
    arguments = F.concat(F.lit("  p (c)\n    : d (data, c,\n      gen_"), size, F.lit(
        ", /* generate_summary */\n      {},\n      a, b, c, d, 0, e,\n      {}"))
    # Empty extra fields are left out; a third of the rows has one field too few.
    extra = F.concat(F.lit(" ,gen, w_"), size, F.lit(",, r, wo, ro,\n fix, 0, t"), F.when(F.col("p_size") % 3 == 0, "").otherwise(", v"))
    made = A.constructor_fields(F.col("arguments"), rules.SUMMARY_FIELDS)
    df = A.initializers(t.part.select("p_partkey", arguments.alias("arguments"), extra.alias("extra")),
                        "extra", rules.SUMMARY_FIELDS, drop_empty=True).select(
                            "p_partkey", "problem", F.col("write_summary").alias("extra_write"), made.alias("f"))
    return df.select("p_partkey", "f.generate_summary", "f.write_summary", "f.variable_transform", "extra_write", "problem")


@query("a18_declarations", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'gimple_opt_pass' ELSE 'rtl_opt_pass' END AS kind,
       'pass_' || p_size AS passname FROM part WHERE p_size % 7 <> 0""")
def pass_declarations(t: Tables):
    size = F.col("p_size")
    kind = F.when(size % 7 == 0, "other_pass").when(size % 2 == 0, "gimple_opt_pass").otherwise("rtl_opt_pass")
    text = F.concat(F.lit("/* One.  */\nextern struct "), kind, F.lit(" pass_"), size.cast("string"), F.lit(";\n"))
    return A.catalogue(t.part.select("p_partkey", text.alias("text")), ["p_partkey"], "text", rules.PASS_DECLARATION,
                       ["kind", "passname"]).drop("ord")


@query("a20_listed", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pass_ccp' WHEN 1 THEN 'pass_vrp' ELSE 'pass_' || source END AS passname, doc_id % 3 < 2 AS several
FROM documents""")
def listed(t: Tables):
    n = F.col("doc_id")
    name = F.when(n % 3 == 0, "pass_ccp").when(n % 3 == 1, "pass_vrp").otherwise(F.concat(F.lit("pass_"), F.col("source")))
    return A.with_listed(t.documents.select("doc_id", name.alias("passname")), "passname", rules.MULTI_INSTANCE_PASSES, "several")


@query("a19_flag_counts", r"""
WITH q AS (SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS item FROM pages WHERE url LIKE '%?%')
SELECT split_part(item, '=', 1) AS flag, count(*)::BIGINT AS n FROM q GROUP BY ALL""")
def flag_counts(t: Tables):
    params = F.regexp_extract("url", r"\?([^#]*)", 1)
    field = F.replace(F.regexp_replace(params, "=[^&]*", " "), F.lit("&"), F.lit(" | "))
    return A.flag_counts(t.pages.where(F.col("url").contains("?")).select(field.alias("field")), "field")


@query("a19_null_test", """
SELECT doc_id, coalesce(quality, 0) <> 0 AS has_quality, coalesce(toxic, 0) <> 0 AS has_toxic FROM labels""")
def null_test(t: Tables):
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return t.labels.select("doc_id", A.has_value(field("quality")).alias("has_quality"),
                           A.has_value(field("toxic")).alias("has_toxic"))


@query("a20_repeated", """
SELECT doc_id, count(*) OVER (PARTITION BY text)::BIGINT AS n FROM documents
QUALIFY count(*) OVER (PARTITION BY text) > 1""")
def repeated(t: Tables):
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    many = A.repeated(hashed, ["digest"])
    return sizing.lookup_join(hashed, many, ["digest"], "inner", ["doc_id"]).select("doc_id", "n")


_PLAN_SQL = """
  SELECT doc_id, section, 'gcc/f' || (doc_id % 50) || '.cc' AS path, CASE WHEN doc_id % 3 = 0 THEN 'by ' || lang END AS remark
  FROM (SELECT *, last_value(CASE WHEN doc_id % 10 = 1 THEN 'Files to move to ``gcc/' || before || '/``' END IGNORE NULLS)
                    OVER (ORDER BY doc_id) AS section
        FROM (SELECT *, lag(source) OVER (ORDER BY doc_id) AS before FROM documents))
  WHERE section IS NOT NULL AND doc_id % 10 > 1"""


def _plan(t: Tables):
    n = F.col("doc_id")
    line = (F.when(n % 10 == 0, F.concat(F.lit("Files to move to ``gcc/"), F.col("source"), F.lit("/``")))
            .when(n % 10 == 1, "=========================")
            .otherwise(F.concat(F.lit("  gcc/f"), (n % 50).cast("string"), F.lit(".cc"),
                                F.when(n % 3 == 0, F.concat(F.lit("   # by "), F.col("lang"))).otherwise(""))))
    return A.plan_lines(t.documents.select("doc_id", line.alias("line")), [], "doc_id", "line")


@query("a21_move_plan", f"""
SELECT *, regexp_extract(section, '``([^`]+?)/?``', 1) || '/' || regexp_extract(path, '([^/]*)$', 1) AS new_path FROM ({_PLAN_SQL})""")
def move_plan(t: Tables):
    return _plan(t).withColumn("new_path", A.new_path(F.col("section"), F.col("path")))


@query("a21_section_sizes", f"SELECT section, count(*)::BIGINT AS n_files FROM ({_PLAN_SQL}) GROUP BY section")
def section_sizes(t: Tables):
    return _plan(t).groupBy("section").agg(F.count("*").alias("n_files"))


@query("a21_in_several", f"SELECT path, count(DISTINCT section)::BIGINT AS n FROM ({_PLAN_SQL}) GROUP BY path HAVING count(DISTINCT section) > 1")
def in_several(t: Tables):
    return A.in_several(_plan(t), "path", "section")


@query("a21_unclassified", f"""
SELECT doc_id FROM documents WHERE 'gcc/f' || (doc_id % 1000) || '.cc' NOT IN (SELECT path FROM ({_PLAN_SQL}))""")
def unclassified(t: Tables):
    files = t.documents.select("doc_id", F.concat(F.lit("gcc/f"), (F.col("doc_id") % 1000).cast("string"), F.lit(".cc")).alias("path"))
    return A.without_listed(files, _plan(t), ["path"], ["doc_id"]).select("doc_id")
