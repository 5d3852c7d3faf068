import pytest
from pyspark.sql import functions as F

from spanwright import rules
from spanwright.operators import inventory as A
from spanwright.operators import records as O
from spanwright.sources import scan

OPTION_FILE = """; a comment
Variable
int flag_x = 3

; comment only, does not end the record
fast
Common Report Var(flag_fast, 0) Optimization Init(-1) ; trailing
Make it
fast.

-param=
Target Common Driver Var(param_no) Alias(x y)

###
Driver

bad
C Warning Optimization

TargetVariable
char *names[4]

last
Joined"""


def option_records(spark, strict=False):
    df = spark.createDataFrame([("a.opt", OPTION_FILE)], "path string, text string")
    lines = scan.lines(df, ["path"], "text")
    return O.records(lines, ["path"], "line_no", "line", strict)


def test_records_are_cut_at_blank_lines(spark):
    got = [r.lines for r in option_records(spark).orderBy("record").collect()]
    assert got == [["Variable", "int flag_x = 3"],
                   ["fast", "Common Report Var(flag_fast, 0) Optimization Init(-1) ", "Make it", "fast."],
                   ["-param=", "Target Common Driver Var(param_no) Alias(x y)"], ["###", "Driver"],
                   ["bad", "C Warning Optimization"], ["TargetVariable", "char *names[4]"], ["last", "Joined"]]
    assert option_records(spark, strict=True).count() == 6


def test_options_and_variables(spark):
    tagged = O.with_tag(option_records(spark))
    assert tagged.where("problem IS NOT NULL").count() == 0
    found = O.options(tagged.where("tag = 'option'").drop("tag", "problem"))
    good, bad = found.where("problem IS NULL"), found.where("problem IS NOT NULL")
    rows = {r.name: r for r in good.collect()}
    fast = rows["fast"]
    assert (fast.availability, fast.kind, fast.driver, fast.report, fast["var"], fast.init, fast.helptext) == (
        "Common", "Optimization", False, True, "flag_fast", "-1", "Make it\nfast.")
    param = rows["param"]
    assert (param.availability, param.kind, param.driver, param["var"]) == ("Target", None, True, "param_no")
    assert [r["name"] for r in bad.collect()] == ["bad"]
    declared = tagged.where("tag = 'variable'").withColumn("line", F.element_at("lines", 2)).drop("lines", "tag", "problem")
    assert {(r.type_, r["name"]) for r in O.with_declaration(declared, "line").collect()} == {("int", "flag_x"), ("char *", "names")}
    names = O.names(good.select(F.col("var").alias("name")), O.with_declaration(declared, "line"), "name")
    assert {r["name"] for r in names.collect()} == {"flag_fast", "param_no", "flag_x", "names"}


@pytest.mark.parametrize("line, words", [
    ("Common Var(flag_x, 0) Report", ["Common", "Var(flag_x, 0)", "Report"]),
    ("  a  b(c   d) e", ["a", "b(c d)", "e"]),
    ("x(never closed", ["x(never closed"]),
    ("", []),
])
def test_properties(spark, line, words):
    assert spark.createDataFrame([(line,)], "l string").select(O.properties(F.col("l")).alias("p")).first().p == words


DEFINITIONS = """/* A comment.  */
DEFGSSTRUCT(GSS_BASE, gimple, false)
DEFGSSTRUCT(GSS_COND, gimple_statement_cond, true)
DEFGSCODE(GIMPLE_COND, "gimple_cond", GSS_COND)
DEFGSCODE(GIMPLE_NOP,
	  "gimple_nop", GSS_BASE)
"""


def test_catalogue_and_chained_lookup(spark):
    df = spark.createDataFrame([(DEFINITIONS,)], "text string")
    structs = A.catalogue(df, [], "text", A.STRUCT_ENTRY, ["gss", "struct", "has_tree_operands"])
    codes = A.catalogue(df, [], "text", A.CODE_ENTRY, ["code", "printable_name", "gss"])
    out = A.chained_lookup(codes.select("code", "gss"), [(structs.select("gss", "struct"), "gss", "gss")])
    assert {(r.code, r.struct) for r in out.collect()} == {("GIMPLE_COND", "gimple_statement_cond"), ("GIMPLE_NOP", "gimple")}


CLASSES = """struct GTY((tag("A")))
  gimple_statement_one : public gimple_statement_with_ops_base
{
};
struct GTY((tag("B"))) gimple_statement_two : public gimple_statement_one
{
};
struct GTY((tag("C"))) gimple_statement_three : public gimple_statement_one
{
};
"""


def test_hierarchy(spark):
    edges = A.class_edges(spark.createDataFrame([(CLASSES,)], "text string"), "text", rules.class_roots(spark))
    closed = A.closure(edges)
    up = {r.node: r.path for r in A.ancestors(closed).collect()}
    assert up["gimple_statement_two"] == ["gimple_statement_base", "gimple_statement_with_ops_base",
                                          "gimple_statement_one", "gimple_statement_two"]
    assert up["gimple_statement_base"] == ["gimple_statement_base"]
    down = {(r.node, r.descendant) for r in A.descendants(closed).collect()}
    assert down == {(a, n) for n, path in up.items() for a in path}
    codes = spark.createDataFrame([(2, "C3", "gimple_statement_three"), (1, "C2", "gimple_statement_two"), (0, "C0", "gimple_statement_base")],
                                  "ord int, code string, struct string")
    cast = A.castable(codes, closed, "struct", "ord").where("ancestor = 'gimple_statement_one'").collect()
    assert [r.code for r in cast] == ["C2", "C3"]


def test_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "c")], "child string, parent string")
    assert {(r.node, r.ancestor, r.depth) for r in A.closure(edges).collect()} == {
        ("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "a", 1), ("c", "a", 1), ("c", "b", 2)}


def test_a_deep_chain_is_closed(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], "child string, parent string")
    closed = A.closure(edges)
    assert closed.count() == 101 * 102 // 2
    assert closed.where("node = 'n0' AND ancestor = 'n100'").first().depth == 100


INITIALIZER = """static struct gimple_opt_pass pass_one =
{
 {
  GIMPLE_PASS,
  "one",				/* name */
  OPTGROUP_A | OPTGROUP_B,     /* optinfo_flags */
  gate_one,
  0,
  NULL,
  NULL,
  0,
  TV_NONE,
  PROP_cfg,
  0,
  0,
  0,
  TODO_a
    | TODO_b,
 }
};
"""


def test_initializers(spark):
    short = INITIALIZER.replace('  gate_one,\n', "").replace("TODO_b,", "TODO_b").replace("pass_one", "pass_two")
    odd = INITIALIZER.replace("  NULL,\n  NULL,", "  sub,\n  NULL,").replace("pass_one", "pass_three")
    df = spark.createDataFrame([(INITIALIZER + short + odd,)], "text string")
    found = A.catalogue(df, [], "text", rules.PASS_INITIALIZER, ["static", "passkind", "passname", "fields"])
    parsed = A.initializers(found, "fields", rules.PASS_FIELDS, rules.PASS_FIXED)
    good, bad = parsed.where("problem IS NULL"), parsed.where("problem IS NOT NULL")
    rows = good.collect()
    assert [r.passname for r in rows] == ["pass_one"]
    assert (rows[0]["name"], rows[0].optinfo_flags, rows[0].todo_flags_finish) == (
        '"one"', "OPTGROUP_A | OPTGROUP_B", "TODO_a | TODO_b")
    assert {(r.passname, r.problem) for r in bad.collect()} == {
        ("pass_two", "wrong number of fields"), ("pass_three", "sub is not NULL")}
    tests = good.select(A.has_value(F.col("gate")).alias("gate"), A.has_value(F.col("execute")).alias("execute")).first()
    assert (tests.gate, tests.execute) == (True, False)
    counts = {r.flag: r.n for r in A.flag_counts(good, "todo_flags_finish").collect()}
    assert counts == {"TODO_a": 1, "TODO_b": 1}


def test_extra_fields_leave_out_empty_ones(spark):
    df = spark.createDataFrame([("a,,b",), ("a, ,b,",), ("a,b,c",)], "fields string")
    rows = A.initializers(df, "fields", ["x", "y"], drop_empty=True).collect()
    assert [(r.x, r.y, r.problem) for r in rows] == [("a", "b", None), ("a", "b", None), (None, None, "wrong number of fields")]


def test_declarations(spark):
    lines = ["tree gimple_a (const_gimple gs, unsigned int *n, bool);", "gimple_b (FILE *, const char *,", "static gimple_c (x);", "static inline tree gimple_d (x);"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    rows = {r.symbol: (r.returntype, r.paramtypes) for r in A.declarations(df, "line", "gimple_").collect()}
    assert rows == {"gimple_a": ("tree", ["const_gimple", "unsigned int *", ""]), "gimple_b": (None, ["FILE", "const char"]),
                    "gimple_c": ("static", [""])}


def test_percentage_is_rounded_down(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("a", False), ("b", True)], "g string, done boolean")
    stats = A.progress(df, ["g"], F.col("done"))
    assert {r.g: r.percentage for r in stats.collect()} == {"a": 66, "b": 100}
    assert [r.g for r in A.complete_groups(stats, ["g"]).collect()] == ["b"]
    assert [r.g for r in A.ranked(stats, ["g"]).collect()] == ["b", "a"]


PLAN = """Files to stay where they are
============================
text

  gcc/alias.cc   # uses both
  gcc/alias.h

Files to move to ``gcc/ipa/``
=============================

Proposed::

  gcc/profile.cc
  gcc/alias.h
"""


def test_move_plan(spark):
    lines = scan.lines(spark.createDataFrame([("p", PLAN)], "id string, text string"), ["id"], "text")
    plan = A.plan_lines(lines, ["id"], "line_no", "line").withColumn("new_path", A.new_path(F.col("section"), F.col("path")))
    rows = [(r.path, r.remark, r.new_path) for r in plan.orderBy("line_no").collect()]
    assert rows == [("gcc/alias.cc", "uses both", "gcc/alias.cc"), ("gcc/alias.h", None, "gcc/alias.h"),
                    ("gcc/profile.cc", None, "gcc/ipa/profile.cc"), ("gcc/alias.h", None, "gcc/ipa/alias.h")]
    assert [r.path for r in A.in_several(plan, "path", "section").collect()] == ["gcc/alias.h"]


def test_names(spark):
    df = spark.createDataFrame([("gimple_statement_with_ops",), ("gimple_statement_cond",), ("tree",)], "s string")
    rows = df.select(A.union_field(F.col("s")).alias("u"), A.instance_name(F.col("s")).alias("i")).collect()
    assert [(r.u, r.i) for r in rows] == [("gsops", "with_ops_stmt"), ("gimple_cond", "cond_stmt"), (None, None)]


def test_longest_prefix_wins(spark):
    df = spark.createDataFrame([("omp_task_x",), ("omp_taskgroup_x",), ("gimple_omp_y",), ("zzz",)], "symbol string")
    prefixes = spark.createDataFrame([("omp_",), ("omp_task_",), ("omp_taskgroup_",)], "prefix string")
    found = A.classify(df, "symbol", prefixes, "prefix", ["gimple_omp_"])
    good, bad = found.where("problem IS NULL"), found.where("problem IS NOT NULL")
    assert {r.symbol: r.prefix for r in good.collect()} == {
        "omp_task_x": "omp_task_", "omp_taskgroup_x": "omp_taskgroup_", "gimple_omp_y": "gimple_omp_"}
    assert [r.symbol for r in bad.collect()] == ["zzz"]


def test_option_catalogue(spark):
    from spanwright.plans.options import catalogue
    text = OPTION_FILE.replace("int flag_x = 3", "flag_x") + "\n\nVariable\n"
    found = catalogue(spark.createDataFrame([("a.opt", text)], "path string, text string"))
    assert {r["name"] for r in found.names.collect()} == {"flag_fast", "param_no", "names"}
    assert {r["name"] for r in found.options.collect()} == {"fast", "param", "last"}
    assert sorted(r.problem for r in found.problems.collect()) == [
        "a declaration needs a type and a name", "a variable record needs two lines", "more than one kind"]


SUMMARY_PASS = """namespace {

const pass_data pass_data_one =
{
  IPA_PASS, /* type */
  "one", /* name */
};

class pass_one : public ipa_opt_pass_d
{
public:
  pass_one (context *ctxt)
    : ipa_opt_pass_d (pass_data_one, ctxt,
		      generate_one, /* generate_summary */
		      NULL, /* write_summary */
		      NULL, /* read_summary */
		      NULL, /* write_optimization_summary */
		      NULL, /* read_optimization_summary */
		      NULL, /* stmt_fixup */
		      0, /* function_transform_todo_flags_start */
		      transform_one, /* function_transform */
		      NULL) /* variable_transform */
  {}

  /* opt_pass methods: */
  bool gate () { return true; }

}; // class pass_one

} // anon namespace
"""


def test_constructor_fields(spark):
    df = spark.createDataFrame([(SUMMARY_PASS,)], "text string")
    found = A.catalogue(df, [], "text", rules.SUMMARY_CLASS, ["data", "passname", "ctor", "methods"])
    r = found.select("data", "passname", A.constructor_fields(F.col("ctor"), rules.SUMMARY_FIELDS).alias("f")).first()
    assert (r.data, r.passname) == ("pass_data_one", "pass_one")
    assert (r.f.generate_summary, r.f.write_summary, r.f.function_transform, r.f.variable_transform) == (
        "generate_one", "NULL", "transform_one", "NULL")
    flags = found.select(A.has_value(A.constructor_fields(F.col("ctor"), rules.SUMMARY_FIELDS)["stmt_fixup"]).alias("h")).first()
    assert flags.h is False
    odd = df.select(F.lit("x\ny\n{},{},{}").alias("c")).select(A.constructor_fields(F.col("c"), ["a", "b", "c"]).alias("f")).first().f
    assert (odd.a, odd.b, odd.c) == ("{}", "{}", "NULL")


def test_catalogue_does_not_depend_on_the_parts(spark):
    from spanwright.plans.options import catalogue
    text = "Wfoo\nCommon Var(flag_foo)\nhelp a\nhelp b\nhelp c\n\nVariable\nint x\n"
    out = []
    for rows in (2, 4096):
        found = catalogue(spark.createDataFrame([("a.opt", text)], "path string, text string"), part_rows=rows)
        out.append(([(r["name"], r["helptext"]) for r in found.options.collect()],
                    sorted(r["name"] for r in found.names.collect()), found.problems.count()))
    assert out[0] == out[1] == ([("Wfoo", "help a\nhelp b\nhelp c")], ["flag_foo", "x"], 0)
