"""Whole runs on small corpora of our own."""

from pyspark.sql import functions as F

from spanwright import rules
from spanwright.operators import changelog as L
from spanwright.plans import conversion, patch_kit
from spanwright.plans import refactor as P


def corpus(spark, **files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def files(spark, pairs):
    return spark.createDataFrame(pairs, "path string, text string")


def header():
    return L.header_line(F.lit("2026-01-01"), F.lit("A Writer"), F.lit("w@example.org"))


def edited(df):
    return {r.path: r.edited for r in df.collect()}


CFG_TEXT = """void
first (void)
{
  /* n_edges is left alone here.  */
  puts ("n_edges in a string");
  total = n_edges + BASIC_BLOCK (BASIC_BLOCK (n_edges));
  FOR_EACH_BB (bb)
    f (cfun->cfg->x_n_edges, NOTE_BASIC_BLOCK (n));
}

void
second (void)
{
  use (n_edges);
}
"""


def test_macros_with_guards_and_log(spark):
    df = files(spark, [("src/gcc/a.c", CFG_TEXT), ("src/gcc/b.c", CFG_TEXT), ("src/gcc/basic-block.h", CFG_TEXT),
                       ("src/gcc/c.c", "nothing here\n"), ("other/d.c", CFG_TEXT)])
    good = P.refactor(df, "path", "text", P.CFG)
    out = edited(good)
    assert good.where("problem IS NOT NULL").count() == 0 and len(out) == 5
    expected = (CFG_TEXT.replace("total = n_edges + BASIC_BLOCK (BASIC_BLOCK (n_edges))",
                                 "total = cfun->cfg->n_edges + cfun->cfg->get_bb (cfun->cfg->get_bb (cfun->cfg->n_edges))")
                .replace("FOR_EACH_BB (bb)", "FOR_EACH_BB (bb, cfun->cfg)")
                .replace("cfun->cfg->x_n_edges", "cfun->cfg->n_edges")
                .replace("use (n_edges)", "use (cfun->cfg->n_edges)"))
    assert out["src/gcc/a.c"] == expected
    assert out["src/gcc/basic-block.h"] == CFG_TEXT and out["src/gcc/c.c"] == "nothing here\n"

    dirs = spark.createDataFrame([("src",), ("src/gcc",)], "dir string")
    logs, homeless = P.change_logs(good, "path", dirs, P.CFG.phrases, header(), F.lit("\tMade by a script."), "first")
    assert {r.path for r in homeless.collect()} == {"other/d.c"}
    log = "".join(r.text for r in logs.where("owner_dir = 'src/gcc'").orderBy("part").collect())
    text = ("Remove uses of macros: BASIC_BLOCK, n_edges.  Added cfun->cfg argument to usage of FOR_EACH_BB macro.  "
            "Drop leading x_ from usage of x_n_edges field.")
    second = "Remove usage of n_edges macro."
    assert log == ("2026-01-01  A Writer  <w@example.org>\n\n\tMade by a script.\n"
                   f"* a.c (first): {text}\n(second): {second}\n* b.c (first): {text}\n(second): {second}\n")


def test_symtab_members_and_casts(spark):
    text = ("void\nfoo (node *n)\n{\n  n->symbol.order = 1;\n  bar ((symtab_node) n);\n"
            "  node = (symtab_node) *slot;\n  first = (symtab_node) (void *) 1;\n}\n")
    tabbed = "void\nbar (void)\n{\n\tnode = (symtab_node) *slot;\n  f ((symtab_node)\n     n->symbol.symbol.x);\n}\n"
    out = edited(P.refactor(files(spark, [("a.c", text), ("a.h", "void reg (symtab_node);\n"), ("b.c", tabbed)]), "path", "text", P.SYMTAB))
    # A tab before a line that needs its cast, a cast at the end of a line, one pass over members.
    assert out["b.c"] == tabbed.replace("((symtab_node)\n", "(\n").replace("->symbol.symbol", "->symbol")
    assert out["a.c"] == text.replace("n->symbol.order", "n->order").replace("((symtab_node) n)", "(n)")
    assert out["a.h"] == "void reg (symtab_node);\n"


def test_statement_renames(spark):
    text = ("/* A gimple statement.  */\nbool\ncheck (const_gimple, gimple g)\n{\n"
            "  gimple stmt = bb->il.gimple.seq;\n  puts (\"gimple\");\n}\nclass gimple;\n")
    out = edited(P.rename_statements(files(spark, [("a.c", text), ("gengtype.c", text)]), "path", "text"))
    assert out["gengtype.c"] == text
    assert out["a.c"] == (text.replace("(const_gimple, gimple g)", "(const gimple *, gimple *g)")
                          .replace("  gimple stmt", "  gimple *stmt"))


def test_class_renames_keep_the_longest_name(spark):
    text = "gimple_switch s;\ngimple_statement_switch t;\nconst_gimple_switch u;\ngimple_switch_p (x);\n"
    out = edited(P.rename_once(files(spark, [("a.c", text)]), "path", "text", rules.statement_class_renames()))
    assert out["a.c"] == "gswitch *s;\ngswitch t;\nconst gswitch *u;\ngimple_switch_p (x);\n"


OPTIONS_TEXT = """int flag_b = 0;
static bool
gate (void)
{
  return optimize > 0 && flag_a; /* optimize */
  x = opt_for_fn (decl, optimize);
  y = GCC_OPTION (flag_a) + "flag_a"[0];
}
"""


def test_options_are_wrapped_once(spark):
    names = spark.createDataFrame([("optimize",), ("flag_a",), ("flag_b",), (None,)], "name string")
    df = files(spark, [("a.c", OPTIONS_TEXT), ("x.md", '\n(define_insn "one"\n  "optimize > 0")\n; optimize\n'),
                       ("gcc-interface/misc.c", OPTIONS_TEXT)])
    once = P.wrap_options(df, "path", "text", names)
    out = edited(once)
    assert out["a.c"] == OPTIONS_TEXT.replace("return optimize > 0 && flag_a;", "return GCC_OPTION (optimize) > 0 && GCC_OPTION (flag_a);")
    again = once.select("path", F.col("edited").alias("text"))
    assert edited(P.wrap_options(again, "path", "text", names)) == out
    assert out["x.md"] == '\n(define_insn "one"\n  "GCC_OPTION (optimize) > 0")\n; optimize\n'
    assert out["gcc-interface/misc.c"] == OPTIONS_TEXT


def test_patch_kit(spark):
    patch = lambda subject, body: f"From: a\nSubject: {subject}\nDate: x\n\n{body}"
    patches = files(spark, [
        ("1.patch", patch("[PATCH 1/3] Add one\n thing", "Text.\n---\ndiff")),
        ("2.patch", patch("[PATCH 2/3] Add two", "gcc/\n\t* a.c: New.\ntest/\n\t* b.c: New.\ngcc/\n\t* c.c: New.\nConflicts:\n\tgcc/a.c\n---\nd")),
        ("3.patch", patch("[PATCH 3/3] Never sent", "T\n---\nd")),
        ("4.patch", patch("[PATCH 3/3] Update the manual", "T\n---\nd"))]).withColumnRenamed("text", "content")
    mails = spark.createDataFrame(
        [(5, "[PATCH 01/89] Add one thing to all", "m5.html", "s"), (2, "[PATCH 02/89] Add one thing", "m2.html", "s"),
         (7, "[PATCH 03/89] Add two", "m7.html", "s"), (1, "Re: [PATCH 02/89] Add one thing", "m1.html", "s")],
        "ord bigint, subject string, href string, sender string")
    approvals = spark.createDataFrame([("[PATCH 02/89] Add one thing", "https://x.org/ok", "Fine.\n  Go on."),
                                       ("[PATCH 03/89] Add two", "https://x.org/ok2", "")],
                                      "subject string, url string, text string")
    done, bad = patch_kit.annotate(patches, mails, approvals, "https://x.org/list/index.html", 89, "kit", "R", ["the manual"])
    rows = done.collect()
    assert [r.path for r in rows] == ["1.patch"] and rows[0].patch_no == 1
    assert rows[0].content == (
        "From: a\nSubject: [PATCH 1/3] Add one\n thing\nDate: x\n\nThis corresponds to:\n  [PATCH 02/89] Add one thing\n"
        "  https://x.org/list/m2.html\nfrom the original kit\n\nThat earlier patch was approved by R:\n> Fine.\n> Go on.\n"
        "in https://x.org/ok\n\nText.\n---\ndiff")
    assert {(r.path, r.problem) for r in bad.collect()} == {
        ("2.patch", "approval not found"), ("3.patch", "no mail for this patch")}
    sections = {(r.path, r.kind, r.section): r.text for r in patch_kit.log_sections(patches).collect()}
    assert sections[("2.patch", "section", "gcc")] == "\t* a.c: New.\n\t* c.c: New."
    assert sections[("2.patch", "section", "test")] == "\t* b.c: New."
    assert sections[("2.patch", "conflicts", "")] == "\tgcc/a.c"
    assert sections[("1.patch", "leading", "")] == "Text."


DIFF = """commit 12
    Fix it
diff --git a/lib/m.c b/lib/m.c
index 0..1 100644
--- a/lib/m.c
+++ b/lib/m.c
@@ -964,6 +964,10 @@ args_ok (reader *r)
 context
@@ -970,6 +970,10 @@ args_ok (reader *r)
+more
@@ -1 +1,2 @@
@@ -9,1 +9,2 @@ struct pair
diff --git a/lib/testsuite/t.c b/lib/testsuite/t.c
new file mode 100644
--- /dev/null
+++ b/lib/testsuite/t.c
@@ -0,0 +1,3 @@
+x
diff --git a/lib/old.c b/lib/old.c
deleted file mode 100644
--- a/lib/old.c
+++ /dev/null
diff --git a/lib/t.exp b/lib/t.exp
--- a/lib/t.exp
+++ b/lib/t.exp
@@ -72,6 +72,14 @@ proc begin { args } {
"""


def test_draft_of_a_diff(spark):
    dirs = spark.createDataFrame([("lib",), ("lib/testsuite",)], "dir string")
    df = spark.createDataFrame([("d", DIFF)], "diff_id string, text string")
    rows = patch_kit.draft(df, dirs).collect()
    assert [(r.path, r.owner_dir, r.scope, r.status_text) for r in rows] == [
        ("lib/m.c", "lib", None, None), ("lib/m.c", "lib", "args_ok", None), ("lib/m.c", "lib", "UNKNOWN", None),
        ("lib/m.c", "lib", "struct pair", None), ("lib/testsuite/t.c", "lib/testsuite", None, "New test."),
        ("lib/old.c", "lib", None, "Deleted file."), ("lib/t.exp", "lib", None, None), ("lib/t.exp", "lib", "begin", None)]
    assert len(patch_kit.draft(df, dirs, keep_repeats=True).collect()) == 9


HEADERS = """gimple gimple_build_nop (void);
gimple_cond gimple_build_cond (enum tree_code, tree, tree);
static inline tree
gimple_cond_lhs (const_gimple gs)
gimple_cond_rhs (const gimple_cond *gs)
gimple_asm_string (gimple_asm *s);
gimple_asm_string (gimple other);
gimple_omp_each (gimple g)
gimple_bb (const_gimple g)
gimple_seq_first (gimple_seq s)
gimple_wce_cleanup (gimple gs, const char *, unsigned int n,
"""


def test_conversion_report(spark):
    df = spark.createDataFrame(list(enumerate(HEADERS.splitlines())), "line_no int, line string")
    found = conversion.accessors(df)
    by_symbol = {r.symbol: r for r in found.collect()}
    assert by_symbol["gimple_asm_string"].paramtypes == ["gimple_asm *"]
    assert by_symbol["gimple_wce_cleanup"].paramtypes == ["gimple", "const char", "unsigned int"] or \
        by_symbol["gimple_wce_cleanup"].paramtypes[0] == "gimple"
    counts = {r.title: r.n for r in conversion.counters(found).collect()}
    assert counts == {"builders_todo": 1, "accessors_todo": 3, "builders_done": 1, "accessors_done": 1, "accessors_exempt": 1}
    codes = spark.createDataFrame([("gimple_cond",), ("gimple_asm",), ("gimple_with_cleanup_expr",)], "printable_name string")
    stats, bad = conversion.progress(found, codes)
    assert {r.prefix: (r.done, r.todo, r.percentage) for r in stats.collect()} == {
        "gimple_cond_": (1, 1, 50), "gimple_asm_": (1, 0, 100), "gimple_omp_": (0, 1, 0), "gimple_wce_": (0, 1, 0)}
    assert bad.count() == 0
