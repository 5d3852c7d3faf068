import random
import re

import pytest
from pyspark.sql import functions as F

from spanwright import rules
from spanwright.functions import spans as S
from spanwright.operators import match as M
from spanwright.operators import rewrite as R


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


NAMES = {"node": "node_t *", "node_base": "node", "const_node": "const node *"}


def test_rename_is_simultaneous_and_swallows_a_blank(spark):
    df = frame(spark, ["node x; node_base y; const_node *z; mynode node1", "f (node, const_node)", "node"])
    out = [r.o for r in df.orderBy("id").select(R.rename_identifiers(F.col("text"), NAMES).alias("o")).collect()]
    assert out == ["node_t *x; node y; const node **z; mynode node1", "f (node_t *, const node *)", "node_t *"]
    subject = df.select(R.rename_identifiers(F.col("text"), NAMES, swallow_blank=False).alias("o")).first().o
    assert subject.startswith("node_t * x;")


def test_table_rename_by_expression_and_by_join_agree(spark):
    rng = random.Random(31)
    words = ["alpha", "beta", "gamma", "delta_1", "x"]
    texts = [rng.choice([" ", ".", "é"]).join(rng.choice(words + ["other"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    table = spark.createDataFrame([(w, w.upper()) for w in words], "old string, new string")
    df = frame(spark, texts)
    small = {r.id: r.renamed for r in R.rename_by_table(df, "id", "text", table).collect()}
    joined = {r.id: r.renamed for r in R.rename_by_table(df, "id", "text", table, inline_bytes=0).collect()}
    expected = {i: re.sub("[_a-zA-Z0-9]+", lambda m: m.group().upper() if m.group() in words else m.group(), t)
                for i, t in enumerate(texts)}
    assert small == expected and joined == expected


def test_templates_reach_nested_uses(spark):
    rule = [R.Template("get", r"GET \((.+)\)", "get_one ({1})", 1)]
    out = R.expand_templates(frame(spark, ["GET (GET (GET (a)))", "none"]), "text", rule).orderBy("id").collect()
    assert [(r.expanded, r.passes, r.settled) for r in out] == [
        ("get_one (get_one (get_one (a)))", 3, True), ("none", 0, True)]


def test_templates_reach_any_depth(spark):
    rule = [R.Template("f", r"g \((.+)\)", "f ({1})", 1)]
    deep = "g (" * 100 + "x" + ")" * 100
    r = R.expand_templates(frame(spark, [deep]), "text", rule).first()
    assert (r.expanded, r.passes, r.settled) == (deep.replace("g", "f"), 100, True)


def test_long_rule_lists(spark):
    names = {f"n{i}": f"m{i} *" for i in range(500)}
    out = frame(spark, ["n1 x n499; n500 n1"]).select(R.rename_identifiers(F.col("text"), names).alias("o")).first().o
    assert out == "m1 *x m499 *; n500 m1 *"


def test_odd_rule_tables_give_the_same_on_both_sides(spark):
    table = spark.createDataFrame([("a", "z"), ("a", "y"), (None, "q"), ("b", None)], "old string, new string")
    df = frame(spark, ["a b c"])
    for size in (R.INLINE_BYTES, 0):
        assert R.rename_by_table(df, "id", "text", table, inline_bytes=size).first().renamed == "y b c"


def test_templates_that_do_not_settle_are_marked(spark):
    rule = [R.Template("grow", "a", "aa")]
    r = R.expand_templates(frame(spark, ["a"]), "text", rule, max_passes=3).first()
    assert not r.settled


def test_wrap_twice_changes_nothing(spark):
    df = frame(spark, ["return fast > 0 && level;", "OPT (fast)", "faster level2"])
    once = df.select("id", R.wrap_identifiers(F.col("text"), ["fast", "level"], "OPT").alias("text"))
    twice = once.select("id", R.wrap_identifiers(F.col("text"), ["fast", "level"], "OPT").alias("text"))
    assert [r.text for r in once.orderBy("id").collect()] == ["return OPT (fast) > 0 && OPT (level);", "OPT (fast)", "faster level2"]
    assert once.orderBy("id").collect() == twice.orderBy("id").collect()


def test_prefix_strip(spark):
    out = frame(spark, ["a->symbol.x; b->symbol. y; c.symbol.z"]).select(
        R.strip_prefix(F.col("text"), "->", r"symbol\.").alias("o")).first().o
    assert out == "a->x; b->symbol. y; c.symbol.z"


def test_overlapping_edits_are_set_apart(spark):
    texts = frame(spark, ["abcdef", "abcdef", "abcdef", "abc"])
    edits = spark.createDataFrame([(0, 1, 2, "X"), (0, 3, 5, ""), (0, 3, 5, ""), (1, 0, 3, "Y"), (1, 2, 4, "Z"), (3, 2, 9, "")],
                                  "id int, start bigint, end bigint, repl string")
    rows = R.apply_edits(texts, "id", "text", edits).collect()
    assert {r.id: r.edited for r in rows} == {0: "aXcf", 1: "abcdef", 2: "abcdef", 3: "abc"}
    assert sorted(r.id for r in rows if r.problem) == [1, 3]


def touched(text, edits):
    """New text and touched lines, by brute force on characters."""
    out, marks, at = "", [], 0
    for a, b, r in edits:
        out += text[at:a]
        marks += [False] * (a - at)
        out += r
        marks += [True] * len(r)
        at = b
    out += text[at:]
    marks += [False] * (len(text) - at)
    result, start = [], 0
    for line in out.split("\n"):
        result.append((line, any(marks[start:start + len(line)])))
        start += len(line) + 1
    return result


def test_touched_lines_on_random_edits(spark):
    rng = random.Random(32)
    rows = []
    for i in range(80):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randrange(120)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(12)) // 2 * 2))
        rows.append((i, text, [(a, b, rng.choice(["", "\n", "X", "Y\nZ"])) for a, b in zip(cuts[::2], cuts[1::2])]))
    df = spark.createDataFrame(rows, "id int, text string, edits array<struct<start:bigint,end:bigint,repl:string>>")
    df = df.withColumn("edited", S.splice(F.col("text"), F.col("edits")))
    for r in R.touched_lines(df, "edited", "edits").collect():
        assert [(x.line, x.touched) for x in r.lines] == touched(r.text, [tuple(e) for e in r.edits])


def test_line_changes_count_repeats(spark):
    df = spark.createDataFrame([(1, "a\na\nb", "a\nc\nb"), (2, "same", "same")], "id int, before string, after string")
    out = {(r.id, r.line, r.change, r.n) for r in R.line_changes(df, ["id"], "before", "after").collect()}
    assert out == {(1, "a", "removed", 1), (1, "c", "added", 1)}


def test_long_lines_count_tabs(spark):
    df = frame(spark, ["\t" * 10 + "x\nshort", "\t" * 10, "y" * 81 + "\n" + "z" * 90])
    out = {r.id: (r.n_long, r.longest) for r in R.long_lines(df, ["id"], "text").collect()}
    assert out == {0: (1, 81), 2: (2, 90)}


def test_excluded_lines(spark):
    found = spark.createDataFrame([(1, "  keep me;"), (2, "  drop me;  "), (3, "\tdrop me;")], "id int, line string")
    listed = spark.createDataFrame([("drop me;",)], "line string")
    assert [r.id for r in M.drop_excluded_lines(found, listed).collect()] == [1]


def test_rule_lists():
    assert len(rules.statement_class_renames()) == 30 * 3 + 1
    assert len(rules.CFG_MACROS) == 13 and len(rules.CFG_FIELD_RULES) == 8
    assert len(rules.MULTI_INSTANCE_PASSES) == 33 and len(rules.PASS_FIELDS) == 14


@pytest.mark.parametrize("n", [1, 199, 200, 201, 400])
def test_names_that_are_no_identifiers_are_an_error_at_every_size(spark, n):
    names = {f"n{i}": f"m{i}" for i in range(n - 1)} | {"last": "new"}
    out = frame(spark, ["a.last last n0. n7last"]).select(R.rename_identifiers(F.col("text"), names).alias("o")).first().o
    assert out == f"a.new new {'m0' if n > 1 else 'n0'}. n7last"
    for odd in ("a.b", "", "a b", "é"):
        with pytest.raises(ValueError, match="not an identifier"):
            R.rename_identifiers(F.col("text"), names | {odd: "c"})


def test_rules_of_a_table_that_rename_nothing(spark):
    rules = spark.createDataFrame([("a.b", "c"), ("x", "y"), (None, "z"), ("q", None), ("a\n", "b")], "old string, new string")
    assert {(r.old, r.problem) for r in R.unfit_rules(rules).collect()} == {
        ("a.b", R.NO_IDENTIFIER), ("a\n", R.NO_IDENTIFIER), (None, "a rule needs an old and a new name"), ("q", "a rule needs an old and a new name")}
    for size in (0, 8 << 20):
        assert R.rename_by_table(frame(spark, ["use a.b x"]), "id", "text", rules, inline_bytes=size).first().renamed == "use a.b y"
