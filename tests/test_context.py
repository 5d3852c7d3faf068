import random
import re

from pyspark.sql import functions as F

from spanwright import rules
from spanwright.functions import spans as S
from spanwright.operators import context as C
from spanwright.plans.refactor import locate


def line_at(text, at):
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    return text[start:len(text) if end < 0 else end]


def in_comment(text, at):
    line = line_at(text, at)
    if "//" in line or line.startswith(";"):
        return True
    opened = text[:at].rfind("/*")
    return opened >= 0 and "*/" not in text[opened:at]


def in_string(text, at):
    inside = False
    for q in (m.start() for m in re.finditer('"', text[:at])):
        before = text[q - 1] if q else ""
        if q and (in_comment(text, q) or before == "\\" or (before == "'" and not inside)):
            continue
        inside = not inside
    return inside


def placed(spark, texts, pattern="x"):
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("found", S.spans(F.col("text"), pattern))
    return df.transform(C.chain(C.with_line("text"), C.with_comment("text"), C.with_string("text"))).collect()


def test_line_comment_and_string_on_random_text(spark):
    rng = random.Random(11)
    parts = ["x", '"', "'", "\\", "/*", "*/", "/*/", "//", "\n", ";", " ", "\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(250))) for _ in range(80)]
    for r in placed(spark, texts):
        for m in r.found:
            at = m["start"]
            assert m.line == line_at(r.text, at) and m.line_no == r.text[:at].count("\n") + 1
            assert m.in_comment == in_comment(r.text, at)
            assert m.in_string == in_string(r.text, at)


def test_comment_and_string_cases(spark):
    cases = [("/* x", True, False), ("/* a */ x", False, False), ("/*/ x", False, False), ('a \\"b x', False, False),
             ('/*"*/ x', False, False), ("u http://y x", True, False), ("; x", True, False), ('"x"', False, True),
             ("'\"' x", False, False)]
    for (text, comment, string), r in zip(cases, placed(spark, [c[0] for c in cases])):
        assert (r.found[0].in_comment, r.found[0].in_string) == (comment, string), text


def scopes(spark, cases):
    """Scope of the place marked @ in each (path, text)."""
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(cases)], "id int, path string, text string")
    df = df.withColumn("found", S.spans(F.col("text"), "@")).transform(locate("path", "text"))
    return [r.found[0].scope for r in df.orderBy("id").collect()]


def test_scopes_of_c(spark):
    cases = [
        ("a.c", "int\nalpha (int a)\n{\n @\n}\n"),
        ("a.c", "int\nalpha (void)\n{\n}\n\nint\nbeta (void)\n{\n  @"),
        # The parameter list is not complete, so the place belongs to the function before.
        ("a.c", "int\nalpha (void)\n{\n}\n\nint\nbeta (int @, int b)\n"),
        ("a.c", "static int gamma_fn (int a,\n  int @);\n"),
        ("a.c", "bool\nhelper <node>::check (base *p)\n{\n  @"),
        ("a.h", "#define TWICE(x) \\\n  @"),
        ("a.h", "struct pair\n{\n  int @;\n"),
        ("a.h", "struct pair {\n  int @;\n"),
        ("a.h", "struct GTY((tag (0))) pair {\n  int @;\n"),
        ("a.h", "  @int value;\n"),
        ("a.md", '\n(define_insn "add_one"\n  (@))'),
        ("a.def", "alpha (1)\n@"),
        # Priority beats recency: a function anywhere before wins over a later struct.
        ("a.c", "alpha (void)\n{\n}\nstruct pair {\n int @;"),
    ]
    assert scopes(spark, cases) == [
        "alpha", "beta", "alpha", "gamma_fn", "helper <node>::check", "TWICE", "struct pair", "struct pair",
        "struct pair", "value", "add_one", None, "alpha"]


def test_scope_fixes(spark):
    df = spark.createDataFrame([("equal", "gimplify.c"), ("equal", "other.c"), ("Copyright", "coretypes.h"), ("fine", "a.c")],
                               "scope string, path string")
    fixed = C.fixed_scopes(df, "scope", "path", rules.scope_fixes(spark), rules.SCOPES_DENIED)
    good, bad = fixed.where("problem IS NULL"), fixed.where("problem IS NOT NULL")
    assert {(r.path, r.scope) for r in good.collect()} == {
        ("gimplify.c", "struct gimplify_ctx"), ("coretypes.h", None), ("a.c", "fine")}
    assert [r.path for r in bad.collect()] == ["other.c"]


def test_annotations_keep_their_length(spark):
    text = 'struct GTY((tag ("A"))) one { GTY((skip)) x; };'
    r = spark.createDataFrame([(text,)], "text string").select(
        C.blanked(F.col("text"), C.ANNOTATION).alias("b"), C.removed(F.col("text"), C.ANNOTATION).alias("r")).first()
    assert len(r.b) == len(text) and "GTY" not in r.b and r.b.split() == r.r.split() == ["struct", "one", "{", "x;", "};"]
