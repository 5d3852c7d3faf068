from pyspark.sql import functions as F

from spanwright.operators import changelog as L
from spanwright.operators import patches as P
from spanwright.sources import scan


def test_longest_owner_and_homeless_paths(spark):
    df = spark.createDataFrame([("src/a.c",), ("src/gcc/b.c",), ("src/gcc/sub/deep/c.c",), ("srcx/d.c",), ("e.c",)], "path string")
    dirs = spark.createDataFrame([("src",), ("src/gcc",)], "dir string")
    placed = L.owners(df, "path", dirs).collect()
    assert {(r.path, r.owner_dir, r.rel_path) for r in placed if r.problem is None} == {
        ("src/a.c", "src", "a.c"), ("src/gcc/b.c", "src/gcc", "b.c"), ("src/gcc/sub/deep/c.c", "src/gcc", "sub/deep/c.c")}
    assert {(r.path, r.problem) for r in placed if r.problem} == {("srcx/d.c", "no owner folder"), ("e.c", "no owner folder")}


def test_scope_texts_and_unfinished_text(spark):
    rows = [("f", "one", 1, "A."), ("f", None, 2, "B."), ("f", "one", 3, "C."), ("f", "two", 4, "D")]
    df = spark.createDataFrame(rows, "file string, scope string, ord bigint, text string")
    out = {r.scope: (r.first_ord, r.text) for r in L.scope_texts(df, ["file"], "scope", "ord", "text").collect()}
    assert out == {"one": (1, "A.  C."), None: (2, "B."), "two": (4, "D")}
    broken, _ = L.unfinished(F.col("text"))
    assert [r.ord for r in df.where(broken).collect()] == [4]


def test_entry_lines(spark):
    rows = [("f", None, 1, "New."), ("f", "one", 2, "Changed."), ("g", "two", 3, "Likewise.")]
    df = spark.createDataFrame(rows, "file string, scope string, ord bigint, text string")
    out = [r.entry for r in L.entry_lines(df, [], "file", "scope", "ord", "text").orderBy("ord").collect()]
    assert out == ["* f: New.", "(one): Changed.", "* g (two): Likewise."]


def test_directory_logs_come_in_parts(spark):
    df = spark.createDataFrame([("d", n, f"e{n}") for n in range(10)], "dir string, ord bigint, entry string")
    old = spark.createDataFrame([("d", "Old."), ("x", "Not touched.")], "dir string, old_text string")
    parts = L.directory_logs(df, "dir", "ord", "entry", F.lit("H"), F.lit("I"), old, part_rows=4).orderBy("part").collect()
    assert len(parts) == 4 and {r.dir for r in parts} == {"d"}
    assert "".join(r.text for r in parts) == "H\n\nI\n" + "".join(f"e{n}\n" for n in range(10)) + "\nOld."


LOG = """stray
2013-08-14  A  <a@x>

	* one.
2013-08-13  B  <b@x>

	* two.
	* three."""


def test_log_entries_keep_the_last(spark):
    lines = scan.lines(spark.createDataFrame([("l", LOG)], "path string, text string"), ["path"], "text")
    rows = L.log_entries(lines, ["path"], "line_no", "line").orderBy("entry_at").collect()
    assert [(r.header, r.body) for r in rows] == [
        ("2013-08-14  A  <a@x>", "\n\t* one."), ("2013-08-13  B  <b@x>", "\n\t* two.\n\t* three.")]
    first = L.log_entries(lines, ["path"], "line_no", "line").groupBy("path").agg(F.min_by("body", "entry_at").alias("body"))
    assert first.first().body == "\n\t* one."


def test_scopes_by_last_hit(spark):
    df = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "a", 3)], "file string, scope string, at int")
    assert [r.scope for r in L.scopes_by_last(df, ["file"], "scope", "at").collect()] == ["b", "a"]
    assert [r.scope for r in L.scopes_by_last(df, ["file"], "scope", "at", True).collect()] == ["a", "b"]


def test_mail_parts(spark):
    mail = "From: x\nSubject: [PATCH 2/9] A long\n one\nTo: y\n\nBody\n\nmore"
    df = scan.mail_parts(spark.createDataFrame([(mail,), ("no mail",)], "text string"), "text")
    rows = P.with_subject(df, "subject").collect()
    assert (rows[0].subject, rows[0].body) == ("[PATCH 2/9] A long\n one", "Body\n\nmore")
    assert (rows[0].patch_no, rows[0].total, rows[0].summary) == (2, 9, "A long one")
    assert (rows[1].subject, rows[1].body, rows[1].patch_no) == (None, None, None)


INDEX = """<table border="0" width="100%">
<tr><td><a href="m2.html">Second</a></td><td align="right">B</td></tr>
<tr><td><a class="x" href="m1.html">First</a></td><td width="1" align="right">A</td></tr>
</table>"""


def test_mail_index_is_chronological(spark):
    rows = scan.mail_index(spark.createDataFrame([(INDEX,)], "html string"), [], "html").orderBy("ord").collect()
    assert [(r.href, r.subject, r.sender) for r in rows] == [("m1.html", "First", "A"), ("m2.html", "Second", "B")]


def test_first_mail_that_starts_with_the_summary(spark):
    patches = spark.createDataFrame([("p1", "Add x"), ("p2", "Add"), ("p3", "Gone"), ("p4", "{a|b} c")], "path string, summary string")
    mails = spark.createDataFrame([(3, "[PATCH 1/89] Add x y"), (1, "[PATCH 2/89] Add z"), (2, "[PATCH 3/89] Add x"),
                                   (0, "Re: [PATCH 3/89] Add x"), (4, "[PATCH 3/88] Gone"), (5, "[PATCH 4/89] {a|b} c")],
                                  "ord int, subject string")
    found = P.match_mails(patches, mails, "path", "summary", "subject", "ord", 89)
    good, bad = found.where("problem IS NULL"), found.where("problem IS NOT NULL")
    assert {(r.path, r.mail.ord) for r in good.collect()} == {("p1", 2), ("p2", 1), ("p4", 5)}
    assert [r.path for r in bad.collect()] == ["p3"]


def test_series_gaps(spark):
    df = spark.createDataFrame([(n,) for n in [1, 2, 2, 4]], "n int")
    assert {(r.number, r.n) for r in P.series_gaps(df, "n", F.lit(1), F.lit(5)).collect()} == {(2, 2), (3, 0), (5, 0)}


def test_path_filters(spark):
    paths = ["testsuite/y.c", "a/b.c", "a/testsuite/x.c", "a/target.def", "a/tree.def", "a/gsstruct.def", "a/x.opt", "a/x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    keep = lambda kind, skip=True: [r.path for r in df.where(scan.wanted(F.col("path"), kind, skip)).collect()]
    assert keep("c") == ["a/b.c"] and keep("c", False) == ["testsuite/y.c", "a/b.c", "a/testsuite/x.c"]
    assert keep("wrap") == ["a/b.c", "a/tree.def", "a/gsstruct.def", "a/x.md"]
    assert keep("rename") == ["a/b.c", "a/gsstruct.def"] and keep("options") == ["a/x.opt"]


def test_corpus_round_trip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.c").write_text("one\ntwo\n")
    (tmp_path / "in" / "sub" / "b.h").write_text("three")
    (tmp_path / "in" / "c.txt").write_text("no")
    df = scan.read_corpus(spark, str(tmp_path / "in"), keep=scan.wanted(F.col("path"), "c"))
    assert {(r.path.rsplit("/", 1)[1], r.text) for r in df.collect()} == {("a.c", "one\ntwo\n"), ("b.h", "three")}
    below = scan.read_corpus(spark, str(tmp_path / "in"), keep=scan.wanted(F.col("path"), "c"), root=str(tmp_path / "in"))
    assert {r.path for r in below.collect()} == {"a.c", "sub/b.h"}
    out = str(tmp_path / "out")
    scan.write_changed(df.withColumn("after", F.replace("text", F.lit("two"), F.lit("2"))), "text", "after", out)
    assert [r.after for r in spark.read.parquet(out).collect()] == ["one\n2\n"]
    logs = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("e", 0, "c")], "owner string, part int, text string")
    scan.write_logs(logs, "owner", str(tmp_path / "logs"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "logs" / "owner=d").glob("part-*")))
    assert text == "a\nb\n"


def test_written_logs_do_not_depend_on_the_parts(spark, tmp_path):
    df = spark.createDataFrame([("d", n * 1000, f"e{n}") for n in range(10)], "dir string, ord bigint, entry string")
    texts = []
    for rows in (2, 4096):
        logs = L.directory_logs(df, "dir", "ord", "entry", F.lit("H"), F.lit("I"), part_rows=rows)
        scan.write_logs(logs, "dir", str(tmp_path / str(rows)))
        texts.append("".join(p.read_text() for p in sorted((tmp_path / str(rows) / "dir=d").glob("part-*"))))
    assert texts[0] == texts[1] == "H\n\nI\n" + "".join(f"e{n}\n" for n in range(10))


def test_entries_messages_and_old_logs_do_not_depend_on_the_parts(spark):
    text = "2013-08-14  A  <a@x>\n" + "\n".join(f"b{n}" for n in range(5)) + "\n2013-08-13  B  <b@x>\nc"
    lines = scan.lines(spark.createDataFrame([("gcc/ChangeLog", text)], "path string, text string"), ["path"], "text")
    old = spark.createDataFrame([("gcc/ChangeLog", "Old.")], "path string, old string")
    out = []
    for rows in (2, 4096):
        entries = L.log_entries(lines, ["path"], "line_no", "line", part_rows=rows)
        messages = [r.message for r in L.messages(entries, "path", "entry_at", "body").collect()]
        sections = entries.where("entry_at = 1").select("path", "part", F.col("body").alias("text"))
        logs = L.with_old_log(sections, "path", old, "old", F.lit("H"), F.lit("S"), F.col("text"), "none")
        out.append((messages, [r.log for r in logs.collect()]))
    assert out[0] == out[1] == (["gcc/\nb0\nb1\nb2\nb3\nb4"], ["H\n\n\tS\n\nb0\nb1\nb2\nb3\nb4\n\nOld."])


def test_lookup_has_one_row_per_key(spark):
    df = spark.createDataFrame([(["a", "b"], "u1", "t"), (["b"], "u0", "s")], "members array<string>, url string, text string")
    assert {(r.subject, r.url) for r in scan.load_lookup(df, "members", ["url", "text"], "subject").collect()} == {("a", "u1"), ("b", "u0")}


def test_messages_of_newest_entries(spark):
    df = spark.createDataFrame([("gcc/ChangeLog", 1, "* one."), ("gcc/ChangeLog", 9, "* old.")], "file string, at int, body string")
    assert [r.message for r in L.messages(df, "file", "at", "body").collect()] == ["gcc/\n* one."]


def test_named_texts(spark, tmp_path):
    df = spark.createDataFrame([("in/0001-a.patch", "x")], "path string, text string")
    scan.write_named(df, "path", "text", str(tmp_path / "out"))
    assert [(r.name, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("0001-a.patch", "x")]
