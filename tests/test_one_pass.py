"""How often parsed tables are read, counted in the plans that run."""

import re

import pytest
from pyspark.sql import functions as F

from spanwright.operators import ordered, sizing
from spanwright.operators import patches as P
from spanwright.plans import all_queries, patch_kit
from spanwright.sources import scan

FOLDER = "/root/testdata/sf0.001"
SCAN = re.compile(r"^[\s:|+*()\d-]*(FileScan|Scan ExistingRDD)", re.M)


def plans_of(monkeypatch, module, run):
    """Plans of the tables that a run stores, and its last plan."""
    made, plans = module.checkpointed, []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df)
    monkeypatch.setattr(module, "checkpointed", keep)
    df = run()
    return df, [*plans, df._jdf.queryExecution().executedPlan().toString()]


def test_diff_lines_are_read_once(spark, monkeypatch):
    _, plans = plans_of(monkeypatch, ordered, lambda: all_queries()["p4_diff_lines"](spark, FOLDER))
    assert sum(p.count("FileScan") for p in plans) == 1
    # What is stored with the pass, its edges, and both joined.
    assert [len(SCAN.findall(p)) for p in plans] == [1, 1, 2]


def test_draft_reads_its_diffs_once(spark, monkeypatch):
    diffs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("diff_id"), F.concat(F.lit("diff --git a/x b/x\n--- a/"), "source", F.lit("/x.c\n@@ -1 +1 @@ f")).alias("text"))
    dirs = spark.createDataFrame([("src1",)], "dir string")
    monkeypatch.setattr(patch_kit, "checkpointed", ordered.checkpointed)
    df, plans = plans_of(monkeypatch, ordered, lambda: patch_kit.draft(diffs, dirs))
    assert sum(p.count("FileScan") for p in plans) == 1
    assert len(SCAN.findall(plans[-1])) <= 2
    assert df.count() == 2 * diffs.count()


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_repeated_hunks(spark, chunk):
    lines = ["@@ -1 +1 @@ zero", "diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1 +1 @@ f", "+a", "@@ -2 +2 @@ f", "@@ -3 +3 @@ g",
             "@@ -4 +4 @@", "@@ -5 +5 @@", "diff --git a/y b/y", "--- a/y", "@@ -5 +5 @@", "new file mode 1", "@@ -6 +6 @@", "@ odd"]
    df = spark.createDataFrame([(d, n, x) for d in ("a", None) for n, x in enumerate(lines)], "d string, n int, line string")
    got = P.diff_lines(df, ["d"], "n", "line", True, chunk).orderBy("d", "n").collect()
    for rows in (got[:16], got[16:]):
        assert [r.n for r in rows if r.kind == "hunk"] == [4, 6, 7, 8, 9, 12]
        assert [r.n for r in rows if r.repeats] == [6, 9]
        assert [r.status for r in rows] == [None] + ["changed"] * 12 + ["new"] * 3


def files_opened(df):
    """Files and bytes of the scans of a plan that has run."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            open_.append(node.executedPlan())
            continue
        if node.metrics().contains("numFiles"):
            found.append((node.metrics().apply("numFiles").value(), node.metrics().apply("filesSize").value()))
        children = node.children().iterator()
        while children.hasNext():
            open_.append(children.next())
    return found


def test_pruned_files_are_not_opened(spark, tmp_path):
    for name, text in {"a.c": "one\ntwo", "testsuite/b.c": "no", "sub/c.h": "three", "d.txt": "no", "sub/testsuite/e.c": "no",
                       "big.c": "x" * 5000, "testsuite.c": "four"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    keep = scan.wanted(F.col("path"), "c", skip_tests=True) & (F.col("size") < 5000)
    df = scan.read_corpus(spark, str(tmp_path), keep=keep, root=str(tmp_path / "in"))
    assert {(r.path, r.text) for r in df.collect()} == {("a.c", "one\ntwo"), ("sub/c.h", "three"), ("testsuite.c", "four")}
    assert files_opened(df) == [(3, 16)]
    assert "file_size" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "DataFilters: [" in plan
    listed = scan.listing(spark, str(tmp_path), "*.c", str(tmp_path / "in"))
    assert {tuple(r) for r in listed.collect()} == {("a.c", 7), ("testsuite/b.c", 2), ("sub/testsuite/e.c", 2), ("big.c", 5000), ("testsuite.c", 4)}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_written_tree_goes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sizing, "shared_folder", lambda _: str(tmp_path / "shared"))
    found = all_queries()["run_corpus_scan"](spark, FOLDER)
    assert not list((tmp_path / "shared").glob("*")) and found.count() > 0
    sizing.remove_folder(spark, str(tmp_path / "nothing"))


def test_no_query_joins_whole_keys(spark, monkeypatch):
    from spanwright.operators import records

    def stop(*_, **__):
        raise AssertionError("a key is joined whole")
    monkeypatch.setattr(ordered, "whole_texts", stop)
    monkeypatch.setattr(records, "whole_records", stop)
    for name in ("l3_scope_texts", "l8_directory_logs", "l9_log_entries", "p3_sections", "o1_records", "run_logs_written"):
        rows = all_queries()[name](spark, FOLDER)
        assert "part" in rows.columns or "line_no" in rows.columns


def test_parts_of_one_source_are_its_text(spark):
    from spanwright.operators import changelog as L
    docs = spark.range(20000).select(F.lit("one").alias("source"), "id", F.concat(F.lit("e"), "id").alias("entry"))
    parts = L.directory_logs(docs, "source", "id", "entry", F.lit("H"), F.lit("I"), part_rows=64).orderBy("part").collect()
    assert [r.part for r in parts] == list(range(313)) and max(len(r.text) for r in parts) < 1000
    assert "".join(r.text for r in parts) == "H\n\nI\n" + "".join(f"e{n}\n" for n in range(20000))
