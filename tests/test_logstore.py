"""Logs as generations of parts."""

from pyspark.sql import functions as F

from spanwright.sources.logstore import LogStore, section_parts


def parts(spark, rows):
    return spark.createDataFrame(rows, "path string, part int, text string")


def whole(store):
    logs = {}
    for r in store.in_order().collect():
        logs[r.path] = logs.get(r.path, "") + r.text
    return logs


def files(folder):
    return {p.name: p.read_bytes() for p in folder.rglob("part-*.parquet") if "manifest" not in str(p)}


def test_appends_copy_nothing_and_read_back_in_order(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "logs"), "path")
    assert store.read() is None and store.in_order() is None and store.generations() == []
    store.append(parts(spark, [("a", 1, "old2\n"), ("a", 0, "old1\n"), ("b", 0, "b\n")]))
    first = files(tmp_path / "logs")
    store.append(parts(spark, [("a", 0, "new\n"), ("c", 0, "c1\n"), ("c", 1, "c2\n")]), "Notice.")
    second = files(tmp_path / "logs")
    assert first.items() <= second.items() and len(second) > len(first)
    assert whole(store) == {"a": "new\nold1\nold2\n", "b": "b\n", "c": "c1\nc2\nNotice."}
    store.append(parts(spark, [("c", 0, "newest\n"), ("d", 0, "d\n")]), "Notice.")
    assert second.items() <= files(tmp_path / "logs").items()
    assert whole(store) == {"a": "new\nold1\nold2\n", "b": "b\n", "c": "newest\nc1\nc2\nNotice.", "d": "d\nNotice."}
    assert [n for n, _ in LogStore(spark, store.folder, "path").generations()] == [0, 1, 2]


def test_an_append_that_was_cut_off_is_not_read(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "logs"), "path")
    store.append(parts(spark, [("a", 0, "x")]))
    parts(spark, [("a", 0, "half")]).write.parquet(f"{store.folder}/parts-cut-off")
    assert whole(store) == {"a": "x"}
    store.append(parts(spark, []), "Notice.")
    assert whole(store) == {"a": "x"}


def test_section_parts(spark):
    rows = [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three \n\n"), ("b", 7, "only\t")]
    args = "path", F.lit("H"), F.lit("S"), F.col("text")
    got = {(r.path, r.part): r.text for r in section_parts(parts(spark, rows), *args).collect()}
    assert got == {("a", 0): "H\n\n\tS\n\none\n", ("a", 1): "two\n", ("a", 2): "three\n\n", ("b", 7): "H\n\n\tS\n\nonly\n\n"}
    single = section_parts(parts(spark, rows[3:]).drop("part"), *args).first()
    assert (single.part, single.text) == (0, "H\n\n\tS\n\nonly\n\n")
