"""Texts of long keys come whole, in one row a key."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from spanwright.operators import ordered
from spanwright.plans import all_queries, all_sql

DOCS, TURNS, LINES = 9000, 5000, 300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Keys longer than a stored part (4096 rows), and longer than 8 turns or 64 lines."""
    where = tmp_path_factory.mktemp("long")
    spark.range(DOCS).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "src1").otherwise("src2").alias("source"),
                             F.lit("en").alias("lang")).write.parquet(f"{where}/documents.parquet")
    turn = F.col("id").cast("int")
    one = spark.range(TURNS).select(F.lit(1).cast("bigint").alias("conv_id"), turn.alias("turn"), F.when(turn % 4900 == 1, "user").otherwise(
        "assistant").alias("role"), F.concat(F.lit("t"), turn, F.lit(".")).alias("text"))
    two = spark.range(30).select(F.lit(2).cast("bigint").alias("conv_id"), turn.alias("turn"), F.when(turn % 2 == 0, "user").otherwise(
        "assistant").alias("role"), F.concat(F.lit("u"), turn).alias("text"))
    one.unionByName(two).write.parquet(f"{where}/conversations.parquet")
    kind = F.when(F.col("id") == 40, "error").when(F.col("id") % 50 == 7, "signup").otherwise("view")
    spark.range(LINES).select((F.col("id") % 1 + 5).alias("user_id"), F.col("id").alias("event_id"),
                              kind.alias("event_type")).write.parquet(f"{where}/events.parquet")
    return str(where)


KEYS = {
    "p3_sections": (["conv_id", "kind", "section"], "text"),
    "l8_directory_logs": (["source"], "text"),
    "l9_log_entries": (["conv_id", "entry_at"], "body"),
    "o1_records": (["user_id", "record"], "joined"),
    "l3_scope_texts": (["conv_id", "role"], "text"),
}


@pytest.mark.parametrize("name", KEYS)
def test_a_long_key_is_one_row(spark, folder, name):
    import duckdb
    con = duckdb.connect()
    for table in ("documents", "conversations", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = all_queries()[name](spark, folder)
    assert compare(df, con, all_sql()[name]) is None
    keys, text = KEYS[name]
    rows = df.select(*keys, F.length(text).alias("n")).collect()
    assert len({tuple(r[k] for k in keys) for r in rows}) == len(rows)
    assert max(r.n for r in rows) > (1000 if name == "o1_records" else 20000)


def test_rows_beyond_the_size_of_a_value_lose_nothing(spark):
    parts = spark.range(100).select((F.col("id") % 2).alias("k"), (F.col("id") / 2).cast("bigint").alias("part"),
                                    F.concat(F.lit("é"), F.col("id")).alias("text"))
    for size in (1, 10, 64, None):
        rows = ordered.filled_rows(parts, ["k"], "text", "--", size).orderBy("k", "part").collect()
        for k in (0, 1):
            mine = [r for r in rows if r.k == k]
            assert "--".join(r.text for r in mine) == "--".join(f"é{n}" for n in range(k, 100, 2))
            assert mine[0].part == 0 and len({r.part for r in mine}) == len(mine)
        assert (size is None) == (len(rows) == 2)
