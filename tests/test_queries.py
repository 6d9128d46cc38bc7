import pytest
from oracle import DATA, same
from pyspark.sql import functions as F

from quillgrid.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["sequence_initial", "sequence_stats"])
def test_numbers_of_different_lengths(spark, tmp_path, name):
    """Keys that pass from five digits to six, and from seven to eight, within an order."""
    rows = [(o, i % 7 + 1, base + 3 * i - o, o, 10.0 + i, 0.0 if (i + o) % 4 == 0 else 0.05) for o in range(12) for i, base in enumerate([89_996, 9_989_990, 80, 89_990, 9_989_998, 11])]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    same(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))


@pytest.mark.parametrize("name", ["deskew", "line_fold"])
def test_long_pages_are_folded_in_a_stream(spark, tmp_path, name):
    """All segments on one page, beside a page without any line; no list of a page's segments is made."""
    spark.range(1500).select(F.col("id").alias("event_id"), F.when(F.col("id") == 7, 3).otherwise(F.col("id") % 3 * 50).cast("long").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    same(out, SQL[name], str(tmp_path))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
