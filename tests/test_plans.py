"""Physical-plan properties that matter at scale (read from ``explain``)."""

import contextlib
import io

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_flagship_scans_once_and_prunes_columns(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["flagship_top_feature"](spark, SF))
    import re
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 2   # lineitem once, supplier once
    assert "SinglePartition" not in p
    assert "l_extendedprice" not in p           # only the needed columns are read
    assert "BroadcastHashJoin" in p             # the supplier side is small at this size


def test_rank_test_has_no_single_partition_sort(spark):
    from pyspark.sql import functions as F
    from tallyframe.operators import scenario as M
    ev = spark.read.parquet(f"{SF}/events.parquet").select(F.hour("ts").alias("hour"), "event_type", "value")
    p = plan(M.rank_sum_test(ev, "hour", "event_type", "value", "click", "view"))
    assert "SinglePartition" not in p
    assert "Scan ExistingRDD" in p  # the range-partitioned sums are written once and read back


def test_dissimilarity_is_blocked_not_a_feature_self_join(spark):
    from pyspark.sql import functions as F
    from tallyframe.operators import distance as X
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("sample"), F.col("l_partkey").cast("string").alias("hash"),
        F.col("l_quantity").alias("value"))
    p = plan(X.dissimilarity(li, blocks=3))
    assert "FlatMapGroupsInPandas" in p
    assert "SortMergeJoin" not in p and "CartesianProduct" not in p
