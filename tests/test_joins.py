"""Joins on crowded keys: all pairs, dealt over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ledger as L
from siltstone.operators.joins import met


@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_crowded_keys_give_all_pairs(spark, chunk):
    left = [(None if k % 11 == 0 else k % 3 * (k > 20), k % 30) for k in range(60)]  # repeats and nulls among them
    right = [(None if k % 9 == 0 else k % 4 * (k > 10), k) for k in range(30)] + [(7, 1)]
    got = met(spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int"), ["k"], chunk)
    assert got.columns == ["k", "a", "b"]
    assert Counter(map(tuple, got.collect())) == Counter((k, a, b) for k, a in left for j, b in right if k is not None and k == j)


def test_nested_folders_are_dealt_over_tasks(spark):
    """Few bytes before the join and many rows after it: one task would make them all."""
    routes = spark.range(600).select(F.concat(F.lit("r"), "id").alias("route"), F.when(F.col("id") % 2 == 0, "in/a").otherwise("in").alias("source"), F.lit("out").alias("output"))
    got = L.nested_folders(routes, spark.createDataFrame([("in/a", "in"), ("in/b", "in"), ("in", "")], "folder string, ancestor string"))
    assert got.count() == 300 * 300
    routes = spark.range(600).select(F.concat(F.lit("r"), "id").alias("route"), F.concat(F.lit("in"), F.col("id") % 20).alias("source"), F.lit("out").alias("output"))
    up = spark.range(1, 20).select(F.concat(F.lit("in"), "id").alias("folder"), F.concat(F.lit("in"), F.col("id") - 1).alias("ancestor"))
    got = L.nested_folders(routes, up)
    assert got.count() == 19 * 30 * 30 and got.select(F.spark_partition_id()).distinct().count() > 1
