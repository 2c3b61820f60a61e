from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.skew import first_by, split_row_number, top_n
from mapweave.operators.compare import correlation_p_value


def test_split_row_number_equals_plain_on_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"),
        (F.hash("id") % 7).alias("c"), F.col("id").alias("v"),
    )
    plain = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("c", "v")).cast("bigint"))
    split = split_row_number(df, ["k"], ["c"], ["v"], "rn")
    assert plain.exceptAll(split.select(plain.columns)).isEmpty()
    assert split.count() == 3000


def test_top_n_and_first_by(spark):
    df = spark.createDataFrame([(1, 5), (1, 4), (1, 9), (2, 1)], "k int, v int")
    assert sorted(tuple(r) for r in top_n(df, ["k"], [F.desc("v")], 2).collect()) == [(1, 5), (1, 9), (2, 1)]
    assert sorted(tuple(r) for r in first_by(df, ["k"], ["v"]).collect()) == [(1, 4), (2, 1)]


def test_p_values():
    # t = 2.0 with 10 degrees of freedom has a two-sided p of 0.0734.
    rho = 2.0 / (10 + 4.0) ** 0.5
    assert abs(correlation_p_value(rho, 12) - 0.07339) < 1e-4
    assert correlation_p_value(1.0, 10) == 0.0
    assert abs(correlation_p_value(0.0, 10) - 1.0) < 1e-12
