import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.operators import skew

HOT = {"share": 0.05, "min_rows": 0}


def skewed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [
        ("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(200)}", i,
         base + dt.timedelta(seconds=rng.randrange(6000)), rng.choice("abc"))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, id long, ts timestamp, v string")


def test_hot_keys_are_bounded_by_the_share(spark):
    df = skewed(spark)
    hot = skew.hot_keys(skew.key_counts(df, ["k"]), ["k"], **HOT)
    assert [r.k for r in hot.collect()] == ["hot"]


def test_salted_lookup_is_a_left_join(spark):
    df = skewed(spark)
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 200, 2)], "k string, d int")
    got = skew.salted_lookup(df, dim, ["k"], ["id"], salts=5, **HOT).select("id", "k", "d")
    want = df.join(dim, "k", "left").select("id", "k", "d")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_lookup_spreads_the_hot_key(spark):
    df = skewed(spark)
    dim = spark.createDataFrame([("hot", 1)], "k string, d int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.salted_lookup(df, dim, ["k"], ["id"], salts=16, **HOT)
        parts = out.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_segmented_lag_and_rank_match_a_window(spark):
    df = skewed(spark).where("k is not null")
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_id", F.lag("id").over(w))
    got = skew.segmented_lag(df, ["k"], ["ts", "id"], ["v", "id"], "ts", seconds=60, **HOT)
    cols = ["k", "id", "prev_v", "prev_id"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    ranked = skew.segmented_row_number(df, ["k"], ["ts", "id"], "ts", "r", seconds=60, **HOT)
    want = df.withColumn("r", F.row_number().over(w).cast("long"))
    cols = ["k", "id", "r"]
    assert sorted(map(str, ranked.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
