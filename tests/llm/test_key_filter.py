from pyspark.sql import functions as F

from ostinato.llm.key_filter import marked, without
from ostinato.llm.spread import salted_join


def test_no_wanted_row_is_missed_and_most_others_are_spared(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("h"))
    wanted = rows.where("k % 100 = 7").select(F.col("k").alias("a"), F.col("h").alias("b"))
    got = {r["k"]: r["_maybe"] for r in marked(rows, ["k", "h"], wanted, ["a", "b"]).collect()}
    assert len(got) == 5000 and all(got[k] for k in range(7, 5000, 100))
    assert sum(got.values()) < 60
    assert marked(rows, ["k", "h"], wanted.where("false"), ["a", "b"]).where("_maybe").count() == 0
    nulls = rows.withColumn("k", F.when(F.col("k") > 3, F.col("k")))
    assert marked(nulls, ["k", "h"], wanted, ["a", "b"]).count() == 5000


def test_salted_joins_equal_plain_joins(spark):
    left = spark.range(400).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"), "id").withColumn("k", F.when(F.col("id") != 11, F.col("k")))
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionAll(spark.createDataFrame([(7, 1), (None, 2)], "k long, v long"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))
        assert sorted(map(str, salted_join(left, right, ["k"], ["id"], counts, how).select("k", "id", "v").collect())) == want
        even = left.groupBy("k").agg(F.lit(1).alias("n"))  # nothing is told to be hot
        assert sorted(map(str, salted_join(left, right, ["k"], ["id"], even, how).select("k", "id", "v").collect())) == want


def test_rows_without_gone_keys_are_the_rest(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 11 != 0, F.col("id")).alias("k"), F.lit("x").alias("_maybe"), F.col("id").alias("_f0"))
    gone = rows.where("k % 5 = 0").select(F.col("k").alias("g"))
    got = sorted(r["_f0"] for r in without(rows, ["k"], gone, ["g"], rows.select("k")).collect())
    assert got == [k for k in range(3000) if k % 11 == 0 or k % 5]
    assert without(rows, ["k"], gone.where("false"), ["g"], rows.select("k")).count() == 3000
