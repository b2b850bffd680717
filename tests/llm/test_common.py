from pyspark.sql import functions as F

from prismata.llm.common import frequent


def test_frequent_items(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, 1000, 1, 9).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("v"))
    got = frequent(df, "v", 1024, 5).first()
    assert got.n == 1000 and got.top[0].item == 7 and got.top[0]["count"] >= 335
    assert frequent(df.limit(0), "hex(v)", 1024, 5).first().n == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
