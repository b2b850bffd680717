"""Exact quantiles of groups of any size, by histograms that are refined around the values asked for.

A pass counts, for each group and open interval, how many values fall into each of BINS parts of it; the part that holds the
wanted rank is the next interval, from its least to its largest value. An interval of one value is the answer. A pass sends
at most BINS numbers an interval and task, so no group's values are gathered or sorted.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BINS = 1024
#: Infinities count as the largest numbers.
LARGEST = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """key, q (array): the quantiles of each group's values, linear between neighbours. Nulls and NaN don't count; a group without any other has no row. A
    null key is a group."""
    x = F.greatest(F.least(F.col(value).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = written(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("g"), x.alias("x")), "quantile-values")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    pos = [(F.col("n") - 1) * F.lit(float(f)) for f in fractions]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in pos])))
    sizes = written(sizes, "quantile-groups")
    open_ = written(sizes.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("bigint").alias("before"), "low", "high"), "quantile-ranks")
    done = []
    while True:
        done.append(open_.where("low = high").select("g", "rank", F.col("low").alias("v")))
        left = open_.where("low < high")
        if left.isEmpty():
            break
        spans = left.select(F.col("g").alias("h"), "low", "high").distinct()
        inside = rows.join(spans, F.col("g").eqNullSafe(F.col("h")) & F.col("x").between(F.col("low"), F.col("high")))
        share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bins = inside.groupBy("h", "low", "high", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("m").over(Window.partitionBy("h", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows at most
        bins = bins.withColumn("upto", upto).select("h", F.col("low").alias("l"), F.col("high").alias("u"), "m", "least", "most", "upto")
        same = F.col("g").eqNullSafe(F.col("h")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("u"))
        at = F.col("rank") - F.col("before")
        found = left.join(bins, same).where((at < F.col("upto")) & (at >= F.col("upto") - F.col("m")))
        open_ = written(found.select("g", "rank", (F.col("before") + F.col("upto") - F.col("m")).alias("before"), F.col("least").alias("low"), F.col("most").alias("high")), "quantile-ranks")
    known = functools.reduce(DataFrame.unionAll, done).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v"))  # two a fraction
    each = sizes.select(F.col("g").alias("h"), "n").join(known, F.col("g").eqNullSafe(F.col("h")))

    def between(p):
        low, high = F.col("v")[F.floor(p)], F.col("v")[F.ceil(p)]
        return low + (high - low) * (p - F.floor(p))

    return each.select(F.col("h").alias(key), F.array(*[between(p) for p in pos]).alias("q"))
