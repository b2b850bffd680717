"""Aggregates over folds and thresholds, and status logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .quantiles import exact_quantiles


def over_folds(metrics: DataFrame) -> DataFrame:
    """cutoff, metric, n, mean, std (sample, 0 for one fold), ci95 of (cutoff, fold, metric, value); NaN doesn't count."""
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    n = F.count("*")
    return metrics.where("not isnan(value)").groupBy("cutoff", "metric").agg(n.alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(std, 6).alias("std"), F.round(1.96 * std / F.sqrt(n), 6).alias("ci95"))


def described(metrics: DataFrame) -> DataFrame:
    return metrics.where("not isnan(value)").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, and whiskers at the furthest values within 1.5 times their distance."""
    q = written(exact_quantiles(df, key, value, [0.25, 0.5, 0.75]), "quartiles")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    rows = df.join(q, key, "left")
    inside = F.when(F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach), F.col(value))
    return rows.groupBy(key).agg(*[F.round(F.first("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.round(F.min(inside), 6).alias("low"), F.round(F.max(inside), 6).alias("high"))


def series(summary: DataFrame, metric: str) -> DataFrame:
    """cutoff, mean, ci95 of one metric for all cutoffs; NaN where it is missing."""
    own = summary.where(F.col("metric") == metric).select("cutoff", "mean", "ci95")
    nan = F.lit(float("nan"))
    return summary.select("cutoff").distinct().join(own, "cutoff", "left").select("cutoff", F.coalesce("mean", nan).alias("mean"), F.coalesce("ci95", nan).alias("ci95"))


def trend(df: DataFrame, key: str, order: str, value: str, slack: float = 0.0) -> DataFrame:
    """How the value goes along `order`: increases, decreases, stable or varies."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    s = df.withColumn("_step", step).groupBy(key).agg(F.coalesce(F.bool_or(F.col("_step") > slack), F.lit(False)).alias("up"), F.coalesce(F.bool_or(F.col("_step") < -slack), F.lit(False)).alias("down"))
    return s.select(key, F.when(F.col("up") & F.col("down"), "varies").when(F.col("up"), "increases").when(F.col("down"), "decreases").otherwise("stable").alias("trend"))


def durations(events: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds from each start to the finish that comes next in its phase (keys): events of ts, event and line_no."""
    turn = Window.partitionBy(*keys).orderBy("ts", "line_no")
    rows = events.withColumn("_before", F.lag("event").over(turn)).withColumn("_since", F.lag("ts").over(turn))
    return rows.where("event = 'finish' and _before = 'start'").select(*keys, "line_no", (F.col("ts").cast("timestamp").cast("double") - F.col("_since").cast("timestamp").cast("double")).alias("seconds"))


def without_repeats(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (line, line_no) without those equal to the one before, colour codes and carriage returns removed."""
    clean = lines.withColumn("line", F.regexp_replace("line", "\\x1b\\[[0-9;]*[A-Za-z]|\\r", ""))
    turn = Window.partitionBy(*keys).orderBy("line_no")
    return clean.withColumn("_before", F.lag("line").over(turn)).where("_before is null or _before != line").drop("_before")


def byte_offsets(lines: DataFrame, file: str) -> DataFrame:
    """Where each record's line starts and ends in its file, in bytes; a file's lines are summed in order."""
    turn = Window.partitionBy(file).orderBy("line_no")
    size = F.octet_length("line") + 1
    end = F.sum(size).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    return lines.select(file, "line_no", (end - size).alias("start"), end.alias("stop"))
