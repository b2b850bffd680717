"""Thresholds from histograms of scores, which are counted within the Arrow batches of the scorer.

Thresholds cut probabilities into bins: bin b holds those that reach b of the thresholds. For each class a task counts
its cells and its true cells by bin, so that a task sends a few numbers a class, however many queries it scored. All
metrics at all thresholds are sums of bins. The one thing that bins don't tell is each query's best
class, which is always taken: that is a row a query and block of the bank.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from ..session import written
from .scoring import BLOCK_BYTES, bank_blocks, class_scorer, prf, projected

MODES = ("max_f1", "precision_at", "recall_at")


def score_bins(queries: DataFrame, bank: DataFrame, truth: DataFrame, taus: list[float], temperature: float = 1.0, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """bins (ec, bin, n, t): all cells and true cells of each class whose probability reaches `bin` of the thresholds, for bins that have any;
    best (ec, bin, true): a row for each query, its best class (the first by name on ties). Queries: accession, vec; a query's
    true classes that the bank lacks don't count. Both are written."""
    spark = bank.sparkSession
    own = truth.select("accession", "ec").distinct().groupBy("accession").agg(F.collect_list("ec").alias("own"))  # labels of one query
    rows = projected(queries).select("accession", "vec").join(own, "accession", "left").select("accession", "vec", "own")
    logits_of, edges = class_scorer(), sorted(set(map(float, taus)))

    def counted(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            ecs, _, first, matrix = sent.value
            at, names = {c: j for j, c in enumerate(ecs)}, pa.array(ecs, pa.string())
            step, wide = max(1, 200_000 // len(matrix)), len(edges) + 1
            total = np.zeros((2, len(ecs) * wide), np.int64)

            def sheet(**columns):
                n = len(next(iter(columns.values())))
                kinds = {"ec": pa.string(), "bin": pa.int32(), "n": pa.int64(), "t": pa.int64(), "accession": pa.string(), "logit": pa.float64()}
                return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    z = logits_of(np.array(part.column("vec").to_pylist(), float), first, matrix)
                    place = np.searchsorted(edges, 1 / (1 + np.exp(-z / temperature)), side="right") + np.arange(len(ecs)) * wide
                    np.add.at(total[0], place.ravel(), 1)
                    true = [(j, at[c]) for j, mine in enumerate(part.column("own").to_pylist()) for c in mine or () if c in at]
                    j, k = np.array(true, np.int64).reshape(-1, 2).T
                    np.add.at(total[1], place[j, k], 1)
                    best = z.argmax(axis=1)  # classes of a block are in order, so the first of equal ones counts
                    hit = np.zeros(z.shape, bool)
                    hit[j, k] = True
                    every = np.arange(len(z))
                    yield sheet(ec=names.take(pa.array(best)), t=hit[every, best].astype(np.int64), accession=part.column("accession"), logit=z[every, best])
            some = np.flatnonzero(total[0])
            for i in range(0, len(some), 10_000):
                k = some[i : i + 10_000]
                yield sheet(ec=names.take(pa.array(k // wide)), bin=(k % wide).astype(np.int32), n=total[0, k], t=total[1, k])

        return rows.mapInArrow(run, "ec string, bin int, n bigint, t bigint, accession string, logit double")

    parts = [counted(block) for block in bank_blocks(bank.select("ec", F.lit(0.0).alias("limit"), "vec"), block_bytes)]
    both = functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "ec string, bin int, n bigint, t bigint, accession string, logit double")
    both = written(both, "score-counts")
    bins = both.where("accession is null").groupBy("ec", "bin").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    best = both.where("accession is not null").groupBy("accession").agg(F.min(F.struct((-F.col("logit")).alias("low"), "ec", "t")).alias("b"))
    p = sigmoid(-F.col("b.low") / temperature)
    best = best.select(F.col("b.ec").alias("ec"), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: p >= e)).alias("bin"), (F.col("b.t") > 0).alias("true"))
    return written(bins, "score-bins"), written(best, "best-classes")


def above(rows: Column, j: Column, field: str, over: bool = True) -> Column:
    """Sum of a field of an array of bins over (else up to) bin j."""
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, x: s + F.when((x["bin"] > j) == F.lit(over), x[field]).otherwise(0))


def tau_curve(bins: DataFrame, best: DataFrame, taus: list[float]) -> DataFrame:
    """Micro metrics for each threshold (over 0) with the best class always taken."""
    edges = sorted(set(map(float, taus)))
    cells = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    first = best.groupBy("bin").agg(F.count("*").alias("bn"), F.count_if("true").alias("bt"))
    all_ = cells.join(first, "bin", "full").na.fill(0).agg(F.collect_list(F.struct("bin", "n", "t", "bn", "bt")).alias("b"))  # a row for each bin
    points = all_.select("b", F.posexplode(F.array(*map(F.lit, edges))).alias("j", "tau"))
    b, j = F.col("b"), F.col("j")
    hits, tp = above(b, j, "n") + above(b, j, "bn", False), above(b, j, "t") + above(b, j, "bt", False)
    points = points.select("tau", hits.alias("hits"), tp.alias("tp"), above(b, F.lit(-1), "t").alias("true"))
    p, r, f = prf(F.col("tp"), F.col("hits") - F.col("tp"), F.col("true") - F.col("tp"))
    return points.select("tau", F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"), F.round(f, 6).alias("micro_f1"))


def class_curves(bins: DataFrame, taus: list[float]) -> DataFrame:
    """ec, tau, tp, fp, fn of each class at each threshold: a class's bins are a few, and are summed from the top."""
    edges = sorted(set(map(float, taus)))
    own = bins.groupBy("ec").agg(F.collect_list(F.struct("bin", "n", "t")).alias("b"))  # a row for each bin
    points = own.select("ec", "b", F.posexplode(F.array(*map(F.lit, edges))).alias("j", "tau"))
    b, j = F.col("b"), F.col("j")
    points = points.select("ec", "tau", above(b, j, "n").alias("hits"), above(b, j, "t").alias("tp"), above(b, F.lit(-1), "t").alias("true"))
    return points.select("ec", "tau", "tp", (F.col("hits") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"))


def class_thresholds(bins: DataFrame, taus: list[float], mode: str, base: float, target: float = 0.0, shrink: float = 0.0, least_positives: int = 1) -> DataFrame:
    """ec, positives, tau of each class of the bank. Of its true cells, mode says which threshold a class prefers: that of most F1 (the smallest on
    ties); the smallest one of precision `target` or more, which has the most recall; or the largest one of recall `target` or more.
    It is drawn towards `base` as if by `shrink` more positives. Classes with fewer than `least_positives`
    true cells, or without a threshold that reaches the target, keep the base."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    curve = class_curves(bins, taus).withColumn("positives", F.col("tp") + F.col("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    if mode == "max_f1":
        choice = F.min(F.struct((-f).alias("worst"), "tau"))["tau"]
    elif mode == "precision_at":
        choice = F.min(F.when((p >= target) & (F.col("tp") + F.col("fp") > 0), F.col("tau")))
    else:
        choice = F.max(F.when(r >= target, F.col("tau")))
    found = curve.groupBy("ec").agg(F.max("positives").alias("positives"), choice.alias("own"))
    drawn = (F.col("positives") * F.col("own") + F.lit(float(shrink * base))) / (F.col("positives") + F.lit(float(shrink)))
    enough = (F.col("positives") >= max(1, least_positives)) & F.col("own").isNotNull()
    return found.select("ec", "positives", F.round(F.when(enough, drawn).otherwise(F.lit(float(base))), 6).alias("tau"))
