"""The benchmark from clusters to metrics, with stored folds and records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import benchmark, calibrate, scoring, splits
from prismata.session import written


@pytest.fixture(scope="module")
def data(spark):
    turn = np.random.default_rng(6)
    middle = turn.normal(size=(6, 10))
    rows = [(f"a{i}", (middle[i % 6] + 0.6 * turn.normal(size=10)).tolist(), f"{i % 3 + 1}.{i % 6}.1.1", f"c{i // 3}") for i in range(180)]
    df = written(spark.createDataFrame(rows, "accession string, vec array<double>, ec string, cluster_id string"), "benchmark-rows")
    members = df.select("ec", "accession").unionByName(df.where("accession like '%7'").select(F.lit("9.9.1.1").alias("ec"), "accession"))
    return df.select("accession", "vec"), written(members, "members"), lambda share: df.select(F.col("accession").alias("node"), "cluster_id")


CONFIG = {"cutoffs": [30, 0.5], "folds": 2, "temperature": 0.1, "seed": 3, "per_class": {"mode": "max_f1", "shrink": 5.0, "least_positives": 2}}


def test_all_steps_of_a_fold(spark, data, tmp_path):
    vectors, members, clusters_at = data
    path = f"file://{tmp_path}/bench"
    asked = []

    def at(share):
        asked.append(share)
        return clusters_at(share)

    rows = benchmark.identity_benchmark(spark, path, vectors, members, at, CONFIG).collect()
    assert sorted((r.cutoff, r.fold) for r in rows) == [(30, 0), (30, 1), (50, 0), (50, 1)] and asked == [0.3, 0.5]
    # The same, step by step.
    config = {**benchmark.CONFIG, **CONFIG}
    own = clusters_at(0.3)
    labels = members.select(F.col("accession").alias("node"), splits.stratum(F.col("ec"), "top").alias("label")).distinct()
    folds = splits.assign_folds(splits.cluster_labels(own, labels), 2, own.groupBy("cluster_id").agg(F.count("*").alias("size")))
    placed = written(splits.fold_members(members, own, folds, 1, 2, 2, 3), "placed")
    train, test = (placed.where(f"split = '{s}'").select("ec", "accession") for s in ("train", "test"))
    bank = written(scoring.prototypes(vectors, train), "bank")
    found = next(r for r in rows if (r.cutoff, r.fold) == (30, 1))
    queries = vectors.join(train.select("accession").distinct(), "accession", "left_semi")
    bins, best = calibrate.score_bins(queries, bank, train, config["taus"], found.metrics["temperature"])
    assert scoring.best_tau(calibrate.tau_curve(bins, best, config["taus"])).first().tau == found.metrics["tau_multi"]
    taus = {r.ec: r.tau for r in calibrate.class_thresholds(bins, config["taus"], "max_f1", found.metrics["tau_multi"], shrink=5.0, least_positives=2).collect()}
    cells = scoring.logits(scoring.cosines(vectors.join(test.select("accession").distinct(), "accession", "left_semi"), bank)).collect()
    truth = {(r.accession, r.ec) for r in test.collect()}
    by: dict = {}
    for c in cells:
        by.setdefault(c.accession, []).append((1 / (1 + np.exp(-c.logit / found.metrics["temperature"])), c.ec))
    tp = fp = 0
    for acc, scored in by.items():
        hit = {ec for p, ec in scored if p >= taus[ec]} or {min(scored, key=lambda x: (-x[0], x[1]))[1]}
        tp += len([ec for ec in hit if (acc, ec) in truth])
        fp += len([ec for ec in hit if (acc, ec) not in truth])
    assert found.metrics["micro_precision"] == pytest.approx(tp / (tp + fp), abs=1e-6) and tp > 0
    assert found.label_stats["rows"] == test.count() and found.metrics["queries_total"] == len(by) == found.metrics["queries_covered"] + found.metrics["missing_labels"]
    # Stored folds and records are taken up; other settings are not.
    again = benchmark.identity_benchmark(spark, path, vectors, members, at, CONFIG).collect()
    assert asked == [0.3, 0.5] and len(again) == 4
    tuned = benchmark.identity_benchmark(spark, path, vectors, members, at, {**CONFIG, "cutoffs": [30]}, {"tau_multi": 0.9}).collect()
    assert asked == [0.3, 0.5, 0.3] and all(r.metrics["tau_multi"] == 0.9 for r in tuned) and len(tuned) == 2
    values = benchmark.fold_values(spark.createDataFrame(tuned, "cutoff int, fold int, label_stats map<string,double>, metrics map<string,double>"))
    assert values.where("metric = 'micro_f1'").count() == 2


def test_folds_are_stored_with_their_settings(spark, data, tmp_path):
    vectors, members, clusters_at = data
    config, path = {**benchmark.CONFIG, "folds": 3}, f"file://{tmp_path}/folds"
    first = {r.cluster_id: r.fold for r in benchmark.identity_folds(spark, path, clusters_at(0.3), members, 0.3, config).collect()}
    assert set(first.values()) == {0, 1, 2} and len(first) == 60
    kept = json.loads(spark.read.text(f"{path}/settings").first()[0])
    assert (kept["threshold"], kept["folds"], kept["stratify"], kept["taus"]) == (0.3, 3, "top", config["taus"])
    totals = spark.read.json(f"{path}/totals").collect()
    assert sum(r.n for r in totals) == members.selectExpr("accession", "split(ec, '[.]')[0]").distinct().count() and all(r.target == pytest.approx(sum(t.n for t in totals if t.label == r.label) / 3, abs=1e-6) for r in totals)
    spark.createDataFrame([("c0", 99)], "cluster_id string, fold int").write.mode("overwrite").json(f"{path}/folds")
    load = lambda **more: benchmark.identity_folds(spark, path, clusters_at(0.3), members, 0.3, {**config, **more})
    assert [tuple(r) for r in load().collect()] == [("c0", 99)]  # taken as stored
    assert {r.cluster_id: r.fold for r in load(seed=7).collect()} == first  # made anew
    assert benchmark.load_folds(spark, f"{path}-none", {}, "string") is None
