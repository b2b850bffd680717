"""The benchmark over cutoffs and folds: runs that are stored are not run again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import temperature_grid
from ..session import written
from . import calibrate, kmeans, scoring, splits
from .settings import same_splits, scoring_settings, similarity_cutoff

RECORD = "cutoff int, fold int, settings string, label_stats map<string,double>, metrics map<string,double>"


def label_stats(members: DataFrame) -> DataFrame:
    """One row of counts of members (ec, accession): rows, entities, classes, entities of several classes and their share."""
    per = members.groupBy("accession").agg(F.count("*").alias("n"), F.count_distinct("ec").alias("k"))
    classes = members.agg(F.count_distinct("ec").alias("classes"))
    found = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("entities"), F.count_if(F.col("k") > 1).alias("multi"))
    return found.crossJoin(classes).withColumn("multi_ratio", F.coalesce(F.round(F.col("multi") / F.nullif(F.col("entities"), F.lit(0)), 6), F.lit(0.0)))  # a row each


def as_map(row: DataFrame):
    """A row of numbers as a dictionary, without what is null."""
    first = row.first()
    return {k: float(v) for k, v in first.asDict().items() if v is not None} if first else {}


def records(spark: SparkSession, path: str) -> DataFrame:
    """All stored records (none yet: an empty table)."""
    try:
        return spark.read.schema(RECORD).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)


def run(spark: SparkSession, path: str, cutoffs: Iterable[int], folds: int, settings: dict, evaluate: Callable[[int, int], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The records of all cutoffs and folds. evaluate(cutoff, fold) plans the members (ec, accession) of a run and one row of its metrics;
    it is only asked for runs that path has no record of under the same settings. A record is appended as soon as its run is
    over, so that a run that breaks off goes on where it was."""
    key = json.dumps(settings, sort_keys=True)
    done = {(r.cutoff, r.fold) for r in records(spark, path).where(F.col("settings") == key).select("cutoff", "fold").collect()}  # a row per run
    for cutoff in cutoffs:
        for fold in range(folds):
            if (cutoff, fold) not in done:
                members, metrics = evaluate(cutoff, fold)
                row = (cutoff, fold, key, as_map(label_stats(members)), as_map(metrics))
                spark.createDataFrame([row], RECORD).write.mode("append").json(path)
    return records(spark, path).where(F.col("settings") == key)


#: What a configuration may say, and what holds where it says nothing.
CONFIG = {
    "cutoffs": [0.3], "folds": 3, "definition": "jaccard", "seed": 42, "stratify": "top", "least": 2, "prototypes": 1,
    "calibration_split": "train", "opt_temp": "bce", "taus": [round(0.2 + 0.02 * i, 10) for i in range(21)], "min_precision": 0.0, "min_recall": 0.0, "per_class": None, "use_calibration": True, "use_per_class": True,
}


def save_folds(folds: DataFrame, histogram: DataFrame, path: str, snapshot: dict) -> None:
    """The folds (cluster_id, fold) of a cutoff, their label totals (fold, label, n, target), and the snapshot of the configuration that
    they were made with. The snapshot is written last, so that folds of a run that broke off are never taken up."""
    n = max(1, int(snapshot["folds"]))
    totals = histogram.join(folds, "cluster_id").groupBy("fold", "label").agg(F.sum("n").alias("n"))
    target = histogram.groupBy("label").agg(F.round(F.sum("n") / n, 6).alias("target"))
    folds.select("cluster_id", "fold").write.mode("overwrite").json(f"{path}/folds")
    totals.join(target, "label").select("fold", "label", "n", "target").write.mode("overwrite").json(f"{path}/totals")
    folds.sparkSession.createDataFrame([(json.dumps(snapshot, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Stored JSON lines, or None where there are none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def load_folds(spark: SparkSession, path: str, wanted: dict, kind: str) -> DataFrame | None:
    """The stored folds, if the settings that they were made with are the wanted ones; kind: the type of cluster_id."""
    try:
        made = json.loads(spark.read.text(f"{path}/settings").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return stored(spark, f"{path}/folds", f"cluster_id {kind}, fold int") if same_splits(made, wanted, ("threshold", "folds", "definition", "seed", "stratify")) else None


def identity_folds(spark: SparkSession, path: str, clusters: DataFrame, members: DataFrame, cutoff: float, config: dict) -> DataFrame:
    """cluster_id, fold of clusters (node, cluster_id) at a cutoff: those stored at path where they fit the configuration, else new ones, which are stored."""
    wanted = {"threshold": cutoff, **{k: config[k] for k in ("folds", "definition", "seed", "stratify")}}
    kind = clusters.schema["cluster_id"].dataType.simpleString()
    found = load_folds(spark, path, wanted, kind)
    if found is None:
        labels = members.select(F.col("accession").alias("node"), splits.stratum(F.col("ec"), config["stratify"]).alias("label")).distinct()  # an entry counts once for each label
        histogram = written(splits.cluster_labels(clusters, labels), "cluster-labels")
        save_folds(written(splits.assign_folds(histogram, config["folds"], clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))), "folds"), histogram, path, {**config, **wanted})
        found = load_folds(spark, path, wanted, kind)
    return found


def fold_scores(vectors: DataFrame, placed: DataFrame, config: dict, arguments: dict) -> tuple[DataFrame, dict]:
    """One row of metrics of a fold (placed: split, ec, accession), and the settings that it was scored with. Prototypes are made of the training
    members, temperature and thresholds tuned on the calibration split, and the test members scored."""
    of = lambda name: placed.where(F.col("split") == name).select("ec", "accession")
    train, tuning, test = of("train"), of(config["calibration_split"]), of("test")
    protos = kmeans.sub_prototypes(vectors, train, config["prototypes"]) if config["prototypes"] > 1 else scoring.prototypes(vectors, train)
    bank = written(protos, "bank")
    asked = lambda members: vectors.join(members.select("accession").distinct(), "accession", "left_semi").select("accession", "vec")
    tuned, own = {}, None
    chosen = scoring_settings(arguments, None, config)
    if config["use_calibration"]:
        queries = written(asked(tuning), "calibration-queries")
        losses = scoring.bank_losses(queries, bank, tuning, temperature_grid(chosen["temperature"]))
        t = scoring.best_temperature(losses, config["opt_temp"], chosen["temperature"]).first()
        tuned["temperature"] = t[0] if t is not None and t[0] is not None else chosen["temperature"]
        bins, best = calibrate.score_bins(queries, bank, tuning, config["taus"], scoring_settings(arguments, tuned, config)["temperature"])
        found = scoring.best_tau(calibrate.tau_curve(bins, best, config["taus"]), config["min_precision"], config["min_recall"]).first()
        tuned["tau_multi"] = found.tau
        if config["per_class"] and config["use_per_class"]:
            own = written(calibrate.class_thresholds(bins, config["taus"], base=found.tau, **config["per_class"]).select("ec", "tau"), "class-thresholds")
    chosen = scoring_settings(arguments, tuned, config, config["use_calibration"])
    how = (chosen["tau_multi"], chosen["temperature"], chosen["shortlist_topN"], own)
    queries = written(asked(test), "test-queries")
    rows = written(scoring.judged(scoring.decide(scoring.promising(queries, bank, *how), *how), test, queries, bank), "decisions")
    parts = [
        scoring.micro_macro(scoring.all_classes(scoring.per_class(rows), bank)),
        scoring.top1_rate(rows),
        scoring.coverage(scoring.answerable(test, test, vectors, bank)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # a row each
    return out, {k: float(v) for k, v in chosen.items()}


def identity_benchmark(spark: SparkSession, path: str, vectors: DataFrame, members: DataFrame, clusters_at: Callable[[float], DataFrame], config: dict | None = None, arguments: dict | None = None) -> DataFrame:
    """cutoff (percent), fold, label_stats and metrics of all cutoffs and folds: clusters of similar entries are dealt to folds, each fold is held out
    once, and the rest is trained on, calibrated and scored against. vectors: accession, vec; members: ec, accession;
    clusters_at(share): node, cluster_id at a similarity. Arguments go before what was calibrated, and that before the
    configuration. Stored folds and records that were made with the same settings are taken up."""
    config, arguments = {**CONFIG, **(config or {})}, arguments or {}
    cutoffs = {round(100 * similarity_cutoff(c)): similarity_cutoff(c) for c in config["cutoffs"]}
    clusters: dict = {}

    def evaluate(percent, fold):
        if percent not in clusters:
            clusters[percent] = written(clusters_at(cutoffs[percent]), "clusters")
        own = clusters[percent]
        folds = identity_folds(spark, f"{path}/split-{percent}", own, members, cutoffs[percent], config)
        placed = written(splits.fold_members(members, own, folds, fold, config["folds"], config["least"], config["seed"]), "fold-members")
        metrics, chosen = fold_scores(vectors, placed, config, arguments)
        more = metrics.select("*", *[F.lit(v).alias(k) for k, v in chosen.items()])
        return placed.where("split = 'test'").select("ec", "accession"), more

    return run(spark, f"{path}/records", cutoffs, config["folds"], {"config": config, "arguments": arguments}, evaluate).drop("settings")


def fold_values(records: DataFrame) -> DataFrame:
    """cutoff, fold, metric, value: the records' metrics in long form, as the reports over folds take them."""
    return records.select("cutoff", "fold", F.explode("metrics").alias("metric", "value"))
