"""Smaller queries: set operations, sorts, grids, early stopping, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import episodes, labels, settings
from ..sources import readers
from ..sources.fixtures import sql, view
from .labels import EXPLODED, exploded
from .registry import query
from .sampling import LONG, SEED, clusters, members
from .sampling import chosen as episode_choice


@query(sql("SELECT ec_full AS ec, round(1 / ln(1 + greatest(count(*), 1)), 9) AS weight FROM labels_long GROUP BY 1", "labels_long"))
def class_weights(spark, d):
    return view(spark, d, "labels_long").groupBy(F.col("ec_full").alias("ec")).agg(F.round(vec.class_weight(F.count("*")), 9).alias("weight"))


@query(sql("SELECT metric, cutoff, fold, i::INT AS i, round(low * pow(high / low, i / 24.0::DOUBLE), 9) AS t FROM (SELECT *, greatest(0.01::DOUBLE, value / 10) AS low, least(100::DOUBLE, value * 10) AS high FROM fold_metrics WHERE value > 0), (SELECT unnest(range(25)) AS i)", "fold_metrics"))
def temperature_points(spark, d):
    """The grid of temperatures around each measured value."""
    rows = view(spark, d, "fold_metrics").where("value > 0")
    return rows.select("metric", "cutoff", "fold", F.posexplode(vec.temperatures(F.col("value"))).alias("i", "t")).withColumn("t", F.round("t", 9))


@query(sql("SELECT metric, i::INT AS i, round(low + i * 0.01::DOUBLE, 10) AS tau FROM (SELECT metric, low, unnest(range(floor((high - low) / 0.01::DOUBLE + 1e-9)::INT + 1)) AS i FROM (SELECT metric, round(min(value), 2) AS low, round(max(value), 2) AS high FROM fold_metrics GROUP BY 1))", "fold_metrics"))
def tau_points(spark, d):
    """Thresholds from the least to the largest value of each metric."""
    ends = view(spark, d, "fold_metrics").groupBy("metric").agg(F.round(F.min("value"), 2).alias("low"), F.round(F.max("value"), 2).alias("high"))
    return ends.select("metric", F.posexplode(vec.points(F.col("low"), F.col("high"), 0.01)).alias("i", "tau"))


@query(sql("SELECT key % 2 = 0 AS even, count(*) AS entities, count(*) FILTER (k > 1) AS multi, round(count(*) FILTER (k > 1) / count(*), 6) AS ratio FROM (SELECT accession, cast(substr(accession, 2) AS bigint) AS key, count(DISTINCT ec) AS k FROM x GROUP BY 1) GROUP BY 1", "entries", x=EXPLODED))
def multilabel_ratio_per_split(spark, d):
    per = exploded(spark, d).groupBy("accession", "key").agg(F.count_distinct("ec").alias("k"))
    return per.groupBy((F.col("key") % 2 == 0).alias("even")).agg(F.count("*").alias("entities"), F.count_if(F.col("k") > 1).alias("multi"), F.round(F.count_if(F.col("k") > 1) / F.count("*"), 6).alias("ratio"))


@query(sql("SELECT count(*) FILTER (n >= 8) AS eligible, count(*) AS classes FROM (SELECT ec, count(*) AS n FROM mem GROUP BY 1)", "vectors", "vec_labels", **LONG))
def eligible_test_classes(spark, d):
    return members(spark, d).groupBy("ec").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= 8).alias("eligible"), F.count("*").alias("classes"))


@query(sql("SELECT DISTINCT accession FROM vec_labels EXCEPT SELECT accession FROM vec_labels WHERE split = 'test'", "vectors", "vec_labels"))
def held_out_difference(spark, d):
    v = view(spark, d, "vec_labels")
    return v.select("accession").distinct().join(v.where("split = 'test'").select("accession"), "accession", "left_anti")


@query(sql("SELECT source, accession FROM (SELECT 'SwissProt' AS source, accession FROM entries WHERE key % 2 = 0 UNION ALL SELECT 'TrEMBL', accession FROM entries WHERE key % 3 = 0)", "labels_long", "entries"))
def tagged_union(spark, d):
    e = view(spark, d, "entries")
    return e.where("key % 2 = 0").select(F.lit("SwissProt").alias("source"), "accession").unionByName(e.where("key % 3 = 0").select(F.lit("TrEMBL").alias("source"), "accession"))


@query(sql("SELECT ec_full AS ec, count(*) AS n FROM labels_long GROUP BY 1 HAVING count(*) < 15 ORDER BY n, ec LIMIT 20", "labels_long"))
def largest_deficits(spark, d):
    return view(spark, d, "labels_long").groupBy(F.col("ec_full").alias("ec")).agg(F.count("*").alias("n")).where("n < 15").orderBy("n", "ec").limit(20)


@query(sql("SELECT accession, length(sequence)::INT AS n, row_number() OVER (ORDER BY length(sequence), accession) - 1 AS idx FROM sequences", "sequences"))
def length_order(spark, d):
    s = view(spark, d, "sequences").select("accession", F.length("sequence").alias("n"))
    keyed = s.withColumn("_key", F.concat(F.lpad(F.col("n").cast("string"), 12, "0"), F.lit("|"), "accession"))
    return labels.numbered(keyed, "_key", "idx").drop("_key")


@query(sql("SELECT doc_id, replace(replace(lang || ' ' || source, ' ', '+'), '|', '%7C') AS encoded FROM documents"))
def url_parts(spark, d):
    return view(spark, d, "documents").select("doc_id", F.url_encode(F.concat_ws(" ", "lang", "source")).alias("encoded"))


@query(sql("SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY cutoff)::INT AS position, cutoff::INT AS threshold FROM (SELECT DISTINCT metric, cutoff FROM fold_metrics)", "fold_metrics"))
def threshold_keys(spark, d):
    """The thresholds among the keys of each metric's summary document, in order."""
    means = view(spark, d, "fold_metrics").groupBy("metric", "cutoff").agg(F.avg("value").alias("mean"))
    entry = F.struct(F.col("cutoff").cast("string").alias("key"), F.col("mean").cast("string").alias("value"))
    rest = F.array(F.struct(F.lit("config").alias("key"), F.lit("x").alias("value")))
    made = means.groupBy("metric").agg(F.to_json(F.map_from_entries(F.concat(F.collect_list(entry), rest))).alias("summary"))
    return made.select("metric", F.posexplode(settings.numeric_keys(F.col("summary"))).alias("position", "threshold")).withColumn("position", F.col("position") + 1)


STOP = """aggregate(v, struct(cast(double('-inf') as double) AS best, -1 AS at, 0 AS wait, 0 AS i, -1 AS stop),
    (s, x) -> CASE WHEN s.stop >= 0 THEN s
                   WHEN x > s.best + 0.001 THEN struct(x AS best, s.i AS at, 0 AS wait, s.i + 1 AS i, -1 AS stop)
                   ELSE struct(s.best AS best, s.at AS at, s.wait + 1 AS wait, s.i + 1 AS i, IF(s.wait + 1 >= 4, s.i, -1) AS stop) END)"""


@query(
    sql(
        "SELECT user_id, best_at, CASE WHEN stop < 0 THEN n - 1 ELSE stop END AS stop FROM (SELECT * FROM run WHERE i = n)",
        r="SELECT user_id, list(value ORDER BY event_id) AS v, count(*)::INT AS n FROM events GROUP BY 1",
        run="SELECT user_id, v, n, 0 AS i, '-inf'::DOUBLE AS best, -1 AS best_at, 0 AS wait, -1 AS stop FROM r UNION ALL SELECT user_id, v, n, i + 1, CASE WHEN stop < 0 AND v[i + 1] > best + 0.001 THEN v[i + 1] ELSE best END, CASE WHEN stop < 0 AND v[i + 1] > best + 0.001 THEN i ELSE best_at END,"
        " CASE WHEN stop >= 0 THEN wait WHEN v[i + 1] > best + 0.001 THEN 0 ELSE wait + 1 END, CASE WHEN stop >= 0 THEN stop WHEN NOT v[i + 1] > best + 0.001 AND wait + 1 >= 4 THEN i ELSE -1 END FROM run WHERE i < n",
    )
)
def early_stopping(spark, d):
    """The best check of each run and the one at which patience ends; a run's checks are few and are folded in order."""
    e = view(spark, d, "events")  # each user stands for a training run
    runs = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda z: z["value"]).alias("v"))
    s = runs.select("user_id", F.size("v").alias("n"), F.expr(STOP).alias("s"))
    return s.select("user_id", F.col("s.at").alias("best_at"), F.when(F.col("s.stop") < 0, F.col("n") - 1).otherwise(F.col("s.stop")).alias("stop"))


@query(sql("SELECT cutoff, fold, count(*) AS n_metrics, round(max(value), 6) AS best, string_agg(metric, ',' ORDER BY metric) AS metrics FROM fold_metrics GROUP BY 1, 2", "fold_metrics"))
def benchmark_records(spark, d):
    rows = view(spark, d, "fold_metrics")
    per = rows.groupBy("cutoff", "fold").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    record = F.from_json(F.to_json(F.struct("m")), "m map<string,double>")["m"]  # as it is stored
    return per.select("cutoff", "fold", F.size(record).cast("bigint").alias("n_metrics"), F.round(F.array_max(F.map_values(record)), 6).alias("best"), F.array_join(F.array_sort(F.map_keys(record)), ",").alias("metrics"))


@query(
    sql(
        "SELECT cutoff, count(DISTINCT accession) AS entities, count(DISTINCT cluster_id) AS n_clusters FROM (SELECT accession, c * 10 AS cutoff, concat('K', key % (c * 10)) AS cluster_id FROM entries CROSS JOIN (SELECT unnest([1, 2, 5]) AS c)) GROUP BY 1",
        "labels_long",
        "entries",
    )
)
def clusters_per_cutoff(spark, d):
    e = view(spark, d, "entries").select("accession", "key", F.explode(F.array(*[F.lit(c) for c in (10, 20, 50)])).alias("cutoff"))
    return e.groupBy("cutoff").agg(F.count_distinct("accession").alias("entities"), F.count_distinct(F.col("key") % F.col("cutoff")).alias("n_clusters"))


@query()
def episode_cluster_repeats(spark, d):
    return episodes.disjoint_with_repeats(episode_choice(spark, d), members(spark, d), clusters(spark, d), 12, 12, SEED)


@query()
def file_checksums(spark, d):
    return readers.checksums(spark, f"{d}/region.parquet").select("length", "sha256")


