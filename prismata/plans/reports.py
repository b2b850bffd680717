"""Queries on sources and sinks, folds, logs, caches, views and training."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import augment
from ..functions import vectors as vec
from ..operators import episodes, reports, training
from ..session import shared_dir, written
from ..sources import readers, writers
from ..sources.fixtures import sql, view
from ..streaming import counters
from .registry import query
from .sampling import K, M, Q, SEED, codes, episode_fallback, members, samples


def place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


SEQ = "SELECT accession, sequence FROM sequences WHERE length(sequence) > 0"


@query(sql("SELECT accession, sequence FROM q", "sequences", q=SEQ))
def fasta_roundtrip(spark, d):
    path = place(spark, "fasta")
    writers.fasta(view(spark, d, "sequences").where("length(sequence) > 0"), path)
    return readers.fasta(spark, path)


@query(sql("SELECT accession, rtrim(regexp_replace(sequence, '(.{80})', '\\1' || chr(10), 'g'), chr(10)) AS w0, length(sequence)::BIGINT AS n FROM q", "sequences", q=SEQ))
def wrap80(spark, d):
    s = view(spark, d, "sequences").where("length(sequence) > 0")
    return s.select("accession", writers.wrapped(F.col("sequence")).alias("w0"), F.length("sequence").cast("bigint").alias("n"))


@query(sql("SELECT accession, ec, source FROM entries WHERE length(trim(ec)) > 0", "labels_long", "entries"))
def tsv_roundtrip(spark, d):
    path = place(spark, "entries")
    writers.tsv(view(spark, d, "entries").where("length(trim(ec)) > 0").select("accession", "ec", "source"), path)
    return readers.tsv(spark, path)


@query(sql("SELECT ec_full AS ec, accession FROM labels_long", "labels_long"))
def split_list_roundtrip(spark, d):
    path = place(spark, "split")
    writers.split_lists(view(spark, d, "labels_long").select("accession", F.col("ec_full").alias("ec")), path)
    return readers.split_lists(spark, path)


@query(sql("SELECT concat('D', doc_id) AS accession, concat('K', doc_id % 9) AS cluster_id FROM documents"))
def cluster_map_roundtrip(spark, d):
    path = place(spark, "clusters")
    writers.cluster_map(view(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.concat(F.lit("K"), F.col("doc_id") % 9).alias("cluster_id")), path)
    return readers.cluster_map(spark, path)


@query(sql("SELECT accession, round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 5) AS total, len(vec)::INT AS width FROM vectors", "vectors"))
def vector_roundtrip(spark, d):
    path = place(spark, "vectors")
    writers.vectors(view(spark, d, "vectors"), path)
    v = spark.read.parquet(path)
    width = readers.vector_width(v)
    return v.select("accession", F.round(F.aggregate(vec.doubles(F.col("vec")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.lit(width).alias("width"))


@query(sql("SELECT cutoff, fold, metric, value FROM fold_metrics", "fold_metrics"))
def json_roundtrip(spark, d):
    path = place(spark, "metrics")
    writers.documents(view(spark, d, "fold_metrics"), path)
    return spark.read.schema("cutoff int, fold int, metric string, value double").json(path)


@query(sql("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'D' || doc_id WHEN 1 THEN 'D' || doc_id WHEN 2 THEN 'D||' || doc_id ELSE doc_id::VARCHAR END AS id FROM documents"))
def header_ids(spark, d):
    """Headers of all usual forms, and their identifiers."""
    kind, name = F.col("doc_id") % 4, F.concat(F.lit("D"), "doc_id")
    header = F.when(kind == 0, F.concat(F.lit("sp|"), name, F.lit("|X_Y "), "lang")).when(kind == 1, F.concat_ws(" ", name, "lang", "source")).when(kind == 2, F.concat(F.lit("D||"), "doc_id", F.lit(" x"))).otherwise(F.concat(F.lit("x|"), "doc_id"))
    return view(spark, d, "documents").select("doc_id", readers.header_id(header).alias("id"))


@query(sql("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS next_url FROM pages"))
def link_headers(spark, d):
    p = view(spark, d, "pages")
    header = F.concat(F.lit("<"), "url", F.when(F.col("page_id") % 2 == 0, '>; rel="next"').otherwise('>; rel="last"'))
    return p.select("page_id", readers.next_link(header).alias("next_url"))


FOLDS = {"f": "SELECT cutoff, metric, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci95 FROM fold_metrics GROUP BY 1, 2"}


@query(sql("SELECT * FROM f", "fold_metrics", **FOLDS))
def fold_ci(spark, d):
    return reports.over_folds(view(spark, d, "fold_metrics"))


@query(sql("SELECT metric, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM fold_metrics GROUP BY 1", "fold_metrics"))
def summary_by_metric(spark, d):
    return reports.described(view(spark, d, "fold_metrics"))


@query(sql("SELECT c.cutoff, coalesce(mean, 'nan'::DOUBLE) AS mean, coalesce(ci95, 'nan'::DOUBLE) AS ci95 FROM (SELECT DISTINCT cutoff FROM f) c LEFT JOIN f ON f.cutoff = c.cutoff AND metric = 'f1'", "fold_metrics", **FOLDS))
def metric_series(spark, d):
    return reports.series(reports.over_folds(view(spark, d, "fold_metrics")), "f1")


@query(sql("SELECT metric, CASE WHEN up AND down THEN 'varies' WHEN up THEN 'increases' WHEN down THEN 'decreases' ELSE 'stable' END AS trend FROM (SELECT metric, coalesce(bool_or(s > 1e-9), false) AS up, coalesce(bool_or(s < -1e-9), false) AS down FROM (SELECT metric, mean - lag(mean) OVER (PARTITION BY metric ORDER BY cutoff) AS s FROM f) GROUP BY 1)", "fold_metrics", **FOLDS))
def monotonic_trend(spark, d):
    return reports.trend(reports.over_folds(view(spark, d, "fold_metrics")), "metric", "cutoff", "mean")


@query(
    sql(
        "SELECT l_returnflag, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS low, round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS high"
        " FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1"
    )
)
def boxplot_stats(spark, d):
    return reports.box_stats(view(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


@query(sql("SELECT line_no, event_type AS phase, user_id % 4 AS cutoff, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS event FROM (SELECT line_no, line_no AS event_id, user_id, event_type FROM status_lines)", "status_lines"))
def status_log_parse(spark, d):
    f = readers.status(view(spark, d, "status_lines"))
    return f.select("line_no", F.col("fields")["phase"].alias("phase"), F.col("fields")["cutoff"].cast("bigint").alias("cutoff"), F.col("fields")["event"].alias("event"))


@query(sql("SELECT user_id, event_type, line_no, round(epoch_us(ts) / 1e6 - epoch_us(t0) / 1e6, 3) AS seconds FROM (SELECT *, lag(line_no % 2) OVER w AS b, lag(ts) OVER w AS t0 FROM status_lines WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, line_no)) WHERE line_no % 2 = 1 AND b = 0", "status_lines"))
def phase_durations(spark, d):
    s = view(spark, d, "status_lines").withColumn("event", F.when(F.col("line_no") % 2 == 0, "start").otherwise("finish"))
    return reports.durations(s, ["user_id", "event_type"]).withColumn("seconds", F.round("seconds", 3))


@query(sql("SELECT user_id, line_no, event_type AS line FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY line_no) AS b FROM status_lines) WHERE b IS NULL OR b <> event_type", "status_lines"))
def duplicate_line_removal(spark, d):
    lines = view(spark, d, "status_lines").select("user_id", "line_no", F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\r")).alias("line"))
    return reports.without_repeats(lines, ["user_id"])


@query(sql("SELECT user_id, line_no, (s - strlen(line) - 1)::BIGINT AS start, s::BIGINT AS stop FROM (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY user_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s FROM status_lines)", "status_lines"))
def byte_offsets(spark, d):
    return reports.byte_offsets(view(spark, d, "status_lines"), "user_id")


@query(sql("SELECT event_type AS ec, event_id, fetched_at FROM events JOIN (SELECT event_type, CASE WHEN length(event_type) % 2 = 0 THEN max(ts) ELSE min(ts) END AS fetched_at FROM events GROUP BY 1) USING (event_type) WHERE fetched_at >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"))
def cache_ttl(spark, d):
    e = view(spark, d, "events").withColumnRenamed("event_type", "ec")
    meta = e.groupBy("ec").agg(F.when(F.length("ec") % 2 == 0, F.max("ts")).otherwise(F.min("ts")).alias("fetched_at"))
    now = e.agg(F.max("ts")).first()[0]
    return readers.cached(e.select("ec", "event_id"), meta, F.lit(now), 1).select("ec", "event_id", "fetched_at")


@query(sql("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"))
def streaming_usage(spark, d):
    rows = spark.readStream.schema(view(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{d}/events.parquet*")
    return counters.run_once(counters.usage(rows), place(spark, "stream"), "start", "event_type")


@query()
def augment_views(spark, d):
    return augment.sequence_views(view(spark, d, "sequences").select("accession", "sequence"), "accession", "sequence", 3).select("accession", "a", "b")


UNIFORM = "(('0x' || substr(md5(concat_ws('|', '12345', accession, i, '{side}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(
    sql(
        "SELECT accession, i::INT AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY accession)), 1e-12), 6) AS x FROM"
        f" (SELECT accession, i, sqrt(-2 * ln(1 - {UNIFORM.format(side='r')})) * cos(2 * pi() * {UNIFORM.format(side='t')}) AS x FROM sequences CROSS JOIN (SELECT unnest(range(1, 9)) AS i))",
        "sequences",
    )
)
def synthetic_vectors(spark, d):
    """Unit vectors for entries that have none."""
    made = augment.synthetic_vectors(view(spark, d, "sequences").select("accession"), 8, 12345)
    return made.select("accession", F.posexplode("vec").alias("i", "x")).select("accession", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query()
def vector_views(spark, d):
    v = view(spark, d, "vectors").select("accession", "vec")
    rows = episode_fallback(spark, d).join(v, "accession").withColumn("vec", vec.doubles(F.col("vec")))
    seen = rows.withColumn("view", augment.vector_views(3)("accession", "occurrence", "vec"))
    return seen.select("episode", "slot", "draw", "accession", "occurrence", F.round(vec.norm(F.col("view")), 6).alias("norm"), F.round(vec.dot(F.col("view"), F.col("vec")), 6).alias("likeness"))


@query()
def train_projection(spark, d):
    """step, loss, accuracy (where it was checked), choice. Episodes of test classes are trained on, and those of val checked."""
    other = view(spark, d, "vec_labels").where("split = 'val'").select("ec", "accession").distinct()
    held = episodes.standard(written(episodes.pick_classes(other, 10, M, K, Q, SEED), "validation-classes"), other, K, Q, SEED)
    both = members(spark, d).unionByName(other)
    got = training.train(samples(spark, d), view(spark, d, "vectors"), 16, rate=0.01, validation=held, members=both, codes=codes(spark, d), every=4)
    seen = dict(got.checks)
    return spark.createDataFrame([(i, x, seen.get(i), got.choice) for i, x in enumerate(got.losses, 1)], "step int, loss double, accuracy double, choice string")


@query(sql("SELECT ec_full AS ec, count(*) AS n FROM labels_long GROUP BY 1", "labels_long"))
def counts_csv_roundtrip(spark, d):
    path = place(spark, "counts")
    writers.csv(view(spark, d, "labels_long").groupBy(F.col("ec_full").alias("ec")).agg(F.count("*").alias("n")), path, "ec")
    return spark.read.option("header", True).schema("ec string, n bigint").csv(path)


@query(sql("SELECT accession, CASE WHEN key % 2 = 0 THEN source END AS source, CASE WHEN key % 2 = 1 THEN key END AS key FROM entries", "labels_long", "entries"))
def append_roundtrip(spark, d):
    """Two tables with different columns, the second appended to the first."""
    e, first, both = view(spark, d, "entries"), place(spark, "first"), place(spark, "both")
    e.where("key % 2 = 0").select("accession", "source").write.parquet(first)
    writers.appended(e.where("key % 2 = 1").select("accession", "key"), first, both)
    return spark.read.parquet(both).select("accession", "source", "key")


@query(sql("SELECT event_id AS line_no, event_type AS phase, (user_id % 4)::VARCHAR AS cutoff, concat('a=', event_id, '_b') AS note FROM events"))
def status_log_roundtrip(spark, d):
    """Lines written from fields, in two turns, and read again."""
    path = place(spark, "log")
    fields = F.create_map(F.lit("phase"), F.col("event_type"), F.lit("cutoff"), (F.col("user_id") % 4).cast("string"), F.lit("note"), F.concat(F.lit("a="), F.col("event_id").cast("string"), F.lit(" b")))
    e = view(spark, d, "events").select((F.col("event_id") % 2).alias("turn"), writers.status_line(F.col("event_id").cast("string"), fields).alias("line"))
    for turn in (0, 1):
        writers.status(e.where(F.col("turn") == turn), path)
    back = readers.status(spark.read.text(path).select(F.substring_index("value", " ", 1).cast("bigint").alias("line_no"), F.col("value").alias("line")))
    return back.select("line_no", F.col("fields.phase").alias("phase"), F.col("fields.cutoff").alias("cutoff"), F.col("fields.note").alias("note"))


@query(sql("SELECT r_regionkey::INT AS place, CASE WHEN r_regionkey < 2 THEN 'a' WHEN r_regionkey = 2 THEN 'c' ELSE 'd' END AS ec FROM region"))
def ragged_rows(spark, d):
    """Rows that lie one after the other, cut by the number of each class; b has none."""
    flat = view(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("at"), F.array(F.col("r_regionkey").cast("double")).alias("vec"))
    counts = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1), ("d", 2)], "ec string, n bigint")
    return readers.ragged(flat, counts).select(F.col("vec")[0].cast("int").alias("place"), "ec")
