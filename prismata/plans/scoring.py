"""Queries on vectors: prototypes, scores, decisions, metrics, calibration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import benchmark, calibrate, kmeans, labels, scoring
from ..session import shared_dir, written
from ..sources import readers, writers
from ..sources.fixtures import sql, view
from .registry import query

T = 0.1
V = ("vectors", "vec_labels")
UNIT = "list_transform({v}, lambda y: y::DOUBLE / greatest(sqrt(list_sum(list_transform({v}, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12))"
PROTO = {
    "u": f"SELECT accession, split, label, vec_id, {UNIT.format(v='vec')} AS v FROM vectors",
    "m": "SELECT ec, pos, avg(v[pos]) AS x, count(*)::INT AS n FROM (SELECT l.ec, u.v, unnest(range(1, 65)) AS pos FROM vec_labels l JOIN u USING (accession) WHERE l.split = 'train') GROUP BY 1, 2",
    "p": f"SELECT ec, {UNIT.format(v='w')} AS v, n AS train_count FROM (SELECT ec, list(x ORDER BY pos) AS w, max(n) AS n FROM m GROUP BY 1)",
    "s": "SELECT u.accession, p.ec, list_sum(list_transform(list_zip(u.v, p.v), lambda z: z[1] * z[2])) AS logit FROM u CROSS JOIN p WHERE u.split = 'test'",
    "truth": "SELECT DISTINCT accession, ec FROM vec_labels WHERE split = 'test'",
    "j": f"SELECT s.*, 1 / (1 + exp(-logit / {T})) AS prob, truth.ec IS NOT NULL AS t, row_number() OVER (PARTITION BY s.accession ORDER BY logit DESC, s.ec) AS rank FROM s LEFT JOIN truth ON truth.accession = s.accession AND truth.ec = s.ec",
}


def train(spark, d):
    return view(spark, d, "vec_labels").where("split = 'train'").select("ec", "accession")


def truth(spark, d):
    return view(spark, d, "vec_labels").where("split = 'test'").select("accession", "ec").distinct()


def bank(spark, d):
    return written(scoring.prototypes(view(spark, d, "vectors"), train(spark, d)), "bank")


def scores(spark, d):
    return scoring.class_logits(view(spark, d, "vectors").where("split = 'test'"), bank(spark, d))


def decided(spark, d, tau=0.85, shortlist=0, overrides=None, own=None):
    """Judged decisions: hits, best classes and true cells; the other cells are never written out."""
    own = bank(spark, d) if own is None else own
    asked = view(spark, d, "vectors").where("split = 'test'")
    found = scoring.promising(asked, own, tau, T, shortlist, overrides)
    return scoring.judged(scoring.decide(found, tau, T, shortlist, overrides), truth(spark, d), asked, own)


def counted(spark, d, *settings):
    """Hits, false hits and misses of each class of the bank."""
    own = bank(spark, d)
    return scoring.all_classes(scoring.per_class(decided(spark, d, *settings, own=own)), own)


def hits(tau="0.85", shortlist=None):
    """Decisions in SQL: over the threshold (and in the shortlist), else the best."""
    over = f"prob >= {tau}" + (f" AND rank <= {shortlist}" if shortlist else "")
    return f"SELECT *, ({over}) OR (rank = 1 AND NOT bool_or({over}) OVER (PARTITION BY accession)) AS h FROM j"


CLASSES = {"c": "SELECT ec, count(*) FILTER (h AND t) AS tp, count(*) FILTER (h AND NOT t) AS fp, count(*) FILTER (NOT h AND t) AS fn FROM d GROUP BY 1"}


def r(a, b):
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


MICRO = f"round({r('sum(tp)', 'sum(tp + fp)')}, 6) AS micro_precision, round({r('sum(tp)', 'sum(tp + fn)')}, 6) AS micro_recall, round({r('2 * sum(tp)', 'sum(2 * tp + fp + fn)')}, 6) AS micro_f1"
MACRO = f"round(avg({r('tp', 'tp + fp')}), 6) AS macro_precision, round(avg({r('tp', 'tp + fn')}), 6) AS macro_recall, round(avg({r('2 * tp', '2 * tp + fp + fn')}), 6) AS macro_f1"


@query(sql("SELECT t.ec, count(*) AS queries, count(*) FILTER (j.t) AS top1_hits, round(count(*) FILTER (j.t) / count(*), 6) AS top1_rate FROM truth t JOIN j ON j.accession = t.accession AND j.rank = 1 GROUP BY 1", *V, **PROTO))
def flagship_top1(spark, d):
    first = decided(spark, d).where("rank = 1").select("accession", "true")
    return truth(spark, d).join(first, "accession").groupBy("ec").agg(F.count("*").alias("queries"), F.count_if("true").alias("top1_hits"), F.round(F.count_if("true") / F.count("*"), 6).alias("top1_rate"))


@query(sql("SELECT ec, train_count, pos, round(v[pos], 6) AS x FROM (SELECT *, unnest(range(1, 65))::INT AS pos FROM p)", *V, **PROTO))
def prototypes(spark, d):
    return bank(spark, d).select("ec", "train_count", F.posexplode("vec").alias("pos", "x")).select("ec", "train_count", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query(sql(f"SELECT src, pos, round(({UNIT.format(v='w')})[pos], 6) AS x FROM (SELECT src, w, unnest(range(1, 65))::INT AS pos FROM (SELECT src, list(x ORDER BY pos) AS w FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 'TrEMBL' ELSE 'SwissProt' END AS src, pos, avg(v[pos]) AS x FROM (SELECT *, unnest(range(1, 65)) AS pos FROM u WHERE split = 'train') GROUP BY 1, 2) GROUP BY 1))", *V, **PROTO))
def prototypes_by_source(spark, d):
    v = view(spark, d, "vectors").where("split = 'train'")
    members = v.select(F.when(F.col("vec_id") % 3 == 0, "TrEMBL").otherwise("SwissProt").alias("ec"), "accession")
    return scoring.prototypes(v, members).select(F.col("ec").alias("src"), F.posexplode("vec").alias("pos", "x")).select("src", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query(sql("SELECT accession, ec, round(logit, 6) AS logit FROM s", *V, **PROTO))
def logits(spark, d):
    return scores(spark, d).withColumn("logit", F.round("logit", 6))


@query(
    sql(
        "SELECT accession, ec, round(CASE WHEN count(*) = 1 THEN max(x) ELSE ln(sum(exp(x))) END, 6) AS logit FROM"
        " (SELECT q.accession, e.ec, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS x FROM u q CROSS JOIN (SELECT concat('L', label % 5) AS ec, v FROM u WHERE split = 'val') e WHERE q.split = 'test') GROUP BY 1, 2",
        *V,
        **PROTO,
    )
)
def logsumexp_logits(spark, d):
    v = view(spark, d, "vectors")
    many = scoring.projected(v.where("split = 'val'")).select(F.concat(F.lit("L"), F.col("label") % 5).alias("ec"), F.col("vec_id").cast("int").alias("proto_id"), "vec")
    return scoring.class_logits(v.where("split = 'test'"), many).withColumn("logit", F.round("logit", 6))


@query(sql(f"SELECT {MICRO}, {MACRO} FROM c", *V, **PROTO, d=hits(), **CLASSES))
def eval_threshold(spark, d):
    return scoring.micro_macro(counted(spark, d))


@query(sql(f"SELECT {MICRO}, {MACRO} FROM c", *V, **PROTO, d=hits("0.6", 2), **CLASSES))
def eval_shortlist(spark, d):
    return scoring.micro_macro(counted(spark, d, 0.6, 2))


@query(sql(f"SELECT {MICRO}, {MACRO} FROM c", *V, **PROTO, d=hits("CASE ec WHEN 'L1' THEN 0.9 WHEN 'L2' THEN 0.7 ELSE 0.85 END"), **CLASSES))
def eval_per_class_tau(spark, d):
    own = spark.createDataFrame([("L1", 0.9), ("L2", 0.7)], "ec string, tau double")
    return scoring.micro_macro(counted(spark, d, 0.85, 0, own))


@query(sql(f"SELECT bucket, {MICRO}, round(avg({r('2 * tp', '2 * tp + fp + fn')}), 6) AS macro_f1 FROM (SELECT c.*, CASE WHEN train_count <= 5 THEN 'tail' WHEN train_count <= 25 THEN 'medium' ELSE 'head' END AS bucket FROM c JOIN p USING (ec)) GROUP BY 1", *V, **PROTO, d=hits(), **CLASSES))
def eval_buckets(spark, d):
    return scoring.buckets(counted(spark, d), bank(spark, d))


SETS = {
    "subset_accuracy": "(i = t + p - i AND t + p - i > 0)::INT::DOUBLE",
    "jaccard": "i / greatest(t + p - i, 1)",
    "card_mae": "abs(p - t)::DOUBLE",
    "card_true": "t::DOUBLE",
    "card_pred": "p::DOUBLE",
    "under": "(p < t)::INT::DOUBLE",
    "over": "(p > t)::INT::DOUBLE",
}


@query(
    sql(
        "SELECT " + ", ".join(f"round(avg({v}), 6) AS {k}" for k, v in SETS.items()) + ", " + ", ".join(f"round(avg({v}) FILTER (t > 1), 6) AS multi_{k}" for k, v in SETS.items())
        + " FROM (SELECT accession, count(*) FILTER (t) AS t, count(*) FILTER (h) AS p, count(*) FILTER (t AND h) AS i FROM d GROUP BY 1)",
        *V,
        **PROTO,
        d=hits(),
    )
)
def eval_set_metrics(spark, d):
    return scoring.set_metrics(decided(spark, d))


@query(sql("SELECT count(*) FILTER (rank = 1) AS queries, round(avg(t::INT) FILTER (rank = 1), 6) AS acc_top1_hit FROM j", *V, **PROTO))
def eval_top1(spark, d):
    return scoring.top1_rate(decided(spark, d))


ASKED = "SELECT accession, CASE WHEN accession LIKE '%3' THEN 'L77' ELSE ec END AS ec FROM truth UNION ALL SELECT concat('W', doc_id), 'L1' FROM documents WHERE source = 'src1'"


@query(
    sql(
        "SELECT count(*) AS queries_total, count(*) FILTER (v AND n > 0) AS queries_covered, count(*) FILTER (NOT v) AS missing_embedding, count(*) FILTER (v AND n = 0) AS missing_labels, round(count(*) FILTER (v AND n > 0) / greatest(count(*), 1), 6) AS coverage"
        " FROM (SELECT a.accession, bool_or(a.accession IN (SELECT accession FROM vectors)) AS v, count(DISTINCT p.ec) AS n FROM a LEFT JOIN p ON p.ec = a.ec GROUP BY 1)",
        *V,
        **PROTO,
        a=ASKED,
    )
)
def eval_coverage(spark, d):
    asked = truth(spark, d).withColumn("ec", F.when(F.col("accession").endswith("3"), "L77").otherwise(F.col("ec")))
    asked = asked.unionAll(view(spark, d, "documents").where("source = 'src1'").select(F.concat(F.lit("W"), "doc_id"), F.lit("L1")))
    return scoring.coverage(scoring.answerable(asked, asked, view(spark, d, "vectors"), bank(spark, d)))


@query(
    sql(
        "SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, " + MACRO + " FROM (SELECT ec, count(*) FILTER (y AND ok) AS tp, count(*) FILTER (NOT y AND NOT ok) AS fp, count(*) FILTER (y AND NOT ok) AS fn FROM"
        " (SELECT y AS ec, true AS y, y = z AS ok FROM o UNION ALL SELECT z, false, y = z FROM o) GROUP BY 1)",
        *V,
        **PROTO,
        o="SELECT concat('L', label) AS y, j.ec AS z FROM j JOIN u USING (accession) WHERE rank = 1",
    )
)
def single_label_macro(spark, d):
    first = decided(spark, d).where("rank = 1").select("accession", F.col("ec").alias("pred_ec"))
    return scoring.single_label_metrics(view(spark, d, "vectors").select("accession", F.concat(F.lit("L"), "label").alias("true_ec")).join(first, "accession"))


GRID = vec.temperature_grid(T)
TAUS = vec.steps(0.60, 0.95, 0.01)


def tests(spark, d):
    return view(spark, d, "vectors").where("split = 'test'")


def bins(spark, d):
    return calibrate.score_bins(tests(spark, d), bank(spark, d), truth(spark, d), TAUS, T)


def taus(spark, d):
    return calibrate.tau_curve(*bins(spark, d), TAUS)


def curve(spark, d):
    return scoring.bank_losses(tests(spark, d), bank(spark, d), truth(spark, d), GRID)


TEMPS = {
    "tc": "SELECT round(tt, 8) AS temperature, round(avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))), 6) AS bce, round(avg((p - y) * (p - y)), 6) AS brier FROM (SELECT *, greatest(least(p, 1 - 1e-7), 1e-7) AS pc FROM"
    " (SELECT tt, t::INT::DOUBLE AS y, 1 / (1 + exp(-logit / tt)) AS p FROM j CROSS JOIN (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in GRID) + "]) AS tt))) GROUP BY tt",
}


@query(sql("SELECT * FROM tc", *V, **PROTO, **TEMPS))
def temperature_curve(spark, d):
    return curve(spark, d)


CURVE = {
    "k": "SELECT tau, count(*) FILTER (h AND t) AS tp, count(*) FILTER (h AND NOT t) AS fp, count(*) FILTER (NOT h AND t) AS fn FROM (SELECT *, prob >= tau OR rank = 1 AS h FROM j CROSS JOIN (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in TAUS) + "]) AS tau)) GROUP BY 1",
    "cv": f"SELECT tau, round({r('tp', 'tp + fp')}, 6) AS micro_precision, round({r('tp', 'tp + fn')}, 6) AS micro_recall, round({r('2 * tp', '2 * tp + fp + fn')}, 6) AS micro_f1 FROM k",
}


@query(sql("SELECT * FROM cv", *V, **PROTO, **CURVE))
def tau_grid(spark, d):
    return taus(spark, d)


@query(sql("SELECT *, micro_precision >= 0.12 AND micro_recall >= 0.2 AS feasible FROM cv ORDER BY feasible DESC, micro_f1 DESC, tau LIMIT 1", *V, **PROTO, **CURVE))
def best_tau(spark, d):
    return scoring.best_tau(taus(spark, d), 0.12, 0.2)


#: Per-class thresholds in SQL: each class's counts at each threshold, and the one that it prefers.
CLASS_TAUS = {
    "ct": "SELECT ec, tau, count(*) FILTER (prob >= tau AND t) AS tp, count(*) FILTER (prob >= tau AND NOT t) AS fp, count(*) FILTER (prob < tau AND t) AS fn FROM j CROSS JOIN (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in TAUS) + "]) AS tau) GROUP BY 1, 2",
}
OWN_TAU = {
    "max_f1": "arg_min(tau, (-" + r("2 * tp", "2 * tp + fp + fn") + ", tau))",
    "precision_at": "min(tau) FILTER (tp + fp > 0 AND " + r("tp", "tp + fp") + " >= {target})",
    "recall_at": "max(tau) FILTER (" + r("tp", "tp + fn") + " >= {target})",
}


def chosen(mode, target, shrink, least):
    own = OWN_TAU[mode].format(target=target)
    return f"SELECT ec, n AS positives, round(CASE WHEN n >= {least} AND own IS NOT NULL THEN (n * own + {shrink} * 0.7) / (n + {shrink}) ELSE 0.7 END, 6) AS tau FROM (SELECT ec, max(tp + fn) AS n, {own} AS own FROM ct GROUP BY 1)"


def own_taus(spark, d, mode, target, shrink, least):
    return calibrate.class_thresholds(bins(spark, d)[0], TAUS, mode, 0.7, target, shrink, least)


@query(sql(chosen("max_f1", 0, "4.0", 3), *V, **PROTO, **CLASS_TAUS))
def class_thresholds_f1(spark, d):
    return own_taus(spark, d, "max_f1", 0, 4.0, 3)


@query(sql(chosen("precision_at", 0.15, "0.0", 1), *V, **PROTO, **CLASS_TAUS))
def class_thresholds_precision(spark, d):
    return own_taus(spark, d, "precision_at", 0.15, 0.0, 1)


@query(sql(chosen("recall_at", 0.4, "2.0", 2), *V, **PROTO, **CLASS_TAUS))
def class_thresholds_recall(spark, d):
    return own_taus(spark, d, "recall_at", 0.4, 2.0, 2)


TUNED = "(SELECT tau FROM w WHERE w.ec = j.ec)"


@query(sql("SELECT ec, tp, fp, fn FROM c", *V, **PROTO, **CLASS_TAUS, w=chosen("max_f1", 0, "4.0", 3), d=hits(TUNED), **CLASSES))
def eval_tuned_thresholds(spark, d):
    """Decisions by thresholds that were tuned for each class."""
    own = written(own_taus(spark, d, "max_f1", 0, 4.0, 3).select("ec", "tau"), "class-thresholds")
    return counted(spark, d, 0.7, 0, own).select("ec", "tp", "fp", "fn")


@query(sql("SELECT ec, (sum(n) OVER (ORDER BY ec ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start, n::BIGINT AS n FROM (SELECT ec, max(n) AS n FROM m GROUP BY 1)", *V, **PROTO))
def ragged_offsets(spark, d):
    """Where each class's rows start when all are laid one after the other."""
    n = train(spark, d).groupBy("ec").agg(F.count("*").alias("n"))
    return labels.ranged(n, "ec", F.col("n"), "start", False)


@query(sql("SELECT accession, round(sqrt(list_sum(list_transform(v, lambda z: z * z))), 6) AS norm, round(v[1], 6) AS head FROM u", *V, **PROTO))
def vec_normalize(spark, d):
    u = scoring.projected(view(spark, d, "vectors"))
    return u.select("accession", F.round(vec.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("head"))


@query(sql("SELECT accession, round(v[1] + v[2] + 0.5, 6) AS raw0, round((0.5 + v[1] + v[2]) / greatest(sqrt((0.5 + v[1] + v[2]) * (0.5 + v[1] + v[2]) + (v[3] - 1) * (v[3] - 1)), 1e-12), 6) AS x0 FROM u", *V, **PROTO))
def affine_projection(spark, d):
    u = scoring.projected(view(spark, d, "vectors"))
    w = [[1.0, 1.0, *[0.0] * 62], [0.0, 0.0, 1.0, *[0.0] * 61]]
    raw = vec.dot(F.col("vec"), F.array(*[F.lit(x) for x in w[0]])) + 0.5
    both = u.select("accession", F.round(raw, 6).alias("raw0"), "vec")
    return scoring.projected(both, w, [0.5, -1.0]).select("accession", "raw0", F.round(F.col("vec")[0], 6).alias("x0"))


@query()
def kmeans_subprototypes(spark, d):
    return kmeans.sub_prototypes(view(spark, d, "vectors"), train(spark, d), 3).select("ec", "proto_id", "train_count", F.round(vec.norm(F.col("vec")), 6).alias("norm"))


@query(sql("SELECT 'bce' AS method, arg_min(temperature, (bce, temperature)) AS temperature FROM tc UNION ALL SELECT 'brier', arg_min(temperature, (brier, temperature)) FROM tc UNION ALL SELECT 'none', 0.1", *V, **PROTO, **TEMPS))
def best_temperature(spark, d):
    losses = written(curve(spark, d), "curve")
    parts = [scoring.best_temperature(losses, m, T).select(F.lit(m).alias("method"), "temperature") for m in ("bce", "brier", "none")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    sql(
        "SELECT (SELECT tau FROM cv ORDER BY micro_f1 DESC, tau LIMIT 1) AS tau_multi, (SELECT arg_min(temperature, (bce, temperature)) FROM tc) AS temperature, 200 AS \"shortlist_topN\", 'bce' AS opt_temp, count(*) AS n_taus, max(micro_f1) AS top_f1, (SELECT count(*) FROM tc) AS n_temperatures, (SELECT min(bce) FROM tc) AS least_loss FROM cv",
        *V,
        **PROTO,
        **CURVE,
        **TEMPS,
    )
)
def calibration_document(spark, d):
    """The calibration document, written as JSON and read again."""
    made = scoring.calibration(written(curve(spark, d), "curve"), written(taus(spark, d), "taus"), "bce", T, 200)
    path = f"{shared_dir(spark)}/calibration-{uuid.uuid4().hex}"
    writers.documents(made, path)
    back = readers.documents(spark, path, made.schema)
    return back.select("tau_multi", "temperature", "shortlist_topN", "opt_temp", F.size("grid.taus").cast("bigint").alias("n_taus"), F.array_max("grid.micro_f1").alias("top_f1"), F.size("temperature_curve.temperature").cast("bigint").alias("n_temperatures"), F.array_min("temperature_curve.bce").alias("least_loss"))


@query(sql("SELECT ec, train_count, round(list_sum(list_transform(v, lambda x: x)), 4) AS total FROM p", *V, **PROTO))
def bank_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/bank-{uuid.uuid4().hex}"
    writers.bank(bank(spark, d), path)
    return readers.bank(spark, path).select("ec", "train_count", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(sql("SELECT accession, round((0.5 + v[1] + v[2]) / greatest(sqrt((0.5 + v[1] + v[2]) * (0.5 + v[1] + v[2]) + (v[3] - 1) * (v[3] - 1)), 1e-12), 6) AS x0 FROM u", *V, **PROTO))
def projection_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/projection-{uuid.uuid4().hex}"
    writers.projection([[1.0, 1.0, *[0.0] * 62], [0.0, 0.0, 1.0, *[0.0] * 61]], [0.5, -1.0], path, spark)
    u = scoring.projected(view(spark, d, "vectors"))
    return scoring.projected(u, *readers.projection(spark, path)).select("accession", F.round(F.col("vec")[0], 6).alias("x0"))


@query(sql("SELECT concat('T', label) AS accession, pos, round(avg(vec[pos]::DOUBLE), 6) AS x FROM (SELECT label, vec, unnest(range(1, 65))::INT AS pos FROM vectors WHERE vec_id % 4 <> 0) GROUP BY 1, 2", "vectors"))
def masked_means(spark, d):
    kind = F.when(F.col("vec_id") % 4 != 0, "letter").when(F.col("vec_id") % 8 == 0, "pad").otherwise("eos")
    tokens = view(spark, d, "vectors").select(F.concat(F.lit("T"), "label").alias("accession"), kind.alias("kind"), vec.doubles(F.col("vec")).alias("vec"))
    return scoring.masked_means(tokens).select("accession", F.posexplode("vec").alias("pos", "x")).select("accession", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query(sql("SELECT wanted, count(*) AS n, count(DISTINCT l.accession) AS n_members FROM (SELECT unnest(['SwissProt', 'TrEMBL', 'Other']) AS wanted) w JOIN (SELECT ec, accession, CASE WHEN substr(accession, 2)::INT % 3 = 0 THEN 'TrEMBL' ELSE 'SwissProt' END AS source FROM vec_labels WHERE split = 'train') l ON wanted = source OR wanted = 'Other' GROUP BY 1", *V))
def source_fallback(spark, d):
    """Members of one source, unknown ones being of the default; of a source that has none, all."""
    known = view(spark, d, "vectors").where("vec_id % 3 = 0").select("accession", F.lit("TrEMBL").alias("source"))
    parts = [scoring.source_members(train(spark, d), known, s).agg(F.lit(s).alias("wanted"), F.count("*").alias("n"), F.count_distinct("accession").alias("n_members")) for s in ("SwissProt", "TrEMBL", "Other")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


BENCH = {
    "bs": "SELECT c AS cutoff, f AS fold, accession, v, label, vec_id % c % 2 = f AS held FROM u CROSS JOIN (SELECT unnest([7, 11]) AS c) CROSS JOIN (SELECT unnest(range(2)) AS f)",
    "bm": "SELECT cutoff, fold, label, pos, avg(v[pos]) AS x FROM (SELECT cutoff, fold, label, v, unnest(range(1, 65)) AS pos FROM bs WHERE NOT held) GROUP BY 1, 2, 3, 4",
    "bp": f"SELECT cutoff, fold, label, {UNIT.format(v='w')} AS p FROM (SELECT cutoff, fold, label, list(x ORDER BY pos) AS w FROM bm GROUP BY 1, 2, 3)",
    "bt": "SELECT b.cutoff, b.fold, accession, arg_max(bp.label, (list_sum(list_transform(list_zip(v, p), lambda z: z[1] * z[2])), -bp.label)) = any_value(b.label) AS ok FROM bs b JOIN bp ON bp.cutoff = b.cutoff AND bp.fold = b.fold WHERE held GROUP BY 1, 2, 3",
}


@query(sql("SELECT cutoff, fold::INT AS fold, count(*)::DOUBLE AS entities, round(avg(ok::INT), 6) AS acc_top1_hit, 0::DOUBLE AS multi_ratio FROM bt GROUP BY 1, 2", *V, **PROTO, **BENCH))
def benchmark_run(spark, d):
    """Two cutoffs and folds: prototypes of what isn't held out, scored on what is; records are stored and read again."""
    v = view(spark, d, "vectors").withColumn("ec", F.concat(F.lit("L"), "label"))

    def evaluate(cutoff, fold):
        held = F.col("vec_id") % cutoff % 2 == fold
        own = v.where(held).select("ec", "accession")
        protos = written(scoring.prototypes(v, v.where(~held).select("ec", "accession")), "bank")
        found = scoring.promising(v.where(held), protos, 0.5, T)
        return own, scoring.top1_rate(scoring.judged(scoring.decide(found, 0.5, T), own)).select("acc_top1_hit")

    path = f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}"
    benchmark.run(spark, path, (7,), 2, {"seed": 1}, evaluate)
    rows = benchmark.run(spark, path, (7, 11), 2, {"seed": 1}, evaluate)  # goes on with what is missing
    return rows.select("cutoff", "fold", F.col("label_stats.entities").alias("entities"), F.col("metrics.acc_top1_hit").alias("acc_top1_hit"), F.col("label_stats.multi_ratio").alias("multi_ratio"))
