"""Queries on coded entries: cleaning, counting, hierarchy, splits, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import graph, labels, splits
from ..session import written
from ..sources.fixtures import sql, view
from .registry import query

SEED = 42


@query(sql("SELECT accession, trim(ec) AS ec, source FROM entries WHERE ec IS NOT NULL AND length(ec) > 0", "labels_long", "entries"))
def normalize_filter(spark, d):
    return labels.normalize(view(spark, d, "entries")).select("accession", "ec", "source")


@query(sql("SELECT accession, trim(ec) AS ec FROM entries WHERE length(ec) > 0 AND NOT contains(ec, ';')", "entries"))
def single_label_filter(spark, d):
    return labels.single_label(labels.normalize(view(spark, d, "entries"))).select("accession", "ec")


EXPLODED = "SELECT accession, source, trim(c) AS ec FROM (SELECT accession, source, unnest(string_split(ec, ';')) AS c FROM entries WHERE length(ec) > 0) WHERE trim(c) <> ''"


def exploded(spark, d):
    return labels.explode_labels(labels.normalize(view(spark, d, "entries")))


@query(sql(EXPLODED, "entries"))
def explode_multilabel(spark, d):
    return exploded(spark, d).select("accession", "source", "ec")


@query(sql("SELECT accession, ec FROM x WHERE source = 'SwissProt'", "entries", x=EXPLODED))
def source_filter(spark, d):
    return labels.from_source(exploded(spark, d), "SwissProt").select("accession", "ec")


@query(sql("SELECT accession, coalesce(nullif(trim(ec), ''), 'none') AS code, coalesce(nullif(trim(ec), ''), source) AS either FROM entries WHERE nullif(trim(accession), '') IS NOT NULL", "entries"))
def alias_coalesce(spark, d):
    e = view(spark, d, "entries")
    return e.where(codes.first_filled(F.col("accession")).isNotNull()).select("accession", codes.first_filled(F.col("ec"), F.lit("none")).alias("code"), codes.first_filled(F.col("ec"), F.col("source")).alias("either"))


@query(sql("SELECT accession, ec AS ec_full, " + ", ".join(f"coalesce(string_split(ec, '.')[{i}], '') AS ec{i}" for i in range(1, 5)) + " FROM x", "entries", x=EXPLODED))
def code_levels(spark, d):
    return labels.levels(exploded(spark, d).select("accession", F.col("ec").alias("ec_full")))


@query(sql("SELECT accession, ec FROM x WHERE len(string_split(ec, '.')) = 4 AND len(list_filter(string_split(ec, '.'), lambda p: p IN ('', '-'))) = 0", "entries", x=EXPLODED))
def full_code_filter(spark, d):
    return exploded(spark, d).where(codes.is_full(F.col("ec"))).select("accession", "ec")


@query(sql("SELECT count(*) AS total, count(*) FILTER (contains(ec, '-')) AS partial, count(*) FILTER (NOT contains(ec, '-')) AS complete, round(count(*) FILTER (contains(ec, '-')) / count(*), 6) AS partial_ratio FROM x", "entries", x=EXPLODED))
def partial_code_counts(spark, d):
    return labels.partial_counts(exploded(spark, d))


@query(sql("SELECT CASE WHEN string_split(ec, '.')[4] = '-' THEN 'NA' ELSE string_split(ec, '.')[4] END AS ec4, count(*) AS n FROM x GROUP BY 1", "entries", x=EXPLODED))
def unknown_levels(spark, d):
    return exploded(spark, d).groupBy(codes.or_na(codes.level(F.col("ec"), 4)).alias("ec4")).agg(F.count("*").alias("n"))


@query(sql("SELECT array_to_string(string_split(ec_full, '.')[1:2], '.') AS code, count(*) AS n, count(DISTINCT accession) AS n_members FROM labels_long GROUP BY 1", "labels_long"))
def ancestor_counts(spark, d):
    return view(spark, d, "labels_long").groupBy(codes.ancestor(F.col("ec_full"), 2).alias("code")).agg(F.count("*").alias("n"), F.count_distinct("accession").alias("n_members"))


@query(sql("SELECT accession, ec FROM entries WHERE list_contains(list_transform(string_split(ec, ';'), lambda p: trim(p)), '1.0.2.1') OR list_contains(list_transform(string_split(ec, ';'), lambda p: trim(p)), '2.1.1.5')", "entries"))
def membership_filter(spark, d):
    e = view(spark, d, "entries")
    return e.where(codes.contains_code(F.col("ec"), F.lit("1.0.2.1")) | codes.contains_code(F.col("ec"), F.lit("2.1.1.5"))).select("accession", "ec")


@query(sql("SELECT DISTINCT ec, replace(replace(replace(ec, '/', '_'), '.', '_'), '-', 'neg') AS key FROM x", "entries", x=EXPLODED))
def key_sanitizer(spark, d):
    return exploded(spark, d).select("ec").distinct().select("ec", codes.sanitized(F.col("ec")).alias("key"))


WANTED = "SELECT accession FROM sequences WHERE lang <> 'fr' UNION ALL SELECT concat('X', doc_id) FROM sequences WHERE source = 'src1'"


def wanted(spark, d):
    s = view(spark, d, "sequences")
    return s.where("lang != 'fr'").select("accession").unionAll(s.where("source = 'src1'").select(F.concat(F.lit("X"), "doc_id").alias("accession")))


@query(sql("SELECT count(*) AS wanted, count(*) FILTER (s.accession IS NULL) AS missing, count(*) FILTER (length(sequence) > 1022) AS over_limit, count(*) FILTER (length(sequence) <= 1022) AS left_over FROM (SELECT DISTINCT accession FROM w) w LEFT JOIN sequences s USING (accession)", "sequences", w=WANTED))
def length_filter_report(spark, d):
    return labels.length_report(wanted(spark, d), view(spark, d, "sequences"), 1022)


@query(sql("SELECT accession, left(sequence, 1022) AS sequence FROM sequences", "sequences"))
def truncate_long(spark, d):
    return labels.length_limit(view(spark, d, "sequences"), 1022, truncate=True).select("accession", "sequence")


@query(sql("SELECT accession, sequence, length(sequence) AS n FROM sequences JOIN (SELECT DISTINCT accession FROM w) w USING (accession) WHERE length(sequence) > 0", "sequences", w=WANTED))
def inner_join_sequences(spark, d):
    s = view(spark, d, "sequences").where(F.length("sequence") > 0)
    return wanted(spark, d).distinct().join(s, "accession").select("accession", "sequence", F.length("sequence").cast("bigint").alias("n"))


@query(sql("SELECT w.accession FROM (SELECT DISTINCT accession FROM w) w WHERE accession NOT IN (SELECT accession FROM sequences)", "sequences", w=WANTED))
def missing_sequences(spark, d):
    return wanted(spark, d).distinct().join(view(spark, d, "sequences"), "accession", "left_anti")


@query(sql("SELECT ec, l.accession FROM vec_labels l WHERE EXISTS (SELECT 1 FROM vectors v WHERE v.accession = l.accession AND v.split = 'train')", "vectors", "vec_labels"))
def covered_members(spark, d):
    return view(spark, d, "vec_labels").join(view(spark, d, "vectors").where("split = 'train'").select("accession"), "accession", "left_semi").select("ec", "accession")


@query(sql("SELECT accession, coalesce(e.source, 'SwissProt') AS source FROM (SELECT DISTINCT accession FROM labels_long) l LEFT JOIN (SELECT accession, source FROM entries WHERE key % 5 <> 0) e USING (accession)", "labels_long", "entries"))
def source_default_join(spark, d):
    lookup = view(spark, d, "entries").where("key % 5 <> 0")
    return labels.with_default(view(spark, d, "labels_long").select("accession").distinct(), lookup, "source", F.lit("SwissProt")).select("accession", "source")


CLUSTERS = "SELECT accession, concat('K', key % 40) AS cluster_id FROM entries WHERE key % 7 <> 0"


def cluster_lookup(spark, d):
    return view(spark, d, "entries").where("key % 7 <> 0").select("accession", F.concat(F.lit("K"), F.col("key") % 40).alias("cluster_id"))


@query(sql("SELECT accession, ec_full AS ec, coalesce(cluster_id, concat('_na_', accession)) AS cluster_id FROM labels_long LEFT JOIN c USING (accession)", "labels_long", "entries", c=CLUSTERS))
def cluster_default_join(spark, d):
    return labels.with_default(view(spark, d, "labels_long"), cluster_lookup(spark, d), "cluster_id", F.concat(F.lit("_na_"), F.col("accession"))).select("accession", F.col("ec_full").alias("ec"), "cluster_id")


@query(sql("SELECT ec_full AS ec, count(DISTINCT coalesce(cluster_id, concat('_na_', accession))) AS n_clusters FROM labels_long LEFT JOIN c USING (accession) GROUP BY 1", "labels_long", "entries", c=CLUSTERS))
def clusters_per_class(spark, d):
    return cluster_default_join(spark, d).groupBy("ec").agg(F.count_distinct("cluster_id").alias("n_clusters"))


@query(sql("SELECT ec, count(*) AS n_rows, count(DISTINCT accession) AS n_members FROM x GROUP BY 1", "entries", x=EXPLODED))
def class_counts(spark, d):
    return labels.class_counts(exploded(spark, d))


@query(sql("SELECT ec, count(DISTINCT accession) AS n FROM x WHERE source = 'SwissProt' AND len(string_split(ec, '.')) = 4 AND NOT contains(ec, '-') GROUP BY 1", "entries", x=EXPLODED))
def class_distinct_counts(spark, d):
    return labels.from_source(exploded(spark, d), "SwissProt").where(codes.is_full(F.col("ec"))).groupBy("ec").agg(F.count_distinct("accession").alias("n"))


@query(sql("SELECT accession, string_agg(DISTINCT ec, ';' ORDER BY ec) AS labels, count(DISTINCT ec) AS n_labels FROM x GROUP BY 1", "entries", x=EXPLODED))
def entity_label_sets(spark, d):
    return labels.label_sets(exploded(spark, d))


@query(sql("SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_entities, count(*) FILTER (k > 1) AS multi_label, round(count(*) FILTER (k > 1) / count(*), 6) AS multi_ratio FROM (SELECT accession, count(*) AS n, count(DISTINCT ec) AS k FROM x GROUP BY 1)", "entries", x=EXPLODED))
def multilabel_stats(spark, d):
    return labels.multilabel_stats(exploded(spark, d))


@query(sql(" UNION ALL ".join(f"SELECT {i} AS depth, array_to_string(string_split(ec_full, '.')[1:{i}], '.') AS code, count(*) AS n FROM labels_long GROUP BY 2" for i in range(1, 5)), "labels_long"))
def level_counts(spark, d):
    return labels.level_counts(view(spark, d, "labels_long"))


LEVELS = "SELECT accession, ec_full, " + ", ".join(f"string_split(ec_full, '.')[{i}] AS ec{i}" for i in range(1, 5)) + " FROM labels_long"


def leveled(spark, d):
    return labels.levels(view(spark, d, "labels_long"))


@query(sql("SELECT a.ec1, b.ec2, count(v.ec1) AS n FROM (SELECT DISTINCT ec1 FROM v) a CROSS JOIN (SELECT DISTINCT ec2 FROM v) b LEFT JOIN v ON v.ec1 = a.ec1 AND v.ec2 = b.ec2 GROUP BY 1, 2", "labels_long", v=LEVELS))
def pivot_level12(spark, d):
    return labels.pivot_counts(leveled(spark, d), "ec1", "ec2")


@query(sql("SELECT ec2, " + ", ".join(f"""count(*) FILTER (ec3 = '{i}') AS "{i}" """ for i in range(1, 6)) + " FROM v GROUP BY 1", "labels_long", v=LEVELS))
def pivot_level23_wide(spark, d):
    return leveled(spark, d).groupBy("ec2").pivot("ec3", ["1", "2", "3", "4", "5"]).count().na.fill(0)


@query(sql("SELECT coalesce(ec1, '*') AS ec1, coalesce(ec2, '*') AS ec2, coalesce(ec3, '*') AS ec3, coalesce(ec4, '*') AS ec4, ((ec1 IS NOT NULL)::INT + (ec2 IS NOT NULL)::INT + (ec3 IS NOT NULL)::INT + (ec4 IS NOT NULL)::INT) AS depth, count(*) AS n FROM v GROUP BY ROLLUP (ec1, ec2, ec3, ec4)", "labels_long", v=LEVELS))
def rollup_hierarchy(spark, d):
    return labels.rollup_sizes(leveled(spark, d))


FLOW = " UNION ALL ".join(f"SELECT concat('EC{i}:', ec{i}) AS src, concat('EC{i + 1}:', ec{i + 1}) AS dst, count(*) AS n FROM v GROUP BY 1, 2" for i in (1, 2, 3))


@query(sql(FLOW, "labels_long", v=LEVELS))
def sankey_edges(spark, d):
    return labels.flow_edges(leveled(spark, d))


@query(sql("SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM f UNION SELECT dst FROM f)", "labels_long", v=LEVELS, f=FLOW))
def node_index(spark, d):
    return labels.node_index(labels.flow_edges(leveled(spark, d)))


@query(sql("SELECT label, row_number() OVER (ORDER BY CASE WHEN label = 'NA' THEN 2 WHEN try_cast(label AS DOUBLE) IS NOT NULL THEN 0 ELSE 1 END, try_cast(label AS DOUBLE), label)::INT AS rank FROM (SELECT DISTINCT ec2 AS label FROM v UNION SELECT 'NA' UNION SELECT DISTINCT r_name FROM region)", "labels_long", v=LEVELS))
def natural_sort_rank(spark, d):
    from pyspark.sql import Window

    names = leveled(spark, d).select(F.col("ec2").alias("label")).union(spark.sql("SELECT 'NA' AS label")).union(view(spark, d, "region").select("r_name")).distinct()
    return names.select("label", F.row_number().over(Window.orderBy(*codes.natural_order(F.col("label")))).alias("rank"))


@query(sql("SELECT ec_full AS ec, count(*) AS n FROM labels_long GROUP BY 1 ORDER BY n DESC, ec LIMIT 25", "labels_long"))
def topn_classes(spark, d):
    return splits.top_classes(members(spark, d), 25)


def members(spark, d):
    return view(spark, d, "labels_long").select("accession", F.col("ec_full").alias("ec"))


def turn(*keys):
    return f"md5(concat_ws('|', '{SEED}', {', '.join(keys)}))"


@query(sql(f"SELECT ec_full AS ec, accession FROM (SELECT *, row_number() OVER (PARTITION BY ec_full ORDER BY {turn('ec_full', 'accession')}, accession) AS r FROM labels_long) WHERE r <= 3", "labels_long"))
def cap_per_class(spark, d):
    return splits.cap_members(members(spark, d), 3, SEED).select("ec", "accession")


RANKED = f"SELECT ec, row_number() OVER (ORDER BY {turn('ec')}, ec) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ec_full AS ec FROM labels_long {{where}})"


@query(sql("SELECT ec, CASE WHEN i < round_even(0.8 * n, 0) THEN 'train' WHEN i < round_even(0.8 * n, 0) + greatest(1, round_even(0.1 * n, 0)) THEN 'val' ELSE 'test' END AS split FROM r", "labels_long", r=RANKED.format(where="")))
def class_split_80_10_10(spark, d):
    return splits.class_split(members(spark, d), SEED)


@query(sql("SELECT ec, CASE WHEN i < greatest(1, round_even(0.1 * n, 0)) THEN 'val' ELSE 'train' END AS split FROM r", "labels_long", r=RANKED.format(where="")))
def class_split_90_10(spark, d):
    return splits.train_val_split(members(spark, d), SEED)


@query(
    sql(
        "SELECT ec, CASE WHEN i < round_even(0.8 * n, 0) THEN 'train' WHEN i < round_even(0.8 * n, 0) + greatest(1, round_even(0.1 * n, 0)) THEN 'val' ELSE 'test' END AS split FROM r"
        " UNION ALL SELECT ec_full, 'test' FROM labels_long GROUP BY 1 HAVING count(*) < 15",
        "labels_long",
        r=RANKED.format(where="WHERE ec_full IN (SELECT ec_full FROM labels_long GROUP BY 1 HAVING count(*) >= 15)"),
    )
)
def small_class_holdout(spark, d):
    return splits.holdout_split(members(spark, d), 15, SEED)


def top_up_input(spark, d):
    e = view(spark, d, "entries").select("accession", "source")
    all_ = members(spark, d).join(e, "accession")
    own, pool = all_.where("source = 'SwissProt'"), all_.where("source = 'TrEMBL'")
    return own, pool, own.groupBy("ec").agg(F.count_distinct("accession").alias("n"))


TOP_UP = {
    "a": "SELECT l.accession, l.ec_full AS ec, e.source FROM labels_long l JOIN entries e USING (accession)",
    "c": "SELECT ec, count(DISTINCT accession) AS n FROM a WHERE source = 'SwissProt' GROUP BY 1",
}
#: Classes choose in turn, as steps of a recursion that carries what is taken.
CHOICES = TOP_UP | {
    "cand": "SELECT c.ec, least(20 - any_value(n), 5) AS need, list(DISTINCT accession ORDER BY accession) AS v, row_number() OVER (ORDER BY any_value(n), c.ec) AS i FROM c JOIN a ON a.ec = c.ec AND a.source = 'TrEMBL' WHERE n < 20 AND accession NOT IN (SELECT accession FROM a WHERE source = 'SwissProt') GROUP BY c.ec",
    "st": "SELECT 0::BIGINT AS i, NULL::VARCHAR AS ec, []::VARCHAR[] AS mine, []::VARCHAR[] AS taken"
    " UNION ALL SELECT i, ec, m, list_concat(taken, m) FROM (SELECT cand.i, cand.ec, st.taken, list_slice(list_filter(cand.v, lambda x: NOT list_contains(st.taken, x)), 1, cand.need) AS m FROM st JOIN cand ON cand.i = st.i + 1)",
}


@query(sql("SELECT ec, unnest(mine) AS accession FROM st", "labels_long", "entries", **CHOICES))
def topup_selection(spark, d):
    own, pool, counts = top_up_input(spark, d)
    return splits.top_up(counts, pool, own.select("accession"), target=20, cap=5)


@query(sql("SELECT count(*) AS classes, count(*) FILTER (n < 20) AS below, coalesce(sum(greatest(20 - n, 0)), 0)::BIGINT AS missing FROM c", "labels_long", "entries", **TOP_UP))
def topup_summary(spark, d):
    return splits.deficits(top_up_input(spark, d)[2], 20)


@query(
    sql(
        "SELECT ec, accession, false AS added FROM a WHERE source = 'SwissProt' UNION ALL SELECT ec, accession, true FROM"
        " (SELECT a.ec, a.accession, c.n, row_number() OVER (PARTITION BY a.ec ORDER BY a.accession) AS r FROM a JOIN c USING (ec) WHERE source = 'TrEMBL') WHERE r <= 20 - n",
        "labels_long",
        "entries",
        **TOP_UP,
    )
)
def augment_train(spark, d):
    own, pool, _ = top_up_input(spark, d)
    return splits.fill_train(own.select("ec", "accession"), pool, 20)


SHINGLES = {
    "w": "SELECT doc_id, string_split(text, ' ') AS w FROM documents",
    "g": "SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM w WHERE len(w) >= 3",
    "eq": "SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS class FROM (SELECT doc_id, count(*) AS n, string_agg(s, ' ' ORDER BY s) AS key FROM g GROUP BY 1)",
    "k": "SELECT g.doc_id, s FROM g JOIN eq USING (doc_id) WHERE g.doc_id = class",
    "p": "SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS c FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2",
    "e": "SELECT src, dst, round(c / (x.n + y.n - c), 6) AS similarity FROM p JOIN eq x ON x.doc_id = src JOIN eq y ON y.doc_id = dst WHERE c >= 0.5 * (x.n + y.n - c) UNION ALL SELECT class, doc_id, 1.0 FROM eq WHERE doc_id <> class",
}


def edges(spark, d, connecting=False):
    return splits.shingle_edges(view(spark, d, "documents"), 0.5, connecting=connecting)


@query(sql("SELECT src, dst, similarity FROM e", **SHINGLES))
def identity_edges(spark, d):
    return edges(spark, d)


COMPONENTS = SHINGLES | {
    "bi": "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e",
    "reach": "SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT reach.node, bi.b FROM reach JOIN bi ON bi.a = reach.r",
    "cl": "SELECT node, min(r) AS cluster_id FROM reach GROUP BY 1",
}


def doc_clusters(spark, d):
    return written(graph.clusters(view(spark, d, "documents").select(F.col("doc_id").alias("node")), edges(spark, d, True)), "clusters")


@query(sql("SELECT node, cluster_id FROM cl", **COMPONENTS))
def identity_components(spark, d):
    return doc_clusters(spark, d)


@query(sql("SELECT size, count(*) AS n_clusters FROM (SELECT cluster_id, count(*) AS size FROM cl GROUP BY 1) GROUP BY 1", **COMPONENTS))
def cluster_sizes(spark, d):
    return doc_clusters(spark, d).groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


def doc_labels(spark, d):
    return view(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("lang").alias("label"))


@query(sql("SELECT cluster_id, lang AS label, count(*) AS n FROM cl JOIN documents ON doc_id = node GROUP BY 1, 2", **COMPONENTS))
def cluster_histogram(spark, d):
    return splits.cluster_labels(doc_clusters(spark, d), doc_labels(spark, d))


#: Classes of equal shingles in order, each a representative or with the first one that it is similar to, as steps of a recursion.
GREEDY = SHINGLES | {
    "ce": "SELECT src, dst FROM p JOIN eq x ON x.doc_id = src JOIN eq y ON y.doc_id = dst WHERE c >= 0.5 * (x.n + y.n - c)",
    "nb": "SELECT a, list(b) AS near FROM (SELECT src AS a, dst AS b FROM ce UNION ALL SELECT dst, src FROM ce) GROUP BY 1",
    "ord": "SELECT class, coalesce(near, []) AS near, row_number() OVER (ORDER BY n DESC, class) AS i FROM (SELECT class, n FROM eq WHERE doc_id = class) LEFT JOIN nb ON a = class",
    "st": "SELECT 0::BIGINT AS i, NULL::BIGINT AS class, NULL::BIGINT AS rep, []::BIGINT[] AS reps"
    " UNION ALL SELECT i, class, coalesce(r, class), CASE WHEN r IS NULL THEN list_append(reps, class) ELSE reps END FROM (SELECT ord.i, ord.class, st.reps, list_filter(st.reps, lambda y: list_contains(ord.near, y))[1] AS r FROM st JOIN ord ON ord.i = st.i + 1)",
}


@query(sql("SELECT DISTINCT d.doc_id, coalesce(rep, d.doc_id) AS representative FROM documents d LEFT JOIN eq ON eq.doc_id = d.doc_id LEFT JOIN st ON st.class = eq.class", **GREEDY))
def identity_representatives(spark, d):
    """Greedy clusters of documents: the longest first, each with those that are similar to it and to no earlier representative."""
    return splits.shingle_representatives(view(spark, d, "documents"), 0.5)


@query(sql("SELECT cluster_id, how, label, count(*) AS n FROM (SELECT cluster_id, 'top' AS how, string_split(ec_full, '.')[1] AS label FROM lc UNION ALL SELECT cluster_id, 'full', ec_full FROM lc UNION ALL SELECT cluster_id, 'none', 'all' FROM lc) GROUP BY 1, 2, 3", "labels_long", "entries", lc=f"SELECT ec_full, cluster_id FROM labels_long JOIN ({CLUSTERS}) USING (accession)"))
def stratified_histogram(spark, d):
    placed = view(spark, d, "labels_long").join(cluster_lookup(spark, d), "accession")
    each = F.array(*[F.struct(F.lit(how).alias("how"), splits.stratum(F.col("ec_full"), how).alias("label")) for how in ("top", "full", "none")])
    return placed.select("cluster_id", F.inline(each)).groupBy("cluster_id", "how", "label").agg(F.count("*").alias("n"))


def doc_folds(spark, d, n=3):
    clusters = doc_clusters(spark, d)
    return clusters, written(splits.assign_folds(splits.cluster_labels(clusters, doc_labels(spark, d)), n), "folds")


#: Folds in SQL: clusters in order, each going where it costs least, as steps of a recursion that carries the folds' counts.
FOLDS = COMPONENTS | {
    "hist": "SELECT cluster_id, lang AS label, count(*) AS n FROM cl JOIN documents ON doc_id = node GROUP BY 1, 2",
    "tg": "SELECT list(t ORDER BY label) AS t, list(label ORDER BY label) AS l, sum(t) AS goal FROM (SELECT label, sum(n) / 3.0::DOUBLE AS t FROM hist GROUP BY 1)",
    "cv": "SELECT c.cluster_id, list(coalesce(n, 0)::DOUBLE ORDER BY c.label) AS v, sum(n)::DOUBLE AS size FROM (SELECT cluster_id, label FROM (SELECT DISTINCT cluster_id FROM hist), (SELECT DISTINCT label FROM hist)) c LEFT JOIN hist USING (cluster_id, label) GROUP BY 1",
    "o": "SELECT *, row_number() OVER (ORDER BY size DESC, cluster_id) - 1 AS i FROM cv",
    "st": "SELECT -1::BIGINT AS i, NULL::BIGINT AS cluster_id, NULL::INT AS fold, list_transform([1, 2, 3], lambda f: list_transform(l, lambda x: 0.0::DOUBLE)) AS h, [0.0, 0.0, 0.0]::DOUBLE[] AS s FROM tg"
    " UNION ALL SELECT i, cluster_id, p - 1, list_transform([1, 2, 3], lambda f: CASE WHEN f = p THEN list_transform(list_zip(h[f], v), lambda z: z[1] + z[2]) ELSE h[f] END), list_transform([1, 2, 3], lambda f: s[f] + CASE WHEN f = p THEN size ELSE 0 END)"
    " FROM (SELECT o.i, o.cluster_id, o.v, o.size, st.h, st.s, CASE WHEN o.i < 3 THEN (o.i + 1)::INT ELSE list_sort(list_transform([1, 2, 3], lambda f: {'c': round(list_sum(list_transform(list_zip(st.h[f], o.v, tg.t), lambda z: CASE WHEN z[1] > 0 OR z[2] > 0 THEN (z[1] + z[2] - z[3]) * (z[1] + z[2] - z[3]) ELSE 0 END))"
    " + (st.s[f] + o.size - tg.goal) * (st.s[f] + o.size - tg.goal), 6), 's': st.s[f], 'f': f}))[1].f::INT END AS p FROM st JOIN o ON o.i = st.i + 1, tg)",
}
PLACED = FOLDS | {
    "pl": "SELECT doc_id AS accession, concat_ws('.', lang, source) AS ec, fold FROM documents JOIN cl ON node = doc_id JOIN st ON st.cluster_id = cl.cluster_id",
    "rs": "SELECT f, ec, accession FROM pl, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f",
    "ks": f"SELECT f, ec, row_number() OVER (PARTITION BY f ORDER BY {turn('ec')}, ec) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM (SELECT f, ec FROM rs GROUP BY 1, 2 HAVING count(*) >= 3)",
}


@query(sql("SELECT cluster_id, fold FROM st WHERE i >= 0", **FOLDS))
def fold_assignment(spark, d):
    return doc_folds(spark, d)[1]


@query(sql("SELECT f::INT AS fold, CASE WHEN i < CASE WHEN n < 2 THEN 0 ELSE greatest(1, round_even(0.1 * n, 0)) END THEN 'val' ELSE 'train' END AS split, ec, accession FROM rs JOIN ks USING (f, ec) UNION ALL SELECT fold, 'test', ec, accession FROM pl", **PLACED))
def fold_splits(spark, d):
    clusters, folds = doc_folds(spark, d)
    m = view(spark, d, "documents").select(F.col("doc_id").alias("accession"), F.concat_ws(".", "lang", "source").alias("ec"))
    each = [splits.fold_members(m, clusters, folds, fold=i, n_folds=3, least=3, seed=SEED).select(F.lit(i).alias("fold"), "split", "ec", "accession") for i in range(3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    sql(
        "SELECT fold, count(*) AS n_clusters_test, sum(k)::BIGINT AS n_seqs_test, (sum(count(*)) OVER () - count(*))::BIGINT AS n_clusters_train, (sum(sum(k)) OVER () - sum(k))::BIGINT AS n_seqs_train"
        " FROM (SELECT cluster_id, count(*) AS k FROM cl GROUP BY 1) JOIN st USING (cluster_id) GROUP BY 1",
        **FOLDS,
    )
)
def fold_counts(spark, d):
    clusters, folds = doc_folds(spark, d)
    return splits.fold_counts(clusters, folds, 3)


@query(sql("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"))
def last_wins_dedup(spark, d):
    return labels.last_wins(view(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query(sql("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"))
def first_wins_dedup(spark, d):
    return labels.first_wins(view(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query(sql("SELECT accession FROM (SELECT accession FROM vec_labels WHERE split = 'train' UNION SELECT accession FROM vec_labels WHERE split = 'val' UNION SELECT accession FROM vec_labels WHERE split = 'test')", "vectors", "vec_labels"))
def split_universe(spark, d):
    v = view(spark, d, "vec_labels")
    parts = [v.where(F.col("split") == s).select("accession") for s in ("train", "val", "test")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()
