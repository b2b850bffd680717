"""Queries on episodes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import episodes
from ..session import written
from ..sources.fixtures import sql, view
from .registry import query
from .scoring import MACRO, MICRO, PROTO, UNIT, V

SEED, N, M, K, Q = 7, 20, 4, 3, 5
LONG = {"mem": "SELECT DISTINCT ec, accession FROM vec_labels WHERE split = 'test'"}
CL = {"cl": "SELECT accession, CASE WHEN vec_id % 4 <> 1 THEN concat('K', vec_id % 35) END AS cluster_id FROM vectors"}


def members(spark, d):
    return view(spark, d, "vec_labels").where("split = 'test'").select("ec", "accession").distinct()


def clusters(spark, d):
    return view(spark, d, "vectors").where("vec_id % 4 <> 1").select("accession", F.concat(F.lit("K"), F.col("vec_id") % 35).alias("cluster_id"))


def tick(*keys):
    return f"md5(concat_ws('|', '{SEED}', {', '.join(keys)}))"


def uni(*keys):
    return f"(('0x' || substr({tick(*keys)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


CHOSEN = LONG | {
    "sz": "SELECT ec, count(DISTINCT accession) AS n FROM mem GROUP BY 1",
    "ch": f"SELECT episode, ec, slot, n FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS c FROM (SELECT *, (row_number() OVER (PARTITION BY episode ORDER BY tier, round(-ln(1 - {uni(chr(39) + 'class' + chr(39), 'episode', 'ec')}) * ln(1 + n), 9), ec) - 1)::INT AS slot"
    f" FROM (SELECT *, CASE WHEN n >= {K + Q} THEN 0 ELSE 1 END AS tier FROM (SELECT unnest(range({N})) AS episode) CROSS JOIN sz WHERE n >= {K})) WHERE slot < {M}) WHERE c = {M}",
}


def chosen(spark, d):
    return written(episodes.pick_classes(members(spark, d), N, M, K, Q, SEED), "episode-classes")


@query(sql("SELECT * FROM ch", *V, **CHOSEN))
def episode_classes(spark, d):
    return episodes.pick_classes(members(spark, d), N, M, K, Q, SEED)


MANY = {
    "sz": "SELECT ec_full AS ec, count(DISTINCT accession) AS n FROM labels_long GROUP BY 1 HAVING count(DISTINCT accession) >= 2",
    "cu": "SELECT ec, n, sum(w) OVER (ORDER BY ec ROWS UNBOUNDED PRECEDING)::BIGINT AS high, w FROM (SELECT *, greatest(round(1000000 / ln(1 + n))::BIGINT, 1) AS w FROM sz)",
    "dr": f"SELECT episode, i, floor({uni(chr(39) + 'draw' + chr(39), 'episode', 'i')} * (SELECT max(high) FROM cu))::BIGINT AS x FROM (SELECT unnest(range(50)) AS episode), (SELECT unnest(range(400)) AS i)",
    "fi": "SELECT episode, ec, n, min(i) AS i FROM dr JOIN cu ON x >= high - w AND x < high GROUP BY 1, 2, 3",
}


@query(sql("SELECT episode, ec, (row_number() OVER (PARTITION BY episode ORDER BY i) - 1)::INT AS slot, n FROM fi QUALIFY slot < 6", "labels_long", **MANY))
def episode_classes_drawn(spark, d):
    """Episodes among many classes: what is drawn by cumulative weights is all that is joined."""
    rows = view(spark, d, "labels_long").select(F.col("ec_full").alias("ec"), "accession")
    return episodes.pick_classes(rows, 50, 6, 2, 0, SEED)


def drawn(most, source="ch", size="n"):
    """Places drawn by Floyd's sampling, and their seeded order, in SQL."""
    steps = f"list_transform(range({size} - least({size}, {most}), {size}), lambda j: [floor({uni(chr(39) + 'place' + chr(39), 'episode', 'ec', 'j')} * (j + 1))::BIGINT, j])"
    places = f"list_reduce(list_prepend([]::BIGINT[], {steps}), lambda a, x: list_append(a, CASE WHEN list_contains(a, x[1]) THEN x[2] ELSE x[1] END))"
    return f"SELECT episode, ec, slot, p, row_number() OVER (PARTITION BY episode, ec ORDER BY {tick(chr(39) + 'turn' + chr(39), 'episode', 'ec', 'p')}, p) - 1 AS i FROM (SELECT episode, ec, slot, unnest({places}) AS p FROM {source})"


MEMBER = "'member'"
STANDARD = CHOSEN | {
    "nm": "SELECT ec, accession, row_number() OVER (PARTITION BY ec ORDER BY accession) - 1 AS p FROM mem",
    "dw": drawn(K + Q),
    "sm": f"SELECT episode, ec, slot, CASE WHEN i < {K} THEN 'support' ELSE 'query' END AS role, accession FROM dw JOIN nm USING (ec, p)",
}


def samples(spark, d):
    return written(episodes.standard(chosen(spark, d), members(spark, d), K, Q, SEED), "episode-samples")


@query(sql("SELECT * FROM sm", *V, **STANDARD))
def episode_samples(spark, d):
    return samples(spark, d)


@query(
    sql(
        "SELECT episode, ec, slot, CASE WHEN i < 2 THEN 'support' ELSE 'query' END AS role, accession, cluster_id FROM (SELECT dw.*, cluster_id, floor("
        f"{uni(MEMBER, 'episode', 'ec', 'cluster_id')} * size)::BIGINT AS m FROM dw JOIN gr USING (ec, p)) JOIN nc USING (ec, cluster_id, m)",
        *V,
        **CHOSEN,
        **CL,
        pl="SELECT DISTINCT ec, accession, coalesce(cluster_id, concat('_na_', accession)) AS cluster_id FROM mem JOIN cl USING (accession)",
        nc="SELECT *, row_number() OVER (PARTITION BY ec, cluster_id ORDER BY accession) - 1 AS m FROM pl",
        gr="SELECT ec, cluster_id, count(*) AS size, row_number() OVER (PARTITION BY ec ORDER BY cluster_id) - 1 AS p FROM pl GROUP BY 1, 2",
        ab="SELECT ch.*, c FROM ch JOIN (SELECT ec, count(*) AS c FROM gr GROUP BY 1) USING (ec) WHERE c >= 5",
        dw=drawn(5, "ab", "c"),
    )
)
def episode_disjoint(spark, d):
    return episodes.disjoint(chosen(spark, d), members(spark, d), clusters(spark, d), 2, 3, SEED)


REPEATS = CHOSEN | {
    "nm": STANDARD["nm"],
    "dw": drawn(24),
    "pool": "SELECT episode, ec, i, accession FROM dw JOIN nm USING (ec, p)",
    "dr": f"SELECT ch.*, draw, CASE WHEN draw < n THEN draw ELSE floor({uni(chr(39) + 'repeat' + chr(39), 'episode', 'ec', 'draw')} * least(n, 24))::INT END AS i FROM ch CROSS JOIN (SELECT unnest(range(24))::INT AS draw)",
    "wr": "SELECT episode, ec, slot, draw, CASE WHEN draw < 12 THEN 'support' ELSE 'query' END AS role, accession, row_number() OVER (PARTITION BY episode, accession ORDER BY slot, draw)::INT AS occurrence FROM dr JOIN pool USING (episode, ec, i)",
}


@query(sql("SELECT * FROM wr", *V, **REPEATS))
def episode_fallback(spark, d):
    return episodes.with_repeats(chosen(spark, d), members(spark, d), 12, 12, SEED)


@query(sql("SELECT q.episode, q.accession, c.slot, c.ec, (mem.ec IS NOT NULL)::INT AS label FROM (SELECT DISTINCT episode, accession FROM sm WHERE role = 'query') q JOIN (SELECT DISTINCT episode, slot, ec FROM sm) c USING (episode) LEFT JOIN mem ON mem.ec = c.ec AND mem.accession = q.accession", *V, **STANDARD))
def episode_multihot(spark, d):
    return episodes.multi_hot(samples(spark, d), members(spark, d))


@query(sql("SELECT count(*) AS total, count(*) FILTER (c >= 2 AND n >= 10) AS full, count(*) FILTER (c >= 2 AND n BETWEEN 5 AND 9) AS tail, count(*) FILTER (c < 2 OR n < 5) AS excluded FROM (SELECT ec, count(DISTINCT accession) AS n, count(DISTINCT coalesce(cluster_id, concat('_na_', accession))) AS c FROM mem JOIN cl USING (accession) GROUP BY 1)", *V, **LONG, **CL))
def class_coverage(spark, d):
    return episodes.coverage(members(spark, d), 5, 5, clusters(spark, d))


@query(
    sql(
        "SELECT m.ec, coalesce(s, 0) AS support_count, coalesce(q, 0) AS query_count, coalesce(f, 0) AS fallback_episodes FROM (SELECT DISTINCT ec FROM vec_labels) m"
        " LEFT JOIN (SELECT ec, count(*) FILTER (role = 'support') AS s, count(*) FILTER (role = 'query') AS q FROM wr GROUP BY 1) USING (ec)"
        " LEFT JOIN (SELECT ec, count(*) AS f FROM (SELECT ec, episode, count(DISTINCT accession) AS d FROM wr GROUP BY 1, 2) WHERE d < 24 GROUP BY 1) USING (ec)",
        *V,
        **REPEATS,
    )
)
def sampler_usage(spark, d):
    return episodes.usage(view(spark, d, "vec_labels"), episode_fallback(spark, d), 12, 12)


@query(sql("SELECT episode, count(*) FILTER (a.role = 'support' AND b.role = 'query') AS shared FROM sm a JOIN sm b USING (episode, ec, accession) GROUP BY 1", *V, **STANDARD))
def support_query_overlap(spark, d):
    s = samples(spark, d)
    both = s.where("role = 'support'").select("episode", "ec", "accession").intersect(s.where("role = 'query'").select("episode", "ec", "accession"))
    return s.select("episode").distinct().join(both, "episode", "left").groupBy("episode").agg(F.count("accession").alias("shared"))


SCORES = STANDARD | {
    "u": f"SELECT accession, {UNIT.format(v='vec')} AS v FROM vectors",
    "pm": "SELECT episode, slot, ec, pos, avg(v[pos]) AS x FROM (SELECT sm.*, u.v, unnest(range(1, 65)) AS pos FROM sm JOIN u USING (accession) WHERE role = 'support') GROUP BY ALL",
    "pr": f"SELECT episode, slot, ec, {UNIT.format(v='w')} AS p FROM (SELECT episode, slot, ec, list(x ORDER BY pos) AS w FROM pm GROUP BY 1, 2, 3)",
    "es": "SELECT q.episode, q.accession, q.slot AS own, pr.slot, pr.ec, list_sum(list_transform(list_zip(u.v, pr.p), lambda z: z[1] * z[2])) / 0.1 AS logit, (mem.ec IS NOT NULL)::INT AS label FROM (SELECT * FROM sm WHERE role = 'query') q JOIN u USING (accession) JOIN pr ON pr.episode = q.episode LEFT JOIN mem ON mem.ec = pr.ec AND mem.accession = q.accession",
}


def scores(spark, d):
    return episodes.episode_scores(samples(spark, d), view(spark, d, "vectors"), members(spark, d), 0.1)


@query(
    sql(
        "SELECT count(*) AS queries, round(avg(ok), 6) AS accuracy, round(avg(ce), 6) AS cross_entropy, round(avg(bce), 6) AS bce FROM (SELECT episode, accession, own, max((r = 1 AND slot = own)::INT)::DOUBLE AS ok,"
        " ln(sum(exp(logit))) - max(logit) FILTER (slot = own) AS ce, avg(-CASE WHEN label = 1 THEN ln(1 / (1 + exp(-logit))) ELSE ln(1 - 1 / (1 + exp(-logit))) END) AS bce"
        " FROM (SELECT *, row_number() OVER (PARTITION BY episode, accession, own ORDER BY logit DESC, slot) AS r FROM es) GROUP BY 1, 2, 3)",
        *V,
        **SCORES,
    )
)
def episodic_metrics(spark, d):
    return episodes.episode_metrics(scores(spark, d))


HIERARCHY = {
    "hc": "SELECT ec, concat(n % 2 + 1, '.', n % 3, '.', n, '.1') AS code FROM (SELECT DISTINCT ec, substr(ec, 2)::INT AS n FROM mem)",
    "hl": "SELECT ec, lv::INT AS level, array_to_string(string_split(code, '.')[1:lv], '.') AS coarse FROM hc CROSS JOIN (SELECT unnest(range(1, 4)) AS lv)",
    "hs": "SELECT sm.episode, role, slot, accession, level, coarse FROM sm JOIN hl USING (ec)",
    "hg": "SELECT episode, level FROM hs GROUP BY 1, 2 HAVING count(DISTINCT coarse) >= 2",
    "hm": "SELECT episode, level, coarse, pos, avg(v[pos]) AS x FROM (SELECT episode, level, coarse, v, unnest(range(1, 65)) AS pos FROM hs JOIN hg USING (episode, level) JOIN u USING (accession) WHERE role = 'support') GROUP BY 1, 2, 3, 4",
    "hp": f"SELECT episode, level, coarse, {UNIT.format(v='w')} AS p FROM (SELECT episode, level, coarse, list(x ORDER BY pos) AS w FROM hm GROUP BY 1, 2, 3)",
    "hz": "SELECT q.episode, q.level, q.accession, q.slot, q.coarse AS own, hp.coarse, list_sum(list_transform(list_zip(u.v, hp.p), lambda z: z[1] * z[2])) / 0.1 AS z FROM (SELECT * FROM hs WHERE role = 'query') q JOIN u USING (accession) JOIN hp ON hp.episode = q.episode AND hp.level = q.level",
    "hy": "SELECT DISTINCT c.episode, level, coarse, accession FROM (SELECT DISTINCT episode, ec FROM sm) c JOIN hl USING (ec) JOIN mem USING (ec)",
}


def codes(spark, d):
    n = F.substring("ec", 2, 9).cast("int")
    return members(spark, d).select("ec").distinct().select("ec", F.concat_ws(".", n % 2 + 1, n % 3, n, F.lit("1")).alias("code"))


@query(
    sql(
        "SELECT episode, round(coalesce(loss, 0), 6) AS loss FROM (SELECT DISTINCT episode FROM sm) LEFT JOIN (SELECT episode, sum(c) * 0.5 / 3 AS loss FROM"
        " (SELECT episode, level, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS c FROM (SELECT hz.*, (hy.accession IS NOT NULL)::INT AS y FROM hz LEFT JOIN hy USING (episode, level, coarse, accession)) GROUP BY 1, 2) GROUP BY 1) USING (episode)",
        *V,
        **SCORES,
        **HIERARCHY,
    )
)
def hierarchy_loss(spark, d):
    return episodes.hierarchy_loss(samples(spark, d), view(spark, d, "vectors"), members(spark, d), codes(spark, d)).withColumn("loss", F.round("loss", 6))


@query(
    sql(
        "SELECT episode, round(coalesce(loss, 0), 6) AS loss FROM (SELECT DISTINCT episode FROM sm) LEFT JOIN (SELECT episode, sum(c) * 0.5 / 2 AS loss FROM"
        " (SELECT episode, level, avg(c) AS c FROM (SELECT episode, level, accession, slot, ln(sum(exp(z))) - max(z) FILTER (coarse = own) AS c FROM hz WHERE level < 3 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY 1) USING (episode)",
        *V,
        **SCORES,
        **HIERARCHY,
    )
)
def hierarchy_loss_single(spark, d):
    return episodes.hierarchy_loss(samples(spark, d), view(spark, d, "vectors"), members(spark, d), codes(spark, d), levels=2, multi=False).withColumn("loss", F.round("loss", 6))


@query(sql("SELECT count(*) AS queries, coalesce(round(avg(label::DOUBLE), 6), 0) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY episode, accession, own ORDER BY logit DESC, slot) AS r FROM es) WHERE r = 1", *V, **SCORES))
def validation_accuracy(spark, d):
    return episodes.validation_accuracy(scores(spark, d))


def per_k(k):
    """The scores' common table expressions for K support members, under names of their own."""
    own = {n: t for n, t in SCORES.items() if n not in ("mem", "u")}
    own["ch"] = own["ch"].replace(f"n >= {K + Q}", f"n >= {k + Q}").replace(f"n >= {K})", f"n >= {k})")
    own["dw"] = drawn(k + Q)
    own["sm"] = own["sm"].replace(f"i < {K} ", f"i < {k} ")
    return {f"{n}_{k}": re.sub(rf"\b({'|'.join(own)})\b(?!\()", rf"\1_{k}", t) for n, t in own.items()}


def evaluated(k):
    hit = "prob >= CASE ec WHEN 'L1' THEN 0.9 ELSE 0.6 END"
    return {
        f"ej_{k}": f"SELECT *, ({hit}) OR (rank = 1 AND NOT bool_or({hit}) OVER (PARTITION BY episode, accession, own)) AS h, label = 1 AS t FROM (SELECT *, 1 / (1 + exp(-logit)) AS prob, row_number() OVER (PARTITION BY episode, accession, own ORDER BY logit DESC, slot) AS rank FROM es_{k})",
        f"ec_{k}": f"SELECT slot, count(*) FILTER (h AND t) AS tp, count(*) FILTER (h AND NOT t) AS fp, count(*) FILTER (NOT h AND t) AS fn FROM ej_{k} GROUP BY 1",
        f"eq_{k}": f"SELECT count(*) FILTER (t) AS t, count(*) FILTER (h) AS p, count(*) FILTER (t AND h) AS i FROM ej_{k} GROUP BY episode, accession, own",
    }


def evaluation_sql(k):
    return f"SELECT {k} AS k, (SELECT round(avg(t::INT), 6) FROM ej_{k} WHERE rank = 1) AS acc_top1_hit, {MICRO}, {MACRO}, (SELECT round(avg((i = t + p - i AND t + p - i > 0)::INT), 6) FROM eq_{k}) AS subset_accuracy, (SELECT round(avg(i / greatest(t + p - i, 1)), 6) FROM eq_{k}) AS jaccard, (SELECT round(avg(abs(p - t)), 6) FROM eq_{k}) AS card_mae FROM ec_{k}"


@query(sql(f"{evaluation_sql(1)} UNION ALL {evaluation_sql(3)}", *V, mem=LONG["mem"], u=SCORES["u"], sz=SCORES["sz"], **per_k(1), **per_k(3), **evaluated(1), **evaluated(3)))
def episodic_eval_per_k(spark, d):
    over = spark.createDataFrame([("L1", 0.9)], "ec string, tau double")
    parts = []
    for k in (1, 3):
        drawn = written(episodes.pick_classes(members(spark, d), N, M, k, Q, SEED), "episode-classes")
        own = written(episodes.standard(drawn, members(spark, d), k, Q, SEED), "episode-samples")
        found = episodes.evaluation(episodes.episode_scores(own, view(spark, d, "vectors"), members(spark, d), 0.1), 0.6, over)
        names = ("acc_top1_hit", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "subset_accuracy", "jaccard", "card_mae")
        parts.append(found.select(F.lit(k).alias("k"), *names))
    return parts[0].unionByName(parts[1])


@query()
def best_versus_last(spark, d):
    """Two projections (the first eight numbers of a vector, and the next eight) on the same episodes."""
    drawn = samples(spark, d)
    one = lambda at: view(spark, d, "vectors").select("accession", F.slice("vec", at, 8).alias("vec"))
    own = lambda at: episodes.episode_scores(drawn, one(at), members(spark, d), 0.1)
    return episodes.best_or_last(own(1), own(9))


def redrawn(spark, d):
    """Half of the classes have members of a few clusters only."""
    few = view(spark, d, "vectors").select("accession", F.when(F.col("label") < 5, F.concat(F.lit("K"), F.col("vec_id") % 3)).alias("cluster_id"))
    return episodes.redrawn(members(spark, d), few.where("cluster_id is not null"), N, 3, 2, 4, SEED)


@query()
def episode_redraws(spark, d):
    return redrawn(spark, d)[0]


@query()
def episode_shortages(spark, d):
    own, short = redrawn(spark, d)
    return episodes.shortage_report(own, short)


@query(sql("SELECT ec, c AS clusters FROM (SELECT ec, count(DISTINCT coalesce(cluster_id, concat('_na_', accession))) AS c FROM (SELECT ec, accession FROM mem UNION ALL SELECT concat('S', vec_id % 3), 'V1' FROM vectors WHERE vec_id < 9) LEFT JOIN cl USING (accession) GROUP BY 1) WHERE c < 2", *V, **LONG, **CL))
def single_cluster_classes(spark, d):
    alone = view(spark, d, "vectors").where("vec_id < 9").select(F.concat(F.lit("S"), F.col("vec_id") % 3).alias("ec"), F.lit("V1").alias("accession"))
    return episodes.single_cluster_classes(members(spark, d).unionByName(alone), clusters(spark, d))
