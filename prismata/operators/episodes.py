"""Few-shot episodes as pure functions of (seed, episode): no state is kept, and any episode can be drawn again.

members: ec, accession. An episode has M classes with K support and Q query members each.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import ancestor
from ..functions.hashing import ticket, uniform
from ..functions.vectors import class_weight, dot, sigmoid, unit
from ..session import written
from .labels import numbered, ranged
from .scoring import mean_vectors, micro_macro, per_class, projected, set_metrics, top1_rate


def episodes(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "episode")


#: Up to so many times as many classes as are drawn, all of them are given keys; of more, classes are drawn by their weights.
FEW = 4
#: Weights are whole numbers of this part.
PART = 1_000_000


def keyed_classes(each: DataFrame, classes: DataFrame, take: int, seed, boost: bool) -> DataFrame:
    """episode, ec, n, turn (from 0): the `take` classes (ec, n; a few) of least exponential keys, for each episode."""
    weight = class_weight(F.col("n")) if boost else F.lit(1.0)
    key = -F.ln(1 - uniform(seed, F.lit("class"), F.col("episode"), F.col("ec"))) / weight
    first = Window.partitionBy("episode").orderBy(F.round(key, 9), "ec")
    rows = each.crossJoin(classes.select("ec", "n"))  # FEW classes for each one that is drawn
    return rows.withColumn("turn", F.row_number().over(first) - 1).where(F.col("turn") < take).select("episode", "ec", "n", "turn")


def drawn_classes(each: DataFrame, classes: DataFrame, take: int, seed, boost: bool) -> DataFrame:
    """The same for many classes: draws with repeats by cumulative weights, of which the first `take` different ones count, which is
    drawing without repeats. Draws look their class up in the cell of the weights that they fall into, and only classes that are drawn are joined."""
    weight = F.greatest(F.round(class_weight(F.col("n")) * PART).cast("bigint"), F.lit(1)) if boost else F.lit(1).cast("bigint")
    rows = written(ranged(classes.select("ec", "n").withColumn("w", weight), "ec", F.col("w"), "high", True), "class-weights")
    total, count = rows.agg(F.sum("w"), F.count("*")).first()
    width = -(-total // count)  # as many cells as classes
    cell = lambda x: F.floor(x / width)
    cells = rows.select("ec", "n", (F.col("high") - F.col("w")).alias("low"), "high")
    cells = written(cells.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1)))), "weight-cells")
    start, size, found, open_ = 0, 2 * take, None, each
    while True:
        draws = open_.withColumn("i", F.explode(F.sequence(F.lit(start), F.lit(start + size - 1))))
        draws = draws.withColumn("x", F.floor(uniform(seed, F.lit("draw"), F.col("episode"), F.col("i")) * total)).withColumn("cell", cell(F.col("x")))
        new = draws.join(cells, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("episode", "i", "ec", "n")
        if found is not None:
            new = new.unionByName(found)
        found = written(new.groupBy("episode", "ec", "n").agg(F.min("i").alias("i")), "drawn-classes")
        # Episodes whose draws gave too few different classes go on with further draws.
        enough = found.groupBy("episode").agg(F.count("*").alias("k")).where(F.col("k") >= take)
        open_ = written(each.join(enough, "episode", "left_anti"), "open-episodes")
        if open_.isEmpty():
            break
        start, size = start + size, 2 * size
    turn = F.row_number().over(Window.partitionBy("episode").orderBy("i")) - 1
    return found.withColumn("turn", turn).where(F.col("turn") < take).select("episode", "ec", "n", "turn")


def pick_classes(members: DataFrame, n_episodes: int, m: int, k: int, q: int, seed: int, boost: bool = True, tail: bool = True, clusters: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """episode, ec, slot (from 0), n: classes of K+Q members or more first, then (with `tail`) those of K or more.
    With `boost` rare classes are likelier: weighted sampling without replacement, by exponential keys of up to few * M classes and by
    draws among more. With clusters (accession, cluster_id), classes of fewer than two clusters are left out. An episode with fewer than M classes is not given.
    """
    sizes = members.groupBy("ec").agg(F.count_distinct("accession").alias("n"))
    if clusters is not None:
        many = members.join(clusters, "accession", "left").groupBy("ec").agg(F.count_distinct(F.coalesce("cluster_id", F.concat(F.lit("_na_"), "accession"))).alias("c"))
        sizes = sizes.join(many.where("c >= 2").select("ec"), "ec", "left_semi")
    able = written(sizes.where(F.col("n") >= (k if tail else k + q)).withColumn("tier", F.when(F.col("n") >= k + q, 0).otherwise(1)), "class-tiers")
    counts = {r.tier: r.n for r in able.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    each = episodes(members.sparkSession, n_episodes if sum(counts.values()) >= m else 0)
    out, have = None, 0
    for tier in sorted(counts):
        take = min(m - have, counts[tier])
        if take > 0:
            choose = keyed_classes if counts[tier] <= few * m else drawn_classes
            part = choose(each, able.where(F.col("tier") == tier), take, seed, boost).select("episode", "ec", (F.col("turn") + have).alias("slot"), "n")
            out, have = part if out is None else out.unionAll(part), have + take
    return out if out is not None else members.sparkSession.createDataFrame([], f"episode bigint, ec {members.schema['ec'].dataType.simpleString()}, slot int, n bigint")


def places(size, take, draw):
    """`take` different whole numbers below `size`, by Floyd's sampling. draw(j): a number in [0, 1) for each of the steps."""

    def step(got, j):
        t = F.floor(draw(j) * (j + 1))
        return F.concat(got, F.array(F.when(F.array_contains(got, t), j).otherwise(t)))

    return F.aggregate(F.sequence(size - take, size - 1), F.array().cast("array<bigint>"), step)


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows of the keys, numbered (at) in their order over all rows."""
    rows = rows.select(*keys).distinct().withColumn("key", F.struct(*keys))
    return written(numbered(rows, "key", "at").select(*keys, "at"), "places")


def drawn(chosen: DataFrame, items: DataFrame, item: str, most: int, seed) -> DataFrame:
    """episode, ec, slot, i (from 0), item: up to `most` different items (ec, item, at) of each chosen class, in a seeded order.
    Places among a class's items are drawn, and only those are joined, however many items a class has."""
    classes = items.groupBy("ec").agg(F.min("at").alias("top"), F.count("*").alias("size"))
    found = places(F.col("size"), F.least("size", F.lit(most)), lambda j: uniform(seed, F.lit("place"), F.col("episode"), F.col("ec"), j))
    rows = chosen.select("episode", "ec", "slot").join(classes, "ec").select("episode", "ec", "slot", "top", F.explode(found).alias("p"))
    turn = Window.partitionBy("episode", "ec").orderBy(ticket(seed, F.lit("turn"), F.col("episode"), F.col("ec"), F.col("p")), "p")
    rows = rows.select("episode", "ec", "slot", (F.row_number().over(turn) - 1).alias("i"), (F.col("top") + F.col("p")).alias("at"))
    return rows.join(items.select("at", item), "at").select("episode", "ec", "slot", "i", item)


def role(k: int):
    return F.when(F.col("i") < k, "support").otherwise("query").alias("role")


def standard(chosen: DataFrame, members: DataFrame, k: int, q: int, seed: int) -> DataFrame:
    """episode, ec, slot, role, accession: K support and up to Q query members, all distinct."""
    return drawn(chosen, ordered(members, "ec", "accession"), "accession", k + q, seed).select("episode", "ec", "slot", role(k), "accession")


def in_clusters(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """ec, cluster_id, accession; a member of no cluster is one of its own."""
    own = F.coalesce("cluster_id", F.concat(F.lit("_na_"), "accession"))
    return members.join(clusters, "accession", "left").select("ec", own.alias("cluster_id"), "accession")


def disjoint(chosen: DataFrame, members: DataFrame, clusters: DataFrame, k: int, q: int, seed: int) -> DataFrame:
    """Like standard, with one member of each of K+Q different clusters; classes of fewer clusters are not given."""
    placed = ordered(in_clusters(members, clusters), "ec", "cluster_id", "accession")
    groups = ordered(placed, "ec", "cluster_id")
    able = groups.groupBy("ec").agg(F.count("*").alias("c")).where(F.col("c") >= k + q).select("ec")
    rows = drawn(chosen.join(able, "ec", "left_semi"), groups, "cluster_id", k + q, seed)
    rows = rows.join(placed.groupBy("ec", "cluster_id").agg(F.min("at").alias("top"), F.count("*").alias("size")), ["ec", "cluster_id"])
    one = F.floor(uniform(seed, F.lit("member"), F.col("episode"), F.col("ec"), F.col("cluster_id")) * F.col("size"))
    rows = rows.withColumn("at", F.col("top") + one)
    return rows.join(placed.select("at", "accession"), "at").select("episode", "ec", "slot", role(k), "accession", "cluster_id")


def with_repeats(chosen: DataFrame, members: DataFrame, k: int, q: int, seed: int) -> DataFrame:
    """K+Q draws for each class: all members in a seeded order first, then seeded repeats. occurrence counts a member's uses in the
    episode; from the second on a view is to be made of it."""
    pool = drawn(chosen, ordered(members, "ec", "accession"), "accession", k + q, seed)
    draws = chosen.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k + q - 1))))
    span = F.least(F.col("n"), F.lit(k + q))
    again = F.floor(uniform(seed, F.lit("repeat"), F.col("episode"), F.col("ec"), F.col("draw")) * span)
    draws = draws.withColumn("i", F.when(F.col("draw") < F.col("n"), F.col("draw")).otherwise(again).cast("int"))
    rows = draws.join(pool.select("episode", "ec", "i", "accession"), ["episode", "ec", "i"])
    use = Window.partitionBy("episode", "accession").orderBy("slot", "draw")
    return rows.select("episode", "ec", "slot", "draw", F.when(F.col("draw") < k, "support").otherwise("query").alias("role"), "accession", F.row_number().over(use).alias("occurrence"))


def multi_hot(samples: DataFrame, members: DataFrame) -> DataFrame:
    """episode, accession, slot, label: for each query sample and class of its episode, whether it is a member."""
    queries = samples.where("role = 'query'").select("episode", "accession").distinct()
    classes = samples.select("episode", "slot", "ec").distinct()
    own = members.select("ec", "accession").distinct().withColumn("label", F.lit(1))
    return queries.join(classes, "episode").join(own, ["ec", "accession"], "left").select("episode", "accession", "slot", "ec", F.coalesce("label", F.lit(0)).alias("label"))


def coverage(members: DataFrame, k: int, q: int, clusters: DataFrame | None = None) -> DataFrame:
    """Classes in all; of K+Q members or more; of K or more but fewer than that; and left out (fewer, or a single cluster)."""
    sizes = members.groupBy("ec").agg(F.count_distinct("accession").alias("n"))
    alone = F.lit(False)
    if clusters is not None:
        many = members.join(clusters, "accession", "left").groupBy("ec").agg(F.count_distinct(F.coalesce("cluster_id", F.concat(F.lit("_na_"), "accession"))).alias("c"))
        sizes, alone = sizes.join(many, "ec"), F.col("c") < 2
    return sizes.agg(F.count("*").alias("total"), F.count_if(~alone & (F.col("n") >= k + q)).alias("full"), F.count_if(~alone & F.col("n").between(k, k + q - 1)).alias("tail"), F.count_if(alone | (F.col("n") < k)).alias("excluded"))


def usage(members: DataFrame, samples: DataFrame, k: int, q: int) -> DataFrame:
    """Each class's support and query samples and episodes with repeats, zeros too."""
    used = samples.groupBy("ec").agg(F.count_if(F.col("role") == "support").alias("s"), F.count_if(F.col("role") == "query").alias("q"))
    short = samples.groupBy("ec", "episode").agg(F.count_distinct("accession").alias("d")).where(F.col("d") < k + q).groupBy("ec").agg(F.count("*").alias("f"))
    classes = members.select("ec").distinct().join(used, "ec", "left").join(short, "ec", "left")
    return classes.select("ec", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("s", "support_count"), ("q", "query_count"), ("f", "fallback_episodes"))])


def episode_scores(samples: DataFrame, vectors: DataFrame, members: DataFrame, temperature: float) -> DataFrame:
    """episode, accession, own (the query's slot), slot, ec, logit, label: queries against the prototypes of their episode."""
    v = projected(vectors).select("accession", "vec")
    rows = samples.join(v, "accession")
    protos = mean_vectors(rows.where("role = 'support'"), "episode", "slot", "ec").select("episode", "slot", "ec", unit(F.col("vec")).alias("proto"))
    queries = rows.where("role = 'query'").select("episode", "accession", F.col("slot").alias("own"), "vec")
    own = members.select("ec", "accession").distinct().withColumn("label", F.lit(1))
    scored = queries.join(protos, "episode").withColumn("logit", dot(F.col("vec"), F.col("proto")) / temperature)
    return scored.join(own, ["ec", "accession"], "left").select("episode", "accession", "own", "slot", "ec", "logit", F.coalesce("label", F.lit(0)).alias("label"))


def episode_metrics(scores: DataFrame) -> DataFrame:
    """Accuracy of the best slot, cross-entropy of the softmax, and binary cross-entropy of all cells."""
    query = ["episode", "accession", "own"]
    best = Window.partitionBy(*query)
    z = scores.withColumn("top", F.max("logit").over(best)).withColumn("r", F.row_number().over(best.orderBy(F.desc("logit"), "slot")))
    z = z.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    rows = z.groupBy(*query).agg(
        F.max(((F.col("r") == 1) & (F.col("slot") == F.col("own"))).cast("double")).alias("ok"),
        (F.max("top") + F.ln(F.sum(F.exp(F.col("logit") - F.col("top")))) - F.max(F.when(F.col("slot") == F.col("own"), F.col("logit")))).alias("ce"),
        F.avg(-F.when(F.col("label") == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p")))).alias("bce"),
    )
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("ok"), 6).alias("accuracy"), F.round(F.avg("ce"), 6).alias("cross_entropy"), F.round(F.avg("bce"), 6).alias("bce"))


def hierarchy_loss(samples: DataFrame, vectors: DataFrame, members: DataFrame, names: DataFrame, levels: int = 3, weight: float = 0.5, temperature: float = 0.1, multi: bool = True) -> DataFrame:
    """episode, loss: for each of the first `levels` levels (3 at most) of the classes' codes (names: ec, code), queries are scored against
    the normalised means of the support under the level's codes, and the mean loss of all cells counts `weight` / levels.
    A level with fewer than two codes in the episode costs nothing. With `multi` a query has every code that one of its
    classes in the episode has, and the loss is binary; else it has its own class's, and the loss is that of the softmax."""
    used = min(levels, 3)
    if used <= 0 or weight <= 0:
        return samples.select("episode").distinct().withColumn("loss", F.lit(0.0))
    v = projected(vectors).select("accession", "vec")
    each = F.array(*[F.struct(F.lit(i).alias("level"), ancestor(F.col("code"), i).alias("coarse")) for i in range(1, used + 1)])
    coarse = names.select("ec", F.inline(each))  # a few rows per class
    placed = written(samples.join(v, "accession").join(coarse, "ec").select("episode", "role", "slot", "accession", "vec", "level", "coarse"), "coarse-samples")
    able = placed.groupBy("episode", "level").agg(F.count_distinct("coarse").alias("n")).where("n >= 2").drop("n")
    protos = mean_vectors(placed.where("role = 'support'").join(able, ["episode", "level"]), "episode", "level", "coarse").select("episode", "level", "coarse", unit(F.col("vec")).alias("proto"))
    queries = placed.where("role = 'query'").select("episode", "level", "accession", "slot", "vec", F.col("coarse").alias("own"))
    scored = queries.join(protos, ["episode", "level"]).withColumn("z", dot(F.col("vec"), F.col("proto")) / temperature)
    if multi:
        has = samples.select("episode", "ec").distinct().join(coarse, "ec").join(members.select("ec", "accession").distinct(), "ec").select("episode", "level", "coarse", "accession", F.lit(1).alias("y")).distinct()
        scored = scored.join(has, ["episode", "level", "coarse", "accession"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
        cost = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.ln(1 + F.exp(-F.abs("z")))
        per = scored.groupBy("episode", "level").agg(F.avg(cost).alias("c"))
    else:
        top = F.max("z").over(Window.partitionBy("episode", "level", "accession", "slot"))
        one = scored.withColumn("top", top).groupBy("episode", "level", "accession", "slot").agg((F.max("top") + F.ln(F.sum(F.exp(F.col("z") - F.col("top")))) - F.max(F.when(F.col("coarse") == F.col("own"), F.col("z")))).alias("c"))
        per = one.groupBy("episode", "level").agg(F.avg("c").alias("c"))
    total = per.groupBy("episode").agg((F.sum("c") * weight / used).alias("loss"))
    return samples.select("episode").distinct().join(total, "episode", "left").select("episode", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def validation_accuracy(scores: DataFrame) -> DataFrame:
    """queries, accuracy: how often the best slot's class is one of the query's (label 1). Episodes that couldn't be drawn have no
    rows and don't count; with no rows at all the accuracy is 0."""
    best = Window.partitionBy("episode", "accession", "own").orderBy(F.desc("logit"), "slot")
    first = scores.withColumn("r", F.row_number().over(best)).where("r = 1")
    return first.agg(F.count("*").alias("queries"), F.coalesce(F.round(F.avg(F.col("label").cast("double")), 6), F.lit(0.0)).alias("accuracy"))


def best_or_last(best: DataFrame, last: DataFrame) -> DataFrame:
    """best, last, choice: of two projections' validation scores on the same episodes; the last one must be better by more than 1e-12."""
    both = validation_accuracy(best).select(F.col("accuracy").alias("best")).crossJoin(validation_accuracy(last).select(F.col("accuracy").alias("last")))  # a row each
    return both.withColumn("choice", F.when(F.col("last") > F.col("best") + 1e-12, "last").otherwise("best"))


def evaluation(scores: DataFrame, tau: float, overrides: DataFrame | None = None) -> DataFrame:
    """One row of metrics of episodes' scores: hits of the best slot; micro and macro (over slots) metrics of cells at the threshold (a class's
    own, if overrides (ec, tau) have it), the best slot always taken if none reaches it; comparisons of sets. Zeros without rows."""
    key = F.concat_ws("|", "episode", "own", "accession")
    rows = scores.select(key.alias("accession"), F.col("slot").alias("ec"), F.col("ec").alias("name"), "logit", (F.col("label") == 1).alias("true"))
    limit = F.lit(tau)
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("ec").alias("name"), F.col("tau").alias("own_tau")), "name", "left")
        limit = F.coalesce("own_tau", limit)
    best = Window.partitionBy("accession").orderBy(F.desc("logit"), "ec")
    over = F.max((sigmoid(F.col("logit")) >= limit).cast("int")).over(Window.partitionBy("accession"))
    rows = rows.withColumn("rank", F.row_number().over(best)).withColumn("hit", (sigmoid(F.col("logit")) >= limit) | ((F.col("rank") == 1) & (over == 0)))
    rows = written(rows.select("accession", "ec", "rank", "hit", "true"), "episode-decisions")
    parts = top1_rate(rows).drop("queries").crossJoin(micro_macro(per_class(rows).withColumn("all", F.lit(1)), "all").drop("all")) if not rows.isEmpty() else None
    if parts is None:
        return scores.sparkSession.range(1).select(*[F.lit(0.0).alias(n) for n in ("acc_top1_hit", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")])
    return parts.crossJoin(set_metrics(rows))  # a row each


def redrawn(members: DataFrame, clusters: DataFrame, n_episodes: int, m: int, k: int, q: int, seed: int, attempts: int = 10) -> tuple[DataFrame, DataFrame]:
    """Samples of episodes with disjoint clusters, and the shortages met on the way (attempt, episode, ec, have, need).

    An episode with a class of fewer than K+Q clusters is drawn again, with other classes, up to `attempts` times in all; if
    none does, it is dropped. Attempt 0 draws what `pick_classes` and `disjoint` draw; samples have the attempt that holds.
    """
    size = members.join(clusters, "accession", "left").groupBy("ec").agg(F.count_distinct(F.coalesce("cluster_id", F.concat(F.lit("_na_"), "accession"))).alias("have"))
    size = written(size, "cluster-counts")
    open_, done, short = None, [], []
    for attempt in range(attempts):
        drawn = pick_classes(members, n_episodes, m, k, q, seed if not attempt else f"{seed}+{attempt}", clusters=clusters)
        drawn = written(drawn if open_ is None else drawn.join(open_, "episode", "left_semi"), "drawn")
        lacking = written(drawn.join(size, "ec").where(F.col("have") < k + q).select(F.lit(attempt).alias("attempt"), "episode", "ec", "have", F.lit(k + q).alias("need")), "shortages")
        good = drawn.join(lacking.select("episode"), "episode", "left_anti")
        done.append(disjoint(good, members, clusters, k, q, seed if not attempt else f"{seed}+{attempt}").withColumn("attempt", F.lit(attempt)))
        short.append(lacking)
        open_ = lacking.select("episode").distinct()
        if lacking.isEmpty():
            break
    both = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return both(done), both(short)


def shortage_report(samples: DataFrame, shortages: DataFrame, attempts: int = 10) -> DataFrame:
    """ec, events (draws that lacked clusters), episodes, dropped (episodes that never came about) of each class that was short."""
    never = shortages.where(F.col("attempt") == attempts - 1).select("episode").distinct().withColumn("never", F.lit(True))
    rows = shortages.join(never, "episode", "left")
    return rows.groupBy("ec").agg(F.count("*").alias("events"), F.count_distinct("episode").alias("episodes"), F.count_distinct(F.when(F.col("never"), F.col("episode"))).alias("dropped"))


def single_cluster_classes(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """ec, clusters of the classes that no disjoint episode can have: those of a single cluster."""
    size = members.join(clusters, "accession", "left").groupBy("ec").agg(F.count_distinct(F.coalesce("cluster_id", F.concat(F.lit("_na_"), "accession"))).alias("clusters"))
    return size.where("clusters < 2")


def disjoint_with_repeats(chosen: DataFrame, members: DataFrame, clusters: DataFrame, k: int, q: int, seed: int) -> DataFrame:
    """Draws for classes of fewer than K+Q clusters: a class's clusters, in a seeded order, are parted between support and query in
    proportion (at least one each), and each side goes round its clusters, taking a seeded member each time. A class of one cluster is not given."""
    placed = members.join(clusters, "accession", "left").select("ec", "accession", F.coalesce("cluster_id", F.concat(F.lit("_na_"), "accession")).alias("cluster_id")).distinct()
    order = Window.partitionBy("episode", "ec").orderBy(ticket(seed, F.lit("cluster"), F.col("episode"), F.col("ec"), F.col("cluster_id")), "cluster_id")
    each = chosen.join(placed.groupBy("ec", "cluster_id").agg(F.count("*").alias("size")), "ec").withColumn("j", F.row_number().over(order) - 1).withColumn("c", F.count("*").over(Window.partitionBy("episode", "ec"))).where("c >= 2")
    each = each.withColumn("cut", F.least(F.greatest(F.bround(F.col("c") * k / (k + q)), F.lit(1)), F.col("c") - 1).cast("int"))
    draws = chosen.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k + q - 1)))).join(each.select("episode", "ec", "c", "cut").distinct(), ["episode", "ec"])
    draws = draws.withColumn("j", F.when(F.col("draw") < k, F.col("draw") % F.col("cut")).otherwise(F.col("cut") + (F.col("draw") - k) % (F.col("c") - F.col("cut"))).cast("int"))
    rows = draws.join(each.select("episode", "ec", "j", "cluster_id", "size"), ["episode", "ec", "j"])
    rows = rows.withColumn("i", F.floor(uniform(seed, F.lit("repeat"), F.col("episode"), F.col("ec"), F.col("draw")) * F.col("size")).cast("int"))
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy("ec", "cluster_id").orderBy("accession")) - 1)
    return rows.join(numbered, ["ec", "cluster_id", "i"]).select("episode", "ec", "slot", "draw", F.when(F.col("draw") < k, "support").otherwise("query").alias("role"), "accession", "cluster_id")
