"""Prototypes, scores of all queries against all classes, decisions and metrics.

Tables: vectors (accession, vec), members (ec, accession), prototypes (ec, proto_id, vec, train_count),
logits (accession, ec, logit), truth (accession, ec), decisions (accession, ec, prob, hit).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid, unit
from ..session import written

#: Bytes of prototypes that are broadcast at a time; more are taken in blocks.
BLOCK_BYTES = 64 << 20


def projected(vectors: DataFrame, weights=None, bias=None) -> DataFrame:
    """Unit vectors, after an affine projection if one is given (rows of numbers)."""
    v = F.col("vec").cast("array<double>")
    if weights is not None:
        rows = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(float(b)), lambda s, x: s + x) for row, b in zip(weights, bias)]
        v = F.array(*rows)
    return vectors.withColumn("vec", unit(v))


def mean_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """The mean of vec for each group, an element at a time, so that partial sums combine on the map side."""
    parts = rows.select(*keys, F.posexplode("vec").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("vec"))


def prototypes(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """The normalised mean of each class's unit vectors. Members without a vector don't count; classes without any vanish."""
    rows = members.join(projected(vectors).select("accession", "vec"), "accession")
    size = rows.groupBy("ec").agg(F.count("*").cast("int").alias("train_count"))
    return mean_vectors(rows, "ec").join(size, "ec").select("ec", F.lit(0).alias("proto_id"), unit(F.col("vec")).alias("vec"), "train_count")


def cosines(queries: DataFrame, bank: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """accession, ec, proto_id, cos for all queries and prototypes. Blocks of the bank of bounded size are multiplied
    with Arrow batches of queries, so each block reads the queries once and nothing is shuffled."""
    spark = bank.sparkSession
    queries = projected(queries).select("accession", "vec")

    def scored(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            ecs, ids, matrix = sent.value
            names, numbers = pa.array(ecs, pa.string()), pa.array(ids, pa.int32())
            step = max(1, 200_000 // len(ecs))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    x = np.array(part.column("vec").to_pylist(), float)
                    cos = x @ matrix.T
                    who = pa.array(np.repeat(np.arange(len(x)), len(ecs)))
                    which = pa.array(np.tile(np.arange(len(ecs)), len(x)))
                    yield pa.RecordBatch.from_arrays([part.column("accession").take(who), names.take(which), numbers.take(which), pa.array(cos.ravel())], names=["accession", "ec", "proto_id", "cos"])

        return queries.mapInArrow(run, "accession string, ec string, proto_id int, cos double")

    out, block, size = None, [], 0

    def flush():
        import numpy as np

        nonlocal out
        part = scored(([r.ec for r in block], [r.proto_id for r in block], np.array([r.vec for r in block], float)))
        out = part if out is None else out.unionAll(part)

    for r in bank.select("ec", "proto_id", "vec").toLocalIterator():
        if block and size > block_bytes:
            flush()
            block, size = [], 0
        block.append(r)
        size += 8 * len(r.vec) + 64
    if block:
        flush()
    return out if out is not None else spark.createDataFrame([], "accession string, ec string, proto_id int, cos double")


def bank_blocks(bank: DataFrame, block_bytes: int = BLOCK_BYTES, whole: bool = True):
    """Names, limits, first rows and the matrix of blocks of classes (`whole` ones, if so asked) of the bank (ec, limit, vec), in order of ec."""
    import numpy as np

    def packed():
        first = [i for i, r in enumerate(block) if not i or r.ec != block[i - 1].ec]
        return [block[i].ec for i in first], np.array([block[i].limit for i in first], float), np.array(first), np.array([r.vec for r in block], float)

    block, size = [], 0
    for r in bank.select("ec", "limit", "vec").orderBy("ec").toLocalIterator():
        if block and size > block_bytes and not (whole and r.ec == block[-1].ec):
            yield packed()
            block, size = [], 0
        block.append(r)
        size += 8 * len(r.vec) + 64
    if block:
        yield packed()


def class_scorer():
    """A function of rows of vectors, first rows and a matrix: the logit of each class, by `logits`' rule."""

    def scored(x, first, matrix):
        import numpy as np

        z = x @ matrix.T
        if len(first) == len(matrix):
            return z
        top = np.maximum.reduceat(z, first, axis=1)
        size = np.diff(np.append(first, len(matrix)))
        return top + np.log(np.add.reduceat(np.exp(z - np.repeat(top, size, axis=1)), first, axis=1))

    return scored


def promising(queries: DataFrame, bank: DataFrame, tau: float, temperature: float = 1.0, shortlist: int = 0, overrides: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """accession, ec, logit of the cells that `decide` with the same settings can take: of each block of the bank a query's best `shortlist` classes
    (one at least, and what ties with the last of them), and without a shortlist all that reach their threshold. All other cells
    are scored within the Arrow batch and never leave it. Blocks hold whole classes."""
    spark = bank.sparkSession
    queries = projected(queries).select("accession", "vec")
    limit = F.lit(float(tau))
    if overrides is not None:
        bank = bank.join(overrides.select("ec", F.col("tau").alias("own_tau")), "ec", "left")
        limit = F.coalesce("own_tau", limit)
    logits_of = class_scorer()

    def scored(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            ecs, limits, first, matrix = sent.value
            names = pa.array(ecs, pa.string())
            n = min(max(shortlist, 1), len(ecs))
            step = max(1, 200_000 // len(matrix))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    z = logits_of(np.array(part.column("vec").to_pylist(), float), first, matrix)
                    p = 1 / (1 + np.exp(-z / temperature))
                    keep = p >= np.partition(p, len(ecs) - n, axis=1)[:, [len(ecs) - n]] - 1e-12
                    if not shortlist:
                        keep |= p >= limits - 1e-9  # the exact comparison is `decide`'s
                    who, which = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([part.column("accession").take(pa.array(who)), names.take(pa.array(which)), pa.array(z[keep])], names=["accession", "ec", "logit"])

        return queries.mapInArrow(run, "accession string, ec string, logit double")

    parts = [scored(block) for block in bank_blocks(bank.select("ec", limit.alias("limit"), "vec"), block_bytes)]
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "accession string, ec string, logit double")


def bank_losses(queries: DataFrame, bank: DataFrame, truth: DataFrame, temperatures: list[float], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What `losses` gives for all cells of queries and the bank's classes, from sums that each Arrow batch makes of its own cells."""
    spark = bank.sparkSession
    own = truth.select("accession", "ec").distinct().groupBy("accession").agg(F.collect_list("ec").alias("own"))
    rows = projected(queries).select("accession", "vec").join(own, "accession", "left").select("vec", "own")
    logits_of, points = class_scorer(), [float(t) for t in temperatures]

    def summed(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            ecs, _, first, matrix = sent.value
            at = {c: j for j, c in enumerate(ecs)}
            step, cells = max(1, 200_000 // len(matrix)), 0
            total = np.zeros((len(points), 2))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    z = logits_of(np.array(part.column("vec").to_pylist(), float), first, matrix)
                    y = np.zeros(z.shape)
                    for j, mine in enumerate(part.column("own").to_pylist()):
                        y[j, [at[c] for c in mine or () if c in at]] = 1
                    cells += z.size
                    for k, t in enumerate(points):
                        p = 1 / (1 + np.exp(-z / t))
                        near = np.clip(p, 1e-7, 1 - 1e-7)
                        total[k] += -(y * np.log(near) + (1 - y) * np.log(1 - near)).sum(), ((p - y) ** 2).sum()
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array([cells] * len(points), pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["t", "cells", "bce", "brier"])

        return rows.mapInArrow(run, "t double, cells bigint, bce double, brier double")

    parts = [summed(block) for block in bank_blocks(bank.select("ec", F.lit(0.0).alias("limit"), "vec"), block_bytes)]
    if not parts:
        return spark.createDataFrame([], "temperature double, bce double, brier double")
    mean = lambda c: F.round(F.sum(c) / F.sum("cells"), 6).alias(c)
    return functools.reduce(DataFrame.unionAll, parts).groupBy(F.round("t", 8).alias("temperature")).agg(mean("bce"), mean("brier"))


def logits(cos: DataFrame) -> DataFrame:
    """One logit per query and class: log-sum-exp over a class's prototypes, which is the cosine itself for a single one."""
    top = cos.groupBy("accession", "ec").agg(F.max("cos").alias("top"), F.collect_list("cos").alias("all"))
    return top.select("accession", "ec", F.when(F.size("all") == 1, F.col("top")).otherwise(F.col("top") + F.ln(F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))).alias("logit"))


def class_logits(queries: DataFrame, bank: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What `logits` gives for `cosines`, from each class's sum of exp that an Arrow batch makes for its queries: a row for each query, class and block of the bank
    is all that is shuffled, however many prototypes a class has. A class may go on from block to block. Cosines are 1 at most, so sums need no scaling."""
    spark = bank.sparkSession
    queries = projected(queries).select("accession", "vec")

    def scored(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            ecs, first, matrix = sent.value
            size = np.diff(np.append(first, len(matrix)))
            step = max(1, 200_000 // len(matrix))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    cos = np.array(part.column("vec").to_pylist(), float) @ matrix.T
                    top, total = np.maximum.reduceat(cos, first, axis=1), np.add.reduceat(np.exp(cos), first, axis=1)
                    who, which = np.repeat(np.arange(len(cos)), len(ecs)), np.tile(np.arange(len(ecs)), len(cos))
                    columns = [part.column("accession").take(pa.array(who)), pa.array(ecs, pa.string()).take(pa.array(which)), pa.array(size[which]), pa.array(top.ravel()), pa.array(total.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names=["accession", "ec", "n", "top", "total"])

        return queries.mapInArrow(run, "accession string, ec string, n bigint, top double, total double")

    parts = [scored((ecs, first, matrix)) for ecs, _, first, matrix in bank_blocks(bank.select("ec", F.lit(0.0).alias("limit"), "vec"), block_bytes, whole=False)]
    if not parts:
        return spark.createDataFrame([], "accession string, ec string, logit double")
    sums = functools.reduce(DataFrame.unionAll, parts).groupBy("accession", "ec").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.sum("total").alias("total"))
    return sums.select("accession", "ec", F.when(F.col("n") == 1, F.col("top")).otherwise(F.ln("total")).alias("logit"))


def answerable(queries: DataFrame, truth: DataFrame, vectors: DataFrame, bank: DataFrame) -> DataFrame:
    """accession, has_vector, n_labels (known to the bank) of each query."""
    known = truth.join(bank.select("ec").distinct(), "ec", "left_semi").groupBy("accession").agg(F.count_distinct("ec").alias("n"))
    have = vectors.select("accession").distinct().withColumn("has_vector", F.lit(True))
    return queries.select("accession").distinct().join(have, "accession", "left").join(known, "accession", "left").select("accession", F.coalesce("has_vector", F.lit(False)).alias("has_vector"), F.coalesce("n", F.lit(0)).alias("n_labels"))


def coverage(state: DataFrame) -> DataFrame:
    ok = F.col("has_vector") & (F.col("n_labels") > 0)
    return state.agg(
        F.count("*").alias("queries_total"),
        F.count_if(ok).alias("queries_covered"),
        F.count_if(~F.col("has_vector")).alias("missing_embedding"),
        F.count_if(F.col("has_vector") & (F.col("n_labels") == 0)).alias("missing_labels"),
        F.round(F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 6).alias("coverage"),
    )


def decide(scores: DataFrame, tau, temperature: float = 1.0, shortlist: int = 0, overrides: DataFrame | None = None, ensure: bool = True) -> DataFrame:
    """accession, ec, prob, rank, hit. hit: the probability is at least the class's threshold (an override (ec, tau), else tau)
    and among the `shortlist` best (0: all); a query with no hit gets its best class (the first by name on ties)."""
    best = Window.partitionBy("accession").orderBy(F.desc("prob"), "ec")
    out = scores.withColumn("prob", sigmoid(F.col("logit") / temperature)).withColumn("rank", F.row_number().over(best))
    limit: Column = F.lit(tau) if not isinstance(tau, Column) else tau
    if overrides is not None:
        out = out.join(overrides.select("ec", F.col("tau").alias("_tau")), "ec", "left")
        limit = F.coalesce("_tau", limit)
    hit = F.col("prob") >= limit
    if shortlist > 0:
        hit = hit & (F.col("rank") <= shortlist)
    out = out.withColumn("_hit", hit)
    if ensure:
        out = out.withColumn("_hit", F.col("_hit") | ((F.col("rank") == 1) & ~F.max("_hit").over(Window.partitionBy("accession"))))
    return out.select("accession", "ec", "prob", "rank", F.col("_hit").alias("hit"))


def judged(decisions: DataFrame, truth: DataFrame, queries: DataFrame | None = None, bank: DataFrame | None = None) -> DataFrame:
    """decisions with `true`: whether the class is one of the query's. With queries and bank, decisions may lack cells that are no hits; those
    of them that are true are added, with nulls for what is known of scored cells."""
    own = truth.select("accession", "ec").distinct().withColumn("true", F.lit(True))
    if bank is None:
        return decisions.join(own, ["accession", "ec"], "left").withColumn("true", F.coalesce("true", F.lit(False)))
    own = own.join(bank.select("ec").distinct(), "ec", "left_semi").join(queries.select("accession").distinct(), "accession", "left_semi")
    both = decisions.join(own, ["accession", "ec"], "full")
    rest = [F.coalesce(c, F.lit(False)).alias(c) if c == "hit" else F.col(c) for c in decisions.columns if c not in ("accession", "ec")]
    return both.select("accession", "ec", *rest, F.coalesce("true", F.lit(False)).alias("true"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def per_class(rows: DataFrame, *keys: str) -> DataFrame:
    hit, true = F.col("hit"), F.col("true")
    return rows.groupBy(*keys, "ec").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))


def all_classes(classes: DataFrame, bank: DataFrame) -> DataFrame:
    """per_class rows of every class of the bank: zeros for those without a hit or a true cell."""
    return bank.select("ec").distinct().join(classes, "ec", "left").na.fill(0, ["tp", "fp", "fn"])


def micro_macro(classes: DataFrame, *keys: str) -> DataFrame:
    """Micro metrics over all cells, and macro ones as unweighted means over all classes."""
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    sums = [F.sum(c) for c in ("tp", "fp", "fn")]
    mp, mr, mf = prf(*sums)
    named = {"micro_precision": mp, "micro_recall": mr, "micro_f1": mf, "macro_precision": F.avg(p), "macro_recall": F.avg(r), "macro_f1": F.avg(f)}
    return classes.groupBy(*keys).agg(*[F.round(v, 6).alias(k) for k, v in named.items()])


def top1_rate(rows: DataFrame) -> DataFrame:
    return rows.where("rank = 1").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("true").cast("double")), 6).alias("acc_top1_hit"))


def buckets(classes: DataFrame, bank: DataFrame) -> DataFrame:
    """Metrics by how often a class was seen in training: tail up to 5, medium up to 25, head above."""
    n = F.col("train_count")
    sizes = bank.groupBy("ec").agg(F.max("train_count").alias("train_count"))
    named = classes.join(sizes, "ec").withColumn("bucket", F.when(n <= 5, "tail").when(n <= 25, "medium").otherwise("head"))
    return micro_macro(named, "bucket").select("bucket", "micro_precision", "micro_recall", "micro_f1", "macro_f1")


def set_metrics(rows: DataFrame) -> DataFrame:
    """Comparisons of predicted and true sets, over all queries and over those with more than one true class."""
    q = rows.groupBy("accession").agg(F.count_if("true").alias("t"), F.count_if("hit").alias("p"), F.count_if(F.col("true") & F.col("hit")).alias("i"))
    union = F.col("t") + F.col("p") - F.col("i")
    named = {
        "subset_accuracy": ((F.col("i") == union) & (union > 0)).cast("double"),
        "jaccard": F.col("i") / F.greatest(union, F.lit(1)),
        "card_mae": F.abs(F.col("p") - F.col("t")).cast("double"),
        "card_true": F.col("t").cast("double"),
        "card_pred": F.col("p").cast("double"),
        "under": (F.col("p") < F.col("t")).cast("double"),
        "over": (F.col("p") > F.col("t")).cast("double"),
    }
    return q.agg(*[F.round(F.avg(v), 6).alias(k) for k, v in named.items()], *[F.round(F.avg(F.when(F.col("t") > 1, v)), 6).alias(f"multi_{k}") for k, v in named.items()])


def single_label_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and macro metrics of (true_ec, pred_ec) over the classes that occur as either."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("true_ec").alias("ec"), F.lit(True).alias("t"), (F.col("true_ec") == F.col("pred_ec")).alias("ok")), F.struct(F.col("pred_ec").alias("ec"), F.lit(False).alias("t"), (F.col("true_ec") == F.col("pred_ec")).alias("ok")))).alias("s")).select("s.*")
    classes = sides.groupBy("ec").agg(F.count_if(F.col("t") & F.col("ok")).alias("tp"), F.count_if(~F.col("t") & ~F.col("ok")).alias("fp"), F.count_if(F.col("t") & ~F.col("ok")).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return classes.agg(F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fn")), 6).alias("accuracy"), *[F.round(F.avg(v), 6).alias(k) for k, v in (("macro_precision", p), ("macro_recall", r), ("macro_f1", f))])


def losses(rows: DataFrame, temperatures: list[float]) -> DataFrame:
    """Mean binary cross-entropy and squared error of all cells (logit, true), for each temperature, in one pass over
    the cells: each contributes to all of the few temperatures' sums."""
    y = F.col("true").cast("double")

    def point(t):
        p = sigmoid(F.col("logit") / t)
        near = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
        return F.struct(F.round(F.lit(t), 8).alias("temperature"), F.round(F.avg(-(y * F.ln(near) + (1 - y) * F.ln(1 - near))), 6).alias("bce"), F.round(F.avg((p - y) ** 2), 6).alias("brier"))

    return rows.agg(F.array(*[point(t) for t in temperatures]).alias("curve")).select(F.inline("curve"))


def best_tau(curve: DataFrame, least_precision: float = 0.0, least_recall: float = 0.0) -> DataFrame:
    """The threshold of most F1 among those that meet both minima (all, if none does); the smallest on ties."""
    ok = (F.col("micro_precision") >= least_precision) & (F.col("micro_recall") >= least_recall)
    return curve.orderBy(ok.desc(), F.desc("micro_f1"), "tau").limit(1).withColumn("feasible", ok)


def best_temperature(curve: DataFrame, method: str, base: float) -> DataFrame:
    """The temperature of least loss (bce or brier; the smallest on ties); `none` keeps the base one."""
    if method not in ("bce", "brier", "none"):
        raise ValueError("choose by bce, brier or none")
    if method == "none":
        return curve.sparkSession.range(1).select(F.lit(float(base)).alias("temperature"))
    return curve.agg(F.min(F.struct(method, "temperature")).alias("b")).select(F.col("b.temperature").alias("temperature"))


def calibration(losses_: DataFrame, taus: DataFrame, method: str, base: float, shortlist: int = 0, least_precision: float = 0.0, least_recall: float = 0.0) -> DataFrame:
    """The calibration document, one row: tau_multi, temperature, shortlist_topN, opt_temp, grid (a struct of the curve's arrays) and temperature_curve."""

    def along(df, key, names):
        """The columns of a curve as a struct of arrays, in the order of its key."""
        pick = lambda n: lambda z: z[n]
        rows = df.agg(F.array_sort(F.collect_list(F.struct(key, *names))).alias("rows"))
        return rows.select(F.struct(*[F.transform("rows", pick(n)).alias("taus" if n == "tau" else n) for n in (key, *names)]).alias("grid"))

    grid = along(taus, "tau", ("micro_precision", "micro_recall", "micro_f1"))
    curve = along(losses_, "temperature", (method,)) if method != "none" else losses_.sparkSession.range(1).select(F.lit(None).cast("struct<temperature:array<double>>").alias("grid"))
    tau = best_tau(taus, least_precision, least_recall).select(F.col("tau").alias("tau_multi"))
    out = tau.crossJoin(best_temperature(losses_, method, base)).crossJoin(grid).crossJoin(curve.select(F.col("grid").alias("temperature_curve")))  # a row each
    return out.select("tau_multi", "temperature", F.lit(shortlist).alias("shortlist_topN"), F.lit(method).alias("opt_temp"), "grid", "temperature_curve")


def overridden(own: DataFrame | None, call: DataFrame | None) -> DataFrame | None:
    """Thresholds per class (ec, tau) of a scorer and of one call of it; the call's hold where both have one."""
    if own is None or call is None:
        return own if call is None else call
    return own.join(call.select("ec"), "ec", "left_anti").select("ec", "tau").unionByName(call.select("ec", "tau"))


def source_members(members: DataFrame, sources: DataFrame, source: str | None, default: str = "SwissProt") -> DataFrame:
    """Members (ec, accession) whose accession is of one source (sources: accession, source; unknown ones are of the default); all of
    them if none is asked for, or if none would be left."""
    if not source:
        return members
    kept = written(members.join(sources.select("accession", "source"), "accession", "left").where(F.coalesce("source", F.lit(default)) == source).select(*members.columns), "source-members")
    return members if kept.isEmpty() else kept


def masked_means(tokens: DataFrame, skipped: tuple[str, ...] = ("pad", "cls", "eos")) -> DataFrame:
    """accession, vec: the mean of the vectors (accession, kind, vec) of each entry's tokens that aren't marks."""
    return mean_vectors(tokens.where(~F.col("kind").isin(*skipped)), "accession")
