"""Seeded class splits, caps, top-up, identity edges and stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import ancestor
from ..functions.hashing import ticket
from ..session import written
from . import shingles
from .graph import components, representatives
from .labels import numbered


def cap_members(df: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n members of each class, chosen by ticket."""
    turn = Window.partitionBy("ec").orderBy(ticket(seed, F.col("ec"), F.col("accession")), "accession")
    return df.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= n).drop("rank")


def top_classes(df: DataFrame, n: int) -> DataFrame:
    return df.groupBy("ec").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ec").limit(max(1, n))


def _ranked(classes: DataFrame, seed: int) -> tuple[DataFrame, int]:
    shuffled = classes.select("ec").distinct().withColumn("turn", F.concat_ws("|", ticket(seed, F.col("ec")), F.col("ec")))
    return numbered(shuffled, "turn", "idx"), shuffled.count()


def split_bounds(n: int, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> tuple[int, int, int]:
    """Sizes of train, val and test: rounded half to even, val and test at least 1 each from three classes on;
    what is over is taken from train, then val, then test."""
    if n <= 1:
        return n, 0, 0
    if n == 2:
        return 1, 1, 0
    sizes = [round(fractions[0] * n), max(1, round(fractions[1] * n)), 0]
    sizes[2] = max(1, n - sizes[0] - sizes[1])
    for i in range(3):
        sizes[i] -= min(sizes[i], max(0, sum(sizes) - n))
    return tuple(sizes)


def class_split(classes: DataFrame, seed: int) -> DataFrame:
    """ec, split (train, val, test)."""
    ranked, n = _ranked(classes, seed)
    train, val, _ = split_bounds(n)
    return ranked.select("ec", F.when(F.col("idx") < train, "train").when(F.col("idx") < train + val, "val").otherwise("test").alias("split"))


def train_val_split(classes: DataFrame, seed: int, share: float = 0.1) -> DataFrame:
    """ec, split (train, val): val has its rounded share, at least 1 if there are two classes."""
    ranked, n = _ranked(classes, seed)
    val = 0 if n < 2 else max(1, round(share * n))
    return ranked.select("ec", F.when(F.col("idx") < val, "val").otherwise("train").alias("split"))


def holdout_split(members: DataFrame, least: int, seed: int) -> DataFrame:
    """Classes of `least` members or more are split; all smaller ones are test classes."""
    sizes = members.groupBy("ec").agg(F.count("*").alias("n"))
    kept = class_split(sizes.where(F.col("n") >= least), seed)
    return kept.unionByName(sizes.where(F.col("n") < least).select("ec", F.lit("test").alias("split")))


def top_up(counts: DataFrame, candidates: DataFrame, used: DataFrame, target: int, cap: int) -> DataFrame:
    """ec, accession chosen so that classes (ec, n, ordered by n, then ec) reach the target with `cap` at most.

    Classes choose in turn, each the smallest accessions that are unused and not chosen before it. That equals the
    one stable assignment in which all accessions prefer earlier classes, so it is found by rounds of
    proposals for all classes at once: each class asks for its first free candidates, each accession stays with the
    earliest class, and those refused are struck off.
    """
    need = counts.where(F.col("n") < target).withColumn("need", F.least(F.lit(target) - F.col("n"), F.lit(cap))).withColumn("turn", F.concat_ws("|", F.lpad(F.col("n").cast("string"), 12, "0"), F.col("ec")))
    open_ = candidates.select("ec", "accession").distinct().join(used.select("accession").distinct(), "accession", "left_anti").join(need.select("ec", "need", "turn"), "ec")
    open_ = written(open_, "candidates")
    first = Window.partitionBy("ec").orderBy("accession")
    while True:
        asked = open_.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= F.col("need"))
        best = asked.groupBy("accession").agg(F.min("turn").alias("winner"))
        asked = written(asked.join(best, "accession"), "proposals")
        lost = asked.where(F.col("turn") != F.col("winner")).select("ec", "accession")
        if lost.isEmpty():
            return asked.select("ec", "accession")
        open_ = written(open_.join(lost, ["ec", "accession"], "left_anti"), "candidates")


def deficits(counts: DataFrame, target: int) -> DataFrame:
    return counts.agg(F.count("*").alias("classes"), F.count_if(F.col("n") < target).alias("below"), F.coalesce(F.sum(F.greatest(F.lit(target) - F.col("n"), F.lit(0))), F.lit(0)).alias("missing"))


def fill_train(train: DataFrame, pool: DataFrame, target: int) -> DataFrame:
    """train (ec, accession) with members of the pool, in order, until each class has the target."""
    size = train.groupBy("ec").agg(F.count("*").alias("n"))
    fresh = pool.select("ec", "accession").distinct().join(train, ["ec", "accession"], "left_anti").join(size, "ec")
    rank = F.row_number().over(Window.partitionBy("ec").orderBy("accession"))
    added = fresh.withColumn("rank", rank).where(F.col("rank") <= F.lit(target) - F.col("n")).select("ec", "accession")
    return train.select("ec", "accession", F.lit(False).alias("added")).unionByName(added.withColumn("added", F.lit(True)))


#: Classes that meet in one bucket of a shingle are those of two chunks of about this size.
CHUNK = 1024


def shingle_classes(docs: DataFrame, width: int = 3, similar: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, class, n) of texts with a shingle, and classes (class, n, g) of texts with equal sets of n shingles: class is the
    smallest doc_id, g those shingles that other classes have too, as an array of struct<df, h> from the rarest on, df
    counting classes, h a number for each shingle. Classes that share no shingle are left out, and those that share too few for a pair of this similarity."""
    rows = written(shingles.sized(docs, width), "shingle-sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = written(rows.groupBy("key").agg(F.min("doc_id").alias("class")), "shingle-classes")
    members = written(rows.join(least, "key").select("doc_id", "class", "n").distinct(), "class-members")
    # One set for each class: a doc_id can have more texts.
    firsts = rows.join(least.withColumnRenamed("class", "doc_id"), ["key", "doc_id"]).groupBy(F.col("doc_id").alias("class")).agg(F.min(F.struct("key", "n")).alias("s"))
    firsts = written(firsts.select("class", "s.key", "s.n"), "class-keys")
    return members, written(shingles.shared(docs, firsts, width, total, shingles.repeated(rows), similar), "classes")


#: Rounds in which a shingle's classes are compared with one of them only, and how many pairs of classes a row they begin at.
ROUNDS, PAIRS = 4, 4


def rarest_shingles(classes: DataFrame, similar: float) -> DataFrame:
    """h, df, class, n, p: the shingles by which classes are looked up, with how many classes have them and their places among the class's n shingles, the rarest first; written.

    Sets this similar share one of their rarest shingles, of which n - similar * n + 1 of each are looked up; those that no
    other class has are among these and need no look."""
    looked = F.size("g") - F.ceil(similar * F.col("n") - 1e-6).cast("int") + 1
    found = classes.select("class", "n", F.size("g").alias("shared"), F.posexplode(F.slice("g", 1, F.greatest(looked, F.lit(0)))).alias("i", "s"))
    return written(found.select(F.col("s.h").alias("h"), F.col("s.df").alias("df"), "class", "n", (F.col("n") - F.col("shared") + F.col("i")).alias("p")), "rarest-shingles")


def can_be_similar(similar: float):
    """Whether the sizes of two sets allow the similarity, and if the shared shingle is the first that they share also what stands after it."""
    na, nb = F.col("na"), F.col("nb")
    after = 1 + F.least(na - F.col("pa"), nb - F.col("pb")) - 1
    return (F.least(na, nb) >= similar * F.greatest(na, nb)) & (after >= similar / (1 + similar) * (na + nb) - 1e-6)


def verified_edges(pairs: DataFrame, classes: DataFrame, similar: float) -> DataFrame:
    """a < b, both, na, nb of the pairs (a, b) that are similar; written."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    # A class that shares too few shingles is in no pair.
    sets = classes.where(F.size("g") >= similar * F.col("n") - 1e-6).select("class", "n", F.transform("g", lambda x: x["h"]).alias("g"))
    first, second = (sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("g").alias(f"g{x}")) for x in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("both"), "na", "nb")
    return written(both.where(F.col("both") >= similar * (F.col("na") + F.col("nb") - F.col("both"))), "class-edges")


def bucket_pairs(rare: DataFrame, similar: float, chunk: int) -> DataFrame:
    """a, b: pairs of classes that share a looked-up shingle and can be similar; with a column comp, only those of two components. A shingle
    that many classes look up is dealt to pairs of chunks."""
    size = written(rare.groupBy("h").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1"), "frequent-shingles")
    dealt = rare.join(size, "h", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(F.lit("chunk"), "class"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    extra = ["comp"] if "comp" in rare.columns else []
    dealt = written(dealt.select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "n", "p", *extra), "dealt-shingles")
    left, right = (dealt.select("h", "low", "high", F.col("own").alias(f"own_{x}"), F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"), *[F.col(c).alias(f"{c}_{x}") for c in extra]) for x in "ab")
    # Two of one chunk meet in the chunk's own bucket only.
    met = left.join(right, ["h", "low", "high"]).where("a < b and (own_a != own_b or low = high)" + (" and comp_a != comp_b" if extra else ""))
    return met.where(can_be_similar(similar)).select("a", "b")


def few_pairs(rare: DataFrame, similar: float) -> DataFrame:
    """a, b: as `bucket_pairs`, of shingles that few classes have."""
    left, right = (rare.select("h", F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    return left.join(right, "h").where("a < b").where(can_be_similar(similar)).select("a", "b")


def class_edges(classes: DataFrame, similar: float, chunk: int = CHUNK) -> DataFrame:
    """a < b, both, na, nb: all pairs of classes with Jaccard of `similar` or more. Candidates are compared by all their shingles. As many near
    copies make as many rows as they have pairs; see `connecting_edges`."""
    return verified_edges(bucket_pairs(rarest_shingles(classes, similar), similar, chunk), classes, similar)


def connecting_edges(classes: DataFrame, similar: float, chunk: int = CHUNK, pairs: int = PAIRS) -> DataFrame:
    """Of `class_edges` some with the same components. Shingles of so few classes that they have `pairs` pairs for each at most are looked up once, and all their
    pairs are compared. While the others have more than `pairs` pairs for each class that looks up a shingle, a round compares each class with one leader
    of the shingle that isn't of its component yet, so that copies of a text find to each other by as many comparisons as they are; at last all
    pairs are compared that are still of two components."""
    rare = rarest_shingles(classes, similar)
    few = F.col("df") <= 2 * pairs + 1
    often, open_, every = rare.where(~few), few_pairs(rare.where(few), similar), rare.count()
    rows, found, comp = often, None, None
    for turn in range(ROUNDS):
        rows = often.withColumn("comp", F.col("class")) if comp is None else often.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        each = rows.groupBy("h", "comp").agg(F.count("*").alias("m")).groupBy("h").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inner"))
        left = each.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("inner")) / 2), F.lit(0))).first()[0]
        if left <= pairs * every:
            break
        rank = F.struct(F.hash(F.lit(turn), "comp"), "comp", F.hash(F.lit(turn), "class"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
        lead = written(rows.groupBy("h").agg(F.min(rank).alias("r"), F.count("*").alias("m")).where("m > 1").select("h", F.col("r.comp").alias("led"), "r.b", "r.nb", "r.pb"), "leaders")
        met = rows.join(lead, "h").where("comp != led").withColumnsRenamed({"n": "na", "p": "pa"}).where(can_be_similar(similar)).select(F.col("class").alias("a"), "b")
        new = verified_edges(met if open_ is None else met.unionAll(open_), classes, similar)
        open_ = None
        found = new if found is None else found.unionAll(new)
        comp = written(components(found.select("a", "b")).select(F.col("node").alias("class"), F.col("root").alias("comp")), "class-components")
    last = bucket_pairs(rows, similar, chunk)
    rest = verified_edges(last if open_ is None else last.unionAll(open_), classes, similar)
    return rest if found is None else found.unionAll(rest)


def shingle_edges(docs: DataFrame, similar: float, width: int = 3, chunk: int = CHUNK, connecting: bool = False) -> DataFrame:
    """src, dst, similarity: links with the components of all pairs of texts (doc_id, text) whose word-shingle Jaccard is `similar`
    or more, however many texts have a shingle. Texts of equal shingles link to the first of them; two such groups
    link by their first texts, src < dst; so copies make no pairs among themselves. Texts with fewer words than a shingle have none.
    All links between such groups are given, or with `connecting` only as many as keep the components."""
    members, classes = shingle_classes(docs, width, similar)
    found = (connecting_edges if connecting else class_edges)(classes, similar, chunk).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity"))
    return found.unionByName(members.where("doc_id != class").select(F.col("class").alias("src"), F.col("doc_id").alias("dst"), F.lit(1.0).alias("similarity")))


def shingle_representatives(docs: DataFrame, similar: float, width: int = 3) -> DataFrame:
    """doc_id, representative: greedy clusters of texts (doc_id, text), those of most shingles (then of smallest doc_id) first. Texts of
    equal shingles are one; texts with fewer words than a shingle stand for themselves."""
    members, classes = shingle_classes(docs, width, similar)
    turn = F.concat(F.lpad((F.lit(1 << 30) - F.col("n")).cast("string"), 10, "0"), F.lit("|"), F.lpad(F.col("class").cast("string"), 20, "0"))
    nodes = members.where("doc_id = class").select(F.col("class").alias("node"), turn.alias("turn"))
    named = written(representatives(nodes, class_edges(classes, similar).select(F.col("a").alias("src"), F.col("b").alias("dst"))), "representatives")
    placed = members.join(named.withColumnRenamed("node", "class"), "class").select("doc_id", "representative")
    return docs.select("doc_id").distinct().join(placed, "doc_id", "left").select("doc_id", F.coalesce("representative", "doc_id").alias("representative"))


def stratum(code, how: str = "top"):
    """What folds are stratified by: the top level of a code, the full code, or nothing."""
    if how not in ("top", "full", "none"):
        raise ValueError("stratify by top, full or none")
    return F.lit("all") if how == "none" else code if how == "full" else ancestor(code, 1)


def cluster_labels(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, label, n: how often clusters (node, cluster_id) hold each label (node, label)."""
    return clusters.join(labels, "node").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))


def assign_folds(histogram: DataFrame, folds: int, sizes: DataFrame | None = None) -> DataFrame:
    """cluster_id, fold: clusters (histogram: cluster_id, label, n; sizes: cluster_id, size, else the sum of the label counts) in order of size (largest first, then id). The first ones open the folds; each other
    one goes where the squared distance of label counts and size from their targets is least (then the smaller fold,
    then the lower number); labels that neither fold nor cluster has cost nothing.

    The choice depends on all choices before it, so one task takes the clusters as a stream in order. It holds
    only the folds' label counts and targets, and a cluster is one row of its label counts and costs as many steps as it has labels.
    """
    total = {r.label: r.n for r in histogram.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row per label
    target = {k: n / folds for k, n in total.items()}
    rows = histogram.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    everything = sum(total.values())
    if sizes is not None:
        rows = sizes.select("cluster_id", "size").join(rows.drop("size"), "cluster_id", "left").select("cluster_id", "size", "counts")
        everything = sizes.agg(F.sum("size")).first()[0] or 0

    def run(batches):
        import pandas as pd

        have = [dict() for _ in range(folds)]
        held, goal, seen = [0] * folds, everything / folds, 0
        base = [0.0] * folds  # each fold's squared distances for the labels that it has
        for batch in batches:
            out = []
            for size, counts in zip(batch["size"], batch["counts"]):
                counts = dict(counts or ())

                def change(f, counts=counts):
                    own = have[f]
                    return sum((own.get(k, 0) + n - target[k]) ** 2 - ((own[k] - target[k]) ** 2 if k in own else 0) for k, n in counts.items())

                if seen < folds:
                    pick = seen
                else:
                    pick = min(range(folds), key=lambda f, size=size: (round(base[f] + change(f) + (held[f] + size - goal) ** 2, 6), held[f], f))
                base[pick] += change(pick)
                seen += 1
                held[pick] += size
                for k, n in counts.items():
                    have[pick][k] = have[pick].get(k, 0) + n
                out.append(pick)
            yield pd.DataFrame({"cluster_id": batch["cluster_id"], "fold": pd.Series(out, dtype="int32")})

    kind = histogram.schema["cluster_id"].dataType.simpleString()
    return rows.orderBy(F.desc("size"), "cluster_id").coalesce(1).mapInPandas(run, f"cluster_id {kind}, fold int")


def fold_members(members: DataFrame, clusters: DataFrame, folds: DataFrame, fold: int, n_folds: int, least: int, seed: int) -> DataFrame:
    """split, ec, accession for one fold. Test: members of the fold's clusters. Train and val: classes with `least`
    members or more in the other clusters, a tenth of the classes being val. With one fold nothing is held out."""
    placed = members.join(clusters.withColumnRenamed("node", "accession"), "accession").join(folds, "cluster_id").select("ec", "accession", "fold")
    test = placed.where(F.col("fold") == fold)
    rest = placed if n_folds == 1 else placed.where(F.col("fold") != fold)
    classes = rest.groupBy("ec").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    named = train_val_split(classes, seed)
    return rest.join(named, "ec").select("split", "ec", "accession").unionByName(test.select(F.lit("test").alias("split"), "ec", "accession"))


def fold_counts(clusters: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """fold, clusters and members in test, and in train (all others; everything if there is one fold)."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).join(folds, "cluster_id").groupBy("fold").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    total = sizes.agg(F.sum("c").alias("tc"), F.sum("n").alias("tn"))
    rest = (lambda t, x: F.col(t) - F.col(x)) if n_folds > 1 else (lambda t, x: F.col(t))
    return sizes.crossJoin(F.broadcast(total)).select("fold", F.col("c").alias("n_clusters_test"), F.col("n").alias("n_seqs_test"), rest("tc", "c").alias("n_clusters_train"), rest("tn", "n").alias("n_seqs_train"))
