"""Several prototypes a class: k-means over all its members, as aggregates by class and centre.

Starts are those of k-means++: a class's next centre is a member with a chance in proportion to its squared distance from the
centres so far. That draw is the least of exponential times at these rates, so it is one more aggregate, and no class is
gathered anywhere. Each round of Lloyd's is a join with the centres and sums by class and nearest centre, combined on
the map side. Draws are hashes of the members, so they don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.vectors import unit
from ..session import discard, written
from .scoring import mean_vectors, projected

#: Centres that move less than this in all rounds' coordinates have come to rest.
REST = 1e-9


def distances(v="vec", centres="c"):
    """Squared distances of a vector from each of an array of centres."""
    return F.transform(centres, lambda x: F.aggregate(F.zip_with(v, x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def starts(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """ec, c: k members of each class (rows: ec, accession, vec) as its first centres; written. Where fewer than k members differ, some stand twice."""
    race = lambda turn: -F.ln(1 - uniform(seed, F.lit("centre"), F.lit(turn), F.col("ec"), F.col("accession")))
    found = written(rows.groupBy("ec").agg(F.array(F.min_by("vec", F.struct(race(0), "accession"))).alias("c")), "centres")
    for turn in range(1, k):
        far = rows.join(found, "ec").withColumn("far", F.array_min(distances()))
        late = F.when(F.col("far") > 0, race(turn) / F.col("far")).otherwise(F.lit(float("inf")))
        more = far.groupBy("ec").agg(F.min_by("vec", F.struct(late, "accession")).alias("next"))
        old, found = found, written(found.join(more, "ec").select("ec", F.concat("c", F.array("next")).alias("c")), "centres")
        discard(old)
    return found


def lloyd(rows: DataFrame, centres: DataFrame, width: int, rounds: int) -> DataFrame:
    """ec, c: centres (ec, c) moved to the means of what is nearest to each (the first of equally near ones), until they rest or `rounds` are over; written. A
    centre that nothing is nearest to stays."""
    for _ in range(rounds):
        d = distances()
        near = rows.join(centres, "ec").select("ec", "vec", (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("j"))
        means = near.groupBy("ec", "j").agg(*[F.avg(F.col("vec")[i]).alias(f"x{i}") for i in range(width)])
        means = means.select("ec", F.struct("j", F.array(*[f"x{i}" for i in range(width)]).alias("m")).alias("e")).groupBy("ec").agg(F.map_from_entries(F.collect_list("e")).alias("m"))  # k a class
        moved = F.transform("c", lambda x, j: F.coalesce(F.col("m")[j], x))
        step = F.aggregate(F.flatten(F.zip_with("c", moved, lambda a, b: F.zip_with(a, b, lambda p, q: F.abs(p - q)))), F.lit(0.0), lambda s, x: F.greatest(s, x))
        old, centres = centres, written(centres.join(means, "ec").select("ec", moved.alias("c"), step.alias("step")), "centres")
        discard(old)
        if centres.where(F.col("step") > REST).isEmpty():
            break
    return centres.select("ec", "c")


def sub_prototypes(vectors: DataFrame, members: DataFrame, k: int, seed: int = 0, rounds: int = 25) -> DataFrame:
    """ec, proto_id, vec, train_count: k normalised centroids of all members for each class with k members or more, else their normalised mean. Members without a vector don't count."""
    rows = members.select("ec", "accession").join(projected(vectors).select("accession", "vec"), "accession").select("ec", "accession", "vec")
    rows = written(rows, "class-vectors")
    size = written(rows.groupBy("ec").agg(F.count("*").cast("int").alias("train_count")), "class-sizes")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    large, small = (rows.join(size.where(w).select("ec"), "ec", "left_semi") for w in (F.col("train_count") >= k, F.col("train_count") < k))
    found = lloyd(large, starts(large, k, seed), width, rounds).select("ec", F.posexplode("c").alias("proto_id", "vec"))
    found = found.unionByName(mean_vectors(small, "ec").select("ec", F.lit(0).alias("proto_id"), "vec"))
    return found.join(size, "ec").select("ec", "proto_id", unit(F.col("vec")).alias("vec"), "train_count")
