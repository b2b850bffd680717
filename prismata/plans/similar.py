"""Queries on vectors that are near each other: links, and components."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import benchmark, graph, similar
from ..session import shared_dir
from ..sources.fixtures import sql, view
from .registry import query

T = 0.4
NEAR = {
    "links": f"SELECT a.accession AS src, b.accession AS dst, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS c FROM vectors a JOIN vectors b ON a.accession < b.accession WHERE list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) >= {T}",
    "bi": "SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links",
    "reach": "SELECT accession AS node, accession AS r FROM vectors UNION SELECT reach.node, bi.b FROM reach JOIN bi ON bi.a = reach.r",
}


@query(sql("SELECT src, dst, round(c, 6) AS similarity FROM links", "vectors", **NEAR))
def vector_edges(spark, d):
    return similar.vector_edges(view(spark, d, "vectors"), T).withColumn("similarity", F.round("similarity", 6))


@query(sql("SELECT node, min(r) AS cluster_id FROM reach GROUP BY 1", "vectors", **NEAR))
def vector_components(spark, d):
    """Clusters of vectors, by as many links as connect them; cells are small here, so that some are left out by their angles."""
    return clusters(view(spark, d, "vectors"), T, cells=8)


def clusters(vectors, t, **how):
    links = similar.vector_edges(vectors, t, spanning=True, **how)
    return graph.clusters(vectors.select(F.col("accession").alias("node")), links)


@query()
def identity_benchmark(spark, d):
    """The benchmark over folds of similar vectors: prototypes, calibration and scores for each fold, from stored folds and records."""
    v = view(spark, d, "vectors")
    members = view(spark, d, "vec_labels").select("ec", "accession").distinct()
    config = {"cutoffs": [100 * T], "folds": 2, "temperature": 0.1, "stratify": "full", "taus": [0.5, 0.6, 0.7, 0.8, 0.9], "per_class": {"mode": "max_f1", "shrink": 5.0}}
    found = benchmark.identity_benchmark(spark, f"{shared_dir(spark)}/identity-benchmark-{uuid.uuid4().hex}", v, members, lambda t: clusters(v, t), config)
    value = lambda name: F.round(F.col("metrics")[name], 4).alias(name)
    return found.select("cutoff", "fold", F.col("label_stats.entities").alias("entities"), *map(value, ("tau_multi", "micro_f1", "macro_f1", "acc_top1_hit", "coverage")))
