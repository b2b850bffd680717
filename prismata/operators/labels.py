"""Cleaning, exploding and counting of coded entries (accession, ec, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..session import written


def required(df: DataFrame, *columns: str) -> DataFrame:
    """df with lower-case column names; a KeyError names what is missing."""
    df = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def normalize(df: DataFrame) -> DataFrame:
    """Drop null and empty codes, then trim (so that blank codes survive as empty ones), and make accession text."""
    df = required(df, "accession", "ec").where("ec is not null and length(ec) > 0")
    return df.withColumns({"ec": F.trim("ec"), "accession": F.col("accession").cast("string")})


def single_label(df: DataFrame) -> DataFrame:
    return df.where(~F.col("ec").contains(";"))


def explode_labels(df: DataFrame) -> DataFrame:
    """One row per code of a `;` list; codes are trimmed, empty ones go, duplicates stay."""
    return df.withColumn("ec", F.explode(codes.code_list(F.col("ec"))))


def from_source(df: DataFrame, source: str | None) -> DataFrame:
    """Rows of one source; all of them if none is asked for or there is no such column."""
    return df.where(F.col("source") == source) if source and "source" in df.columns else df


def levels(df: DataFrame, column: str = "ec_full") -> DataFrame:
    """Four more columns ec1 to ec4, padded with empty text."""
    return df.withColumns({f"ec{i}": codes.level(F.col(column), i) for i in range(1, 5)})


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ec").agg(F.count("*").alias("n_rows"), F.count_distinct("accession").alias("n_members"))


def label_sets(df: DataFrame) -> DataFrame:
    return df.groupBy("accession").agg(F.array_join(F.array_sort(F.collect_set("ec")), ";").alias("labels"), F.count_distinct("ec").alias("n_labels"))


def multilabel_stats(df: DataFrame) -> DataFrame:
    """Rows, entities, and how many of these have more than one code."""
    per = df.groupBy("accession").agg(F.count("*").alias("n"), F.count_distinct("ec").alias("k"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("unique_entities"),
        F.count_if(F.col("k") > 1).alias("multi_label"),
        F.coalesce(F.round(F.count_if(F.col("k") > 1) / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("multi_ratio"),
    )


def level_counts(df: DataFrame, column: str = "ec_full") -> DataFrame:
    """Counts at four depths in one pass: each row stands for its four ancestors."""
    rows = df.select(F.posexplode(F.array(*[codes.ancestor(F.col(column), d) for d in range(1, 5)])).alias("depth", "code"))
    return rows.groupBy((F.col("depth") + 1).alias("depth"), "code").agg(F.count("*").alias("n"))


def partial_counts(df: DataFrame, column: str = "ec") -> DataFrame:
    part = F.count_if(codes.is_partial(F.col(column)))
    return df.agg(F.count("*").alias("total"), part.alias("partial"), (F.count("*") - part).alias("complete"), F.round(part / F.nullif(F.count("*"), F.lit(0)), 6).alias("partial_ratio"))


def pivot_counts(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of all pairs of row and column values, with zeros, in long form; wide(...) makes the matrix."""
    axis = df.select(rows).distinct().crossJoin(df.select(columns).distinct())  # the table that is asked for has a cell for each pair
    seen = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    return axis.join(seen, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).alias("n"))


def wide(df: DataFrame, rows: str, columns: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns).count().na.fill(0)


def rollup_sizes(df: DataFrame) -> DataFrame:
    """Sizes of all nodes of the four-level hierarchy; depth 0 is the root."""
    return (
        df.rollup("ec1", "ec2", "ec3", "ec4")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        .select(*[F.coalesce(f"ec{i}", F.lit("*")).alias(f"ec{i}") for i in range(1, 5)], (4 - F.bit_count("g")).cast("int").alias("depth"), "n")
    )


def flow_edges(df: DataFrame) -> DataFrame:
    """Counts between adjacent levels: source node, target node, n."""
    parts = [df.groupBy(codes.node(i, F.col(f"ec{i}")).alias("src"), codes.node(i + 1, F.col(f"ec{i + 1}")).alias("dst")).agg(F.count("*").alias("n")) for i in (1, 2, 3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def node_index(edges: DataFrame) -> DataFrame:
    """Nodes numbered from 0 in order: ranges of nodes are counted first, so that no single task sorts all of them."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return numbered(nodes, "node", "idx")


def ranged(df: DataFrame, key: str, amount, name: str, inclusive: bool) -> DataFrame:
    """df with the sum (bigint) of an amount over all rows up to each one in the order of key (unique), its own included or not. Rows are
    range-partitioned, summed in their partition, and moved on by the sums of the partitions before."""
    # Written once: two plans of the ranges would sample their bounds twice and need not agree.
    taken = {c.lower() for c in df.columns}
    part, own, n, before = (next(x for x in (f"{name}{'_' * i}" for i in range(1, 99)) if x.lower() not in taken) for name in ("part", "own", "size", "before"))
    parts = written(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()).withColumn(n, amount), "ranges")
    summed = parts.withColumn(own, F.sum(n).over(Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    sizes = parts.groupBy(part).agg(F.sum(n).alias(n))  # a row per partition
    shift = sizes.select(part, (F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(before))
    total = F.col(before) + F.col(own) - (F.lit(0) if inclusive else F.col(n))
    return summed.join(F.broadcast(shift), part).withColumn(name, total.cast("bigint")).select(*df.columns, name)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a row number from 0 in the order of key (unique)."""
    return ranged(df, key, F.lit(1), name, False)


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key: that of the largest ordinal."""
    rest = [c for c in df.columns if c not in (key, ordinal)]
    return df.groupBy(key).agg(F.max(F.struct(ordinal, *rest)).alias("w")).select(key, *[F.col(f"w.{c}") for c in (ordinal, *rest)])


def first_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, ordinal)]
    return df.groupBy(key).agg(F.min(F.struct(ordinal, *rest)).alias("w")).select(key, *[F.col(f"w.{c}") for c in (ordinal, *rest)])


def length_limit(df: DataFrame, limit: int, truncate: bool = False) -> DataFrame:
    """Sequences over the limit are cut or dropped; 0 is no limit."""
    if limit <= 0:
        return df
    return df.withColumn("sequence", F.left("sequence", F.lit(limit))) if truncate else df.where(F.length("sequence") <= limit)


def length_report(wanted: DataFrame, sequences: DataFrame, limit: int) -> DataFrame:
    """Of the wanted accessions: without a sequence, over the limit, and left."""
    joined = wanted.select("accession").distinct().join(sequences.select("accession", F.length("sequence").alias("n")), "accession", "left")
    over = F.col("n") > limit
    return joined.agg(F.count("*").alias("wanted"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(over).alias("over_limit"), F.count_if(F.col("n") <= limit).alias("left_over"))


def with_default(df: DataFrame, lookup: DataFrame, column: str, default) -> DataFrame:
    """Left join by accession; `default` where the lookup has none."""
    return df.join(lookup.select("accession", column), "accession", "left").withColumn(column, F.coalesce(column, default))
