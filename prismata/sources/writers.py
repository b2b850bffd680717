"""Text sinks. Each writes a folder of part files through Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def split_lists(members: DataFrame, path: str) -> None:
    """JSON lines of classes with their members, both in order."""
    members.groupBy("ec").agg(F.array_sort(F.collect_list("accession")).alias("accessions")).orderBy("ec").write.mode("overwrite").json(path)


def wrapped(sequence: Column, width: int = 80) -> Column:
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "accession", F.lit("\n"), wrapped(F.col("sequence"))).alias("value")).write.mode("overwrite").text(path)


def cluster_map(df: DataFrame, path: str) -> None:
    df.select("accession", "cluster_id").write.mode("overwrite").option("sep", "\t").csv(path)


def documents(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def vectors(df: DataFrame, path: str) -> None:
    df.select("accession", F.col("vec").cast("array<float>").alias("vec")).orderBy("accession").write.mode("overwrite").parquet(path)


def cache(rows: DataFrame, path: str, fetched_at: Column) -> None:
    """Rows by class, and when they were fetched; only classes among the rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ec").parquet(f"{path}/rows")
    rows.groupBy("ec").agg(F.count("*").alias("row_count")).withColumn("fetched_at", fetched_at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ec").parquet(f"{path}/meta")


def csv(df: DataFrame, path: str, *order: str) -> None:
    """A CSV with a header, in order, such as class counts or a sampler's usage."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def bank(prototypes: DataFrame, path: str) -> None:
    """Prototypes (ec, proto_id, vec, train_count), one row each."""
    prototypes.select("ec", F.col("proto_id").cast("int"), F.col("vec").cast("array<float>"), F.col("train_count").cast("int")).write.mode("overwrite").parquet(path)


def projection(weights, bias, path: str, spark) -> None:
    """An affine projection: a row for each output number, with its weights and its bias."""
    rows = [(i, [float(x) for x in w], float(b)) for i, (w, b) in enumerate(zip(weights, bias))]
    spark.createDataFrame(rows, "row int, weights array<double>, bias double").coalesce(1).write.mode("overwrite").parquet(path)


def appended(new: DataFrame, path: str, to: str) -> None:
    """The union of the table at path and new rows, by column names (a column that one of them lacks is null there), as a new table."""
    old = new.sparkSession.read.parquet(path)
    old.unionByName(new, allowMissingColumns=True).write.mode("errorifexists").parquet(to)


def status_line(ts: Column, fields: Column) -> Column:
    """A `ts key=value key=value ...` line of a map, by key; white space in values becomes `_`."""
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(F.coalesce(e["value"], F.lit("")), "\\s", "_")))
    return F.concat_ws(" ", ts, pairs)


def status(lines: DataFrame, path: str) -> None:
    """Append lines (line) to a status log, a folder of text files; writers that run at once add files of their own."""
    lines.select("line").write.mode("append").text(path)
