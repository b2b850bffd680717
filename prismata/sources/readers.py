"""Text sources as DataFrames: TSV, FASTA, split lists, cluster maps, JSON documents, caches, status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import first_filled
from ..operators.labels import ranged


def tsv(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """A TSV with a header, all columns text; `NA` and empty cells are null. columns: a schema, else the header's names."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").option("quote", "")
    return (reader.schema(columns) if columns else reader).csv(path)


def lookup(df: DataFrame, ordinal: str, key: str = "accession", value: str = "sequence") -> DataFrame:
    """key and value of the last row of each key (the largest ordinal), without blank ones."""
    rows = df.where((F.trim(key) != "") & (F.trim(value) != ""))
    return rows.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def header_id(header: Column) -> Column:
    """The identifier of a FASTA header (without `>`): its second `|` field, else its first word."""
    return F.coalesce(F.nullif(F.get(F.split(header, "\\|"), F.lit(1)), F.lit("")), F.regexp_extract(header, "^(\\S+)", 1))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, sequence: records begin at `>`; a record without letters is left out. One row is one record, so files are split anywhere."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    head = F.substring_index("r", "\n", 1)
    body = F.when(F.contains("r", F.lit("\n")), F.regexp_replace(F.expr("substr(r, instr(r, '\n') + 1)"), "\\s", "")).otherwise("")
    return rows.select(header_id(head).alias("accession"), body.alias("sequence")).where("sequence != '' and accession != ''")


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """ec, accession from JSON lines of {"ec": ..., "accessions": [...]}."""
    return spark.read.schema("ec string, accessions array<string>").json(path).select("ec", F.explode("accessions").alias("accession"))


def cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """accession, cluster_id from a TSV without header; short and blank lines are skipped."""
    return spark.read.option("sep", "\t").schema("accession string, cluster_id string").csv(path).where("accession is not null and cluster_id is not null")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def vector_width(vectors: DataFrame) -> int:
    """The width of all vectors; an error if they differ."""
    low, high = vectors.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers")
    return low or 0


def matrix(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """accession, vec of a table of vectors; an error if a key or a vector is missing, a key stands twice, or widths differ."""
    rows = spark.read.parquet(path).select("accession", "vec")
    n, keys, distinct, vecs, low, high = rows.agg(F.count("*"), F.count("accession"), F.count_distinct("accession"), F.count("vec"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not n == keys == distinct == vecs:
        raise ValueError(f"{n} rows with {keys} keys ({distinct} different) and {vecs} vectors")
    if low != high or width not in (None, low):
        raise ValueError(f"vectors of {low} to {high} numbers")
    return rows


def bank(spark: SparkSession, path: str) -> DataFrame:
    """ec, proto_id, vec, train_count of a stored bank; rows without a vector are left out."""
    return spark.read.parquet(path).where("size(vec) > 0").select("ec", "proto_id", F.col("vec").cast("array<double>").alias("vec"), "train_count")


def ragged(flat: DataFrame, counts: DataFrame) -> DataFrame:
    """ec, proto_id, vec from rows that are laid one after the other (at, vec) and how many each class has (ec, n; in order of ec).
    Classes without rows are left out."""
    own = ranged(counts.where("n > 0"), "ec", F.col("n"), "end", True).select("ec", F.posexplode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("proto_id", "at"))
    return own.join(flat, "at").select("ec", "proto_id", "vec")


def projection(spark: SparkSession, path: str) -> tuple[list[list[float]], list[float]]:
    """Weights and bias of a stored projection, which has a row for each output number."""
    rows = spark.read.parquet(path).orderBy("row").collect()
    if [r.row for r in rows] != list(range(len(rows))):
        raise ValueError("the projection lacks rows")
    return [list(r.weights) for r in rows], [r.bias for r in rows]


def config(spark: SparkSession, path: str) -> dict:
    """Settings from a YAML file (or JSON, which YAML includes) in any store that Spark reads."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def cached(rows: DataFrame, meta: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows (ec, ...) whose class was fetched (ec, fetched_at) at most so many days before now; with 0 days or fewer they never expire."""
    fresh = meta if days <= 0 else meta.where(F.col("fetched_at") >= now - F.make_interval(days=F.lit(days)))
    return rows.join(fresh.select("ec", "fetched_at"), "ec")


def status(lines: DataFrame) -> DataFrame:
    """line_no, fields (a map) of `ts key=value key=value ...` lines; text without `=` is left out. A value is all behind
    the first `=`; of a repeated key the last value holds."""
    words = F.filter(F.split(F.trim("line"), "\\s+"), lambda w: F.contains(w, F.lit("=")))
    key = lambda w: F.substring_index(w, "=", 1)
    rows = lines.select("line_no", words.alias("w")).select("line_no", "w", F.array_distinct(F.transform("w", key)).alias("k"))
    last = F.transform("k", lambda k: F.element_at(F.filter("w", lambda w: key(w) == k), -1))
    values = F.zip_with(last, "k", lambda w, k: F.substring(w, F.length(k) + 2, F.length(w)))
    return rows.select("line_no", F.map_from_arrays("k", values).alias("fields"))


def next_link(header: Column) -> Column:
    """The target of rel="next" in an HTTP Link header; null if there is none."""
    return F.nullif(F.regexp_extract(header, '<([^>]*)>;\\s*rel="next"', 1), F.lit(""))


def joined_entries(table: DataFrame, sequences: DataFrame) -> DataFrame:
    """Entries with the first filled of the usual names of each column, and their sequences; those without are left out."""
    names = {"accession": ("accession", "entry"), "ec": ("ec", "ec number"), "protein_name": ("protein_name", "protein names"), "taxon_id": ("taxon_id", "taxon id", "organism_id", "taxonomic identifier"), "organism_name": ("organism_name", "organism"), "length": ("length",)}
    table = table.toDF(*[c.lower() for c in table.columns])
    found = {k: [F.col(f"`{c}`") for c in v if c in table.columns] for k, v in names.items()}
    rows = table.select(*[(first_filled(*c) if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])
    return rows.where("accession is not null").join(sequences, "accession")
