"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401

#: Rows and bytes of an Arrow batch that goes to a Python worker. A single row may be longer.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, so that a Python worker holds a few MB of text at a time. The two settings are read when
    a plan runs, which may be after its function has returned, so they stay; all operators take the same ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def sent(spark: SparkSession, thing):
    """A broadcast of an object of this package, pickled by value: executors need not have the package."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast([cloudpickle.dumps(thing)])


def received(broadcast):
    """What `sent` sent; unpickled once by each worker, and freed with the broadcast."""
    import pickle

    box = broadcast.value
    if isinstance(box[0], bytes):
        box[0] = pickle.loads(box[0])
    return box[0]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def own_key(column: str = "text"):
    """A hash of a row's text. A doc_id and this key tell rows of different texts apart, also where they share a doc_id or have none."""
    return F.xxhash64(text_or_empty(column))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and own (see `own_key`) of every row of docs."""
    return quoted(docs, ["doc_id", "text"]).select("doc_id", "text", own_key().alias("own"))


def row_order(*more: str):
    """What orders rows: by doc_id, those without one last, then by their key."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own", *more)


def matched_rows(docs: DataFrame, rows: DataFrame, how: str, *values: str) -> DataFrame:
    """docs joined by doc_id (null or not) and text with rows (doc_id, own): its own columns and, unless how is a semi or anti join, the
    values under the names that follow; the names must not be docs' own."""
    doc, own, key = fresh(docs, "row_doc", "row_own", "text_own")
    right = rows.select(F.col("doc_id").alias(doc), F.col("own").alias(own), *values)
    left = docs.withColumn(key, own_key())
    return left.join(right, F.col("`doc_id`").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(own)), how).drop(doc, own, key)


def joined_runs(rows: DataFrame, *keys: str, gap: int = 0, name: str = "runs") -> DataFrame:
    """For each group of rows (keys, top, bottom) one row with its runs as a flat array top, bottom, top, bottom, ... in order; what overlaps or is at
    most `gap` apart is one run."""
    turn = Window.partitionBy(*keys).orderBy("top", "bottom")
    before = F.max("bottom").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    run = rows.select(*keys, "top", "bottom", F.coalesce(F.col("top") > before + gap, F.lit(True)).cast("int").alias("new"))
    run = run.withColumn("run", F.sum("new").over(turn.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    lists = run.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top", "bottom"))).alias("r"))  # as many as a text has
    return lists.select(*keys, F.expr("flatten(transform(r, x -> array(x.top, x.bottom)))").alias(name))


def quoted(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns; whatever other columns are called doesn't matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def merged_runs(column: str, gap: int = 0) -> str:
    """SQL: a sorted array of struct<top, bottom> as one flat array top, bottom, top, bottom, ... of runs; those that
    overlap or are at most `gap` apart are one run."""
    kind = "cast(array() as array<int>)"
    joined = "concat(slice(s, 1, size(s) - 1), array(greatest(element_at(s, -1), x.bottom)))"
    return f"aggregate({column}, {kind}, (s, x) -> if(size(s) > 0 and x.top <= get(s, size(s) - 1) + {gap}, {joined}, concat(s, array(x.top, x.bottom))))"


def pieces(batch, column: str, limit: int = BATCH_BYTES):
    """Slices of an Arrow batch whose text column holds about `limit` bytes at most."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield batch.slice(start)


def as_bytes(batch, column: str) -> list[bytes]:
    """The column's strings as UTF-8 bytes; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    got = batch.column(column)
    return pc.fill_null(got.cast(pa.large_binary()), b"").to_pylist()


def frequent(df: DataFrame, value: str, tracked: int, most: int) -> DataFrame:
    """One row: n, the number of rows of df, and top, at most `most` of the most frequent values with upper bounds of
    their counts, from a frequent-items sketch of `tracked` counters. Sketches of tasks are merged in two steps, the first
    in as many groups as the root of the number of tasks, so that no task reads the sketches of all."""
    groups = max(1, round(df.rdd.getNumPartitions() ** 0.5))
    rows = df.select(F.expr(value).alias("v"))
    spare = df.sparkSession.range(1).select(F.lit("0").cast(rows.schema["v"].dataType).alias("v"))  # sketches of nothing can't be merged
    first = rows.unionAll(spare).groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(v, {tracked})").alias("s"))
    # Grouped by a constant: empty partitions then give no sketch, which could not be merged either.
    both = first.groupBy((F.col("g") * 0).alias("g")).agg((F.sum("n") - 1).alias("n"), F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    return both.select("n", F.expr(f"approx_top_k_estimate(s, {most})").alias("top"))
