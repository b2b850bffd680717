"""What text filters take, alone and one after another, from a packed bitmap index.

1. Each text is read once: its digest and the filters that it fails by itself are written.
2. Texts that come more than once give their smallest doc_id, so that the filter of repeats is one more bit;
   labels are joined by doc_id, reduced to a row each.
3. Each task keeps one bitset per part, filter and label for its rows, and walks the tree of all
   subsets of filters: what is alive after one more filter is AND-NOT of two bitsets, and a popcount
   counts it. Only these counts leave the task; Spark sums them.
4. All orders of the filters read their steps from the counts of subsets, which are 2^filters a part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, pieces, prepare, quoted, table, written

#: Fixed values of the filters: fewest words, least percentage of distinct words, largest percentage of capitals, and marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
#: Filters in the order of their bits; the last one is that of repeats.
FILTERS = "ABCDE"
#: Rows whose bitsets a task holds at a time.
ROWS = 1 << 20


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, marks."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = len(text.translate(None, bytes(range(0x80, 0xC0))))  # code points: all bytes but continuations
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * letters) << 2
        | (len(text) != len(text.translate(None, MARKS))) << 3
    )


def failed(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang; null is empty), digest and fails (bits of A to D) of every row of docs (doc_id, text, lang)."""
    prepare(docs.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text"):
                texts = as_bytes(part, "text")
                digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), digest, pa.array([failures(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "fails"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = quoted(docs, ["doc_id", "text", "lang"]).select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, fails int")


def index_counts(bits: DataFrame, filters: int, labels: int) -> DataFrame:
    """part, subset, n (array: all rows, then those with each label) of rows that fail no filter of the subset, for all subsets.
    bits: part (string), fails and marks (int: bits of filters and of labels)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def counted(names, part, fails, marks):
            for p in range(len(names)):
                own = part == p
                f, m = fails[own], marks[own]
                packed = lambda x, k: np.packbits((x >> k) & 1 > 0)
                bad = [packed(f, k) for k in range(filters)]
                rows = [np.packbits(np.ones(len(f), bool)), *[packed(m, k) for k in range(labels)]]
                stack = [(0, 0, rows)]  # subset, next filter, what is alive of all rows and of each label's
                while stack:
                    subset, k, alive = stack.pop()
                    yield names[p], subset, [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in alive]
                    stack += [(subset | 1 << j, j + 1, [x & ~bad[j] for x in alive]) for j in range(k, filters)]

        total, held, size = {}, [], 0

        def add():
            names = sorted({x for batch in held for x in batch.column("part").unique().to_pylist()})
            part = np.concatenate([pc.index_in(batch.column("part"), value_set=pa.array(names)).to_numpy() for batch in held])
            values = [np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("fails", "marks")]
            for name, subset, n in counted(names, part, *values):
                old = total.get((name, subset))
                total[name, subset] = n if old is None else [a + b for a, b in zip(old, n)]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS:
                add()
                held, size = [], 0
        if held:
            add()
        for i in range(0, len(keys := list(total)), 4096):
            some = keys[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some]), pa.array([k[1] for k in some], pa.int32()), pa.array([total[k] for k in some], pa.list_(pa.int64()))], names=["part", "subset", "n"])

    rows = bits.select("part", "fails", "marks").mapInArrow(run, "part string, subset int, n array<bigint>")
    sums = [F.sum(F.col("n")[i]) for i in range(labels + 1)]
    return rows.groupBy("part", "subset").agg(F.array(*sums).alias("n"))


def orders(filters: str) -> list[tuple[str, int, int, int]]:
    """Order, step, number of the step's filter and the subset before it, for all permutations."""
    bit = {c: i for i, c in enumerate(filters)}
    return [("".join(p), i + 1, bit[c], sum(1 << bit[x] for x in p[:i])) for p in permutations(filters) for i, c in enumerate(p)]


def steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, lost (array: a number for each label) and shapley of each step
    of each order, from the counts of all subsets: what a filter removes after a subset is the difference of two of them."""
    ways = [dict(zip(("filter_order", "step", "k", "before"), way)) for way in orders(filters)]
    lookup = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", "n"))).alias("c"))  # 2^filters numbers a part
    way = F.from_json(F.lit(json.dumps(ways)), "array<struct<filter_order:string,step:int,k:int,before:int>>")
    bit, whole = F.expr("shiftleft(1, k)"), F.lit((1 << len(filters)) - 1)
    taken = lambda before: F.zip_with(F.col("c")[before], F.col("c")[before.bitwiseOR(bit)], lambda a, b: a - b)
    each = lookup.select("part", "c", F.explode(way).alias("w")).select("part", "c", "w.*").select(
        "part",
        "filter_order",
        "step",
        "k",
        F.col("c")[F.col("before").bitwiseOR(bit)][0].alias("kept"),
        taken(F.col("before")).alias("lost"),
        taken(F.lit(0))[0].alias("failing"),
        taken(whole.bitwiseXOR(bit))[0].alias("unique_fails"),
    )
    removed = F.col("lost")[0]
    shapley = F.sum(removed).over(Window.partitionBy("part", "k"))  # a row for each order
    return each.select("part", "filter_order", "step", "kept", removed.alias("removed"), (F.col("failing") - removed).alias("redundant"), "unique_fails", F.expr("slice(lost, 2, size(lost) - 1)").alias("lost"), shapley.alias("shapley"))


def audit_bits(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E) and marks (bits: labelled of quality 1, labelled toxic) of every row of docs (doc_id, text, lang);
    labels: doc_id, quality, toxic.

    Null texts are empty, and a null lang is the part of empty strings. A row fails E if its text is that of a smaller doc_id, so rows that repeat a
    doc_id and its text don't fail by each other, and rows without a doc_id never fail it. A doc_id that labels name more
    than once has a label if any of its rows has. An empty table gives no rows.
    """
    rows = written(failed(docs), "failed-filters")
    # Written before they are joined, so that a text or doc_id with a large share of the rows can be split.
    again = written(rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("digest", "low"), "repeated-texts")
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = quoted(labels, ["doc_id", "quality", "toxic"]).where("doc_id is not null").groupBy("doc_id").agg((has("quality") + 2 * has("toxic")).alias("marks")).where("marks > 0")
    out = rows.join(again, "digest", "left").select("doc_id", "part", F.when(F.col("doc_id") > F.col("low"), F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"))
    return out.join(marks, "doc_id", "left").select("part", "fails", F.coalesce("marks", F.lit(0)).alias("marks"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (lang), order of the filters A to E and step of it. See `audit_bits` for what nulls, ties and repeated rows do."""
    found = steps(index_counts(audit_bits(docs, labels), len(FILTERS), 2))
    lost = F.col("lost")
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", lost[0].alias("good_lost"), lost[1].alias("toxic_lost"), "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marked AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), bits AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM words LEFT JOIN marked ON words.doc_id = marked.doc_id
), grouped AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY part, f
), perms AS (
  SELECT '' AS o UNION ALL SELECT o || c FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE position(c IN o) = 0
), ways AS (
  SELECT o, s, ascii(o[s]) - 64 AS k, [ascii(x) - 64 FOR x IN string_split(o[1:s - 1], '') IF x <> ''] AS before
  FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS s FROM perms WHERE length(o) = 5)
), steps AS (
  SELECT part, o AS filter_order, s::INT AS step, k,
         sum(CASE WHEN NOT f[k] AND NOT early THEN n ELSE 0 END) AS kept, sum(CASE WHEN f[k] AND NOT early THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[k] AND early THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f[k] AND len([x FOR x IN f IF x]) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN f[k] AND NOT early THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN f[k] AND NOT early THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len([x FOR x IN before IF f[x]]) > 0 AS early FROM grouped, ways) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM steps
"""
