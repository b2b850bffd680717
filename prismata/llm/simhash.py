"""SimHash near-deduplication with pigeonhole blocks.

Fingerprints of 64 bits are cut into BLOCKS blocks. Two that differ in at most RADIUS bits agree in
at least BLOCKS - RADIUS blocks, so they share one of the C(BLOCKS, BLOCKS - RADIUS) bucket keys
made of so many blocks. Equal fingerprints are joined first, so a bucket holds distinct ones only.
Buckets of more than CHUNK fingerprints are dealt into chunks, and each pair of chunks is a bucket
of its own: no task holds more than about 2 * CHUNK of them, and no link is lost.

In a bucket of up to SMALL fingerprints each pair is verified. In a larger one a search from each
fingerprint through those not yet reached verifies what connects the bucket, which gives fewer links
than fingerprints. A link is only given by the first bucket key that its ends share.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, keyed, matched_rows, pieces, prepare, row_order, table, written
from ..operators.graph import components

#: Words of a shingle, and the bits in which linked fingerprints may differ.
WORDS, RADIUS = 4, 4
#: With 7 blocks a key has 27 bits or more, in 35 tables; for more than about 10^9 distinct fingerprints take 8 (32 bits, 70 tables) or 9.
BLOCKS = 7
CHUNK, SMALL = 4096, 8
#: Rows that are looked at together.
ROWS = 50_000


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: max(1, len(words) - width + 1)].tolist()
    end = end[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(start, end)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        votes += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, own (see `own_key`), fp (bigint) of every row of docs."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), pa.array([fingerprint(x, width) for x in as_bytes(part, "text")], pa.int64())], names=["doc_id", "own", "fp"])

    return keyed(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, own bigint, fp bigint")


def masks(blocks: int, radius: int) -> list[int]:
    """The bits of each bucket key."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) of at most `radius` different bits that connect all such pairs."""
    if blocks <= radius:
        raise ValueError("pigeonhole blocks must outnumber the bits that may differ")
    spark = prints.sparkSession
    kinds = masks(blocks, radius)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(kinds)])
    rows = prints.select("fp", F.posexplode(keys).alias("t", "key"))
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "large-buckets")
    dealt = rows.join(large, "key", "left").withColumn("n", F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(F.when(F.col("n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), F.col("t").cast("int").alias("t"), "fp")
    prepare(spark)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.array(kinds, np.uint64)

        def close(x, y):
            return np.bitwise_count(x ^ y) <= radius

        def first(x, y, t):
            """Whether key t is the first that x and y share."""
            return ((((x ^ y)[:, None] & bits[None, :]) == 0).argmax(axis=1)) == t

        def verified(key, t, fp):
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(edge, len(key)))
            group = np.repeat(np.arange(len(edge)), size)
            small = np.flatnonzero(size[group] <= SMALL)
            for d in range(1, SMALL):
                i = small[small + d < len(key)]
                i = i[key[i] == key[i + d]]
                if not len(i):
                    break
                i = i[close(fp[i], fp[i + d])]
                i = i[first(fp[i], fp[i + d], t[i])]
                yield fp[i], fp[i + d]
            for g in np.flatnonzero(size > SMALL).tolist():
                rest = fp[edge[g] : edge[g] + size[g]]
                front: list = []
                while len(rest):
                    if not front:
                        front, rest = [rest[0]], rest[1:]
                    x = front.pop()
                    hit = close(rest, x)
                    new = rest[hit]
                    rest = rest[~hit]
                    front += list(new)
                    own = np.full(len(new), x, np.uint64)
                    keep = first(own, new, t[edge[g]])
                    yield own[keep], new[keep]

        def out(key, t, fp):
            for a, b in verified(key, t, fp):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def gathered():
            parts, size = [], 0
            for batch in batches:
                parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "t", "fp")])
                size += batch.num_rows
                if size >= ROWS:
                    yield [np.concatenate(x) for x in zip(*parts)]
                    parts, size = [], 0
            if parts:
                yield [np.concatenate(x) for x in zip(*parts)]

        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
        for got in gathered():
            held = [np.concatenate([x, y]) for x, y in zip(held, (got[0], got[1], got[2].view(np.uint64)))]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from out(*(x[:whole] for x in held))
            held = [x[whole:] for x in held]
        yield from out(*held)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def rooted(docs: DataFrame, width: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs' rows (doc_id, own, fp), and of each fingerprint its component: fp, low (smallest doc_id), root. Both are written."""
    prints = written(fingerprints(docs, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(written(links(distinct, radius, blocks, chunk), "links"))
    return prints, written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, width: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, component_id (the smallest doc_id that links reach).

    A-Z are lower-cased and words split at ASCII white space; a text of fewer words than a shingle is
    one shingle; null, empty and blank texts have fingerprint zero and link like any other. Equal
    fingerprints are linked. Rows that repeat a doc_id stay; a null doc_id is never a component's id
    unless the component has no other. An empty table gives no rows.
    """
    prints, joined = rooted(docs, width, radius, blocks, chunk)
    # Written first: a join with an aggregate of its own stage can't be split where many fingerprints share a root.
    names = written(joined.groupBy("root").agg(F.min("low").alias("component_id")), "component-names")
    return prints.join(written(joined.join(names, "root").select("fp", "component_id"), "names"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, all columns kept: that of the smallest doc_id, and of rows of different texts
    that share it the one with the smallest hash. Rows without a doc_id take part, after all others. Rows that repeat the doc_id and the text
    of the one that stays are the same document, and stay."""
    prints, roots = rooted(docs)
    rows = prints.select("doc_id", "own", "fp").distinct().join(roots.select("fp", "root"), "fp")
    first = written(rows.groupBy("root").agg(F.min(row_order()).alias("first")), "kept-rows")
    gone = written(rows.join(first, "root").where(row_order() != F.col("first")).select("doc_id", "own"), "dropped-rows")
    return matched_rows(docs, gone, "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
