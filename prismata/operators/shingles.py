"""Word shingles of texts as packed hashes, and an inverted index of those that more texts have.

A shingle is as many words as it is wide, cut at single spaces, as a 64-bit hash. Hashes are never rows: an Arrow batch sends each bucket of hashes
one binary value, in which the differences of sorted numbers stand plane by plane and compressed. Buckets are ranges of hashes, so that what a difference takes
depends on how many hashes are sent together and not on the number of buckets. A bucket counts the classes of each hash and sends those that more than one
has, by numbers that take less room than hashes, to their classes' buckets. Buckets hold GRAMS shingles on average, and a hash's classes meet in one of them only to be counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Shingles of a bucket on average, buckets of hashes of a task and of a bucket of classes, shingles that a task gathers before it sends them, and bytes of text that are looked at together.
GRAMS, TOGETHER, SENT, PART = 1 << 19, 4, 1 << 21, 1 << 20
#: Bits of the filter that tells which texts need not meet their class's key. Where it is full, more texts are moved, and nothing else.
BITS = 1 << 23


def tools(width: int):
    """Functions for tasks, sent by value: the shingles of texts, and packed numbers."""

    def mixed(h):
        import numpy as np

        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def hashed(texts):
        """text number and hash of each different shingle of the texts (bytes), in order."""
        import numpy as np

        count = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        end = np.flatnonzero(data == 32)
        start = np.append(0, end[:-1] + 1)
        power, back = (np.full(len(data) + 1, x, np.uint64) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
        power[0] = back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        word = mixed((total[end] - total[start]) * back[start])
        h = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            h = mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : len(word) - width + 1 + k] + np.uint64(k + 1))
        text = np.repeat(np.arange(len(texts)), count)
        last = np.repeat(np.cumsum(count), count)
        at = np.flatnonzero(np.arange(len(word)) + width <= last)
        text, h = text[at], h[at]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        return text[new], h[new]

    def parts(batch):
        """Slices of a batch of about PART bytes of text, and the texts' bytes."""
        import pyarrow as pa

        texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PART):
                size += len(texts[stop])
                stop += 1
            yield batch.slice(at, stop - at), texts[at:stop]
            at = stop

    def packed(*numbers):
        """The first numbers are sorted, and sent as differences."""
        import numpy as np
        import pyarrow as pa

        first = numbers[0].astype(np.uint64)
        first[1:] -= numbers[0][:-1]
        planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T.tobytes() for x in (first, *numbers[1:]))
        return len(first).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)

    def unpacked(blob, columns):
        import numpy as np
        import pyarrow as pa

        size = int.from_bytes(blob[:4], "little")
        planes = np.frombuffer(pa.decompress(blob[4:], columns * 8 * size, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, size)
        first, *rest = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in planes]
        return [np.cumsum(first, dtype=np.uint64), *rest]

    def dealt(to, *numbers):
        """bucket and packed numbers of each bucket that something goes to."""
        import numpy as np

        order = np.argsort(to, kind="stable")
        to, numbers = to[order], [x[order] for x in numbers]
        edge = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
        return to[edge].tolist(), [packed(*(x[a:b] for x in numbers)) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(to)])]

    return hashed, parts, unpacked, dealt


def bounded(df: DataFrame) -> DataFrame:
    """df, for Arrow batches of a few MB."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def sized(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (SHA-256 of the set), n of each text that has shingles."""
    hashed, parts, _, _ = tools(width)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in parts(batch):
                text, h = hashed(texts)
                n = np.bincount(text, minlength=len(texts))
                end = np.cumsum(n)
                some = np.flatnonzero(n)
                keys = [hashlib.sha256(h[end[i] - n[i] : end[i]].tobytes()).digest() for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(keys, pa.binary()), pa.array(n[some].astype(np.int32))], names=["doc_id", "key", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInArrow(run, f"doc_id {kind}, key binary, n int")


def spot(bits: int):
    """A doc_id's place in the filter, from 1 on."""
    return (F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1).alias("spot")


def repeated(rows: DataFrame) -> bytes:
    """The filter: a set bit for each doc_id of `sized` rows that has another row, or whose key has. It reaches the driver and takes BITS bits at most."""
    import numpy as np

    keys = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    # Written by itself, so that the join can be split where many texts have a key.
    held = written(rows.join(keys, "key").select("doc_id"), "repeated-texts").unionAll(rows.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"))
    parts = held.select(spot(BITS)).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    out = np.zeros((-(-BITS // 32768), 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def shared(docs: DataFrame, firsts: DataFrame, width: int, total: int, marks: bytes, similar: float = 0.0) -> DataFrame:
    """class, n, g of the texts that firsts (class, key, n) name by doc_id and key, once each: g are those shingles that other classes have too, as an array of
    struct<df, h> from the rarest on, df counting classes, h a number for each shingle. Classes without any, or with fewer than `similar` of their shingles, are left
    out. total: the shingles of all texts, by which buckets are numbered. marks: the filter of `repeated`; texts that it doesn't hold are classes of their own and stay
    where they are read, and only the others move to meet their class's key."""
    hashed, parts, unpacked, dealt = tools(width)
    buckets, sent, bits = max(1, total // GRAMS), SENT, BITS
    ends = max(1, buckets // TOGETHER)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // TOGETHER)
    kind = "to bigint, blob binary"

    def table(to, blobs):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=["to", "blob"])

    def marked(batch):
        """Which rows of a batch the filter holds."""
        import numpy as np

        at = batch.column("spot").to_numpy() - 1
        return np.frombuffer(marks, np.uint8)[at >> 3] >> (at & 7) & 1 == 1

    def held_rows(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(marked(batch))).select(["doc_id", "text", "key"])

    def by_hashes(hs, cs):
        import numpy as np

        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.argsort(h)
        return table(*dealt(((h[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), h[order], c[order]))

    def single(batches):
        """The shingles of texts that are classes of their own, by buckets of hashes."""
        import numpy as np
        import pyarrow as pa

        hs, cs, held = [], [], 0
        for batch in batches:
            for part, texts in parts(batch.filter(pa.array(~marked(batch)))):
                text, h = hashed(texts)
                hs.append(h)
                cs.append(part.column("doc_id").cast(pa.int64()).to_numpy()[text].view(np.uint64))
                held += len(h)
                if held >= sent:
                    yield by_hashes(hs, cs)
                    hs, cs, held = [], [], 0
        if held:
            yield by_hashes(hs, cs)

    def posted(batches):
        """The shingles of each class, by buckets of hashes. A class's row with the key comes before the texts of that doc_id."""
        import hashlib

        import numpy as np
        import pyarrow.compute as pc

        asked, hs, cs, held = (None, None), [], [], 0
        for batch in batches:
            for part, texts in parts(batch):
                ids, keys, texted = part.column("doc_id").to_pylist(), part.column("key").to_pylist(), pc.is_valid(part.column("text")).to_pylist()
                text, h = hashed(texts)
                end = np.cumsum(np.bincount(text, minlength=len(texts)))
                for i, (doc, key) in enumerate(zip(ids, keys)):
                    if not texted[i]:
                        asked = (doc, key)
                        continue
                    own = h[end[i - 1] if i else 0 : end[i]]
                    if asked[0] == doc and len(own) and hashlib.sha256(own.tobytes()).digest() == asked[1]:
                        asked = (None, None)  # a row that repeats it counts once
                        hs.append(own)
                        cs.append(np.full(len(own), doc, np.int64).view(np.uint64))
                        held += len(own)
                if held >= sent:
                    yield by_hashes(hs, cs)
                    hs, cs, held = [], [], 0
        if held:
            yield by_hashes(hs, cs)

    def counted(batches):
        """Of each bucket the shingles of two classes or more, by buckets of classes. A shingle's number is its place in its bucket, times the buckets, and the bucket."""
        import numpy as np

        def kept(at, blobs):
            h, c = (np.concatenate(x) for x in zip(*(unpacked(b, 2) for b in blobs)))
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            df = np.diff(np.append(first, len(h)))
            place = np.cumsum(df > 1) - 1
            keep = np.repeat(df > 1, df)
            return c[keep].view(np.int64), (np.repeat(place, df)[keep] * buckets + at).astype(np.uint64), np.repeat(df, df)[keep].astype(np.uint64)

        def out(some):
            c, x, df = (np.concatenate(y) for y in zip(*some))
            to = c % ends
            order = np.lexsort((x, c, to))
            return table(*dealt(to[order], (c[order] // ends).view(np.uint64), x[order], df[order]))

        at, blobs, some, held = None, [], [], 0
        for batch in batches:
            for to, blob in zip(batch.column("to").to_pylist(), batch.column("blob").to_pylist()):
                if to != at:
                    if blobs:
                        some.append(kept(at, blobs))
                        held += len(some[-1][0])
                    at, blobs = to, []
                    if held >= sent:
                        yield out(some)
                        some, held = [], 0
                blobs.append(blob)
        if blobs:
            some.append(kept(at, blobs))
        if some:
            yield out(some)

    def gathered(batches):
        """The classes of each bucket, with their sizes."""
        import numpy as np
        import pyarrow as pa

        def out(at, sizes, blobs):
            c, h, df = (np.concatenate(x) for x in zip(*(unpacked(b, 3) for b in blobs)))
            c = c.view(np.int64) * ends + at
            order = np.lexsort((h.view(np.int64), df, c))
            c, h, df = c[order], h[order].view(np.int64), df[order].astype(np.int32)
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)])
            count = np.diff(np.append(first, len(c)))
            enough = count >= similar * np.array([sizes[x] for x in c[first].tolist()]) - 1e-6
            keep = np.repeat(enough, count)
            c, h, df = c[keep], h[keep], df[keep]
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)])
            for i in range(0, len(first), 500):
                some = first[i : i + 500]
                edge = np.append(some, first[i + 500] if i + 500 < len(first) else len(c))
                a, b = int(edge[0]), int(edge[-1])
                g = pa.ListArray.from_arrays(pa.array(edge - a, pa.int32()), pa.StructArray.from_arrays([pa.array(df[a:b]), pa.array(h[a:b])], names=["df", "h"]))
                yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array([sizes[x] for x in c[some].tolist()], pa.int32()), g], names=["class", "n", "g"])

        at, sizes, blobs = None, {}, []
        for batch in batches:
            for to, c, n, blob in zip(*(batch.column(x).to_pylist() for x in ("to", "class", "n", "blob"))):
                if to != at:
                    if blobs:
                        yield from out(at, sizes, blobs)
                    at, sizes, blobs = to, {}, []
                if blob is None:
                    sizes[c] = n
                else:
                    blobs.append(blob)
        if blobs:
            yield from out(at, sizes, blobs)

    read = docs.where("doc_id is not null and text is not null")
    own = bounded(read.select("doc_id", "text", spot(bits))).mapInArrow(single, kind)
    texts = read.select("doc_id", "text", F.lit(None).cast("binary").alias("key"), spot(bits))
    asked = firsts.select(F.col("class").alias("doc_id"), F.lit(None).cast("string").alias("text"), "key").withColumn("spot", spot(bits))
    met = texts.unionByName(asked).mapInArrow(held_rows, texts.drop("spot").schema).repartition(tasks, "doc_id").sortWithinPartitions("doc_id", F.col("key").isNull())
    by_hash = own.unionAll(met.mapInArrow(posted, kind)).repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(counted, kind)
    sizes = firsts.select(F.pmod("class", F.lit(ends)).cast("bigint").alias("to"), "class", "n", F.lit(None).cast("binary").alias("blob"))
    both = sizes.unionByName(by_hash.select("to", F.lit(None).cast("bigint").alias("class"), F.lit(None).cast("int").alias("n"), "blob"))
    return both.repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(gathered, "class bigint, n int, g array<struct<df:int,h:bigint>>")
