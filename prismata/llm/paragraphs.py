"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, components.

Passages repeat inside lines and across them, so paragraphs are cut by content: one of LENGTH words starts at the
document's first word and at each word where the hash of three words is less than those of the SPREAD words
before it and not more than those of the SPREAD words after it. Equal passages have equal paragraphs, wherever they
stand; two paragraphs of one document start more than SPREAD words apart, so they overlap but are never similar by that.
Such starts leave gaps. The query leaves none: paragraphs fill them (`covered`), and `windows` compares every window for equality.

1. Mappers make each paragraph's digest and the keys of its MinHash bands from whole texts, and send packed
   records (key, digest, place) to the key's bucket; of equal paragraphs of a batch only the first is sent.
2. In a bucket, equal paragraphs of a key are one class, whose first place stands for all. Keys of two classes
   or more are kept. Keys that more than CHUNK classes share are dealt into pairs of chunks, so that no
   task holds more than about 2 * CHUNK of them and no pair is lost.
3. Only classes that share a key get their shingle sets, from whole texts. In each bucket a search from
   each class through those not yet reached verifies the exact Jaccard similarity.
4. Verified links make components; the first paragraph of a component (smallest doc_id, then place) stays.

Bands are tuned by `tuned`: the most rows per band for which a paragraph at the threshold is missed with a
chance of at most 1 - RECALL, within HASHES hash functions. Equal paragraphs are never missed, and a passage of
over 50 words mostly holds two paragraphs or more, so that a near copy of it has more than one chance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import as_bytes, fresh, joined_runs, keyed, matched_rows, own_key, pieces, prepare, table, written

#: Words of a shingle, and the least Jaccard similarity of shingle sets that links paragraphs.
WORDS, SIMILAR = 5, 0.8
#: Chance that a paragraph at the threshold shares a band, and the most hash functions.
RECALL, HASHES = 0.98, 8
#: Most bands; a key's lowest bits are its band's number.
BANDS = 8
#: Words of a paragraph, and how many words before and after its start that start is compared with.
LENGTH, SPREAD = 20, 8
#: Classes of a chunk, and sets of a bucket that are compared without postings.
CHUNK, FEW = 1024, 12
#: Records of a bucket, buckets of a task, and bytes of text that are looked at together.
BUCKET, TOGETHER, PART = 50_000, 8, 4 << 20
RECORD = [("key", "<u8"), ("pid", "<u8"), ("doc", "<i8"), ("own", "<i8"), ("start", "<i4"), ("n", "<i4")]
#: In a record's start: the batch that it comes from has more of the same paragraph.
MORE = -(1 << 31)
#: A-Z to a-z, ASCII white space to spaces.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def tuned(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands, and rows of a band."""
    for rows in range(hashes, 0, -1):
        p = similar**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= hashes and bands <= BANDS:
            return bands, rows
    raise ValueError("not enough hash functions for this recall")


def mixed(h):
    import numpy as np

    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def hashed_words(texts: list[bytes]):
    """For all texts one after the other: hash, first byte and end of each word, and how many each text has.
    A word's hash is that of a polynomial of its bytes in powers of an odd number, taken from sums over all bytes."""
    import numpy as np

    size = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts).translate(TO_WORDS) + b" ", np.uint8)
    black = np.concatenate([[False], data != 32, [False]])
    turn = np.flatnonzero(black[1:] != black[:-1])
    start, end = turn[::2], turn[1::2]
    power = np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = mixed((total[end] - total[start]) * back[start])
    edge = np.cumsum(size)
    count = np.diff(np.concatenate([[0], np.searchsorted(start, edge)]))
    return h, start, end, count, edge - size


def sliding(v, n: int):
    """The least of each n neighbours."""
    import numpy as np

    span = 1
    while 2 * span <= n:
        v, span = np.minimum(v[: len(v) - span], v[span:]), 2 * span
    return np.minimum(v[: len(v) - (n - span)], v[n - span :]) if n > span else v


def shingled(word, width: int = WORDS):
    """The hash of each `width` words from a word on; word must be that much longer than what is asked for."""
    import numpy as np

    h = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : len(word) - width + 1 + k]
    return mixed(h)


def covered(at, count):
    """Starts `at` with more of them: between starts over LENGTH words apart others are spread evenly, and after a text's last one a paragraph follows the other while
    they have room. So all words of a text of LENGTH words are in paragraphs, but for fewer than LENGTH at its end: a paragraph that ended with the
    text would be similar to one of a copy that is a word shorter, and that word would go. Starts stay at least SPREAD words apart."""
    import numpy as np

    text = np.repeat(np.arange(len(count)), count)[at]
    inner = np.append(text[1:] == text[:-1], False)[: len(at)]
    gap = np.append(at[1:], 0)[: len(at)] - at
    more = np.where(inner, np.maximum(gap - 1, 0) // LENGTH, (np.cumsum(count)[text] - at) // LENGTH - 1)
    gap = np.where(inner, gap, LENGTH * (more + 1))
    turn = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.union1d(at, np.repeat(at, more) + np.repeat(gap, more) * turn // np.repeat(more + 1, more))


def starts(word, count, every: bool = False):
    """The words at which paragraphs start; with `every` more of them, as many as fill the gaps (see `covered`)."""
    import numpy as np

    first = np.cumsum(count) - count
    end = np.repeat(first + count, count)
    lead = np.repeat(first, count)
    at = np.arange(len(word))
    g = shingled(np.append(word, np.zeros(2, np.uint64)), 3)
    wide = np.concatenate([np.full(SPREAD, np.iinfo(np.uint64).max), g, np.full(SPREAD, np.iinfo(np.uint64).max)])
    low = sliding(wide, SPREAD)
    chosen = (g < low[: len(g)]) & (g <= low[SPREAD + 1 : SPREAD + 1 + len(g)]) & (at - lead >= SPREAD) | (at == lead)
    found = np.flatnonzero(chosen & (at + LENGTH <= end))
    return covered(found, count) if every else found


def digests(word, at):
    """The digests of the paragraphs from word `at` on."""
    import numpy as np

    pid = np.zeros(len(at), np.uint64)
    for k in range(LENGTH):
        pid = pid * np.uint64(0xD6E8FEB86659FD93) + word[at + k]
    return mixed(pid)


def paragraphs(texts: list[bytes], bands: int, rows: int, every: bool = False):
    """text number, first byte, bytes, digest and band keys of each paragraph of the texts."""
    import numpy as np

    word, start, end, count, base = hashed_words(texts)
    at = starts(word, count, every)
    text = np.repeat(np.arange(len(texts)), count)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros((0, bands), np.uint64)
    h = shingled(np.append(word, np.zeros(LENGTH, np.uint64)))
    m = LENGTH - WORDS + 1
    turn = np.random.default_rng(20240229)
    odd = turn.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = turn.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    keys = np.zeros((len(at), bands), np.uint64)
    for i in range(bands * rows):
        v = h * odd[i] + add[i]
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x94D049BB133111EB)
        keys[:, i // rows] = (keys[:, i // rows] + sliding(v, m)[at] + np.uint64(i + 1)) * np.uint64(0x2545F4914F6CDD1D)
    keys = mixed(keys) & np.uint64(~(BANDS - 1) & (1 << 64) - 1) | np.arange(bands, dtype=np.uint64)[None, :]
    return text[at], start[at] - base[text[at]], end[at + LENGTH - 1] - start[at], digests(word, at), keys


def firsts(r):
    """records, sorted by key and digest, of which the first place of each pair stays; and those that repeat it."""
    import numpy as np

    r = r[np.lexsort((r["start"] & 0x7FFFFFFF, r["own"], r["doc"], r["pid"], r["key"]))]
    new = np.append(True, (r["key"][1:] != r["key"][:-1]) | (r["pid"][1:] != r["pid"][:-1])) if len(r) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    more = np.zeros(len(at), bool)
    np.logical_or.at(more, group, r["start"] < 0)
    first = r[at].copy()
    first["start"] &= 0x7FFFFFFF
    late = r[~new].copy()
    late["start"] &= 0x7FFFFFFF
    apart = (late["doc"] != first["doc"][group[~new]]) | (late["own"] != first["own"][group[~new]]) | (late["start"] != first["start"][group[~new]])  # not a row that stands twice
    np.logical_or.at(more, group[~new][apart], True)
    return first, late[apart], more


def sent_records(docs: DataFrame, bands: int, rows: int, buckets: int, every: bool = False) -> DataFrame:
    """bucket, records, late: packed records for each bucket, and of each batch the paragraphs that repeat an earlier one of it (none with `every`)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch.filter(batch.column("doc_id").is_valid()), "text", PART):
                ids, owns = (part.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("doc_id", "own"))
                text, start, n, pid, keys = paragraphs(as_bytes(part, "text"), bands, rows, every)
                whole = np.zeros(len(pid), RECORD)
                whole["pid"], whole["doc"], whole["own"], whole["start"], whole["n"] = pid, ids[text], owns[text], start, n
                one, late, more = firsts(whole)  # by digest alone: the key is 0
                one["start"] |= np.where(more, MORE, 0).astype(np.int32)
                key = keys[np.argsort(pid, kind="stable")][np.searchsorted(np.sort(pid), one["pid"])]
                r = np.repeat(one, bands)
                r["key"] = key.ravel()
                bucket = (r["key"] // np.uint64(BANDS) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                r, bucket = r[order], bucket[order]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(r) else np.zeros(0, np.int64)
                blobs = [r[a:b].tobytes() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(r)])]
                own = [*bucket[edge].tolist(), int(ids[0]) % buckets if len(ids) else 0]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([*blobs, b""], pa.binary()), pa.array([*[b""] * len(blobs), b"" if every else late.tobytes()], pa.binary())], names=["bucket", "records", "late"])

    return docs.mapInArrow(run, "bucket bigint, records binary, late binary")


def classed(sent: DataFrame, buckets: int, every: bool = False) -> DataFrame:
    """pid, key, doc_id, own, start, n: paragraphs that stand more than once (key null; none with `every`), and the first of each class of a key that more classes share."""
    spark = prepare(sent.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(r, keyed):
            kind = [pa.array(r[c].copy().view(t)) for c, t in (("pid", np.int64), ("doc", np.int64), ("own", np.int64), ("start", np.int32), ("n", np.int32))]
            key = pa.array(r["key"].copy().view(np.int64)) if keyed else pa.nulls(len(r), pa.int64())
            return pa.RecordBatch.from_arrays([kind[0], key, *kind[1:]], names=["pid", "key", "doc_id", "own", "start", "n"])

        def out(blobs):
            first, late, more = firsts(np.frombuffer(b"".join(blobs), RECORD))
            if not len(first):
                return
            if not every:
                yield batch_of(late[late["key"] % np.uint64(BANDS) == 0], False)  # equal ones share all their keys
                yield batch_of(first[more & (first["key"] % np.uint64(BANDS) == 0)], False)
            new = np.append(True, first["key"][1:] != first["key"][:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(first)))
            yield batch_of(first[np.repeat(size, size) > 1], True)

        at, blobs = None, []
        for batch in batches:
            for bucket, records, late in zip(*(batch.column(c).to_pylist() for c in ("bucket", "records", "late"))):
                if bucket != at:
                    yield from out(blobs)
                    at, blobs = bucket, []
                blobs.append(records)
                if late:
                    yield batch_of(np.frombuffer(late, RECORD), False)
        yield from out(blobs)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // TOGETHER)
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "pid bigint, key bigint, doc_id bigint, own bigint, start int, n int")


def dealt(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """bucket, pid: rows (key, pid), where keys of many classes are dealt into pairs of chunks."""
    size = written(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > chunk), "large-keys")
    out = rows.join(size, "key", "left").withColumn("chunks", F.ceil(F.coalesce("size", F.lit(1)) / chunk).cast("int"))
    out = out.withColumn("own", F.pmod(F.xxhash64("pid"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.select(F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("bucket"), "pid")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pid, hashes: the shingle sets of wanted (pid, doc_id, own, start, n), from docs' (`keyed`) whole texts."""
    joined = docs.join(wanted.groupBy("doc_id", "own").agg(F.collect_list(F.struct("pid", "start", "n")).alias("_wanted")), ["doc_id", "own"]).select("text", "_wanted")
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text", PART):
                pids, cut = [], []
                for text, own in zip(as_bytes(part, "text"), part.column("_wanted").to_pylist()):
                    for x in own:
                        pids.append(x["pid"])
                        cut.append(text[x["start"] : x["start"] + x["n"]])
                if cut:
                    word, _, _, count, _ = hashed_words(cut)
                    h = shingled(np.append(word, np.zeros(WORDS, np.uint64))).view(np.int64)
                    first = np.cumsum(count) - count
                    found = np.flatnonzero(count == LENGTH)
                    sets = [np.unique(h[a : a + LENGTH - WORDS + 1]) for a in first[found].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(pids, np.int64)[found]), pa.array(sets, pa.list_(pa.int64()))], names=["pid", "hashes"])

    return joined.mapInArrow(run, "pid bigint, hashes array<bigint>").dropDuplicates(["pid"])


def verified(members: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b: links between members (bucket, pid, hashes) of the same bucket that connect all pairs of enough similarity.
    A set has LENGTH - WORDS + 1 hashes at most and a bucket 2 * CHUNK sets or so, which bounds what a task holds."""
    prepare(members.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def few(sets):
            """Links in a bucket of a few sets: pairs of their numbers."""
            sets = [set(x.tolist()) for x in sets]
            rest, front = list(range(len(sets))), []
            while rest:
                x = front.pop() if front else rest.pop()
                for y in rest:
                    if (both := len(sets[x] & sets[y])) >= similar * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                        yield x, y
                        front.append(y)
                rest = [y for y in rest if y not in front]

        def many(sets):
            """The same through postings: those of a set's hashes tell how many it has in common with every other."""
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            number = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
            owner = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(number, kind="stable")
            post = np.split(owner[order], np.cumsum(np.bincount(number))[:-1])
            own = np.split(number, np.cumsum(size)[:-1])
            left, front, seed = np.ones(len(sets), bool), [], 0
            while True:
                if not front:
                    while seed < len(sets) and not left[seed]:
                        seed += 1
                    if seed == len(sets):
                        return
                    left[seed] = False
                    front.append(seed)
                x = front.pop()
                both = np.bincount(np.concatenate([post[k] for k in own[x].tolist()]), minlength=len(sets))
                near = np.flatnonzero(left & (both >= similar * (size[x] + size - both) - 1e-9))
                left[near] = False
                for y in near.tolist():
                    yield x, y
                    front.append(y)

        def out(pids, sets):
            found = list((few if len(sets) <= FEW else many)(sets)) if len(sets) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array([pids[i] for i in x], pa.int64()) for x in zip(*found)], names=["a", "b"])] if found else []

        at, pids, sets = None, [], []
        for batch in batches:
            hashes = batch.column("hashes")
            edge = hashes.offsets.to_numpy()
            flat = hashes.values.to_numpy(zero_copy_only=False)
            for i, (key, pid) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("pid").to_pylist())):
                if key != at:
                    yield from out(pids, sets)
                    at, pids, sets = key, [], []
                pids.append(pid)
                sets.append(flat[edge[i] : edge[i + 1]])
        yield from out(pids, sets)

    return members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint")


def repeated(docs: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK, every: bool = False) -> DataFrame:
    """doc_id, own (see `own_key`), removed (runs of bytes: first, end, first, end, ...), kept_in (the documents where their components stay), for each
    row that loses paragraphs.

    Words are lower-cased (A-Z) and split at ASCII white space. Paragraphs link if the Jaccard similarity of
    their sets of five-word shingles is `similar` or more; equal ones always do. Of a component the paragraph
    of smallest doc_id and place stays; all others go. Null and empty texts, and those of fewer than LENGTH words,
    have no paragraphs; rows without doc_id are left alone. Rows of different texts that share a doc_id are documents of
    their own, in the order of their hashes; rows that repeat a doc_id and its text count as one.

    With `every` no position is left out: of equal windows of LENGTH words, wherever they start, all but the first go (`windows.repeated_windows`),
    and the paragraphs that are compared for similarity hold all words of a text but for fewer than LENGTH at its end.
    """
    from .windows import repeated_windows

    docs = keyed(docs)
    spark = prepare(docs.sparkSession)
    bands, rows = tuned(similar)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * bands // (100 * BUCKET))  # a paragraph starts every 100 bytes or so
    found = written(classed(sent_records(docs, bands, rows, buckets, every), buckets, every), "paragraphs")
    classes = written(found.groupBy("pid").agg(F.min(F.struct("doc_id", "own", "start", "n")).alias("first")), "classes")
    shared = found.where("key is not null").select("key", "pid").distinct()
    shared = written(shared, "shared-bands")
    wanted = classes.join(shared.select("pid").distinct(), "pid", "left_semi").select("pid", "first.doc_id", "first.own", "first.start", "first.n")
    sets = written(sets_of(docs, wanted), "shingle-sets")
    roots = components(written(verified(dealt(shared, chunk).join(sets, "pid").select("bucket", "pid", "hashes"), similar), "links"))
    named = classes.select("pid", "first").join(roots.withColumnRenamed("node", "pid"), "pid", "left").select("pid", "first", F.coalesce("root", "pid").alias("root"))
    named = written(named, "components")
    # Written first: a join with an aggregate of its own stage can't be split where many classes share a root.
    stays = written(named.groupBy("root").agg(F.min("first").alias("stays")), "stays")
    named = written(named.join(stays, "root").select("pid", "stays"), "named")
    # Equal paragraphs are among the windows, so that with `every` only the first of each class is left.
    places = classes.select("pid", "first.doc_id", "first.own", "first.start", "first.n") if every else found.select("pid", "doc_id", "own", "start", "n").distinct()
    gone = places.join(named, "pid").where(F.struct("doc_id", "own", "start") != F.struct("stays.doc_id", "stays.own", "stays.start"))
    gone = written(gone.select("doc_id", "own", F.col("start").alias("top"), (F.col("start") + F.col("n")).alias("bottom"), F.col("stays.doc_id").alias("stays")), "removed-paragraphs")
    if every:
        gone = gone.unionByName(repeated_windows(docs))
    kept = gone.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("stays")).alias("kept_in"))
    return joined_runs(gone, "doc_id", "own", name="removed").join(kept, ["doc_id", "own"])


def dedup_paragraphs(docs: DataFrame, similar: float = SIMILAR, every: bool = False) -> DataFrame:
    """docs, all columns kept, with the bytes that `repeated` names cut out of text. Runs begin and end with words, so
    no character is split; the white space around them stays."""
    (runs,) = fresh(docs, "removed_runs")
    gone = written(repeated(docs, similar, every=every), "removed").withColumnRenamed("removed", runs)
    joined = matched_rows(docs, gone, "left", runs)
    part = f"substring(cast(text as binary), if(j = 0, 0, {runs}[2 * j - 1]) + 1, if(2 * j = size({runs}), octet_length(text), get({runs}, 2 * j)) - if(j = 0, 0, {runs}[2 * j - 1]))"
    kept = f"if({runs} is null, text, array_join(transform(sequence(0, size({runs}) div 2), j -> cast({part} as string)), ''))"
    return joined.select(*[F.expr(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_removed (bytes in removed runs), n_bytes, removed (the runs: first byte, end, ...), kept_in. Every window of LENGTH words is looked at."""
    docs = table(spark, sf_dir, "documents")
    gone = written(repeated(docs, every=True), "removed")
    lost = F.expr("coalesce(aggregate(removed, 0L, (s, x) -> x - s), 0L)")  # end - (first - (end - (first - ...)))
    ids = docs.select("doc_id", own_key().alias("own"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return ids.join(gone, ["doc_id", "own"], "left").select("doc_id", lost.alias("n_removed"), "n_bytes", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"))
