"""Removal of repeated byte strings with suffix arrays, over whole documents.

A byte goes if a LENGTH-byte string that covers it also starts earlier (in a smaller doc_id, or further up
in the same document). Sorting every suffix of a corpus in one order would move each byte many times,
so only texts that can hold repeats are sorted:

1. Anchors. Each LENGTH-byte window is owned by its least GRAM-byte hash (leftmost of equal ones), so equal windows
   have equal anchors at equal offsets. The windows that an anchor owns, one after the other, are its
   context. Mappers send a record of each context (anchor, digest, place) to the anchor's bucket; contexts that
   came earlier in the same batch are repeats already and only the first is sent.
2. In a bucket, contexts equal to an earlier one are repeats as a whole. Anchors with two or more different
   contexts may still share some windows: the first place of each of these contexts is kept.
3. The texts of these contexts are sorted: a two-stage suffix array of some hundred kB at a time, in
   which suffixes that are smaller than their successors are sorted directly and the others are induced by
   scans through the buckets of first bytes. Neighbours with common prefixes of LENGTH bytes hold the same
   window; all but the earliest are repeats.
4. Repeats meet by document and are cut out of the text.

Hot anchors (such as those of a line that a third of all documents have) are found by a frequent-items
sketch first. Each of their windows is an anchor of its own, so that equal ones are combined by
the mappers and different ones are spread. Of the other anchors, one with more than LARGE different contexts is met
in its bucket: its contexts are passed on as they come, and their windows are compared by digest in an aggregate and a
join, which can be split anywhere. So a task holds about HELD records, and sorts LARGE contexts of an anchor at most,
however large the corpus is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, frequent, pieces, prepare, quoted, table, written

LENGTH, GRAM = 100, 24
#: Anchors with more than this share of all anchors, and at least so many, are hot; the sketch's error is 3.5 / TRACKED.
HOT, LEAST_HOT, TRACKED, MOST_HOT = 5e-4, 1000, 16384, 4096
#: Different contexts of an anchor that are sorted, and records of a bucket that are held.
LARGE, HELD = 2000, 1 << 19
#: Records of a bucket, buckets of a task (several small ones even out), and bytes of contexts that are sorted at a time.
BUCKET, TOGETHER, SORTED = 50_000, 8, 1 << 19
PART = 2 << 20
RECORD = [("h", "<u8"), ("d", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")]


def packed(data):
    """The eight bytes from each position on as one big-endian number; data ends with 8 or more spare bytes."""
    import numpy as np

    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """For all texts one after the other: hash, position and text number of each anchor, the first window that it owns and how many."""
    import numpy as np

    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(gram + 16), np.uint8)
    total = int(size.sum())
    w = packed(data)
    m = total + 1
    h = w[:m] * np.uint64(0x9E3779B97F4A7C15) + w[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + w[gram - 8 : m + gram - 8] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:  # least of `span` neighbours, then of twice as many
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    end = np.cumsum(size)
    start = end - size
    number = np.repeat(np.arange(len(texts)), size)
    window = np.flatnonzero(np.arange(total) + length <= np.repeat(end, size)) if total else np.zeros(0, np.int64)
    at = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = number[window]
    if not len(window):
        z = np.zeros(0, np.int64)
        return h[:0], z, z, z, z, start
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    return h[at[new]], at[new], text[new], window[new], np.diff(np.append(new, len(window))), start


def hot_anchors(docs: DataFrame, length: int, gram: int) -> tuple[int, list[int]]:
    """How many anchors there are, and the hashes of the hot ones (at most MOST_HOT)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text", PART):
                h = anchors(as_bytes(part, "text"), length, gram)[0]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    found = frequent(docs.select("text").mapInArrow(run, "h bigint"), "h", TRACKED, MOST_HOT).first()
    return found.n, [x.item for x in found.top or [] if x["count"] > max(LEAST_HOT, HOT * found.n)]


def merged(doc, start, n):
    """Sorted spans (start, start + n) of documents, those that touch made one."""
    import numpy as np

    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start[order] + n[order]).astype(np.int64)
    if not len(doc):
        return doc, start, end - start
    code = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 40
    reach = np.maximum.accumulate(code + end)
    new = np.append(True, (code + start)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - code[last] - start[first]


def firsts(records):
    """records, sorted, without those that repeat the context of an earlier place; and those."""
    import numpy as np

    r = records[np.lexsort((records["start"], records["doc"], records["d"], records["h"]))]
    new = np.append(True, (r["h"][1:] != r["h"][:-1]) | (r["d"][1:] != r["d"][:-1])) if len(r) else np.zeros(0, bool)
    first = r[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(r) else r
    same = (first["doc"] == r["doc"]) & (first["start"] == r["start"])
    return r[new], r[~new & ~same]


def contexts(docs: DataFrame, hot_in, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, records, spans: packed records of contexts for each bucket, and spans that are repeats already."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        hot = hot_in.value
        for batch in batches:
            for part in pieces(batch.filter(batch.column("doc_id").is_valid()), "text", PART):
                texts = as_bytes(part, "text")
                ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                h, at, text, window, n, base = anchors(texts, length, gram)
                whole = b"".join(texts)
                if len(hot) and len(h):
                    many = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    count = np.where(many, n, 1)
                    row = np.repeat(np.arange(len(h)), count)
                    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    own = many[row]
                    h, at, text, window, n = h[row], at[row], text[row], window[row] + inner, np.where(own, 1, n[row])
                else:
                    own = np.zeros(len(h), bool)
                digest = xxhash.xxh3_64_intdigest
                r = np.zeros(len(h), RECORD)
                r["d"] = [digest(whole[a : a + k + length - 1], o) for a, k, o in zip(window.tolist(), n.tolist(), (at - window).tolist())]
                for i in np.flatnonzero(own).tolist():  # a hot anchor's window stands for itself, wherever the anchor is in it
                    a = int(window[i])
                    h[i] = digest(whole[a : a + length], 1 << 20)
                r["h"], r["doc"], r["start"], r["n"] = h, ids[text], window - base[text], n
                r, late = firsts(r)
                spans = np.stack([x.astype("<i8") for x in merged(late["doc"], late["start"], late["n"] + length - 1)], axis=1)
                bucket = (r["h"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                r, bucket = r[order], bucket[order]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(r) else np.zeros(0, np.int64)
                blobs = [r[a:b].tobytes() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(r)])]
                to = bucket[edge].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([*to, int(ids[0]) % buckets if len(ids) else 0], pa.int64()), pa.array([*blobs, b""], pa.binary()), pa.array([*[b""] * len(blobs), spans.tobytes()], pa.binary())], names=["bucket", "records", "spans"])

    return docs.mapInArrow(run, "bucket bigint, records binary, spans binary")


FOUND = "doc_id bigint, start int, n int, anchor bigint, large boolean"


def compared(sent: DataFrame, buckets: int, length: int) -> DataFrame:
    """doc_id, start, n, anchor, large: repeats (anchor null), and contexts whose windows are still to be compared."""
    spark = prepare(sent.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(doc, start, n, anchor, large=False):
            return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor, pa.int64()) if anchor is not None else pa.nulls(len(doc), pa.int64()), pa.array([large] * len(doc), pa.bool_())], names=["doc_id", "start", "n", "anchor", "large"])

        def less(blobs, large):
            """Pass on repeats, and the contexts of anchors that have too many; the rest, and how many contexts each of its anchors has."""
            r, late = firsts(np.frombuffer(b"".join(blobs), RECORD))
            yield batch_of(*merged(late["doc"], late["start"], late["n"] + length - 1), None)
            new = np.append(True, r["h"][1:] != r["h"][:-1]) if len(r) else np.zeros(0, bool)
            size = np.diff(np.append(np.flatnonzero(new), len(r)))
            large.update(r["h"][new][size > LARGE].tolist())
            many = np.isin(r["h"], np.array(sorted(large), np.uint64))
            if many.any():
                out = r[many]
                yield batch_of(out["doc"], out["start"], out["n"], out["h"].copy().view(np.int64), True)
            return r[~many], np.repeat(size, size)[~many]

        def out(blobs, large):
            r, size = yield from less(blobs, large)
            r = r[size > 1]
            yield batch_of(r["doc"], r["start"], r["n"], r["h"].copy().view(np.int64))

        at, blobs, held, large = None, [], 0, set()
        for batch in batches:
            for key, records, spans in zip(*(batch.column(c).to_pylist() for c in ("bucket", "records", "spans"))):
                if key != at:
                    yield from out(blobs, large)
                    at, blobs, held, large = key, [], 0, set()
                blobs.append(records)
                held += len(records) // np.dtype(RECORD).itemsize
                if held > HELD:
                    rest, _ = yield from less(blobs, large)
                    blobs, held = [rest.tobytes()], len(rest) // 2  # what is left counts half, so that it isn't gone over for each row
                if spans:
                    s = np.frombuffer(spans, "<i8").reshape(-1, 3)
                    yield batch_of(s[:, 0], s[:, 1], s[:, 2], None)
        yield from out(blobs, large)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // TOGETHER)
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def suffix_array(text, depth: int = LENGTH):
    """Positions of text (uint8) in the order of their suffixes, exact for the first `depth` bytes at least, by two-stage sorting."""
    import numpy as np

    n = len(text)
    words = packed(np.append(text, np.zeros(depth + 24, np.uint8)))
    # Whether each suffix is smaller than its successor: the next byte that differs tells; past the end stand zeros.
    change = np.flatnonzero(text[1:] != text[:-1])
    up = np.append(text[change] < text[change + 1], text[-1] == 0)
    small = up[np.searchsorted(change, np.arange(n))]
    # First stage: sort these by eight bytes at a time, as long as some are equal.
    order = np.flatnonzero(small)
    order = order[np.argsort(words[order], kind="stable")]
    key = words[order]
    new = np.append(True, key[1:] != key[:-1])
    done = 8
    while done < depth + 8 and not new.all():
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        again = tied[np.lexsort((words[np.minimum(order[tied] + done, len(words) - 1)], group[tied]))]
        order[tied] = order[again]
        key = words[np.minimum(order + done, len(words) - 1)]
        new |= np.append(True, key[1:] != key[:-1]) & np.append(True, group[1:] == group[:-1])
        done += 8
    # Second stage: scan the buckets of first bytes upward. A position's predecessor that isn't small goes to its own bucket's front part.
    first = text[order]
    edge = np.searchsorted(first, np.arange(257))
    waiting: list[list] = [[] for _ in range(256)]
    if text[-1]:
        waiting[text[-1]].append(np.array([n - 1]))
    out = []

    def induce(items):
        before = items[items > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        cut = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(byte)]):
            waiting[byte[a]].append(before[a:b])

    for c in range(256):
        while waiting[c]:
            items, waiting[c] = np.concatenate(waiting[c]), []
            out.append(items)
            induce(items)
        items = order[edge[c] : edge[c + 1]]
        out.append(items)
        induce(items)
    return np.concatenate(out), words


def shared_windows(texts: list[bytes], windows: list[int], doc, start, length: int = LENGTH):
    """The spans of windows that also start earlier: texts are contexts, whose first `windows` positions start windows;
    doc and start: where each text stands."""
    import numpy as np

    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    base = np.cumsum(size + 1) - size - 1
    number = np.repeat(np.arange(len(texts)), size + 1)
    inner = np.arange(len(data)) - base[number]
    order, words = suffix_array(data, length)
    order = order[inner[order] < np.asarray(windows)[number[order]]]
    if not len(order):
        return merged(doc[:0], start[:0], start[:0])
    common = np.ones(len(order) - 1, bool)  # whether neighbours have `length` bytes in common
    for k in range(0, length, 8):
        shift = np.uint64(8 * max(0, k + 8 - length))
        common &= (words[order[1:] + k] >> shift) == (words[order[:-1] + k] >> shift)
    place = (np.unique(doc, return_inverse=True)[1][number[order]].astype(np.int64) << 32) + start[number[order]] + inner[order]
    run = np.flatnonzero(np.append(True, ~common))
    earliest = np.repeat(np.minimum.reduceat(place, run), np.diff(np.append(run, len(order))))
    late = order[place > earliest]
    return merged(doc[number[late]], start[number[late]] + inner[late], np.full(len(late), length))


def sorted_repeats(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """doc_id, start, n: repeats among the contexts `wanted` (doc_id, start, n, anchor), from docs' whole texts."""
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("_wanted")).withColumnRenamed("doc_id", "_wanted_doc")
    joined = docs.join(wanted, F.col("doc_id") == F.col("_wanted_doc")).select("doc_id", "text", "_wanted")
    spark = prepare(docs.sparkSession)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text", PART):
                rows = [(x["anchor"], doc, x["start"], x["n"], text[x["start"] : x["start"] + x["n"] + length - 1]) for doc, text, asked in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), as_bytes(part, "text"), part.column("_wanted").to_pylist()) for x in asked]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["anchor", "doc_id", "start", "n", "body"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(rows):
            if rows:
                _, doc, start, n, body = zip(*rows)
                d, s, k = shared_windows(list(body), list(n), np.array(doc, np.int64), np.array(start, np.int64), length)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32))], names=["doc_id", "start", "n"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "n", "body"))):
                if size > SORTED and row[0] != rows[-1][0]:
                    yield from out(rows)
                    rows, size = [], 0
                if len(row[4]) == row[3] + length - 1:
                    rows.append(row)
                    size += len(row[4])
        yield from out(rows)

    bodies = joined.mapInArrow(cut, "anchor bigint, doc_id bigint, start int, n int, body binary")
    return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id bigint, start int, n int")


def window_repeats(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """doc_id, start, n: the windows of contexts `wanted` (doc_id, start, n) that also start earlier, each by its 128-bit digest."""
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("_wanted")).withColumnRenamed("doc_id", "_wanted_doc")
    joined = docs.join(wanted, F.col("doc_id") == F.col("_wanted_doc")).select("doc_id", "text", "_wanted")
    prepare(docs.sparkSession)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in pieces(batch, "text", PART):
                for doc, text, asked in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), as_bytes(part, "text"), part.column("_wanted").to_pylist()):
                    at = sorted({i for x in asked for i in range(x["start"], min(x["start"] + x["n"], len(text) - length + 1))})
                    d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[i : i + length]) for i in at]), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([doc] * len(at), pa.int64()), pa.array(at, pa.int32())], names=["high", "low", "doc_id", "start"])

    windows = written(joined.mapInArrow(cut, "high bigint, low bigint, doc_id bigint, start int"), "windows")
    first = written(windows.groupBy("high", "low").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "first-windows")
    late = windows.join(first, ["high", "low"]).where(F.struct("doc_id", "start") > F.col("first"))
    return late.select("doc_id", "start", F.lit(length).alias("n"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, spans (start, bytes) of repeats in each document that has any; they may overlap."""
    docs = quoted(docs, ["doc_id", "text"])
    spark = prepare(docs.sparkSession)
    total, hot = hot_anchors(docs, length, gram)
    import numpy as np

    sent_hot = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    found = written(compared(contexts(docs, sent_hot, buckets, length, gram), buckets, length), "contexts")
    more = written(sorted_repeats(docs, found.where("anchor is not null and not large"), length), "sorted")
    spans = found.where("anchor is null").select("doc_id", "start", "n").unionAll(more).unionAll(window_repeats(docs, found.where("large"), length))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) with `texts`.

    Texts are UTF-8 bytes, null is empty. Strings are judged on the input, not on what is left; overlaps count; no
    string crosses documents. What is kept is joined without gaps and may split a character. doc_id must
    name one text: rows that repeat a doc_id and text are treated alike. Rows without doc_id are left
    whole and are not compared. Other columns are ignored; an empty table gives no rows.
    """
    if not 24 <= gram <= length:
        raise ValueError("anchors have 24 bytes at least and fit into a string")
    found = written(repeats(docs, length, gram), "repeats").select(F.col("doc_id").alias("_doc"), "spans")
    docs = quoted(docs, ["doc_id", "text"])
    joined = docs.join(found, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "spans")
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text", PART):
                rows = []
                spans = part.column("spans")
                edge = spans.offsets.to_numpy()
                starts, sizes = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
                for text, a, b in zip(as_bytes(part, "text"), edge.tolist(), edge[1:].tolist()):
                    removed = runs = 0
                    kept = text
                    if b > a:
                        _, start, n = merged(np.zeros(b - a, np.int64), starts[a:b].astype(np.int64), sizes[a:b].astype(np.int64))
                        removed, runs = int(n.sum()), len(start)
                        ends = [0, *np.stack([start, start + n], axis=1).ravel().tolist(), len(text)]
                        kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple]:
    """The definition with a dictionary of all windows; for tests."""
    seen, out = set(), {}
    for doc in sorted(texts):
        text = texts[doc]
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[doc] = (len(text), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out
