"""Every window of LENGTH words that also starts earlier, wherever it stands.

A window's anchor is the least hash of GRAM words in it, the last one where there are more; equal windows have equal anchors. Hashes
are never rows (see `operators/shingles.py` for the packed numbers).

1. Mappers send the places of all anchors, a sixth of all words, to buckets of hashes; a bucket tells the documents which of their anchors stand more than once.
2. Documents send all windows with such an anchor, as digests with their places, to buckets of anchors. There the first place of
   equal windows stays, and all others go.

An anchor or a window that comes more than HOT times in what a task sends at once goes to its bucket once or twice; its other places are told by
the task itself, or meet the first place in a join, so that no bucket holds all places of a frequent passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shingles import tools
from .common import as_bytes, pieces, prepare, written
from .paragraphs import LENGTH, PART, digests, hashed_words, mixed, shingled, sliding

#: Words of an anchor, and how often what is sent at once may hold one thing until it is frequent.
GRAM, HOT = 10, 8
#: Bytes of text for each bucket, buckets of a task, and windows that a task gathers before it sends them.
BUCKET, TOGETHER, SENT = 16 << 20, 4, 1 << 19
#: In a window's length: what it was sent with has more of the same.
MORE = 1 << 31


def anchors(word, count):
    """first word, anchor and the anchor's first word of each window."""
    import numpy as np

    end = np.repeat(np.cumsum(count), count)
    at = np.flatnonzero(np.arange(len(word)) + LENGTH <= end)
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    h = shingled(np.append(word, np.zeros(GRAM - 1, np.uint64)), GRAM)
    low = sliding(h, LENGTH - GRAM + 1)[at]
    place = at.copy()
    for k in range(1, LENGTH - GRAM + 1):
        same = h[at + k] == low
        place[same] = at[same] + k
    return at, low, place


def ranked(*keys):
    """The order by the keys, and for each row its rank among those with an equal first key and how many these are."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    edge = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(first)])
    size = np.diff(np.append(edge, len(first)))
    return order, np.arange(len(first)) - np.repeat(edge, size), np.repeat(size, size)


def repeated_windows(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, own, top, bottom (bytes from top on), stays (the doc_id of the first place): runs of windows of docs (`keyed`) that go. Places are in the order of
    doc_id, own and start; overlapping windows count, and windows are judged on the input. Rows without doc_id or text, and
    texts of fewer than LENGTH words, have none. Rows that repeat doc_id and text count once. Windows are told apart by 64-bit digests."""
    spark = prepare(docs.sparkSession)
    hot = HOT if hot is None else hot
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "own", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parallel, size // BUCKET)
    tasks = max(parallel, buckets // TOGETHER)
    _, _, unpacked, dealt = tools(1)

    def table(to, blobs):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=["to", "blob"])

    def bucketed(batches):
        """to and all its blobs, bucket by bucket; those from `buckets` on, which need not meet, one by one."""
        at, blobs = None, []
        for batch in batches:
            for to, blob in zip(batch.column("to").to_pylist(), batch.column("blob").to_pylist()):
                if blobs and (to != at or at >= buckets):
                    yield at, blobs
                    blobs = []
                at = to
                blobs.append(blob)
        if blobs:
            yield at, blobs

    def posted(batches):
        """hash and document of each anchor, to buckets of hashes; of frequent ones all but two to buckets of documents."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text", PART):
                ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                word, _, _, count, _ = hashed_words(as_bytes(part, "text"))
                _, low, place = anchors(word, count)
                if not len(low):
                    continue
                new = np.append(True, place[1:] != place[:-1])
                h, doc = low[new], ids[np.repeat(np.arange(len(count)), count)[place[new]]]
                order, rank, times = ranked(h, doc)
                to = np.empty(len(h), np.int64)
                to[order] = np.where((times > hot) & (rank > 1), buckets + doc[order] % buckets, (h[order] % np.uint64(buckets)).astype(np.int64))
                yield table(*dealt(to, h, doc.view(np.uint64)))

    def counted(batches):
        """hash and document of the anchors that stand more than once, to buckets of documents."""
        import numpy as np

        for to, blobs in bucketed(batches):
            if to >= buckets:
                yield table([to - buckets], blobs)
                continue
            h, doc = (np.concatenate(x) for x in zip(*(unpacked(b, 2) for b in blobs)))
            order, _, times = ranked(h, doc)
            order = order[times > 1]
            if len(order):
                order = np.sort(order)  # a document's anchors stay together
                yield table(*dealt(doc[order].view(np.int64) % buckets, h[order], doc[order]))

    def placed(batches):
        """digest, doc_id, own, start and length of the windows with such an anchor, to buckets of anchors; of frequent ones all but the first aside."""
        import numpy as np
        import pyarrow as pa

        held, total = [], 0

        def of_document(h, doc):
            return mixed(h + mixed(doc.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))

        def found(part, known):
            texts = as_bytes(part, "text")
            ids, owns = (part.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("doc_id", "own"))
            word, start, end, count, base = hashed_words(texts)
            at, low, _ = anchors(word, count)
            text = np.repeat(np.arange(len(count)), count)[at]
            key = of_document(low, ids[text])
            hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            at, low, text = at[hit], low[hit], text[hit]
            return low, digests(word, at), ids[text], owns[text], start[at] - base[text], end[at + LENGTH - 1] - start[at]

        def out():
            low, pid, doc, own, start, n = (np.concatenate(x) for x in zip(*held))
            order, rank, times = ranked(pid, doc, own, start)
            low, pid, doc, own, start, n = (x[order] for x in (low, pid, doc, own, start, n))
            n = n.astype(np.uint64) | np.where((times > hot) & (rank == 0), np.uint64(MORE), np.uint64(0))
            lead = np.arange(len(pid)) - rank
            twice = (doc == doc[lead]) & (own == own[lead]) & (start == start[lead]) & (rank > 0)  # a row that stands twice
            to = np.where((times > hot) & (rank > 0), buckets + doc % buckets, (low % np.uint64(buckets)).astype(np.int64))
            order = np.lexsort((start, own, doc))
            order = order[~twice[order]]
            columns = (pid, doc.view(np.uint64), own.view(np.uint64), start.astype(np.uint64) << np.uint64(32) | n)
            return table(*dealt(to[order], *(x[order] for x in columns)))

        at, blobs, known = None, [], None
        for batch in batches:
            tos, given = batch.column("to").to_pylist(), batch.column("blob").to_pylist()
            k = 0
            while k < len(tos):
                if tos[k] != at:
                    at, blobs, known = tos[k], [], None
                if given[k] is not None:
                    blobs.append(given[k])
                    k += 1
                    continue
                stop = k
                while stop < len(tos) and tos[stop] == at and given[stop] is None:
                    stop += 1
                if known is None and blobs:
                    known = np.unique(of_document(*(np.concatenate(x) for x in zip(*(unpacked(b, 2) for b in blobs)))))
                    blobs = []
                for part in pieces(batch.slice(k, stop - k), "text", PART) if known is not None else ():
                    held.append(found(part, known))
                    total += len(held[-1][0])
                    if total >= SENT:
                        yield out()
                        held, total = [], 0
                k = stop
        if total:
            yield out()

    def met(batches):
        """Runs of windows that aren't the first, with the first's document; of frequent windows the places (no stays) and the first's document (no doc_id)."""
        import numpy as np
        import pyarrow as pa

        names = ["pid", "doc_id", "own", "top", "bottom", "stays"]

        def rows(n, **columns):
            kinds = {"top": (np.int32, pa.int32()), "bottom": (np.int32, pa.int32())}
            of = {c: kinds.get(c, (np.int64, pa.int64())) for c in names}
            return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(of[c][0]), of[c][1]) if c in columns else pa.nulls(n, of[c][1]) for c in names], names=names)

        for to, blobs in bucketed(batches):
            pid, doc, own, place = (np.concatenate(x) for x in zip(*(unpacked(b, 4) for b in blobs)))
            pid, doc, own = pid.view(np.int64), doc.view(np.int64), own.view(np.int64)
            start, n = (place >> np.uint64(32)).astype(np.int64), (place & np.uint64(MORE - 1)).astype(np.int64)
            if to >= buckets:
                yield rows(len(pid), pid=pid, doc_id=doc, own=own, top=start, bottom=start + n)
                continue
            more = place & np.uint64(MORE) > 0
            order, rank, _ = ranked(pid, doc, own, start)
            pid, doc, own, start, n, more = (x[order] for x in (pid, doc, own, start, n, more))
            lead = np.arange(len(pid)) - rank
            often = np.unique(lead[more])
            yield rows(len(often), pid=pid[often], stays=doc[often])
            late = np.flatnonzero((doc != doc[lead]) | (own != own[lead]) | (start != start[lead]))
            doc, own, top, bottom, stays = doc[late], own[late], start[late], start[late] + n[late], doc[lead[late]]
            order = np.lexsort((top, stays, own, doc))
            doc, own, top, bottom, stays = (x[order] for x in (doc, own, top, bottom, stays))
            new = np.append(True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (stays[1:] != stays[:-1]) | (top[1:] > bottom[:-1]))[: len(doc)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc))[: len(first)] - 1
            yield rows(len(first), doc_id=doc[first], own=own[first], top=top[first], bottom=bottom[last], stays=stays[first])

    kind = "to bigint, blob binary"
    known = docs.mapInArrow(posted, kind).repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(counted, kind)
    texts = docs.select(F.pmod("doc_id", F.lit(buckets)).cast("bigint").alias("to"), F.lit(None).cast("binary").alias("blob"), "doc_id", "own", "text")
    both = texts.unionByName(known, allowMissingColumns=True).repartition(tasks, "to").sortWithinPartitions("to", F.col("blob").isNull())
    sent = both.mapInArrow(placed, kind).repartition(tasks, "to").sortWithinPartitions("to")
    found = written(sent.mapInArrow(met, "pid bigint, doc_id bigint, own bigint, top int, bottom int, stays bigint"), "repeated-windows")
    columns = ["doc_id", "own", "top", "bottom", "stays"]
    often = found.where("doc_id is null").groupBy("pid").agg(F.min("stays").alias("stays"))
    often = found.where("stays is null").drop("stays").join(written(often, "frequent-windows"), "pid").select(columns)
    return found.where("doc_id is not null and stays is not null").select(columns).unionAll(often)
