"""Benchmark decontamination on a distributed positional inverted index.

The index is built once, for all terms of the training documents, and is split by documents: each shard is one row that
holds, for some hundreds of documents, the postings (positions in the shard) of each term, sorted by the term's
64-bit hash. A shard never holds more than about SHARD_BYTES of text, or one longer document. Shards are written to the
shared folder and can be searched again and again without a shuffle and without the texts.

A phrase is found by taking the postings of its rarest term in the shard, less the term's offset,
and intersecting them with the offset-adjusted postings of the next rarest terms, for all
phrases at once. Documents in a shard are one position apart, where no term stands, so no
phrase reaches from one document into the next. Proximity matches take the rarest term's postings in the same
way and keep those that have postings of all other terms nearby.

The benchmark is the query set: it is taken in blocks of at most BLOCK_BYTES of text, which
bounds what is broadcast; every block searches the same index, and matches meet by the document's row in it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, keyed, matched_rows, merged_runs, pieces, prepare, quoted, received, sent, table, written

#: Words of a window.
WINDOW = 13
#: Words of a span that holds all words of a window in any order, for a proximity match.
NEAR = 26
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
#: Shards of a Parquet row group, which is what writers and readers hold at a time; windows and candidates that a search looks at together.
GROUP, WINDOWS, CANDIDATES = 2, 1 << 15, 1 << 18
#: Bytes that are part of words after lower-casing A-Z; all others separate words.
WORD_BYTES = bytes(b for b in range(256) if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
TO_WORDS = bytes(b if b in WORD_BYTES else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: shard: the first 31 bits are the task that made it; row i of the shard is document shard << 24 | i of the index. terms are packed hashes of 8 bytes, starts
#: and positions packed numbers of 4: as arrays they would take many times the room in the JVM.
INDEX = "shard bigint, ids array<bigint>, owns array<bigint>, first array<int>, n_words array<int>, terms binary, starts binary, positions binary"
SEARCHED = ["shard", "first", "n_words", "terms", "starts", "positions"]
MATCHES = "row bigint, items array<bigint>, spans array<int>"


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def term_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class Phrases:
    """The distinct windows of benchmark items over numbered terms; -1 fills up short windows.

    hashes: of each term; terms: a row of term numbers for each window; items[bound[k] : bound[k + 1]]: the items of window k.
    """

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        import numpy as np

        number: dict[bytes, int] = {}
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            line = np.array([number.setdefault(w, len(number)) for w in words(text)], np.int32)
            if not len(line):
                continue
            line = np.append(line, np.full(max(0, window - len(line)), -1, np.int32))
            rows.append(np.lib.stride_tricks.sliding_window_view(line, window))
            owner.append(np.full(len(rows[-1]), item, np.int64))
        self.hashes = np.fromiter(map(term_hash, number), np.uint64, len(number))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        self.terms, place = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        place = place.ravel()
        order = np.lexsort((owner, place))
        new = np.append(len(order) > 0, (place[order][1:] != place[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(order)]
        order = order[new]
        self.items, self.bound = owner[order], np.searchsorted(place[order], np.arange(len(self.terms) + 1))
        self.length = (self.terms >= 0).sum(axis=1)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """Lists of (item_id, text) of about `limit` bytes at most, an item at a time from the workers."""
    block, size = [], 0
    for r in quoted(benchmark, ["item_id", "text"]).where("item_id is not null").toLocalIterator():
        text = (r.text or "").encode()
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text) + 50
    yield block


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of docs (doc_id, text), with the postings of all their terms."""
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 20
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            for part in pieces(batch, "text", SHARD_BYTES):
                lines = [words(t) for t in as_bytes(part, "text")]
                count = np.fromiter(map(len, lines), np.int64, len(lines))
                first = np.cumsum(count + 1) - count - 1
                number: dict[bytes, int] = {}
                term = np.fromiter((number.setdefault(w, len(number)) for line in lines for w in line), np.int32, int(count.sum()))
                at = np.arange(len(term)) + np.repeat(np.arange(len(lines)), count)
                hashes = np.fromiter(map(term_hash, number), np.uint64, len(number))
                order = np.argsort(hashes)
                rank = np.empty(len(number), np.int32)
                rank[order] = np.arange(len(number), dtype=np.int32)
                by = np.argsort(rank[term], kind="stable")
                starts = np.cumsum(np.bincount(term, minlength=len(number))[order]) if len(number) else np.zeros(0, np.int64)
                starts = np.append(0, starts)[:-1] if len(number) else starts
                arrays = [[shard], [part.column("doc_id").cast(pa.int64()).to_pylist()], [part.column("own").to_pylist()], [first.astype(np.int32)], [count.astype(np.int32)]]
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (hashes[order], starts.astype(np.int32), at[by].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays, (pa.int64(), longs, longs, ints, ints)), *packed], names=["shard", "ids", "owns", "first", "n_words", "terms", "starts", "positions"])
                shard += 1

    return keyed(docs).mapInArrow(run, INDEX)


class Shard:
    """The part of a row of the index that has postings of some terms, given by their hashes."""

    def __init__(self, row, i: int, hashes):
        import numpy as np

        take = lambda name: row.column(name)[i].values.to_numpy(zero_copy_only=False)
        packed = lambda name, kind: np.frombuffer(row.column(name)[i].as_buffer(), kind)
        self.shard = row.column("shard")[i].as_py()
        self.first, self.n_words = take("first").astype(np.int64), take("n_words").astype(np.int64)
        self.size = int(self.first[-1] + self.n_words[-1] + 1) if len(self.first) else 0
        terms, positions = packed("terms", np.uint64), packed("positions", np.int32)
        starts = np.append(packed("starts", np.int32), len(positions)).astype(np.int64)
        at = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
        there = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
        self.count = np.where(there, starts[at + 1] - starts[at], 0) if len(terms) else np.zeros(len(hashes), np.int64)
        self.place = np.cumsum(self.count) - self.count  # where a term's postings begin
        inner = np.arange(int(self.count.sum())) - np.repeat(self.place, self.count)
        self.positions = positions[np.repeat(starts[at] if len(terms) else self.place, self.count) + inner].astype(np.int64)
        self.keys = np.repeat(np.arange(len(hashes)), self.count) * self.size + self.positions

    def rarest(self, terms, windows: int = WINDOWS, candidates: int = CANDIDATES):
        """Pieces of the windows whose terms all stand here: their numbers, their offsets from the rarest term on, and their candidates
        as (row of these, position) of each posting of the rarest. A piece has at most `windows` windows, and `candidates` candidates or one window's."""
        import numpy as np

        for a in range(0, len(terms), windows):
            part = terms[a : a + windows]
            often = np.where(part < 0, np.iinfo(np.int64).max, self.count[np.maximum(part, 0)])
            live = np.flatnonzero(often.min(axis=1) > 0)
            order = np.argsort(often[live], axis=1, kind="stable")
            lead = part[live, order[:, 0]]
            total = np.cumsum(self.count[lead])
            low = 0
            while low < len(live):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + candidates, "right")))
                size = self.count[lead[low:high]]
                row = np.repeat(np.arange(high - low), size)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield live[low:high] + a, order[low:high], row, self.positions[self.place[lead[low:high]][row] + inner]
                low = high

    def phrases(self, phrases: Phrases):
        """(window, start) of every exact occurrence."""
        import numpy as np

        terms, windows, starts = phrases.terms, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for live, order, row, start in self.rarest(terms):
            start = start - order[row, 0]
            for k in range(1, terms.shape[1]):
                offset = order[row, k]
                term = terms[live[row], offset].astype(np.int64)
                at = start + offset
                key = np.maximum(term, 0) * self.size + at
                found = (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key) & (at >= 0) & (at < self.size)
                keep = (term < 0) | found
                row, start = row[keep], start[keep]
            windows.append(live[row])
            starts.append(start)
        return np.concatenate(windows), np.concatenate(starts)

    def near(self, phrases: Phrases, width: int):
        """(window, document) where a span of at most `width` words of the document holds all terms of the window, in any order."""
        import numpy as np

        terms, found = phrases.terms, set()
        for live, order, row, at in self.rarest(terms):
            doc = np.searchsorted(self.first, at, "right") - 1
            low, high = np.maximum(at - width + 1, self.first[doc]), np.minimum(at + width, self.first[doc] + self.n_words[doc])
            for k in range(1, terms.shape[1]):  # all other terms must have a posting within reach
                term = terms[live[row], order[row, k]].astype(np.int64)
                base = np.maximum(term, 0) * self.size
                keep = (term < 0) | (np.searchsorted(self.keys, base + low) < np.searchsorted(self.keys, base + high))
                row, at, doc, low, high = row[keep], at[keep], doc[keep], low[keep], high[keep]
            for r, d, a, b in zip(row.tolist(), doc.tolist(), low.tolist(), high.tolist()):
                own = [int(t) for t in set(terms[live[r]].tolist()) if t >= 0]
                post = [self.positions[self.place[t] : self.place[t] + self.count[t]] for t in own]
                post = [x[np.searchsorted(x, a) : np.searchsorted(x, b)] for x in post]
                start = np.concatenate(post)  # a shortest span starts at a posting
                last = np.max([np.append(x, 1 << 40)[np.searchsorted(x, start)] for x in post], axis=0)
                if (last < start + width).any():
                    found.add((int(live[r]), d))
        return tuple(np.array(x, np.int64) for x in zip(*sorted(found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _per_document(phrases: Phrases, window, doc) -> dict[int, set]:
    """The items of the windows found in each document of a shard."""
    items: dict[int, set] = {}
    for d, w in zip(doc.tolist(), window.tolist()):
        items.setdefault(d, set()).update(phrases.items[phrases.bound[w] : phrases.bound[w + 1]].tolist())
    return items


def search(index: DataFrame, phrases_in) -> DataFrame:
    """Per document with an exact match: row, items with occurring windows, and the hit spans as start, end, start, end, ..."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        phrases = received(phrases_in)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, phrases.hashes)
                window, start = shard.phrases(phrases)
                if not len(window):
                    continue
                edge = np.zeros(shard.size + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + phrases.length[window], -1)
                hit = np.cumsum(edge)[: shard.size] > 0
                items = _per_document(phrases, window, np.searchsorted(shard.first, start, "right") - 1)
                turn = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                ends = np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)], axis=1)
                spans: dict[int, list] = {}
                for d, (a, b) in zip((np.searchsorted(shard.first, ends[:, 0], "right") - 1).tolist(), ends.tolist()):
                    spans.setdefault(d, []).extend((a - int(shard.first[d]), b - int(shard.first[d])))
                docs = sorted(items)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.shard << 24 | d for d in docs], pa.int64()), pa.array([sorted(items[d]) for d in docs], pa.list_(pa.int64())), pa.array([spans[d] for d in docs], pa.list_(pa.int32()))],
                    names=["row", "items", "spans"],
                )

    return index.select(*SEARCHED).mapInArrow(run, MATCHES)


def near_search(index: DataFrame, phrases_in, width: int = NEAR) -> DataFrame:
    """Per document with a proximity match: row, items with a window whose words all stand in `width` words, in any order."""

    def run(batches):
        import pyarrow as pa

        phrases = received(phrases_in)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, phrases.hashes)
                items = _per_document(phrases, *shard.near(phrases, width))
                docs = sorted(items)
                yield pa.RecordBatch.from_arrays([pa.array([shard.shard << 24 | d for d in docs], pa.int64()), pa.array([sorted(items[d]) for d in docs], pa.list_(pa.int64()))], names=["row", "items"])

    return index.select(*SEARCHED).mapInArrow(run, "row bigint, items array<bigint>")


def indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written index, and its documents (row, doc_id, own, n_words), one for each row of docs."""
    index = written(build_index(docs), "postings", **{"parquet.block.row.count.limit": GROUP})
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "owns", "n_words")).alias("i", "d"))
    return index, rows.select((F.shiftleft("shard", 24) + F.col("i")).alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.owns").alias("own"), F.col("d.n_words").cast("bigint").alias("n_words"))


def matched(index: DataFrame, benchmark: DataFrame, find, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What find(index, broadcast Phrases) gives for all blocks of the benchmark, each written as soon as it is found."""
    spark, out = index.sparkSession, None
    for block in blocks(benchmark, block_bytes):
        phrases = sent(spark, Phrases(block, window))
        part = written(find(index, phrases), "matches")
        phrases.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What `contamination` returns, and own (see `own_key`)."""
    index, rows = indexed(docs)
    hits = matched(index, benchmark, search, window, block_bytes).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("s"))
    ends = "array_sort(transform(sequence(0, size(s) div 2 - 1), i -> struct(s[2 * i] as top, s[2 * i + 1] as bottom)))"
    hits = hits.select("row", "items", F.expr(ends).alias("ends")).select("row", "items", F.expr(merged_runs("ends")).alias("spans"))
    out = rows.join(hits, "row", "left").withColumn("n_hit", F.expr("coalesce(aggregate(spans, 0L, (s, x) -> x - s), 0L)"))  # end - (start - (end - ...))
    items, spans = F.coalesce("items", F.array().cast("array<bigint>")), F.coalesce("spans", F.array().cast("array<int>"))
    return out.select("doc_id", "own", "n_words", "n_hit", items.alias("items"), spans.alias("spans"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, items (sorted array of item_id), spans, contaminated.

    A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. A window is
    `window` consecutive words of an item, or a shorter item as a whole; a word inside an occurrence
    is hit. A document is contaminated if at least one of 20 words is hit. Null or empty texts have
    no words and are clean; items without words or without item_id match nothing. Items with equal
    texts all count. Rows that repeat a doc_id, or have none, are judged each by its own text. Empty tables give
    no rows, or no hits. However many blocks the benchmark makes, the rows are the same.
    """
    return judged(docs, benchmark, window, block_bytes).drop("own")


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = NEAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, items (sorted array of item_id) with a window whose words all stand in `width`
    consecutive words of the document, in any order. Words, windows, nulls and repeated rows as in `contamination`."""
    index, rows = indexed(docs)
    found = matched(index, benchmark, lambda i, p: near_search(i, p, width), window, block_bytes)
    hits = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents, all columns kept. Each row goes or stays by its own text, also where rows share a doc_id or have none."""
    bad = written(judged(docs, benchmark).where("contaminated").select("doc_id", "own").distinct(), "contaminated")
    return matched_rows(docs, bad, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op4_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the items that have a window whose words all stand in NEAR consecutive words of it, in any order."""
    found = proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("items").cast("long").alias("n_items"), "items")


def brute_near(texts: list[bytes], items: list[tuple[int, bytes]], window: int = WINDOW, width: int = NEAR) -> list[list[int]]:
    """The items of `proximity` for each text; for tests."""
    out = []
    for text in texts:
        own, found = words(text), set()
        spans = [set(own[s : s + width]) for s in range(max(1, len(own) - width + 1))]
        for i, t in items:
            line = words(t)
            for k in range(max(1, len(line) - window + 1) if line else 0):
                if any(set(line[k : k + window]) <= s for s in spans):
                    found.add(i)
        out.append(sorted(found))
    return out


def brute_force(texts: list[bytes], items: list[tuple[int, bytes]], window: int = WINDOW) -> list[tuple]:
    """The definition, word by word; for tests."""
    out = []
    lines = [(i, words(t)) for i, t in items]
    for text in texts:
        own = words(text)
        hit, found = set(), set()
        for i, line in lines:
            n = min(window, len(line))
            for k in range(len(line) - n + 1 if n else 0):
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == line[k : k + n]:
                        hit.update(range(s, s + n))
                        found.add(i)
        out.append((len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
m AS (SELECT doc_id, s, ds.n, item_id FROM ds JOIN bw ON bw.n = ds.n AND bw.win = array_to_string(w[s:s + ds.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
