"""Phrase collocation mining on vertical positional inverted lists.

1. Tasks cut the documents into shards of a few MB, number a shard's words, and write a list of positions for each
   word of a shard. A piece's end skips a number, so that words on both sides of it are not adjacent.
2. A list's length is its phrase's count in the shard; Spark sums them. Phrases that come LEAST times or more are numbered,
   and only their lists are carried on.
3. Longer phrases come level by level: within a shard the occurrences of each phrase are merge-joined by position with those
   that start at the next word. An occurrence at p and one at p + 1 are one of the phrase with one word
   more, since all parts of a frequent phrase are frequent. Positions stay with their shard: what is shuffled are the lengths of
   lists, packed by buckets of phrases, and which of them are frequent comes back.
4. Candidates are joined with the counts of their parts, those inside a longer one of much the same count go, and the rest is ranked.

Nothing is broadcast but what Spark finds small, and no task holds more than a shard.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.labels import numbered
from ..session import discard
from .common import as_bytes, pieces, prepare, quoted, table, written

#: Occurrences of a candidate at least, its words at most, and how many of a language are returned.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one that holds it has at least this percentage of its count.
COVERED = 80
#: Bytes of text in a shard; a longer text is cut at the end of a piece.
SHARD_BYTES = 16 << 20
#: What ends a piece, besides the end of a text.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: In how many groups a language's candidates are ranked before the last step, which then reads TOP of each.
RANKS = 64


def packed(value):
    """Whole numbers from 0 as base-128 digits (an array of bytes), and where each ends."""
    import numpy as np

    value = np.asarray(value).astype(np.uint64)
    size = np.ones(len(value), np.int64)
    for k in range(1, 9):
        size += value >> np.uint64(7 * k) > 0
    end = np.append(0, np.cumsum(size))
    out = np.zeros(end[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[end[:-1][has] + k] = ((value[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, end


def numbers(data: bytes):
    """What `packed` wrote."""
    import numpy as np

    data = np.frombuffer(data, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    start = np.append(0, last[:-1] + 1)
    within = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), start)


def steps(at, first):
    """Lists of increasing numbers (list i is at[first[i]:first[i + 1]]) as their first number, then the steps between them."""
    import numpy as np

    out = np.diff(at, prepend=0)
    out[first[:-1]] = at[first[:-1]]
    return out


def position_lists(at, first):
    """An Arrow array of lists of increasing positions, each packed by itself."""
    import numpy as np
    import pyarrow as pa

    out, end = packed(steps(at, first))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(end[first].astype(np.int64)), pa.py_buffer(out)])


def positions(lists, counts):
    """The positions of packed lists (bytes), one list after another; counts: their lengths."""
    import numpy as np

    value = numbers(b"".join(lists))
    total = np.cumsum(value)
    first = np.append(0, np.cumsum(counts)[:-1])
    return total - np.repeat(total[first] - value[first], counts) if len(value) else value


def runs(key):
    """The order that sorts the keys (stably), and where in it each distinct key starts, with the length as the last."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]), len(key))


def parts_of(text: bytes, limit: int):
    """The text in parts of about `limit` bytes that end where pieces end."""
    import re

    end = re.compile(b"[" + re.escape(ENDS) + b"]")
    start = 0
    while len(text) - start > limit and (found := end.search(text, start + limit)):
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def word_lists(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, word, n, at: a row for each word of a language in a shard, with its n positions. docs: text, lang."""
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        newline = bytes.maketrans(ENDS, b"\n" * len(ENDS))
        shard, size, held = TaskContext.get().partitionId() << 32, 0, []
        words, langs, known = [b"."], [""], {}  # number 0 is the end of a piece; no word holds a full stop

        class Numbers(dict):
            """Numbers of a language's words, given as they come."""

            def __init__(self, lang):
                super().__init__({b".": 0})
                self.lang = lang

            def __missing__(self, word):
                self[word] = n = len(words)
                words.append(word)
                langs.append(self.lang)
                return n

        def lists():
            ids = np.concatenate(held)
            at = np.flatnonzero(ids)
            order, first = runs(ids[at])
            packed, n = position_lists(at[order], first), np.diff(first)
            names, of = pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(langs[1:], pa.string())
            for i in range(0, len(n), 50_000):
                rows = len(n[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * rows, pa.int64()), of.slice(i, rows), names.slice(i, rows), pa.array(n[i : i + rows], pa.int64()), packed.slice(i, rows).cast(pa.binary())], names=["shard", "lang", "word", "n", "at"])

        for batch in batches:
            for part in pieces(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part, "text")):
                    own = known.get(lang)
                    if own is None:
                        own = known[lang] = Numbers(lang)
                    for some in parts_of(text, shard_bytes):
                        found = (some.lower().translate(newline) + b"\n").replace(b"\n", b" . ").split()  # what is left of white space are blanks and tabs
                        held.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                        size += len(some)
                        if size >= shard_bytes:
                            yield from lists()
                            shard, size, held = shard + 1, 0, []
                            del words[1:], langs[1:]
                            known.clear()
                            own = known[lang] = Numbers(lang)
        if held:
            yield from lists()

    rows = quoted(docs, ["text", "lang"]).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "shard bigint, lang string, word string, n bigint, at binary")


def by_key(batches, name):
    """(key, rows) of runs of equal keys in sorted batches: rows is a list of batches."""
    import numpy as np

    key, held = None, []
    for batch in batches:
        own = batch.column(name).to_numpy()
        edge = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(edge, edge[1:]):
            if a < b and own[a] != key:
                if held:
                    yield key, held
                key, held = int(own[a]), []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield key, held


LISTS = "shard bigint, id binary, last binary, n binary, at binary"


def shard_rows(lists: DataFrame) -> DataFrame:
    """A row for each shard: packed numbers of its lists, in order: id, last word, length n, and all positions. lists: shard, id, n, at."""
    prepare(lists.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for shard, rows in by_key(batches, "shard"):
            ids, n = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("id", "n"))
            order = np.argsort(ids)
            lists = [x for r in rows for x in r.column("at").to_pylist()]
            at = b"".join([lists[i] for i in order.tolist()])
            ids = packed(ids[order])[0].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), *[pa.array([x], pa.binary()) for x in (ids, ids, packed(n[order])[0].tobytes(), at)]], names=["shard", "id", "last", "n", "at"])

    rows = lists.select("shard", "id", "n", "at").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, LISTS)


class Lists:
    """The lists of a shard's phrases of one length, in order of id."""

    def __init__(self, id, last, n, at):
        self.id, self.last, self.n, self.at = id, last, n, at

    @staticmethod
    def read(row):
        n = numbers(row["n"])
        return Lists(numbers(row["id"]), numbers(row["last"]), n, positions([row["at"]], n))

    def columns(self):
        import numpy as np

        first = np.append(0, np.cumsum(self.n))
        return [packed(x)[0].tobytes() for x in (self.id, self.last, self.n, steps(self.at, first))]

    def longer(self, buckets: int):
        """Phrases with one word more, ordered by bucket: left (id), last, n and bucket of each, their positions and where each one's start.
        What starts at p and what starts at p + 1 are merge-joined."""
        import numpy as np

        which = np.repeat(np.arange(len(self.n)), self.n)
        order = np.argsort(self.at)
        at, which = self.at[order], which[order]
        hit = np.flatnonzero(at[1:] == at[:-1] + 1)
        word, code = np.unique(self.last, return_inverse=True)
        order, first = runs(which[hit] * len(word) + code[which[hit + 1]])
        at, lead = at[hit[order]], hit[order][first[:-1]]
        left, last, n = self.id[which[lead]], self.last[which[lead + 1]], np.diff(first)
        mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        start = np.append(0, np.cumsum(n[turn]))
        at = at[np.repeat(first[:-1][turn] - start[:-1], n[turn]) + np.arange(len(at))]
        return left[turn], last[turn], n[turn], bucket[turn], at, start

    def kept(self, buckets: int, rows):
        """The lists of longer phrases that the rows (bucket, keep, ids of `frequent_longer`) name."""
        import numpy as np

        left, last, n, bucket, at, start = self.longer(buckets)
        place, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, keep, own in rows:
            place.append(np.searchsorted(bucket, b) + np.cumsum(numbers(keep)))
            ids.append(numbers(own))
        place, ids = np.concatenate(place), np.concatenate(ids)
        order = np.argsort(ids)
        place, ids = place[order], ids[order]
        end = np.append(0, np.cumsum(n[place]))
        at = at[np.repeat(start[place] - end[:-1], n[place]) + np.arange(end[-1])]
        return Lists(ids, last[place], n[place], at)


def counted_longer(shards: DataFrame, frequent: DataFrame | None, before: int, buckets: int) -> DataFrame:
    """shard, and either a shard's lists (id, last, n, at) of the phrases that `frequent` (shard, bucket, keep, ids of `frequent_longer`) keeps, dealt to
    `before` buckets; or a bucket and the packed (left, last, n) of the shard's phrases with one word more in it. Without `frequent` the shards' own lists are taken, and not repeated."""
    prepare(shards.sparkSession)
    marked = frequent is not None
    kinds = {"shard": "bigint", "bucket": "int", "id": "binary", "last": "binary", "n": "binary", "at": "binary", "left": "binary"}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

        def row(shard, lists, own):
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([shard, None, *lists.columns(), None], types)], names=list(kinds))
            left, last, n, bucket, _, _ = lists.longer(buckets)
            first = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
            (a, a_end), (b, b_end), (c, c_end) = packed(steps(left, first)), packed(last), packed(n)
            cut = lambda data, end: pa.array([data[i:j].tobytes() for i, j in zip(end[first[:-1]].tolist(), end[first[1:]].tolist())], pa.binary())
            k = len(first) - 1
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int64()), pa.array(bucket[first[:-1]], pa.int32()), pa.nulls(k, pa.binary()), cut(b, b_end), cut(c, c_end), pa.nulls(k, pa.binary()), cut(a, a_end)], names=list(kinds))

        if not marked:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from row(r["shard"], Lists.read(r), False)
            return
        for shard, rows in by_key(batches, "shard"):
            rows = [r for batch in rows for r in batch.to_pylist()]
            own = [r for r in rows if r["bucket"] is None]
            marks = [(r["bucket"], r["keep"], r["ids"]) for r in rows if r["bucket"] is not None]
            if own and marks:
                yield from row(shard, Lists.read(own[0]).kept(before, marks), True)

    if marked:
        shards = shards.unionByName(frequent.select("shard", "bucket", "keep", "ids"), allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard")
    return shards.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def frequent_longer(counts: DataFrame, buckets: int, least: int) -> DataFrame:
    """From rows (shard, bucket, left, last, n) of `counted_longer`: left, last, f and id of each phrase that comes `least` times or more, and for each shard
    and bucket which of its phrases those are (keep: packed steps between their places; ids). A bucket holds its phrases' counts of all shards."""
    prepare(counts.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["shard", "bucket", "keep", "ids", "left", "last", "f", "id"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for bucket, rows in by_key(batches, "bucket"):
            rows = [r for batch in rows for r in batch.select(["shard", "left", "last", "n"]).to_pylist()]
            each = [numbers(r["n"]) for r in rows]
            size = np.array([len(x) for x in each])
            n, last = np.concatenate(each), numbers(b"".join([r["last"] for r in rows]))
            left = positions([r["left"] for r in rows], size)
            order = np.lexsort((last, left))
            new = np.append(True, (left[order][1:] != left[order][:-1]) | (last[order][1:] != last[order][:-1]))
            first = np.flatnonzero(new)
            total = np.add.reduceat(n[order], first)
            many = total >= least
            number = np.where(many, np.cumsum(many) * buckets + bucket, 0)  # over 0, and of this bucket only
            lead = order[first[many]]
            k = len(lead)
            if not k:
                continue
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, t) for t in types[:4]], pa.array(left[lead]), pa.array(last[lead]), pa.array(total[many]), pa.array(number[many])], names=names)
            own = np.zeros(len(n), np.int64)
            own[order] = number[np.cumsum(new) - 1]
            end = np.cumsum(size)
            marks = []
            for r, a, b in zip(rows, end - size, end):
                place = np.flatnonzero(own[a:b])
                if len(place):
                    marks.append((r["shard"], bucket, packed(np.diff(place, prepend=0))[0].tobytes(), packed(own[a:b][place])[0].tobytes()))
            m = len(marks)
            yield pa.RecordBatch.from_arrays([*[pa.array(list(x), t) for x, t in zip(zip(*marks), types)], *[pa.nulls(m, t) for t in types[4:]]], names=names)

    rows = counts.where("bucket is not null").select("bucket", "shard", "left", "last", "n").repartition("bucket").sortWithinPartitions("bucket", "shard")
    return rows.mapInArrow(run, "shard bigint, bucket int, keep binary, ids binary, left bigint, last bigint, f bigint, id bigint")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """phrases (lang, size, phrase, f): all phrases of 1 to `longest` words that come `least` times or more in a language, and
    totals (lang, n): its words. docs: text, lang; null texts are empty, and languages that are null are `und`."""
    lists = written(word_lists(docs, shard_bytes), "word-lists")
    totals = written(lists.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    found = lists.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = written(numbered(found.withColumn("key", F.concat_ws("\t", "lang", "phrase")), "key", "id").drop("key"), "words")
    level, out = words, [words.select("lang", F.lit(1).alias("size"), "phrase", "f")]
    shards = written(shard_rows(lists.join(words.select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"])), "shards")
    discard(lists)
    buckets = max(16, shards.count())  # as many as shards: a bucket then holds about as much as a shard
    frequent = None
    for size in range(2, longest + 1):
        old = shards
        if frequent is None:
            counts = counted_longer(shards, None, buckets, buckets)
        else:
            counts = written(counted_longer(shards, frequent.where("shard is not null"), buckets, buckets), f"counts-{size}")
            shards = counts.where("bucket is null").select(*old.columns)
        frequent = written(frequent_longer(counts, buckets, least), f"frequent-{size}")
        named = frequent.where("shard is null").select("left", "last", "f", "id").join(level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head")), "left")
        named = named.join(words.select(F.col("id").alias("last"), F.col("phrase").alias("tail")), "last")
        level = written(named.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), f"phrases-{size}")
        out.append(level.select("lang", F.lit(size).alias("size"), "phrase", "f"))
    return functools.reduce(DataFrame.unionAll, out), totals


def exact(column):
    """A count as a decimal, whose products with percentages and the like don't overflow."""
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language (docs: text, lang).

    A-Z are lower-cased, texts are cut at ENDS, and words are what blanks and tabs separate. Repeated rows count as
    often as they come; null, empty and blank texts have no words; a null language is `und`, as one that is called so. A language without
    candidates and an empty table give no rows.
    """
    phrases, totals = frequent_phrases(docs, least, longest, shard_bytes)
    phrases = written(phrases, "phrases")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "size", words.alias("w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("twice", exact("a") * F.lit(2_000_000)).withColumn("both", exact("l") + exact("r")).withColumn("score", F.expr("twice div both"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Parts of two words or more of longer candidates, with the largest count of what holds them.
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    holding = candidates.where("size > 2").select("lang", "size", words.alias("w"), "a").select("lang", F.explode(spans).alias("phrase"), "a")
    holding = holding.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = best.join(holding, ["lang", "phrase"], "left").where(F.col("over").isNull() | (exact("over") * 100 < exact("a") * covered))

    first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANKS)).alias("part"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*first))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first)).cast("bigint")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), cand AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), holding AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand)) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best b LEFT JOIN holding h ON h.lang = b.lang AND h.phrase = b.phrase JOIN totals t ON t.lang = b.lang
WHERE over IS NULL OR 100 * over < 80 * a
QUALIFY rank <= 2000
"""
