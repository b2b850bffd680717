"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a document marked 1 and one marked 0 are preferences. A linear score of text features is
learned by the logistic loss on the pair's feature differences, so that the better one scores
higher. The cut between good and bad is a quantile of the labelled rows' scores, chosen for
balanced accuracy; scores are mapped so that the cut is 0.5.

Features are shares and ratios of whole texts, cut into bins at their quantiles, and the shares of hashed words.

All labelled rows teach. Their features are dealt to blocks of about BLOCK rows, of which each is one packed row. In an epoch every block learns on from the
model as it is, by pairs in which each of its rows stands TURNS times or more, and the blocks' models are averaged. Quantiles, counts
and the cut are of all rows as well. The driver gets bin edges, sums of weights and counts, but no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from .common import as_bytes, own_key, pieces, prepare, quoted, received, sent, table, written
from .langid import TO_WORDS, held_out

#: Rows of a block on average, and the fewest of a class: rows of a class that has fewer go to more blocks than one.
BLOCK, FEWEST = 8192, 32
#: How often a row of the larger class of a block is in a pair, in an epoch, and the fewest pairs of all blocks.
TURNS, PAIRS = 15, 60_000
EPOCHS, RATE, SHRINK, BINS = 6, 0.2, 1e-4, 12
#: Cuts that are compared at once.
CUTS = 4097
#: Weights are summed as whole numbers of this part, so that sums don't depend on their order.
UNIT = 2.0**-48
#: Buckets of hashed words (a power of two), and the texts that are looked at together.
WORD_BUCKETS, TOGETHER = 1024, 500
NAMES = ("length", "words", "word_size", "upper", "mark", "symbol", "digit", "distinct", "repeat", "top", "short", "line_size", "line_repeat", "sentence", "wide")


def features(text: bytes) -> list[float]:
    """NAMES of a whole text; all are defined for the empty one."""
    import math
    from collections import Counter

    import numpy as np

    n = max(1, len(text))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    line = text.translate(TO_WORDS).split()
    k = max(1, len(line))
    count = Counter(line)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    letters = max(1, int(byte[65:91].sum() + byte[97:123].sum()))
    marks = int(byte[[33, 44, 46, 58, 59, 63]].sum())
    symbols = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()) - marks
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        sum(map(len, words)) / max(1, len(words)),
        float(byte[65:91].sum()) / letters,
        marks / n,
        symbols / n,
        float(byte[48:58].sum()) / n,
        math.log1p(len(count)) / math.log1p(k),
        sum(map(bytes.__eq__, line, line[1:])) / k,
        (max(count.values()) if count else 0) / k,
        sum(len(w) <= 2 for w in line) / k,
        math.log1p(len(text) / m),
        1 - len(set(lines)) / m,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
        float(byte[128:].sum()) / n,
    ]


def word_shares(texts: list[bytes]):
    """A row for each text: how often its words fall into each of WORD_BUCKETS buckets, as a vector of length one (zeros without words)."""
    import numpy as np

    from .paragraphs import hashed_words

    h, _, _, count, _ = hashed_words(texts)
    at = np.repeat(np.arange(len(texts)), count) * WORD_BUCKETS + (h >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int64)
    x = np.bincount(at, minlength=len(texts) * WORD_BUCKETS).reshape(len(texts), WORD_BUCKETS).astype(float)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    edges: object  # inner bin edges of each feature
    weight: object
    words: object  # a weight for each bucket of words
    cut: float = 0.0
    scale: float = 1.0

    def bins(self, x):
        """The number of each feature's bin among all bins."""
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, i], "right") + i * BINS for i, e in enumerate(self.edges)], axis=1)

    def raw(self, x, shares):
        return self.weight[self.bins(x)].sum(axis=1) + (shares * self.words).sum(axis=1)  # row by row, so that equal texts have equal sums

    def scores(self, x, shares):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip((self.raw(x, shares) - self.cut) / self.scale, -60, 60)))


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, the array of features, and the buckets of words that aren't 0 with their shares, packed."""
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text"):
                texts = as_bytes(part, "text")
                for k in range(0, len(texts), TOGETHER):
                    own = texts[k : k + TOGETHER]
                    shares = word_shares(own).astype(np.float32)
                    at = [np.flatnonzero(x) for x in shares]
                    packed = [pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(shares, at)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(k, TOGETHER) for c in keep), pa.array([features(x) for x in own], pa.list_(pa.float64())), *packed], names=[*keep, "features", "at", "share"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return quoted(docs, [*keep, "text"]).mapInArrow(run, f"{kinds}, features array<double>, at binary, share binary")


def dealt(rows: DataFrame, count: dict[int, int], blocks: int) -> DataFrame:
    """block, and what its rows have: y (quality, and 2 more where another block has the row too), features, number of buckets, at, share; all packed."""
    copies = {q: 1 if blocks == 1 else -(-FEWEST * blocks // n) for q, n in count.items()}
    most = F.when(F.col("quality") == 1, F.lit(copies[1])).otherwise(F.lit(copies[0]))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), most - 1))).withColumn("block", F.pmod(F.xxhash64("doc_id", "own", "quality", "copy"), F.lit(blocks)).cast("bigint"))
    rows = rows.select("block", "doc_id", "own", (F.col("quality") + F.when(F.col("copy") > 0, 2).otherwise(0)).cast("int").alias("y"), "copy", "features", "at", "share")
    names = ["block", "y", "features", "n", "at", "share"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(block, held):
            y, x, at, share = (np.concatenate(held[0]), np.concatenate(held[1]), *([b for part in held[i] for b in part] for i in (2, 3)))
            blobs = [y.astype(np.int8).tobytes(), x.tobytes(), np.array([len(b) // 2 for b in at], np.int32).tobytes(), b"".join(at), b"".join(share)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=names)

        own, held = None, None
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(block)]):
                if block[a] != own:
                    if held:
                        yield out(own, held)
                    own, held = int(block[a]), ([], [], [], [])
                part = batch.slice(a, b - a)
                values = part.column("y").to_numpy(zero_copy_only=False), part.column("features").flatten().to_numpy(zero_copy_only=False), part.column("at").to_pylist(), part.column("share").to_pylist()
                for column, value in zip(held, values):
                    column.append(value)
        if held:
            yield out(own, held)

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    met = rows.repartition(tasks, "block").sortWithinPartitions("block", "doc_id", "own", "y", "copy")
    return met.mapInArrow(run, "block bigint, " + ", ".join(f"{c} binary" for c in names[1:]))


def unpacked(y, x, n, at, share):
    """y, features and shares of a block's rows."""
    import numpy as np

    y, n = np.frombuffer(y, np.int8).astype(np.int64), np.frombuffer(n, np.int32)
    shares = np.zeros((len(y), WORD_BUCKETS), np.float32)
    shares[np.repeat(np.arange(len(y)), n), np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
    return y, np.frombuffer(x, np.float64).reshape(len(y), len(NAMES)), shares


def taught(model: Model, place, shares, good, bad, pairs: int, rate: float, turn):
    """The model's weights and words after so many pairs; every row of good and bad is in a pair, as often as the others of its class but for one time."""
    import numpy as np

    weight, words = model.weight.copy(), model.words.copy()
    a, b = (np.concatenate([turn.permutation(x) for _ in range(-(-pairs // len(x)))])[:pairs] for x in (good, bad))
    for k in range(0, pairs, 200):
        up, down = place[a[k : k + 200]], place[b[k : k + 200]]
        apart = shares[a[k : k + 200]] - shares[b[k : k + 200]]
        miss = 1 / (1 + np.exp(weight[up].sum(axis=1) - weight[down].sum(axis=1) + apart @ words))  # the loss's slope
        words += rate * (miss @ apart) / 20 - rate * SHRINK * words
        step = np.bincount(up.ravel(), np.repeat(miss, up.shape[1]), len(weight)) - np.bincount(down.ravel(), np.repeat(miss, down.shape[1]), len(weight))
        weight += rate * step / 20 - rate * SHRINK * weight
    return weight, words


def epoch_of(table: DataFrame, model: Model, epoch: int, blocks: int, rows: int, seed: int) -> Model:
    """The average of what the blocks make of the model in an epoch, each by its number of rows."""
    import numpy as np

    spark = table.sparkSession
    model_in, rate = sent(spark, model), RATE * (1 - epoch / EPOCHS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                y, x, shares = unpacked(*blobs)
                good, bad = np.flatnonzero(y % 2 == 1), np.flatnonzero(y % 2 == 0)
                if len(good) and len(bad):
                    now = received(model_in)
                    got = taught(now, now.bins(x), shares, good, bad, max(TURNS * max(len(good), len(bad)), PAIRS // blocks), rate, np.random.default_rng([seed, epoch, block]))
                    v = np.concatenate([*got, [1.0]]) * (len(y) / rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(np.rint(v / UNIT).astype(np.int64))], names=["i", "v"])

    got = sorted(table.mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect())  # a row for each weight
    model_in.unpersist()
    v = np.array([r.v for r in got], float)
    v = v[:-1] / v[-1]
    return Model(model.edges, v[: len(model.weight)], v[len(model.weight) :])


def scored(table: DataFrame, model: Model) -> DataFrame:
    """y and raw of each row of the blocks, once."""
    model_in = sent(table.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                y, x, shares = unpacked(*blobs)
                once = y < 2
                yield pa.RecordBatch.from_arrays([pa.array(y[once].astype("int32")), pa.array(received(model_in).raw(x[once], shares[once]))], names=["y", "raw"])

    return table.mapInArrow(run, "y int, raw double")


def placed_cut(rows: DataFrame, count: dict[int, int]) -> tuple[float, float]:
    """The quantile of all rows (y, raw) that is fairest to both classes, in the middle of its neighbours, and the deviation of raw. It is found among CUTS values
    over the whole range, and then among as many around the best of them."""
    import numpy as np

    raw = F.col("raw")
    low, high, apart = rows.agg(F.min(raw), F.max(raw), F.stddev_pop(raw)).first()

    def counted(cuts):
        """How many rows of each class are below each cut."""

        def run(batches):
            import pyarrow as pa

            n = np.zeros((2, len(cuts) + 1), np.int64)
            for batch in batches:
                y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "raw"))
                np.add.at(n, (y, np.searchsorted(cuts, x, "right")), 1)
            i = np.flatnonzero(n.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(n.ravel()[i])], names=["i", "n"])

        n = np.zeros(2 * (len(cuts) + 1), np.int64)
        for r in rows.mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
            n[r.i] = r.n
        return np.cumsum(n.reshape(2, -1), axis=1)[:, :-1]

    for _ in range(2):
        cuts = np.linspace(low, high, CUTS)
        below = counted(cuts)
        fair = 0.5 * (1 - below[1] / count[1]) + 0.5 * below[0] / count[0]
        near = -abs(below.sum(axis=0) - count[0])  # to the share of bad rows
        best = max(range(CUTS), key=lambda k: (fair[k], near[k]))
        cut, low, high = float(cuts[best]), float(cuts[max(0, best - 1)]), float(cuts[min(CUTS - 1, best + 1)])
    least, most = rows.agg(F.max(F.when(raw < cut, raw)), F.min(F.when(raw >= cut, raw))).first()
    return cut if least is None or most is None else (least + most) / 2, apart


def train(docs: DataFrame, labels: DataFrame, seed: int = 11, block: int = BLOCK) -> Model:
    """Fit on all rows of docs (doc_id, text) that labels (doc_id, quality) mark. Rows of null quality teach nothing."""
    import numpy as np

    labels = quoted(labels, ["doc_id", "quality"]).where("quality in (0, 1) and doc_id is not null").dropDuplicates()
    # One plan at any size: as many labels as documents are not to be sent to all tasks.
    marked = quoted(docs, ["doc_id", "text"]).join(labels.hint("merge"), "doc_id").select("doc_id", "quality", own_key().alias("own"), "text")
    rows = written(featured(marked, ["doc_id", "quality", "own"]), "labelled-features")
    count = {int(r.quality): r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:  # nothing to compare: all texts get the class that there is, or 1
        one = float(next(iter(count), 1))
        return Model([np.zeros(0)] * len(NAMES), np.zeros(len(NAMES) * BINS), np.zeros(WORD_BUCKETS), cut=1.0 - 2 * one)
    inner = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    edges = {r.i: np.unique(r.q) for r in exact_quantiles(rows.select(F.posexplode("features").alias("i", "x")), "i", "x", inner).collect()}
    model = Model([edges[i] for i in range(len(NAMES))], np.zeros(len(NAMES) * BINS), np.zeros(WORD_BUCKETS))
    blocks = max(1, sum(count.values()) // block)
    packed = written(dealt(rows, count, blocks), "labelled-blocks")
    for epoch in range(EPOCHS):
        model = epoch_of(packed, model, epoch, blocks, sum(count.values()), seed)
    model.cut, apart = placed_cut(written(scored(packed, model), "labelled-scores"), count)
    model.scale = float(max(1e-6, apart / 2))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score, predicted. Rows that repeat are scored alike.

    Null text is scored as empty. Texts are read whole. Equal texts get equal scores; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    model_in = sent(spark, model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text"):
                texts, got = as_bytes(part, "text"), []
                for k in range(0, len(texts), TOGETHER):
                    own = texts[k : k + TOGETHER]
                    got.append(received(model_in).scores(np.array([features(x) for x in own], float), word_shares(own)))
                got = np.concatenate(got)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return quoted(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return score(docs, model).withColumn("held_out", held_out(3, 1)).select("doc_id", "held_out", "score", "predicted")
