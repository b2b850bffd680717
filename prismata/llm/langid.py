"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's subwords are its byte n-grams between word marks, hashed into BUCKETS rows of an embedding
table. A text is the average of the embeddings of all its subwords; a linear layer and a softmax
give the languages' probabilities. Both are trained by stochastic gradient descent in numpy on the
driver, on a bounded sample: about PER_LANGUAGE rows of each language, as bags of hashed subwords
made on the executors from whole texts. A fifth of the sample sets the temperature that calibrates
the probabilities and the confidence under which a text is rejected.

For prediction the two layers fold into one row of logits for each bucket, and a worker remembers
the summed rows of words it has met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, pieces, prepare, quoted, received, sent, table

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (1, 2, 3, 4, 5)
#: Bound of the training sample: about so many labelled rows of each language, and about MOST_ROWS in all, but never
#: fewer than LEAST_ROWS of a language. More than MOST_LANGUAGES languages are an error, not left out.
PER_LANGUAGE, MOST_ROWS, LEAST_ROWS, MOST_LANGUAGES = 500, 4000, 20, 1000
EPOCHS, RATE = 8, 4.0
#: Share of rightly named texts that may be rejected, and the calibrated confidence from which on none is: where the chance
#: of an error is a quarter or less.
REJECTED, CERTAIN = 0.002, 0.75
#: About how many bytes of words a worker remembers before it starts anew.
CACHE_BYTES = 32 << 20
#: A-Z to a-z; other ASCII characters separate words.
TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def subwords(words: list[bytes]):
    """The buckets of all subwords of the words, and where each word's begin."""
    import numpy as np

    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint32)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(letters))  # letters to the word's end
    h = np.zeros(len(letters), np.uint32)
    found, own = [], []
    word = np.repeat(np.arange(len(words)), size)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(letters) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + letters[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS))
            own.append(word[at])
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(own[order], np.arange(len(words)))


@dataclass
class Model:
    languages: list[str]
    logits: object  # a row for each bucket, and a last column of ones
    bias: object
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, sums):
        """sums: for each text the summed rows of its subwords."""
        import numpy as np

        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, lang, buckets, counts: each text as a bag of hashed subwords, BUCKETS of them at most."""
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "text"):
                for i, text in enumerate(as_bytes(part, "text")):
                    words = text.translate(TO_WORDS).split()
                    total = np.zeros(BUCKETS, np.int64)
                    for k in range(0, len(words), 50_000):
                        total += np.bincount(subwords(words[k : k + 50_000])[0], minlength=BUCKETS)
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id")[i : i + 1].cast(pa.int64()), part.column("lang")[i : i + 1], pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[at].astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "lang", "buckets", "counts"]
                    )

    return quoted(docs, ["doc_id", "lang", "text"]).mapInArrow(run, "doc_id bigint, lang string, buckets array<int>, counts array<int>")


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on rows (doc_id, lang, text). Rows without lang or doc_id teach nothing; rows that repeat teach as often as they stand."""
    import numpy as np

    rows = rows.where("lang is not null and doc_id is not null")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(count) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not count:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(0), 1.0, 2.0)
    top = 1 << 30
    per_language = max(min(per_language, MOST_ROWS / len(count)), LEAST_ROWS)
    share = F.create_map(*[x for k, n in count.items() for x in (F.lit(k), F.lit(int(top * min(1.0, per_language / n))))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(top)) < share[F.col("lang")])
    languages = sorted(count)
    got = bags(sample).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    y, xs = [], []
    for lang, at, n in zip(got.column("lang").to_pylist(), got.column("buckets"), got.column("counts")):
        at, n = at.values.to_numpy(), n.values.to_numpy()
        if len(at):
            y.append(languages.index(lang))
            xs.append((at.copy(), (n / n.sum()).astype(np.float32)))
    del got
    y = np.array(y, np.int64)
    turn = np.random.default_rng(seed)
    order = turn.permutation(len(xs))
    held, taught = order[: len(xs) // 5], order[len(xs) // 5 :]
    table_, out, bias = turn.normal(0, 0.05, (BUCKETS, WIDTH)), turn.normal(0, 0.3, (WIDTH, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in turn.permutation(taught):
            at, weight = xs[i]
            v = weight @ table_[at]
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= 0.1 * rate * np.outer(v, p)
            bias -= 0.001 * rate * p
            table_[at] -= rate * np.outer(weight, back)
    model = Model(languages, np.hstack([table_ @ out, np.ones((BUCKETS, 1))]), bias)
    if len(held):
        sums = np.stack([np.append(w @ model.logits[a][:, :-1], 1.0) for a, w in (xs[i] for i in held)])
        right = np.arange(len(held)), y[held]
        loss = []
        grid = np.geomspace(0.1, 10, 41)
        for t in grid:
            model.temperature = t
            loss.append(-np.log(np.maximum(model.probabilities(sums)[right], 1e-9)).mean())
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.probabilities(sums)
        ok = p.argmax(axis=1) == y[held]
        if ok.any():
            model.threshold = min(CERTAIN, float(np.quantile(p.max(axis=1)[ok], REJECTED)))
    return model


class Predictor:
    """A worker's model, with the summed rows of the words that it has met."""

    def __init__(self, model: Model):
        import regex

        self.model, self.letter = model, regex.compile(r"\p{L}").search
        self.forget()

    def forget(self):
        import numpy as np

        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.model.logits.shape[1]))

    def __call__(self, texts: list[bytes]):
        """The language, the score, and whether it is rejected, for each text."""
        import numpy as np

        model, place = self.model, self.place
        if len(place) * (8 * self.rows.shape[1] + 120) > CACHE_BYTES:
            self.forget()
            place = self.place
        lines = [t.translate(TO_WORDS).split() for t in texts]
        new = list({w for line in lines for w in line if w not in place})
        for k in range(0, len(new), 20_000):
            own = new[k : k + 20_000]
            bucket, start = subwords(own)
            place.update(zip(own, range(len(place), len(place) + len(own))))
            if len(place) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros((max(len(self.rows), len(place) - len(self.rows)), self.rows.shape[1]))])
            self.rows[len(place) - len(own) : len(place)] = np.add.reduceat(model.logits[bucket], start, axis=0)
        sums = np.zeros((len(texts), self.rows.shape[1]))
        for i, line in enumerate(lines):
            if line:
                sums[i] = self.rows[np.fromiter(map(place.__getitem__, line), np.int64, len(line))].sum(axis=0)
        known = np.array([bool(model.languages) and self.letter(t.decode("utf-8", "replace")) is not None for t in texts], bool)
        p = model.probabilities(sums) if model.languages else np.zeros((len(texts), 1))
        score = np.where(known, p.max(axis=1), 0.0)
        names = [model.languages[b] if k else "und" for b, k in zip(p.argmax(axis=1).tolist(), known.tolist())]
        return names, score, ~known | (score < model.threshold)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score, rejected.

    score is the calibrated probability of lang_pred. Texts that are null or have no letter get `und`,
    score 0, and are rejected; so are texts whose score is under the model's threshold. Texts of any
    length are read whole. Equal texts get equal results; an empty table gives no rows. With no
    labelled rows at all every text is `und`.
    """
    model_in = sent(prepare(docs.sparkSession), model)

    def run(batches):
        import pyarrow as pa

        predict = Predictor(received(model_in))
        for batch in batches:
            for part in pieces(batch, "text"):
                names, score, rejected = predict(as_bytes(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return quoted(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose text is not rejected; without a shuffle."""
    model_in = sent(prepare(docs.sparkSession), model)

    def run(batches):
        import pyarrow as pa

        predict = Predictor(received(model_in))
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(~predict(as_bytes(part, "text"))[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int, remainder: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without the texts that a model taught on them (rows not held out) rejects, all columns kept."""
    return accepted(docs, train(docs.where(~held_out(5, 0))))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(5, 0)))
    return identify(docs, model).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
