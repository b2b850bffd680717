"""Near-duplicate embeddings by product quantisation.

1. Equal vectors of a label are one class. A codebook is fitted on a bounded sample: centres of coarse lists (first those of
   dense spots, then k-means), and a small codebook for each part of the residuals.
2. Each vector goes into the list of its nearest centre, with its residual's code and its angle to
   what the code stands for. It also probes the lists of centres that a neighbour could be in: those whose border
   with its own list is near enough, by the angle of the threshold and the spread of residuals.
3. A list of one label is cut into chunks of bounded size, large ones by their angle to the centre first. By that angle alone
   most chunks of a dense spot are known to link as a whole, or not at all; these are counted without looking at pairs.
4. Else codes visit chunks: each task looks up the distances between the chunk's vectors and the
   visitors' codes in tables. The angle of a code's error bounds what the lookup may be wrong by, so no near pair is lost here.
5. Only visitors with a candidate send their vector, for the exact cosine. Pairs are counted in the task;
   links leave it only as far as they connect something.

What can be missed are neighbours whose lists don't probe each other; see `recall` in the tests and README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import discard
from .common import prepare, received, sent, table, written

#: Cosine of links.
SIMILAR = 0.93
#: Vectors that the codebook is fitted on at most; coarse lists at most; parts of a residual and codes of a part.
SAMPLE, LISTS, PARTS, CODES = 16_384, 4096, 8, 256
#: Standard deviations of a neighbour's way towards another list that probes cover.
SPREAD = 3.0
#: Vectors of a chunk at about most, and visits of a chunk that one task takes.
CHUNK, VISITS = 2048, 16_384
#: Shells of angle, from centre to threshold, that lists of more than CHUNK vectors are cut into.
SHELLS = 16
#: Room for rounding when angles decide, and when looked-up distances do.
TIGHT, LOOSE = 1e-6, 1e-3


def unit_rows(vectors, width: int):
    """A matrix of unit vectors; shorter ones are filled up with zeros."""
    import numpy as np

    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(vectors), width))
    if len(vectors):
        flat = np.concatenate([np.asarray(v, float) for v in vectors])
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), 1e-300)  # large components would overflow when squared
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


class Codebook:
    """Coarse centres and residual codes, fitted on the rows of a matrix of unit vectors."""

    def __init__(self, x, lists: int, similar: float, seed: int = 11):
        import numpy as np

        turn = np.random.default_rng(seed)
        self.angle = float(np.arccos(similar))
        dense = self.dense_spots(x)
        far = x if not len(dense) else x[(x @ dense.T).max(axis=1) < np.cos(self.angle)]
        rest = min(max(lists - len(dense), 1), len(far))
        centre = self.means(far, far[np.sort(turn.choice(len(far), rest, replace=False))], True) if rest else far[:0]
        self.centre = np.vstack([dense, centre])
        home = (x @ self.centre.T).argmax(axis=1)
        left = x - self.centre[home]
        spread = np.linalg.svd(left - left.mean(axis=0), compute_uv=False) ** 2
        wide = spread.sum() ** 2 / max((spread**2).sum(), 1e-300)  # directions that residuals take in effect
        self.margin = float(np.tan(self.angle) * min(1.0, SPREAD / max(wide, 1e-9) ** 0.5))
        self.cut = np.linspace(0, x.shape[1], PARTS + 1).astype(int)
        self.books = []
        for a, b in zip(self.cut, self.cut[1:]):
            own = left[:, a:b]
            self.books.append(self.means(own, own[turn.choice(len(own), min(CODES, len(own)), replace=False)], False))

    def dense_spots(self, x):
        """Centres of spots that hold a five-hundredth of the rows or more within half the threshold's angle, further than that angle from each other."""
        import numpy as np

        near, least = np.cos(self.angle / 2), max(16, len(x) // 500)
        count = np.concatenate([(x[i : i + 1024] @ x.T >= near).sum(axis=1) for i in range(0, len(x), 1024)])
        out = []
        while len(count) and count.max() >= least:
            middle = x[x @ x[count.argmax()] >= near].mean(axis=0)
            middle /= np.linalg.norm(middle)
            count[count.argmax()] = 0
            count[x @ middle >= np.cos(self.angle)] = 0
            out.append(middle)
        return np.array(out).reshape(-1, x.shape[1])

    @staticmethod
    def means(x, centre, unit: bool, rounds: int = 8):
        import numpy as np

        for _ in range(rounds):
            near = np.concatenate([(x[i : i + 4096] @ centre.T - (0 if unit else (centre**2).sum(axis=1) / 2)).argmax(axis=1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            size = np.bincount(near, minlength=len(centre))[:, None]
            new = np.where(size > 0, total / np.maximum(size, 1), centre)
            if unit:
                length = np.linalg.norm(new, axis=1, keepdims=True)
                new = np.where(length > 1e-9, new / np.maximum(length, 1e-9), centre)
            if np.allclose(new, centre):
                break
            centre = new
        return centre

    def encoded(self, x):
        """Home lists, angles to their centres, codes, angles to what the codes stand for and its length, and a matrix of the lists to probe."""
        import numpy as np

        score = x @ self.centre.T
        home = score.argmax(axis=1)
        own = score[np.arange(len(x)), home]
        apart = np.sqrt(np.maximum(2 - 2 * (self.centre[home] @ self.centre.T), 0))
        probe = own[:, None] - score <= self.margin * apart
        probe[np.arange(len(x)), home] = False
        left, code = x - self.centre[home], np.zeros((len(x), PARTS), np.uint8)
        stands = self.centre[home].copy()
        for k, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
            code[:, k] = (left[:, a:b] @ self.books[k].T - (self.books[k] ** 2).sum(axis=1) / 2).argmax(axis=1)
            stands[:, a:b] += self.books[k][code[:, k]]
        length = np.maximum(np.linalg.norm(stands, axis=1), 1e-12)
        angle = lambda c: np.arccos(np.clip(c, -1, 1))
        return home, angle(score), code, angle((x * stands).sum(axis=1) / length), length, probe

    def tables(self, x):
        """What distances from the rows of x to codes are looked up in: products with the centres, and with each part's codes."""
        return x @ self.centre.T, [x[:, a:b] @ book.T for a, b, book in zip(self.cut, self.cut[1:], self.books)]


def vector_classes(rows: DataFrame, key: str, vec: str, label: str) -> tuple[DataFrame, list]:
    """Classes of equal vectors and labels (id, grp, k1, k2, vec, low: smallest key, n), written; and the columns grp, k1, k2 that name a row's class,
    null where a row is compared with nothing."""
    v = F.col(f"`{vec}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(good & F.col(f"`{label}`").isNotNull(), F.lit(False))
    # Only vectors of one length are compared; two hashes tell the vectors of a label apart.
    named = [F.when(good, F.xxhash64(F.lit(seed), F.col(f"`{label}`"), F.size(v), *([v] if seed else []))).alias(name) for seed, name in enumerate(("grp", "k1", "k2"))]
    found = rows.select(*named, v.alias("vec"), F.col(f"`{key}`").alias("low")).where("grp is not null")
    classes = found.groupBy("grp", "k1", "k2").agg(F.first("vec").alias("vec"), F.min("low").alias("low"), F.count("*").alias("n"))
    return written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes"), named


def placed(classes: DataFrame, book, width: int) -> DataFrame:
    """id, grp, n, vec, home, angle, code, err, size, probes and turns (lists to probe and angles to their centres) of each class, and its chunk; written."""
    spark = classes.sparkSession
    prepare(spark)
    kind = classes.schema["vec"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = received(book)
        step = max(64, 4_000_000 // len(model.centre))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                home, angle, code, err, size, probe = model.encoded(unit_rows(part.column("vec").to_pylist(), width))
                row, cell = np.nonzero(probe)
                first = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(home)))), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (cell.astype(np.int32), angle[row, cell])]
                own = [pa.array(home, pa.int32()), pa.array(angle[np.arange(len(home)), home]), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err), pa.array(size)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grp"), part.column("n"), part.column("vec"), *own, *lists], names=["id", "grp", "n", "vec", "home", "angle", "code", "err", "size", "probes", "turns"])

    rows = classes.select("id", "grp", "n", "vec").mapInArrow(run, f"id bigint, grp bigint, n bigint, vec {kind}, home int, angle double, code binary, err double, size double, probes array<int>, turns array<double>")
    return written(rows, "encoded-vectors")


def chunked(rows: DataFrame, angle: float, chunk: int) -> DataFrame:
    """rows with their chunk (bigint): small lists of a label are one, large ones are cut by angle to the centre, and then evenly."""
    shell = F.floor(F.col("angle") * (SHELLS / angle)).cast("int")
    sizes = rows.select("grp", "home", shell.alias("shell")).groupBy("grp", "home", "shell").agg(F.count("*").alias("m"))
    large = written(sizes.groupBy("grp", "home").agg(F.sum("m").alias("all"), F.collect_list(F.struct("shell", "m")).alias("s")).where(F.col("all") > chunk), "large-lists")  # 180 degrees of shells at most
    shells = written(large.select("grp", "home", F.inline("s")).select("grp", "home", "shell", F.ceil(F.col("m") / chunk).alias("cuts")), "large-shells")
    out = rows.withColumn("shell", shell).join(shells, ["grp", "home", "shell"], "left")
    cut = F.when(F.col("cuts").isNull(), F.xxhash64("grp", "home")).otherwise(F.xxhash64("grp", "home", "shell", F.pmod(F.xxhash64(F.lit("cut"), "id"), F.col("cuts"))))
    return out.withColumn("chunk", cut).drop("shell", "cuts")


def grouped(batches):
    """(key, batch) for each run of equal (chunk, salt) within sorted batches."""
    import numpy as np

    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("chunk", "salt")]
        edge = [0, *(np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:]):
            if a < b:
                yield (int(keys[0][a]), int(keys[1][a])), batch.slice(a, b - a)


class Members:
    """The vectors of a chunk: they come first in its group, then its visitors."""

    def __init__(self, width: int, lists: int):
        self.width, self.lists, self.key, self.held = width, lists, None, []

    def split(self, key, batch):
        """Whether the group is new, and the visitors of the batch."""
        import numpy as np

        new = key != self.key
        if new:
            self.key, self.held, self.ready = key, [], False
        kind = batch.column("kind").to_numpy()
        n = int(np.searchsorted(kind, 1))
        if n:
            self.held.append(batch.slice(0, n))
        return new, batch.slice(n)

    def open(self):
        import numpy as np

        if self.ready:
            return False
        self.ready = True
        column = lambda c: [x for b in self.held for x in b.column(c).to_pylist()]
        self.id, self.n = np.array(column("id"), np.int64), np.array(column("n"), np.int64)
        self.home = column("home")[0] if len(self.id) else -1
        self.x = unit_rows(column("vec"), self.width)
        self.probes = np.zeros((len(self.id), self.lists), bool)
        for i, p in enumerate(column("probes")):
            self.probes[i, p] = True
        return True

    def allowed(self, visitor, home):
        """Which pairs of members and visitors are looked at here: not a vector with itself, and of lists that probe each other only from the lower one."""
        import numpy as np

        return (self.id[:, None] != visitor[None, :]) & ~(self.probes[:, home] & (np.asarray(home) > self.home)[None, :])


def with_candidates(rows: DataFrame, book, width: int, similar: float) -> DataFrame:
    """chunk, salt, id of the visitors that may be near a member, by looking up distances to their codes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = received(book)
        limit = float(np.arccos(similar)) + LOOSE
        members = Members(width, len(model.centre))
        for key, batch in grouped(batches):
            _, visitors = members.split(key, batch)
            if not visitors.num_rows:
                continue
            if members.open():
                coarse, tables = model.tables(members.x)
            who, home, err, size = (visitors.column(c).to_numpy() for c in ("id", "home", "err", "size"))
            code = np.frombuffer(b"".join(visitors.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            near = np.zeros(len(who), bool)
            for i in range(0, len(who), step := max(1, 1_000_000 // max(1, len(members.id)))):
                part = slice(i, i + step)
                dot = coarse[:, home[part]]
                for k in range(PARTS):
                    dot += tables[k][:, code[part, k]]
                turn = np.arccos(np.clip(dot / size[part], -1, 1))
                near[part] = ((np.abs(turn - err[part]) <= limit) & members.allowed(who[part], home[part])).any(axis=0)
            keep = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([visitors.column(c).take(keep) for c in ("chunk", "salt", "id")], names=["chunk", "salt", "id"])

    return rows.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "kind").mapInArrow(run, "chunk bigint, salt int, id bigint")


def exact_links(rows: DataFrame, width: int, lists: int, similar: float) -> DataFrame:
    """a, b, gain: links that connect what the chunks' members and visitors link to (gain null), and by how many rows the links of a grow (b null)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(a, b, gain):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(gain, pa.int64())], names=["a", "b", "gain"])

        def counts(ids, n):
            keep = n > 0
            return table(ids[keep], [None] * int(keep.sum()), n[keep])

        members, gain = Members(width, lists), None
        for key, batch in grouped(batches):
            new = key != members.key
            if new and gain is not None:
                yield counts(members.id, gain)
                gain = None
            _, visitors = members.split(key, batch)
            if not visitors.num_rows:
                continue
            if members.open():
                gain, group = np.zeros(len(members.id), np.int64), np.arange(len(members.id))
            who, home, n, own = (visitors.column(c).to_numpy() for c in ("id", "home", "n", "from"))
            vec = visitors.column("vec")
            for i in range(0, len(who), step := max(1, 1_000_000 // max(1, len(members.id)))):
                part = slice(i, i + step)
                hit = (members.x @ unit_rows(vec.slice(i, step).to_pylist(), width).T >= similar) & members.allowed(who[part], home[part])
                yield counts(who[part], members.n @ hit)
                gain += hit @ np.where(own[part] == key[0], 0, n[part])  # members that visit their own chunk count for themselves
                linked = np.flatnonzero(hit.any(axis=0))
                first = hit[:, linked].argmax(axis=0)
                a, b = [who[part][linked]], [members.id[first]]
                if (group != group[0]).any():
                    for j, f in zip(linked.tolist(), first.tolist()):
                        own_hits = np.flatnonzero(hit[:, j])
                        found, place = np.unique(group[own_hits], return_index=True)
                        if len(found) > 1:  # this visitor connects members that weren't: a link to one of each group
                            a.append(np.full(len(found), who[part][j]))
                            b.append(members.id[own_hits[place]])
                            group[np.isin(group, found)] = group[f]
                a, b = np.concatenate(a), np.concatenate(b)
                yield table(a, b, [None] * len(a))
        if gain is not None:
            yield counts(members.id, gain)

    return rows.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "kind").mapInArrow(run, "a bigint, b bigint, gain bigint")


def links(classes: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK, visits: int = VISITS, lists: int | None = None, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) that connect linked classes of `vector_classes`, and gains (id, gain): to how many rows of other classes each links. Both are written."""
    spark = classes.sparkSession
    prepare(spark)
    total = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not total.n:
        return spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "id bigint, gain bigint")
    taken = [r.vec for r in classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()]
    model = Codebook(unit_rows(taken, total.width), lists or min(LISTS, max(8, round(total.n**0.5 / 2))), similar)
    book, angle, n_lists = sent(spark, model), model.angle, len(model.centre)
    rows = chunked(placed(classes, book, total.width), angle, chunk)
    chunks = rows.groupBy("chunk", "grp", "home").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("n").alias("rows"), F.min("id").alias("lead"))
    chunks = written(chunks, "vector-chunks")

    # Chunks of one list: most are decided by angles.
    left, right = (chunks.select("grp", "home", *[F.col(c).alias(f"{c}_{x}") for c in ("chunk", "lo", "hi", "rows", "lead")]) for x in "ab")
    pairs = left.join(right, ["grp", "home"]).where("chunk_a <= chunk_b").where(F.greatest(F.col("lo_a") - F.col("hi_b"), F.col("lo_b") - F.col("hi_a")) <= angle + TIGHT)
    pairs = written(pairs.withColumn("sure", F.col("hi_a") + F.col("hi_b") <= angle - TIGHT), "chunk-pairs")
    sure = pairs.where("sure")
    whole = sure.select(F.col("chunk_a").alias("chunk"), F.col("rows_b").alias("more")).unionAll(sure.where("chunk_a != chunk_b").select(F.col("chunk_b").alias("chunk"), F.col("rows_a").alias("more")))
    whole = whole.groupBy("chunk").agg(F.sum("more").alias("more"))
    inner = sure.where("chunk_a = chunk_b").select(F.col("chunk_a").alias("chunk"), F.col("lead_a").alias("lead"))
    stars = rows.select("id", "chunk").join(inner, "chunk").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    between = sure.where("chunk_a != chunk_b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    own = inner.select("chunk", F.lit(1).alias("own"))
    spared = rows.select("id", "n", "chunk").join(whole, "chunk").join(own, "chunk", "left").select("id", (F.col("more") - F.when(F.col("own").isNotNull(), F.col("n")).otherwise(0)).alias("gain"))

    # Codes that visit chunks: of their own list where angles don't decide, and of the lists that they probe.
    code = ["id", "home", "code", "err", "size"]
    near = rows.select("chunk", *code).join(pairs.where("not sure").select(F.col("chunk_a").alias("chunk"), F.col("chunk_b").alias("to")), "chunk")
    probing = rows.select("grp", *code, F.explode(F.arrays_zip("probes", "turns")).alias("p")).select("grp", F.col("p.probes").alias("cell"), F.col("p.turns").alias("turn"), *code)
    lists_of = chunks.select("grp", F.col("home").alias("cell"), F.col("chunk").alias("to"), "lo", "hi")
    far = probing.join(lists_of, ["grp", "cell"]).where(F.greatest(F.col("lo") - F.col("turn"), F.col("turn") - F.col("hi")) <= angle + TIGHT)
    visiting = written(near.select("to", *code).unionAll(far.select("to", *code)).withColumnRenamed("to", "chunk"), "visits")
    busy = written(visiting.groupBy("chunk").agg(F.ceil(F.count("*") / visits).cast("int").alias("salts")), "visited-chunks")
    inside = written(rows.join(busy, "chunk").select("chunk", "salts", "id", "n", "home", "vec", "probes"), "visited-members")
    inside = inside.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = visiting.join(busy, "chunk").withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.col("salts")).cast("int"))
    members = inside.select("chunk", "salt", F.lit(0).alias("kind"), "id", "n", "home", "vec", "probes")
    met = members.unionByName(salted.select("chunk", "salt", F.lit(1).alias("kind"), *code), allowMissingColumns=True)
    candidates = written(with_candidates(met, book, total.width, similar), "candidates")

    # Exact cosines for what is left.
    used = candidates.select("chunk", "salt").distinct()
    vectors = rows.select("id", "n", "home", "vec", F.col("chunk").alias("from"))
    coming = candidates.join(vectors, "id").select("chunk", "salt", F.lit(1).alias("kind"), "id", "n", "home", "vec", "from")
    met = members.join(used, ["chunk", "salt"], "left_semi").unionByName(coming, allowMissingColumns=True)
    found = written(exact_links(met, total.width, n_lists, similar), "vector-links")
    edges = found.where("gain is null").select("a", "b").unionAll(stars).unionAll(between)
    gains = found.where("gain is not null").select(F.col("a").alias("id"), "gain").unionAll(spared)
    return written(edges, "vector-edges"), written(gains.groupBy("id").agg(F.sum("gain").alias("gain")), "vector-gains")


def near_duplicate_vectors(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", similar: float = SIMILAR, **how) -> DataFrame:
    """One row per row of rows: key, n_links, component_id, kept.

    Rows of equal labels link at a cosine of `similar` or more. Vectors that are null, empty or zero, that hold nulls, NaN or
    infinities, or that have no label link with nothing; vectors of different lengths don't link. Equal vectors link, so a
    repeated row links with its copies, and all rows of a component's smallest key are kept. A null key is
    no component's id unless it has no other. An empty table gives no rows. Other columns are ignored.
    """
    classes, named = vector_classes(rows, key, vec, label)
    edges, gains = links(classes, similar, **how)
    roots = components(edges)
    own = classes.select("id", "grp", "k1", "k2", "low", "n").join(gains, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    own = written(own.select("grp", "k1", "k2", "low", (F.coalesce("gain", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "class-links")
    # Written first: a join with an aggregate of its own stage can't be split where many classes share a root.
    least = written(own.groupBy("root").agg(F.min("low").alias("component_id")), "component-names")
    own = written(own.join(least, "root").select("grp", "k1", "k2", "n_links", "component_id"), "named-classes")
    discard(classes)
    name = F.col(f"`{key}`")
    out = rows.select(name.alias(key), *named).join(own, ["grp", "k1", "k2"], "left")
    alone = F.col("n_links").isNull()
    root = F.when(alone, F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.col(key).eqNullSafe(root).alias("kept"))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
)
SELECT e.vec_id, (SELECT count(*) FROM pairs WHERE a = e.vec_id) AS n_links,
       least(e.vec_id, (SELECT min(b) FROM reach WHERE a = e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, (SELECT min(b) FROM reach WHERE a = e.vec_id)) AS kept
FROM embeddings e
"""
