"""All pairs of vectors with a cosine of t or more, exactly, by cells around pivots.

Each vector belongs to the cell of its nearest pivot. By the triangle inequality a neighbour can only be in a cell whose border
is within the threshold's angle, and whose members reach far enough from their pivot; only such cells are visited, and of two cells only one
way. Large cells are cut into chunks and chunks with many visitors are dealt to several tasks, so no task holds more than a chunk and a
batch. The bounds are exact: what they leave out can't link. Where data have no structure they leave out little, and vectors
then meet all cells, but never as pairs: products of a chunk with a batch stay in the task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .scoring import projected

#: Vectors of a cell on average, pivots at most, vectors of a chunk at about most, and visitors of a chunk that one task takes.
CELL, PIVOTS, CHUNK, VISITS = 4096, 4096, 8192, 65_536
#: Room for rounding of angles.
SLACK = 1e-6


def pivots_of(vectors: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """n of the vectors, by hash."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), "accession"), "accession").limit(n)


def placed(vectors: DataFrame, angle: float, cells: int | None) -> DataFrame:
    """accession, vec (unit), cell and the cells that it visits, its own included; written. Vectors without a number or of length zero are left out."""
    spark = vectors.sparkSession
    real = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = projected(vectors.select("accession", F.col("vec").cast("array<double>").alias("vec")).where("accession is not null and vec is not null").where(real))
    rows = written(rows.select("accession", "vec"), "unit-vectors")
    n = rows.count()
    chosen = [r.vec for r in pivots_of(rows, cells or min(PIVOTS, -(-n // CELL))).select("vec").collect()]  # at most PIVOTS
    sent = spark.sparkContext.broadcast(chosen)

    def homes(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(sent.value, float)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                near = np.array(part.column("vec").to_pylist(), float) @ p.T
                cell = near.argmax(axis=1)
                far = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["accession", "vec", "cell", "far"])

    kind = "accession string, vec array<double>, cell int"
    home = written(rows.mapInArrow(homes, f"{kind}, far double"), "vector-cells")
    reach = {r.cell: (r.low, r.high) for r in home.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # a row a pivot
    rings = spark.sparkContext.broadcast(reach)

    def visits(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(sent.value, float)
        low, high = (np.array([rings.value.get(c, (9.0, -9.0))[k] for c in range(len(p))]) for k in (0, 1))
        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                near = np.array(part.column("vec").to_pylist(), float) @ p.T
                cell = part.column("cell").to_numpy()
                turn = np.arccos(np.clip(near, -1, 1))
                # The angle to a border is that whose sine is the distance to the plane between two pivots.
                border = (near[np.arange(len(cell)), cell][:, None] - near) <= np.sin(min(angle, np.pi / 2)) * apart[cell] + SLACK
                ring = np.maximum(low - turn, turn - high) <= angle + SLACK
                go = border & ring & (np.arange(len(p)) >= cell[:, None])
                go[np.arange(len(cell)), cell] = True
                row, to = np.nonzero(go)
                first = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(cell)))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("accession"), part.column("vec"), part.column("cell"), pa.ListArray.from_arrays(first, pa.array(to, pa.int32()))], names=["accession", "vec", "cell", "to"])

    return written(home.mapInArrow(visits, f"{kind}, to array<int>"), "visiting-vectors")


def vector_edges(vectors: DataFrame, t: float, cells: int | None = None, chunk: int = CHUNK, visits: int = VISITS, spanning: bool = False) -> DataFrame:
    """src < dst, similarity: all pairs of vectors (accession: unique, vec) whose cosine is t (over 0) or more; written. With `spanning` only links
    that connect the same components, fewer than a chunk has members and visitors. Null, zero and unfinished vectors link with nothing."""
    import math

    if not 0 < t <= 1:
        raise ValueError("t must be over 0 and at most 1")
    rows = placed(vectors, math.acos(t), cells)
    sizes = written(rows.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "cell-sizes")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "accession"), F.col("chunks")).cast("int")
    rows = rows.join(sizes, "cell").withColumn("chunk", own).select("accession", "vec", "cell", "chunk", "to")
    going = rows.select("accession", "vec", "cell", "chunk", F.explode("to").alias("in")).join(sizes.select(F.col("cell").alias("in"), "chunks"), "in")
    # Chunks of one cell meet once: the higher one visits the lower one, and each itself.
    going = going.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("in") == F.col("cell"), F.col("chunk")).otherwise(F.col("chunks") - 1))))
    busy = going.groupBy("in", "part").agg(F.ceil(F.count("*") / visits).cast("int").alias("salts"))
    busy = written(busy, "visited-chunks")
    members = rows.select(F.col("cell").alias("in"), F.col("chunk").alias("part"), "accession", "vec").join(busy, ["in", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    members = members.select("in", "part", "salt", F.lit(0).alias("kind"), "accession", "vec")
    coming = going.join(busy, ["in", "part"]).withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "accession"), F.col("salts")).cast("int"))
    home = (F.col("in") == F.col("cell")) & (F.col("part") == F.col("chunk"))
    coming = coming.select("in", "part", "salt", F.when(home, 1).otherwise(2).alias("kind"), "accession", "vec")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(names, hit, cos, other):
            who, which = np.nonzero(hit)
            a, b, c = names[who], other[which], cos[hit]
            return a, b, c

        def out(a, b, c):
            flip = a > b
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], names=["src", "dst", "similarity"])

        def connecting(hit, group):
            """Which hits of members (rows) and visitors (columns) connect something, in turn; group: of each member, changed here."""
            keep = np.zeros(hit.shape, bool)
            some = np.flatnonzero(hit.any(axis=0))
            keep[hit[:, some].argmax(axis=0), some] = True
            for j in some.tolist() if (group != group[0]).any() else ():
                at = np.flatnonzero(hit[:, j])
                found, place = np.unique(group[at], return_index=True)
                if len(found) > 1:
                    keep[at[place], j] = True
                    group[np.isin(group, found)] = group[at[0]]
            return keep

        key, names, x, group = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("in", "part", "salt")], axis=1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                if tuple(keys[a]) != key:
                    key, names, x, group = tuple(keys[a]), [], [], None
                part = batch.slice(a, b - a)
                kind = part.column("kind").to_numpy()
                n = int(np.searchsorted(kind, 1))
                if n:
                    names += part.column("accession").to_pylist()[:n]
                    x += part.column("vec").to_pylist()[:n]
                if group is None and n < len(kind):
                    names, x, group = np.array(names, object), np.array(x, float), np.arange(len(names))
                for i in range(n, len(kind), step := max(1, 2_000_000 // max(1, len(names)))):
                    some = part.slice(i, step)
                    other = np.array(some.column("accession").to_pylist(), object)
                    cos = x @ np.array(some.column("vec").to_pylist(), float).T
                    hit = cos >= t
                    inside = kind[i : i + step] == 1
                    hit[:, inside] &= names[:, None] < other[None, inside]  # a chunk's own pairs come from both sides
                    if spanning:
                        hit = connecting(hit, group)
                    if hit.any():
                        yield out(*linked(names, hit, cos, other))

    met = members.unionByName(coming).repartition("in", "part", "salt").sortWithinPartitions("in", "part", "salt", "kind")
    return written(met.mapInArrow(run, "src string, dst string, similarity double"), "vector-links")
