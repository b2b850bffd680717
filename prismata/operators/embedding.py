"""Vectors of sequences from any model, in batches of sequences of like length.

Sequences are range-partitioned by length, so that a task's batches are padded little, and batches are cut by the padded
size that the model has room for. Where the model runs out of memory nonetheless, the batch is retried in halves,
and the task goes on with the smaller size. The model is a function that each task makes for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import length_limit

#: Sequences of a batch, letters of a batch with padding, and letters of a sequence at most (0: all).
ROWS, BUDGET, LONGEST = 1536, 1 << 20, 1022


def no_room(error: BaseException) -> bool:
    """Whether a model's error says that memory ran out; libraries for devices raise errors of their own kinds for that."""
    return isinstance(error, MemoryError) or (isinstance(error, RuntimeError) and "out of memory" in str(error).lower())


def cut_batches(rows, most: int, budget: int):
    """Lists of rows (key, sequence) that come in order of length: at most `most` rows, and at most `budget` letters when all are as long as the
    last one. A longer sequence is alone."""
    held: list = []
    for row in rows:
        if held and (len(held) >= most or (len(held) + 1) * len(row[1]) > budget):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def in_halves(model, rows: list, size: int, dynamic: bool, spare=None):
    """(key, vector) of the rows, and the number of rows that the model had room for. Rows go `size` at a time; a part that it has no room for is
    halved. A single sequence without room goes to the spare model (say, one that uses no device), else its error is raised."""
    out, i = [], 0
    while i < len(rows):
        part = rows[i : i + size]
        try:
            found = model([s for _, s in part])
        except Exception as error:  # noqa: BLE001
            if not dynamic or not no_room(error):
                raise
            if len(part) > 1:
                size = len(part) // 2
                continue
            if spare is None:
                raise
            found = spare([s for _, s in part])
        out += zip([k for k, _ in part], found)
        i += len(part)
    return out, size


def embedded(sequences: DataFrame, make: Callable, rows: int = ROWS, budget: int = BUDGET, longest: int = LONGEST, truncate: bool = True, dynamic: bool = True, spare: Callable | None = None) -> DataFrame:
    """accession, vec of all sequences (accession string, sequence). make: a function without arguments that gives a model, which gives a
    matrix for a list of sequences; it is called once a task. spare: the same for sequences that the model has no room for. Sequences over `longest` letters are
    truncated or left out. Null sequences have no vector; empty ones have the model's; repeated rows are embedded each."""
    kept = length_limit(sequences.select("accession", "sequence").where("sequence is not null"), longest, truncate)
    size = F.length("sequence")
    ranged = kept.repartitionByRange(size, "accession").sortWithinPartitions(size, "accession")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model, other, most = make(), None, rows

        def last_resort(few):
            nonlocal other
            other = other or spare()
            return other(few)

        def each():
            for batch in batches:
                yield from zip(batch.column("accession").to_pylist(), batch.column("sequence").to_pylist())

        for part in cut_batches(each(), rows, budget):
            done, most = in_halves(model, part, most, dynamic, last_resort if spare else None)
            vectors = np.array([v for _, v in done], float)
            flat = pa.array(vectors.ravel())
            first = pa.array(np.arange(len(done) + 1) * vectors.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.ListArray.from_arrays(first, flat)], names=["accession", "vec"])

    return ranged.mapInArrow(run, "accession string, vec array<double>")


def kmer_model(width: int = 64, k: int = 3, base: int = 31) -> Callable:
    """A model that needs no weights: the share of each of `width` groups among a sequence's words of k bytes, groups being a polynomial in `base`
    of the bytes. Sequences are padded to the longest one and padding is masked, as with a learned model; those of fewer
    than k bytes have zeros."""

    def make():
        import numpy as np

        def model(sequences):
            data = [s.encode() for s in sequences]
            size = np.array([len(x) for x in data])
            long = max(int(size.max(initial=0)), k)
            tokens = np.frombuffer(b"".join(x.ljust(long, b"\0") for x in data), np.uint8).reshape(len(data), long).astype(np.int64)
            group = np.zeros((len(data), long - k + 1), np.int64)
            for i in range(k):
                group = (group * base + tokens[:, i : i + group.shape[1]]) % width
            real = np.arange(group.shape[1]) < (size - k + 1)[:, None]
            row = np.repeat(np.arange(len(data)), real.sum(axis=1))
            counts = np.bincount(row * width + group[real], minlength=len(data) * width).reshape(-1, width)
            return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)

        return model

    return make
