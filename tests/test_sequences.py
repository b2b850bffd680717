"""The embedding hook, and records found by byte offsets."""

import random
import types

import numpy as np
import pytest

from prismata.operators import embedding
from prismata.sources import indexed

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def sequences(n=300):
    turn = random.Random(2)
    return [(f"S{i}", "".join(turn.choice(LETTERS) for _ in range(turn.choice([0, 1, 2, 3, 7, 40, 300, 1500])))) for i in range(n)]


def by_hand(seq, longest=1022, width=64):
    out = np.zeros(width)
    data = seq[:longest].encode()
    for a, b, c in zip(data, data[1:], data[2:]):
        out[(a * 961 + b * 31 + c) % width] += 1
    return out / max(out.sum(), 1)


def test_embedding_equals_a_loop_for_any_batches(spark):
    rows = sequences() + [("S1", "AAAC"), ("N", None), (None, "ACDE")]
    df = spark.createDataFrame(rows, "accession string, sequence string").repartition(7)
    want = sorted((k or "", by_hand(s).round(9).tolist()) for k, s in rows if s is not None)
    for how in ({}, {"rows": 3}, {"budget": 50}):
        found = embedding.embedded(df, embedding.kmer_model(), **how).collect()
        assert sorted((r.accession or "", np.round(r.vec, 9).tolist()) for r in found) == want
    kept = embedding.embedded(df, embedding.kmer_model(), longest=300, truncate=False)
    assert kept.count() == sum(s is not None and len(s) <= 300 for _, s in rows)
    assert embedding.embedded(df.limit(0), embedding.kmer_model()).count() == 0


def test_batches_of_a_task_hold_the_budget():
    rows = sorted(sequences(), key=lambda r: len(r[1]))
    cut = list(embedding.cut_batches(rows, 20, 5000))
    assert [r for part in cut for r in part] == rows and max(map(len, cut)) == 20
    assert all(len(part) == 1 or len(part) * len(part[-1][1]) <= 5000 for part in cut)
    assert sum(len(part) for part in cut if len(part) > 1) > 200


def small_model(room, calls):
    """A model that has room for so many letters with padding."""

    def model(part):
        calls.append(len(part))
        if len(part) * max(map(len, part)) > room:
            raise RuntimeError("device: out of memory") if len(calls) % 2 else MemoryError()
        return [[len(s)] for s in part]

    return model


def test_batches_without_room_are_halved():
    rows = [(i, "A" * 10) for i in range(37)]
    calls: list = []
    out, size = embedding.in_halves(small_model(60, calls), rows, 32, True)
    assert out == [(i, [10]) for i in range(37)] and size == 4
    assert calls == [32, 16, 8, 4, 4, 4, 4, 4, 4, 4, 4, 4, 1]
    with pytest.raises((MemoryError, RuntimeError)):
        embedding.in_halves(small_model(60, []), rows, 32, False)
    with pytest.raises((MemoryError, RuntimeError)):
        embedding.in_halves(small_model(60, []), [(1, "A" * 61)], 32, True)
    out, _ = embedding.in_halves(small_model(60, []), [(1, "A" * 61), (2, "A")], 32, True, lambda part: [[-1] for _ in part])
    assert out == [(1, [-1]), (2, [1])]

    def broken(part):
        raise RuntimeError("shape")

    with pytest.raises(RuntimeError, match="shape"):
        embedding.in_halves(broken, rows, 32, True)


def test_halving_within_tasks(spark):
    def make():
        def model(part):
            if len(part) * max(map(len, part)) > 3000:
                raise MemoryError
            return [[float(len(s))] for s in part]

        return model

    rows = sequences()
    found = embedding.embedded(spark.createDataFrame(rows, "accession string, sequence string"), make).collect()
    assert {r.accession: r.vec for r in found} == {k: [float(min(len(s), 1022))] for k, s in rows}


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    turn = random.Random(4)
    folder = tmp_path_factory.mktemp("fasta")
    want, records = {}, []
    for i in range(400):
        seq = "".join(turn.choice(LETTERS) for _ in range(turn.choice([0, 1, 60, 61, 200, 3000])))
        lines = [seq[k : k + 60] for k in range(0, len(seq), 60)]
        head = turn.choice([f">sp|P{i}|NAME_X word", f">P{i} some words", f">P{i}"])
        records.append("\n".join([head, *lines]) + "\n")
        want[f"P{i}"] = seq
    records += [">\nACDE\n", ">P5 again\nAAAA\n\nCC\n", ">tr|Ä1|ß\r\nACD\r\nEF\r\n"]
    want |= {"P5": "AAAACC", "Ä1": "ACDEF"}
    (folder / "a.fasta").write_text("".join(records[:250]).rstrip("\n"))  # no line end at the end
    (folder / "b.fasta").write_text("".join(records[250:]), newline="")
    (folder / "c.fasta").write_text("")
    (folder / "_SUCCESS").write_text("no records")
    return folder, want


def read_at(rows):
    found = {}
    for key, path, start, stop in sorted(rows, key=lambda r: (r[1], r[2])):
        with open(path, "rb") as f:
            found[key] = b"".join(f.read()[start:stop].split()).decode()
    return found


def test_index_does_not_depend_on_ranges(spark, fasta, tmp_path):
    folder, want = fasta
    assert read_at(map(tuple, indexed.fasta_index(spark, str(folder), 5000).collect())) == want
    text = ">A\nAC\n\nD\n>\nQ\n>x|B|y\r\nEF\r\n>C\n>A\nGH"
    (tmp_path / "f").write_text(text, newline="")
    for size in range(1, len(text) + 2):
        reader = indexed.RangeReader(str(tmp_path / "f"), size)
        rows = [r for part in reader.partitions() for r in reader.read(part)]
        assert [r[0] for r in rows] == ["A", "B", "C", "A"] and read_at(rows) == {"A": "GH", "B": "EF", "C": ""}


@pytest.mark.parametrize("gap", [0, 1 << 20])
def test_lookups(spark, fasta, gap):
    folder, want = fasta
    index = indexed.fasta_index(spark, str(folder), 5000)
    asked = ["P1", "P2", "P5", "P399", "Ä1", "unknown", "P1", None]
    found = indexed.lookups(index, spark.createDataFrame([(a, 1) for a in asked], "accession string, start int"), gap).collect()
    assert sorted(tuple(r) for r in found) == sorted((a, want[a]) for a in set(asked) if a in want)
    assert indexed.lookups(index, spark.createDataFrame([], "accession string")).count() == 0


def test_only_what_is_asked_for_is_read(spark, fasta, tmp_path):
    folder, want = fasta
    index = indexed.newest(indexed.fasta_index(spark, str(folder))).where("accession in ('P3', 'P4', 'P300')").collect()
    log = str(tmp_path / "reads")

    def opener(path):
        from pyarrow import fs

        class Logged:
            def __init__(self, file):
                self.file = file

            def seek(self, at):
                self.at = at
                self.file.seek(at)

            def read(self, n):
                with open(log, "a") as f:
                    f.write(f"{self.at} {n}\n")
                return self.file.read(n)

            def close(self):
                self.file.close()

        return types.SimpleNamespace(open_input_file=lambda p: Logged(fs.LocalFileSystem().open_input_file(p))), path

    rows = spark.createDataFrame(index, "accession string, path string, start bigint, stop bigint").coalesce(1)
    assert {r.accession: r.sequence for r in indexed.read_ranges(rows, 0, opener).collect()} == {k: want[k] for k in ("P3", "P4", "P300")}
    reads = {tuple(map(int, line.split())) for line in open(log)}
    assert reads == {(r.start, r.stop - r.start) for r in index}
