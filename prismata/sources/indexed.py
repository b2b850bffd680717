"""FASTA files with an index of byte offsets: indexed once, then only the records that are asked for are read.

The index comes from a data source that plans byte ranges of the files: a task reads one range, and a record belongs to the
range in which it begins. Lookups join keys to the index and read the ranges of what was found, in the order
of the files, so that neighbours are read at once. Files are opened by pyarrow: local ones and the stores that it knows.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range that a task indexes, and bytes between two records up to which they are read at once.
RANGE_BYTES, GAP_BYTES = 32 << 20, 64 << 10


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files of a path (a file or a folder) with their sizes, without hidden ones."""
    from pyarrow import fs

    system, place = opened(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    files = [(f"{prefix}{i.path}", i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    return sorted(files)


def header_key(line: bytes) -> str:
    """The identifier of a header line: its second `|` field, else its first word; empty where it has none."""
    parts = line.decode("utf-8", "ignore").rstrip("\r\n").split("|")
    if len(parts) > 1 and parts[1]:
        return parts[1]
    words = parts[0][1:].split() if len(parts) == 1 else line.decode("utf-8", "ignore")[1:].split()
    return words[0] if words else ""


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RangeReader(DataSourceReader):
    """accession, path, start, stop of each record that begins in a range."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        ranges = [ByteRange(path, i, min(i + self.size, total)) for path, total in listed(self.path) for i in range(0, total, self.size)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        import io

        system, place = opened(part.path)
        with system.open_input_file(place) as source, io.BufferedReader(source, 1 << 20) as file:
            at = part.start
            if at:  # a line that runs into this range belongs to the one before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            key = begin = None
            for line in file:
                if line.startswith(b">"):
                    if key:
                        yield key, part.path, begin, at
                    key = None
                    if at < part.stop:
                        key, begin = header_key(line), at + len(line)
                if not key and at >= part.stop:
                    return
                at += len(line)
            if key:
                yield key, part.path, begin, at


class FastaRanges(DataSource):
    """The index of the files of a path; options: path, and rangeBytes (bytes that a task reads)."""

    @classmethod
    def name(cls):
        return "fasta_index"

    def schema(self):
        return "accession string, path string, start bigint, stop bigint"

    def reader(self, schema):
        return RangeReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def fasta_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """accession, path, start, stop: where the sequence of each record begins and ends in its file, in bytes; a record's own
    header is not part of it. Records without an identifier are left out."""
    spark.dataSource.register(FastaRanges)
    return spark.read.format("fasta_index").option("rangebytes", str(range_bytes)).load(path)


def newest(index: DataFrame) -> DataFrame:
    """One record for each accession: the last one, by file and place."""
    return index.groupBy("accession").agg(F.max(F.struct("path", "start", "stop")).alias("r")).select("accession", "r.*")


def read_ranges(found: DataFrame, gap: int = GAP_BYTES, opener=opened) -> DataFrame:
    """accession, sequence of index rows (accession, path, start, stop). Rows are brought in the order of the files; ranges at most `gap` bytes
    apart are read at once, and nothing else of the files is. White space is no part of a sequence."""

    def run(batches):
        import pyarrow as pa

        path, file = None, None
        for batch in batches:
            names = batch.column("path").to_pylist()
            start, stop = (batch.column(c).to_numpy() for c in ("start", "stop"))
            out, i = [], 0
            while i < len(names):
                j, end = i + 1, stop[i]
                while j < len(names) and names[j] == names[i] and start[j] <= end + gap and stop[j] - start[i] <= 8 << 20:
                    end = max(end, stop[j])
                    j += 1
                if names[i] != path:
                    if file is not None:
                        file.close()
                    system, place = opener(names[i])
                    path, file = names[i], system.open_input_file(place)
                file.seek(int(start[i]))
                data = file.read(int(end - start[i]))
                out += [b"".join(data[a:b].split()).decode() for a, b in zip((start[i:j] - start[i]).tolist(), (stop[i:j] - start[i]).tolist())]
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("accession"), pa.array(out, pa.string())], names=["accession", "sequence"])
        if file is not None:
            file.close()

    placed = found.select("accession", "path", "start", "stop").repartitionByRange("path", "start").sortWithinPartitions("path", "start", "stop")
    return placed.mapInArrow(run, "accession string, sequence string")


def lookups(index: DataFrame, wanted: DataFrame, gap: int = GAP_BYTES) -> DataFrame:
    """accession, sequence of the wanted accessions (accession) that the index has; each once."""
    return read_ranges(newest(index.join(wanted.select("accession").distinct(), "accession", "left_semi")), gap)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need pyarrow, but not this package
