"""Queries on sequences: vectors from a model, and records found by byte offsets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import embedding
from ..session import shared_dir, written
from ..sources import indexed, writers
from ..sources.fixtures import sql, view
from .registry import query

KMERS = {
    "cut": "SELECT accession, left(sequence, 1022) AS s FROM sequences",
    "hashed": "SELECT accession, (ascii(s[i]) * 961 + ascii(s[i + 1]) * 31 + ascii(s[i + 2])) % 64 AS pos FROM (SELECT accession, s, unnest(range(1, length(s) - 1)) AS i FROM cut)",
}


@query(sql("SELECT accession, pos::INT AS pos, round(count(*) / sum(count(*)) OVER (PARTITION BY accession), 6) AS x FROM hashed GROUP BY accession, pos", "sequences", **KMERS))
def kmer_vectors(spark, d):
    """Vectors of hashed words of three letters, by the hook for models."""
    found = embedding.embedded(view(spark, d, "sequences"), embedding.kmer_model())
    return found.select("accession", F.posexplode("vec").alias("pos", "x")).where("x > 0").select("accession", "pos", F.round("x", 6).alias("x"))


def indexed_file(spark, d):
    path = f"{shared_dir(spark)}/indexed-{uuid.uuid4().hex}"
    writers.fasta(view(spark, d, "sequences").where("length(sequence) > 0"), path)
    return indexed.fasta_index(spark, path, 1 << 20)


@query(sql("SELECT accession, (length(sequence) + (length(sequence) + 79) // 80)::BIGINT AS n_bytes FROM sequences WHERE length(sequence) > 0", "sequences"))
def fasta_index(spark, d):
    """How many bytes each record takes in a file of lines of 80 letters."""
    return indexed_file(spark, d).select("accession", (F.col("stop") - F.col("start")).alias("n_bytes"))


@query(sql("SELECT s.accession, s.sequence, l.quality FROM sequences s JOIN labels l ON l.doc_id = s.doc_id WHERE length(s.sequence) > 0", "sequences"))
def indexed_lookup(spark, d):
    """Sequences of labelled entries: ids are joined with the index, and only their byte ranges are read."""
    labels = view(spark, d, "labels").select(F.concat(F.lit("D"), "doc_id").alias("accession"), "quality")
    return indexed.lookups(written(indexed_file(spark, d), "fasta-index"), labels).join(labels, "accession")
