"""Motifs like a reference in reads: windows within a Hamming distance, left to right without overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import motif_label, species_code
from .graph import written
from .running import running

SIMILARITY = 0.6


def most_differences(length: int, similarity: float = SIMILARITY) -> int:
    return int(length * (1 - similarity))


def hits_in(text: str, motif: str, most: int) -> list[int]:
    """Offsets of the motifs of one read: after a hit the search goes on behind it, after a miss one letter on."""
    letters, wanted = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (text, motif))
    size = len(wanted)
    if size == 0:
        raise ValueError("the reference sequence is empty")
    if len(letters) < size:
        return []
    differences = np.zeros(len(letters) - size + 1, np.int32)
    for k in range(size):
        differences += letters[k : k + len(differences)] != wanted[k]
    out, free = [], 0
    for at in np.flatnonzero(differences <= most).tolist():
        if at >= free:
            out.append(at)
            free = at + size
    return out


def scan(reads: DataFrame, motif: str, similarity: float = SIMILARITY) -> DataFrame:
    """library, read_idx, offset, motif of every motif in reads (library, read_idx, seq). Reads don't move."""
    most = most_differences(len(motif), similarity)
    hits_in("", motif, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hits_in(s.as_py() or "", motif, most) for s in batch.column(2)]
            counts = [len(f) for f in found]
            take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            offsets = [o for f in found for o in f]
            motifs = [s.as_py()[o : o + len(motif)] for s, f in zip(batch.column(2), found, strict=True) for o in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(offsets, pa.int64()), pa.array(motifs, pa.string())], names=["library", "read_idx", "offset", "motif"])

    return reads.select("library", F.col("read_idx").cast("long").alias("read_idx"), "seq").mapInArrow(run, "library string, read_idx long, offset long, motif string")


def numbered(motifs: DataFrame) -> DataFrame:
    """motifs with motif_no, counted within each library in order of reads and offsets, and its label; then only those of
    A, C, G and T. Motifs of one read are numbered behind those of earlier reads."""
    # one row for each read, not each motif, summed over tiles of reads
    reads = written(motifs.groupBy("library", "read_idx").agg(F.count("*").alias("n")))
    reads = running(reads, ["library"], "read_idx", ["read_idx"], {"before": ("sum", F.col("n"))}).select("library", "read_idx", "before")
    inner = F.row_number().over(Window.partitionBy("library", "read_idx").orderBy("offset"))
    out = motifs.withColumn("k", inner).join(reads, ["library", "read_idx"]).withColumn("motif_no", F.col("before") + F.col("k"))
    return out.where(F.upper("motif").rlike("^[ACGT]*$")).select("library", "read_idx", "offset", "motif_no", "motif", motif_label(F.col("library"), F.col("motif_no")).alias("motif_id"))


def repeated(motifs: DataFrame, copies: int) -> DataFrame:
    """Motifs that occur more than `copies` times, with their number."""
    return motifs.groupBy("motif").agg(F.count("*").alias("copies")).where(F.col("copies") > copies)


def annotated(motifs: DataFrame, species: DataFrame, id: Column | None = None) -> DataFrame:
    """Sequence, Species: each motif's species by the letters that its label begins with; Unknown if none is named.

    species (code, species) is a small dimension; its last row for a code counts, by column order if there is one.
    """
    label = F.col("motif_id") if id is None else id
    names = species.groupBy("code").agg(F.max_by("species", "order").alias("species")) if "order" in species.columns else species.dropDuplicates(["code"])
    out = motifs.withColumn("code", species_code(label)).join(names, "code", "left")
    return out.select(F.col("motif_id").alias("Sequence"), F.coalesce("species", F.lit("Unknown")).alias("Species"))


def per_library(motifs: DataFrame) -> DataFrame:
    """library, motifs, reads: how many motifs and reads with motifs each library has."""
    return motifs.groupBy("library").agg(F.count("*").alias("motifs"), F.count_distinct("read_idx").alias("reads"))
