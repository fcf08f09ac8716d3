"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a run of ids of fixed width, each document followed by an end-of-document id, without an index. Files are
read in blocks of fixed size that end anywhere. Each block is searched for separators at once, as a vector; a prefix scan
over the blocks then gives each block its place in the file and the last separator before it, and so stitches documents
that span blocks. The scan has two levels, blocks within stripes of STRIPE blocks and stripes within files, so that no
task meets more than STRIPE blocks or one row for each stripe of a file.

Defined results: each separator ends one document, which may have no token; ids after a file's last separator are one
more document, marked as not ended. An empty file has no document. A block's bytes that don't fill an id raise an error.
`flatten` writes a null text as an empty document and repeated rows as often as they come; a null doc_id stays null. A
very long text is encoded whole and then cut into blocks. An empty table gives an empty result. Other columns, of whatever
name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import checkpointed

#: Bytes of a block, blocks of a stripe, and numpy's name for an id's type.
BLOCK, STRIPE, IDS = 1 << 18, 1024, "<u2"
BLOCKS = "file long, block long, ids binary, doc_ids array<long>"
FOUND = "file long, block long, size long, ends array<long>, doc_ids array<long>"


def flatten(docs: DataFrame, block: int = BLOCK, ids: str = IDS, separator: int = tokens.END_OF_TEXT) -> DataFrame:
    """Flat files of docs, one for each input partition, as blocks: file, block, ids, and for labels only the doc_ids
    of the documents whose separators a block holds."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, held, labels = TaskContext.get().partitionId(), 0, bytearray(), []
        end = np.array([separator], ids).tobytes()

        def row(raw: bytes, labels: list) -> pa.RecordBatch:
            arrays = [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([raw], pa.binary()), pa.array([labels], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "ids", "doc_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += tokens.encode_ordinary(text.as_py() or "").astype(ids).tobytes() + end
                labels.append((len(held), doc_id))
                while len(held) >= block:
                    yield row(bytes(held[:block]), [d for at, d in labels if at <= block])
                    labels = [(at - block, d) for at, d in labels if at > block]
                    del held[:block]
                    number += 1
        if held:
            yield row(bytes(held), [d for _, d in labels])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, BLOCKS)


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of the flat token files under path, each up to the 2 GB that Spark's binaryFile source reads.

    Files are numbered in order of their paths.
    """
    files = spark.read.format("binaryFile").load(path)
    numbers = files.select("path").withColumn("file", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    cut = files.where("length > 0").join(numbers, "path").withColumn("block", F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")))
    return cut.select("file", "block", F.expr(f"substring(content, cast(block * {block} + 1 as int), {block})").alias("ids"), F.expr("cast(array() as array<long>)").alias("doc_ids"))


def scan(blocks: DataFrame, ids: str = IDS, separator: int = tokens.END_OF_TEXT) -> DataFrame:
    """Each block's number of ids and the offsets of its separators."""
    kind = np.dtype(ids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw.as_py() or b"", kind) for raw in batch.column(2)]
            ends = pa.array([np.flatnonzero(block == separator) for block in found], pa.list_(pa.int64()))
            sizes = pa.array([len(block) for block in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, ends, batch.column(3)], names=["file", "block", "size", "ends", "doc_ids"])

    return blocks.select("file", "block", "ids", "doc_ids").mapInArrow(search, FOUND)


def documents(found: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """file, doc_index, start, n_tokens, ended, doc_id: the documents of flat files, from scanned blocks."""
    found = found.withColumn("stripe", F.floor(F.col("block") / stripe)).withColumn("n", F.array_size("ends"))
    earlier = Window.partitionBy("file", "stripe").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    placed = found.withColumn("base", F.coalesce(F.sum("size").over(earlier), none)).withColumn("before", F.coalesce(F.sum("n").over(earlier), none))
    last = F.when(F.col("n") > 0, F.col("base") + F.element_at("ends", -1))
    placed = placed.withColumn("last", last).withColumn("carried", F.max("last").over(earlier))
    stripes = placed.groupBy("file", "stripe").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("file").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.withColumn("stripe_base", F.coalesce(F.sum("size").over(earlier), none)).withColumn("stripe_before", F.coalesce(F.sum("n").over(earlier), none))
    stripes = stripes.withColumn("stripe_last", F.col("stripe_base") + F.col("last")).withColumn("stripe_carried", F.max("stripe_last").over(earlier))
    whole = placed.join(stripes.select("file", "stripe", "stripe_base", "stripe_before", "stripe_carried"), ["file", "stripe"])
    base = F.col("stripe_base") + F.col("base")
    before = F.coalesce(F.col("stripe_base") + F.col("carried"), F.col("stripe_carried"), F.lit(-1).cast("long"))
    ended = whole.where("n > 0").select(
        "file", (F.col("stripe_before") + F.col("before")).alias("first"), "doc_ids",
        # where each of the block's documents begins: behind the separator before it
        F.transform("ends", lambda e: base + e).alias("ends"), F.concat(F.array(before), F.transform("ends", lambda e: base + e)).alias("heads"),
    ).select("file", "first", "heads", "doc_ids", F.posexplode("ends").alias("k", "end"))
    start = F.element_at("heads", F.col("k") + 1) + 1
    ended = ended.select("file", (F.col("first") + F.col("k")).alias("doc_index"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"), F.get("doc_ids", F.col("k")).alias("doc_id"))
    files = stripes.groupBy("file").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.coalesce(F.max("stripe_last"), F.lit(-1).cast("long")).alias("last"))
    rest = F.col("size") - F.col("last") - 1
    open_ends = files.where(rest > 0).select("file", F.col("n").alias("doc_index"), (F.col("last") + 1).alias("start"), rest.alias("n_tokens"), F.lit(False).alias("ended"), F.lit(None).cast("long").alias("doc_id"))
    return ended.unionByName(open_ends)


def counted(docs: DataFrame, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """doc_id, n_tokens, file, doc_index, start, ended of every document: docs flattened, scanned and stitched.

    What the scan finds, a few numbers for each document, is checkpointed: texts are encoded once, and the files keep
    their numbers, however often the stitching reads them.
    """
    return documents(checkpointed(scan(flatten(docs, block))), stripe).select("doc_id", "n_tokens", "file", "doc_index", "start", "ended")
