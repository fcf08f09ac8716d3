"""Search output that arrives file by file, appended to a table of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.readers import stranded


def incoming(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of hits from the tabular files that appear in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).csv(path, sep="\t", schema=schemas.SEARCH)
    rows = stranded(rows, F.col("sstart"), F.col("send"))
    return rows.select(
        F.col("qseqid").alias("Reference"), F.col("sseqid").alias("Chromosome"), "Start", "End", "Strand", F.col("pident").alias("Pident"), F.col("length").alias("HitLength"), F.col("bitscore").alias("Bitscore")
    ).where("Start is not null and End is not null and Pident is not null")


def append(spark: SparkSession, path: str, table: str, state: str) -> StreamingQuery:
    """Append the hits of new files to a Parquet table by chromosome, each file once; ends when none is left."""
    return (
        incoming(spark, path).writeStream.format("parquet").partitionBy("Chromosome").option("path", table).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """Hits and bases of each reference so far, for update or complete output."""
    size = F.col("End") - F.col("Start") + 1
    return incoming(spark, path).groupBy("Reference").agg(F.count("*").alias("Hits"), F.sum(size).alias("Bases"))
