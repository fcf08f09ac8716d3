"""Genomic views over the driver's tables, so that each operator runs on tables that grow with the scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import clean
from ..sources.readers import stranded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search output: sstart > send on the minus strand."""
    length = F.col("l_quantity").cast("long")
    low = F.col("l_orderkey") * 40 + F.col("l_linenumber")
    high = low + length - 1
    minus = F.col("l_linenumber") % 2 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Chr"), (F.col("l_suppkey") % 10).cast("string")).alias("Chromosome"), F.concat("l_returnflag", "l_linestatus").alias("Reference"),
        F.when(minus, high).otherwise(low).alias("sstart"), F.when(minus, low).otherwise(high).alias("send"),
        (100.0 * (1 - F.col("l_discount"))).alias("Pident"), length.alias("HitLength"), F.col("l_extendedprice").alias("Bitscore"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stranded(raw_hits(spark, sf_dir), F.col("sstart"), F.col("send")).drop("sstart", "send")


def chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome, ChromosomeLengthBp: the ten that hits lie on."""
    length = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") * 40 + 200).alias("ChromosomeLengthBp"))
    return length.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("Chr"), i.cast("string")))).alias("Chromosome"), "ChromosomeLengthBp")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, id, seq: all documents as cleaned sequences."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_idx"), F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("id"), clean(F.col("text")).alias("seq"))


def monomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, id, seq: all turns of conversations that have a letter, as short cleaned sequences."""
    index = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(index.alias("seq_idx"), F.concat(F.lit("seq"), index.cast("string")).alias("id"), clean(F.col("text")).alias("seq"))
    return rows.where("seq <> ''")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderkey") * 40
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("Chr"), (F.col("o_orderkey") % 10).cast("string")).alias("Chromosome"), at.alias("Start"), (at + 40).alias("End"), F.col("o_orderkey").alias("gene"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    first = F.pmod(F.col("event_id") * 7, F.col("n"))
    rows = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    return rows.select(F.col("event_id").alias("line_no"), first.alias("g_start"), (first + 10 * (1 + F.col("event_id") % 5)).alias("g_end"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, header: headers of five kinds from the parts' keys and names."""
    k = F.col("p_partkey")
    n = k.cast("string")
    kind = k % 5
    header = (
        F.when(kind == 0, F.concat(F.lit("ref|NC_"), n, F.lit("| Danio chromosome "), (k % 25).cast("string")))
        .when(kind == 1, F.concat(F.lit("Chr"), F.upper(F.substring("p_name", 1, 1)), (k % 40).cast("string")))
        .when(kind == 2, F.concat(F.lit("scaffold_"), F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string")))
        .when(kind == 3, F.concat(F.lit("micro"), n))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select((k + 1).alias("index"), header.alias("header"))
