"""Blocks of collinear genes, and repeats inside, outside and far from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import beside, is_inside, nearest as nearest


def gene_positions(genes: DataFrame, order: str) -> DataFrame:
    """One row for each gene: the last in order wins. Chromosome, Start, End, gene."""
    last = F.max_by(F.struct("Chromosome", "Start", "End"), order)
    return genes.groupBy("gene").agg(last.alias("p")).select("p.*", "gene")


def blocks(anchors: DataFrame, genes: DataFrame) -> DataFrame:
    """Chromosome, Start, End, block, same_chromosome of each anchor (line_no, g_start, g_end) whose two genes are known.

    The chromosome is the start gene's, as the inputs' producers assume; same_chromosome tells whether the end gene agrees.
    """
    a = genes.select(F.col("gene").alias("g_start"), F.col("Chromosome"), F.col("Start").alias("s1"), F.col("End").alias("e1"))
    b = genes.select(F.col("gene").alias("g_end"), F.col("Chromosome").alias("c2"), F.col("Start").alias("s2"), F.col("End").alias("e2"))
    both = anchors.join(a, "g_start").join(b, "g_end")
    return both.select("Chromosome", F.least("s1", "s2").alias("Start"), F.greatest("e1", "e2").alias("End"), F.concat(F.lit("block_"), F.col("line_no").cast("string")).alias("block"), (F.col("Chromosome") == F.col("c2")).alias("same_chromosome"))


def inside(repeats: DataFrame, blocks: DataFrame) -> DataFrame:
    return beside(repeats, blocks).where(is_inside()).select(*repeats.columns)


def outside(repeats: DataFrame, blocks: DataFrame) -> DataFrame:
    return beside(repeats, blocks).where(~is_inside()).select(*repeats.columns)


def summary(repeats: DataFrame, blocks: DataFrame, far: int = 100_000) -> DataFrame:
    """species, family, total, outside, far, perc_outside, perc_far. A repeat counts as far once for each block at its
    distance, and never where its chromosome has no block."""
    keys = ["species", "family"]
    total = repeats.groupBy(*keys).agg(F.count("*").alias("total"))
    out = outside(repeats, blocks)
    n_out = out.groupBy(*keys).agg(F.count("*").alias("outside"))
    n_far = nearest(out, blocks).where(F.col("dist") > far).groupBy(*keys).agg(F.count("*").alias("far"))
    all_of = total.join(n_out, keys, "full").join(n_far, keys, "full").na.fill(0, ["total", "outside", "far"])
    share = lambda c: 100.0 * F.col(c) / F.nullif(F.col("total"), F.lit(0))
    return all_of.select(*keys, "total", "outside", "far", share("outside").alias("perc_outside"), share("far").alias("perc_far"))
