"""What chromosomes consist of: disjoint segments by sweep, composition, and metrics of arrays.

The number of chromosomes and references is small beside that of arrays; grids of the two are made from dimension tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import natural_key
from .arrays import n50
from .graph import written
from .intervals import overlapping
from .running import TILE, running
from .selection import percentiles

NONE, MANY, GENOME = "Non_satDNA", "Multi_satDNA_overlap", "Complete_genome"


def segments(arrays: DataFrame, chromosomes: DataFrame, tile: int = TILE) -> DataFrame:
    """Disjoint covered segments with the references active in each: Chromosome, Start, End, LengthBp, Category,
    ActiveReferences, NumActiveReferences. Arrays are clipped to [1, ChromosomeLengthBp]."""
    clipped = arrays.join(chromosomes, "Chromosome").select(
        "Chromosome", "Reference", F.greatest("Start", F.lit(1)).alias("Start"), F.least("End", "ChromosomeLengthBp").alias("End")
    ).where("End >= Start")
    events = clipped.select("Chromosome", F.explode(F.array(F.struct(F.col("Start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("End") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("Chromosome", "e.pos").agg(F.sum("e.d").alias("d"))
    steps = running(written(steps), ["Chromosome"], "pos", ["pos"], {"depth": ("sum", F.col("d"))}, tile, inclusive=True)
    steps = running(written(steps), ["Chromosome"], "pos", ["pos"], {"next": ("min", F.col("pos"))}, tile, behind=True)
    covered = written(steps.where("depth > 0").select("Chromosome", F.col("pos").alias("Start"), (F.col("next") - 1).alias("End")))
    # a segment lies in an array or beside it, never across its end
    active = overlapping(covered, clipped, ["Chromosome"], closed=True)
    named = active.groupBy("Chromosome", F.col("a.Start").alias("Start"), F.col("a.End").alias("End")).agg(F.collect_set("b.Reference").alias("refs"))
    ordered = F.transform(F.array_sort(F.transform("refs", lambda r: F.struct(natural_key(r).alias("k"), r.alias("r")))), lambda x: x["r"])
    return named.select(
        "Chromosome", "Start", "End", (F.col("End") - F.col("Start") + 1).alias("LengthBp"), F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(F.lit(MANY)).alias("Category"),
        F.concat_ws(",", ordered).alias("ActiveReferences"), F.size("refs").cast("long").alias("NumActiveReferences"),
    )


def composition(segments: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Bases of each category of each chromosome; what no segment covers is Non_satDNA, and only where it isn't 0."""
    held = segments.groupBy("Chromosome", "Category").agg(F.sum("LengthBp").alias("CoveredBp"))
    total = held.groupBy("Chromosome").agg(F.sum("CoveredBp").alias("covered"))
    bare = chromosomes.join(total, "Chromosome", "left").select("Chromosome", F.lit(NONE).alias("Category"), (F.col("ChromosomeLengthBp") - F.coalesce("covered", F.lit(0))).alias("CoveredBp")).where("CoveredBp <> 0")
    checked = bare.withColumn("CoveredBp", F.when(F.col("CoveredBp") < 0, F.raise_error(F.lit("composition exceeds the chromosome's length")).cast("long")).otherwise(F.col("CoveredBp")))
    both = held.unionByName(checked).join(chromosomes, "Chromosome")
    return both.select("Chromosome", "ChromosomeLengthBp", "Category", "CoveredBp", percent("CoveredBp", "ChromosomeLengthBp").alias("PercentChromosome"))


def percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def with_genome(composition: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """The composition with rows for all chromosomes together."""
    both = composition.groupingSets([["Chromosome", "Category"], ["Category"]], "Chromosome", "Category").agg(F.sum("CoveredBp").alias("CoveredBp"), F.grouping("Chromosome").alias("all"))
    named = both.select(F.when(F.col("all") == 1, F.lit(GENOME)).otherwise(F.col("Chromosome")).alias("Chromosome"), "Category", "CoveredBp")
    genome = chromosomes.agg(F.lit(GENOME).alias("Chromosome"), F.sum("ChromosomeLengthBp").alias("ChromosomeLengthBp"))
    lengths = chromosomes.select("Chromosome", "ChromosomeLengthBp").unionByName(genome)
    return named.join(lengths, "Chromosome").select("Chromosome", "ChromosomeLengthBp", "Category", "CoveredBp", percent("CoveredBp", "ChromosomeLengthBp").alias("PercentChromosome"))


def _sizes(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, MedianArrayBp, ArrayP90Bp."""
    return percentiles(arrays, keys, "ArraySize", (0.5, 0.9)).select(*keys, F.col("p")[0].alias("MedianArrayBp"), F.col("p")[1].alias("ArrayP90Bp"))


def _weighted(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.col(weight).cast("double")), F.lit(0.0))


def chromosome_metrics(arrays: DataFrame, composition: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """25 columns for each chromosome, also for those without arrays."""
    size = "ArraySize"
    largest = F.max_by(F.struct(size, "Reference", "Start", "End"), F.struct(F.col(size), F.transform(F.split("Reference", ""), lambda c: -F.ascii(c)), -F.col("Start")))
    held = arrays.groupBy("Chromosome").agg(
        F.count_distinct("Reference").alias("NumSatDNAFamilies"), F.count("*").alias("NumArrays"), F.sum(size).alias("RawSummedArrayBp"), largest.alias("l"),
        F.avg(size).alias("MeanArrayBp"), F.sum("NumMonomers").alias("TotalMonomerHits"), _weighted("MeanPident", size).alias("WeightedMeanPident"),
    ).join(_sizes(arrays, ["Chromosome"]), "Chromosome", "left")
    covered = composition.groupBy("Chromosome").agg(
        F.coalesce(F.sum(F.when(F.col("Category") != NONE, F.col("CoveredBp"))), F.lit(0)).alias("UnionSatDNABp"),
        F.coalesce(F.sum(F.when(F.col("Category") == MANY, F.col("CoveredBp"))), F.lit(0)).alias("MultiSatDNAOverlapBp"),
    )
    best = Window.partitionBy("Chromosome").orderBy(F.desc("CoveredBp"), "Category")
    dominant = composition.where(~F.col("Category").isin(NONE, MANY)).withColumn("r", F.row_number().over(best)).where("r = 1").select("Chromosome", F.col("Category").alias("d"), F.col("CoveredBp").alias("d_bp"))
    c = chromosomes.join(held, "Chromosome", "left").join(covered, "Chromosome", "left").join(dominant, "Chromosome", "left").join(n50(arrays, ["Chromosome"]), "Chromosome", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    real = lambda name: F.coalesce(F.col(name), F.lit(0.0)).alias(name)
    length = F.col("ChromosomeLengthBp")
    share = lambda bp: F.when(length > 0, 100.0 * F.coalesce(F.col(bp), F.lit(0)) / length).otherwise(F.lit(0.0))
    rate = lambda name: F.when(length > 0, F.coalesce(F.col(name), F.lit(0)) / (length / 1e6)).otherwise(F.lit(0.0))
    return c.select(
        "Chromosome", "ChromosomeLengthBp", n("NumSatDNAFamilies"), n("NumArrays"), n("RawSummedArrayBp"), n("UnionSatDNABp"), share("UnionSatDNABp").alias("SatDNAPercentChromosome"),
        n("MultiSatDNAOverlapBp"), share("MultiSatDNAOverlapBp").alias("MultiSatDNAOverlapPercent"), F.coalesce("l.ArraySize", F.lit(0)).cast("long").alias("LargestArrayBp"),
        F.coalesce("l.Reference", F.lit("NA")).alias("LargestArraySatDNA"), F.col("l.Start").alias("LargestArrayStart"), F.col("l.End").alias("LargestArrayEnd"), n("ArrayN50Bp"), n("ArrayL50"),
        real("MedianArrayBp"), real("MeanArrayBp"), real("ArrayP90Bp"), rate("NumArrays").alias("ArraysPerMb"), rate("NumSatDNAFamilies").alias("SatDNAFamiliesPerMb"), n("TotalMonomerHits"),
        "WeightedMeanPident", F.coalesce("d", F.lit("NA")).alias("DominantSatDNA"), F.coalesce("d_bp", F.lit(0)).cast("long").alias("DominantSatDNAExclusiveBp"), share("d_bp").alias("DominantSatDNAPercentChromosome"),
    )


def reference_metrics(arrays: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """16 columns for each chromosome and reference that has arrays there."""
    keys, size = ["Chromosome", "Reference"], "ArraySize"
    largest = F.max_by(F.struct(size, "Start", "End"), F.struct(F.col(size), -F.col("Start")))
    held = arrays.groupBy(*keys).agg(
        F.count("*").alias("NumArrays"), F.sum(size).alias("TotalArrayBpRaw"), largest.alias("l"), F.avg(size).alias("MeanArrayBp"), F.sum("NumMonomers").alias("TotalMonomerHits"),
        _weighted("MeanPident", size).alias("MeanPidentWeightedByArrayBp"),
    ).join(_sizes(arrays, keys), keys, "left")
    out = held.join(n50(arrays, keys), keys, "left").join(chromosomes, "Chromosome")
    return out.select(
        "Chromosome", "ChromosomeLengthBp", "Reference", "NumArrays", "TotalArrayBpRaw", percent("TotalArrayBpRaw", "ChromosomeLengthBp").alias("RawPercentChromosome"),
        F.col("l.ArraySize").alias("LargestArrayBp"), F.col("l.Start").alias("LargestArrayStart"), F.col("l.End").alias("LargestArrayEnd"),
        F.coalesce("ArrayN50Bp", F.lit(0)).alias("ArrayN50Bp"), F.coalesce("ArrayL50", F.lit(0)).alias("ArrayL50"), "MedianArrayBp", "MeanArrayBp", "ArrayP90Bp", "TotalMonomerHits", "MeanPidentWeightedByArrayBp",
    )


def satellitome(arrays: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Summed array sizes of each reference on each chromosome and on all, zeros included, with shares and ranks."""
    both = arrays.groupingSets([["Chromosome", "Reference"], ["Reference"]], "Chromosome", "Reference").agg(F.sum("ArraySize").alias("TotalArrayBp"), F.grouping("Chromosome").alias("all"))
    held = written(both.select(F.when(F.col("all") == 1, F.lit(GENOME)).otherwise(F.col("Chromosome")).alias("Chromosome"), "Reference", "TotalArrayBp"))  # a row for each cell
    places = chromosomes.select("Chromosome").unionByName(chromosomes.limit(1).select(F.lit(GENOME).alias("Chromosome")))
    grid = places.crossJoin(held.select("Reference").distinct())  # chromosomes by references, the result's own size
    full = grid.join(held, ["Chromosome", "Reference"], "left").na.fill(0, ["TotalArrayBp"])
    each = Window.partitionBy("Chromosome")
    full = full.withColumn("TotalSatellitomeBpRaw", F.sum("TotalArrayBp").over(each))
    rank = F.row_number().over(each.orderBy(F.desc("TotalArrayBp"), natural_key(F.col("Reference")), "Reference"))
    return full.select("Chromosome", "Reference", "TotalArrayBp", "TotalSatellitomeBpRaw", percent("TotalArrayBp", "TotalSatellitomeBpRaw").alias("PercentSatellitome"), rank.cast("long").alias("RankWithinChromosome"))


def pivoted(arrays: DataFrame, chromosomes: DataFrame, references: list[str], count: bool = False) -> DataFrame:
    """Chromosomes by references: summed array sizes, or numbers of arrays; 0 where there is none."""
    grouped = arrays.groupBy("Chromosome").pivot("Reference", references)
    table = grouped.count() if count else grouped.agg(F.sum("ArraySize"))
    return chromosomes.select("Chromosome").join(table, "Chromosome", "left").na.fill(0)
