"""Repeat arrays from hits: gaps, data-driven merge distances, islands and their summaries.

Coordinates are 1-based and closed here: an interval's size is End - Start + 1, the gap of two is Start - End - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import natural_key
from .graph import written
from .running import TILE, running
from .selection import percentiles

GAP_CAP, FALLBACK_GAP = 10_000, 2_000
#: Fewer local gaps than this leave the fallback distance.
FEW = 5
GROUP = ["Reference", "Chromosome"]


def gaps(hits: DataFrame, tile: int = TILE) -> DataFrame:
    """hits with gap: distance to the farthest end before, of the same reference and chromosome; null for the first."""
    out = running(hits, GROUP, "Start", ["Start", "End"], {"prev_end": ("max", F.col("End"))}, tile)
    return out.withColumn("gap", F.col("Start") - F.col("prev_end") - 1)


def merge_distances(gapped: DataFrame, cap: int = GAP_CAP, fallback: int = FALLBACK_GAP) -> DataFrame:
    """One row for each reference: the distance up to which its hits merge, and the percentiles behind it.

    The 95th percentile of the gaps up to the cap decides. Those percentiles keep at most cap distinct values in memory;
    the ones over all gaps are made only for references with few local gaps, by counts of ranges.
    """
    gap, local = F.col("gap"), (F.col("gap") > 0) & (F.col("gap") <= cap)
    points = (0.5, 0.75, 0.9, 0.95)
    held = gapped.groupBy("Reference").agg(
        F.count_if(gap > 0).alias("n"), F.count_if(local).alias("near"), F.percentile(F.when(local, gap), F.lit(list(points))).alias("p")
    )
    held = written(held)  # a row for each reference
    few = held.where((F.col("near") < FEW) & (F.col("n") > 0)).select("Reference")
    if few.isEmpty():
        out = held.withColumn("q", F.lit(None).cast("array<double>"))
    else:
        rest = gapped.where(gap > 0).join(few, "Reference", "left_semi")
        out = held.join(percentiles(rest, ["Reference"], "gap", points).withColumnRenamed("p", "q"), "Reference", "left")
    few_local = F.col("near") < FEW
    shown = F.when(F.col("n") == 0, None).when(few_local, F.col("q")).otherwise(F.col("p"))
    adaptive = F.ceil(F.least(F.greatest(F.col("p")[3], F.lit(1.0)), F.lit(float(cap)))).cast("long")
    names = ("GapMedian_local_bp", "GapP75_local_bp", "GapP90_local_bp", "GapP95_local_bp")
    method = F.when(F.col("n") == 0, "fallback_no_positive_gaps").when(few_local, "fallback_few_local_gaps").otherwise("p95_local_gaps_capped")
    return out.select(
        "Reference", F.when(few_local, F.lit(fallback)).otherwise(adaptive).cast("long").alias("AdaptiveMergeGap_bp"),
        F.lit(fallback).cast("long").alias("FallbackGap_bp"), F.lit(cap).cast("long").alias("GapCap_bp"), F.col("n").alias("NumPositiveGaps"),
        *[shown[i].alias(name) for i, name in enumerate(names)], method.alias("Method"),
    )


def islands(gapped: DataFrame, distance: Column, keys: list[str], tile: int = TILE, order: Sequence[str] = ("Start", "End")) -> DataFrame:
    """gapped with island: a new one begins where the gap exceeds the distance, or is null. order: of its rows."""
    starts = gapped.withColumn("begins", F.coalesce(F.col("gap") > distance, F.lit(True)).cast("long"))
    # of equal intervals the one that begins an island comes first
    return running(starts, keys, "Start", [*order, F.desc("begins")], {"island": ("sum", F.col("begins"))}, tile, inclusive=True)


def arrays(hits: DataFrame, min_hits: int = 1, cap: int = GAP_CAP, fallback: int = FALLBACK_GAP, tile: int = TILE) -> DataFrame:
    """Arrays of at least min_hits hits, with the statistics of their hits.

    Medians keep an array's distinct values: lengths of hits, identities as they are printed, gaps up to the cap.
    """
    # read by the distances and by the islands: a few numbers for each hit
    gapped = written(gaps(hits.select(*GROUP, "Start", "End", "Strand", "Pident", "HitLength", "Bitscore"), tile))
    # one row for each reference
    distances = merge_distances(gapped, cap, fallback).select("Reference", "AdaptiveMergeGap_bp")
    found = islands(gapped.join(distances, "Reference"), F.col("AdaptiveMergeGap_bp"), GROUP, tile)
    # the gap before an array's first hit is not the array's
    inner = F.when((F.col("begins") == 0) & (F.col("gap") > 0), F.col("gap"))
    plus, minus = F.count_if(F.col("Strand") == "+"), F.count_if(F.col("Strand") == "-")
    out = found.groupBy(*GROUP, "island").agg(
        F.min("Start").alias("Start"), F.max("End").alias("End"), F.count("*").alias("NumMonomers"),
        F.avg("HitLength").alias("MeanMonomerHitLength"), F.median("HitLength").alias("MedianMonomerHitLength"),
        F.avg("Pident").alias("MeanPident"), F.median("Pident").alias("MedianPident"), F.avg("Bitscore").alias("MeanBitscore"),
        F.coalesce(F.median(inner), F.lit(0.0)).alias("MedianGap"), F.coalesce(F.max(inner), F.lit(0)).cast("long").alias("MaxGap"),
        F.first("AdaptiveMergeGap_bp").alias("AdaptiveMergeGap_bp"), plus.alias("PlusStrandHits"), minus.alias("MinusStrandHits"),
    ).where(F.col("NumMonomers") >= min_hits)
    mixed = F.when((F.col("PlusStrandHits") > 0) & (F.col("MinusStrandHits") > 0), "mixed").when(F.col("PlusStrandHits") > 0, "+").otherwise("-")
    return out.select(
        "Chromosome", "Start", "End", "Reference", (F.col("End") - F.col("Start") + 1).alias("ArraySize"), "NumMonomers", "MeanMonomerHitLength", "MedianMonomerHitLength",
        "MeanPident", "MedianPident", "MeanBitscore", "MedianGap", "MaxGap", "AdaptiveMergeGap_bp", "PlusStrandHits", "MinusStrandHits", mixed.alias("StrandMix"),
    )


def regions(arrays: DataFrame, tile: int = TILE) -> DataFrame:
    """Arrays of all references merged where they overlap; arrays that only touch stay apart."""
    ended = running(arrays, ["Chromosome"], "Start", ["Start", "End", "Reference"], {"prev_end": ("max", F.col("End"))}, tile)
    merged = ended.withColumn("gap", F.when(F.col("Start") <= F.col("prev_end"), F.lit(0)).otherwise(F.lit(1)))
    found = islands(merged, F.lit(0), ["Chromosome"], tile)
    out = found.groupBy("Chromosome", "island").agg(F.min("Start").alias("Start"), F.max("End").alias("End"), F.collect_set("Reference").alias("refs"))
    ordered = F.transform(F.array_sort(F.transform("refs", lambda r: F.struct(natural_key(r).alias("k"), r.alias("r")))), lambda x: x["r"])
    return out.select("Chromosome", "Start", "End", F.concat_ws(",", ordered).alias("References"), F.size("refs").cast("long").alias("NumReferences"), (F.col("End") - F.col("Start") + 1).alias("ArraySize"))


def by_reference(arrays: DataFrame) -> DataFrame:
    size, hits = "ArraySize", "NumMonomers"
    held = arrays.groupBy("Reference").agg(
        F.count("*").alias("NumArrays"), F.sum(size).alias("TotalArrayBp"), F.min(size).alias("MinArrayBp"), F.max(size).alias("MaxArrayBp"),
        F.sum(hits).alias("TotalMonomerHits"), F.avg("MeanPident").alias("MeanPident"),
    )
    for value, name in ((size, "MedianArrayBp"), (hits, "MedianMonomersPerArray")):
        held = held.join(percentiles(arrays, ["Reference"], value, (0.5,)).select("Reference", F.col("p")[0].alias(name)), "Reference", "left")
    return held.select("Reference", "NumArrays", "TotalArrayBp", "MinArrayBp", "MedianArrayBp", "MaxArrayBp", "TotalMonomerHits", "MedianMonomersPerArray", "MeanPident")


def n50(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ArrayN50Bp, ArrayL50: the size at which the largest arrays hold half of all, and how many those are."""
    sized = arrays.where("ArraySize > 0")
    # equal sizes count together: no more rows than distinct sizes of a key
    sizes = sized.groupBy(*keys, "ArraySize").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(F.desc("ArraySize")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    bp = F.col("ArraySize") * F.col("n")
    summed = sizes.select(*keys, "ArraySize", "n", F.coalesce(F.sum(bp).over(upto), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("larger"), (F.sum(bp).over(every) / 2).alias("half"))
    reached = summed.where(F.col("before") + bp >= F.col("half"))
    first = reached.groupBy(*keys).agg(F.max(F.struct("ArraySize", "before", "larger", "half")).alias("f"))
    more = F.greatest(F.ceil((F.col("f.half") - F.col("f.before")) / F.col("f.ArraySize")), F.lit(1))
    return first.select(*keys, F.col("f.ArraySize").alias("ArrayN50Bp"), (F.col("f.larger") + more).cast("long").alias("ArrayL50"))


def largest_per_reference(arrays: DataFrame, n: int = 2) -> DataFrame:
    best = Window.partitionBy("Reference").orderBy(F.desc("ArraySize"), "Chromosome", "Start", "End")
    return arrays.withColumn("Rank", F.row_number().over(best)).where(F.col("Rank") <= n)


def displayed(arrays: DataFrame, chromosomes: DataFrame, least: int = 80_000) -> DataFrame:
    """arrays with display_start and display_end: short ones widened around their middle, what sticks out cut off."""
    out = arrays.join(chromosomes, "Chromosome")
    half, middle = F.greatest(F.col("End") - F.col("Start"), F.lit(least)) / 2, (F.col("Start") + F.col("End")) / 2
    start, end = F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.col("ChromosomeLengthBp").cast("double"))
    return out.select(*arrays.columns, start.alias("display_start"), end.alias("display_end"))
