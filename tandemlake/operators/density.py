"""Binned coverage along chromosomes, merged hits and GC tracks. Bins are 0-based and half-open."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import gc_fraction
from .arrays import islands
from .graph import written
from .running import TILE, running
from .selection import percentiles

MERGE_GAP, BIN, TOP = 2_000, 100_000, 10
#: The angle left free behind a chromosome in a circular plot.
GAP_ANGLE = math.radians(2.0)


def merged_runs(hits: DataFrame, gap: int = MERGE_GAP, tile: int = TILE) -> DataFrame:
    """Hits merged with the one before if it has the same reference and ends at most gap before: a hit of another
    reference in between breaks the run. Chromosome, Start, End, Reference.

    Runs and their farthest ends are made within tiles of positions; a row for each tile tells whether its first run goes
    on an earlier one, and how far that reaches.
    """
    order = ["Start", "Reference", "End"]
    along = Window.partitionBy("Chromosome", "tile").orderBy(*order)
    tiled = hits.select("Chromosome", "Start", "End", "Reference", F.floor(F.col("Start") / tile).alias("tile"))
    changed = (F.col("Reference") != F.lag("Reference").over(along)).cast("int")  # null for a tile's first hit
    local = tiled.withColumn("changed", changed).withColumn("run", F.coalesce(F.sum("changed").over(along), F.lit(0)))
    # runs are numbered upwards: the greatest (run, End) before has the farthest end of the latest run
    local = written(local.withColumn("before", F.max(F.struct("run", "End")).over(along.rowsBetween(Window.unboundedPreceding, -1))))
    place = F.struct(*order)
    tiles = local.groupBy("Chromosome", "tile").agg(F.min_by("Reference", place).alias("first"), F.max_by("Reference", place).alias("last"), F.max(F.struct("run", "End")).alias("open"))
    over = Window.partitionBy("Chromosome").orderBy("tile")
    begins = (F.coalesce(F.col("first") != F.lag("last").over(over), F.lit(True))).cast("int")
    tiles = tiles.withColumn("begins", begins).withColumn("runs", F.sum(F.col("begins") + F.col("open.run")).over(over))
    carried = F.max(F.struct("runs", F.col("open.End").alias("End"))).over(over.rowsBetween(Window.unboundedPreceding, -1))
    tiles = tiles.select("Chromosome", "tile", "begins", carried["End"].alias("carried"))
    rows = local.join(tiles, ["Chromosome", "tile"])
    goes_on = (F.col("run") == 0) & (F.col("begins") == 0)
    near = F.when(F.col("before.run") == F.col("run"), F.col("before.End"))
    far = F.when(goes_on, F.greatest(near, F.col("carried"))).otherwise(near)
    rows = rows.select("Chromosome", "Start", "End", "Reference", (F.col("Start") - far).alias("gap"))
    pieces = islands(rows, F.lit(gap), ["Chromosome"], tile, ["Start", "Reference", "End"])
    return pieces.groupBy("Chromosome", "Reference", "island").agg(F.min("Start").alias("Start"), F.max("End").alias("End")).select("Chromosome", "Start", "End", "Reference")


def merged_by_reference(hits: DataFrame, gap: int = MERGE_GAP, tile: int = TILE) -> DataFrame:
    """Hits of one reference merged where at most gap lies between, whatever stands there."""
    keys = ["Chromosome", "Reference"]
    ended = running(hits, keys, "Start", ["Start", "End"], {"far": ("max", F.col("End"))}, tile).withColumn("gap", F.col("Start") - F.col("far"))
    found = islands(ended, F.lit(gap), keys, tile)
    return found.groupBy(*keys, "island").agg(F.min("Start").alias("Start"), F.max("End").alias("End")).select("Chromosome", "Start", "End", "Reference")


def bins(chromosomes: DataFrame, bin: int = BIN) -> DataFrame:
    """Chromosome, Start, End of each bin; the last one is cut at the chromosome's end."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ChromosomeLengthBp") - 1, F.lit(bin).cast("long")))
    cut = chromosomes.where("ChromosomeLengthBp > 0").select("Chromosome", "ChromosomeLengthBp", starts.alias("Start"))
    return cut.select("Chromosome", "Start", F.least(F.col("Start") + bin, "ChromosomeLengthBp").alias("End"))


def top_by_abundance(intervals: DataFrame, n: int = TOP) -> DataFrame:
    """The n references with most bases, as a report: Reference, TotalBp."""
    size = F.greatest(F.col("End") - F.col("Start"), F.lit(0))
    return intervals.groupBy("Reference").agg(F.sum(size).alias("TotalBp")).orderBy(F.desc("TotalBp"), "Reference").limit(n)


def top_by_order(sequences: DataFrame, n: int = TOP) -> DataFrame:
    """The first n distinct references in input order: Reference, FirstIndex."""
    return sequences.groupBy("Reference").agg(F.min("index").alias("FirstIndex")).orderBy("FirstIndex", "Reference").limit(n)


def coverage(intervals: DataFrame, chromosomes: DataFrame, groups: DataFrame, label: Column, bin: int = BIN) -> DataFrame:
    """Bases of each bin covered by each group: overlaps summed and capped at the bin. Chromosome, Start, End, Reference,
    Coverage_bp, zeros included.

    groups names the groups (Reference), label a row's. Intervals are dealt to the bins that they touch.
    """
    grid = bins(chromosomes, bin)
    first, last = F.greatest(F.floor(F.col("Start") / bin), F.lit(0)), F.floor((F.col("End") - 1) / bin)
    touched = intervals.where("End > Start").where(F.col("End") > 0).select("Chromosome", label.alias("Reference"), "Start", "End", F.explode(F.sequence(first, last)).alias("b"))
    # a bin's end may lie before its nominal one
    held = touched.join(chromosomes, "Chromosome").withColumn("over", F.greatest(F.least(F.col("End"), (F.col("b") + 1) * bin, "ChromosomeLengthBp") - F.greatest(F.col("Start"), F.col("b") * bin), F.lit(0)))
    summed = held.groupBy("Chromosome", (F.col("b") * bin).alias("Start"), "Reference").agg(F.sum("over").alias("raw"))
    full = grid.crossJoin(groups.select("Reference"))  # bins by groups, the result's own size
    out = full.join(summed, ["Chromosome", "Start", "Reference"], "left")
    return out.select("Chromosome", "Start", "End", "Reference", F.least(F.coalesce("raw", F.lit(0)), F.col("End") - F.col("Start")).alias("Coverage_bp"))


def total(coverage: DataFrame) -> DataFrame:
    """All groups together, which may exceed a bin."""
    return coverage.groupBy("Chromosome", "Start", "End").agg(F.sum("Coverage_bp").alias("Coverage_bp"))


def gc_track(contigs: DataFrame, bin: int = BIN) -> DataFrame:
    """Chromosome, Start, End, GC_fraction of each bin of each contig (Chromosome, seq), which is cut into bins once."""
    part = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{bin}}}"), F.lit(0))
    cut = contigs.where(F.length("seq") > 0).select("Chromosome", F.posexplode(part).alias("k", "part"))
    start = F.col("k").cast("long") * bin
    return cut.select("Chromosome", start.alias("Start"), (start + F.length("part")).alias("End"), gc_fraction(F.col("part")).alias("GC_fraction"))


def plot_track(track: DataFrame) -> DataFrame:
    """A GC track with GC_plot: missing values take the median, all are scaled to 0 to 1."""
    half = percentiles(track, [], "GC_fraction", (0.5,)).select(F.col("p")[0].alias("mid"))
    ends = track.agg(F.min("GC_fraction").alias("lo"), F.max("GC_fraction").alias("hi"))
    middle = ends.join(half, how="left")  # one row each
    filled = track.crossJoin(F.broadcast(middle))  # one row
    scaled = (F.coalesce("GC_fraction", "mid") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return filled.select("Chromosome", "Start", "End", "GC_fraction", F.greatest(F.least(F.coalesce(scaled, F.lit(0.5)), F.lit(1.0)), F.lit(0.0)).alias("GC_plot"))


def offsets(chromosomes: DataFrame, gap: float = GAP_ANGLE, tile: int = TILE) -> DataFrame:
    """Where each chromosome (index, Chromosome, ChromosomeLengthBp) begins in a plot of all, in their order: with Offset in
    bases, and StartTheta and EndTheta on a circle, of which each chromosome takes its share and a gap behind it."""
    length = F.col("ChromosomeLengthBp").cast("double")
    placed = running(chromosomes.select("index", "Chromosome", "ChromosomeLengthBp"), [], "index", ["index"], {"Offset": ("sum", F.col("ChromosomeLengthBp")), "__earlier": ("sum", F.lit(1))}, tile)
    whole = chromosomes.agg(F.sum(length).alias("__total"), F.count("*").alias("__n"))
    out = placed.crossJoin(F.broadcast(whole))  # one row
    free, total = F.greatest(F.lit(2 * math.pi) - F.lit(gap) * F.col("__n"), F.lit(0.0)), F.when(F.col("__total") > 0, F.col("__total")).otherwise(F.lit(1.0))
    start = F.col("Offset") / total * free + F.lit(gap) * F.col("__earlier")
    return out.select("index", "Chromosome", "ChromosomeLengthBp", "Offset", start.alias("StartTheta"), (start + length / total * free).alias("EndTheta"))


def bin_angles(track: DataFrame, offsets: DataFrame) -> DataFrame:
    """track (Chromosome, Start, End and more) with the angles of each row's ends, linear along its chromosome."""
    placed = track.join(offsets.select("Chromosome", "ChromosomeLengthBp", "StartTheta", "EndTheta"), "Chromosome")
    at = lambda pos: F.col("StartTheta") + F.col(pos) / F.nullif(F.col("ChromosomeLengthBp"), F.lit(0)) * (F.col("EndTheta") - F.col("StartTheta"))
    return placed.select(*track.columns, at("Start").alias("StartAngle"), at("End").alias("EndAngle"))
