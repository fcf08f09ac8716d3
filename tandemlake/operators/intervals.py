"""Joins of intervals: overlaps, inside and outside, nearest.

Overlaps are an equi-join on bins of several widths: an interval is dealt to the one or two bins that it touches of the
least width that isn't below its length, so that long intervals are as few rows as short ones, and to those of the greater
widths that the other side has. A pair meets in the wider one's bins, and counts only in the bin where both are first
together, so that no distinct is needed. Inside, outside and nearest need no pairs: running maxima of ends and minima of
starts along the positions tell the nearest interval on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written
from .running import TILE, running

#: Width of the narrowest bins, and of each next one in the one before.
BIN, STEP = 1 << 14, 4


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], closed: bool = False, bin: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals (Start, End) with equal keys: keys, a and b, structs of the rows.

    closed: ends belong to intervals (1-based); else they don't (0-based, half-open). Both sides are read twice: once for
    the widths of bins that they need.
    """
    last = (lambda end: end) if closed else (lambda end: end - 1)
    whole = lambda df: df.where(F.col("End") >= F.col("Start")) if closed else df.where(F.col("End") > F.col("Start"))
    # the least level whose bins are at least as wide as the interval is long
    length = last(F.col("End")) - F.col("Start") + 1
    level = F.greatest(F.ceil(F.log(length.cast("double") / bin) / F.log(F.lit(float(STEP))) - 1e-9), F.lit(0)).cast("int")
    held = [{r[0] for r in whole(df).select(level).distinct().toLocalIterator()} for df in (a, b)]  # some ten levels at most

    width = F.lit(bin) * F.pow(F.lit(float(STEP)), F.col("__level")).cast("long")
    touched = lambda name: F.explode(F.sequence(F.floor(F.col(f"{name}.Start") / width), F.floor(last(F.col(f"{name}.End")) / width))).alias("__bin")

    def dealt(df: DataFrame, name: str, levels: set[int], above: bool) -> DataFrame:
        """Rows in the bins that they touch of those levels that are at or above their own, or only above."""
        listed = F.array(*[F.lit(x).cast("int") for x in sorted(levels)]) if levels else F.array().cast("array<int>")
        mine = F.filter(listed, lambda x: x > level if above else x >= level)
        rows = whole(df).select(*keys, F.struct(*df.columns).alias(name), F.explode(mine).alias("__level"))
        return rows.select("*", touched(name))

    def own(df: DataFrame, name: str) -> DataFrame:
        rows = whole(df).select(*keys, F.struct(*df.columns).alias(name), level.alias("__level"))
        return rows.select("*", touched(name))

    met = own(a, "a").join(dealt(b, "b", held[0], above=False), [*keys, "__level", "__bin"])
    if held[0] and held[1] and max(held[1]) > min(held[0]):  # b has wider ones than some of a's
        met = met.unionByName(dealt(a, "a", held[1], above=True).join(own(b, "b"), [*keys, "__level", "__bin"]))
    meets = (F.col("a.Start") <= last(F.col("b.End"))) & (F.col("b.Start") <= last(F.col("a.End")))
    first = F.col("__bin") == F.floor(F.greatest("a.Start", "b.Start") / width)
    return met.where(meets & first).select(*keys, "a", "b")


def beside(a: DataFrame, b: DataFrame, key: str = "Chromosome", tile: int = TILE) -> DataFrame:
    """a (half-open) with left_end, the greatest end of b that begins before a's end, and right_start, the least start of b
    at a's end or behind; null where there is none. Each row of a comes once, equal rows too."""
    row = a.select(F.struct(*a.columns).alias("r")).schema["r"].dataType
    marks = b.select(key, F.col("Start").alias("__at"), F.lit(1).alias("__b"), F.col("Start").alias("__s"), F.col("End").alias("__e"), F.lit(None).cast(row).alias("__row"))
    asks = a.select(key, F.col("End").alias("__at"), F.lit(0).alias("__b"), F.lit(None).cast("long").alias("__s"), F.lit(None).cast("long").alias("__e"), F.struct(*a.columns).alias("__row"))
    both = marks.unionByName(asks)
    # at one position a's end comes first: intervals that begin there are on its right
    both = running(both, [key], "__at", ["__at", "__b"], {"left_end": ("max", F.col("__e"))}, tile)
    both = running(both, [key], "__at", ["__at", "__b"], {"right_start": ("min", F.col("__s"))}, tile, behind=True)
    return both.where("__b = 0").select("__row.*", "left_end", "right_start")


def is_inside() -> Column:
    """Whether a row of beside() overlaps an interval of b."""
    return F.coalesce(F.col("left_end") > F.col("Start"), F.lit(False))


def distance() -> Column:
    """Distance to the nearest interval: 0 inside, 1 where they touch, -1 without any on the key."""
    left, right = F.col("Start") - F.col("left_end") + 1, F.col("right_start") - F.col("End") + 1
    return F.when(is_inside(), F.lit(0)).otherwise(F.coalesce(F.least(left, right), F.lit(-1))).cast("long")


def nearest(a: DataFrame, b: DataFrame, key: str = "Chromosome", name: str = "block", tile: int = TILE, bin: int = BIN) -> DataFrame:
    """a with dist, and the name, start and end of each interval of b at that distance: a row for each of several."""
    # read by each of four branches
    found = written(beside(a, b, key, tile).withColumn("dist", distance()))
    kept = [*a.columns, "dist"]
    target = b.select(key, F.col("Start").alias("block_start"), F.col("End").alias("block_end"), F.col(name).alias("block"))
    inside = overlapping(found.where("dist = 0").select(*kept), b, [key], bin=bin).select("a.*", F.col("b.Start").alias("block_start"), F.col("b.End").alias("block_end"), F.col(f"b.{name}").alias("block"))
    near = found.where("dist > 0")
    left = near.where(F.col("Start") - F.col("left_end") + 1 == F.col("dist")).withColumn("block_end", F.col("left_end")).join(target, [key, "block_end"])
    right = near.where(F.col("right_start") - F.col("End") + 1 == F.col("dist")).withColumn("block_start", F.col("right_start")).join(target, [key, "block_start"])
    none = found.where("dist < 0").select(*kept, F.lit(None).cast("long").alias("block_start"), F.lit(None).cast("long").alias("block_end"), F.lit(None).cast("string").alias("block"))
    columns = [*kept, "block_start", "block_end", "block"]
    return inside.select(*columns).unionByName(left.select(*columns)).unionByName(right.select(*columns)).unionByName(none.select(*columns))
