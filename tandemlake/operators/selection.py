"""Exact percentiles of groups of any size and number.

The values of the wanted ranks are sought between bounds: the values of a group are counted in ranges between its least and
greatest, those ranges that hold a wanted rank are counted in ranges again, and when few values are left between the bounds
they are sorted. No task ever holds a group's values: what is kept are counts by range, and at the end up to `few` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

RANGES, FEW = 1_024, 100_000


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))


def percentiles(df: DataFrame, keys: list[str], value: str, points: Sequence[float], ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """keys, p: an array of the percentiles of value at the points, interpolated between neighbours, in each group that has
    a value that isn't null. Like percentile(), without its memory."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v"))
    sizes = written(rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    position = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(position(q)), F.ceil(position(q))) for q in points])))
    # the wanted ranks, each between bounds, with the number of values below them
    state = sizes.where("n > 0").select(*names, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), "n")
    other = [f"__o{i}" for i in range(len(keys))]
    while not (wide := state.where((F.col("n") > few) & (F.col("low") < F.col("high")))).isEmpty():
        bounds = wide.select(*[F.col(n).alias(o) for n, o in zip(names, other, strict=True)], "low", "high").distinct()
        inside = rows.join(bounds, _same(names, other) & F.col("v").between(F.col("low"), F.col("high")))
        step = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * ranges), F.lit(ranges - 1))
        counted = inside.groupBy(*other, "low", "high", step.alias("range")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*other, "low", "high").orderBy("range")) - F.col("n")  # a row for each range
        counted = counted.select(*other, F.col("low").alias("of_low"), F.col("high").alias("of_high"), upto.alias("below"), F.col("n").alias("m"), "least", "most")
        found = wide.join(counted, _same(names, other) & (F.col("low") == F.col("of_low")) & (F.col("high") == F.col("of_high")))
        found = found.where((F.col("rank") - F.col("before") >= F.col("below")) & (F.col("rank") - F.col("before") < F.col("below") + F.col("m")))
        narrowed = found.select(*names, "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("below")).alias("before"), F.col("m").alias("n"))
        state = written(state.where((F.col("n") <= few) | (F.col("low") >= F.col("high"))).unionByName(narrowed))
    told = state.where("low = high").select(*names, "rank", F.col("low").alias("v"))
    sought = state.where("low < high")
    bounds = sought.select(*[F.col(n).alias(o) for n, o in zip(names, other, strict=True)], "low", "high", "before").distinct()
    inside = rows.join(bounds, _same(names, other) & F.col("v").between(F.col("low"), F.col("high")))
    placed = inside.withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy(*other, "low", "high").orderBy("v")) - 1).select(*other, "at", F.col("v").alias("w"))
    sorted_ = sought.join(placed, _same(names, other) & (F.col("rank") == F.col("at"))).select(*names, "rank", F.col("w").alias("v"))
    values = told.unionByName(sorted_.distinct()).groupBy(*names).agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("held"))
    both = values.join(sizes.select(*[F.col(n).alias(o) for n, o in zip(names, other, strict=True)], "n"), _same(names, other))

    def at(q: float) -> Column:
        low, high = F.element_at("held", F.floor(position(q))), F.element_at("held", F.ceil(position(q)))
        share = position(q) - F.floor(position(q))
        return F.when(share == 0, low).otherwise((1 - share) * low + share * high)

    return both.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.array(*map(at, points)).alias("p"))
