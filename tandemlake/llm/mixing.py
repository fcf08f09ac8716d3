"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key, -ln(u) / weight, with u from its id and a seed and the weight from its quality;
within a source the smallest keys come first. A source's target is met by complete epochs of all its documents and then
by a fraction of one more: the documents in key order as far as the prefix sum of their sizes reaches the rest.

No source is sorted as a whole: documents are counted into key ranges, ranges are summed, and only the one range of each
source in which the budget ends is sorted. Rows equal in key and size are counted there as one with their number; where
the budget ends among them, as many are taken as fit. The text is read for its size and never shuffled.

Defined results: null text has size 0; null is a source of its own, last in order; documents of size 0 are taken with
their place in the key order and count nothing. Rows with equal ids have equal keys and come in order of size; among rows
equal in both it is rows, not ids, that are taken. A very long text is counted whole, and may overshoot a target by half
its size. An empty table gives an empty result. All columns of the input, of whatever name, pass through `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, unit_interval, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Documents of a key range of a source, on average, and the least and the most ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 4_096, 1 << 10, 1 << 24
#: Plans of up to so many sources (some 100 bytes each) are broadcast to the documents; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Equal rows that one task makes of their number.
CHUNK = 10_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = WEIGHTS
    share: float = SHARE
    most_epochs: float = MOST_EPOCHS
    seed: str = SEED
    range_rows: int = RANGE_ROWS


def quality(size: Column, characters: Column) -> Column:
    """Weight in 0.5 to 1: 1 for a mean word of 3 to 10 characters, less beyond, as junk has."""
    mean = characters / F.greatest(size, F.lit(1))
    return F.when((mean >= 3) & (mean <= 10), F.lit(1.0)).when((mean >= 2) & (mean <= 16), F.lit(0.75)).otherwise(F.lit(0.5))


def sized(docs: DataFrame, columns: list[str], mix: Mix) -> DataFrame:
    """row (a struct of the columns), id, size, source, key."""
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    measured = docs.select(kept, F.col("doc_id").alias("id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), F.md5("text").alias("digest"))
    uniform = unit_interval(F.lit(mix.seed), F.coalesce(F.col("id").cast("string"), F.col("digest"), F.lit("null")))
    return measured.select("row", "id", "size", "source", (-F.log(uniform) / quality(F.col("size"), F.col("chars"))).alias("key"))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size -> with target: weighted shares of the whole, cut at most_epochs and dealt again.

    Dealing the excess again and again ends at target = min(most_epochs * size, level * weight) with one level for all;
    in order of size / weight, the sources up to some place are full and the level follows from the others. These are
    windows over one row for each source.
    """
    everything = Window.partitionBy()
    listed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("place") - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    listed = listed.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(mix.most_epochs))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    listed = (
        listed.withColumn("total", F.sum("source_size").over(everything) * F.lit(mix.share))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone")))
    )
    open_level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(open_level["level"] * F.col("weight"), F.col("most")))
    return listed.select("source", "source_size", F.round(target, 6).alias("target"))


def _range(key: Column, ranges: Column) -> Column:
    """A key's range: 1 - exp(-key) lies in 0 to 1, grows with the key and is uniform for weight 1."""
    return F.least(F.floor((1 - F.exp(-key)) * ranges), ranges - 1).cast("int")


def budgets(measured: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, the range in which the fraction ends (null: nowhere)
    of how many, and last: the last rows that it takes of this range as key, size, their number n and how many of them are
    taken, k (null: it takes none of the range)."""
    ranges = min(MOST_RANGES, max(LEAST_RANGES, measured.count() // mix.range_rows))
    m = measured.select("source", "size", "key", _range(F.col("key"), F.lit(ranges)).alias("range"))
    held = m.groupBy("source", "range").agg(F.sum("size").alias("size"))
    plan = targets(held.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    whole = F.col("source_size")
    plan = plan.withColumn("epochs", F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * whole)
    summed = held.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("range")))
    split = (
        plan.alias("p").join(summed.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")))
        .where("upto > rest").groupBy("p.source").agg(F.min(F.struct("range", (F.col("upto") - F.col("r.size")).alias("before"))).alias("at"), F.first("rest").alias("rest"))
        .select("source", "at.range", "at.before", "rest")
    )
    near = m.alias("m").join(split.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source")) & (F.col("m.range") == F.col("s.range")))
    equal = near.groupBy("s.source", "key", "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("key", "size"))
    left = F.col("rest") - (upto - F.col("size") * F.col("n"))
    # the row on the border is taken if at least half of it fits
    fit = F.when(left < 0, F.lit(0)).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(left / F.col("size") + 0.5))).cast("long")
    last = equal.select("source", "key", "size", "n", fit.alias("k")).where("k > 0").groupBy("source").agg(F.max(F.struct("key", "size", "n", "k")).alias("last"))
    ends = split.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.source", "range", "last")
    joined = plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    return joined.select("p.source", "source_size", "target", "epochs", "range", F.lit(ranges).alias("ranges"), "last")


def planned(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """row, id, size, source, key, plan, copies: how often the mix takes each row."""
    plan = plan.select(F.col("source").alias("of"), F.struct("source_size", "target", "epochs", "range", "ranges", "last").alias("plan"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = measured.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    p, mine = F.col("plan"), F.struct("key", "size")
    last = F.struct(p["last"]["key"].alias("key"), p["last"]["size"].alias("size"))
    inside = F.when(p["range"].isNull(), F.lit(0)).when(p["last"].isNull(), (_range(F.col("key"), p["ranges"]) < p["range"]).cast("int")).otherwise((mine <= last).cast("int"))
    out = joined.withColumn("copies", p["epochs"] + inside)
    divided = p["last"].isNotNull() & (p["last"]["k"] < p["last"]["n"]) & (mine == last)
    if plan.where("plan.last.k < plan.last.n").isEmpty():
        return out
    return out.where(~F.coalesce(divided, F.lit(False))).unionByName(_numbered(out.where(divided)))


def _numbered(equal: DataFrame) -> DataFrame:
    """Rows equal in source, key and size of which only k are taken, each with its copies.

    They are counted before they move, numbered by runs of equal rows, and made again in tasks of CHUNK rows.
    """
    runs = equal.groupBy("row", "id", "size", "source", "key", "plan").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("id", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("k", F.col("plan.last.k") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    chunks = runs.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})"))).repartition(F.xxhash64("row", "id", "chunk"))
    each = chunks.withColumn("i", F.explode(F.expr(f"sequence(chunk * {CHUNK} + 1, least(n, (chunk + 1) * {CHUNK}))")))
    return each.select("row", "id", "size", "source", "key", "plan", (F.col("plan.epochs") + (F.col("i") <= F.col("k")).cast("int")).alias("copies"))


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for each row of docs."""
    measured = checkpointed(sized(docs, ["doc_id"], mix))
    d = planned(measured, checkpointed(budgets(measured, mix)))
    return d.select(
        F.col("id").alias("doc_id"), "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies",
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with docs' columns.

    The measures are checkpointed to plan from; docs are read once more for their columns.
    """
    small = checkpointed(sized(docs, ["doc_id"], mix).drop("row"))
    d = planned(sized(docs, docs.columns, mix), checkpointed(budgets(small, mix))).where("copies > 0")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
