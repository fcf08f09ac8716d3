"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles. All sets list their shingles in one global order, rare before frequent; two sets as
similar as asked share a shingle among the first n - ceil(t * n) + 1 of each, their prefixes. The index lists, for each
prefix shingle, the sets that hold it with their sizes and the shingle's place in them.

- Skipping in the index: at the first shingle that two sets share, what they can have in common is bounded by what is
  left behind its places. A list is cut into blocks of sets of like sizes; an entry's place and size say which blocks can
  hold a partner, its own, the next, or none as the smaller set, and only those are read. Within a block, places and
  sizes of both entries decide whether their sets are compared.
- Skipping in the answers: equal sets are one set. In each list, the entry with the fewest rarer shingles is the pivot;
  its similarity to the others is computed first. A set similar to a pivot takes over the pivot's answers: both are in one
  group, and need no comparison with others of the group. What is left to compare is pairs of one list whose groups differ.

The result is exact: a pair that meets the threshold is either connected already or meets in the list of the first shingle
it shares, passes the bound there and is compared over whole sets. The global order takes the shingles' frequencies, over
all documents, from a table of BINS counters of hashed shingles; shingles that share a counter only share a place in the
order, which costs time and loses nothing. A set is indexed once by each task that meets it, whatever its copies. Lists of
frequent shingles are dealt to as many parts as their counter asks for, each with a pivot of its own, of which the list's
pivot is one.

Defined results: null texts and texts without a word have no shingle, link with nothing and are their own component; a
text with fewer words than a shingle is one shingle. Equal texts link. A row with a null doc_id links with nothing and has
a null component. Rows with equal ids and texts are one; rows with equal ids and different texts connect what either
links and have one component, those without a shingle as well. A very long text is one task's row. An empty table gives an
empty result. Other columns, of whatever name, aren't read; `deduplicated` hands them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .common import checkpointed, components, giving_back, mix, shingle_sets, signed

WIDTH, PERCENT = 4, 85
#: Counters of the frequency table: one byte each while they are gathered and broadcast.
BINS = 1 << 24
#: Lists are dealt to parts where the counter says 2 ** HOT documents, and 2 ** APART times the mean of all counters.
HOT, APART = 14, 6
#: Up to so many ids (8 bytes each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Join:
    width: int = WIDTH
    percent: int = PERCENT
    bins: int = BINS
    hot: int = HOT
    apart: int = APART


def identity(shingles: np.ndarray) -> np.uint64:
    """One number for a set, whatever its order."""
    return mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]


def measured(docs: DataFrame, how: Join) -> DataFrame:
    """doc_id, n_shingles, node: the set's size and identity (null for an empty one)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for row, found in shingle_sets(batch.column(1), how.width):
                sizes[row], nodes[row] = len(found), identity(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(signed(nodes), mask=sizes == 0)], names=["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long")


def rarity(docs: DataFrame, how: Join) -> np.ndarray:
    """For each bin, the logarithm of how often the corpus has its shingles: a table of fixed size.

    Each task counts its documents into a table of its own.
    """
    bins = how.bins

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one byte a counter: what a task sees more than 255 times is frequent anyhow
        table = np.zeros(bins, np.uint8)
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), how.width):
                at = (found & np.uint64(bins - 1)).astype(np.int64)
                table[at] = np.minimum(table[at], 254) + 1
        yield from tables.sent(table)

    return tables.summed(docs.select("text").mapInArrow(count, tables.PARTS), bins, "u1", lambda counts: np.log2(counts + 1.0).astype(np.uint8))


def prefixes(docs: DataFrame, rare: np.ndarray, how: Join) -> DataFrame:
    """token, part, node, n, place: the index entries of every document, its prefix in the global order.

    part is 0 but for hot tokens, whose entries are dealt to parts from 1 on by their sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rare)
    # by parts: as doubles the whole table would take the driver 16 times its size
    mean = sum(float(np.exp2(rare[i : i + tables.PART].astype(np.float64)).sum()) for i in range(0, len(rare), tables.PART)) / max(1, len(rare))
    hot = max(how.hot, math.ceil(math.log2(max(1.0, mean))) + how.apart)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # 8 bytes for each set of the task
        for batch in batches:
            tokens, parts, nodes, sizes, places, held = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                counts = [len(t) for t in tokens]
                arrays = [pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(parts)), pa.array(signed(np.repeat(np.array(nodes, np.uint64), counts))), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.concatenate(places))]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, names=["token", "part", "node", "n", "place"])

            for _, found in shingle_sets(batch.column(0), how.width):
                n = len(found)
                node = identity(found) if n else np.uint64(0)
                if n == 0 or int(node) in seen:
                    continue
                seen.add(int(node))
                first = n - -(-how.percent * n // 100) + 1
                # the order: frequency above, hash below; six bits of the hash make room
                order = shared.value[found & np.uint64(len(shared.value) - 1)].astype(np.uint64) << np.uint64(58) | found >> np.uint64(6)
                order = np.sort(np.partition(order, first - 1)[:first] if first < n else order)
                frequent = (order >> np.uint64(58)).astype(np.int64) - hot
                spread = 1 + (int(node) >> 8) % (1 << np.clip(frequent + 1, 0, 16))
                tokens.append(order), nodes.append(node), sizes.append(n), places.append(np.arange(first, dtype=np.int32))
                parts.append(np.where(frequent >= 0, spread, 0).astype(np.int32))
                held += first
                if held > 200_000:
                    yield out()
                    tokens, parts, nodes, sizes, places, held = [], [], [], [], [], 0
            if tokens:
                yield out()

    return docs.select("text").mapInArrow(run, "token long, part int, node long, n int, place int")


def _possible(n: Column, place: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of n and m shingles that first meet at the given places can reach the threshold."""
    left = F.least(n - place, m - other).cast("long")
    return left * (100 + percent) >= F.lit(percent).cast("long") * (n + m)


def lists(entries: DataFrame) -> DataFrame:
    """The index lists of more than one set, each entry with its list's pivot.

    Parts of hot lists find their own pivots first; the list's is the least of those, a row for each part.
    """
    part = Window.partitionBy("token", "part")
    pivot = F.min(F.struct("place", "node", "n")).over(part)
    found = entries.withColumn("p", pivot).withColumn("low", F.min("node").over(part)).withColumn("high", F.max("node").over(part))
    found = checkpointed(found.where("low <> high or part > 0").select("token", "part", "node", "n", "place", "p", "low", "high").distinct())
    hot = found.where("part > 0")
    whole = checkpointed(hot.groupBy(F.col("token").alias("of")).agg(F.min("p").alias("least"), F.min("low").alias("first"), F.max("high").alias("last")).where("first <> last"))
    if whole.count() <= BROADCAST_IDS:
        whole = F.broadcast(whole)
    hot = hot.join(whole, F.col("token") == F.col("of")).select("token", "node", "n", "place", F.col("least").alias("p"))
    every = found.where("part = 0").select("token", "node", "n", "place", "p").unionByName(hot)
    return every.select("token", "node", "n", "place", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.place").alias("pivot_place"))


def compared(docs: DataFrame, sets: DataFrame, pairs: DataFrame, how: Join) -> DataFrame:
    """a, b, linked for each pair of nodes, from the whole texts of one document of each."""
    ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").select("node", "doc_id"))
    named = ids.withColumnRenamed("doc_id", "__id")
    if ids.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    texts = checkpointed(docs.select("doc_id", "text").join(named, F.col("doc_id") == F.col("__id")).select("node", "text").dropDuplicates(["node", "text"]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            linked = np.zeros(batch.num_rows, bool)
            right = shingle_sets(batch.column(3), how.width)
            for (row, x), (_, y) in zip(shingle_sets(batch.column(2), how.width), right, strict=True):
                if signed(np.array([identity(x)]))[0] != a[row] or signed(np.array([identity(y)]))[0] != b[row]:
                    continue  # another text under the same id
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked[row] = 100 * common >= how.percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _block(n: Column, percent: int) -> Column:
    """The block of a set's size: sizes of similar sets lie in one block or in two neighbours."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * 1.0001 + 1e-9)).cast("int")


def pairs_left(open_lists: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of one list with different groups that the skipping bounds leave. open_lists has token, node, n, place
    and group."""
    largest = F.floor(((100 + percent) * (F.col("n") - F.col("place")).cast("long") - percent * F.col("n")) / percent)
    own = _block(F.col("n"), percent)
    # as the smaller set of a pair, an entry reads the blocks up to the largest size that its place leaves within reach
    x = open_lists.where(largest >= F.col("n")).withColumn("block", F.explode(F.sequence(own, F.least(own + 1, _block(largest, percent))))).alias("x")
    y = open_lists.withColumn("block", own).alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.group") != F.col("y.group"))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    found = x.join(y, apart & order & _possible(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent))
    return found.select(*_pair(F.col("x.node"), F.col("y.node"))).distinct()


def _pair(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def links(docs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """a, b: verified links that connect every set with all it is similar to, directly or through one another."""
    index = lists(prefixes(docs, rarity(docs, how), how))
    star = index.where("node <> pivot").where(_possible(F.col("n"), F.col("place"), F.col("pivot_n"), F.col("pivot_place"), how.percent))
    star = checkpointed(star.select(*_pair(F.col("node"), F.col("pivot"))).distinct())
    first = checkpointed(compared(docs, sets, star, how))
    linked = first.where("linked").select("a", "b")
    group = components(linked).select("node", F.col("component").alias("group"))
    grouped = index.select("token", "node", "n", "place").join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    split = grouped.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    open_lists = checkpointed(grouped.join(split, "token", "left_semi"))
    rest = pairs_left(open_lists, how.percent).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = compared(docs, sets, checkpointed(rest), how)
    return linked.unionByName(second.where("linked").select("a", "b"))


def joined(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = checkpointed(measured(docs, how))
    sets = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = checkpointed(sets)
    named = rows.where("doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("rows"), F.count("node").alias("full"))
    several = checkpointed(several.where("first <> last or full > 0 and full < rows").select("doc_id", "first"))
    same = named.join(several, "doc_id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = components(links(docs.where("doc_id is not null"), sets, how).unionByName(same))
    # one class for equal sets and for rows of one id, then the smallest id of each component
    classes = sets.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id")
    out = rows.join(several, "doc_id", "left").withColumn("node", F.coalesce("node", "first")).join(named, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def deduplicated(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of each component one row, of its smallest doc_id.

    Rows with null ids stay. Texts are moved only for ids that come more than once, of which the longest stays.
    """
    found = checkpointed(joined(docs, how).where("component_id = doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")))
    kept = found
    if found.count() <= BROADCAST_IDS:
        kept = F.broadcast(found)
    whole = docs.select(F.struct("*").alias("row"))
    one = whole.join(kept, F.col("row.doc_id") == F.col("id"), "left")
    stay = one.where("row.doc_id is null or rows = 1").select("row.*")
    if found.where("rows > 1").isEmpty():
        return stay
    longest = F.max_by("row", F.struct(F.coalesce(F.length("row.text"), F.lit(-1)), "row.text"))
    return stay.unionByName(one.where("rows > 1").groupBy("id").agg(longest.alias("row")).select("row.*"))
