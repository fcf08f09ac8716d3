"""Embedding near-duplicates by NN-descent.

Vectors of one label and dimension are compared by cosine in double precision. Equal vectors are one class and are
compared once. A neighbour graph keeps each class's nearest found so far, NEIGHBOURS at first. It starts from sorted
lists: TABLES times, classes are ordered by the signs of random projections and compared with those next to them. Then
rounds of local joins compare the neighbours of each class, those in its list and those in whose lists it is, with one
another, as far as one of two is new, until few lists change. Classes are dealt to blocks of like ones, and a block gets
each vector that its lists name once.

A list is saturated if all its places are links, that is, reach the threshold: more links may exist than it has room for.
Saturated lists are enlarged to twice their places, up to ENLARGED times, and joined again. Classes whose lists are
saturated even then are compared with their whole component of links, in blocks of BLOCK classes, so that links are
counted where they arise and no list of all pairs is made. Links between two components with saturated lists have no place
in any list: such components are held against one another as balls (blocks of classes with a centre and an angle), and the
classes of balls that a link can span are compared; components that a link joins become one. The angles are a triangle
inequality, so this is exact.

A bounded sample of AUDITED classes is compared with every vector; while less than RECALL of their links are found, more
sorted lists are added, up to ATTEMPTS times. If that isn't enough, all components are treated as saturated ones are: then
every link is found. The recall of the audit that counts is a column of the result.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links
with nothing and is its own component; finite components of any size are compared. A null vec_id links with nothing, has a
null component and isn't kept. Rows equal in id and vector are one vector. Other columns, of whatever name, aren't read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import written
from .common import components

THRESHOLD = 0.93
NEIGHBOURS, TABLES, BITS, NEAR = 12, 6, 30, 32
ROUNDS, SETTLED = 4, 0.002
ENLARGED, BLOCK, LISTS = 1, 256, 512
AUDITED, RECALL, ATTEMPTS = 256, 0.95, 3
#: ENLARGED: doublings of a saturated list. LISTS: classes of a block of local joins.
#: Balls compared with as many others at once, and what rounding may add to an angle.
TILE, SLACK = 1024, 1e-6
EDGE = "a long, b long, cosine double, fresh boolean"


@dataclass(frozen=True)
class Descent:
    threshold: float = THRESHOLD
    neighbours: int = NEIGHBOURS
    tables: int = TABLES
    near: int = NEAR
    rounds: int = ROUNDS
    block: int = BLOCK
    audited: int = AUDITED
    recall: float = RECALL
    enlarged: int = ENLARGED
    lists: int = LISTS
    kind: str = "<f8"  # numpy's name for a vector's components


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision from a column of raw vectors of one dimension."""
    if not len(column):
        return np.zeros((0, 0))
    points = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    # by the largest component first: squares of any finite numbers then neither overflow nor vanish
    points /= np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def _kind(vectors: DataFrame) -> str:
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, space (label and dimension), raw (a vector's bytes), same (the vector's class): one row for each, space null
    where a vector links with nothing."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, dims = [], []
            for x in batch.column(1):
                values = x.values
                usable = x.is_valid and len(values) > 0 and values.null_count == 0
                point = np.asarray(values.to_numpy(zero_copy_only=False), kind) if usable else None
                fine = usable and bool(np.isfinite(point).all()) and bool(point.any())
                raws.append(point.tobytes() if fine else None)
                dims.append(len(point) if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "label", "dim", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>"), F.col("label").cast("string").alias("label"))
    rows = rows.mapInArrow(run, "vec_id long, label string, dim int, raw binary")
    space = F.when(F.col("raw").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.concat_ws(":", F.col("dim").cast("string"), "label"))
    return rows.select("vec_id", space.alias("space"), "raw", F.md5(F.concat(F.encode(F.coalesce(space, F.lit("")), "utf-8"), "raw")).alias("same"))


def _ranked(edges: DataFrame) -> DataFrame:
    """The edges taken both ways, each once, with their rank among those of a. An edge is fresh if all its rows are."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", "fresh"))
    once = both.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.min("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b")))


def _within(ranked: DataFrame, widths: DataFrame | None, how: Descent, times: int = 1) -> DataFrame:
    """Of each class its `times` * NEIGHBOURS nearest, or as many times its own width."""
    if widths is None:
        return ranked.where(F.col("rank") <= times * how.neighbours).drop("rank")
    held = ranked.join(widths, "a", "left").where(F.col("rank") <= times * F.coalesce("width", F.lit(how.neighbours)))
    return held.select("a", "b", "cosine", "fresh")


def signs(classes: DataFrame, how: Descent, seed: int) -> DataFrame:
    """id, space, turn, code, raw: each class in `tables` orders by the signs of random projections."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(x) for x in batch.column(2).to_pylist()]) // np.dtype(how.kind).itemsize
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, how.tables * BITS))
                bits = (matrix(part.column(2), how.kind) @ planes[dim] > 0).reshape(part.num_rows, how.tables, BITS)
                codes = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for t in range(how.tables):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, t, np.int32)), pa.array(codes[:, t]), part.column(2)], names=["id", "space", "turn", "code", "raw"])

    return classes.select("id", "space", "raw").mapInArrow(sign, "id long, space string, turn int, code long, raw binary")


def placed(classes: DataFrame, how: Descent) -> DataFrame:
    """id, space, raw, block: classes in blocks of at most LISTS like ones of one space."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, space = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            blocks = np.zeros(batch.num_rows, np.int64)
            for row, of in enumerate(batch.column(1).to_pylist()):
                if held == how.lists or (held and of != space):
                    number, held = number + 1, 0
                blocks[row], held, space = number, held + 1, of
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(blocks)], names=["id", "space", "raw", "block"])

    order = ["space", "code", "id"]
    rows = signs(classes, replace(how, tables=1), 0).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("id", "space", "raw").mapInArrow(deal, "id long, space string, raw binary, block long"))


def sorted_lists(classes: DataFrame, how: Descent, seed: int) -> DataFrame:
    """Edges between classes next to one another in TABLES orders."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # the last rows wait for those that follow them
            yield from _beside(held, how)
            held = held.slice(max(0, held.num_rows - how.near)).combine_chunks()

    order = ["space", "turn", "code", "id"]
    return signs(classes, how, seed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, EDGE)


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _beside(table: pa.Table, how: Descent) -> Iterator[pa.RecordBatch]:
    """Each row's nearest among the `near` rows before it and behind it, of the same space and order."""
    ids, turn, space, raw = table.column("id").to_numpy(), table.column("turn").to_numpy(), np.array(table.column("space").to_pylist()), _column(table, "raw")
    starts = np.flatnonzero(np.concatenate([[True], (space[1:] != space[:-1]) | (turn[1:] != turn[:-1])]))
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        points = matrix(raw.slice(begin, end - begin), how.kind)
        step = how.near
        for at in range(0, end - begin, step):
            mine, others = slice(at, min(at + step, end - begin)), slice(at, min(at + 2 * step, end - begin))
            found = points[mine] @ points[others].T
            found[np.tril_indices(found.shape[0], 0, found.shape[1])] = -2
            yield from _nearest(ids[begin:end][mine], ids[begin:end][others], found, how.neighbours)


def _edges(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> list[pa.Array]:
    return [pa.array(a), pa.array(b), pa.array(cosine), pa.array(np.ones(len(a), bool))]


def _nearest(rows: np.ndarray, columns: np.ndarray, found: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    k = min(k, found.shape[1])
    best = np.argpartition(-found, k - 1, axis=1)[:, :k]
    a, b, cosine = np.repeat(rows, k), columns[best].reshape(-1), np.take_along_axis(found, best, 1).reshape(-1)
    kept = cosine > 0
    yield pa.RecordBatch.from_arrays(_edges(a[kept], b[kept], cosine[kept]), names=["a", "b", "cosine", "fresh"])


def local_join(graph: DataFrame, nodes: DataFrame, widths: DataFrame | None, how: Descent) -> DataFrame:
    """Edges among the neighbours of each class, forward and reverse, that would enter either's list.

    Of reverse neighbours the nearest count, so that a list and they are twice a list at most.
    """
    sizes = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    sizes = sizes.withColumn("width", F.lit(how.neighbours)) if widths is None else sizes.join(widths, "a", "left").withColumn("width", F.coalesce("width", F.lit(how.neighbours)))
    bar = sizes.where("n >= width").select(F.col("a").alias("b"), F.col("least").alias("bar"))
    around = _within(_ranked(graph), widths, how, 2).select("a", "b", "fresh")
    active = around.where("fresh").select("a").distinct()
    listed = around.join(active, "a", "left_semi").join(nodes.select(F.col("id").alias("a"), "block"), "a")
    needed = listed.select("block", "b").distinct().join(nodes.select(F.col("id").alias("b"), "raw"), "b").join(bar, "b", "left").select("block", "b", F.coalesce("bar", F.lit(-1.0)).alias("bar"), "raw")

    def join(lists: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids)
        ids, points, bars = ids[order], matrix(_column(vectors, "vector"), how.kind)[order], vectors.column("least").to_numpy()[order]
        owner, at, fresh = lists.column("owner").to_numpy(), np.searchsorted(ids, lists.column("member").to_numpy()), lists.column("new").to_numpy()
        order = np.argsort(owner, kind="stable")
        owner, at, fresh = owner[order], at[order], fresh[order]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.diff(np.append(starts, len(owner)))
        made = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        by_size = np.argsort(sizes, kind="stable")
        for k in range(0, len(starts), 64):
            some = by_size[k : k + 64]
            # lists of like sizes side by side, filled up
            place = starts[some][:, None] + np.arange(sizes[some].max())[None, :]
            used = np.arange(place.shape[1])[None, :] < sizes[some][:, None]
            place = np.minimum(place, len(owner) - 1)
            member, new = at[place], fresh[place]
            found = points[member] @ points[member].transpose(0, 2, 1)
            better = found > np.minimum(bars[member][:, :, None], bars[member][:, None, :])
            better &= used[:, :, None] & used[:, None, :] & (new[:, :, None] | new[:, None, :]) & (member[:, :, None] < member[:, None, :])
            g, i, j = np.nonzero(better)
            made.append((member[g, i], member[g, j], found[g, i, j]))
        a, b, cosine = (np.concatenate(x) for x in zip(*made, strict=True))
        _, once = np.unique(a * len(ids) + b, return_index=True)
        return pa.Table.from_arrays(_edges(ids[a[once]], ids[b[once]], cosine[once]), names=["a", "b", "cosine", "fresh"])

    # under names of their own: both sides come from the same tables
    lists = listed.select(F.col("block").alias("of"), F.col("a").alias("owner"), F.col("b").alias("member"), F.col("fresh").alias("new"))
    vectors = needed.select(F.col("block").alias("for"), F.col("b").alias("id"), F.col("bar").alias("least"), F.col("raw").alias("vector"))
    return lists.groupBy("of").cogroup(vectors.groupBy("for")).applyInArrow(join, EDGE)


def descended(graph: DataFrame, nodes: DataFrame, widths: DataFrame | None, how: Descent) -> DataFrame:
    """The graph after rounds of local joins. What a round adds is fresh in the next one."""
    for _ in range(how.rounds):
        added = local_join(graph, nodes, widths, how)
        known = graph.withColumn("fresh", F.lit(False))
        graph = written(_within(_ranked(known.unionByName(added)), widths, how))
        changed, size = graph.agg(F.count_if("fresh"), F.count("*")).first()
        if changed <= SETTLED * size:
            break
    return graph


def _full(graph: DataFrame, widths: DataFrame | None, how: Descent) -> DataFrame:
    """a, width: the classes whose lists are saturated."""
    sizes = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    sizes = sizes.withColumn("width", F.lit(how.neighbours)) if widths is None else sizes.join(widths, "a", "left").withColumn("width", F.coalesce("width", F.lit(how.neighbours)))
    return sizes.where((F.col("n") >= F.col("width")) & (F.col("least") >= how.threshold)).select("a", "width")


def neighbour_graph(edges: DataFrame, nodes: DataFrame, how: Descent) -> tuple[DataFrame, DataFrame | None]:
    """The neighbour graph from some edges, and the widths of enlarged lists."""
    graph = descended(written(_within(_ranked(edges), None, how)), nodes, None, how)
    widths = None
    for _ in range(how.enlarged):
        wider = written(_full(graph, widths, how).select("a", (2 * F.col("width")).cast("int").alias("width")))
        if wider.isEmpty():
            break
        widths = wider if widths is None else written(widths.join(wider, "a", "left_anti").unionByName(wider))
        # the lists that have room now meet once more, as if they were new
        again = graph.join(wider.withColumnRenamed("width", "now"), "a", "left").select("a", "b", "cosine", F.col("now").isNotNull().alias("fresh"))
        graph = descended(again, nodes, widths, replace(how, rounds=1))
    return graph, widths


def saturated(graph: DataFrame, widths: DataFrame | None, groups: DataFrame, how: Descent) -> DataFrame:
    """The components that hold a saturated list."""
    return _full(graph, widths, how).join(groups, F.col("a") == F.col("node")).select("component").distinct()


def in_blocks(members: DataFrame, how: Descent) -> DataFrame:
    """members with the number of blocks of their component and their own block."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / how.block).cast("int").alias("blocks"))
    return members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def bridges(members: DataFrame, how: Descent) -> DataFrame:
    """a, b: the pairs of components between which there is a link; members has component, node, space, raw."""
    members = written(in_blocks(members, how).select("component", "own", "node", "space", "raw"))
    reach = float(np.arccos(how.threshold)) + SLACK

    def ball(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = matrix(_column(pa.Table.from_batches(list(batches)), "raw"), how.kind)  # one block
        middle = points.sum(axis=0)
        norm = float(np.sqrt((middle * middle).sum()))
        centre = middle / norm if norm > SLACK else points[0]
        radius = float(np.arccos(np.clip(points @ centre, -1, 1)).max())
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), pa.int64(), pa.int32()), strict=True)] + [pa.array([centre.astype(np.float64).tobytes()], pa.binary()), pa.array([radius])], names=["space", "component", "own", "raw", "radius"])

    balls = written(members.groupBy("space", "component", "own").applyInArrow(ball, "space string, component long, own int, raw binary, radius double"))
    tiles = balls.groupBy("space").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    spread = balls.join(tiles, "space").withColumn("tile", F.pmod(F.xxhash64("component", "own"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("space", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "component", "own", "raw", "radius")

    def near(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()  # two tiles at most
        tile, component, own, radius = (table.column(c).to_numpy() for c in ("tile", "component", "own", "radius"))
        points = matrix(_column(table, "raw"), "<f8")
        for at in range(0, len(points), how.block):
            rows = np.arange(at, min(at + how.block, len(points)))
            close = np.arccos(np.clip(points[rows] @ points.T, -1, 1)) <= radius[rows, None] + radius[None, :] + reach
            close &= component[rows, None] < component[None, :]
            if key[1].as_py() != key[2].as_py():
                close &= tile[rows, None] != tile[None, :]
            i, j = np.nonzero(close)
            i = rows[i]
            yield pa.RecordBatch.from_arrays([pa.array(component[i]), pa.array(own[i]), pa.array(component[j]), pa.array(own[j])], names=["a", "own_a", "b", "own_b"])

    pair = ["a", "own_a", "b", "own_b"]
    pairs = written(spread.groupBy("space", "low", "high").applyInArrow(near, "a long, own_a int, b long, own_b int"))
    sides = [pairs.join(members.select(F.col("component").alias(c), F.col("own").alias(f"own_{c}"), "raw"), [c, f"own_{c}"]).select(*pair, F.lit(c == "a").alias("first"), "raw") for c in ("a", "b")]

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()  # two blocks
        first, points = table.column("first").to_numpy(), matrix(_column(table, "raw"), how.kind)
        if (points[first] @ points[~first].T >= how.threshold).any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[2].as_py()], pa.int64())], names=["a", "b"])

    return written(sides[0].unionByName(sides[1]).groupBy(*pair).applyInArrow(meet, "a long, b long").distinct())


def bridged(groups: DataFrame, held: DataFrame, classes: DataFrame, how: Descent) -> DataFrame:
    """groups, with those of the held components as one between which there is a link."""
    members = groups.join(held, "component").join(classes.select(F.col("id").alias("node"), "space", "raw"), "node")
    found = bridges(members, how)
    if found.isEmpty():
        return groups
    merged = components(found).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return written(groups.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def enlarged(held: DataFrame, groups: DataFrame, classes: DataFrame, how: Descent) -> DataFrame:
    """id, links: for classes in the held components, their links to all of the component, in vectors."""
    members = groups.join(held, "component")
    dealt = in_blocks(members, how).join(classes.select(F.col("id").alias("node"), "raw", "copies"), "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "raw", "copies")

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()  # two blocks at most
        ids, own, copies = (table.column(c).to_numpy() for c in ("node", "own", "copies"))
        points = matrix(_column(table, "raw"), how.kind)
        linked = points @ points.T >= how.threshold
        np.fill_diagonal(linked, False)
        if key[1].as_py() != key[2].as_py():
            linked &= own[:, None] != own[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ copies)], names=["id", "links"])

    counted = dealt.groupBy("component", "low", "high").applyInArrow(count, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def audit(graph: DataFrame, held: DataFrame, groups: DataFrame, classes: DataFrame, how: Descent) -> float:
    """The share of links found, of a sample of classes compared with every vector."""
    n = classes.count()
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    sample = [(r["id"], r["space"], bytes(r["raw"])) for r in classes.where(draw < int((1 << 30) * min(1.0, how.audited / max(1, n)))).select("id", "space", "raw").limit(4 * how.audited).collect()]
    if not sample:
        return 1.0
    shared = classes.sparkSession.sparkContext.broadcast(sample)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for space in {s for _, s, _ in shared.value}:
            of = [(i, u) for i, s, u in shared.value if s == space]
            spaces[space] = np.array([i for i, _ in of]), matrix(pa.array([u for _, u in of], pa.binary()), how.kind)
        for batch in batches:
            of = np.array(batch.column(1).to_pylist(), object)
            for space, (ids, points) in spaces.items():
                part = batch.take(pa.array(np.flatnonzero(of == space)))
                if part.num_rows:
                    mine = part.column(0).to_numpy()
                    i, j = np.nonzero((matrix(part.column(2), how.kind) @ points.T >= how.threshold) & (mine[:, None] != ids[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(mine[i])], names=["a", "b"])

    true = written(classes.select("id", "space", "raw").mapInArrow(compare, "a long, b long"))
    links = graph.where(F.col("cosine") >= how.threshold).select("a", "b")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    one = groups.select(F.col("node").alias("a"), F.col("component").alias("x"))
    two = groups.select(F.col("node").alias("b"), F.col("component").alias("y"))
    saturated = held.select(F.col("component").alias("x"), F.lit(True).alias("all"))
    seen = true.join(links.withColumn("listed", F.lit(True)), ["a", "b"], "left").join(one, "a", "left").join(two, "b", "left").join(saturated, "x", "left")
    hit = F.coalesce("listed", F.lit(False)) | F.coalesce(F.col("all") & (F.col("x") == F.col("y")), F.lit(False))
    total, found = seen.agg(F.count("*"), F.sum(hit.cast("long"))).first()
    return found / total if total else 1.0


def linked(vectors: DataFrame, how: Descent = Descent()) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for each row of vectors; recall is the audit's share of links found."""
    how = replace(how, kind=_kind(vectors))
    rows = written(prepared(vectors))
    members = rows.where("space is not null").select("vec_id", "same", "space", "raw").dropDuplicates(["vec_id", "same"])
    classes = written(members.groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("raw").alias("raw")))
    nodes = placed(classes, how)
    graph = None
    for attempt in range(ATTEMPTS):
        edges = sorted_lists(classes, how, attempt)
        edges = edges if graph is None else edges.unionByName(graph.withColumn("fresh", F.lit(False)))
        graph, widths = neighbour_graph(edges, nodes, how)
        links = graph.where(F.col("cosine") >= how.threshold).select("a", "b")
        groups = written(components(links))
        groups = bridged(groups, saturated(graph, widths, groups, how), classes, how)
        held = written(saturated(graph, widths, groups, how))
        recall = audit(graph, held, groups, classes, how)
        if recall >= how.recall:
            break
    else:
        alone = classes.select(F.col("id").alias("node"), F.col("id").alias("component")).join(groups, "node", "left_anti")
        groups = written(groups.unionByName(alone))
        groups = bridged(groups, groups.select("component").distinct(), classes, how)
        held, recall = groups.select("component").distinct(), 1.0
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    listed = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("listed")).withColumnRenamed("a", "id")
    counted = written(enlarged(held, groups, classes, how))
    known = classes.select("same", "id", "copies").join(listed, "id", "left").join(counted, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("same", (F.coalesce("links", "listed", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("least"))
    out = rows.select("vec_id", F.when(F.col("space").isNotNull(), F.col("same")).alias("same")).join(known, "same", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    ).withColumn("recall", F.lit(float(recall)))
