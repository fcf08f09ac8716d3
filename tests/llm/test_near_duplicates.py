"""Jaccard join, NN-descent and graph components against brute force, and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tandemlake.llm import common, jaccard_join, nn_descent

from .helpers import DOCS, LONG, ODD, clashing, docs


def union(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1000 + i + 1) for i in range(60)] + [(7, 7)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(edges, {n for e in edges for n in e})
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: want[n] for n in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=25))
    texts = []
    for size in (60, 60, 150, 15):
        base = rng.choices(words, k=size)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 3)] = [f"new{rng.randrange(10**6)}"]
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                texts.append(texts[-1].upper())
    texts += [passage + " " + " ".join(rng.choices(words, k=20)) for _ in range(30)]
    texts += [base_cut for base_cut in (" ".join(texts[0].split()[: 60 - k]) for k in range(0, 20, 3))]
    return texts


def test_jaccard_join_is_exact(spark):
    for width, percent, hot in ((4, 85, 14), (5, 80, 1)):
        data = [(10 + i, t) for i, t in enumerate(corpus(width))] + [r for r in ODD if r[0] is None or r[0] < 10] + [(1, "other text under the id of another row")]
        frame = clashing(docs(spark, data)).repartition(4)
        how = jaccard_join.Join(width, percent, bins=1 << 16, hot=hot, apart=0)
        found = jaccard_join.joined(frame, how).collect()
        assert len(found) == len(data)
        sets = [(i, shingles(t, width)) for i, t in data]
        links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
        want = union(links, {i for i, _ in sets if i is not None})
        sizes = defaultdict(list)
        for i, s in sets:
            sizes[i].append(len(s))
        got = defaultdict(list)
        for r in found:
            got[r.doc_id].append(r.n_shingles)
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in sizes.items()}
        kept = jaccard_join.deduplicated(frame, how)
        assert kept.columns == frame.columns
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c}) and ids.count(None) == 1


def test_skipping_loses_no_pair(spark):
    rng = random.Random(9)
    for percent in (80, 85, 50):
        rows = [(rng.randrange(3), i, n, rng.randrange(max(1, n - -(-percent * n // 100) + 1)), i % 40) for i in range(150) for n in [rng.choice([1, 2, 5, 7, 8, 9, 10, 20, 40, 80, 100, 125])]]
        want = {
            (min(x[1], y[1]), max(x[1], y[1])) for k, x in enumerate(rows) for y in rows[:k]
            if x[0] == y[0] and x[4] != y[4] and min(x[2] - x[3], y[2] - y[3]) * (100 + percent) >= percent * (x[2] + y[2])
        }
        frame = spark.createDataFrame(rows, "token long, node long, n int, place int, group long")
        assert {(r.a, r.b) for r in jaccard_join.pairs_left(frame, percent).collect()} == want and want


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.joined(spark.createDataFrame([], DOCS)).collect() == []
    (r,) = jaccard_join.joined(docs(spark, [(3, None)])).collect()
    assert (r.n_shingles, r.component_id) == (0, 3)


def test_shingles_of_long_texts():
    import pyarrow as pa

    texts = [LONG, None, "a b", LONG.upper(), "é" * 70_000 + " x y z"]
    got = {row: len(found) for row, found in common.shingle_sets(pa.array(texts), 4)}
    assert got == {i: len(shingles(t, 4)) for i, t in enumerate(texts)}


def test_nn_descent(spark):
    rng = np.random.default_rng(2)
    rows, key = [], 0
    for label in (0, 1, 2):
        for size in [1] * 120 + [2] * 20 + [5] * 5 + [60 if label == 0 else 20]:
            center = rng.standard_normal(24)
            for _ in range(size):
                rows.append((key, (center + 0.06 * rng.standard_normal(24)).tolist(), label))
                key += 1
    rows += [(key, rows[0][1], 0), (key + 1, rows[0][1], 1), (key + 2, rows[0][1], None), (key + 3, None, 0), (key + 4, [0.0] * 24, 0), (key + 5, [float("nan")] * 24, 0), (key + 6, [], 0), (key + 7, [None] * 24, 0), (key + 8, rows[0][1][:5], 0), (None, rows[0][1], 0), rows[5], rows[0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)
    found = nn_descent.linked(frame, nn_descent.Descent(neighbours=8, block=16)).collect()
    assert len(found) == len(rows)
    usable = {i: (tuple(v), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, (v, _) in usable.items()}
    links = [(a, b) for a in usable for b in usable if a < b and usable[a][1] == usable[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want, degree = union(links, {r[0] for r in rows if r[0] is not None}), defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert nn_descent.linked(frame.limit(0)).collect() == []


def test_shingles_of_few_words():
    import pyarrow as pa

    for width in (4, 5):
        for n in range(width + 2):
            ((row, found),) = common.shingle_sets(pa.array([" ".join("abcdefg"[:n])]), width)
            assert (row, len(found)) == (0, len(shingles(" ".join("abcdefg"[:n]), width)))


def test_rows_of_one_id_with_different_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    frame = docs(spark, [(3, x), (5, x), (5, y), (8, y), (6, None), (6, x), (9, z), (9, None), (10, z), (11, None)])
    found = sorted((r.doc_id, r.component_id) for r in jaccard_join.joined(frame).collect())
    assert found == [(3, 3), (5, 3), (5, 3), (6, 3), (6, 3), (8, 3), (9, 9), (9, 9), (10, 9), (11, 11)]
    assert sorted((r.doc_id, r.text) for r in jaccard_join.deduplicated(frame).collect()) == [(3, x), (9, z), (11, None)]


def near_groups(seed, sizes, dim=32):
    """Tight groups around centres whose cosines with the first are above the threshold, and as many rows far from them."""
    rng = np.random.default_rng(seed)
    first = rng.standard_normal(dim)
    first /= np.linalg.norm(first)
    rows = []
    for size in sizes:
        aside = rng.standard_normal(dim)
        aside -= aside @ first * first
        centre = first + 0.2 * aside / np.linalg.norm(aside)
        rows += [centre + 0.004 * rng.standard_normal(dim) for _ in range(size)]
    rows += list(rng.standard_normal((sum(sizes), dim)))
    return [(i, x.tolist(), 0) for i, x in enumerate(rows)]


def links_of(rows, threshold=0.93):
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    return linked.sum(axis=1).tolist(), union(np.argwhere(linked).tolist(), range(len(rows)))


def test_links_between_saturated_groups(spark):
    rows = near_groups(4, (20, 20, 40))
    degree, want = links_of(rows)
    assert min(degree[:40]) >= 39
    found = nn_descent.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), nn_descent.Descent(block=16)).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in sorted(found)] == [(i, degree[i], want[i]) for i in range(len(rows))]


def test_exact_where_recall_stays_low(spark):
    rows = near_groups(5, (3, 20, 20))
    degree, want = links_of(rows)
    how = nn_descent.Descent(tables=1, near=1, rounds=0, recall=1.1, block=16)
    found = nn_descent.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), how).collect()
    assert {r.recall for r in found} == {1.0}
    assert [(r.vec_id, r.n_links, r.component_id) for r in sorted(found)] == [(i, degree[i], want[i]) for i in range(len(rows))]


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1.0, 1.0], 0), (3, [1e-310, 1e-310], 0), (4, [1.0, -1.0], 0), (5, [3.0, 3.0], 1), (6, [float("inf"), 1.0], 0)]
    found = sorted(nn_descent.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in found] == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    single = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(([1, 2, 3], [2, 4, 6], [3, -1, 0]))], "vec_id long, embedding array<float>, label int")
    assert [r.n_links for r in sorted(nn_descent.linked(single).collect())] == [1, 1, 0]


def test_local_joins_alone_find_neighbours(spark):
    """From few and poor first edges, rounds of local joins find nearly all links."""
    rng = np.random.default_rng(8)
    rows = [(k, (centre + 0.05 * rng.standard_normal(16)).tolist(), 0) for k, centre in enumerate(np.repeat(rng.standard_normal((60, 16)), 6, axis=0))]
    degree, _ = links_of(rows)
    how = nn_descent.Descent(tables=1, near=8, rounds=6, recall=0.0, lists=50)
    found = sorted(nn_descent.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), how).collect())
    assert sum(r.n_links for r in found) >= 0.95 * sum(degree)
    assert all(r.n_links <= degree[r.vec_id] for r in found)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from tandemlake.llm import language_id, tokens

    prose = [(i, f"The {i} sentences of this document say that number {i * 7919 % 1000} is theirs alone. " * 3, "en", f"src{i % 3}") for i in range(60)]
    copies = [(100 + i, prose[i][1] + ("" if i % 2 else " And a little more."), "en", "src1") for i in range(10)]
    odd = [(200, None, "en", "src0"), (201, "12 34", "en", "src0"), (202, prose[3][1], "en", None), (3, prose[3][1], "en", "src0")]
    data = prose + copies + odd
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "source_mix", "sequence_packing"]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = language_id.learn(docs(spark, data))
    assert model
    # by brute force: who stays of each group of near-duplicates
    stay = [r for r in data if r[1] and re.search(r"[^\W\d_]", r[1])]
    sets = [(r[0], shingles(r[1], 5)) for r in stay]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if 100 * len(x & y) >= 80 * len(x | y)]
    want = union(links, {i for i, _ in sets})
    kept = {i for i, c in want.items() if i == c}
    text = {r[0]: r[1] for r in stay}
    held = defaultdict(bytes)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        held[r.doc_id] += bytes(r.ids)
    assert held.keys() <= kept and len(held) >= 0.6 * len(kept)
    for i, ids in held.items():
        once = np.append(tokens.encode(text[i]), 0).astype("<u4").tobytes()
        assert ids == once * (len(ids) // len(once)) and len(ids) // len(once) in (1, 2)


def test_the_frequency_table_stays_small(spark, monkeypatch):
    """A task counts into a byte a counter, and the driver plans from such a table: neither holds it in wider numbers."""
    import tracemalloc

    import pyarrow as pa

    from tandemlake.llm import tables

    frame = docs(spark, [(i, f"a shared line of seven plain words {'and more ' * (i % 3)}") for i in range(300)])
    batches = frame.select("text").toArrow().to_batches()
    how = jaccard_join.Join()

    class Counted:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter(batches)))

    def peak(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    monkeypatch.setattr(tables, "sent", lambda table: iter([table]))
    monkeypatch.setattr(tables, "summed", lambda parts, *_: parts)
    jaccard_join.rarity(Counted(), how)  # what is kept for later texts is made once
    (table,), most = peak(lambda: jaccard_join.rarity(Counted(), how)[:1])
    slots = defaultdict(int)
    for batch in batches:
        for _, found in common.shingle_sets(batch.column(0), how.width):
            for at in {int(x) % how.bins for x in found}:
                slots[at] += 1
    assert {int(k): int(table[k]) for k in np.flatnonzero(table)} == {k: min(n, 255) for k, n in slots.items()} and max(slots.values()) == 300
    assert most < 2 * how.bins
    _, most = peak(lambda: jaccard_join.prefixes(frame, np.zeros(how.bins, np.uint8), how))
    assert most < 5 * how.bins
