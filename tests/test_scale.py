"""What keeps large groups, long intervals and long files from being one task's work, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlake.operators import density, intervals
from tandemlake.operators.selection import percentiles


@pytest.mark.parametrize(("ranges", "few"), [(1024, 100_000), (4, 3), (2, 1)])
def test_percentiles_by_ranges(spark, ranges, few):
    rng = random.Random(ranges)
    kinds = {"even": lambda: float(rng.randrange(50)), "wide": lambda: 10.0 ** rng.randrange(-20, 20), "same": lambda: 7.0, None: lambda: rng.gauss(0, 1)}
    rows = [(k, make()) for k, make in kinds.items() for _ in range(rng.randrange(30, 60))] + [("one", -1.5), ("even", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    points = (0.0, 0.1, 0.5, 0.95, 1.0)
    got = {r.k: r.p for r in percentiles(frame, ["k"], "v", points, ranges, few).collect()}
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    assert got.keys() == held.keys()
    for k, values in held.items():
        assert got[k] == pytest.approx(np.percentile(values, [100 * q for q in points]).tolist(), rel=1e-12)
    (r,) = percentiles(frame.where("k = 'even'"), [], "v", [0.5], ranges, few).collect()
    assert r.p == [np.median(held["even"])]
    assert percentiles(frame.limit(0), ["k"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_of_intervals_of_any_length(spark, closed):
    rng = random.Random(9)
    lengths = [0, 1, 3, 15, 16, 17, 64, 65, 300, 5000, 10**6, 10**12]
    made = lambda n: [(rng.choice("cd"), s, s + rng.choice(lengths), k) for k, s in enumerate(rng.randrange(-200, 2000) for _ in range(n))]
    x, y = made(90), made(70)
    schema = "Chromosome string, Start long, End long, i long"
    found = intervals.overlapping(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), ["Chromosome"], closed, bin=16)
    want = sorted((i, j) for c, s, e, i in x for d, p, q, j in y if c == d and ((s <= e and p <= q and s <= q and p <= e) if closed else (s < e and p < q and s < q and p < e)))
    assert sorted((r.a.i, r.b.i) for r in found.collect()) == want
    assert len(want) > 200


def test_overlaps_with_nothing(spark):
    frame = spark.createDataFrame([("c", 1, 5)], "Chromosome string, Start long, End long")
    assert intervals.overlapping(frame, frame.limit(0), ["Chromosome"]).collect() == []
    assert intervals.overlapping(frame.limit(0), frame, ["Chromosome"]).collect() == []


@pytest.mark.parametrize("tile", [1 << 20, 16, 3])
def test_runs_over_tiles(spark, tile):
    rng = random.Random(tile)
    hits = sorted({(rng.choice("ab"), s, rng.choice("RS" if s % 50 < 25 else "R"), s + rng.randrange(1, 30)) for s in (rng.randrange(220) for _ in range(90))})
    want, last = [], None
    for c, s, r, e in hits:
        if last and last[0] == c and last[3] == r and s <= last[2] + 4:
            last[2] = max(last[2], e)
        else:
            last = [c, s, e, r]
            want.append(last)
    frame = spark.createDataFrame([(c, s, e, r) for c, s, r, e in hits], "Chromosome string, Start long, End long, Reference string")
    got = density.merged_runs(frame, 4, tile)
    assert sorted(map(tuple, got.select("Chromosome", "Start", "End", "Reference").collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("tile", [1 << 20, 1])
def test_angles_around_a_circle(spark, tile):
    frame = spark.createDataFrame([(0, "a", 30), (1, "b", 0), (2, "c", 10)], "index long, Chromosome string, ChromosomeLengthBp long")
    gap, free = math.radians(2), 2 * math.pi - 3 * math.radians(2)
    placed = density.offsets(frame, tile=tile)
    got = {r.Chromosome: (r.Offset, r.StartTheta, r.EndTheta) for r in placed.collect()}
    want = {"a": (0, 0.0, 0.75 * free), "b": (30, 0.75 * free + gap, 0.75 * free + gap), "c": (30, 0.75 * free + 2 * gap, free + 2 * gap)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    track = spark.createDataFrame([("c", 0, 5), ("c", 5, 10)], "Chromosome string, Start long, End long")
    assert sorted((r.Start, round(r.EndAngle - r.StartAngle, 9)) for r in density.bin_angles(track, placed).collect()) == [(0, round(0.125 * free, 9)), (5, round(0.125 * free, 9))]
