"""Genomic operators against small cases worked out by hand and naive versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlake.functions import names, sequences
from tandemlake.operators import alignment, arrays, composition, density, families, graph, intervals, kmers, motifs, synteny
from tandemlake.operators.running import running

HIT = "Chromosome string, Reference string, Start long, End long, Strand string, Pident double, HitLength long, Bitscore double"


def hits(spark, spans, reference="A", chromosome="c"):
    return spark.createDataFrame([(chromosome, reference, s, e, "+", 90.0, e - s + 1, 1.0) for s, e in spans], HIT)


def spans(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("tile", [1 << 20, 4])
def test_running_over_tiles(spark, tile):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(60), i, rng.randrange(100)) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, p long, i long, v long")
    out = {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))}
    got = {(r.i): (r.m, r.s) for r in running(frame, ["k"], "p", ["p", "i"], out, tile).collect()}
    behind = {(r.i): r.n for r in running(frame, ["k"], "p", ["p", "i"], {"n": ("min", F.col("v"))}, tile, behind=True).collect()}
    for k, p, i, _ in rows:
        before = [w for kk, q, j, w in rows if kk == k and (q, j) < (p, i)]
        after = [w for kk, q, j, w in rows if kk == k and (q, j) > (p, i)]
        assert got[i] == (max(before, default=None), sum(before))
        assert behind[i] == min(after, default=None)


def test_gaps_use_the_farthest_end(spark):
    found = arrays.gaps(hits(spark, [(1, 100), (10, 20), (105, 110)]))
    assert spans(found, "Start", "gap") == [(1, None), (10, -91), (105, 4)]


def test_islands_by_distance(spark):
    flagged = arrays.islands(arrays.gaps(hits(spark, [(1, 5), (4, 6), (9, 10), (14, 15)])), F.lit(2), arrays.GROUP)
    made = flagged.groupBy("island").agg(F.min("Start").alias("s"), F.max("End").alias("e"), F.count("*").alias("n"))
    assert spans(made, "s", "e", "n") == [(1, 10, 3), (14, 15, 1)]


def chain(gaps):
    out, at = [(1, 10)], 10
    for g in gaps:
        out.append((at + g + 1, at + g + 10))
        at += g + 10
    return out


@pytest.mark.parametrize(
    ("gaps", "distance", "method", "n"),
    [([], 2000, "fallback_no_positive_gaps", 0), ([1, 2, 3, 4], 2000, "fallback_few_local_gaps", 4), ([1, 2, 3, 4, 5], 5, "p95_local_gaps_capped", 5), ([1, 2, 3, 4, 5, 20000], 5, "p95_local_gaps_capped", 6)],
)
def test_merge_distance(spark, gaps, distance, method, n):
    (r,) = arrays.merge_distances(arrays.gaps(hits(spark, chain(gaps)))).collect()
    assert (r.AdaptiveMergeGap_bp, r.Method, r.NumPositiveGaps) == (distance, method, n)
    if gaps:
        local = gaps if method.startswith("fallback") else [g for g in gaps if g <= 10000]
        assert r.GapP95_local_bp == pytest.approx(np.percentile(local, 95))


def test_arrays_of_nothing(spark):
    assert arrays.arrays(hits(spark, [])).collect() == []


def test_regions_touch_without_merging(spark):
    two = lambda b: hits(spark, [(1, 10)], "A").union(hits(spark, b, "B"))
    assert spans(arrays.regions(two([(10, 20)])), "Start", "End", "References") == [(1, 20, "A,B")]
    assert spans(arrays.regions(two([(11, 20)])), "Start", "End", "References") == [(1, 10, "A"), (11, 20, "B")]


def test_sweep_and_composition(spark):
    chromosomes = spark.createDataFrame([("c", 20), ("d", 5)], "Chromosome string, ChromosomeLengthBp long")
    found = hits(spark, [(3, 10)], "A").union(hits(spark, [(8, 25)], "B"))
    segments = composition.segments(found, chromosomes)
    assert spans(segments, "Start", "End", "Category", "ActiveReferences") == [(3, 7, "A", "A"), (8, 10, "Multi_satDNA_overlap", "A,B"), (11, 20, "B", "B")]
    made = composition.composition(segments, chromosomes)
    assert spans(made, "Chromosome", "Category", "CoveredBp") == [("c", "A", 5), ("c", "B", 10), ("c", "Multi_satDNA_overlap", 3), ("c", "Non_satDNA", 2), ("d", "Non_satDNA", 5)]
    genome = composition.with_genome(made, chromosomes).where("Chromosome = 'Complete_genome'")
    assert spans(genome, "Category", "CoveredBp")[-1] == ("Non_satDNA", 7)


@pytest.mark.parametrize(("sizes", "want"), [([10, 6, 4], (10, 1)), ([6, 6, 4, 4], (6, 2)), ([5], (5, 1)), ([], None)])
def test_n50(spark, sizes, want):
    frame = spark.createDataFrame([("r", s) for s in sizes], "Reference string, ArraySize long")
    assert [tuple(r)[1:] for r in arrays.n50(frame, ["Reference"]).collect()] == ([want] if want else [])


def test_satellitome_fills_zeros(spark):
    chromosomes = spark.createDataFrame([("c", 20), ("d", 20)], "Chromosome string, ChromosomeLengthBp long")
    held = spark.createDataFrame([("c", "A", 6), ("c", "B", 2), ("d", "A", 4)], "Chromosome string, Reference string, ArraySize long")
    found = composition.satellitome(held, chromosomes)
    assert spans(found, "Chromosome", "Reference", "TotalArrayBp", "RankWithinChromosome") == [("Complete_genome", "A", 10, 1), ("Complete_genome", "B", 2, 2), ("c", "A", 6, 1), ("c", "B", 2, 2), ("d", "A", 4, 1), ("d", "B", 0, 2)]


def test_interleaved_hits_break_runs(spark):
    rows = hits(spark, [(100, 200), (300, 400)], "A").union(hits(spark, [(150, 160)], "B"))
    assert spans(density.merged_runs(rows), "Reference", "Start", "End") == [("A", 100, 200), ("A", 300, 400), ("B", 150, 160)]
    assert spans(density.merged_by_reference(rows), "Reference", "Start", "End") == [("A", 100, 400), ("B", 150, 160)]


def test_coverage_is_capped_by_group(spark):
    chromosomes = spark.createDataFrame([("c", 15)], "Chromosome string, ChromosomeLengthBp long")
    rows = [("c", r, s, e) for r in "AB" for s, e in ((0, 8), (2, 10))]
    frame = spark.createDataFrame(rows, "Chromosome string, Reference string, Start long, End long")
    groups = spark.createDataFrame([("A",), ("B",)], "Reference string")
    found = density.coverage(frame, chromosomes, groups, F.col("Reference"), 10)
    assert spans(found, "Start", "End", "Reference", "Coverage_bp") == [(0, 10, "A", 10), (0, 10, "B", 10), (10, 15, "A", 0), (10, 15, "B", 0)]
    assert spans(density.total(found), "Start", "Coverage_bp") == [(0, 20), (10, 0)]
    none = density.coverage(frame.limit(0), chromosomes, groups, F.col("Reference"), 10)
    assert {r.Coverage_bp for r in none.collect()} == {0}


def test_gc_track(spark):
    frame = spark.createDataFrame([("x", "GGCCAATTNNN"), ("y", "")], "Chromosome string, seq string")
    track = density.gc_track(frame, 4)
    assert spans(track, "Start", "End", "GC_fraction") == [(0, 4, 1.0), (4, 8, 0.0), (8, 11, None)]
    assert {r.GC_plot for r in density.plot_track(track).collect()} == {0.0, 0.5, 1.0}


def brute_nearest(a, blocks):
    away = [(0 if s < a[1] and a[0] < e else a[0] - e + 1 if e <= a[0] else s - a[1] + 1, n) for s, e, n in blocks]
    least = min((d for d, _ in away), default=-1)
    return sorted((least, n) for d, n in away if d == least) or [(-1, None)]


@pytest.mark.parametrize("tile", [1 << 20, 8])
def test_nearest_blocks(spark, tile):
    rng = random.Random(tile)
    ask = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(90) for _ in range(60))] + [(10, 20), (10, 20)]
    blocks = [(s, s + rng.randrange(1, 12), f"b{i}") for i, s in enumerate(rng.randrange(90) for _ in range(9))]
    a = spark.createDataFrame([("c", s, e, i) for i, (s, e) in enumerate(ask)] + [("z", 1, 2, 999)], "Chromosome string, Start long, End long, i long")
    b = spark.createDataFrame([("c", *x) for x in blocks], "Chromosome string, Start long, End long, block string")
    got = {}
    for r in intervals.nearest(a, b, tile=tile, bin=7).collect():
        got.setdefault(r.i, []).append((r.dist, r.block))
    assert got.pop(999) == [(-1, None)]
    assert {i: sorted(v) for i, v in got.items()} == {i: brute_nearest(x, blocks) for i, x in enumerate(ask)}
    inside = {r.i for r in synteny.inside(a, b).collect()}
    outside = [r.i for r in synteny.outside(a, b).collect()]
    assert inside == {i for i, x in enumerate(ask) if brute_nearest(x, blocks)[0][0] == 0}
    assert sorted([*inside, *outside]) == sorted([*range(len(ask)), 999])
    pairs = {(r.a.i, r.b.block) for r in intervals.overlapping(a, b, ["Chromosome"], bin=5).collect()}
    assert pairs == {(i, n) for i, (s, e) in enumerate(ask) for x, y, n in blocks if s < y and x < e}


@pytest.mark.parametrize(("block", "want"), [((25, 30), 6), ((20, 25), 1), ((15, 17), 0)])
def test_distances_of_neighbours(spark, block, want):
    a = spark.createDataFrame([("c", 10, 20)], "Chromosome string, Start long, End long")
    b = spark.createDataFrame([("c", *block, "b")], "Chromosome string, Start long, End long, block string")
    assert [r.dist for r in intervals.nearest(a, b).collect()] == [want]


def test_blocks_take_the_last_position_of_a_gene(spark):
    genes = spark.createDataFrame([("c", 1, 5, "g", 0), ("c", 50, 60, "g", 1), ("d", 7, 9, "h", 2)], "Chromosome string, Start long, End long, gene string, order long")
    anchors = spark.createDataFrame([(4, "g", "h"), (5, "g", "missing")], "line_no long, g_start string, g_end string")
    (r,) = synteny.blocks(anchors, synteny.gene_positions(genes, "order")).collect()
    assert (r.Chromosome, r.Start, r.End, r.block, r.same_chromosome) == ("c", 7, 60, "block_4", False)


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, sequences.revcomp(lit("ACGTN"))) == "NACGT"
    assert one(spark, sequences.clean(lit(" acg-uX n"))) == "ACGTN"
    assert one(spark, sequences.strict_clean(lit("acu-g"))) == "ACG"
    assert one(spark, sequences.rotated(lit("ACGT"), lit(5))) == "CGTA"
    assert one(spark, sequences.tandem(lit("AC"), 3)) == "ACACAC"
    assert sorted(one(spark, sequences.circular_kmers(lit("ACG"), 2))) == ["AC", "CG", "GA"]
    assert one(spark, sequences.circular_kmers(lit("ACG"), 4)) == []
    assert one(spark, sequences.gc_fraction(lit("GCAN"))) == pytest.approx(2 / 3)
    assert one(spark, sequences.hamming(lit("ACGT"), lit("ACCA"))) == 2
    assert one(spark, sequences.subsequence(lit("AACCGG"), lit(4), lit(2))) == "GGT"
    assert one(spark, sequences.alignment_identity(lit("A-CG"), lit("AACT"), lit(4))) == 0.5
    assert one(spark, names.file_safe(lit("._a b/c.."))) == "a_b_c"
    assert one(spark, names.file_safe(lit("..."))) == "unnamed"
    assert one(spark, names.base_name(lit("/x/y.fna.fa"))) == "y"
    assert one(spark, names.sample_id(lit("/x/a-b.fasta"))) == "a_b"
    assert one(spark, names.accession(lit("ref|NC_1.2| rest"))) == "NC_1.2"
    for header, index, want in (("NC_1 Danio chromosome 7", 1, "Chromosome7"), ("ChrB", 2, "Chromosomeb"), ("scaffold_12", 3, "scaffold12"), ("microB", 4, "microB"), ("foo bar", 3, "Chromosome3")):
        assert one(spark, names.chromosome_label(lit(header), lit(index))) == want
    assert one(spark, names.plot_label(lit("Chromosome007"))) == "Chr 7"
    assert [one(spark, names.base_pairs(lit(float(x)))) for x in (12, 1500, 2_500_000, 3_200_000_000)] == ["12 bp", "1.5 kb", "2.50 Mb", "3.20 Gb"]
    assert one(spark, names.highlighted(lit("Chr12"), ["x", " chr1 "])) is True
    assert one(spark, names.highlighted(lit("Chr12"), [""])) is False
    assert [one(spark, names.is_whole_number(lit(x))) for x in ("12", "1.2", "", None)] == [True, False, False, False]
    assert one(spark, names.species_query(lit("Danio rerio"))) == "Danio+rerio"
    assert one(spark, names.species_file(lit("hbb"), lit("Danio rerio"))) == "HBB_Danio_rerio.fasta"


def test_natural_order(spark):
    order = ["2", "10", "B1", "chr2", "Chr10", "chr-1", "chra", "microB", "scaffold_2", "x2"]
    frame = spark.createDataFrame([(n,) for n in order[::-1]], "n string")
    got = [r.n for r in frame.orderBy(names.natural_key(F.col("n"))).collect()]
    assert got.index("2") < got.index("10") < got.index("B1") < got.index("chr2") < got.index("Chr10")
    assert got.index("chr2") < got.index("chr-1")


def test_motifs(spark):
    reads = spark.createDataFrame([("lib1", 0, "AAAATAAAAA"), ("lib1", 1, "AAA"), ("lib1", 2, None), ("lib2", 0, "NAAA")], "library string, read_idx long, seq string")
    found = motifs.scan(reads, "AAAA")
    assert spans(found, "library", "read_idx", "offset", "motif") == [("lib1", 0, 0, "AAAA"), ("lib1", 0, 4, "TAAA"), ("lib2", 0, 0, "NAAA")]
    assert spans(motifs.numbered(found), "motif_id", "motif") == [("lib11", "AAAA"), ("lib12", "TAAA")]
    species = spark.createDataFrame([("lib", "Old", 0), ("lib", "New", 1)], "code string, species string, order long")
    assert {r.Species for r in motifs.annotated(motifs.numbered(found), species).collect()} == {"New"}
    with pytest.raises(ValueError, match="empty"):
        motifs.scan(reads, "")


def test_middle_length_and_k(spark):
    frame = spark.createDataFrame([("A" * n,) for n in (3, 9, 5, 7)], "seq string")
    assert tuple(kmers.middle_length(frame).first()) == (4, 3, 9, 7)
    assert [one(spark, kmers.choice(F.lit(n))[0]) for n in (100, 800, 2000, 5000)] == [6, 9, 11, 13]


def test_pruned_alignments_lose_nothing():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a = [word(rng.randint(1, 90)) for _ in range(120)]
    b = [x if rng.random() < 0.1 else "".join(c if rng.random() < rng.choice([0.9, 0.5]) else rng.choice("ACGT") for c in x[7:] + x[:7]) or "A" for x in a]
    whole, forward = alignment.identities(a, b)
    some, turned = alignment.identities(a, b, 0.8)
    for x, f, y, g in zip(whole, forward, some, turned, strict=True):
        assert (y, g) == (x, f) if x + 1e-12 >= 0.8 else y < 0.8
    assert 10 < sum(whole >= 0.8) < 110


def test_scores_above_a_threshold(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(4)]
    rows = [(k, f"s{k}", "".join(c if rng.random() < 0.9 else rng.choice("ACGT") for c in base[k % 4])) for k in range(20)] + [(50, "twice", base[0] + base[0])]
    frame = spark.createDataFrame(rows, "seq_idx long, id string, seq string")
    pairs = frame.select(F.col("seq_idx").alias("i")).join(frame.select(F.col("seq_idx").alias("j")), F.col("j") < F.col("i"))
    every = {tuple(r) for r in families.pair_scores(pairs, frame).collect()}
    assert {tuple(r) for r in families.pair_scores(pairs, frame, 0.8).collect()} == {r for r in every if r[6] + 1e-12 >= 0.8}
    assert {tuple(r) for r in families.pair_scores(pairs, frame, 0.8, both_ways=False).collect()} == {r for r in every if max(r[2], r[4]) + 1e-12 >= 0.8}


def test_display_and_labels(spark):
    rows = spark.createDataFrame([("c", 10, 20), ("c", 100, 2000), ("c", 4990, 5000)], "Chromosome string, Start long, End long")
    found = arrays.displayed(rows, spark.createDataFrame([("c", 5000)], "Chromosome string, ChromosomeLengthBp long"), 1000)
    assert spans(found, "Start", "display_start", "display_end") == [(10, 0.0, 515.0), (100, 100.0, 2000.0), (4990, 4495.0, 5000.0)]
    assert [one(spark, names.chromosome_label(F.lit(h), F.lit(1))) for h in ("scaffold_12.1", "scaffold_12.2", "NC chromosome 2L-a")] == ["scaffold12.1", "scaffold12.2", "Chromosome2l-a"]
    labels = spark.createDataFrame([("acc1", "Chromosome1")], "accession string, pretty_name string")
    assert spans(names.renamed(spark.createDataFrame([("acc1", 1), ("acc2", 2)], "Chromosome string, Start long"), labels), "Chromosome", "Start") == [("Chromosome1", 1), ("acc2", 2)]
    assert alignment.blocks("AC-GT", "ACTG-", 3) == "AC-\n|| \nACT\n\nGT\n| \nG-" and names.percent_tag(0.57) == "56"


def test_rescue_and_medoids(spark):
    """A chain of three: two strict groups, one family, one rescue pair and group."""
    rng = random.Random(2)
    a = "".join(rng.choice("ACGT") for _ in range(60))
    swap = lambda s, at: s[:at] + {"A": "C", "C": "A", "G": "T", "T": "G"}[s[at]] + s[at + 1 :]
    b, c = a, a
    for k in range(0, 20, 2):
        b = swap(b, k)
        c = swap(swap(c, k), 58 - k)
    rows = [(0, "m0", a), (1, "m1", b), (2, "m2", c), (3, "m3", a)]
    frame = spark.createDataFrame(rows, "seq_idx long, id string, seq string")
    once = graph.checkpointed(families.classes(frame))
    scores = graph.checkpointed(families.pair_scores(kmers.similar_lengths(once, 0.8), once))
    held = graph.checkpointed(families.families(frame, scores=scores))
    named = families.families(once.withColumn("id", F.col("seq_idx").cast("string")), scores=scores)
    strict = families.strict_members(frame, once, families.strict_families(scores, kmers.shared(once, 6, 3), named))
    groups = {r.seq_idx: r.strict for r in strict.collect()}
    assert groups[0] == groups[3] and len(groups) == 4
    identity = {(r.i, r.j): r.identity_min for r in scores.collect()}
    linked = {p for p, x in identity.items() if x + 1e-12 >= 0.8}
    assert {r.family for r in held.collect()} == {0} and len(set(groups.values())) == 2
    (r,) = families.rescue_pairs(scores, frame, strict).collect()
    pair = tuple(sorted((int(r.member_A[1:]), int(r.member_B[1:])), reverse=True))
    assert pair in linked and r.reciprocal_identity_min == max(identity[p] for p in linked if groups[p[0]] != groups[p[1]])
    assert sorted((r.old_family_size, r.new_family_size, r.exhaustive_rescue_group) for r in families.rescue_groups(frame, strict, held).collect()) == [(s, 4, "ExhaustiveRescueGroup_000001") for s in sorted((list(groups.values()).count(g) for g in set(groups.values())))]
    sums = {k: sum(x for p, x in identity.items() if k in p) for k in range(3)}
    assert [r.medoid for r in families.medoids(scores, held).collect()] == [f"m{max(sums, key=lambda k: (sums[k], -k))}"]
    assert families.proofs(scores, once, most=1, families=named).count() == 1


def test_alignment_kernels():
    rng = random.Random(4)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    pairs = [(word(rng.randint(1, 20), "ACGT"[: rng.choice([2, 4])]), word(rng.randint(1, 25))) for _ in range(200)]
    scores, matches = alignment.semiglobal_matches([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), score, same in zip(pairs, scores, matches, strict=True):
        total, x, y, start, end = alignment.traced(a, b, free=True)
        assert (total, sum(p == q != "-" for p, q in zip(x, y, strict=True))) == (score, same)
        assert x.replace("-", "") == a and y.replace("-", "") == b[start:end]
    unit = word(60)
    assert alignment.identities([unit], [unit[30:] + unit[:30]])[0][0] == 1.0
    assert alignment.identities([unit + unit], [unit])[0][0] == 1.0 and alignment.identities([unit], [unit + unit])[0][0] == 0.5
    found = alignment.framed(unit, alignment.revcomp(unit[7:] + unit[:7]))
    assert (found["orientation"], found["global_identity"], found["aligned_member"]) == ("reverse-complement", 1.0, unit)
    assert alignment.framed(unit, "")["aligned_member"] == "-" * 60


def test_families_are_components(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    change = lambda s, at: "".join(swap[c] if i in at else c for i, c in enumerate(s))
    near, far = change(base, range(0, 9)), change(base, range(0, 18))
    seqs = [("a", base), ("b", near), ("c", far), ("d", base), ("e", "".join(rng.choice("ACGT") for _ in range(58)))]
    frame = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_idx long, id string, seq string")
    found = families.families(frame)
    assert {r.id: (r.family, r.family_id, r.family_size) for r in found.collect()} == {"a": (0, "a", 4), "b": (0, "a", 4), "c": (0, "a", 4), "d": (0, "a", 4), "e": (4, "e", 1)}
    aligned = {r.seq_idx: r.aligned for r in families.anchored(families.frames(frame, found), frame).collect()}
    assert aligned.keys() == {0, 1, 2, 3} and len({len(x) for x in aligned.values()}) == 1
    assert aligned[0].replace("-", "") == base
    once = families.classes(frame)
    scores = families.pair_scores(kmers.similar_lengths(once, 0.8), once)
    strict = {r.seq_idx: r.strict for r in families.strict_families(scores, kmers.shared(once, 6, 3), families.families(once.withColumn("id", F.col("seq_idx").cast("string")), scores=scores)).collect()}
    assert strict[0] == strict[1] != strict[2]


def test_length_classes_lose_no_pair(spark):
    rng = random.Random(3)
    lengths = [rng.randrange(1, 200) for _ in range(120)] + [80, 100, 8, 10]
    frame = spark.createDataFrame([(i, "A" * n) for i, n in enumerate(lengths)], "seq_idx long, seq string")
    got = {(r.i, r.j) for r in kmers.similar_lengths(frame, 0.8).collect()}
    assert got == {(i, j) for i, x in enumerate(lengths) for j, y in enumerate(lengths[:i]) if min(x, y) >= 0.8 * max(x, y)}


def test_components_ignore_loops_and_repeats(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (9, 9), (5, 4)], "a long, b long")
    assert spans(graph.components(edges), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
