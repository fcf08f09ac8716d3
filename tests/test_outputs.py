"""Files of many splits, ordered outputs, family folders and reports."""

import random

import pytest
from pyspark.sql import functions as F

from tandemlake.operators import alignment, families, graph, kmers, motifs, reports
from tandemlake.sources import readers, writers


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64"), spark.conf.set(names[1], "8")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    lines = {f"f{k}.txt": ["" if rng.random() < 0.2 else f"g{i} g{i + 1} x {k}" + " y" * rng.randrange(9) for i in range(n)] for k, n in enumerate((37, 1, 80))}
    for name, held in lines.items():
        (tmp_path / name).write_text("\n".join(held) + "\n")
    found = readers.numbered(readers.lines(spark, str(tmp_path)))
    assert found.select("file", "at").distinct().count() > 10
    assert sorted((r.file.split("/")[-1], r.number, r.value) for r in found.collect()) == sorted((n, i, v) for n, held in lines.items() for i, v in enumerate(held))
    across = readers.numbered(readers.lines(spark, str(tmp_path)), across=True)
    assert [r.value for r in across.orderBy("number").collect()] == [v for n in sorted(lines) for v in lines[n]]
    kept = readers.numbered(readers.lines(spark, str(tmp_path)).where("value <> ''")).where("value like '%y'")
    want = [(n, i) for n, held in lines.items() for i, v in enumerate([v for v in held if v]) if v.endswith("y")]
    assert sorted((r.file.split("/")[-1], r.number) for r in kept.collect()) == sorted(want)
    anchors = readers.anchors(spark, str(tmp_path / "f2.txt"))
    assert sorted((r.line_no, r.g_start) for r in anchors.collect()) == sorted((i, v.split()[0]) for i, v in enumerate(lines["f2.txt"]) if v)


def test_records_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGTUNacgtu-x\n") for _ in range(rng.randrange(1, 150))) for _ in range(30)] + ["--", "u\nU", ""]
    (tmp_path / "a.fa").write_text("".join(f">s{i} of {len(s)}\n{s}\n" for i, s in enumerate(seqs)))
    upper = [s.upper().replace("\n", "") for s in seqs]
    clean = ["".join(c for c in s.replace("U", "T") if c in "ACGTN") for s in upper]
    strict = ["".join(c for c in s if c in "ACGTN") for s in upper]
    for mode, want in (("clean", clean), ("strict", strict)):
        found = sorted(tuple(r) for r in readers.fasta(spark, str(tmp_path / "a.fa"), mode=mode).select("record", "id", "seq").collect())
        assert found == [(k, *x) for k, x in enumerate((f"s{i}", s) for i, s in enumerate(want) if s)]
    some = readers.fasta(spark, str(tmp_path / "a.fa"), wanted=["s3", "s9", "s31"])
    assert sorted((r.record, r.id) for r in some.collect()) == [(3, "s3"), (9, "s9"), (sum(bool(s) for s in clean[:31]), "s31")]
    table = spark.createDataFrame([("s3",), ("none",), ("s3",)], "id string")
    assert [r.seq for r in readers.fasta(spark, str(tmp_path / "a.fa"), mode="strict", wanted=table).collect()] == [strict[3]]
    assert readers.single_record(spark, str(tmp_path / "a.fa")) == seqs[0].replace("\n", "")
    (tmp_path / "none.fa").write_text("")
    with pytest.raises(ValueError, match="no sequence"):
        readers.single_record(spark, str(tmp_path / "none.fa"))
    (tmp_path / "q.fastq").write_text("".join(f"@r{i}\n{'ACGT' * (i % 9)}\n+\n{'>' * 4 * (i % 9)}\n" for i in range(40)))
    assert sorted((r.read_idx, r.seq) for r in readers.fastq(spark, str(tmp_path / "q.fastq")).collect()) == [(i, "ACGT" * (i % 9)) for i in range(40)]


def test_four_fields(spark, tmp_path):
    (tmp_path / "b.bed").write_text("c\t1\t5\tr\nc\t1\t5\nc\t1\t5\tr\textra\nd\t2\tx\tr\n")
    assert sorted(tuple(r) for r in readers.bed4(spark, str(tmp_path / "b.bed"), strict=True).collect()) == [("c", 1, 5, "r"), ("d", 2, None, "r")]


def read(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_ordered_files(spark, tmp_path):
    rows = [(k * 7 % 50, f"v{k}") for k in range(50)]
    frame = spark.createDataFrame(rows, "n long, v string").repartition(5)
    writers.ordered_tsv(frame, str(tmp_path / "o"), F.desc("n"))
    lines = [x for x in read(tmp_path / "o").splitlines() if x != "n\tv"]
    assert lines == [f"{n}\t{v}" for n, v in sorted(rows, reverse=True)]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    change = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.08 else c for c in s)
    a, b = word(140), word(70)
    rows = [(0, "z/0", a), (1, "m1", b), (2, "m2", change(a[50:] + a[:50])), (3, "m3", alignment.revcomp(change(b))), (4, "m4", word(90)), (5, "m5", change(a))]
    frame = spark.createDataFrame(rows, "seq_idx long, id string, seq string")
    scores = graph.written(families.pair_scores(kmers.similar_lengths(frame, 0.8), frame, 0.8))
    held = graph.written(families.families(frame, scores=scores))
    return {i: (n, s) for i, n, s in rows}, frame, scores, held, graph.written(families.ranked(held))


def records(text):
    parts = [p.split("\n", 1) for p in text.split(">")[1:]]
    return [(h, body.replace("\n", "")) for h, body in parts]


def test_family_folders(spark, clustered, tmp_path):
    rows, frame, scores, held, ranks = clustered
    frames = graph.written(families.frames(frame, held))
    anchored = graph.written(families.anchored(frames, frame))
    texts = graph.written(writers.family_texts(frame, held, ranks, frames, anchored))
    writers.family_folders(texts, ranks, str(tmp_path / "out"))
    group = {}
    for r in held.collect():
        group.setdefault(r.family, []).append(r.seq_idx)
    many = sorted((sorted(g) for g in group.values() if len(g) > 1), key=lambda g: (-len(g), g[0]))
    assert many == [[0, 2, 5], [1, 3]]
    manifest = [x.split("\t") for x in read(tmp_path / "out" / "MANIFEST.tsv").splitlines()]
    assert [r[:4] for r in manifest if r[0] != "family_rank"] == [["1", "z/0", "3", "z/0"], ["2", "m1", "2", "m1"]]
    assert {p.name for p in (tmp_path / "out").glob("family_dir=*")} == {"family_dir=Family_000001_z_0", "family_dir=Family_000002_m1"}
    framed = {r.seq_idx: r for r in frames.collect()}
    for rank, members in enumerate(many, 1):
        first = members[0]
        name, seq = rows[first]
        where = tmp_path / "out" / f"family_dir=Family_{rank:06d}_{name.replace('/', '_')}"
        kind = lambda k: read(where / f"kind={writers.KINDS[k]}")  # noqa: B023, E731
        assert records(kind(0)) == [rows[m] for m in members]
        turned = records(kind(1))
        assert turned[0] == (f"{name}|family_rank={rank}|role=representative_first_sequence|orientation=forward|rotation_start=0|original_len={len(seq)}", seq)
        assert [s for _, s in turned[1:]] == [framed[m].rotated for m in members[1:]]
        m = members[1]
        r = framed[m]
        assert turned[1][0] == f"{rows[m][0]}|family_rank={rank}|family={name}|representative={name}|role=frame_corrected_monomer|orientation={r.orientation}|rotation_start={r.rotation_start}|frame_identity={r.frame_identity:.6f}|global_identity_to_rep={r.global_identity:.6f}|original_len={len(rows[m][1])}"
        assert [s for _, s in records(kind(2))] == [s for m in members[1:] for s in (framed[m].aligned_reference, framed[m].aligned_member)]
        assert records(kind(2))[0][0].startswith(f"{name.replace('/', '_')}__VS__{rows[m][0]}|role=representative_first_sequence|member={rows[m][0]}|orientation=")
        aligned = records(kind(3))
        assert [s.replace("-", "") for _, s in aligned] == [seq, *[framed[m].rotated for m in members[1:]]] and len({len(s) for _, s in aligned}) == 1
        summary = [x.split("\t") for x in kind(4).splitlines()]
        assert tuple(summary[0]) == writers.SUMMARY and [x[3] for x in summary[1:]] == [rows[m][0] for m in members]
        assert summary[1][4:] == ["forward", "0", "1.000000", "1.000000", str(len(seq)), str(len(seq)), "representative_first_sequence"]


def test_alignment_summary(spark, clustered):
    rows, frame, _, held, _ = clustered
    frames = {r.seq_idx: r for r in families.frames(frame, held).collect()}
    got = {(r.family_rank, r.family_id, r.representative, r.member): r for r in families.alignment_summary(spark.createDataFrame(list(frames.values()), families.FRAMES), held, frame).collect()}
    assert got.keys() == {(1, "z/0", "z/0", n) for n in ("z/0", "m2", "m5")} | {(2, "m1", "m1", n) for n in ("m1", "m3")}
    own, other = got[1, "z/0", "z/0", "z/0"], got[2, "m1", "m1", "m3"]
    assert tuple(own)[4:] == ("forward", 0, 1.0, 1.0, 140, 140, "representative_first_sequence")
    assert (other.orientation, other.frame_identity, other.note[:6]) == ("reverse-complement", frames[3].frame_identity, "member")


def test_reports_and_counters(spark, clustered, tmp_path):
    rows, frame, scores, held, ranks = clustered
    counters = reports.Counters()
    proofs = graph.written(counters.count(families.proofs(scores, frame), "proofs"))
    assert counters.values() == {"proofs": scores.count()} == {"proofs": proofs.count()}
    writers.ordered_text(reports.proof_report(frame, held, ranks, scores, proofs, most=2), str(tmp_path / "proof"), "family_rank", "part", "place")
    lines = read(tmp_path / "proof").splitlines()
    assert lines[:3] == ["=" * 100, "FAMILY: m2", "Family size: 3"]
    assert lines[4:7] == [f"  {n}\t{len(s)}" for n, s in sorted(rows[i] for i in (0, 2, 5))]
    assert sum(x.startswith("[EDGE]") for x in lines) == 3 and sum(x.startswith("FAMILY:") for x in lines) == 3
    assert lines.count("Singleton or family without stored proof edges.") == 1
    at = lines.index("  Alignment A→B:")
    proof = min(proofs.collect(), key=lambda r: (r.i, r.j))
    assert lines[at + 1] == "A: " + proof.i_in_j[:120] and lines[at + 3] == "B: " + proof.j_aligned[:120]
    bars = "".join("|" if x == y != "-" else " " for x, y in zip(proof.i_in_j, proof.j_aligned, strict=True))
    assert lines[at + 2] == "   " + bars[:120] and lines[at + 4] == "" and lines[at + 5] == "A: " + proof.i_in_j[120:]
    links = spark.createDataFrame([("a", "b", 1, "x", "y", "A_in_B", "forward", 0.9, 5), ("b", "c", 2, "p", "q", "B_in_A", "forward", 0.95, 4), ("d", "e", 1, "r", "s", "A_in_B", "forward", 0.8, 3)], "family_a string, family_b string, links long, query_id string, target_id string, direction string, best_orientation string, identity_oneway double, shared_signals long")
    groups = spark.createDataFrame([(f, "a" if f in "abc" else "d") for f in "abcde"], "family string, superfamily string")
    sizes = spark.createDataFrame([(f, k + 1) for k, f in enumerate("abcde")], "family_id string, family_size long")
    writers.ordered_text(reports.superfamily_report(links, groups, sizes, most=1), str(tmp_path / "super"), "group", "part", "place")
    text = [x for x in read(tmp_path / "super").splitlines() if x]
    assert text[1:5] == ["SuperfamilyGroup-1 (families=3):", "  Family rep: a (size=1)", "  Family rep: b (size=2)", "  Family rep: c (size=3)"]
    assert text[6] == "  b  <->  c | best one-way=95.0% (dir=B_in_A, orient=forward) | ex: p -> q" and text[7] == "  (stopped after 1 links)"
    assert text[9] == "SuperfamilyGroup-2 (families=2):"


def test_motif_files(spark, tmp_path):
    reads = spark.createDataFrame([("lib1", k, "AAAA" * (k % 4) + "C" * k) for k in range(14)] + [("other2", 0, "AAAATAAA")], "library string, read_idx long, seq string").repartition(4)
    found = motifs.numbered(motifs.scan(reads, "AAAA"))
    species = spark.createDataFrame([("lib", "One")], "code string, species string")
    writers.motif_files(found, motifs.annotated(found, species), str(tmp_path / "m"))
    rows = sorted(tuple(r) for r in found.select("library", "motif_no", "motif_id", "motif").collect())
    assert read(tmp_path / "m" / "final.fasta") == "".join(f">{i}\n{m}\n" for _, _, i, m in rows)
    for library in ("lib1", "other2"):
        assert read(tmp_path / "m" / "libraries" / f"library={library}") == "".join(f">{i}\n{m}\n" for k, _, i, m in rows if k == library)
    table = [x.split("\t") for x in read(tmp_path / "m" / "output.tsv").splitlines() if not x.startswith("Sequence")]
    assert table == [[i, "One" if k == "lib1" else "Unknown"] for k, _, i, _ in rows]
    assert len(rows) > 15
