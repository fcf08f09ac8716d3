import pytest

from tandemlake.sources import readers, writers


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACG\nUun\n\n>s2\n-- \n>s3 x>y\nTT\n")
    found = readers.fasta(spark, str(tmp_path / "a.fa"))
    assert [(r.record, r.id, r.seq, r.len) for r in found.orderBy("record").collect()] == [(0, "s1", "ACGTTN", 6), (1, "s3", "TT", 2)]
    raw = readers.fasta(spark, str(tmp_path / "a.fa"), cleaned=False)
    assert {r.header: r.seq for r in raw.collect()} == {"s1 first": "ACGUun", "s2": "--", "s3 x>y": "TT"}
    assert [r.id for r in readers.first_records(found, 1).collect()] == ["s1"]
    writers.fasta(found.select("id", "seq"), str(tmp_path / "out"), width=4)
    again = readers.fasta(spark, str(tmp_path / "out"))
    assert {r.id: r.seq for r in again.collect()} == {"s1": "ACGTTN", "s3": "TT"}
    writers.fasta_by_id(found.select("id", "seq"), str(tmp_path / "each"))
    assert sorted(p.name for p in (tmp_path / "each").glob("id=*")) == ["id=s1", "id=s3"]


def test_reads(spark, tmp_path):
    (tmp_path / "lib7.fq").write_text(">r1\nAC\nGT\n>r2\nTT\n")
    assert sorted((r.library, r.read_idx, r.seq) for r in readers.reads(spark, str(tmp_path / "lib7.fq")).collect()) == [("lib7", 0, "ACGT"), ("lib7", 1, "TT")]
    (tmp_path / "q.fastq").write_text("@r1\nACGT\n+\n>>>>\n@r2\nGG\n+\n@@\n")
    assert sorted((r.read_idx, r.seq) for r in readers.fastq(spark, str(tmp_path / "q.fastq")).collect()) == [(0, "ACGT"), (1, "GG")]


def test_hits(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q\tchr1\t98.5\t10\t12\t1\t10\t30\t21\t1e-12\t50\nq\tchr1\tx\t10\t12\t1\t10\t5\t9\t1e-12\t50\n")
    found = readers.search_hits(spark, str(tmp_path / "h.tsv"), "ref")
    kept = readers.valid_hits(found).collect()
    assert [(r.Reference, r.Query, r.Start, r.End, r.Strand, r.Pident) for r in kept] == [("ref", "q", 21, 30, "-", 98.5)]
    assert readers.valid_hits(found, 99.0).collect() == []
    writers.tsv(found.where("Pident is not null"), str(tmp_path / "table"))
    assert readers.hit_table(spark, str(tmp_path / "table")).collect() == found.where("Pident is not null").collect()
    text = spark.createDataFrame([("c", "1", "5", "r", "90.5", "5"), ("c", "x", "5", "r", "90", "5"), ("c", "9", "5", "r", "90", "5")], "Chromosome string, Start string, End string, Reference string, Pident string, HitLength string")
    assert [(r.Start, r.Pident) for r in readers.valid_hits(text).collect()] == [(1, 90.5)]
    with pytest.raises(ValueError, match="Pident"):
        readers.valid_hits(found.drop("Pident"))


def test_interval_and_mapping_files(spark, tmp_path):
    (tmp_path / "g.bed").write_text("c 1 5 g1\nshort 1\n\nc\t7\t9\tg2\textra\n")
    assert [(r.gene, r.Start, r.End) for r in readers.gene_bed(spark, str(tmp_path / "g.bed")).orderBy("order").collect()] == [("g1", 1, 5), ("g2", 7, 9)]
    (tmp_path / "a.simple").write_text("g1 g2 x 1\nshort line\n\ng2 g1 y 2\n")
    assert [tuple(r) for r in readers.anchors(spark, str(tmp_path / "a.simple")).orderBy("line_no").collect()] == [(0, "g1", "g2"), (3, "g2", "g1")]
    (tmp_path / "m.tsv").write_text("code\tspecies\nab\tOne\nab\tTwo\nonly\n")
    assert [(r.code, r.species) for r in readers.mapping(spark, str(tmp_path / "m.tsv")).orderBy("order").collect()] == [("ab", "One"), ("ab", "Two")]
    (tmp_path / "d.tsv").write_text("c\t1\t5\tf\tc\t9\t12\t5\n")
    assert [(r.block, r.dist) for r in readers.distances(spark, str(tmp_path / "d.tsv"), with_block=False).collect()] == [(None, 5)]
    assert readers.distances(spark, None).collect() == []
    (tmp_path / "s.txt").write_text("Danio rerio\n\nMus musculus")
    assert [r.name for r in readers.names(spark, str(tmp_path / "s.txt")).collect()] == ["Danio rerio", "Mus musculus"]
    bed = spark.createDataFrame([("c", 5, 9, "r"), ("b", 1, 2, "r")], "Chromosome string, Start long, End long, Reference string")
    writers.bed(bed, str(tmp_path / "out.bed"))
    assert sorted(tuple(r) for r in readers.bed4(spark, str(tmp_path / "out.bed")).collect()) == [("b", 1, 2, "r"), ("c", 5, 9, "r")]
    writers.tsv(bed, str(tmp_path / "out.tsv"))
    assert writers.json_map(bed, "Chromosome", "Start").first()["json"] == '{"b":1,"c":5}'
