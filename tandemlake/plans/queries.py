"""Registered queries of the genomic operators, over the views of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, sequences
from ..operators import arrays, composition, density, families, kmers, motifs, synteny
from ..operators.graph import shared_folder, written
from ..sources import readers, writers
from ..sources.readers import valid_hits
from . import programs, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: References of the hits view, by return flag and line status.
REFERENCES = ["AF", "AO", "NF", "NO", "RF", "RO"]
MIN_HITS, BIN, TOP, FAR = 3, 10_000, 4, 1_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places; what lies half-way goes up, whatever the order of a sum has made of its last bits."""
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query
def hits_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.hits(spark, sf_dir))


@query
def hits_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.chromosomes(spark, sf_dir).where("Chromosome <> 'Chr9'")
    return rounded(valid_hits(views.hits(spark, sf_dir), 95.0).join(known, "Chromosome", "left_semi").select("Chromosome", "Reference", "Start", "End", "Strand", "Pident"))


@query
def header_pretty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.headers(spark, sf_dir)
    labelled = rows.select("index", names.accession(F.col("header")).alias("accession"), names.chromosome_label(F.col("header"), F.col("index")).alias("pretty_name"))
    return names.unique_labels(labelled, "pretty_name", "index")


@query
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The natural sort key of each distinct header's first word, as text: keys compare as arrays."""
    words = views.headers(spark, sf_dir).select(names.first_word(F.col("header")).alias("name")).distinct()
    return words.select("name", F.array_join(names.natural_key(F.col("name")), "|").alias("sort_key"))


@query
def adaptive_gap_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.merge_distances(arrays.gaps(views.hits(spark, sf_dir))))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.arrays(views.hits(spark, sf_dir), MIN_HITS)


@query
def arrays_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_arrays(spark, sf_dir))


@query
def summary_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.by_reference(_arrays(spark, sf_dir)))


@query
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.regions(written(_arrays(spark, sf_dir)))


@query
def array_n50_l50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.n50(_arrays(spark, sf_dir), ["Reference"])


@query
def top_n_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.largest_per_reference(_arrays(spark, sf_dir)).select("Reference", "Chromosome", "Start", "End", "ArraySize", F.col("Rank").cast("long").alias("Rank"))


@query
def display_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = arrays.displayed(_arrays(spark, sf_dir), views.chromosomes(spark, sf_dir), least=5_000)
    return rounded(shown.select("Chromosome", "Reference", "Start", "End", "display_start", "display_end"))


def _contig_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = views.sequences(spark, sf_dir).select(F.col("seq_idx").alias("index"), F.col("id").alias("Chromosome"), F.length("seq").cast("long").alias("ChromosomeLengthBp"))
    return density.offsets(contigs, gap=0.0)


@query
def chromosome_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence begins in a plot of all, in bases and on a circle."""
    return rounded(_contig_offsets(spark, sf_dir))


@query
def gc_track_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GC bins on the circle of all sequences."""
    contigs = views.sequences(spark, sf_dir).select(F.col("id").alias("Chromosome"), "seq")
    return rounded(density.bin_angles(density.gc_track(contigs, 100), _contig_offsets(spark, sf_dir)))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.segments(written(_arrays(spark, sf_dir)), views.chromosomes(spark, sf_dir))


@query
def nonoverlap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


def _composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.composition(written(_segments(spark, sf_dir)), views.chromosomes(spark, sf_dir))


@query
def composition_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_composition(spark, sf_dir))


@query
def composition_with_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.with_genome(written(_composition(spark, sf_dir)), views.chromosomes(spark, sf_dir)))


@query
def chromosome_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chromosomes, held = views.chromosomes(spark, sf_dir), written(_arrays(spark, sf_dir))
    made = written(composition.composition(composition.segments(held, chromosomes), chromosomes))
    return rounded(composition.chromosome_metrics(held, made, chromosomes))


@query
def chromosome_reference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.reference_metrics(written(_arrays(spark, sf_dir)), views.chromosomes(spark, sf_dir)))


@query
def satellitome_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.satellitome(written(_arrays(spark, sf_dir)), views.chromosomes(spark, sf_dir)))


@query
def heatmap_bp_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.pivoted(_arrays(spark, sf_dir), views.chromosomes(spark, sf_dir), REFERENCES)


@query
def heatmap_count_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.pivoted(_arrays(spark, sf_dir), views.chromosomes(spark, sf_dir), REFERENCES, count=True)


@query
def fixed_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.merged_runs(views.hits(spark, sf_dir), gap=100)


@query
def fixed_gap_merge_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.merged_by_reference(views.hits(spark, sf_dir), gap=100)


@query
def top_refs_by_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.top_by_abundance(views.hits(spark, sf_dir), TOP)


@query
def top_refs_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("Reference"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"))
    return density.top_by_order(lines, TOP)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = views.hits(spark, sf_dir)
    top = [r["Reference"] for r in density.top_by_abundance(hits, TOP).collect()]  # TOP rows
    groups = spark.createDataFrame([(t,) for t in [*top, "Other"]], "Reference string")
    label = F.when(F.col("Reference").isin(top), F.col("Reference")).otherwise("Other")
    return density.coverage(hits, views.chromosomes(spark, sf_dir), groups, label, BIN)


@query
def density_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query
def density_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.total(_coverage(spark, sf_dir))


@query
def gc_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = views.sequences(spark, sf_dir).select(F.col("id").alias("Chromosome"), "seq")
    return rounded(density.gc_track(contigs, 100))


@query
def gc_plot_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = views.sequences(spark, sf_dir).select(F.col("id").alias("Chromosome"), "seq")
    return rounded(density.plot_track(density.gc_track(contigs, 100)))


@query
def heatmap_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heatmap_bp_pivot(spark, sf_dir).select("Chromosome", *[F.log10(F.col(r) + 1).alias(r) for r in REFERENCES]))


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as 0-based half-open intervals of three species."""
    hits = views.hits(spark, sf_dir)
    return hits.select("Chromosome", (F.col("Start") - 1).alias("Start"), "End", F.col("Reference").alias("family"), F.concat(F.lit("sp"), (F.col("HitLength") % 3).cast("string")).alias("species"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = synteny.gene_positions(views.genes(spark, sf_dir), "Start")
    return synteny.blocks(views.anchors(spark, sf_dir), genes)


@query
def blocks_from_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query
def sat_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synteny.inside(_repeats(spark, sf_dir), _blocks(spark, sf_dir))


@query
def sat_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synteny.outside(_repeats(spark, sf_dir), _blocks(spark, sf_dir))


@query
def sat_nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synteny.nearest(_repeats(spark, sf_dir), written(_blocks(spark, sf_dir)))
    return found.select("Chromosome", "Start", "End", "family", "species", "dist", "block")


@query
def synteny_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synteny.summary(_repeats(spark, sf_dir), written(_blocks(spark, sf_dir)), FAR))


@query
def fasta_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sequences(spark, sf_dir).select("id", "seq", F.length("seq").cast("long").alias("len"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that have a letter, as sequences."""
    return views.sequences(spark, sf_dir).where("seq <> ''")


@query
def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, at = F.col("seq"), F.col("seq_idx")
    return rounded(_documents(spark, sf_dir).select(
        "id", sequences.revcomp(seq).alias("revcomp"), sequences.rotated(seq, at).alias("rotated"), F.length(sequences.tandem(seq, 3)).cast("long").alias("tandem_len"),
        sequences.gc_fraction(seq).alias("gc"), sequences.hamming(seq, sequences.rotated(seq, at)).cast("long").alias("shifted_differences"),
        sequences.subsequence(seq, F.lit(15), F.lit(4)).alias("minus_part"), names.file_safe(F.col("id")).alias("file"), names.species_code(F.col("id")).alias("code"),
    ))


@query
def circular_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.distinct(_documents(spark, sf_dir), 6)


@query
def circular_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many k-mers each document has for each k that may be chosen."""
    return kmers.counts(_documents(spark, sf_dir), [k for _, k, _ in kmers.SIZES])


@query
def median_k_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice(_documents(spark, sf_dir))


def _choice(rows: DataFrame) -> DataFrame:
    k, least = kmers.choice(F.col("median_len"))
    return kmers.middle_length(rows).select("n", "min_len", "max_len", "median_len", k.cast("long").alias("k"), least.cast("long").alias("min_shared"))


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    monomers = views.monomers(spark, sf_dir)
    chosen = _choice(monomers).first()
    return kmers.shared(monomers, chosen["k"], chosen["min_shared"])


@query
def kmer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share k-mers, with the k and the number that their middle length asks for."""
    chosen = median_k_choice(spark, sf_dir).first()
    return kmers.shared(_documents(spark, sf_dir), chosen["k"], chosen["min_shared"])


@query
def candidate_pairs_length_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.similar_lengths(_documents(spark, sf_dir), families.THRESHOLD)


def _motif(spark: SparkSession, sf_dir: str) -> str:
    first = views.monomers(spark, sf_dir).orderBy("seq_idx").limit(1).first()  # the reference: one record
    return first["seq"][:12].replace("N", "G")


def _motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads of four letters, their sources as libraries."""
    docs = views.table(spark, sf_dir, "documents")
    reads = docs.select(F.col("source").alias("library"), F.col("doc_id").alias("read_idx"), F.translate(sequences.clean(F.col("text")), "N", "G").alias("seq"))
    return motifs.scan(reads, _motif(spark, sf_dir))


@query
def motif_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir)


@query
def motif_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = views.table(spark, sf_dir, "nation")
    species = nation.select(F.when(F.col("n_nationkey") == 3, "src").otherwise(F.lower("n_name")).alias("code"), F.col("n_name").alias("species"), F.col("n_nationkey").alias("order"))
    return motifs.annotated(motifs.numbered(_motifs(spark, sf_dir)), species)


@query
def motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.per_library(_motifs(spark, sf_dir))


@query
def motif_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.repeated(_motifs(spark, sf_dir), 2)


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(distinct monomers, scores of those that reach the families' threshold)."""
    once = written(families.classes(views.monomers(spark, sf_dir)))
    return once, written(families.all_scores(once, families.THRESHOLD))


@query
def pair_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct monomers that reach the threshold both ways."""
    return rounded(_scores(spark, sf_dir)[1])


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.families(views.monomers(spark, sf_dir), scores=_scores(spark, sf_dir)[1])


@query
def sequence_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _families(spark, sf_dir)


@query
def family_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.ranked(_families(spark, sf_dir))


def _strict(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, families of all monomers, their strict groups)."""
    once, scores = _scores(spark, sf_dir)
    monomers = views.monomers(spark, sf_dir)
    held = written(families.families(once.withColumn("id", F.col("seq_idx").cast("string")), scores=scores))
    strict = families.strict_families(scores, _shared(spark, sf_dir), held)
    return scores, families.families(monomers, scores=scores), written(families.strict_members(monomers, once, strict))


@query
def strict_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir)[2]


@query
def rescue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _, strict = _strict(spark, sf_dir)
    return rounded(families.rescue_pairs(scores, views.monomers(spark, sf_dir), strict))


@query
def family_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all pairs of a family, which chains of links leave to be scored."""
    once, scores = _scores(spark, sf_dir)
    held = written(families.families(views.monomers(spark, sf_dir), scores=scores))
    inner = written(held.where("family_size > 1").join(once.select("seq_idx"), "seq_idx", "left_semi").select("seq_idx", "family"))
    pairs = inner.select(F.col("seq_idx").alias("i"), "family").join(inner.select(F.col("seq_idx").alias("j"), "family"), "family").where("j < i")
    return families.medoids(written(families.pair_scores(pairs, once)), held)


def _superfamily_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    monomers = views.monomers(spark, sf_dir)
    once = written(families.classes(monomers))
    candidates = written(families.class_pairs(_shared(spark, sf_dir), families.classed(monomers, once)))
    scores = written(families.link_scores(monomers, once, candidates))
    return written(families.superfamily_links(families.member_scores(scores, candidates), families.families(monomers, scores=scores)))


@query
def superfamily_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_superfamily_links(spark, sf_dir))


@query
def superfamily_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(families.family_links(_superfamily_links(spark, sf_dir)))


@query
def frame_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    monomers, held = views.monomers(spark, sf_dir), written(_families(spark, sf_dir))
    return rounded(families.alignment_summary(families.frames(monomers, held), held, monomers))


@query
def anchored_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    monomers, held = views.monomers(spark, sf_dir), written(_families(spark, sf_dir))
    return families.anchored(written(families.frames(monomers, held)), monomers)


@query
def superfamily_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.superfamilies(_superfamily_links(spark, sf_dir))


@query
def family_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten proofs of each family."""
    once, scores = _scores(spark, sf_dir)
    held = families.families(once.withColumn("id", F.col("seq_idx").cast("string")), scores=scores)
    return families.proofs(scores, once, most=10, families=held)


@query
def rescue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held, strict = _strict(spark, sf_dir)
    return families.rescue_groups(views.monomers(spark, sf_dir), strict, held)


@query
def hits_pretty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their chromosomes under the labels of a genome's headers; those that no header names stay as they are."""
    chromosomes = views.chromosomes(spark, sf_dir).where("Chromosome <> 'Chr9'")
    index = F.substring("Chromosome", 4, 1).cast("long") + 1
    headers = chromosomes.select(index.alias("index"), F.concat("Chromosome", F.lit(" Danio chromosome "), index.cast("string")).alias("header"))
    labels = names.unique_labels(headers.select("index", names.accession(F.col("header")).alias("accession"), names.chromosome_label(F.col("header"), F.col("index")).alias("pretty_name")), "pretty_name", "index")
    return rounded(names.renamed(views.hits(spark, sf_dir), labels))


@query
def hits_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by way of files: written as tabular search output, read and validated."""
    raw = views.raw_hits(spark, sf_dir)
    one = F.lit(1)
    rows = raw.select(F.col("Reference").alias("qseqid"), F.col("Chromosome").alias("sseqid"), F.col("Pident").alias("pident"), F.col("HitLength").alias("length"), F.col("HitLength").alias("qlen"), one.alias("qstart"), F.col("HitLength").alias("qend"), "sstart", "send", F.lit(1e-12).alias("evalue"), F.col("Bitscore").alias("bitscore"))
    path = _scratch(spark)
    rows.write.csv(path, sep="\t")
    found = valid_hits(readers.search_hits(spark, path), 95.0)
    return rounded(found.select("Reference", "Query", "Chromosome", "Start", "End", "Strand", "Pident", F.col("HitLength").cast("long").alias("HitLength"), F.col("Bitscore").alias("Bitscore")))


@query
def intervals_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as a BED file, sorted, written and read."""
    path = _scratch(spark)
    writers.bed(views.hits(spark, sf_dir), path)
    return readers.bed4(spark, path)


@query
def sequences_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTA, wrapped at 60 letters, written and read."""
    path = _scratch(spark)
    writers.fasta(views.sequences(spark, sf_dir).where("seq <> ''"), path)
    return readers.fasta(spark, path).select("id", "header", "seq", "len")


@query
def sequences_strict_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ASCII letters as FASTA, read in the mode that drops U."""
    path = _scratch(spark)
    raw = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq")).where("seq <> ''")
    writers.fasta(raw, path)
    return readers.fasta(spark, path, mode="strict").select("id", "seq", "len")


@query
def sequences_wanted_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of documents in English, read from a FASTA of all."""
    path = _scratch(spark)
    writers.fasta(views.sequences(spark, sf_dir).where("seq <> ''"), path)
    wanted = views.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("id"))
    return readers.fasta(spark, path, wanted=wanted).select("id", "seq", "len")


@query
def array_tables_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and headers to all array tables, in one call: the rows that each file holds when it is read again."""
    path = _scratch(spark)
    chromosomes = views.chromosomes(spark, sf_dir)
    headers = chromosomes.select((F.substring("Chromosome", 4, 1).cast("long") + 1).alias("index"), F.col("Chromosome").alias("header"), F.col("ChromosomeLengthBp").alias("length"))
    made = programs.array_tables(views.hits(spark, sf_dir), headers, path, MIN_HITS)
    rows = [spark.read.csv(at, sep="\t", header=name != "valid_monomers").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, at in made.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def similarity_tables_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monomers to all results of their comparison, in one call: the families' table when it is read again."""
    path = _scratch(spark)
    programs.similarity_tables(views.monomers(spark, sf_dir), path)
    return spark.read.csv(f"{path}/id80.families.tsv", sep="\t", header=True, schema="family_id string, family_size long, rep_id string, member_id string, member_len long")


@query
def genes_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes as a file of fields set apart by blanks, written and read."""
    path = _scratch(spark)
    views.genes(spark, sf_dir).select(F.concat_ws("  ", "Chromosome", "Start", "End", "gene").alias("value")).write.text(path)
    return readers.gene_bed(spark, path).select("Chromosome", "Start", "End", "gene")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
