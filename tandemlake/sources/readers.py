"""Readers of sequence, hit, interval and mapping files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.names import first_word
from ..functions.sequences import clean, strict_clean
from ..operators.graph import written


#: Splits of files, some 100 bytes each, up to which their table is broadcast.
BROADCAST_SPLITS = 1_000_000
#: What makes a record's body a sequence, by mode: letters to be kept once they are upper case, or anything.
LETTERS = {"clean": "[ACGTNU]", "strict": "[ACGTN]", "raw": r"\S"}


def lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """file, at (where the row's split of the file begins), value: the lines of text files, in the order of each split."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def numbered(rows: DataFrame, across: bool = False) -> DataFrame:
    """rows of lines(), filtered perhaps, with number: 0, 1, 2... along each file, or along all in order of their paths.

    A row's number is its place in its split and the rows of the splits before: the files are read once more to count
    rows, a split a row of the count, and no file is gathered in one task. What is filtered afterwards keeps its number.
    """
    placed = rows.withColumn("__n", F.monotonically_increasing_id())
    splits = written(placed.groupBy("file", "at").agg(F.min("__n").alias("__first"), F.count("*").alias("__rows")))
    earlier = (Window.orderBy("file", "at") if across else Window.partitionBy("file").orderBy("at")).rowsBetween(Window.unboundedPreceding, -1)
    heads = splits.select("file", "at", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    if splits.count() <= BROADCAST_SPLITS:
        heads = F.broadcast(heads)
    number = (F.col("__before") + F.col("__n") - F.col("__first")).cast("long")
    return placed.join(heads, ["file", "at"]).select(*rows.columns, number.alias("number"))


def fasta(spark: SparkSession, path: str | list[str], cleaned: bool = True, mode: str | None = None, wanted: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """file, record, header, id, seq, len of each record that has letters; record counts along a file.

    Records are split at line starts with `>`, so that a file is read in parts. mode: clean (upper case, U as T, A, C, G, T
    and N only), strict (the same, but U goes) or raw (lines are only joined); cleaned=False is raw. wanted: ids, or a
    table of them (id), of the records to be kept; others are counted, but neither cleaned nor joined.
    """
    mode = mode or ("clean" if cleaned else "raw")
    make = {"clean": clean, "strict": strict_clean, "raw": lambda seq: seq}[mode]
    text = F.regexp_replace("value", r"^>", "")
    body = F.regexp_replace(text, r"^[^\n]*\n?", "")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    rows = numbered(lines(spark, path, "\n>").where((body if mode == "raw" else F.upper(body)).rlike(LETTERS[mode])))
    rows = rows.select("file", F.col("number").alias("record"), header.alias("header"), first_word(header).alias("id"), body.alias("body"))
    if isinstance(wanted, DataFrame):
        rows = rows.join(wanted.select("id"), "id", "left_semi")
    elif wanted is not None:
        rows = rows.where(F.col("id").isin(list(wanted)))
    out = rows.select("file", "record", "header", "id", make(F.regexp_replace("body", r"\s", "")).alias("seq"))
    return out.select("*", F.length("seq").cast("long").alias("len"))


def single_record(spark: SparkSession, path: str) -> str:
    """The letters of a file's first record, lines joined: a reference sequence."""
    rows = fasta(spark, path, mode="raw").where("record = 0").limit(1).collect()  # one row
    if not rows:
        raise ValueError(f"{path} has no sequence")
    return rows[0]["seq"]


def first_records(sequences: DataFrame, n: int) -> DataFrame:
    return sequences.where(F.col("record") < n)


def reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """library, read_idx, seq: `>` records as they are, the library named by its file."""
    rows = fasta(spark, path, cleaned=False)
    library = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.select(library.alias("library"), F.col("record").alias("read_idx"), "seq")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """library, read_idx, seq of four-line records: the second line of each."""
    rows = numbered(lines(spark, path)).where(F.col("number") % 4 == 1)
    library = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.select(library.alias("library"), F.floor(F.col("number") / 4).cast("long").alias("read_idx"), F.trim("value").alias("seq"))


def stranded(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows with Start <= End and Strand: - where the coordinates run backwards."""
    return rows.withColumn("Strand", F.when(start <= end, "+").otherwise("-")).withColumn("Start", F.least(start, end)).withColumn("End", F.greatest(start, end))


def search_hits(spark: SparkSession, path: str | list[str], reference: str | None = None, default_columns: bool = False) -> DataFrame:
    """Hits from tabular search output. The reference is the given name, else the query's."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.SEARCH_DEFAULT if default_columns else schemas.SEARCH)
    rows = stranded(rows, F.col("sstart"), F.col("send"))
    name = F.lit(reference) if reference else F.col("qseqid")
    length = F.lit(None).cast("int") if default_columns else F.col("qlen")
    return rows.select(
        name.alias("Reference"), F.col("qseqid").alias("Query"), F.col("sseqid").alias("Chromosome"), "Start", "End", "Strand", F.col("pident").alias("Pident"), F.col("length").alias("HitLength"),
        length.alias("QueryLength"), F.col("qstart").alias("Qstart"), F.col("qend").alias("Qend"), F.col("evalue").alias("Evalue"), F.col("bitscore").alias("Bitscore"),
    )


def valid_hits(hits: DataFrame, min_pident: float = 0.0) -> DataFrame:
    """Hits with all that arrays need, read as numbers where they are text; raises on missing columns."""
    needed = {"Chromosome": "string", "Start": "long", "End": "long", "Reference": "string", "Pident": "double", "HitLength": "int"}
    if missing := [c for c in needed if c not in hits.columns]:
        raise ValueError(f"hits lack columns {missing}")
    kinds = dict(hits.dtypes)

    def number(c: str):
        if c not in needed:
            return F.col(c)
        # text that isn't a number becomes null, and goes
        return (F.col(c).try_cast(needed[c]) if kinds[c] == "string" else F.col(c).cast(needed[c])).alias(c)

    read = hits.select(*[number(c) for c in hits.columns])
    kept = read.na.drop(subset=list(needed)).where("End >= Start")
    return kept.where(F.col("Pident") >= min_pident) if min_pident > 0 else kept


def bed4(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Chromosome, Start, End, Reference. strict: only lines of exactly four fields."""
    if not strict:
        return spark.read.csv(path, sep="\t", schema=schemas.BED4)
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 4)
    return fields.select(F.col("f")[0].alias("Chromosome"), F.col("f")[1].try_cast("long").alias("Start"), F.col("f")[2].try_cast("long").alias("End"), F.col("f")[3].alias("Reference"))


def gene_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Chromosome, Start, End, gene, order (along all files) from lines of four or more fields; others are skipped."""
    rows = numbered(lines(spark, path), across=True).select(F.col("number").alias("order"), F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.where(F.size("f") >= 4).select(F.col("f")[0].alias("Chromosome"), F.col("f")[1].cast("long").alias("Start"), F.col("f")[2].cast("long").alias("End"), F.col("f")[3].alias("gene"), "order")


def anchors(spark: SparkSession, path: str | list[str], start: int = 0, end: int = 1) -> DataFrame:
    """line_no, g_start, g_end: the genes in the given fields; a file's lines count from 0, short and blank ones too."""
    fields = numbered(lines(spark, path)).select(F.col("number").alias("line_no"), F.split(F.trim("value"), r"\s+").alias("f"))
    return fields.where(F.size("f") >= max(4, start + 1, end + 1)).select("line_no", F.col("f")[start].alias("g_start"), F.col("f")[end].alias("g_end"))


def distances(spark: SparkSession, path: str | list[str] | None, with_block: bool = True) -> DataFrame:
    """Distance tables of nine columns, or eight without the block; no path gives an empty table."""
    if path is None:
        return spark.createDataFrame([], schemas.DISTANCES)
    schema = schemas.DISTANCES if with_block else schemas.DISTANCES.replace(" block string,", "")
    rows = spark.read.csv(path, sep="\t", schema=schema)
    return rows if with_block else rows.withColumn("block", F.lit(None).cast("string")).select(*[c.split()[0] for c in schemas.DISTANCES.split(", ")])


def mapping(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """code, species, order: two tab-separated fields; the first line is a header unless told otherwise."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.MAPPING, header=header)
    return rows.where("species is not null").withColumn("order", F.monotonically_increasing_id())


def names(spark: SparkSession, path: str) -> DataFrame:
    """name: one for each line that isn't blank."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def hit_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Hits as the engine writes them: tab-separated with a header in each file."""
    return spark.read.csv(path, sep="\t", schema=schemas.HITS, header=True)
