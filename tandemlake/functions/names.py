"""Identifiers, headers and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_word(header: Column) -> Column:
    return F.regexp_extract(header, r"(\S+)", 1)


def accession(header: Column) -> Column:
    """A header without `ref|` and bars, up to the first blank."""
    return first_word(F.replace(F.replace(F.trim(header), F.lit("ref|"), F.lit("")), F.lit("|"), F.lit("")))


def file_safe(text: Column) -> Column:
    """Letters, digits and -_. stay, others become _, dots and underscores at the ends go; unnamed if nothing is left."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_")
    bare = F.regexp_replace(kept, r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unnamed"))


def sample_id(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"[^A-Za-z0-9]", "_")


def base_name(path: Column) -> Column:
    """The file's name without the endings of sequence files."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    for ending in ("fasta", "fa", "fna"):
        name = F.regexp_replace(name, rf"\.{ending}$", "")
    return name


def species_code(id: Column) -> Column:
    return F.regexp_extract(id, r"^([a-zA-Z]+)", 1)


def chromosome_label(header: Column, index: Column) -> Column:
    """A short label from a header: its chromosome or scaffold in lower case, else the header if it is one word, else by index."""
    low = F.lower(F.trim(header))
    spelled = F.regexp_extract(low, r"chromosome\s+([a-z0-9_.-]+)", 1)
    short = F.regexp_extract(low, r"chr(?:omosome)?[_\s-]*([a-z0-9_.-]+)", 1)
    scaffold = F.regexp_extract(low, r"scaffold[_\s-]+([a-z0-9_.-]+)", 1)
    return (
        F.when(spelled != "", F.concat(F.lit("Chromosome"), spelled))
        .when(short != "", F.concat(F.lit("Chromosome"), short))
        .when(scaffold != "", F.concat(F.lit("scaffold"), scaffold))
        .when(F.trim(header).rlike(r"^[A-Za-z0-9_.-]+$"), F.trim(header))
        .otherwise(F.concat(F.lit("Chromosome"), index.cast("string")))
    )


def unique_labels(headers: DataFrame, label: str, index: str) -> DataFrame:
    """headers whose label, where an earlier row has it already, gets the row's index behind it."""
    seen = F.row_number().over(Window.partitionBy(label).orderBy(index))
    return headers.withColumn(label, F.when(seen > 1, F.concat_ws("_", label, F.col(index).cast("string"))).otherwise(F.col(label)))


def renamed(rows: DataFrame, labels: DataFrame, column: str = "Chromosome") -> DataFrame:
    """rows with a column's accessions replaced by their labels (accession, pretty_name); unknown ones stay.

    labels has a row for each sequence of a genome; adaptive execution broadcasts it where it is small.
    """
    known = labels.select(F.col("accession").alias("of"), "pretty_name").dropDuplicates(["of"])
    out = rows.join(known, F.col(column) == F.col("of"), "left").withColumn(column, F.coalesce("pretty_name", column))
    return out.select(*rows.columns)


def percent_tag(threshold: float) -> str:
    """A threshold in a file's name: its whole percents, cut off."""
    return str(int(threshold * 100))


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits count as numbers: an array, so that parts compare one by one."""
    parts = F.split(F.regexp_replace(name, r"([0-9]+)", "\x01$1\x01"), "\x01", -1)
    return F.transform(parts, lambda t, i: F.when(i % 2 == 1, F.lpad(t, 20, "0")).otherwise(F.lower(t)))


def plot_label(name: Column) -> Column:
    number = F.regexp_extract(name, r"^[Cc]hromosome\s*0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("Chr "), number)).otherwise(name)


def base_pairs(bp: Column) -> Column:
    """A length for people: Gb, Mb, kb or bp."""
    return (
        F.when(bp >= 1e9, F.concat(F.format_string("%.2f", bp / 1e9), F.lit(" Gb")))
        .when(bp >= 1e6, F.concat(F.format_string("%.2f", bp / 1e6), F.lit(" Mb")))
        .when(bp >= 1e3, F.concat(F.format_string("%.1f", bp / 1e3), F.lit(" kb")))
        .otherwise(F.concat(F.bround(bp).cast("long").cast("string"), F.lit(" bp")))
    )


def highlighted(chromosome: Column, wanted: list[str]) -> Column:
    """Whether any of the wanted names occurs in the chromosome's, in whatever case."""
    return F.exists(F.lit([w.strip().lower() for w in wanted if w.strip()]), lambda w: F.contains(F.lower(chromosome), w)) if any(w.strip() for w in wanted) else F.lit(False)


def motif_label(library: Column, number: Column) -> Column:
    """The library's first three letters, its first digit and a running number."""
    return F.concat(F.substring(library, 1, 3), F.regexp_extract(library, r"\d", 0), number.cast("string"))


def is_whole_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9]+$"), F.lit(False))


def species_query(name: Column) -> Column:
    """A species' name as a search term."""
    return F.replace(name, F.lit(" "), F.lit("+"))


def species_file(gene: Column, name: Column) -> Column:
    """The file of a gene of a species."""
    return F.concat(F.upper(gene), F.lit("_"), F.replace(name, F.lit(" "), F.lit("_")), F.lit(".fasta"))
