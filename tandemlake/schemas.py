"""Schemas of the tables that the operators read, as Spark DDL."""

HITS = "Reference string, Query string, Chromosome string, Start long, End long, Strand string, Pident double, HitLength int, QueryLength int, Qstart int, Qend int, Evalue double, Bitscore double"
#: Tabular search output with the columns asked for, and with the usual twelve.
SEARCH = "qseqid string, sseqid string, pident double, length int, qlen int, qstart int, qend int, sstart long, send long, evalue double, bitscore double"
SEARCH_DEFAULT = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart long, send long, evalue double, bitscore double"
BED4 = "Chromosome string, Start long, End long, Reference string"
DISTANCES = "chr string, start long, end long, family string, chr2 string, start2 long, end2 long, block string, dist long"
MAPPING = "code string, species string"
