"""The registered genomic queries as SQL over the driver's tables, in DuckDB's dialect."""

from __future__ import annotations

HITS = """hits as (select 'Chr' || cast(l_suppkey % 10 as varchar) as "Chromosome", l_returnflag || l_linestatus as "Reference",
  l_orderkey * 40 + l_linenumber as "Start", l_orderkey * 40 + l_linenumber + cast(l_quantity as bigint) - 1 as "End",
  case when l_linenumber % 2 = 0 and l_quantity > 1 then '-' else '+' end as "Strand",
  100.0 * (1 - l_discount) as "Pident", cast(l_quantity as bigint) as "HitLength", l_extendedprice as "Bitscore" from lineitem)"""
CHROMS = """chroms as (select 'Chr' || cast(i as varchar) as "Chromosome", (select max(o_orderkey) * 40 + 200 from orders) as "ChromosomeLengthBp" from range(10) t(i))"""
GAPS = f"""{HITS}, gaps as (select *, "Start" - max("End") over (partition by "Reference", "Chromosome" order by "Start", "End" rows between unbounded preceding and 1 preceding) - 1 as gap from hits)"""
FACTORS = f"""{GAPS}, stats as (select "Reference", count(*) filter (gap > 0) as n, count(*) filter (gap > 0 and gap <= 10000) as near,
  quantile_cont(gap, [0.5, 0.75, 0.9, 0.95]) filter (gap > 0 and gap <= 10000) as p, quantile_cont(gap, [0.5, 0.75, 0.9, 0.95]) filter (gap > 0) as q from gaps group by 1),
factors as (select "Reference", case when near < 5 then 2000 else cast(ceil(least(greatest(p[4], 1.0), 10000.0)) as bigint) end as "AdaptiveMergeGap_bp",
  2000::bigint as "FallbackGap_bp", 10000::bigint as "GapCap_bp", n as "NumPositiveGaps",
  round(case when n = 0 then null when near < 5 then q[1] else p[1] end + 1e-9, 6) as "GapMedian_local_bp", round(case when n = 0 then null when near < 5 then q[2] else p[2] end + 1e-9, 6) as "GapP75_local_bp",
  round(case when n = 0 then null when near < 5 then q[3] else p[3] end + 1e-9, 6) as "GapP90_local_bp", round(case when n = 0 then null when near < 5 then q[4] else p[4] end + 1e-9, 6) as "GapP95_local_bp",
  case when n = 0 then 'fallback_no_positive_gaps' when near < 5 then 'fallback_few_local_gaps' else 'p95_local_gaps_capped' end as "Method" from stats)"""
ARRAYS = f"""{FACTORS}, flagged as (select g.*, f."AdaptiveMergeGap_bp", case when gap is null or gap > f."AdaptiveMergeGap_bp" then 1 else 0 end as begins from gaps g join factors f using ("Reference")),
islands as (select *, sum(begins) over (partition by "Reference", "Chromosome" order by "Start", "End", begins desc rows unbounded preceding) as island from flagged),
arrays as (select "Chromosome", min("Start") as "Start", max("End") as "End", "Reference", max("End") - min("Start") + 1 as "ArraySize", count(*) as "NumMonomers",
  avg("HitLength") as "MeanMonomerHitLength", median("HitLength")::double as "MedianMonomerHitLength", avg("Pident") as "MeanPident", median("Pident") as "MedianPident", avg("Bitscore") as "MeanBitscore",
  coalesce(median(gap) filter (begins = 0 and gap > 0), 0)::double as "MedianGap", coalesce(max(gap) filter (begins = 0 and gap > 0), 0)::bigint as "MaxGap", any_value("AdaptiveMergeGap_bp") as "AdaptiveMergeGap_bp",
  count(*) filter ("Strand" = '+') as "PlusStrandHits", count(*) filter ("Strand" = '-') as "MinusStrandHits",
  case when count(*) filter ("Strand" = '+') > 0 and count(*) filter ("Strand" = '-') > 0 then 'mixed' when count(*) filter ("Strand" = '+') > 0 then '+' else '-' end as "StrandMix"
  from islands group by "Reference", "Chromosome", island having count(*) >= 3)"""
SEGMENTS = f"""{ARRAYS}, {CHROMS}, clipped as (select "Chromosome", "Reference", greatest("Start", 1) as s, least("End", "ChromosomeLengthBp") as e from arrays join chroms using ("Chromosome") where least("End", "ChromosomeLengthBp") >= greatest("Start", 1)),
points as (select "Chromosome", s as pos from clipped union select "Chromosome", e + 1 from clipped),
steps as (select "Chromosome", pos, lead(pos) over (partition by "Chromosome" order by pos) - 1 as last from points),
segments as (select t."Chromosome", pos as "Start", last as "End", last - pos + 1 as "LengthBp", case when count(distinct "Reference") = 1 then min("Reference") else 'Multi_satDNA_overlap' end as "Category",
  string_agg(distinct "Reference", ',' order by "Reference") as "ActiveReferences", count(distinct "Reference") as "NumActiveReferences"
  from steps t join clipped c on t."Chromosome" = c."Chromosome" and c.s <= pos and c.e >= last group by t."Chromosome", pos, last)"""
COMPOSITION = f"""{SEGMENTS}, held as (select "Chromosome", "Category", sum("LengthBp")::bigint as bp from segments group by all),
bare as (select "Chromosome", 'Non_satDNA' as "Category", ("ChromosomeLengthBp" - coalesce((select sum(bp) from held h where h."Chromosome" = c."Chromosome"), 0))::bigint as bp from chroms c),
composition as (select "Chromosome", "ChromosomeLengthBp", "Category", bp as "CoveredBp", 100.0 * bp / "ChromosomeLengthBp" as "PercentChromosome"
  from (select * from held union all select * from bare where bp <> 0) join chroms using ("Chromosome"))"""


def n50(keys: str) -> str:
    """CTEs n50s: the keys with their N50 and L50."""
    return f"""ordered as (select {keys}, "ArraySize", sum("ArraySize") over (partition by {keys} order by "ArraySize" desc, "Start", "End", "Reference", "Chromosome" rows unbounded preceding) as upto,
  row_number() over (partition by {keys} order by "ArraySize" desc, "Start", "End", "Reference", "Chromosome") as r, sum("ArraySize") over (partition by {keys}) / 2.0 as half from arrays),
n50s as (select {keys}, arg_min("ArraySize", r) as "ArrayN50Bp", min(r) as "ArrayL50" from ordered where upto >= half group by {keys})"""


ARRAY_DOUBLES = ("MeanMonomerHitLength", "MedianMonomerHitLength", "MeanPident", "MedianPident", "MeanBitscore", "MedianGap")


def rounded(source: str, *names: str) -> str:
    return f"select * replace ({', '.join(f'round("{n}" + 1e-9, 6) as "{n}"' for n in names)}) from {source}"


RUNS = f"""{HITS}, ordered as (select *, lag("Reference") over (partition by "Chromosome" order by "Start", "Reference", "End") as prev from hits),
runs as (select *, sum(case when prev is null or prev <> "Reference" then 1 else 0 end) over (partition by "Chromosome" order by "Start", "Reference", "End" rows unbounded preceding) as run from ordered),
ended as (select *, max("End") over (partition by "Chromosome", run order by "Start", "Reference", "End" rows between unbounded preceding and 1 preceding) as far from runs),
pieces as (select *, sum(case when "Start" > far + 100 then 1 else 0 end) over (partition by "Chromosome", run order by "Start", "Reference", "End" rows unbounded preceding) as piece from ended)"""
BY_REFERENCE = f"""{HITS}, ended as (select *, max("End") over (partition by "Chromosome", "Reference" order by "Start", "End" rows between unbounded preceding and 1 preceding) as far from hits),
flagged as (select *, case when far is null or "Start" > far + 100 then 1 else 0 end as begins from ended),
pieces as (select *, sum(begins) over (partition by "Chromosome", "Reference" order by "Start", "End", begins desc rows unbounded preceding) as piece from flagged)"""
COVERAGE = f"""{HITS}, {CHROMS}, top as (select "Reference" from hits group by 1 order by sum(greatest("End" - "Start", 0)) desc, 1 limit 4),
groups as (select "Reference" from top union all select 'Other'), named as (select h.*, coalesce(t."Reference", 'Other') as g from hits h left join top t on h."Reference" = t."Reference"),
grid as (select "Chromosome", s as "Start", least(s + 10000, "ChromosomeLengthBp") as "End" from chroms, lateral (select unnest(range(0, "ChromosomeLengthBp", 10000)) as s)),
raw as (select b."Chromosome", b."Start", n.g, sum(greatest(0, least(n."End", b."End") - greatest(n."Start", b."Start"))) as bp from grid b join named n on n."Chromosome" = b."Chromosome" and n."Start" < b."End" and n."End" > b."Start" group by all),
coverage as (select b."Chromosome", b."Start", b."End", g."Reference", least(coalesce(bp, 0), b."End" - b."Start")::bigint as "Coverage_bp"
  from grid b cross join groups g left join raw r on r."Chromosome" = b."Chromosome" and r."Start" = b."Start" and r.g = g."Reference")"""
BLOCKS = f"""{HITS}, genes as (select 'Chr' || cast(o_orderkey % 10 as varchar) as "Chromosome", o_orderkey * 40 as "Start", o_orderkey * 40 + 40 as "End", o_orderkey as gene from orders),
anchors as (select event_id as line_no, (event_id * 7) % (select count(*) from orders) as g_start, (event_id * 7) % (select count(*) from orders) + 10 * (1 + event_id % 5) as g_end from events),
blocks as (select a."Chromosome", least(a."Start", b."Start") as "Start", greatest(a."End", b."End") as "End", 'block_' || cast(line_no as varchar) as block, a."Chromosome" = b."Chromosome" as same_chromosome
  from anchors join genes a on g_start = a.gene join genes b on g_end = b.gene),
repeats as (select row_number() over () as id, "Chromosome", "Start" - 1 as "Start", "End", "Reference" as family, 'sp' || cast("HitLength" % 3 as varchar) as species from hits),
inner_ids as (select distinct r.id from repeats r join blocks b on r."Chromosome" = b."Chromosome" and r."Start" < b."End" and b."Start" < r."End"),
dist as (select r.id, b.block, case when r."Start" < b."End" and b."Start" < r."End" then 0 when b."End" <= r."Start" then r."Start" - b."End" + 1 else b."Start" - r."End" + 1 end as d from repeats r join blocks b using ("Chromosome")),
least_dist as (select id, min(d) as d from dist group by id),
nearest as (select r.*, coalesce(l.d, -1)::bigint as dist, x.block from repeats r left join least_dist l using (id) left join dist x on x.id = r.id and x.d = l.d)"""
SEQUENCES = """seqs as (select doc_id as seq_idx, 'seq' || cast(doc_id as varchar) as id, regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGTN]', '', 'g') as seq from documents)"""
MONOMERS = """monomers as (select * from (select conv_id * 1000 + turn as seq_idx, 'seq' || cast(conv_id * 1000 + turn as varchar) as id, regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGTN]', '', 'g') as seq from conversations) where seq <> '')"""
OFFSETS = """lengths as (select seq_idx as index, id as "Chromosome", length(seq) as "ChromosomeLengthBp" from seqs),
summed as (select *, coalesce(sum("ChromosomeLengthBp") over (order by index rows between unbounded preceding and 1 preceding), 0)::bigint as "Offset", sum("ChromosomeLengthBp") over () as total from lengths),
offsets as (select index, "Chromosome", "ChromosomeLengthBp", "Offset", "Offset" / total::double * 2 * pi() as s, ("Offset" + "ChromosomeLengthBp") / total::double * 2 * pi() as e from summed)"""
#: Documents with a letter, under the same name.
DOCUMENTS = SEQUENCES.replace("seqs as (", "monomers as (select * from (") + " where seq <> '')"
KMERS = f"""{DOCUMENTS}, windows as (select seq_idx, substr(seq || seq, i::int, 6) as w from monomers, lateral (select unnest(range(1, length(seq) + 1)) as i) where length(seq) >= 6),
kmers as (select distinct seq_idx, least(w, reverse(translate(w, 'ACGTN', 'TGCAN'))) as kmer from windows)"""
MOTIFS = f"""{MONOMERS}, wanted as (select translate(substr(seq, 1, 12), 'N', 'G') as m from monomers order by seq_idx limit 1),
reads as (select source as library, doc_id as read_idx, translate(regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGTN]', '', 'g'), 'N', 'G') as seq from documents),
near as (select library, read_idx, seq, list_filter(range(0, greatest(length(seq) - 11, 0)), lambda o: hamming(substr(seq, o::int + 1, 12), m) <= 4) as o from reads, wanted where length(seq) >= 12),
greedy as (select library, read_idx, seq, list_reduce(list_transform(o, lambda x: [x]), lambda acc, x: case when x[1] >= acc[-1] + 12 then list_concat(acc, x) else acc end) as o from near where len(o) > 0),
motifs as (select library, read_idx, k as "offset", substr(seq, k::int + 1, 12) as motif from greedy, lateral (select unnest(o) as k))"""
LABELS = r"""words as (select p_partkey + 1 as index, case p_partkey % 5 when 0 then 'ref|NC_' || p_partkey || '| Danio chromosome ' || (p_partkey % 25) when 1 then 'Chr' || upper(substr(p_name, 1, 1)) || (p_partkey % 40)
  when 2 then 'scaffold_' || p_partkey // 10 || '.' || p_partkey % 10 when 3 then 'micro' || p_partkey else p_name end as header from part)"""

SIZES = """median("ArraySize") as "MedianArrayBp", avg("ArraySize") as "MeanArrayBp", quantile_cont("ArraySize", 0.9) as "ArrayP90Bp\""""

ORACLE_SQL: dict[str, str] = {
    "hits_normalized": f"with {HITS} {rounded('hits', 'Pident', 'Bitscore')}",
    "hits_pretty_names": f"""with {HITS}, named as (select *, case when "Chromosome" = 'Chr9' then 'Chr9' else 'Chromosome' || (cast(substr("Chromosome", 4, 1) as bigint) + 1) end as c from hits)
select c as "Chromosome", "Reference", "Start", "End", "Strand", round("Pident" + 1e-9, 6) as "Pident", "HitLength", round("Bitscore" + 1e-9, 6) as "Bitscore" from named""",
    "hits_from_files": f"""with {HITS} select "Reference", "Reference" as "Query", "Chromosome", "Start", "End", "Strand", round("Pident" + 1e-9, 6) as "Pident", "HitLength", round("Bitscore" + 1e-9, 6) as "Bitscore" from hits where "Pident" >= 95""",
    "intervals_from_files": f"""with {HITS} select "Chromosome", "Start", "End", "Reference" from hits""",
    "sequences_from_files": f"""with {SEQUENCES} select id, id as header, seq, length(seq) as len from seqs where seq <> ''""",
    "genes_from_files": """select 'Chr' || cast(o_orderkey % 10 as varchar) as "Chromosome", o_orderkey * 40 as "Start", o_orderkey * 40 + 40 as "End", cast(o_orderkey as varchar) as gene from orders""",
    "hits_filtered": f"""with {HITS} select "Chromosome", "Reference", "Start", "End", "Strand", round("Pident" + 1e-9, 6) as "Pident" from hits where "Pident" >= 95 and "End" >= "Start" and "Chromosome" <> 'Chr9'""",
    "header_pretty_names": rf"""with {LABELS}, low as (select index, header, lower(trim(header)) as h from words),
x as (select index, header, regexp_extract(h, 'chromosome\s+([0-9a-z_.-]+)', 1) as a, regexp_extract(h, 'chr(?:omosome)?[_\s-]*([0-9a-z_.-]+)', 1) as b, regexp_extract(h, 'scaffold[_\s-]+([0-9a-z_.-]+)', 1) as c from low),
y as (select index, regexp_extract(replace(replace(trim(header), 'ref|', ''), '|', ''), '(\S+)', 1) as accession, case when a <> '' then 'Chromosome' || a when b <> '' then 'Chromosome' || b when c <> '' then 'scaffold' || c
  when regexp_matches(trim(header), '^[A-Za-z0-9_.-]+$') then trim(header) else 'Chromosome' || index end as p from x)
select index, accession, case when row_number() over (partition by p order by index) > 1 then p || '_' || index else p end as pretty_name from y""",
    "natural_order": rf"""with {LABELS}, n as (select distinct regexp_extract(header, '(\S+)', 1) as name from words)
select name, array_to_string(list_transform(string_split(regexp_replace(name, '([0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda t, i: case when i % 2 = 0 then lpad(t, 20, '0') else lower(t) end), '|') as sort_key from n""",
    "adaptive_gap_by_reference": f"with {FACTORS} select * from factors",
    "arrays_by_reference": f"with {ARRAYS} {rounded('arrays', *ARRAY_DOUBLES)}",
    "summary_by_reference": f"""with {ARRAYS} select "Reference", count(*) as "NumArrays", sum("ArraySize")::bigint as "TotalArrayBp", min("ArraySize") as "MinArrayBp", round(median("ArraySize") + 1e-9, 6) as "MedianArrayBp", max("ArraySize") as "MaxArrayBp",
sum("NumMonomers")::bigint as "TotalMonomerHits", round(median("NumMonomers") + 1e-9, 6) as "MedianMonomersPerArray", round(avg("MeanPident") + 1e-9, 6) as "MeanPident" from arrays group by 1""",
    "merged_regions": f"""with {ARRAYS}, ended as (select *, max("End") over (partition by "Chromosome" order by "Start", "End", "Reference" rows between unbounded preceding and 1 preceding) as far from arrays),
begun as (select *, case when far is null or "Start" > far then 1 else 0 end as starts from ended),
numbered as (select *, sum(starts) over (partition by "Chromosome" order by "Start", "End", starts desc rows unbounded preceding) as region from begun)
select "Chromosome", min("Start") as "Start", max("End") as "End", string_agg(distinct "Reference", ',' order by "Reference") as "References", count(distinct "Reference") as "NumReferences", max("End") - min("Start") + 1 as "ArraySize" from numbered group by "Chromosome", region""",
    "array_n50_l50": f"""with {ARRAYS}, {n50('"Reference"')} select * from n50s""",
    "top_n_arrays": f"""with {ARRAYS}, r as (select "Reference", "Chromosome", "Start", "End", "ArraySize", row_number() over (partition by "Reference" order by "ArraySize" desc, "Chromosome", "Start", "End") as "Rank" from arrays) select * from r where "Rank" <= 2""",
    "display_intervals": f"""with {ARRAYS}, {CHROMS}, w as (select a.*, c."ChromosomeLengthBp"::double as n, (a."Start" + a."End") / 2.0::double as mid, greatest(a."End" - a."Start", 5000) / 2.0::double as half from arrays a join chroms c using ("Chromosome"))
select "Chromosome", "Reference", "Start", "End", round(greatest(mid - half, 0) + 1e-9, 6) as display_start, round(least(mid + half, n) + 1e-9, 6) as display_end from w""",
    "chromosome_offsets": f"""with {SEQUENCES}, {OFFSETS} select index, "Chromosome", "ChromosomeLengthBp", "Offset", round(s + 1e-9, 6) as "StartTheta", round(e + 1e-9, 6) as "EndTheta" from offsets""",
    "nonoverlap_segments": f"with {SEGMENTS} select * from segments",
    "composition_long": f"with {COMPOSITION} {rounded('composition', 'PercentChromosome')}",
    "composition_with_genome": f"""with {COMPOSITION}, total as (select sum("ChromosomeLengthBp")::bigint as n from chroms),
both_of as (select * from composition union all select 'Complete_genome', (select n from total), "Category", sum("CoveredBp")::bigint, 100.0 * sum("CoveredBp") / (select n from total) from composition group by "Category") {rounded('both_of', 'PercentChromosome')}""",
    "chromosome_metrics": f"""with {COMPOSITION}, {n50('"Chromosome"')},
a as (select "Chromosome", count(distinct "Reference") as f, count(*) as n, sum("ArraySize")::bigint as raw_bp, {SIZES}, sum("NumMonomers")::bigint as hits, sum("MeanPident" * "ArraySize") / sum("ArraySize"::double) as wp from arrays group by 1),
big as (select * from (select *, row_number() over (partition by "Chromosome" order by "ArraySize" desc, "Reference", "Start") as r from arrays) where r = 1),
c as (select "Chromosome", coalesce(sum("CoveredBp") filter ("Category" <> 'Non_satDNA'), 0)::bigint as u, coalesce(sum("CoveredBp") filter ("Category" = 'Multi_satDNA_overlap'), 0)::bigint as o from composition group by 1),
d as (select * from (select *, row_number() over (partition by "Chromosome" order by "CoveredBp" desc, "Category") as r from composition where "Category" not in ('Non_satDNA', 'Multi_satDNA_overlap')) where r = 1)
select "Chromosome", h."ChromosomeLengthBp", coalesce(f, 0) as "NumSatDNAFamilies", coalesce(n, 0) as "NumArrays", coalesce(raw_bp, 0) as "RawSummedArrayBp", coalesce(u, 0) as "UnionSatDNABp",
  round(100.0 * coalesce(u, 0) / h."ChromosomeLengthBp" + 1e-9, 6) as "SatDNAPercentChromosome", coalesce(o, 0) as "MultiSatDNAOverlapBp", round(100.0 * coalesce(o, 0) / h."ChromosomeLengthBp" + 1e-9, 6) as "MultiSatDNAOverlapPercent",
  coalesce(big."ArraySize", 0) as "LargestArrayBp", coalesce(big."Reference", 'NA') as "LargestArraySatDNA", big."Start" as "LargestArrayStart", big."End" as "LargestArrayEnd",
  coalesce("ArrayN50Bp", 0) as "ArrayN50Bp", coalesce("ArrayL50", 0) as "ArrayL50", round(coalesce("MedianArrayBp", 0) + 1e-9, 6) as "MedianArrayBp", round(coalesce("MeanArrayBp", 0) + 1e-9, 6) as "MeanArrayBp", round(coalesce("ArrayP90Bp", 0) + 1e-9, 6) as "ArrayP90Bp",
  round(coalesce(n, 0) / (h."ChromosomeLengthBp" / 1e6) + 1e-9, 6) as "ArraysPerMb", round(coalesce(f, 0) / (h."ChromosomeLengthBp" / 1e6) + 1e-9, 6) as "SatDNAFamiliesPerMb", coalesce(hits, 0) as "TotalMonomerHits", round(wp + 1e-9, 6) as "WeightedMeanPident",
  coalesce(d."Category", 'NA') as "DominantSatDNA", coalesce(d."CoveredBp", 0) as "DominantSatDNAExclusiveBp", round(coalesce(100.0 * d."CoveredBp" / h."ChromosomeLengthBp", 0) + 1e-9, 6) as "DominantSatDNAPercentChromosome"
from chroms h left join a using ("Chromosome") left join big using ("Chromosome") left join c using ("Chromosome") left join d using ("Chromosome") left join n50s using ("Chromosome")""",
    "chromosome_reference_metrics": f"""with {ARRAYS}, {CHROMS}, {n50('"Chromosome", "Reference"')},
a as (select "Chromosome", "Reference", count(*) as n, sum("ArraySize")::bigint as bp, {SIZES}, sum("NumMonomers")::bigint as hits, sum("MeanPident" * "ArraySize") / sum("ArraySize"::double) as wp from arrays group by 1, 2),
big as (select * from (select *, row_number() over (partition by "Chromosome", "Reference" order by "ArraySize" desc, "Start") as r from arrays) where r = 1)
select "Chromosome", "ChromosomeLengthBp", "Reference", n as "NumArrays", bp as "TotalArrayBpRaw", round(100.0 * bp / "ChromosomeLengthBp" + 1e-9, 6) as "RawPercentChromosome", big."ArraySize" as "LargestArrayBp", big."Start" as "LargestArrayStart", big."End" as "LargestArrayEnd",
  "ArrayN50Bp", "ArrayL50", round("MedianArrayBp" + 1e-9, 6) as "MedianArrayBp", round("MeanArrayBp" + 1e-9, 6) as "MeanArrayBp", round("ArrayP90Bp" + 1e-9, 6) as "ArrayP90Bp", hits as "TotalMonomerHits", round(wp + 1e-9, 6) as "MeanPidentWeightedByArrayBp"
from a join big using ("Chromosome", "Reference") join n50s using ("Chromosome", "Reference") join chroms using ("Chromosome")""",
    "satellitome_composition": f"""with {ARRAYS}, {CHROMS}, held as (select "Chromosome", "Reference", sum("ArraySize")::bigint as bp from arrays group by all),
every as (select * from held union all select 'Complete_genome', "Reference", sum(bp)::bigint from held group by 2),
places as (select "Chromosome" from chroms union all select 'Complete_genome'), refs as (select distinct "Reference" from arrays),
filled as (select "Chromosome", "Reference", coalesce(bp, 0) as "TotalArrayBp" from places cross join refs left join every using ("Chromosome", "Reference")),
summed as (select *, sum("TotalArrayBp") over (partition by "Chromosome")::bigint as "TotalSatellitomeBpRaw" from filled)
select *, round(case when "TotalSatellitomeBpRaw" > 0 then 100.0 * "TotalArrayBp" / "TotalSatellitomeBpRaw" else 0 end + 1e-9, 6) as "PercentSatellitome", row_number() over (partition by "Chromosome" order by "TotalArrayBp" desc, "Reference") as "RankWithinChromosome" from summed""",
    "fixed_gap_merge": f"""with {RUNS} select "Chromosome", min("Start") as "Start", max("End") as "End", "Reference" from pieces group by "Chromosome", "Reference", run, piece""",
    "fixed_gap_merge_by_reference": f"""with {BY_REFERENCE} select "Chromosome", min("Start") as "Start", max("End") as "End", "Reference" from pieces group by "Chromosome", "Reference", piece""",
    "top_refs_by_abundance": f"""with {HITS} select "Reference", sum(greatest("End" - "Start", 0))::bigint as "TotalBp" from hits group by 1 order by 2 desc, 1 limit 4""",
    "top_refs_by_order": """select l_returnflag || l_linestatus as "Reference", min(l_orderkey * 10 + l_linenumber) as "FirstIndex" from lineitem group by 1 order by 2, 1 limit 4""",
    "density_by_ref": f"with {COVERAGE} select * from coverage",
    "density_total": f"""with {COVERAGE} select "Chromosome", "Start", "End", sum("Coverage_bp")::bigint as "Coverage_bp" from coverage group by all""",
    "gc_track": f"""with {SEQUENCES}, bins as (select id, seq, unnest(range(0, length(seq), 100)) as s from seqs), parts as (select id, s, substr(seq, s::int + 1, 100) as p from bins)
select id as "Chromosome", s::bigint as "Start", (s + length(p))::bigint as "End", round((length(p) - length(translate(p, 'GC', ''))) / nullif(length(p) - length(translate(p, 'ACGT', '')), 0)::double + 1e-9, 6) as "GC_fraction" from parts""",
    "gc_plot_track": f"""with {SEQUENCES}, bins as (select id, seq, unnest(range(0, length(seq), 100)) as s from seqs), parts as (select id, s, substr(seq, s::int + 1, 100) as p from bins),
t as (select id as "Chromosome", s::bigint as "Start", (s + length(p))::bigint as "End", (length(p) - length(translate(p, 'GC', ''))) / nullif(length(p) - length(translate(p, 'ACGT', '')), 0)::double as g from parts),
m as (select quantile_cont(g, 0.5) as mid, min(g) as lo, max(g) as hi from t)
select "Chromosome", "Start", "End", round(g + 1e-9, 6) as "GC_fraction", round(greatest(least(coalesce((coalesce(g, mid) - lo) / nullif(hi - lo, 0), 0.5), 1), 0) + 1e-9, 6) as "GC_plot" from t, m""",
    "blocks_from_anchors": f"with {BLOCKS} select * from blocks",
    "sat_inside": f"""with {BLOCKS} select "Chromosome", "Start", "End", family, species from repeats where id in (select id from inner_ids)""",
    "sat_outside": f"""with {BLOCKS} select "Chromosome", "Start", "End", family, species from repeats where id not in (select id from inner_ids)""",
    "sat_nearest_block": f"""with {BLOCKS} select "Chromosome", "Start", "End", family, species, dist, block from nearest""",
    "synteny_summary": f"""with {BLOCKS}, t as (select species, family, count(*) as total, count(*) filter (id not in (select id from inner_ids)) as outside from repeats group by all),
f as (select species, family, count(*) as far from nearest where id not in (select id from inner_ids) and dist > 1000 group by all)
select species, family, total, outside, coalesce(far, 0) as far, round(100.0 * outside / total + 1e-9, 6) as perc_outside, round(100.0 * coalesce(far, 0) / total + 1e-9, 6) as perc_far from t left join f using (species, family)""",
    "fasta_clean": f"with {SEQUENCES} select id, seq, length(seq) as len from seqs",
    "sequence_functions": rf"""with {DOCUMENTS}, r as (select *, substr(seq, (seq_idx % length(seq))::int + 1) || substr(seq, 1, (seq_idx % length(seq))::int) as rotated from monomers)
select id, reverse(translate(seq, 'ACGTN', 'TGCAN')) as revcomp, rotated, length(seq) * 3 as tandem_len, round((length(seq) - length(translate(seq, 'GC', ''))) / nullif(length(seq) - length(translate(seq, 'ACGT', '')), 0)::double + 1e-9, 6) as gc,
  hamming(seq, rotated) as shifted_differences, reverse(translate(substr(seq, 4, 12), 'ACGTN', 'TGCAN')) as minus_part, regexp_replace(id, '[^A-Za-z0-9_.-]', '_', 'g') as file, regexp_extract(id, '^([a-zA-Z]+)', 1) as code from r""",
    "circular_kmers": f"with {KMERS} select seq_idx, kmer from kmers",
    "median_k_choice": f"""with {DOCUMENTS}, l as (select length(seq) as n, row_number() over (order by length(seq)) as r, count(*) over () as c from monomers), m as (select max(c) as n, min(n) as min_len, max(n) as max_len, min(n) filter (r = c // 2 + 1) as median_len from l)
select *, case when median_len >= 5000 then 13 when median_len >= 2000 then 11 when median_len >= 800 then 9 else 6 end::bigint as k, case when median_len >= 5000 then 6 when median_len >= 2000 then 5 when median_len >= 800 then 4 else 3 end::bigint as min_shared from m""",
    "kmer_candidates": f"""with {KMERS}, p as (select a.seq_idx as i, b.seq_idx as j, count(*) as shared from kmers a join kmers b on a.kmer = b.kmer and b.seq_idx < a.seq_idx group by all having count(*) >= 3),
r as (select *, row_number() over (partition by i order by shared desc, j) as n from p) select i, j, shared from r where n <= 3000""",
    "candidate_pairs_length_pruned": f"""with {DOCUMENTS} select a.seq_idx as i, b.seq_idx as j, length(a.seq) as len_i, length(b.seq) as len_j from monomers a join monomers b on b.seq_idx < a.seq_idx and least(length(a.seq), length(b.seq)) >= 0.8::double * greatest(length(a.seq), length(b.seq))""",
    "motif_scan": f"with {MOTIFS} select * from motifs",
    "motif_annotated": rf"""with {MOTIFS}, n as (select *, row_number() over (partition by library order by read_idx, "offset") as k from motifs),
s as (select 'src' as code, n_name as species from nation where n_nationkey = 3),
l as (select substr(library, 1, 3) || regexp_extract(library, '\d') || k as "Sequence" from n where regexp_matches(upper(motif), '^[ACGT]*$'))
select "Sequence", coalesce(species, 'Unknown') as "Species" from l left join s on regexp_extract("Sequence", '^([a-zA-Z]+)', 1) = code""",
    "motif_counts": f"with {MOTIFS} select library, count(*) as motifs, count(distinct read_idx) as reads from motifs group by 1",
    "motif_copies": f"with {MOTIFS} select motif, count(*) as copies from motifs group by 1 having count(*) > 2",
}
for name, what in (("heatmap_bp_pivot", 'coalesce(sum("ArraySize") filter ("Reference" = \'{r}\'), 0)::bigint'), ("heatmap_count_pivot", 'count(*) filter ("Reference" = \'{r}\')')):
    columns = ", ".join(f'{what.format(r=r)} as "{r}"' for r in ("AF", "AO", "NF", "NO", "RF", "RO"))
    ORACLE_SQL[name] = f"""with {ARRAYS}, {CHROMS} select c."Chromosome", {columns} from chroms c left join arrays a on a."Chromosome" = c."Chromosome" group by 1"""
columns = ", ".join(f"""round(log10(coalesce(sum("ArraySize") filter ("Reference" = '{r}'), 0) + 1) + 1e-9, 6) as "{r}\"""" for r in ("AF", "AO", "NF", "NO", "RF", "RO"))
ORACLE_SQL["heatmap_log10"] = f"""with {ARRAYS}, {CHROMS} select c."Chromosome", {columns} from chroms c left join arrays a on a."Chromosome" = c."Chromosome" group by 1"""

ORACLE_SQL["circular_kmer_counts"] = f"""with {DOCUMENTS}, k as (select unnest([6, 9, 11, 13]) as k),
w as (select distinct seq_idx, k, substr(seq || seq, i::int, k) as w from monomers, k, lateral (select unnest(range(1, length(seq) + 1)) as i) where length(seq) >= k),
c as (select seq_idx, k, count(distinct least(w, reverse(translate(w, 'ACGTN', 'TGCAN')))) as n from w group by 1, 2)
select seq_idx, {", ".join(f"coalesce(max(n) filter (k = {k}), 0)::bigint as k{k}" for k in (6, 9, 11, 13))} from monomers left join c using (seq_idx) group by 1"""
ORACLE_SQL["sequences_strict_from_files"] = r"""with s as (select 'seq' || cast(doc_id as varchar) as id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGTN]', '', 'g') as seq from documents)
select id, seq, length(seq) as len from s where seq <> ''"""
ORACLE_SQL["sequences_wanted_from_files"] = f"""with {SEQUENCES} select id, seq, length(seq) as len from seqs join documents on doc_id = seq_idx where seq <> '' and lang = 'en'"""
_TABLES = {
    "adaptive_merge_distance_by_reference": "adaptive_gap_by_reference", "arrays_by_reference": "arrays_by_reference", "merged_regions_multi_satdna": "merged_regions", "satdna_nonoverlapping_segments": "nonoverlap_segments",
    "satdna_percentage_composition_long": "composition_long", "satdna_percentage_composition_long_with_complete_genome": "composition_with_genome", "satdna_metrics_by_chromosome": "chromosome_metrics",
    "satdna_metrics_by_chromosome_reference": "chromosome_reference_metrics", "satellitome_composition_long": "satellitome_composition", "top_2_arrays_by_reference": "top_n_arrays", "summary_by_reference": "summary_by_reference",
}
ORACLE_SQL["array_tables_from_files"] = " union all ".join(
    [f"select '{name}' as name, count(*) as n from ({ORACLE_SQL[query]})" for name, query in _TABLES.items()]
    + [f"select '{name}' as name, count(*) as n from lineitem" for name in ("raw_hits_mapped", "valid_monomers")]
    + ["select 'sequence_name_mapping' as name, 10 as n", *[f"select '{name}' as name, 11 as n" for name in ("satellitome_total_array_bp_wide", "satellitome_percentage_composition_wide")]]
)
ORACLE_SQL["gc_track_angles"] = f"""with t as ({ORACLE_SQL["gc_track"]}), {SEQUENCES}, {OFFSETS}
select t."Chromosome", t."Start", t."End", t."GC_fraction", round(s + t."Start" / "ChromosomeLengthBp"::double * (e - s) + 1e-9, 6) as "StartAngle", round(s + t."End" / "ChromosomeLengthBp"::double * (e - s) + 1e-9, 6) as "EndAngle" from t join offsets using ("Chromosome")"""
