"""DuckDB SQL giving the same result as each registered query."""

from __future__ import annotations

import re

from protomatch.operators.collapse import HIT_ORDER, TARGET_COLUMNS
from protomatch_checks import fixtures
from protomatch_checks.fixtures import duck

_KEY = "system, target_database, run, spacer_seq"
_MATCH = " and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in _KEY.split(","))

_FIXTURES = {
    "hits": fixtures.SEARCH_HITS,
    "details": fixtures.SPACER_DETAILS,
    "strains": fixtures.STRAIN_NAMES,
    "names": fixtures.PHAGE_NAMES,
    "lengths": fixtures.PHAGE_LENGTHS,
    "metadata": fixtures.IMGVR_METADATA,
    "nucleoid_gb": fixtures.NUCLEOID_GENBANK,
    "nucleoid_vr": fixtures.NUCLEOID_IMGVR,
    "taxonomy_table": fixtures.TAXONOMY,
}
_NUCLEOID = (
    "nucleoid_forming, shell_id, tubulin_id, shell_evalue, tubulin_evalue, shell_description, tubulin_description"
)
_UNIQUE_TEXT = (
    "target_gca", "phage", "nucleoid_forming", "target_id", "alignment_seq", "shell_id", "tubulin_id", "shell_evalue",
    "tubulin_evalue", "shell_description", "tubulin_description",
)
_TARGET_ORDER = ", ".join(
    ["target_length desc nulls last"] + [
        f"{c} nulls last" for c in (
            "target_id", "target_gca", "phage", "nucleoid_forming", "shell_id", "tubulin_id", "shell_evalue",
            "tubulin_evalue", "shell_description", "tubulin_description", "gcf", "crispr", "spacer", "shared_spacer",
            "strand", "position", "alignment_seq",
        )
    ]
)

_COERCED = ", ".join(f"try_cast({c} as double) as {c}" for c in ("alignment_length", "mismatches", "gaps"))
_PARSE = """
split_part(spacer_id,'-Cr',1) as gcf,
nullif(split_part(split_part(spacer_id,'-Cr',2),'-Sp',1),'') as crispr,
nullif(split_part(split_part(split_part(spacer_id,'-Cr',2),'-Sp',2),'-dup-',1),'') as spacer,
nullif(split_part(split_part(split_part(spacer_id,'-Cr',2),'-Sp',2),'-dup-',2),'') as shared_spacer,
split_part(target_id,'-',1) as target_id,
coalesce(nullif(split_part(target_id,'-',2),''),'non-shuffled') as shuffled,
strand, position, details, alignment_seq, system, target_database, run
"""

_CELLS = (
    "spacer_id", "target_id", "strand", "details", "mismatches", "gaps", "alignment_seq", "alignment_length",
)
_HEAD = "substr(target_id, 1, length(target_id) - length(split_part(target_id,'-',-1)) - 1)"

_STEPS = {
    "parsed": f"select {_PARSE}, mismatches, gaps, alignment_length from hits",
    "parsed_numbers": f"select {_PARSE}, {_COERCED} from hits",
    "scored": """
select *, length(spacer_seq) as spacer_length, '' as notes,
  cast(length(spacer_seq) - 2*mismatches - 3*gaps as double) as score
from parsed_numbers left join details using (gcf, crispr, spacer, system)""",
    "clear": """
select *, substr(gcf,1,15) as assembly from scored where alignment_seq is null or not contains(alignment_seq,'NN')""",
    "strained": """
select * from clear left join (select substr(assembly,1,15) as assembly, strain from strains) s using (assembly)""",
    "genbank": "select * from names left join lengths using (target_gca)",
    "matched_gb": """
select * from strained left join genbank using (target_id) where not starts_with(target_database,'IMGVR')""",
    "matched_vr": """
select * from strained left join metadata using (target_id) where starts_with(target_database,'IMGVR')""",
    "classified_gb": f"""
select * replace (coalesce(nucleoid_forming,'nonNF') as nucleoid_forming), cast(100 as double) as target_completeness
from matched_gb left join (select target_gca, {_NUCLEOID} from nucleoid_gb) n using (target_gca)""",
    "classified_vr": f"""
select * replace (coalesce(nucleoid_forming,'nonNF') as nucleoid_forming)
from matched_vr left join (select target_id, {_NUCLEOID} from nucleoid_vr) n using (target_id)""",
    "classified": "select * from classified_gb union all by name select * from classified_vr",
    "flat": "select * from classified where gaps = 0",
    "by_score": f"""
select * exclude (best, scored_rows),
  count(*) over (partition by {_KEY}) as spacer_hits_topscoring
from (select *, count(*) over (partition by {_KEY}) as spacer_hits_total,
        count(score) over (partition by {_KEY}) as scored_rows, max(score) over (partition by {_KEY}) as best
      from flat)
where score = best and scored_rows = spacer_hits_total""",
    "by_completeness": f"""
select * exclude (best, known_rows)
from (select *, count(target_completeness) over (partition by {_KEY}) as known_rows,
        max(target_completeness) over (partition by {_KEY}) as best
      from by_score)
where target_completeness = best and known_rows = spacer_hits_topscoring""",
    "supported": """
select *, count(*) over (partition by system, target_database, run, gcf, target_id) as host_target_hits
from by_completeness""",
    "selected": f"""
select * exclude (best), count(*) over (partition by {_KEY}) as spacer_hits_final
from (select *, max(host_target_hits) over (partition by {_KEY}) as best from supported)
where host_target_hits = best""",
    "placed": f"select *, row_number() over (partition by {_KEY} order by {_TARGET_ORDER}) as place from selected",
}
for _c in _UNIQUE_TEXT:
    _STEPS[f"text_{_c}"] = f"""
select {_KEY}, string_agg(v, ';' order by place) as {_c}
from (select {_KEY}, coalesce({_c},'NA') as v, min(place) as place from placed group by all) group by {_KEY}"""
_STEPS["listed"] = f"""
select {_KEY}, string_agg(coalesce(strand,'NA'), ';' order by place) as strand,
  string_agg(coalesce(cast(position as varchar),'NA'), ';' order by place) as position,
  case when count(target_length) = count(*) then max(target_length) end as target_length
from placed group by {_KEY}"""
_STEPS["texts"] = "select * from listed " + " ".join(
    f"join text_{c} using ({_KEY})" for c in _UNIQUE_TEXT
)
_STEPS["members"] = f"""
select distinct * exclude (spacer_hits_final, strand, position, target_length, {', '.join(_UNIQUE_TEXT)}) from selected"""
_STEPS["processed"] = f"""
select *, count(*) over (partition by {_KEY}) as spacer_hits_final from members join texts using ({_KEY})"""
_UNIQUE_KEY = "system, shuffled, spacer_seq"
_STEPS["longest"] = f"""
select *, count(target_length) over (partition by {_UNIQUE_KEY}) as known_rows,
  count(*) over (partition by {_UNIQUE_KEY}) as all_rows, max(target_length) over (partition by {_UNIQUE_KEY}) as best
from (select *, count(*) over (partition by {_UNIQUE_KEY}) as spacer_hits_before,
        max(score) over (partition by {_UNIQUE_KEY}) as top,
        count(score) over (partition by {_UNIQUE_KEY}) as scored_rows
      from processed)
where score = top and scored_rows = spacer_hits_before"""
_STEPS["unique_hits"] = f"""
select * exclude (known_rows, all_rows, best, top, scored_rows, n), cast(1 as bigint) as spacer_hits
from (select *, row_number() over (partition by {_UNIQUE_KEY} order by
          case target_database when 'gb<150kb' then 1 when 'gb>150kb' then 2 when 'IMGVR<150kb' then 3 else 4 end,
          gcf nulls last, crispr nulls last, spacer nulls last, shared_spacer nulls last, details nulls last,
          mismatches nulls last, alignment_length nulls last, strain nulls last, run nulls last) as n
      from longest where target_length = best and known_rows = all_rows)
where n = 1"""
_STEPS["top"] = """
select gcf, target_gca, target_id, score, nucleoid_forming from flat where score >= 26 and nucleoid_forming <> 'nonNF'"""
_STEPS["top_stats"] = """
select t.*, s.host_cluster_hits, s.targets_in_relationship
from top t join (select gcf, target_gca, count(*) as host_cluster_hits,
                   count(distinct coalesce(target_id,'missing')) as targets_in_relationship
                 from top group by gcf, target_gca) s
  on t.gcf is not distinct from s.gcf and t.target_gca is not distinct from s.target_gca"""
_STEPS["representatives"] = """
select * exclude (n) from (
  select *, string_agg(case when score = floor(score) then cast(cast(score as bigint) as varchar)
                            else cast(score as varchar) end, ';' order by score desc)
             over (partition by gcf, target_gca, target_id
                   rows between unbounded preceding and unbounded following) as scores_all,
    row_number() over (partition by gcf, target_gca, target_id order by score desc, nucleoid_forming) as n
  from top_stats)
where n = 1"""

# What each step reads; the steps before it come with it.
_ORDER = [*_FIXTURES, *_STEPS]


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def _with(select: str, inputs: dict[str, str] | None = None) -> str:
    """Prefix ``select`` with the steps it needs, in order; ``inputs`` stand in for the fixtures."""
    texts = {**{n: duck(t) for n, t in _FIXTURES.items()}, **(inputs or {}), **_STEPS}
    needed: set[str] = set()
    waiting = [select]
    while waiting:
        sql = waiting.pop()
        for name in _ORDER:
            if name not in needed and _mentions(sql, name) and texts[name] is not sql:
                needed.add(name)
                waiting.append(texts[name])
    steps = ",\n".join(f"{n} as materialized ({texts[n].strip()})" for n in _ORDER if n in needed)
    return f"with {steps}\n{select}"


def _score_table(where: str = "true", inputs: dict[str, str] | None = None) -> str:
    cells = ", ".join(
        f"sum(n) filter (system = '{s}' and shuffled = '{r}') as \"{s}_{r}\""
        for s in ("TypeIE", "TypeIF", "TypeIII") for r in ("non-shuffled", "shuffled")
    )
    return _with(f"""
select score, {cells} from (
  select system, shuffled, case when score <= 18 then 18.0::double else score end as score, count(*)::bigint as n
  from unique_hits where {where} group by all)
group by score order by score""", inputs)


_TARGETS_SHOWN, _HITS_SHOWN = ", ".join(TARGET_COLUMNS), ", ".join(HIT_ORDER)


def _nulls_last(columns: str) -> str:
    return ", ".join(f"{c} nulls last" for c in columns.split(", "))


_LONG_TARGET_ORDER = f"target_length desc nulls last, {_nulls_last(', '.join(TARGET_COLUMNS[1:]))}"
_DOC_BASES = fixtures.BASES_OF_TEXT.format(g=",'g'")
_TARGETS = f"select 'doc'||cast(doc_id as varchar) as target_id, {_DOC_BASES} as seq from documents"


def _spacers(both: bool) -> str:
    turned = "when k%3=2 then reverse(translate(seq,'ACGT','TGCA'))" if both else ""
    return f"""
items as (select item_id, {_DOC_BASES} as seq from benchmark),
counted as (select item_id, seq, greatest(1, length(seq)//32) as pieces from items),
cut as (select item_id, k, substr(seq, k*32+1, case when k = pieces-1 then 64 else 32 end) as seq
        from (select *, unnest(range(0, pieces)) as k from counted)),
spacers as materialized (
  select concat_ws('_','item',item_id,k) as spacer_id,
    case when k%3=1 then substr(seq,1,9)||'A'||substr(seq,11) {turned} else seq end as seq from cut)"""


def _search(both: bool, targets: str = _TARGETS) -> str:
    reverse = "union all select spacer_id, reverse(translate(seq,'ACGT','TGCA')) as seq, '-' as strand from spacers"
    return f"""
with targets as materialized ({targets}),
{_spacers(both)},
stranded as materialized (select spacer_id, seq, '+' as strand from spacers {reverse if both else ''}),
seeds as (select *, substr(seq, o, 7) as word
          from (select *, unnest(range(1, length(seq)-5)) as o from stranded where length(seq) >= 7)),
words as (select target_id, p, substr(seq, p, 7) as word
          from (select *, unnest(range(1, length(seq)-5)) as p from targets where length(seq) >= 7)),
places as (select distinct spacer_id, s.seq, strand, target_id, p-o+1 as position
           from words w join seeds s on w.word = s.word where p-o+1 >= 1),
aligned as (select spacer_id, p.seq as spacer, strand, target_id, position,
              substr(t.seq, position, length(p.seq)) as alignment_seq
            from places p join targets t using (target_id) where position+length(p.seq)-1 <= length(t.seq))
select spacer_id, target_id, strand, cast(position as bigint) as position,
  cast(length(spacer) as varchar)||'M' as details,
  cast(hamming(spacer, alignment_seq) as double) as mismatches, cast(0 as double) as gaps, alignment_seq,
  cast(length(spacer) as double) as alignment_length
from aligned where hamming(spacer, alignment_seq)*100 <= 20*length(spacer)"""


def _nearest(query: str, target: str) -> str:
    """Least edit distance of ``query`` to a beginning of ``target``."""
    shifts = range(-fixtures.GAPS, fixtures.GAPS + 1)
    return "least(" + ", ".join(f"levenshtein({query}, left({target}, greatest(0, length({query})+({d}))))" for d in shifts) + ")"


# Sides of the seed as texts read outwards; every alignment of a side is walked letter by letter.
_W = fixtures.LONG_SEED
_GAPPED = f"""
with recursive targets as materialized ({_TARGETS}),
{_spacers(True)},
edited as (select spacer_id, {fixtures.EDITED.format(k="split_part(spacer_id,'_',3)")} as seq from spacers),
stranded as materialized (select spacer_id, seq, '+' as strand from edited
  union all select spacer_id, reverse(translate(seq,'ACGT','TGCA')) as seq, '-' as strand from edited),
seeds as (select *, substr(seq, o, {_W}) as word
          from (select *, unnest(range(1, length(seq)-{_W - 2})) as o from stranded where length(seq) >= {_W})),
tiles as (select target_id, length(seq) as total, k, greatest(0, 512*k-100) as base, substr(seq, greatest(0, 512*k-100)+1, 718) as part
          from (select *, unnest(range(0, length(seq)//512+1)) as k from targets where length(seq) >= {_W})),
words as (select target_id, base, part, p, substr(part, p-base, {_W}) as word
          from (select *, unnest(range(512*k+1, least(512*(k+1), total-{_W - 1})+1)) as p from tiles)),
framed as (select s.* exclude (seq), target_id, p, length(s.seq) as n, 20*length(s.seq)//100 as allowed,
             reverse(substr(s.seq, 1, o-1)) as lq, substr(s.seq, o+{_W}) as rq,
             reverse(substr(part, greatest(1, p-base-(o-1)-{fixtures.GAPS}), p-base-greatest(1, p-base-(o-1)-{fixtures.GAPS}))) as lt,
             substr(part, p-base+{_W}, length(s.seq)-o-{_W - 1}+{fixtures.GAPS}) as rt
           from words w join seeds s on w.word = s.word),
near as (select * from framed where {_nearest("left(lq,12)", "lt")} + {_nearest("left(rq,12)", "rt")} <= allowed),
likely as materialized (
  select row_number() over () as id, * from near where {_nearest("lq", "lt")} + {_nearest("rq", "rt")} <= allowed),
sides as materialized (select id, 'l' as side, lq as q, lt as t, allowed from likely
  union all select id, 'r', rq, rt, allowed from likely),
moves(kind, dj, dk, dd) as (values ('M',1,0,0), ('I',1,1,-1), ('D',0,1,1)),
walk(id, side, j, k, d, mm) as (
  select id, side, 0, 0, 0, 0 from sides
  union
  select w.id, w.side, j+dj, k+dk, d+dd, mm + case when kind='M' and substr(q,j+1,1)<>substr(t,j+d+1,1) then 1 else 0 end
  from walk w join sides s on w.id=s.id and w.side=s.side, moves
  where (dj=0 or j<length(q)) and (kind='I' or j+d<length(t)) and k+dk<={fixtures.GAPS}
    and mm + k + dk + case when kind='M' and substr(q,j+1,1)<>substr(t,j+d+1,1) then 1 else 0 end <= allowed),
ends as (select w.* from walk w join sides s on w.id=s.id and w.side=s.side where j=length(q)
         qualify row_number() over (partition by w.id, w.side, k order by mm, abs(d), d desc)=1),
paired as (select l.id, l.k+r.k as gaps, l.mm+r.mm as mm, 2*(l.mm+r.mm)+3*(l.k+r.k) as penalty, l.d as dl, r.d as dr
           from ends l join ends r on l.id=r.id and l.side='l' and r.side='r' and l.k+r.k<={fixtures.GAPS}
           join likely c on c.id=l.id where l.mm+r.mm+l.k+r.k<=allowed
           qualify row_number() over (partition by l.id order by 2*(l.mm+r.mm)+3*(l.k+r.k), l.k+r.k, l.k)=1),
placed as (select spacer_id, target_id, strand, p-(o-1)-dl as position, penalty, gaps, mm, n, n+dl+dr as span
           from paired join likely using (id)
           qualify row_number() over (partition by spacer_id, target_id, strand, p-(o-1)-dl order by penalty, gaps, n+dl+dr)=1)
select spacer_id, target_id, strand, cast(position as bigint) as position, cast(mm as double) as mismatches, cast(gaps as double) as gaps,
  cast(n + (gaps+span-n)//2 as double) as alignment_length
from placed a where gaps=0 or not exists (
  select 1 from placed b where a.spacer_id=b.spacer_id and a.target_id=b.target_id and a.strand=b.strand and a.position<>b.position
    and abs(a.position-b.position)<={fixtures.GAPS} and (b.penalty, b.gaps, b.position) < (a.penalty, a.gaps, a.position))"""

_CONTROL = f"""
with targets as ({_TARGETS}),
letters as (select target_id, seq, unnest(range(1, length(seq)+1)) as place from targets where length(seq) > 0),
keyed as (select target_id, place, md5('42/'||target_id||'/'||cast(place as varchar)) as key, seq[place] as letter
          from letters)
select target_id||'-shuffled' as target_id, string_agg(letter, '' order by key, place) as seq
from keyed group by target_id
union all select target_id||'-shuffled', seq from targets where length(seq) = 0"""

# Inputs of the analysis that come from the search and not from a result file.
_N = "cast(split_part(spacer_id,'_',2) as bigint)"
_SP = f"cast({_N}*100+cast(split_part(spacer_id,'_',3) as bigint) as varchar)"
_HOST_OF, _SYSTEM_OF = fixtures.SEARCHED_HOST.format(n=_N), fixtures.SEARCHED_SYSTEM.format(n=_N)
_SEARCHED = {
    "hits": f"""
select * replace ({_HOST_OF}||'-Cr1-Sp'||{_SP} as spacer_id, cast(mismatches as varchar) as mismatches, cast(gaps as varchar) as gaps,
    cast(alignment_length as varchar) as alignment_length),
  {_SYSTEM_OF} as system, '{fixtures.SEARCHED_DATABASE}' as target_database
from (select *, 'non-shuffled' as run from ({_search(True)}) union all select *, 'shuffled' as run from ({_search(True, _CONTROL)}))""",
    "details": f"""
with {_spacers(True)}
select {_HOST_OF} as gcf, '1' as crispr, seq as spacer_seq, {_SP} as spacer, {_SYSTEM_OF} as system from spacers""",
    **{n: duck(t) for n, t in fixtures.SEARCHED_LOOKUPS.items()},
}

_PROTEINS = """
select concat_ws('.', conv_id, turn, role) as protein_id, conv_id as genome_id,
  upper(regexp_replace(text,'[^A-Za-z]','','g')) as seq from conversations"""
_SCREEN = f"""
with proteins as materialized ({_PROTEINS}),
numbered as (select row_number() over () as row_id, protein_id, seq from proteins),
emissions as (select *, {fixtures.EMISSION} as score from (
    select profile, node, chr(cast(64+l as int)) as residue
    from (select unnest(['shell','tubulin']) as profile), (select unnest(range(1,{fixtures.PROFILE_NODES}+1)) as node),
         (select unnest(range(1,27)) as l))),
residues as (select row_id, p, substr(seq, p, 1) as residue
             from (select row_id, seq, unnest(range(1, length(seq)+1)) as p from numbered)),
sums as (select row_id, profile, p-node as diagonal, p,
           sum(score) over (partition by row_id, profile, p-node order by p) as total
         from residues join emissions using (residue)),
segments as (select row_id, profile,
               total - least(0, min(total) over (partition by row_id, profile, diagonal order by p)) as gain from sums),
screened as (select n.protein_id, f.profile, cast(coalesce(max(gain), 0) as bigint) as score
             from numbered n cross join (select distinct profile from emissions) f
             left join segments s on s.row_id = n.row_id and s.profile = f.profile
             group by n.row_id, n.protein_id, f.profile)
"""

_CLASSIFY = f"""{_SCREEN},
named as (select p.genome_id, s.profile, s.protein_id, s.score
          from screened s join (select distinct protein_id, genome_id from proteins) p using (protein_id)),
best as (select * from (select *, row_number() over (partition by genome_id, profile order by score desc, protein_id) as n
                        from named) where n = 1)
select genome_id,
  max(protein_id) filter (profile = 'shell') as shell_id, max(score) filter (profile = 'shell') as shell_score,
  max(protein_id) filter (profile = 'tubulin') as tubulin_id, max(score) filter (profile = 'tubulin') as tubulin_score,
  case when max(score) filter (profile = 'shell') >= {fixtures.THRESHOLDS['shell']}
        and max(score) filter (profile = 'tubulin') >= {fixtures.THRESHOLDS['tubulin']} then 'NF' else 'nonNF' end
    as nucleoid_forming
from best group by genome_id"""

ORACLES: dict[str, str] = {
    "q01_parse_ids": _with("select * from parsed"),
    "q02_coerce_numeric": _with(f"select * replace ({_COERCED}) from hits"),
    "q03_fasta_pairs_to_lines": f"""
with pairs as (select target_id, string_split_regex('>'||target_id||'  '||seq, '\\s+') as tokens from ({_TARGETS}))
select target_id, cast(i-1 as int) as line_part, tokens[i] as line
from (select *, unnest(range(1, len(tokens)+1)) as i from pairs) where tokens[i] <> ''""",
    "q04_drop_header_lines": """
with lines as (select doc_id, string_split(text, chr(10)) as parts from documents)
select doc_id, cast(i-1 as int) as line_no, parts[i] as value
from (select *, unnest(range(1, len(parts)+1)) as i from lines) where parts[i] not like '%@%'""",
    "q05_target_lookup_genbank": _with(
        "select * from parsed left join genbank using (target_id) where not starts_with(target_database,'IMGVR')"),
    "q06_target_lookup_imgvr": _with(
        "select * from parsed left join metadata using (target_id) where starts_with(target_database,'IMGVR')"),
    "q07_spacer_join_score": _with("select * from scored"),
    "q08_strain_prefix_join": _with("""
select * from (select *, substr(gcf,1,15) as assembly from parsed) p
left join (select substr(assembly,1,15) as assembly, strain from strains) s using (assembly)"""),
    "q09_no_ambiguous": _with("select * from parsed where alignment_seq is null or not contains(alignment_seq,'NN')"),
    "q10_classify_genbank": _with("select * from classified_gb"),
    "q11_classify_imgvr": _with("select * from classified_vr"),
    "q12_ungapped": _with("select * from flat"),
    "q13_top_score_per_spacer": _with("select * from by_score"),
    "q14_top_completeness": _with("select * from by_completeness"),
    "q15_host_target_support": _with("select * from selected"),
    "q16_collapse_targets": _with("select * from processed"),
    "q17_union_databases": _with("select * from processed"),
    "q18_union_systems": _with("""
select * from selected where system = 'TypeIII' union all by name
select * from selected where system = 'TypeIE' union all by name select * from selected where system = 'TypeIF'"""),
    "q19_dedupe_spacers": _with("select * from unique_hits"),
    "q20_score_table_all": _score_table(),
    "q21_score_table_large": _score_table("target_length >= 200000"),
    "q22_score_table_small": _score_table("target_length < 200000"),
    "q23_score_table_nf": _score_table("nucleoid_forming <> 'nonNF'"),
    "q24_taxonomy_hits": _with("""
select * from (select * exclude (spacer_hits_before), regexp_replace(gcf,'\\..*','') as gcf_tax from unique_hits
               where nucleoid_forming <> 'nonNF' and score >= 25) h
left join (select regexp_replace(replace(gcf_tax,'RS_',''),'\\..*','') as gcf_tax, taxonomy from taxonomy_table) t
  using (gcf_tax)"""),
    "q25_host_cluster_stats": _with("select * from top_stats"),
    "q26_host_target_representative": _with("select * from representatives"),
    "q27_relationship_summary": _with("""
select count(*) as total_host_target_relationships, count(distinct coalesce(gcf,'missing')) as unique_hosts,
  count(distinct coalesce(target_id,'missing')) as unique_target_contigs,
  count(distinct coalesce(target_gca,'missing')) as unique_target_clusters
from representatives"""),
    "q28_seed_search": _search(False),
    "q29_seed_search_both_strands": _search(True),
    "q30_shuffled_control": _CONTROL,
    "q39_collapse_long_targets": _with(f"""
select *, row_number() over (partition by {_KEY} order by {_LONG_TARGET_ORDER}, score nulls last) as target_place
from (select {_KEY}, score, {_TARGETS_SHOWN}, count(*) as n from selected group by all)"""),
    "q40_collapse_long_hits": _with(f"""
select *, row_number() over (partition by {_KEY} order by {_LONG_TARGET_ORDER}, {_nulls_last(_HITS_SHOWN)}, score nulls last) as hit_place
from (select {_KEY}, score, {_TARGETS_SHOWN}, {_HITS_SHOWN}, count(*) as n from selected group by all)"""),
    "q41_long_score_list": _with("""
select *, row_number() over (partition by gcf, target_gca, target_id order by score desc nulls last) as score_place
from (select gcf, target_gca, target_id, score, count(*) as n from top group by all)"""),
    "q42_rejected_lines": f"""
select l_orderkey, l_linenumber, cast(len(cells) as int) as cells,
  case when len(cells) < 9 then 'too few cells' when len(cells) > 9 then 'too many cells' else 'no number' end as reason,
  concat_ws(',', {', '.join(f"case when nullif(nullif(cells[{i}],'NA'),'') is not null and try_cast(cells[{i}] as {t}) is null then '{n}' end"
                            for i, n, t in ((4, 'position', 'bigint'), (6, 'mismatches', 'double'), (7, 'gaps', 'double'), (9, 'alignment_length', 'double')))}) as bad_columns
from (select l_orderkey, l_linenumber, string_split(rtrim(value, chr(13)), chr(9)) as cells from ({duck(fixtures.RAW_LINES)}) raw) split
where len(cells) <> 9 or bad_columns <> ''""",
    "q38_gapped_search_long_seed": _GAPPED,
    "q43_prepared_search": f"select 'one strand' as search, * from ({_search(False)}) union all select 'both strands', * from ({_search(True)})",
    "q36_search_to_score_table": _score_table(inputs=_SEARCHED),
    "q31_profile_screen": f"{_SCREEN} select * from screened",
    "q32_genome_classification": _CLASSIFY,
    "q34_missing_cells": f"""
select {", ".join(f"nullif(nullif(rtrim({c}, chr(13)),'NA'),'') as {c}" for c in _CELLS)},
  try_cast(nullif(position,'NA') as bigint) as position from ({duck(fixtures.RAW_CELLS)}) cells""",
    "q35_split_on_last": _with(f"""
select {_PARSE.replace("split_part(target_id,'-',1)", _HEAD).replace("split_part(target_id,'-',2)", "split_part(target_id,'-',-1)")},
  mismatches, gaps, alignment_length from (select * replace ('virus-'||target_id as target_id) from hits) hits"""),
    "q33_length_partition": _with("""
select *, case when target_length >= 150000 then '>150kb' when target_length < 150000 then '<150kb' end as size_class
from genbank"""),
}
