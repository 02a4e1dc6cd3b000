"""Hit tables, lookups and sequences derived from the given tables.

Each SQL text below runs unchanged in Spark and in DuckDB, over whole tables
and whole texts, with whole-number arithmetic so both engines agree. Every part
is a search target that both kinds of database know; every eight orders share a
spacer, every four suppliers a host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomatch.plans import Lookups

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_HEX_TO_BASES = "'0123456789abcdef','ACGTACGTACGTACGT'"


def _whole(expr: str) -> str:
    return f"cast(floor({expr}) as bigint)"


def _text(expr: str) -> str:
    return f"cast({expr} as string)"


def _padded(expr: str) -> str:
    return f"lpad({_text(expr)},9,'0')"


def _length(key: str) -> str:
    return f"20000+(({key}*7919)%480)*1000"


_SPACER = _whole("l_orderkey/8")
_HOST = _whole("l_suppkey/4")
_GENBANK_GCA = _whole("l_partkey/4")
_SYSTEM = f"case {_SPACER}%3 when 0 then 'TypeIE' when 1 then 'TypeIF' else 'TypeIII' end"
_IS_GENBANK = "(l_partkey+l_linenumber)%2=0"

SEARCH_HITS = f"""
select 'GCF_'||{_padded(_HOST)}||'.1-Cr'||{_text('l_linenumber%4')}||'-Sp'||{_text(_SPACER)}
       ||case when l_quantity>=40 then '-dup-'||{_text('l_linenumber')} else '' end as spacer_id,
  'TGT'||{_padded('l_partkey')}||case when l_tax>=0.04 then '-shuffled' else '' end as target_id,
  case when l_returnflag='A' then '-' else '+' end as strand,
  cast((l_orderkey*7+l_linenumber*131)%190000+1 as bigint) as position,
  'q'||{_text('l_linenumber')} as details,
  case when l_linenumber=7 and l_quantity=13 then 'NA' else {_text('cast(l_quantity as int)%5')} end as mismatches,
  case when l_discount>=0.08 then '1' else '0' end as gaps,
  case when l_linenumber=5 and l_quantity=3 then null else
    substr(translate(md5({_text('l_partkey')}||'/'||{_text(_SPACER)}),{_HEX_TO_BASES}),1,28)
       ||case when l_suppkey%25=3 then 'NNNN' else 'ACGT' end end as alignment_seq,
  case when l_linenumber=6 and l_quantity=17 then 'x' else '32' end as alignment_length,
  {_SYSTEM} as system,
  case when {_IS_GENBANK}
       then case when {_length(_GENBANK_GCA)} >= 150000 then 'gb>150kb' else 'gb<150kb' end
       else case when {_length('l_partkey')} >= 150000 then 'IMGVR>150kb' else 'IMGVR<150kb' end end as target_database,
  case when l_tax>=0.04 then 'shuffled' else 'non-shuffled' end as run
from {{lineitem}}
"""

# Array and spacer facts of each host; those seen only at quantity 11 are missing.
SPACER_DETAILS = f"""
select 'GCF_'||{_padded('host')}||'.1' as gcf, {_text('crispr')} as crispr,
  substr(translate(md5('spacer'||{_text('spacer')}),{_HEX_TO_BASES}),1,cast(28+spacer%5 as int)) as spacer_seq,
  {_text('spacer')} as spacer,
  'sp'||{_text('spacer')}||'h'||{_text('host')} as spacer_id,
  cast(host%10 as double) as crispr_score,
  'CRISPR-'||{_text('crispr')} as crispr_type,
  substr(translate(md5('repeat'||{_text('crispr')}),{_HEX_TO_BASES}),1,24) as repeat_seq,
  cast(24 as bigint) as repeat_length,
  'h'||{_text('host')} as id,
  {_SYSTEM.replace(_SPACER, 'spacer')} as system
from (select distinct {_HOST} as host, l_linenumber%4 as crispr, {_SPACER} as spacer
      from {{lineitem}} where l_quantity<>11) spacers
"""

_SUPPLIER_HOST = _whole("s_suppkey/4")
STRAIN_NAMES = f"""
select 'GCF_'||{_padded(_SUPPLIER_HOST)}||'.1_ASM' as assembly, 'strain '||{_text(_SUPPLIER_HOST)} as strain
from {{supplier}} group by {_SUPPLIER_HOST} having min(s_acctbal)>=0
"""

TAXONOMY = f"""
select distinct case when {_SUPPLIER_HOST}%5=4 then 'GB_GCA_' else 'RS_GCF_' end||{_padded(_SUPPLIER_HOST)}||'.1' as gcf_tax,
  'd__Bacteria;p__P'||{_text(f'{_SUPPLIER_HOST}%6')} as taxonomy
from {{supplier}}
"""

_PART_GCA = _whole("p_partkey/4")
_PART_TARGET = f"'TGT'||{_padded('p_partkey')}"
PHAGE_NAMES = f"""
select {_PART_TARGET} as target_id, 'GCA_'||{_padded(_PART_GCA)} as target_gca,
  'phage '||p_brand||' '||{_text('p_partkey%90')} as phage
from {{part}}
"""

# Some genomes have no length, and some a second contig, which repeats their targets.
PHAGE_LENGTHS = f"""
select 'GCA_'||{_padded(_PART_GCA)} as target_gca, {_length(_PART_GCA)} as target_length
from {{part}} group by {_PART_GCA} having max(p_size)>=20
union all
select 'GCA_'||{_padded(_PART_GCA)} as target_gca, 5000+p_partkey as target_length from {{part}} where p_size=7
"""

# Targets of size 13 are unknown to the metadata, so they have no completeness.
IMGVR_METADATA = f"""
select {_PART_TARGET} as target_id, 'vOTU '||{_text('p_partkey%70')} as phage,
  'CL_'||{_padded(_whole('p_partkey/5'))} as target_gca,
  {_length('p_partkey')} as target_length,
  cast(40+(p_partkey*13)%61 as double) as target_completeness
from {{part}} where p_size<>13
"""

_NUCLEOID_FACTS = """
  'shell_'||cast({n}%4 as string) as shell_id,
  case when {n}%3=0 then 'tubulin_'||cast({n}%5 as string) end as tubulin_id,
  '1e-'||cast(10+{n}%60 as string) as shell_evalue,
  case when {n}%3=0 then '2e-'||cast(5+{n}%40 as string) end as tubulin_evalue,
  'shell protein '||cast({n}%6 as string) as shell_description,
  case when {n}%3=0 then 'tubulin like' end as tubulin_description
"""
NUCLEOID_GENBANK = f"""
select 'GCA_'||{_padded('gca')} as target_gca,
  case when top>=48 then 'NF' else 'candidate' end as nucleoid_forming, {_NUCLEOID_FACTS.format(n='gca')}
from (select {_PART_GCA} as gca, max(p_size) as top from {{part}} group by {_PART_GCA}) genomes where top>=40
"""
NUCLEOID_IMGVR = f"""
select {_PART_TARGET} as target_id,
  case when p_size>=45 then 'NF' else 'candidate' end as nucleoid_forming, {_NUCLEOID_FACTS.format(n='p_partkey')},
  {_length('p_partkey')} as target_length, 'vOTU '||{_text('p_partkey%70')} as phage,
  'c'||{_text('p_partkey%70')} as imgvr_cluster, cast(1 as bigint) as cluster_count,
  cast(40 as double) as target_completeness
from {{part}} where p_size>=30
"""

# Letters to bases, both cases, all other characters removed.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"
# Spark's regexp_replace is always global, DuckDB's takes a flag.
BASES_OF_TEXT = "translate(regexp_replace(text,'[^A-Za-z]',''{g}),'" + _LETTERS + "','" + _BASES + "')"

# Two synthetic models of 30 nodes over 26 letters; scores are fixed by a digest.
PROFILE_NODES = 30
PROFILES = ("shell", "tubulin")
EMISSION = "(ascii(substr(md5(profile||cast(node as string)||residue),1,1))%16)*20000-150000"
THRESHOLDS = {"shell": 120_000, "tubulin": 120_000}

# The cells of a hit file as a scan gives them: text, some missing, some lines ended by CR LF.
RAW_CELLS = f"""
select case when position%11=0 then 'NA' when position%13=0 then '' else spacer_id end as spacer_id,
  case when position%7=0 then 'NA' else target_id end as target_id, strand,
  case when position%5=0 then 'NA' else {_text('position')} end as position, details, mismatches, gaps, alignment_seq,
  case when position%3=0 then alignment_length||chr(13) else alignment_length end as alignment_length
from ({SEARCH_HITS}) raw
"""


# Lines of a hit file: some end early, some go on too long, some have words among the numbers.
RAW_LINES = f"""
select l_orderkey, l_linenumber, spacer_id||chr(9)||target_id||chr(9)||strand||chr(9)
  ||case when l_linenumber=2 and l_quantity=5 then 'unknown' else {_text('position')} end||chr(9)||details
  ||case when l_linenumber=3 and l_quantity=9 then '' else chr(9)||mismatches||chr(9)||gaps||chr(9)||coalesce(alignment_seq,'NA')||chr(9)||alignment_length end
  ||case when l_linenumber=1 and l_quantity=21 then chr(9)||'more' else '' end||case when l_linenumber=4 then chr(13) else '' end as value
from (select l_orderkey, l_linenumber, l_quantity, """ + SEARCH_HITS.strip().removeprefix("select ") + ") lines"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture from its SQL text."""
    used = [n for n in TABLES if "{" + n + "}" in text]
    return spark.sql(text, **tables(spark, sf_dir, *used))


def duck(text: str) -> str:
    """The same text naming DuckDB's registered views."""
    return text.format(**{n: n for n in TABLES}).strip()


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SEARCH_HITS)


def lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    return Lookups(
        spacer_details=derived(spark, sf_dir, SPACER_DETAILS),
        strain_names=derived(spark, sf_dir, STRAIN_NAMES),
        phage_names=derived(spark, sf_dir, PHAGE_NAMES),
        phage_lengths=derived(spark, sf_dir, PHAGE_LENGTHS),
        imgvr_metadata=derived(spark, sf_dir, IMGVR_METADATA),
        nucleoid_genbank=derived(spark, sf_dir, NUCLEOID_GENBANK),
        nucleoid_imgvr=derived(spark, sf_dir, NUCLEOID_IMGVR),
    )


def target_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a target: its letters read as bases."""
    documents = tables(spark, sf_dir, "documents")["documents"]
    return documents.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("target_id"),
        F.expr(BASES_OF_TEXT.format(g="")).alias("seq"),
    )


def spacer_sequences(spark: SparkSession, sf_dir: str, reverse_some: bool = False) -> DataFrame:
    """Benchmark passages cut end to end into spacers of 32 bases, the last up to 63.

    Every third spacer has one base overwritten; with ``reverse_some`` every
    third is reverse-complemented.
    """
    items = tables(spark, sf_dir, "benchmark")["benchmark"].select(
        "item_id", F.expr(BASES_OF_TEXT.format(g="")).alias("seq")
    )
    count = F.greatest(F.lit(1), F.floor(F.length("seq") / 32))
    cut = items.select("item_id", "seq", count.alias("pieces")).select(
        "item_id", "seq", "pieces", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("k")
    )
    width = F.when(F.col("k") == F.col("pieces") - 1, F.lit(64)).otherwise(F.lit(32))
    piece = F.substr("seq", (F.col("k") * 32 + 1).cast("int"), width)
    changed = F.when(F.col("k") % 3 == 1, F.expr("substr(seq,1,9)||'A'||substr(seq,11)"))
    turned = F.when(F.col("k") % 3 == 2, F.reverse(F.translate("seq", "ACGT", "TGCA")))
    seq = F.coalesce(changed, turned, F.col("seq")) if reverse_some else F.coalesce(changed, F.col("seq"))
    return cut.select(
        F.concat_ws("_", F.lit("item"), "item_id", "k").alias("spacer_id"), "k", piece.alias("seq")
    ).select("spacer_id", seq.alias("seq"))


# Every fourth piece loses a base, every fifth other one gains one.
EDITED = """case when cast({k} as bigint)%4=3 then substr(seq,1,15)||substr(seq,17)
  when cast({k} as bigint)%5=4 then substr(seq,1,12)||'G'||substr(seq,13) else seq end"""
# Most gap letters of the search with gaps.
GAPS = 5
# Seed word of the search that is compared with SQL, which cannot align the candidates of shorter words in reasonable time.
LONG_SEED = 10


def edited_spacers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacers with a base too few or too many."""
    spacers = spacer_sequences(spark, sf_dir, reverse_some=True)
    return spacers.select("spacer_id", F.expr(EDITED.format(k="split(spacer_id,'_')[2]")).alias("seq"))


# Lookups of a search of documents: names and lengths by document, nothing of the other kind of database.
_DOC_GCA = "'C'||" + _text("doc_id%50")
SEARCHED_LOOKUPS = {
    "strains": "select 'GCF_000000001' as assembly, 'strain one' as strain from {documents} group by 1",
    "names": f"select 'doc'||{_text('doc_id')} as target_id, {_DOC_GCA} as target_gca, 'phage' as phage from {{documents}}",
    "lengths": f"select {_DOC_GCA} as target_gca, cast(100000+(doc_id%50)*5000 as bigint) as target_length from {{documents}} group by doc_id%50",
    "metadata": f"""select 'doc'||{_text('doc_id')} as target_id, 'phage' as phage, {_DOC_GCA} as target_gca,
  cast(1 as bigint) as target_length, cast(1 as double) as target_completeness from {{documents}} where false""",
    "nucleoid_gb": f"""select {_DOC_GCA} as target_gca, 'NF' as nucleoid_forming, {_NUCLEOID_FACTS.format(n='(doc_id%50)')}
from {{documents}} where doc_id%50 < 20 group by doc_id%50""",
    "nucleoid_vr": f"""select 'doc'||{_text('doc_id')} as target_id, 'NF' as nucleoid_forming, {_NUCLEOID_FACTS.format(n='doc_id')}
from {{documents}} where false""",
}
SEARCHED_DATABASE = "gb>150kb"
# Both take the number of the passage a spacer comes from.
SEARCHED_SYSTEM = "case {n}%3 when 0 then 'TypeIE' when 1 then 'TypeIF' else 'TypeIII' end"
SEARCHED_HOST = "'GCF_'||lpad(cast({n} as string),9,'0')||'.1'"


def searched_spacers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacers under packed ids, with the passage and the piece they come from."""
    parts = F.split("spacer_id", "_")
    numbered = spacer_sequences(spark, sf_dir, reverse_some=True).select(
        parts[1].cast("bigint").alias("n"), (parts[1].cast("bigint") * 100 + parts[2].cast("bigint")).alias("spacer"), "seq")
    return numbered.select(
        F.concat(F.expr(SEARCHED_HOST.format(n="n")), F.lit("-Cr1-Sp"), F.col("spacer").cast("string")).alias("spacer_id"),
        "n", F.col("spacer").cast("string").alias("spacer"), "seq")


def searched_lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    look = {n: derived(spark, sf_dir, t) for n, t in SEARCHED_LOOKUPS.items()}
    details = searched_spacers(spark, sf_dir).select(
        F.expr(SEARCHED_HOST.format(n="n")).alias("gcf"), F.lit("1").alias("crispr"), F.col("seq").alias("spacer_seq"),
        "spacer", F.expr(SEARCHED_SYSTEM.format(n="n")).alias("system"))
    return Lookups(details, look["strains"], look["names"], look["lengths"], look["metadata"], look["nucleoid_gb"], look["nucleoid_vr"])


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a protein of the genome its conversation stands for."""
    turns = tables(spark, sf_dir, "conversations")["conversations"]
    return turns.select(
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("protein_id"),
        F.col("conv_id").alias("genome_id"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"),
    )


def emissions(spark: SparkSession) -> DataFrame:
    letters = F.array(*[F.lit(chr(c)) for c in range(ord("A"), ord("Z") + 1)])
    return (
        spark.range(1, PROFILE_NODES + 1).select(
            F.explode(F.array(*[F.lit(p) for p in PROFILES])).alias("profile"),
            F.col("id").cast("int").alias("node"),
        )
        .select("profile", "node", F.explode(letters).alias("residue"))
        .withColumn("score", F.expr(EMISSION).cast("bigint"))
    )
