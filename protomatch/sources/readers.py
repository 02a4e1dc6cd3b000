"""Scans of hit tables, lookups, sequences and profile models."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protomatch.sources import schemas

# Profile emissions are given with five decimals; as whole numbers their sums
# are exact in any order of addition.
EMISSION_SCALE = 100_000
MISSING = "NA"
# Stands in for a zero-probability emission.
IMPOSSIBLE_EMISSION = -10_000_000


def _strip_carriage_returns(df: DataFrame) -> DataFrame:
    """Files written on another system end their lines in CR LF; only the last text field sees it."""
    strings = {f.name: F.rtrim(F.col(f.name), F.lit("\r")) for f in df.schema if f.dataType.simpleString() == "string"}
    return df.withColumns(strings)


def missing_text(value: Column) -> Column:
    """Empty cells and ``NA`` are missing, in text and number columns alike."""
    return F.when(~value.isin("", MISSING), value)


def parse_cells(raw: DataFrame, schema: str) -> DataFrame:
    """Typed columns from the text cells of a file: missing ones NULL, words in number columns too."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    known = {f.name for f in raw.schema}
    cells = _strip_carriage_returns(raw.select(*[n for n, _ in fields if n in known]))
    return cells.select(*[
        (missing_text(F.col(n)) if t == "string" else missing_text(F.col(n)).try_cast(t)).alias(n)
        for n, t in fields if n in known
    ])


def _read_tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    # All columns are read as text so a trailing CR cannot spoil a number.
    raw = ", ".join(f"{f.strip().rsplit(' ', 1)[0]} string" for f in schema.split(","))
    df = spark.read.schema(raw).option("sep", "\t").option("header", header).option("quote", "").csv(path)
    return parse_cells(df, schema)


def read_hits(spark: SparkSession, path: str | list[str], system: str, target_database: str, run: str) -> DataFrame:
    """Search result files of one search, tagged with where they came from."""
    return _read_tsv(spark, path, schemas.HITS).withColumns({
        "system": F.lit(system),
        "target_database": F.lit(target_database),
        "run": F.lit(run),
    })


def read_search_results(spark: SparkSession, files: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Search result files given as (path, system, target_database, run); files of equal tags are one scan."""
    grouped: dict[tuple[str, str, str], list[str]] = {}
    for path, *tags in files:
        grouped.setdefault(tuple(tags), []).append(path)
    return reduce(DataFrame.unionByName, [read_hits(spark, paths, *tags) for tags, paths in grouped.items()])


def read_phage_names(spark: SparkSession, path: str) -> DataFrame:
    """Target names with a header row; ``target.id`` and ``species`` get their working names."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    # A CR at the line end also clings to the last column name.
    df = df.toDF(*[c.rstrip("\r") for c in df.columns])
    df = df.toDF(*[c.replace(".", "_").lower() for c in df.columns])
    df = _strip_carriage_returns(df.withColumnRenamed("species", "phage"))
    return df.select(*[missing_text(F.col(c)).alias(c) for c in df.columns])


def read_phage_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Genome lengths; the header line is skipped and the contig id dropped."""
    return _read_tsv(spark, path, schemas.PHAGE_LENGTHS, header=True).select("target_gca", "target_length")


def read_imgvr_metadata(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, schemas.IMGVR_METADATA)


def read_spacer_details(spark: SparkSession, path: str, system: str | None = None) -> DataFrame:
    df = _read_tsv(spark, path, schemas.SPACER_DETAILS)
    return df if system is None else df.withColumn("system", F.lit(system))


def read_strain_names(spark: SparkSession, path: str, system: str | None = None) -> DataFrame:
    df = _read_tsv(spark, path, schemas.STRAIN_NAMES)
    return df if system is None else df.withColumn("system", F.lit(system))


def _with_schema(table: DataFrame, schema: str) -> DataFrame:
    """The declared columns, in order and typed; further ones stay behind them, a lacking one is an error."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    named = [n for n, _ in fields]
    return table.select(*[F.col(n).cast(t).alias(n) for n, t in fields], *[c for c in table.columns if c not in named])


def read_nucleoid_table(spark: SparkSession, path: str, key: str = "target_gca", text: bool = False) -> DataFrame:
    """Nucleoid labels by ``target_gca`` or ``target_id``; ``text`` reads tab-separated files with a header row."""
    schema = f"{key} string, {schemas.NUCLEOID}"
    if not text:
        return _with_schema(spark.read.parquet(path), schema)
    table = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    table = table.toDF(*[c.rstrip("\r") for c in table.columns])
    return _with_schema(parse_cells(table, ", ".join(f"{c} string" for c in table.columns)), schema)


def read_hits_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored hit tables, one per system or already stacked, by column name; columns that reports use must be there."""
    tables = [_with_schema(spark.read.parquet(p), schemas.STORED_HITS) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, schemas.TAXONOMY)


def pairs_to_lines(lines: DataFrame, column: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """Two-column FASTA-like lines to one token per line, in order within the line."""
    tokens = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    return (
        lines.select(*keep, F.posexplode(tokens).alias("line_part", "line"))
        .filter(F.col("line") != "")
    )


def drop_header_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Remove lines holding an ``@`` anywhere, as the search output headers do."""
    return lines.filter(~F.coalesce(F.col(column).contains("@"), F.lit(False)))


def read_spacer_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``>id sequence`` text as (seq_id, seq); a sequence in several tokens is put together."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return (
        spark.read.text(path)
        .select(F.get(tokens, F.lit(0)).alias("head"), F.nullif(F.array_join(F.slice(tokens, 2, F.size(tokens)), ""), F.lit("")).alias("seq"))
        .filter(F.col("head") != "")
        .select(F.regexp_replace("head", "^>", "").alias("seq_id"), F.upper("seq").alias("seq"))
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records as (seq_id, description, seq), one row per record.

    Files are split at record starts, so a catalogue of many contigs is read in
    parallel; a single record has to fit in a row.
    """
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.substring_index("record", "\n", 1)
    return (
        spark.read.option("lineSep", "\n>").text(path)
        .select(record.alias("record"))
        .filter(F.trim("record") != "")
        .select(
            F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"),
            F.nullif(F.regexp_extract(head, r"^\S*\s+(.*)$", 1), F.lit("")).alias("description"),
            F.upper(F.regexp_replace(F.expr("substr(record, length(substring_index(record, '\n', 1)) + 1)"),
                                     r"\s", "")).alias("seq"),
        )
    )


def emission_score(match: Column, insert: Column) -> Column:
    """Log-odds of a residue at a node as a scaled whole number; insert values act as background."""
    score = F.round((insert - match) * EMISSION_SCALE).cast("bigint")
    return F.coalesce(score, F.lit(IMPOSSIBLE_EMISSION).cast("bigint"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile model text as (profile, node, residue, match_nlp, insert_nlp, score).

    A file may hold many models, each ended by ``//``. A node takes three lines:
    match, insert and transition values; before node 1 come the residue names,
    the transition names and the entry block, with or without a composition line.
    """
    line = lambda i: F.get("lines", i)
    tokens = lambda c: F.split(F.trim(c), r"\s+")
    models = (
        spark.read.option("lineSep", "\n//").text(path)
        .select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
        .select(
            "lines",
            F.array_position(F.transform("lines", lambda x: F.substring(x, 1, 4)), "HMM ").cast("int").alias("head"),
            F.get(F.filter("lines", lambda x: x.startswith("NAME ")), F.lit(0)).alias("name_line"),
            F.get(F.filter("lines", lambda x: x.startswith("LENG ")), F.lit(0)).alias("length_line"),
        )
        .filter(F.col("head") > 0)
    )
    entry = F.when(F.trim(line(F.col("head") + 1)).startswith("COMPO"), 3).otherwise(2)
    nodes = models.select(
        "lines",
        F.get(tokens(F.col("name_line")), F.lit(1)).alias("profile"),
        tokens(line(F.col("head") - 1)).alias("alphabet"),
        (F.col("head") + 1 + entry).alias("first"),
        F.explode(F.sequence(F.lit(1), F.get(tokens(F.col("length_line")), F.lit(1)).cast("int"))).alias("node"),
    )
    at = F.col("first") + 3 * (F.col("node") - 1)
    values = nodes.select(
        "profile", "node", "alphabet",
        tokens(line(at)).alias("match"), tokens(line(at + 1)).alias("insert"),
    )
    return (
        values.select(
            "profile", "node", "match", "insert",
            F.posexplode(F.slice("alphabet", 2, F.size("alphabet") - 1)).alias("i", "residue"),
        )
        .select(
            "profile", "node", "residue",
            F.get("match", F.col("i") + 1).try_cast("double").alias("match_nlp"),
            F.get("insert", F.col("i")).try_cast("double").alias("insert_nlp"),
        )
        .withColumn("score", emission_score(F.col("match_nlp"), F.col("insert_nlp")))
    )
