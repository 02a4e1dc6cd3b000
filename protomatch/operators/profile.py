"""Screening proteins with position-specific profiles, and labelling genomes from the result."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomatch.operators.enrich import NOT_NUCLEOID_FORMING

# Tasks get the scoring helpers with their work, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUCLEOID_FORMING = "NF"
# Most model nodes handed to tasks at once; more profiles are screened in several passes.
NODES_PER_PASS = 5_000
# Residues scored at once within a task.
_RESIDUES_PER_STEP = 1_000_000
_BREAK = -(1 << 40)


def _passes(emissions: DataFrame, nodes_per_pass: int) -> list[list[str]]:
    """Profile names in groups of bounded size. Only names and sizes reach the driver."""
    groups: list[list[str]] = []
    room = 0
    sizes = emissions.groupBy("profile").agg(F.max("node").alias("nodes")).orderBy("profile")
    for row in sizes.toLocalIterator():
        if not groups or row["nodes"] > room:
            groups.append([])
            room = nodes_per_pass
        groups[-1].append(row["profile"])
        room -= row["nodes"]
    return groups


def _upper(text: str) -> str:
    """Capitals, but for characters whose capital is more than one."""
    upper = text.upper()
    return upper if len(upper) == len(text) else "".join(c.upper() if len(c.upper()) == 1 else c for c in text)


def _score_tables(emissions: DataFrame, names: list[str]) -> dict[str, tuple[dict[str, int], np.ndarray]]:
    """Per profile the column of each residue and an array of node by column.

    Column 0 breaks runs between sequences, column 1 is for residues the model
    lacks, which score 0. Residues are upper-cased.
    """
    rows = emissions.filter(F.col("profile").isin(names)).select("profile", "node", "residue", "score").toPandas()
    tables = {}
    for name, part in rows.groupby("profile"):
        residues = part["residue"].map(_upper)
        columns = {r: k + 2 for k, r in enumerate(sorted(residues.unique()))}
        table = np.zeros((int(part["node"].max()), len(columns) + 2), dtype=np.int64)
        table[part["node"].to_numpy() - 1, residues.map(columns).to_numpy()] = part["score"].to_numpy()
        table[:, 0] = _BREAK
        tables[name] = columns, table
    return tables


def _code_points(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all sequences laid end to end, a zero after each, and where each starts."""
    text = "\0".join(sequences) + "\0"
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in sequences])[:-1]))
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), starts


def best_segments(sequences: list[str], model: tuple[dict[str, int], np.ndarray]) -> np.ndarray:
    """Greatest sum over runs of consecutive nodes against consecutive residues, at least 0.

    The sequences are laid end to end with a breaking column between them; each
    node then extends all runs by one residue in one vector step.
    """
    columns, table = model
    points, starts = _code_points([_upper(s) for s in sequences])
    column_of = np.ones(max(int(points.max()), max(map(ord, columns))) + 1, dtype=np.intp)
    column_of[0] = 0
    column_of[[ord(r) for r in columns]] = list(columns.values())
    codes = column_of[points]
    run = np.zeros(len(codes), dtype=np.int64)
    best = np.zeros(len(codes), dtype=np.int64)
    for node in table:
        run[1:] = run[:-1].copy()
        run[0] = 0
        run += node[codes]
        np.maximum(run, 0, out=run)
        np.maximum(best, run, out=best)
    return np.maximum.reduceat(best, starts)


def _steps(sequences: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, s in enumerate(sequences):
        if size and size + len(s) > _RESIDUES_PER_STEP:
            yield slice(start, i)
            start, size = i, 0
        size += len(s) + 1
    if start < len(sequences):
        yield slice(start, len(sequences))


def screen_profiles(proteins: DataFrame, emissions: DataFrame, nodes_per_pass: int = NODES_PER_PASS,
                    min_score: int | None = None) -> DataFrame:
    """Best ungapped local score of each protein (protein_id, seq) against each profile.

    ``emissions`` holds (profile, node, residue, score) with whole-number
    scores. This is a screening score, not an E-value. Proteins stay where they
    are read; models travel to them in passes of bounded size. ``genome_id`` is
    carried along if proteins have it; ``min_score`` reports only scores that
    reach it.
    """
    carried = [f for f in proteins.schema if f.name == "genome_id"]
    schema = ", ".join(["protein_id string", *[f"genome_id {f.dataType.simpleString()}" for f in carried],
                        "profile string", "score bigint"])
    kept = [F.col("protein_id").cast("string"), *[F.col(f.name) for f in carried], "seq"]
    names_kept = ["protein_id", *[f.name for f in carried]]
    screens = []
    for names in _passes(emissions, nodes_per_pass):
        tables = _score_tables(emissions, names)

        def screen(batches: Iterator[pd.DataFrame], tables=tables) -> Iterator[pd.DataFrame]:
            for batch in batches:
                seqs = batch["seq"].fillna("").tolist()
                for step in _steps(seqs):
                    rows = batch.iloc[step][names_kept]
                    for name, model in tables.items():
                        found = rows.assign(profile=name, score=best_segments(seqs[step], model))
                        yield found if min_score is None else found[found["score"] >= min_score]

        screens.append(proteins.select(*kept).mapInPandas(screen, schema))
    if not screens:
        return proteins.sparkSession.createDataFrame([], schema)
    united = screens[0]
    for other in screens[1:]:
        united = united.union(other)
    return united


def best_hits(screened: DataFrame, genome_of: DataFrame | None = None) -> DataFrame:
    """Best protein per genome and profile; equal scores give the first protein id.

    Rows are combined in their tasks before the shuffle. ``genome_of`` is only
    needed for a screen that did not carry the genome.
    """
    named = screened
    if "genome_id" not in screened.columns:
        named = screened.join(genome_of.select("protein_id", "genome_id").distinct(), "protein_id")
    best = F.min(F.struct((-F.col("score")).alias("rank"), F.col("protein_id")))
    return (
        named.groupBy("genome_id", "profile").agg(best.alias("best"))
        .select("genome_id", "profile", F.col("best.protein_id").alias("protein_id"), (-F.col("best.rank")).alias("score"))
    )


def classify_genomes(genomes: DataFrame, hits: DataFrame, thresholds: Mapping[str, int]) -> DataFrame:
    """Label each genome from its best hit per profile.

    A genome is nucleus-forming when every profile in ``thresholds`` reaches its
    score; that rule is an assumption and is set by the caller.
    """
    names = list(thresholds)
    wide = (
        hits.groupBy("genome_id").pivot("profile", names)
        .agg(F.first("protein_id").alias("id"), F.first("score").alias("score"))
    )
    joined = genomes.select("genome_id").join(wide, "genome_id", "left")
    passed = F.lit(True)
    for name, least in thresholds.items():
        passed = passed & F.coalesce(F.col(f"{name}_score") >= least, F.lit(False))
    return joined.withColumn(
        "nucleoid_forming", F.when(passed, F.lit(NUCLEOID_FORMING)).otherwise(F.lit(NOT_NUCLEOID_FORMING))
    )
