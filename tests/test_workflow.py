"""The run to disk, on the derived hit tables."""

from __future__ import annotations

import os

import pytest

from helpers import rows_of
from dataclasses import replace

from pyspark.sql import functions as F

from protomatch.operators.dedupe import dedupe_spacers
from protomatch.operators.enrich import classify_genbank, classify_imgvr, ungapped
from protomatch.operators.report import score_table
from protomatch.operators.search import SearchSettings
from protomatch.plans import (
    AnalysisSettings,
    all_matches,
    classified_kind,
    classified_matches,
    classify,
    match_table,
    process_all,
    run_workflow,
    score_tables,
    stack,
    tagged_search,
)
from protomatch.plans import workflow
from protomatch.plans.workflow import is_kind
from protomatch.sources.staging import lazily
from protomatch_checks import fixtures

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data missing")


def test_run_to_disk_equals_the_lazy_plans(spark, tmp_path):
    hits, look = fixtures.search_hits(spark, DATA).filter("system = 'TypeIE'"), fixtures.lookups(spark, DATA)
    taxonomy = fixtures.derived(spark, DATA, fixtures.TAXONOMY)
    paths = run_workflow(hits, look, taxonomy, str(tmp_path))
    stored = spark.read.parquet(paths["hits"])
    lazy = process_all(hits, look, stage=lazily)
    columns = sorted(lazy.columns)
    assert rows_of(stored, *columns) == rows_of(lazy, *columns)
    assert sorted(p.name for p in (tmp_path / "hits").glob("system=*")) == ["system=TypeIE"]
    table = score_table(dedupe_spacers(stored)).collect()
    text = next((tmp_path / "score_table_all").glob("part-*")).read_text().splitlines()
    assert len(text) == len(table) + 1 and text[0].startswith("score,TypeIE_non-shuffled")
    assert spark.read.parquet(paths["nucleoid_hits"]).filter("score < 25").count() == 0
    # Matches are stored before the gap filter.
    assert spark.read.parquet(paths["target_matches"]).filter("gaps > 0").count() > 0
    # Host-target tables come from all well-scored matches.
    chosen = spark.read.parquet(paths["host_target_representatives"])
    summary = spark.read.parquet(paths["relationship_summary"]).first()
    assert summary["total_host_target_relationships"] == chosen.count() > 0
    assert spark.read.parquet(paths["top_hits"]).filter("score < 26").count() == 0


def test_second_run_keeps_finished_tables_and_failures_leave_no_stage(spark, tmp_path, monkeypatch):
    hits, look = fixtures.search_hits(spark, DATA).filter("system = 'TypeIE'"), fixtures.lookups(spark, DATA)
    taxonomy = fixtures.derived(spark, DATA, fixtures.TAXONOMY)
    shared = tmp_path / "shared"
    made = workflow.SharedStage
    monkeypatch.setattr(workflow, "SharedStage", lambda spark, root=None: made(spark, str(shared)))

    def broken(*args, **kwargs):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as patch:
        patch.setattr(workflow, "collapse_targets", broken)
        with pytest.raises(RuntimeError):
            run_workflow(hits, look, taxonomy, str(tmp_path / "out"))
    assert not shared.exists() or not list(shared.iterdir())
    first = {p.name for p in (tmp_path / "out" / "target_matches").rglob("part-*")}
    paths = run_workflow(hits, look, taxonomy, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out" / "target_matches").rglob("part-*")} == first
    assert all(os.path.exists(os.path.join(p, "_SUCCESS")) for p in paths.values())
    assert not list(shared.iterdir())


def test_hits_are_scanned_once_per_kind(spark, tmp_path):
    fixtures.search_hits(spark, DATA).write.parquet(str(tmp_path / "raw_hits"))
    hits, look = spark.read.parquet(str(tmp_path / "raw_hits")), fixtures.lookups(spark, DATA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = lambda df: sum("FileScan" in line and "spacer_id" in line for line in plan(df))
    assert scans(all_matches(hits, look)) == 2
    assert scans(ungapped(classified_matches(hits, look))) == 2
    a, b = classified_matches(hits, look), classify(all_matches(hits, look), look)
    assert rows_of(a, *sorted(a.columns)) == rows_of(b, *sorted(a.columns))


def test_every_hit_is_of_one_kind_or_an_error(spark):
    hits = spark.createDataFrame([("gb>150kb",), ("IMGVR<150kb",), (None,), ("other",)], "target_database string")
    with pytest.raises(Exception, match="unknown kind of target database"):
        hits.filter(is_kind("genbank")).collect()
    kinds = [{r[0] for r in hits.filter(is_kind(k, "imgvr")).collect()} for k in ("genbank", "imgvr")]
    assert kinds == [{"gb>150kb"}, {None, "IMGVR<150kb", "other"}]
    with pytest.raises(ValueError):
        is_kind("genbank", "elsewhere")


def test_headings_come_from_the_data_or_must_cover_them(spark):
    hits = spark.createDataFrame(
        [("TypeIV", "non-shuffled", 30.0, 1), ("TypeIE", "v2", 30.0, 1)], "system string, shuffled string, score double, target_length int")
    assert score_table(hits).columns == ["score", "TypeIE_v2", "TypeIV_non-shuffled"]
    with pytest.raises(Exception, match="TypeIV_non-shuffled"):
        score_table(hits, headings=["TypeIE_v2"]).collect()


def test_settings_reach_their_operators(spark):
    hits, look = fixtures.search_hits(spark, DATA).limit(300).cache(), fixtures.lookups(spark, DATA)
    base = AnalysisSettings()
    plain = {r["spacer_seq"]: r for r in all_matches(hits, look).filter("mismatches > 0 and gaps > 0 and score is not null").collect()}
    heavy = all_matches(hits, look, replace(base, mismatch_weight=10, gap_weight=20)).filter("mismatches > 0 and gaps > 0 and score is not null")
    assert plain and all(r["score"] == r["spacer_length"] - 10 * r["mismatches"] - 20 * r["gaps"] for r in heavy.collect())
    named = hits.withColumn("target_id", F.lit("a-b-shuffled"))
    for split, want in (("first", ("a", "b")), ("last", ("a-b", "shuffled"))):
        row = all_matches(named, look, replace(base, split_on=split)).select("target_id", "shuffled").first()
        assert tuple(row) == want
    labelled = hits.withColumn("target_database", F.lit("elsewhere"))
    assert all_matches(labelled, look, replace(base, other_databases="imgvr")).count() >= 0
    nulls = hits.withColumn("target_id", F.lit(None).cast("string"))
    extra = look.phage_names.sparkSession.createDataFrame([(None, "C0", "null phage")], look.phage_names.select("target_id", "target_gca", "phage").schema)
    with_null = replace(look, phage_names=extra)
    found = lambda s: all_matches(nulls, with_null, s).filter("phage = 'null phage'").count()
    assert found(base) == 0 and found(replace(base, match_nulls=True)) > 0
    scored = spark.createDataFrame([("s", "r", 19.0, 100), ("s", "r", 25.0, 300)], "system string, shuffled string, score double, target_length int")
    tables = score_tables(scored.withColumn("nucleoid_forming", F.lit("NF")), settings=replace(base, score_floor=20, length_cutoff=200, headings=["s_r", "t_r"]))
    assert rows_of(tables["all"], "score", "s_r", "t_r") == [(20.0, 1, None), (25.0, 1, None)]
    assert rows_of(tables["large"], "score") == [(25.0,)]


def test_score_tables_come_from_one_scan_of_the_hits(spark, tmp_path):
    rows = [(f"s{k % 2}", "r" if k % 3 else "x", float(15 + k % 9) if k % 7 else None, [None, 100, 200_000, 300_000][k % 4],
             [None, "NF", "non-NF"][k % 3], f"letters {k}") for k in range(120)]
    path = str(tmp_path / "hits")
    spark.createDataFrame(rows, "system string, shuffled string, score double, target_length int, nucleoid_forming string, alignment_seq string").write.parquet(path)
    hits, staged = spark.read.parquet(path), []

    def stage(table, name):
        staged.append(table._jdf.queryExecution().optimizedPlan().toString())
        table.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    tables = score_tables(hits, stage=stage)
    assert len(staged) == 1 and staged[0].count("Relation") == 1 and staged[0].count("Aggregate") == 1
    assert not any("/hits/" in f for t in tables.values() for f in t.inputFiles())
    for name, only in {"all": {}, "large": {"size": "large"}, "small": {"size": "small"}, "nucleoid": {"nucleoid_only": True}}.items():
        want = score_table(hits, **only)
        assert tables[name].columns == want.columns and rows_of(tables[name], *want.columns) == rows_of(want, *want.columns)
    lazy = score_tables(hits)
    assert rows_of(lazy["small"]) == rows_of(tables["small"])


def test_from_sequences_to_score_tables_of_three_systems(spark, tmp_path):
    import random

    rng = random.Random(11)
    targets = [(f"T{k}", "".join(rng.choice("ACGT") for _ in range(3000))) for k in range(4)]
    spacers = [(f"GCF_00000000{k % 3}.1-Cr1-Sp{k}", targets[k % 4][1][100 * k:100 * k + 32]) for k in range(12)]
    table = spark.createDataFrame(targets, "target_id string, seq string")
    systems = ("TypeIE", "TypeIF", "TypeIII")
    found = stack([
        tagged_search(spark.createDataFrame(spacers[k::3], "spacer_id string, seq string"), table, s, "gb>150kb", SearchSettings())
        for k, s in enumerate(systems)
    ])
    details = spark.createDataFrame(
        [(s.split("-")[0], "1", q, s.split("-Sp")[1], 1.0, "I", "GG", 2, s) for s, q in spacers],
        "gcf string, crispr string, spacer_seq string, spacer string, crispr_score double, crispr_type string, repeat_seq string, repeat_length bigint, id string")
    look = replace(
        fixtures.lookups(spark, DATA), spacer_details=details,
        strain_names=spark.createDataFrame([], "assembly string, strain string"),
        phage_names=spark.createDataFrame([(t, f"C{t}", "p") for t, _ in targets], "target_id string, target_gca string, phage string"),
        phage_lengths=spark.createDataFrame([(f"C{t}", 3000) for t, _ in targets], "target_gca string, target_length bigint"))
    taxonomy = spark.createDataFrame([("GCF_000000000", "d__B")], "gcf_tax string, taxonomy string")
    paths = run_workflow(found, look, taxonomy, str(tmp_path))
    rows = spark.read.option("header", True).option("inferSchema", True).csv(paths["score_table_all"]).collect()
    best = {r["score"]: r.asDict() for r in rows}[32.0]
    assert [best[f"{s}_non-shuffled"] for s in systems] == [4, 4, 4]


def test_targets_are_labelled_before_the_hits_look_them_up(spark):
    hits, look = fixtures.search_hits(spark, DATA), fixtures.lookups(spark, DATA)
    for kind, labelled in (("genbank", classify_genbank), ("imgvr", classify_imgvr)):
        own = hits.filter(F.col("target_database").startswith("gb" if kind == "genbank" else "IMGVR"))
        # Some targets twice, and labels of targets that the other lookups do not know.
        twice = replace(look, phage_names=look.phage_names.union(look.phage_names.limit(50)), imgvr_metadata=look.imgvr_metadata.union(look.imgvr_metadata.limit(50)),
                        nucleoid_imgvr=look.nucleoid_imgvr.union(look.nucleoid_imgvr.limit(50)))
        for side in (look, twice):
            table = classified_kind(own, side, kind)
            labels = side.nucleoid_genbank if kind == "genbank" else side.nucleoid_imgvr
            want = labelled(match_table(own, side, kind), labels)
            assert table.columns == want.columns
            assert table.exceptAll(want).count() == want.exceptAll(table).count() == 0
        # A condition on the label is met before the spacer details are looked up.
        plan = table.filter("nucleoid_forming = 'NF'")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        details = next(i for i, x in enumerate(plan) if "Join" in x and "gcf#" in x and "crispr#" in x)
        assert any("Join" in x and "target_id#" in x for x in plan[details:])
        assert not any("Filter" in x and "nucleoid_forming" in x for x in plan[:details])
