"""A run to disk redoes what has changed and leaves the rest."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from protomatch.plans import AnalysisSettings, process_all, run_workflow
from protomatch.plans.manifest import Manifest, content_digests
from protomatch.plans.workflow import RESULTS
from protomatch.sources.sinks import write_hits_table
from protomatch_checks import fixtures

DATA = "/root/testdata/sf0.001"


def test_digests_follow_content_and_not_order(spark):
    rows = [("a", None, 1), ("a", "x", 2), (None, "x", 2), ("b", "x", 1)]
    table = lambda r: spark.createDataFrame(r, "k string, v string, n int")
    base = content_digests(table(rows), ["k"])
    assert content_digests(table(rows[::-1]).repartition(3), ["k"]) == base and len(base) == 3
    changed = content_digests(table([("a", 1 and None, 1), ("a", "x", 3), *rows[2:]]), ["k"])
    assert {k for k in base if base[k] != changed[k]} == {("a",)}
    # Missing values in other places, and repeated rows, are other contents.
    assert content_digests(table([(None, "a", 1)])) != content_digests(table([("a", None, 1)]))
    assert content_digests(table(rows[:1])) != content_digests(table(rows[:1] * 2))
    assert content_digests(table([]), ["k"]) == {}


def files(out):
    """Data files of every table, by the path of their folder."""
    return {
        name: {str(p.parent.relative_to(out / name)): p.name for p in (out / name).rglob("part-*")} for name in RESULTS
    }


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data missing")
def test_changes_redo_what_depends_on_them(spark, tmp_path):
    hits, look = fixtures.search_hits(spark, DATA).filter("system <> 'TypeIII'"), fixtures.lookups(spark, DATA)
    taxonomy = fixtures.derived(spark, DATA, fixtures.TAXONOMY)
    run = lambda h=hits, t=taxonomy, s=AnalysisSettings(): run_workflow(h, look, t, str(tmp_path), settings=s)

    def redone(before):
        return {n for n, f in files(tmp_path).items() if f != before[n]}

    paths = run()
    first = files(tmp_path)
    # The same again, from other partitions in another order: nothing.
    run(hits.repartition(5))
    assert redone(first) == set()
    # Another cut-off and another taxonomy: the tables that use them, and those made from these.
    other = AnalysisSettings(top_score=27.0)
    run(t=taxonomy.filter(F.lit(False)), s=other)
    assert redone(first) == {"top_hits", "host_target_representatives", "relationship_summary", "nucleoid_hits"}
    assert spark.read.parquet(paths["top_hits"]).filter("score < 27").count() == 0
    # One search result has more rows: its partitions, and the tables over all of them.
    one = (F.col("system") == "TypeIE") & (F.col("target_database") == "gb>150kb") & (F.col("run") == "shuffled")
    more = hits.unionByName(hits.filter(one).limit(20).withColumn("position", F.col("position") + 1))
    run(more, s=other)
    now = files(tmp_path)
    for name in ("target_matches", "processed"):
        assert [p for p in now[name] if now[name][p] != first[name].get(p)] == ["system=TypeIE/target_database=gb>150kb/run=shuffled"]
    assert [p for p in now["hits"] if now["hits"][p] != first["hits"].get(p)] == ["system=TypeIE"]
    whole = process_all(more, look)
    stored = spark.read.parquet(paths["hits"])
    assert rows_of(stored, *sorted(whole.columns)) == rows_of(whole, *sorted(whole.columns))


def test_partitions_that_change_go_or_break_off(spark, tmp_path):
    manifest, path = Manifest(spark, str(tmp_path)), str(tmp_path / "hits")
    rows = [("TypeIE", 1.0), ("TypeIE", 2.0), ("TypeIF", 3.0), (None, 4.0)]
    table = lambda r: spark.createDataFrame(r, "system string, score double")

    def refresh(r, write=write_hits_table):
        made = table(r)
        build = lambda only: made if only is None else made.filter(only)
        return manifest.refresh("hits", content_digests(made, ["system"]), build, write, ["system"])

    read = lambda: sorted((r["score"], r["system"]) for r in spark.read.parquet(path).collect())
    assert refresh(rows) is not None and refresh(rows[::-1]) is None
    # A partition without a name changes by itself.
    built = refresh([*rows, (None, 5.0)])
    assert rows_of(built, "score") == [(4.0,), (5.0,)] and len(read()) == 5
    # A partition that is gone leaves no rows behind.
    assert refresh(rows[2:]) is not None and read() == [(3.0, "TypeIF"), (4.0, None)]

    def broken(made, path, **options):
        write_hits_table(made.limit(1), path, **options)
        raise RuntimeError("lost driver")

    with pytest.raises(RuntimeError):
        refresh([*rows[2:], ("TypeIF", 6.0), ("TypeIF", 7.0)], broken)
    assert set(manifest.known("hits")) == {(None,)}
    refresh([*rows[2:], ("TypeIF", 6.0), ("TypeIF", 7.0)])
    assert read() == [(3.0, "TypeIF"), (4.0, None), (6.0, "TypeIF"), (7.0, "TypeIF")]
    assert refresh([]) is not None and spark.read.schema("score double").parquet(path).count() == 0
    assert refresh([]) is None
