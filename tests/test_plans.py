"""What the physical plans do with skew, pruning and reuse."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from helpers import SELECT_SCHEMA, executed_plan, hits, settings
from protomatch.operators.collapse import collapse_targets
from protomatch.operators.dedupe import dedupe_spacers
from protomatch.operators.enrich import add_targets
from protomatch.operators.report import add_host_target_stats, host_target_representatives, score_table
from protomatch.operators.select import select_hits

SHUFFLED_JOINS = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
# Small enough for test data to count as skewed.
SKEW = {
    **SHUFFLED_JOINS,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


def skewed(spark, n=40_000):
    """A third of the hits share spacer, host and target."""
    names = [f.split()[0] for f in SELECT_SCHEMA.split(", ")]
    base = hits(spark, {}).drop("spacer_seq", "gcf", "target_id", "position", "alignment_seq")
    hot = F.col("id") % 3 == 0
    rows = spark.range(0, n, 1, 8).select(
        F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("S"), F.col("id") % 5000)).alias("spacer_seq"),
        F.when(hot, F.lit("G")).otherwise(F.concat(F.lit("G"), F.col("id") % 50)).alias("gcf"),
        F.when(hot, F.lit("T")).otherwise(F.concat(F.lit("T"), F.col("id") % 700)).alias("target_id"),
        F.col("id").alias("position"),
        F.md5(F.col("id").cast("string")).alias("alignment_seq"),
    )
    return rows.join(F.broadcast(base)).select(*names)


def test_a_spacer_with_a_third_of_the_hits_is_split(spark, tmp_path):
    path = str(tmp_path / "hits")
    skewed(spark).write.parquet(path)
    df = spark.read.parquet(path)
    with settings(spark, **SKEW):
        selected = select_hits(df)
        plan = executed_plan(selected)
        assert "skew=true" in plan
        assert selected.filter("spacer_seq = 'HOT'").count() == (40_000 + 2) // 3


def test_lookup_of_a_frequent_target_is_split(spark, tmp_path):
    skewed(spark).select("target_id", "alignment_seq", "position").write.parquet(str(tmp_path / "h"))
    spark.range(700).select(F.concat(F.lit("T"), "id").alias("target_id"), F.lit("x").alias("phage")).write.parquet(
        str(tmp_path / "t"))
    with settings(spark, **SKEW):
        joined = add_targets(spark.read.parquet(str(tmp_path / "h")), spark.read.parquet(str(tmp_path / "t")))
        assert "skew=true" in executed_plan(joined)


def test_host_target_stats_of_a_frequent_pair_are_split(spark, tmp_path):
    skewed(spark).write.parquet(str(tmp_path / "h"))
    with settings(spark, **SKEW):
        assert "skew=true" in executed_plan(add_host_target_stats(spark.read.parquet(str(tmp_path / "h"))))


def test_rules_use_no_python_no_windows_and_no_cross_joins(spark):
    with settings(spark, **SHUFFLED_JOINS):
        plan = executed_plan(collapse_targets(select_hits(skewed(spark, 200))))
    assert not re.search(r"Python|Cartesian|NestedLoop.*Cross|Window", plan)
    assert "ReusedExchange" in plan


def test_first_rows_are_picked_before_the_shuffle(spark):
    df = skewed(spark, 200)
    for result in (dedupe_spacers(df), host_target_representatives(
            df.select("gcf", "target_gca", "target_id", "score", "nucleoid_forming"))):
        plan = executed_plan(result)
        final = plan[:plan.find("Initial Plan")] if "Initial Plan" in plan else plan
        # From the top: the limit over whole groups, the exchange, and below it the limit within each task.
        lines = final.splitlines()
        whole = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Final" in x)
        exchange = next(i for i, x in enumerate(lines) if i > whole and "Exchange hashpartitioning" in x)
        partial = next(i for i, x in enumerate(lines) if i > whole and "WindowGroupLimit" in x and "Partial" in x)
        assert whole < exchange < partial


def test_score_table_reads_only_what_it_counts(spark, tmp_path):
    path = str(tmp_path / "hits")
    collapse_targets(select_hits(skewed(spark, 300))).write.parquet(path)
    plan = executed_plan(score_table(dedupe_spacers(spark.read.parquet(path)), headings=["TypeIE_non-shuffled"]))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert not {"position", "strand", "alignment_seq", "shell_id"} & {c.split(":")[0] for c in read.split(",")}
    assert "MapSort" not in plan
