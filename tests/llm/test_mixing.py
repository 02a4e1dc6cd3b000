import random
from collections import Counter
from fractions import Fraction
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from protomatch.llm.mixing import DEPTH, PARTS, given_shares, mix_sources, parts_before, schedule, slot_of, tempered_shares
from tests.llm.helpers import documents, odd_rows, rows_of


def edf(a, b, slots):
    """Two halves by hand: the released block with the earliest deadline, ties to the first one. Gives each slot's half."""
    total, done, out = a + b, [0, 0], []
    for slot in range(slots):
        ready = [h for h, share in enumerate((a, b)) if done[h] * total // share <= slot]
        best = min(ready, key=lambda h: (Fraction((done[h] + 1) * total, (a, b)[h]), h))
        assert slot + 1 <= -(-(done[best] + 1) * total // (a, b)[best])
        out.append(best)
        done[best] += 1
    return out


def walk(names, slots):
    """The schedule by hand: every node of the tree of halvings steps through its own slots. ``names``: (name, share) along the line."""
    total, before, places = sum(w for _, w in names), 0, []
    for name, w in names:
        places.append((name, w, (2 * before + w, 2 * total)))
        before += w

    def run(members, depth, n):
        if len(members) == 1:
            return [members[0][0]] * n
        sides = [[m for m in members if (m[2][0] << depth + 1) // m[2][1] % 2 == k] for k in (0, 1)]
        if not all(sides):
            return run(members, depth + 1, n)
        own = [sum(w for _, w, _ in side) for side in sides]
        order = edf(*own, n)
        inner = [iter(run(side, depth + 1, order.count(k))) for k, side in enumerate(sides)]
        return [next(inner[k]) for k in order]

    return run(places, 0, slots)


def along_the_line(shares):
    return sorted(shares.items(), key=lambda x: (md5(x[0].encode()).hexdigest(), x[0]))


@pytest.mark.parametrize("shares", [
    {"a": 1}, {"a": 3, "b": 1, "c": 2}, {"a": 17, "b": 5, "c": 5, "d": 1}, {f"s{k}": 1 for k in range(7)},
    {f"s{k}": 3 ** (k % 9) for k in range(30)}, {"a": 999_983, "b": 7, "c": 1_000_003, "d": 1},
])
def test_schedule_is_earliest_deadline_first_at_every_node_and_stays_within_a_block(spark, shares):
    slots = 3000
    want = walk(along_the_line(shares), slots)
    table = spark.createDataFrame(list(shares.items()), "mix_source string, share long")
    paths = schedule(table).crossJoin(spark.range(slots).withColumnRenamed("id", "j"))
    got = paths.select("mix_source", slot_of("j").alias("slot"), "j", parts_before("j").alias("had")).collect()
    assert all(want[r["slot"]] == r["mix_source"] for r in got if r["slot"] < slots)
    counts = Counter(want)
    assert Counter(r["mix_source"] for r in got if r["slot"] < slots) == counts
    had = {(r["mix_source"], r["j"]): r["had"] for r in got}
    seen, total = Counter(), sum(shares.values())
    for at, source in enumerate(want):
        assert all(seen[s] == had[s, at] for s in shares)
        seen[source] += 1
        assert all(abs(seen[s] - (at + 1) * w / total) < PARTS for s, w in shares.items())


def deviation(weights):
    """Sum of the source's part of every node below a real halving, the largest over all sources."""
    total, before, cells, nodes = sum(weights), 0, [], Counter()
    for w in weights:
        cells.append([((2 * before + w) << d) // (2 * total) for d in range(DEPTH + 1)])
        before += w
        for d, c in enumerate(cells[-1]):
            nodes[d, c] += w
    return max(
        sum(w / nodes[d, c[d]] for d in range(1, DEPTH + 1) if nodes[d, c[d]] < nodes[d - 1, c[d - 1]]) for w, c in zip(weights, cells))


def test_bound_of_the_deviation_for_unlike_weights():
    rng = random.Random(3)
    worst = 0
    for _ in range(300):
        spread = rng.choice([1, 4, 12, 24])
        worst = max(worst, deviation([max(1, int(2 ** (rng.random() * spread))) for _ in range(rng.choice([2, 3, 8, 20, 200]))]))
    weights = [max(1, int(2 ** (rng.random() * 20))) for _ in range(12)]
    for _ in range(3000):  # climbs towards bad cases
        tried = [*weights]
        k = rng.randrange(len(tried))
        tried[k] = max(1, int(tried[k] * 2 ** rng.uniform(-1.5, 1.5)))
        if sum(tried) < 2 ** 29 and deviation(tried) >= deviation(weights):
            weights = tried
    assert max(worst, deviation(weights)) < PARTS - 1


def test_a_tiny_source_keeps_its_target(spark):
    sizes = spark.range(19_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("big"), F.col("id") % 19).alias("source"), F.lit(60_000).alias("n"))
    tiny = spark.createDataFrame([(-1, "tiny", 30_000)], "doc_id long, source string, n int")
    docs = sizes.unionByName(tiny)
    shares = tempered_shares(docs, size_col="n")
    mixed = mix_sources(docs.withColumn("text", F.lit("")), shares, size_col="n").cache()
    assert mixed.where("source <> 'tiny'").groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    weights = {r["mix_source"]: r["share"] for r in shares.collect()}
    target = weights["source tiny"] / sum(weights.values()) * (mixed.agg(F.max("mix_slot")).first()[0] + 1)
    copies = mixed.where("source = 'tiny'").count()
    # The document fills four slots.
    assert abs(copies - target / 4) <= PARTS / 4 + 1 and copies < 12


def test_thousands_of_sources(spark):
    docs = spark.range(15_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5000).alias("source"), (F.col("id") % 97 * 11 + 1).alias("n"), F.lit("").alias("text"))
    shares = tempered_shares(docs, size_col="n", least_bytes=64)
    mixed = mix_sources(docs, shares, size_col="n", block_bytes=64 * PARTS).cache()
    assert mixed.select("doc_id").distinct().count() == 15_000
    slots = mixed.select("mix_slot", "source").distinct()
    assert slots.count() == slots.select("mix_slot").distinct().count()
    paths = schedule(shares).select(F.size("path").alias("n")).agg(F.max("n")).first()[0]
    assert paths <= DEPTH


def test_all_documents_are_there_and_prefixes_keep_the_weights(spark):
    rows = [(k, "x" * (50 + k % 7), "en", "big" if k % 3 else f"s{k % 4}", 1) for k in range(900)]
    docs = documents(spark, rows)
    mixed = mix_sources(docs, given_shares(docs, {"big": 4}), block_bytes=256).collect()
    assert {r["doc_id"] for r in mixed} == set(range(900))
    blocks = {(r["mix_slot"], r["source"]) for r in mixed}
    assert len({s for s, _ in blocks}) == len(blocks)  # one source per slot
    shares = {"source big": 4} | {f"source s{k}": 1 for k in range(4)}
    want = walk(along_the_line(shares), max(s for s, _ in blocks) + 1)
    assert all(want[slot] == f"source {source}" for slot, source in blocks)
    whole = Counter((r["source"], r["mix_copy"]) for r in mixed)
    assert whole["big", 0] == 600


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    docs = documents(spark, odd_rows(), clashes=True)
    mixed = mix_sources(docs, tempered_shares(docs))
    assert mixed.columns == [*docs.columns, "mix_slot", "mix_block", "mix_copy"]
    sized = docs.select("doc_id", "text", "source", F.octet_length("text").alias("n"))
    by_size = mix_sources(sized, tempered_shares(sized, size_col="n"), size_col="n")
    assert rows_of(by_size, "doc_id", "mix_slot", "mix_copy") == rows_of(mixed, "doc_id", "mix_slot", "mix_copy")
    once = mixed.where("mix_copy = 0").select("doc_id", "text", "source")
    assert rows_of(once) == rows_of(docs, "doc_id", "text", "source")
    empty = documents(spark, [])
    assert mix_sources(empty, tempered_shares(empty)).count() == 0
    with pytest.raises(ValueError):
        given_shares(docs, {"a": 0})
    with pytest.raises(ValueError):
        mix_sources(mixed, tempered_shares(docs))


def test_no_python_in_the_plan_and_no_source_in_one_task(spark):
    docs = documents(spark, odd_rows())
    plan = mix_sources(docs, tempered_shares(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "range_" in plan and "part_" in plan
