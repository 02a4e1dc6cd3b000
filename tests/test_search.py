"""The seed search and the shuffled control against direct computation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import executed_plan, rows_of, settings
from protomatch.operators.control import length_class, shuffle_sequences
from protomatch.operators.search import SearchSettings, query_extent, search
from protomatch.plans import search_with_control

COLUMNS = ["spacer_id", "target_id", "strand", "position", "details", "mismatches", "gaps", "alignment_seq",
           "alignment_length"]


def brute_force(queries, targets, seed, identity, both_strands=True):
    found = set()
    turn = str.maketrans("ACGT", "TGCA")
    for qid, seq in queries:
        strands = [("+", seq.upper())]
        if both_strands:
            strands.append(("-", seq.upper().translate(turn)[::-1]))
        for strand, q in strands:
            n = len(q)
            for tid, target in targets:
                t = target.upper()
                for p in range(len(t) - n + 1):
                    window = "".join(c if c in "ACGT" else "N" for c in t[p:p + n])
                    same = [a == b and a in "ACGT" for a, b in zip(q, window)]
                    seeded = any(all(same[i:i + seed]) for i in range(n - seed + 1))
                    wrong = n - sum(same)
                    if seeded and wrong * 100 <= (100 - identity) * n:
                        found.add((qid, tid, strand, p + 1, f"{n}M", float(wrong), 0.0, window, float(n)))
    return sorted(found)


def random_case(rng, lengths, n_targets=4, target_length=400):
    letters = "ACGT"
    targets = [(f"t{i}", "".join(rng.choice(letters) for _ in range(target_length))) for i in range(n_targets)]
    targets.append(("low", "A" * 90 + "N" * 5 + "ACGTR" * 8))
    targets.append(("short", "ACG"))
    queries = []
    for i, n in enumerate(lengths):
        _, t = rng.choice(targets[:n_targets])
        start = rng.randrange(len(t) - n)
        q = list(t[start:start + n])
        for _ in range(rng.randrange(0, n // 6 + 1)):
            q[rng.randrange(n)] = rng.choice(letters + "N")
        q = "".join(q)
        if i % 2:
            q = q.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        queries.append((f"q{i}", q))
    queries += [("tiny", "ACGTA"), ("poly", "a" * 12), ("edge", targets[0][1][:20]), ("end", targets[0][1][-20:])]
    return queries, targets


@pytest.mark.parametrize("options", [
    {}, {"tile": 16}, {"broadcast_bytes": 0}, {"seed": 5, "identity": 90}, {"both_strands": False, "tile": 64},
])
def test_search_finds_exactly_what_brute_force_finds(spark, options):
    rng = random.Random(7)
    queries, targets = random_case(rng, [20, 28, 32, 33, 49, 50, 71, 100])
    q = spark.createDataFrame(queries, "spacer_id string, seq string")
    t = spark.createDataFrame(targets, "target_id string, seq string")
    used = SearchSettings(**options)
    assert rows_of(search(q, t, used), *COLUMNS) == sorted(
        brute_force(queries, targets, used.seed, used.identity, used.both_strands),
        key=lambda r: tuple((v is None, str(v)) for v in r))


def test_queries_of_very_unlike_lengths_and_blocks_of_queries(spark):
    rng = random.Random(17)
    queries, targets = random_case(rng, [20, 40, 70, 71, 150, 400, 900, 2000], n_targets=2, target_length=2600)
    q = spark.createDataFrame(queries, "spacer_id string, seq string")
    t = spark.createDataFrame(targets, "target_id string, seq string")
    want = sorted(brute_force(queries, targets, 7, 80), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows_of(search(q, t), *COLUMNS) == want
    # Blocks of the query side give the same.
    assert rows_of(search(q, t, SearchSettings(broadcast_bytes=400_000)), *COLUMNS) == want


def test_a_long_query_does_not_widen_the_rows_of_short_ones(spark):
    short = [("a", "ACGTTGCAAC" * 3), ("b", "ACGTTGCAAC" * 6)]
    classes = lambda rows: query_extent(spark.createDataFrame(rows, "spacer_id string, seq string"), SearchSettings())
    assert classes(short) == classes([*short, ("long", "ACGT" * 500)])[:1]
    assert [c.longest for c in classes([*short, ("long", "ACGT" * 500)])] == [60, 2000]


def test_exact_copies_are_always_found(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    t = spark.createDataFrame([("t", seq)], "target_id string, seq string")
    starts = [0, 1, 505, 510, 512, 1020, 2968]
    q = spark.createDataFrame([(str(s), seq[s:s + 32]) for s in starts], "spacer_id string, seq string")
    found = search(q, t).filter("mismatches = 0 and strand = '+'")
    assert rows_of(found, "position") == sorted([(s + 1,) for s in starts], key=lambda r: str(r))


def test_large_query_sides_join_by_shuffle_on_the_seed_word(spark):
    queries, targets = random_case(random.Random(3), [30, 30])
    q = spark.createDataFrame(queries, "spacer_id string, seq string")
    t = spark.createDataFrame(targets, "target_id string, seq string")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = executed_plan(search(q, t, SearchSettings(broadcast_bytes=0)))
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "BroadcastHashJoin" in executed_plan(search(q, t))


def test_settings_are_checked():
    with pytest.raises(ValueError):
        SearchSettings(seed=22)
    with pytest.raises(ValueError):
        SearchSettings(identity=0)


@pytest.mark.parametrize("key", ["xxhash64", "md5"])
def test_shuffle_keeps_composition_and_repeats(spark, key):
    source = [("a", "ACGTNNACGT" * 5), ("b", ""), ("c", None), ("d", "ACGTNNACGT" * 5)]
    df = spark.createDataFrame(source, "target_id string, seq string")
    first = {r.target_id: r.seq for r in shuffle_sequences(df, "target_id", key=key).collect()}
    again = {r.target_id: r.seq for r in shuffle_sequences(df.repartition(5), "target_id", key=key).collect()}
    other = {r.target_id: r.seq for r in shuffle_sequences(df, "target_id", seed=7, key=key).collect()}
    assert first == again and first["a-shuffled"] != other["a-shuffled"]
    assert first["a-shuffled"] != first["d-shuffled"]
    assert sorted(first["a-shuffled"]) == sorted(source[0][1]) and first["a-shuffled"] != source[0][1]
    assert first["b-shuffled"] == "" and first["c-shuffled"] is None


@pytest.mark.parametrize("key", ["xxhash64", "md5"])
def test_long_sequences_are_permuted_alike_in_buckets(spark, key):
    rng = random.Random(5)
    long = "".join(rng.choice("ACGTN") for _ in range(9000))
    source = [("a", long), ("a", long), ("a", long[::-1]), (None, long), ("short", "ACGT" * 5), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(source, "target_id string, seq string")
    whole = rows_of(shuffle_sequences(df, "target_id", key=key, long_from=None))
    assert rows_of(shuffle_sequences(df, "target_id", key=key, long_from=5000)) == whole
    assert len(whole) == len(source)


def test_length_classes_split_at_the_cut(spark):
    df = spark.createDataFrame([(149_999,), (150_000,), (None,)], "target_length bigint")
    assert rows_of(length_class(df), "target_length", "size_class") == [
        (149_999, "<150kb"), (150_000, ">150kb"), (None, None)]


def test_the_control_is_searched_like_the_targets(spark):
    queries, targets = random_case(random.Random(9), [24, 24])
    q = spark.createDataFrame(queries, "spacer_id string, seq string")
    t = spark.createDataFrame(targets, "target_id string, seq string")
    found = search_with_control(q, t)
    assert rows_of(found.filter("run = 'non-shuffled'"), *COLUMNS) == rows_of(search(q, t), *COLUMNS)
    control = search(q, shuffle_sequences(t, "target_id"))
    assert rows_of(found.filter("run = 'shuffled'"), *COLUMNS) == rows_of(control, *COLUMNS)


def test_words_are_shifted_out_of_pieces(spark):
    from protomatch.operators.search import WORD, _pieces, _word_array

    digits = ["0123454321" * n + "35" for n in (3, 4, 9)] + ["5" * WORD, "4" * (2 * WORD)]
    table = spark.createDataFrame([(d,) for d in digits], "digits string").select(
        "digits", F.length("digits").alias("width"), _pieces(F.col("digits")).alias("pieces"))
    for row in table.select("digits", _word_array(F.col("pieces"), F.col("width")).alias("words")).collect():
        assert row["words"] == [int(row["digits"][i:i + WORD], 8) for i in range(len(row["digits"]) - WORD + 1)]


def test_a_target_letter_is_not_converted_once_per_word(spark):
    from protomatch.operators.search import target_words

    targets = spark.createDataFrame([("t", "ACGT" * 30)], "target_id string, seq string")
    plan = target_words(targets, SearchSettings(), 3)._jdf.queryExecution().optimizedPlan().toString()
    # Digits become numbers in pieces that lie end to end; words are shifts of these.
    assert plan.count("conv(") == 1 and "shiftleft(" in plan


def test_what_the_letters_of_a_control_sequence_share_is_made_once(spark):
    targets = spark.createDataFrame([("t", "ACGTN" * 5), ("v", "AC"), ("u", None)], "target_id string, seq string")
    plan = shuffle_sequences(targets, "target_id", key="md5", long_from=None)._jdf.queryExecution().optimizedPlan().toString()
    # Below the spreading, not in the function applied to each letter.
    assert plan.index("concat_ws(") > plan.index("Repartition")
    long = shuffle_sequences(targets, "target_id", key="md5", long_from=3)
    assert rows_of(long, "target_id", "seq") == rows_of(shuffle_sequences(targets, "target_id", key="md5"), "target_id", "seq")
