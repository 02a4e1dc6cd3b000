import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protomatch.llm import lexical_search
from protomatch.llm.lexical_search import _from_varints, _varints, build_index, rank_documents, search_index, terms_of
from protomatch.llm.staging import shared_folder, written
from tests.llm.helpers import documents, odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(FOLD))), []
        for i, c, length in held:
            m = 25 + 75 * length * n // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [prose(rng, 1) for _ in range(60)] + ["the", "of", "and"] * 20
    rows = [(rng.choice([k, k, k, None]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for k in range(n)]
    items = [(k, " ".join(rng.choice([*words, "unheard"]) for _ in range(rng.randint(1, 30)))) for k in range(12)]
    items += [(20, rows[7][1]), (20, rows[7][1]), (None, "the the the of"), (21, ""), (22, None), (23, "unheard"), (24, "The, OF; and!")]
    return [*rows, *rows[:20]], items


def ranked(spark, rows, items, **options):
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows])
    queries = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in rank_documents(docs, queries, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 1), max_size=50))
def test_variable_length_numbers_come_back(values):
    data, ends = _varints(np.array(values, np.int64))
    assert _from_varints(data).tolist() == values and len(ends) == len(values)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_terms_are_those_of_the_expression(text):
    assert [t.decode() for t in terms_of(text)] == TERM.findall(text.translate(FOLD))


def test_equals_brute_force(spark):
    rows, items = corpus(1)
    assert ranked(spark, rows, items) == brute(rows, items)


def test_small_blocks_ranges_shards_and_few_results(spark, monkeypatch):
    for name, value in {"SHARD_BYTES": 4000, "BLOCK": 3, "RANGE": 5}.items():
        monkeypatch.setattr(lexical_search, name, value)
    rows, items = corpus(2)
    assert ranked(spark, rows, items) == brute(rows, items)
    assert ranked(spark, rows, items, k=2) == brute(rows, items, k=2)


def test_passes_give_the_same(spark):
    rows, items = corpus(3, n=80)
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows])
    index = written(build_index(docs), shared_folder(spark), "index")
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = search_index(index, queries, pass_terms=20).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, items)


def test_blocks_of_weak_lists_are_mostly_left_compressed(monkeypatch):
    """A rare term decides; the frequent one is read only where its document is."""
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    shard = lexical_search._Shard()
    for k in range(4000):
        shard.add(k, "common filler words" + (" rare" * 3 if k % 400 == 7 else ""))
    table = shard.rows(0).to_pandas()
    header, rows = table.iloc[0], table.iloc[1:].set_index("term")
    lengths = np.frombuffer(header["postings"], np.int32).astype(np.int64)
    norms = 25 + 75 * 4000 * lengths // int(header["places"])
    lists = {t: lexical_search._List(r["meta"], r["postings"], norms, 25, 75 * 4000, int(header["places"])) for t, r in rows.iterrows()}
    docs, _ = lexical_search.best_of_shard([(1, lists["common"]), (8000, lists["rare"])], 4000, 3)
    assert docs.tolist() == [7, 407, 807]
    assert len(lists["common"].blocks) <= 64 + 10 < len(lists["common"].lasts)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows_clashing_columns_and_empty_tables(spark, clashes):
    rows = odd_rows()
    items = [(1, "same text row"), (2, "𝔘nicode ß x"), (3, rows[3][1][:200]), (3, None)]
    docs = documents(spark, rows, clashes)
    queries = spark.createDataFrame(items, "item_id long, text string")
    if clashes:
        from pyspark.sql import functions as F

        queries = queries.withColumns({c: F.lit("extra") for c in ("query", "term", "rank", "score", "shard", "name", "doc_id")})
    found = rank_documents(docs, queries).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute([(r[0], r[1]) for r in rows], items)
    assert rank_documents(documents(spark, []), queries).count() == 0
    assert rank_documents(docs, queries.limit(0)).count() == 0
