from collections import Counter

import numpy as np
import pytest

from protomatch.llm.token_output import DTYPE, END, Permutation, export_shards, read_encoding, read_slots, training_shards
from tests.llm.helpers import documents, odd_rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_has_an_inverse(n):
    order = Permutation(n)
    slots = order.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (order.number(slots) == np.arange(n)).all()
    if n > 15:
        assert (slots != Permutation(n, 1).slot(np.arange(n))).any() and (slots != np.arange(n)).any()


def texts_of(data, number_of_slot):
    """Texts from sequences put back in their numbered order."""
    encoding, texts, held = read_encoding(), Counter(), []
    for row in data[np.argsort(number_of_slot)]:
        for token in row.tolist():
            if token == END:
                texts[encoding.decode(held)] += 1
                held = []
            else:
                held.append(token)
    return texts


def test_round_trip_shards_and_resumable_reads(spark, tmp_path):
    rows = odd_rows()
    docs = documents(spark, rows, clashes=True).repartition(3)
    shards = training_shards(docs, length=64, per_shard=50)
    found = sorted(shards.collect(), key=lambda r: r["shard"])
    assert [r["shard"] for r in found] == list(range(len(found)))
    assert all(r["n_sequences"] == 50 for r in found[:-1])
    data = np.frombuffer(b"".join(r["payload"] for r in found), DTYPE).reshape(-1, 64)
    got = texts_of(data, Permutation(len(data)).number(np.arange(len(data))))
    want = Counter(r[1] or "" for r in rows)
    assert all(got[t] == n for t, n in want.items() if t) and got[""] >= want[""]
    assert {i for r in found for i in r["doc_ids"]} == {r[0] for r in rows if r[0] is not None}
    export_shards(shards, str(tmp_path))
    for start in (0, 49, 50, 77):
        assert (np.array(list(read_slots(str(tmp_path), start, length=64, per_shard=50))) == data[start:]).all()


def test_empty_table(spark):
    assert training_shards(documents(spark, [])).count() == 0
