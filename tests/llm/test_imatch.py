import hashlib
import random

import pytest

from protomatch.llm.imatch import codes_of, decoded, document_frequencies, edited, fingerprint_documents, lexicon, likeness, terms_of
from tests.llm.helpers import documents, odd_rows, prose


def test_edited_texts_next_documents_and_likeness(spark):
    rng = random.Random(2)
    words = prose(rng, 400).split()
    rows = [(k * 3, " ".join(rng.choice(words) for _ in range(rng.randint(120, 300))), None, None, None) for k in range(80)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprint_documents(documents(spark, rows)).collect()}
    order = sorted(rows)
    assert sorted(got) == [r[0] for r in order]
    for k, (i, text, *_) in enumerate(order):
        following = order[(k + 1) % len(order)]
        row = got[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited(text, following[1]).encode()).hexdigest()
        assert row["near_next"] == pytest.approx(likeness(decoded(row["fingerprint"]), decoded(got[following[0]]["fingerprint"])))
        assert row["near_edited"] == pytest.approx(likeness(decoded(row["fingerprint"]), decoded(row["edited_fingerprint"])))
    near = sum(r["near_edited"] for r in got.values()) / len(got)
    far = sum(r["near_next"] for r in got.values()) / len(got)
    assert near > far + 0.2


def test_lexicon_is_the_band_of_document_frequencies(spark):
    rows = [(k, f"all half{k % 2} rare{k} twice{k // 2} twice{k // 2}", None, None, None) for k in range(40)]
    docs = documents(spark, rows)
    counts = {r["code"] % 2**64: r["df"] for r in document_frequencies(docs).collect()}
    brute = {t: sum(t in terms_of(r[1]) for r in rows) for r in rows for t in terms_of(r[1])}
    assert counts == {int(codes_of([t])[0]): n for t, n in brute.items()}
    band = [t for t, n in brute.items() if 2 <= n <= 20]
    assert lexicon(docs, low=0.05, high=0.5).tolist() == sorted(codes_of(band).tolist())


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = odd_rows()
    got = fingerprint_documents(documents(spark, rows, clashes=True)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    assert sum(r["n_chars"] for r in got) == sum(len(r[1] or "") for r in rows)
    assert fingerprint_documents(documents(spark, [])).count() == 0
    one = fingerprint_documents(documents(spark, [(1, "only one document here", None, None, None)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
