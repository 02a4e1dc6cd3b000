import random

import numpy as np
import pytest

from protomatch.llm import quality_cnn
from protomatch.llm.quality_cnn import STEP, WIDTH, _chunks, fit, fit_on, score_documents, score_text
from tests.llm.helpers import documents, odd_rows, prose


def labelled(rng, n):
    good = [(prose(rng, rng.randint(20, 80)), 1) for _ in range(n)]
    return good + [(" ".join(w + rng.choice(["***", "$$$", "!!"]) for w in prose(rng, rng.randint(20, 80)).split()), 0) for _ in range(n)]


@pytest.fixture(scope="module")
def network():
    data = labelled(random.Random(1), 150)
    return fit([t for t, _ in data], [y for _, y in data])


def test_held_out_accuracy(network):
    data = labelled(random.Random(2), 100)
    assert sum((score_text(network, t) >= 0.5) == y for t, y in data) >= 190


@pytest.mark.parametrize("n", [0, 1, WIDTH - 1, WIDTH, WIDTH + 1, WIDTH + STEP, 1000])
def test_every_byte_is_in_a_chunk(n):
    data = np.arange(n) % 250
    chunks = _chunks(data)
    back = np.concatenate([chunks[0], *(c[WIDTH - STEP:] for c in chunks[1:])])
    assert (back[:n] == data).all() and (back[n:] == quality_cnn.PAD).all()


def test_pieces_give_the_score_of_the_whole(network, monkeypatch):
    text = prose(random.Random(3), 4000)
    whole = score_text(network, text)
    monkeypatch.setattr(quality_cnn, "PIECE", 1024)
    assert score_text(network, text) == pytest.approx(whole, abs=1e-4)


def test_odd_rows_labels_and_empty_tables(spark, network):
    got = score_documents(documents(spark, odd_rows(), clashes=True), network).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, odd_rows())
    one = fit_on(docs, labels)
    assert score_text(one, "anything") > 0.99
    assert score_text(fit_on(docs, labels.limit(0)), "anything") == 0.5
    assert score_documents(documents(spark, []), network).count() == 0


def long_texts(rng, n):
    """Texts of some 6 to 20 kB; those of label 0 hold a few marks, all in one short passage somewhere."""
    data = []
    for k in range(n):
        words = prose(rng, rng.randint(1000, 3000)).split()
        at = rng.randrange(len(words) - 5)
        if k % 2 == 0:
            words[at:at + 5] = [w + "$$$" for w in words[at:at + 5]]
        data.append((" ".join(words), k % 2))
    return data


def test_held_out_long_texts_are_fitted_and_scored_whole():
    train, held_out = long_texts(random.Random(4), 200), long_texts(random.Random(5), 100)
    net = fit([t for t, _ in train], [y for _, y in train])
    assert sum((score_text(net, t) >= 0.5) == y for t, y in held_out) >= 90


def test_gradient_does_not_depend_on_the_pieces(network, monkeypatch):
    text, found = prose(random.Random(6), 2000), []
    for piece in (1 << 16, 1024):
        monkeypatch.setattr(quality_cnn, "PIECE", piece)
        g = {k: np.zeros_like(getattr(network, k)) for k in ("weights", "bias", "out", "out_bias")}
        quality_cnn._add_gradient(network, text, 1.0, g)
        found.append(g)
    for k in found[0]:
        assert np.allclose(found[0][k], found[1][k], atol=1e-4)
