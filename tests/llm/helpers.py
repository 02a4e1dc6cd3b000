"""Small document tables for the operators of the training-data subpackage."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; as extra columns they must not disturb them.
CLASHES = ("row", "found", "size", "key", "slot", "shard", "node", "path", "h", "id", "chunk", "part", "bucket", "guest", "share", "rank", "before")

SYLLABLES = {
    "en": "th er on an in ed nd ha re ea st en to ing tion".split(),
    "fr": "ou eau é è le ai re en ment tion que ier oi ê".split(),
}


def prose(rng: random.Random, n_words: int, lang: str = "en") -> str:
    parts = SYLLABLES[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n_words))


def odd_rows(seed: int = 5) -> list[tuple]:
    """Nulls in every column, empty, tiny and very long texts, repeated rows and equal texts."""
    rng = random.Random(seed)
    long_text = prose(rng, 20_000)
    return [
        (1, prose(rng, 60), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, long_text, "en", "b", None),
        (5, prose(rng, 40, "fr"), "fr", "b", 5), (5, prose(rng, 40, "fr"), "fr", "b", 5), (None, prose(rng, 50), "en", "a", 5), (None, None, None, None, None),
        (7, "same text twice over here", "en", "a", 3), (8, "same text twice over here", "en", "c", 3), (9, "12 34 !!", "en", "c", 3),
        (10, "repeated row", "en", "a", 1), (10, "repeated row", "en", "a", 1), (11, "x", "fr", "a", 1), (12, "𝔘nicode ß İ ÉÈ ñ", "fr", "b", 2),
    ]


def documents(spark, rows, clashes: bool = False):
    frame = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})
    return frame


def rows_of(frame, *columns) -> list[tuple]:
    """Sorted rows, nulls first."""
    found = [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]
    return sorted(found, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
