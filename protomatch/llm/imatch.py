"""Document fingerprints after I-Match, with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band, so that
neither words that every text has nor words that only one text has count. A text
is reduced to its distinct terms of the lexicon. Each of many random subsets of the
lexicon picks some of them; those are sorted and hashed. Changing a text changes
only the hashes of subsets that hold a changed term.

Subsets come in scales: a subset of scale s holds a term with probability 4**-s. A
text keeps the two scales at which a subset picks about one of its terms or fewer, as
larger subsets of a text hardly survive an edit. The likeness of two fingerprints is the share of
equal hashes among the subsets that pick something from either text, over the scales
both have (none in common: sizes differ by far, likeness 0).

A term of the lexicon is in at least ``low`` of all documents, so the lexicon has at
most (mean distinct terms per document) / ``low`` entries whatever the number of
documents; it is broadcast.

Defined cases: a null text is an empty one. A text without terms of the lexicon is
represented by all its terms, one without any terms by itself as a whole, and those
never look like others unless equal. Documents are in ascending order of id, then of
a digest of the text; those without an id come first. Repeated rows are documents of
their own. In a table of one document the next document is the same one. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH = 0.001, 0.25
HASHES, KEPT_BUCKETS = 4, 64
SEEDS = np.array([0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(HASHES)], np.uint64)
TERM = re.compile(r"\w+")
FLUSH = 200_000
RANGE_BYTES = 16 << 20
NO_ID = -(2**63)

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def terms_of(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def codes_of(terms: Iterable[str]) -> np.ndarray:
    """64-bit digests of terms, which stand for them from here on."""
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)


def document_frequencies(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``code``, ``df``: documents that have the term with this digest; counted in the task before they are shuffled."""

    def counted(seen: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame({"code": codes_of(seen).view(np.int64), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(terms_of(text))
                if len(seen) >= FLUSH:
                    yield counted(seen)
                    seen.clear()
        yield counted(seen)

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, *, low: float = LOW, high: float = HIGH, text_col: str = "text") -> np.ndarray:
    """Sorted digests of the terms in at least ``low`` and at most ``high`` of the documents, from all documents."""
    n_docs = docs.count()
    least, most = max(low * n_docs, 1), max(high * n_docs, 1)
    band = document_frequencies(docs, text_col=text_col).where((F.col("df") >= least) & (F.col("df") <= most))
    return np.sort(np.array([row["code"] for row in band.select("code").collect()], np.int64).view(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def subset_hashes(text: str, band: np.ndarray) -> dict[str, np.ndarray]:
    """Per scale, for each subset that picks a term: its number in the top byte, the hash of its sorted distinct terms below."""
    codes, mark = np.sort(codes_of(terms_of(text))), ""
    known = codes[band[np.minimum(np.searchsorted(band, codes), len(band) - 1)] == codes] if len(band) else codes[:0]
    terms = known
    if not len(known):
        mark, terms = "t", codes
    if not len(terms):
        return {"w" + hashlib.blake2b(text.encode(), digest_size=12).hexdigest(): np.zeros(0, np.uint32)}
    first_scale, out = (len(terms).bit_length() - 1) // 2 + 1, {}
    keys = _mixed(terms[None, :] ^ SEEDS[:, None])
    for scale in (first_scale, first_scale + 1):
        buckets = keys >> np.uint64(64 - 2 * scale)
        row, term = np.nonzero(buckets < KEPT_BUCKETS)
        subset = row.astype(np.uint64) * np.uint64(KEPT_BUCKETS) + buckets[row, term]
        order = np.argsort(subset, kind="stable")
        subset, term = subset[order], term[order]
        starts = np.flatnonzero(np.r_[True, subset[1:] != subset[:-1]]) if len(subset) else np.zeros(0, np.int64)
        # Terms are sorted and distinct inside a subset, so a sum of mixed codes is a digest of the list.
        sums = np.add.reduceat(_mixed(terms[term]), starts) if len(starts) else np.zeros(0, np.uint64)
        out[f"{mark}{scale}"] = ((subset[starts] << np.uint64(24)) | (_mixed(sums) >> np.uint64(40))).astype(np.uint32)
    return out


def encoded(hashes: dict[str, np.ndarray]) -> str:
    """Scales separated by ``|``; in each, eight hexadecimal digits per filled subset."""
    return "|".join(f"{scale}:{h.astype('>u4').tobytes().hex()}" for scale, h in hashes.items())


def decoded(fingerprint: str) -> dict[str, np.ndarray]:
    parts = (x.partition(":") for x in fingerprint.split("|"))
    return {scale: np.frombuffer(bytes.fromhex(h), ">u4").astype(np.uint32) for scale, _, h in parts}


def fingerprint(text: str, band: np.ndarray) -> str:
    return encoded(subset_hashes(text, band))


def likeness(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> float:
    """Share of equal hashes among the subsets that either text fills, 0 to 1."""
    if a.keys() == b.keys() and all(np.array_equal(a[s], b[s]) for s in a):
        return 1.0
    equal = filled = 0
    for scale in a.keys() & b.keys():
        x, y = set(a[scale].tolist()), set(b[scale].tolist())
        same, subsets = len(x & y), len({k >> 24 for k in x} | {k >> 24 for k in y})
        equal, filled = equal + same, filled + subsets
    return equal / filled if filled else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many characters from the start of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _in_ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows by ranges of ids, each range with a copy of the row that follows its last one (``guest``).

    The driver sees one id per range. Returns the rows partitioned by range and sorted, and the number of ranges.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(place.alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    quantiles = rows.select(F.col("place").cast("double")).approxQuantile("place", [k / wanted for k in range(1, wanted)], 0.1 / wanted)
    cuts = sorted(set(quantiles))
    # Halving the cuts gives an expression of logarithmic depth.
    def bucket(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("place") < F.lit(cuts[mid]), bucket(lo, mid)).otherwise(bucket(mid + 1, hi))

    rows = rows.withColumn("range_", bucket(0, len(cuts)))
    firsts = rows.groupBy("range_").agg(F.min(F.struct("place", "h")).alias("first")).orderBy("range_").collect()
    guests = [(r["range_"], r["first"]["place"], r["first"]["h"], firsts[k - 1]["range_"]) for k, r in enumerate(firsts)]
    if not guests:
        return rows.withColumn("guest", F.lit(0)), 1
    guest = spark.createDataFrame(guests, "range_ int, place long, h long, to_ int")
    rows = rows.withColumn("guest", F.lit(0)).unionByName(
        rows.where(F.col("place").isin([g[1] for g in guests])).join(F.broadcast(guest), ["range_", "place", "h"])
        .drop("range_").withColumnsRenamed({"to_": "range_"}).withColumn("guest", F.lit(1))
    )
    n = len(cuts) + 1
    return rows.repartitionById(n, F.col("range_")).sortWithinPartitions("range_", "guest", "place", "h"), n


def fingerprint_documents(docs: DataFrame, terms: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text and how like the edited and the next text's are."""
    spark: SparkSession = docs.sparkSession
    terms = lexicon(docs, text_col=text_col) if terms is None else terms
    shared = spark.sparkContext.broadcast(terms)
    rows, _ = _in_ranges(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band, before = shared.value, None
        for batch in batches:
            out = []
            for place, text, group, guest in zip(batch["place"], batch["text"], batch["range_"], batch["guest"], strict=True):
                doc_id = None if place == NO_ID else place
                own = subset_hashes(text, band)
                if before is not None and before[3] == group and not before[4]:
                    old_id, old, old_print = before[:3]
                    changed = edited(old, text)
                    changed_print = subset_hashes(changed, band)
                    out.append((
                        old_id, len(old), hashlib.sha256(changed.encode()).hexdigest(), encoded(old_print), encoded(changed_print),
                        likeness(old_print, changed_print), likeness(old_print, own),
                    ))
                before = (doc_id, text, own, group, guest)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return rows.select("place", "text", "range_", "guest").mapInPandas(run, RESULT)
