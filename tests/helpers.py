"""Small builders shared by the tests."""

from __future__ import annotations

from contextlib import contextmanager

from protomatch.sources.schemas import NUCLEOID_COLUMNS

SELECT_SCHEMA = (
    "system string, target_database string, run string, shuffled string, spacer_seq string, gcf string, crispr string, "
    "spacer string, shared_spacer string, details string, mismatches double, alignment_length double, strain string, "
    "target_id string, target_gca string, phage string, target_length bigint, target_completeness double, "
    "score double, strand string, position bigint, alignment_seq string, "
    + ", ".join(f"{c} string" for c in NUCLEOID_COLUMNS)
)
_DEFAULTS = {
    "system": "TypeIE", "target_database": "gb>150kb", "run": "non-shuffled", "shuffled": "non-shuffled",
    "spacer_seq": "ACGT", "gcf": "G1", "crispr": "1", "spacer": "1", "shared_spacer": None, "details": "q",
    "mismatches": 0.0, "alignment_length": 30.0, "strain": "s", "target_id": "T1", "target_gca": "C1", "phage": "p",
    "target_length": 1000, "target_completeness": 100.0, "score": 30.0, "strand": "+", "position": 1,
    "alignment_seq": "ACGT", **{c: None for c in NUCLEOID_COLUMNS}, "nucleoid_forming": "nonNF",
}


def hits(spark, *rows):
    """Classified hits from partial rows."""
    names = [f.split()[0] for f in SELECT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**_DEFAULTS, **r}[n] for n in names) for r in rows], SELECT_SCHEMA)


def rows_of(df, *columns):
    """Rows as a sorted list of tuples, missing values comparable."""
    table = [tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()]
    return sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def executed_plan(df):
    """Text of the final plan after running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
