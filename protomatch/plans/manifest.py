"""What a run to disk was made from, so that a later run redoes what has changed and nothing else.

Beside the tables of a run lies, for each, a digest of its settings and inputs, for
partitioned ones a digest per partition. Inputs are known by their content: rows
are hashed and the hashes summed, in one pass with map-side combining, so neither the order of rows nor the
files they come from matter, and a repeated row does. Results are known by the digests of what they were made from.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A digest per partition, by the values of the partition columns; () for a table without.
Digests = dict[tuple, str]


def digest(*parts) -> str:
    """One digest of plain values, lists of them and digests of tables."""
    plain = [sorted([list(map(str, k)), v] for k, v in p.items()) if isinstance(p, dict) else p for p in parts]
    return hashlib.sha256(json.dumps(plain, default=str).encode()).hexdigest()


def content_digests(table: DataFrame, keys: Sequence[str] = ()) -> Digests:
    """Digest of the rows and columns of a table, for every combination of ``keys`` that occurs."""
    columns = sorted(table.columns)
    # As text with names, as hashes of columns pass over missing values.
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")).cast("string").alias(f"sum{k}") for k in (1, 2)]
    found = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums).collect()
    shape = [(f.name, f.dataType.simpleString()) for f in sorted(table.schema, key=lambda f: f.name)]
    return {tuple(r[k] for k in keys): digest(shape, r["rows"], r["sum1"], r["sum2"]) for r in found}


def _is_one_of(keys: Sequence[str], parts: Sequence[tuple]) -> Column:
    """Rows of the given partitions."""
    return reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, part, strict=True)], F.lit(True)) for part in parts
    ], F.lit(False))


class Manifest:
    """The digests of the tables below ``out``."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out

    def finished(self, path: str) -> bool:
        """Whether a table was written to its end."""
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def _path(self, name: str) -> str:
        return f"{self.out}/manifest/{name}"

    def known(self, name: str) -> Digests:
        """The digests a table was written with; none if it was not finished."""
        if not self.finished(self._path(name)) or not self.finished(f"{self.out}/{name}"):
            return {}
        text = self.spark.read.text(self._path(name), wholetext=True).first()
        return {tuple(part): d for part, d in json.loads(text["value"])} if text else {}

    def _keep(self, name: str, digests: Digests) -> None:
        row = self.spark.createDataFrame([(json.dumps([[list(p), d] for p, d in digests.items()]),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self._path(name))

    def refresh(
        self, name: str, digests: Digests, build: Callable[[Column | None], DataFrame], write: Callable[..., None], keys: Sequence[str] = (),
    ) -> DataFrame | None:
        """Bring the table ``name`` up to date; gives what was built, or nothing if all of it was.

        ``build`` takes a condition for the rows of the partitions to redo, or nothing for the whole
        table. Partitions that stay are not touched; one that has no input any more means that
        all are written again. While partitions are written they are missing in the
        manifest, so a run that breaks off does them again.
        """
        path, known = f"{self.out}/{name}", self.known(name)
        redo = [p for p, d in digests.items() if known.get(p) != d]
        if known and not redo and set(known) <= set(digests) or not digests and self.finished(path) and self.finished(self._path(name)) and not known:
            return None
        if keys and known and set(known) <= set(digests) and len(redo) < len(digests):
            table = build(_is_one_of(keys, redo))
            self._keep(name, {p: d for p, d in known.items() if p not in redo})
            write(table, path, mode="overwrite", partitions_only=True)
        else:
            table = build(None)
            self._keep(name, {})
            write(table, path, mode="overwrite")
        self._keep(name, digests)
        return table
