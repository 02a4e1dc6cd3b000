"""Tables written between steps, so later steps read files and not a long lineage.

A step whose input is read several times, or that is costly to repeat when an
executor is lost, continues from a table in the folder the cluster shares.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Takes a table and its name, gives the table to go on with.
Stage = Callable[[DataFrame, str], DataFrame]
# Rows of one key that one task may have, however small the fair share of a bucket.
LEAST_SHARE = 1_000_000
# Cells of hashed keys in which rows are counted, to find frequent keys without a count for each.
CELLS = 1 << 16


def lazily(table: DataFrame, name: str) -> DataFrame:
    """Go on without writing anything."""
    return table


def dealt(stage: Stage, table: DataFrame, name: str, by: Sequence[str]) -> tuple[DataFrame, int | None]:
    """The staged table, in buckets if the stage has them."""
    return stage.dealt(table, name, by) if isinstance(stage, SharedStage) else (stage(table, name), None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only when Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="protomatch-"))
    return spark.sparkContext.getCheckpointDir()


class SharedStage:
    """Write each table below a folder of its own and read it back.

    The folder goes when it is discarded, or else when the driver ends.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = f"{root or shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        path, files = self._path()
        files.deleteOnExit(path)

    def __call__(self, table: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        table.write.option("compression", "zstd").parquet(path)
        # With the schema given, an empty table reads back too.
        return self.spark.read.schema(table.schema).parquet(path)

    def dealt(self, table: DataFrame, name: str, by: Sequence[str], least_share: int = LEAST_SHARE) -> tuple[DataFrame, int | None]:
        """Written in buckets of ``by``: the table and the number of its buckets, over which groups and joins need not move it.

        Rows go to the files of their buckets as they come, which takes a fraction of the room of a shuffle. If one key holds more
        rows than the fair share of a bucket, the table is read as if it had none, so that joins can split that key.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, stored = f"{self.root}/{name}", f"stage_{uuid.uuid4().hex}"
        table.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *by).saveAsTable(stored)
        self.tables.append(stored)
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
        cell = F.pmod(F.xxhash64(*by), F.lit(CELLS))
        counts = self.spark.table(stored).filter(known).groupBy(cell.alias("cell")).count().agg(F.max("count"), F.sum("count")).first()
        if counts[0] is not None and counts[0] > max(least_share, counts[1] // buckets):
            return self.spark.read.schema(table.schema).parquet(path), None
        return self.spark.table(stored), buckets

    def discard(self) -> None:
        """Delete the staged tables once no plan reads them any more."""
        for stored in self.tables:
            self.spark.sql(f"drop table if exists {stored}")
        path, files = self._path()
        files.delete(path, True)

    def _path(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
