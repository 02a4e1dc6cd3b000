"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protomatch.sources.staging import SharedStage


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``."""
    return SharedStage(spark).root


def written(table: DataFrame, folder: str, name: str) -> DataFrame:
    """The table as written to the folder and read back: later steps do not depend on executors' disks."""
    path = f"{folder}/{name}"
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
