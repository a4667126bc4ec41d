"""Source files stored once as a table, the form to audit at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from repoaudit.functions import paths


def write_source_files(files: DataFrame, path: str) -> None:
    """Store ``(repo, path, content)`` as parquet, partitioned by the kind of file.

    Each check then reads only the partitions of the kinds it looks at. The files arrive
    spread over all tasks, whatever their repository, so content is not shuffled here.
    """
    kinds = files.withColumn("kind", paths.kind(F.col("path")))
    kinds.write.partitionBy("kind").mode("errorifexists").parquet(path)


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
