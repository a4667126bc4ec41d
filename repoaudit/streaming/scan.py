"""Security scan of a stream of source files.

The scan looks at one file at a time and keeps no state, so the batch function runs on a
stream as it is, with append output and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from repoaudit.operators.security import scan_security
from repoaudit.schemas import SOURCE_FILES


def stream_source_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that land as parquet below a folder."""
    return spark.readStream.schema(SOURCE_FILES).parquet(path)


def write_findings(
    files: DataFrame, path: str, checkpoint: str, rules=None, trigger: dict | None = None
) -> StreamingQuery:
    """Start the scan; by default it takes what is there and ends."""
    findings = scan_security(files, rules)
    return (
        findings.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
