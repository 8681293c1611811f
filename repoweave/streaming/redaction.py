"""Selection by rule and redaction keep no state, so they run unchanged on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from repoweave.operators.redact import redact


def redact_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Redact files as they arrive and append them as Parquet; stops when caught up."""
    return (
        redact(files).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
