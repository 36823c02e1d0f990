"""Scripts as they come: the same kernel under Structured Streaming. It keeps no state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptmill.operators.rewrite import rewrite_scripts


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rewrite_stream(stream: DataFrame, path: str, checkpoint: str, source: str = "source", presets: str = "generic") -> StreamingQuery:
    """Append rewritten rows to a Parquet table; the checkpoint makes each input row count once."""
    own = rewrite_scripts(stream, source, presets)
    return own.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
