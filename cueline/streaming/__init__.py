"""Model responses as a stream.

The normalisers are row-wise, so they run on a stream as on a table; this is the one
place where rows arrive one by one, while a responder works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from cueline.operators import responses

KINDS = {"commentary": responses.commentary, "visual": responses.visual, "fusion": responses.fusion, "metadata": responses.metadata}


def read_responses(spark: SparkSession, path: str, schema: str = "media_id bigint, rank int, attempt int, raw_text string") -> DataFrame:
    """Stream of response rows from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def normalise_stream(rows: DataFrame, kind: str) -> DataFrame:
    """Typed rows of one kind of response."""
    return KINDS[kind](rows)


def write_rows(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append typed rows to a folder, each once; start it with start()."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
