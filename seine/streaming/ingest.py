"""Continuous ingest of page files: each micro-batch is parsed and appended; the index is built from the folder by seine.plans.build."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from seine.functions.html import extract_text_udf
from seine.sources.pages import read_pages


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append url, path, content and extracted text of new page files to a Parquet folder, then stop when all are read."""
    rows = read_pages(spark, folder, stream=True).where("content is not null")
    rows = rows.withColumn("text", extract_text_udf("content")["text"])
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
