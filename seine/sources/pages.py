"""Page sources and index tables."""

from __future__ import annotations

import json
from urllib.parse import urldefrag

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = "path string, modificationTime timestamp, length long, content binary"
#: Tables of a built index, one Parquet folder each.
TABLES = ("documents", "postings", "terms", "norms", "edges", "pagerank", "status")


def page_of(data: bytes) -> tuple[str | None, str | None]:
    """url and content of a file that holds one JSON object with a url; else nulls. Bytes that are no UTF-8 go."""
    try:
        page = json.loads(data.decode("utf-8", "ignore"))
    except (ValueError, RecursionError):
        return None, None
    url, content = (page.get("url"), page.get("content")) if isinstance(page, dict) else (None, None)
    if not isinstance(url, str) or not url:
        return None, None
    try:
        url = urldefrag(url)[0]
    except ValueError:
        url = url.partition("#")[0]
    return url.strip(), content if isinstance(content, str) else None


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.StringType())]))
def page_udf(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_of(d) for d in data], columns=["url", "content"], dtype=object)


def read_pages(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """url, content, path of all .json files below the folder. Files that hold no object, or no url, are left out;
    fragments of urls go. `path` is the order of documents."""
    reader = spark.readStream if stream else spark.read
    raw = reader.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    pages = raw.select(page_udf("content").alias("page"), "path").select("page.url", "page.content", "path")
    return pages.where("url is not null")


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Postings are clustered by term, so a lookup reads few row groups."""
    for name, df in tables.items():
        if name in ("postings", "terms"):
            df = df.repartitionByRange("term").sortWithinPartitions("term")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables that were not written (ranks are optional) are missing from the result."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    out = {}
    for name in TABLES:
        where = fs_path(f"{folder}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out[name] = spark.read.parquet(f"{folder}/{name}")
    return out
