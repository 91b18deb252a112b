"""Shared plumbing of the training-data operators: inputs, written tables, file access."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.operators.state import shared_dir

#: ASCII white space that separates words, as the byte-wise split of Python sees it.
WORD = r"[^\x20\x09-\x0D]+"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number behind it if a column of the frame has it already (in either case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        own, n = f"seine_{name}", 0
        while own in have:
            own, n = f"seine_{name}_{n}", n + 1
        have.add(own)
        out.append(own)
    return out


def parted(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows with what `of` has for their key; those with a null key take no part in the join, where it would be hot."""
    none = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(t).alias(c) for c, t in of.dtypes if c != key))
    return rows.where(F.col(key).isNotNull()).join(of, key, "left").select(none.columns).union(none)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Tables and files of one run, under the shared folder. Written tables cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seine/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def write(self, df: DataFrame, tag: str, **options: str) -> DataFrame:
        """Write the rows and return a frame that reads them back."""
        path = self.path(tag)
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.seine_path = path
        return back

    def drop(self, *frames: DataFrame | str) -> None:
        """Delete tables that no later step reads."""
        for x in frames:
            path = x if isinstance(x, str) else x.seine_path
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


_memos: dict = {}


def claim(name: str, forget=None) -> None:
    """For Python workers, which Spark uses again for other operators: the memos of all but the named one are emptied.

    `forget` is a function of its module, or None for operators whose memos end with their tasks. A method of a memo would
    not do: a nested function goes to the workers with copies of the objects it names, and the copy would be emptied."""
    if name not in _memos:
        for clear in _memos.values():
            if clear:
                clear()
        _memos.clear()
        _memos[name] = forget
        release()


def release() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def input_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column, from one small aggregation."""
    return df.agg(F.sum(F.octet_length(col)).alias("b")).first()["b"] or 0


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


@contextmanager
def create(uri: str):
    """A binary file that appears whole or not at all, so that a second attempt of a task can write it again."""
    own = uuid.uuid4().hex[:8]
    if (path := _local(uri)) is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        part = f"{path}.{own}.part"
        with open(part, "wb") as out:
            yield out
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(f"{path}.{own}.part") as out:
            yield out
        store.move(f"{path}.{own}.part", path)


def opened(uri: str):
    """A seekable binary file."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
