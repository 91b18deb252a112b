"""From pages to a searchable index: extract, tokenize, deduplicate, index, link, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions.html import extract_text_udf
from seine.operators import index as ix
from seine.operators.dedup import dedup, fingerprints
from seine.operators.links import link_graph, pagerank, stored_ranks
from seine.operators.search import Index
from seine.operators.state import Tables
from seine.sources.pages import read_index, read_pages, write_index


def build(spark: SparkSession, pages: DataFrame, stemmed: bool = True) -> dict[str, DataFrame]:
    """pages: url, content, path (their order). Pages without content take no part; kept ones get dense ids in order."""
    tables = Tables(spark, "build")
    rows = pages.where("content is not null").select("path", "url", "content")
    # ordered ids without a global window: ids ascend in the order of path, then are made dense among the kept
    placed = tables.write(rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("doc_id", F.monotonically_increasing_id()))
    parsed = tables.write(placed.select("doc_id", extract_text_udf("content").alias("x")).select("doc_id", "x.text", "x.spans"))
    arrays = tables.write(ix.arrays_of(parsed, stemmed=stemmed, keep=("spans",)))
    status = tables.write(dedup(fingerprints(placed, arrays, "content"), tables))
    keep = status.where("status = 'keep'").select("doc_id")
    dense = tables.write(_dense(keep))
    n = dense.count()
    found = tables.write(ix.postings(arrays.join(dense, "doc_id").drop("doc_id").withColumnRenamed("dense", "doc_id"), positions=True))
    docs = placed.join(dense, "doc_id").select(F.col("dense").alias("doc_id"), "url")
    edges = tables.write(link_graph(docs, placed.select(F.col("doc_id").alias("ord"), "url", F.col("content").alias("html"))))
    ranks = pagerank(docs.select(F.col("doc_id").alias("id")), edges, tables)
    return {"documents": docs, "postings": ix.stored(found), "terms": ix.terms(found, n), "norms": ix.norms(found), "edges": edges, "pagerank": stored_ranks(ranks), "status": status.groupBy("status").agg(F.count("*").alias("n"))}


def _dense(keep: DataFrame) -> DataFrame:
    """doc_id, dense: 0, 1, ... in ascending order. Ids hold their partition in the upper bits, so a window per partition
    and a running total of partition sizes (few rows) do it without one global window."""
    from pyspark.sql import Window

    rows = keep.withColumn("part", F.shiftright("doc_id", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select("doc_id", (F.col("own") + F.col("before")).alias("dense"))


def build_folder(spark: SparkSession, folder: str, out: str, stemmed: bool = True) -> None:
    write_index(build(spark, read_pages(spark, folder), stemmed), out)


def open_index(spark: SparkSession, folder: str) -> tuple[Index, DataFrame]:
    t = read_index(spark, folder)
    return Index(t["postings"], t["terms"], t["norms"], t.get("pagerank")), t["documents"]
