"""Exact and near duplicates in document order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.config import HAMMING_K, NUM_BITS, NUM_BLOCKS
from seine.functions.text import simhash
from seine.operators.state import Tables


def fingerprints(docs: DataFrame, arrays: DataFrame, content: str = "text") -> DataFrame:
    """doc_id, content_hash, fp."""
    return docs.select("doc_id", F.sha2(F.col(content), 256).alias("content_hash")).join(simhash(arrays), "doc_id")


def near_pairs(fps: DataFrame, k: int = HAMMING_K, blocks: int = 2 * NUM_BLOCKS - 2) -> DataFrame:
    """Pairs i < j (columns id, fp) whose fingerprints differ in 1 to k bits. At least blocks - k blocks are equal, so two
    such fingerprints agree in one of all choices of that many blocks (three of six: 20 keys of 32 bits about), which
    keeps groups small where single blocks of 16 bits would grow with the corpus."""
    edges = [NUM_BITS * b // blocks for b in range(blocks + 1)]
    parts = [(1 << edges[b + 1]) - (1 << edges[b]) for b in range(blocks)]
    masks = [sum(x) - (sum(x) >> 63 << 64) for x in combinations(parts, blocks - k)]
    keys = F.array(*(F.struct(F.lit(no).alias("no"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")) for no, mask in enumerate(masks)))
    rows = fps.select("id", "fp", F.inline(keys))
    # Spark takes the rows of a key each for no more than the fingerprints they come from, and would send them to all by way of the driver
    a, b = rows.alias("a"), rows.hint("merge").alias("b")
    # a pair counts under the first key it shares, so it comes once
    first = F.coalesce(*(F.when(F.col("a.fp").bitwiseXOR(F.col("b.fp")).bitwiseAND(F.lit(mask).cast("long")) == 0, no) for no, mask in enumerate(masks))) == F.col("a.no")
    on = [F.col("a.no") == F.col("b.no"), F.col("a.value") == F.col("b.value"), F.col("a.id") < F.col("b.id"), F.expr(f"bit_count(a.fp ^ b.fp) <= {k}"), first]
    return a.join(b, on).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))


def first_independent(nodes: DataFrame, pairs: DataFrame, tables: Tables) -> DataFrame:
    """Written ids that a scan in ascending order keeps: those with no kept smaller neighbour. Each round keeps the open
    nodes that have no smaller open neighbour and drops the neighbours of the kept, so rounds follow the longest chain."""
    kept = None
    edges = tables.write(pairs)
    ends = edges.select(F.col("j").alias("id"))
    free = nodes.join(ends, "id", "left_anti").select("id")  # no smaller neighbour at all
    kept = tables.write(free)
    fresh = kept
    while not edges.isEmpty():
        gone = edges.join(fresh.select(F.col("id").alias("i")), "i", "left_semi").select("j").distinct()
        gone = tables.write(gone)
        # links of dropped nodes go, and so do links from kept ones, whose other end is dropped
        rest = edges.join(gone, "j", "left_anti").join(gone.select(F.col("j").alias("i")), "i", "left_anti")
        rest = tables.write(rest.select("i", "j"))
        open_ = edges.select(F.col("j").alias("id")).distinct().join(gone.select(F.col("j").alias("id")), "id", "left_anti")
        fresh = tables.write(open_.join(rest.select(F.col("j").alias("id")), "id", "left_anti"))
        kept = tables.write(kept.union(fresh))
        edges = rest
    return kept


def dedup(found: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, status (keep, exact, near) from doc_id, content_hash, fp.

    Documents with the same fingerprint stand or fall with the first of them, so only distinct fingerprints are paired,
    and a large group of copies is a group of nothing but partial minima."""
    found = tables.write(found)
    reps = tables.write(found.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min_by("content_hash", "doc_id").alias("first_hash")))
    kept = first_independent(reps.select("id"), near_pairs(reps.select("id", "fp")), tables)
    heads = tables.write(reps.join(kept.withColumn("kept", F.lit(True)), "id", "left").select("fp", "id", "first_hash", F.coalesce("kept", F.lit(False)).alias("kept")))
    own = F.when(F.col("kept") & (F.col("doc_id") == F.col("id")), "keep").when(F.col("kept") & (F.col("content_hash") == F.col("first_hash")), "exact").otherwise("near")
    return found.join(heads, "fp").select("doc_id", own.alias("status"))
