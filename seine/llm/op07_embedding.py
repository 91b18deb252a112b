"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label form a class and count with their number, so copies are never paired. In each table a class
lies in the bucket of its sign pattern. The number of planes follows the logarithm of the largest label, so buckets
stay small, and the number of tables follows from it: a pair at the threshold is missed with probability 1 - RECALL at
most. Within a bucket all cosines are worked out in double precision. A bucket of more than BLOCK classes is cut into
blocks, and each pair of blocks is a cell of its own: tasks stay bounded and no pair is left out. A pair that meets in
several tables counts in the first of them. Cells emit counts per class and a spanning forest of their links, not
pairs. Vectors travel to their buckets as they came (four bytes a component for floats) and become unit vectors in
double precision there.

Defined results: vectors that are null, empty or zero or that hold null or non-finite components, and rows with a null
label, link with nothing (n_links 0, own component, kept); so do vectors of different lengths. A null vec_id links
nothing and comes back with null component_id and kept. Repeated rows count as vectors of their own. Extra columns are
left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.llm.common import Workspace, parted, table
from seine.llm.components import components

COSINE = 0.93
RECALL = 0.9999
#: Classes wanted in a bucket, and the most that a block has on average.
TARGET, BLOCK = 16, 2048
SEED = 20_240_501


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Planes in a table, and tables, for n classes in the largest label."""
    planes = min(30, max(4, round(math.log2(max(n, 1) / TARGET)))) if n > TARGET else 4
    same = (1 - math.acos(cosine) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def planes_for(dim: int, planes: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, tables * planes))


def patterns(v: np.ndarray, h: np.ndarray, planes: int) -> np.ndarray:
    """Sign patterns, rows by tables."""
    bits = (v @ h >= 0).reshape(len(v), -1, planes)
    return bits @ (1 << np.arange(planes))


def kind_of(vectors: DataFrame) -> str:
    """How components are kept: as floats if they are floats, else in double precision."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def unit_of(raw: bytes, kind: str) -> np.ndarray | None:
    """The unit vector in double precision, or None if there is none. Scaled copies mostly give the same."""
    x = np.frombuffer(raw, kind).astype(np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, cid (null: links with nothing), vector (its components as bytes)."""
    kind = kind_of(vectors)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, kept = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                cid = raw = None
                if label is not None and v.is_valid and v.values is not None and len(v.values) and v.values.null_count == 0:
                    data = v.values.to_numpy().astype(kind).tobytes()
                    unit = unit_of(data, kind)
                    if unit is not None:
                        raw, cid = data, int.from_bytes(hashlib.blake2b(unit.tobytes(), digest_size=8, key=str(label).encode()[:64]).digest(), "little", signed=True)
                cids.append(cid)
                kept.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cids, pa.int64()), pa.array(kept, pa.binary())], ["vec_id", "label", "cid", "vector"])

    frame = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    return frame.mapInArrow(run, "vec_id long, label string, cid long, vector binary")


def bucketed(classes: DataFrame, planes: int, tables: int, kind: str) -> DataFrame:
    """cid, m, vector once per table, with its bucket."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                buckets = []
                for label, raw in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                    unit = unit_of(raw, kind)
                    dim = len(unit)
                    if dim not in kept:
                        kept[dim] = planes_for(dim, planes, tables)
                    found = patterns(unit[None], kept[dim], planes)[0]
                    start = hashlib.blake2b(f"{dim}:{label}".encode(), digest_size=8)
                    for t, x in enumerate(found):
                        h = start.copy()
                        h.update(b"%d:%d" % (t, x))
                        buckets.append(int.from_bytes(h.digest(), "little", signed=True))
                n = np.repeat(np.arange(part.num_rows), tables)
                out = part.select(["cid", "m", "vector"]).take(pa.array(n))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), *out.columns], ["bucket", "tab", "cid", "m", "vector"])

    return classes.select("cid", "label", "m", "vector").mapInArrow(run, "bucket long, tab int, cid long, m long, vector binary")


def in_cells(rows: DataFrame, work: Workspace, block: int) -> DataFrame:
    """Rows dealt to cells: a small bucket is one cell; of a large one each pair of blocks is."""
    large = work.write(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    r = rows.join(large, "bucket", "left")
    own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    r = r.withColumn("own", own)
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return r.select("bucket", "tab", F.explode(other).alias("o"), "own", "cid", "m", "vector").select("bucket", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "tab", "cid", "m", "vector")


def linked_in_cells(cells: DataFrame, planes: int, tables: int, cosine: float, kind: str) -> DataFrame:
    """a, b, n: with b null, n vectors link with each vector of class a; else a link of a spanning forest."""

    def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := root.setdefault(v, v)) != v:
                root[v] = v = root[p]
            return v

        out = []
        for a, b in zip(x.tolist(), y.tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        return out

    def cell(i: int, j: int, own, tab: int, cid, m, raws) -> pa.RecordBatch | None:
        v = np.stack([unit_of(raw, kind) for raw in raws])
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(cid)),) * 2
        n, xs, ys, seen = np.zeros(len(cid), np.int64), [], [], None
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            p, q = np.nonzero(v[rows] @ v[right].T >= cosine)
            p, q = rows[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            if len(p) and tab:
                if seen is None:
                    seen = patterns(v, planes_for(v.shape[1], planes, tables)[:, : tab * planes], planes)
                new = np.ones(len(p), bool)
                for t in range(tab):
                    new &= seen[p, t] != seen[q, t]
                p, q = p[new], q[new]
            if len(p):
                np.add.at(n, p, m[q])
                np.add.at(n, q, m[p])
                xs.append(cid[p])
                ys.append(cid[q])
        if not xs:
            return None
        tree = forest(np.concatenate(xs), np.concatenate(ys))
        some = np.flatnonzero(n)
        a = [*cid[some].tolist(), *(x for x, _ in tree)]
        b = [None] * len(some) + [y for _, y in tree]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*n[some].tolist(), *[None] * len(tree)], pa.int64())], ["a", "b", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, i, j, own, tab, cid, m = (t.column(c).to_numpy() for c in range(7))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
                if b - a > 1 and (out := cell(int(i[a]), int(j[a]), own[a:b], int(tab[a]), cid[a:b], m[a:b], t.column(7).slice(a, b - a).to_pylist())):
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            keys = [t.column(c).to_numpy() for c in range(3)]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            first = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # rows from here belong to a cell that may go on
            if first:
                yield from done(t.slice(0, first))
                held = t.slice(first).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")
    return dealt.select("bucket", "i", "j", "own", "tab", "cid", "m", "vector").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, work: Workspace, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = work.write(classes_of(vectors), "rows")
    one = rows.where("cid is not null and vec_id is not null").groupBy("cid").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = work.write(one, "classes")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    (planes, tables), kind = plan(n, cosine, recall), kind_of(vectors)
    found = work.write(linked_in_cells(in_cells(bucketed(classes, planes, tables, kind), work, block), planes, tables, cosine, kind), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    labels = components(work, found.where("b is not null").select("a", "b"))
    lead = classes.select("cid", "first_id", "m").join(links, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    lead = work.write(lead.select("cid", "first_id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "cid").alias("label")), "leads")
    least = work.write(lead.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    of = work.write(lead.join(least, "label").select("cid", "n_links", "component_id"), "component_of")
    out = parted(rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cid")).alias("cid")), of, "cid")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.expr("vec_id = component_id"))


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Workspace(spark, "op7"))


QUERIES = {"op7_embedding": op7_embedding}
SQL: dict[str, str] = {}
