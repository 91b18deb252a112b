"""Link graph and PageRank."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.config import DAMPING, MAX_ITER, RANK_PLACES, TOLERANCE
from seine.functions.html import normalize_url_udf, out_links_udf
from seine.operators.state import Tables


def canonical_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """src canonical target per distinct link of a page (id, url, html)."""
    return pages.select(F.col(id_col).alias("src"), F.explode(out_links_udf("html", "url")).alias("target"))


def link_graph(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between kept documents.

    kept: doc_id, url; pages: ord (order), url, html of all pages, dropped ones too. Of documents with one canonical
    address the last in order owns it, and of pages with one address the last gives its links."""
    owner = kept.withColumn("canon", normalize_url_udf("url")).groupBy("canon").agg(F.max("doc_id").alias("doc_id"))
    last = pages.where("html is not null").withColumn("canon", normalize_url_udf("url")).groupBy("canon").agg(F.max_by(F.struct("url", "html"), "ord").alias("p"))
    rows = last.join(owner, "canon").select(F.col("doc_id").alias("src"), F.explode(out_links_udf("p.html", "p.url")).alias("canon"))
    return rows.join(owner.withColumnRenamed("doc_id", "dst"), "canon").select("src", "dst").distinct()


#: Edges and vertices of a block, about.
BLOCK_EDGES, BLOCK_VERTICES = 1 << 19, 1 << 18
SENT = "block long, sender long, at binary, value binary, moved array<double>"
STATE = -1  # the sender of a block's own ranks


def _file(root: str, block: int):
    """Store and path of a block's file in the shared folder."""
    root = "file:///" + root[5:].lstrip("/") if root.startswith("file:") else root
    store, path = fs.FileSystem.from_uri(root)
    return store, f"{path}/{block}.npz"


def _load(root: str, block: int):
    store, path = _file(root, block)
    with store.open_input_file(path) as src:
        return np.load(io.BytesIO(src.read()))


def _rows(block: int, ranks: np.ndarray, moved: list[float], links, damping: float) -> pa.Table:
    """A block's ranks, and what it sends to each block at the next step: sums for the vertices at `at`."""
    out = [(block, STATE, b"", ranks.tobytes(), moved)]
    if len(links["starts"]):
        share = damping * (ranks / np.maximum(links["degree"], 1))
        sums, to, at = np.add.reduceat(share[links["src"]], links["starts"]), links["to"], links["at"]
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1), len(to)]
        out += [(int(to[a]), block, at[a:b].tobytes(), sums[a:b].tobytes(), []) for a, b in zip(cuts, cuts[1:])]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())))], names=["block", "sender", "at", "value", "moved"])


def pagerank(vertices: DataFrame, edges: DataFrame, tables: Tables, damping: float = DAMPING, max_iter: int = MAX_ITER, tolerance: float | None = TOLERANCE, together: int = 8) -> DataFrame:
    """id, rank. Ranks start at 1, the teleport is (1 - d) / N, and what dangling vertices hold is lost. Targets of edges
    that are no vertices start at 0.

    Vertices are dealt into blocks by ranges of ids. The edges of a block's sources are packed once into a file in the shared
    folder, so no step shuffles edges: a block adds up what it got, and sends one sum per target vertex, which are
    few where neighbours lie in one range. Several steps make a job, whose ranks and changes are written. The first step
    that moves no rank by the tolerance gives the result; tolerance None runs max_iter steps."""
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(1.0).alias("rank"))
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    parts = max(1, -(-edges.count() // BLOCK_EDGES), -(-n // BLOCK_VERTICES))
    known = vertices.select("id", F.lit(1.0).alias("start")).union(edges.select("dst", F.lit(0.0))).groupBy("id").agg(F.max("start").alias("start"))
    nodes = known.join(degree.hint("merge"), "id", "left").repartitionByRange(parts, "id").sortWithinPartitions("id")
    nodes = tables.write(nodes.select("id", "start", F.coalesce("degree", F.lit(0)).alias("degree"), F.monotonically_increasing_id().alias("place")))
    block = F.shiftright("place", 33).alias("block")
    source = nodes.select(F.col("id").alias("src"), block, F.col("place").bitwiseAND((1 << 33) - 1).cast("int").alias("from")).hint("merge")
    target = nodes.select(F.col("id").alias("dst"), F.col("place").alias("to")).hint("merge")
    links = edges.select("src", "dst").join(source, "src").join(target, "dst").select("block", "from", "to")
    root = f"{tables.root}/blocks"

    def pack(key, own, out):
        own = own.sort_by("place")
        src, to = out["from"].to_numpy(), out["to"].to_numpy()
        order = np.lexsort((src, to))
        src, to = src[order], to[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        links = {"id": own["id"].to_numpy(), "degree": own["degree"].to_numpy(), "src": src, "starts": starts, "to": to[starts] >> 33, "at": (to[starts] & ((1 << 33) - 1)).astype(np.int32)}
        np.savez(data := io.BytesIO(), **links)
        store, path = _file(root, no := key[0].as_py())
        store.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex[:8]}"
        with store.open_output_stream(part) as file:
            file.write(data.getbuffer())
        store.move(part, path)
        return _rows(no, own["start"].to_numpy(), [], links, damping)

    def step(key, got):
        no, got = key[0].as_py(), sorted(got.select(["sender", "at", "value", "moved"]).to_pylist(), key=lambda r: r["sender"])
        old = np.frombuffer(got[0]["value"])
        new = np.full(len(old), (1 - damping) / n)
        for r in got[1:]:
            new[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["value"])
        return _rows(no, new, [*got[0]["moved"], float(np.abs(new - old).max())], _load(root, no), damping)

    def named(batches):
        for batch in batches:
            for no, value in zip(batch["block"].to_pylist(), batch["value"].to_pylist()):
                yield pa.record_batch([pa.array(_load(root, no)["id"], pa.int64()), pa.array(np.frombuffer(value))], names=["id", "rank"])

    sent, done, still = tables.write(nodes.withColumn("block", block).groupBy("block").cogroup(links.groupBy("block")).applyInArrow(pack, SENT)), 0, False
    while done < max_iter and not still:
        steps = min(together, max_iter - done)
        while True:
            new = sent
            for _ in range(steps):
                new = new.groupBy("block").applyInArrow(step, SENT)
            new = tables.write(new)
            own = new.where(F.col("sender") == STATE)
            most = own.agg(*(F.max(F.element_at("moved", k - steps)) for k in range(steps))).first() if tolerance is not None else ()
            first = next((k + 1 for k, x in enumerate(most) if x < tolerance), None)
            still = first is not None
            if first in (None, steps):
                break
            tables.drop(new)
            steps = first  # the first step that moves little lies within this job
        tables.drop(sent)
        sent, done = new, done + steps
    return sent.where(F.col("sender") == STATE).select("block", "value").mapInArrow(named, "id long, rank double")


def stored_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.select(F.col("id").alias("doc_id"), F.round("rank", RANK_PLACES).alias("rank"))
