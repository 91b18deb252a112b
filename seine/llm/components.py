"""Connected components of links between long ids, by rounds of contraction on DataFrames.

Each round points every node at its smallest neighbour (or itself), follows the pointers to their roots by doubling,
and moves the links to the roots; links inside a root vanish. Hot nodes are no hot groups: minima are taken with
partial sums, and each join is between two written tables, which adaptive execution may split. Each round's tables are
written to the shared folder, so a lost executor costs no more than its running tasks. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.common import Workspace


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """links (a long, b long, either order, repeats and loops allowed) -> written rows (node, label) of all nodes with a
    link to another; label is the smallest node reachable. Null ends are left out."""
    ab = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, labels = work.write(ab, "links"), None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = work.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "pointers")
        while True:
            x, y = p.alias("x"), p.alias("y")
            q = work.write(x.join(y, F.col("x.root") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.root").alias("root"), (F.col("x.root") != F.col("y.root")).alias("moved")), "roots")
            still = not q.where("moved").isEmpty()
            work.drop(p)
            p = work.spark.read.parquet(q.seine_path).select("node", "root")
            p.seine_path = q.seine_path
            if not still:
                break
        if labels is None:
            labels = work.write(p.select("node", F.col("root").alias("label")), "labels")
        else:
            new = work.write(labels.join(p.withColumnRenamed("node", "label"), "label", "left").select(labels["node"], F.coalesce("root", "label").alias("label")), "labels")
            work.drop(labels)
            labels = new
        pa, pb = p.select(F.col("node").alias("a"), F.col("root").alias("ra")), p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = e.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        new = work.write(moved, "links")
        work.drop(e, p)
        e = new
    if labels is None:
        labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        labels.seine_path = e.seine_path
    return labels
