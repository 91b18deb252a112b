"""python -m seine.cli build PAGES INDEX | search INDEX QUERY"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seine.operators.search import tiered_search
from seine.plans.build import build_folder, open_index


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in ("build", "search"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("seine").getOrCreate()
    if args[0] == "build":
        build_folder(spark, args[1], args[2])
        return 0
    index, docs = open_index(spark, args[1])
    start = time.perf_counter()
    found = tiered_search(index, args[2], stemmed=True).join(docs, "doc_id", "left").select("doc_id", F.coalesce("url", F.lit("Unknown")).alias("url"), "score")
    for rank, row in enumerate(found.orderBy(F.desc("score"), "doc_id").collect(), 1):
        print(f"{rank}. URL: {row['url']}, Score: {row['score']:.4f}")
    print(f"Search completed in {(time.perf_counter() - start) * 1000:.2f}ms")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
