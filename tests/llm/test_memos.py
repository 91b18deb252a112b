"""Python workers that Spark uses again do not keep the memos of other operators."""

import pyarrow as pa

from seine.llm import op01_bpe, op03_quality, op04_mixing, op10_token_file
from seine.llm.common import Workspace


def held(spark):
    """Entries of each operator's memo, per worker process met."""

    def run(batches):
        import os

        from seine.llm import op01_bpe, op03_quality, op04_mixing, op10_token_file

        sizes = [len(m) for m in (op01_bpe._memos, op03_quality._features, op04_mixing._slots, op10_token_file._words)]
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (os.getpid(), *sizes)], ["pid", "bpe", "quality", "mixing", "ids"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "pid long, bpe long, quality long, mixing long, ids long").first()


def test_memos(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    op01_bpe.encode_texts(docs, op01_bpe.vocabulary()).count()
    quality = op03_quality.Model(docs, labels)
    membership = op04_mixing.fit_membership(docs, op04_mixing.labelled_languages(docs, labels), op04_mixing.TARGETS)
    runs = {
        "bpe": lambda: op01_bpe.encode_texts(docs, op01_bpe.vocabulary()).collect(),
        "quality": lambda: op03_quality.scored(docs, quality)[0].collect(),
        "mixing": lambda: op04_mixing.posteriors(docs, membership).collect(),
        "ids": lambda: op10_token_file.write_token_files(docs, Workspace(spark, "memos").path("ids"), op01_bpe.vocabulary()).collect(),
    }
    for name in [*runs, *reversed(runs)]:
        runs[name]()
        row = held(spark).asDict()
        assert sum(row[k] > 0 for k in runs) <= 1, (name, row)
