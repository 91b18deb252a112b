"""A corpus pipeline of five training-data operators, each stage written as Parquet and read again.

quality    documents that the co-training classifier rejects (low quality or toxic) go
line_dedup later copies of runs of lines go; documents of which nothing is left go
jaccard    of each group of near copies (five words, similarity 0.8 or more) one row stays, that with the smallest doc_id
mixing     documents are repeated so that the languages' tokens meet their target weights; none goes
bpe        per document: token count and digests of its ids and of its decoded text

Defined results, by stage (columns besides those of `documents`, of any name, are kept until the last stage):

           null text          null doc_id                  equal rows, repeated doc_id        blank text
quality    scored as empty    scored like any              each scored by itself, alike       scored as empty
line_dedup kept as it is      comes first in order         equal rows share one fate          kept as it is
jaccard    kept               loses to any other id        one row of a group stays           kept
mixing     gets the prior     drawn like any               each drawn by itself, alike        gets the prior
bpe        counts as empty    passed through               a row for each                     encoded

Ties do not matter but in jaccard, where the smallest class id decides. Long texts are taken whole. Null lang, source or
n_chars are values of their own. Each stage makes no rows of an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seine.llm import op01_bpe, op03_quality, op04_mixing, op05_jaccard, op06_lines
from seine.llm.common import Workspace, table

#: SQL cannot express a trained classifier.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op03_quality.Model(docs, table(spark, sf_dir, "labels"))
    rows, *scores = op03_quality.scored(docs, model)
    return rows.where(op03_quality.keep(*scores)).drop(*scores)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_lines.without_copies(docs, Workspace(spark, "line_dedup"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_jaccard.one_of_each(docs, Workspace(spark, "jaccard"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = op04_mixing.labelled_languages(docs, table(spark, sf_dir, "labels"))
    return op04_mixing.mixed(docs, labelled, Workspace(spark, "mixing"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_bpe.encode_texts(docs, op01_bpe.vocabulary())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("jaccard", jaccard), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
