"""Quality classifier by co-training.

Two views of a document: its words (hashed words and word beginnings), and its page metadata (language, source, length
and layout counts, without any word). For each target (quality, toxicity) a classifier per view starts from the same
labelled rows. In each round both are calibrated on rows held back and score all documents, and each hands those of
which it is surest, at most HANDED per class and at SURE or more, to the other as labelled ones. In the end both views,
calibrated, are combined by a logistic regression on the rows held back, and all documents are scored whole.

The features of all documents are written once, as gaps of sorted ids; a round is a pass over them. Copies of a document
(equal text, language, source and length) count once among the surest. Layout figures are cut at quantiles of the whole
corpus. Bounds: LABELLED labelled documents, those first in the order of a hash of doc_id, and what HANDED and ROUNDS
let through are fitted on the driver, on their feature ids. The model has a fixed size and goes to the workers.

Defined results: a null text counts as empty, other null columns as values of their own; labels for unknown documents
are unused; labels that repeat are averaged (quality: at least half, toxic: at least half); a null label is no label
for that target; with no labels, or one class, a target's score is the share of its positive labels (without labels 1
for quality, 0 for toxicity). Repeated rows score alike; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.llm.common import Workspace, claim, free_names, release, table
from seine.llm.logistic import Rows, fit, newton, sigmoid

LABELLED, ROUNDS, HANDED, SURE = 8000, 3, 400, 0.97
SIZE = 1 << 18
HELD_BACK = 4  # every fourth labelled row
BINS = 8
UPPER, DIGITS, SIGNS, STOPS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#$%&*+/<=>@\\^_`{|}~", ".,;:?'\"()-"))
LAYOUT = 9


class Features(dict):
    """Word -> ids of its features. Bounded by forgetting."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        ids = self[word] = (zlib.crc32(word) % SIZE, zlib.crc32(b"4" + word[:4]) % SIZE, zlib.crc32(b"6" + word[:6]) % SIZE)
        return ids


_features = Features()


def _forget() -> None:
    _features.clear()


def text_view(text: str | None) -> tuple[np.ndarray, int, int]:
    """Distinct feature ids, words, distinct words."""
    if len(_features) > 150_000:
        _features.clear()
    words = (text or "").encode().lower().split()
    distinct = set(words)
    return np.unique(np.fromiter(chain.from_iterable(map(_features.__getitem__, distinct)), np.int64)), len(words), len(distinct)


def meta_view(text: str | None, lang, source, n_chars, words: int, distinct: int) -> list[float]:
    """Language and source as hashes, then LAYOUT figures."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    lines = raw.count(b"\n") + 1
    return [
        float(zlib.crc32(str(lang).encode()) % 16), float(zlib.crc32(str(source).encode()) % 64),
        np.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text or "")), np.log1p(words), np.log1p(words / lines),
        share(UPPER), share(DIGITS), share(SIGNS), share(STOPS), np.log1p(distinct) - np.log1p(words), len(raw) / max(1, words),
    ]


class Meta:
    """One-hot ids of the metadata view, from the cuts of the layout figures."""

    def __init__(self, cuts: np.ndarray):
        self.cuts = cuts
        self.size = 16 + 64 + LAYOUT * BINS + BINS * BINS

    def ids(self, rows: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, rows[:, 2 + j], "left") for j, c in enumerate(self.cuts)], axis=1)
        cols = [rows[:, 0], 16 + rows[:, 1], *(80 + BINS * j + bins[:, j] for j in range(LAYOUT))]
        cols.append(80 + BINS * LAYOUT + BINS * bins[:, 1] + bins[:, 7])  # length by share of distinct words
        return np.stack(cols, axis=1).astype(np.int64)


class Target:
    """Both views of one target, their calibrations and their combination."""

    def __init__(self, base: float):
        self.base, self.w, self.b, self.both, self.learns = base, None, (0.0, 0.0), np.zeros(3), False
        self.cal = [np.array([1.0, 0.0])] * 2

    def start(self, views: list[list[np.ndarray]], sizes: list[int], y: np.ndarray) -> None:
        """y: 0, 1, or nan where a row has no label."""
        known = np.flatnonzero(~np.isnan(y))
        held, train = known[::HELD_BACK], np.setdiff1d(known, known[::HELD_BACK])
        if len(known):
            self.base = float(y[known].mean())
        self.learns = len({*y[train]}) == 2 and len({*y[held]}) == 2
        self.sizes, self.y, self.held_y = sizes, [y[train]] * 2, y[held]
        self.rows, self.held = [[v[i] for i in train] for v in views], [Rows([v[i] for i in held]) for v in views]
        self.taken: list[set[int]] = [set(), set()]

    def refit(self) -> None:
        models = [fit(Rows(rows), y, size) for rows, y, size in zip(self.rows, self.y, self.sizes)]
        self.w, self.b = [w.astype(np.float32) for w, _ in models], tuple(b for _, b in models)
        self.cal = [newton((h.dot(w) + b)[:, None], self.held_y) for h, w, b in zip(self.held, self.w, self.b)]

    def take(self, k: int, value: int, keys: list[int], rows: list[np.ndarray]) -> None:
        """Documents that the other view handed to view k."""
        self.taken[k].update(keys)
        self.rows[k] += rows
        self.y[k] = np.append(self.y[k], np.full(len(rows), float(value)))

    def finish(self) -> None:
        self.both = newton(self.logits([h.dot(w) for h, w in zip(self.held, self.w)]), self.held_y)
        del self.rows, self.held, self.y, self.held_y, self.taken

    def views(self) -> Target:
        """The views alone, without the rows they are fitted on."""
        out = Target(self.base)
        out.w, out.b, out.cal = self.w, self.b, self.cal
        return out

    def sure(self, k: int, dots: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of view k."""
        return sigmoid((dots + self.b[k]) * self.cal[k][0] + self.cal[k][1])

    def logits(self, dots: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.clip((d + b) * c[0] + c[1], -20, 20) for d, b, c in zip(dots, self.b, self.cal)], axis=1)

    def score(self, texts: Rows, meta: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(meta), self.base)
        return sigmoid(np.column_stack((self.logits([texts.dot(self.w[0]), self.w[1][meta].sum(axis=1)]), np.ones(len(meta)))) @ self.both)


VIEW = ("text string", "lang string", "source string", "n_chars long")


def _view(docs: DataFrame) -> list:
    have = {c.lower() for c in docs.columns}
    return [(docs[c.split()[0]] if c.split()[0] in have else F.lit(None)).cast(c.split()[1]) for c in VIEW]


class Model:
    def __init__(self, docs: DataFrame, labels: DataFrame):
        """Fit on a bounded sample of `labels` (doc_id, quality, toxic) and on the surest of all documents."""
        work = Workspace(docs.sparkSession, "quality")
        # small row groups, as a writer holds one in memory
        feats = work.write(features(docs), "features", compression="zstd", **{"parquet.block.size": str(16 << 20)})
        one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("q"), F.avg(F.col("toxic").cast("double")).alias("x"))
        # the list is cut to its bound before any features are read, so it may be broadcast
        some = feats.select("doc_id", "key").where("doc_id is not null").distinct().join(one, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(LABELLED)
        t = feats.join(F.broadcast(some), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "q", "x", "gaps", "meta").toArrow().sort_by([("doc_id", "ascending"), ("key", "ascending")])
        self.meta = Meta(_cuts(feats))
        views, (q, x) = self._views(t), (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("q", "x"))
        self.quality, self.toxic = Target(1.0), Target(0.0)
        for target, y in ((self.quality, q), (self.toxic, x)):
            target.start(views, [SIZE, self.meta.size], np.where(np.isnan(y), np.nan, (y >= 0.5).astype(float)))
        known, learning = set(t.column("key").to_pylist()), [g for g in (self.quality, self.toxic) if g.learns]
        del t, views
        for round_ in range(ROUNDS + 1 if learning else 0):
            for target in learning:
                target.refit()
            if round_ < ROUNDS:
                self._hand_over(feats, learning, known)
        for target in learning:
            target.finish()
        work.drop(feats)
        release()

    def _views(self, t: pa.Table) -> list[list[np.ndarray]]:
        meta = np.array(t.column("meta").to_pylist(), float).reshape(-1, 2 + LAYOUT)
        return [_ids(t.column("gaps")), list(self.meta.ids(meta)) if len(meta) else []]

    def _hand_over(self, feats: DataFrame, targets: list[Target], known: set[int]) -> None:
        """What view k of a target is sure of goes to its other view."""
        found = surest(feats, targets, self.meta, known).collect()
        if not found:
            return
        wanted = feats.sparkSession.createDataFrame([(k,) for k in sorted({r["key"] for r in found})], "key long")
        t = feats.join(F.broadcast(wanted), "key").dropDuplicates(["key"]).select("key", "gaps", "meta").toArrow()
        views, at = self._views(t), {k: i for i, k in enumerate(t.column("key").to_pylist())}
        groups: dict[int, list[int]] = {}
        for g, key in sorted((r["g"], r["key"]) for r in found):
            groups.setdefault(g, []).append(key)
        for g, keys in groups.items():
            to = 1 - g // 2 % 2
            targets[g // 4].take(to, g % 2, keys, [views[to][at[k]] for k in keys])


def features(docs: DataFrame) -> DataFrame:
    """For each row its doc_id, a key that equal documents share, the gaps of its sorted word ids, its metadata figures."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(c.alias(n.split()[0]) for c, n in zip(_view(docs), VIEW)))
    return rows.select("doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("key"), "text", "lang", "source", "n_chars").mapInArrow(_extract, "doc_id long, key long, gaps array<int>, meta array<double>")


def _extract(batches) -> Iterator[pa.RecordBatch]:
    claim("quality", _forget)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            gaps, meta = [], []
            for text, lang, source, n_chars in zip(*(part.column(i).to_pylist() for i in range(2, 6))):
                f, n, d = text_view(text)
                gaps.append(np.diff(f, prepend=0).astype(np.int32))
                meta.append(meta_view(text, lang, source, n_chars, n, d))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(gaps, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.float64()))], ["doc_id", "key", "gaps", "meta"])


def _ids(gaps) -> list[np.ndarray]:
    """Feature ids of each row of a column of gaps."""
    return [np.cumsum(r.values.to_numpy(zero_copy_only=False), dtype=np.int32) for r in gaps]


def _cuts(feats: DataFrame) -> np.ndarray:
    """Quantiles of the layout figures over all rows, from counts by thousandths (figures over 64 count as 64)."""
    value = F.ceil(F.least("col", F.lit(64.0)) * 1000).alias("value")
    rows = feats.select(F.posexplode("meta")).where("pos >= 2").groupBy("pos", value).count().toArrow().sort_by([("pos", "ascending"), ("value", "ascending")])
    pos, values, n = (rows.column(c).to_numpy() for c in ("pos", "value", "count"))
    cuts = np.zeros((LAYOUT, BINS - 1))
    for j in range(LAYOUT if len(pos) else 0):
        v, upto = values[pos == 2 + j], np.cumsum(n[pos == 2 + j])
        cuts[j] = v[np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)] / 1000
    return cuts


def _best(key: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The HANDED surest of different keys; sureness counts to three places, then the lower key."""
    key, at = np.unique(key, return_index=True)
    top = np.lexsort((key, -sure[at]))[:HANDED]
    return key[top], sure[at][top]


def surest(feats: DataFrame, targets: list[Target], meta: Meta, known: set[int]) -> DataFrame:
    """(g, key): for each target, view and class, g = (target * 2 + view) * 2 + class, the HANDED surest of all documents
    but the labelled ones (`known`) and those the other view has. Each task keeps its own best, so few rows shuffle."""
    shared = feats.sparkSession.sparkContext.broadcast(([t.views() for t in targets], meta, np.array(sorted(known), np.int64), [[np.array(sorted(x), np.int64) for x in t.taken] for t in targets]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("quality rounds")  # the memo of words is of no use here
        targets, meta, known, taken = shared.value
        none = np.empty(0, np.int64), np.empty(0, np.int32)
        best = [none] * (4 * len(targets))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys, rows = part.column(0).to_numpy(), Rows(_ids(part.column(1)))
                hot = meta.ids(np.array(part.column(2).to_pylist(), float))
                free = ~np.isin(keys, known)
                for i, t in enumerate(targets):
                    for k, dots in enumerate((rows.dot(t.w[0]), t.w[1][hot].sum(axis=1))):
                        p, may = t.sure(k, dots), free & ~np.isin(keys, taken[i][1 - k])
                        for value, sure in ((0, 1 - p), (1, p)):
                            g, ok = (2 * i + k) * 2 + value, may & (sure >= SURE)
                            best[g] = _best(np.append(best[g][0], keys[ok]), np.append(best[g][1], np.rint(sure[ok] * 1000).astype(np.int32)))
        for g, (key, sure) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), g, np.int32)), pa.array(key, pa.int64()), pa.array(sure.astype(np.int32))], ["g", "key", "sure"])

    rows = feats.select("key", "gaps", "meta").mapInArrow(run, "g int, key long, sure int").groupBy("g", "key").agg(F.max("sure").alias("sure"))
    parts = math.isqrt(feats.rdd.getNumPartitions()) + 1  # two steps, so that no task gets all tasks' best
    for by in (("g", F.pmod(F.xxhash64("key"), F.lit(parts))), ("g",)):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "key"))).where(F.col("n") <= HANDED).drop("n")
    return rows.select("g", "key")


def scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """docs with two more columns, the probabilities of quality and of toxicity, and their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)
    quality, toxic, *views = free_names(docs, "quality", "toxic", *(f"view{i}" for i in range(len(VIEW))))

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("quality", _forget)
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, meta = [], []
                for text, lang, source, n_chars in zip(*(part.column(n + i).to_pylist() for i in range(4))):
                    f, words, distinct = text_view(text)
                    ids.append(f)
                    meta.append(meta_view(text, lang, source, n_chars, words, distinct))
                rows, hot = Rows(ids), m.meta.ids(np.array(meta))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(m.quality.score(rows, hot)), pa.array(m.toxic.score(rows, hot))], names)

    out = T.StructType([*docs.schema.fields, T.StructField(quality, T.DoubleType()), T.StructField(toxic, T.DoubleType())])
    names = [f.name for f in out.fields]
    return docs.select("*", *(c.alias(v) for c, v in zip(_view(docs), views))).mapInArrow(run, out), quality, toxic


def keep(quality: str, toxic: str):
    """The documents that are not rejected."""
    return (F.col(quality) >= 0.5) & (F.col(toxic) < 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, quality, toxic = scored(docs, Model(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.col(quality).alias("quality_score"), F.col(toxic).alias("toxic_score"), keep(quality, toxic).alias("kept"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
