"""Mixing sources to target weights, with soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains. A rate r >= 0 per document (how
often it is drawn) is fitted so that the expected tokens of each domain, sum of r * tokens * posterior, match the
targets: of all rates that do, those nearest to 1 in the metric that weighs documents by their tokens. They are the
clipped sum of 1 and the posterior times one number per domain, so all documents of like membership get like rates.
Those few numbers come from Newton steps on the convex dual, one pass each, whose sums (curvature too) are all that
reaches the driver. Steps go on to the tolerance. Targets that cannot be met are met as nearly as can be in least
squares, and the misses are kept in the plan and reported as a warning.

The classifier is fitted on at most LABELLED labelled documents, those first in the order of a hash of doc_id. It has a
fixed size: hashed words by domains.

Defined results: a null text counts as empty and gets the prior; labelled rows whose domain is null or has no target
are unused; a domain without labelled documents keeps posterior 0 and its target is missed; without any labelled
document posteriors are the targets; with no tokens at all rates stay 1. A null doc_id has a rate of its own; rows that
repeat are rated each by itself and alike; extra columns are kept by `mixed`; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.llm.common import Workspace, claim, free_names, table

LABELLED, SIZE = 6000, 1 << 16
#: The most copies that `mixed` makes of a document; what this leaves short of the targets is reported.
MOST = 20.0
CLOSE = 1e-5
#: Weight of the distance from 1 beside the misses, made smaller until those are CLOSE or stay as they are.
WEIGHT, LESS = 1e-6, 1e-3
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        slot = self[word] = zlib.crc32(word) % SIZE
        return slot


_slots = _Slots()


def _forget() -> None:
    _slots.clear()


def slots(text: str | None) -> np.ndarray:
    """Hashes of all words of the text."""
    if len(_slots) > 150_000:
        _slots.clear()
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))


class Membership:
    """Posterior over domains: log count ratios of words, summed over the root of their number, with a temperature that
    is chosen on labelled rows held back."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, domains: list[str], fallback: np.ndarray):
        k = len(domains)
        self.domains, self.w, self.heat = domains, np.zeros((SIZE, k), np.float32), 1.0
        n = np.bincount(y, minlength=k).astype(float) if len(y) else np.zeros(k)
        if not n.sum():
            with np.errstate(divide="ignore"):
                self.prior = np.log(fallback)
            return
        with np.errstate(divide="ignore"):
            self.prior = np.log(n / n.sum())
        held = np.arange(len(y)) % 4 == 0
        train = ~held if len(y) >= 8 else np.ones(len(y), bool)
        counts = np.zeros((SIZE, k))
        for i in np.flatnonzero(train):
            np.add.at(counts[:, y[i]], rows[i], 1)
        share = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * SIZE))
        self.w = (share - share.mean(axis=1, keepdims=True)).astype(np.float32)
        check = np.flatnonzero(held)
        losses = []
        for heat in (heats := np.geomspace(0.1, 10, 15)):
            self.heat = heat
            p = np.stack([self.one(rows[i]) for i in check])
            losses.append(-np.log(p[np.arange(len(check)), y[check]] + 1e-12).mean())
        self.heat = float(heats[int(np.argmin(losses))])

    def one(self, row: np.ndarray) -> np.ndarray:
        x = self.prior + self.heat * (self.w[row].sum(axis=0, dtype=np.float64) / max(1, len(row)) ** 0.5 if len(row) else 0)
        x = np.exp(x - x.max())
        return x / x.sum()


def fit_membership(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> Membership:
    """labelled: doc_id, domain."""
    domains = sorted(targets)
    some = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # bounded, so it may be broadcast

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("mixing", _forget)
        for batch in batches:
            rows = [slots(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "domain", "slots"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    t = texts.join(F.broadcast(some), "doc_id").select("doc_id", "domain", "text").mapInArrow(run, "doc_id long, domain string, slots array<int>").toArrow().sort_by("doc_id")
    y = np.array([domains.index(d) for d in t.column("domain").to_pylist()], int)
    return Membership([np.asarray(r.values) for r in t.column("slots")], y, domains, _weights(targets))


def _weights(targets: dict[str, float]) -> np.ndarray:
    w = np.array([targets[d] for d in sorted(targets)], float)
    if not len(w) or (w < 0).any() or not w.sum():
        raise ValueError("targets are nonnegative weights, not all zero")
    return w / w.sum()


def posteriors(docs: DataFrame, model: Membership) -> DataFrame:
    """doc_id, n_tokens, p (posterior)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("mixing", _forget)
        m = shared.value
        for batch in batches:
            rows = [slots(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([m.one(r) for r in rows], pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


class Plan:
    """What a worker needs to rate documents. missed: relative misses of the domains at the end."""

    def __init__(self, k: int, floor: float, most: float | None):
        self.by, self.missed = np.zeros(k), np.zeros(k)
        self.floor, self.most = floor, most

    def rates(self, p: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        return np.clip(max(1.0, self.floor) + p @ (self.by if by is None else by), self.floor, self.most)


def fit_rates(rows: DataFrame, targets: dict[str, float], floor: float = 0.0, most: float | None = None, total: float | None = None) -> Plan:
    """rows: n_tokens, p. total: tokens wanted; by default as many as there are, or with a floor of 1 and more as many as
    the targets need when no document falls below it."""
    w, k = _weights(targets), len(targets)
    n = F.col("n_tokens").cast("double")
    sums = rows.agg(F.sum(n).alias("s"), *(F.sum(n * F.col("p")[i]).alias(f"m{i}") for i in range(k))).first()
    plan = Plan(k, floor, most)
    have = sums["s"] or 0.0
    if not have:
        return plan
    m = np.array([sums[f"m{i}"] for i in range(k)])
    if total is None:
        open_ = (w > 0) & (m > 0)
        total = have if floor < 1 or not open_.any() else float((m[open_] * floor / w[open_]).max())
    wide = 1 + k + k * k
    start, want = max(1.0, floor), w * total / have

    def sums_at(points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Per point of the dual: its value and gradient without targets and weight, and its curvature."""

        def run(batches) -> Iterator[pa.RecordBatch]:
            part = np.zeros((len(points), wide))
            for batch in batches:
                if batch.num_rows:
                    tokens = batch.column(0).to_numpy().astype(float)
                    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    for out, by in zip(part, points):
                        r = plan.rates(p, by)
                        # closed at the bounds: at the start all rates may lie on the floor, and must count as free
                        x = start + p @ by
                        free = tokens * ((x >= floor) & (x <= (np.inf if most is None else most)))
                        # the integral of the rate, in a form that does not cancel
                        out[0] += tokens @ (r * (p @ by) - (r - start) ** 2 / 2)
                        out[1 : 1 + k] += (r * tokens) @ p
                        out[1 + k :] += ((p * free[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.size)), pa.array(part.ravel() / have)], ["i", "x"])

        got = {r["i"]: r["x"] for r in rows.select("n_tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        flat = np.array([got.get(i, 0.0) for i in range(len(points) * wide)]).reshape(-1, wide)
        return [(x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k)) for x in flat]

    by, near = plan.by, CLOSE * total / have
    (value, got, curve), = sums_at([by])
    weight, before = WEIGHT, np.inf
    while np.abs(got - want).max() > near:
        slope = got - want + weight * by
        if np.abs(slope).max() > near / 100:
            step = np.linalg.solve(curve + weight * np.eye(k), -slope)
            points = [by + step / 2**i for i in range(16)]
            found = sums_at(points)
            values = [x[0] - want @ y + weight * (y @ y) / 2 for x, y in zip(found, points)]
            best = int(np.argmin(values))
            if values[best] < value - want @ by + weight * (by @ by) / 2:
                by, (value, got, curve) = points[best], found[best]
                continue
        miss = np.linalg.norm(got - want)  # the least for this weight
        if miss > 0.99 * before:
            break
        weight, before = weight * LESS, miss
    plan.by, plan.missed = by, (got - want) * have / total
    if np.abs(plan.missed).max() > CLOSE:
        warnings.warn("targets missed by shares of all tokens: " + ", ".join(f"{d} {x:+.2g}" for d, x in zip(sorted(targets), plan.missed)), stacklevel=2)
    return plan


def draws(doc_id: str = "doc_id", rate: str = "rate"):
    """Whole copies: the rate, rounded up with the probability of its fraction, by a hash of doc_id."""
    return F.floor(F.col(rate) + F.pmod(F.xxhash64(F.lit(7), F.col(doc_id)), F.lit(1 << 20)) / float(1 << 20)).cast("long")


def rated(rows: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_tokens, p, rate."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = np.array(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plan.rates(p))], ["doc_id", "n_tokens", "p", "rate"])

    return rows.select("doc_id", "n_tokens", "p").mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double")


def mixed(docs: DataFrame, labelled: DataFrame, work: Workspace, targets: dict[str, float] = TARGETS, floor: float = 1.0, most: float | None = MOST) -> DataFrame:
    """The documents, each as often as its rate says, at most `most` times; the same columns. With a floor of 1 none goes."""
    model = fit_membership(docs, labelled, targets)
    plan = fit_rates(work.write(posteriors(docs, model), "posteriors"), targets, floor, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)
    rate, view, copy = free_names(docs, "rate", "view", "copy")

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("mixing", _forget)
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                p = np.stack([m.one(slots(t.as_py())) for t in batch.column(n)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(plan.rates(p))], names)

    out = T.StructType([*docs.schema.fields, T.StructField(rate, T.DoubleType())])
    names = [f.name for f in out.fields]
    rows = docs.select("*", docs["text"].cast("string").alias(view)).mapInArrow(run, out)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), draws(rate=rate).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries here: the language of documents that `labels` covers."""
    return docs.select("doc_id", F.col("lang").cast("string").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "op4")
    model = fit_membership(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), TARGETS)
    rows = work.write(posteriors(docs, model), "posteriors")
    out = rated(rows, fit_rates(rows, TARGETS)).withColumn("copies", draws())
    return out.select("doc_id", "n_tokens", "rate", "copies", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))))


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
