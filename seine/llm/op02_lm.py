"""LM scoring with a hierarchical Pitman-Yor model.

A word is drawn from the restaurant of its context, the word before it; the parent of that is the restaurant of the last
two bytes of that word, shared by all contexts that end alike; their parent is the restaurant without context, over a
uniform base of the known words and one unknown. Contexts are hashed: the ending has 256 classes, and each class has
8192 restaurants that its words are hashed to, so there are 2**21 restaurants at any corpus size; words that share one
are taken for one context (the frequent ones rarely do). Counts of words in contexts are kept whole and grow with the
input, and the totals of the restaurants are summed in slices by tasks, so what reaches the driver is bounded.

1. Map: texts are cut into words by batches of bounded size. A batch sends each bucket of words its occurrences
   (context, document), packed. Words that are very common in a batch are aggregated first: their bucket gets counts per
   context only, and their occurrences stay in rows of their own, by word, share of the contexts and batch.
2. Each bucket counts customers per (word, context) over the training texts and starts with a table for each.
3. Gibbs sweeps: all customers of a cell (a word in a restaurant) are seated anew at once. Its number of tables is
   drawn from its conditional distribution given all others, in proportion to a generalised Stirling number (from the
   recurrence, or by numerical integration for large counts) and to the weights of opening tables, which have the
   parent's probability; each table sends a customer to the parent. After each sweep the discount and the strength of
   each level are drawn from their joint conditional on a grid: tasks add up the Stirling numbers of their cells for each
   discount, and the totals give the rest. Sweeps start from as many tables as cells without a parent would open, as
   totals fall to their level faster than they rise to it, and go on until the totals of tables settle. Buckets sweep
   in parallel with the totals of the sweep before. A bucket's seating is a file in the shared folder; its seed is
   fixed, so a task that runs again writes the same.
4. Predictive probabilities are averaged over the last sweeps; each bucket adds up their logarithms per document, the
   rows of common words meet the same share of their word's table, and sums meet by batch.

All texts and all training tokens take part. Defined results: a null text counts as empty (one end token); a null doc_id
counts as the empty text for the training split; repeated rows are documents of their own; without training texts the
score is that of the base alone; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm.common import Workspace, create, input_bytes, opened, table

FOLD, HELD = 7, 2
BATCH, DOCS = 1 << 20, 30_000
#: A word is common in a batch if it makes up this share of it.
COMMON = 1 / 400
#: At least SWEEPS sweeps; totals of tables have settled when a sweep moves them by SETTLED or, if that is more, by two
#: standard deviations of a count.
SWEEPS, AVERAGED, SETTLED, SMALL = 3, 2, 0.01, 512
#: Strengths at the start, and the grids that discounts and strengths are drawn from after each sweep.
STRENGTH = (50.0, 20.0, 5.0)  # without context, the end of the word before, the word before
DISCOUNTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
STRENGTHS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0)
END_WORD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the hash of a word beside its ending; restaurants by level; restaurants in a slice of totals; least and most
#: shares of a common word's contexts (an eighth of the buckets otherwise).
OWN_BITS = 13
LEVELS = (1, 256, 256 << OWN_BITS)
SLICE, SHARES = 1 << 15, (16, 512)


def packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    out = []
    while raw.tell() < len(raw.getbuffer()):
        out.append(np.load(raw, allow_pickle=False))
    return out


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLD != HELD


class Ids(dict):
    """Local word numbers, with the hash and the context that each word gives to the next one."""

    def __init__(self):
        super().__init__()
        self.hashes, self.contexts = [], []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        h = xxhash.xxh3_64_intdigest(word)
        self.hashes.append(h)
        self.contexts.append((zlib.crc32(word[-2:]) & 255) << OWN_BITS | h >> 64 - OWN_BITS)
        return n


FIELDS = "kind int, key long, batch long, data binary, more binary, a double, b double"
SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("batch", pa.int64()), ("data", pa.binary()), ("more", pa.binary()), ("a", pa.float64()), ("b", pa.float64())])
STATE, TOTAL, HOT, DOC, COUNT, SUM, TABLE, FIT = range(8)


def share_key(word: np.uint64, share: int) -> int:
    """A key of a common word and a share of its contexts."""
    return xxhash.xxh3_64_intdigest(int(word).to_bytes(8, "little"), seed=share) - (1 << 63)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def split_words(docs: DataFrame, buckets: int, shares: int) -> DataFrame:
    """Step 1: rows of kind STATE (key: bucket), HOT (key: word) and DOC."""

    def batch_rows(batch: int, ids: Ids, words: list[np.ndarray], doc_ids: list[int | None]) -> list[tuple]:
        hashes, ctx_of = np.append(np.array(ids.hashes, np.uint64), END_WORD), np.array([*ids.contexts, 0], np.uint32)
        n = np.array([len(w) for w in words], np.int64)
        word = np.concatenate(words)
        doc = np.repeat(np.arange(len(words), dtype=np.uint16), n)
        ctx = np.zeros(len(word), np.uint32)
        ctx[1:] = ctx_of[word[:-1]]
        ctx[np.cumsum(n)[:-1]] = 0
        train = np.array([in_training(d) for d in doc_ids])
        count = np.bincount(word, minlength=len(hashes))
        seen = np.flatnonzero(count)
        common = np.zeros(len(hashes), bool)
        common[seen] = count[seen] >= max(1024, COMMON * BATCH)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = seen[np.lexsort((hashes[seen], common[seen], bucket[seen]))]
        rank = np.empty(len(hashes), np.int32)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[word], kind="stable")
        ctx, doc = ctx[by], doc[by]
        stops = np.cumsum(count[order])
        starts = stops - count[order]
        bits = np.packbits(train)
        rows = [(DOC, batch % 64, batch, packed(np.array([d or 0 for d in doc_ids], np.int64), np.array([d is not None for d in doc_ids]), n, train), None, None, None)]
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for i, j in zip([0, *cut], [*cut, len(order)]):
            hot = np.flatnonzero(common[order[i:j]]) + i
            plain = order[i : hot[0] if len(hot) else j]
            a, b = starts[i], starts[i] + count[plain].sum()
            pre = []
            for h in hot:
                c, d = ctx[starts[h] : stops[h]], doc[starts[h] : stops[h]]
                values, m = np.unique(c, return_inverse=True)
                pre.append((values, np.bincount(m, train[d], len(values)).astype(np.uint32)))
                for share in range(shares):
                    some = c % shares == share
                    if some.any():
                        rows.append((HOT, share_key(hashes[order[h]], share), batch, packed(c[some], np.diff(d[some], prepend=np.uint16(0))), None, None, None))
            data = packed(
                hashes[plain], count[plain].astype(np.uint32), ctx[a:b], np.diff(doc[a:b], prepend=np.uint16(0)), bits, hashes[order[hot]], np.array([len(v) for v, _ in pre], np.int64),
                np.concatenate([v for v, _ in pre] or [np.empty(0, np.uint32)]), np.concatenate([m for _, m in pre] or [np.empty(0, np.uint32)]),
            )
            rows.append((STATE, int(bucket[order[i]]), batch, data, None, None, None))
        return rows

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, words, doc_ids, n = Ids(), [], [], 0
        get = ids.__getitem__

        def done():
            total = len(ids.hashes)  # the number of the end token in this batch
            return _rows(batch_rows((part << 24) + k, ids, [np.append(w, total) for w in words], doc_ids))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = (text.as_py() or "").encode().lower().split()
                words.append(np.fromiter(map(get, row), np.int32, len(row)))
                doc_ids.append(doc_id)
                n += len(row) + 1
                if n >= BATCH or len(words) >= DOCS:
                    yield done()
                    ids, words, doc_ids, n, k = Ids(), [], [], 0, k + 1
                    get = ids.__getitem__
        if words:
            yield done()

    return docs.mapInArrow(run, FIELDS)


class Bucket:
    """Words of a bucket (sorted hashes) with their (word, context) pairs and training counts, sorted."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, count: np.ndarray):
        self.words, self.pairs, self.count = words, pairs, count.astype(np.int64)
        self.ctx = (pairs & 0xFFFFFFFF).astype(np.int64)
        q = (pairs >> 32 << 8) | (self.ctx >> OWN_BITS)  # (word, ending), ascending as the pairs are
        first = np.flatnonzero(np.diff(q, prepend=-1))
        self.q, self.q_of = q[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(q))))
        self.q_ctx, self.w_of = self.q & 0xFF, self.q >> 8

    def start(self) -> list[np.ndarray]:
        """Tables, from the restaurant without context down: one wherever there is a customer."""
        t2 = np.minimum(self.count, 1)
        t1 = np.minimum(np.bincount(self.q_of, t2, len(self.q)), 1).astype(np.int64)
        t0 = np.minimum(np.bincount(self.w_of, t1, len(self.words)), 1).astype(np.int64)
        return [t0, t1, t2]

    def spread(self, discount: list[float]) -> list[np.ndarray]:
        """Tables at which sweeps start: c^d / Gamma(1 + d), what a cell without a parent opens."""
        out, c = [], self.count
        for d, up, n in ((discount[2], self.q_of, len(self.q)), (discount[1], self.w_of, len(self.words)), (discount[0], None, 0)):
            out.insert(0, np.clip(np.rint(c**d / math.gamma(1 + d)), np.minimum(c, 1), c).astype(np.int64))
            c = np.bincount(up, out[0], n).astype(np.int64) if n else c
        return out

    def customers(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        return [np.bincount(self.w_of, tables[1], len(self.words)).astype(np.int64), np.bincount(self.q_of, tables[2], len(self.q)).astype(np.int64), self.count]

    def places(self) -> list[np.ndarray]:
        return [np.zeros(len(self.words), np.int64), self.q_ctx, self.ctx]

    def probabilities(self, tables: list[np.ndarray], totals: Totals, upto: int = 2) -> list[np.ndarray]:
        """Predictive probabilities per level."""
        out, parent = [], 1 / (totals.types + 1)
        up = (None, self.w_of, self.q_of)
        for level, (c, t, at) in enumerate(zip(self.customers(tables), tables, self.places())):
            if level > upto:
                break
            d, s = totals.discount[level], totals.strength[level]
            above = parent if level == 0 else out[-1][up[level]]
            out.append((c - d * t + (s + d * totals.tables[level][at]) * above) / (s + totals.customers[level][at]))
        return out

    def sweep(self, tables: list[np.ndarray], totals: Totals, rng: np.random.Generator) -> list[np.ndarray]:
        """Gibbs moves from the contexts up; tables opened or closed below are customers come or gone above."""
        tables = list(tables)
        for level in (2, 1, 0):
            c, d = self.customers(tables)[level], totals.discount[level]
            t = np.minimum(c, 1)
            some = np.flatnonzero(c > 1)
            if len(some):
                at = self.places()[level][some]
                if level:
                    above = self.probabilities(tables, totals, level - 1)[-1][(self.w_of, self.q_of)[level - 1][some]]
                else:
                    above = np.full(len(some), 1 / (totals.types + 1))
                others = totals.tables[level][at] - tables[level][some]
                t[some] = seated(c[some], totals.strength[level] / d + others, above, d, rng)
            tables[level] = t
        return tables


class Totals:
    def __init__(self, discount: list[float], types: float):
        self.discount, self.strength, self.types = list(discount), list(STRENGTH), types
        self.customers, self.tables = [np.zeros(n, np.float32) for n in LEVELS], [np.zeros(n, np.float32) for n in LEVELS]

    def __getstate__(self) -> bytes:
        return packed(np.array([*self.discount, *self.strength, self.types]), *self.customers, *self.tables)

    def __setstate__(self, data: bytes) -> None:
        own, *sums = unpacked(data)
        self.discount, self.strength, self.types = own[:3].tolist(), own[3:6].tolist(), float(own[6])
        self.customers, self.tables = sums[:3], sums[3:]

    def drawn(self, fits: np.ndarray, rng: np.random.Generator) -> None:
        """Draw discount and strength of each level. fits: per level and discount the sum of log S(c, t) over all cells."""
        for level in range(3):
            some = self.customers[level] > 1
            both, n = np.unique(self.customers[level][some].astype(np.int64) << 32 | self.tables[level][some].astype(np.int64), return_counts=True)
            if not len(n):
                continue
            c, t = (both >> 32).astype(float), (both & 0xFFFFFFFF).astype(float)
            d, s = (x.ravel() for x in np.meshgrid(DISCOUNTS, STRENGTHS, indexing="ij"))
            p = np.repeat(fits[level], len(STRENGTHS))
            for i in range(len(d)):
                opened_ = (t - 1) * math.log(d[i]) + log_gamma(s[i] / d[i] + t) - math.lgamma(s[i] / d[i] + 1)
                p[i] += n @ (opened_ - log_gamma(s[i] + c) + math.lgamma(s[i] + 1))
            k = int(np.argmax(p + rng.gumbel(size=len(p))))
            self.discount[level], self.strength[level] = float(d[k]), float(s[k])


def stirling_sums(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum of log S(c, t) over cells, for each of DISCOUNTS."""
    both, n = np.unique(c.astype(np.int64) << 32 | t.astype(np.int64), return_counts=True)
    c, t = both >> 32, both & 0xFFFFFFFF
    small = c <= SMALL
    big, u = c[~small].astype(float), t[~small].astype(float)
    one, mid = u == 1, (u > 1) & (u < big)
    out = []
    for d in DISCOUNTS:
        x = np.zeros(len(big))
        x[one] = log_gamma(big[one] - d) - math.lgamma(1 - d)
        for i in np.array_split(np.flatnonzero(mid), max(1, mid.sum() // 4096)):
            x[i] = large(big[i], u[i], d)
        out.append(float(n[small] @ stirling(d)[c[small], t[small]] + n[~small] @ x))
    return np.array(out)


@lru_cache(32)
def stirling(d: float) -> np.ndarray:
    """[c, t]: logarithm of the generalised Stirling number S(c, t), the weight of all ways to seat c customers at t tables."""
    s = np.full((SMALL + 1, SMALL + 1), -np.inf)
    s[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(1, SMALL + 1):
            t = np.arange(1, c + 1)
            s[c, 1 : c + 1] = np.logaddexp(s[c - 1, t - 1], np.log(np.maximum(c - 1 - d * t, 0)) + s[c - 1, t])
    return s


@lru_cache(8)
def alone(d: float) -> np.ndarray:
    """[c, t]: probability that one of c customers at t tables sits alone: S(c-1, t-1) / S(c, t)."""
    s, out = stirling(d), np.zeros((SMALL + 1, SMALL + 1))
    with np.errstate(invalid="ignore"):
        out[1:, 1:] = np.exp(s[:-1, :-1] - s[1:, 1:])
    out[1, 1] = 1
    return np.nan_to_num(out)


def log_gamma(x: np.ndarray) -> np.ndarray:
    y, below = x + 8, np.ones_like(x)
    for i in range(8):
        below = below * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(below)


@lru_cache(32)
def _saddles(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log c/t, ascending, and log of the saddle point (see `large`)."""
    y = np.concatenate((np.geomspace(1e-40, 0.5, 6000), 1 - np.geomspace(0.5, 1e-12, 3000)[1:]))[::-1]
    return np.log((1 - y) * d * y ** (d - 1) / -np.expm1(d * np.log(y))), np.log(y)


def large(c: np.ndarray, t: np.ndarray, d: float, points: int = 40) -> np.ndarray:
    """log S(c, t) for any count: S is c!/t! times the coefficient of x^c in ((1 - (1-x)^d) / d)^t, a contour integral. The
    contour, with y = 1 - x, is a parabola through the saddle point, or near 0, around the cut."""
    mid = np.maximum(np.exp(np.interp(np.log(c / t), *_saddles(d))), np.minimum(1 / c, 0.5))
    g = (1 - mid) * d * mid ** (d - 1) / (1 - mid**d)
    curve = t * np.abs(g * (1 + (1 - d) * (1 - mid) / mid - g))
    top = np.minimum(4 * (1 - mid) / (mid * np.sqrt(np.maximum(curve, 1e-9))), np.sqrt(np.expm1(40 / c) / mid) + 1)
    turn = 1 + 1j * (np.arange(points) + 0.5) / points * top[..., None]
    y = mid[..., None] * turn**2
    e = t[..., None] * np.log((1 - np.exp(d * np.log(y))) / d) - (c[..., None] + 1) * np.log(1 - y) + np.log(2 * mid[..., None] * turn)
    most = e.real.max(axis=-1)
    return np.log(np.exp(e - most[..., None]).real.sum(axis=-1) * top / points / math.pi) + most + log_gamma(c + 1) - log_gamma(t + 1)


def seated(c: np.ndarray, base: np.ndarray, above: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells with c > 1 customers, drawn in proportion to S(c, t) * prod_{j<t} above * d * (base + j)."""
    out, u, w = np.empty(len(c), np.int64), rng.random(len(c)), np.log(above * d)
    at = 1
    while at < SMALL:  # counts of like size together, as many columns as the largest has tables
        band = np.flatnonzero((c > at) & (c <= (at := 2 * at)))
        j = np.arange(at)
        for i in np.split(band, range((1 << 19) // at, len(band), (1 << 19) // at)):
            p = stirling(d)[c[i], 1 : at + 1] + np.cumsum(np.log(base[i, None] + j) + w[i, None], axis=1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            out[i] = np.minimum(1 + (p < u[i, None] * p[:, -1:]).sum(axis=1), c[i])
    rest = np.flatnonzero(c > SMALL)
    for i in np.split(rest, range(256, len(rest), 256)):
        if len(i):
            out[i] = _seated_large(c[i].astype(float), base[i], w[i], d, u[i])
    return out


def _seated_large(c: np.ndarray, base: np.ndarray, w: np.ndarray, d: float, u: np.ndarray, nodes: int = 24) -> np.ndarray:
    """The same for large counts: around the mode, with the smooth logarithm interpolated between Chebyshev nodes."""
    log_p = lambda t, c=c, base=base, w=w: large(c + 0 * t, t, d) + t * w + log_gamma(base + t)

    def rise(t):
        """The slope of log_p past t, by the saddle point alone, which is near enough to find the mode."""
        y = np.exp(np.interp(np.log(c / t), *_saddles(d)))
        return np.log((1 - y**d) / d) - np.log(t + 0.5) + w + np.log(base + t)

    lo, hi = np.ones(len(c)), c - 1
    while (hi - lo > 1).any():  # the mode: the logarithm is concave
        mid = np.floor((lo + hi) / 2)
        up = rise(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    near = np.clip(lo, 2, c - 3)
    wide = 10 / np.sqrt(np.maximum((rise(near - 1) - rise(near + 1)) / 2, 1e-12)) + 12
    lo, hi = np.maximum(1, np.floor(lo - wide)), np.minimum(c, np.ceil(lo + wide))
    x = np.cos((np.arange(nodes) + 0.5) * np.pi / nodes)
    t = (lo + hi)[:, None] / 2 + (hi - lo)[:, None] / 2 * x
    values = log_p(t, c[:, None], base[:, None], w[:, None])
    fits = np.polynomial.chebyshev.chebfit(x, (values - values.max(axis=1, keepdims=True)).T, nodes - 1)
    out = np.empty(len(c), np.int64)
    for i, (a, b) in enumerate(zip(lo, hi)):
        p = np.cumsum(np.exp(np.polynomial.chebyshev.chebval(np.linspace(-1, 1, int(b - a) + 1), fits[:, i])))
        out[i] = a + min(np.searchsorted(p, u[i] * p[-1]), b - a)
    return out


def build_states(rows: DataFrame) -> DataFrame:
    """Step 2: rows in the order of (kind, key). STATE rows with the pairs and the occurrences of a bucket; counts of
    the first seating; HOT and DOC rows as they came."""

    def bucket_rows(key: int, held: list[tuple[int, bytes]], counts: np.ndarray) -> tuple:
        parts = [(batch, *unpacked(data)) for batch, data in held]
        all_words = np.concatenate([x for p in parts for x in (p[1], p[6])])
        words, inverse = np.unique(all_words, return_inverse=True)
        at, pairs, weight, ref, hot = 0, [], [], [], []
        for i, (_, h, n, ctx, doc, bits, hh, hn, hctx, hcount) in enumerate(parts):
            w, at = inverse[at : at + len(h)], at + len(h)
            d = np.cumsum(doc, dtype=np.uint16)
            pairs.append(np.repeat(w, n).astype(np.int64) << 32 | ctx)
            weight.append(np.unpackbits(bits)[d])
            ref.append(np.uint32(i) << np.uint32(16) | d)
            w, at = inverse[at : at + len(hh)], at + len(hh)
            hot.append((np.repeat(w, hn).astype(np.int64) << 32 | hctx, hcount))
        occ, more = np.concatenate(pairs), np.concatenate([p for p, _ in hot])
        found, where = np.unique(np.concatenate((occ, more)), return_inverse=True)
        count = np.bincount(where, np.concatenate((*weight, *(c for _, c in hot))), len(found)).astype(np.uint32)
        b = Bucket(words, found, count)
        tables = b.start()
        for level, c in enumerate(b.customers(tables)):
            counts[2 + 2 * level : 4 + 2 * level] += (c == 1).sum(), (c == 2).sum()
        per_word = np.bincount(found >> 32, count, len(words))
        counts[:2] += count.sum(), (per_word > 0).sum()
        order = np.argsort(where[: len(occ)], kind="stable")
        n_occ = np.bincount(where[: len(occ)], minlength=len(found)).astype(np.uint32)
        is_hot = np.unique(np.concatenate([p[6] for p in parts]))
        pair_data = packed(words, np.bincount(found >> 32, minlength=len(words)).astype(np.uint32), (found & 0xFFFFFFFF).astype(np.uint32), count)
        return (STATE, key, 0, pair_data, packed(n_occ, np.concatenate(ref)[order], np.array([p[0] for p in parts], np.int64), is_hot), None, None)

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(8)
        key, held, any_ = None, [], False
        for batch in batches:
            for kind, k, b, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                any_ = True
                if held and (kind != STATE or k != key):
                    yield _rows([bucket_rows(key, held, counts)])
                    held = []
                if kind == STATE:
                    key = k
                    held.append((b, data))
                else:
                    yield _rows([(kind, k, b, data, None, None, None)])
        if held:
            yield _rows([bucket_rows(key, held, counts)])
        if any_:
            yield _rows([*((COUNT, i, 0, None, None, float(x), None) for i, x in enumerate(counts))])

    return rows.mapInArrow(run, FIELDS)


def _total_rows(totals: list[np.ndarray]) -> list[tuple]:
    """Totals of a task in slices of restaurants; empty ones are left out."""
    rows = []
    for level, sums in enumerate(totals):
        for i in range(0, sums.shape[1], SLICE):
            if (part := sums[:, i : i + SLICE]).any():
                rows.append((TOTAL, level << 32 | i, 0, packed(part.astype(np.float32)), None, None, None))
    return rows


def _gathered(rows: DataFrame, base: Totals, seed: int | None = None) -> Totals:
    """Slices are summed by tasks; the driver gets a bounded number of them, and few other sums. With a seed, discounts and
    strengths are drawn too."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is not None and key != now:
                    yield _rows([(TOTAL, now, 0, packed(total.astype(np.float32)), None, None, None)])
                    total = None
                now, part = key, unpacked(data)[0].astype(np.float64)
                total = part if total is None else total + part
        if now is not None:
            yield _rows([(TOTAL, now, 0, packed(total.astype(np.float32)), None, None, None)])

    out = Totals(base.discount, base.types)
    out.strength = list(base.strength)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = rows.where(F.col("kind") == TOTAL).select("key", "data").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, FIELDS)
    for key, data in slices.select("key", "data").collect():
        c, t = unpacked(bytes(data))[0]
        level, i = key >> 32, key & 0xFFFFFFFF
        out.customers[level][i : i + len(c)], out.tables[level][i : i + len(t)] = c, t
    if seed is not None:
        fits = np.zeros((3, len(DISCOUNTS)))
        for r in rows.where(F.col("kind") == FIT).groupBy("key").agg(F.sum("a").alias("a")).collect():
            fits[r["key"] >> 8, r["key"] & 255] = r["a"]
        out.drawn(fits, np.random.default_rng(seed))
    return out


def _bucket(data: bytes) -> Bucket:
    words, n, ctx, count = unpacked(data)
    return Bucket(words, np.repeat(np.arange(len(words)), n) << 32 | ctx.astype(np.int64), count)


def swept(states: DataFrame, shared: Broadcast, s: int, seats: list[str]) -> DataFrame:
    """Step 3: totals and fits after sweep s (0: the start), which reads seats[s - 1] and writes seats[s]; shared: the
    totals before it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last, totals, fits = shared.value, [np.zeros((2, n)) for n in LEVELS], np.zeros((3, len(DISCOUNTS)))
        for batch in batches:
            for key, data in zip(*(batch.column(i).to_pylist() for i in range(2))):
                b = _bucket(data)
                tables = b.sweep(_seats(seats[s - 1], key), last, np.random.default_rng([key, s])) if s else b.spread(last.discount)
                with create(f"{seats[s]}/{key}") as out:
                    out.write(packed(*tables))
                for level, (c, t, place) in enumerate(zip(b.customers(tables), tables, b.places())):
                    totals[level][0] += np.bincount(place, c, LEVELS[level])
                    totals[level][1] += np.bincount(place, t, LEVELS[level])
                    some = c > 1
                    fits[level] += stirling_sums(c[some], t[some])
        yield _rows([*_total_rows(totals), *((FIT, level << 8 | i, 0, None, None, float(x), None) for level in range(3) for i, x in enumerate(fits[level]))])

    return states.select("key", "data").mapInArrow(run, FIELDS)


def _seats(path: str, key: int) -> list[np.ndarray]:
    with opened(f"{path}/{key}") as f:
        return unpacked(f.read())


def settled(before: Totals, after: Totals) -> bool:
    """Whether a sweep moved the tables of no level by more than chance or SETTLED."""
    pairs = [(a.sum(), b.sum()) for a, b in zip(before.tables, after.tables)]
    return all(abs(a - b) <= max(SETTLED * a, 2 * a**0.5) for a, b in pairs)


def _sums(batch: int, docs: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> tuple:
    """Sums per document of a batch."""
    n = int(docs.max()) + 1 if len(docs) else 0
    some = np.flatnonzero(np.bincount(docs, minlength=n)).astype(np.uint16)
    return (SUM, 0, batch, packed(some, np.bincount(docs, score, n)[some], np.bincount(docs, base, n)[some], np.bincount(docs, known, n)[some].astype(np.uint32)), None, None, None)


def final_sums(states: DataFrame, history: list[Totals], seats: list[str], shares: int) -> DataFrame:
    """Step 4 for the occurrences in buckets: SUM rows; and TABLE rows with the probabilities of common words (key: word
    and share of the contexts)."""
    shared = states.sparkSession.sparkContext.broadcast(history)

    def run(batches) -> Iterator[pa.RecordBatch]:
        history = shared.value
        for batch in batches:
            for key, data, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = _bucket(data)
                n_occ, ref, batch_ids, hot = unpacked(more)
                p = np.zeros(len(b.pairs))
                for path, totals in zip(seats, history):
                    p += b.probabilities(_seats(path, key), totals)[2] / len(seats)
                p = np.log10(p)
                c = np.bincount(b.pairs >> 32, b.count, len(b.words))
                base, known = np.log10(c + 1), c > 0
                word = b.pairs >> 32
                score_of, word_of = np.repeat(p, n_occ), np.repeat(word, n_occ)
                part = ref >> np.uint32(16)
                by = np.argsort(part.astype(np.uint16), kind="stable")
                cuts = np.searchsorted(part[by], np.arange(len(batch_ids) + 1))
                rows = []
                for i, batch_id in enumerate(batch_ids.tolist()):
                    at = by[cuts[i] : cuts[i + 1]]
                    if len(at):
                        rows.append(_sums(batch_id, (ref[at] & np.uint32(0xFFFF)).astype(np.int64), score_of[at], base[word_of[at]], known[word_of[at]]))
                for w in np.searchsorted(b.words, hot):
                    a, z = np.searchsorted(word, [w, w + 1])
                    for share in range(shares):
                        some = np.flatnonzero(b.ctx[a:z] % shares == share) + a
                        if len(some):
                            rows.append((TABLE, share_key(b.words[w], share), 0, packed(b.ctx[some].astype(np.uint32), p[some]), None, float(base[w]), float(known[w])))
                for i in range(0, len(rows), 64):
                    yield _rows(rows[i : i + 64])

    return states.select("key", "data", "more").mapInArrow(run, FIELDS)


def hot_sums(occurrences: DataFrame, tables: DataFrame) -> DataFrame:
    """Step 4 for common words: each share's table goes ahead of its occurrences, so no table is copied per batch."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        at = p = None
        for batch in batches:
            for kind, batch_id, data, base, known in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == TABLE:
                    (at, p), word = unpacked(data), (base, known)
                    continue
                ctx, doc = unpacked(data)
                d = np.cumsum(doc, dtype=np.uint16).astype(np.int64)
                yield _rows([_sums(batch_id, d, p[np.searchsorted(at, ctx)], np.full(len(d), word[0]), np.full(len(d), word[1]))])

    cols = ["kind", "key", "batch", "data", "a", "b"]
    parts = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = tables.select(cols).union(occurrences.select(cols)).repartition(parts, "key").sortWithinPartitions("key", F.desc("kind"), "batch")
    return both.select("kind", "batch", "data", "a", "b").mapInArrow(run, FIELDS)


def per_document(rows: DataFrame, tokens: float, types: float) -> DataFrame:
    """DOC and SUM rows, dealt and sorted by batch, DOC first."""
    floor = np.log10(tokens + types + 1)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, doc, sums = None, None, None

        def done():
            ids, there, n, train = doc
            return pa.RecordBatch.from_arrays([
                pa.array(ids, mask=~there), pa.array(~train), pa.array(n), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(n), int(tokens))),
                pa.array(sums[1] - n * floor), pa.array(sums[0]),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for kind, b, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == DOC:
                    if now is not None:
                        yield done()
                    now, doc = b, unpacked(data)
                    sums = np.zeros((3, len(doc[2])))
                else:
                    at, *more = unpacked(data)
                    for s, x in zip(sums, more):
                        s[at] += x
        if now is not None:
            yield done()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("kind", "batch", "data").repartition(parts, "batch").sortWithinPartitions("batch", "kind")
    return dealt.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame, work: Workspace, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. sweeps: how many there are at least."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    buckets = max(64, input_bytes(docs, "text") >> 24)
    shares = min(max(buckets // 8, SHARES[0]), SHARES[1])
    parts = max(buckets // 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = work.path("states")
    # common words' rows are dealt by word, share and batch, so that no word is hot
    dealt = split_words(docs, buckets, shares).repartition(parts, F.col("kind"), F.when(F.col("kind") == STATE, F.col("key")).otherwise(F.xxhash64("key", "batch"))).sortWithinPartitions("kind", "key", "batch")
    build_states(dealt).write.partitionBy("kind").parquet(path)
    rows = work.spark.read.schema(FIELDS).parquet(path)
    of = lambda kind: rows.where(F.col("kind") == kind)
    counts = {r["key"]: r["a"] for r in of(COUNT).groupBy("key").agg(F.sum("a").alias("a")).collect()}
    get = lambda i: counts.get(i, 0.0)
    discount = [float(np.clip(get(2 + 2 * i) / max(1.0, get(2 + 2 * i) + 2 * get(3 + 2 * i)), 0.1, 0.95)) for i in range(3)]
    base = Totals(discount, get(1))
    seats, states = [work.path("seats")], of(STATE)

    def after(s: int, last: Totals) -> Totals:
        # the rows of a sweep are read twice, and a second run of the sweep would write its files again
        shared = work.spark.sparkContext.broadcast(last)
        rows = work.write(swept(states, shared, s, seats), "swept")
        found = _gathered(rows, last, s)
        work.drop(rows)
        shared.destroy()
        return found

    history = [after(0, base)]
    while len(history) <= max(sweeps, AVERAGED - 1) or not settled(*history[-2:]):
        seats.append(work.path("seats"))
        history.append(after(len(history), history[-1]))
        if len(history) > AVERAGED + 1:
            history[-AVERAGED - 2] = None
        if len(seats) > AVERAGED:
            work.drop(seats[-1 - AVERAGED])
    found = work.path("sums")
    final_sums(states, history[-AVERAGED:], seats[-AVERAGED:], shares).write.partitionBy("kind").parquet(found)
    sums = work.spark.read.schema(FIELDS).parquet(found)
    hot = hot_sums(of(HOT), sums.where(F.col("kind") == TABLE))
    cols = ["kind", "batch", "data"]
    return per_document(of(DOC).select(cols).union(sums.where(F.col("kind") == SUM).select(cols)).union(hot.select(cols)), get(0), get(1))


def perplexity(found: DataFrame) -> DataFrame:
    """held_out, perplexity, base_perplexity of all tokens, from the rows of `scores`."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return found.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


QUERIES = {"op2_lm": op2_lm}
SQL: dict[str, str] = {}
