"""Operators 2, 3, 4, 6 and 9 and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from seine.llm import op02_lm as lm
from seine.llm import op03_quality as q
from seine.llm import op04_mixing as mix
from seine.llm import op06_lines as li
from seine.llm import op09_audio as au
from seine.llm.common import Workspace


def test_lm(spark, big, odd):
    for docs, least in ((big, 1.5), (odd, None)):
        rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in docs.collect()]
        got = {(r["doc_id"], r["n_tokens"]): r for r in lm.scores(docs, Workspace(spark, "t")).collect()}
        train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
        c = Counter(w for d, ws in rows if train(d) for w in ws)
        n, v = sum(c.values()), len(c)
        held = [0.0, 0.0, 0]
        for d, ws in rows:
            r = got[d, len(ws)]
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
            assert (r["held_out"], r["n_known"], r["train_tokens"]) == (not train(d), sum(c[w] > 0 for w in ws), n)
            assert r["base_score"] == pytest.approx(base) and r["score"] <= 0 and math.isfinite(r["score"])
            if not train(d):
                held = [held[0] + base, held[1] + r["score"], held[2] + len(ws)]
        if least:
            assert 10 ** ((held[1] - held[0]) / held[2]) > least  # perplexity is that much lower
    assert lm.scores(odd.limit(0), Workspace(spark, "t")).count() == 0


def test_lm_probabilities_sum_to_one():
    """Over all words, at any context, after sweeps."""
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(0, 2**63, 40, dtype=np.uint64))
    pairs = np.unique((rng.integers(0, 40, 900) << 32) | rng.integers(0, 3, 900) << lm.OWN_BITS | rng.integers(0, 5, 900))
    count = rng.geometric(0.1, len(pairs))
    # a bucket that knows every (word, context) pair, with zero counts where there is none
    every = np.unique(np.concatenate((pairs, (np.arange(40)[:, None] << 32 | np.unique(pairs & 0xFFFFFFFF)).ravel())))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, pairs)] = count
    b = lm.Bucket(words, every, full)
    tables = b.start()
    for s in range(4):
        totals = lm.Totals([0.3, 0.5, 0.7], 40)
        for level, (c, t, at) in enumerate(zip(b.customers(tables), tables, b.places())):
            assert ((t <= c) & (t >= np.minimum(c, 1))).all()
            np.add.at(totals.customers[level], at, c)
            np.add.at(totals.tables[level], at, t)
        p = b.probabilities(tables, totals)[2]
        per = np.bincount(b.ctx, p)
        # the one unknown word has what is left
        assert (per[per > 0] < 1).all() and (per[per > 0] > 0.9).all()
        tables = b.sweep(tables, totals, np.random.default_rng(s))


def test_alone_is_exact():
    """Against all ways to seat five customers."""
    d, c = 0.4, 5
    mass = Counter()

    def seat(sizes, k, p, last_alone):
        if k == c:
            mass[len(sizes), last_alone] += p
            return
        for i in range(len(sizes)):
            seat(sizes[:i] + [sizes[i] + 1] + sizes[i + 1 :], k + 1, p * (sizes[i] - d), False)
        seat(sizes + [1], k + 1, p, True)

    seat([], 0, 1.0, False)
    for t in range(1, c + 1):
        assert lm.alone(d)[c, t] == pytest.approx(mass[t, True] / (mass[t, True] + mass[t, False]))


def test_quality(spark, odd, sf):
    d = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit = labels.where("doc_id % 3 <> 0")
    model = q.Model(docs, fit)
    rows, qs, ts = q.scored(docs, model)
    held = rows.join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = held.select(F.avg(((F.col(qs) >= 0.5).cast("int") == F.col("quality")).cast("int")).alias("q"), F.avg(((F.col(ts) >= 0.5).cast("int") == F.col("toxic")).cast("int")).alias("t"), F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), q.keep(qs, ts).cast("int"))).alias("k")).first()
    assert r["q"] > 0.97 and r["t"] > 0.96 and r["k"] > 0.97
    clash = odd.selectExpr("*", "1 as seine_quality", "2 as seine_toxic", "3 as view0_", "4 as seine_view0")
    got, qs, ts = q.scored(clash, model)
    assert got.columns[: len(clash.columns)] == clash.columns and got.where(F.col(qs).between(0, 1) & F.col(ts).between(0, 1)).count() == odd.count()
    none = labels.limit(0)
    got, qs, ts = q.scored(odd, q.Model(odd, none))
    assert got.where(q.keep(qs, ts)).count() == odd.count()
    bad = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.scored(odd, q.Model(odd, bad))[0].count() == odd.count() and q.scored(odd.limit(0), q.Model(odd.limit(0), bad))[0].count() == 0


def test_quality_surest(spark, odd, big, labels, monkeypatch):
    """The documents handed over are the surest of all rows, copies once, against a plain sort on the driver."""
    monkeypatch.setattr(q, "HANDED", 7)
    docs = big.select("doc_id", "text", "lang", "source", "n_chars").union(big.select(F.lit(None), "text", "lang", "source", "n_chars")).union(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    model = q.Model(docs, labels)
    feats = q.features(docs).repartition(13).cache()
    rows = feats.toArrow()
    key, words = rows.column("key").to_numpy(), q.Rows(q._ids(rows.column("gaps")))
    hot = model.meta.ids(np.array(rows.column("meta").to_pylist()))
    targets, known = [t for t in (model.quality, model.toxic) if t.learns], {int(k) for k in key[::5]}
    assert len(targets) == 2
    for t in targets:
        t.taken = [{int(k) for k in key[1::7]}, {int(k) for k in key[2::7]}]
    want = set()
    for i, t in enumerate(targets):
        for k, dots in enumerate((words.dot(t.w[0]), t.w[1][hot].sum(axis=1))):
            p = t.sure(k, dots)
            for value, sure in ((0, 1 - p), (1, p)):
                able = {(-int(np.rint(s * 1000)), int(d)) for s, d in zip(sure, key) if s >= q.SURE and int(d) not in known | t.taken[1 - k]}
                want |= {((2 * i + k) * 2 + value, d) for _, d in sorted(able)[:7]}
    got = [tuple(r) for r in q.surest(feats, targets, model.meta, known).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 14
    figures = np.ceil(np.minimum(np.array(rows.column("meta").to_pylist())[:, 2:], 64) * 1000) / 1000
    assert np.allclose(q._cuts(feats), np.quantile(figures, np.arange(1, q.BINS) / q.BINS, axis=0, method="inverted_cdf").T)


def test_mixing(spark, big, labels, odd, sf):
    work = Workspace(spark, "t")
    model = mix.fit_membership(big, mix.labelled_languages(big, labels), mix.TARGETS)
    rows = work.write(mix.posteriors(big, model), "p")
    plan = mix.fit_rates(rows, mix.TARGETS)
    got = mix.rated(rows, plan).collect()
    n, p, r = np.array([x["n_tokens"] for x in got]), np.array([x["p"] for x in got]), np.array([x["rate"] for x in got])
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    total = (n * r) @ p
    assert np.abs(total / n.sum() - [0.2, 0.4, 0.2, 0.2]).max() < 1e-3
    d = sf.replace("sf0.001", "sf0.1")
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = mix.posteriors(docs, mix.fit_membership(docs, mix.labelled_languages(docs, lab), mix.TARGETS)).join(docs.select("doc_id", "lang").join(lab, "doc_id", "left_anti"), "doc_id").collect()
    assert np.mean([sorted(mix.TARGETS)[x["p"].index(max(x["p"]))] == x["lang"] for x in held]) > 0.97
    out = mix.mixed(big, mix.labelled_languages(big, labels), work)
    assert out.columns == big.columns and out.select("doc_id").distinct().count() == big.count() <= out.count()
    lab = spark.createDataFrame([(1, "en"), (4, None), (9, "es"), (13, "fr"), (None, "de")], "doc_id long, domain string")
    clash = odd.selectExpr("*", "1 as rate_", "2 as view_", "3 as copy_", "4 as seine_rate", "5 as seine_view", "6 as seine_copy")
    out = mix.mixed(clash, lab, work)
    assert out.columns == clash.columns and out.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2 * mix.MOST
    assert mix.mixed(odd, lab.limit(0), work).count() >= odd.count() and mix.mixed(odd.limit(0), lab, work).count() == 0


def brute_lines(rows, w):
    """Every qualifying window of lines, in order; a window seen before is deleted."""
    lines = {d: [(i, x) for i, raw in enumerate(t.split("\n")) if (x := raw.strip(" \t\r\x0b\x0c"))] for d, t in rows}
    seen, gone = {}, set()
    for d in sorted(lines):
        ls = lines[d]
        for i in range(len(ls)):
            for k in range(i + 1, len(ls) + 1):
                key = tuple(x for _, x in ls[i:k])
                if sum(len(x.split()) for x in key) >= w:
                    if key in seen:
                        gone |= {(d, at) for at, _ in ls[i:k]}
                    seen.setdefault(key, (d, i))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_lines(spark, odd):
    import random

    rng = random.Random(9)
    pool = ["a", "b c", "d e f", "g h i j k l", "", "m n o p q r s t u v w x", "  b c "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for w in (10, 3, 1):
        want = brute_lines(rows, w)
        got = {r["doc_id"]: r["text"] for r in li.without_copies(docs, Workspace(spark, "t"), w, drop_empty=False).collect()}
        assert got == want
    dropped = li.without_copies(docs, Workspace(spark, "t"), 10)
    assert {r["doc_id"] for r in dropped.collect()} == {d for d, t in rows if (x := brute_lines(rows, 10)[d]).strip() or x == t}
    got = {r["doc_id"]: r["text"] for r in li.without_copies(odd, Workspace(spark, "t")).collect()}
    assert got[3] is None and got[4] == "" and got[5] == " \n\t " and 2 not in got and 7 not in got and 12 not in got and got[11] == "\nother" and got[10].count("\n") == 2 and got[None]
    out = li.without_copies(odd, Workspace(spark, "t"))
    assert out.columns == odd.columns and out.where("doc_id = 8").count() == 2 and li.without_copies(odd.limit(0), Workspace(spark, "t")).count() == 0


def audio(spark, docs):
    work = Workspace(spark, "t9")
    return au.audio_features(work.write(au.stored_media(docs), "media"), work.path("tensors"))


def plain_log_mel(x):
    """Frame by frame: the input with zeros between, the whole low pass, every DOWN-th sample; windows; triangles on the mel scale."""
    up = np.zeros(len(x) * au.UP)
    up[:: au.UP] = (x.astype(float) - 128) / 128
    y = np.convolve(up, au.phases().T.reshape(-1))[:: au.DOWN]
    n = -(-len(x) * au.UP // au.DOWN)
    frames = 1 + max(0, -(-(n - au.FRAME) // au.HOP))
    y = np.append(y, np.zeros(au.FRAME + au.HOP))
    rate = au.RATE * au.UP / au.DOWN
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edge = [to_hz(m) for m in np.linspace(0, to_mel(rate / 2), au.MELS + 2)]
    out, energy = [], []
    for i in range(frames):
        w = y[i * au.HOP : i * au.HOP + au.FRAME] * np.hanning(au.FRAME)
        power = np.abs(np.fft.fft(w, au.FFT)[: au.FFT // 2 + 1]) ** 2
        hz = np.arange(au.FFT // 2 + 1) * rate / au.FFT
        out.append([np.log(sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, hz)) + 1e-6) for a, b, c in zip(edge, edge[1:], edge[2:])])
        energy.append(10 * np.log10((w * w).mean() + 1e-9))
    return np.array(out), np.array(energy)


def plain_spans(energy):
    floor = min(sorted(energy)[len(energy) // 10], au.QUIET)
    out, start = [], None
    for i, e in enumerate([*energy, -1e9]):
        if start is None and e >= floor + au.HIGH:
            start = i
        elif start is not None and e < floor + au.LOW:
            if i - start >= au.SHORT:
                out.append((start, i))
            start = None
    return out


def test_audio(spark, odd):
    import hashlib
    import zlib

    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    got = audio(spark, odd).collect()
    assert len(got) == odd.count() and audio(spark, odd.limit(0)).count() == 0
    files = {}
    for r in got:
        raw = texts[r["doc_id"]].encode() if r["doc_id"] != 8 else b"one"
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        wav = au.wav(payload)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_bytes"] == len(wav) and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
        if len(raw) < 2000:
            mels, energy = plain_log_mel(np.frombuffer(payload, np.uint8))
            ours, e = au.log_mel(np.frombuffer(payload, np.uint8))
            assert np.allclose(ours, mels, atol=2e-3) and np.allclose(e, energy, atol=1e-2)
            found = plain_spans(energy)
            assert au.spans(energy) == found and sum(-(-(b - a) // au.SHAPE[0]) for a, b in found) == r["n_tensors"]
        if r["n_tensors"]:
            files.setdefault(r["tensor_file"], []).append(r)
    assert files
    import pyarrow.parquet as pq

    for uri, rows in files.items():
        t = pq.read_table(uri.removeprefix("file:"))
        assert t.schema.field("log_mel").type == au.KIND and t.num_rows == sum(r["n_tensors"] for r in rows)
        assert all(b > a >= 0 for a, b in zip(t["start_s"].to_pylist(), t["end_s"].to_pylist()))
    by = {r["doc_id"]: r for r in got}
    assert by[1][1:9] == by[2][1:9] and by[3][1:9] == by[4][1:9] and by[4]["payload_bytes"] == 576 and by[4]["media_bytes"] == 620
    assert au.samples_of(au.wav(b"abc")) == (16000, b"abc")
    with pytest.raises(ValueError):
        au.samples_of(b"RIFFxxxxWAVE")


def test_spans():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 200):
        for _ in range(50):
            e = rng.normal(rng.choice([-60, -20]), rng.choice([2, 12]), n)
            assert au.spans(e) == plain_spans(e)


def test_audio_parts():
    t = np.arange(48_000) / 16_000
    tone = np.where((t > 1) & (t < 2), np.sin(2 * np.pi * 1000 * t), 0) * 100 + 128
    x = tone.astype(np.uint8)
    mels, energy = au.log_mel(x)
    (a, b), = au.spans(energy)
    assert abs(a * 0.01 - 1) < 0.05 and abs(b * 0.01 - 2) < 0.05
    block, when = au.tensors(mels, [(a, b)])
    assert block.shape == (len(when), *au.SHAPE) and when[0][0] == pytest.approx(a * 0.01) and (block[0] == mels[a : a + 32]).all()
    # any cut of the output gives the same samples, also with three phases
    h = au.phases(3, 2)
    y = au.resampled(x[:500], 0, 750, 3, 2)
    assert np.allclose(y[100:333], au.resampled(x[:500], 100, 333, 3, 2))
    up = np.zeros(1500)
    up[::3] = (x[:500].astype(float) - 128) / 128
    full = np.convolve(up, h.T.reshape(-1))
    assert np.allclose(y, full[: 2 * 750 : 2], atol=1e-4)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for name, stage in cp.STAGES[:-1]:
        rows = Workspace(spark, "t").write(stage(spark, rows, sf), name)
        assert rows.columns == docs.columns
    assert cp.run(spark, sf).count() == rows.count() > 0
