import json
import random

import pytest
from pyspark.sql import functions as F

from seine.operators import dedup as dd
from seine.operators import index as ix
from seine.operators import links as lk
from seine.operators import search as se
from seine.operators.state import Tables
from seine.plans.build import build_folder, open_index
from seine.streaming.ingest import ingest


def test_independent_set_is_the_sequential_scan(spark):
    rng = random.Random(3)
    for n, m in ((6, 4), (18, 30), (12, 0)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        kept = set()
        for i in range(n):
            if not any((j, i) in pairs for j in kept):
                kept.add(i)
        nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
        edges = spark.createDataFrame(list(pairs), "i long, j long")
        assert {r["id"] for r in dd.first_independent(nodes, edges, Tables(spark, "t")).collect()} == kept


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(1, 6))) for b in base]
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    got = {(r["i"], r["j"]) for r in dd.near_pairs(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_status(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, ""), (4, "?"), (5, "x y z"), (6, "A b c d e f g")], "doc_id long, text string")
    got = {r["doc_id"]: r["status"] for r in dd.dedup(dd.fingerprints(docs, ix.arrays_of(docs)), Tables(spark, "t")).collect()}
    assert got == {1: "keep", 2: "exact", 3: "keep", 4: "near", 5: "keep", 6: "near"}


def test_pagerank(spark):
    vertices = spark.createDataFrame([(i,) for i in range(4)], "id long")
    none = spark.createDataFrame([], "src long, dst long")
    assert {r["id"]: r["rank"] for r in lk.pagerank(vertices, none, Tables(spark, "t")).collect()} == pytest.approx(dict.fromkeys(range(4), 0.15 / 4))
    edges = [(0, 1), (1, 2), (2, 0), (2, 2), (3, 0)]
    rank = dict.fromkeys(range(4), 1.0)
    out = {s: [d for a, d in edges if a == s] for s in range(4)}
    for _ in range(7):
        new = dict.fromkeys(range(4), 0.15 / 4)
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * rank[s] / len(ds)
        rank = new
    got = lk.pagerank(vertices, spark.createDataFrame(edges, "src long, dst long"), Tables(spark, "t"), max_iter=7, tolerance=None)
    assert {r["id"]: r["rank"] for r in got.collect()} == pytest.approx(rank)
    assert lk.pagerank(vertices.limit(0), none, Tables(spark, "t")).count() == 0


def test_link_graph(spark):
    html = '<a href="/b">1</a><a href="http://h/b/#x">2</a><a href="/a">self</a><a href="/zz">out</a>'
    pages = spark.createDataFrame([(0, "http://h/a", html), (1, "http://H/b/", None), (2, "http://h/b", '<a href="/a">x</a>')], "ord long, url string, html string")
    kept = pages.where("ord < 2").select(F.col("ord").alias("doc_id"), "url")
    assert sorted(map(tuple, lk.link_graph(kept, pages).collect())) == [(0, 0), (0, 1), (1, 0)]


def _index(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ix.postings(ix.arrays_of(docs), positions=True).cache()
    return se.Index(ix.stored(found), ix.terms(found, len(texts)), ix.norms(found))


def test_search(spark):
    index = _index(spark, ["red fox", "red cat fox", "blue whale swims", "green", "tree", "sea", "x y z", "q r s"])
    assert se.tiered_search(index, "").count() == 0 and se.tiered_search(index, "unknown words here").count() == 0
    assert {r["doc_id"] for r in se.tiered_search(index, "whale").collect()} == {2}
    got = {r["doc_id"]: r for r in se.vector_search(index, se.parse("red fox", index.terms)).collect()}
    assert got[0]["proximity"] == pytest.approx(0.5)  # all of red, fox, "red fox" within two positions
    assert got[1]["proximity"] == pytest.approx(2 / 3 / 3)
    best = [r["doc_id"] for r in se.tiered_search(index, "red fox").collect()]
    assert best == [0, 1]
    ranks = spark.createDataFrame([(1, 1.0), (0, 0.0)], "doc_id long, rank double")
    a = {r["doc_id"]: r["score"] for r in se.tiered_search(index, "red fox").collect()}
    index.ranks = ranks
    b = {r["doc_id"]: r["score"] for r in se.tiered_search(index, "red fox").collect()}
    assert b == pytest.approx({0: 0.85 * a[0], 1: 0.85 * a[1] + 0.15})


def test_importance(spark):
    arrays = spark.createDataFrame([(1, ["a", "b"], [(0, 0, 2), (1, 5, 0)])], "doc_id long, t array<string>, spans array<struct<start: int, end: int, importance: int>>")
    got = {r["term"]: (r["tf"], [tuple(p) for p in r["positions"]]) for r in ix.postings(arrays, positions=True).collect()}
    assert got == {"a": (2.0, [(0, 2)]), "b": (1.0, [(1, 0)]), "a b": (2.0, [(0, 2)])}


def test_build_search_and_stream(spark, tmp_path):
    pages = [
        {"url": "http://h/1#f", "content": "<title>Foxes</title><p>A fox runs <a href='/2'>to</a>"}, {"url": "http://h/2", "content": "<p>A whale swims <a href='/1'>back</a>"},
        {"url": "http://h/3", "content": "<p>A whale swims <a href='/1'>back</a>"}, {"url": "", "content": "x"}, {"url": "http://h/4", "content": None}, {"url": "http://h/5", "content": "<p>running dogs and more words"},
    ]
    src = tmp_path / "pages" / "deep"
    src.mkdir(parents=True)
    for i, p in enumerate(pages):
        (src / f"{i}.json").write_text(json.dumps(p))
    (src / "bad.json").write_text("{nope")
    (src / "list.json").write_text("[1]")
    build_folder(spark, str(tmp_path / "pages"), str(tmp_path / "index"))
    index, docs = open_index(spark, str(tmp_path / "index"))
    assert {r["url"]: r["doc_id"] for r in docs.collect()} == {"http://h/1": 0, "http://h/2": 1, "http://h/5": 2}
    assert {r["status"]: r["n"] for r in spark.read.parquet(str(tmp_path / "index" / "status")).collect()} == {"keep": 3, "exact": 1}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "index" / "edges")).collect())) == [(0, 1), (1, 0)]
    assert [r["doc_id"] for r in se.tiered_search(index, "run", stemmed=True).collect()][0] in (0, 2)
    ingest(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_pages_that_are_not_quite_json(spark, tmp_path):
    import json

    files = {
        "a": b'{"url": "\\t http://x.org/a#top ", "content": "one\xff two"}', "b": json.dumps([{"url": "http://x.org/b", "content": "x"}]).encode(),
        "c": b'{"url": "http://x.org/c", "content": "x"} trailing', "d": b'{"url": "", "content": "x"}', "e": b'{"url": "http://x.org/e"}', "f": b"",
        "g": b'{"url": 7, "content": "x"}', "h": b'{"url": "http://[x#y", "content": 5}',
    }
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    (tmp_path / "z.txt").write_bytes(files["a"])
    from seine.sources.pages import read_pages

    got = sorted((r["url"], r["content"]) for r in read_pages(spark, str(tmp_path)).collect())
    assert got == [("http://[x", None), ("http://x.org/a", "one two"), ("http://x.org/e", None)]


def test_near_pairs_miss_none(spark, tmp_path):
    import random

    from seine.operators.dedup import near_pairs

    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for x in list(fps):
        for k in (1, 2, 3, 4):
            fps.append(x ^ sum(1 << i for i in rng.sample(range(64), k)))
    signed = [x - (x >> 63 << 64) for x in fps]
    got = {tuple(r) for r in near_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, fp long")).collect()}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if 1 <= (fps[i] ^ fps[j]).bit_count() <= 3}


def test_near_pairs_send_nothing_to_all(spark):
    """Each fingerprint has twenty rows in the join, which the planner does not see; a broadcast of them goes by way of the driver."""
    got = dd.near_pairs(spark.createDataFrame([(i, i * 8191) for i in range(50)], "id long, fp long"))
    rows = [tuple(r) for r in got.collect()]
    assert "Broadcast" not in got._jdf.queryExecution().toString() and len(rows) == len(set(rows))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_norms_and_postings_group_nothing(spark, sf):
    """A task holds a document, not the terms of all its documents, and a search makes no postings of other terms."""
    from seine.plans import queries as q

    for name in ("doc_norms", "postings_tf"):
        assert "Aggregate" not in _plan(q.QUERIES[name](spark, sf))
    plan = _plan(q.QUERIES["term_stats"](spark, sf))
    assert plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")
    index = q._index(spark, sf, "of the", stemmed=True)
    assert {r["term"] for r in index.postings.select("term").distinct().collect()} <= {"of", "the", "of the"}


def test_search_rows_are_those_of_the_whole_index(spark):
    docs = spark.createDataFrame([(1, "b a b, a! b"), (2, ""), (3, "c"), (4, "a"), (5, None)], "doc_id long, text string")
    arrays = ix.arrays_of(docs)
    whole = ix.postings(arrays, positions=True)
    found = ix.looked_up(arrays, ["a", "b a"])
    rows = lambda df: sorted((r["doc_id"], r["term"], r["tf"], [tuple(p) for p in r["positions"]]) for r in df.collect())
    assert rows(found.select("doc_id", F.inline("hits"))) == rows(whole.where("term in ('a', 'b a')"))
    norms = {r["doc_id"]: r["norm"] for r in ix.norms(whole).collect()}
    assert {r["doc_id"]: r["norm"] for r in found.collect()} == pytest.approx({k: norms[k] for k in (1, 4)})
    assert {r["doc_id"]: r["norm"] for r in ix.norms_of(arrays).collect()} == pytest.approx(norms)
    assert ix.looked_up(arrays, []).count() == 0


def test_pagerank_of_many_blocks(spark, monkeypatch):
    """Edges are packed once into a file for each block; ranks are those of a plain loop, up to the first step that moves none."""
    import glob

    monkeypatch.setattr(lk, "BLOCK_EDGES", 20, raising=False)
    rng = random.Random(9)
    ids = [i * i - 50 for i in range(30)]
    edges = sorted({(rng.choice(ids[:25]), rng.choice(ids)) for _ in range(90)})
    rank, out = dict.fromkeys(ids, 1.0), {s: [d for a, d in edges if a == s] for s in ids}
    for _ in range(100):
        new = dict.fromkeys(ids, 0.15 / len(ids))
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * rank[s] / len(ds)
        moved, rank = max(abs(new[i] - rank[i]) for i in ids), new
        if moved < 0.02:
            break
    tables = Tables(spark, "t")
    got = lk.pagerank(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"), tables, tolerance=0.02, together=4)
    assert {r["id"]: r["rank"] for r in got.collect()} == pytest.approx(rank, rel=1e-12)
    assert len(glob.glob(tables.root.removeprefix("file://") + "/blocks/*.npz")) > 2
