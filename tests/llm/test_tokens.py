"""Operators 1 and 10 against the tokenizers library."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seine.llm import op01_bpe as b
from seine.llm import op10_token_file as f
from seine.llm.common import Workspace

LIB = Tokenizer.from_file(b.vocabulary())
MEMO, WORDS = b.Memo(b.vocabulary()), f.LibraryWords(b.vocabulary())


def lib(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aehint 'stdS.,<|>endoftx\n\x1c1é", max_size=60)))
def test_any_text(text):
    chunks = MEMO.chunks(text)
    known = MEMO.learn([chunks])
    ids = np.frombuffer(b"".join(known[c][0] for c in chunks), "<u4").tolist()
    assert ids == lib(text)
    assert " ".join(known[c][1] for c in chunks) == MEMO.decode(ids) == LIB.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(WORDS.packed([text])[0], "<u4").tolist() == lib(text)


def test_bpe_rows(spark, odd, big):
    for docs in (odd, big):
        got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in b.encode_texts(docs, b.vocabulary()).collect()}
        want = set()
        for r in docs.select("doc_id", "text").collect():
            ids = lib(r["text"])
            want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == want
    assert b.encode_texts(odd, b.vocabulary()).count() == odd.count() and b.encode_texts(odd.limit(0), b.vocabulary()).count() == 0
    row = b.encode_texts(odd.where("doc_id = 1"), b.vocabulary(), keep_ids=True).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == lib(odd.where("doc_id = 1").first()["text"])


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_pack(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003, dtype=np.uint64).astype(np.uint32)
    data = f.pack(ids, width)
    assert len(data) == 126 * width and (f.unpack(data, width, 1003) == ids).all()
    out = io.BytesIO()
    w = f.Writer(out, width, block=64)
    cuts = [0, 0, 3, 200, 200, 1003]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        w.add(None if k == 1 else k, ids[a:z])
    w.close()
    r = f.Reader(out)
    assert r.doc_ids == [0, None, 2, 3, 4] and all((r.document(k) == ids[a:z]).all() for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert (r.ids(63, 66) == ids[63:66]).all() and (r.ids(0, 1003) == ids).all()
    out.seek(out.getbuffer().nbytes - 60)
    out.write(b"xxxx")
    with pytest.raises(ValueError):
        f.Reader(io.BytesIO(out.getvalue()))


def test_width():
    assert [f.width_of(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_files(spark, odd, big):
    for docs in (odd, big, odd.limit(0)):
        work = Workspace(spark, "t10")
        got = sorted((tuple(r) for r in f.read_token_files(spark, work.write(f.write_token_files(docs, work.path("x"), b.vocabulary(), shard=700), "m")).collect()), key=lambda r: r[1])
        rows = sorted((tuple(r) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, at = [], 0
        for doc_id, text in rows:
            ids = [*lib(text), 2]
            want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want


class Asked(dict):
    """A dictionary that counts what it is asked."""

    n = 0

    def get(self, *a):
        self.n += 1
        return super().get(*a)

    def __contains__(self, key):
        self.n += 1
        return super().__contains__(key)


def gibberish(n):
    rng, parts = np.random.default_rng(5), ["th", "oning", "ció", "ß", "ö", "tz", "ment", "a", "ally", "日", "ent", "re"]
    return sorted({"".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(n)})


def test_walk_looks_up_little():
    trie, words = b.TrieBpe(b.vocabulary()), gibberish(3_000)
    warm = dict(trie.encode_words(words))
    tables = {k: Asked(v) for k, v in vars(trie).items() if k in ("vocab", "inner", "final", "stands")}
    vars(trie).update(tables)
    assert dict(trie.encode_words(words)) == warm
    pairs, size = tables.pop("stands").n, sum(len(w.encode()) for w in words)
    # entries that end a prefix come from its state: nothing is cut from a prefix and looked up again
    assert sum(t.n for t in tables.values()) == 0 and 0 < pairs < 2 * size


def test_walk_forgets(monkeypatch):
    words = [*gibberish(200), "a", "ab", "abc", "x" * 5_000, "thing" * 900, "é" * 700]
    want = {w: lib(w) for w in words}
    trie = b.TrieBpe(b.vocabulary())
    monkeypatch.setattr(b, "STANDS", 3)
    monkeypatch.setattr(b, "STEPS", 0)
    for _ in range(3):
        assert dict(trie.encode_words(words)) == want
        assert all(dict(trie.encode_words([w])) == {w: want[w]} for w in words[::20])
