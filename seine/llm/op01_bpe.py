"""BPE encoding and decoding by a prefix-sharing trie.

A greedy merge encoding has two properties: what is left of it after its last token goes is the encoding of the
shorter text, and a row of tokens is an encoding if each pair of neighbours is one. So each prefix of a word has
exactly one possible last token: the vocabulary entry that ends the prefix and stands well beside the last token of
what goes before it. The distinct words of a batch are met in the order of their bytes, which is a depth-first walk of
their trie; it carries the last token of each prefix down, so a prefix shared with the word before is not worked out
again, and a word's ids are read back from its leaf. The entries that end a prefix come from a state beside it: the
longest end of the prefix that begins an entry, as in the automaton of Aho and Corasick, whose steps are made when met.

Nothing is shuffled: each Python worker keeps a bounded table of runs of characters it has met, for speed alone.

Defined results: a null text counts as the empty text, with no ids and the empty string decoded; a null doc_id is
passed through; repeated rows give repeated rows; other columns of the input are left out; an empty table gives no
rows; a long text is encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seine.llm.common import claim, table
from seine.llm.wordsplit import END, WordSplitter, byte_chars

#: What an entry of a memo counts besides its characters and ids, and the most pairs of tokens, and steps of the
#: automaton, that are remembered.
ENTRY, STANDS, STEPS = 40, 300_000, 300_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class State:
    """An end of a prefix: its bytes, the tokens that end it (with their lengths, longest first), and what follows on each
    byte: another state, or, where the byte ends a word, the tokens that end there."""

    __slots__ = ("text", "fits", "steps", "ends")

    def __init__(self, text: bytes, fits: list[tuple[int, int]]):
        self.text, self.fits = text, fits
        self.steps: dict[int, State] = {}
        self.ends: dict[int, list[tuple[int, int]]] = {}


class TrieBpe(WordSplitter):
    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        table = {c: b for b, c in byte_chars().items()}
        self.inner: dict[bytes, int] = {}  # tokens within words, and tokens that end words, by their bytes
        self.final: dict[bytes, int] = {}
        for s, i in self.vocab.items():
            body = s.removesuffix(END)
            if body and all(c in table for c in body):
                (self.final if s.endswith(END) else self.inner)[bytes(table[c] for c in body)] = i
        self.begins = {t[:n] for t in (*self.inner, *self.final) for n in range(len(t) + 1)}
        self.stands: dict[int, bool] = {}
        self.restart()
        del self.spec

    def symbols(self, token: int) -> list[int]:
        name = self.names[token]
        body, end = name.removesuffix(END), name.endswith(END) and name != END
        return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + END * end]] if body else [token]

    def merged(self, row: list[int]) -> list[int]:
        """Plain merging of a short row: the best rank first, the leftmost of equals."""
        row = list(row)
        while len(row) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(row, row[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            row[i : i + 2] = [self.merges[row[i], row[i + 1]][1]]
        return row

    def beside(self, before: int, token: int) -> bool:
        """Whether [before, token] is the encoding of its own text; before is -1 at the start of a word."""
        key = (before << 20) ^ token
        known = self.stands.get(key)
        if known is None:
            if len(self.stands) > STANDS:
                self.stands.clear()
            known = self.stands[key] = (self.merged(self.symbols(token)) == [token]) if before < 0 else (self.merged(self.symbols(before) + self.symbols(token)) == [before, token])
        return known

    def restart(self) -> None:
        self.root = State(b"", [])
        self.states, self.n_steps = {b"": self.root}, 0

    def step(self, state: State, byte: int) -> State:
        text = state.text + bytes((byte,))
        while text not in self.begins:
            text = text[1:]
        to = self.states.get(text)
        if to is None:
            to = self.states[text] = State(text, self.fitting(text, self.inner))
        state.steps[byte] = to
        self.n_steps += 1
        return to

    def end(self, state: State, byte: int) -> list[tuple[int, int]]:
        fits = state.ends[byte] = self.fitting(state.text + bytes((byte,)), self.final)
        self.n_steps += 1
        return fits

    @staticmethod
    def fitting(text: bytes, tokens: dict[bytes, int]) -> list[tuple[int, int]]:
        return [(tokens[text[a:]], len(text) - a) for a in range(len(text)) if text[a:] in tokens]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of distinct words, in the order of the walk."""
        stands, beside, step = self.stands, self.beside, self.step
        if self.n_steps > STEPS:
            self.restart()
        last, size, path, before = [-1], [0], [self.root], b""
        for word in sorted(words):  # code points are in the order of their bytes
            raw = word.encode()
            shared, most = 0, min(len(before), len(raw)) - 1  # the end of a word is a symbol of its own
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            depth, before = shared, raw
            del last[depth + 1 :], size[depth + 1 :], path[depth + 1 :]
            state = path[depth]
            for byte in raw[depth:-1]:
                depth += 1
                state = state.steps.get(byte) or step(state, byte)
                for token, n in state.fits:
                    pair = (last[depth - n] << 20) ^ token
                    known = stands.get(pair)
                    if known or known is None and beside(last[depth - n], token):
                        break
                else:
                    raise ValueError(f"no last token for {raw[:depth]!r}")
                last.append(token)
                size.append(n)
                path.append(state)
            at, byte = len(raw), raw[-1]
            for token, n in state.ends.get(byte) or self.end(state, byte):
                pair = (last[at - n] << 20) ^ token
                known = stands.get(pair)
                if known or known is None and beside(last[at - n], token):
                    break
            else:
                raise ValueError(f"no last token for {raw!r}")
            ids, at = [token], at - n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            yield word, ids

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: token strings joined by one space, unknown ids left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


class Memo(TrieBpe):
    """Packed ids and decoded string of each run of characters met, for whole batches of texts. There are two generations:
    when the young one holds `most` characters and ids, it becomes the old one, and of that those stay that are met again."""

    def __init__(self, path: str, most: int = 6 << 20):
        super().__init__(path)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.fixed = {s: (struct.pack("<I", i), self.decode([i])) for s, i in self.added.items()}
        self.young, self.old, self.size = dict(self.fixed), {}, 0

    def learn(self, rows: list[list[str]]) -> dict[str, tuple[bytes, str]]:
        """What is known of all runs of the rows."""
        if self.size > self.most:
            self.young, self.old, self.size = dict(self.fixed), self.young, 0
        young, old = self.young, self.old
        new = []
        for c in set().union(*rows).difference(young):
            if known := old.get(c):
                young[c] = known
                self.size += len(c) + ENTRY
            else:
                new.append(c)
        cut = {c: self.pieces(c.removeprefix("\n")) for c in new}
        ids = dict(self.encode_words(set().union(*cut.values())))
        pack, names = struct.pack, self.names
        for chunk, words in cut.items():
            row = ids[words[0]] if len(words) == 1 else [i for w in words for i in ids[w]]
            young[chunk] = pack(f"<{len(row)}I", *row), " ".join([names[i] for i in row])
            self.size += 2 * len(chunk) + 6 * len(row) + ENTRY
        return young


_memos: dict[str, Memo] = {}


def _forget() -> None:
    _memos.clear()


def memo(path: str) -> Memo:
    if path not in _memos:
        _memos[path] = Memo(path)
    return _memos[path]


def groups(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of bounded total length, nulls as empty texts."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids (packed little-endian uint32, only if keep_ids) and both digests."""

    def run(batches):
        claim("bpe", _forget)
        m = memo(path)
        for batch in batches:
            keys, out, at = batch.column(0), [], 0
            for texts in groups(batch.column(1).to_pylist()):
                rows = [m.chunks(t) for t in texts]
                known = m.learn(rows).__getitem__
                for row in rows:
                    both = [known(c) for c in row]
                    ids = b"".join([x for x, _ in both])
                    shown = " ".join([x for _, x in both])
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), ids if keep_ids else None))
                n = len(out)
                cols = list(zip(*out))
                arrays = [keys.slice(at, n), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays.append(pa.array(cols[3], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
                at, out = at + n, []

    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return frame.mapInArrow(run, SCHEMA + (", ids binary" if keep_ids else ""))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
