"""Token-id files: fixed-width bit packing with block offsets.

Each id takes the bits that the largest id of the vocabulary needs. Ids lie in blocks of a fixed count; eight ids fill
exactly `width` bytes, so numpy packs and unpacks a whole block with a few shifts and any id can be reached from its
block's offset. A file (shard) holds

    header   magic 8 bytes, version u32, width u32, ids in a block u32, zero u32
    blocks   packed ids; the last block is padded to a multiple of eight ids
    footer   block offsets u64[], document ids i64[], whether the id is not null u8[], first token of each document u64[]
    trailer  footer offset u64, blocks u64, documents u64, tokens u64, crc32 of the footer u32, magic 8 bytes

Documents are dealt by ranges of doc_id, and a task begins a new shard when one has SHARD ids or documents enough, so a
shard and its footer have bounded size at any number of partitions (a single longer document gets a shard of its own
length). Shards follow each other in ascending order; a manifest has a row per shard.
Files are written under another name and renamed, so a task that runs again leaves the same whole file.

Defined results: a null text counts as the empty text and gets the end id alone; a row whose doc_id is null comes
before all others; rows with the same doc_id are ordered by their text; other columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from seine.llm.common import Workspace, claim, create, opened, table
from seine.llm.op01_bpe import groups, vocabulary
from seine.llm.wordsplit import END, WordSplitter

MAGIC = b"SEINEIDS"
HEADER = struct.Struct("<8sIIII")
TRAILER = struct.Struct("<QQQQI8s")
BLOCK = 1 << 16
END_ID = 2
#: Ids, and documents, from which on a shard ends.
SHARD, SHARD_DOCS = 1 << 26, 1 << 20


def width_of(vocab_size: int) -> int:
    """The least bits that hold ids 0 .. vocab_size - 1."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width, at most 32 bits each; padded with zeros to a multiple of eight ids."""
    n = -(-len(ids) // 8)
    rows = np.zeros((n, 8), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, width), np.uint8)
    for k in range(8):
        bit = k * width
        first, shift = divmod(bit, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range(first, (bit + width - 1) // 8 + 1):
            out[:, j] |= (value >> np.uint64(8 * (j - first))).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.empty((len(rows), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        bit = k * width
        first, shift = divmod(bit, 8)
        value = np.zeros(len(rows), np.uint64)
        for j in range(first, (bit + width - 1) // 8 + 1):
            value |= rows[:, j].astype(np.uint64) << np.uint64(8 * (j - first))
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


class Writer:
    def __init__(self, out, width: int, block: int = BLOCK):
        if not 1 <= width <= 32 or block % 8:
            raise ValueError("width is 1 to 32 bits, a block a multiple of eight ids")
        self.out, self.width, self.block = out, width, block
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = 0
        self.at = HEADER.size
        self.offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []
        out.write(HEADER.pack(MAGIC, 1, width, block, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            data = pack(ids[a : min(a + self.block, whole)], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        footer = b"".join((
            np.array(self.offsets, "<u8").tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in self.doc_ids], np.uint8).tobytes(), np.array(self.starts, "<u8").tobytes(),
        ))
        self.out.write(footer + TRAILER.pack(self.at, len(self.offsets), len(self.doc_ids), self.tokens, zlib.crc32(footer), MAGIC))


class Reader:
    """Random access to a shard: any run of ids, or the ids of any document."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        magic, version, self.width, self.block, _ = HEADER.unpack(file.read(HEADER.size))
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - TRAILER.size)
        self.end, n_blocks, n_docs, self.tokens, crc, again = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC or again != MAGIC or version != 1:
            raise ValueError("not a token-id file")
        file.seek(self.end)
        footer = file.read(end - TRAILER.size - self.end)
        if zlib.crc32(footer) != crc:
            raise ValueError("the footer is damaged")
        cut = np.cumsum([0, 8 * n_blocks, 8 * n_docs, n_docs, 8 * n_docs])
        self.offsets, ids, there, self.starts = (np.frombuffer(footer[a:b], t) for a, b, t in zip(cut, cut[1:], ("<u8", "<i8", np.uint8, "<u8")))
        self.doc_ids = [int(i) if t else None for i, t in zip(ids, there)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        until = int(self.offsets[b]) if b < len(self.offsets) else self.end
        self.file.seek(int(self.offsets[a]))
        data = self.file.read(until - int(self.offsets[a]))
        return unpack(data, self.width, (b - a) * self.block)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.tokens)


class LibraryWords(WordSplitter):
    """Ids as the tokenizers library gives them; it encodes each distinct run of characters once.

    New runs go to the library in lines, a run's pieces apart, and are told by the pieces' ends in the ids. A text whose
    normal form changes when it is normalised again goes to the library whole."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if s.endswith(END)]] = True
        self.most = most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # a generation of at most about `most` runs, of which those stay that are met again

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: list[str], line: int = 5_000) -> None:
        todo = [c for c in new if c not in self.added]
        self.known.update((c, np.array([self.added[c]], "<u4").tobytes()) for c in new if c in self.added)
        cut = [self.pieces(c.removeprefix("\n")) for c in todo]
        lines = [" ".join([p for ps in cut[a : a + line] for p in ps]) for a in range(0, len(cut), line)]
        for k, e in enumerate(self.tokenizer.encode_batch(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            some, part = todo[k * line : (k + 1) * line], cut[k * line : (k + 1) * line]
            stops = np.flatnonzero(self.ends[ids])[np.cumsum([len(ps) for ps in part]) - 1] + 1
            raw, at = ids.tobytes(), 0
            for c, stop in zip(some, (4 * stops).tolist()):
                self.known[c] = raw[at:stop]
                at = stop

    def packed(self, texts: list[str]) -> list[bytes]:
        rows = [self.chunks(t) if t.isascii() or unicodedata.is_normalized("NFC", self.normal(t)) else None for t in texts]
        used = [r for r in rows if r is not None]
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        new = []
        for c in set().union(*used).difference(self.known):
            if c in self.old:
                self.known[c] = self.old[c]
            else:
                new.append(c)
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, r)) if r is not None else self.whole([t])[0] for r, t in zip(rows, texts)]


_words: dict[str, LibraryWords] = {}


def _forget() -> None:
    _words.clear()


def library(path: str) -> LibraryWords:
    if path not in _words:
        _words[path] = LibraryWords(path)
    return _words[path]


def write_token_files(docs: DataFrame, to: str, vocab: str, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Write the shards under the folder; returns the manifest (shard, uri, n_docs, n_tokens). Lazy: writing the manifest writes the shards."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("ids", _forget)
        encoder, end = library(vocab), np.array([end_id], np.uint32)
        part, width = TaskContext.get().partitionId(), width_of(max(encoder.size, end_id + 1))

        def rows():
            for batch in batches:
                keys, at = batch.column(0).to_pylist(), 0
                for texts in groups(batch.column(1).to_pylist()):
                    for key, ids in zip(keys[at : at + len(texts)], encoder.packed(texts)):
                        yield key, np.concatenate((np.frombuffer(ids, "<u4"), end))
                    at += len(texts)

        todo, k = rows(), 0
        row = next(todo, None)
        while row is not None:
            uri = f"{to}/ids-{part:06d}-{k:06d}.bin"
            with create(uri) as out:
                writer = Writer(out, width)
                while row is not None and writer.tokens < shard and len(writer.doc_ids) < SHARD_DOCS:
                    writer.add(*row)
                    row = next(todo, None)
                writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [part << 32 | k], "uri": [uri], "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.tokens]}, schema=pa.schema({"shard": pa.int64(), "uri": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()}))
            k += 1

    frame = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    dealt = frame.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "shard long, uri string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, manifest: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A row per document from the files: doc_id, start (over all shards), n_tokens, ids_crc32.

    The manifest has one short row per shard, so the running total of tokens is summed on the driver."""
    plan, base = [], 0
    for row in sorted(manifest.collect()):
        plan.append((row["uri"], base))
        base += row["n_tokens"]
    todo = spark.createDataFrame(plan, "uri string, base long")
    if plan:
        todo = todo.repartition(len(plan))

    def run(batches):
        schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()})
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(uri) as f:
                    r = Reader(f)
                    ends = np.append(r.starts[1:], r.tokens).astype(np.int64)
                    starts, k = r.starts.astype(np.int64), 0
                    while k < len(starts):  # documents of about `most` ids at a time
                        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + most, "right")))
                        ids = r.ids(int(starts[k]), int(ends[stop - 1])).astype("<u4")
                        cuts = starts[k:stop] - starts[k]
                        crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, ends[k:stop] - starts[k])]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[k:stop], pa.int64()), pa.array(starts[k:stop] + base), pa.array(ends[k:stop] - starts[k:stop]), pa.array(crcs, pa.int64())], schema=schema)
                        k = stop

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op10")
    manifest = work.write(write_token_files(table(spark, sf_dir, "documents"), work.path("shards"), vocabulary()), "manifest")
    return read_token_files(spark, manifest)


QUERIES = {"op10_token_file": op10_token_file}
SQL: dict[str, str] = {}
