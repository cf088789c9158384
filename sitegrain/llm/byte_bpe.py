"""Byte-level BPE: each distinct word of the corpus is encoded once, and its ids are joined back by position.

1. Each task packs its documents into blocks: a block's distinct words (pre-tokens, the blank before a word included), and for each document the
   positions of its words in that list. Words are dealt into shards by their hash.
2. One row per (block, shard) carries a shard's words of a block. After a shuffle by shard, a word's copies from all
   blocks lie in one partition, where it is encoded once; the ids go back to the blocks in rows of the same shape.
3. After a shuffle by block each block's documents are put together from the ids of its words, by position.

So a word is shuffled once per block, not once per occurrence, and no task holds more than one block, however often a
word occurs. Decoding looks ids up in the token-byte table, which has as many rows as the vocabulary.

Defined cases: a null or empty text has no ids and decodes to no bytes. Rows with a null or repeated doc_id each give a row.
An empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame

from sitegrain.llm.common import CHUNK, partitions, texts

#: Characters of text after which a task closes its block, and that one row of packed documents may hold.
BLOCK_CHARS, ROW_CHARS = 24_000_000, 2_000_000
#: Words or pieces that a task keeps at once.
WORDS_KEPT = 1_000_000
_PACKED = "route long, block long, shard int, seq int, data binary, lens binary, doc_ids array<long>"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
#: The shard number of document rows. Rows are dealt by route: a block, or a shard as a negative number.
_DOCS = 2**31 - 1


def _row(route: int, block: int, shard: int, seq: int, data: bytes, lens, doc_ids: list) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=3).compress
    values = [route, block, shard, seq, pack(data), pack(np.asarray(lens, "<u4").tobytes()), doc_ids]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _TYPES, strict=True)], _NAMES)


def _read(batches, words: bool) -> Iterator[tuple]:
    """The word rows or document rows of batches or a table."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            block, shard, seq, data, lens, docs = (batch.column(j)[i] for j in range(1, 7))
            if (shard.as_py() != _DOCS) == words:
                yield block.as_py(), shard.as_py(), seq.as_py(), unpack(data.as_buffer()), np.frombuffer(unpack(lens.as_buffer()), "<u4"), docs.as_py()


@lru_cache(1)
def _coder(path: str):
    """Encodes one word; kept by a Python worker from task to task."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece


@lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, of a file of base64 tokens and ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _packed(docs: DataFrame, pattern: str, shards: int) -> DataFrame:
    """The blocks' words, to be dealt by shard, and their documents, to be dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        state: dict = {}

        def clear(number: int) -> None:
            state.update(number=number, chars=0, words={}, pieces={}, docs=[])

        def closed() -> Iterator[pa.RecordBatch]:
            """The block's rows: words by shard, renumbered in that order, then documents by position."""
            block, words = task << 24 | state["number"], list(state["words"])
            coded = [w.encode() for w in words]
            shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in coded), np.int64, len(coded))
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                own = [coded[i] for i in order[edges[s] : edges[s + 1]]]
                if own:
                    yield _row(-1 - s, block, s, 0, b"".join(own), list(map(len, own)), [])
            some, chars, seq = [], 0, 0
            for doc, at, size in [*state["docs"], (None, None, None)]:
                if at is None or chars + size > ROW_CHARS and some:
                    if some:
                        yield _row(block, block, _DOCS, seq, place[np.concatenate([x for _, x in some])].astype("<u4").tobytes(), [len(x) for _, x in some], [d for d, _ in some])
                    some, chars, seq = [], 0, seq + 1
                if at is not None:
                    some.append((doc, at))
                    chars += size

        clear(0)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words, pieces, at = state["words"], state["pieces"], []
                for piece in CHUNK.findall(text):
                    own = pieces.get(piece)
                    if own is None:
                        pieces[piece] = own = [words.setdefault(w, len(words)) for w in split(piece)]
                    at += own
                state["docs"].append((doc, np.array(at, np.uint32), len(text)))
                state["chars"] += len(text)
                if state["chars"] >= BLOCK_CHARS or len(words) > WORDS_KEPT:
                    yield from closed()
                    clear(state["number"] + 1)
        if state["docs"]:
            yield from closed()

    return texts(docs).mapInArrow(run, _PACKED)


def _encoded(words: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _coder(path)
        known: dict[bytes, bytes] = {}
        for block, shard, seq, data, lens, _ in _read(batches, True):
            ends = np.cumsum(lens, dtype=np.int64).tolist()
            out = []
            for start, end in zip([0, *ends], ends, strict=False):
                word = data[start:end]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(piece(word), "<u4").tobytes()
                out.append(ids)
            if len(known) > WORDS_KEPT:
                known.clear()
            yield _row(block, block, shard, seq, b"".join(out), [len(x) // 4 for x in out], [])

    return words.mapInArrow(run, _PACKED)


def _assembled(rows: DataFrame, replies: DataFrame) -> DataFrame:
    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        parts = sorted(_read(found.to_batches(), True), key=lambda x: x[1])  # one reply per shard, in the order of the numbering
        ids, lens = (np.concatenate([np.empty(0, np.int64), *(np.frombuffer(p[k], "<u4") for p in parts)]).astype(np.int64) for k in (3, 4))
        starts = np.cumsum(lens) - lens
        doc_ids, ends, flats = [], [0], []
        for _, _, _, data, sizes, docs in _read(own.to_batches(), False):
            at = np.frombuffer(data, "<u4").astype(np.int64)
            flats.append(gathered(ids, starts[at], lens[at]).astype(np.int32))
            # tokens before each document's end: by positions first, then by the tokens of those positions
            upto = np.concatenate([[0], np.cumsum(lens[at])])[np.cumsum(sizes, dtype=np.int64)]
            ends += (upto + ends[-1]).tolist()
            doc_ids += docs
        flat = np.concatenate([np.empty(0, np.int32), *flats])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return pa.Table.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"])

    return rows.groupBy("route").cogroup(replies.groupBy("route")).applyInArrow(run, "doc_id long, ids array<int>")


def gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[start : start + len] of each pair, one after another."""
    before = np.cumsum(lens) - lens
    return values[np.repeat(starts - before, lens) + np.arange(int(lens.sum()))]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every whole text: each match of the pattern is encoded by the ranks in the file."""
    parts = partitions(docs.sparkSession)
    # one shuffle serves both branches: words are encoded where their shard lies, documents wait where their block lies
    dealt = _packed(docs, pattern, parts).repartition(parts, "route")
    return _assembled(dealt, _encoded(dealt, path))


class Decoder:
    """Bytes of ids, by the token-byte table as one array and its offsets."""

    def __init__(self, path: str):
        table = ranks(path)
        tokens: list[bytes] = [b""] * (max(table.values(), default=-1) + 1)
        for token, i in table.items():
            tokens[i] = token
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.lens[ids]).tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (bytes) of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoder(path)
        for batch in batches:
            out = [decoded(ids) for ids in id_arrays(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def id_arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column as arrays without copies."""
    flat = column.values.to_numpy(zero_copy_only=False)
    for start, end in zip(column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:], strict=True):
        yield flat[start:end]
