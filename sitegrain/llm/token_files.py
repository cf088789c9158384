"""Token files: ids of whole documents, compressed one by one with a shared zstandard dictionary.

Documents are dealt by ranges of doc_id and sorted, so shard k holds smaller ids than shard k + 1. A file row is a
segment of a shard: the frames of some documents one after another, and their index (doc_ids, byte offsets, token starts
within the shard, token counts). A short document is read by its segment (first_id and last_id are plain columns that
Parquet prunes by) and one slice of the frames. Each segment names its dictionary by SHA-256, and reading checks it.
Ids are stored as little-endian integers of 2 bytes where the vocabulary allows it, else of 4. Files are written by
Spark's own writer, so a lost executor's half-written shard never counts.

Defined cases: a null or empty text holds the end id only. A null doc_id sorts first. Rows that repeat a doc_id lie side by
side, ordered by text. An empty table gives files without rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm.byte_bpe import gathered
from sitegrain.llm.common import CHUNK, UNICODE_SPACE, partitions, texts
from sitegrain.session import scratch_folder

#: The dictionary is trained on so many documents (those of the smallest id hash), so many leading ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 112_640
SEGMENT_BYTES = 1 << 20
#: Distinct pieces of text whose ids a worker keeps: so many new ones, and as many that were in use before those.
PIECES_KEPT = 320_000
#: Bytes of text that are encoded at a time (a longer text is encoded alone).
SLICE_BYTES = 3_000_000
LEVEL = 3
#: The characters that a byte-level vocabulary writes for bytes (visible Latin-1 for itself, the others from U+0100 on).
_ITSELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _ITSELF} | {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)).difference(_ITSELF)))}
BLANK = chr(BYTE_CHARS[0x20])
#: A word of Latin letters and marks after it. The token pattern parts the two.
WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)").fullmatch
VISIBLE = re.compile(f" ?[^{UNICODE_SPACE}]+").fullmatch
#: A blank between white space, or at the end after white space.
ACROSS = f"[{UNICODE_SPACE}] ([{UNICODE_SPACE}]|$)"


class Pieces:
    """Token ids of texts by a byte-level BPE of the tokenizers library; each distinct piece is encoded once.

    A piece is a word with the blank before it. Where white space stands on both sides of a blank (or the text ends
    after it), the tokens of a run of white space may reach across, so such texts are cut by CHUNK instead.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.packs = [self._pack(n) for n in range(32)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.end = np.array([end], self.kind).tobytes()
        self.line = self._ids("a\nb")[1]
        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        # a word of letters only is one pre-token, so the model takes it directly
        plain = type(cut).__name__ == "ByteLevel" and cut.use_regex and not cut.add_prefix_space and self.tokenizer.normalizer is None and type(model).__name__ == "BPE"
        self.model = model if plain else None
        self._marks = lru_cache(1000)(lambda marks: self._bytes(self._ids(marks)))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _bytes(self, ids: list[int]) -> bytes:
        return (self.packs[len(ids)] if len(ids) < len(self.packs) else self._pack(len(ids)))(*ids)

    def _pack(self, count: int):
        return struct.Struct(f"<{count}{'H' if self.kind == '<u2' else 'I'}").pack

    def _word(self, word: str) -> bytes:
        """A word of letters, by the model."""
        ids = self.known.get(word)
        if ids is None:
            named = BLANK + word[1:] if word[0] == " " and word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = self.known[word] = self._bytes([t.id for t in self.model.tokenize(named)])
        return ids

    def _learn(self, missing: list[str]) -> None:
        """Words of letters and their closing marks go to the model, each by itself; pieces with white space inside are put
        together from their parts; the others are encoded many at a time, parted by line ends, which are tokens of their own.
        """
        plain, mixed = [], []
        for x in missing:
            word = WORD(x) if self.model is not None else None
            if word:
                letters, marks = word.groups()
                self.known[x] = self._word(letters) + self._marks(marks) if marks else self._word(letters)
            elif VISIBLE(x):
                plain.append(x)
            else:
                mixed.append(x)
        parts = {x: CHUNK.findall(x) for x in mixed}
        inner = {y for ys in parts.values() for y in ys}.difference(self.known, plain)
        blank = {y for y in inner if y.isspace()}
        self.known.update((y, self._bytes(self._ids(y))) for y in blank)
        more = [y for y in inner if y not in blank]
        if mixed and more:
            self._learn(more)
        self._batches(plain)
        self.known.update((x, b"".join(map(self.known.__getitem__, ys))) for x, ys in parts.items())

    def _batches(self, plain: list[str]) -> None:
        for at in range(0, len(plain), 64):
            some = plain[at : at + 64]
            ids = np.array(self._ids("\n".join(some)), self.kind)
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) != len(some) - 1:  # a vocabulary that merges line ends
                self.known.update((x, self._bytes(self._ids(x))) for x in some)
                continue
            data, size = ids.tobytes(), ids.itemsize
            edges = ((cuts + 1) * size).tolist()
            self.known.update(zip(some, [data[a : b - size] for a, b in zip([0, *edges], [*edges, len(data) + size], strict=True)], strict=True))

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > PIECES_KEPT:  # what isn't used again before the next change is forgotten
                self.known, self.older = {}, self.known
                found = [None] * len(pieces)
            missing = {x for x, ids in zip(pieces, found, strict=True) if ids is None}
            again = {x: self.older[x] for x in missing if x in self.older}
            self.known.update(again)
            self._learn([x for x in missing if x not in again])
            found = list(map(self.known.__getitem__, pieces))
        return found

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, then the end id, as bytes."""
        texts = texts.cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._encoded(texts.slice(at, to - at))
            at = to

    def _encoded(self, texts: pa.Array) -> Iterator[bytes]:
        odd = set(np.flatnonzero(pc.match_substring_regex(texts, ACROSS).to_numpy(zero_copy_only=False)).tolist())
        if odd:
            whole = texts
            texts = pc.if_else(pc.match_substring_regex(texts, ACROSS), pa.scalar("", texts.type), texts)
        words = pc.split_pattern(texts, " ")
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        pieces = [" " + x for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        place[edges[:-1]] = len(pieces) + np.arange(len(texts))  # the first word of a text has no blank before it
        pieces += pc.list_element(words, 0).to_numpy(zero_copy_only=False).tolist()
        ids = self._looked_up(pieces)
        values = np.frombuffer(b"".join(ids), self.kind)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // values.itemsize
        starts = np.cumsum(lens) - lens
        own = lens[place]
        flat = memoryview(gathered(values, starts[place], own).tobytes())
        cuts = (np.concatenate([[0], np.cumsum(own)])[edges] * values.itemsize).tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i in odd:
                yield b"".join(self._looked_up(CHUNK.findall(whole[i].as_py()))) + self.end
            else:
                yield bytes(flat[a:b]) + self.end


@lru_cache(1)
def _pieces(path: str, end: int) -> Pieces:
    """Kept by a Python worker from task to task."""
    return Pieces(path, end)


def dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """A zstandard dictionary of id arrays, trained on a bounded sample; empty where there is too little to train on."""
    rows = texts(docs).select("doc_id", F.col("text").substr(1, 8 * SAMPLE_IDS).alias("text"))
    # ids alone tell which hashes are small enough, so only about so many texts are sent to the driver
    order = F.xxhash64("doc_id")
    least = rows.select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    some = rows.filter(order <= F.lit(least)).orderBy(order, "doc_id", "text").limit(SAMPLE_DOCS).collect() if least is not None else []
    pieces = _pieces(tokenizer, end)
    size = np.dtype(pieces.kind).itemsize
    samples = [ids[: SAMPLE_IDS * size] for ids in pieces.encode(pa.array([r.text for r in some], pa.large_string()))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


FILE = (
    "shard int, first_id long, last_id long, kind string, dictionary_sha256 string, frames binary, doc_ids array<long>, "
    "offsets array<long>, starts array<long>, counts array<long>"
)


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> str:
    """Encodes every document and writes the files below the path (default: a new one in the scratch folder)."""
    spark = docs.sparkSession
    path = path or f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    data = dictionary(docs, tokenizer, end)
    name = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(name, bytearray(data))], "dictionary_sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, pieces = TaskContext.get().partitionId(), _pieces(tokenizer, end)
        size, pack = np.dtype(pieces.kind).itemsize, zstandard.ZstdCompressor(level=LEVEL, **_codec(data))
        at, ids, frames, counts = 0, [], [], []

        def segment() -> pa.RecordBatch:
            starts = at - np.cumsum(counts[::-1])[::-1]
            known = [x for x in ids if x is not None]
            row = [shard, known[0] if known else None, known[-1] if known else None, pieces.kind, name, b"".join(frames), ids, np.cumsum([0, *map(len, frames)]), starts, counts]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], NAMES)

        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), pieces.encode(batch.column(1)), strict=True):
                ids.append(doc), frames.append(pack.compress(coded)), counts.append(len(coded) // size)
                at += counts[-1]
                if sum(counts) * size >= 4 * SEGMENT_BYTES or len(ids) >= 2000:
                    yield segment()
                    ids, frames, counts = [], [], []
        if ids:
            yield segment()

    numbers = pa.list_(pa.int64())
    KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), numbers, numbers, numbers, numbers]
    NAMES = [x.split()[0] for x in FILE.split(", ")]
    rows = texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    return path


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None, checksums: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids; of all documents, or of one.

    With checksums, ids_crc32 (of the ids as little-endian integers of 4 bytes) stands for ids, so that only it leaves the reading task.
    """
    known = {r.dictionary_sha256: bytes(r.data) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    files = spark.read.schema(FILE).parquet(f"{path}/segments")
    # one row per shard, of which there are as many as partitions were written
    sums = files.groupBy("shard").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")).orderBy("shard").collect()
    base = dict(zip([r.shard for r in sums], np.cumsum([0, *(r.n for r in sums)]).tolist(), strict=False))
    if doc_id is not None:
        files = files.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    name, kind = ("ids_crc32", "long") if checksums else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = {k: zstandard.ZstdDecompressor(**_codec(v)) for k, v in known.items()}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] not in unpack:
                    raise ValueError(f"no dictionary {row['dictionary_sha256']} in {path}")
                open_, frames = unpack[row["dictionary_sha256"]], memoryview(row["frames"])
                picked = [i for i, x in enumerate(row["doc_ids"]) if doc_id is None or x == doc_id]
                parts = [np.frombuffer(open_.decompress(frames[row["offsets"][i] : row["offsets"][i + 1]]), row["kind"]) for i in picked]
                if checksums:
                    last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64())
                else:
                    edges = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                    flat = np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"][i] for i in picked], pa.int64()),
                        pa.array([base[row["shard"]] + row["starts"][i] for i in picked], pa.int64()),
                        pa.array([row["counts"][i] for i in picked], pa.int64()),
                        last,
                    ],
                    ["doc_id", "start", "n_tokens", name],
                )

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")
