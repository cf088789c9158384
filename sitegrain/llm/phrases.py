"""Collocations: Misra-Gries summaries of n-grams per hash partition, then exact counts of the survivors.

1. Tasks cut texts into pieces and words, and count the n-grams of one to three words of a few million words at a time.
   The counts go to hash partitions of the n-grams, packed: one row holds a chunk's n-grams of one length for a
   partition, and rows are sent some megabytes at a time.
2. Each partition merges them into one Misra-Gries summary per language, reading its rows in a stream. The mass comes
   first (a header of each row), so the capacity is known before the first n-gram: SLACK times the mass divided by the
   threshold, and one more. A merge that leaves more counters takes the first surplus counter's value off all of them,
   which costs the mass at least capacity times as much; so no count falls by more than threshold / SLACK, and each
   n-gram of `least` occurrences survives, with a count that shows how far it may have fallen. A count beyond the
   threshold weighs as the threshold, so one hot n-gram does not widen its partition's summary.
3. A second pass counts again, and partitions add up the survivors only, by the 64-bit hashes of their words. While the
   survivors' bitmap is under 64 MB it travels with the tasks, which then send little else; beyond that all n-grams
   are sent, with the same result.
4. All parts of a candidate are as frequent as itself, so they are survivors too: scores are joins among the exact counts.

Words that share a 64-bit hash are an error, not a guess: each frequent word's text is compared where it is counted.

Defined cases: a null or empty text has no words; a null lang is `und`; a lang without candidates has no rows. Equal
texts and repeated ids count as often as they come. A word of any length is a word. An empty table gives an empty
result. Ties go to the larger count, then to the smaller phrase in bytes of UTF-8. Other columns than text and lang play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegrain.llm.common import held, small

LEAST = 10
MOST_WORDS = 3
TOP = 2000
#: How far the capacity of a summary exceeds mass / threshold: what a count can lose is threshold / SLACK.
SLACK = 4
#: Words that a task counts at a time, and the distinct ones among them that 21 bits can name.
CHUNK_WORDS, CHUNK_VOCABULARY = 4_000_000, 2_000_000
#: Bytes of text for which a hash partition is made.
PART_BYTES = 8_000_000
#: Bytes that a task sends at a time.
SENT_BYTES = 2_000_000
#: Bits of the survivors' bitmap up to which it travels with the tasks (64 MB), and bits per survivor.
BITMAP_BITS, BITS_EACH = 1 << 29, 16
#: Frequent words up to which their table is broadcast.
BROADCAST_ROWS = 500_000
_BREAK = b"\n"
#: A-Z to lower case; what ends a piece to a line feed; tabulators to blanks.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\t", bytes(range(97, 123)) + _BREAK * 10 + b" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hash(words: list[np.ndarray], lang: str) -> np.ndarray:
    """64-bit hash of n-grams, given as one array of word hashes for each place."""
    out = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang.encode()) ^ len(words), np.uint64)
    for w in words:
        out = _mix((out * np.uint64(0x9E3779B97F4A7C15)) ^ w)
    return out


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _vocabulary() -> _Vocabulary:
    return _Vocabulary({_BREAK: 0, b"": 1})


def _counted(tokens: np.ndarray, known: int, most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Distinct n-grams of word numbers (one array per place) with their counts, for each length up to most.

    The first `known` tokens only lead in: n-grams that end among them are counted already.
    """
    key = np.zeros(len(tokens), np.int64)
    whole = np.ones(len(tokens), bool)
    for n in range(1, most + 1):
        end = len(tokens) - n + 1
        if end <= 0:
            return
        key = (key[:end] << 21) | tokens[n - 1 :]
        whole = whole[:end] & (tokens[n - 1 :] > 0)
        new = key[max(0, known - n + 1) :][whole[max(0, known - n + 1) :]]
        distinct, counts = np.unique(new, return_counts=True)
        yield [(distinct >> (21 * (n - 1 - i))) & 0x1FFFFF for i in range(n)], counts


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list, np.ndarray, list[bytes]]]:
    """Language, n-grams with counts, hashes of the vocabulary and the vocabulary, for some million words at a time.

    A text longer than a chunk goes on in the next, led in by its last words.
    """
    vocabulary, numbers, lead, size = _vocabulary(), {}, {}, 0

    def counted():
        words = list(vocabulary)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        for lang, arrays in numbers.items():
            yield lang, _counted(np.concatenate(arrays), lead.get(lang, 0), most), hashes, words

    step = CHUNK_WORDS // 4
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = text.as_py().translate(_TABLE).replace(_BREAK, b" \n ").split(b" ")
            for at in range(0, len(found), step):
                own = numbers.setdefault(lang, [])
                part = np.fromiter(map(vocabulary.__getitem__, found[at : at + step]), np.int64, len(found[at : at + step]))
                own.append(part[part != 1])
                size += len(part)
                last = at + step >= len(found)
                if last:
                    own.append(np.zeros(1, np.int64))
                if size >= CHUNK_WORDS or len(vocabulary) >= CHUNK_VOCABULARY:
                    yield from counted()
                    vocabulary, numbers, lead, size = _vocabulary(), {}, {}, 0
                    if not last:
                        before = [w for w in found[max(0, at + step - 64) : at + step] if w]
                        i = at + step - 64
                        while len(before) < most - 1 and i > 0:
                            before = [w for w in found[max(0, i - 64) : i] if w] + before
                            i -= 64
                        before = before[-(most - 1) :] if most > 1 else []
                        numbers[lang] = [np.array([vocabulary[w] for w in before], np.int64)]
                        lead[lang] = len(before)
    yield from counted()


def _by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hash partition and the places of its n-grams."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


# --- first pass: summaries -----------------------------------------------------------------------------------------

SUMMARY = "part int, lang string, tag int, mass long, words long, grams binary, counts binary"


def _rows(columns: list[list], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _sent(rows: Iterator[tuple], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about SENT_BYTES bytes, so that nobody holds all that a chunk sends."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SENT_BYTES:
            yield _rows(list(zip(*out, strict=True)), names, types)
            out, size = [], 0
    if out:
        yield _rows(list(zip(*out, strict=True)), names, types)


_SUMMARY_NAMES = ["part", "lang", "tag", "mass", "words", "grams", "counts"]
_SUMMARY_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _packed(texts: DataFrame, parts: int, least: int, most: int) -> DataFrame:
    """Per chunk, length and hash partition: a header with the mass of its n-grams, and the n-grams with counts (least at most)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for lang, grams, hashes, _ in _chunks(batches, most):
            for places, counts in grams:
                keys = gram_hash([hashes[p] for p in places], lang)
                weights = np.minimum(counts, least).astype(np.uint32)
                for part, own in _by_part(keys, parts):
                    mass, words = int(weights[own].sum()), int(counts[own].sum()) if len(places) == 1 else 0
                    yield part, lang, 0, mass, words, None, None
                    yield part, lang, 1, mass, words, keys[own].tobytes(), weights[own].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(rows(batches), _SUMMARY_NAMES, _SUMMARY_TYPES)

    return texts.mapInArrow(run, SUMMARY)


class Summary:
    """A Misra-Gries summary of hashed n-grams. `lost` is the most that any count may have fallen."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost, self.waiting = capacity, 0, 0
        self.grams, self.counts, self.buffer = np.empty(0, np.uint64), np.empty(0, np.int64), []

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.buffer.append((grams, counts))
        self.waiting += len(grams)
        if self.waiting > max(500_000, self.capacity // 2):
            self.merge()

    def merge(self) -> None:
        grams = np.concatenate([self.grams, *(g for g, _ in self.buffer)])
        counts = np.concatenate([self.counts, *(c for _, c in self.buffer)])
        self.buffer, self.waiting = [], 0
        if not len(grams):
            return
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        grams, counts = grams[first], np.add.reduceat(counts, first)
        if len(grams) > self.capacity:
            at = len(grams) - self.capacity - 1
            cut = int(np.partition(counts, at)[at])
            self.lost += cut
            grams, counts = grams[counts > cut], counts[counts > cut] - cut
        self.grams, self.counts = grams, counts

    def survivors(self, least: int) -> np.ndarray:
        """Sorted hashes of all that may have occurred so often."""
        self.merge()
        return self.grams[self.counts + self.lost >= least]


def survivors(packed: DataFrame, parts: int, least: int, slack: int) -> DataFrame:
    """part, lang, words (all of its single-word occurrences) and the sorted hashes of the n-grams that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, words, summary = None, 0, 0, None

        def done():
            return _rows([[now[0]], [now[1]], [words], [summary.survivors(least).tobytes() if summary else b""]], ["part", "lang", "words", "grams"], [pa.int32(), pa.string(), pa.int64(), pa.binary()])

        for batch in batches:
            for part, lang, tag, own, single, grams, counts in zip(*batch.columns, strict=True):
                key = part.as_py(), lang.as_py()
                if key != now:
                    if now:
                        yield done()
                    now, mass, words, summary = key, 0, 0, None
                if tag.as_py() == 0:
                    mass, words = mass + own.as_py(), words + single.as_py()
                    continue
                summary = summary or Summary(slack * mass // least + 1)
                summary.add(np.frombuffer(grams.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32))
        if now:
            yield done()

    dealt = packed.repartition(parts, "part").sortWithinPartitions("part", "lang", "tag")
    return dealt.mapInArrow(run, "part int, lang string, words long, grams binary")


# --- second pass: exact counts ---------------------------------------------------------------------------------------


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def bitmap(found: DataFrame, most_bits: int = BITMAP_BITS) -> np.ndarray | None:
    """A Bloom filter of all survivors, made piece by piece; None where it would take more than most_bits."""
    count = found.agg(F.sum(F.length("grams"))).first()[0] or 0
    bits = 1 << max(13, math.ceil(math.log2(max(1, count // 8 * BITS_EACH))))
    if bits > most_bits:
        return None
    piece = min(bits, 1 << 19)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in batch.column(0):
                at = np.unique(np.concatenate(_probes(np.frombuffer(grams.as_buffer(), np.uint64), bits)).astype(np.int64))
                edges = np.searchsorted(at, np.arange(0, bits + 1, piece))
                some = np.flatnonzero(np.diff(edges))
                yield _rows([some.tolist(), [(at[edges[i] : edges[i + 1]] - i * piece).astype(np.uint32).tobytes() for i in some]], ["piece", "at"], [pa.int64(), pa.binary()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_, key = np.zeros(piece, bool), None
        for batch in batches:
            key = batch.column(0)[0].as_py()
            for at in batch.column(1):
                set_[np.frombuffer(at.as_buffer(), np.uint32)] = True
        yield _rows([[key], [np.packbits(set_, bitorder="little").tobytes()]], ["piece", "bits"], [pa.int64(), pa.binary()])

    out = np.zeros(bits // 8, np.uint8)
    for row in found.select("grams").mapInArrow(places, "piece long, at binary").groupBy("piece").applyInArrow(joined, "piece long, bits binary").collect():
        out[row["piece"] * piece // 8 : (row["piece"] + 1) * piece // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


COUNTS = "part int, lang string, n int, grams binary, counts binary, texts binary"
_COUNT_NAMES = ["part", "lang", "n", "grams", "counts", "texts"]
_COUNT_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
GRAMS = "lang string, n int, w1 long, w2 long, w3 long, f long, word binary"


def _again(texts: DataFrame, parts: int, most: int, sieve) -> DataFrame:
    """Per chunk, hash partition and length: word hashes and counts of its n-grams, those that the sieve holds; single words with their texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bits = None if sieve is None else sieve.value
        for lang, grams, hashes, words in _chunks(batches, most):
            for places, counts in grams:
                names = [hashes[p] for p in places]
                keys = gram_hash(names, lang)
                if bits is not None:
                    a, b = _probes(keys, len(bits) * 8)
                    hit = (bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
                    own = np.flatnonzero(hit)
                    keys, counts, names, places = keys[own], counts[own], [x[own] for x in names], [p[own] for p in places]
                for part, own in _by_part(keys, parts):
                    text = b"\n".join([words[i] for i in places[0][own]]) if len(places) == 1 else None
                    yield part, lang, len(places), np.array([x[own] for x in names]).tobytes(), counts[own].astype(np.uint32).tobytes(), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(rows(batches), _COUNT_NAMES, _COUNT_TYPES)

    return texts.mapInArrow(run, COUNTS)


class Exact:
    """Sums of counts by the word hashes of an n-gram, for the survivors only."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted, self.waiting, self.keys, self.counts, self.texts = wanted, 0, [], [], {}

    def add(self, lang: str, n: int, grams: bytes, counts: np.ndarray, texts: bytes | None) -> None:
        keys = np.frombuffer(grams, np.uint64).reshape(n, -1)
        if not len(self.wanted):
            return
        hashes = gram_hash(list(keys), lang)
        own = np.flatnonzero(self.wanted[np.minimum(np.searchsorted(self.wanted, hashes), len(self.wanted) - 1)] == hashes)
        if texts is not None:
            words = texts.split(b"\n")
            for i in own:
                if self.texts.setdefault(int(keys[0, i]), words[i]) != words[i]:
                    raise ValueError("two frequent words share a 64-bit hash")
        self.keys.append(keys[:, own])
        self.counts.append(counts[own].astype(np.int64))
        self.waiting += len(own)
        if self.waiting > 500_000 + 2 * len(self.counts[0]):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys, axis=1), np.concatenate(self.counts)
        if len(counts):
            order = np.lexsort(keys)
            keys, counts = keys[:, order], counts[order]
            first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            keys, counts = keys[:, first], np.add.reduceat(counts, first)
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts


def exact(packed: DataFrame, found: DataFrame, parts: int, least: int) -> DataFrame:
    """lang, n, word hashes, exact count f (least or more) and, of single words, the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted, sums = None, np.empty(0, np.uint64), None

        def done():
            keys, counts = sums.merge()
            own = counts >= least
            keys, counts = keys[:, own], counts[own]
            some = [pa.array(k.view(np.int64)) for k in keys] + [pa.nulls(len(counts), pa.int64())] * (3 - len(keys))
            words = pa.array([sums.texts[int(k)] for k in keys[0]] if len(keys) == 1 else [None] * len(counts), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(counts), pa.string()), pa.array(np.full(len(counts), now[2], np.int32)), *some, pa.array(counts), words], ["lang", "n", "w1", "w2", "w3", "f", "word"])

        for batch in batches:
            for part, lang, n, grams, counts, texts in zip(*batch.columns, strict=True):
                key = part.as_py(), lang.as_py(), n.as_py()
                if key != now:
                    if sums:
                        yield done()
                    if key[:2] != (now or ())[:2]:
                        wanted = np.empty(0, np.uint64)
                    now, sums = key, None
                if key[2] == 0:
                    wanted = np.frombuffer(grams.as_buffer(), np.uint64)
                    continue
                sums = sums or Exact(wanted)
                if not sums.keys:
                    sums.keys.append(np.empty((key[2], 0), np.uint64)), sums.counts.append(np.empty(0, np.int64))
                sums.add(key[1], key[2], grams.as_buffer(), np.frombuffer(counts.as_buffer(), np.uint32), texts.as_py())
        if sums:
            yield done()

    known = found.select("part", "lang", F.lit(0).alias("n"), "grams", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("texts"))
    dealt = packed.unionByName(known).repartition(parts, "part").sortWithinPartitions("part", "lang", "n")
    return dealt.mapInArrow(run, GRAMS)


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, slack: int = SLACK, parts: int | None = None, most_bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """The n-grams that occur `least` times or more, per language, with exact counts; and all word occurrences per language."""
    if not 1 <= most <= 3:
        raise ValueError("n-grams have one to three words")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = parts or max(1, math.ceil(size / PART_BYTES))
    found = held(survivors(_packed(texts, parts, least, most), parts, least, slack))
    bits = bitmap(found, most_bits)
    sieve = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    grams = held(exact(_again(texts, parts, most, sieve), found, parts, least))
    return grams, found.groupBy("lang").agg(F.sum("words").cast("long").alias("n"))


# --- scores -----------------------------------------------------------------------------------------------------------


def score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), exact: products have up to 38 digits."""
    wide = f"CAST(CAST(1000000 * CAST({a} AS DECIMAL(15,0)) AS DECIMAL(22,0)) * CAST({a} AS DECIMAL(15,0)) AS DECIMAL(37,0))"
    return F.expr(f"CAST({wide} div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0))) AS LONG)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two and three words."""
    grams, totals = frequent(docs, least, MOST_WORDS, **how)
    words = small(held(grams.filter("n = 1").select("lang", "w1", "f", F.col("word").cast("string").alias("word"))), BROADCAST_ROWS)
    pairs, triples = (grams.filter(F.col("n") == n).drop("n", "word") for n in (2, 3))

    def place(i: int) -> DataFrame:
        return words.select("lang", F.col("w1").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"word{i}"))

    def pair(i: int) -> DataFrame:
        return pairs.select("lang", F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{i + 1}"), F.col("f").alias(f"p{i}"))

    longer = triples.select("lang", "w1", "w2", "f").union(triples.select("lang", "w2", "w3", "f")).groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    two = pairs.select("lang", "w1", "w2", F.col("f").alias("a")).join(longer, ["lang", "w1", "w2"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
    two = two.join(place(1), ["lang", "w1"]).join(place(2), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    three = triples.withColumnRenamed("f", "a").join(pair(1), ["lang", "w1", "w2"]).join(pair(2), ["lang", "w2", "w3"])
    for i in (1, 2, 3):
        three = three.join(place(i), ["lang", f"w{i}"])
    three = three.withColumns({"s1": score("a", "f1", "p2"), "s2": score("a", "p1", "f3")})
    pick = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", pick("f1", "p1").alias("l"), pick("p2", "f3").alias("r"), F.least("s1", "s2").alias("score"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = two.union(three).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
