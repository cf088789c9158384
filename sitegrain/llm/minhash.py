"""Near duplicates: minima of universal hashes in bands, signature checks, exact checks, components by two stars.

1. Each document becomes its set of word shingles (as 64-bit hashes), the minima of bands x rows universal hashes over
   the set, one key per band, and four bits of every minimum as its signature.
2. Documents with the same set collapse to the smallest doc_id, so copies never meet in a band.
3. Every member of a band bucket is compared with one pivot only: the member that meets most others over all its buckets,
   which in a group of edited copies is the text that they were made from. That is one candidate per member and band,
   however large the bucket. Signatures screen the candidates; full sets confirm them.
4. Links give components by alternating large-star and small-star.
5. Buckets that still hold several components may hide links between members whom no pivot joins. Members of one pivot's
   buckets are joined by a prefix filter on their differences from the pivot, so that texts made from one text, but not
   alike, don't meet for what they have in common; signatures and full sets confirm. No link that a shared bucket offers
   is lost, and a bucket of near copies that hang together costs nothing here.

With 56 bands of 6 rows a pair at similarity 0.8 shares no bucket with probability 4e-8; the screen of 336 minima turns
away a pair at 0.8 with probability 3e-6, and one at 0.82 with 3e-8.

Defined cases: null and empty texts, and texts of white space only, have an empty set and are linked with nothing. A text
of fewer words than a shingle takes is one shingle of all its words. A row with a null doc_id is linked with nothing;
its component_id is null and it is kept. Rows that repeat a doc_id all carry the same component. An empty table gives an
empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegrain.llm.common import bundled, by_own_ids, held, small, texts

BANDS, ROWS = 56, 6
#: Standard deviations below its mean at which the agreement of two signatures is too low for the similarity asked.
DEVIATIONS = 4.5
#: Rows up to which a frame of ids or pairs is broadcast (some 16 bytes each); beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Copies (digest and id, some 70 bytes each) up to which they are broadcast.
COPIES_ROWS = 250_000
#: Bytes of shingle sets up to which their documents, packed, are broadcast.
BROADCAST_BYTES = 48_000_000
#: Bits of a sieve for each id, longs of bits in one of its pieces, and pieces at most (16 MB in all).
SIEVE_BITS, SIEVE_LONGS, SIEVE_PIECES = 16, 256, 8192
#: Classes of members by how far they differ from their pivot, per size of the pivot's set.
CLASSES = 32
#: Distinct words whose hashes a task keeps at once.
WORDS_KEPT = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, worked out once for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z only, and white space is blank and \\x09-\\x0D


def shingle_set(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles. Letters A-Z count as lower case."""
    return _shingles(_words(text), words, hashes)


def _shingles(found: list[bytes], words: int, hashes: WordHashes) -> np.ndarray:
    if not found:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    width = min(words, len(values))
    out = np.full(len(values) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mixed((out * _MIX) ^ values[j : len(values) - width + 1 + j])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def packed(text: str, words: int, hashes: WordHashes) -> bytes:
    """What tells a text's shingle set, in few bytes: its words, compressed, or the set itself where that is shorter.

    Hashes can't be compressed; the words of prose take about a third of their bytes. Texts that repeat may have far fewer
    shingles than words: a set has about as many elements as there are distinct words, or more, so it is only made to be
    measured where these are few.
    """
    found = _words(text)
    out = zlib.compress(b" ".join(found), 1)  # begins with \x78
    if 8 * (len(set(found)) - words) < len(out):
        whole = bytes(8) + _shingles(found, words, hashes).tobytes()
        return min(out, whole, key=len)
    return out


def unpacked(data: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The shingle set of a packed text."""
    return _shingles(zlib.decompress(data).split(), words, hashes) if data[0] else np.frombuffer(data, np.uint64, offset=8)


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, (2, count), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def _signature(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, marks (four bits of each minimum) and band keys; the last three null for an empty set."""
    count = bands * rows
    if count % 16:
        raise ValueError("bands x rows must be a multiple of 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_family(count)
        hashes, values = WordHashes(), np.empty((128, count), np.uint64)
        for batch in batches:
            sizes, digests, bits, keys = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words, hashes)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), bits.append(None), keys.append(None)
                    continue
                least = np.full(count, np.iinfo(np.int64).max)
                for at in range(0, len(found), len(values)):
                    some = found[at : at + len(values), None]
                    part = np.multiply(some, a, out=values[: len(some)])
                    np.minimum(least, np.add(part, b, out=part).view(np.int64).min(axis=0), out=least)
                least = least.view(np.uint64)
                band = np.arange(bands, dtype=np.uint64)
                for j in range(rows):
                    band = _mixed((band * _MIX) ^ least[j : bands * rows : rows])
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                four = ((least >> np.uint64(20)) & np.uint64(15)).astype(np.uint8)
                bits.append((four[0::2] | four[1::2] << np.uint8(4)).view(np.int64))
                keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bits", "bands"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bits array<long>, bands array<long>")


def _sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among the ids (held), and few others: a bit for each id is broadcast, in pieces, where the ids themselves are too many.

    Beyond the most pieces bits are shared by more ids, and more other rows pass.
    """
    pieces = 1 << min(math.ceil(math.log2(max(1, ids.count() * SIEVE_BITS / (64 * SIEVE_LONGS)))), int(math.log2(SIEVE_PIECES)))
    parts = {"piece": f"xxhash64(id) & {pieces - 1}L", "slot": f"cast(shiftrightunsigned(xxhash64(id), 32) & {SIEVE_LONGS - 1}L AS int)", "bit": "shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), 48) & 63L AS int))"}
    piece, slot, bit = (F.expr(e).alias(f"_{name}") for name, e in parts.items())
    longs = ids.select(piece, slot, bit).groupBy("_piece", "_slot").agg(F.bit_or("_bit").alias("long")).groupBy("_piece").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "long"))).alias("by"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(SIEVE_LONGS - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long")))
    sieve = held(bundled(longs.select("_piece", filled.alias("_longs"))))
    met = rows.select("*", piece, slot, bit).join(F.broadcast(sieve), "_piece")
    return met.filter("(_longs[_slot] & _bit) != 0").select(*rows.columns)


def _packed(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and whole text, packed (found), of the documents named in ids (column id, held); where these can't be broadcast texts are sieved and packed before they move to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = [packed(text.as_py(), words, hashes) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "found"])

    rows, kinds = texts(docs).withColumnRenamed("doc_id", "id"), "id long, found binary"
    if ids.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), "id", "left_semi").mapInArrow(run, kinds)
    return _sieved(rows, ids).mapInArrow(run, kinds).join(ids, "id", "left_semi")


def _both_sets(own: pa.Array, core: pa.Array, words: int, hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of each row's packed texts. Rows of one pivot mostly come one after the other, and its set is then made once."""
    last, wide = None, None
    for x, y in zip(own, core, strict=True):
        x, y = x.as_py(), y.as_py()
        if y != last:
            last, wide = y, unpacked(y, words, hashes)
        yield unpacked(x, words, hashes), wide


def _side_by_side(pairs: DataFrame, docs: DataFrame, ids: DataFrame, words: int, member: str, pivot: str) -> DataFrame:
    """The pairs (held) with own and core, the packed texts of their members and pivots (ids, held, has both).

    Pairs are short and texts are long: where the pairs can be broadcast, a member's text moves once for each of its pivots,
    and of the pivots' texts one copy each; both are packed where they lie and go straight into their shuffle. Beyond that
    texts must move to meet their ids (those that a sieve of the ids lets pass), so those found are held, and are also dealt
    by id first. A large group's pivot is hot: its text comes last, and Spark splits that join.
    """
    few, most = pairs.count() <= BROADCAST_ROWS, ids.count() > BROADCAST_ROWS
    whole = held(_packed(docs, ids, words)) if most or not few else None
    sides = []
    for side, found in ((member, "own"), (pivot, "core")):
        rows = whole if whole is not None else _packed(docs, held(bundled(pairs.select(F.col(side).alias("id")).distinct())), words)
        sides.append(rows.select(F.col("id").alias(side), F.col("found").alias(found)))
    own, core = sides
    if few:
        pairs, core = F.broadcast(pairs), core.join(F.broadcast(pairs.select(pivot).distinct()), pivot, "left_semi") if most else core
    return own.join(pairs, member).join(core, pivot)


def _confirmed(pairs: DataFrame, docs: DataFrame, marks: DataFrame, words: int, percent: int, alike) -> DataFrame:
    """The pairs (a, b) that reach the similarity: screened by signature bits (unless alike is None: done before), confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ok = []
            for x, y in _both_sets(batch.column(2), batch.column(3), words, hashes):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    if alike is None:
        screened = held(bundled(pairs))
    else:
        bits = marks.select("id", "bits", "n_shingles")
        left, right = (bits.select(F.col("id").alias(x), F.col("bits").alias(f"{x}_bits"), F.col("n_shingles").alias(f"{x}_n")) for x in "ab")
        pairs = held(bundled(pairs))
        if pairs.count() <= BROADCAST_ROWS:  # signatures of documents in no pair stay where they are
            left, right = (df.join(F.broadcast(pairs.select(x).distinct()), x, "left_semi") for df, x in ((left, "a"), (right, "b")))
        screened = held(bundled(pairs.join(right, "b").join(left, "a").filter(alike).select("a", "b")))
    # each side's ids are combined before they are joined, so no row is made per pair
    ids = held(bundled(screened.select(F.col("a").alias("id")).distinct().union(screened.select(F.col("b").alias("id")).distinct()).distinct()))
    size = marks.join(small(ids, BROADCAST_ROWS), "id", "left_semi").agg(F.sum(8 * F.col("n_shingles") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = held(_packed(docs, ids, words))
        whole = screened.join(F.broadcast(rows.select(F.col("id").alias("a"), F.col("found").alias("own"))), "a")
        whole = whole.join(F.broadcast(rows.select(F.col("id").alias("b"), F.col("found").alias("core"))), "b")
    else:
        whole = _side_by_side(screened, docs, ids, words, "a", "b")
    return whole.select("a", "b", "own", "core").mapInArrow(run, "a long, b long").distinct()


def _differences(crowd: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """pivot, id, component, n (size of the member's set), wide (of the pivot's), d and the elements that only one of both sets holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, wide, apart = [], [], []
            for x, y in _both_sets(batch.column(3), batch.column(4), words, hashes):
                sizes.append(len(x)), wide.append(len(y)), apart.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(wide, pa.int64()), pa.array(apart, pa.list_(pa.int64()))], ["pivot", "id", "component", "n", "wide", "apart"]
            )

    ids = held(bundled(crowd.select("id").distinct().union(crowd.select("pivot").distinct()).distinct()))
    return _side_by_side(crowd, docs, ids, words, "id", "pivot").select("pivot", "id", "component", "own", "core").mapInArrow(run, "pivot long, id long, component long, n long, wide long, apart array<long>")


def _leftover(crowd: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a pivot's members (pivot, id, component) in different components that can reach the similarity.

    A prefix filter on differences from the pivot. With D_A = A xor P, A xor B is D_A xor D_B, and a link allows it at most
    r (|A| + |B|) elements, r = (100 - percent) / (100 + percent). So D_A and D_B share at least o = (g_A + g_B) / 2, with
    g = |D| - r |set|, and never less than one: both can't be linked with P. Members that share o elements share one among
    the first |D| - o + 1 of each, in any common order. Taken rarest first, these are a member's own edits, which nobody
    shares: elements of one member only are counted and not sent. Members are put into classes by g, and send a prefix
    for each class of partners, as long as the least o of both classes asks.

    What is left to meet: members that share edits without being alike, and in a group right at the similarity some of
    those that only lost the same words of the pivot.
    """
    part = (100 - percent) / (100 + percent)
    told = held(_differences(crowd, docs, words))
    element = told.select("pivot", "id", F.explode("apart").alias("e"))
    often = element.groupBy("pivot", "e").agg(F.count("*").alias("times")).filter("times > 1")
    shared = element.join(often, ["pivot", "e"]).groupBy("pivot", "id").agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("shared"))
    width = F.greatest(F.lit(1.0), F.col("wide") / CLASSES)
    gain = F.size("apart") - part * F.col("n")
    sent = held(told.withColumns({"width": width, "class": F.floor(gain / width).cast("int")}).drop("apart", "n", "wide").join(shared, ["pivot", "id"]))
    classes = sent.groupBy("pivot").agg(F.collect_set("class").alias("classes"))
    # the least o of two classes is half the sum of their lower edges
    prefix = F.transform("classes", lambda c: F.struct(c.alias("c"), (F.size("shared") + 1 - F.greatest(F.lit(1), F.ceil((F.col("class") + c) * F.col("width") / 2 - 1e-6))).cast("int").alias("long")))
    rows = sent.join(classes, "pivot").withColumn("p", F.explode(F.filter(prefix, lambda p: p["long"] > 0)))
    rows = rows.withColumn("e", F.explode(F.slice("shared", 1, F.col("p.long"))))
    rows = rows.select("pivot", F.least("class", "p.c").alias("low"), F.greatest("class", "p.c").alias("high"), F.col("e.e").alias("e"), "class", "id", "component")
    key = ["pivot", "low", "high", "e"]
    left = rows.select(*key, F.col("class").alias("x"), F.col("id").alias("a"), F.col("component").alias("a_c"))
    right = rows.select(*key, F.col("class").alias("y"), F.col("id").alias("b"), F.col("component").alias("b_c"))
    return left.join(right, key).filter("a < b AND a_c != b_c AND (x != y OR low = high)").select("a", "b").distinct()


def _alike(x: str, y: str, x_n: str, y_n: str, percent: int, count: int = BANDS * ROWS):
    """Whether two signatures agree often enough; sets whose sizes differ too much can't reach the similarity at all."""
    p = percent / 100 + (1 - percent / 100) / 16
    most = math.floor(count * (1 - p) + DEVIATIONS * math.sqrt(count * p * (1 - p)))
    longs = count // 16
    # of each group of four bits that differs, one bit is left
    folded = "(d | shiftrightunsigned(d, 1) | shiftrightunsigned(d, 2) | shiftrightunsigned(d, 3)) & 1229782938247303441L"
    differ = " + ".join(f"bit_count({folded.replace('d ', f'({x}[{i}] ^ {y}[{i}]) ').replace('(d,', f'({x}[{i}] ^ {y}[{i}],')})" for i in range(longs))
    return F.expr(f"100 * least({x_n}, {y_n}) >= {percent} * greatest({x_n}, {y_n}) AND {differ} <= {most}")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that can be reached) for every id in edges (a, b), by alternating stars."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = held(bundled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()))
    now = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = held(bundled(pulled.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()))
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _shared(single: DataFrame) -> DataFrame:
    """id, band and n (members of the band's bucket), for the buckets of two or more. Band keys move once: they are most of what this operator moves."""
    member = single.select("id", F.explode("bands").alias("band"))
    return member.withColumn("n", F.count("*").over(W.partitionBy("band"))).filter("n > 1")


def _representatives(named: DataFrame, same: DataFrame) -> DataFrame:
    """id, n_shingles, bits and band keys of the documents that stand for their set (same: digest, id, rows).

    The others are told by digest and id, which are short. While they are few they are broadcast, and band keys and
    signatures stay where they are; beyond that these are dealt by digest, once, and held.
    """
    others = named.select("digest", "id").join(same.filter("rows > 1").select("digest", F.col("id").alias("least")), "digest")
    others = held(bundled(others.filter("id != least").select("digest", "id").distinct()))
    few = others.count() <= COPIES_ROWS
    single = named.join(F.broadcast(others) if few else others, ["digest", "id"], "left_anti").select("id", "n_shingles", "bits", "bands")
    return single if few else held(single)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    marks = held(_signature(docs, words, bands, rows))
    named = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    same = held(bundled(named.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"))))
    single = _representatives(named, same)
    alike = _alike("a_bits", "b_bits", "a_n", "b_n", percent, bands * rows)
    member = held(_shared(single))
    meets = member.groupBy("id").agg(F.sum("n").alias("meets"))
    pivots = member.join(meets, "id").groupBy("band").agg(F.max(F.struct("meets", (-F.col("id")).alias("m"))).alias("p"))
    pivots = held(bundled(pivots.select("band", (-F.col("p.m")).alias("pivot"))))
    star = member.join(pivots, "band").filter("id != pivot")
    star = held(bundled(star.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()))
    links = held(bundled(_confirmed(star, docs, single, words, percent, alike)))
    found = held(bundled(components(links)))

    # what the stars leave: buckets with several components, where unlinked members may still be alike
    placed = member.select("band", "id").join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most").select("band")
    crowd = held(bundled(placed.join(mixed, "band").join(pivots, "band").select("pivot", "id", "component").distinct()))
    more = held(bundled(_confirmed(_leftover(crowd, docs, words, percent), docs, single, words, percent, alike)))
    if more.limit(1).count():
        found = held(bundled(components(links.union(more))))

    reach = same.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = marks.select("doc_id", "n_shingles", "digest").join(reach, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: of each component the smallest doc_id.

    Rows with a null or repeated doc_id are documents of their own, and come after all others in their component. Rows
    with an empty set all stay.
    """

    def stage(rows: DataFrame) -> DataFrame:
        stay = near_groups(rows, words, percent).filter("kept").select(F.col("doc_id").alias("_keep"))
        return rows.join(stay, rows["doc_id"] == stay["_keep"], "left_semi")

    return by_own_ids(docs, stage)
