"""A mix of sources to target weights: exact block quotas, split over output shards by a multivariate-hypergeometric tree.

1. Each source's documents, in an order drawn by hash, form one stream of words, cut into equal blocks (the last may be
   short). A document's place is a sum over its hash bucket and over the buckets before it, so no source is one sort.
2. Targets: sources weigh 1, 2, 3, repeating, by code point; a target stops at 3 times its source, and what it leaves is
   shared again by weight until none is above. A source's quota is the number of blocks nearest to its target.
3. All quotas together fill equal shards. From the root (all shards), a node gives its left half as many blocks of each
   source as a draw without replacement would: a multivariate-hypergeometric split of the exact counts. Each child also
   gets the part of the source's permuted order that its blocks come from, so shards are disjoint, without a common pass.
   Nodes hold one row per source; six levels are split in one step.
4. A shard deals its blocks: the epoch and place of each in its source's keyed permutation (a Feistel network walked
   into range, new for each epoch), then a local shuffle. An epoch is the whole source, so no block comes more than 3 times.

Blocks have 512 words, fewer where a source or its target has under 512 x 1024 (a target is met within some thousandth
of the smaller of both), and more where all sizes pass 2.5e11 words, which keeps the quotas below the 10^9 that numpy's
exact draw takes. Reruns agree: everything follows from ids, texts and the seed.

Defined cases: null and empty texts, and those of white space, have size 0 and are taken 0 times; a source of such texts
only has target 0. A null source is a source of its own, last in order. Null and repeated doc_ids are rows like any other;
rows that are equal in doc_id, source and text may swap their `taken`. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegrain.functions.ordering import numbered
from sitegrain.llm.common import held, let, small

WORD = "[^ \\t-\\r]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 512
#: Blocks that a source, or its target, has at least (of single words at worst).
LEAST_BLOCKS = 1024
#: Blocks of all sources together, for which the block grows: numpy draws exactly from under 10^9.
MOST_BLOCKS = 500_000_000
SHARD_BLOCKS = 8192
#: Hash buckets of a source's stream; each is one window.
BUCKETS = 4096
LEVELS_A_STEP = 6
#: Sources up to which their table is broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
SEED = 20240301


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a mark of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark")
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, sid (its place in order), source_size, weight, target, and the cut into blocks: block_words, blocks, draws."""
    given = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = numbered(given, "sid", F.col("source").isNull(), F.col("source"))
    given = held(given.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")))
    whole = int(given.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * most
    share, capped = Fraction(0), None
    while True:
        # two numbers a round reach the driver, however many sources there are
        above = F.lit(False) if capped is None else F.col("weight").cast("decimal(38,0)") * F.lit(share.numerator).cast("decimal(38,0)") > limit.cast("decimal(38,0)") * F.lit(share.denominator).cast("decimal(38,0)")
        n, full, free = given.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, share = n, Fraction(whole - int(full or 0), int(free))
    by_weight = F.col("weight") * F.lit(float(share.numerator)) / F.lit(float(share.denominator))
    given = given.withColumn("target", F.least(limit.cast("double"), by_weight))
    most_words = max(BLOCK_WORDS, -(-whole // MOST_BLOCKS))
    less = F.least(F.col("source_size").cast("double"), F.col("target"))
    given = given.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(most_words), F.floor(less / LEAST_BLOCKS))).cast("long"))
    given = given.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.least(F.round((F.col("target") - epochs * F.col("source_size")) / F.col("block_words")).cast("long"), F.col("blocks"))
    return held(given.withColumn("draws", F.least(epochs * F.col("blocks") + rest, F.col("blocks") * most)))


def placed(sized: DataFrame, sources: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each document with its source's row and its first word's place in the source's stream."""
    rows = sized.join(small(sources, BROADCAST_ROWS), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "mark"), F.lit(buckets)).cast("int"))
    order = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).select("sid", "bucket", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("start"))
    inner = W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    offset = F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    return rows.join(starts, ["sid", "bucket"]).withColumn("at", offset).drop("bucket", "start")


# --- the tree -------------------------------------------------------------------------------------------------------

NODE = "lo long, hi long, sid long, blocks long, start long, quota long"


def _node(lo: int, hi: int, sid: np.ndarray, blocks: np.ndarray, start: np.ndarray, quota: np.ndarray) -> pa.RecordBatch:
    n = len(sid)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, lo), np.full(n, hi), sid, blocks, start, quota)], ["lo", "hi", "sid", "blocks", "start", "quota"])


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    table = table.sort_by("sid")
    return {name: table.column(name).to_numpy() for name in table.column_names}


def _split(shard_blocks: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        c = _columns(table)
        open_, done = [(int(c["lo"][0]), int(c["hi"][0]), c["sid"], c["blocks"], c["start"], c["quota"], LEVELS_A_STEP)], []
        while open_:
            lo, hi, sid, blocks, start, quota, levels = open_.pop()
            if hi - lo == 1 or not levels:
                done.append(_node(lo, hi, sid, blocks, start, quota))
                continue
            mid = (lo + hi) // 2
            draw = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, lo, hi])))
            left = draw.multivariate_hypergeometric(quota, min(int(quota.sum()), (mid - lo) * shard_blocks), method="marginals")
            for a, b, first, n in ((lo, mid, start, left), (mid, hi, start + left, quota - left)):
                some = n > 0
                if some.any():
                    open_.append((a, b, sid[some], blocks[some], first[some], n[some], levels - 1))
        return pa.Table.from_batches(done)

    return run


def quotas(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per shard (lo) and source: its exact count of blocks, and where in the source's permuted order they start."""
    whole = int(sources.agg(F.sum("draws")).first()[0] or 0)
    shards = -(-whole // shard_blocks)
    nodes = sources.filter("draws > 0").select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "sid", "blocks", F.lit(0).cast("long").alias("start"), F.col("draws").alias("quota")
    )
    width = shards
    while width > 1:
        nodes = held(nodes.groupBy("lo", "hi").applyInArrow(_split(shard_blocks, seed), NODE))
        for _ in range(LEVELS_A_STEP):
            width = -(-width // 2)
    return nodes


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(size) sends the indices: four Feistel rounds, walked on while out of range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.SeedSequence(key).generate_state(4, np.uint64)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def dealt(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, slot in it, sid and block: each shard draws its permuted blocks and shuffles them."""

    def run(table: pa.Table) -> pa.Table:
        c = _columns(table)
        shard = int(c["lo"][0])
        sids, found = [], []
        for sid, blocks, start, quota in zip(*(c[x].tolist() for x in ("sid", "blocks", "start", "quota"))):
            place = np.arange(start, start + quota)
            block = np.empty(quota, np.int64)
            for epoch in range(start // blocks, (start + quota - 1) // blocks + 1):
                own = place // blocks == epoch
                block[own] = permuted(place[own] % blocks, blocks, [seed, sid, epoch])
            sids.append(np.full(quota, sid))
            found.append(block)
        sids, found = np.concatenate(sids), np.concatenate(found)
        slot = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, 1, shard]))).permutation(len(found))
        return pa.table({"shard": np.full(len(found), shard), "slot": slot, "sid": sids, "block": found})

    return nodes.groupBy("lo").applyInArrow(run, "shard long, slot long, sid long, block long")


def pieces(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """What each dealt block holds: shard, slot, sid, at (the document's place), doc_id, source, mark, first (word of the document), words."""
    spans = rows.filter("size > 0").withColumn("block", F.explode(F.expr("sequence(at div block_words, (at + size - 1) div block_words)")))
    first = F.greatest(F.lit(0), F.col("block") * F.col("block_words") - F.col("at"))
    last = F.least(F.col("size"), (F.col("block") + 1) * F.col("block_words") - F.col("at"))
    spans = spans.select("sid", "block", "at", "doc_id", "source", "mark", first.alias("first"), (last - first).alias("words"))
    return spans.join(blocks, ["sid", "block"]).select("shard", "slot", "sid", "at", "doc_id", "source", "mark", "first", "words")


def mixed(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with size, source_size, target and place, and the pieces of them that the mix takes, shard by shard."""
    sized = held(sizes(docs))
    sources = targets(sized)
    rows = held(placed(sized, sources))
    return rows, pieces(rows, held(dealt(quotas(sources, seed=seed), seed)))


def taken(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, and the words that the mix takes of it."""
    columns = ["doc_id", "size", "source_size", "target"]
    sums = parts.groupBy("sid", "at").agg(F.sum("words").alias("n"))
    some = rows.filter("size > 0").join(sums, ["sid", "at"], "left").select(*columns, F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(rows.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def texts_of(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, at, doc_id, source and the piece's words, joined by blanks. Each text is split once."""
    piece = F.struct("shard", "slot", "at", "first", "words")
    wanted = parts.groupBy("doc_id", "source", "mark").agg(F.collect_list(piece).alias("pieces"))
    text = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    text = text.withColumn("m", F.xxhash64("t")).dropDuplicates(["d", "s", "m"])
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("m") == F.col("mark"))
    cut = let(
        F.filter(F.split("t", "[ \\t-\\r]+"), lambda w: w != ""),
        lambda words: F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["slot"].alias("slot"), p["at"].alias("at"), F.array_join(F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text"))),
    )
    return wanted.join(text, same).select("doc_id", "source", F.explode(cut).alias("p")).select("p.shard", "p.slot", "p.at", "doc_id", "source", "p.text")


def write_mix(docs: DataFrame, path: str, seed: int = SEED) -> None:
    """Writes the mix as Parquet, a folder per shard, each in its shuffled order."""
    parts = mixed(docs, seed)[1]
    texts_of(docs, parts).repartition("shard").sortWithinPartitions("shard", "slot", "at").write.partitionBy("shard").parquet(path)
