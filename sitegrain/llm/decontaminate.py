"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of slots and words are joined by hash.

A text becomes a list of items: lower-cased words without punctuation, or the slots <number>, <unit> (after a number) and
<name> (a capitalised word). A capitalised word that begins a sentence or line may be either a word or a name: its windows are hashed in
all variants. Windows of WINDOW items with at least half of them words are hashed by template; those that may have more slots than words,
and so say little as templates, by their exact values. A benchmark item of fewer items is one window. The benchmark's distinct window
hashes are sent to the tasks while they are few (counted first), so that only windows that can match leave a document, and only windows
whose first LEAD items, in one of their variants, begin a window of the benchmark are spelt at all; beyond that all windows are joined.
Matches of a document and an item count by alignment (position in the document less position in the item): its slots
must be filled consistently, each value of the item by one value of the document, and enough of the item's windows must lie on it. Enough
is COVERAGE of the windows that have a template, or, with those that agree exactly, of all windows. An alignment that is consistent
without the variants of sentence beginnings counts without them.

Defined cases: null and empty texts match nothing; a benchmark item without words and slots is no template, one of slots only is found by
its exact values. Items with equal templates, whose
values are equal at the same places, have equal answers: they are searched once and all of them are reported. Rows with a null doc_id
match nothing. Rows that repeat a doc_id count as one document.
Empty tables give no leaks. Columns other than doc_id and text, and item_id and text of the benchmark, play no part.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import bundled, by_own_ids, held, small, texts

WINDOW = 8
#: First places of a window by which most windows are turned away before they are hashed.
LEAD = 4
#: Share of an item's windows that one consistent alignment must hold.
COVERAGE = 0.3
#: Benchmark windows (16 bytes each) up to which their hashes are sent to the tasks.
SENT_ROWS = 1_000_000
#: Words whose numbers a task keeps, and characters of the texts that it takes at once.
WORDS_KEPT, PORTION = 50_000, 1_000_000
UNITS = frozenset("mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hours days weeks years kb mb gb tb hz khz mhz ghz w kw v a °c °f % percent usd eur dollars euros cents".split())
_NUMBER = re.compile(r"[+-]?[0-9][0-9.,]*(?:[a-z°%]{0,3})")
_NUMBER_BEGINS = "+-0123456789"
_EDGE = re.compile(r"^[^\w%°$€+-]+|[^\w%°$€]+$")
_NAME, _NUM, _UNIT = "<name>", "<number>", "<unit>"


#: How a window was hashed: by its template, by one with a sentence's first word as a name, or by its exact values.
PLAIN, VARIANT, EXACT = 0, 1, 2


def _code(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode())


#: What a word can be, as bits.
_NUMBER_BIT, _CAPITAL, _UNIT_BIT, _NOTHING, _ENDS = (1 << i for i in range(5))


class Words(dict):
    """word -> its number; by number: bare lower-cased value, code, and what the word can be."""

    def __init__(self):
        super().__init__()
        self.values: list[str] = []
        self.fresh: tuple[list[int], list[int]] = [], []
        self.codes, self.flags = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def __missing__(self, word: str) -> int:
        # most words are letters only, and need no pattern
        bare = word if word.isalpha() else _EDGE.sub("", word)
        low = bare.lower()
        flag = _ENDS if word[-1] in ".!?:" else 0
        if low[:1] in _NUMBER_BEGINS and _NUMBER.fullmatch(low):
            flag |= _NUMBER_BIT
        elif bare[:1].isupper() and bare[1:].islower():
            flag |= _CAPITAL
        if low in UNITS:
            flag |= _UNIT_BIT
        if not low:
            flag |= _NOTHING
        self.fresh[0].append(_code(low))
        self.fresh[1].append(flag)
        self[word] = at = len(self.values)
        self.values.append(low)
        return at

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes and the bits of all words, by number."""
        if self.fresh[0]:
            self.codes = np.concatenate([self.codes, np.array(self.fresh[0], np.uint64)])
            self.flags = np.concatenate([self.flags, np.array(self.fresh[1], np.uint8)])
            self.fresh = [], []
        return self.codes, self.flags


class Items:
    """The items of some texts one after another: owner (number of the text), begin (of each text), code of the value and of the item, slot, maybe (also a name)."""

    def __init__(self, texts_: list[str], known: Words):
        words, lines, sizes = [], [], []
        for text in texts_:
            before = len(words)
            for line in text.split("\n"):
                lines.append(len(words))
                words += line.split()
            sizes.append(len(words) - before)
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        codes, flags = known.look()
        flags = flags[ids]
        owner = np.repeat(np.arange(len(texts_)), sizes)
        # what lies between an item and the one before it: a line's start, or a word that ends a sentence
        event = np.zeros(len(ids) + 1, bool)
        event[lines] = True
        event[1:] |= (flags & _ENDS) != 0
        passed = np.cumsum(event)[:-1]
        kept = np.flatnonzero((flags & _NOTHING) == 0)
        self.ids, self.owner, flags = ids[kept], owner[kept], flags[kept]
        passed = passed[kept]
        begins = np.diff(passed, prepend=0) > 0
        same = np.diff(self.owner, prepend=-1) == 0
        number = (flags & _NUMBER_BIT) != 0
        unit = ((flags & _UNIT_BIT) != 0) & same & np.concatenate([[False], number[:-1]])[: len(number)]
        number, capital = number & ~unit, ((flags & _CAPITAL) != 0) & ~unit
        name, self.maybe = capital & ~begins, capital & begins
        self.exact = codes[self.ids]
        self.code = np.where(unit, _code(_UNIT), np.where(number, _code(_NUM), np.where(name, _code(_NAME), self.exact)).astype(np.uint64)).astype(np.uint64)
        self.slot = unit | number | name
        self.sizes = np.bincount(self.owner, minlength=len(texts_))
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])


def _start(places: int, kind: int) -> np.uint64:
    return np.uint64(places + (kind == EXACT) * 1000)


def _mix(out: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ x
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _mixed(columns: list[np.ndarray], kind: int) -> np.ndarray:
    """Hashes of windows, given the codes at each of their places."""
    out = np.full(len(columns[0]), _start(len(columns), kind))
    for x in columns:
        out = _mix(out, x)
    return out.view(np.int64)


def windows(
    items: Items, width: int, exact: str | None, may: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray | None]]:
    """Windows of the width, as (kind, first places, codes place by place, and what is a slot in them; exact windows have none).

    exact: which windows are also given by their exact values: "slots" (that may have more slots than words), "all" or None.
    may: for each place whether a window is to begin there; None for all.
    """
    count = len(items.ids) - width + 1
    if count < 1 or width < 1:
        return
    begins = items.owner[:count] == items.owner[width - 1 :]
    at = np.flatnonzero(begins if may is None else begins & may[:count])
    if not len(at):
        return
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)]).astype(np.int64)[np.stack([at, at + width])], axis=0)[0]
    slots, maybe = sums(items.slot), sums(items.maybe)
    usable = 2 * slots <= width
    if exact:
        own = at if exact == "all" else at[2 * (slots + maybe) > width]
        yield EXACT, own, [items.exact[own + j] for j in range(width)], None
    own = at[usable]
    yield PLAIN, own, [items.code[own + j] for j in range(width)], None
    name = np.uint64(_code(_NAME))
    for n in np.unique(maybe[usable & (maybe > 0)]).tolist():
        picked = usable & (maybe == n)
        first, free = at[picked], width // 2 - slots[picked]
        place = first[:, None] + np.arange(width)
        where = np.nonzero(items.maybe[place])[1].reshape(-1, n)
        code, slot = items.code[place], items.slot[place]
        for size in range(1, min(n, int(free.max())) + 1):
            fits = np.flatnonzero(free >= size)
            for chosen in itertools.combinations(range(n), size):
                new, names = code[fits], slot[fits]
                for c in chosen:
                    new[np.arange(len(fits)), where[fits, c]] = name
                    names[np.arange(len(fits)), where[fits, c]] = True
                yield VARIANT, first[fits], list(new.T), names


class Hashes:
    """A set of hashes; a table of their leading bits turns most others away."""

    def __init__(self, hashes: np.ndarray):
        bits = min(max(20, len(hashes).bit_length() + 5), 24)
        self.hashes, self.shift, self.leading = np.unique(hashes), np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.leading[self._lead(self.hashes)] = True

    def _lead(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) >> self.shift).view(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        may = np.flatnonzero(self.leading[self._lead(hashes)])
        near = np.minimum(np.searchsorted(self.hashes, hashes[may]), len(self.hashes) - 1)
        return may[self.hashes[near] == hashes[may]]


class Wanted:
    """The benchmark's window hashes, and those of the first LEAD places of its windows."""

    def __init__(self, hashes: np.ndarray, leads: np.ndarray):
        self.whole, self.leads = Hashes(hashes), Hashes(leads)

    def begins(self, items: Items, places: int, exact: bool) -> np.ndarray:
        """For each item whether a window that is wanted may begin there: its first places, in one of their variants, are wanted.

        Variants are spelt place by place, so that those with a common beginning share its work: 2^places at most for an
        item, and one for most.
        """
        out, count = np.zeros(len(items.ids), bool), len(items.ids) - places + 1
        if count < 1:
            return out
        name = np.uint64(_code(_NAME))
        spelt = [(np.full(count, _start(places, PLAIN)), None)]
        for j in range(places):
            code, maybe = items.code[j : j + count], items.maybe[j : j + count]
            longer = []
            for some, at in spelt:
                longer.append((_mix(some, code if at is None else code[at]), at))
                named = np.flatnonzero(maybe if at is None else maybe[at])
                if len(named):
                    longer.append((_mix(some[named], name), named if at is None else at[named]))
            spelt = longer
        if exact:
            spelt.append((_mixed([items.exact[j : j + count] for j in range(places)], EXACT).view(np.uint64), None))
        for some, at in spelt:
            found = self.leads.places(some.view(np.int64))
            out[found if at is None else at[found]] = True
        return out


_FOUND = "id long, hash long, lead long, at int, kind int, slots array<string>"


def _portions(texts_: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts, about PORTION characters at a time, and the number of their first one."""
    first, some, size = 0, [], 0
    for i, text in enumerate(texts_.to_pylist()):
        some.append(text)
        size += len(text)
        if size >= PORTION:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some


def _first_places(items: Items, known: Words) -> list[str]:
    """For each item the first place in its text where its value stands."""
    first: dict[tuple[int, str], str] = {}
    owners, begins = items.owner.tolist(), items.begin.tolist()
    return [first.setdefault((o, known.values[x]), str(i - begins[o])) for i, (o, x) in enumerate(zip(owners, items.ids.tolist(), strict=True))]


def _windows_of(rows: DataFrame, widths: list[int], exact: list[int] | None, wanted: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Windows of (id, text) rows. exact: the widths of which exact windows are asked for, too; None for benchmark items.

    Of items only windows of WINDOW items, or of all if they are fewer, are taken, and a slot is given as the first place of its value,
    since only equal values must be filled alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, only = Words(), None if wanted is None else Wanted(*wanted)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, some in _portions(batch.column(1)):
                items = Items(some, known)
                may = {n: only.begins(items, n, bool(exact)) for n in {min(w, LEAD) for w in widths}} if only else {}
                places_of = None if exact is not None else _first_places(items, known)
                for width in widths:
                    exactly = "slots" if exact is None else "all" if width in exact else None
                    for kind, at, codes, slot in windows(items, width, exactly, may.get(min(width, LEAD))):
                        hashes = _mixed(codes, kind)
                        picked = np.arange(len(at)) if only is None else only.whole.places(hashes)
                        if exact is None:
                            picked = picked[np.minimum(items.sizes[items.owner[at[picked]]], WINDOW) == width]
                        if not len(picked):
                            continue
                        own, values = at[picked], []
                        for k, i in zip(picked.tolist(), own.tolist(), strict=True):
                            places = [] if kind == EXACT else (i + np.flatnonzero(items.slot[i : i + width] if slot is None else slot[k])).tolist()
                            values.append([known.values[items.ids[p]] if places_of is None else places_of[p] for p in places])
                        owner, leads = items.owner[own], _mixed([c[picked] for c in codes[:LEAD]], kind)
                        columns = ids[first + owner], hashes[picked], leads, (own - items.begin[owner]).astype(np.int32), np.full(len(own), kind, np.int32), values
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["id", "hash", "lead", "at", "kind", "slots"])
                if len(known) > WORDS_KEPT:
                    known = Words()

    return rows.mapInArrow(run, _FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, item_id, windows (matched on the best alignment) and of (the item's windows) for each leak."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id IS NOT NULL")
    named = held(bundled(named.distinct().select(F.xxhash64("item_id", "text").alias("id"), "item_id", "text")))
    items = named.select("id", "text")
    widths = _widths(items)
    # items with equal windows and equal places of equal values are searched as one of them, and all are found with it
    asked = held(bundled(_windows_of(items, widths, None, None)))
    sums_of = asked.groupBy("id").agg(F.sum(F.xxhash64("hash", "at", "kind", "slots").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    one = held(bundled(sums_of.groupBy("sum", "n").agg(F.min("id").alias("one"))))
    members = held(bundled(sums_of.join(one, ["sum", "n"]).join(named, "id").select(F.col("one"), F.col("item_id").alias("member")).distinct()))
    asked = held(bundled(asked.join(one.select(F.col("one").alias("id")), "id", "left_semi")))
    # windows with a template, and all windows
    of = asked.groupBy(F.col("id").alias("item_id"), "at").agg(F.min("kind").alias("kind")).groupBy("item_id")
    of = held(bundled(of.agg(F.count_if(F.col("kind") == PLAIN).alias("of_plain"), F.count("*").alias("of"))))
    hashes, wanted = held(bundled(asked.select("hash", "lead").distinct())), None
    if hashes.count() <= sent_rows:
        rows = hashes.collect()
        wanted = np.array([r.hash for r in rows], np.int64), np.array([r.lead for r in rows], np.int64)
    exact = widths if asked.filter(f"kind = {EXACT}").limit(1).count() else []
    rows = texts(docs).filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    if wanted is not None and not len(wanted[0]):
        rows, wanted = rows.limit(0), None
    found = held(_windows_of(rows, widths, exact, wanted).drop("lead"))
    ask = small(asked, sent_rows).select(F.col("id").alias("item_id"), "hash", F.col("at").alias("item_at"), F.col("kind").alias("item_kind"), F.col("slots").alias("item_slots"))
    met = found.withColumnRenamed("id", "doc_id").join(ask, "hash")
    met = held(met.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("kind", F.greatest("kind", "item_kind")).drop("hash", "at", "item_kind"))
    # each value of the item must stand for one value of the document, all over the alignment; without variants, and with them
    group = ["doc_id", "item_id", "shift"]
    pair = F.explode(F.arrays_zip("slots", "item_slots")).alias("p")
    filled = met.select(*group, "kind", pair).groupBy(*group, F.col("p.item_slots").alias("theirs"), F.col("p.slots").alias("mine")).agg(F.min("kind").alias("kind"))
    values = filled.groupBy(*group, "theirs").agg(F.count("*").alias("every"), F.count(F.when(F.col("kind") == PLAIN, 1)).alias("plain"))
    clash = values.groupBy(*group).agg(F.max("every").alias("every"), F.max("plain").alias("plain")).filter("every > 1")
    kinds = {"p": [PLAIN], "pv": [PLAIN, VARIANT], "pe": [PLAIN, EXACT], "pve": [PLAIN, VARIANT, EXACT]}
    each = met.groupBy(*group, "item_at").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    counts = each.groupBy(*group).agg(*(F.count_if(F.col("kinds").bitwiseAND(F.lit(sum(1 << x for x in k))) != 0).alias(n) for n, k in kinds.items()))
    counts = counts.join(clash, group, "left").join(small(of, sent_rows), "item_id")
    need = lambda of: F.greatest(F.lit(1), F.ceil(F.col(of) * coverage))
    enough = lambda some, every: (F.col(some) >= need("of_plain")) | (F.col(every) >= need("of"))
    with_variants = F.col("every").isNull() & enough("pv", "pve")
    without = (F.coalesce("plain", F.lit(0)) <= 1) & enough("p", "pe")
    counts = counts.withColumn("windows", F.when(with_variants, F.col("pve")).when(without, F.col("pe"))).filter("windows IS NOT NULL")
    best = counts.groupBy("doc_id", "item_id", "of").agg(F.max("windows").alias("windows"))
    every = best.join(small(members, sent_rows), F.col("item_id") == F.col("one")).groupBy("doc_id", "member").agg(F.max(F.struct("windows", "of")).alias("m"))
    return every.select("doc_id", F.col("member").alias("item_id"), "m.windows", "m.of")


def _widths(items: DataFrame) -> list[int]:
    """The window lengths that occur: WINDOW, and the lengths of shorter items; at most WINDOW numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            sizes = np.minimum(Items(batch.column(1).to_pylist(), known).sizes, WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32())], ["width"])

    return sorted(r.width for r in items.mapInArrow(run, "width int").distinct().collect() if r.width > 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, items (ids of the benchmark items it holds, ascending), contaminated."""
    found = leaks(docs, benchmark, coverage).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumnRenamed("doc_id", "d")
    rows = texts(docs).select("doc_id").join(found, F.col("doc_id") == F.col("d"), "left")
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", F.coalesce("items", none).alias("items"), F.col("items").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Rows with a null or repeated doc_id are searched each for itself."""

    def stage(rows: DataFrame) -> DataFrame:
        drop = leaks(rows, benchmark).select(F.col("doc_id").alias("_drop")).distinct()
        return rows.join(drop, rows["doc_id"] == drop["_drop"], "left_anti")

    return by_own_ids(docs, stage)
