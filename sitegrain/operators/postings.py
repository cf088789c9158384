"""Which of many words or rules a text holds, when they come as a table: a posting index met by a hash join.

A constant rule table is compiled into the plan (``functions.patterns``), which serves some hundreds of rules. Here the
rules are rows, 10^4 to 10^6 of them. Each is posted under one part of the text that it must hold: an n-gram, the one
that a sample of the texts holds least often. A text is cut into its distinct n-grams, these meet the index by equality,
and only then are the word itself and its pattern looked for. Explode, join and filter are one stage: the text is
neither copied per n-gram nor shuffled.

The index is broadcast by slices of at most ``SLICE`` rows, each a pass over the texts. The sample decides under which
n-gram a rule is posted, hence speed, and never what is found. A rule without any fixed text is posted under the empty
n-gram, which every text has.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.patterns import FLAGS, branches, fixed_text
from sitegrain.session import stored

GRAM = 4
#: Rows of the index (some 100 bytes each) that are broadcast at once.
SLICE = 200_000
#: Texts that are read to see which n-grams are rare.
SAMPLE = 2_000


def grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a text, in one walk over it; of a shorter text none."""
    if n == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def posted(words: DataFrame, word: str, texts: DataFrame, text: str) -> DataFrame:
    """The words with ``gram``, the n-gram they are posted under. Both sides in lower case."""
    own = words.select(F.col(word).alias("posted_word")).distinct()
    size = F.length("posted_word")
    parts = F.when(size >= GRAM, grams(F.col("posted_word"), GRAM)).otherwise(F.array(F.col("posted_word")))
    parts = own.select("posted_word", F.explode(parts).alias("gram"))
    lengths = [r["n"] for r in parts.select(F.length("gram").alias("n")).distinct().collect()]
    seen = texts.limit(SAMPLE).select(F.explode(F.flatten(F.array(*[grams(F.col(text), n) for n in lengths]))).alias("gram")) if lengths else parts.select("gram").limit(0)
    common = seen.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    choice = parts.join(common, "gram", "left").groupBy("posted_word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return words.join(choice, words[word] == choice["posted_word"]).drop("posted_word")


def holding(texts: DataFrame, text: str, index: DataFrame, word: str, keep: list[str], found: Column | None = None, most: int = SLICE) -> DataFrame:
    """One row (keep, and the index's columns without its gram) per text and row of a stored index whose word the text holds, and for which ``found`` is true."""
    lengths = [r["n"] for r in index.select(F.length("gram").alias("n")).distinct().collect()]
    if not lengths:
        return texts.limit(0).select(*keep, *[F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name != "gram"])
    parts = F.flatten(F.array(*[grams(F.col(text), n) for n in sorted(lengths)]))
    cut = texts.withColumn("gram", F.explode(parts))
    count = index.count()
    slices = -(-count // most)
    test = F.contains(F.col(text), F.col(word)) & (F.lit(True) if found is None else found)
    out = []
    for i in range(slices):
        own = index if slices == 1 else index.filter(F.pmod(F.xxhash64("gram", word), F.lit(slices)) == i)
        out.append(cut.join(F.broadcast(own), "gram").filter(test).select(*keep, *[c for c in index.columns if c != "gram"]))
    return functools.reduce(DataFrame.unionAll, out)


# --- rules with patterns --------------------------------------------------------------------------------------------


def rule_branches(rules: DataFrame) -> DataFrame:
    """rules(rule_set, tech, category, patterns ARRAY<STRING>) by alternatives: each with the text that it must hold, and a pattern where that text does not say it all."""
    schema = "rule_set string, tech string, category string, literal string, pattern string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for branch in (b for p in row["patterns"] or [] for b in branches(p)):
                    literal, plain = fixed_text(branch)
                    out.append({"rule_set": row["rule_set"], "tech": row["tech"], "category": row["category"], "literal": literal, "pattern": None if plain else FLAGS + branch})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c.split()[0], pa.string()) for c in schema.split(", ")]))

    return rules.select("rule_set", "tech", "category", "patterns").mapInArrow(run, schema)


def fingerprint_index(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored posting index of a rule table, made once and used for any pages."""
    return stored(posted(rule_branches(rules), "literal", pages.select(F.lower("html").alias("low")), "low"))


def fingerprints(pages: DataFrame, index: DataFrame, most: int = SLICE) -> DataFrame:
    """(page_id, domain, rule_set, tech, category), one row per rule of the index with any alternative on the page; pages have a domain."""
    texts = pages.select("page_id", "domain", F.col("html"), F.lower("html").alias("low"))
    hit = F.col("pattern").isNull() | F.rlike(F.col("html"), F.coalesce("pattern", F.lit("")))
    rows = holding(texts, "low", index, "literal", ["page_id", "domain"], hit, most)
    return rows.select("page_id", "domain", "rule_set", "tech", "category").distinct()


# --- names and hosts ------------------------------------------------------------------------------------------------


def either_holds(names: DataFrame, name: str, table: DataFrame, word: str) -> DataFrame:
    """(name, and the table's columns) for every pair of which one holds the other, both in lower case and not empty; names are distinct."""
    names, table = stored(names.select(name).filter(F.length(name) > 0)), stored(table.filter(F.length(word) > 0))
    down = holding(names, name, stored(posted(table, word, names, name)), word, [name])
    by_name = stored(posted(names, name, table, word))
    up = holding(table, word, by_name, name, table.columns).select(name, *table.columns)
    return down.select(name, *table.columns).union(up).distinct()
