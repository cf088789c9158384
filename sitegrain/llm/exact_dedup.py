"""Exact duplicates: combined within each task, then within salted digest groups, then over the salt winners.

Every stage groups by digest *and* whole normalised text, so rows are only ever combined when their full contents are
equal; a digest that two texts share splits into two groups. A text with any number of copies costs each task one row
per salt, since Spark combines before it shuffles, and its members meet their winner again salt by salt.

Defined cases: a null text counts as empty, and all empty texts are equal. Of equal texts the smallest doc_id stays.
A null doc_id only stays (as keep_id null) where its text has no other row, and `kept` is then true. Rows that repeat
a doc_id and text all carry the same answer; `deduplicated` leaves one of them. An empty table gives an empty result.
Columns of the input other than doc_id and text play no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import texts

#: White space runs that count as one blank.
SPACE_RUN = "[ \\t-\\r]+"


def digests(docs: DataFrame, salts: int = 32, digest_bits: int = 256) -> DataFrame:
    """doc_id, normalised text, its SHA-256, the leading digest bits that rows are grouped by, and a salt.

    digest_bits under 256 makes digests collide, for tests of the full comparison.
    """
    norm = F.regexp_replace("text", SPACE_RUN, " ")
    return (
        texts(docs)
        .select("doc_id", norm.alias("norm"))
        .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        .withColumn("digest", F.col("text_sha256").substr(1, digest_bits // 4))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    )


def groups(docs: DataFrame, salts: int = 32, digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. At most 63 salts."""
    rows = digests(docs, salts, digest_bits)
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(
        F.min("first").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")
    )
    present = F.expr(f"filter(sequence(0, {salts - 1}), s -> (mask & shiftleft(1L, s)) != 0)")
    back = winners.select("digest", "norm", "keep_id", "group_size", F.explode(present).alias("salt"))
    key = ["digest", "salt", "norm"]
    if digest_bits == 256:
        # members meet their winner by digest and salt alone; that two texts share a whole SHA-256 is an error, not a guess
        key = ["digest", "salt"]
        back = back.groupBy(key).agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count("*").alias("texts"))
        size = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
        back = back.select(*key, "keep_id", size.alias("group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return rows.select("doc_id", "text_sha256", *key).join(back, key).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, salts: int = 32) -> DataFrame:
    """The documents that stay, with all their columns; a row that repeats another's doc_id and text goes too."""
    row = f"row_{uuid.uuid4().hex}"
    key = lambda doc_id, digest: F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), digest)
    stay = groups(docs, salts).filter("kept").select(key("doc_id", F.col("text_sha256")).alias(row)).distinct()
    norm = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE_RUN, " ")
    return docs.withColumn(row, key("doc_id", F.sha2(norm.cast("binary"), 256))).join(stay, row, "left_semi").dropDuplicates([row]).drop(row)
