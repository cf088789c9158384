"""What the operators share: their view of a document table, reliable intermediate tables, checked broadcasts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.ordering import numbered
from sitegrain.session import checkpointed

#: White space of the token pattern (the Unicode property), which Python's own \\s exceeds by four control characters.
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces of a text that a byte-level BPE never merges across: a run of visible characters with the blank before it,
#: or white space as the token pattern takes it.
CHUNK = re.compile(f" ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+")

#: Files of a bundled frame: for each core, and at least.
FILES_A_CORE, LEAST_FILES = 2, 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only, so that other columns can't clash; a null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def held(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back: computed once, and safe when an executor is lost."""
    return checkpointed(df)


def bundled(df: DataFrame) -> DataFrame:
    """A frame of short rows (ids, pairs, counts) in a few partitions for each core, to be held as so many files.

    A checkpoint writes a file for each partition, however few rows there are, and on a local disk Hadoop starts processes
    (chmod) for each file, which share or copy the executor's memory as they start.
    """
    return df.coalesce(max(LEAST_FILES, FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism))


def small(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint where the rows, counted first, are at most so many; else the frame as it is, to be shuffled.

    Only for frames that are held, so that counting costs a read and no second run.
    """
    return F.broadcast(df) if df.count() <= most else df


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_own_ids(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage that tells documents apart by doc_id keeps of any documents, with all their columns.

    Rows whose doc_id is null or repeats are numbered beyond the largest id while the stage runs, so each is judged for
    itself; other tables know them under no id. Without such rows, which costs a count of ids to know, nothing is changed.
    """
    ids = docs.groupBy(F.col("doc_id").alias("odd")).agg(F.count("*").alias("n"))
    odd = held(bundled(ids.filter("odd IS NULL OR n > 1").select("odd")))
    if not odd.limit(1).count():
        return stage(docs)
    own, place = f"own_{uuid.uuid4().hex}", f"place_{uuid.uuid4().hex}"
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    same, told = docs["doc_id"].eqNullSafe(odd["odd"]), F.col("doc_id").alias(own)
    few = numbered(docs.join(odd, same, "left_semi"), place, F.col("doc_id"), F.xxhash64("text"))
    rest = [c for c in docs.columns if c != "doc_id"]
    rows = docs.join(odd, same, "left_anti").select(F.col("doc_id").cast("long").alias("doc_id"), *rest, told)
    rows = held(rows.unionByName(few.select((F.lit(top) + F.col(place)).cast("long").alias("doc_id"), *rest, told)))
    return stage(rows).withColumn("doc_id", F.col(own)).select(*docs.columns)
