"""A page table laid out by page id, so that joins which pick pages by id never move html.

``lay_out`` pays for one shuffle of the pages when they are written; after that every join on ``page_id`` (candidate scores,
home pages of the audit, contact pages) finds the page side in place, and only the ids of the other side travel. That holds
whatever the size of the picking table; a broadcast only helps while that table is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def buckets_for(spark: SparkSession, buckets: int | None = None) -> int:
    """Buckets of a layout: the asked number, at least the session's shuffle partitions.

    With fewer Spark would take the join for too coarse and shuffle both sides. Aim at some 128 MB of Parquet a bucket.
    """
    return max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lay_out(pages: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """Writes pages as the table ``name`` at ``path`` (a folder that all machines share), bucketed and sorted by page_id.

    Pages are dealt by the hash that buckets use before they are written, so each bucket is one file. Rows with a null
    page_id are kept, in the bucket of null. An existing table is an error, never overwritten.
    """
    n = buckets_for(pages.sparkSession, buckets)
    dealt = pages.repartition(n, "page_id").write.format("parquet").bucketBy(n, "page_id").sortBy("page_id")
    dealt.option("path", path).mode("errorifexists").saveAsTable(name)
    return pages.sparkSession.table(name)


def attach(spark: SparkSession, name: str, path: str, schema: str, buckets: int) -> DataFrame:
    """A layout written before, made known to a session whose catalog does not hold it. ``buckets`` as written."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        f"CLUSTERED BY (page_id) SORTED BY (page_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
