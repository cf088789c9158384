"""Page snapshots: the table every other operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.markup import skeleton
from sitegrain.functions.urls import host_of


def spread(df: DataFrame) -> DataFrame:
    """Spreads an input that would keep most cores idle over all of them; any other input is left as it is, unshuffled.

    Reading HTML costs far more CPU than I/O, and a small file is a single split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages. A snapshot that was not a 200 HTML answer carries no html, as if it had not been fetched."""
    pages = spread(spark.read.parquet(f"{folder}/pages.parquet"))
    if "status" in pages.columns:
        pages = pages.withColumn("html", F.when(F.col("status") == 200, F.col("html")))
    if "content_type" in pages.columns:
        is_html = F.col("content_type").isNull() | F.contains(F.lower("content_type"), F.lit("html"))
        pages = pages.withColumn("html", F.when(is_html, F.col("html")))
    return pages


def with_domain(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", host_of(F.col("url")))


def pages_per_domain(pages: DataFrame) -> DataFrame:
    return with_domain(pages.select("page_id", "url")).groupBy("domain").agg(
        F.count("*").alias("pages"), F.min("page_id").alias("first_page_id")
    )


def with_skeleton(pages: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``markup`` (the page without scripts' and styles' content and comments)."""
    return with_domain(pages).withColumn("markup", skeleton(F.col("html")))
