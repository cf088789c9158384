"""Where redirects end: chains of any length over a table of hops, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.urls import url_key
from sitegrain.session import checkpointed


def redirect_ends(pages: DataFrame) -> DataFrame:
    """One row per stored URL: (url_key, final_url, http_status, redirects, cyclic).

    pages hold url, status and final_url (where an answer led; null, empty or the page itself if nowhere) and may hold
    page_id: of a URL that is stored more than once the least id counts. URLs are compared by ``url_key``. A chain ends
    at a URL that leads nowhere or is not stored; http_status is that of its end, or null if that is not stored. What
    leads into a circle is cyclic, ends at the least URL of the circle, and has neither count nor status.

    Each round doubles the way that every open pointer has gone, so a chain of n hops takes log2(n) joins, against one row
    per URL. A pointer that has reached its end moves no further.
    """
    order = F.struct(*[c for c in ("page_id", "url") if c in pages.columns])
    hops = pages.select(url_key(F.col("url")).alias("url_key"), order.alias("o"), "url", "status", F.nullif(F.trim("final_url"), F.lit("")).alias("final_url"))
    hops = hops.filter("url_key IS NOT NULL").groupBy("url_key").agg(F.min_by(F.struct("url", "status", "final_url"), "o").alias("h")).select("url_key", "h.*")
    hops = checkpointed(hops.withColumn("at", url_key(F.col("final_url"))).withColumn("at", F.when(F.col("at") != F.col("url_key"), F.col("at"))))
    pointer = ["url_key", "at", "final_url", "steps", "low"]
    low = F.struct(F.col("at").alias("key"), F.col("final_url").alias("url"))
    walked = checkpointed(hops.filter("at IS NOT NULL").select("url_key", "at", "final_url", F.lit(1).cast("long").alias("steps"), low.alias("low")))
    ends, left, turns = walked.limit(0), None, 0
    while True:
        known = ends.withColumn("ended", F.lit(True)).unionByName(walked.withColumn("ended", F.lit(False)))
        ahead = known.select(F.col("url_key").alias("at"), F.col("at").alias("next"), F.col("final_url").alias("next_url"), F.col("steps").alias("more"), F.col("low").alias("next_low"), "ended")
        moved = walked.join(ahead, "at", "left").select(
            "url_key", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNull(), F.col("final_url")).otherwise(F.col("next_url")).alias("final_url"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", "next_low").alias("low"), F.coalesce("ended", F.lit(True)).alias("ended"),
        )
        moved = checkpointed(moved)
        ends = ends.unionByName(moved.filter("ended").select(*pointer))
        walked = moved.filter("NOT ended").select(*pointer)
        before, left, turns = left, walked.count(), turns + 1
        # what is left are circles once a round settles nothing; the least of a circle is known when the way covers all of it
        if not left or (left == before and 2**turns > left):
            break
    circles = walked.join(walked.select(F.col("url_key").alias("at"), F.col("low").alias("round")), "at").select("url_key", F.col("round.url").alias("final_url"))
    still = hops.filter("at IS NULL").select("url_key", F.col("url").alias("final_url"), F.col("status").alias("http_status"), F.lit(0).cast("long").alias("redirects"))
    status = hops.select(F.col("url_key").alias("at"), F.col("status").alias("http_status"))
    led = ends.join(status, "at", "left").select("url_key", "final_url", "http_status", F.col("steps").alias("redirects"))
    cyclic = circles.select("url_key", "final_url", F.lit(None).cast(hops.schema["status"].dataType).alias("http_status"), F.lit(None).cast("long").alias("redirects"), F.lit(True).alias("cyclic"))
    return still.unionByName(led).withColumn("cyclic", F.lit(False)).unionByName(cyclic)
