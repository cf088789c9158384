"""Structured Streaming twins: first candidate per site, scores as pages arrive, the best so far, progress counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sitegrain.operators import funnel, score

class FirstInOrder(StatefulProcessor):
    """Keeps the least candidate, in order, of a key until the watermark has passed the wait after its first one; emits it
    once, remembers the key for a while, so that later ones are not taken for new, and then drops it."""

    def __init__(self, schema: StructType, order: tuple[str, ...], wait: int, memory: int) -> None:
        self.schema, self.order, self.wait, self.memory = schema, order, wait, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)
        self.until = handle.getValueState("until", "at long, told boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        mark = timerValues.getCurrentWatermarkInMs()
        until, told = self.until.get() if self.until.exists() else (None, False)
        if told and until < mark:
            # its time is over, though the timer comes only after this batch's rows
            self.handle.deleteTimer(until)
            self.until.clear()
            until, told = None, False
        best = Row(**dict(zip(self.schema.names, self.best.get()))) if self.best.exists() else None
        for row in rows:
            at = int(row["ts"].timestamp() * 1000)
            if told or at < mark:
                continue
            if until is None:
                until = at + self.wait
                self.handle.registerTimer(until)
                self.until.update((until, False))
            if at <= until and (best is None or self._place(row) < self._place(best)):
                best = row
        if best is not None:
            self.best.update(tuple(best[c] for c in self.schema.names))
        return iter([])

    def _place(self, row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        at, told = self.until.get()
        if told:
            self.until.clear()
            return
        row = Row(**dict(zip(self.schema.names, self.best.get())))
        self.best.clear()
        self.until.update((at + self.memory, True))
        self.handle.registerTimer(at + self.memory)
        yield row

    def close(self) -> None:
        pass


def stream_first_per_domain(stream: DataFrame, delay: str = "1 hour", wait: float = 3600, memory: float = 86_400) -> DataFrame:
    """The first candidate, in query order and position, of each (intent, site), whenever it came: a stream (ts, intent_id,
    domain, query_ord, position, url, ...).

    A site's candidates are compared for ``wait`` seconds of event time after the first one to come; the least is emitted
    once, when the watermark has passed that. Those after the wait, and for ``memory`` more seconds, are ignored, and so
    are late ones, which the watermark has passed.
    """
    schema = stream.schema
    return stream.withWatermark("ts", delay).groupBy("intent_id", "domain").transformWithState(
        statefulProcessor=FirstInOrder(schema, funnel.ARRIVAL, int(wait * 1000), int(memory * 1000)), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def stream_scores(pages: DataFrame) -> DataFrame:
    """Liveness and type points of pages as they arrive: stateless, one row per page."""
    kinds = list(score.rules.TYPE_WORDS)
    low = F.lower("html")
    rows = pages.select("page_id", "url", funnel.alive_reason(F.col("html"), low).alias("reason"), low.alias("low"))
    return rows.select(
        "page_id", "url", "reason", *[score.type_points(F.col("low"), k).alias(k) for k in kinds], score.info_penalty(F.col("low")).alias("info_penalty")
    )


def keep_top(folder: str, n: int, scored: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps the n best rows in versioned folders, each batch scored on the way.

    Version v holds the state after batch v, so a batch that is run again starts from the same earlier version and
    yields the same rows. Without ``scored``, batches hold confidence themselves. Of a site (and intent) that comes
    again, the best row counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = scored(batch) if scored else batch
        keys = [c for c in ("intent_id", "domain") if c in rows.columns]
        rows = rows.select(*keys, "confidence")
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/v={batch_id - 1}"))
        best = rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
        funnel.top_sites(best, n).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    return write


def top_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a table that ``keep_top`` writes."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    newest = rows.agg(F.max("v")).first()[0]
    return rows.filter(F.col("v") == newest).drop("v")


def stream_progress(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by phase per tumbling event-time window; rows later than the watermark are dropped."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", window).alias("w"), "phase").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), "phase", "events")
