"""Relaxation levels over verdicts, by event time: the stream operator and its batch twin.

The level of a key starts at 0 and rises by one, up to 4, after 8 rejections in a row, or once so many spans of 45
seconds as the next level has have gone by without a pass. A pass ends the run and starts the clock again, and so does a
rise; nothing lowers a level. A verdict that failed (an error of the judge) counts as a rejection below level 2 and as a
pass from there on. Verdicts count in the order of (ts, event_id), whatever order they arrive in. A deadline comes
before a verdict of the same instant. With ``idle``, a key without verdicts for so long ends, and starts anew at level 0.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitegrain.functions.ordering import Ordered, asof_join
from sitegrain.session import checkpointed

REJECTIONS_PER_LEVEL = 8
SECONDS_PER_LEVEL = 45.0
MAX_LEVEL = 4
RELAX_MAX = 2
METRICS_OFF_FROM = 3
_FIRST = -(2**63)

LEVELS = "key bigint, ts timestamp, event_id bigint, level int, relax_level int, metrics_off boolean"


class RelaxationLevel(StatefulProcessor):
    """Buffers a key's verdicts until the watermark passes them, then settles them in order; deadlines are event-time timers.

    One timer stands for the next thing that can happen to a key: its earliest buffered verdict, its next deadline, or
    its end. State is dropped at that end (with ``idle``).
    """

    def __init__(self, rejections: int, seconds: float | None, idle: float | None) -> None:
        self.rejections = rejections
        self.span = None if seconds is None else int(seconds * 1_000_000)
        self.idle = None if idle is None else int(idle * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("relax", "level int, run int, since long, last long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, passed boolean, failed boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        """The key's only timer, at these microseconds (or none)."""
        now = self.timer.get()[0] if self.timer.exists() else None
        new = None if at is None else at // 1000
        if new != now:
            if now is not None:
                self.handle.deleteTimer(now)
                self.timer.clear()
            if new is not None:
                self.handle.registerTimer(new)
                self.timer.update((new,))

    def _next(self, state: tuple | None, waiting: list) -> int | None:
        times = [min(waiting)[0]] if waiting else []
        if state:
            level, _, since, last = state
            if self.span and level < MAX_LEVEL:
                deadline = since + self.span * (level + 1)
                if self.idle is None or deadline <= last + self.idle:
                    times.append(deadline)
            if self.idle is not None:
                times.append(last + self.idle + 1)
        return min(times, default=None)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        new = []
        for chunk in rows:
            flags = [[None if pd.isna(v) else bool(v) for v in chunk[c]] for c in ("passed", "failed")]
            new += [r for r in zip((t.value // 1000 for t in chunk["ts"]), map(int, chunk["event_id"]), *flags) if r[0] // 1000 >= mark]
        if new:
            self.waiting.appendList(new)
            first = min(new)[0]
            now = self.timer.get()[0] if self.timer.exists() else None
            if now is None or first // 1000 < now:
                self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs() * 1000
        state = tuple(self.state.get()) if self.state.exists() else None
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] // 1000 * 1000 < mark]
        later = waiting[len(due) :]
        out = []
        for row in [*due, None]:
            until = mark - 1 if row is None else row[0]
            end = state and self.idle is not None and state[3] + self.idle
            if state and self.span:
                level, run, since, last = state
                while level < MAX_LEVEL and (at := since + self.span * (level + 1)) <= (until if not end else min(until, end)):
                    level, run, since = level + 1, 0, at
                    out.append((at, None, level))
                state = level, run, since, last
            if end and until > end:
                state = None
            if row is None:
                break
            ts, event_id, passed, failed = row
            level, run, since, _ = state or (0, 0, ts, ts)
            if failed:
                passed = level >= RELAX_MAX
            if passed is True:
                run, since = 0, ts
            elif passed is False:
                run += 1
                if run >= self.rejections and level < MAX_LEVEL:
                    level, run, since = level + 1, 0, ts
            state = level, run, since, ts
            out.append((ts, event_id, level))
        if due or (waiting and not later):
            self.waiting.clear() if not later else self.waiting.put(later)
        if state:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        self.timer.clear()
        self._wake(self._next(state, later))
        if out:
            ts, ids, levels = zip(*out)
            frame = pd.DataFrame({"key": [key[0]] * len(out), "ts": pd.to_datetime(pd.Series(ts, dtype="int64"), unit="us"), "event_id": pd.array(ids, dtype="Int64"), "level": levels})
            frame["relax_level"] = frame["level"].clip(upper=RELAX_MAX)
            frame["metrics_off"] = frame["level"] >= METRICS_OFF_FROM
            yield frame

    def close(self) -> None:
        pass


def _told(verdicts: DataFrame) -> DataFrame:
    failed = F.coalesce("failed", F.lit(False)) if "failed" in verdicts.columns else F.lit(False)
    return verdicts.select("key", "ts", "event_id", "passed", failed.alias("failed"))


def stream_relax_level(
    verdicts: DataFrame, rejections: int = REJECTIONS_PER_LEVEL, seconds: float | None = SECONDS_PER_LEVEL, delay: str = "10 minutes", idle: float | None = None
) -> DataFrame:
    """Level after each verdict of a stream (key, ts, event_id, passed [, failed]), and each rise by time (event_id null).

    Verdicts settle once the watermark passes them; those that come later than that are dropped. passed may be null
    (neither a pass nor a rejection).
    """
    return _told(verdicts).withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        statefulProcessor=RelaxationLevel(rejections, seconds, idle), outputStructType=LEVELS, outputMode="Append", timeMode="EventTime"
    )


# --- batch ---------------------------------------------------------------------------------------------------------


def _later(at: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + micros)


def relax_rises(
    verdicts: DataFrame, rejections: int = REJECTIONS_PER_LEVEL, seconds: float | None = None, until: Column | None = None, idle: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """What raises levels, as a batch: (key, session, level, at, event_id) with event_id null for a rise by time; and the
    sessions (key, session, begin), one per key without ``idle``. Rises by time are told up to ``until`` (None: the last verdict).

    A level never falls, so a key has four rises at most, and each is the least of what could come next: four combined
    minima over the verdicts, which know their count of rejections and their last pass from a scan of ranges.
    """
    failed = F.col("failed")
    rows = Ordered(_told(verdicts), ["key"], ["ts", "event_id"]).running(lasts={"prior": F.col("ts")}, before=True)
    starts = F.col("prior").isNull()
    if idle is not None:
        starts = starts | (F.unix_micros("ts") - F.unix_micros("prior") > int(idle * 1_000_000))
    rows = rows.with_columns({"starts": starts}).running(sums={"session": F.col("starts").cast("long")})
    # failed verdicts are rejections (kind 0) below level 2, passes (kind 1) from there on
    good = [F.coalesce("passed", F.lit(False)) & ~failed, F.coalesce("passed", F.lit(False)) | failed]
    bad = [F.coalesce(~F.col("passed"), F.lit(False)) | failed, F.coalesce(~F.col("passed"), F.lit(False)) & ~failed]
    rows = rows.running(sums={f"r{i}": bad[i].cast("long") for i in (0, 1)})
    passes = {f"pass{i}": F.when(good[i], F.struct("session", F.col("ts").alias("at"), f"r{i}")) for i in (0, 1)}
    scan = rows.running(lasts=passes, before=True).with_columns({f"bad{i}": bad[i] for i in (0, 1)} | {f"good{i}": good[i] for i in (0, 1)})
    scan = checkpointed(scan.rows().drop("prior", "passed", "failed"))

    own = ["key", "session"]
    horizon = F.max("ts") if until is None else until
    if idle is not None:
        horizon = F.least(horizon, _later(F.max("ts"), F.lit(int(idle * 1_000_000))))
    ends = scan.groupBy(*own).agg(
        F.min("ts").alias("begin"), horizon.alias("horizon"),
        *[F.min(F.col(f"r{i}") - F.col(f"bad{i}").cast("long")).alias(f"first{i}") for i in (0, 1)],
        *[F.max(f"r{i}").alias(f"end{i}") for i in (0, 1)], *[F.max(F.when(F.col(f"good{i}"), F.col("ts"))).alias(f"last{i}") for i in (0, 1)],
    )
    ends = checkpointed(ends)
    # where each session stands: the time and place of its last rise (its begin at first), and the rejections until then
    at = ends.select(*own, F.col("begin").alias("up"), F.lit(_FIRST).alias("up_event"), F.col("first0").alias("up0"), F.col("first1").alias("up1"))
    rises = []
    for level in range(MAX_LEVEL):
        i = int(level >= RELAX_MAX)
        known = F.col(f"pass{i}.session") == F.col("session")
        anchor = F.greatest("up", F.when(known, F.col(f"pass{i}.at")))
        run = F.col(f"r{i}") - F.greatest(f"up{i}", F.when(known, F.col(f"pass{i}.r{i}")))
        after = (F.col("ts") > F.col("up")) | ((F.col("ts") == F.col("up")) & (F.col("event_id") > F.col("up_event")))
        by_count = F.when(F.col(f"bad{i}") & (run >= rejections), F.struct(F.col("ts").alias("at"), "event_id", F.col("r0").alias("u0"), F.col("r1").alias("u1")))
        choices = [by_count]
        if seconds is not None:
            deadline = _later(anchor, F.lit(int(seconds * 1_000_000) * (level + 1)))
            before = [(F.col(f"r{k}") - F.col(f"bad{k}").cast("long")).alias(f"u{k}") for k in (0, 1)]
            choices.append(F.when(deadline <= F.col("ts"), F.struct(deadline.alias("at"), F.lit(_FIRST).alias("event_id"), *before)))
        found = scan.join(at, own).filter(after).groupBy(*own).agg(F.min(F.least(*choices) if len(choices) > 1 else by_count).alias("rise"))
        if seconds is not None:
            # the time after the last pass, which no verdict ends
            standing = at.join(ends, own).withColumn("deadline", _later(F.greatest("up", f"last{i}"), F.lit(int(seconds * 1_000_000) * (level + 1))))
            open_ = standing.filter(F.col("deadline") <= F.col("horizon")).select(
                *own, F.struct(F.col("deadline").alias("at"), F.lit(_FIRST).alias("event_id"), F.col("end0").alias("u0"), F.col("end1").alias("u1")).alias("rise")
            )
            found = found.unionByName(open_).groupBy(*own).agg(F.min("rise").alias("rise"))
        at = checkpointed(found.filter("rise IS NOT NULL").select(*own, F.col("rise.at").alias("up"), F.col("rise.event_id").alias("up_event"), F.col("rise.u0").alias("up0"), F.col("rise.u1").alias("up1")))
        rises.append(at.select(*own, F.lit(level + 1).alias("level"), F.col("up").alias("at"), F.nullif("up_event", F.lit(_FIRST)).alias("event_id")))
    every = rises[0]
    for more in rises[1:]:
        every = every.unionByName(more)
    return every, ends.select(*own, "begin")


def level_changes(rises: DataFrame, sessions: DataFrame) -> DataFrame:
    """(key, ts, event_id, level): every change, begins of sessions at level 0 with them; event_id is the least long where time alone did it."""
    begins = sessions.select("key", F.col("begin").alias("ts"), F.lit(_FIRST).alias("event_id"), F.lit(0).alias("level"))
    return begins.unionByName(rises.select("key", F.col("at").alias("ts"), F.coalesce("event_id", F.lit(_FIRST)).alias("event_id"), "level"))


def time_levels(verdicts: DataFrame, rejections: int = REJECTIONS_PER_LEVEL, seconds: float | None = SECONDS_PER_LEVEL, idle: float | None = None) -> DataFrame:
    """The level after each verdict: what ``stream_relax_level`` tells once all has settled, without the rises in between."""
    changes = level_changes(*relax_rises(verdicts, rejections, seconds, idle=idle))
    rows = verdicts.select("key", "ts", "event_id")
    # at one place (a begin and a rise by time can share it) the higher level counts
    changes = changes.groupBy("key", "ts", "event_id").agg(F.max("level").alias("level"))
    return asof_join(rows, changes, ["key"], ["ts", "event_id"])


def relax_levels(verdicts: DataFrame, rejections: int = REJECTIONS_PER_LEVEL) -> DataFrame:
    """Final level per key by the counting rule: (key, level)."""
    told = verdicts if "failed" in verdicts.columns else verdicts.filter("passed IS NOT NULL")
    rises, sessions = relax_rises(told, rejections)
    top = rises.groupBy("key").agg(F.max("level").alias("level"))
    return sessions.select("key").distinct().join(top, "key", "left").select("key", F.coalesce("level", F.lit(0)).cast("int").alias("level"))
