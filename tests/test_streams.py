"""Streams in several micro-batches against their batch twins and a plain replay."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitegrain.operators import verdicts
from sitegrain.functions.ordering import Ordered, asof_join
from sitegrain.streaming import relaxation, streams
from workload.streams import run_to_table

START = datetime(2026, 1, 1)


def made(seed=3, n=600):
    rng, rows, now = random.Random(seed), [], START
    for i in range(n):
        now += timedelta(seconds=rng.choice([1, 2, 5, 20, 70]))
        key = 1 if i % 3 else rng.randint(2, 4)  # key 1 holds most rows
        rows.append((key, now, i, rng.choice([True, None] + [False] * 14), rng.random() < 0.05))
    return rows


def replay(rows, rejections, seconds, until=None, idle=None):
    """Level after each event, and the rises by time, by stepping through a key's events in order."""
    out, rises = {}, []
    for key in {r[0] for r in rows}:
        level = run = since = last = None

        def wait(now):
            nonlocal level, run, since
            if idle is not None:
                now = min(now, last + timedelta(seconds=idle))
            while seconds and level < 4 and since + timedelta(seconds=seconds * (level + 1)) <= now:
                since += timedelta(seconds=seconds * (level + 1))
                level, run = level + 1, 0
                rises.append((key, since, level))

        for _, now, event_id, passed, failed in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if until and now >= until:
                continue
            if level is not None:
                wait(now)
            if level is None or (idle is not None and (now - last).total_seconds() > idle):
                level, run, since = 0, 0, now
            last = now
            if failed:
                passed = level >= 2
            if passed:
                run, since = 0, now
            elif passed is False:
                run += 1
                if run >= rejections and level < 4:
                    level, run, since = level + 1, 0, now
            out[event_id] = level
        if until and level is not None:
            wait(until - timedelta(microseconds=1))
    return out, sorted(rises)


VERDICTS = "key bigint, ts timestamp, event_id bigint, passed boolean, failed boolean"


def stream_in_pieces(spark, rows, folder, pieces=4):
    schema = VERDICTS
    size = len(rows) // pieces
    for p in range(pieces):
        part = rows[p * size : (p + 1) * size if p < pieces - 1 else None]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_levels_follow_the_rules(spark, tmp_path):
    rows = made()
    late = [(1, START - timedelta(days=1), 9000, True, False)]
    # out of order within the delay, one key over all files; the last file moves the watermark past all of them
    shuffled = sorted(rows, key=lambda r: (r[2] // 40, r[2] * 7919 % 40)) + [(5, rows[-1][1] + timedelta(days=2), 9001, True, False)]
    until = shuffled[-1][1] - timedelta(days=1)
    stream = stream_in_pieces(spark, shuffled + late, str(tmp_path / "in"))
    got = run_to_table(relaxation.stream_relax_level(stream, 8, 45.0, "1 day")).collect()
    want, rises = replay(rows, 8, 45.0, until)
    assert {r.event_id: r.level for r in got if r.event_id is not None} == want
    assert sorted((r.key, r.ts, r.level) for r in got if r.event_id is None) == rises and rises
    assert set(want.values()) == {0, 1, 2, 3, 4} and all(r.relax_level == min(r.level, 2) and r.metrics_off == (r.level >= 3) for r in got)


def test_state_ends_with_its_key(spark, tmp_path):
    rows = made(seed=11, n=300)
    rows = [r for r in rows if not (60 < r[2] < 120 and r[0] == 2)]
    more = rows + [(5, rows[-1][1] + timedelta(days=2), 9001, True, False)]
    stream = stream_in_pieces(spark, more, str(tmp_path / "in"))
    got = run_to_table(relaxation.stream_relax_level(stream, 4, 90.0, "1 day", idle=240)).collect()
    want, rises = replay(rows, 4, 90.0, more[-1][1] - timedelta(days=1), idle=240)
    assert {r.event_id: r.level for r in got if r.event_id is not None} == want
    assert sorted((r.key, r.ts, r.level) for r in got if r.event_id is None) == rises
    frame = spark.createDataFrame(rows, VERDICTS)
    assert {r.event_id: r.level for r in relaxation.time_levels(frame, 4, 90.0, idle=240).collect()} == want


def test_time_twin_by_rises(spark):
    for seed, rejections, seconds in ((1, 8, 45.0), (2, 3, 200.0), (3, 1, 30.0), (4, 5, None)):
        rows = made(seed=seed, n=400)
        frame = spark.createDataFrame(rows, VERDICTS)
        want, rises = replay(rows, rejections, seconds, rows[-1][1] + timedelta(seconds=100))
        assert {r.event_id: r.level for r in relaxation.time_levels(frame, rejections, seconds).collect()} == want
        found, _ = relaxation.relax_rises(frame, rejections, seconds, F.lit(rows[-1][1] + timedelta(seconds=100, microseconds=-1)))
        assert sorted((r.key, r["at"], r.level) for r in found.collect() if r.event_id is None) == rises


def test_counting_twin(spark):
    for rejections in (4, 8):
        rows = made(seed=rejections)
        frame = spark.createDataFrame(rows, VERDICTS)
        want = {}
        for key in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == key]
            want[key] = replay(own, rejections, None)[0][own[-1][2]]
        assert {r.key: r.level for r in relaxation.relax_levels(frame, rejections).collect()} == want


def test_one_key_fills_all_tasks(spark):
    """A key with all rows is dealt over the ranges, and no stage sorts it, or collects its ranges' rows, in one piece."""
    rows = spark.range(400_000).select(F.lit(1).cast("long").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 11 == 0).alias("passed"), F.lit(False).alias("failed"))
    ordered = Ordered(rows, ["key"], ["ts", "event_id"])
    sizes = [r["count"] for r in ordered.df.groupBy(ordered.part).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1.2 * min(sizes)
    plan = ordered.running(sums={"s": F.lit(1)}).df._jdf.queryExecution().executedPlan().toString()
    assert all(ordered.part in line for line in plan.splitlines() if "Window [sum(own_s" in line)
    assert [tuple(r) for r in relaxation.relax_levels(rows).collect()] == [(1, 4)]
    assert [tuple(r) for r in relaxation.relax_levels(rows, 11).collect()] == [(1, 0)]


def test_asof_join(spark):
    dice = random.Random(9)
    left = [(dice.choice([1, 1, 1, 2, None]), dice.randint(0, 50), i) for i in range(200)]
    right = [(dice.choice([1, 1, 2, 3, None]), t, f"v{t}") for t in range(0, 50, 7)]
    got = asof_join(spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, t long, v string"), ["k"], ["t"]).collect()
    strict = asof_join(spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, t long, v string"), ["k"], ["t"], ties=False).collect()
    for rows, near in ((got, lambda a, b: a <= b), (strict, lambda a, b: a < b)):
        want = {i: max(((u, v) for q, u, v in right if q == k and near(u, t)), default=(0, None))[1] for k, t, i in left}
        assert {r.i: r.v for r in rows} == want and len(rows) == 200


def test_top_table_over_batches(spark, tmp_path):
    write = streams.keep_top(str(tmp_path / "top"), 3)
    for batch_id, rows in enumerate([[("a", 1.0), ("b", 5.0)], [("c", 3.0), ("a", 9.0)], [("d", 2.0), ("b", 4.0)]]):
        write(spark.createDataFrame(rows, "domain string, confidence double"), batch_id)
    write(spark.createDataFrame([("d", 2.0), ("b", 4.0)], "domain string, confidence double"), 2)  # a batch that is run again
    got = [(r.domain, r.confidence) for r in spark.read.parquet(str(tmp_path / "top" / "v=2")).orderBy(F.desc("confidence")).collect()]
    assert got == [("a", 9.0), ("b", 5.0), ("c", 3.0)]


CANDIDATES = "ts timestamp, intent_id bigint, domain string, query_ord int, position int, url string"


def candidate_stream(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, CANDIDATES).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_per_domain_is_first_in_order(spark, tmp_path):
    dice, at = random.Random(12), lambda s: START + timedelta(seconds=s)
    rows = [(at(i * 7 % 3000), i % 3, f"d{dice.randint(0, 11)}", dice.randint(0, 4), dice.randint(1, 20), f"u{i}") for i in range(300)]
    least = {}
    for r in rows:
        least[r[1:3]] = min(least.get(r[1:3], r[3:]), r[3:])
    # a better one in the last file, long after its site was told; one that comes after the watermark; and a row that moves it on
    told = (at(3 * 3600), *rows[0][1:3], -1, 0, "after it was told")
    late = (at(0), 0, "too late", 0, 0, "late")
    end = (at(9 * 3600), 9, "end", 0, 0, "end")
    batches = [rows[:100], rows[100:200], rows[200:], [(at(4 * 3600), 8, "mover", 0, 0, "m")], [told, late], [end]]
    got = run_to_table(streams.stream_first_per_domain(candidate_stream(spark, str(tmp_path / "in"), batches), "1 hour", wait=3600)).collect()
    assert {(r.intent_id, r.domain): (r.query_ord, r.position, r.url) for r in got} == least | {(8, "mover"): (0, 0, "m")}
    assert len(got) == len(least) + 1


def test_state_of_told_sites_is_dropped(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    batches = [[(at(0), 1, "a", 1, 1, "first")], [(at(10), 2, "b", 0, 0, "b")], [(at(60), 2, "c", 0, 0, "c")], [(at(61), 1, "a", 0, 0, "again")], [(at(90), 3, "z", 0, 0, "z")]]
    got = run_to_table(streams.stream_first_per_domain(candidate_stream(spark, str(tmp_path / "in"), batches), "1 hour")).collect()
    # a day after it was told a site is forgotten, so it can come anew
    assert sorted(r.url for r in got) == ["again", "b", "c", "first"]


def test_failed_verdicts_pass_from_level_two_on(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, f"d{i}", None if i in (5, 20) else "no", "timeout" if i in (5, 20) else None, at(i), i) for i in range(25)]
    rows += [(2, "x", None, "timeout", at(1), 100), (2, "y", "sí", None, at(2), 101)]
    told = spark.createDataFrame(rows, "intent_id long, domain string, raw string, error string, ts timestamp, event_id long")
    sites = told.select("intent_id", "domain").union(spark.createDataFrame([(1, "unjudged")], "intent_id long, domain string"))
    got = {r.domain: r.passed for r in verdicts.apply_timed_verdicts(sites, told, verdicts.verdict_levels(told, seconds=None)).collect()}
    assert {d for d, p in got.items() if p} == {"d20", "y"} and len(got) == 28
