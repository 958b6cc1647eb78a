"""Keyed, time-dependent rules: in batch, and as Structured Streaming.

The folds are plain functions over one key's events in order. In batch they run over partitions sorted by key and time, one
event at a time, so a key of any size needs constant memory; as streams they keep their state per key and drop it by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# last writer wins


def last_writer(events: DataFrame, key: list[str], *, updated: str, deleted: str, tie: str) -> DataFrame:
    """Latest row of each key; a deletion wins against an update of the same time, then the larger tie. Deleted keys go."""
    best = F.max(F.struct(F.col(updated), F.col(deleted).cast("int").alias("_d"), F.col(tie).alias("_t"), F.struct(*events.columns).alias("row")))
    latest = events.groupBy(*key).agg(best.alias("b")).select("b.row.*")
    return latest.where(~F.col(deleted))


def first_added(events: DataFrame, key: list[str], *, updated: str, deleted: str, added: str, tie: str) -> DataFrame:
    """(key, added): when the row that is there was added. An update keeps the earlier time unless the row was deleted."""
    order = Window.partitionBy(*key).orderBy(updated, F.col(deleted).cast("int"), tie)
    lives = events.withColumn("_life", F.coalesce(F.sum(F.col(deleted).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lives.where(~F.col(deleted)).groupBy(*key).agg(F.max_by(added, F.struct("_life", (-F.unix_micros(F.col(updated).cast("timestamp"))).alias("_u"))).alias(added))


BUCKETS = 64


def merge_into(path: str, key: list[str], *, updated: str, deleted: str, tie: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch target: the table of latest rows, deletions among them, below path. Read it with merged().

    The table lies in buckets of the key's hash. A batch writes new versions of the buckets that it touches and leaves the others
    alone; a version is read once its marker is there. Late events are just older and lose. A repeated batch starts from the
    versions before it and writes the same ones again. Versions that a newer one replaces are deleted a batch later.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # `buckets` numbers at most
        if not touched:
            return
        newest = {b: v for b, v in _versions(spark, path, batch_id).items() if b in touched}
        old = [f"{path}/version={v}/_bucket={b}" for b, v in newest.items()]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        best = F.max(F.struct(F.col(updated), F.col(deleted).cast("int").alias("_d"), F.col(tie).alias("_t"), F.struct(*batch.columns).alias("row")))
        latest = rows.groupBy("_bucket", *key).agg(best.alias("b")).select("_bucket", "b.row.*")
        latest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/version={batch_id}")
        # nobody needs what the last batch but one left of these buckets
        for b, v in _versions(spark, path, batch_id - 1).items():
            if b in newest and newest[b] != v:
                _delete(spark, f"{path}/version={v}/_bucket={b}")

    return merge


def _files(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _versions(spark, path: str, before: int | None = None) -> dict[int, int]:
    """Newest finished version of each bucket, of those below `before`."""
    fs, at = _files(spark, path)
    out: dict[int, int] = {}
    if not fs.exists(at):
        return out
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        if not name.startswith("version=") or not fs.exists(_files(spark, f"{path}/{name}/_SUCCESS")[1]):
            continue
        version = int(name.split("=")[1])
        if before is not None and version >= before:
            continue
        for b in fs.listStatus(folder.getPath()):
            part = b.getPath().getName()
            if part.startswith("_bucket="):
                bucket = int(part.split("=")[1])
                out[bucket] = max(out.get(bucket, -1), version)
    return out


def merged(spark, path: str) -> DataFrame:
    """The rows of a table that merge_into() keeps."""
    return spark.read.parquet(*[f"{path}/version={v}/_bucket={b}" for b, v in _versions(spark, path).items()])


# idempotence, rewards, limits


def idempotent(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """First event of each request key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def idempotent_stream(events: DataFrame, key: list[str], *, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def daily_cap(events: DataFrame, *, user: str, kind: str, ref: str, day: Column, order: str, limit: int) -> DataFrame:
    """Rewards: once for (user, kind, ref) ever, and `limit` for (user, kind, day)."""
    once = idempotent(events, [user, kind, ref], order)
    rank = F.row_number().over(Window.partitionBy(user, kind, "_day").orderBy(order))
    return once.withColumn("_day", day).withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n").withColumnRenamed("_day", "day")


def _by_key(events: DataFrame, key: str, order: list[str], fold: Callable[[], Callable[[tuple], object]], columns: list[str], name: str, kind: str) -> DataFrame:
    """Adds what fold()(values of columns) returns for each event, in order, afresh for each key."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(batch[key], *(batch[c] for c in columns), strict=True):
                if step is None or k != last:
                    last, step = k, fold()
                out.append(step(tuple(values)))
            batch[name] = out
            yield batch

    schema = StructType([*events.schema.fields, StructField(name, _parse_datatype_string(kind))])
    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def limiter(limit: int, window_seconds: float, state: tuple = (None, 0)):
    """Fixed windows that start at a key's first event after the last window ended; events beyond the limit are refused."""
    start, n = state

    def step(values: tuple) -> bool:
        nonlocal start, n
        at = values[0]
        at = at.timestamp() if hasattr(at, "timestamp") else float(at)
        if start is None or at - start >= window_seconds:
            start, n = at, 0
        n += 1
        return n <= limit

    step.state = lambda: (start, n)
    return step


def rate_limit(events: DataFrame, *, key: str, ts: str, order: str, limit: int, window_seconds: float) -> DataFrame:
    """Adds allowed. ts is a timestamp or seconds."""
    return _by_key(events, key, [ts, order], lambda: limiter(limit, window_seconds), [ts], "allowed", "boolean")


def rate_limit_into(path: str, *, key: str, ts: str, limit: int, window_seconds: float) -> Callable[[DataFrame, int], None]:
    """foreachBatch target: the same over a stream. Each key's window is kept in numbered versions below path/state, the
    answers (key, ts, allowed) go to path/answers; a repeated batch writes the same versions again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.select(key, ts)
        before = spark.read.parquet(f"{path}/state/version={batch_id - 1}") if batch_id else None
        if before is None:
            rows = rows.withColumn("start", F.lit(None).cast("double")).withColumn("n", F.lit(0).cast("long"))
        else:
            rows = rows.join(before, key, "left")

        def fold():
            inner = None

            def step(values: tuple) -> dict:
                nonlocal inner
                at, start, n = values
                if inner is None:
                    inner = limiter(limit, window_seconds, (None, 0) if pd.isna(start) else (float(start), int(n)))
                allowed = inner((at,))
                return {"allowed": allowed, "start": inner.state()[0], "n": inner.state()[1]}

            return step

        out = _by_key(rows, key, [ts], fold, [ts, "start", "n"], "_r", "struct<allowed:boolean,start:double,n:bigint>").select(key, ts, "_r")
        out.select(key, ts, "_r.allowed").write.mode("overwrite").parquet(f"{path}/answers/version={batch_id}")
        last = out.groupBy(key).agg(F.max(F.struct("_r.start", "_r.n")).alias("s")).select(key, "s.start", "s.n")
        if before is not None:
            last = last.unionByName(before.join(last.select(key), key, "left_anti"))
        last.write.mode("overwrite").parquet(f"{path}/state/version={batch_id}")
        _delete(spark, f"{path}/state/version={batch_id - 2}")  # a repeated batch starts from the version before it

    return run


def breaker(failures: int, cooldown_seconds: float, deadline_seconds: float | None = None):
    """Circuit breaker: after consecutive failures calls are not made until the cooldown is over. A call that takes longer than
    the deadline has failed; failed may then be the seconds that it took, negative for a failure."""
    row, until = 0, None

    def step(values: tuple) -> str:
        nonlocal row, until
        at, failed = values
        at = at.timestamp() if hasattr(at, "timestamp") else float(at)
        if until is not None and at < until:
            return "open"
        if deadline_seconds is not None:
            failed = failed < 0 or failed > deadline_seconds
        row = row + 1 if failed else 0
        until = at + cooldown_seconds if row >= failures else None
        row = 0 if until is not None else row
        return "failed" if failed else "ok"

    return step


def circuit_breaker(events: DataFrame, *, key: str, ts: str, order: str, failed: str, failures: int, cooldown_seconds: float, deadline_seconds: float | None = None) -> DataFrame:
    return _by_key(events, key, [ts, order], lambda: breaker(failures, cooldown_seconds, deadline_seconds), [ts, failed], "call", "string")


def planner(per_day: int, gap_seconds: float, stale_seconds: float, quiet: tuple[int, int] = (22, 9), keep_seconds: float = 259_200):
    """Push planner: a key once, nothing stale or in quiet hours, so many a day and apart by a gap. What was sent is forgotten
    after keep_seconds, so the state of a user is bounded by what is sent in that time."""
    sent: dict = {}
    day, count, last = None, 0, None

    def step(values: tuple) -> str:
        nonlocal day, count, last
        at, made, name = values
        for old in [k for k, t in sent.items() if (at - t).total_seconds() >= keep_seconds]:
            del sent[old]
        if name in sent:
            return "duplicate"
        if (at - made).total_seconds() > stale_seconds:
            return "stale"
        if at.hour >= quiet[0] or at.hour < quiet[1]:
            return "quiet"
        if at.date() != day:
            day, count = at.date(), 0
        if count >= per_day:
            return "cap"
        if last is not None and (at - last).total_seconds() < gap_seconds:
            return "gap"
        sent[name] = at
        count, last = count + 1, at
        return "send"

    return step


def plan_pushes(events: DataFrame, *, user: str, ts: str, made: str, name: str, order: str, per_day: int = 2, gap_seconds: float = 7200, stale_seconds: float = 50_400) -> DataFrame:
    return _by_key(events, user, [ts, order], lambda: planner(per_day, gap_seconds, stale_seconds), [ts, made, name], "plan", "string")


def due_reminders(rows: DataFrame, now: Column, *, most_attempts: int = 6, late_days: int = 30, device_days: int = 90) -> DataFrame:
    """rows(remind_at, sent, attempts, last_try, device_seen) with action: wait, send, retry later, drop or expired."""
    from tessera.functions.dates import backoff_ms

    day = F.expr("interval 1 day")
    after = F.col("last_try") + F.make_dt_interval(secs=(backoff_ms(F.col("attempts")) / 1000).cast("decimal(18,6)"))
    action = (
        F.when(F.col("device_seen") < now - day * device_days, "expired")
        .when(F.col("sent") | (F.col("attempts") >= most_attempts) | (F.col("remind_at") < now - day * late_days), "drop")
        .when(F.col("remind_at") > now, "wait")
        .when(F.col("last_try").isNotNull() & (after > now), "retry later")
        .otherwise("send")
    )
    return rows.withColumn("action", action)


def sync_reminders(old: DataFrame, new: DataFrame, now: Column, *, device: str = "device", key: str = "id") -> DataFrame:
    """The reminders that a device sends replace its old ones; what was sent, tried and planned is kept for those that stay.
    new(device, id, due_at), old(device, id, sent_at, attempts, next_at). A new one is tried when due, a minute from now at the
    earliest."""
    was = old.select(device, key, "sent_at", "attempts", "next_at")
    first = F.greatest(F.col("due_at"), now + F.expr("interval 1 minute"))
    return new.join(was, [device, key], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).withColumn("next_at", F.coalesce("next_at", first))


def due_items(entries: DataFrame, now: Column) -> DataFrame:
    """entries(slug, added_at, remind_at, reaction) that wait for a reaction: id of the reminder, and whether it is due."""
    waiting = entries.where(F.col("reaction").isNull() & F.col("remind_at").isNotNull())
    return waiting.withColumn("id", F.concat_ws(":", "slug", F.col("added_at").cast("string"), F.col("remind_at").cast("string"))).withColumn("due", F.col("remind_at") <= now)


# sessions, streaks, folds


def sessions(events: DataFrame, *, key: str, ts: str, gap: str, value: str, tie: str) -> DataFrame:
    """Bursts of a key's events less than a gap apart: bounds, size, best event by value and mean value."""
    best = F.max_by(tie, F.struct(F.col(value), F.col(tie)))
    out = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), best.alias("best"), F.avg(value).alias("mean"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "best", "mean")


def session_stream(events: DataFrame, *, key: str, ts: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_stream(events: DataFrame, *, ts: str, every: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; later events than the delay are dropped."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def streaks(days: DataFrame, *, key: str, day: str, solved: str) -> DataFrame:
    """days has a row for each key and day: current streak of solved days at the last day, and the best one."""
    good = days.where(F.col(solved))
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(key).orderBy(day)))
    runs = good.withColumn("_i", island).groupBy(key, "_i").agg(F.count("*").alias("n"), F.max(day).alias("until"))
    last = days.groupBy(key).agg(F.max(day).alias("last_day"))
    per = last.join(runs, key, "left").groupBy(key).agg(F.coalesce(F.max("n"), F.lit(0)).alias("best"), F.coalesce(F.max(F.when(F.col("until") == F.col("last_day"), F.col("n"))), F.lit(0)).alias("current"))
    return per.select(key, "current", "best")


def inventory(moves: DataFrame, *, key: str, order: list[str], item: str, n: str, capacity: int) -> DataFrame:
    """Moves of items into (n > 0) and out of a store, in order: ok, full (it holds `capacity` in all) or short (fewer are there).
    Refused moves change nothing."""

    def fold():
        held: dict = {}

        def step(values: tuple) -> str:
            name, count = values[0], int(values[1])
            if count > 0 and sum(held.values()) + count > capacity:
                return "full"
            if held.get(name, 0) + count < 0:
                return "short"
            held[name] = held.get(name, 0) + count
            if not held[name]:
                del held[name]
            return "ok"

        return step

    return _by_key(moves, key, order, fold, [item, n], "outcome", "string")


def experience(events: DataFrame, *, key: str, order: list[str], gain: str, levels: list[int], bonus: int) -> DataFrame:
    """Running experience: gains add up, each level that is reached adds a bonus once."""

    def fold():
        xp, level = 0, 0

        def step(values: tuple) -> int:
            nonlocal xp, level
            xp += int(values[0] or 0)
            while level < len(levels) and xp >= levels[level]:
                level += 1
                xp += bonus
            return xp

        return step

    return _by_key(events, key, order, fold, [gain], "xp", "long")


def remembered(scans: DataFrame, asked: DataFrame, *, session: str, item: str, ts: str, ttl_seconds: int = 1800) -> DataFrame:
    """asked(session, item, ts) with what the session's memory holds of the item: the latest scan before it, if that is younger
    than the time to live. One ordered window over both, so a session of any length needs no list."""
    value = F.struct(*[c for c in scans.columns if c not in (session, item)])
    both = scans.select(session, item, F.col(ts).alias("_at"), F.lit(0).alias("_ask"), value.alias("_v")).unionByName(asked.select(session, item, F.col(ts).alias("_at"), F.lit(1).alias("_ask")), allowMissingColumns=True)
    before = Window.partitionBy(session, item).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_v", ignorenulls=True).over(before)).where("_ask = 1")
    young = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col(f"_last.{ts}").cast("timestamp")) < ttl_seconds * 1_000_000
    return seen.select(session, item, F.col("_at").alias(ts), F.when(young, F.col("_last")).alias("seen"))


def fuse_frames(rows: DataFrame, mode: str) -> DataFrame:
    """rows(query_id, frame, sharpness, item_id, score): one ranking of a burst. Modes: sharpest, max, mean, rrf, max3, rrf3 (the
    last two over the three sharpest frames). Rows (query_id, item_id, score)."""
    sharp = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("sharpness").desc(), "frame"))
    used = rows.withColumn("_s", sharp)
    keep = {"sharpest": 1, "max3": 3, "rrf3": 3}.get(mode)
    if keep:
        used = used.where(F.col("_s") <= keep)
    if mode.startswith("rrf"):
        place = F.row_number().over(Window.partitionBy("query_id", "frame").orderBy(F.col("score").desc(), "item_id"))
        return used.withColumn("_r", place).groupBy("query_id", "item_id").agg(F.sum(1 / (60 + F.col("_r"))).alias("score"))
    if mode == "mean":
        n = used.groupBy("query_id").agg(F.count_distinct("frame").alias("_n"))
        return used.groupBy("query_id", "item_id").agg(F.sum("score").alias("s")).join(n, "query_id").select("query_id", "item_id", (F.col("s") / F.col("_n")).alias("score"))
    return used.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def cache_reads(reads: DataFrame, *, key: str, ts: str, order: str, failed: str, ttl_seconds: float) -> DataFrame:
    """What a cache with a time to live answers: fresh, cached, stale (the source failed, an old value is there) or error."""

    def fold():
        at_value = None

        def step(values: tuple) -> str:
            nonlocal at_value
            at, bad = values
            at = at.timestamp() if hasattr(at, "timestamp") else float(at)
            if at_value is not None and at - at_value < ttl_seconds:
                return "cached"
            if bad:
                return "error" if at_value is None else "stale"
            at_value = at
            return "fresh"

        return step

    return _by_key(reads, key, [ts, order], fold, [ts, failed], "answer", "string")
