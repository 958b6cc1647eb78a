"""Keyed state, sessions and community statistics over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import metrics, search
from tessera.plans._tables import table
from tessera.sources import readers
from tessera.streaming import state


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def lww_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event of each user and type; purchases stand for deletions."""
    e = _events(spark, sf).select("user_id", F.get_json_object("props", "$.k").cast("int").alias("slot"), "event_id", "ts", "value", (F.col("event_id") % 5 == 0).alias("deleted"))
    return state.last_writer(e, ["user_id", "slot"], updated="ts", deleted="deleted", tie="event_id").select("user_id", "slot", "event_id", "value")


def lww_added(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("user_id", "event_type", "event_id", "ts", (F.col("event_id") % 5 == 0).alias("deleted"), F.col("ts").alias("added"))
    return state.first_added(e, ["user_id", "event_type"], updated="ts", deleted="deleted", added="added", tie="event_id")


def idempotent(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("request", F.get_json_object("props", "$.k"))
    return state.idempotent(e, ["user_id", "request"], "event_id").select("user_id", "request", "event_id")


def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("ref", F.get_json_object("props", "$.k"))
    return state.daily_cap(e, user="user_id", kind="event_type", ref="ref", day=dates.day_key(F.col("ts")), order="event_id", limit=1).select("user_id", "event_type", "ref", "day", "event_id")


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_type", "ts", "event_id")
    return state.rate_limit(e, key="event_type", ts="ts", order="event_id", limit=20, window_seconds=6 * 3600).groupBy("event_type").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def session_burst(spark: SparkSession, sf: str) -> DataFrame:
    out = state.sessions(_events(spark, sf), key="user_id", ts="ts", gap="6 hours", value="value", tie="event_id")
    return out.select("user_id", "start", "n", "best", F.round("mean", 6).alias("mean"))


def streaks(spark: SparkSession, sf: str) -> DataFrame:
    days = _events(spark, sf).groupBy("event_type", (F.col("user_id") % 50).alias("u"), F.col("ts").cast("date").alias("day")).agg((F.sum("value") > 40).alias("solved"))
    return state.streaks(days.withColumn("key", F.concat_ws(":", "event_type", "u")), key="key", day="day", solved="solved")


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.latency_ranked(_events(spark, sf), "event_type", "value")
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


def community_stats(spark: SparkSession, sf: str) -> DataFrame:
    """By type: events, distinct users, share of values above 50 rounded half up, last event."""
    liked = F.count_if(F.col("value") > 50)
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.floor(100 * liked / F.count("*") + 0.5).alias("liked_percent"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def dish_share(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent words of each role's turns, four each."""
    words = table(spark, sf, "conversations").select("role", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3)).alias("word"))
    per = words.groupBy("role", "word").agg(F.count("*").alias("n"))
    return search.top_k(per, ["role"], "n", 4, "word").select("role", "word", "n", "rank")


def daily_players(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).groupBy(dates.day_key(F.col("ts")).alias("day")).agg(F.count_distinct("user_id").alias("players"), F.round(100 * F.avg((F.col("value") > 50).cast("double")), 6).alias("solved_percent"))
    return e


def log_recent(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.request_log(_events(spark, sf).select("event_id", "ts", "event_type"), since="2024-01-03 00:00:00", until="2024-01-20 00:00:00", ts="ts", order="event_id", limit=50, offset=10)
    return rows.select("event_id", "event_type")


def latest_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with their last user turn, and the reply that follows it if there is one."""
    t = table(spark, sf, "conversations")
    last = t.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    reply = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("reply_role"), F.length("text").alias("reply_chars"))
    return last.join(reply, ["conv_id", "turn"], "left")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Batch twin of the windowed stream: counts by day and type."""
    return _events(spark, sf).groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (lww_upsert, lww_added, idempotent, daily_cap, rate_limit, session_burst, streaks, latency_percentiles, community_stats, dish_share, daily_players, log_recent, latest_turn, event_windows)}

SQL = {
    "lww_upsert": "with e as (select user_id, (props->>'$.k')::int slot, event_id, ts, value, event_id % 5 = 0 deleted from events), r as (select *, row_number() over (partition by user_id, slot order by ts desc, deleted desc, event_id desc) k from e) select user_id, slot, event_id, value from r where k = 1 and not deleted",
    "lww_added": "with e as (select user_id, event_type, event_id, ts, event_id % 5 = 0 deleted from events), l as (select *, coalesce(sum(deleted::int) over (partition by user_id, event_type order by ts, deleted, event_id rows between unbounded preceding and 1 preceding), 0) life from e), m as (select user_id, event_type, max(life) life from l where not deleted group by 1, 2) select l.user_id, l.event_type, min(ts) added from l join m using (user_id, event_type, life) where not deleted group by 1, 2",
    "idempotent": "select user_id, props->>'$.k' request, min(event_id) event_id from events group by 1, 2",
    "daily_cap": "with o as (select user_id, event_type, props->>'$.k' ref, min(event_id) event_id from events group by 1, 2, 3), d as (select o.*, (ts + interval 3 hours)::date as day from o join events using (event_id)), r as (select *, row_number() over (partition by user_id, event_type, day order by event_id) k from (select user_id, event_type, ref, day, event_id from d)) select user_id, event_type, ref, day, event_id from r where k <= 1",
    "rate_limit": "with recursive e as materialized (select event_type, epoch_us(ts) / 1e6 s, row_number() over (partition by event_type order by ts, event_id) i from events), w(event_type, i, start, n) as (select event_type, i, s, 1 from e where i = 1 union all select e.event_type, e.i, case when s - start >= 21600 then s else start end, case when s - start >= 21600 then 1 else n + 1 end from w join e on e.event_type = w.event_type and e.i = w.i + 1) select event_type, count(*) filter (n <= 20) allowed, count(*) filter (n > 20) refused from w group by 1",
    "session_burst": "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) k from g) select user_id, min(ts) as start, count(*) n, arg_max(event_id, {'v': value, 'e': event_id}) best, round(avg(value), 6) mean from s group by user_id, k",
    "streaks": "with d as (select event_type || ':' || (user_id % 50) as key, ts::date as day, sum(value) > 40 solved from events group by 1, 2), i as (select key, day, day - row_number() over (partition by key order by day)::int g from d where solved), r as (select key, g, count(*) n, max(day) until from i group by 1, 2), l as (select key, max(day) last from d group by 1) select l.key, coalesce(max(case when until = last then n end), 0) as current, coalesce(max(n), 0) best from l left join r using (key) group by 1",
    "latency_percentiles": "with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 k, count(*) over (partition by event_type) n from events) select event_type, round(median(value), 6) p50, round(max(case when k = least(floor(n * 0.95::double), n - 1) then value end), 6) p95, count(*) n from r group by 1",
    "community_stats": "select event_type, count(*) n, count(distinct user_id) users, floor(100 * count(*) filter (value > 50) / count(*) + 0.5)::bigint liked_percent, arg_max(event_id, {'t': ts, 'e': event_id}) last_event from events group by 1",
    "dish_share": "with w as (select role, unnest(string_split_regex(lower(text), '[^a-z]+')) word from conversations), c as (select role, word, count(*) n from w where length(word) > 3 group by 1, 2), r as (select *, row_number() over (partition by role order by n desc, word) - 1 k from c) select role, word, n, k::int as rank from r where k < 4",
    "daily_players": "select (ts + interval 3 hours)::date as day, count(distinct user_id) players, round(100 * avg((value > 50)::int), 6) solved_percent from events group by 1",
    "log_recent": "select event_id, event_type from events where ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-20' order by event_id desc limit 50 offset 10",
    "latest_turn": "with l as (select conv_id, max(turn) turn from conversations where role = 'user' group by 1) select l.conv_id, l.turn, c.role reply_role, length(c.text)::int reply_chars from l left join conversations c on c.conv_id = l.conv_id and c.turn = l.turn + 1",
    "event_windows": "select date_trunc('day', ts) as start, event_type, count(*) n from events group by 1, 2",
}
