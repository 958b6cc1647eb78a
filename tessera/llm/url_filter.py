"""URL filter with dated lists: validity intervals and an as-of join.

A list is a table of dated entries (pattern, action, day): action block, allow or remove, from that day on. The entries
of a pattern become validity intervals that end where its next entry begins. A capture looks up its host and every parent
domain; of the entries active at its fetch time the longest pattern decides, so an allowed host in a blocked domain stays.

The lookup is an equi-join on the pattern with the interval as a residual condition, so each capture and pattern meet in
one interval at most. The list side is compact (an array of intervals for each pattern would grow without bound; rows
don't), and hot hosts are collapsed first: captures are looked up once for each distinct host and fetch day.

Defined results: a null URL, one without a host, or a null fetch time matches nothing and is kept with rule null. An address
(IPv4, or IPv6 in brackets) has no parent domains: only an entry of the whole address matches it. Of
entries with the same pattern and day the last action in the order allow, block, remove holds. Repeated captures each get
a row. Patterns are compared in lower case without a leading "*." or dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a list that is sent to every executor; a larger one is joined by a shuffle on the pattern.
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user, port and trailing dot; null where there is none."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)", 1)
    host = F.regexp_replace(raw, r"\.+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame, *, pattern_col: str = "pattern", action_col: str = "action", day_col: str = "day") -> DataFrame:
    """Rows (pattern, action, valid_from, valid_to): valid_to is null while the entry still holds; removals leave a gap."""
    clean = entries.select(F.regexp_replace(F.lower(F.col(pattern_col)), r"^\*?\.", "").alias("pattern"), F.col(action_col).alias("action"), F.col(day_col).cast("date").alias("valid_from"))
    clean = clean.where("pattern is not null and pattern <> '' and valid_from is not null and action in ('allow', 'block', 'remove')")
    one = clean.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))
    ordered = one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from")))
    return ordered.where("action <> 'remove'").select("pattern", "action", "valid_from", "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", day_col: str = "fetched_on", **list_cols) -> DataFrame:
    """The captures with host, rule (the deciding pattern), rule_action, rule_from and kept; columns of these names are replaced."""
    kept = [c for c in captures.columns if c.lower() not in ("host", "rule", "rule_action", "rule_from", "kept")]
    seen = captures.select(F.struct(*kept).alias("_row"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("_day"))
    looked_up = seen.where("host is not null and _day is not null").select("host", "_day").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = F.when(F.col("host").rlike(r"^[0-9.]+$|^\["), F.array("host")).otherwise(parents)
    asked = looked_up.select("host", "_day", F.explode(parents).alias("pattern"))
    valid = intervals(entries, **list_cols)
    if entries.count() <= BROADCAST_ROWS:  # no host is shuffled to the domain that it shares with many
        valid = F.broadcast(valid)
    hits = asked.join(valid, (asked["pattern"] == valid["pattern"]) & (F.col("valid_from") <= F.col("_day")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    best = hits.groupBy(F.col("host").alias("_host"), F.col("_day").alias("_at")).agg(F.max(F.struct(F.length(valid["pattern"]).alias("n"), valid["pattern"].alias("rule"), F.col("action"), F.col("valid_from"))).alias("_b"))
    out = seen.join(best, (F.col("host") == F.col("_host")) & (F.col("_day") == F.col("_at")), "left")
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "host", F.col("_b.rule").alias("rule"), F.col("_b.action").alias("rule_action"), F.col("_b.valid_from").alias("rule_from"), F.coalesce(F.col("_b.action") != "block", F.lit(True)).alias("kept"))
