"""View analytics over the events table: day series, trends, facets, retention, limits by anchored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table
from ..streaming.limits import anchored_decisions

NOW = "2024-01-31 00:00:00"


def _end():
    return F.lit(NOW).cast("timestamp_ntz")


def usage_by_day(spark, d):
    """Thirty days by rolling 24-hour age, zero-filled: views and purchases."""
    return R.day_series(table(spark, d, "events"), "ts", NOW, 30, {"views": F.col("event_type") == "view", "purchases": F.col("event_type") == "purchase"})


def logins_week(spark, d):
    return R.day_series(table(spark, d, "events").where(F.col("event_type").contains("sign")), "ts", NOW, 7, {"logins": F.lit(True)})


def usage_totals(spark, d):
    """Events and distinct users by type and over all, with the share of all events in percent."""
    e = table(spark, d, "events")
    by = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return by.unionByName(e.agg(F.lit("all").alias("event_type"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))


def usage_share(spark, d):
    """Share of each type in percent, rounded half up, 0 where there is nothing."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = e.agg(F.sum("n").alias("total"))
    return e.join(F.broadcast(total)).select("event_type", F.when(F.col("total") > 0, F.floor(F.col("n") * 100 / F.col("total") + 0.5)).otherwise(0).cast("long").alias("percent"))


def period_trend(spark, d):
    """The last 7 days against the 7 before, by type: change in percent, null from nothing, and its direction."""
    age = F.datediff(_end(), "ts")
    e = table(spark, d, "events").groupBy("event_type").agg(F.count_if(age.between(1, 7)).alias("now"), F.count_if(age.between(8, 14)).alias("before"))
    change = F.when(F.col("before") > 0, F.floor((F.col("now") - F.col("before")) * 100 / F.col("before") + 0.5).cast("long"))
    return e.select("event_type", "now", "before", change.alias("change"), F.when(F.col("now") > F.col("before"), "up").when(F.col("now") < F.col("before"), "down").otherwise("flat").alias("direction"))


def log_search(spark, d):
    """Search, multi-select and date facet, without the events of some users' errors."""
    e = table(spark, d, "events")
    hidden = (F.col("event_type") == "error") & F.col("user_id").isin([1, 2, 3])
    return e.where(R.all_of(~hidden, R.any_contains(["event_type", "props"], "R"), R.one_of("event_type", ["error", "purchase"]), F.col("ts") > _end() - F.expr("interval 7 days"))).select("event_id", "user_id", "event_type")


def retention(spark, d):
    """What a retention of half a month leaves, by type."""
    return table(spark, d, "events").where(F.col("ts") >= _end() - F.expr("interval 15 days")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def notifications(spark, d):
    """The 100 newest of stored and virtual notifications; a virtual one only where its user has no stored one."""
    e = table(spark, d, "events")
    stored = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts", F.lit("stored").alias("kind"))
    virtual = e.where("event_type = 'signup'").select("user_id", "event_id", "ts", F.lit("virtual").alias("kind")).join(stored.where("ts >= '2024-01-29'").select("user_id").distinct(), "user_id", "left_anti")
    return stored.unionByName(virtual).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("user_id", "event_id", "kind")


def json_flag(spark, d):
    """Events whose JSON property k is 50 or more; text that isn't JSON counts as absent."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')")
    return table(spark, d, "events").where(k >= 50).groupBy("event_type").agg(F.count("*").alias("n"), F.max(k).cast("long").alias("most"))


def json_merge(spark, d):
    """Shallow merge of the properties with a patch: keys of the patch win."""
    stored = F.from_json("props", "map<string,int>")
    patch = F.create_map(F.lit("k"), F.when(F.col("value") > 10, F.lit(0)).otherwise(F.lit(None)), F.lit("seen"), F.lit(1))
    merged = F.map_zip_with(stored, F.map_filter(patch, lambda _, v: v.isNotNull()), lambda _, a, b: F.coalesce(b, a))
    return table(spark, d, "events").select("event_id", merged["k"].alias("k"), merged["seen"].alias("seen"))


def sessions(spark, d):
    """Events by user in fixed quarter-hour windows, the most of any window: the tumbling form of a rate limit."""
    e = table(spark, d, "events").groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.max("n").alias("most"), F.count("*").alias("windows"))


def rate_limit(spark, d):
    """Events that a limit of 2 in windows of 6 hours rejects, the window of a user opening with the first event after the last one closed."""
    return anchored_decisions(table(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600, 2).groupBy("user_id").agg(F.count_if(~F.col("allowed")).alias("rejected"), F.count("*").alias("n"))


def unread(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("value") < 5).alias("unread"), F.max("event_id").alias("last_id"))


_AGE = f"floor(epoch_us(TIMESTAMP '{NOW}' - ts) / 86400000000)"
QUERIES = {
    "usage_by_day": (usage_by_day, f"WITH e AS (SELECT {_AGE}::BIGINT AS age, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases FROM (SELECT *, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS us FROM events) GROUP BY 1) SELECT s.age, coalesce(views, 0) AS views, coalesce(purchases, 0) AS purchases FROM range(30) s(age) LEFT JOIN e ON e.age = s.age".replace(_AGE, "floor(us / 86400000000)")),
    "logins_week": (logins_week, f"WITH e AS (SELECT floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000)::BIGINT AS age, count(*) AS logins FROM events WHERE event_type LIKE '%sign%' GROUP BY 1) SELECT s.age, coalesce(logins, 0) AS logins FROM range(7) s(age) LEFT JOIN e ON e.age = s.age"),
    "usage_totals_unique": (usage_totals, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT user_id) FROM events"),
    "usage_share": (usage_share, "SELECT event_type, floor(count(*) * 100 / sum(count(*)) OVER () + 0.5)::BIGINT AS percent FROM events GROUP BY 1"),
    "period_trend": (period_trend, f"""
        SELECT event_type, now, before, CASE WHEN before > 0 THEN floor((now - before) * 100 / before + 0.5)::BIGINT END AS change, CASE WHEN now > before THEN 'up' WHEN now < before THEN 'down' ELSE 'flat' END AS direction FROM (
        SELECT event_type, count(*) FILTER (date_diff('day', ts::DATE, DATE '2024-01-31') BETWEEN 1 AND 7) AS now, count(*) FILTER (date_diff('day', ts::DATE, DATE '2024-01-31') BETWEEN 8 AND 14) AS before FROM events GROUP BY 1)"""),
    "log_search_facets": (log_search, f"SELECT event_id, user_id, event_type FROM events WHERE NOT (event_type = 'error' AND user_id IN (1, 2, 3)) AND (lower(event_type) LIKE '%r%' OR lower(props) LIKE '%r%') AND event_type IN ('error', 'purchase') AND ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY"),
    "retention_delete": (retention, f"SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 15 DAY GROUP BY 1"),
    "notifications_merge": (notifications, """
        SELECT user_id, event_id, kind FROM (SELECT user_id, event_id, ts, 'stored' AS kind FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, event_id, ts, 'virtual' FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.ts >= TIMESTAMP '2024-01-29' AND s.user_id = e.user_id)) ORDER BY ts DESC, event_id DESC LIMIT 100"""),
    "json_flag_filter": (json_flag, "SELECT event_type, count(*) AS n, max((props::JSON->>'$.k')::BIGINT) AS most FROM events WHERE (props::JSON->>'$.k')::INT >= 50 GROUP BY 1"),
    "json_merge": (json_merge, "SELECT event_id, CASE WHEN value > 10 THEN 0 ELSE (props::JSON->>'$.k')::INT END AS k, 1 AS seen FROM events"),
    "fixed_window_counts": (sessions, "SELECT user_id, max(n) AS most, count(*) AS windows FROM (SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"),
    "anchored_rate_limit": (rate_limit, None),
    "unread_counts": (unread, "SELECT user_id, count(*) FILTER (value < 5) AS unread, max(event_id) AS last_id FROM events GROUP BY 1"),
}
