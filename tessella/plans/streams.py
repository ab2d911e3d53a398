"""Event-time queries over the events of users; each operator also runs on a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.session import table
from tessella.streaming import windows


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "value", "event_type")


def typing_bursts(spark, sf_dir):
    return windows.typing_bursts(_events(spark, sf_dir), "1 hour", "15 minutes", 3)


BURST_SQL = """WITH w AS (SELECT user_id AS key, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM events, range(4) r(k))
SELECT key, start, start + INTERVAL 1 HOUR AS "end", count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3"""


def sessions(spark, sf_dir):
    return windows.sessions(_events(spark, sf_dir), "2 hours")


SESSION_SQL = """WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT key, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY key, k"""


def monthly_events(spark, sf_dir):
    return windows.monthly_usage(_events(spark, sf_dir))


MONTHLY_SQL = "SELECT user_id AS key, strftime(ts, '%Y-%m') AS period, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2"


def rate_window_counts(spark, sf_dir):
    """For each event: how many of its user's fall into the hour and the day up to it."""
    e = _events(spark, sf_dir).select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    back = lambda s: F.count(F.lit(1)).over(Window.partitionBy("key").orderBy("t").rangeBetween(-s * 1_000_000 + 1, 0))
    return e.select("id", back(3600).alias("hour"), back(86400).alias("day"))


RATE_SQL = """WITH e AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t FROM events)
SELECT id, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS day FROM e"""


def rate_limited(spark, sf_dir):
    """Requests that a limiter of one a quarter hour, three an hour and ten a day lets through."""
    return windows.rate_limit(_events(spark, sf_dir), ((900, 1), (3600, 3), (86400, 10))).select("key", "id", "accepted")


def rate_remaining(spark, sf_dir):
    """What the limits of three an hour and ten a day leave each user at the time of the last event of all."""
    e = _events(spark, sf_dir).select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    now = e.agg(F.max("t").alias("now"))
    n = e.join(F.broadcast(now)).groupBy("key").agg(*[F.count_if(F.col("t") > F.col("now") - s * 1_000_000).alias(k) for k, s in (("h", 3600), ("d", 86400))])  # now is one row
    return n.select("key", F.greatest(F.lit(0), 3 - F.col("h")).alias("hour_left"), F.greatest(F.lit(0), 10 - F.col("d")).alias("day_left"))


REMAINING_SQL = """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events), n AS (SELECT max(t) AS now FROM e)
SELECT key, greatest(0, 3 - count(*) FILTER (t > now - 3600000000)) AS hour_left, greatest(0, 10 - count(*) FILTER (t > now - 86400000000)) AS day_left FROM e, n GROUP BY key"""


QUERIES = {
    "rate_remaining": (rate_remaining, REMAINING_SQL),
    "typing_bursts": (typing_bursts, BURST_SQL),
    "sessions": (sessions, SESSION_SQL),
    "monthly_events": (monthly_events, MONTHLY_SQL),
    "rate_window_counts": (rate_window_counts, RATE_SQL),
    "rate_limited": (rate_limited, None),
}
