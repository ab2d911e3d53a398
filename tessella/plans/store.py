"""Queries over the durable store: pages of jobs, usage, retries, upserts, cases. Orders stand for jobs, their customers
for tenants, line items for results, events for webhook deliveries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import records
from tessella.session import table


def jobs_page(spark, sf_dir):
    """A page of finished jobs, newest first."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_custkey", "o_orderdate")


JOBS_SQL = "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20"


def result_page(spark, sf_dir):
    """The best results from a threshold on."""
    r = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.05")
    return r.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")


RESULT_SQL = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount >= 0.05 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50"


def usage_monthly(spark, sf_dir):
    """Sums by tenant and month, the month's share of a limit left over."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    return o.select("*", F.greatest(F.lit(0), 5 - F.col("jobs")).alias("remaining"))


USAGE_SQL = "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS jobs, round(sum(o_totalprice), 2) AS amount, greatest(0, 5 - count(*)) AS remaining FROM orders GROUP BY 1, 2"


def webhook_pending(spark, sf_dir):
    """Deliveries that are due, oldest first, with the time of the next attempt: 60 * 2^attempt seconds on."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("event_id") % 6).alias("attempts"))
    due = e.filter("(event_type = 'signup' OR (event_type = 'error' AND ts <= timestamp '2024-01-15 00:00:00')) AND attempts < 5")
    after = F.expr("ts + make_dt_interval(0, 0, 0, 60 * cast(pow(2, attempts + 1) as int))")
    return due.orderBy("ts", "event_id").limit(100).select("event_id", "attempts", after.alias("next_attempt"))


WEBHOOK_SQL = """SELECT event_id, event_id % 6 AS attempts, ts + to_seconds(60 * 2 ** (event_id % 6 + 1)) AS next_attempt FROM events
WHERE (event_type = 'signup' OR (event_type = 'error' AND ts <= TIMESTAMP '2024-01-15 00:00:00')) AND event_id % 6 < 5 ORDER BY ts, event_id LIMIT 100"""


def latest_upsert(spark, sf_dir):
    """The last state of each key: what a batch of upserts leaves; summed before the shuffle, not ranked."""
    e = table(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x")
    return e.groupBy("user_id").agg(last, F.count(F.lit(1)).alias("versions")).select("user_id", "x.event_id", "x.event_type", "x.value", "versions")


UPSERT_SQL = "SELECT user_id, event_id, event_type, value, count(*) OVER (PARTITION BY user_id) AS versions FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def api_usage(spark, sf_dir):
    """Jobs and results of each tenant, the results through their jobs."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    results = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(results, "o_orderkey", "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("n"), F.lit(0)).alias("results"))


API_SQL = "SELECT o_custkey, count(*) AS jobs, coalesce(sum(n), 0)::BIGINT AS results FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey"


def case_view(spark, sf_dir):
    """An order with its customer, nation, region and lines: a case with its parties and results."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))) / 10000).alias("net"))
    who = t("customer").join(t("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").join(t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    who = who.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name", "r_name")
    out = t("orders").filter("o_orderpriority = '1-URGENT'").join(who, "o_custkey").join(lines, "o_orderkey", "left")
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"), F.coalesce("net", F.lit(0.0)).alias("net"))


CASE_SQL = """SELECT o_orderkey, c_mktsegment, n_name, r_name, coalesce(n_lines, 0) AS n_lines, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(net, 0.0) AS net
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers, sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::DOUBLE / 10000 AS net FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT'"""


def orphan_delete(spark, sf_dir):
    """What is left when the rows of deleted jobs go: suppliers' line counts without those of cancelled orders."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_left"))


ORPHAN_SQL = "SELECT l_suppkey, count(*) AS n_left FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P') GROUP BY 1"


def batch_summary(spark, sf_dir):
    """Totals of results: count, mean, extremes, flagged and their share."""
    on = F.col("l_discount") >= 0.08
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("l_discount"), 9).alias("mean"), F.max("l_discount").alias("highest"), F.min("l_discount").alias("lowest"), F.count_if(on).alias("flagged"), (100 * F.count_if(on) / F.count(F.lit(1))).alias("percent"))


SUMMARY_SQL = "SELECT l_returnflag, count(*) AS total, round(avg(l_discount), 9) AS mean, max(l_discount) AS highest, min(l_discount) AS lowest, count(*) FILTER (l_discount >= 0.08) AS flagged, 100 * count(*) FILTER (l_discount >= 0.08) / count(*) AS percent FROM lineitem GROUP BY 1"


def dominance(spark, sf_dir):
    """Parts of which one supplier has most lines, or that only one supplies: authors who dominate a file."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("l_partkey").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count(F.lit(1)).alias("authors"))
    return t.select("l_partkey", "total", "authors", (F.col("top") / F.col("total")).alias("share"), (F.col("authors") == 1).alias("single"))


DOMINANCE_SQL = "SELECT l_partkey, sum(n)::BIGINT AS total, count(*) AS authors, max(n) / sum(n)::DOUBLE AS share, count(*) = 1 AS single FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1"

def tenant_by_key(spark, sf_dir):
    """The tenant whose hashed key is given, and one of its jobs by id and tenant."""
    who = table(spark, sf_dir, "customer").filter(F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256) == F.sha2(F.lit("key-7"), 256)).select(F.col("c_custkey").alias("o_custkey"), "c_name").limit(1)
    job = table(spark, sf_dir, "orders").join(who, "o_custkey")
    return job.groupBy("o_custkey", "c_name").agg(F.max("o_orderkey").alias("last_job"), F.count(F.lit(1)).alias("jobs"))


TENANT_SQL = "SELECT o_custkey, c_name, max(o_orderkey) AS last_job, count(*) AS jobs FROM orders JOIN customer ON c_custkey = o_custkey WHERE sha256('key-' || c_custkey::VARCHAR) = sha256('key-7') GROUP BY 1, 2"


def status_updates(spark, sf_dir):
    """Jobs after their status updates, folded in order of time: the last one is the status, and each time, and a failure's
    reason, is that of the last update that sets it, so a failed job keeps the time when it started. The shipments of a job
    are its updates. Times have no zone, as in the table."""
    sent = table(spark, sf_dir, "lineitem")
    kind = sent.schema["l_shipdate"].dataType
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("queued").alias("status"), *[F.lit(None).cast(kind).alias(c) for c in ("started_at", "completed_at", "failed_at")], F.lit(None).cast("string").alias("error"))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "processing").otherwise("completed")
    sent = sent.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"), "l_linenumber", status.alias("status"))
    at = lambda s: F.when(F.col("status") == s, F.col("at"))
    updates = sent.select("*", at("processing").alias("started_at"), at("completed").alias("completed_at"), at("failed").alias("failed_at"), F.when(F.col("status") == "failed", "returned").alias("error"))
    return records.merged(jobs, records.folded(updates, ["o_orderkey"], ["at", "l_linenumber"]), ["o_orderkey"])


STATUS_SQL = """WITH u AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'processing' ELSE 'completed' END AS status, l_shipdate AS t, l_linenumber AS k FROM lineitem),
f AS (SELECT l_orderkey, (list(status ORDER BY t DESC, k DESC, status DESC))[1] AS status, max(t) FILTER (status = 'processing') AS started_at, max(t) FILTER (status = 'completed') AS completed_at,
  max(t) FILTER (status = 'failed') AS failed_at, max(CASE WHEN status = 'failed' THEN 'returned' END) AS error FROM u GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, coalesce(f.status, 'queued') AS status, started_at, completed_at, failed_at, error FROM orders FULL JOIN f ON l_orderkey = o_orderkey"""


def idempotent_requests(spark, sf_dir):
    """Requests by kind that are taken or refused: a key (user and kind) is taken once, and never if a sign-up had it."""
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "user_id", (F.col("event_id") % 50)))
    done = records.accepted(e.filter("event_type <> 'signup'"), "key", ["ts", "event_id"], e.filter("event_type = 'signup'"))
    return done.groupBy("event_type").agg(F.count_if(F.col("accepted")).alias("taken"), F.count_if(~F.col("accepted")).alias("refused"))


IDEMPOTENT_SQL = """WITH e AS (SELECT *, user_id || ':' || event_id % 50 AS key FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1 AND key NOT IN (SELECT key FROM e WHERE event_type = 'signup') AS ok FROM e WHERE event_type <> 'signup')
SELECT event_type, count(*) FILTER (ok) AS taken, count(*) FILTER (NOT ok) AS refused FROM r GROUP BY 1"""


def usage_or_create(spark, sf_dir):
    """A usage row of every tenant for one month, made with zeros where there is none, and what its tier leaves."""
    o = table(spark, sf_dir, "orders").filter(F.date_format("o_orderdate", "yyyy-MM") == "1996-03")
    used = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    tiers = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2), ("AUTOMOBILE", 3)], "c_mktsegment string, allowed long")  # a row for each tier
    c = table(spark, sf_dir, "customer").join(F.broadcast(tiers), "c_mktsegment", "left").select("c_custkey", F.coalesce("allowed", F.lit(5)).alias("allowed"))
    return records.with_defaults(c, used, ["c_custkey"], {"jobs": 0, "amount": 0.0}).join(c, "c_custkey").select("c_custkey", "jobs", "amount", F.greatest(F.lit(0), F.col("allowed") - F.col("jobs")).alias("remaining"))


USAGE_CREATE_SQL = """WITH u AS (SELECT o_custkey, count(*) AS jobs, round(sum(o_totalprice), 2) AS amount FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03' GROUP BY 1)
SELECT c_custkey, coalesce(jobs, 0) AS jobs, coalesce(amount, 0.0) AS amount, greatest(0, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 5 END - coalesce(jobs, 0)) AS remaining FROM customer LEFT JOIN u ON o_custkey = c_custkey"""


def usage_history(spark, sf_dir):
    """The last twelve months of use, newest first."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("jobs"))
    return o.orderBy(F.desc("period")).limit(12)


HISTORY_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS jobs FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12"


def case_timeline(spark, sf_dir):
    """What an append-only log holds of each case, in order: opened, items, closed with its last shipment. Items of one number
    and time stand in the order of their actions; rows that are still equal are so in all columns."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    l = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    opened = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("happened"), F.lit("opened").alias("action"), F.lit(0).alias("item"))
    items = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("happened"), F.when(F.col("l_returnflag") == "R", "returned").otherwise("shipped").alias("action"), F.col("l_linenumber").alias("item"))
    closed = l.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.max("l_shipdate").alias("happened")).select("case_id", "happened", F.lit("closed").alias("action"), F.lit(99).alias("item"))
    log = opened.unionByName(items).unionByName(closed)
    return log.select("*", F.row_number().over(Window.partitionBy("case_id").orderBy("happened", "item", "action")).alias("n"))


TIMELINE_SQL = """WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
x AS (SELECT o_orderkey AS case_id, o_orderdate AS happened, 'opened' AS action, 0 AS item FROM o UNION ALL SELECT l_orderkey, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'shipped' END, l_linenumber FROM l UNION ALL SELECT l_orderkey, max(l_shipdate), 'closed', 99 FROM l GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY happened, item)::INTEGER AS n FROM x"""


def cases_by_group(spark, sf_dir):
    """Cases of one organisation by status, newest first."""
    o = records.matching(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=None, o_custkey=7)
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


CASES_SQL = "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25"


def vector_upsert(spark, sf_dir):
    """Vectors after a batch of upserts on (id, job), of which the last of each key stands, counted by label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("job"), "label")
    batch = v.filter("vec_id % 3 = 0").select("vec_id", "job", (F.col("label") + 1).alias("label"), F.lit(1).alias("seq"))
    batch = batch.unionByName(v.filter("vec_id % 6 = 0").select("vec_id", "job", (F.col("label") + 2).alias("label"), F.lit(2).alias("seq")))
    batch = batch.unionByName(v.filter("vec_id % 10 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), "job", "label", F.lit(1).alias("seq")))
    after = records.merged(v, records.latest(batch, ["vec_id", "job"], ["seq"]).select("vec_id", "job", "label"), ["vec_id", "job"])
    return after.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


VECTOR_SQL = """SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN label + 2 WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS label FROM embeddings UNION ALL SELECT -vec_id - 1, label FROM embeddings WHERE vec_id % 10 = 0) GROUP BY 1"""


def first_author(spark, sf_dir):
    """Who supplied a part first, and whether another supplier has most of it since."""
    l = table(spark, sf_dir, "lineitem")
    n = l.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first"))
    t = n.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("first", "l_suppkey")).alias("author"), F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("main"))
    return t.select("l_partkey", "author", "main", (F.col("author") != F.col("main")).alias("suspicious"))


AUTHOR_SQL = """WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, l_suppkey AS main FROM n QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1),
f AS (SELECT l_partkey, l_suppkey AS author FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey, author, main, author <> main AS suspicious FROM f JOIN m USING (l_partkey)"""

QUERIES = {
    "jobs_page": (jobs_page, JOBS_SQL),
    "result_page": (result_page, RESULT_SQL),
    "usage_monthly": (usage_monthly, USAGE_SQL),
    "webhook_pending": (webhook_pending, WEBHOOK_SQL),
    "latest_upsert": (latest_upsert, UPSERT_SQL),
    "api_usage": (api_usage, API_SQL),
    "case_view": (case_view, CASE_SQL),
    "orphan_delete": (orphan_delete, ORPHAN_SQL),
    "batch_summary": (batch_summary, SUMMARY_SQL),
    "dominance": (dominance, DOMINANCE_SQL),
    "tenant_by_key": (tenant_by_key, TENANT_SQL),
    "status_updates": (status_updates, STATUS_SQL),
    "idempotent_requests": (idempotent_requests, IDEMPOTENT_SQL),
    "usage_or_create": (usage_or_create, USAGE_CREATE_SQL),
    "usage_history": (usage_history, HISTORY_SQL),
    "case_timeline": (case_timeline, TIMELINE_SQL),
    "cases_by_group": (cases_by_group, CASES_SQL),
    "vector_upsert": (vector_upsert, VECTOR_SQL),
    "first_author": (first_author, AUTHOR_SQL),
}
