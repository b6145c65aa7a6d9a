"""Queue and call logs read as event statistics: what is claimable at a time, late lease beats, latencies and throttles, waits.

No scheduler runs here: claims, renewals and limits are questions about a log, answered by grouping and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions.numbers import millis_between
from scholia.registry import query

C = F.col


def claimable(jobs: DataFrame, as_of: Column, max_attempts: int = 3) -> DataFrame:
    """Pending jobs, and running ones whose lease has run out, that have attempts left."""
    free = (C("status") == "pending") | ((C("status") == "running") & (C("lease_until").isNull() | (C("lease_until") < as_of)))
    return jobs.where(free & (C("attempts") < max_attempts))


def jobs(s: Source) -> DataFrame:
    """Orders as jobs of a tenant (customer): priority by the order's, attempts by its returned lines, a lease of thirty days from the order on."""
    n = s.table("lineitem").groupBy("l_orderkey").agg(F.count_if(C("l_returnflag") == "R").alias("attempts"))
    status = F.when(C("o_orderstatus") == "O", "pending").when(C("o_orderstatus") == "P", "running").otherwise("done")
    lease = F.when(C("o_orderkey") % 5 > 0, C("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS"))
    return s.table("orders").join(n, C("o_orderkey") == C("l_orderkey"), "left").select(
        C("o_custkey").alias("tenant"), C("o_orderkey").alias("job"), (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), status.alias("status"), lease.alias("lease_until"), F.coalesce("attempts", F.lit(0)).alias("attempts")
    )


_JOBS = """jobs AS (SELECT o_custkey AS tenant, o_orderkey AS job, 6 - CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
    CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END AS lease_until, coalesce(n, 0) AS attempts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey),
    t AS (SELECT CAST(max(o_orderdate) AS TIMESTAMP) AS moment FROM orders)"""


@query("stm2_flt9_claim", f""", {_JOBS} SELECT tenant, job, priority, attempts + 1 AS attempt FROM jobs, t WHERE attempts < 3 AND (status = 'pending' OR status = 'running' AND (lease_until IS NULL OR lease_until < moment)) QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY priority DESC, job) = 1""")
def claim(s: Source) -> DataFrame:
    """The job that each tenant's next worker would get: highest priority, then lowest id; a grouped minimum, so a large queue meets no window."""
    at = s.table("orders").agg(F.max(C("o_orderdate").cast("timestamp")).alias("at"))
    j = claimable(jobs(s).join(F.broadcast(at)), C("at"))  # one row
    best = j.groupBy("tenant").agg(F.min(F.struct((-C("priority")).alias("p"), "job", "attempts")).alias("r"))
    return best.select("tenant", C("r.job").alias("job"), (-C("r.p")).alias("priority"), (C("r.attempts") + 1).alias("attempt"))


@query("stm3_lease_renewal", ", t AS (SELECT user_id, created_at, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, attempt_id) AS before FROM attempts) SELECT user_id, count(*) FILTER (WHERE created_at - before <= INTERVAL 100 SECOND) AS renewed, count(*) FILTER (WHERE created_at - before > INTERVAL 100 SECOND AND created_at - before <= INTERVAL 300 SECOND) AS late, count(*) FILTER (WHERE created_at - before > INTERVAL 300 SECOND) AS lost FROM t GROUP BY user_id")
def renewals(s: Source) -> DataFrame:
    """Beats of a lease of 300 seconds: due within a third of it, late up to all of it, lost beyond."""
    w = W.partitionBy("user_id").orderBy("created_at", "attempt_id")
    t = s.attempts().withColumn("gap", F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(w)))
    late = (C("gap") > 100_000_000) & (C("gap") <= 300_000_000)
    return t.groupBy("user_id").agg(F.count_if(C("gap") <= 100_000_000).alias("renewed"), F.count_if(late).alias("late"), F.count_if(C("gap") > 300_000_000).alias("lost"))


def call_health(calls: DataFrame, key: str, recent: int = 20, slow_ms: int = 60_000, least: int = 10, minutes: int = 5, throttles: int = 3) -> DataFrame:
    """Of each call (key, attempt_id, created_at, is_correct, duration_ms): the nearest-rank 75th percentile of the key's last `recent` good calls, itself included;
    whether that allows more concurrency (`least` good calls, percentile under slow_ms); throttled calls in the minutes up to it, and whether they trip the breaker."""
    past = W.partitionBy(key).orderBy("attempt_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    good = calls.where("is_correct = 1")
    v = F.sort_array(F.collect_list("duration_ms").over(W.partitionBy(key).orderBy("attempt_id").rowsBetween(-(recent - 1), W.currentRow)))
    fast = good.select("attempt_id", F.count("*").over(past).alias("n"), F.element_at(v, F.floor((3 * F.size(v) + 3) / 4).cast("int")).alias("p75"))
    span = W.partitionBy(key).orderBy("t").rangeBetween(-minutes * 60_000_000, W.currentRow)
    slow = calls.where("is_correct = 0").withColumn("t", F.unix_micros("created_at")).select("attempt_id", F.count("*").over(span).alias("throttled"))
    j = calls.select(key, "attempt_id").join(fast, "attempt_id", "left").join(slow, "attempt_id", "left")
    return j.select(key, "attempt_id", "p75", F.coalesce((C("n") >= least) & (C("p75") < slow_ms), F.lit(False)).alias("may_raise"), F.coalesce("throttled", F.lit(0)).alias("throttled"), F.coalesce(C("throttled") >= throttles, F.lit(False)).alias("breaks"))


@query("stm5_call_health", """, g AS (SELECT attempt_id, row_number() OVER (PARTITION BY user_id ORDER BY attempt_id) AS n, list_sort(list(duration_ms) OVER (PARTITION BY user_id ORDER BY attempt_id ROWS 19 PRECEDING)) AS v FROM attempts WHERE is_correct = 1),
    b AS (SELECT attempt_id, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) AS throttled FROM attempts WHERE is_correct = 0)
    SELECT user_id, attempt_id, v[(3 * len(v) + 3) // 4] AS p75, coalesce(n >= 10 AND v[(3 * len(v) + 3) // 4] < 60000, FALSE) AS may_raise, coalesce(throttled, 0) AS throttled, coalesce(throttled >= 3, FALSE) AS breaks FROM attempts LEFT JOIN g USING (attempt_id) LEFT JOIN b USING (attempt_id)""")
def health(s: Source) -> DataFrame:
    return call_health(s.attempts(), "user_id")


@query("dat3_queue_wait", ", t AS (SELECT attempt_id, created_at, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, attempt_id) AS before FROM attempts) SELECT attempt_id, CAST(floor((epoch_us(created_at) - epoch_us(before)) / 1000) AS BIGINT) AS wait_ms FROM t WHERE before IS NOT NULL")
def waits(s: Source) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("created_at", "attempt_id")
    return s.attempts().withColumn("b", F.lag("created_at").over(w)).where("b is not null").select("attempt_id", millis_between(C("b"), C("created_at")).cast("long").alias("wait_ms"))
