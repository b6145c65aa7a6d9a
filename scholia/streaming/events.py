"""Event streams: cursor tails, daily rollups with a watermark, idempotent and guarded consumption.

The reference model has no event time; here the daily rollup has a watermark of one day and its closed days equal the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from scholia.adapters import Source
from scholia.operators import windows
from scholia.registry import query
from scholia.session import scratch

C = F.col


def run_once(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Consume what a stream has now into a table of the shared folder, with its checkpoint beside it, and read that. Called again with the
    same folder it goes on where it stopped, with the state it had."""
    spark = stream.sparkSession
    at = at or scratch(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def event_stream(s: Source) -> DataFrame:
    return s.spark.readStream.schema(s.table("events").schema).parquet(f"{s.path}/events.parquet*")


@query("stm1_snk4_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def tail(s: Source) -> DataFrame:
    """Events past a cursor, as the stream brings them."""
    return run_once(event_stream(s).where("event_id > 500").select("event_id", "user_id", "event_type"))


@query("stm8_daily_rollup", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS stat_date, user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY ALL""")
def rollup(s: Source) -> DataFrame:
    """Closed days only: those that the watermark, one day behind the latest event, has passed."""
    e = event_stream(s).withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", "1 day")
    days = e.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return run_once(days.select(F.to_date("w.start").cast("string").alias("stat_date"), "user_id", "n"))


def once(events: DataFrame, keys: list[str], within: str = "30 days") -> DataFrame:
    """The first event of each key, however often it comes within a time; a key that stays away longer than that is forgotten, which bounds the state."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


@query("stm6_idempotent", "SELECT DISTINCT user_id, event_type FROM events")
def idempotent(s: Source) -> DataFrame:
    """One run for each input key."""
    return run_once(once(timed(event_stream(s)), ["user_id", "event_type"]).select("user_id", "event_type"))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", C("ts").cast("timestamp"))


def by_user(events: DataFrame, step: Callable[[list, pd.DataFrame], tuple[list, pd.DataFrame]], start: list, state: str, out: str, idle: str = "30 days") -> DataFrame:
    """Each user's events in order of event_id through a state: step(state, rows) gives the next state and a row for each event that says something.

    A trigger brings a user's new events only; the state lives in the checkpoint and survives restarts. A user idle for longer than `idle` behind the watermark is forgotten. Events
    (user_id, event_id, event_type, ts) of one trigger are ordered; one that comes a trigger late is taken as it comes."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values("event_id")
        now, said = step(list(held.get) if held.exists else list(start), rows)
        held.update(tuple(now))
        held.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + wait)
        if len(said):
            yield said

    slim = events.withWatermark("ts", idle).select("user_id", "event_id", "event_type", "ts")
    return slim.groupBy("user_id").applyInPandasWithState(run, out, state, "append", "EventTimeTimeout")


@query("stm4_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events""")
def rate(s: Source) -> DataFrame:
    e = s.table("events").withColumn("ts", C("ts").cast("timestamp"))
    return windows.trailing_count(e, ["user_id"], "ts", 3600, "n").select("event_id", "n")


def guarded(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, verdict) for each event: a run's first terminal event ends it, what comes after is ignored, what came before counts."""

    def step(state: list, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        ended = state[0]
        final = rows.loc[rows["event_type"].isin(["purchase", "error"]), "event_id"]
        end = ended if ended >= 0 else int(final.iloc[0]) if len(final) else -1
        verdict = rows["event_id"].map(lambda i: "counts" if end < 0 or ended < 0 and i < end else "ends" if i == end and ended < 0 else "ignored")
        return [end], rows[["user_id", "event_id", "event_type"]].assign(verdict=verdict)

    return by_user(events, step, [-1], "ended long", "user_id long, event_id long, event_type string, verdict string")


@query("stm12_terminal_guard", """, t AS (SELECT user_id, arg_min(event_type, event_id) AS state, min(event_id) AS ended_by FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
    SELECT t.user_id, state, ended_by, count(*) FILTER (WHERE e.event_id > ended_by) AS ignored FROM t JOIN events e USING (user_id) GROUP BY ALL""")
def guard(s: Source) -> DataFrame:
    """The first terminal event of a run stands; whatever comes after changes nothing."""
    g = run_once(guarded(timed(event_stream(s)))).groupBy("user_id")
    ends = C("verdict") == "ends"
    return g.agg(F.max(F.when(ends, C("event_type"))).alias("state"), F.max(F.when(ends, C("event_id"))).alias("ended_by"), F.count_if(C("verdict") == "ignored").alias("ignored")).where("ended_by is not null")


@query("stm7_stm13_active_run", """, r AS (SELECT o_custkey AS session_id, o_orderkey AS run_id, o_orderstatus <> 'F' AS live FROM orders), t AS (SELECT session_id, max(run_id) FILTER (WHERE live) AS active, min(run_id) FILTER (WHERE live) AS first FROM r GROUP BY session_id)
    SELECT session_id, run_id, CASE WHEN NOT live THEN 'ended' WHEN run_id = active THEN 'active' ELSE 'superseded' END AS state, live AND run_id > first AS claim_refused FROM r JOIN t USING (session_id)""")
def active(s: Source) -> DataFrame:
    """Of a session's live runs the newest is active and those before are superseded; a claim is refused while an earlier live run stands."""
    r = s.table("orders").select(C("o_custkey").alias("session_id"), C("o_orderkey").alias("run_id"), (C("o_orderstatus") != "F").alias("live"))
    live = F.when(C("live"), C("run_id"))
    t = r.groupBy("session_id").agg(F.max(live).alias("active"), F.min(live).alias("first"))
    state = F.when(~C("live"), "ended").when(C("run_id") == C("active"), "active").otherwise("superseded")
    return r.join(t, "session_id").select("session_id", "run_id", state.alias("state"), (C("live") & (C("run_id") > C("first"))).alias("claim_refused"))


@query("stm11_attachments", """, c AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ended FROM events), a AS (SELECT *, row_number() OVER w AS revision, lag(ended) OVER w AS before FROM c WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, CAST(revision AS INTEGER) AS revision, CAST(sum(CASE WHEN before IS NULL OR before < ended THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run, CASE WHEN revision = 1 THEN 'initial' ELSE 'incremental' END AS run_type FROM a""")
def attachments(s: Source) -> DataFrame:
    """Attachments are purchases here, and errors end a run."""
    return run_once(coalesced(timed(event_stream(s))))


def coalesced(events: DataFrame) -> DataFrame:
    """(event_id, revision, run, run_type) for each attachment: it raises its user's revision and joins the running run, or opens one if that has
    ended since the attachment before."""

    def step(state: list, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        revision, run, open_ = state
        out = []
        for event, kind in zip(rows["event_id"].tolist(), rows["event_type"]):
            if kind == "error":
                open_ = False
            elif kind == "purchase":
                revision, run, open_ = revision + 1, run + (not open_), True
                out.append((event, revision, run, "initial" if revision == 1 else "incremental"))
        return [revision, run, open_], pd.DataFrame(out, columns=["event_id", "revision", "run", "run_type"])

    return by_user(events, step, [0, 0, False], "revision int, run long, open boolean", "event_id long, revision int, run long, run_type string")


@query("stm10_archive", """, dead AS (SELECT p_partkey AS k FROM part WHERE p_size % 6 = 2) SELECT 'job' AS kind, event_id AS id FROM events WHERE CAST(props->>'$.k' AS BIGINT) IN (SELECT k FROM dead)
    UNION ALL SELECT 'unit', l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_partkey IN (SELECT k FROM dead) UNION ALL SELECT DISTINCT 'run', l_orderkey FROM lineitem WHERE l_partkey IN (SELECT k FROM dead)""")
def archive(s: Source) -> DataFrame:
    """All that an archived session cancels: jobs whose JSON payload points at it, its units, and the runs that hold them."""
    dead = s.table("part").where("p_size % 6 = 2").select(C("p_partkey").alias("k"))
    jobs = s.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).join(dead, "k", "left_semi").select(F.lit("job").alias("kind"), C("event_id").alias("id"))
    units = s.table("lineitem").withColumn("k", C("l_partkey")).join(dead, "k", "left_semi")
    runs = units.select(F.lit("run").alias("kind"), C("l_orderkey").alias("id")).distinct()
    return jobs.unionByName(units.select(F.lit("unit").alias("kind"), (C("l_orderkey") * 8 + C("l_linenumber")).alias("id"))).unionByName(runs)
