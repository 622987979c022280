"""Streaming queries: each reads the event table as a stream and returns the resulting table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import curve as V, govern as G, series as S, skew
from tidemark.plans import measurement as M
from tidemark.plans.governance import FOLLOWUP_SQL, followup_plans
from tidemark.plans.registry import query
from tidemark.session import fresh_path
from tidemark.sources.views import SCHEMAS, measurement_rows
from tidemark.streaming import ingest as I
from tidemark.streaming.suppress import keep_first_stream


def r(c, n=6):
    return F.round(c, n)


def whole(t):
    """The event table as a stream; rows come in the table's order, which is not that of time."""
    return measurement_rows(I.event_stream(t.spark, t.sf_dir, SCHEMAS["events"], glob="events.parquet"))


def spaces(t, *names):
    return [fresh_path(t.spark, n) for n in names]


@query("st1_ingest_routing", f"SELECT CASE WHEN len(flags)=0 THEN 'valid' ELSE 'quarantine' END AS route, mtype, count(*) AS n FROM {M.FLAGS_SQL} f GROUP BY ALL")
def st1(t):
    good, bad, mark = spaces(t, "valid", "quarantine", "checkpoint")
    kinds = F.array(*[F.lit(x) for x in ("bp", "glucose", "hr", "other")])
    rows = whole(t).withColumn("mtype", F.element_at(kinds, (F.col("measurement_id") % 4 + 1).cast("int"))).withColumn(
        "value2", F.when(F.col("k") % 7 != 0, (F.col("k") * 2).cast("double"))
    )
    joined = rows.join(M.definitions(t), "mtype", "left")
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    flagged = joined.withColumn("flags", C.quality_flags("value", "value2", "value_type", "min_value", "max_value", "ts", now))
    I.run_batches(flagged, I.split_sink(good, bad), mark)
    both = t.spark.read.parquet(good).select(F.lit("valid").alias("route"), "mtype").unionByName(t.spark.read.parquet(bad).select(F.lit("quarantine").alias("route"), "mtype"))
    return both.groupBy("route", "mtype").agg(F.count(F.lit(1)).alias("n"))


@query("st2_duplicate_suppression", M.keep_first_sql(M.DUP_SQL, M.DUP_KEYS, 4 * 3600 * 1000000))
def st2(t):
    out, mark = spaces(t, "kept", "checkpoint")
    rows = whole(t).select(
        "participant_id", "metric", F.floor(F.col("value") / 50).alias("value"), F.when(F.col("k") % 2 == 0, F.col("k") % 4).alias("value2"), "ts", "measurement_id"
    )
    kept = keep_first_stream(rows, M.DUP_KEYS, 4 * 3600, 7 * 86400, out, mark)
    return kept.select(*M.DUP_KEYS, "kept_us", "measurement_id")


@query("st4_alert_suppression", M.keep_first_sql(M.ALERT_SQL, ["participant_id", "metric", "title"], 86400 * 1000000))
def st4(t):
    out, mark = spaces(t, "alerts", "checkpoint")
    v, keys = F.col("value"), ["participant_id", "metric", "title"]
    rows = whole(t).select("participant_id", "metric", F.when(v >= 100, "very high").when(v >= 50, "high").otherwise("low").alias("title"), "ts", "measurement_id")
    return keep_first_stream(rows, keys, 86400, 30 * 86400, out, mark).select(*keys, "kept_us", "measurement_id")


@query("st5_daily_tumbling", "SELECT participant_id, metric, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value),4) AS total, count(*) AS n FROM {measurements} m GROUP BY participant_id, metric, CAST(ts AS DATE)")
def st5(t):
    out, mark = spaces(t, "daily", "checkpoint")
    state = I.daily_stream(whole(t), M.KEY, out, mark)
    return state.select(*M.KEY, F.col("day").cast("string").alias("day"), r("total", 4).alias("total"), "n")


@query("st5_daily_median", f"SELECT participant_id, CAST(day AS VARCHAR) AS day, round(v,6) AS v FROM {M.USER_DAILY_SQL} u")
def st5_median(t):
    """Medians are recomputed for the touched days only."""
    history, out, mark = spaces(t, "history", "medians", "checkpoint")
    rows = whole(t).select("participant_id", "ts", "value", F.to_date("ts").alias("day"))
    I.run_batches(rows, I.recompute_touched(history, out, ["participant_id", "day"], lambda h: S.daily(h, ["participant_id"])), mark)
    state = G.newest_state(t.spark.read.parquet(out), ["participant_id", "day"], ["batch"], ["v"])
    return state.select("participant_id", F.col("day").cast("string").alias("day"), r("v").alias("v"))


@query("st3_trend_trigger", None)
def st3(t):
    """New non-synthetic readings trigger the curve analysis of the touched participants on their 90-day history."""
    history, out, mark = spaces(t, "history", "curves", "checkpoint")
    rows = whole(t).filter("source <> 'synthetic'").select("participant_id", "ts", "value")

    def analyse(h):
        ends = h.groupBy("participant_id").agg(F.max("ts").alias("_end"))
        recent = skew.salted_join(h, ends, ["participant_id"], ["ts"], "inner", 8).filter(F.col("ts") >= F.col("_end") - F.expr("INTERVAL 90 DAYS")).drop("_end")
        packed = V.packed(V.clean_series(S.daily(recent, ["participant_id"]), ["participant_id"]), ["participant_id"])
        return V.analysed(packed, ["participant_id"], 7).select("participant_id", "n_days", "long_term_trend", "trend_strength", "selected", "available")

    I.run_batches(rows, I.recompute_touched(history, out, ["participant_id"], analyse), mark)
    return G.newest_state(t.spark.read.parquet(out), ["participant_id"], ["batch"], ["n_days", "long_term_trend", "trend_strength", "selected", "available"])


@query("st6_device_sync_status", "SELECT participant_id, arg_max(metric,(ts,measurement_id)) AS last_event, epoch_us(max(ts)) AS synced_us, arg_max(k,(ts,measurement_id)) AS battery FROM {measurements} m GROUP BY 1")
def st6(t):
    """Latest state per device; each batch contributes its own newest row and the newest of those is the state."""
    out, mark = spaces(t, "devices", "checkpoint")
    keep = ["ts", "measurement_id", "metric", "k"]
    newest = lambda rows: G.newest_state(rows, ["participant_id"], ["ts", "measurement_id"], keep)
    I.run_batches(whole(t).select("participant_id", *keep), I.batch_writer(out, newest), mark)
    state = G.newest_state(t.spark.read.parquet(out), ["participant_id"], ["ts", "measurement_id"], keep)
    return state.select("participant_id", F.col("metric").alias("last_event"), F.unix_micros("ts").alias("synced_us"), F.col("k").alias("battery"))


@query("st7_future_and_late_policy", "SELECT CASE WHEN ts > TIMESTAMP '2024-01-28' + INTERVAL 5 MINUTE THEN 'rejected' WHEN ts < TIMESTAMP '2024-01-03' - INTERVAL 1 DAY THEN 'backfill' ELSE 'live' END AS route, count(*) AS n FROM {measurements} m GROUP BY 1")
def st7(t):
    out, mark = spaces(t, "routes", "checkpoint")
    now, high = F.lit("2024-01-28 00:00:00").cast("timestamp"), F.lit("2024-01-03 00:00:00").cast("timestamp")
    I.run_batches(I.time_policy(whole(t), now, high, 86400).select("measurement_id", "route"), I.batch_writer(out), mark)
    return t.spark.read.parquet(out).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("st8_followup_stream", FOLLOWUP_SQL)
def st8_stream(t):
    """The stream form of st8_followup_closure: due follow-ups and readings are two streams."""
    out, mark = spaces(t, "followups", "checkpoint")
    plans = followup_plans(I.event_stream(t.spark, t.sf_dir, SCHEMAS["orders"], glob="orders.parquet"))
    state = I.followup_stream(plans, whole(t).select("participant_id", "ts"), ["participant_id"], 7, out, mark)
    return state.select("followup_id", "status", F.col("closed_day").cast("string").alias("closed_day"))
