"""Curve queries: robust fits, back-tests, gates, forecasts and alerts on daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import curve as V, series as S
from tidemark.plans.measurement import MAD_SQL, TREND_SQL, USER_DAILY_SQL, X_SQL, user_daily
from tidemark.plans.registry import query

KEY = ["participant_id"]
SHIP_AS_OF = "2001-11-05 00:00:00"


def r(c, n=6):
    return F.round(c, n)


def supplier_daily(t):
    """One year of daily quantities per supplier: the sum policy on a looked-back scan."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("participant_id"), F.col("l_shipdate").alias("ts"), F.lit("quantity").alias("metric"), F.col("l_quantity").alias("value"))
    return S.daily(S.lookback(rows, SHIP_AS_OF, 365), ["participant_id", "metric"], {"quantity": "sum"}).drop("metric")


SUPPLIER_SQL = f"(SELECT l_suppkey AS participant_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SHIP_AS_OF}' - INTERVAL 365 DAY AND l_shipdate <= TIMESTAMP '{SHIP_AS_OF}' GROUP BY 1,2)"


@query("src1_long_series", f"SELECT participant_id, CAST(day AS VARCHAR) AS day, v FROM {SUPPLIER_SQL} s")
def long_series(t):
    return supplier_daily(t).select("participant_id", F.col("day").cast("string").alias("day"), "v")


def packs(t):
    return V.packed(V.clean_series(user_daily(t), KEY), KEY)


@query("ts3_huber_trend", None)
def ts3(t):
    return V.fitted(packs(t)).select("participant_id", r("slope").alias("slope"), r("intercept").alias("intercept"), r("recent_slope").alias("recent_slope"), r("resid_std").alias("resid_std"))


@query("ts4_robust_local_smoother", None)
def ts4(t):
    return V.smoothed_rows(packs(t), KEY).withColumn("smooth", r("smooth"))


def future_of(t, model):
    rows = V.fitted(packs(t)).select("participant_id", "last_day", F.explode("future").alias("f")).filter(F.col("f.model") == model)
    return rows.select("participant_id", "last_day", F.posexplode("f.predicted").alias("i", "predicted")).select(
        "participant_id", F.date_add("last_day", F.col("i") + 1).alias("day"), r("predicted").alias("predicted")
    )


@query("ts5_damped_forecast", None)
def ts5(t):
    return future_of(t, "damped")


@query("ts6_state_filter_forecast", None)
def ts6(t):
    return future_of(t, "state_space_local_linear")


@query("ts8_backtest_selection", None)
def ts8(t):
    rows = V.scored(V.fitted(V.packed(V.clean_series(supplier_daily(t), KEY), KEY)))
    return rows.select("participant_id", "selected", "best.n", "best.mae", "best.rmse", "best.bias", "best.mase", "best.q80_in_sample", F.explode("scores").alias("s")).select(
        "participant_id", "selected", "mae", "mase", F.col("s.model").alias("candidate"), F.col("s.mase").alias("candidate_mase"), F.col("s.rmse").alias("candidate_rmse")
    )


def analysis(t, requested=30):
    daily = supplier_daily(t)
    return V.analysed_all(daily, V.clean_series(daily, KEY), KEY, requested, low=0.0, high=400.0)


@query("ts11_curve_analysis", None)
def ts11(t):
    return analysis(t).select(
        "participant_id", "status", "n_days", "span_days", "long_term_trend", "recent_trend", "trend_strength", "fluctuation", "selected",
        F.col("best.mase").alias("mase"), "available", "horizon", "reason", "crosses_bound",
    )


@query("ts11_forecast_points", None)
def ts11_points(t):
    daily = user_daily(t)
    rows = V.analysed_all(daily, V.clean_series(daily, KEY), KEY, 7)
    return rows.select("participant_id", "status", "selected", "horizon", F.explode_outer("forecast").alias("p")).select("participant_id", "status", "selected", "horizon", "p.*")


GATE = """CASE WHEN n_days>=84 AND span_days>=90 THEN 30 WHEN n_days>=42 AND span_days>=56 THEN 14 WHEN n_days>=21 AND span_days>=28 THEN 7 ELSE 0 END"""


@query(
    "ts10_eligibility_gates",
    f"""SELECT participant_id, least({GATE},14) AS horizon, nullif(array_to_string(list_filter([CASE WHEN n_days<7 THEN 'valid days '||n_days||'/7' END, CASE WHEN span_days<14 THEN 'span '||CAST(span_days AS BIGINT)||'/14 days' END,
         CASE WHEN fluctuation='high' THEN 'fluctuation too high' END], lambda x: x IS NOT NULL),'; '),'') AS reason FROM {TREND_SQL} t""",
)
def ts10(t):
    f = S.ols_trend(user_daily(t), KEY)
    n, span = F.col("n_days"), F.col("span_days")
    return f.select("participant_id", V.gate_horizon(n, span, 14).alias("horizon"), V.refusal(n, span, F.col("fluctuation"), F.lit(True), F.lit(False), 14).alias("reason"))


FOLDS = f"""(SELECT o.participant_id, CAST(o.day AS VARCHAR) AS origin, CAST(f.x-o.x AS INTEGER) AS lead, o.v AS predicted, f.v AS actual FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY participant_id) AS n, CAST(day - min(day) OVER (PARTITION BY participant_id) AS DOUBLE) AS x FROM {USER_DAILY_SQL} u) o
   JOIN (SELECT *, CAST(day - min(day) OVER (PARTITION BY participant_id) AS DOUBLE) AS x FROM {USER_DAILY_SQL} u2) f ON f.participant_id=o.participant_id AND f.x>o.x AND f.x<=o.x+7 WHERE o.rn>=greatest(8,ceil(o.n*0.45)) AND o.rn<o.n)"""


@query("win8_rolling_origin_folds", f"SELECT participant_id, origin, lead, round(predicted,6) AS predicted, round(actual,6) AS actual FROM {FOLDS} f")
def win8(t):
    folds = V.naive_folds(user_daily(t), KEY)
    return folds.select("participant_id", F.col("origin").cast("string").alias("origin"), "lead", r("predicted").alias("predicted"), r("actual").alias("actual"))


@query(
    "ts12_forecast_quality",
    f"""SELECT participant_id, round(mae/sc,4) AS mase, CASE WHEN mae/sc<0.8 THEN 'good' WHEN mae/sc<1 THEN 'reference' ELSE 'baseline' END AS quality FROM (SELECT participant_id, avg(abs(actual-predicted)) AS mae FROM {FOLDS} f GROUP BY 1) a
        JOIN (SELECT participant_id, median(d) AS sc FROM (SELECT participant_id, abs(v-lag(v) OVER (PARTITION BY participant_id ORDER BY day)) AS d FROM {USER_DAILY_SQL} u) y GROUP BY 1) b USING(participant_id)""",
)
def ts12(t):
    series = user_daily(t)
    errors = V.naive_folds(series, KEY).groupBy(*KEY).agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    mase = F.col("mae") / F.col("median_step")
    return errors.join(S.step_scale(series, KEY), KEY).select("participant_id", r(mase, 4).alias("mase"), V.quality_class(mase, F.lit(True)).alias("quality"))


@query(
    "ts14_alert_rule",
    f"""SELECT participant_id, rule, 'series: '||CASE WHEN rule='abnormal_spike' THEN 'abnormal reading' ELSE CASE WHEN direction='falling' THEN 'falling' ELSE 'rising' END||' trend' END AS title FROM (
        SELECT participant_id, direction, CASE WHEN spike THEN 'abnormal_spike' WHEN strength='strong' AND (direction IN ('rising','falling') OR rs<>0) THEN 'strong_trend' END AS rule FROM {TREND_SQL} t
        JOIN (SELECT participant_id, bool_or(usable AND abs(v-med)>=4.0*mad) AS spike FROM {MAD_SQL} q GROUP BY 1) s USING(participant_id)
        JOIN (SELECT participant_id, regr_slope(v,x) AS rs FROM (SELECT participant_id, v, CAST(day - min(day) OVER (PARTITION BY participant_id) AS DOUBLE) AS x, row_number() OVER (PARTITION BY participant_id ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY participant_id) AS n FROM {USER_DAILY_SQL} u) z WHERE rn<=greatest(3,ceil(n*0.3)) GROUP BY 1) w USING(participant_id)) k WHERE rule IS NOT NULL""",
)
def ts14(t):
    series = user_daily(t)
    spikes = S.mad_clean(series, KEY).groupBy(*KEY).agg(F.bool_or("spike").alias("spike"))
    joined = S.ols_trend(series, KEY).join(spikes, KEY).join(S.recent_slope(series, KEY), KEY)
    recent = F.when(F.col("recent_slope") > 0, "rising").when(F.col("recent_slope") < 0, "falling").otherwise("stable")
    rule = V.alert_rule(F.col("spike"), F.col("strength"), F.col("direction"), recent, F.lit(False))
    named = joined.withColumn("rule", rule).filter("rule is not null")
    return named.select("participant_id", "rule", V.alert_title(F.lit("series"), F.col("rule"), F.col("direction")).alias("title"))


WINDOWS = f"""(SELECT o.participant_id, o.day AS origin, o.rn AS history, a.day, o.v AS predicted, a.v AS actual FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day) AS rn FROM {USER_DAILY_SQL} u) o
   JOIN {USER_DAILY_SQL} a ON a.participant_id=o.participant_id AND a.day>o.day AND a.day<=o.day+7 WHERE o.rn>=10 AND (o.rn-10)%7=0)"""


@query("jn10_forecast_alignment", f"SELECT participant_id, CAST(origin AS VARCHAR) AS origin, CAST(day AS VARCHAR) AS day, round(predicted,6) AS predicted, round(actual,6) AS actual FROM {WINDOWS} w")
def jn10(t):
    series = user_daily(t)
    rows = V.aligned(V.forecast_windows(series, KEY, 10, 7), series, KEY)
    return rows.select("participant_id", F.col("origin").cast("string").alias("origin"), F.col("day").cast("string").alias("day"), r("predicted").alias("predicted"), r("actual").alias("actual"))


@query(
    "ag49_macro_window_average",
    f"""SELECT count(*) AS attempts, count(*) FILTER (history<17) AS refused, round(count(*) FILTER (history<17)/count(*),6) AS refusal_rate, round(avg(mae) FILTER (history>=17),5) AS mae, round(avg(rmse) FILTER (history>=17),5) AS rmse
        FROM (SELECT participant_id, origin, any_value(history) AS history, avg(abs(actual-predicted)) AS mae, sqrt(avg((actual-predicted)*(actual-predicted))) AS rmse FROM {WINDOWS} w GROUP BY ALL) x""",
)
def ag49(t):
    """Per-window errors first, then their plain average; windows with too little history are refused."""
    series = user_daily(t)
    e = F.col("actual") - F.col("predicted")
    per = V.aligned(V.forecast_windows(series, KEY, 10, 7), series, KEY).groupBy(*KEY, "origin").agg(
        F.first("history").alias("history"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )
    ok = F.col("history") >= 17
    return per.agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(~ok).alias("refused"), r(F.count_if(~ok) / F.count(F.lit(1))).alias("refusal_rate"),
        r(F.avg(F.when(ok, F.col("mae"))), 5).alias("mae"), r(F.avg(F.when(ok, F.col("rmse"))), 5).alias("rmse"),
    )
