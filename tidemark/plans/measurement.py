"""Scans, cleaning and series queries on the measurement view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import cleaning as C
from tidemark.functions.text import bind
from tidemark.operators import keepfirst, series as S, skew
from tidemark.operators.trailing import trailing_features
from tidemark.plans.registry import query
from tidemark.sources.views import AS_OF

KEY = ["participant_id", "metric"]
# study bounds of the five fixture metrics (metric, lo, hi)
BOUNDS = [("view", 1.0, 400.0), ("click", 2.0, 300.0), ("purchase", 5.0, 250.0), ("signup", 0.5, 350.0), ("error", 0.0, 200.0)]
BOUNDS_SQL = "(VALUES " + ",".join(f"('{m}',{lo},{hi})" for m, lo, hi in BOUNDS) + ") AS b(metric,lo,hi)"
POLICY = {"purchase": "sum", "signup": "mean"}


def r(c, n=6):
    return F.round(c, n)


def bounds(t):
    return t.spark.createDataFrame(BOUNDS, "metric string, lo double, hi double")


DAILY_SQL = """(SELECT participant_id, metric, CAST(ts AS DATE) AS day,
    CASE WHEN metric='purchase' THEN sum(value) WHEN metric='signup' THEN avg(value) ELSE median(value) END AS v
    FROM {measurements} m0 GROUP BY participant_id, metric, CAST(ts AS DATE))"""
USER_DAILY_SQL = "(SELECT participant_id, CAST(ts AS DATE) AS day, median(value) AS v FROM {measurements} m0 GROUP BY ALL)"


def daily(t):
    return S.daily(t.measurements, KEY, POLICY)


def user_daily(t):
    return S.daily(t.measurements, ["participant_id"])


@query(
    "metric_trend",
    f"""WITH m AS (SELECT m.* FROM {{measurements}} m JOIN {BOUNDS_SQL} USING(metric)
          WHERE value BETWEEN lo AND hi AND ts >= {{as_of}} - INTERVAL 30 DAY AND ts <= {{as_of}}),
        s AS (SELECT participant_id, metric, round(avg(value),6) AS avg_value, min(value) AS min_value,
                max(value) AS max_value, count(*) AS n, arg_max(value, (ts, measurement_id)) AS latest_value,
                avg(value) FILTER (ts >= {{as_of}} - INTERVAL 7 DAY) AS rm, avg(value) FILTER (ts < {{as_of}} - INTERVAL 7 DAY) AS bm
              FROM m GROUP BY ALL),
        p AS (SELECT *, round(CASE WHEN bm=0 THEN NULL ELSE (rm-bm)/bm END*100,1) AS trend_pct FROM s)
        SELECT participant_id, metric, avg_value, min_value, max_value, n, latest_value, trend_pct,
          CASE WHEN trend_pct IS NULL OR abs(trend_pct)<3 THEN 'stable' WHEN trend_pct>0 THEN 'up' ELSE 'down' END AS trend
        FROM p""",
)
def metric_trend(t):
    """Thirty-day statistics, latest value and recent-versus-baseline trend in a single aggregate pass."""
    rows = S.within_bounds(S.lookback(t.measurements, AS_OF, 30), bounds(t))
    cut = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    agg = rows.groupBy(*KEY).agg(
        r(F.avg("value")).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count("value").alias("n"), F.max(F.struct("ts", "measurement_id", "value"))["value"].alias("latest_value"),
        F.avg(F.when(F.col("ts") >= cut, F.col("value"))).alias("rm"),
        F.avg(F.when(F.col("ts") < cut, F.col("value"))).alias("bm"),
    )
    pct = r(F.try_divide(F.col("rm") - F.col("bm"), F.col("bm")) * 100, 1)
    trend = F.when(pct.isNull() | (F.abs(pct) < 3), "stable").when(pct > 0, "up").otherwise("down")
    return agg.select(*KEY, "avg_value", "min_value", "max_value", "n", "latest_value", pct.alias("trend_pct"), trend.alias("trend"))


@query(
    "src1_lookback_scan",
    """SELECT participant_id, metric, count(*) AS n, round(sum(value),4) AS total, epoch_us(min(ts)) AS first_us
       FROM {measurements} m WHERE ts >= {as_of} - INTERVAL 10 DAY AND ts <= {as_of} GROUP BY ALL""",
)
def src1(t):
    return S.lookback(t.measurements, AS_OF, 10).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"), F.unix_micros(F.min("ts")).alias("first_us")
    )


@query(
    "prj1_tolerant_coercion",
    """SELECT measurement_id, TRY_CAST(raw AS DOUBLE) AS number, raw FROM (
         SELECT measurement_id, CASE WHEN k % 9 = 0 THEN 'n/a' WHEN k % 9 = 1 THEN '' ELSE CAST(k AS VARCHAR) || '.5' END AS raw
         FROM {measurements} m) x""",
)
def prj1(t):
    raw = F.when(F.col("k") % 9 == 0, "n/a").when(F.col("k") % 9 == 1, "").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5")))
    return t.measurements.select("measurement_id", raw.alias("raw")).select("measurement_id", C.to_number("raw").alias("number"), "raw")


@query(
    "prj2_range_to_null",
    """SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 50000 AND 400000 THEN o_totalprice END AS price,
        CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1999 THEN year(o_orderdate) END AS yr FROM orders""",
)
def prj2(t):
    ranges = {"price": (F.col("o_totalprice"), 50000, 400000), "yr": (F.year("o_orderdate").cast("long"), 1996, 1999)}
    return t.orders.select("o_orderkey", *[C.in_range(c, lo, hi).alias(n) for n, (c, lo, hi) in ranges.items()])


@query("prj3_negative_codes_to_null", "SELECT measurement_id, CASE WHEN k-30 >= 0 THEN k-30 END AS code FROM {measurements} m")
def prj3(t):
    coded = t.measurements.select("measurement_id", (F.col("k") - 30).alias("code"))
    return coded.select("measurement_id", C.no_negative_codes("code").alias("code"))


@query(
    "prj4_range_filter",
    f"SELECT measurement_id, metric, value FROM {{measurements}} m JOIN {BOUNDS_SQL} USING(metric) WHERE value BETWEEN lo AND hi",
)
def prj4(t):
    return S.within_bounds(t.measurements, bounds(t)).select("measurement_id", "metric", "value")


@query(
    "prj5_condition_alias",
    """SELECT measurement_id, mtype, CASE
         WHEN c IS NULL THEN 'unknown'
         WHEN mtype='glucose' AND c NOT IN ('fasting','postprandial_2h','random') THEN 'unknown'
         WHEN mtype='hr' AND c NOT IN ('resting','active') THEN 'unknown'
         WHEN mtype='bp' AND c NOT IN ('morning_rest','evening_rest','other') THEN 'unknown' ELSE c END AS condition
       FROM (SELECT measurement_id, mtype, CASE lower(trim(raw)) WHEN '空腹' THEN 'fasting' WHEN 'postprandial' THEN 'postprandial_2h'
           WHEN '随机' THEN 'random' WHEN 'resting' THEN 'resting' WHEN '晨起' THEN 'morning_rest' END AS c
         FROM (SELECT measurement_id, ['glucose','hr','bp','waist'][measurement_id % 4 + 1] AS mtype,
                 ['空腹',' Postprandial ','随机','RESTING','晨起','no such'][k % 6 + 1] AS raw FROM {measurements} m) a) b""",
)
def prj5(t):
    kinds = F.array(*[F.lit(x) for x in ("glucose", "hr", "bp", "waist")])
    raws = F.array(*[F.lit(x) for x in ("空腹", " Postprandial ", "随机", "RESTING", "晨起", "no such")])
    rows = t.measurements.select(
        "measurement_id", F.element_at(kinds, (F.col("measurement_id") % 4 + 1).cast("int")).alias("mtype"),
        F.element_at(raws, F.col("k") % 6 + 1).alias("raw"),
    )
    return rows.select("measurement_id", "mtype", C.normal_condition("mtype", "raw").alias("condition"))


@query(
    "prj6_source_whitelist",
    "SELECT measurement_id, CASE WHEN source IN ('manual','device','synthetic') THEN source ELSE 'manual' END AS source FROM {measurements} m",
)
def prj6(t):
    return t.measurements.select("measurement_id", C.normal_source("source").alias("source"))


DUAL_SQL = """(SELECT measurement_id, participant_id, ts, k, source, condition, ['bp','glucose','hr','other'][measurement_id % 4 + 1] AS mtype,
   value, CASE WHEN k % 7 <> 0 THEN CAST(k*2 AS DOUBLE) END AS value2 FROM {measurements} m0)"""


def dual(t):
    kinds = F.array(*[F.lit(x) for x in ("bp", "glucose", "hr", "other")])
    return t.measurements.select(
        "measurement_id", "participant_id", "ts", "k", "source", "condition",
        F.element_at(kinds, (F.col("measurement_id") % 4 + 1).cast("int")).alias("mtype"), "value",
        F.when(F.col("k") % 7 != 0, (F.col("k") * 2).cast("double")).alias("value2"),
    )


def definitions(t):
    defs = t.spark.createDataFrame(rules.METRICS, rules.METRIC_COLUMNS)
    return F.broadcast(defs.withColumnRenamed("type", "mtype"))


def flagged(t):
    joined = dual(t).join(definitions(t), "mtype", "left")
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return joined.withColumn(
        "flags", C.quality_flags("value", "value2", "value_type", "min_value", "max_value", "ts", now)
    )


FLAGS_SQL = f"""(SELECT *, list_filter([
   CASE WHEN mtype='other' THEN 'unsupported_metric' END,
   CASE WHEN (mtype='bp' AND (value<50 OR value>250)) OR (mtype='glucose' AND (value<1 OR value>33)) OR (mtype='hr' AND (value<20 OR value>220)) THEN 'outside_physical_range' END,
   CASE WHEN mtype='bp' AND value2 IS NULL THEN 'missing_secondary_value' END,
   CASE WHEN mtype='bp' AND (value2<30 OR value2>180) THEN 'secondary_outside_physical_range' END,
   CASE WHEN ts > TIMESTAMP '2024-01-25' + INTERVAL 5 MINUTE THEN 'future_timestamp' END], lambda x: x IS NOT NULL) AS flags FROM {DUAL_SQL} d0)"""


@query("prj7_quality_flags", f"SELECT measurement_id, array_to_string(flags,',') AS flags, len(flags)=0 AS valid FROM {FLAGS_SQL} f")
def prj7(t):
    return flagged(t).select("measurement_id", F.array_join("flags", ",").alias("flags"), (F.size("flags") == 0).alias("valid"))


@query(
    "prj8_quality_struct",
    f"""SELECT measurement_id, len(flags)=0 AS valid, len(flags) AS n_flags, condition <> 'unknown' AS condition_present, source,
        CASE WHEN k%11=0 THEN true WHEN k%11=1 THEN true ELSE len(flags)=0 END AS parsed_valid,
        CASE WHEN k%11=0 THEN '' WHEN k%11=1 THEN 'quality_unparsed' ELSE array_to_string(flags,',') END AS parsed_flags
        FROM {FLAGS_SQL} f""",
)
def prj8(t):
    rows = flagged(t).withColumn("q", C.quality_struct("flags", "source", "condition", "ts"))
    stored = F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 11 == 1, "{broken").otherwise(F.to_json("q"))
    parsed = rows.withColumn("stored", stored).withColumn("p", C.parse_quality("stored"))
    return parsed.select(
        "measurement_id", "q.valid", F.size("q.flags").alias("n_flags"), "q.condition_present", "q.source",
        F.col("p.valid").alias("parsed_valid"), F.array_join("p.flags", ",").alias("parsed_flags"),
    )


@query(
    "prj9_unit_conversion",
    """SELECT measurement_id, round(CASE mtype WHEN 'glucose' THEN value*18.0 WHEN 'cholesterol' THEN value*38.67
        WHEN 'uricacid' THEN value*(1/59.48) WHEN 'creatinine' THEN value*(1/88.4) ELSE value END, 4) AS converted FROM
        (SELECT measurement_id, value, ['glucose','cholesterol','uricacid','creatinine','hr'][k%5+1] AS mtype FROM {measurements} m) x""",
)
def prj9(t):
    kinds = F.array(*[F.lit(x) for x in ("glucose", "cholesterol", "uricacid", "creatinine", "hr")])
    factor = F.coalesce(F.element_at(C.literal_map(rules.UNIT_FACTORS), F.element_at(kinds, F.col("k") % 5 + 1)), F.lit(1.0))
    return t.measurements.select("measurement_id", r(F.col("value") * factor, 4).alias("converted"))


@query(
    "prj10_bmi",
    """SELECT measurement_id, round(value/(height*height),4) AS bmi FROM {measurements} m
       LEFT JOIN {profile} p ON p.id = m.participant_id""",
)
def prj10(t):
    heights = t.profile.select(F.col("id").alias("participant_id"), "height")
    return t.measurements.join(heights, "participant_id", "left").select("measurement_id", C.body_mass_index("value", "height").alias("bmi"))


@query(
    "prj11_egfr",
    """SELECT id, CASE WHEN scr>0 AND age>=18 THEN round(142.0*pow(least(scr/ka,1),al)*pow(greatest(scr/ka,1),-1.2)*pow(0.9938,age)*(CASE WHEN sex=0 THEN 1.012 ELSE 1 END),2) END AS egfr
       FROM (SELECT id, age, sex, (abs(acctbal)/50+20)/88.4 AS scr, CASE WHEN sex=0 THEN 0.7 ELSE 0.9 END AS ka, CASE WHEN sex=0 THEN -0.241 ELSE -0.302 END AS al FROM {profile} p) x""",
)
def prj11(t):
    lab = t.profile.withColumn("creatinine", F.abs("acctbal") / 50 + 20)
    return lab.select("id", C.egfr("creatinine", "age", "sex").alias("egfr"))


@query(
    "prj12_flag_encoding",
    """SELECT id, CASE WHEN sex=1 THEN 1 ELSE 0 END AS sex_code,
        CASE WHEN id%5=0 THEN NULL WHEN id%3=0 OR id%7=0 THEN 1 ELSE 0 END AS chronic FROM {profile} p""",
)
def prj12(t):
    p = t.profile.select(
        "id", F.when(F.col("sex") == 1, " Male").otherwise("女").alias("sex_text"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 3 == 0).cast("int")).alias("a"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 7 == 0).cast("int")).alias("b"),
    )
    return p.select("id", C.sex_code("sex_text").alias("sex_code"), C.any_flag("a", "b").alias("chronic"))


@query(
    "prj13_profile_domain",
    "SELECT id, CASE WHEN age BETWEEN 55 AND 90 THEN age END AS age, CASE WHEN acctbal BETWEEN 0 AND 5000 THEN acctbal END AS exercise, CASE WHEN id%4 IN (0,1) THEN id%4 END AS smoker FROM {profile} p",
)
def prj13(t):
    return t.profile.select(
        "id", C.in_range("age", 55, 90).alias("age"), C.in_range("acctbal", 0, 5000).alias("exercise"),
        C.in_range(F.col("id") % 4, 0, 1).alias("smoker"),
    )


def _segments_sql(value, segments):
    arms = " ".join(
        f"WHEN {value}>={lo}" + ("" if hi == rules.INF else f" AND {value}<{hi}") + f" THEN {s}" for lo, hi, s in segments
    )
    return f"CASE {arms} END"


SCORED = ("bp", "glucose", "hr", "sleep", "weight", "ecg", "resp", "other")
SCORE_SQL = f"""(SELECT measurement_id, participant_id, ts, mtype, value, CASE mtype
   WHEN 'bp' THEN CAST(round({_segments_sql('value', rules.SCORE_SEGMENTS[('bp','sys')])}*0.6 + {_segments_sql('value2', rules.SCORE_SEGMENTS[('bp','dia')])}*0.4) AS INTEGER)
   WHEN 'weight' THEN {_segments_sql('(value/(height*height))', rules.SCORE_SEGMENTS[('weight','bmi')])}
   WHEN 'ecg' THEN CASE WHEN value IN (1,100) THEN 100 ELSE 50 END
   {' '.join(f"WHEN '{m}' THEN {_segments_sql('value', rules.SCORE_SEGMENTS[(m, '')])}" for m in ('glucose', 'hr', 'sleep', 'resp'))} END AS score
   FROM (SELECT measurement_id, participant_id, ts, ['bp','glucose','hr','sleep','weight','ecg','resp','other'][measurement_id % 8 + 1] AS mtype, value,
           CASE WHEN k%7<>0 THEN CAST(k*2 AS DOUBLE) END AS value2, coalesce(height,1.6) AS height
         FROM {{measurements}} m1 LEFT JOIN {{profile}} p1 ON p1.id = m1.participant_id) z)"""


def scored(t):
    kinds = F.array(*[F.lit(x) for x in SCORED])
    heights = t.profile.select(F.col("id").alias("participant_id"), "height")
    rows = t.measurements.join(heights, "participant_id", "left").withColumn(
        "mtype", F.element_at(kinds, (F.col("measurement_id") % 8 + 1).cast("int"))
    ).withColumn("value2", F.when(F.col("k") % 7 != 0, (F.col("k") * 2).cast("double")))
    return rows.withColumn("score", C.metric_score("mtype", "value", "value2", "height"))


@query("prj14_segment_score", f"SELECT measurement_id, mtype, score FROM {SCORE_SQL} s")
def prj14(t):
    return scored(t).select("measurement_id", "mtype", "score")


@query(
    "prj15_pulse_pressure",
    """SELECT record, line, round(least(260.0,greatest(60.0,s)),2) AS high_fit, round(least(150.0,greatest(40.0,d)),2) AS low_fit,
        tight OR least(260.0,greatest(60.0,s))<>s OR least(150.0,greatest(40.0,d))<>d AS adjusted FROM
        (SELECT record, line, high-low<5 AS tight, CASE WHEN high-low<5 THEN (high+low)/2.0+2.5 ELSE high END AS s,
           CASE WHEN high-low<5 THEN (high+low)/2.0-2.5 ELSE low END AS d FROM {paired} p) x""",
)
def prj15(t):
    return t.paired.select("record", "line", *C.pulse_pressure("high", "low"))


@query("prj16_risk_band", "SELECT id, CASE WHEN p>=0.3 THEN 'high' WHEN p>=0.15 THEN 'medium' ELSE 'low' END AS band, CASE WHEN p>=0.15 THEN 'high' WHEN p>=0.05 THEN 'medium' ELSE 'low' END AS fixed_band FROM {pred_risk} r")
def prj16(t):
    fixed = F.when(F.col("p") >= 0.15, "high").when(F.col("p") >= 0.05, "medium").otherwise("low")
    return t.pred_risk.select("id", C.risk_band("p", 0.3).alias("band"), fixed.alias("fixed_band"))


@query(
    "prj17_subgroup_labels",
    """SELECT grp, count(*) AS n, round(avg(acctbal),4) AS mean_balance FROM (SELECT acctbal, unnest(list_filter([
         'age:' || CASE WHEN age<60 THEN '<60' WHEN age<70 THEN '60-69' WHEN age<80 THEN '70-79' ELSE '80+' END,
         'sex:' || CASE WHEN sex=1 THEN 'male' ELSE 'female' END, 'segment:' || segment,
         CASE WHEN acctbal<0 THEN 'debt' END], lambda x: x IS NOT NULL)) AS grp FROM {profile} p) x GROUP BY grp""",
)
def prj17(t):
    labels = F.array_compact(F.array(
        F.concat(F.lit("age:"), C.age_band("age")),
        F.concat(F.lit("sex:"), F.when(F.col("sex") == 1, "male").otherwise("female")),
        F.concat(F.lit("segment:"), F.col("segment")), F.when(F.col("acctbal") < 0, "debt"),
    ))
    return t.profile.select("acctbal", F.explode(labels).alias("grp")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("acctbal"), 4).alias("mean_balance")
    )


FEATURES = ["f_systo", "f_pulse", "f_sleep", "f_srh"]
FEATURE_SQL = """(SELECT id, CASE WHEN id%3<>0 THEN acctbal END AS f_systo, CASE WHEN id%4<>0 THEN age END AS f_pulse,
   CASE WHEN id%5<>0 THEN height END AS f_sleep, CASE WHEN id%2=0 THEN sex END AS f_srh FROM {profile} p0)"""


def features(t):
    i = F.col("id")
    return t.profile.select(
        "id", F.when(i % 3 != 0, F.col("acctbal")).alias("f_systo"), F.when(i % 4 != 0, F.col("age")).alias("f_pulse"),
        F.when(i % 5 != 0, F.col("height")).alias("f_sleep"), F.when(i % 2 == 0, F.col("sex")).alias("f_srh"),
    )


@query(
    "prj18_completeness",
    f"""SELECT id, c AS completeness, c>=0.5 AS usable, CASE WHEN c>=0.85 THEN 'low' WHEN c>=0.6 THEN 'moderate' ELSE 'high' END AS missingness
        FROM (SELECT id, (CAST(f_systo IS NOT NULL AS INT)+CAST(f_pulse IS NOT NULL AS INT)+CAST(f_sleep IS NOT NULL AS INT)+CAST(f_srh IS NOT NULL AS INT))/4.0 AS c FROM {FEATURE_SQL} f) x""",
)
def prj18(t):
    share = C.completeness(FEATURES)
    return features(t).select("id", share.alias("completeness"), (share >= 0.5).alias("usable"), C.missingness_band(share).alias("missingness"))


ADVICE = {"f_systo": "measure blood pressure", "f_pulse": "measure heart rate", "f_sleep": "record sleep", "f_srh": "rate own health"}


@query(
    "prj19_missing_features",
    f"""SELECT id, feature, CASE feature {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items())} END AS next_step FROM (
        SELECT id, unnest(list_filter([CASE WHEN f_systo IS NULL THEN 'f_systo' END, CASE WHEN f_pulse IS NULL THEN 'f_pulse' END,
          CASE WHEN f_sleep IS NULL THEN 'f_sleep' END, CASE WHEN f_srh IS NULL THEN 'f_srh' END], lambda x: x IS NOT NULL)) AS feature FROM {FEATURE_SQL} f) x""",
)
def prj19(t):
    gaps = features(t).select("id", F.explode(C.missing_names(FEATURES)).alias("feature"))
    return gaps.withColumn("next_step", F.element_at(C.literal_map(ADVICE), F.col("feature")))


LATEST_SQL = "(SELECT participant_id, metric, arg_max(value,(ts,measurement_id)) AS value, epoch_us(max(ts)) AS ts_us, arg_max(measurement_id,(ts,measurement_id)) AS measurement_id FROM {measurements} m0 GROUP BY ALL)"


def newest(t):
    return skew.latest(t.measurements, KEY, ["ts", "measurement_id"], ["value", "ts", "measurement_id"])


@query(
    "prj20_influence_factors",
    f"SELECT participant_id, metric, value, CASE WHEN value>hi THEN 'high' ELSE 'low' END AS factor FROM {LATEST_SQL} l JOIN {BOUNDS_SQL.replace('400.0','90.0').replace('300.0','80.0')} USING(metric) WHERE value<lo OR value>hi",
)
def prj20(t):
    normal = t.spark.createDataFrame(
        [(m, lo, {400.0: 90.0, 300.0: 80.0}.get(hi, hi)) for m, lo, hi in BOUNDS], "metric string, lo double, hi double"
    )
    joined = newest(t).join(F.broadcast(normal), "metric")
    side = F.when(F.col("value") > F.col("hi"), "high").when(F.col("value") < F.col("lo"), "low")
    return joined.select("participant_id", "metric", "value", side.alias("factor")).filter("factor is not null")


@query(
    "prj21_contract_violations",
    """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([
         CASE WHEN point<lower THEN 'point_below_lower' END, CASE WHEN point>upper THEN 'point_above_upper' END,
         CASE WHEN p<0 OR p>1 THEN 'probability_out_of_range' END, CASE WHEN mode NOT IN ('value','range','risk','anomaly','derived','not_supported') THEN 'unknown_mode' END,
         CASE WHEN abstained AND point IS NOT NULL THEN 'abstained_with_point' END, CASE WHEN abs(pct-100*p)>1e-9 THEN 'percent_mismatch' END], lambda x: x IS NOT NULL)) AS rule
       FROM (SELECT predicted AS point, lower, upper*(CASE WHEN line=1 THEN 0.5 ELSE 1 END) AS upper, baseline_pred/60000.0 AS p, 100*baseline_pred/60000.0 + (CASE WHEN line=2 THEN 1 ELSE 0 END) AS pct,
               NOT accepted AS abstained, CASE WHEN line=3 THEN 'other' ELSE 'value' END AS mode FROM {pred_numeric} n) x) y GROUP BY rule""",
)
def prj21(t):
    n = t.pred_numeric
    p = F.col("baseline_pred") / 60000.0
    rows = n.select(
        F.col("predicted").alias("point"), "lower", (F.col("upper") * F.when(F.col("line") == 1, 0.5).otherwise(1.0)).alias("upper"),
        p.alias("p"), (100 * F.col("baseline_pred") / 60000.0 + F.when(F.col("line") == 2, 1).otherwise(0)).alias("pct"), (~F.col("accepted")).alias("abstained"),
        F.when(F.col("line") == 3, "other").otherwise("value").alias("mode"),
    )
    return rows.select(F.explode(contract_violations()).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def contract_violations():
    """Invariants of a prediction row; every broken one is named."""
    point = F.col("point")
    return F.array_compact(F.array(
        F.when(point < F.col("lower"), "point_below_lower"), F.when(point > F.col("upper"), "point_above_upper"),
        F.when((F.col("p") < 0) | (F.col("p") > 1), "probability_out_of_range"),
        F.when(~F.col("mode").isin("value", "range", "risk", "anomaly", "derived", "not_supported"), "unknown_mode"),
        F.when(F.col("abstained") & point.isNotNull(), "abstained_with_point"),
        F.when(F.abs(F.col("pct") - 100 * F.col("p")) > 1e-9, "percent_mismatch"),
    ))


@query(
    "prj22_input_validation",
    """SELECT doc, array_to_string(bad,',') AS violations FROM (SELECT measurement_id AS doc, list_filter([
         CASE WHEN extra THEN 'unknown_field' END, CASE WHEN systo IS NULL THEN 'missing:systo' END,
         CASE WHEN TRY_CAST(systo AS DOUBLE) IS NULL AND systo IS NOT NULL THEN 'not_numeric:systo' END,
         CASE WHEN TRY_CAST(systo AS DOUBLE) < 3 OR TRY_CAST(systo AS DOUBLE) > 90 THEN 'out_of_bounds:systo' END], lambda x: x IS NOT NULL) AS bad
       FROM (SELECT measurement_id, k%13=0 AS extra, CASE WHEN k%10=0 THEN NULL WHEN k%10=1 THEN 'abc' ELSE CAST(k AS VARCHAR) END AS systo FROM {measurements} m) a) b WHERE len(bad)>0""",
)
def prj22(t):
    raw = t.measurements.select(
        F.col("measurement_id").alias("doc"),
        F.to_json(F.struct(
            F.when(F.col("k") % 10 == 0, None).when(F.col("k") % 10 == 1, "abc").otherwise(F.col("k").cast("string")).alias("systo"),
            F.when(F.col("k") % 13 == 0, "x").alias("extra"),
        )).alias("payload"),
    )
    checked = raw.withColumn("bad", bind(F.from_json("payload", "map<string,string>"), input_violations))
    return checked.filter(F.size("bad") > 0).select("doc", F.array_join("bad", ",").alias("violations"))


def input_violations(given):
    """Unknown, missing, non-numeric and out-of-bounds fields of one scoring input."""
    text = F.element_at(given, F.lit("systo"))
    number = C.to_number(text)
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(F.map_keys(given), F.array(F.lit("systo")))) > 0, "unknown_field"),
        F.when(text.isNull(), "missing:systo"), F.when(text.isNotNull() & number.isNull(), "not_numeric:systo"),
        F.when((number < 3) | (number > 90), "out_of_bounds:systo"),
    ))


@query("prj23_exclude_synthetic", "SELECT source, count(*) AS n FROM {measurements} m WHERE source <> 'synthetic' GROUP BY source")
def prj23(t):
    return t.measurements.filter(F.col("source") != "synthetic").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("prj24_drop_empty_columns", None)
def prj24(t):
    """Columns without a single value leave the frame; one aggregate decides."""
    frame = features(t).withColumn("f_empty", F.lit(None).cast("double"))
    return drop_empty(frame)


def drop_empty(frame):
    held = frame.agg(*[F.count(c).alias(c) for c in frame.columns]).first()
    return frame.select([c for c in frame.columns if held[c] > 0])


@query(
    "prj25_conjunctive_search",
    "SELECT doc_id, lang, source FROM documents WHERE lang='en' AND source IN ('src1','src2','src3') AND (text ILIKE '%and%' OR source ILIKE '%and%' OR lang ILIKE '%and%')",
)
def prj25(t):
    return search(t.documents, {"lang": ["en"], "source": ["src1", "src2", "src3"]}, "And", ["text", "source", "lang"]).select("doc_id", "lang", "source")


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def search(df, equal: dict, keyword: str | None, columns: list[str]):
    """Only the filters that are given apply; the keyword may stand in any of the columns, A-Z in either case."""
    for name, allowed in equal.items():
        if allowed:
            df = df.filter(F.col(name).isin(*allowed))
    if keyword:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.translate(c, CAPITALS, CAPITALS.lower()), F.translate(F.lit(keyword), CAPITALS, CAPITALS.lower()))
        df = df.filter(hit)
    return df


@query(
    "prj26_rule_comment",
    f"""SELECT participant_id, metric, array_to_string(list_filter([
          CASE WHEN value>=150 THEN 'very high: repeat the measurement' WHEN value>=80 THEN 'high: keep recording' END,
          CASE WHEN value<5 THEN 'low: rest and repeat' END, CASE WHEN metric='error' THEN 'check the device' END,
          'single readings do not show a lasting state'], lambda x: x IS NOT NULL)[1:3], '; ') AS comment FROM {LATEST_SQL} l""",
)
def prj26(t):
    v = F.col("value")
    tips = F.array_compact(F.array(
        F.when(v >= 150, "very high: repeat the measurement").when(v >= 80, "high: keep recording"),
        F.when(v < 5, "low: rest and repeat"), F.when(F.col("metric") == "error", "check the device"),
        F.lit("single readings do not show a lasting state"),
    ))
    return newest(t).select(*KEY, F.array_join(F.slice(tips, 1, 3), "; ").alias("comment"))


@query(
    "prj27_peer_reference",
    """SELECT id, band, round(height*40-peer,4) AS gap FROM (SELECT id, height, CASE WHEN age<70 THEN '60-69' WHEN age<80 THEN '70-79' ELSE '80+' END AS band,
         CASE WHEN age<70 THEN 65 WHEN age<80 THEN 63 ELSE 60 END AS peer FROM {profile} p) x""",
)
def prj27(t):
    rows = [(b, m, float(v)) for b, vs in rules.PEERS.items() for m, v in zip(rules.PEER_COLUMNS, vs)]
    peers = t.spark.createDataFrame(rows, "band string, mtype string, peer double")
    own = t.profile.select("id", C.peer_band("age").alias("band"), F.lit("weight").alias("mtype"), (F.col("height") * 40).alias("v"))
    return own.join(F.broadcast(peers), ["band", "mtype"]).select("id", "band", r(F.col("v") - F.col("peer"), 4).alias("gap"))


@query(
    "prj28_survey_validation",
    """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('O','F') THEN 'arm' END, CASE WHEN o_custkey%50=0 THEN 'participant' END,
        CASE WHEN CAST(substr(o_orderpriority,1,1) AS INT) NOT BETWEEN 1 AND 4 THEN 'score' END, CASE WHEN o_orderkey%3 NOT IN (0,1) THEN 'binary' END], lambda x: x IS NOT NULL)) AS field FROM orders""",
)
def prj28(t):
    score = F.substring("o_orderpriority", 1, 1).cast("int")
    broken = F.array_compact(F.array(
        F.when(~F.col("o_orderstatus").isin("O", "F"), "arm"), F.when(F.col("o_custkey") % 50 == 0, "participant"),
        F.when(~score.between(1, 4), "score"), F.when(~(F.col("o_orderkey") % 3).isin(0, 1), "binary"),
    ))
    return t.orders.select("o_orderkey", F.explode(broken).alias("field"))


@query(
    "prj29_sensitive_action",
    "SELECT user_id, id, (role='system' OR regexp_matches(content,'der|the')) AS sensitive FROM {messages} m",
)
def prj29(t):
    return t.messages.select("user_id", "id", sensitive(F.col("role"), F.col("content"), ("system",), "der|the").alias("sensitive"))


def sensitive(kind, text, kinds=rules.SENSITIVE_ACTIONS, pattern=rules.SENSITIVE_PATTERN):
    return kind.isin(*kinds) | F.coalesce(text.rlike(pattern), F.lit(False))


@query(
    "prj30_display_values",
    f"""SELECT participant_id, mtype, CASE WHEN mtype='bp' AND value2 IS NOT NULL THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR)||'/'||CAST(CAST(value2 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(value) AS BIGINT) AS VARCHAR) END AS shown,
        CASE mtype WHEN 'bp' THEN 'mmHg' WHEN 'glucose' THEN 'mmol/L' WHEN 'hr' THEN 'bpm' ELSE '' END AS unit
        FROM (SELECT participant_id, mtype, arg_max(value,(ts,measurement_id)) AS value, max(row(ts,measurement_id,value2))[3] AS value2 FROM {DUAL_SQL} d GROUP BY ALL) x""",
)
def prj30(t):
    rows = skew.latest(dual(t), ["participant_id", "mtype"], ["ts", "measurement_id"], ["value", "value2"])
    joined = rows.join(definitions(t), "mtype", "left")
    main = F.round("value").cast("long").cast("string")
    both = F.concat_ws("/", main, F.col("value2").cast("long").cast("string"))
    shown = F.when((F.col("value_type") == "dual") & F.col("value2").isNotNull(), both).otherwise(main)
    # one row per metric definition and participant, so at most 8 of them can be asked for
    return joined.select("participant_id", "mtype", shown.alias("shown"), F.coalesce("unit", F.lit("")).alias("unit"))


@query("prj31_sensitive_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def prj31(t):
    return without_identifiers(t.customer, {"c_name", "c_acctbal"})


def without_identifiers(df, secret: set[str]):
    """Drop secret columns and fail when a direct identifier is still present."""
    out = df.drop(*secret)
    direct = {"name", "full_name", "id_card", "idcard", "phone", "address"} & {c.lower() for c in out.columns}
    if direct:
        raise ValueError(f"direct identifiers: {sorted(direct)}")
    return out


# --- aggregates --------------------------------------------------------------------------------------------------------


@query(
    "ag1_basic_stats",
    "SELECT participant_id, metric, round(avg(value),6) AS mean, min(value) AS lo, max(value) AS hi, count(*) AS n, round(stddev_pop(value),6) AS sd, round(median(value),6) AS med FROM {measurements} m GROUP BY ALL",
)
def ag1(t):
    m = t.measurements
    flat = m.groupBy(*KEY).agg(
        r(F.avg("value")).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.count("value").alias("n"), r(F.stddev_pop("value")).alias("sd"),
    )
    middle = skew.quantiles(m, KEY, "value", {"med": 0.5})
    return flat.join(middle, KEY).withColumn("med", r("med"))


@query(
    "ag2_instant_collapse",
    "SELECT participant_id, metric, epoch_us(hour_ts) AS ts_us, round(avg(value),6) AS value, count(*) AS n_raw, min(measurement_id) AS first_id FROM (SELECT *, date_trunc('hour',ts) AS hour_ts FROM {measurements} m) x GROUP BY participant_id, metric, hour_ts",
)
def ag2(t):
    hourly = t.measurements.withColumn("ts", F.date_trunc("hour", "ts"))
    return S.collapse(hourly, KEY).select(*KEY, F.unix_micros("ts").alias("ts_us"), r("value").alias("value"), "n_raw", "first_id")


@query("ag3_daily_bucket", f"SELECT participant_id, metric, CAST(day AS VARCHAR) AS day, round(v,6) AS v FROM {DAILY_SQL} d")
def ag3(t):
    return daily(t).select(*KEY, F.col("day").cast("string").alias("day"), r("v").alias("v"))


MAD_SQL = f"""(SELECT *, n>=5 AND mad>1e-9 AS usable FROM (SELECT d.*, s.n, s.med, s.mad FROM {USER_DAILY_SQL} d JOIN
   (SELECT participant_id, any_value(med) AS med, count(*) AS n, median(abs(v-med))*1.4826 AS mad FROM (SELECT participant_id, v, median(v) OVER (PARTITION BY participant_id) AS med FROM {USER_DAILY_SQL} d1) y GROUP BY participant_id) s USING(participant_id)) z)"""


@query(
    "ag4_mad_outliers",
    f"SELECT participant_id, CAST(day AS VARCHAR) AS day, round(v,6) AS v, NOT usable OR abs(v-med)<=4.0*mad AS keep FROM {MAD_SQL} q",
)
def ag4(t):
    return S.mad_clean(user_daily(t), ["participant_id"]).select("participant_id", F.col("day").cast("string").alias("day"), r("v").alias("v"), "keep")


@query("ag5_spike_flag", f"SELECT participant_id, bool_or(usable AND abs(v-med)>=4.0*mad) AS spike FROM {MAD_SQL} q GROUP BY participant_id")
def ag5(t):
    return S.mad_clean(user_daily(t), ["participant_id"]).groupBy("participant_id").agg(F.bool_or("spike").alias("spike"))


@query(
    "ag6_baseline_band",
    f"""SELECT participant_id, round(quantile_cont(v,0.5),6) AS base_value, round(quantile_cont(v,0.25),6) AS base_lower, round(quantile_cont(v,0.75),6) AS base_upper
        FROM (SELECT *, max(day) OVER (PARTITION BY participant_id) AS last FROM {USER_DAILY_SQL} d) x WHERE last-day<=14 GROUP BY participant_id""",
)
def ag6(t):
    b = S.baseline_band(user_daily(t), ["participant_id"])
    return b.select("participant_id", *[r(c).alias(c) for c in ("base_value", "base_lower", "base_upper")])


# --- windows -----------------------------------------------------------------------------------------------------------


@query("win1_latest", f"SELECT participant_id, metric, value, ts_us, measurement_id FROM {LATEST_SQL} l")
def win1(t):
    return newest(t).select(*KEY, "value", F.unix_micros("ts").alias("ts_us"), "measurement_id")


@query("jn5_latest_by_type", f"SELECT participant_id, metric, value, measurement_id FROM {LATEST_SQL} l")
def jn5(t):
    return newest(t).select(*KEY, "value", "measurement_id")


CHANGE_SQL = """(SELECT participant_id, metric, first_value, last_value, round(last_value-first_value,2) AS delta,
   CASE WHEN abs(last_value-first_value)<=(CASE metric WHEN 'view' THEN 3.0 WHEN 'click' THEN 0.2 WHEN 'error' THEN 10 ELSE 1.0 END) THEN 'stable' WHEN last_value>first_value THEN 'rising' ELSE 'falling' END AS direction
   FROM (SELECT participant_id, metric, arg_min(value,(ts,measurement_id)) AS first_value, arg_max(value,(ts,measurement_id)) AS last_value FROM {measurements} m0 GROUP BY ALL) x)"""


def changes(t):
    tolerance = F.when(F.col("metric") == "view", 3.0).when(F.col("metric") == "click", 0.2).when(F.col("metric") == "error", 10.0).otherwise(1.0)
    return S.first_last_change(t.measurements, KEY, tolerance)


@query("win2_first_last_change", f"SELECT * FROM {CHANGE_SQL} c")
def win2(t):
    return changes(t)


@query(
    "win3_latest_vs_previous",
    """SELECT participant_id, metric, latest_value, p AS previous_value, round(latest_value-p,6) AS change,
        round(CASE WHEN abs(p)>1e-9 THEN (latest_value-p)/p*100 ELSE 0 END,4) AS change_percent FROM (
        SELECT participant_id, metric, max(CASE WHEN rn=1 THEN value END) AS latest_value, coalesce(max(CASE WHEN rn=2 THEN value END), max(CASE WHEN rn=1 THEN value END)) AS p FROM (
          SELECT *, row_number() OVER (PARTITION BY participant_id, metric ORDER BY ts DESC, measurement_id DESC) AS rn FROM {measurements} m) x WHERE rn<=2 GROUP BY ALL) y""",
)
def win3(t):
    out = S.latest_and_previous(t.measurements, KEY)
    return out.withColumn("change", r("change")).withColumn("change_percent", r("change_percent", 4))


@query(
    "win4_last_seven_records",
    """SELECT participant_id, metric, count(*) AS n, round(avg(value),6) AS rolling_7_records_avg FROM (
        SELECT *, row_number() OVER (PARTITION BY participant_id, metric ORDER BY ts DESC, measurement_id DESC) AS rn FROM {measurements} m) x WHERE rn<=7 GROUP BY ALL""",
)
def win4(t):
    seven = skew.newest_n(t.measurements, KEY, [F.col("ts").desc(), F.col("measurement_id").desc()], 7)
    return seven.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("rolling_7_records_avg"))


@query(
    "win4_rolling_seven_days_rows",
    f"SELECT participant_id, metric, CAST(day AS VARCHAR) AS day, round(avg(v) OVER (PARTITION BY participant_id, metric ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),6) AS rolling FROM {DAILY_SQL} d",
)
def win4_rows(t):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("day").rowsBetween(-6, 0)
    return daily(t).select(*KEY, F.col("day").cast("string").alias("day"), r(F.avg("v").over(w)).alias("rolling"))


@query(
    "win5_recent_vs_baseline",
    """SELECT participant_id, metric, round(rm,6) AS recent_mean, round(bm,6) AS baseline_mean, pct AS trend_pct, CASE WHEN pct IS NULL OR abs(pct)<3 THEN 'stable' WHEN pct>0 THEN 'up' ELSE 'down' END AS trend FROM (
        SELECT *, round(CASE WHEN bm<>0 THEN (rm-bm)/bm END*100,1) AS pct FROM (SELECT participant_id, metric, avg(value) FILTER (ts>={as_of}-INTERVAL 7 DAY) AS rm, avg(value) FILTER (ts<{as_of}-INTERVAL 7 DAY) AS bm FROM {measurements} m GROUP BY ALL) x) y""",
)
def win5(t):
    out = S.recent_vs_baseline(t.measurements, KEY, AS_OF)
    return out.withColumn("recent_mean", r("recent_mean")).withColumn("baseline_mean", r("baseline_mean"))


def keep_first_sql(rows, keys, gap_us):
    """Recursive chain: first row per key, then the first row at least one gap later."""
    k = ", ".join(keys)
    same = " AND ".join(f"e.{c} IS NOT DISTINCT FROM c.{c}" for c in keys)
    return f"""WITH RECURSIVE ev AS (SELECT {k}, epoch_us(ts) AS t, min(measurement_id) AS id FROM {rows} r0 GROUP BY ALL),
      c AS (SELECT {k}, min(t) AS t FROM ev GROUP BY {k}
            UNION ALL SELECT {', '.join('c.' + x for x in keys)}, (SELECT min(e.t) FROM ev e WHERE {same} AND e.t >= c.t + {gap_us}) AS t FROM c
            WHERE EXISTS (SELECT 1 FROM ev e WHERE {same} AND e.t >= c.t + {gap_us}))
      SELECT {', '.join('c.' + x for x in keys)}, c.t AS kept_us, e.id AS measurement_id FROM c JOIN ev e ON {same} AND e.t = c.t"""


DUP_SQL = "(SELECT participant_id, metric, CAST(floor(value/50) AS BIGINT) AS value, CASE WHEN k%2=0 THEN k%4 END AS value2, ts, measurement_id FROM {measurements} m0)"


def repeats(t):
    return t.measurements.select(
        "participant_id", "metric", F.floor(F.col("value") / 50).alias("value"),
        F.when(F.col("k") % 2 == 0, F.col("k") % 4).alias("value2"), "ts", "measurement_id",
    )


DUP_KEYS = ["participant_id", "metric", "value", "value2"]


@query("win6_near_duplicates", keep_first_sql(DUP_SQL, DUP_KEYS, 4 * 3600 * 1000000))
def win6(t):
    """Same value of one series within the gap is a repeat of the last kept row (gap widened to the fixture's density)."""
    return keepfirst.keep_first(repeats(t), DUP_KEYS, 4 * 3600, 86400, "measurement_id")


@query(
    "jn9_near_duplicate_pairs",
    f"""SELECT participant_id, metric, value, value2, count(*) AS repeats FROM (SELECT *, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY participant_id, metric, value, value2 ORDER BY ts, measurement_id) AS prev FROM {DUP_SQL} d) x
        WHERE t - prev < 14400000000 GROUP BY ALL""",
)
def jn9(t):
    """Readings that repeat the one before them; the neighbour is found by ordered chunks, never by pairing rows."""
    return neighbour_repeats(repeats(t), DUP_KEYS, 4 * 3600)


def neighbour_repeats(df, keys, gap_seconds):
    from pyspark.sql import Window

    chunked = df.withColumn("_t", F.unix_micros("ts")).withColumn("_day", F.to_date("ts"))
    inside = Window.partitionBy(*keys, "_day").orderBy("_t", "measurement_id")
    local = chunked.withColumn("_prev", F.lag("_t").over(inside))
    # only the first row of each day looks at the day before: one row per (key, day)
    across = Window.partitionBy(*keys).orderBy("_day")
    edge = chunked.groupBy(*keys, "_day").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    edge = edge.withColumn("_prev", F.lag("_hi").over(across))
    in_day = local.groupBy(*keys).agg(F.count_if(F.col("_t") - F.col("_prev") < gap_seconds * 1000000).alias("n"))
    at_edge = edge.groupBy(*keys).agg(F.count_if(F.col("_lo") - F.col("_prev") < gap_seconds * 1000000).alias("n"))
    both = in_day.unionByName(at_edge).groupBy(*keys).agg(F.sum("n").alias("repeats"))
    return both.filter("repeats > 0")


ALERT_SQL = "(SELECT participant_id, metric, CASE WHEN value>=100 THEN 'very high' WHEN value>=50 THEN 'high' ELSE 'low' END AS title, ts, measurement_id FROM {measurements} m0)"


def raw_alerts(t):
    v = F.col("value")
    return t.measurements.select("participant_id", "metric", F.when(v >= 100, "very high").when(v >= 50, "high").otherwise("low").alias("title"), "ts", "measurement_id")


@query("win12_alert_suppression", keep_first_sql(ALERT_SQL, ["participant_id", "metric", "title"], 86400 * 1000000))
def win12(t):
    """An alert title is not repeated within a day of the last one that was raised."""
    return keepfirst.keep_first(raw_alerts(t), ["participant_id", "metric", "title"], 86400, 7 * 86400, "measurement_id")


@query(
    "win7_window_features",
    """SELECT participant_id, metric, window_days, count(v) AS count, round(avg(v),6) AS mean, round(stddev_pop(v),5) AS std, min(v) AS min, max(v) AS max,
        CASE WHEN count(v)>0 THEN round(CASE WHEN count(DISTINCT x)>1 THEN regr_slope(v,x) ELSE 0 END,5) END AS slope, CASE WHEN count(v)>0 THEN round(greatest(0,1-count(DISTINCT d)/CAST(window_days AS DOUBLE)),6) END AS missing_rate
       FROM (SELECT participant_id, metric, w AS window_days, CASE WHEN age<w THEN value END AS v, CASE WHEN age<w THEN -age END AS x, CASE WHEN age<w THEN CAST(ts AS DATE) END AS d
             FROM (SELECT *, (epoch_us({as_of})-epoch_us(ts))/86400000000.0 AS age FROM {measurements} m), (VALUES (1),(3),(7),(14),(30),(90)) AS ws(w)) y GROUP BY participant_id, metric, window_days""",
)
def win7(t):
    f = S.window_features(t.measurements, KEY, AS_OF)
    return f.select(*KEY, "window_days", "count", r("mean").alias("mean"), r("std", 5).alias("std"), "min", "max", r("slope", 5).alias("slope"), r("missing_rate").alias("missing_rate"))


@query(
    "win7_window_medians",
    """SELECT participant_id, metric, w AS window_days, round(median(value),6) AS median FROM (SELECT *, (epoch_us({as_of})-epoch_us(ts))/86400000000.0 AS age FROM {measurements} m), (VALUES (1),(3),(7),(14),(30),(90)) AS ws(w) WHERE age<w GROUP BY ALL""",
)
def win7_medians(t):
    return S.window_medians(t.measurements, KEY, AS_OF).withColumn("median", r("median"))


@query(
    "win7_trailing_table",
    """WITH a AS (SELECT *, (epoch_us({as_of})-epoch_us(ts))/86400000000.0 AS age FROM {measurements} m WHERE ts<={as_of} AND value IS NOT NULL),
         l AS (SELECT participant_id, metric, arg_max(value,(ts,measurement_id)) AS last, min(age) AS days_since_last FROM a GROUP BY ALL)
       SELECT participant_id, metric, w AS window_days, last, round(days_since_last,6) AS days_since_last, count(v) AS count, round(avg(v),6) AS mean, round(median(v),6) AS median, round(stddev_pop(v),5) AS std,
        min(v) AS min, max(v) AS max, CASE WHEN count(v)>0 THEN round(CASE WHEN count(DISTINCT x)>1 THEN regr_slope(v,x) ELSE 0 END,5) END AS slope,
        CASE WHEN count(v)>0 THEN round(greatest(0,1-count(DISTINCT d)/CAST(w AS DOUBLE)),6) END AS missing_rate
       FROM (SELECT participant_id, metric, w, CASE WHEN age<w THEN value END AS v, CASE WHEN age<w THEN -age END AS x, CASE WHEN age<w THEN CAST(ts AS DATE) END AS d
             FROM a, (VALUES (1),(3),(7),(14),(30),(90)) AS ws(w)) y JOIN l USING(participant_id, metric) GROUP BY participant_id, metric, w, last, days_since_last""",
)
def win7_table(t):
    """All trailing features and the last reading in one table; each reading is counted once."""
    f = trailing_features(t.measurements, KEY, AS_OF)
    places = {"days_since_last": 6, "mean": 6, "median": 6, "std": 5, "slope": 5, "missing_rate": 6}
    return f.select(*[r(c, places[c]).alias(c) if c in places else c for c in f.columns])


@query(
    "jn18_as_of_value",
    "SELECT participant_id, metric, arg_max(value,(ts,measurement_id)) AS value, epoch_us(max(ts)) AS ts_us FROM {measurements} m WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL",
)
def jn18(t):
    return S.as_of_values(t.measurements, KEY, "2024-01-15 00:00:00").select(*KEY, "value", F.unix_micros("ts").alias("ts_us"))


@query(
    "win9_step_scale",
    f"SELECT participant_id, round(median(d),6) AS median_step, round(avg(d),6) AS mean_step FROM (SELECT participant_id, abs(v-lag(v) OVER (PARTITION BY participant_id ORDER BY day)) AS d FROM {USER_DAILY_SQL} u) x GROUP BY 1",
)
def win9(t):
    s = S.step_scale(user_daily(t), ["participant_id"])
    return s.select("participant_id", r("median_step").alias("median_step"), r("mean_step").alias("mean_step"))


@query(
    "win10_recent_slope",
    f"""SELECT participant_id, round(regr_slope(v,x),6) AS recent_slope, count(*) AS recent_days FROM (SELECT participant_id, v, CAST(day - min(day) OVER (PARTITION BY participant_id) AS DOUBLE) AS x,
         row_number() OVER (PARTITION BY participant_id ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY participant_id) AS n FROM {USER_DAILY_SQL} u) x WHERE rn<=greatest(3,ceil(n*0.3)) GROUP BY 1""",
)
def win10(t):
    return S.recent_slope(user_daily(t), ["participant_id"]).withColumn("recent_slope", r("recent_slope"))


@query(
    "win11_exponential_smoothing",
    f"""WITH RECURSIVE o AS (SELECT participant_id, day, v, row_number() OVER (PARTITION BY participant_id ORDER BY day) AS rn FROM {USER_DAILY_SQL} u),
        s AS (SELECT participant_id, day, v, rn, v AS e FROM o WHERE rn=1 UNION ALL SELECT o.participant_id, o.day, o.v, o.rn, o.v*CAST(0.3 AS DOUBLE)+s.e*CAST(0.7 AS DOUBLE) FROM s JOIN o ON o.participant_id=s.participant_id AND o.rn=s.rn+1)
        SELECT participant_id, CAST(day AS VARCHAR) AS day, e AS ewma FROM s""",
)
def win11(t):
    return S.smoothed(user_daily(t), ["participant_id"]).select("participant_id", F.col("day").cast("string").alias("day"), "ewma")


@query(
    "win13_time_ordered_holdout",
    f"""SELECT participant_id, part, count(*) AS n, round(avg(v),6) AS mean FROM (SELECT participant_id, v, CASE WHEN n<5 THEN 'none' WHEN rn<=(CASE WHEN n>=10 THEN greatest(2,ceil(n*0.2)) ELSE 2 END) THEN 'validation' ELSE 'train' END AS part FROM (
         SELECT *, count(*) OVER (PARTITION BY participant_id) AS n, row_number() OVER (PARTITION BY participant_id ORDER BY day DESC) AS rn FROM {USER_DAILY_SQL} u) x) y GROUP BY ALL""",
)
def win13(t):
    return S.holdout(user_daily(t), ["participant_id"]).groupBy("participant_id", "part").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("mean"))


@query(
    "win15_ordinal_index",
    "SELECT participant_id, measurement_id, row_number() OVER (PARTITION BY participant_id ORDER BY ts, measurement_id) AS ordinal FROM {measurements} m",
)
def win15(t):
    return S.reading_positions(t.measurements, ["participant_id"], "ordinal").select("participant_id", "measurement_id", "ordinal")


# --- trends ------------------------------------------------------------------------------------------------------------

X_SQL = f"(SELECT participant_id, v, CAST(day - min(day) OVER (PARTITION BY participant_id) AS DOUBLE) AS x FROM {USER_DAILY_SQL} u)"


@query("ts1_ols_trend", f"SELECT participant_id, round(regr_slope(v,x),6) AS slope, round(regr_intercept(v,x),6) AS intercept FROM {X_SQL} q GROUP BY 1")
def ts1(t):
    f = S.ols_trend(user_daily(t), ["participant_id"])
    return f.select("participant_id", r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(
    "ts2_quadratic_trend",
    f"""SELECT participant_id, round(a,5) AS a, round(b,5) AS b, round(c,4) AS c FROM (SELECT *, (t0-s1*b-s2*a)/n AS c FROM (SELECT *,
          ((n*s2-s1*s1)*(n*t2-s2*t0)-(n*s3-s1*s2)*(n*t1-s1*t0))/d AS a, ((n*s4-s2*s2)*(n*t1-s1*t0)-(n*s3-s1*s2)*(n*t2-s2*t0))/d AS b FROM (
          SELECT *, (n*s2-s1*s1)*(n*s4-s2*s2)-(n*s3-s1*s2)*(n*s3-s1*s2) AS d FROM (SELECT participant_id, CAST(count(*) AS DOUBLE) AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(v) AS t0, sum(x*v) AS t1, sum(x*x*v) AS t2 FROM {X_SQL} q GROUP BY 1) p) r WHERE d>1e-6) w) z""",
)
def ts2(t):
    q = S.quadratic_fit(user_daily(t), ["participant_id"])
    return q.select("participant_id", r("a", 5).alias("a"), r("b", 5).alias("b"), r("c", 4).alias("c"))


@query(
    "ts7_naive_forecasts",
    f"SELECT participant_id, round(arg_max(v,day),6) AS last_value, round(median(v),6) AS median_value FROM {USER_DAILY_SQL} u GROUP BY 1",
)
def ts7(t):
    return user_daily(t).groupBy("participant_id").agg(r(F.max_by("v", "day")).alias("last_value"), r(F.median("v")).alias("median_value"))


TREND_SQL = f"""(SELECT *, CASE WHEN rel<lim THEN 'stable' WHEN slope>0 THEN 'rising' ELSE 'falling' END AS direction, CASE WHEN rel<0.05 THEN 'weak' WHEN rel<0.15 THEN 'moderate' ELSE 'strong' END AS strength FROM (
   SELECT *, abs(slope)*greatest(span_days,1e-6)/greatest(abs(med),1e-9) AS rel, CASE fluctuation WHEN 'low' THEN 0.03 WHEN 'moderate' THEN 0.06 ELSE 0.12 END AS lim FROM (
   SELECT *, CASE WHEN noise<0.03 THEN 'low' WHEN noise<0.1 THEN 'moderate' ELSE 'high' END AS fluctuation FROM (
   SELECT participant_id, coalesce(regr_slope(v,x),0) AS slope, median(v) AS med, max(x) AS span_days, count(*) AS n_days,
     sqrt(greatest(0,(regr_syy(v,x)-coalesce(CASE WHEN regr_sxx(v,x)<>0 THEN regr_sxy(v,x)*regr_sxy(v,x)/regr_sxx(v,x) END,0))/count(*)))/greatest(abs(median(v)),1e-9) AS noise FROM {X_SQL} q GROUP BY 1) a) b) c)"""


@query("ts9_trend_class", f"SELECT participant_id, n_days, span_days, round(noise,5) AS noise, fluctuation, direction, strength FROM {TREND_SQL} t")
def ts9(t):
    f = S.ols_trend(user_daily(t), ["participant_id"])
    return f.select("participant_id", "n_days", "span_days", r("noise", 5).alias("noise"), "fluctuation", "direction", "strength")


@query(
    "ts13_condition_split",
    """SELECT participant_id, metric, condition, count(*) AS n, round(avg(value),6) AS mean FROM (SELECT m.*, any_known FROM {measurements} m JOIN (SELECT participant_id, metric, bool_or(condition<>'unknown') AS any_known FROM {measurements} m2 GROUP BY ALL) k USING(participant_id, metric)) x
        WHERE condition<>'unknown' OR NOT any_known GROUP BY ALL""",
)
def ts13(t):
    return split_conditions(t.measurements, KEY).groupBy(*KEY, "condition").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


def split_conditions(df, keys):
    """One series per known condition; unknown rows stay only where nothing else is known."""
    known = df.groupBy(*keys).agg(F.bool_or(F.col("condition") != "unknown").alias("_known"))
    return skew.salted_join(df, known, keys, ["measurement_id"], "inner").filter((F.col("condition") != "unknown") | ~F.col("_known")).drop("_known")
