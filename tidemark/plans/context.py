"""Context, scoring, rule and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import cleaning as C
from tidemark.operators import context as X, govern as G, skew
from tidemark.plans.measurement import (
    CHANGE_SQL, DUAL_SQL, FLAGS_SQL, LATEST_SQL, SCORE_SQL, changes, definitions, dual, flagged, newest, scored,
)
from tidemark.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


@query("jn6_metric_definition_join", f"SELECT mtype, count(*) AS n, any_value(unit) AS unit, count(*) FILTER (unit IS NULL) AS undefined FROM (SELECT d.*, CASE mtype WHEN 'bp' THEN 'mmHg' WHEN 'glucose' THEN 'mmol/L' WHEN 'hr' THEN 'bpm' END AS unit FROM {DUAL_SQL} d) x GROUP BY mtype")
def jn6(t):
    joined = dual(t).join(definitions(t), "mtype", "left")
    return joined.groupBy("mtype").agg(F.count(F.lit(1)).alias("n"), F.max("unit").alias("unit"), F.count_if(F.col("unit").isNull()).alias("undefined"))


CARE_SQL = "(SELECT DISTINCT o_custkey AS senior, o_orderkey % 997 + 1 AS member FROM orders)"


@query("jn7_two_role_relations", f"SELECT member AS user_id, 'member' AS role, senior AS other_id, c_name FROM {CARE_SQL} e JOIN customer ON c_custkey=senior UNION ALL SELECT senior, 'senior', member, c_name FROM {CARE_SQL} e JOIN customer ON c_custkey=member")
def jn7(t):
    """Each relation is seen from both sides: two joins to the names, which stay one row per customer."""
    edges = t.orders.select(F.col("o_custkey").alias("senior"), (F.col("o_orderkey") % 997 + 1).alias("member")).distinct()

    def seen(role: str, own: str, other: str):
        names = t.customer.select(F.col("c_custkey").alias(other), "c_name")
        return edges.join(names, other).select(F.col(own).alias("user_id"), F.lit(role).alias("role"), F.col(other).alias("other_id"), "c_name")

    return seen("member", "member", "senior").unionByName(seen("senior", "senior", "member"))


@query("jn8_authorised_rows", "SELECT participant_id, count(*) AS n FROM {measurements} m WHERE participant_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus='O' AND o_orderpriority='1-URGENT') GROUP BY 1")
def jn8(t):
    active = t.orders.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("participant_id")).distinct()
    return t.measurements.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n")).join(active, "participant_id", "left_semi")


@query("jn19_metric_directions", f"SELECT participant_id, array_to_string(list(metric||'='||direction ORDER BY metric||'='||direction),',') AS directions FROM {CHANGE_SQL} c GROUP BY 1")
def jn19(t):
    maps = X.direction_map(changes(t))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("directions"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return maps.select("participant_id", text.alias("directions"))


@query("jn20_capability_matrix", "SELECT metric, n, enabled IS NOT NULL AS available FROM (SELECT metric, count(*) AS n FROM {measurements} m GROUP BY 1) a LEFT JOIN (SELECT metric AS tm, true AS enabled FROM {measurements} m WHERE source<>'synthetic' GROUP BY 1 HAVING avg(value)>=49.5) b ON tm=metric")
def jn20(t):
    m = t.measurements
    targets = m.filter("source <> 'synthetic'").groupBy("metric").agg(F.avg("value").alias("a")).filter("a >= 49.5").select("metric", F.lit(True).alias("enabled"))
    catalogue = m.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    return catalogue.join(targets, "metric", "left").select("metric", "n", F.col("enabled").isNotNull().alias("available"))


@query("ag31_status_summary", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus='P') AS pending, count(*) FILTER (o_orderstatus='P' AND o_orderpriority='1-URGENT') AS critical, round(avg(CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END),6) AS completion FROM orders GROUP BY 1")
def ag31(t):
    pending = F.col("o_orderstatus") == "P"
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(pending).alias("pending"),
        F.count_if(pending & (F.col("o_orderpriority") == "1-URGENT")).alias("critical"),
        r(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("completion"),
    )


def _domain_case():
    return "CASE " + " ".join(f"WHEN mtype IN ({','.join(repr(m) for m in ms)}) THEN '{d}'" for d, ms in rules.SCORE_DOMAINS.items()) + " END"


DOMAINS = f"""(SELECT participant_id, {', '.join(f"max(CASE WHEN domain='{d}' THEN s END) AS {d}" for d in rules.SCORE_DOMAINS)}, CAST(round(avg(s)) AS INTEGER) AS total FROM (
   SELECT participant_id, domain, CAST(round(avg(score)) AS INTEGER) AS s FROM (SELECT participant_id, mtype, {_domain_case()} AS domain, max(row(ts, measurement_id, score))[3] AS score FROM {SCORE_SQL} z GROUP BY ALL) a
   WHERE score IS NOT NULL AND domain IS NOT NULL GROUP BY ALL) b GROUP BY 1)"""


@query("ag32_domain_scores", f"SELECT * FROM {DOMAINS} d")
def ag32(t):
    return X.domain_scores(scored(t))


@query(
    "prj26_domain_suggestions",
    f"""SELECT participant_id, CASE WHEN len(h)=0 THEN 'keep up the good habits' ELSE array_to_string(h[1:3],'; ') END AS suggestions FROM (SELECT participant_id, list_filter([CASE WHEN chronic<80 THEN 'record blood pressure twice a day' END,
        CASE WHEN activity<80 THEN 'move half an hour a day' END, CASE WHEN sleep<80 THEN 'keep a fixed bedtime' END, CASE WHEN nutrition<80 THEN 'eat regular balanced meals' END], lambda x: x IS NOT NULL) AS h FROM {DOMAINS} d) x""",
)
def prj26_domains(t):
    return X.suggestions(X.domain_scores(scored(t))).select("participant_id", "suggestions")


@query("ag33_daily_composite", f"SELECT participant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(score),6) AS score, count(score) AS readings FROM {SCORE_SQL} s WHERE score IS NOT NULL GROUP BY ALL")
def ag33(t):
    return X.daily_score(scored(t)).select("participant_id", F.col("day").cast("string").alias("day"), r("score").alias("score"), "readings")


QUALITY = f"""(SELECT b.*, coalesce(flag_counts,'') AS flag_counts FROM (SELECT participant_id, mtype, count(*) AS data_points, count(*) FILTER (condition='unknown') AS missing_condition FROM {FLAGS_SQL} f GROUP BY ALL) b
   LEFT JOIN (SELECT participant_id, mtype, array_to_string(list(c ORDER BY c),',') AS flag_counts FROM (SELECT participant_id, mtype, flag||':'||count(*) AS c FROM (SELECT participant_id, mtype, unnest(flags) AS flag FROM {FLAGS_SQL} f2) u GROUP BY participant_id, mtype, flag) v GROUP BY ALL) w USING(participant_id, mtype))"""


@query("ag34_quality_summary", f"SELECT * FROM {QUALITY} q")
def ag34(t):
    return X.quality_summary(flagged(t), ["participant_id", "mtype"])


@query("ag35_common_completeness", f"SELECT participant_id, round(count(DISTINCT mtype) FILTER (mtype IN ('bp','glucose','hr','sleep'))/4.0,3) AS ratio, array_to_string(list_filter(['bp','glucose','hr','sleep'], lambda x: NOT list_contains(list(DISTINCT mtype), x)),',') AS missing FROM {DUAL_SQL} d WHERE k<40 GROUP BY 1")
def ag35(t):
    return X.common_completeness(dual(t).filter("k < 40"), "participant_id", "mtype")


@query("ag36_type_inventory", "SELECT metric, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, metric) AS position FROM {measurements} m GROUP BY metric")
def ag36(t):
    """The catalogue of metrics is fixed, so ordering its counts is a one-task job of a few rows."""
    return t.measurements.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).withColumn("position", F.row_number().over(Window.orderBy(F.col("n").desc(), "metric")))


@query("ag37_tag_frequency", "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) x GROUP BY tag ORDER BY n DESC, tag LIMIT 12")
def ag37(t):
    stored = t.documents.select(F.to_json(F.array("lang", "source")).alias("tags"))
    counts = stored.select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return G.top_rows(counts, [F.col("n").desc(), F.col("tag")], 12)


@query("ag38_condition_means", "SELECT o_orderstatus AS arm, round(avg(CASE WHEN o_totalprice>50000 THEN o_totalprice END),4) AS mean_score, round(avg(CASE WHEN o_orderpriority='1-URGENT' THEN 1.0 ELSE 0.0 END),6) AS rate, count(DISTINCT o_custkey) AS participants FROM orders GROUP BY 1")
def ag38(t):
    per_person = t.orders.groupBy(F.col("o_orderstatus").alias("arm"), "o_custkey").agg(
        F.sum(F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice"))).alias("s"), F.count_if(F.col("o_totalprice") > 50000).alias("k"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count(F.lit(1)).alias("n"),
    )
    return per_person.groupBy("arm").agg(
        r(F.sum("s") / F.sum("k"), 4).alias("mean_score"), r(F.sum("u") / F.sum("n")).alias("rate"), F.count(F.lit(1)).alias("participants")
    )


@query("ag44_call_statistics", "SELECT role AS provider, count(*) AS calls, count(*) FILTER (length(content)>500) AS long_calls, round(median(length(content)),4) AS p50, round(quantile_cont(length(content),0.95),4) AS p95 FROM {messages} m GROUP BY 1")
def ag44(t):
    calls = t.messages.select(F.col("role").alias("provider"), F.length("content").cast("double").alias("latency"))
    counts = calls.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("latency") > 500).alias("long_calls"))
    spread = skew.quantiles(calls, ["provider"], "latency", {"p50": 0.5, "p95": 0.95})
    return counts.join(spread, "provider").withColumn("p50", r("p50", 4)).withColumn("p95", r("p95", 4))


@query("ag45_direction_consensus", f"SELECT participant_id, CASE WHEN count(DISTINCT direction)=1 THEN min(direction) ELSE 'mixed' END AS consensus, count(*) AS metrics FROM {CHANGE_SQL} c GROUP BY 1")
def ag45(t):
    return X.direction_consensus(changes(t))


@query("ag48_context_ablation", "SELECT province, round(avg(changed),6) AS changed_rate, count(DISTINCT action)>=2 AS two_outputs FROM (SELECT a.province, a.act AS action, CASE WHEN a.act<>b.act THEN 1.0 ELSE 0.0 END AS changed FROM (SELECT *, CASE WHEN cond=1 THEN 'recheck' WHEN n_orders>=3 THEN 'record' ELSE 'keep' END AS act FROM {panel} p) a JOIN (SELECT id, CASE WHEN cond=1 THEN 'recheck' WHEN n_orders>=3 THEN 'record' ELSE 'keep' END AS act FROM {panel} p WHERE wave=1) b ON a.id=b.id AND a.wave>1) x GROUP BY province")
def ag48(t):
    """Every variant against the participant's own baseline case."""
    action = F.when(F.col("cond") == 1, "recheck").when(F.col("n_orders") >= 3, "record").otherwise("keep")
    cases = t.panel.select("id", "wave", "province", action.alias("action"))
    base = cases.filter("wave = 1").select("id", F.col("action").alias("base_action"))
    joined = cases.filter("wave > 1").join(base, "id")
    return joined.groupBy("province").agg(
        r(F.avg((F.col("action") != F.col("base_action")).cast("double"))).alias("changed_rate"), (F.min("action") != F.max("action")).alias("two_outputs")
    )


@query("ag50_view_counter", "SELECT k AS article, count(*) AS views FROM {measurements} m WHERE metric='view' GROUP BY k")
def ag50(t):
    return t.measurements.filter("metric = 'view'").groupBy(F.col("k").alias("article")).agg(F.count(F.lit(1)).alias("views"))


@query(
    "ag51_daily_user_summary",
    f"""SELECT a.participant_id, CAST(a.day AS VARCHAR) AS day, round(score,6) AS score, todos, todos_done, alerts FROM (SELECT participant_id, CAST(ts AS DATE) AS day, count(*) FILTER (metric='click') AS todos, count(*) FILTER (metric='click' AND k%2=0) AS todos_done, count(*) FILTER (metric='error') AS alerts FROM {{measurements}} m GROUP BY participant_id, CAST(ts AS DATE)) a
        LEFT JOIN (SELECT participant_id, CAST(ts AS DATE) AS day, avg(score) AS score FROM {SCORE_SQL} s WHERE score IS NOT NULL GROUP BY participant_id, CAST(ts AS DATE)) b USING(participant_id, day)""",
)
def ag51(t):
    day = F.to_date("ts").alias("day")
    click = F.col("metric") == "click"
    counts = t.measurements.groupBy("participant_id", day).agg(
        F.count_if(click).alias("todos"), F.count_if(click & (F.col("k") % 2 == 0)).alias("todos_done"), F.count_if(F.col("metric") == "error").alias("alerts")
    )
    joined = counts.join(X.daily_score(scored(t)).select("participant_id", "day", "score"), ["participant_id", "day"], "left")
    return joined.select("participant_id", F.col("day").cast("string").alias("day"), r("score").alias("score"), "todos", "todos_done", "alerts")


@query("top1_newest_messages", "SELECT user_id, id, role, row_number() OVER (PARTITION BY user_id ORDER BY id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM {messages} m) x WHERE rn<=5")
def top1(t):
    five = skew.newest_n(t.messages, ["user_id"], [F.col("id").desc()], 5)
    return five.select("user_id", "id", "role", F.row_number().over(Window.partitionBy("user_id").orderBy("id")).alias("position"))


@query("set6_metric_catalogue", f"SELECT user_id, key, unit, value FROM (SELECT DISTINCT participant_id AS user_id, mtype AS key, CASE mtype WHEN 'bp' THEN 'mmHg' WHEN 'glucose' THEN 'mmol/L' ELSE 'bpm' END AS unit, arg_max(value,(ts,measurement_id)) AS value FROM {DUAL_SQL} d WHERE mtype<>'other' GROUP BY participant_id, mtype UNION ALL SELECT participant_id, 'custom_'||metric, NULL, value FROM {LATEST_SQL} l) x")
def set6(t):
    builtin = skew.latest(dual(t), ["participant_id", "mtype"], ["ts", "measurement_id"], ["value"]).join(definitions(t), "mtype")
    own = newest(t).select(F.col("participant_id").alias("user_id"), F.concat(F.lit("custom_"), "metric").alias("key"), "value")
    fixed = builtin.select(F.col("participant_id").alias("user_id"), F.col("mtype").alias("key"), "unit", "value")
    return fixed.unionByName(own, allowMissingColumns=True)


RULES = [
    ("bp_severe", "bp", 180.0, rules.INF, "urgent", "rest, repeat, call for help with danger signs", "now"),
    ("bp_high", "bp", 140.0, 180.0, "high", "repeat twice at fixed times", "today"),
    ("bp_recorded", "bp", 0.0, 140.0, "normal", "keep recording", "this week"),
    ("glucose_high", "glucose", 7.0, rules.INF, "high", "repeat under the same condition", "today"),
    ("glucose_recorded", "glucose", 0.0, 7.0, "normal", "record meal context", "this week"),
    ("hr_fast", "hr", 100.0, rules.INF, "high", "sit five minutes and repeat", "today"),
    ("steps_low", "other", 0.0, 30.0, "normal", "short safe walks", "this week"),
]
RULES_SQL = "(VALUES " + ",".join(f"('{n}','{m}',CAST({lo} AS DOUBLE),CAST({'1e300' if hi == rules.INF else hi} AS DOUBLE),'{p}','{a}','{s}')" for n, m, lo, hi, p, a, s in RULES) + ") AS ru(rule,mtype,lo,hi,priority,action,schedule)"
DUAL_LATEST = f"(SELECT participant_id, mtype, arg_max(value,(ts,measurement_id)) AS value, max(row(ts,measurement_id,value2))[3] AS value2 FROM {DUAL_SQL} d0 GROUP BY ALL)"
MATCHED = f"(SELECT participant_id, rule, priority, action, schedule, value FROM {DUAL_LATEST} v JOIN {RULES_SQL} ON ru.mtype=v.mtype AND value>=lo AND value<hi)"


def dual_latest(t):
    return skew.latest(dual(t), ["participant_id", "mtype"], ["ts", "measurement_id"], ["value", "value2"])


def rule_hits(t):
    table = t.spark.createDataFrame(RULES, X.RULE_COLUMNS)
    return X.matched_rules(dual_latest(t), table)


@query("jn15_rules_by_context", f"SELECT participant_id, rule, priority, value FROM {MATCHED} m")
def jn15(t):
    return rule_hits(t).select("participant_id", "rule", "priority", "value")


@query("kg19_personal_actions", f"SELECT participant_id, position, rule, action, schedule FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, rule) AS position FROM {MATCHED} m) x WHERE position<=4")
def kg19(t):
    return X.prioritised(rule_hits(t), "participant_id").select("participant_id", "position", "rule", "action", "schedule")


@query("top3_priority_order", f"SELECT participant_id, position, priority FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, rule) AS position FROM {MATCHED} m) x WHERE position<=2")
def top3(t):
    return X.prioritised(rule_hits(t), "participant_id", 2).select("participant_id", "position", "priority")


PLAN = [
    ("hypertension", 0, "measure morning and evening", None), ("hypertension", 1, "note salty food", None), ("hypertension", 2, "repeat at the same time", None),
    ("hypertension", 3, "move only with company", "fall_risk"), ("hypertension", 3, "twenty minutes of light activity", "no_fall_risk"),
    ("hypertension", 4, "record one night of sleep", None), ("hypertension", 5, "review the week", None), ("hypertension", 6, "contact a doctor if still high", None),
    ("diabetes", 0, "note meal context", None), ("diabetes", 1, "record meals", None), ("diabetes", 3, "repeat under the same condition", None),
    ("diabetes", 2, "light activity with company", "fall_risk"), ("diabetes", 6, "contact a doctor if still abnormal", None),
]
PLAN_SQL = "(VALUES " + ",".join(f"('{a}',{b},'{c}',{'NULL' if d is None else repr(d)})" for a, b, c, d in PLAN) + ") AS pl(topic,day_offset,action,needs)"


@query("kg20_weekly_plan", f"SELECT id, topic, day_offset, action FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day_offset, action) AS rn FROM (SELECT id, CASE WHEN sex=1 THEN 'hypertension' ELSE 'diabetes' END AS topic, age>=75 AS fall_risk FROM {{profile}} p) x JOIN {PLAN_SQL} USING(topic) WHERE needs IS NULL OR (needs='fall_risk' AND fall_risk) OR (needs='no_fall_risk' AND NOT fall_risk)) y WHERE rn<=7")
def kg20(t):
    template = t.spark.createDataFrame(PLAN, "topic string, day_offset int, action string, needs string")
    people = t.profile.select("id", F.when(F.col("sex") == 1, "hypertension").otherwise("diabetes").alias("topic"), (F.col("age") >= 75).alias("fall_risk"))
    return X.weekly_plan(people, template, "id").select("id", "topic", "day_offset", "action")


@query("kg21_factor_lists", f"SELECT participant_id, array_to_string(list_filter([CASE WHEN a THEN 'recent_bp' END, CASE WHEN b THEN 'recent_glucose' END, CASE WHEN c THEN 'fast_pulse' END], lambda x: x IS NOT NULL),',') AS matched, array_to_string(list_filter([CASE WHEN NOT a THEN 'recent_bp' END, CASE WHEN NOT b THEN 'recent_glucose' END, CASE WHEN NOT c THEN 'fast_pulse' END], lambda x: x IS NOT NULL),',') AS missing FROM (SELECT participant_id, bool_or(mtype='bp' AND k<30) AS a, bool_or(mtype='glucose' AND k<30) AS b, bool_or(mtype='hr' AND value>=100) AS c FROM {DUAL_SQL} d GROUP BY 1) x")
def kg21(t):
    flags = dual(t).groupBy("participant_id").agg(
        F.bool_or((F.col("mtype") == "bp") & (F.col("k") < 30)).alias("recent_bp"), F.bool_or((F.col("mtype") == "glucose") & (F.col("k") < 30)).alias("recent_glucose"),
        F.bool_or((F.col("mtype") == "hr") & (F.col("value") >= 100)).alias("fast_pulse"),
    )
    return X.factors(flags, "participant_id", ["recent_bp", "recent_glucose", "fast_pulse"])


@query("kg27_evidence_cards", f"""SELECT participant_id, mtype, l.value, direction, delta, data_points, flag_counts, position FROM (SELECT l.*, c.direction, c.delta, q.data_points, q.flag_counts, row_number() OVER (PARTITION BY participant_id ORDER BY mtype) AS position FROM {DUAL_LATEST} l JOIN {QUALITY} q USING(participant_id, mtype)
   JOIN (SELECT participant_id, mtype, round(lv-fv,2) AS delta, CASE WHEN abs(lv-fv)<=(CASE mtype WHEN 'bp' THEN 3.0 WHEN 'glucose' THEN 0.2 ELSE 1.0 END) THEN 'stable' WHEN lv>fv THEN 'rising' ELSE 'falling' END AS direction FROM (SELECT participant_id, mtype, arg_min(value,(ts,measurement_id)) AS fv, arg_max(value,(ts,measurement_id)) AS lv FROM {DUAL_SQL} d GROUP BY ALL) z) c USING(participant_id, mtype)) l WHERE position<=8""")
def kg27(t):
    """Latest value, trend and data quality of each metric side by side, at most eight per participant."""
    from tidemark.operators.series import first_last_change

    keys = ["participant_id", "mtype"]
    tolerance = F.when(F.col("mtype") == "bp", 3.0).when(F.col("mtype") == "glucose", 0.2).otherwise(1.0)
    trend = first_last_change(dual(t), keys, tolerance)
    cards = dual_latest(t).join(trend.select(*keys, "direction", "delta"), keys).join(X.quality_summary(flagged(t), keys), keys)
    numbered = cards.withColumn("position", F.row_number().over(Window.partitionBy("participant_id").orderBy("mtype")))
    return numbered.filter("position <= 8").select(*keys, "value", "direction", "delta", "data_points", "flag_counts", "position")


@query("kg28_user_context", f"SELECT participant_id, sum(n)::BIGINT AS data_points, array_to_string(list(mtype||'='||n ORDER BY mtype||'='||n),',') AS by_type, array_to_string(list(mtype||'='||CAST(CAST(round(v*100) AS BIGINT) AS VARCHAR) ORDER BY mtype||'='||CAST(CAST(round(v*100) AS BIGINT) AS VARCHAR)),',') AS latest, any_value(age) AS age, any_value(segment) AS segment FROM (SELECT participant_id, mtype, count(*) AS n, arg_max(value,(ts,measurement_id)) AS v FROM {DUAL_SQL} d GROUP BY ALL) x LEFT JOIN {{profile}} p ON p.id=participant_id GROUP BY 1")
def kg28(t):
    """One row per participant: counts and latest values per metric as maps, plus the profile."""
    per_type = dual(t).groupBy("participant_id", "mtype").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "measurement_id", "value"))["value"].alias("v")
    )
    maps = per_type.groupBy("participant_id").agg(
        F.sum("n").alias("data_points"), X.entry_text("mtype", F.col("n").cast("string")).alias("by_type"),
        X.entry_text("mtype", F.round(F.col("v") * 100).cast("long").cast("string")).alias("latest"),
    )
    people = t.profile.select(F.col("id").alias("participant_id"), "age", "segment")
    return maps.join(people, "participant_id", "left")


@query("ml17_feature_assembly", f"SELECT participant_id, max(CASE WHEN mtype='bp' THEN value END) AS systo, max(CASE WHEN mtype='bp' THEN value2 END) AS diasto, max(CASE WHEN mtype='hr' THEN value END) AS pulse, round(max(CASE WHEN mtype='glucose' THEN value END)*18.0,4) AS bl_glu, round(max(CASE WHEN mtype='other' THEN value END)/(any_value(height)*any_value(height)),4) AS bmi, any_value(age) AS age, any_value(sex) AS sex FROM {DUAL_LATEST} l LEFT JOIN {{profile}} p ON p.id=participant_id GROUP BY 1")
def ml17(t):
    wide = dual_latest(t).groupBy("participant_id").agg(
        *[F.max(F.when(F.col("mtype") == m, F.col(c))).alias(n) for n, m, c in (("systo", "bp", "value"), ("diasto", "bp", "value2"), ("pulse", "hr", "value"), ("g", "glucose", "value"), ("w", "other", "value"))]
    )
    people = t.profile.select(F.col("id").alias("participant_id"), "age", "sex", "height")
    joined = wide.join(people, "participant_id", "left")
    return joined.select("participant_id", "systo", "diasto", "pulse", r(F.col("g") * rules.UNIT_FACTORS["glucose"], 4).alias("bl_glu"), C.body_mass_index("w", "height").alias("bmi"), "age", "sex")
