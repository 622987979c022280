"""Evaluation queries on the prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as E, skew
from tidemark.plans.registry import query

TENTHS = [i / 10 for i in range(11)]
CUSTOM = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0]


def r(c, n=6):
    return F.round(c, n)


NUMERIC = """count(*) AS n, count(a) AS accepted_n, round(avg(abs(e)),4) AS mae, round(sqrt(avg(e*e)),4) AS rmse, round(avg(e),4) AS bias,
   round(1-sum(e*e)/(var_pop(a)*count(a)),6) AS r2, round(1-avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END),6) AS refusal_rate"""
ERR_SQL = "(SELECT *, CASE WHEN accepted THEN actual END AS a, CASE WHEN accepted THEN actual-predicted END AS e, CASE WHEN accepted THEN actual-baseline_pred END AS b FROM {pred_numeric} n0)"


def errors(t):
    return E.error_set(F.col("actual"), F.col("predicted"), F.col("accepted"))


def rounded(df, digits=4, six=("r2", "refusal_rate")):
    return df.select([
        r(c, 6 if c in six else digits).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns
    ])


@query("ag14_error_set", f"SELECT metric, split, {NUMERIC}, round(avg(abs(e))/greatest(avg(abs(b)),1e-9),6) AS mase FROM {ERR_SQL} x GROUP BY ALL")
def ag14(t):
    n = t.pred_numeric
    scale = F.avg(F.when(F.col("accepted"), F.abs(F.col("actual") - F.col("baseline_pred"))))
    out = n.groupBy("metric", "split").agg(*errors(t), scale.alias("_s"))
    return rounded(out.withColumn("mase", F.col("mae") / F.greatest(F.col("_s"), F.lit(1e-9))).drop("_s"), six=("r2", "refusal_rate", "mase"))


@query(
    "ag15_interval_coverage",
    "SELECT metric, split, round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END),6) AS coverage, round(avg(upper-lower),4) AS width FROM {pred_numeric} n GROUP BY ALL",
)
def ag15(t):
    out = t.pred_numeric.groupBy("metric", "split").agg(*E.interval_set(F.col("actual"), F.col("lower"), F.col("upper")))
    return rounded(out, six=("coverage",))


@query(
    "ag16_conformal_quantile",
    "SELECT split, round(quantile_cont(abs(actual-predicted),0.8),4) AS q80 FROM {pred_numeric} n GROUP BY split",
)
def ag16(t):
    """Three groups hold all residuals, so the rank is found by counting and never by collecting a group."""
    residuals = t.pred_numeric.select("split", F.abs(F.col("actual") - F.col("predicted")).alias("res"))
    return skew.quantiles(residuals, ["split"], "res", {"q80": 0.8}).withColumn("q80", r("q80", 4))


@query("ag16_conformal_quantile_overall", "SELECT round(quantile_cont(abs(actual-predicted),0.8),4) AS q80, round(median(abs(actual-predicted)),4) AS q50 FROM {pred_numeric} n")
def ag16_all(t):
    residuals = t.pred_numeric.select(F.abs(F.col("actual") - F.col("predicted")).alias("res"))
    out = skew.quantiles(residuals, [], "res", {"q80": 0.8, "q50": 0.5})
    return out.select(r("q80", 4).alias("q80"), r("q50", 4).alias("q50"))


CONF = "count(*) FILTER (y=0 AND p<0.3) AS tn, count(*) FILTER (y=0 AND p>=0.3) AS fp, count(*) FILTER (y=1 AND p<0.3) AS fn, count(*) FILTER (y=1 AND p>=0.3) AS tp"
CONF_SQL = f"""SELECT *, CASE WHEN precision+recall>0 THEN round(2*precision*recall/(precision+recall),6) ELSE 0 END AS f1 FROM (SELECT segment, tn, fp, fn, tp,
   CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall, CASE WHEN tn+fp>0 THEN tn/(tn+fp) ELSE 0 END AS specificity
   FROM (SELECT segment, {CONF} FROM {{pred_risk}} r GROUP BY segment) c) d"""


@query("ag17_confusion_rates", f"SELECT segment, tn, fp, fn, tp, round(precision,6) AS precision, round(recall,6) AS recall, round(specificity,6) AS specificity, f1 FROM ({CONF_SQL}) z")
def ag17(t):
    c = t.pred_risk.groupBy("segment").agg(*E.confusion(F.col("y"), F.col("p") >= 0.3))
    return rounded(E.rates(c), 6)


@query(
    "ag18_brier_logloss",
    "SELECT segment, round(avg((p-y)*(p-y)),6) AS brier, round(avg(CASE WHEN y=1 THEN -ln(least(greatest(p,1e-6),1-1e-6)) ELSE -ln(1-least(greatest(p,1e-6),1-1e-6)) END),6) AS log_loss FROM {pred_risk} r GROUP BY segment",
)
def ag18(t):
    y, p = F.col("y"), F.col("p")
    return t.pred_risk.groupBy("segment").agg(r(E.brier(y, p)).alias("brier"), r(E.log_loss(y, p)).alias("log_loss"))


def rank_sql(key, rows, p="p"):
    """Mann-Whitney with half ties and average precision, from the score histogram."""
    return f"""(SELECT {key}, sum(pos+neg)::BIGINT AS n, sum(pos)::BIGINT AS positives, round(CASE WHEN sum(pos)*sum(neg)>0 THEN sum(neg*(tp-pos/2.0))/(CAST(sum(pos) AS DOUBLE)*sum(neg)) END,6) AS auroc,
      round(CASE WHEN sum(pos)>0 THEN sum(pos*tp/(tp+fp))/sum(pos) END,6) AS pr_auc FROM (
      SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT {key}, {p} AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1-y) AS DOUBLE) AS neg FROM {rows} r1 GROUP BY {key}, {p}) h
      WINDOW w AS (PARTITION BY {key} ORDER BY s DESC)) q GROUP BY {key})"""


def ranked(rows, keys, p="p"):
    return E.ranking_metrics(E.running_counts(E.score_histogram(rows, keys, p=p), keys), keys)


ALL_RISK = "(SELECT 1 AS g, * FROM {pred_risk} r0)"


@query("ag19_auroc", f"SELECT n, positives, auroc FROM {rank_sql('g', ALL_RISK)} z")
def ag19(t):
    return ranked(t.pred_risk, []).select("n", "positives", r("auroc").alias("auroc"))


@query("ag20_average_precision", f"SELECT segment, n, positives, auroc, pr_auc FROM {rank_sql('segment', '{pred_risk}')} z")
def ag20(t):
    return ranked(t.pred_risk, ["segment"]).select("segment", "n", "positives", r("auroc").alias("auroc"), r("pr_auc").alias("pr_auc"))


@query(
    "win14_roc_running_totals",
    "SELECT p, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM (SELECT p, sum(y) AS pos, sum(1-y) AS neg FROM {pred_risk} r GROUP BY p) h WINDOW w AS (ORDER BY p DESC)",
)
def win14(t):
    return E.running_counts(E.score_histogram(t.pred_risk, []), []).select("p", "tp", "fp")


def bins_sql(edges):
    arms = " ".join(f"WHEN p<{hi} THEN {i}" for i, hi in enumerate(edges[1:-1]))
    return f"SELECT bin, n, mean_p, observed, CAST([{','.join(map(str, edges))}][bin+1] AS DOUBLE) AS lower FROM (SELECT CASE {arms} ELSE {len(edges) - 2} END AS bin, count(*) AS n, round(avg(p),6) AS mean_p, round(avg(y),6) AS observed FROM {{pred_risk}} r GROUP BY 1) b"


@query("ag21_calibration_equal_width", bins_sql(TENTHS))
def ag21(t):
    b = E.calibration_bins(t.pred_risk, [], TENTHS)
    return b.select("bin", "n", r("mean_p").alias("mean_p"), r("observed").alias("observed"), "lower")


@query("ag22_calibration_custom_edges", bins_sql(CUSTOM))
def ag22(t):
    b = E.calibration_bins(t.pred_risk, [], CUSTOM)
    return b.select("bin", "n", r("mean_p").alias("mean_p"), r("observed").alias("observed"), "lower")


@query(
    "ag23_calibration_line",
    "SELECT segment, round(regr_slope(y,z),6) AS slope, round(regr_intercept(y,z),6) AS intercept FROM (SELECT segment, y, ln(least(greatest(p,1e-5),1-1e-5)/(1-least(greatest(p,1e-5),1-1e-5))) AS z FROM {pred_risk} r) x GROUP BY segment",
)
def ag23(t):
    return rounded(E.calibration_line(t.pred_risk, ["segment"]), 6)


@query("ag24_calibration_logistic", None)
def ag24(t):
    return E.calibration_logistic(t.pred_risk)


T_SQL = "(VALUES " + ",".join(f"(CAST({x} AS DOUBLE))" for x in E.THRESHOLDS) + ") AS ts(threshold)"
CURVE_SQL = f"""SELECT threshold, tp, fp, round(tp/n-fp/n*(threshold/(1-threshold)),6) AS net_benefit, round(prev-(1-prev)*(threshold/(1-threshold)),6) AS treat_all, 0.0 AS treat_none FROM (
   SELECT threshold, count(*) AS n, avg(y) AS prev, count(*) FILTER (p>=threshold AND y=1) AS tp, count(*) FILTER (p>=threshold AND y=0) AS fp FROM {{pred_risk}} r, {T_SQL} GROUP BY threshold) x"""


@query("ag25_decision_curve", CURVE_SQL)
def ag25(t):
    return rounded(E.decision_curve(t.pred_risk, []).withColumn("threshold", F.col("threshold")), 6)


@query("jn16_threshold_table", f"SELECT segment, threshold, count(*) FILTER (p>=threshold AND y=1) AS tp, count(*) FILTER (p>=threshold AND y=0) AS fp FROM {{pred_risk}} r, {T_SQL} GROUP BY ALL")
def jn16(t):
    return E.decision_curve(t.pred_risk, ["segment"]).select("segment", "threshold", "tp", "fp")


SWEEP = """SELECT arg_max(p, (round(f1,9), -p)) AS best_f1_threshold, arg_max(p, (round(j,9), p)) AS best_youden_threshold,
   least(greatest(arg_max(p, (round(j,9), p)),0.05),0.5) AS clipped_youden_threshold, coalesce(arg_max(p, (round(rec,9), -p)) FILTER (spec>=0.6),0.5) AS best_recall_threshold FROM (
   SELECT p, 2*tp/(tp+fp+pp) AS f1, tp/pp-fp/nn AS j, tp/pp AS rec, 1-fp/nn AS spec FROM (SELECT p, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS pp, CAST(sum(neg) OVER () AS DOUBLE) AS nn
     FROM (SELECT p_alt AS p, sum(CASE WHEN id%5=0 THEN 1-y ELSE y END) AS pos, sum(1-(CASE WHEN id%5=0 THEN 1-y ELSE y END)) AS neg FROM {pred_risk} r GROUP BY 1) h WINDOW w AS (ORDER BY p DESC)) c) d"""


@query("ag26_threshold_sweep", SWEEP)
def ag26(t):
    noisy = t.pred_risk.withColumn("y", F.when(F.col("id") % 5 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return E.threshold_sweep(E.running_counts(E.score_histogram(noisy, [], p="p_alt"), []), [])


@query("ag27_bootstrap_interval", None)
def ag27(t):
    """Raw scores: equal scores share one draw, nothing is rounded."""
    return E.bootstrap_interval(E.score_histogram(t.pred_risk, []))


@query(
    "ag28_subgroup_audit",
    f"""SELECT dimension, label, {NUMERIC} FROM (SELECT 'status' AS dimension, status_group AS label, a, e, accepted FROM {ERR_SQL} x UNION ALL
        SELECT 'device', CAST(device AS VARCHAR), a, e, accepted FROM {ERR_SQL} x UNION ALL SELECT 'line', CAST(line AS VARCHAR), a, e, accepted FROM {ERR_SQL} x) u GROUP BY ALL HAVING count(*)>=20""",
)
def ag28(t):
    long = E.long_dimensions(t.pred_numeric, {"status": F.col("status_group"), "device": F.col("device"), "line": F.col("line")})
    return rounded(long.groupBy("dimension", "label").agg(*errors(t)).filter(F.col("n") >= 20))


@query("ag28_subgroup_risk", f"SELECT * FROM {rank_sql('segment', '{pred_risk}')} z WHERE n>=20")
def ag28_risk(t):
    out = ranked(t.pred_risk, ["segment"]).filter(F.col("n") >= 20)
    return out.select("segment", "n", "positives", r("auroc").alias("auroc"), r("pr_auc").alias("pr_auc"))


@query(
    "ag29_evaluation_matrix",
    f"""SELECT 'numeric' AS task, split, metric, count(*) AS n, round(avg(abs(e)),4) AS main_error, round(1-avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END),6) AS refusal_rate FROM {ERR_SQL} x GROUP BY ALL
        UNION ALL SELECT 'risk', CASE WHEN {{fraction:id}}<0.7 THEN 'train' WHEN {{fraction:id}}<0.85 THEN 'validation' ELSE 'test' END, segment, count(*), round(avg((p-y)*(p-y)),4), 0.0 FROM {{pred_risk}} r GROUP BY ALL""",
)
def ag29(t):
    from tidemark.operators.panel import stable_split

    numeric = t.pred_numeric.groupBy("split", "metric").agg(*errors(t)).select(
        F.lit("numeric").alias("task"), "split", "metric", "n", r("mae", 4).alias("main_error"), r("refusal_rate").alias("refusal_rate")
    )
    risk = t.pred_risk.groupBy(stable_split(F.col("id")).alias("split"), F.col("segment").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), r(E.brier(F.col("y"), F.col("p")), 4).alias("main_error"), F.lit(0.0).alias("refusal_rate")
    )
    return numeric.unionByName(risk.select(F.lit("risk").alias("task"), "*"))


@query(
    "ag30_enablement_rule",
    f"SELECT metric, round(avg(abs(actual-predicted)),4) AS mae_complex, round(avg(abs(actual-baseline_pred)),4) AS mae_simple, avg(abs(actual-predicted)) <= 0.98*avg(abs(actual-baseline_pred)) AS enabled FROM {{pred_numeric}} n GROUP BY metric",
)
def ag30(t):
    c, s = F.avg(F.abs(F.col("actual") - F.col("predicted"))), F.avg(F.abs(F.col("actual") - F.col("baseline_pred")))
    return t.pred_numeric.groupBy("metric").agg(r(c, 4).alias("mae_complex"), r(s, 4).alias("mae_simple"), (c <= 0.98 * s).alias("enabled"))


@query(
    "ag30_enablement_rule_risk",
    f"""SELECT a.segment, round(a.pr_auc,6) AS pr_complex, round(b.pr_auc,6) AS pr_simple, coalesce(a.pr_auc,0)>=coalesce(b.pr_auc,0)+0.01 AND ba<=bb*1.05 AS enabled FROM {rank_sql('segment', '{pred_risk}')} a
        JOIN {rank_sql('segment', '{pred_risk}', 'p_alt')} b USING(segment) JOIN (SELECT segment, avg((p-y)*(p-y)) AS ba, avg((p_alt-y)*(p_alt-y)) AS bb FROM {{pred_risk}} r GROUP BY segment) c USING(segment)""",
)
def ag30_risk(t):
    rows = t.pred_risk
    long = rows.select("segment", "y", F.explode(F.array(
        F.struct(F.lit("complex").alias("model"), F.col("p").alias("p")), F.struct(F.lit("simple").alias("model"), F.col("p_alt").alias("p"))
    )).alias("m")).select("segment", "y", "m.*")
    ranks = ranked(long, ["segment", "model"]).select("segment", "model", "pr_auc")
    losses = long.groupBy("segment", "model").agg(E.brier(F.col("y"), F.col("p")).alias("brier"))
    wide = ranks.join(losses, ["segment", "model"]).groupBy("segment").pivot("model", ["complex", "simple"]).agg(F.first("pr_auc").alias("pr"), F.first("brier").alias("b"))
    won = (F.coalesce("complex_pr", F.lit(0.0)) >= F.coalesce("simple_pr", F.lit(0.0)) + 0.01) & (F.col("complex_b") <= F.col("simple_b") * 1.05)
    return wide.select("segment", r("complex_pr").alias("pr_complex"), r("simple_pr").alias("pr_simple"), won.alias("enabled"))


@query(
    "jn11_paired_series",
    """SELECT a.participant_id, a.record, a.line, round(a.high,6) AS high, round(b.low,6) AS low FROM (SELECT participant_id, record, line, avg(high) AS high FROM {paired} p GROUP BY ALL) a
       JOIN (SELECT participant_id, record, line, avg(low) AS low FROM {paired} p GROUP BY ALL) b USING(participant_id, record, line)""",
)
def jn11(t):
    """Component series meet on (participant, instant); collapsing and pairing are a single aggregate, no join."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("v")) for c in ("high", "low")]))
    long = t.paired.select("participant_id", "record", "line", parts.alias("p")).select("participant_id", "record", "line", "p.*")
    return pair_parts(long, ["participant_id", "record", "line"], ("high", "low"))


def pair_parts(long, on, parts):
    means = [r(F.avg(F.when(F.col("part") == c, F.col("v")))).alias(c) for c in parts]
    return long.groupBy(*on).agg(*means).dropna(subset=list(parts))
