"""Model queries on the panel: preparation, fitting, calibration, comparison and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as E, learn as L, panel as P
from tidemark.operators.skew import quantiles
from tidemark.plans.panel import INCIDENT_SQL, incidents
from tidemark.plans.registry import query
from tidemark.session import fresh_path

FEATURES = ["n_orders", "sum_price", "max_price", "share_f", "balance"]


def r(c, n=6):
    return F.round(c, n)


SPLIT_SQL = "CASE WHEN {fraction:id}<0.7 THEN 'train' WHEN {fraction:id}<0.85 THEN 'validation' ELSE 'test' END"
ROWS_SQL = f"(SELECT i.*, CASE WHEN acctbal>=0 THEN acctbal END AS balance, {SPLIT_SQL} AS part FROM {INCIDENT_SQL} i)"


def study(t):
    """At-risk person-waves with a feature that is missing for debtors, split by person."""
    rows = incidents(t).withColumn("balance", F.when(F.col("acctbal") >= 0, F.col("acctbal")))
    return rows.withColumn("part", P.stable_split(F.col("id")))


def part(rows, name):
    return rows.filter(F.col("part") == name)


@query(
    "ml6_median_imputation",
    f"SELECT id, wave, coalesce(balance, (SELECT median(balance) FROM {ROWS_SQL} t WHERE part='train')) AS balance, CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END AS missing FROM {ROWS_SQL} s",
)
def ml6(t):
    rows = study(t)
    ready = L.prepare(part(rows, "train"), FEATURES)
    return ready.imputed(rows).select("id", "wave", F.col("i_balance").alias("balance"), F.col("m_balance").alias("missing"))


@query(
    "ml7_standardise",
    f"SELECT id, wave, round((sum_price-m)/d,5) AS z FROM {ROWS_SQL} s, (SELECT avg(sum_price) AS m, stddev_pop(sum_price) AS d FROM {ROWS_SQL} t WHERE part='train') p",
)
def ml7(t):
    rows = study(t)
    return L.prepare(part(rows, "train"), FEATURES).scaled(rows).select("id", "wave", r("s_sum_price", 5).alias("z"))


def numeric_pairs(t):
    """Next wave's spending from this wave's features."""
    panel = t.panel.withColumn("balance", F.when(F.col("acctbal") >= 0, F.col("acctbal")))
    after = t.panel.select("id", (F.col("wave") - 1).alias("wave"), F.col("sum_price").alias("target"))
    return panel.join(after, ["id", "wave"]).withColumn("part", P.stable_split(F.col("id")))


@query("ml8_ridge", None)
def ml8(t):
    rows = numeric_pairs(t)
    train = part(rows, "train")
    ready = L.prepare(train, FEATURES)
    scored = L.ridge(ready.vectors(train), "target").transform(ready.vectors(part(rows, "test")))
    return scored.agg(*E.error_set(F.col("target"), F.col("prediction")))


@query("ml9_balanced_logistic", None)
def ml9(t):
    rows = study(t)
    ready = L.prepare(part(rows, "train"), FEATURES)
    model = L.logistic(ready.vectors(part(rows, "train")), "y")
    return L.summary(L.with_probability(model, ready.vectors(rows)), ["part"])


@query("ml10_boosted_trees", None)
def ml10(t):
    rows = study(t)
    ready = L.prepare(part(rows, "train"), FEATURES)
    model = L.boosted_classifier(ready.vectors(part(rows, "train")), "y")
    return L.summary(L.with_probability(model, ready.vectors(rows)), ["part"])


def oof(t, k=5):
    rows = part(study(t), "train").select("id", "wave", "y", *FEATURES).persist()
    return L.out_of_fold(rows, FEATURES, "y", "id", L.logistic, k)


@query("ml11_calibration", None)
def ml11(t):
    """Platt and isotonic maps fitted on out-of-fold scores, compared by Brier score."""
    scores = oof(t).select("y", "p").persist()
    mapped = scores.withColumn("platt", L.platt(scores, "y")(F.col("p"))).withColumn("s", F.col("p"))
    both = L.isotonic(scores, "y").transform(mapped).withColumnRenamed("prediction", "isotonic")
    y = F.col("y")
    return both.agg(*[E.brier(y, F.col(c)).alias(n) for c, n in (("p", "raw"), ("platt", "platt"), ("isotonic", "isotonic"))])


@query("ml12_out_of_fold", None)
def ml12(t):
    return L.summary(oof(t), ["fold"])


@query("ml13_feature_ablation", None)
def ml13(t):
    """One row of metrics per feature set; a driver loop over three fits."""
    rows = study(t).persist()
    sets = {"all": FEATURES, "spending": ["sum_price", "max_price"], "status": ["share_f", "n_orders"]}
    out = None
    for name, columns in sets.items():
        ready = L.prepare(part(rows, "train"), columns)
        model = L.logistic(ready.vectors(part(rows, "train")), "y")
        scored = L.with_probability(model, ready.vectors(part(rows, "validation")))
        row = L.summary(scored.withColumn("feature_set", F.lit(name)), ["feature_set"])
        out = row if out is None else out.unionByName(row)
    return out


PAIRS_SQL = f"(SELECT a.id, a.wave, a.sum_price AS last_value, b.sum_price AS target, {SPLIT_SQL.replace('{fraction:id}', '{fraction:a.id}')} AS part FROM {{panel}} a JOIN {{panel}} b ON a.id=b.id AND b.wave=a.wave+1)"


@query(
    "ml14_naive_candidates",
    f"SELECT part, round(avg(abs(target-last_value)),4) AS last_value_mae, round(avg(abs(target-med)),4) AS median_mae, CASE WHEN avg(abs(target-last_value))<=avg(abs(target-med)) THEN 'last_value' ELSE 'median' END AS selected FROM {PAIRS_SQL} s, (SELECT median(target) AS med FROM {PAIRS_SQL} t WHERE part='train') m GROUP BY part",
)
def ml14(t):
    rows = numeric_pairs(t)
    middle = quantiles(part(rows, "train"), [], "target", {"med": 0.5})
    last, flat = F.avg(F.abs(F.col("target") - F.col("sum_price"))), F.avg(F.abs(F.col("target") - F.col("med")))
    return rows.crossJoin(F.broadcast(middle)).groupBy("part").agg(  # one row on the right
        r(last, 4).alias("last_value_mae"), r(flat, 4).alias("median_mae"), F.when(last <= flat, "last_value").otherwise("median").alias("selected")
    )


@query("ml14_candidate_selection", None)
def ml14_models(t):
    """Last value, ridge and boosting on the validation part; boosting needs a two percent gain."""
    rows = numeric_pairs(t).persist()
    train = part(rows, "train")
    ready = L.prepare(train, FEATURES)
    vectors, check = ready.vectors(train), ready.vectors(part(rows, "validation"))
    linear = L.ridge(vectors, "target").transform(check).withColumnRenamed("prediction", "linear")
    scored = L.boosted_regressor(vectors, "target").transform(linear).withColumnRenamed("prediction", "boosting")
    mae = scored.agg(*[F.avg(F.abs(F.col("target") - F.col(c))).alias(n) for c, n in (("sum_price", "last_value"), ("linear", "linear"), ("boosting", "boosting"))])
    simple = F.least("last_value", "linear")
    chosen = F.when(F.col("boosting") <= 0.98 * simple, "boosting").when(F.col("last_value") <= F.col("linear"), "last_value").otherwise("linear")
    return mae.withColumn("selected", chosen)


@query("ml15_feature_importance", None)
def ml15(t):
    """Gain of the boosted model and the AUROC lost when a feature is permuted."""
    rows = study(t).persist()
    ready = L.prepare(part(rows, "train"), FEATURES)
    model = L.boosted_classifier(ready.vectors(part(rows, "train")), "y")
    gains = dict(zip(ready.inputs, model.featureImportances.toArray().tolist()))
    check = part(rows, "validation")
    variants = [("", check)] + [(c, L.permuted(check, c, F.concat_ws("-", "id", "wave"), 42)) for c in FEATURES]
    scored = None
    for name, frame in variants:
        one = L.with_probability(model, ready.vectors(frame)).select(F.lit(name).alias("feature"), "y", "p")
        scored = one if scored is None else scored.unionByName(one)
    ranks = L.summary(scored, ["feature"]).select("feature", "auroc")
    base = ranks.filter("feature = ''").select(F.col("auroc").alias("base"))
    gain = F.element_at(F.create_map(*[F.lit(x) for c in FEATURES for x in (c, gains[f"s_{c}"] + gains[f"m_{c}"])]), F.col("feature"))
    return ranks.filter("feature <> ''").crossJoin(F.broadcast(base)).select("feature", gain.alias("gain"), (F.col("base") - F.col("auroc")).alias("auroc_loss"))


@query("ml16_scoring_with_abstention", None)
def ml16(t):
    """Conformal half width from the validation part; rows with too few features get no point."""
    rows = numeric_pairs(t)
    train = part(rows, "train")
    ready = L.prepare(train, FEATURES)
    model = L.ridge(ready.vectors(train), "target")
    check = model.transform(ready.vectors(part(rows, "validation"))).select(F.abs(F.col("target") - F.col("prediction")).alias("res"))
    half = quantiles(check, [], "res", {"q": 0.8}).first()["q"]
    typical = quantiles(train, [], "target", {"m": 0.5}).first()["m"]
    scored = L.abstaining(model.transform(ready.vectors(part(rows, "test"))), FEATURES, half, typical, share=2.0, least=0.9)
    return scored.select("id", "wave", "completeness", "abstained", "point", "lower", "upper")


@query("ml20_frozen_model_scoring", None)
def ml20(t):
    """A saved model scores another period without refitting."""
    from pyspark.ml.classification import LogisticRegressionModel

    rows = study(t)
    early = rows.filter("wave <= 3")
    ready = L.prepare(early, FEATURES)
    path = fresh_path(t.spark, "model")
    L.logistic(ready.vectors(early), "y").write().overwrite().save(path)
    frozen = LogisticRegressionModel.load(path)
    late = P.drop_ids(rows.filter("wave > 3"), early).withColumn("cohort", F.lit("disjoint")).unionByName(rows.filter("wave > 3").withColumn("cohort", F.lit("later waves")))
    return L.summary(L.with_probability(frozen, ready.vectors(late)), ["cohort"])
