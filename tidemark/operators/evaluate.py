"""Evaluation of predictions as distributed aggregates.

Ranking metrics never sort raw rows: scores are first counted per distinct value, then accumulated in score chunks whose
offsets come from a table with at most ``CHUNKS + 1`` rows per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import prefix_sums

CHUNKS = 1000
PIECE = 2048


def score_histogram(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys, F.col(p).alias("p")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).cast("long").alias("neg"),
    )


def running_counts(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives when everything scored at least ``p`` is called positive."""
    chunked = histogram.withColumn("_chunk", F.floor(F.col("p") * CHUNKS))
    return prefix_sums(chunked, keys, "_chunk", [F.col("p").desc()], {"pos": "tp", "neg": "fp"}, descending=True).drop("_chunk")


def ranking_metrics(running: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC with half credit for ties and average precision; NULL where a class is absent."""
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    positives, negatives = F.sum("pos"), F.sum("neg")
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return running.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), positives.alias("positives"),
        F.try_divide(pairs, positives.cast("double") * negatives).alias("auroc"),
        F.try_divide(precision, positives).alias("pr_auc"),
    )


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = clipped(p, eps)
    return F.ln(c / (1 - c))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(y: Column, p: Column) -> Column:
    c = clipped(p)
    return F.avg(F.when(y == 1, -F.ln(c)).otherwise(-F.ln(1 - c)))


def confusion(y: Column, called: Column) -> list[Column]:
    """Counts of the confusion matrix."""
    return [
        F.count_if((y == 0) & ~called).alias("tn"), F.count_if((y == 0) & called).alias("fp"),
        F.count_if((y == 1) & ~called).alias("fn"), F.count_if((y == 1) & called).alias("tp"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, specificity and F1 from tn, fp, fn, tp; zero where undefined."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))

    out = df.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn")).withColumn("specificity", share("tn", "fp"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def calibration_bins(df: DataFrame, keys: list[str], edges: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """Rows, mean score and observed rate per bin; bins are [lo, hi), the last is closed, empty bins are absent."""
    number = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        number = F.when(F.col(p) >= edges[i], i).otherwise(number) if i == len(edges) - 2 else F.when(F.col(p) < edges[i + 1], i).otherwise(number)
    lower = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return (
        df.withColumn("bin", number).groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))
        .withColumn("lower", lower)
    )


def calibration_line(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Least-squares line of the outcome on the clipped log odds."""
    z = logit(F.col(p), 1e-5)
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), z).alias("slope"), F.regr_intercept(F.col(y), z).alias("intercept"))


def calibration_logistic(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Logistic recalibration: coefficients of a one-feature fit on the log odds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    z = df.select(F.col(y).cast("double").alias("label"), logit(F.col(p)).alias("z"))
    model = LogisticRegression(maxIter=100, regParam=0.0, standardization=False).fit(
        VectorAssembler(inputCols=["z"], outputCol="features").transform(z)
    )
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


THRESHOLDS = (0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5)


def decision_curve(df: DataFrame, keys: list[str], thresholds=THRESHOLDS, y: str = "y", p: str = "p") -> DataFrame:
    """Net benefit per threshold; one aggregate pass, the thresholds become columns and are unpivoted afterwards."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("prev"),
        *[F.count_if((F.col(p) >= t) & (F.col(y) == 1)).alias(f"tp_{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((F.col(p) >= t) & (F.col(y) == 0)).alias(f"fp_{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"),
                 F.lit(t / (1 - t)).alias("odds"))
        for i, t in enumerate(thresholds)
    ]))
    long = counts.select(*keys, "n", "prev", rows.alias("_r")).select(*keys, "n", "prev", "_r.*")
    return long.select(
        *keys, "threshold", "tp", "fp",
        (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * F.col("odds")).alias("net_benefit"),
        (F.col("prev") - (1 - F.col("prev")) * F.col("odds")).alias("treat_all"),
        F.lit(0.0).alias("treat_none"),
    )


def threshold_sweep(running: DataFrame, keys: list[str], floor: float = 0.60) -> DataFrame:
    """Best F1, best Youden J (also clipped to [0.05, 0.5]) and best recall at a specificity floor.

    Equal values are settled towards the lowest threshold for F1 and recall, the highest for Youden.
    """
    totals = running.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    if keys:
        joined = running.join(totals, keys)
    else:  # a single row
        joined = running.crossJoin(F.broadcast(totals))
    recall, fall = F.col("tp") / F.col("_P"), F.col("fp") / F.col("_N")
    scored = joined.select(
        *keys, "p", (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("_P"))).alias("_f1"),
        (recall - fall).alias("_j"), recall.alias("_r"), (1 - fall).alias("_s"),
    )

    def ranked(name: str, sign: int) -> Column:
        return F.struct(F.round(name, 9).alias("value"), (F.col("p") * sign).alias("tie"))

    pick = scored.groupBy(*keys).agg(
        F.max(ranked("_f1", -1)).alias("_a"), F.max(ranked("_j", 1)).alias("_b"),
        F.max(F.when(F.col("_s") >= floor, ranked("_r", -1))).alias("_c"),
    )

    def arg(name: str, sign: int) -> Column:
        return F.col(name)["tie"] * sign

    return pick.select(
        *keys, arg("_a", -1).alias("best_f1_threshold"), arg("_b", 1).alias("best_youden_threshold"),
        F.least(F.greatest(arg("_b", 1), F.lit(0.05)), F.lit(0.50)).alias("clipped_youden_threshold"),
        F.coalesce(arg("_c", -1), F.lit(0.5)).alias("best_recall_threshold"),
    )


def bootstrap_interval(histogram: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Resampling intervals of AUROC, Brier score and log loss.

    Poisson(1) weights of n equal rows add up to one Poisson(n) draw, so the resampling runs on the score histogram:
    its size depends on the score resolution, not on the number of rows. Scores lie in falling order over the tasks; a task draws PIECE of
    them at a time and gives their sums per replicate, in which pairs count positives of the piece only: those above are added per piece.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PIECE):
                p, pos, neg = (batch[c].to_numpy()[at:at + PIECE] for c in ("p", "pos", "neg"))
                drawn = np.empty((2, len(p), replicates), np.int64)
                for i, score in enumerate(p):
                    rng = np.random.default_rng([seed, int(round(score * 1e9))])
                    drawn[0, i], drawn[1, i] = rng.poisson(pos[i], replicates), rng.poisson(neg[i], replicates)
                (pos, neg), c = drawn, np.clip(p, 1e-6, 1 - 1e-6)
                yield pd.DataFrame({
                    "p": p[0], "replicate": np.arange(replicates), "pos": pos.sum(axis=0), "neg": neg.sum(axis=0),
                    "pairs": (neg * (pos.cumsum(axis=0) - pos / 2)).sum(axis=0), "brier": (1 - p) ** 2 @ pos + p ** 2 @ neg, "log_loss": -np.log(c) @ pos - np.log(1 - c) @ neg,
                })

    ordered = histogram.select("p", "pos", "neg").repartitionByRange(F.col("p").desc()).sortWithinPartitions(F.col("p").desc())
    pieces = ordered.mapInPandas(sums, "p double, replicate int, pos long, neg long, pairs double, brier double, log_loss double")
    above = F.coalesce(F.sum("pos").over(Window.partitionBy("replicate").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = pieces.withColumn("pairs", F.col("pairs") + F.col("neg") * above).groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "pairs", "brier", "log_loss")]
    )
    n = F.col("pos") + F.col("neg")
    ranks = whole.select(
        F.try_divide("pairs", F.col("pos").cast("double") * F.col("neg")).alias("auroc"), F.try_divide("brier", n).alias("brier"), F.try_divide("log_loss", n).alias("log_loss"),
    ).filter(F.col("auroc").isNotNull())
    long = ranks.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("auroc", "brier", "log_loss")])).alias("_m")
    ).select("_m.*")
    return long.groupBy("metric").agg(
        F.count("v").alias("n_bootstrap"), F.avg("v").alias("estimate"),
        F.percentile("v", F.lit(0.025)).alias("lower"), F.percentile("v", F.lit(0.975)).alias("upper"),
    )


def error_set(actual: Column, predicted: Column, accepted: Column | None = None) -> list[Column]:
    """n, accepted n, MAE, RMSE, bias, R2 and refusal rate; refused rows count only in n."""
    ok = F.lit(True) if accepted is None else F.coalesce(accepted, F.lit(False))
    a, e = F.when(ok, actual), F.when(ok, actual - predicted)
    return [
        F.count(F.lit(1)).alias("n"), F.count(a).alias("accepted_n"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"),
        (1 - F.avg(ok.cast("double"))).alias("refusal_rate"),
    ]


def interval_set(actual: Column, lower: Column, upper: Column) -> list[Column]:
    return [F.avg(actual.between(lower, upper).cast("double")).alias("coverage"), F.avg(upper - lower).alias("width")]


def long_dimensions(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """One row per (row, dimension) with its label; aggregate before any shuffle."""
    return df.withColumn(
        "_d", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("label")) for n, c in dimensions.items()]))
    ).select("*", "_d.dimension", "_d.label").drop("_d")
