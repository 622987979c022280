"""Statistical learning jobs on ``pyspark.ml``: preparation, linear and boosted models, calibration, out-of-fold scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators.panel import fold_of
from tidemark.operators.skew import quantiles


@dataclass
class Prepared:
    """Medians, means and spreads learned on training rows only; a few numbers per feature."""

    columns: list[str]
    medians: dict[str, float]
    centre: dict[str, float]
    spread: dict[str, float]

    @property
    def inputs(self) -> list[str]:
        return [f"s_{c}" for c in self.columns] + [f"m_{c}" for c in self.columns]

    def imputed(self, df: DataFrame) -> DataFrame:
        return df.select(
            "*", *[F.col(c).isNull().cast("double").alias(f"m_{c}") for c in self.columns],
            *[F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(f"i_{c}") for c in self.columns],
        )

    def scaled(self, df: DataFrame) -> DataFrame:
        return self.imputed(df).select(
            "*", *[((F.col(f"i_{c}") - self.centre[c]) / (self.spread[c] or 1.0)).alias(f"s_{c}") for c in self.columns]
        )

    def vectors(self, df: DataFrame) -> DataFrame:
        made = VectorAssembler(inputCols=self.inputs, outputCol="features").transform(self.scaled(df))
        return made.drop(*self.inputs, *[f"i_{c}" for c in self.columns])


def medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per feature in long form (feature, median)."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_f")).select("_f.*")
    return quantiles(long, ["feature"], "v", {"median": 0.5})


def prepare(train: DataFrame, columns: list[str]) -> Prepared:
    """Two small results reach the driver: a median, a mean and a deviation per feature."""
    middle = {row["feature"]: row["median"] for row in medians(train, columns).collect()}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in columns]
    row = train.agg(*[F.avg(v).alias(f"a_{c}") for c, v in zip(columns, filled)], *[F.stddev_pop(v).alias(f"d_{c}") for c, v in zip(columns, filled)]).first()
    return Prepared(columns, middle, {c: row[f"a_{c}"] for c in columns}, {c: row[f"d_{c}"] for c in columns})


def ridge(train: DataFrame, label: str, alpha: float = 10.0):
    """Ridge with penalty alpha on the summed squares; Spark's loss is a mean and its penalty is divided by the label's spread."""
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return LinearRegression(featuresCol="features", labelCol=label, regParam=alpha * row["sd"] / row["n"], elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (2 * n_class) as a column; two counts reach the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("p")).first()
    n, p = float(row["n"]), float(row["p"] or 0)
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * max(p, 1.0))).otherwise(n / (2 * max(n - p, 1.0))))


def logistic(train: DataFrame, label: str, c: float = 0.5):
    """Class-balanced logistic regression with inverse penalty ``c`` on the summed loss."""
    weighted = balanced(train, label)
    total = float(weighted.agg(F.sum("weight")).first()[0])
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=100).fit(weighted)


def task_count(rows: int, cores: int, least: int = 8192, most: int = 1_000_000) -> int:
    """Tasks for a fit of many rounds: ``least`` rows or more in each up to one task per core, beyond that as many as keep ``most`` rows."""
    return max(1, min(cores, math.ceil(rows / least)), math.ceil(rows / most))


@contextmanager
def fitting(train: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """The columns of a fit, cached in a number of parts that follows its rows: each of some thousand stages has a task per part."""
    needed = train.select(*columns).persist()
    parts = task_count(needed.count(), train.sparkSession.sparkContext.defaultParallelism)
    rows = needed.repartition(parts).persist()
    try:
        rows.count()
        needed.unpersist()
        yield rows
    finally:
        rows.unpersist()


def boosted_classifier(train: DataFrame, label: str, trees: int = 300, depth: int = 3, seed: int = 42):
    model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.04, subsamplingRate=0.85, seed=seed)
    with fitting(train, ["features", label]) as rows:
        return model.fit(balanced(rows, label))


def boosted_regressor(train: DataFrame, label: str, trees: int = 350, depth: int = 5, seed: int = 42):
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.04, lossType="absolute", subsamplingRate=0.85, seed=seed)
    with fitting(train, ["features", label]) as rows:
        return model.fit(rows)


def with_probability(model: Transformer, df: DataFrame, name: str = "p") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, columns: list[str], label: str, key: str, fit, k: int = 5) -> DataFrame:
    """Every row scored by a model that saw no row of its id. ``k`` fits; preparation is learned inside each fold."""
    folded = df.withColumn("fold", fold_of(F.col(key), k))
    parts = None
    for i in range(k):
        train, held = folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)
        ready = prepare(train, columns)
        part = with_probability(fit(ready.vectors(train), label), ready.vectors(held)).drop("features")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def platt(oof: DataFrame, label: str, p: str = "p"):
    """Logistic map of the out-of-fold log odds; returns a column function."""
    rows = oof.select(F.col(label).cast("double").alias("label"), E.logit(F.col(p)).alias("z"))
    model = LogisticRegression(maxIter=1000, regParam=0.0, standardization=False).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(rows))
    slope, shift = float(model.coefficients[0]), float(model.intercept)
    return lambda c: 1 / (1 + F.exp(-(E.logit(c) * slope + shift)))


def isotonic(oof: DataFrame, label: str, p: str = "p"):
    """Monotone calibration fitted on groups of equal scores (mean label, weight)."""
    grouped = oof.groupBy(F.col(p).alias("s")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="s", labelCol="label", weightCol="w").fit(grouped)


def summary(df: DataFrame, keys: list[str], label: str = "y", p: str = "p") -> DataFrame:
    """AUROC, PR-AUC and Brier per key."""
    ranks = E.ranking_metrics(E.running_counts(E.score_histogram(df, keys, label, p), keys), keys)
    loss = df.groupBy(*keys).agg(E.brier(F.col(label), F.col(p)).alias("brier"))
    return ranks.join(loss, keys)


def permuted(df: DataFrame, column: str, key: Column, seed: int, buckets: int = 4096) -> DataFrame:
    """A column shuffled among the rows of random hash buckets: each row takes the value of the next row in hash order."""
    order = Window.partitionBy("_b").orderBy("_o")
    first = F.first(column).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mixed = df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets))).withColumn("_o", F.xxhash64(F.lit(seed + 1), key))
    return mixed.withColumn("_next", F.lead(F.struct(F.col(column).alias("v"))).over(order)).withColumn(
        column, F.when(F.col("_next").isNull(), first).otherwise(F.col("_next.v"))
    ).drop("_b", "_o", "_next")


def abstaining(scored: DataFrame, columns: list[str], half_width: float, typical: float, share: float = 0.40, least: float = 0.50) -> DataFrame:
    """Point, interval and abstention: too few features or too wide an interval gives no point."""
    complete = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / float(len(columns))
    ok = (complete >= least) & F.lit(2.0 * half_width <= max(abs(typical) * share, 1.0))
    return scored.withColumn("completeness", complete).withColumn("abstained", ~ok).select(
        "*", *[F.when(ok, c).alias(n) for n, c in (("point", F.col("prediction")), ("lower", F.col("prediction") - half_width), ("upper", F.col("prediction") + half_width))]
    )
