"""Curve analysis of every daily series: trend, back-test, model choice, gates, forecast interval and alerts.

Spark buckets, cleans and packs the series; one Arrow pass fits them; scoring, selection, gates and intervals are column
expressions again. Nothing is shuffled after the series are packed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import fits
from tidemark.operators.series import day_number, fluctuation_band, mad_clean, trend_class

STEPS = tuple(range(1, 31))
TREND = ("slope", "intercept", "resid_std", "recent_slope")


def packed(series: DataFrame, keys: list[str], least: int = 7) -> DataFrame:
    """One row per series with ordered day and value arrays; a series is at most one looked-back year.

    Shorter series than ``least`` cannot be fitted and are left out here; ``short_series`` has them.
    """
    rows = series.withColumn("_n", F.count("v").over(Window.partitionBy(*keys))).filter(F.col("_n") >= least)
    numbered = day_number(rows, keys)
    grouped = numbered.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_a"), F.max("day").alias("last_day")
    )
    return spread(grouped.select(*keys, "last_day", F.col("_a.x").alias("xs"), F.col("_a.v").alias("ys")), keys)


def short_series(daily: DataFrame, clean: DataFrame, keys: list[str], least: int = 7) -> DataFrame:
    """Series of ``daily`` with fewer than ``least`` clean days, those without any included, as rows of ``analysed``.

    They have the status insufficient_data, no fit and no forecast.
    """
    known = clean.groupBy(*keys).agg(F.count("v").alias("n_days"), F.datediff(F.max("day"), F.min("day")).cast("double").alias("span_days"), F.max("day").alias("last_day"))
    same = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    rows = daily.select(*keys).distinct().alias("d").join(known.alias("c"), same, "left")
    rows = rows.select(*[f"d.{k}" for k in keys], F.coalesce("n_days", F.lit(0)).cast("int").alias("n_days"), "span_days", "last_day").filter(F.col("n_days") < least)
    reason = F.format_string(f"valid days %d/{least}", F.col("n_days").cast("long"))
    return rows.select(
        "*", F.lit("insufficient_data").alias("status"), F.lit("stable").alias("long_term_trend"), F.lit("stable").alias("recent_trend"),
        F.lit("weak").alias("trend_strength"), F.lit(False).alias("available"), F.lit(0).alias("horizon"), reason.alias("reason"), F.lit(False).alias("crosses_bound"),
    )


def analysed_all(daily: DataFrame, clean: DataFrame, keys: list[str], requested: int = 7, **bounds) -> DataFrame:
    """``analysed`` for every series of ``daily``; the short ones keep a row, see ``short_series``."""
    full = analysed(packed(clean, keys), keys, requested, **bounds).withColumn("status", F.lit("ok"))
    return full.unionByName(short_series(daily, clean, keys), allowMissingColumns=True)


def clean_series(daily: DataFrame, keys: list[str], bounds: Column | None = None) -> DataFrame:
    """Days inside the bounds (when given) and not rejected by the MAD rule; rejected days are counted per series."""
    inside = daily if bounds is None else daily.withColumn("v", F.when(bounds, F.col("v")))
    flagged = mad_clean(inside, keys)
    ok = F.coalesce(F.col("keep") & F.col("v").isNotNull(), F.lit(False))
    removed = F.sum((~ok).cast("int")).over(Window.partitionBy(*keys))
    return flagged.withColumn("removed", removed).filter(ok).drop("keep", "spike", "med", "mad")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def spread(series: DataFrame, keys: list[str]) -> DataFrame:
    """Packed series are small but costly to fit, so they go to as many tasks as a shuffle has.

    The hash of the keys is used because partitioning by the keys themselves is already given, would be optimised away,
    and would then be merged into a few tasks by size.
    """
    return series.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def fitted(series: DataFrame) -> DataFrame:
    """Robust trend, rolling-origin tests and 30 future days of every model, one row per series.

    The Arrow pass returns flat number arrays; they become named structs in Spark.
    """
    lists = ["lead", "actual", *[f"test_{m}" for m in fits.MODELS], *[f"next_{m}" for m in fits.MODELS]]
    none = np.array([], dtype=float)

    def run(batches):
        for batch in batches:
            columns = {n: [] for n in (*TREND, *lists)}
            for xs, ys in zip(batch.column("xs"), batch.column("ys")):
                x, y = xs.values.to_numpy(zero_copy_only=False), ys.values.to_numpy(zero_copy_only=False)
                for name, value in zip(TREND, fits.trend_fit(x, y)):
                    columns[name].append(float(value))
                tested = fits.rolling_origins(x, y) if len(y) >= 8 else None
                lead, actual, guesses = tested or (none, none, dict.fromkeys(fits.MODELS, none))
                ahead = fits.predict(x, y, np.array([len(y)]), np.zeros(len(STEPS), dtype=int), x[-1] + np.array(STEPS, dtype=float))
                columns["lead"].append(lead)
                columns["actual"].append(actual)
                for m in fits.MODELS:
                    columns[f"test_{m}"].append(guesses[m])
                    columns[f"next_{m}"].append(ahead[m])
            made = [pa.array(columns[n], pa.float64()) for n in TREND] + [pa.array(columns[n], pa.list_(pa.float64())) for n in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *TREND, *lists])

    schema = ", ".join([_schema(series), *[f"{n} double" for n in TREND], *[f"{n} array<double>" for n in lists]])
    flat = series.mapInArrow(run, schema)
    tests = F.array(*[F.struct(F.lit(m).alias("model"), F.col("lead"), F.col("actual"), F.col(f"test_{m}").alias("predicted")) for m in fits.MODELS])
    future = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"next_{m}").alias("predicted")) for m in fits.MODELS])
    empty = F.slice(tests, 1, 0)
    return flat.withColumn("tests", F.when(F.size("lead") > 0, tests).otherwise(empty)).withColumn("future", future).drop(*lists)


def smoothed_rows(series: DataFrame, keys: list[str]) -> DataFrame:
    """Robust local smoother: one row per (series, day)."""

    def run(batches):
        for batch in batches:
            smooth = [fits.local_smooth(np.asarray(x, dtype=float), np.asarray(y, dtype=float)) for x, y in zip(batch["xs"], batch["ys"])]
            yield batch.assign(smooth=smooth)

    rows = series.mapInPandas(run, f"{_schema(series)}, smooth array<double>")
    return rows.select(*keys, F.explode(F.arrays_zip("xs", "ys", "smooth")).alias("_p")).select(
        *keys, F.col("_p.xs").alias("x"), F.col("_p.ys").alias("v"), F.col("_p.smooth").alias("smooth")
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _quantile(values: Column, p: float) -> Column:
    """Interpolated quantile of an array column."""
    ordered, spot = F.array_sort(values), (F.size(values) - 1) * F.lit(p)
    low = F.element_at(ordered, (F.floor(spot) + 1).cast("int"))
    return low + (F.element_at(ordered, (F.ceil(spot) + 1).cast("int")) - low) * (spot - F.floor(spot))


def scored(fit: DataFrame) -> DataFrame:
    """Per model MAE, RMSE, bias, MASE and q80 (in-sample) for leads up to 7 days, and the selected model.

    Smallest (MASE, |bias|) wins; earlier models win ties.
    """
    median = _quantile(F.col("ys"), 0.5)
    jumps = F.transform(F.sequence(F.lit(2), F.size("ys")), lambda i: F.abs(F.element_at("ys", i) - F.element_at("ys", i - 1)))
    spread = F.sqrt(_mean(F.transform("ys", lambda v: F.pow(v - F.col("_avg"), F.lit(2.0)))))
    base = fit.withColumn("median_value", median).withColumn("_avg", _mean(F.col("ys"))).withColumn("_step", _quantile(jumps, 0.5))
    scale = F.greatest(F.when(F.col("_step") < 1e-6, spread).otherwise(F.col("_step")), F.abs("median_value") * 0.01, F.lit(1e-6))
    base = base.withColumn("scale", scale)

    def metrics(t: Column) -> Column:
        def of(error: Column) -> Column:
            size = F.transform(error, lambda e: F.abs(e))
            return F.struct(
                t["model"].alias("model"), F.size(error).alias("n"), F.round(_mean(size), 4).alias("mae"),
                F.round(F.sqrt(_mean(F.transform(error, lambda e: e * e))), 4).alias("rmse"), F.round(_mean(error), 4).alias("bias"),
                F.round(_mean(size) / F.col("scale"), 4).alias("mase"), F.round(_quantile(size, 0.8), 4).alias("q80_in_sample"), _quantile(size, 0.8).alias("q80"),
            )

        errors = F.zip_with(t["actual"], t["predicted"], lambda a, b: a - b)
        return F.element_at(F.transform(F.array(errors), of), 1)

    base = base.withColumn("scores", F.transform("tests", metrics)).drop("_avg", "_step")
    ranked = F.transform("scores", lambda s, i: F.struct(s["mase"].alias("mase"), F.abs(s["bias"]).alias("bias"), i.alias("at")))
    best = F.array_min(ranked)
    return base.withColumn("best", F.when(F.size("scores") > 0, F.element_at("scores", best["at"] + 1))).withColumn("selected", F.col("best.model"))


def gate_horizon(n: Column, span: Column, requested: int) -> Column:
    """Longest horizon the history supports, limited to the request; 0 is none."""
    most = F.lit(0)
    for days, (valid, length) in sorted(rules.FORECAST_GATES.items()):
        most = F.when((n >= valid) & (span >= length), days).otherwise(most)
    return F.when(most > 0, F.least(most, F.lit(requested))).otherwise(0)


def refusal(n: Column, span: Column, fluct: Column, has_model: Column, wide: Column, requested: int) -> Column:
    """All reasons against a forecast, joined; NULL when there is none."""
    reasons = F.array_compact(F.array(
        F.when(n < 7, F.format_string("valid days %d/7", n.cast("long"))),
        F.when(span < 14, F.format_string("span %d/14 days", span.cast("long"))),
        F.when(~has_model, "no stable back-test"), F.when(fluct == "high", "fluctuation too high"),
        F.when(wide, "back-test error or interval too wide"),
        F.when(F.lit(requested >= 30) & ((n < 84) | (span < 90)), "30 days need 84 valid days over 90 days"),
    ))
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))


def analysed(series: DataFrame, keys: list[str], requested: int = 7, forecastable: Column | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Trend class, back-test choice, eligibility and the gated forecast of every packed series.

    The boundary test uses the interval before clipping; both forms are kept.
    """
    rows = scored(fitted(series))
    n, span, med = F.size("ys"), F.element_at("xs", -1), F.col("median_value")
    fluct = fluctuation_band(F.col("resid_std") / F.greatest(F.abs(med), F.lit(1e-9)))
    rows = rows.withColumn("n_days", n).withColumn("span_days", span).withColumn("fluctuation", fluct)
    direction, strength = trend_class(F.col("slope"), F.col("span_days"), F.col("median_value"), F.col("fluctuation"))
    rows = rows.withColumn("long_term_trend", direction).withColumn("trend_strength", strength).withColumn(
        "recent_trend", F.when(F.col("recent_slope") > 0, "rising").when(F.col("recent_slope") < 0, "falling").otherwise("stable")
    )
    wide = (F.coalesce(F.col("best.mase"), F.lit(99.0)) > 5.0) | (F.coalesce(F.col("best.q80"), F.lit(0.0)) > F.greatest(F.abs("median_value") * 0.20, F.lit(1.0)))
    horizon = gate_horizon(F.col("n_days"), F.col("span_days"), requested)
    can = F.lit(True) if forecastable is None else forecastable
    rows = rows.withColumn("_h", horizon).withColumn(
        "available", can & (F.col("_h") > 0) & F.col("selected").isNotNull() & (F.col("fluctuation") != "high") & ~wide
    )
    reason = F.coalesce(refusal(F.col("n_days"), F.col("span_days"), F.col("fluctuation"), F.col("selected").isNotNull(), wide, requested), F.lit("conditions not met"))
    rows = rows.withColumn("horizon", F.when(F.col("available"), F.col("_h")).otherwise(0)).withColumn("reason", F.when(~F.col("available"), reason))
    # conformal margin from the selected model's back-test, at least one percent of the median
    model = F.filter("future", lambda f: f["model"] == F.col("selected"))
    q = F.greatest(F.col("best.q80"), F.abs("median_value") * 0.01, F.lit(1e-6))
    steps = F.when(F.col("horizon") == 30, F.array(*[F.lit(s) for s in (7, 14, 21, 28, 30)])).when(F.col("horizon") > 0, F.sequence(F.lit(1), F.col("horizon")))
    rows = rows.withColumn("_path", F.element_at(F.transform(model, lambda f: f["predicted"]), 1)).withColumn("_q", q)

    def clip(c: Column) -> Column:
        out = c if low is None else F.greatest(c, F.lit(float(low)))
        return out if high is None else F.least(out, F.lit(float(high)))

    def point(s: Column) -> Column:
        centre = clip(F.element_at("_path", s))
        margin = F.col("_q") * F.sqrt(1.0 + s / F.col("n_days"))
        return F.struct(
            F.date_add("last_day", s).alias("day"), F.round(centre, 2).alias("predicted"), F.round(clip(centre - margin), 2).alias("lower"),
            F.round(clip(centre + margin), 2).alias("upper"), F.round(centre - margin, 2).alias("raw_lower"), F.round(centre + margin, 2).alias("raw_upper"),
        )

    rows = rows.withColumn("forecast", F.when(F.col("available"), F.transform(steps, point)))
    crosses = F.lit(False)
    if high is not None:
        crosses = crosses | F.coalesce(F.exists("forecast", lambda p: p["raw_upper"] > high), F.lit(False))
    if low is not None:
        crosses = crosses | F.coalesce(F.exists("forecast", lambda p: p["raw_lower"] < low), F.lit(False))
    return rows.withColumn("crosses_bound", crosses).drop("_h", "_path", "_q", "tests", "future")


def alert_rule(spike: Column, strength: Column, long_term: Column, recent: Column, crosses: Column) -> Column:
    """Spike before strong directional trend before a forecast that crosses a bound."""
    directional = long_term.isin("rising", "falling") | recent.isin("rising", "falling")
    return F.when(spike, "abnormal_spike").when((strength == "strong") & directional, "strong_trend").when(crosses, "forecast_boundary")


def alert_title(name: Column, rule: Column, long_term: Column) -> Column:
    side = F.when(long_term == "falling", "falling").otherwise("rising")
    tail = F.when(rule == "abnormal_spike", "abnormal reading").when(rule == "forecast_boundary", "forecast range").otherwise(F.concat(side, F.lit(" trend")))
    return F.concat_ws(": ", name, tail)


def quality_class(mase: Column, available: Column) -> Column:
    return F.when(~available, "off").when(mase.isNull(), "reference").when(mase < 0.8, "good").when(mase < 1, "reference").otherwise("baseline")


def naive_folds(series: DataFrame, keys: list[str], reach: int = 7, share: float = 0.45, least: int = 8) -> DataFrame:
    """Last-value rolling origins in SQL: each origin day sees the actual days within ``reach`` through a range frame."""
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("x")
    rows = day_number(series, keys).withColumn("rn", F.row_number().over(ordered)).withColumn("n", F.count("v").over(whole))
    ahead = rows.withColumn("_next", F.collect_list(F.struct("x", "v")).over(ordered.rangeBetween(1, reach)))
    start = F.greatest(F.lit(least), F.ceil(F.col("n") * share))
    kept = ahead.filter((F.col("rn") >= start) & (F.col("rn") < F.col("n")))
    return kept.select(*keys, F.col("day").alias("origin"), F.col("v").alias("predicted"), F.col("x").alias("_x"), F.explode("_next").alias("_t")).select(
        *keys, "origin", (F.col("_t.x") - F.col("_x")).cast("int").alias("lead"), "predicted", F.col("_t.v").alias("actual")
    )


def forecast_windows(series: DataFrame, keys: list[str], min_history: int, horizon: int) -> DataFrame:
    """Last-value forecasts for every calendar day of a window that starts after each ``horizon``-th record."""
    ordered = Window.partitionBy(*keys).orderBy("day")
    rows = series.withColumn("rn", F.row_number().over(ordered))
    origins = rows.filter((F.col("rn") >= min_history) & ((F.col("rn") - min_history) % horizon == 0))
    return origins.select(
        *keys, F.col("day").alias("origin"), F.col("rn").alias("history"), F.col("v").alias("predicted"),
        F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", horizon))).alias("day"),
    )


def aligned(windows: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted day meets actual day; a missing calendar day simply has no partner."""
    return windows.join(series.select(*keys, "day", F.col("v").alias("actual")), keys + ["day"])
