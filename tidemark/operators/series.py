"""Per-participant series: collapse, daily buckets, cleaning, trends and the window operators over them.

Raw readings of one key are unbounded, so raw-row operators aggregate or rank-limit before the shuffle. A daily series
holds one row per calendar day, so windows over it are bounded by the length of the study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import latest, newest_n, prefix_sums, quantiles


def lookback(df: DataFrame, as_of: str, days: int, ts: str = "ts", most: int = 365, least: int = 1) -> DataFrame:
    """Rows of the last ``days`` (clamped) up to an explicit cutoff; both bounds reach the scan."""
    days = max(least, min(most, days))
    end = F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {days} DAYS")
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= end))


def within_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Drop readings outside their metric's bounds; ``bounds`` is a fixed rule table (metric, lo, hi)."""
    joined = df.join(F.broadcast(bounds), "metric", "left")
    return joined.filter(F.col("lo").isNull() | F.col("value").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def collapse(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", id_: str = "measurement_id") -> DataFrame:
    """One point per instant: mean value, number of readings, first reading id."""
    return df.groupBy(*keys, ts).agg(
        F.avg(value).alias(value), F.count(F.lit(1)).alias("n_raw"), F.min(id_).alias("first_id")
    )


def daily(
    df: DataFrame, keys: list[str], policy: dict[str, str] | None = None, ts: str = "ts", value: str = "value"
) -> DataFrame:
    """UTC day buckets; ``policy`` names the metrics that use sum or mean, all others take the exact median."""
    how = F.lit("median")
    for metric, method in (policy or {}).items():
        how = F.when(F.col("metric") == metric, method).otherwise(how)
    day = df.withColumn("day", F.to_date(ts)).withColumn("_how", how)
    group = [*keys, "day"]
    simple = (
        day.filter(F.col("_how") != "median")
        .groupBy(*group, "_how")
        .agg(F.sum(value).alias("_s"), F.avg(value).alias("_m"), F.count(value).alias("n"))
        .select(*group, F.when(F.col("_how") == "sum", F.col("_s")).otherwise(F.col("_m")).alias("v"))
    )
    middle = quantiles(day.filter(F.col("_how") == "median"), group, value, {"v": 0.5})
    return simple.unionByName(middle) if policy else middle


def mad_clean(series: DataFrame, keys: list[str], value: str = "v", least: int = 5, width: float = 4.0) -> DataFrame:
    """Flag days further than ``width`` scaled MADs from the series median (needs ``least`` days and a spread)."""
    whole = Window.partitionBy(*keys)
    centred = series.withColumn("med", F.median(value).over(whole)).withColumn("_n", F.count(value).over(whole))
    scaled = centred.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(whole) * 1.4826)
    usable = (F.col("_n") >= least) & (F.col("mad") > 1e-9)
    distance = F.abs(F.col(value) - F.col("med"))
    return scaled.withColumn("keep", ~usable | (distance <= width * F.col("mad"))).withColumn(
        "spike", usable & (distance >= width * F.col("mad"))
    ).drop("_n")


def ols(x: Column, y: Column) -> tuple[Column, Column]:
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def day_number(series: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Days since the first day of each series."""
    return series.withColumn(
        "x", F.datediff(day, F.min(day).over(Window.partitionBy(*keys))).cast("double")
    )


def fluctuation_band(ratio: Column) -> Column:
    return F.when(ratio < 0.03, "low").when(ratio < 0.10, "moderate").otherwise("high")


def trend_class(slope: Column, span: Column, med: Column, fluct: Column) -> tuple[Column, Column]:
    """Direction by relative change against a noise-dependent threshold, and strength bands."""
    size = F.abs(slope) * F.greatest(span, F.lit(1e-6)) / F.greatest(F.abs(med), F.lit(1e-9))
    limit = F.when(fluct == "low", 0.03).when(fluct == "moderate", 0.06).otherwise(0.12)
    direction = F.when(size < limit, "stable").when(slope > 0, "rising").otherwise("falling")
    strength = F.when(size < 0.05, "weak").when(size < 0.15, "moderate").otherwise("strong")
    return direction, strength


def ols_trend(series: DataFrame, keys: list[str]) -> DataFrame:
    """SQL variant of the trend classification: OLS fit, residual spread, direction and strength."""
    x, y = F.col("x"), F.col("v")
    numbered = day_number(series, keys)
    slope, intercept = ols(x, y)
    fit = numbered.groupBy(*keys).agg(
        slope.alias("slope"),
        intercept.alias("intercept"),
        F.median(y).alias("med"),
        F.max(x).alias("span_days"),
        F.count(y).alias("n_days"),
        # residual variance in closed form: syy - sxy^2/sxx, divided by n
        ((F.regr_syy(y, x) - F.coalesce(F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0)))
         / F.count(y)).alias("_var"),
    )
    noise = F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))) / F.greatest(F.abs(F.col("med")), F.lit(1e-9))
    fluct = fluctuation_band(noise)
    direction, strength = trend_class(F.coalesce("slope", F.lit(0.0)), F.col("span_days"), F.col("med"), fluct)
    return fit.select(
        "*", noise.alias("noise"), fluct.alias("fluctuation"), direction.alias("direction"), strength.alias("strength")
    ).drop("_var")


def recent_slope(series: DataFrame, keys: list[str], share: float = 0.30, least: int = 3) -> DataFrame:
    """OLS slope over the last ``ceil(share * n)`` days (at least ``least``)."""
    numbered = day_number(series, keys)
    back = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    sized = numbered.withColumn("_rn", F.row_number().over(back)).withColumn(
        "_n", F.count("v").over(Window.partitionBy(*keys))
    )
    kept = sized.filter(F.col("_rn") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share)))
    return kept.groupBy(*keys).agg(
        F.regr_slope(F.col("v"), F.col("x")).alias("recent_slope"), F.count("v").alias("recent_days")
    )


def step_scale(series: DataFrame, keys: list[str]) -> DataFrame:
    """Median and mean absolute day-to-day difference (the MASE denominator)."""
    ordered = Window.partitionBy(*keys).orderBy("day")
    steps = series.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(ordered)))
    return steps.groupBy(*keys).agg(F.median("_d").alias("median_step"), F.avg("_d").alias("mean_step"))


def holdout(series: DataFrame, keys: list[str]) -> DataFrame:
    """Time-ordered split: the last 20 % of days (10 or more) or the last two (5 to 9); shorter series have none."""
    whole = Window.partitionBy(*keys)
    sized = series.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "_rn", F.row_number().over(whole.orderBy(F.col("day").desc()))
    )
    size = F.when(F.col("_n") >= 10, F.greatest(F.lit(2), F.ceil(F.col("_n") * 0.2))).when(F.col("_n") >= 5, 2)
    part = F.when(size.isNull(), "none").when(F.col("_rn") <= size, "validation").otherwise("train")
    return sized.withColumn("part", part).drop("_n", "_rn")


def baseline_band(series: DataFrame, keys: list[str], days: int = 14) -> DataFrame:
    """Median and quartiles of the last ``days`` days of each series."""
    near = series.withColumn("_last", F.max("day").over(Window.partitionBy(*keys))).filter(
        F.datediff("_last", "day") <= days
    )
    return near.groupBy(*keys).agg(
        F.percentile("v", F.lit(0.5)).alias("base_value"),
        F.percentile("v", F.lit(0.25)).alias("base_lower"),
        F.percentile("v", F.lit(0.75)).alias("base_upper"),
    )


def smoothed(series: DataFrame, keys: list[str], alpha: float = 0.3) -> DataFrame:
    """Exponential smoothing of each daily series, folded over its ordered (bounded) day array."""
    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("_a"))
    start = F.array().cast("array<struct<day:date,v:double,s:double>>")

    def step(acc, point):
        before = F.element_at(acc, -1)["s"]
        value = F.when(F.size(acc) == 0, point["v"]).otherwise(point["v"] * alpha + before * (1 - alpha))
        return F.concat(acc, F.array(F.struct(point["day"].alias("day"), point["v"].alias("v"), value.alias("s"))))

    folded = packed.select(*keys, F.explode(F.aggregate("_a", start, step)).alias("_p"))
    return folded.select(*keys, "_p.day", "_p.v", F.col("_p.s").alias("ewma"))


def quadratic_fit(series: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares parabola from centred power sums (Cramer's rule), one aggregate per series."""
    centre = day_number(series, keys)
    middle = Window.partitionBy(*keys)
    moved = centre.withColumn("_m", F.avg("x").over(middle)).withColumn("u", F.col("x") - F.col("_m"))
    u, v = F.col("u"), F.col("v")
    s = moved.groupBy(*keys, "_m").agg(
        F.count(v).cast("double").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"),
        F.sum(u * u * u * u).alias("s4"), F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"),
    )
    det = F.expr("n*(s2*s4 - s3*s3) - s2*s2*s2")
    a = F.try_divide(F.expr("n*(s2*t2 - s3*t1) - s2*s2*t0"), det)
    b = F.try_divide(F.expr("n*(s4*t1 - s3*t2) - s2*s2*t1 + s2*s3*t0"), det)
    fitted = s.withColumn("_det", det).filter(F.col("_det") > 1e-6).withColumn("a", a).withColumn("b", b)
    c = F.expr("(t0 - a*s2)/n")
    return fitted.select(
        *keys, "a", (F.col("b") - 2 * F.col("a") * F.col("_m")).alias("b"),
        (c - F.col("b") * F.col("_m") + F.col("a") * F.col("_m") * F.col("_m")).alias("c"),
    )


def window_features(df: DataFrame, keys: list[str], as_of: str, windows: tuple[int, ...] = (1, 3, 7, 14, 30, 90)) -> DataFrame:
    """Trailing features on (cutoff - w, cutoff] for every window in one aggregate pass, then unpivoted."""
    cutoff = F.lit(as_of).cast("timestamp")
    seen = df.filter((F.col("ts") <= cutoff) & F.col("value").isNotNull())
    age = (F.unix_micros(cutoff) - F.unix_micros("ts")) / F.lit(86400e6)
    x, v = -age, F.col("value")
    daily_keyed = seen.withColumn("_age", age).withColumn("_day", F.to_date("ts"))
    parts = []
    for w in windows:
        inside = F.col("_age") < w
        kept = F.when(inside, v)
        parts += [
            F.count(kept).alias(f"count_{w}"), F.avg(kept).alias(f"mean_{w}"), F.stddev_pop(kept).alias(f"std_{w}"),
            F.min(kept).alias(f"min_{w}"), F.max(kept).alias(f"max_{w}"),
            F.regr_slope(kept, F.when(inside, x)).alias(f"slope_{w}"),
        ]
    base = daily_keyed.groupBy(*keys).agg(*parts)
    # distinct days per window come from the day list of each key: one row per (key, day)
    days = daily_keyed.groupBy(*keys, "_day").agg(F.min("_age").alias("_near"))
    day_counts = days.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_near") < w, 1).otherwise(0)).alias(f"days_{w}") for w in windows]
    )
    wide = base.join(day_counts, keys)
    names = ("count", "mean", "std", "min", "max", "slope", "days")
    long = wide.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(w).alias("window_days"), *[F.col(f"{n}_{w}").alias(n) for n in names]) for w in windows
        ])).alias("_w"),
    ).select(*keys, "_w.*")
    held = F.col("count") > 0
    return long.select(
        *keys, "window_days", "count", "mean", "std", "min", "max",
        F.when(held, F.coalesce("slope", F.lit(0.0))).alias("slope"),
        F.when(held, F.greatest(F.lit(0.0), 1.0 - F.col("days") / F.greatest(F.col("window_days"), F.lit(1)))).alias("missing_rate"),
    )


def window_medians(df: DataFrame, keys: list[str], as_of: str, windows: tuple[int, ...] = (1, 3, 7, 14, 30, 90)) -> DataFrame:
    """Exact medians per trailing window; each reading goes only to the windows that hold it."""
    cutoff = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(cutoff) - F.unix_micros("ts")) / F.lit(86400e6)
    fits = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.col("_age") < w)
    spread = df.filter(F.col("ts") <= cutoff).withColumn("_age", age).withColumn("window_days", F.explode(fits))
    return quantiles(spread, [*keys, "window_days"], "value", {"median": 0.5})


def latest_and_previous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest reading against the one before it."""
    two = newest_n(df, keys, [F.col("ts").desc(), F.col("measurement_id").desc()], 2)
    pair = two.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("latest_value"),
        F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("_p"),
    )
    previous = F.coalesce("_p", "latest_value")
    change = F.col("latest_value") - previous
    return pair.select(
        *keys, "latest_value", previous.alias("previous_value"), change.alias("change"),
        F.when(F.abs(previous) > 1e-9, change / previous * 100).otherwise(0.0).alias("change_percent"),
    )


def first_last_change(df: DataFrame, keys: list[str], tolerance: Column) -> DataFrame:
    """Last minus first reading with a per-metric tolerance band."""
    ends = df.groupBy(*keys).agg(
        F.min(F.struct("ts", "measurement_id", "value")).alias("_f"), F.max(F.struct("ts", "measurement_id", "value")).alias("_l")
    )
    delta = F.col("_l.value") - F.col("_f.value")
    return ends.select(
        *keys, F.col("_f.value").alias("first_value"), F.col("_l.value").alias("last_value"),
        F.round(delta, 2).alias("delta"),
        F.when(F.abs(delta) <= tolerance, "stable").when(delta > 0, "rising").otherwise("falling").alias("direction"),
    )


def recent_vs_baseline(df: DataFrame, keys: list[str], as_of: str, days: int = 7, band: float = 3.0) -> DataFrame:
    """Mean of the last ``days`` against the mean before, in percent; a zero baseline gives NULL and stable."""
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    means = df.groupBy(*keys).agg(
        F.avg(F.when(F.col("ts") >= cut, F.col("value"))).alias("recent_mean"),
        F.avg(F.when(F.col("ts") < cut, F.col("value"))).alias("baseline_mean"),
    )
    pct = F.round(F.try_divide(F.col("recent_mean") - F.col("baseline_mean"), F.col("baseline_mean")) * 100, 1)
    trend = F.when(pct.isNull() | (F.abs(pct) < band), "stable").when(pct > 0, "up").otherwise("down")
    return means.select(*keys, "recent_mean", "baseline_mean", pct.alias("trend_pct"), trend.alias("trend"))


def as_of_values(df: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Last value at or before the cutoff per key."""
    return latest(df.filter(F.col("ts") <= F.lit(as_of).cast("timestamp")), keys, ["ts", "measurement_id"], ["ts", "value"])


def reading_positions(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ordinal of every reading inside its key, numbered day by day so that a hot key is split."""
    one = df.withColumn("_day", F.to_date("ts")).withColumn("_one", F.lit(1).cast("long"))
    out = prefix_sums(one, keys, "_day", [F.col("ts"), F.col("measurement_id")], {"_one": name})
    return out.drop("_day", "_one")
