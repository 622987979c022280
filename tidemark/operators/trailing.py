"""Trailing-window features of every series in one table, from disjoint age bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import value_chunk

DAY = 86400e6  # microseconds
WINDOWS = (1, 3, 7, 14, 30, 90)


def trailing_features(df: DataFrame, keys: list[str], as_of: str, windows: tuple[int, ...] = WINDOWS, id_: str = "measurement_id") -> DataFrame:
    """One row per key and window (cutoff - w, cutoff]: last, days_since_last, count, mean, median, std, min, max, slope, missing_rate.

    A reading is counted once, in the band between two windows that holds its age; a window is the union of the bands below it.
    Readings after the cutoff, without time or with a missing (NULL, NaN) value do not count. A window without readings has count 0
    and NULL features, ``last`` may be older than all windows. Equal instants: the higher id is last. A NULL key is a key.
    """
    windows = tuple(sorted(windows))
    cutoff, value = F.lit(as_of).cast("timestamp"), F.col("value").cast("double")
    seen = df.filter((F.col("ts") <= cutoff) & value.isNotNull() & ~F.isnan(value)).select(*keys, "ts", F.col(id_).alias("_id"), value.alias("_v"))
    seen = seen.withColumn("_x", (F.unix_micros("ts") - F.unix_micros(cutoff)) / F.lit(DAY))
    band = reduce(lambda rest, i: F.when(-F.col("_x") < windows[i], i).otherwise(rest), reversed(range(len(windows))), F.lit(len(windows)))
    rows = seen.withColumn("_band", band)
    bands = _bands(rows, keys).unionByName(_days(rows, keys), allowMissingColumns=True)
    names = [c for c in bands.columns if c not in keys]
    packed = bands.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_b"))  # two entries a band
    medians = _medians(rows, keys, len(windows))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = packed.join(medians.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_medians"), same, "left")
    last = F.array_max(F.transform("_b", lambda b: b["last"]))
    per_window = F.array(*[_window(i, w) for i, w in enumerate(windows)])
    return joined.select(
        *keys, last["v"].alias("last"), ((F.unix_micros(cutoff) - F.unix_micros(last["ts"])) / F.lit(DAY)).alias("days_since_last"), F.explode(per_window).alias("_w")
    ).select(*keys, F.col("_w.window_days"), "last", "days_since_last", *[f"_w.{c}" for c in ("count", "mean", "median", "std", "min", "max", "slope", "missing_rate")])


def _bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable moments about the band's own means."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys, "_band").agg(
        n.alias("n"), F.avg("_v").alias("v"), (F.var_pop("_v") * n).alias("vv"), F.avg("_x").alias("x"), (F.var_pop("_x") * n).alias("xx"),
        (F.covar_pop("_x", "_v") * n).alias("xv"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.min("_x").alias("first_x"), F.max("_x").alias("last_x"),
        F.max(F.struct("ts", F.col("_id").alias("id"), F.col("_v").alias("v"))).alias("last"),
    )


def _days(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Days by the nearest band they reach, so that the days of a window add up."""
    near = rows.groupBy(*keys, F.to_date("ts").alias("_day")).agg(F.min("_band").alias("_band"))
    return near.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("days"))


def _window(i: int, days: int) -> Column:
    """The features of window ``i`` from the bands 0 .. i."""
    held = F.filter("_b", lambda b: b["_band"] <= i)
    moments = F.filter(held, lambda b: b["n"].isNotNull())

    def total(of) -> Column:
        return F.aggregate(moments, F.lit(0.0), lambda s, b: s + of(b))

    n = F.aggregate(moments, F.lit(0).cast("long"), lambda s, b: s + b["n"])
    mean, mid = total(lambda b: b["n"] * b["v"]) / n, total(lambda b: b["n"] * b["x"]) / n
    spread = total(lambda b: b["vv"] + b["n"] * (b["v"] - mean) * (b["v"] - mean))
    width = total(lambda b: b["xx"] + b["n"] * (b["x"] - mid) * (b["x"] - mid))
    both = total(lambda b: b["xv"] + b["n"] * (b["x"] - mid) * (b["v"] - mean))
    apart = F.array_min(F.transform(moments, lambda b: b["first_x"])) < F.array_max(F.transform(moments, lambda b: b["last_x"]))
    covered = F.aggregate(held, F.lit(0).cast("long"), lambda s, b: s + F.coalesce(b["days"], F.lit(0)))
    some = n > 0
    return F.struct(
        F.lit(days).alias("window_days"), n.alias("count"), F.when(some, mean).alias("mean"), F.get("_medians", F.lit(i)).alias("median"),
        F.when(some, F.sqrt(spread / n)).alias("std"), F.array_min(F.transform(moments, lambda b: b["low"])).alias("min"),
        F.array_max(F.transform(moments, lambda b: b["high"])).alias("max"), F.when(some, F.when(apart, both / width).otherwise(0.0)).alias("slope"),
        F.when(some, F.greatest(F.lit(0.0), 1.0 - covered / float(max(days, 1)))).alias("missing_rate"),
    )


def _medians(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, _medians): exact medians of all windows from one table of value counts; no task holds a key, only a chunk of its values.

    A value carries one count per window; counts per chunk say which chunks hold a middle rank, and only those are opened.
    """
    weights = [f"_w{i}" for i in range(n)]
    counts = rows.filter(F.col("_band") < n).groupBy(*keys, value_chunk(F.col("_v")).alias("_chunk"), "_v").agg(
        *[F.count_if(F.col("_band") <= i).alias(w) for i, w in enumerate(weights)]
    )
    sums = counts.groupBy(*keys, "_chunk").agg(*[F.sum(w).alias(w) for w in weights])
    ordered, whole = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys)
    spans = sums.select(*keys, "_chunk", *weights, *[F.sum(w).over(ordered).alias(f"u{w}") for w in weights], *[F.sum(w).over(whole).alias(f"t{w}") for w in weights])

    def wanted(i: int, side: str) -> Column:
        w = weights[i]
        rank = F.expr(f"(t{w} + 1) div 2" if side == "lo" else f"t{w} div 2 + 1")
        before = F.col(f"u{w}") - F.col(w)
        return F.when((rank > before) & (rank <= F.col(f"u{w}")), F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (rank - before).alias("rank")))

    ranks = F.array_compact(F.array(*[wanted(i, side) for i in range(n) for side in ("lo", "hi")]))
    targets = spans.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_chunk").alias("_c"), ranks.alias("_t")).filter(F.size("_t") > 0)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col("_chunk") == F.col("_c"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_v")
    opened = counts.join(targets, same).select(*keys, "_v", "_t", F.array(*weights).alias("_own"), F.array(*[F.sum(w).over(inside) for w in weights]).alias("_upto"))

    def here(t: Column) -> Column:
        upto = F.get("_upto", t["i"])
        return (t["rank"] <= upto) & (t["rank"] > upto - F.get("_own", t["i"]))

    hits = opened.select(*keys, "_v", F.explode(F.filter("_t", here)).alias("_t"))

    def middle(i: int) -> Column:
        low, high = (F.max(F.when((F.col("_t.i") == i) & (F.col("_t.side") == side), F.col("_v"))) for side in ("lo", "hi"))
        return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)

    return hits.groupBy(*keys).agg(F.array(*[middle(i) for i in range(n)]).alias("_medians"))
