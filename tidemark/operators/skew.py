"""Exact grouped operations that stay balanced when one key holds most of the rows.

The tools: aggregate before shuffling, salt the join key, or cut an ordered group into chunks whose partial results
are combined through a small per-chunk table. None of them drops, caps or samples rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], salt_by: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join rows to a one-row-per-key table when a key of ``big`` may be hot.

    ``big`` is spread over ``salts`` sub-keys, ``small`` is repeated once per sub-key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Newest row per key as one map-side-combined aggregate (no per-key sort)."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep])


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key; Spark limits every map task to ``n`` rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def value_chunk(value: Column, per_e: int = 256) -> Column:
    """Monotone chunk number of a double: equal width on a log scale, so it needs no bounds; infinities take the outermost ones."""
    return (F.signum(value) * F.floor(F.least(F.log1p(F.abs(value)), F.lit(1000.0)) * per_e)).cast("long")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key, by counting: value counts, chunk counts, then only the chunks that hold a rank are opened.

    No task ever holds a key, only one of its chunks. NULL and NaN values do not count; a key without any other value gets NULL.
    A NULL key is a key.
    """
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs).drop("_all")
    number = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(number), number).alias("_v"))
    counts = rows.groupBy(*keys, F.coalesce(value_chunk(F.col("_v")), F.lit(0)).alias("_chunk"), "_v").agg(F.count("_v").alias("_n"))
    by_chunk = counts.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_cn"))
    ordered, whole = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys)
    upto, total = F.sum("_cn").over(ordered), F.sum("_cn").over(whole)
    spans = by_chunk.select(*keys, "_chunk", (upto - F.col("_cn")).alias("_before"), upto.alias("_upto"), total.alias("_total"))

    def wanted(name: str, p: float, side: str, cut) -> Column:
        at = F.lit(float(p)) * (F.col("_total") - 1)
        return F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (cut(at) + 1).cast("long").alias("rank"), at.alias("pos"))

    ranks = F.array(*[wanted(n, p, side, cut) for n, p in probs.items() for side, cut in (("lo", F.floor), ("hi", F.ceil))])
    inside = F.filter(ranks, lambda t: (t["rank"] > F.col("_before")) & (t["rank"] <= F.col("_upto")))
    targets = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), "_before", "_total", inside.alias("_t"))
    targets = targets.filter((F.size("_t") > 0) | (F.col("_total") == 0)).drop("_total")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_chunk") == F.col("_c"))
    opened = counts.join(targets, same).withColumn("_to", F.sum("_n").over(Window.partitionBy(*keys, "_chunk").orderBy("_v")))
    held = F.filter("_t", lambda t: (t["rank"] - F.col("_before") > F.col("_to") - F.col("_n")) & (t["rank"] - F.col("_before") <= F.col("_to")))
    hits = opened.select(*keys, "_v", F.explode_outer(held).alias("_t"))

    def pick(name: str, side: str, column: str) -> Column:
        return F.max(F.when((F.col("_t.name") == name) & (F.col("_t.side") == side), F.col(column)))

    def value_at(name: str) -> Column:
        low, high, at = pick(name, "lo", "_v"), pick(name, "hi", "_v"), pick(name, "lo", "_t.pos")
        part = at - F.floor(at)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name)

    return hits.groupBy(*keys).agg(*[value_at(name) for name in probs])


def prefix_sums(
    df: DataFrame, keys: list[str], chunk: str, order: list[Column], sums: dict[str, str], descending: bool = False
) -> DataFrame:
    """Running totals along ``order`` where each (key, chunk) is summed alone and offset by the chunks before it.

    ``chunk`` must rise with the order (fall, when ``descending``); the number of chunks per key is bounded.
    """
    by = F.col(chunk).desc() if descending else F.col(chunk).asc()
    totals = df.groupBy(*keys, chunk).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, chunk, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    local = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.select("*", *[F.sum(c).over(local).alias(f"_l_{c}") for c in sums])
    joined = summed.join(offsets, keys + [chunk])
    for column, name in sums.items():
        joined = joined.withColumn(name, F.col(f"_l_{column}") + F.col(f"_o_{column}"))
    return joined.drop(*[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def ordinal(df: DataFrame, keys: list[str], chunk: str, order: list[Column], name: str) -> DataFrame:
    """Row number per key along ``order``, numbered chunk by chunk and offset by chunk counts."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(one, keys, chunk, order, {"_one": name}).drop("_one")
