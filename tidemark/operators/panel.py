"""Panel cohorts: wave pairs, incident outcomes and leakage-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.views import stable_fraction


def one_row_per_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per id in a stated order, as one aggregate."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = F.min(F.struct(*order, *rest))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def wave_pair(panel: DataFrame, base: int, follow: int, key: str = "id", wave: str = "wave") -> DataFrame:
    """Baseline wave joined to outcome wave on the id, columns suffixed ``_x`` and ``_y``."""

    def side(number: int, suffix: str) -> DataFrame:
        rows = panel.filter(F.col(wave) == number).drop(wave)
        return rows.select(key, *[F.col(c).alias(f"{c}{suffix}") for c in rows.columns if c != key])

    return side(base, "_x").join(side(follow, "_y"), key)


def adjacent_waves(panel: DataFrame, keep: list[str], condition: str = "cond", key: str = "id", wave: str = "wave") -> DataFrame:
    """Every (w, w + 1) pair at once: one equi join instead of a union of pairwise joins."""
    after = panel.select(key, (F.col(wave) - 1).alias(wave), F.col(condition).alias("follow"))
    return panel.select(key, wave, F.col(condition).alias("base"), *keep).join(after, [key, wave])


def incident(pairs: DataFrame) -> DataFrame:
    """At risk: free of the condition at baseline, known 0/1 at follow-up. The label is the follow-up state."""
    at_risk = pairs.filter((F.col("base") == 0) & F.col("follow").isin(0, 1))
    return at_risk.withColumn("y", F.col("follow").cast("int")).drop("base", "follow")


def drop_ids(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    return train.join(test.select(key).distinct(), key, "left_anti")


def stable_split(key: Column, train: float = 0.70, validation: float = 0.15) -> Column:
    """Hash split of the id: the same id always lands in the same part."""
    f = stable_fraction(key)
    return F.when(f < train, "train").when(f < train + validation, "validation").otherwise("test")


def fold_of(key: Column, k: int = 5) -> Column:
    """Group fold: all rows of one id share a fold. The hash differs from the split's, so folds of a part are even."""
    return F.least(F.floor(stable_fraction(F.concat(F.lit("fold-"), key.cast("string"))) * k), F.lit(k - 1)).cast("int")


def holdout_group(df: DataFrame, group: str, key: str, least: int, smallest: bool, share: float = 0.0) -> DataFrame:
    """The site (smallest) or region (largest) held out: enough ids, at least two candidates for a site."""
    sizes = df.groupBy(group).agg(F.count_distinct(key).alias("n_ids"))
    total = df.select(key).distinct().agg(F.count(F.lit(1)).alias("_total"))
    sized = sizes.crossJoin(F.broadcast(total))  # one row on the right
    able = sized.filter(F.col("n_ids") >= F.greatest(F.lit(float(least)), F.col("_total") * share))
    rank = F.col("n_ids") if smallest else -F.col("n_ids")
    pick = able.agg(F.min(F.struct(rank.alias("rank"), F.col(group).alias("chosen"), F.col("n_ids").alias("n_ids"))).alias("_b"),
                    F.count(F.lit(1)).alias("_c"))
    return pick.filter(F.col("_c") >= (2 if smallest else 1)).select(F.col("_b.chosen").alias(group), "_b.n_ids")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, buckets: int = 4096) -> DataFrame:
    """Exact share per class in hash order; positions are counted per hash bucket, so a class is never sorted whole."""
    from tidemark.operators.skew import ordinal

    hashed = df.withColumn("_f", stable_fraction(F.col(key))).withColumn("_bucket", F.floor(F.col("_f") * buckets))
    numbered = ordinal(hashed, [label], "_bucket", [F.col("_f"), F.col(key)], "_pos")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    part = F.when(F.col("_pos") <= F.round(F.col("_n") * share), "train").otherwise("test")
    return numbered.join(sizes, label).withColumn("part", part).drop("_f", "_bucket", "_pos", "_n")


def split_overlap(members: DataFrame, key: str = "id", part: str = "part") -> DataFrame:
    """Ids that occur in several parts and the number of part pairs that share them."""
    spread = members.groupBy(key).agg(F.count_distinct(part).alias("_k"))
    return spread.agg(
        F.count_if(F.col("_k") > 1).alias("ids_in_several"),
        F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k") * (F.col("_k") - 1) / 2)), F.lit(0)).cast("long").alias("pair_count"),
    )


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of NULLs per column in one pass, one row per column."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rate")) for c in columns])).alias("_m")
    ).select("_m.*")
