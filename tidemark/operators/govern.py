"""Data-set governance: validation, coverage and readiness gates, manifests, keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import quantiles, salted_join


def participant_table(rows: DataFrame, id_: str = "participant_id", ts: str = "ts") -> DataFrame:
    """Per participant: first site and region, span, rows, distinct metrics."""
    first = F.struct(ts, "measurement_id")
    base = rows.groupBy(id_).agg(
        F.min_by("site_id", first).alias("site_id"), F.min_by("region_id", first).alias("region_id"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("value").alias("n_rows"),
        F.collect_set("metric").alias("_metrics"),  # bounded by the metric catalogue
    )
    whole_days = F.floor((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(86400000000)) + 1
    return base.withColumn("n_metrics", F.size("_metrics")).withColumn("span_days", whole_days).drop("_metrics")


def summary_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows per value of every dimension from one pass (grouping sets)."""
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    name, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        code = (2 ** len(dimensions) - 1) & ~(1 << (len(dimensions) - 1 - i))
        name = F.when(F.col("_g") == code, F.lit(d)).otherwise(name)
        label = F.when(F.col("_g") == code, F.col(d).cast("string")).otherwise(label)
    return sets.select(name.alias("dimension"), label.alias("label"), "n")


def dataset_summary(rows: DataFrame, participants: DataFrame, target_days: int = 90) -> DataFrame:
    """One row of totals; distinct counts come from the already grouped participant table where possible."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("site_id").alias("sites"), F.count_distinct("region_id").alias("regions")
    )
    people = participants.agg(F.count(F.lit(1)).alias("participants"), F.count_if(F.col("span_days") >= target_days).alias("long_participants"))
    span = quantiles(participants.withColumn("_s", F.col("span_days").cast("double")), [], "_s", {"median_span_days": 0.5})
    return totals.crossJoin(F.broadcast(people)).crossJoin(F.broadcast(span))  # single rows


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def series_coverage(rows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Distinct days per series: days are made distinct first, so a hot series is counted from many tasks."""
    return rows.select(*keys, F.to_date(ts).alias("_d")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("valid_days"))


def readiness(participants: DataFrame, gates: dict[str, int], span_days: int, external: DataFrame) -> DataFrame:
    """Boolean gates on the number of participants, their span and an external site."""
    long_enough = F.count_if(F.col("span_days") >= span_days)
    flags = participants.agg(
        *[((F.count(F.lit(1)) >= n) & (long_enough >= n)).alias(name) for name, n in gates.items()]
    )
    return flags.crossJoin(F.broadcast(external.agg((F.count(F.lit(1)) > 0).alias("external_holdout"))))  # single rows


def column_report(columns: list[str], required: set[str], forbidden: set[str], spark) -> DataFrame:
    """Missing and forbidden columns; a frame with missing columns must not be read further."""
    rows = [(c, "missing") for c in sorted(required - set(columns))]
    rows += [(c, "forbidden") for c in sorted({c.lower() for c in columns} & forbidden)]
    return spark.createDataFrame(rows, "column_name string, problem string")


def unexpected_values(rows: DataFrame, allowed: dict[str, tuple]) -> DataFrame:
    """Values outside each column's allowed set, with counts."""
    bad = F.explode(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*ok), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")))
        for c, ok in allowed.items()
    ])))
    return rows.select(bad.alias("_b")).select("_b.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_references(rows: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Distinct references without a target. References are made distinct before the join, so no key is hot."""
    distinct = rows.select(F.col(column).alias("reference")).filter("reference is not null").distinct()
    return distinct.join(known.select(F.col(known_column).alias("reference")).distinct(), "reference", "left_anti")


def newest_state(log: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Latest state per key of an append-only change log (upsert by last writer)."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order]))
    return log.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep])


def erase(tables: dict[str, tuple[DataFrame, str]], erased: DataFrame) -> dict[str, DataFrame]:
    """Every dependent table without the erased ids; the id list is made distinct once."""
    ids = erased.select(F.col(erased.columns[0]).alias("_id")).distinct()
    return {name: df.join(ids, df[key] == ids["_id"], "left_anti") for name, (df, key) in tables.items()}


def fingerprint(columns: list[str]) -> Column:
    """Cross-engine row hash over the named columns in sorted order."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)]), 256)


def change_signature(rows: DataFrame, key: str, ts: str, profile: DataFrame, fields: list[str]) -> DataFrame:
    """Signature of a participant's inputs: newest record instant plus profile fields."""
    newest = rows.groupBy(key).agg(F.unix_micros(F.max(ts)).alias("newest_us"))
    joined = newest.join(profile, key, "left")
    parts = [F.col("newest_us").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]]
    return joined.select(key, F.sha2(F.concat_ws("|", *parts), 256).alias("signature"))


def changed_only(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Participants whose signature is new or different."""
    return current.join(stored, [key, "signature"], "left_anti")


def compare_manifests(now: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """Full outer comparison: same, changed, missing or new artifact."""
    a, b = now.select(key, F.col("sha256").alias("_now")), stored.select(key, F.col("sha256").alias("_was"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_was").isNull(), "new").when(F.col("_now") == F.col("_was"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def per_reviewer_state(reviews: DataFrame, sources: DataFrame, key: str, reviewer: str) -> DataFrame:
    """Sources with this reviewer's status; pending where nothing was recorded."""
    own = reviews.filter(F.col("reviewer") == reviewer).select(key, "status")
    return sources.join(own, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """A report's first n rows: a per-task limit followed by one small merge."""
    return df.orderBy(*order).limit(n)


def followups_closed(followups: DataFrame, results: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Status of every scheduled follow-up: completed by the first later result of its key within ``days``.

    Results are reduced to one row per (key, day) before the join; each follow-up meets at most ``days + 1`` of them.
    """
    per_day = results.groupBy(*keys, F.to_date("ts").alias("_day")).agg(F.max("ts").alias("_hi"))
    due = followups.withColumn("_day", F.explode(F.sequence(F.to_date("due_ts"), F.date_add(F.to_date("due_ts"), days))))
    joined = salted_join(due, per_day, keys + ["_day"], ["followup_id"], "left", 8)
    # on the due day only a reading after the due instant counts, so the day's last reading decides
    done = joined.groupBy("followup_id", *keys, "due_ts").agg(F.min(F.when(F.col("_hi") > F.col("due_ts"), F.col("_day"))).alias("closed_day"))
    return done.withColumn("status", F.when(F.col("closed_day").isNull(), "scheduled").otherwise("completed"))
