"""Participant context: scores, quality, completeness, rules, plans and evidence cards, for everybody at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators.skew import latest


def domain_scores(scored: DataFrame, id_: str = "participant_id") -> DataFrame:
    """Latest score per metric -> rounded mean per domain -> rounded mean of domains; absent domains stay absent."""
    newest = latest(scored, [id_, "mtype"], ["ts", "measurement_id"], ["score"]).filter("score is not null")
    domain = F.lit(None).cast("string")
    for name, members in rules.SCORE_DOMAINS.items():
        domain = F.when(F.col("mtype").isin(*members), name).otherwise(domain)
    per_domain = (
        newest.withColumn("domain", domain).filter("domain is not null").groupBy(id_, "domain")
        .agg(F.round(F.avg("score")).cast("int").alias("score"))
    )
    parts = [F.max(F.when(F.col("domain") == d, F.col("score"))).alias(d) for d in rules.SCORE_DOMAINS]
    return per_domain.groupBy(id_).agg(*parts, F.round(F.avg("score")).cast("int").alias("total"))


def suggestions(scores: DataFrame) -> DataFrame:
    """Up to three hints in a fixed order for domains below 80."""
    order = {"chronic": "record blood pressure twice a day", "activity": "move half an hour a day",
             "sleep": "keep a fixed bedtime", "nutrition": "eat regular balanced meals"}
    hints = F.array_compact(F.array(*[F.when(F.col(d) < 80, text) for d, text in order.items()]))
    hints = F.when(F.size(hints) == 0, F.array(F.lit("keep up the good habits"))).otherwise(F.slice(hints, 1, 3))
    return scores.withColumn("suggestions", F.array_join(hints, "; "))


def daily_score(scored: DataFrame, id_: str = "participant_id") -> DataFrame:
    return scored.filter("score is not null").groupBy(id_, F.to_date("ts").alias("day")).agg(
        F.avg("score").alias("score"), F.count("score").alias("readings")
    )


def quality_summary(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Readings, condition gaps and flag counts per key; flags are counted before they are listed (fixed vocabulary)."""
    base = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"), F.count_if(F.col("condition") == "unknown").alias("missing_condition")
    )
    counted = flagged.select(*keys, F.explode("flags").alias("flag")).groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "flag", F.col("n").cast("string")))), ",").alias("flag_counts")
    )
    return base.join(listed, keys, "left").withColumn("flag_counts", F.coalesce("flag_counts", F.lit("")))


def common_completeness(rows: DataFrame, id_: str, metric: str) -> DataFrame:
    """Share and list of the common metrics; each is tested by its own flag, no set is collected."""
    held = rows.groupBy(id_).agg(*[F.bool_or(F.col(metric) == m).alias(m) for m in rules.COMMON_METRICS])
    present = sum((F.col(m).cast("int") for m in rules.COMMON_METRICS), F.lit(0))
    gaps = F.array_compact(F.array(*[F.when(~F.col(m), m) for m in rules.COMMON_METRICS]))
    return held.select(id_, F.round(present / float(len(rules.COMMON_METRICS)), 3).alias("ratio"), F.array_join(gaps, ",").alias("missing"))


def direction_consensus(changes: DataFrame, id_: str = "participant_id") -> DataFrame:
    low, high = F.min("direction"), F.max("direction")
    return changes.groupBy(id_).agg(F.when(low == high, low).otherwise("mixed").alias("consensus"), F.count("direction").alias("metrics"))


def direction_map(changes: DataFrame, id_: str = "participant_id", metric: str = "metric") -> DataFrame:
    """Directions of all metrics of one participant side by side (bounded by the metric catalogue)."""
    entries = F.array_sort(F.collect_list(F.struct(metric, "direction")))
    return changes.groupBy(id_).agg(F.map_from_entries(entries).alias("directions"))


RULE_COLUMNS = "rule string, mtype string, lo double, hi double, priority string, action string, schedule string"
PRIORITY_RANK = {"urgent": 0, "high": 1, "normal": 2}


def matched_rules(values: DataFrame, table: DataFrame) -> DataFrame:
    """Equi join on the metric plus the rule's half-open range; the rule table is fixed and small."""
    hit = (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))
    return values.join(F.broadcast(table), "mtype").filter(hit).drop("lo", "hi")


def prioritised(actions: DataFrame, id_: str, n: int = 4) -> DataFrame:
    """First ``n`` actions per participant: urgent before high before normal, then by rule name."""
    rank = F.lit(3)
    for name, value in PRIORITY_RANK.items():
        rank = F.when(F.col("priority") == name, value).otherwise(rank)
    ordered = Window.partitionBy(id_).orderBy(rank, "rule")
    return actions.withColumn("position", F.row_number().over(ordered)).filter(F.col("position") <= n)


def weekly_plan(people: DataFrame, template: DataFrame, id_: str, days: int = 7) -> DataFrame:
    """Template rows of the participant's topic whose condition flag holds, at most one week."""
    rows = people.join(F.broadcast(template), "topic").filter(
        F.col("needs").isNull() | ((F.col("needs") == "fall_risk") & F.col("fall_risk")) | ((F.col("needs") == "no_fall_risk") & ~F.col("fall_risk"))
    )
    ordered = Window.partitionBy(id_).orderBy("day_offset", "action")
    return rows.withColumn("_rn", F.row_number().over(ordered)).filter(F.col("_rn") <= days).drop("_rn", "needs", "fall_risk")


def factors(flags: DataFrame, id_: str, names: list[str]) -> DataFrame:
    """Matched and missing factor lists from boolean columns (NULL counts as missing)."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit(False)), n) for n in names]))
    gaps = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n), F.lit(False)), n) for n in names]))
    return flags.select(id_, F.array_join(held, ",").alias("matched"), F.array_join(gaps, ",").alias("missing"))


def uncertainty(best_authority: Column, has_actions: Column, flagged: Column) -> Column:
    level = F.when((best_authority >= 4) & has_actions, "high").when(best_authority.isNotNull(), "medium").otherwise("low")
    return F.when(flagged & (level == "high"), "medium").otherwise(level)


def entry_text(key: str, value: Column) -> Column:
    """Sorted ``key=value`` list of a grouped column: a stable text form of a map."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(key), value))), ",")
