"""Column expressions for coercion, normalisation, flags and derived measures."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(pairs: dict) -> Column:
    """A constant map column of a small fixed table."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def to_number(c) -> Column:
    """Bad text, NaN and infinities become NULL."""
    n = col(c).try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == F.lit(float("inf"))), None).otherwise(n)


def to_instant(c) -> Column:
    """ISO text (with or without offset) or epoch seconds; anything else becomes NULL."""
    text = F.trim(col(c))
    epoch = text.try_cast("double")
    return F.coalesce(
        F.when(epoch.isNotNull() & text.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_micros((epoch * 1000000).cast("long"))),
        F.try_to_timestamp(text),
    )


def in_range(c, low, high) -> Column:
    """Out-of-range values become NULL; the row stays."""
    return F.when(col(c).between(low, high), col(c))


def no_negative_codes(c) -> Column:
    return F.when(col(c) >= 0, col(c))


def normal_condition(metric, raw) -> Column:
    """Alias -> canonical condition, then ``unknown`` where the metric does not allow it."""
    text = F.lower(F.trim(F.coalesce(col(raw), F.lit(""))))
    canonical = F.coalesce(F.element_at(literal_map(rules.CONDITION_ALIASES), text), F.lit("unknown"))
    allowed = F.create_map(
        *chain.from_iterable((F.lit(m), F.array(*[F.lit(c) for c in cs])) for m, cs in rules.CONDITIONS_ALLOWED.items())
    )
    list_ = F.element_at(allowed, col(metric))
    return F.when(list_.isNull() | F.array_contains(list_, canonical), canonical).otherwise("unknown")


def normal_source(c) -> Column:
    return F.when(col(c).isin(*rules.KNOWN_SOURCES), col(c)).otherwise("manual")


def quality_flags(value, value2, value_type, low, high, ts, now) -> Column:
    """Flags of one measurement; empty means valid. ``value_type`` NULL marks an unsupported metric."""
    v, second, dual = col(value), col(value2), col(value_type) == "dual"
    return F.array_compact(
        F.array(
            F.when(col(value_type).isNull() | v.isNull(), "unsupported_metric"),
            F.when((v < col(low)) | (v > col(high)), "outside_physical_range"),
            F.when(dual & second.isNull(), "missing_secondary_value"),
            F.when(dual & ((second < 30) | (second > 180)), "secondary_outside_physical_range"),
            F.when(col(ts) > col(now) + F.expr("INTERVAL 5 MINUTES"), "future_timestamp"),
        )
    )


def quality_struct(flags, source, condition, given_ts) -> Column:
    return F.struct(
        (F.size(col(flags)) == 0).alias("valid"),
        F.lit(False).alias("duplicate"),
        col(flags).alias("flags"),
        col(source).alias("source"),
        F.when(col(given_ts).isNotNull(), "provided").otherwise("server_time").alias("timestamp_quality"),
        (col(condition) != "unknown").alias("condition_present"),
        col(condition).alias("measurement_condition"),
    )


QUALITY_SCHEMA = "valid boolean, flags array<string>"


def parse_quality(c) -> Column:
    """Tolerant JSON parse: no text is valid without flags, unreadable text is flagged."""
    parsed = F.from_json(col(c), QUALITY_SCHEMA, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    return (
        F.when(col(c).isNull(), F.struct(F.lit(True).alias("valid"), none.alias("flags")))
        .when(
            parsed["valid"].isNull() & parsed["flags"].isNull(),
            F.struct(F.lit(True).alias("valid"), F.array(F.lit("quality_unparsed")).alias("flags")),
        )
        .otherwise(F.struct(parsed["valid"].alias("valid"), F.coalesce(parsed["flags"], none).alias("flags")))
    )


def body_mass_index(weight, height) -> Column:
    return F.when(col(height) > 0, F.round(col(weight) / (col(height) * col(height)), 4))


def egfr(creatinine_umol, age, sex) -> Column:
    """CKD-EPI 2021 from creatinine in umol/L; sex 0 is female."""
    scr = col(creatinine_umol) / 88.4
    female = col(sex) == 0
    kappa = F.when(female, 0.7).otherwise(0.9)
    alpha = F.when(female, -0.241).otherwise(-0.302)
    ratio = scr / kappa
    value = (
        F.lit(142.0)
        * F.pow(F.least(ratio, F.lit(1.0)), alpha)
        * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2))
        * F.pow(F.lit(0.9938), col(age))
        * F.when(female, 1.012).otherwise(1.0)
    )
    return F.when((scr > 0) & (col(age) >= 18), F.round(value, 2))


def sex_code(c) -> Column:
    text = F.lower(F.trim(col(c)))
    return F.when(text.isin("male", "m", "男", "1"), 1).when(text.isin("female", "f", "女", "0"), 0)


def any_flag(*flags) -> Column:
    """True OR of 0/1 flags; NULL only when every flag is NULL."""
    return F.greatest(*[(col(f) != 0).cast("int") for f in flags])


def completeness(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def missing_names(columns: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))


def segment_score(value, segments) -> Column:
    """First half-open [lo, hi) segment that holds the value; holes stay NULL."""
    out = F.lit(None).cast("int")
    for lo, hi, score in reversed(segments):
        inside = (col(value) >= lo) if hi == rules.INF else (col(value) >= lo) & (col(value) < hi)
        out = F.when(inside, score).otherwise(out)
    return out


def metric_score(metric, value, value2=None, height=None) -> Column:
    """Score of a reading from the fixed segment table; unknown metrics and segment holes give NULL."""
    out = F.when(col(metric) == "ecg", F.when(col(value).isin(100.0, 1.0), 100).otherwise(50))
    second = col(value2) if value2 is not None else F.lit(None).cast("double")
    bp = F.round(
        segment_score(value, rules.SCORE_SEGMENTS[("bp", "sys")]) * F.lit(0.6)
        + segment_score(second, rules.SCORE_SEGMENTS[("bp", "dia")]) * F.lit(0.4)
    ).cast("int")
    out = out.when(col(metric) == "bp", bp)
    tall = F.coalesce(col(height) if height is not None else F.lit(None).cast("double"), F.lit(1.6))
    for (name, part), segments in rules.SCORE_SEGMENTS.items():
        if name == "weight":
            out = out.when(col(metric) == "weight", segment_score(col(value) / (tall * tall), segments))
        elif name != "bp":
            out = out.when(col(metric) == name, segment_score(value, segments))
    return out


def pulse_pressure(high, low, gap: float = 5.0) -> list[Column]:
    """Joint blood-pressure constraint: re-centre when the gap is too small, then clip; flag what changed."""
    centre, tight = (col(high) + col(low)) / 2.0, (col(high) - col(low)) < gap
    s = F.when(tight, centre + gap / 2.0).otherwise(col(high))
    d = F.when(tight, centre - gap / 2.0).otherwise(col(low))
    clipped_s = F.least(F.lit(260.0), F.greatest(F.lit(60.0), s))
    clipped_d = F.least(F.lit(150.0), F.greatest(F.lit(40.0), d))
    changed = tight | (clipped_s != s) | (clipped_d != d)
    return [F.round(clipped_s, 2).alias("high_fit"), F.round(clipped_d, 2).alias("low_fit"), changed.alias("adjusted")]


def risk_band(p, threshold) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, float) else col(threshold)
    return F.when(col(p) >= limit, "high").when(col(p) >= limit / 2.0, "medium").otherwise("low")


def age_band(age) -> Column:
    return F.when(col(age) < 60, "<60").when(col(age) < 70, "60-69").when(col(age) < 80, "70-79").otherwise("80+")


def peer_band(age) -> Column:
    return F.when(col(age).isNull() | (col(age) < 70), "60-69").when(col(age) < 80, "70-79").otherwise("80+")


def missingness_band(share) -> Column:
    return F.when(col(share) >= 0.85, "low").when(col(share) >= 0.60, "moderate").otherwise("high")
