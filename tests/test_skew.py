"""Skew-proof operators against brute force, with one key that holds most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import keepfirst, series as S, skew


def hot_rows(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", round(rng.expovariate(0.02) - 20, 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double")


def test_counted_quantiles_equal_numpy(spark):
    rows, df = hot_rows(spark)
    out = {r["k"]: r for r in skew.quantiles(df, ["k"], "v", {"q1": 0.1, "q5": 0.5, "q8": 0.8}).collect()}
    for key in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == key]
        for name, p in (("q1", 0.1), ("q5", 0.5), ("q8", 0.8)):
            assert out[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    whole = skew.quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([r[2] for r in rows]))


def test_ordinal_and_prefix_sums(spark):
    rows, df = hot_rows(spark)
    chunked = df.withColumn("c", F.floor(F.col("id") / 100))
    got = {r["id"]: r["n"] for r in skew.ordinal(chunked, ["k"], "c", [F.col("id")], "n").collect()}
    seen = {}
    for i, k, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]


def test_salted_join_keeps_every_row(spark):
    rows, df = hot_rows(spark)
    small = df.groupBy("k").agg(F.count("id").alias("n"))
    assert skew.salted_join(df, small, ["k"], ["id"], "inner").count() == len(rows)


def chain(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t >= kept[-1] + gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("seed,step", [(1, 20), (2, 45), (3, 7)])
def test_keep_first_equals_chain(spark, seed, step):
    """A dense key runs over many chunks without a gap, so every chunk depends on the one before it."""
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(1500):
        t += rng.randrange(1, step)
        data.append((i, "hot", t))
    data += [(10000 + i, f"k{i % 9}", rng.randrange(200000)) for i in range(400)] + [(20000, None, 5), (20001, None, 30)]
    df = spark.createDataFrame(data, "measurement_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {}
    for r in keepfirst.kept_instants(df, ["k"], 60, 300).collect():
        got.setdefault(r["k"], []).append(r["kept_us"] // 1_000_000)
    want = {}
    for _, k, s in data:
        want.setdefault(k, []).append(s)
    assert {k: sorted(v) for k, v in got.items()} == {k: chain(v, 60) for k, v in want.items()}


def test_duplicate_chain_of_the_fixture(spark):
    df = spark.createDataFrame([(1, 0), (2, 50), (3, 100)], "measurement_id long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    kept = sorted(r["measurement_id"] for r in keepfirst.keep_first(df, ["k"], 60, 3600, "measurement_id").collect())
    assert kept == [1, 3]


def test_alert_chain_of_the_fixture(spark):
    df = spark.createDataFrame([(1, 0), (2, 20), (3, 40)], "measurement_id long, h long").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)).withColumn("k", F.lit("t"))
    kept = sorted(r["measurement_id"] for r in keepfirst.keep_first(df, ["k"], 86400, 7 * 86400, "measurement_id").collect())
    assert kept == [1, 3]


def test_three_values_at_one_instant(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 60.0)], "measurement_id long, value double").withColumn("ts", F.timestamp_seconds(F.lit(5))).withColumn("k", F.lit(1))
    row = S.collapse(df, ["k"]).first()
    assert (row["value"], row["n_raw"]) == (30.0, 3)


def test_quantiles_with_missing_values_and_keys(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0), ("a", nan), ("a", 3.0), (None, -2.0), (None, None), ("b", None), ("b", nan), ("c", inf), ("c", -inf), ("c", 0.0), ("d", -0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in skew.quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, None: -2.0, "b": None, "c": 0.0, "d": 0.0}
    assert skew.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []
