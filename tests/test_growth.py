"""Work that must follow parts, pages or pieces, and not rows, series or replicates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.functions import fits
from tidemark.operators import evaluate as A, evidence as E, graph as K, learn as L
from tidemark.streaming import suppress as S


def test_tied_edges_and_tokens_add_no_rows(spark):
    """Hundreds of edges with one score over several batches; shared tokens are masks, not rows."""
    edges = spark.createDataFrame([("s", f"t{i:03d}", "increases_risk_of", "high", "alpha beta") for i in range(300)], "source string, target string, type string, strength string, evidence string")
    seeds = spark.createDataFrame([(q, "s") for q in (0, 1, 70)], "question long, node string")
    asked = spark.createDataFrame([(0, ["alpha", "beta", None]), (1, []), (70, None)], "question long, question_tokens array<string>")
    none = spark.createDataFrame([], "node string"), spark.createDataFrame([], "source string, target string")
    touched = E.touched_edges(edges, K.planes(edges, seeds), asked, *none)
    assert "collect_set" not in touched._jdf.queryExecution().optimizedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = E.best_edges(touched, 5).orderBy("question", "position").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r["question"], r["target"]) for r in got] == [(q, f"t{i:03d}") for q in (0, 1, 70) for i in range(5)]
    base = got[5]["score"]
    assert [round(r["score"] - base, 4) for r in got] == [0.4] * 5 + [0.0] * 10


@pytest.fixture
def shuffled(spark):
    """Sorted joins only, as with tables of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hub_edges(spark):
    kinds = ["increases_risk_of", "protective_against", "mentions"]
    rows = [("hub" if i % 2 else f"s{i % 9}", f"t{i % 50}", kinds[i % 3], "high", f"e{i % 4}") for i in range(600)]
    return spark.createDataFrame(rows, "source string, target string, type string, strength string, evidence string")


def test_edges_move_once_to_each_end(spark, shuffled):
    """beyond the stored halves the edges are dealt by their targets only; conflicts, repeats and contexts take no further exchange."""
    edges = hub_edges(spark)
    seeds = spark.createDataFrame([(0, "hub"), (1, "s1"), (70, "t3")], "question long, node string")
    asked = spark.createDataFrame([(q, ["hub"]) for q in (0, 1, 70)], "question long, question_tokens array<string>")
    context = spark.createDataFrame([("t3",)], "node string")
    planes = K.planes(edges, seeds)
    assert shuffled(planes).count("Exchange hashpartitioning") == 1  # of the stored fronts; the edges are not read again
    touched = E.touched_edges(edges, planes, asked, context, K.conflicts(edges))
    plan = shuffled(touched)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(dealt) == 4, plan  # edges and nodes by target, then what is left of both sides by word
    assert touched.filter("conflict").count() and touched.filter("context_match").count()


def test_sources_side_is_dealt_once(spark, shuffled):
    edges = hub_edges(spark)
    clash = K.conflicts(edges).select("source", "target").distinct().collect()
    nodes = spark.createDataFrame([("hub", [(0, 1, 0, 0)], True)], "node string, reach array<struct<word:long,m0:long,m1:long,m2:long>>, context boolean")
    before = {key: spark.conf.get(key) for key in E.DEALT_ONCE}
    try:
        for key, value in E.DEALT_ONCE.items():
            spark.conf.set(key, value)
        half = E._from_sources(edges, spark.createDataFrame(clash, "source string, target string"), nodes)
        assert shuffled(half).count("Exchange hashpartitioning") == 3  # edges, conflicts, nodes
        rows = half.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    pairs = {tuple(r) for r in clash}
    assert len(rows) == edges.distinct().count() and pairs
    assert all(r["conflict"] == ((r["source"], r["target"]) in pairs) and r["_source"] == (r["source"] == "hub") for r in rows)


def test_shuffled_edges_leave_the_disk(spark, tmp_path):
    """A stored table keeps no shuffle files behind it."""
    from tidemark.session import stored

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum(1 for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f)

    before = files()
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert files() <= before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


class Store:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


@pytest.mark.parametrize("stage", [S.ChunkTable, S.ChunkChain, S.ChunkRows])
def test_state_calls_follow_pages(stage):
    n, gap, width = 400, 10, 100
    store, made = Store(), stage(gap, width, None)
    made.init(store)
    names, at = [f"s{i}" for i in range(n)], np.arange(n) % width
    tables = [S.entry_table(np.array([t], np.int64), 0, width, gap) for t in at]
    rows = pd.DataFrame({
        "series": names, "chunk": 0, "t": at, "id": np.arange(n), "kind": 0, "entries": [x.tobytes() for x, _ in tables], "exits": [x.tobytes() for _, x in tables],
    })
    key = (0,) if stage is S.ChunkChain else (0, 0)
    first = [len(x) for x in made.handleInputRows(key, iter([rows]), None)]
    assert store.calls <= 4 * S.PAGES  # pages of block 0 and, for the chain, of the chunks beside it
    again = list(made.handleInputRows(key, iter([rows]), None))  # from the pages that were written
    assert not again and sum(first) == (0 if stage is S.ChunkRows else n)
    other = list(made.handleInputRows(key, iter([rows.assign(series="new" + rows["series"])]), None))
    assert sum(map(len, other)) == sum(first)


def test_boosted_fits_get_parts_by_rows(spark, monkeypatch):
    seen = []
    for kind in (L.GBTClassifier, L.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda _, df: seen.append((df.rdd.getNumPartitions(), df.count())))
    rows = spark.createDataFrame([(Vectors.dense([float(i)]), i % 2) for i in range(100)], ["features", "y"]).repartition(64)
    L.boosted_classifier(rows, "y")
    L.boosted_regressor(rows, "y")
    assert seen == [(1, 100), (1, 100)]
    assert [L.task_count(n, 12) for n in (0, 8192, 8193, 60_000, 1_500_000, 90_000_000)] == [1, 1, 2, 8, 12, 90]


def test_robust_fits_of_a_series_are_stacked(monkeypatch):
    calls, real = [], fits.huber_lines
    monkeypatch.setattr(fits, "huber_lines", lambda *a: calls.append(len(a[2])) or real(*a))
    rng = np.random.default_rng(3)
    x, y = np.arange(20.0), rng.normal(50, 20, 20)
    fits.predict(x, y, np.array([10, 20]), np.array([0, 1]), np.array([12.0, 22.0]))
    slope, icpt, _, late = fits.trend_fit(x, y)
    assert calls == [4, 2]
    every = np.ones((1, 20), bool)
    assert (slope, icpt) == tuple(v[0] for v in real(x, y, every)) and late == real(x, y, every & (np.arange(20) >= 14))[0][0]


def test_bootstrap_makes_no_row_per_score_and_replicate(spark, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 7)
    rng = np.random.default_rng(5)
    scores, labels = rng.integers(0, 60, 400) / 64, rng.integers(0, 2, 400)
    rows = spark.createDataFrame([(int(y), float(p)) for y, p in zip(labels, scores)], "y int, p double")
    made = A.bootstrap_interval(A.score_histogram(rows, []), replicates=20)
    assert "posexplode" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["metric"]: r for r in made.collect()}
    values = {"auroc": [], "brier": [], "log_loss": []}
    p = np.unique(scores)
    drawn = []
    for s in p:
        draw = np.random.default_rng([42, int(round(s * 1e9))])
        drawn.append((draw.poisson((labels[scores == s] == 1).sum(), 20), draw.poisson((labels[scores == s] == 0).sum(), 20)))
    for k in range(20):
        a, b = (np.array([d[i][k] for d in drawn]) for i in (0, 1))
        above = a[::-1].cumsum()[::-1] - a
        values["auroc"].append((b * (above + a / 2)).sum() / (a.sum() * b.sum()))
        c = np.clip(p, 1e-6, 1 - 1e-6)
        values["brier"].append((a * (1 - p) ** 2 + b * p**2).sum() / (a + b).sum())
        values["log_loss"].append((-a * np.log(c) - b * np.log(1 - c)).sum() / (a + b).sum())
    for name, v in values.items():
        assert got[name]["n_bootstrap"] == 20
        assert np.allclose([got[name][c] for c in ("estimate", "lower", "upper")], [np.mean(v), *np.quantile(v, [0.025, 0.975])])


def test_relation_names_are_not_multiplied(spark, tmp_path):
    from tidemark.plans.catalog import QUERIES

    orders = [(997 * k + 4, c) for k in range(3) for c in (5, 6)] + [(3, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "five"), (6, "six"), (4, None)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    made = QUERIES["jn7_two_role_relations"](spark, str(tmp_path))
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = [(5, "member", 5, "five"), (5, "member", 6, "six"), (5, "senior", 5, "five"), (6, "senior", 5, "five"), (None, "senior", 4, None)]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)


def test_edges_are_grouped_by_numbers(spark, tmp_path):
    from tidemark.sources.views import SCHEMAS, Study

    rows = [(1, 7, 3, 45.0, "R"), (1, 7, 2, 10.0, "R"), (1, 7, 5, 20.0, "A"), (2, 27, 1, 1.0, "N"), (None, 7, 1, 1.0, None), (1, None, 4, 1.0, "R")]
    df = spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    spark.createDataFrame([], SCHEMAS["lineitem"]).unionByName(df, allowMissingColumns=True).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = Study(spark, str(tmp_path)).edges
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "supplier:" not in plan[plan.index("Aggregate") :]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([
        ("supplier:1", "part:7", "increases_risk_of", "high", "src7#2"), ("supplier:1", "part:7", "protective_against", "moderate", "src7#5"),
        ("supplier:2", "part:27", "mentions", "low", "src7#1"), (None, "part:7", "mentions", "low", "src7#1"), ("supplier:1", None, "increases_risk_of", "low", None),
    ], key=repr)
