"""Hand-made edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C, fits, text as T
from tidemark.operators import context as X, curve as V, evaluate as E, graph as K, govern as G, learn as L, panel as P, retrieve as R, series as S


def days(spark, values, key="a", skip=()):
    start = dt.date(2024, 1, 1)
    rows = [(key, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "participant_id string, day date, v double")


def test_mad_zero_removes_nothing(spark):
    out = S.mad_clean(days(spark, [5.0] * 10), ["participant_id"])
    assert out.filter("not keep or spike").count() == 0


def test_single_spike_is_flagged_not_a_strong_trend(spark):
    values = [100 + (-1) ** i * 2 for i in range(30)]
    values[15] = 300
    flagged = S.mad_clean(days(spark, values), ["participant_id"])
    assert flagged.filter("spike").count() == 1
    trend = S.ols_trend(flagged.filter("keep").select("participant_id", "day", "v"), ["participant_id"]).first()
    assert trend["direction"] == "stable"
    rule = spark.range(1).select(V.alert_rule(F.lit(True), F.lit("strong"), F.lit("rising"), F.lit("rising"), F.lit(False)).alias("r")).first()["r"]
    assert rule == "abnormal_spike"


def test_gates(spark):
    rows = [(20, 27.0, 0), (21, 28.0, 7), (42, 56.0, 14), (84, 90.0, 30)]
    df = spark.createDataFrame(rows, "n int, span double, want int").withColumn("got", V.gate_horizon(F.col("n"), F.col("span"), 30))
    assert df.filter("got <> want").count() == 0


def test_six_days_are_not_analysed(spark):
    assert V.packed(days(spark, [1, 2, 3, 4, 5, 6]), ["participant_id"]).count() == 0


def test_calendar_gap_keeps_days_apart(spark):
    series = days(spark, range(1, 25), skip=(12,))
    rows = V.aligned(V.forecast_windows(series, ["participant_id"], 10, 7), series, ["participant_id"]).collect()
    assert rows and all((r["day"] - dt.date(2024, 1, 1)).days + 1 == r["actual"] for r in rows)
    assert dt.date(2024, 1, 13) not in {r["day"] for r in rows}


def test_rising_series_gets_a_gated_forecast(spark):
    rng = np.random.default_rng(3)
    values = 120 + 0.05 * np.arange(60) + rng.normal(0, 0.6, 60)
    row = V.analysed(V.packed(days(spark, values), ["participant_id"]), ["participant_id"], 14, low=60, high=260).first()
    assert row["available"] and row["horizon"] == 14 and len(row["forecast"]) == 14
    assert all(p["lower"] <= p["predicted"] <= p["upper"] for p in row["forecast"])
    assert row["long_term_trend"] in ("rising", "stable")


def test_raw_interval_can_cross_the_bound(spark):
    """The alert looks at the interval before clipping."""
    rng = np.random.default_rng(4)
    row = V.analysed(V.packed(days(spark, 99 + rng.normal(0, 0.5, 40)), ["participant_id"]), ["participant_id"], 7, low=50, high=99.2).first()
    assert row["crosses_bound"] and max(p["upper"] for p in row["forecast"]) <= 99.2


def plain_huber(x, y):
    a = np.vstack([x, np.ones_like(x)]).T
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    scale = max(1.4826 * np.median(np.abs(y - a @ coef)), 1e-9)
    for _ in range(25):
        away = np.abs(y - a @ coef)
        w = np.sqrt(np.where(away > 1.345 * scale, 1.345 * scale / np.maximum(away, 1e-300), 1.0))
        coef = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
    return coef


def test_prefix_fits_equal_one_by_one_fits():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.integers(1, 3, 40)).astype(float)
    y = 50 + 0.3 * x + rng.normal(0, 2, 40)
    y[7] += 40
    ends = np.arange(8, 41)
    mask = np.arange(40)[None, :] < ends[:, None]
    slope, icpt = fits.huber_lines(x, y, mask)
    for i, e in enumerate(ends):
        want = plain_huber(x[:e], y[:e])
        assert (slope[i], icpt[i]) == pytest.approx(tuple(want), rel=1e-6)
    level, pace = fits.state_filter(x, y, ends)
    for i, e in enumerate(ends):
        alone = fits.state_filter(x[:e], y[:e], np.array([e]))
        assert (level[i], pace[i]) == pytest.approx((alone[0][0], alone[1][0]), rel=1e-9)
    lead, actual, predicted = fits.rolling_origins(x, y)
    assert lead.min() > 0 and lead.max() <= 7 and len(actual) == len(predicted["huber"])


def test_local_smoother_follows_a_line_through_an_outlier():
    x = np.arange(30.0)
    y = 2 * x + 1
    y[10] += 50
    smooth = fits.local_smooth(x, y)
    assert np.abs(np.delete(smooth - (2 * x + 1), 10)).max() < 3


def risk(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_auc_ties_and_single_class(spark):
    def auc(rows):
        return E.ranking_metrics(E.running_counts(E.score_histogram(risk(spark, rows), []), []), []).first()["auroc"]

    assert auc([(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.2), (1, 0.9)]) is None
    rng = np.random.default_rng(5)
    rows = [(int(a), round(float(b), 2)) for a, b in zip(rng.integers(0, 2, 300), rng.random(300))]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc(rows) == pytest.approx(want)


def test_last_calibration_bin_is_closed(spark):
    bins = E.calibration_bins(risk(spark, [(1, 1.0), (0, 0.95), (1, 0.0)]), [], [i / 10 for i in range(11)]).collect()
    assert {b["bin"]: b["n"] for b in bins} == {9: 2, 0: 1}


def test_zero_baseline_is_null_and_stable(spark):
    rows = [(1, "m", 0.0, "2024-01-01 00:00:00"), (1, "m", 5.0, "2024-01-30 00:00:00")]
    df = spark.createDataFrame(rows, "participant_id long, metric string, value double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    row = S.recent_vs_baseline(df, ["participant_id"], "2024-01-31 00:00:00").first()
    assert row["trend_pct"] is None and row["trend"] == "stable"


def test_future_rows_do_not_change_features(spark):
    rows = [(1, 1, 5.0, "2024-01-20 00:00:00"), (2, 1, 7.0, "2024-01-22 00:00:00")]
    make = lambda r: spark.createDataFrame(r, "measurement_id long, participant_id long, value double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    a = S.window_features(make(rows), ["participant_id"], "2024-01-25 00:00:00").collect()
    b = S.window_features(make(rows[::-1] + [(3, 1, 900.0, "2024-02-20 00:00:00")]), ["participant_id"], "2024-01-25 00:00:00").collect()
    assert sorted(a) == sorted(b)


def test_score_holes_are_null(spark):
    df = spark.createDataFrame([("glucose", 3.0, None), ("sleep", 9.5, None), ("bp", 120.0, None), ("bp", 120.0, 80.0), ("ecg", 1.0, None), ("other", 1.0, None)], "m string, v double, v2 double")
    assert [r["s"] for r in df.select(C.metric_score("m", "v", "v2").alias("s")).collect()] == [None, None, None, 100, 100, None]


def test_split_leak_counts(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (1, "external"), (2, "train")], "id long, part string")
    assert tuple(P.split_overlap(df).first()) == (1, 3)


def test_contradictory_edges_give_one_row(spark):
    rows = [("a:1", "b:2", "increases_risk_of"), ("a:1", "b:2", "protective_against"), ("a:1", "b:3", "managed_by")]
    assert K.conflicts(spark.createDataFrame(rows, "source string, target string, type string")).count() == 1


def test_expansion_cycle_and_many_questions(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "source string, target string")
    seeds = spark.createDataFrame([(0, "a"), (75, "c"), (130, "b")], "question long, node string")
    got = {(r["question"], r["node"]): r["hop"] for r in K.unpack(K.reach(edges, seeds)).collect()}
    assert got == {(0, "a"): 0, (0, "b"): 1, (0, "c"): 2, (75, "c"): 0, (75, "b"): 1, (75, "d"): 1, (75, "a"): 2, (130, "b"): 0, (130, "a"): 1, (130, "c"): 1, (130, "d"): 2}


def test_tokens_mix_words_terms_and_bigrams(spark):
    row = spark.createDataFrame([("Blood 血压高 is ok",)], "t string").select(T.tokens(F.col("t")).alias("x")).first()["x"]
    assert set(row) == {"blood", "血压", "压高"}


def test_unit_audit(spark):
    df = spark.createDataFrame([("您的血糖 7 %",), ("血糖 7 mmol/L",)], "t string")
    assert [list(r["w"]) for r in df.select(T.wrong_units(F.col("t")).alias("w")).collect()] == [["血糖 %"], []]


def test_near_duplicate_items_keep_first(spark):
    df = spark.createDataFrame([(["walk ten minutes", "Walk ten minutes!", "walk", "please walk ten minutes", "sleep early today"],)], "i array<string>")
    assert list(df.select(T.distinct_items(F.col("i")).alias("k")).first()["k"]) == ["walktenminutes", "walktenminutes!", "walk", "sleepearlytoday"][0:1] + ["walk", "sleepearlytoday"]


def corpus(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    rows = []
    for i in range(n):
        size = int(rng.integers(1, 9))
        rows.append((f"{i}#0", i, int(rng.integers(0, 5)), " ".join(rng.choice(words, size)), f"s{i % 11}#0", bool(i % 13 == 0)))
    asks = [(q, " ".join(rng.choice(words, 6)) if q else "zzz yyy") for q in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, authority int, text string, evidence_key string, registry boolean")
    return chunks, spark.createDataFrame(asks, "question_id long, text string"), rows, asks


def test_scan_and_join_retrieval_equal_brute_force(spark):
    chunks, questions, rows, asks = corpus(spark)
    w = R.Weights(topics={"t": ("wab", "wb")}, danger=("wc",))
    linked = spark.createDataFrame([("s1#0",), ("s2#0",)], "evidence_key string")
    direct = spark.createDataFrame([(1, "s2#0"), (2, "s5#0")], "question_id long, evidence_key string")
    clash = spark.createDataFrame([("s2#0",)], "evidence_key string")
    want = {}
    for q, text in asks:
        qt, scores = set(text.split()), []
        for cid, doc, authority, body, key, registry in rows:
            alias = sum(x in body for x in ("wab", "wb")) if any(x in text for x in ("wab", "wb")) else 0
            link = 4 if (q, key) in {(1, "s2#0"), (2, "s5#0")} else 1 if key in ("s1#0", "s2#0") else 0
            s = len(qt & set(body.split())) + 2 * alias + (2 if "wc" in text and "wc" in body else 0) + link + 0.5 * authority - 2 * registry - (2 if key == "s2#0" else 0)
            if s:
                scores.append((-s, cid))
        want[q] = [(c, -s) for s, c in sorted(scores)[:8]]
    got = {}
    for r in R.hybrid_top_k(chunks, questions, linked, direct, clash, 8, w).orderBy("question_id", "position").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], r["score"]))
    assert got == want


def test_lexical_overlap_equals_plain(spark):
    chunks, questions, _, _ = corpus(spark)
    tokens = T.tokens(F.col("text"), ()).alias("tokens")
    held, asked = chunks.select("*", tokens).collect(), questions.select("question_id", tokens).collect()
    want = {}
    for q in asked:
        found = [(-round(len(set(q.tokens) & set(c.tokens)) + 0.6 * int(c.authority) - (0.2 if c.registry else 0.0), 4), c.chunk_id) for c in held if set(q.tokens) & set(c.tokens)]
        want[q.question_id] = [(c, -s) for s, c in sorted(found)[:5]]
    got = {}
    for r in R.lexical_top_k(chunks, questions, 5, 0.6, 0.2).orderBy("question_id", "position").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], r["score"]))
    assert got == {q: v for q, v in want.items() if v}


def test_passages_cut_inside_words(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta yy"), (2, "alpha beta"), (3, "beta gamma")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "ha beta gam"), (8, "a beta gamma d")], "question_id long, text string")
    got = {tuple(r) for r in R.passages_in(docs, asked).collect()}
    assert got == {(7, 1), (8, 1)}


def test_permutation_keeps_the_values(spark):
    df = spark.range(500).select("id", (F.col("id") * 3).alias("v"))
    out = L.permuted(df, "v", F.col("id"), 1, 4)
    assert sorted(r["v"] for r in out.collect()) == [i * 3 for i in range(500)]
    assert out.filter(F.col("v") != F.col("id") * 3).count() > 400


def test_ridge_equals_the_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    x, noise = rng.normal(size=(80, 2)), rng.normal(size=80)
    y = 3 + x @ np.array([2.0, -1.0]) + noise
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    model = L.ridge(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df), "y", 10.0)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_abstention(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, None, 5.0)], "a double, b double, prediction double")
    rows = L.abstaining(df, ["a", "b"], 1.0, 10.0, least=0.8).collect()
    assert [r["abstained"] for r in rows] == [False, True] and rows[1]["point"] is None and rows[0]["lower"] == 4.0


def test_identifier_columns_are_refused(spark):
    from tidemark.plans.measurement import without_identifiers

    with pytest.raises(ValueError):
        without_identifiers(spark.range(1).withColumn("phone", F.lit("1")), set())


def test_quality_parse(spark):
    df = spark.createDataFrame([(None,), ("{oops",), ('{"valid":false,"flags":["x"]}',)], "q string")
    rows = [r["p"] for r in df.select(C.parse_quality("q").alias("p")).collect()]
    assert [(p["valid"], list(p["flags"])) for p in rows] == [(True, []), (True, ["quality_unparsed"]), (False, ["x"])]


def test_instants(spark):
    df = spark.createDataFrame([("2024-01-01T08:00:00+08:00",), ("1704067200",), ("nope",)], "t string")
    assert [r["u"] for r in df.select(F.unix_seconds(C.to_instant("t")).alias("u")).collect()] == [1704067200, 1704067200, None]


def test_manifest_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    was = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in G.compare_manifests(now, was).collect()} == {"a": "same", "b": "changed", "c": "new", "d": "missing"}


def test_empty_context_gives_every_gap(spark):
    row = X.factors(spark.createDataFrame([(1, None, True)], "id long, a boolean, b boolean"), "id", ["a", "b"]).first()
    assert (row["matched"], row["missing"]) == ("b", "a")


def test_one_character_names_are_seeded(spark):
    from tidemark.operators.retrieve import seeds

    asked = spark.createDataFrame([(1, ["吃盐", "abc"]), (2, ["血压"])], "question_id long, tokens array<string>")
    names = spark.createDataFrame([("e:salt", "盐"), ("e:bp", "高血压"), ("e:b", "b")], "entity string, name string")
    assert {tuple(r) for r in seeds(asked, names).collect()} == {(1, "e:salt"), (1, "e:b"), (2, "e:bp")}


def test_retrieval_has_one_plan_and_one_rounding(spark):
    chunks, questions, rows, asks = corpus(spark)
    w = R.Weights(topics={"t": ("wab", "wb")}, danger=("wc",), authority=0.333333, registry=3.0, conflict=5.0)
    linked = spark.createDataFrame([("s1#0",), ("s2#0",)], "evidence_key string")
    direct = spark.createDataFrame([(1, "s2#0")], "question_id long, evidence_key string")
    many = spark.range(6, 2100).select(F.col("id").alias("question_id"), F.lit("zzz").alias("text"))
    few = sorted(R.hybrid_top_k(chunks, questions, linked, direct, linked, 8, w).collect())
    large = R.hybrid_top_k(chunks, questions.unionByName(many), linked, direct, linked, 8, w).filter("question_id < 6")
    assert sorted(large.collect()) == few and any(r["score"] == 1.3333 for r in few)


def test_retrieval_passes_over_zero_scores(spark):
    # registry chunks score -1 alone and exactly 0 with one shared word
    rows = [(f"{i:03d}#0", i, 0, "alpha" if i < 12 else "other", f"s{i}#0", True) for i in range(20)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, authority int, text string, evidence_key string, registry boolean")
    none = spark.createDataFrame([], "question_id long, evidence_key string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "nothing")], "question_id long, text string")
    w = R.Weights(topics={}, danger=("zz",), registry=1.0)
    got = R.hybrid_top_k(chunks, asked, none, none, none, 3, w).collect()
    assert sorted((r["question_id"], r["chunk_id"], r["score"]) for r in got) == [
        (1, "012#0", -1.0), (1, "013#0", -1.0), (1, "014#0", -1.0), (2, "000#0", -1.0), (2, "001#0", -1.0), (2, "002#0", -1.0)]


def test_retrieval_counts_dictionary_terms(spark):
    chunks = spark.createDataFrame([("a", 1, 0, "高血压", "x", False)], "chunk_id string, doc_id long, authority int, text string, evidence_key string, registry boolean")
    asked = spark.createDataFrame([(1, "高血压")], "question_id long, text string")
    none = spark.createDataFrame([], "question_id long, evidence_key string")
    w = R.Weights(topics={}, danger=("zz",))
    assert T.DICTIONARY.count("高血压") == 1 and R.hybrid_top_k(chunks, asked, none, none, none, 3, w).first()["score"] == 3.0


def test_passages_of_one_and_two_words(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta"), (2, "alphabet a"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "pha"), (2, "ha be"), (3, "xx alpha beta"), (4, "none")], "question_id long, text string")
    assert {tuple(r) for r in R.passages_in(docs, asked).collect()} == {(1, 1), (1, 2), (2, 1), (3, 1)}


def test_short_series_keep_a_row(spark):
    long = days(spark, range(1, 41))
    daily = long.unionByName(days(spark, [1, 2, 3], key="b"))
    rows = {r["status"]: r for r in V.analysed_all(daily, V.clean_series(daily, ["participant_id"]), ["participant_id"], 7).collect()}
    assert set(rows) == {"ok", "insufficient_data"} and rows["ok"]["n_days"] == 40
    short = rows["insufficient_data"]
    assert not short["available"] and short["forecast"] is None and short["selected"] is None and short["n_days"] < 7
    assert short["reason"] == f"valid days {short['n_days']}/7"


def test_registered_boosted_models_use_all_trees(study, monkeypatch):
    from tidemark.plans import learning

    class Done(Exception):
        pass

    def stop(estimator, *_):
        raise Done(estimator.getMaxIter())

    monkeypatch.setattr(L.GBTClassifier, "fit", stop)
    monkeypatch.setattr(L.GBTRegressor, "fit", stop)
    for plan, trees in ((learning.ml10, 300), (learning.ml14_models, 350), (learning.ml15, 300)):
        with pytest.raises(Done, match=str(trees)):
            plan(study)
