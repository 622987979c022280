"""Trailing features against a loop over windows."""

import datetime as dt
import math

import numpy as np

from tidemark.operators.trailing import WINDOWS, trailing_features

CUT = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
FORM = "participant_id long, measurement_id long, value double, ts timestamp"
NAMES = ("last", "days_since_last", "count", "mean", "median", "std", "min", "max", "slope", "missing_rate")


def plain(rows, window):
    known = [(t, i, v) for _, i, v, t in rows if t is not None and v is not None and v == v and t <= CUT]
    last = max(known)
    held = [(t, v) for t, _, v in known if t > CUT - dt.timedelta(days=window)]
    head = (last[2], (CUT - last[0]).total_seconds() / 86400, len(held))
    if not held:
        return head + (None,) * 7
    x, v = np.array([(t - CUT).total_seconds() / 86400 for t, _ in held]), np.array([v for _, v in held])
    slope = float(((x - x.mean()) * (v - v.mean())).sum() / ((x - x.mean()) ** 2).sum()) if len(set(x)) > 1 else 0.0
    return head + (v.mean(), np.median(v), v.std(), v.min(), v.max(), slope, max(0.0, 1 - len({t.date() for t, _ in held}) / window))


def table(spark, rows):
    got = trailing_features(spark.createDataFrame(rows, FORM), ["participant_id"], "2024-03-01 00:00:00").collect()
    assert len({(r["participant_id"], r["window_days"]) for r in got}) == len(got)
    return {(r["participant_id"], r["window_days"]): tuple(r[c] for c in NAMES) for r in got}


def test_windows_equal_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        who = [1, 2, 3, None][i % 4]
        at = CUT - dt.timedelta(hours=float(rng.integers(-50, 2600)) if who != 2 else 3000.0)
        rows.append((who, i, [round(float(rng.normal(100, 20)), 1), 7.0, None, math.nan][rng.choice(4, p=[0.7, 0.2, 0.05, 0.05])], at))
    rows += [(4, 1000, 5.0, CUT), (4, 1001, 6.0, CUT), (5, 1002, 1.0, CUT + dt.timedelta(seconds=1)), (6, 1003, 9.0, None)]
    rows += [(7, 2000 + i, 3.5, CUT - dt.timedelta(days=w)) for i, w in enumerate(WINDOWS)]  # a reading exactly w days old is outside
    got = table(spark, rows)
    people = (1, 2, 3, 4, 7, None)
    assert set(got) == {(p, w) for p in people for w in WINDOWS}
    for p in people:
        own = [r for r in rows if r[0] == p]
        for w in WINDOWS:
            for name, a, b in zip(NAMES, got[p, w], plain(own, w)):
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (p, w, name, a, b)


def test_no_reading_gives_no_row(spark):
    assert table(spark, []) == {}
