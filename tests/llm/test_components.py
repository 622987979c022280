"""Components of edge tables, in few rounds, and exact intersections of many sets."""

import numpy as np
import pytest

from tidemark.llm import components, near


def plain(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if a != b:
                root.setdefault(x, x)
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((x, find(x)) for x in root)


rng = np.random.default_rng(11)
SHAPES = {
    "random": rng.integers(0, 400, (380, 2)).tolist(),
    "path": [(i, i + 1) for i in range(60)],
    "shuffled path": (lambda p: list(zip(p[:-1], p[1:], strict=True)))(rng.permutation(90).tolist()),
    "large centres": [(1000 + i % 2, i) for i in range(80)] + [(1000, 1001), (1001, 1000), (5, 5)],
    "loops alone": [(3, 3), (4, 4)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_equal_union_find(spark, shape):
    pairs = SHAPES[shape]
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in [*pairs, *pairs[:9]]], "a long, b long")
    assert sorted(map(tuple, components.connected(edges).collect())) == plain(pairs)


def test_stars_take_no_round_and_the_last_round_is_no_idle_one(spark, monkeypatch):
    """Links of small clusters are stars when they come; a round that changes nothing was run on them, and after all others."""
    stored = []
    monkeypatch.setattr(components, "store", lambda df, name: stored.append(name) or df.localCheckpoint())
    stars = spark.createDataFrame([(10 * k + i, 10 * k) for k in range(9) for i in range(1, 6)], "a long, b long")
    assert components.connected(stars).count() == 54 and not stored
    two = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "a long, b long")
    assert sorted(map(tuple, components.connected(two).collect())) == [(i, 1) for i in (1, 2, 3, 4)]
    assert len(stored) <= 3  # the edges, a round, a jump


def test_links_of_a_piece_are_stars_around_the_smallest_component():
    import pyarrow as pa

    ids, comps = [9, 4, 7, 30, 2], [9, 4, 7, 30, 2]
    rows = pa.table({"cluster": [2] * 5, "piece": [0] * 5, "id": ids, "comp": comps, "guest": [False] * 5, "content": [b"a", b"a", b"a", b"b", b"b"]})

    def sets(contents):
        return [np.arange(5, dtype=np.uint64) + np.uint64(100 * c[0]) for c in contents]

    found = {(r["a"], r["b"]) for out in near._links(sets, (4, 5))(iter(rows.to_batches())) for r in out.to_pylist()}
    assert found == {(9, 4), (7, 4), (30, 2)}
    again = rows.set_column(3, "comp", [[4, 4, 1, 30, 2]]).set_column(4, "guest", [[False, False, False, True, False]])
    found = [(r["a"], r["b"]) for out in near._links(sets, (4, 5))(iter(again.to_batches())) for r in out.to_pylist()]
    assert sorted(found) == [(4, 1), (30, 2)]  # components that meet, once each


@pytest.mark.parametrize("dense", [0, 1, 64, 1 << 40])
def test_intersections_counted_by_products_and_by_pairs_agree(monkeypatch, dense):
    monkeypatch.setattr(near, "DENSE", dense)
    monkeypatch.setattr(near, "COLUMNS", 7)
    monkeypatch.setattr(near, "PAIRS", 50)
    monkeypatch.setattr(near, "PIECE", 16)
    draw = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([draw.integers(0, 6, 5), draw.integers(0, 300, draw.integers(1, 40))])).astype(np.uint64) for _ in range(50)]
    sets += [np.array([1 << 63], np.uint64), np.array([9999], np.uint64)]
    wanted = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets[:20]]
    assert near.shared(sets[:20], sets).tolist() == wanted
    assert near.shared(sets[-1:], sets[:1]).tolist() == [[0]]
