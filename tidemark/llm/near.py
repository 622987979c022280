"""Linking of near copies: banded buckets, sketch comparison, exact comparison inside candidate clusters, components.

Sketches decide which members of a bucket can reach the threshold at all; what hangs together that way is a cluster, in which
every link must lie. Each cluster then meets once with the full sets of its members, cut into pieces. A piece compares its
members exactly and gives a spanning star of what it found linked, never its pairs. Pieces of a large cluster share one
member, so a tight group becomes one component at once; members that are still outside that component visit all other
pieces in a second pass, which compares every pair that the first has left open. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, mix, slices, store, whole_groups
from tidemark.llm.components import connected

#: Members that one task compares with one another.
PIECE = 256
#: Buckets of at most so many members are compared together, offset by offset, where a pairwise form is given; clusters always.
TOGETHER = 16
#: A member of sets is counted by a matrix product if one in so many pairs share it, for so many members at once; the others by so many pairs.
DENSE, COLUMNS, PAIRS = 64, 1 << 12, 1 << 20
#: Rows of small sketches that a task reads at once.
ROWS_AT_ONCE = 1 << 13

Similarity = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spread(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over the links ``x - y``."""
    root = np.arange(n)
    while True:
        now = root.copy()
        np.minimum.at(now, x, root[y])
        np.minimum.at(now, y, root[x])
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _edges(ids: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return list(zip(ids[moved].tolist(), ids[root[moved]].tolist(), strict=True))


def _joined(comps: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Stars of the components of the rows that are linked, each around its smallest."""
    names, place = np.unique(comps, return_inverse=True)
    return _edges(names, spread(len(names), place[x], place[y]))


def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _parts(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        values = table[k].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    edge = np.flatnonzero(change)
    yield from zip([0, *edge], [*edge, table.num_rows], strict=True)


def _neighbours(buckets: np.ndarray, ids: np.ndarray, sketches: np.ndarray, pairwise: Similarity, floor: float) -> list[tuple[int, int]]:
    """Stars of small buckets, all at once: each row meets the row 1, 2, … places after it in its bucket."""
    order = np.lexsort((ids, buckets))
    buckets, ids, sketches = buckets[order], ids[order], sketches[order]
    ones, twos, step = [], [], 0
    rows = np.arange(len(ids))
    while True:
        step += 1
        rows = rows[: np.searchsorted(rows, len(ids) - step)]
        rows = rows[buckets[rows] == buckets[rows + step]]
        if not len(rows):
            break
        near = rows[pairwise(sketches[rows], sketches[rows + step]) >= floor]
        ones.append(near)
        twos.append(near + step)
    if not ones:
        return []
    return _edges(ids, spread(len(ids), np.concatenate(ones), np.concatenate(twos)))


def _candidates(similar: Similarity, floor: float, pairwise: Similarity | None):
    """Arrow pass over buckets: stars of members whose sketches may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            ids = table["id"].to_numpy()
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
            found, parts = [], list(_parts(table, ["bucket"]))
            if pairwise is not None:
                few = np.repeat([hi - lo <= TOGETHER for lo, hi in parts], [hi - lo for lo, hi in parts])
                found += _neighbours(table["bucket"].to_numpy()[few], ids[few], sketches[few], pairwise, floor)
                parts = [(lo, hi) for lo, hi in parts if hi - lo > TOGETHER]
            for lo, hi in parts:
                order = lo + np.argsort(ids[lo:hi])
                x, y = np.nonzero(np.triu(similar(sketches[order], sketches[order]) >= floor, 1))
                found += _edges(ids[order], spread(hi - lo, x, y))
            if found:
                yield _batch(found)

    return run


def shared(own: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets of distinct numbers, one row per own set.

    Members that many sets hold are counted by a product of 0/1 matrices, the others pair by pair.
    """
    number = np.repeat(np.arange(len(own)), [len(s) for s in own])
    values = np.concatenate(own)
    order = np.argsort(values, kind="stable")
    values, number = values[order], number[order]
    out = np.empty((len(own), len(others)), np.int64)
    for j in range(0, len(others), PIECE):
        some = others[j : j + PIECE]
        out[:, j : j + len(some)] = _shared(values, number, len(own), some)
    return out


def _shared(values: np.ndarray, number: np.ndarray, n: int, others: list[np.ndarray]) -> np.ndarray:
    m = len(others)
    other, theirs = np.repeat(np.arange(m), [len(s) for s in others]), np.concatenate(others)
    order = np.argsort(theirs, kind="stable")
    other, theirs = other[order], theirs[order]
    lo, hi = np.searchsorted(values, theirs, "left"), np.searchsorted(values, theirs, "right")
    other, lo, hi = other[hi > lo], lo[hi > lo], hi[hi > lo]
    out = np.zeros(n * m, np.int64)
    if not len(other):
        return out.reshape(n, m)
    # rows of one member stand together: the sets of both sides that hold it are a block of pairs
    first = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]]))
    holders, held = hi[first] - lo[first], np.diff(np.concatenate([first, [len(other)]]))
    many = holders * held * DENSE >= n * m
    for k in range(0, int(many.sum()), COLUMNS):
        some = np.flatnonzero(many)[k : k + COLUMNS]
        a, b = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        a[number[_runs(lo[first[some]], holders[some])], np.repeat(np.arange(len(some)), holders[some])] = 1
        b[other[_runs(first[some], held[some])], np.repeat(np.arange(len(some)), held[some])] = 1
        out += (a @ b.T).astype(np.int64).ravel()  # sums of at most COLUMNS ones are exact
    few = np.repeat(~many, held)
    other, lo, size = other[few], lo[few], (hi - lo)[few]
    block = np.cumsum(size) // PAIRS
    for part in np.split(np.arange(len(other)), np.flatnonzero(np.diff(block)) + 1):
        out += np.bincount(number[_runs(lo[part], size[part])] * m + np.repeat(other[part], size[part]), minlength=n * m)
    return out.reshape(n, m)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, …`` of all runs behind one another."""
    return np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _linked_pairs(sets: list[np.ndarray], group: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked sets within groups of at most ``TOGETHER`` neighbours: equal members of a group meet, and are counted by pair."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    # one sort by 64-bit hashes of member and group; members whose hashes are equal by chance still count as different
    order = np.argsort(values + mix(group.astype(np.uint64))[owner])
    values, owner = values[order], owner[order]
    same = (values[1:] == values[:-1]) & (group[owner[1:]] == group[owner[:-1]])
    run = np.concatenate([[0], np.cumsum(~same)]) if len(values) else owner
    both = np.zeros(len(sets) * TOGETHER, np.int64)
    rows, step = np.arange(len(values)), 0
    while True:
        step += 1
        rows = rows[: np.searchsorted(rows, len(values) - step)]
        rows = rows[run[rows] == run[rows + step]]
        if not len(rows):
            break
        one, two = owner[rows], owner[rows + step]
        both += np.bincount(np.minimum(one, two) * TOGETHER + np.abs(one - two), minlength=len(both))
    pairs = np.flatnonzero(both)
    x, y = pairs // TOGETHER, pairs // TOGETHER + pairs % TOGETHER
    near = least[1] * both[pairs] >= least[0] * (size[x] + size[y] - both[pairs])
    return x[near], y[near]


def _links(as_sets: Callable[[list[bytes]], list[np.ndarray]], least: tuple[int, int]):
    """Arrow pass over pieces: stars of the components of members that are linked exactly; guests are compared with the piece's own members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cluster", "piece"]):
            every, comps, guest = table["id"].to_numpy(), table["comp"].to_numpy(), table["guest"].to_numpy()
            contents, found = table["content"], []
            parts = list(_parts(table, ["cluster", "piece"]))
            few = [(lo, hi) for lo, hi in parts if 1 < hi - lo <= TOGETHER and not guest[lo:hi].any()]
            for lo, hi in slices([contents[a:b] for a, b in few], of=lambda c: c.nbytes):
                rows = np.concatenate([np.arange(a, b) for a, b in few[lo:hi]])
                group = np.repeat(np.arange(hi - lo), [b - a for a, b in few[lo:hi]])
                x, y = _linked_pairs(as_sets(contents.take(rows).to_pylist()), group, least)
                found += _joined(comps[rows], x, y)
            for lo, hi in set(parts).difference(few):
                order = lo + np.lexsort((guest[lo:hi], every[lo:hi]))
                order = order[np.unique(every[order], return_index=True)[1]]  # a guest in its own piece stands there once
                if len(order) < 2:
                    continue
                comp = comps[order]
                sets = as_sets(contents.take(order).to_pylist())
                size = np.array([len(s) for s in sets])
                own = np.flatnonzero(~guest[order])
                both = shared([sets[i] for i in own], sets)
                near = (least[1] * both >= least[0] * (size[own, None] + size[None, :] - both)) & (comp[own, None] != comp[None, :])
                x, y = np.nonzero(near)
                found += _joined(comp, own[x], y)
            if found:
                yield _batch(found)

    return run


def near_components(
    members: DataFrame,
    details: Callable[[DataFrame], DataFrame] | DataFrame,
    similar: Similarity,
    floor: float,
    as_sets: Callable[[list[bytes]], list[np.ndarray]],
    least: tuple[int, int],
    name: str,
    pairwise: Similarity | None = None,
) -> DataFrame:
    """Components ``(id, comp)`` of the items that are linked to another item; ``comp`` is the smallest id.

    ``members``: ``(bucket, id)``, at most one row of an id in a bucket; or with ``n``, the members of the bucket (any number over ``PIECE``
    for more), without buckets of one. ``details(ids)`` gives ``(id, sketch, content)`` for a table of ids; only items that share a
    bucket are asked for. If these are at hand for all items, ``details`` is that table. ``similar`` estimates similarity between rows of two sketch
    matrices (``pairwise``, if given, between equal rows of two); pairs under ``floor`` are no candidates. ``as_sets`` makes a sorted set of each content; two sets are linked if
    their intersection over their union is at least ``least[0] / least[1]``.
    """
    if "n" not in members.columns:
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        members = members.join(sizes, "bucket")
    crowded = store(members, f"{name}-buckets")
    detail = details if isinstance(details, DataFrame) else store(details(crowded.select("id").distinct()), f"{name}-details")
    small = crowded.where(f"n <= {PIECE}").join(detail.select("id", "sketch"), "id").select("bucket", "id", "sketch")
    stars = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(similar, floor, pairwise), "a long, b long")
    large = crowded.where(f"n > {PIECE}")  # taken whole: what is alike enough is decided on the sets
    hubs = large.groupBy("bucket").agg(F.min("id").alias("b"))
    stars = stars.union(large.join(hubs, "bucket").select(F.col("id").alias("a"), "b"))
    with arrow_rows(stars.sparkSession, ROWS_AT_ONCE):
        stars = store(stars, f"{name}-stars")
    clusters = connected(stars).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    clusters = store(clusters.join(counts, "cluster"), f"{name}-clusters")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece")
    everywhere = F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")

    def linked(rows: DataFrame, guests: DataFrame) -> DataFrame:
        rows = rows.select("cluster", own, "id", "comp", F.lit(False).alias("guest"))
        rows = rows.union(guests.select("cluster", everywhere, "id", "comp", F.lit(True).alias("guest")))
        rows = rows.join(detail.select("id", "content"), "id").select("cluster", "piece", "id", "comp", "guest", "content")
        rows = rows.repartition("cluster", "piece").sortWithinPartitions("cluster", "piece")
        return store(rows.mapInArrow(_links(as_sets, least), "a long, b long"), f"{name}-links")

    alone = clusters.withColumn("comp", F.col("id"))
    found = linked(alone, alone.where(f"id = cluster and n > {PIECE}"))
    labels = connected(found)
    cut = clusters.where(f"n > {PIECE}")
    if not cut.isEmpty():
        now = cut.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id"))
        home = now.where("id = cluster").select("cluster", F.col("comp").alias("home"))
        now = store(now.join(home, "cluster"), f"{name}-open")
        outside = now.where("comp != home")
        again = now.join(outside.select("cluster").distinct(), "cluster", "left_semi")
        met = connected(linked(again, outside)).select(F.col("node").alias("comp"), F.col("root").alias("top"))
        alone = now.where("root is null").select("id", "comp").join(met, "comp").select(F.col("id").alias("node"), F.col("top").alias("root"))
        labels = labels.withColumnRenamed("root", "comp").join(met, "comp", "left").select("node", F.coalesce("top", "comp").alias("root")).union(alone)
    return labels.select(F.col("node").alias("id"), F.col("root").alias("comp"))
