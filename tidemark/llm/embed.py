"""Embedding near-dedup with a forest of random-projection trees.

Nodes of all trees are split side by side: a node above ``LEAF`` vectors is fitted on a bounded sample of its own vectors
(random directions, thresholds at their medians) and all its vectors descend, those near a threshold to both sides. A node
whose sample is mostly within linking distance is a cluster, splitting would only part its links, so it stays whole. Leaves
are compared in blocks, in double precision. A pair that meets in several leaves counts in the one with the smallest number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready, store, whole_groups
from tidemark.llm.components import connected

TREES = 10
#: Vectors of a leaf that one task compares; larger leaves are cut into blocks of this size and blocks meet in pairs.
LEAF = 1024
#: Vectors a node's splits are fitted on, at most about this many (chosen by hash).
SAMPLE = 4096
FAN_OUT = 64
#: Share of a node's vectors on either side of a threshold that goes to both children.
SPILL = 0.08
LEAST = 0.95


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, units = [], []
        for vector in batch.column("embedding").to_pylist():
            key = unit = None
            if vector and None not in vector:
                x = np.array(vector, np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    scaled = x / top  # a huge or tiny vector neither overflows nor vanishes when squared
                    unit = (scaled / np.sqrt(scaled @ scaled)).tobytes()
                    key = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            keys.append(key)
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "vec_key", "unit"])


def _node(tree: int, path: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(path, digest_size=8, key=bytes([tree % 256])).digest(), "little", signed=True)


def _fit(seed: int):
    """Splits of one node: rows (direction, low, high) of a binary tree in heap order; none for a cluster."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(u, np.float64) for u in group.sort_values("id")["unit"]])
        node, size = int(group["node"].iloc[0]), int(group["n"].iloc[0])
        rng = np.random.default_rng([seed, node % (1 << 63)])
        some = x[rng.permutation(len(x))[:256]]
        close = (some @ some.T >= LEAST).mean() if len(some) > 1 else 1.0
        splits: dict[int, np.ndarray] = {}
        parts = {1: np.arange(len(x))}
        share = size / max(len(x), 1)
        while close < 0.25 and parts:
            place, rows = parts.popitem()
            if place >= FAN_OUT or len(rows) * share <= LEAF / 2 or len(rows) < 8:
                continue
            direction = rng.normal(size=x.shape[1])
            direction /= np.sqrt(direction @ direction)
            y = x[rows] @ direction
            low, high = np.quantile(y, [0.5 - SPILL / 2, 0.5 + SPILL / 2])
            splits[place] = np.concatenate((direction, [low, high]))
            parts[2 * place], parts[2 * place + 1] = rows[y <= high], rows[y >= low]
        places = sorted(splits)
        model = np.stack([splits[p] for p in places]).tobytes() if places else b""
        return pd.DataFrame({"node": [node], "places": [places], "model": [model]})

    return run


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    models: dict[int, tuple[dict[int, int], np.ndarray]] = {}
    for batch in batches:
        out = {k: [] for k in ("id", "unit", "tree", "node", "done")}
        rows = zip(*(batch.column(k).to_pylist() for k in ("id", "unit", "tree", "node", "places", "model")), strict=True)
        for id_, unit, tree, node, places, model in rows:
            if not places:
                found, done = [node], True
            else:
                if node not in models:
                    if len(models) > 64:
                        models.clear()
                    models[node] = ({p: i for i, p in enumerate(places)}, np.frombuffer(model, np.float64).reshape(len(places), -1))
                known, splits = models[node]
                x, open_, ends = np.frombuffer(unit, np.float64), [1], []
                while open_:
                    place = open_.pop()
                    i = known.get(place)
                    if i is None:
                        ends.append(place)
                        continue
                    y = splits[i, :-2] @ x
                    if y <= splits[i, -1]:
                        open_.append(2 * place)
                    if y >= splits[i, -2]:
                        open_.append(2 * place + 1)
                found, done = [_node(tree, f"{node}/{p}".encode()) for p in sorted(ends)], False
            for child in found:
                for k, v in zip(out, (id_, unit, tree, child, done), strict=True):
                    out[k].append(v)
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def leaves(vectors: DataFrame, seed: int = 3) -> DataFrame:
    """``id, leaf`` for every vector and tree (several rows where it spills); ``vectors``: ``id, unit``, one dimension."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = vectors.select("id", "unit", trees).withColumn("tree", F.col("tree").cast("int"))
    rows = rows.withColumn("node", F.hash(F.length("unit"), "tree").cast("long")).withColumn("done", F.lit(False))
    ready_leaves = None
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"))
        rows = store(rows.join(sizes, "node"), "forest")
        small = rows.where(f"n <= {LEAF} or done").select("id", F.col("node").alias("leaf"))
        ready_leaves = small if ready_leaves is None else ready_leaves.union(small)
        large = rows.where(f"n > {LEAF} and not done")
        if large.isEmpty():
            return ready_leaves
        # a bounded share of each node, by hash
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "node"), 1) / F.lit(2.0**63)
        sample = large.where(draw * F.col("n") < SAMPLE).select("node", "n", "id", "unit")
        models = sample.groupBy("node").applyInPandas(_fit(seed), "node long, places array<int>, model binary")
        models = store(models, "splits")
        moved = large.select("id", "unit", "tree", "node").join(models, "node", "left").select("id", "unit", "tree", "node", "places", "model")
        rows = moved.mapInArrow(_descend, "id long, unit binary, tree int, node long, done boolean")


def _compare(least: float):
    def block(ids, copies, sides, units, places, leaf, pair) -> list[tuple[int, int, int]]:
        first = np.unique(ids, return_index=True)[1]
        ids, copies, sides, units, places = ids[first], copies[first], sides[first], units[first], places[first]
        i, j = pair
        a = np.flatnonzero(sides == i)
        b = np.flatnonzero(sides == j)
        near = units[a] @ units[b].T >= least
        if i == j:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        if not len(x):
            return []
        x, y = a[x], b[y]
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(x), 20_000):
            u, v = x[at : at + 20_000], y[at : at + 20_000]
            left, right = places[u], places[v]
            before = np.zeros(len(u), bool)
            for k in range(left.shape[1]):
                own = left[:, k]
                before |= (own < leaf) & (own[:, None] == right).any(axis=1)
            np.add.at(links, u[~before], copies[v[~before]])
            np.add.at(links, v[~before], copies[u[~before]])
        root = np.arange(len(ids))
        while True:  # labels run along the links until all of a part agree on its smallest row
            now = root.copy()
            np.minimum.at(now, x, root[y])
            np.minimum.at(now, y, root[x])
            now = now[now]
            if (now == root).all():
                break
            root = now
        touched = np.union1d(x, y)
        return [(int(ids[k]), int(links[k]), int(ids[root[k]])) for k in touched]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["leaf", "i", "j"]):
            columns = {k: table[k].to_numpy() for k in ("leaf", "i", "j", "side", "id", "copies")}
            units, places = table["unit"].to_pylist(), table["leaves"].to_pylist()
            change = np.zeros(len(units), bool)
            for k in ("leaf", "i", "j"):
                change[1:] |= columns[k][1:] != columns[k][:-1]
            edge = np.flatnonzero(change)
            for lo, hi in zip([0, *edge], [*edge, len(units)], strict=True):
                if hi - lo < 2:
                    continue
                wide = max(len(p) for p in places[lo:hi])
                padded = np.full((hi - lo, wide), np.iinfo(np.int64).max)
                for r, p in enumerate(places[lo:hi]):
                    padded[r, : len(p)] = p
                part = np.stack([np.frombuffer(u, np.float64) for u in units[lo:hi]])
                found = block(columns["id"][lo:hi], columns["copies"][lo:hi], columns["side"][lo:hi], part, padded, columns["leaf"][lo], (columns["i"][lo], columns["j"][lo]))
                if found:
                    a, n, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], ["id", "n", "root"])

    return run


def near_vectors(embeddings: DataFrame, least: float = LEAST, seed: int = 3) -> DataFrame:
    """One row per row of ``embeddings``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of different
    length. Equal vectors are one node with a weight, so copies link with each other and cost one row. A null vec_id never
    names a component that has another id. Rows that repeat a vec_id are vectors of their own.
    """
    ready(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding").mapInArrow(_clean, "vec_id long, vec_key binary, unit binary")
    rows = store(rows, "units")
    nodes = rows.where("vec_key is not null").groupBy("vec_key").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    nodes = store(nodes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    placed = store(leaves(nodes.select("id", "unit"), seed).distinct(), "leaves")
    lists = placed.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # a few entries a tree
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    met = placed.join(sizes, "leaf").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("id", "leaf", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    full = nodes.select("id", "unit", "copies").join(lists, "id")
    dealt = met.join(full, "id").repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    found = dealt.select("leaf", "i", "j", "side", "id", "copies", "unit", "leaves").mapInArrow(_compare(least), "id long, n long, root long")
    found = store(found, "vector-links")
    links = found.groupBy("id").agg(F.sum("n").alias("others"))
    groups = connected(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = nodes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    named = store(named.select("vec_key", "vec_id", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "id").alias("root")), "named-vectors")
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = store(named.join(smallest, "root").select("vec_key", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-groups")
    out = rows.select("vec_id", "vec_key").join(named, "vec_key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
