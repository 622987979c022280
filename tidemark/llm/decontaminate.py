"""Benchmark decontamination by greedy string tiling over shared-word seeds.

Seeds are five-word shingles that a document shares with a benchmark item. Only the stretches of a document that consist of
seeds can hold a tile, so the scan keeps those alone; a join on the seeds pairs documents with items, and tiling marks the
longest common stretches first, each word once, until none of five words is left. The share of an item's words under tiles
is its coverage in the document; the order of the tiles plays no part, so reordered passages count in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_lists, mix, ready, shingle_hashes, slices, store, text_bytes, word_hashes

LEAST = 5
#: An item counts as leaked when tiles cover this share of its words.
COVERAGE = 0.5
#: Bits of the fixed-size filter that spares non-seeds the shuffle (2 MB); it decides nothing.
FILTER_BITS = 1 << 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all runs of ``size`` unmarked words, and their positions."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    open_runs = np.concatenate(([0], np.cumsum(free)))
    at = np.flatnonzero(open_runs[size:] - open_runs[:-size] == size)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words) - 1, _BASE))))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words) - 1, _BACK))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power)))
    # a run's sum, scaled back to position 0
    return (total[at + size] - total[at]) * back[at], at


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, least: int) -> int:
    """Length of the longest common run of unmarked words (0: under ``least``); common runs of a length imply shorter ones."""
    low, high = least - 1, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if len(np.intersect1d(_windows(a, free_a, middle)[0], _windows(b, free_b, middle)[0])):
            low = middle
        else:
            high = middle - 1
    return low if low >= least else 0


def tile(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> int:
    """Words of ``a`` under the tiles that greedy string tiling lays over ``a`` and ``b`` (arrays of word hashes).

    Longest matches go first, ties by position in ``a``, then in ``b``; every match is compared word by word.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    while size := _longest(a, b, free_a, free_b, least):
        hash_a, at_a = _windows(a, free_a, size)
        hash_b, at_b = _windows(b, free_b, size)
        order = np.argsort(hash_b, kind="stable")
        laid = False
        lo = np.searchsorted(hash_b[order], hash_a, "left")
        hi = np.searchsorted(hash_b[order], hash_a, "right")
        for i in np.flatnonzero(hi > lo):
            x = at_a[i]
            if not free_a[x : x + size].all():
                continue
            for j in order[lo[i] : hi[i]]:
                y = at_b[j]
                if free_b[y : y + size].all() and np.array_equal(a[x : x + size], b[y : y + size]):
                    free_a[x : x + size] = free_b[y : y + size] = False
                    laid = True
                    break
        if not laid:
            break
    return int(len(a) - free_a.sum())


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (hashes & mask).astype(np.int64), (mix(hashes) & mask).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary_lists(batch.column("text"))
        words, counts = word_hashes(texts)
        ends = np.cumsum(counts)
        parts = [words[e - c : e] for e, c in zip(ends, counts, strict=True)]
        seeds = [np.unique(shingle_hashes(w, np.array([len(w)]))[0]).view(np.int64).tolist() if len(w) >= LEAST else [] for w in parts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array([w.tobytes() for w in parts], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
            ["item_id", "words", "seeds"])


def _filter_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        values = batch.column("seeds").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for slot in _slots(values):
            bits[slot] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            texts = binary_lists(batch.column("text"))
            for lo, hi in slices(texts):
                words, counts = word_hashes(texts[lo:hi])
                runs, n = shingle_hashes(words, counts)
                one, two = _slots(runs)
                hit = bits[one] & bits[two]
                end, last = np.cumsum(counts), np.cumsum(n)
                stretches, sizes, seeds = [], [], []
                for e, c, z, k in zip(end, counts, last, n, strict=True):
                    here = hit[z - k : z]
                    if c < LEAST or not here.any():
                        stretches.append(None), sizes.append(None), seeds.append(None)
                        continue
                    cover = np.zeros(c + 1, np.int64)
                    at = np.flatnonzero(here)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + LEAST, -1)
                    inside = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
                    own = words[e - c : e]
                    stretches.append(own[inside].tobytes())
                    sizes.append((edge[1::2] - edge[::2]).tolist())
                    seeds.append(np.unique(runs[z - k : z][here]).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], batch.column("mark")[lo:hi], pa.array(counts, pa.int64()), pa.array(stretches, pa.binary()),
                     pa.array(sizes, pa.list_(pa.int32())), pa.array(seeds, pa.list_(pa.int64()))],
                    ["doc_id", "mark", "n_words", "stretches", "sizes", "seeds"])

    return run


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wall = np.zeros(1, np.uint64)
    for batch in batches:
        covered, of = [], []
        for item, stretch, sizes in zip(*(batch.column(k).to_pylist() for k in ("words", "stretches", "sizes")), strict=True):
            a, b = np.frombuffer(item, np.uint64), np.frombuffer(stretch, np.uint64)
            # a wall no item word equals keeps tiles inside a stretch
            walls = np.array([x for k, part in enumerate(np.split(b, np.cumsum(sizes)[:-1])) for x in ((wall, part) if k else (part,))], dtype=object)
            covered.append(tile(a, np.concatenate(list(walls)).astype(np.uint64)))
            of.append(len(a))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("item_id"), pa.array(covered, pa.int64()), pa.array(of, pa.int64())], ["id", "item_id", "covered", "item_words"])


def coverages(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanned documents ``(id, doc_id, mark, n_words)`` and tiled pairs ``(id, item_id, covered, item_words)``.

    A pair is listed for every document and item that share a seed. Items under five words have no seed; equal items are
    tiled once and then named by their smallest item_id. An item without an item_id is an item like any other. Null texts are
    empty; words are lower-cased A-Z only.
    """
    spark = ready(docs.sparkSession)
    items = benchmark.select("item_id", text_bytes("text").alias("text")).mapInArrow(_items, "item_id long, words binary, seeds array<long>")
    items = store(items, "benchmark-words")
    distinct = items.groupBy("words").agg(F.min(F.struct(F.col("item_id").isNull(), "item_id"))["item_id"].alias("item_id"), F.first("seeds").alias("seeds"))
    distinct = store(distinct.where("size(seeds) > 0").withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in distinct.select("seeds").coalesce(8).mapInArrow(_filter_part, "bits binary").toLocalIterator():
        bits |= np.frombuffer(part["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())  # always FILTER_BITS / 8 bytes
    rows = docs.select("doc_id", F.xxhash64(text_bytes("text")).alias("mark"), text_bytes("text").alias("text"))
    rows = rows.mapInArrow(_scan(shared), "doc_id long, mark long, n_words long, stretches binary, sizes array<int>, seeds array<long>")
    rows = store(rows.withColumn("id", F.monotonically_increasing_id()), "scanned")
    seeds = distinct.select("item", F.explode("seeds").alias("seed"))
    met = rows.where("seeds is not null").select("id", F.explode("seeds").alias("seed")).join(seeds, "seed").select("id", "item").distinct()
    pairs = met.join(rows.select("id", "stretches", "sizes"), "id").join(distinct.select("item", "item_id", "words"), "item")
    pairs = pairs.select("id", "item_id", "words", "stretches", "sizes").mapInArrow(_tiled, "id long, item_id long, covered long, item_words long")
    return rows.select("id", "doc_id", "mark", "n_words"), store(pairs, "tiled")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """One row per document row: ``doc_id, mark, n_words, item_id, coverage, contaminated``.

    ``item_id`` is the item covered best (ties: the smallest id; copies of an item go by their smallest id; a null id comes
    last), null without a tile; ``coverage`` is then 0. Empty tables, null and short texts are clean.
    """
    rows, pairs = coverages(docs, benchmark)
    best = pairs.where("covered > 0").withColumn("coverage", F.col("covered") / F.col("item_words"))
    best = best.groupBy("id").agg(F.max("coverage").alias("coverage"), F.min_by("item_id", F.struct(-F.col("coverage"), F.col("item_id").isNull(), F.col("item_id"))).alias("item_id"))
    out = rows.join(best, "id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return out.select("doc_id", "mark", "n_words", "item_id", "coverage", (F.col("coverage") >= least).alias("contaminated"))
