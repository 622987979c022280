"""MinHash near-dedup whose banded candidates are compared by odd sketches and confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles. Minima of the set under 126 hash functions give 21 band keys of six
minima. Documents that share a key get an odd sketch: 1,024 minima, each toggling one bit of a bitmap. Minima that two
documents share cancel in the XOR of their sketches, so its population count tells how many differ, most precisely near
similarity 1: pairs that cannot reach the threshold are put aside without their sets, all others are confirmed on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_lists, mix, ready, shingle_hashes, slices, store, text_bytes, word_hashes
from tidemark.llm.near import near_components

#: 21 bands of 6 minima: a pair of similarity 0.85 shares no band with probability 5e-5, one of 0.3 shares one in 66 cases.
BANDS, ROWS = 21, 6
MINIMA = BANDS * ROWS
FOLDED, SKETCH_BITS = 1024, 4096
#: Over four standard errors of the similarity that the folded minima estimate at 0.85 (0.011 each).
SLACK = 0.05

_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, FOLDED, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, FOLDED, dtype=np.uint64).astype(np.uint32)
_FOLD = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    shingles, n = shingle_hashes(words, counts)
    at = np.cumsum(n) - n
    return [np.unique(shingles[i : i + k]) for i, k in zip(at, n, strict=True)]


def minima(sets: list[np.ndarray], count: int = MINIMA) -> np.ndarray:
    """The first ``count`` minima of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    bands = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = (bands * _FOLD).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(_A[0])).view(np.int64)


def odd_sketches(signature: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps: the bit of every (number, minimum) is toggled."""
    numbers = np.arange(signature.shape[1], dtype=np.uint64) << np.uint64(32)
    place = (mix(signature.astype(np.uint64) + numbers) % np.uint64(bits)).astype(np.int64)
    place += np.arange(len(signature))[:, None] * bits
    parity = np.bincount(place.ravel(), minlength=len(signature) * bits).reshape(len(signature), bits) & 1
    return np.packbits(parity.astype(np.uint8), axis=1)


_LIKENESS = np.full(SKETCH_BITS + 1, -1.0)
_odd = np.arange(SKETCH_BITS // 2)
_LIKENESS[: SKETCH_BITS // 2] = 1 - np.log1p(-2 * _odd / SKETCH_BITS) / (2 * np.log1p(-2 / SKETCH_BITS)) / FOLDED


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities estimated from the population count of the XOR of odd sketches, for all rows of two matrices."""
    a, b = np.ascontiguousarray(left).view(np.uint64), np.ascontiguousarray(right).view(np.uint64)
    differ = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        differ += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return _LIKENESS[differ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary_lists(batch.column("text"))
        for lo, hi in slices(texts):
            sets = shingle_sets(texts[lo:hi])
            keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                for i, b in zip(full, band_keys(minima([sets[i] for i in full])).tolist(), strict=True):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("mark")[lo:hi], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n_shingles", "set_key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary_lists(batch.column("text"))
        for lo, hi in slices(texts):
            sets = shingle_sets(texts[lo:hi])
            sketches = [s.tobytes() for s in odd_sketches(minima(sets, FOLDED))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[lo:hi], pa.array(sketches, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sketch", "content"])


def as_sets(contents: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(content, np.uint64) for content in contents]


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``components`` without the internal number, and ``kept``: whether ``component_id`` is the row's own doc_id.

    A null doc_id alone is kept, and so is every row that repeats its component's id; ``one_of_each`` keeps a single row.
    """
    named = components(docs, percent).drop("component")
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, mark`` of one row per component, the smallest doc_id (null last) and then mark; rows without shingles all stay."""
    rows = components(docs, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    first = rows.where("component is not null").groupBy("component").agg(least.alias("_at")).select("_at.doc_id", "_at.mark")
    return first.unionByName(rows.where("component is null").select("doc_id", "mark").distinct())


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document row: ``doc_id, mark, n_shingles, component, component_id`` (``mark``: hash of the text).

    Documents whose sets agree to ``percent`` are linked; ``component_id`` is the smallest doc_id reachable by links, itself
    included, ``component`` numbers the components in this run. Equal sets are one node from the start, so copies cost one row each.
    Null and blank texts have an empty set, no link and no component; texts under five words are one shingle. A null doc_id never names a
    component that has another id; alone, it has a null component_id. Rows that repeat a doc_id are nodes of their
    own and share their component's id. Other columns are not touched. Empty tables give no row.
    """
    spark = ready(docs.sparkSession)
    text = text_bytes("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = store(rows.mapInArrow(_features, "doc_id long, mark long, n_shingles long, set_key binary, bands array<long>"), "shingled")
    first = rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("at"))
    first = first.select("set_key", "at.*", F.monotonically_increasing_id().alias("id"))
    first = store(first, "distinct-sets")
    sketched = rows.where("n_shingles > 0").select("set_key", "doc_id", "mark", "bands").alias("r")
    own = first.alias("f")
    sketched = sketched.join(
        own, F.expr("r.set_key = f.set_key and r.doc_id <=> f.doc_id and r.mark = f.mark")).select("f.id", "r.bands")
    sketched = store(sketched.dropDuplicates(["id"]), "signatures")
    members = sketched.select(F.explode("bands").alias("bucket"), "id")

    def details(ids: DataFrame) -> DataFrame:
        wanted = first.join(ids, "id", "left_semi").select("id", F.col("doc_id").alias("at_doc"), F.col("mark").alias("at_mark"))
        found = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
        found = found.join(wanted, F.expr("doc_id <=> at_doc and mark = at_mark")).select("id", "text")
        return found.mapInArrow(_sets, "id long, sketch binary, content binary").dropDuplicates(["id"])

    linked = near_components(members, details, likeness, percent / 100 - SLACK, as_sets, (percent, 100), "minhash")
    named = first.join(linked, "id", "left").select("set_key", "doc_id", F.coalesce("comp", "id").alias("comp"))
    named = store(named, "named-sets")
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = store(named.join(smallest, "comp").select("set_key", F.col("comp").alias("component"), "component_id"), "components")
    out = rows.select("doc_id", "mark", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select(
        "doc_id", "mark", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"),
    )
