"""Quality classifier: hashed n-grams of words and word shapes, logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLOCK, binary_lists, mix, ready, slices, text_bytes

#: Size of the weight vector.
BITS = 18
#: At most so many labelled rows train the model (documented bound; the lowest hashes of doc_id are taken).
TRAIN_ROWS = 8192
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.2, 0.5
#: A document's features are its n-gram counts over their number, times this.
SCALE = 24.0
KEEP = 0.7

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_POWER = np.multiply.accumulate(np.full(2 * BLOCK, 0x9E3779B97F4A7C15, np.uint64))
_BACK = np.multiply.accumulate(np.full(2 * BLOCK, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
_ORDER = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and shape of each run of letters, digits or marks in a block of text."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], change))
    ends = np.concatenate((change, [len(raw)]))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWER[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _BACK[starts])
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    capitals = upper[ends] - upper[starts]
    length = ends - starts
    # marks, digits, lower case, one capital, mostly capitals; short and long apart
    shape = np.where(kind[starts] == 3, 0, np.where(kind[starts] == 2, 1, np.where(capitals == 0, 2, np.where(2 * capitals < length, 3, 4))))
    return starts, hashes, (shape * 4 + np.minimum(length // 6, 3)).astype(np.uint64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all texts behind one another, and their count by text; blank texts have none.

    Features: words, pairs of words and triples of word shapes. Texts longer than a block are cut, at any byte.
    """
    numbers, counts = [], np.zeros(len(texts), np.int64)
    pieces = [(i, text[at : at + BLOCK]) for i, text in enumerate(texts) for at in range(0, max(len(text), 1), BLOCK)]
    sizes = [p for _, p in pieces]
    for lo, hi in slices(sizes):
        data = b"\n".join(sizes[lo:hi]) + b"\n"
        begin = np.cumsum([0] + [len(p) + 1 for p in sizes[lo:hi]])
        starts, hashes, shape = _tokens(data)
        doc = np.searchsorted(begin, starts, side="right") - 1
        pair = mix(hashes[:-1] * _ORDER[0] + hashes[1:] * _ORDER[1])
        triple = mix((shape[:-2] << np.uint64(10)) + (shape[1:-1] << np.uint64(5)) + shape[2:] + _ORDER[2])
        # one slot for each kind at each word; slots that would cross texts stay empty
        table = np.zeros((len(starts), 3), np.uint64)
        table[:, 0] = hashes
        table[:-1, 1] = pair
        table[:-2, 2] = triple
        valid = np.ones((len(starts), 3), bool)
        valid[:-1, 1] = doc[1:] == doc[:-1]
        valid[:-2, 2] = doc[2:] == doc[:-2]
        valid[-1:, 1] = False
        valid[-2:, 2] = False
        numbers.append((table[valid] >> np.uint64(64 - BITS)).astype(np.int32))
        each = np.bincount(doc, weights=valid.sum(axis=1), minlength=hi - lo).astype(np.int64)
        np.add.at(counts, [i for i, _ in pieces[lo:hi]], each)
    return (np.concatenate(numbers) if numbers else np.empty(0, np.int32)), counts


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal updates, one document at a time, in the given order."""
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for place, value, label in rows:
            w = weights(place)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            after = n[place] + g * g
            z[place] += g - (np.sqrt(after) - np.sqrt(n[place])) / ALPHA * w
            n[place] = after
    return weights(slice(None)).astype(np.float32)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Sparse dot products through the logistic function; blank texts score by the bias alone."""
    out = np.full(len(texts), float(weights[-1]))
    for lo, hi in slices(texts):
        numbers, counts = features(texts[lo:hi])
        full = np.flatnonzero(counts)
        if len(full):
            at = (np.cumsum(counts) - counts)[full]
            out[lo:hi][full] += np.add.reduceat(weights[numbers].astype(np.float64), at) * SCALE / counts[full]
    return 1 / (1 + np.exp(-out))


def held_out(doc_id: str | Column) -> Column:
    """Rows no label is learnt from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        texts, labels = binary_lists(batch.column("text")), batch.column("quality").to_pylist()
        for text, label in zip(texts, labels, strict=True):
            numbers, _ = features([text])
            place, count = np.unique(numbers, return_counts=True)
            place = np.append(place, 1 << BITS).astype(np.int64)
            rows.append((place, np.append(count * (SCALE / max(len(numbers), 1)), 1.0), int(label)))
    yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from at most ``TRAIN_ROWS`` labelled rows outside the held-out part.

    Rows without a label, text row or doc_id do not train; several labels of a document train once each, a null text trains as
    an empty one. Without any labelled row all scores are 0.5.
    """
    ready(docs.sparkSession)
    chosen = labels.where("quality in (0, 1)").where(~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    chosen = chosen.orderBy(*order).limit(TRAIN_ROWS)
    rows = docs.select("doc_id", text_bytes("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS small rows
    rows = rows.orderBy(*order, F.xxhash64("text")).limit(TRAIN_ROWS).select("text", "quality")
    found = rows.coalesce(1).mapInArrow(_learn, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, whole texts; null and empty texts get the bias' score."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(binary_lists(batch.column("text")), weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), text_bytes("text").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= KEEP, 1).otherwise(0))


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows that score ``KEEP`` or more, with all their columns, in one pass without a join."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(scores(texts, weights) >= KEEP))

    return docs.mapInArrow(run, docs.schema)
