"""Word and shingle hashing inside tasks, batch helpers and stored intermediate tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_path

#: Words are runs of anything but ASCII white space; only A-Z is lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = re.compile(rb"[\x20\x09-\x0D]")
_SAME = np.arange(256, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_WIDTH = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    size = max(BLOCK * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            power = np.full(size, base, np.uint64)
            power[0] = 1
            out.append(np.multiply.accumulate(power))
        if size > BLOCK * 2:  # a word larger than a block: not worth keeping
            return out[0], out[1]
        _powers[size] = (out[0], out[1])
    return _powers[size]


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``raw[starts:ends]``."""
    power, inverse = _tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    hashes += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(hashes)


def _hash_block(pieces: list[bytes], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    at = np.cumsum([0] + [len(p) + 1 for p in pieces])
    return run_hashes(fold[raw], starts, ends), np.diff(np.searchsorted(starts, at))


def cut_long(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Texts cut at white space into pieces of about a block, and the text each piece is of (at least one for each text)."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > BLOCK:
            cut = _CUT.search(text, at + BLOCK)
            if cut is None:
                break
            pieces.append(text[at : cut.start()])
            owner.append(i)
            at = cut.end()
        pieces.append(text[at:] if at else text)
        owner.append(i)
    return pieces, owner


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text.

    Works block by block, so its memory does not follow the length of a text.
    """
    fold = _LOWER if lower else _SAME
    pieces, owner = cut_long(texts)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    first, held = 0, 0
    for k, piece in enumerate(pieces):
        held += len(piece) + 1
        if held > BLOCK or k + 1 == len(pieces):
            found, n = _hash_block(pieces[first : k + 1], fold)
            hashes.append(found)
            np.add.at(counts, owner[first : k + 1], n)
            first, held = k + 1, 0
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and their number by text; a shorter text is one shingle, an empty one none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(n.sum()), np.uint64)
    if len(words) >= width:
        run = words[: len(words) - width + 1] * _WIDTH[0]
        for j in range(1, width):
            run += words[j : len(words) - width + 1 + j] * _WIDTH[j % 5]
        run = mix(run)
    at = np.cumsum(n) - n
    long = np.flatnonzero(counts >= width)
    if len(long):
        # positions start..start+n-1 of each long text, laid behind one another
        size = n[long]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at[long], size) + step] = run[np.repeat(starts[long], size) + step]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = words[starts[i] : ends[i]] * _WIDTH[: counts[i]]
        out[at[i]] = mix(np.array([part.sum(dtype=np.uint64) + np.uint64(int(counts[i]))], np.uint64))[0]
    return out, n


def slices(texts: list, most: int = BLOCK, of: Callable = len) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together (at least one row)."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = of(text)
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(k)[0] != held[0].column(k)[held[0].num_rows - 1] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k)
            if batch.num_rows > 1:
                change[1:] |= ~np.asarray(pc.equal(values[1:], values[:-1]).fill_null(False))
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def binary_lists(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Values as bytes, null as empty."""
    return [x or b"" for x in column.to_pylist()]


def text_bytes(column: str | Column) -> Column:
    """A text as bytes; null is the empty text."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.cast("binary"), F.lit(b""))


def words_in(text: Column) -> Column:
    """Number of words of a text (null: 0), counted in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


#: Folders of stored tables that can still be discarded.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it again: no task of an earlier stage ever runs again for it.

    As nothing reads the shuffle files of a table that is written, Spark removes them at the end of the write.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``store`` wrote, once everything that reads them has been written itself."""
    for df in frames:
        path = _stored.pop(df, None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of ``n`` rows for tables that are written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the Python passes: small Arrow batches bound the memory that long texts take."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
