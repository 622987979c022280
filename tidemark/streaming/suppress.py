"""Keep-first suppression on keyed state: late readings correct earlier decisions by change rows.

A series is cut into time chunks of at least one gap, and three chained processors share the work, each with state of its own:

``ChunkTable`` holds the instants of every chunk and publishes entry -> exit whenever they change: for each instant at which the chunk's
chain can begin, the last instant that it keeps. ``ChunkChain`` holds nothing but these tables, walks on from a changed chunk only as far
as exits change, and publishes where touched chunks start. ``ChunkRows`` holds the instants with their lowest ids, resolves its chunk
from its start, and gives the difference to what it gave before. So a batch reads the state of touched chunks, whatever the history
holds, and a series with most of the rows is spread over its chunks.

Series share state groups by hash (a call per series would cost more than its work): the first and last processor are keyed by
(bucket, chunk), the chain by bucket. In a group the series lie in PAGES pages by hash, those of the chain cut further every BLOCK chunks;
a call to the state store reads or writes a whole page, so that calls follow touched pages and not touched series.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.ingest import batch_writer, run_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NO_ID = 2**63 - 1
#: State groups of series; fixed for the life of a checkpoint.
BUCKETS = 512
#: Pages of a group, and chunks of a page of the chain; fixed likewise.
PAGES, BLOCK = 4, 16
_TABLE = "bucket int, series string, chunk long, entries binary, exits binary"
_START = "bucket int, chunk long, series string, t long, id long, kind int"
_CHANGE = "series string, kept_us long, id long, change int"


def chain(times: np.ndarray, start: int | None, gap: int) -> np.ndarray:
    """Positions of the kept ones among rising ``times``, from the one at ``start`` on."""
    if start is None or not len(times):
        return np.empty(0, np.int64)
    follow = np.searchsorted(times, times + gap)
    at, out = int(np.searchsorted(times, start)), []
    while at < len(times):
        out.append(at)
        at = int(follow[at])
    return np.array(out, np.int64)


def entry_table(times: np.ndarray, chunk: int, width: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Instants at which the chain of a chunk can begin (those of its first gap and the next one), and the last one kept from each."""
    follow, last = np.searchsorted(times, times + gap), times.copy()
    for i in range(len(times) - 1, -1, -1):
        if follow[i] < len(times):
            last[i] = last[follow[i]]
    n = min(int(np.searchsorted(times, chunk * width + gap)) + 1, len(times))
    return times[:n], last[:n]


def _by_series(rows: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    """``(series, column, …)`` for each series among the rows of a group."""
    frame = pd.concat(list(rows), ignore_index=True)
    series, columns = frame["series"].to_numpy(), [frame[n].to_numpy() for n in names]
    order = np.argsort(series, kind="stable")
    edges = np.flatnonzero(series[order][1:] != series[order][:-1]) + 1
    for part in np.split(order, edges):
        yield (series[part[0]], *[c[part] for c in columns])


def _instants(value: bytes | None) -> np.ndarray:
    return np.empty(0, np.int64) if value is None else np.frombuffer(bytes(value), np.int64)


class _Pages:
    """Rows by (series, chunk) in the pages of a group, each page one Arrow value of the state store. Written by ``flush``."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, ttl_ms: int | None, columns: dict[str, pa.DataType]):
        self.state = handle.getMapState(name, "page int, block long", "rows binary", ttl_ms)
        self.schema = pa.schema({"series": pa.string(), "chunk": pa.int64(), **columns})
        self.pages, self.changed = {}, set()

    def _at(self, series: str, chunk: int) -> tuple[int, int]:
        at = (zlib.crc32(series.encode()) % PAGES, chunk // BLOCK)
        if at not in self.pages:
            held = self.state.getValue(at)
            rows = [] if held is None else zip(*[c.to_pylist() for c in pa.ipc.open_stream(bytes(held[0])).read_all().columns], strict=True)
            self.pages[at] = {row[:2]: row[2:] for row in rows}
        return at

    def get(self, series: str, chunk: int) -> tuple | None:
        return self.pages[self._at(series, chunk)].get((series, chunk))

    def put(self, series: str, chunk: int, row: tuple) -> None:
        at = self._at(series, chunk)
        self.pages[at][series, chunk] = row
        self.changed.add(at)

    def flush(self) -> None:
        """Write the changed pages; the next call may belong to another group, so nothing stays loaded."""
        for at in self.changed:
            rows = zip(*[(*key, *row) for key, row in self.pages[at].items()], strict=True)
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, self.schema, strict=True)], schema=self.schema)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, self.schema) as stream:
                stream.write_batch(batch)
            self.state.updateValue(at, (out.getvalue().to_pybytes(),))
        self.pages, self.changed = {}, set()


class _Keyed(StatefulProcessor):
    def __init__(self, gap: int, width: int, ttl_ms: int | None):
        self.gap, self.width, self.ttl = gap, width, ttl_ms

    def close(self) -> None:
        pass


class ChunkTable(_Keyed):
    """(bucket, chunk): distinct instants of each series. A batch that brings no new instant publishes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = _Pages(handle, "times", self.ttl, {"t": pa.binary()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for series, new in _by_series(rows, "t"):
            held = self.times.get(series, key[1])
            old = _instants(held and held[0])
            times = np.union1d(old, new)
            if len(times) > len(old):
                self.times.put(series, key[1], (times.tobytes(),))
                entries, exits = entry_table(times, key[1], self.width, self.gap)
                out.append((key[0], series, key[1], entries.tobytes(), exits.tobytes()))
        self.times.flush()
        if out:
            yield pd.DataFrame(out, columns=["bucket", "series", "chunk", "entries", "exits"])


class ChunkChain(_Keyed):
    """(bucket): table, start and exit of each chunk of each series; a call loads the pages of the chunks that it walks over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        form = {"entries": pa.binary(), "exits": pa.binary(), "begun": pa.int32(), "start": pa.int64(), "exit": pa.int64()}
        self.chunks = _Pages(handle, "chunks", self.ttl, form)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for series, chunks, entries, exits in _by_series(rows, "chunk", "entries", "exits"):
            fresh = dict(zip(chunks.tolist(), zip(entries, exits, strict=True), strict=True))
            out += [(key[0], chunk, series, start, begun, 1) for chunk, start, begun in self._walk(series, fresh)]
        self.chunks.flush()
        if out:
            yield pd.DataFrame(out, columns=["bucket", "chunk", "series", "t", "id", "kind"])

    def _walk(self, series: str, fresh: dict) -> Iterator[tuple]:
        todo, done = list(fresh), set()
        heapq.heapify(todo)
        while todo:
            chunk = heapq.heappop(todo)
            held = self.chunks.get(series, chunk)
            if chunk in done or (chunk not in fresh and held is None):
                continue
            done.add(chunk)
            entries, exits = (bytes(x) for x in (fresh[chunk] if chunk in fresh else held[:2]))
            past, first = self.chunks.get(series, chunk - 1), _instants(entries)
            at = int(np.searchsorted(first, past[4] + self.gap)) if past is not None and past[2] else 0
            begun = int(at < len(first))
            start, exit_ = (int(first[at]), int(_instants(exits)[at])) if begun else (0, 0)
            self.chunks.put(series, chunk, (entries, exits, begun, start, exit_))
            if held is None or (held[2], held[3]) != (begun, start):
                yield chunk, start, begun
            if held is None or (held[2], held[4]) != (begun, exit_):
                heapq.heappush(todo, chunk + 1)


class ChunkRows(_Keyed):
    """(bucket, chunk): instants of each series with their lowest ids, and the start; gives what changes among the kept rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = _Pages(handle, "rows", self.ttl, {"t": pa.binary(), "id": pa.binary(), "begun": pa.int32(), "start": pa.int64()})

    def _kept(self, rows: dict[int, int], begun: int, start: int) -> dict[int, int]:
        times = np.array(sorted(rows), np.int64)
        return {t: rows[t] for t in times[chain(times, start if begun else None, self.gap)].tolist()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for series, kind, t, id_ in _by_series(rows, "kind", "t", "id"):
            held = self.rows.get(series, key[1])
            old = {} if held is None else dict(zip(_instants(held[0]).tolist(), _instants(held[1]).tolist(), strict=True))
            was = (0, 0) if held is None else (held[2], held[3])
            now, begins = dict(old), was
            for k, at, value in zip(kind.tolist(), t.tolist(), id_.tolist(), strict=True):
                if k:
                    begins = (value, at)
                else:
                    now[at] = min(value, now.get(at, _NO_ID))
            if now != old or begins != was:
                self.rows.put(series, key[1], (np.array(list(now), np.int64).tobytes(), np.array(list(now.values()), np.int64).tobytes(), *begins))
                before, after = self._kept(old, *was), self._kept(now, *begins)
                out += [(series, at, value, -1) for at, value in before.items() if after.get(at) != value]
                out += [(series, at, value, 1) for at, value in after.items() if before.get(at) != value]
        self.rows.flush()
        if out:
            yield pd.DataFrame(out, columns=["series", "kept_us", "id", "change"])


def suppressed(stream: DataFrame, keys: list[str], gap_seconds: int, chunk_seconds: int, id_: str, ttl_days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Change rows ``series, kept_us, id, change`` of a stream with ``ts`` and ``id_``: 1 where a row becomes kept, -1 where it no longer is.

    Rows may arrive in any order. NULL keys are keys, rows without an instant have no place and count for nothing. Key columns may be
    numbers, strings, booleans or dates. With ``ttl_days`` the state of a page that nothing has touched for so long expires (send older
    rows to the backfill, ``time_policy``); this needs a query that runs on, as Spark plans processing-time batches without end.
    """
    gap, width = gap_seconds * 1_000_000, chunk_seconds * 1_000_000
    if width < gap:
        raise ValueError("a chunk must span at least one gap")
    ttl, mode = (None, "None") if ttl_days is None else (ttl_days * 86_400_000, "ProcessingTime")
    t = F.unix_micros("ts")
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = stream.where(F.col("ts").isNotNull()).select(
        F.pmod(F.xxhash64(series), F.lit(buckets)).cast("int").alias("bucket"), F.floor(t / width).cast("long").alias("chunk"), series.alias("series"),
        t.alias("t"), F.coalesce(F.col(id_).cast("long"), F.lit(_NO_ID)).alias("id"), F.lit(0).alias("kind"))

    def staged(df: DataFrame, by: list[str], stage: type[_Keyed], schema: str) -> DataFrame:
        return df.groupBy(*by).transformWithStateInPandas(stage(gap, width, ttl), schema, "append", mode)

    tables = staged(rows, ["bucket", "chunk"], ChunkTable, _TABLE)
    starts = staged(tables, ["bucket"], ChunkChain, _START)
    return staged(rows.union(starts), ["bucket", "chunk"], ChunkRows, _CHANGE)


def fold_changes(changes: DataFrame, keys: list[str], schema: T.StructType, id_: str) -> DataFrame:
    """The kept rows after all changes: ``keys, kept_us, id_``. Order does not matter, so parts of a log may be folded in turn."""
    shape = T.StructType([schema[k] for k in keys])
    kept = changes.groupBy("series", "kept_us", "id").agg(F.sum("change").alias("n")).where("n > 0")
    kept = kept.withColumn("_k", F.from_json("series", shape))
    return kept.select(*[F.col("_k")[k].alias(k) for k in keys], "kept_us", F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_))


def keep_first_stream(
    stream: DataFrame, keys: list[str], gap_seconds: int, chunk_seconds: int, output: str, checkpoint: str, id_: str = "measurement_id"
) -> DataFrame:
    """Run ``suppressed`` over what is available, append its change rows to ``output`` (a folder a batch) and return the kept rows so far."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run_batches(suppressed(stream, keys, gap_seconds, chunk_seconds, id_), batch_writer(output), checkpoint)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    log = spark.read.schema(_CHANGE).parquet(output)
    return fold_changes(log, keys, stream.schema, id_)
