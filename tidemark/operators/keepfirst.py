"""Keep-first suppression: keep a row, drop later rows of the key until ``gap`` seconds after the kept row.

This is a chain, so ``lag`` alone is wrong. A key is cut into time chunks of at least one gap. Inside a chunk the chain
depends on the past only through its first kept row, and that row lies in the first gap of the chunk (or is the first
row after it). Every chunk therefore publishes a small table entry -> last kept row; walking those tables gives each
chunk its start, and the chunks are then resolved independently. A hot key is spread over its chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chain(times, start, gap: int):
    """Kept instants of an ordered array column from ``start`` (inclusive) on."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        times,
        empty,
        lambda kept, t: F.when(
            (t >= start) & ((F.size(kept) == 0) | (t >= F.element_at(kept, -1) + gap)), F.concat(kept, F.array(t))
        ).otherwise(kept),
    )


def kept_instants(df: DataFrame, keys: list[str], gap_seconds: int, chunk_seconds: int, ts: str = "ts") -> DataFrame:
    """(keys, kept instant in microseconds). Equal instants of a key count as one.

    ``chunk_seconds`` bounds the instants held at once: a chunk of a key has at most as many as the clock resolves.
    """
    gap, width = gap_seconds * 1_000_000, chunk_seconds * 1_000_000
    if width < gap:
        raise ValueError("a chunk must span at least one gap")
    instants = df.select(*keys, F.unix_micros(ts).alias("_t")).distinct()
    chunks = (
        instants.withColumn("_c", F.floor(F.col("_t") / width).cast("long"))
        .groupBy(*keys, "_c")
        .agg(F.array_sort(F.collect_list("_t")).alias("_times"))
        .withColumn("_first", F.element_at("_times", 1))
        .withColumn("_last", F.element_at("_times", -1))
    )
    # a chunk needs the past only when the chunk before it ends within one gap of its first row
    before = chunks.select(*keys, (F.col("_c") + 1).alias("_c"), F.col("_last").alias("_past"))
    linked = _null_safe_left(chunks, before, keys + ["_c"]).withColumn(
        "_open", F.coalesce(F.col("_first") < F.col("_past") + gap, F.lit(False))
    )
    free = linked.filter(~F.col("_open")).withColumn("_start", F.col("_first"))
    # chunks that feed or need a neighbour publish entry -> exit
    early = F.filter("_times", lambda t: t < F.col("_c") * width + gap)
    later = F.filter("_times", lambda t: t >= F.col("_c") * width + gap)
    entries = F.concat(early, F.slice(later, 1, 1))

    @F.pandas_udf("array<bigint>")
    def exits(times: pd.Series, starts: pd.Series) -> pd.Series:
        """Last kept instant of the chunk for every possible first one, filled from the end of the chunk."""
        out = []
        for t, s in zip(times, starts):
            t = np.asarray(t, dtype=np.int64)
            follow, last = np.searchsorted(t, t + gap), t.copy()
            for i in range(len(t) - 1, -1, -1):
                if follow[i] < len(t):
                    last[i] = last[follow[i]]
            out.append(last[np.searchsorted(t, np.asarray(s, dtype=np.int64))])
        return pd.Series(out)

    after = chunks.select(*keys, (F.col("_c") - 1).alias("_c"), F.col("_first").alias("_next"))
    feeding = _null_safe_left(linked, after, keys + ["_c"]).filter(
        F.col("_open") | F.coalesce(F.col("_next") < F.col("_last") + gap, F.lit(False))
    )
    tables = feeding.select(*keys, "_c", "_open", "_times", entries.alias("_entries")).withColumn("_exits", exits("_times", "_entries")).drop("_times")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", _c long, _start long"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_c")
        starts, last = [], None
        for is_open, ins, outs in zip(rows["_open"], rows["_entries"], rows["_exits"]):
            floor = last + gap if is_open else ins[0]
            at = next((i for i, e in enumerate(ins) if e >= floor), None)
            starts.append(None if at is None else int(ins[at]))
            last = last if at is None else int(outs[at])
        out = rows[[*keys, "_c"]].copy()
        out["_start"] = pd.array(starts, dtype="Int64")
        return out[rows["_open"].to_numpy()]

    starts = tables.groupBy(*keys).applyInPandas(walk, schema)
    bound = _null_safe_left(
        linked.filter("_open"), starts.withColumnRenamed("_start", "_s"), keys + ["_c"]
    ).withColumn("_start", F.col("_s")).drop("_s")
    ready = free.unionByName(bound.select(free.columns)).filter(F.col("_start").isNotNull())
    return ready.select(*keys, F.explode(_chain(F.col("_times"), F.col("_start"), gap)).alias("kept_us"))


def _null_safe_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.select([F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [left[c].eqNullSafe(renamed[f"r_{c}"]) for c in on]
    return left.join(renamed, same, "left").drop(*[f"r_{c}" for c in on])


def keep_first(
    df: DataFrame, keys: list[str], gap_seconds: int, chunk_seconds: int, id_: str, ts: str = "ts"
) -> DataFrame:
    """The kept rows themselves: the lowest id at every kept instant."""
    firsts = df.groupBy(*keys, F.unix_micros(ts).alias("kept_us")).agg(F.min(id_).alias(id_))
    kept = kept_instants(df, keys, gap_seconds, chunk_seconds, ts).withColumn("_kept", F.lit(True))
    return _null_safe_left(firsts, kept, keys + ["kept_us"]).filter("_kept").drop("_kept")
