"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents by hash. Its target gives an exact quota of block draws: whole passes over the
source, then blocks in permuted order until the rest is reached, the last block in part. A tree over the output shards splits
the vector of quotas: what goes to the left half of a node's shards is multivariate-hypergeometric, so the shards are what
drawing all blocks without replacement in random order would give. Every leaf then takes its own stretch of each source's
permuted draws and shuffles them locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ready, store, words_in

MOST_PASSES = 3
BLOCK_WORDS, BLOCK_ROWS = 1 << 16, 1 << 12
SHARD_BLOCKS = 32
FAN_OUT = 64
#: Rows of one source that a window orders at once.
STRETCH = 1024


def _numbered_sources(sized: DataFrame) -> DataFrame:
    """Sources in code point order, null last, with their number; only one count per partition comes to the driver."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = store(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    parts = sources.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before, offsets = 0, []
    for part in parts:
        offsets += [F.lit(part["part"]), F.lit(before)]
        before += part["count"]
    base = F.create_map(*offsets)[F.shiftright("at", 33)] if offsets else F.lit(0)
    return sources.withColumn("source_no", (base + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("at")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_no, source_size, source_rows, weight, target``: weights 1, 2, 3, repeating, share the total of all sizes.

    A target stops at three times its source's size; the excess is shared again by weight until none is above. Each round
    reads one row of sums.
    """
    sources = _numbered_sources(sized).withColumn("weight", F.col("source_no") % 3 + 1)
    rate, stopped = None, -1
    while True:
        above = F.lit(False) if rate is None else MOST_PASSES * F.col("source_size") <= rate * F.col("weight")
        total, full, weight, count = sources.agg(
            F.sum("source_size"), F.sum(F.when(above, MOST_PASSES * F.col("source_size"))), F.sum(F.when(~above, F.col("weight"))),
            F.count(F.when(above, 1))).first()
        if not weight or count == stopped:
            break
        rate, stopped = ((total or 0) - (full or 0)) / weight, count
    target = F.least(F.lit(float(rate or 0)) * F.col("weight"), (MOST_PASSES * F.col("source_size")).cast("double"))
    return sources.withColumn("target", target.cast("double"))


def _draw(size: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), size)


def _blocked(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds ``source_no, h, block``; needs ``doc_id, source, size``."""
    blocks = F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS), F.ceil(F.col("source_rows") / BLOCK_ROWS)).cast("long")
    keyed = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", blocks.alias("_blocks"))
    rows = rows.join(keyed, F.expr("source <=> _source")).withColumn("h", _draw(F.col("size"), seed))
    return rows.withColumn("block", F.pmod("h", "_blocks")).drop("_source", "_blocks")


def _running(rows: DataFrame, order: list[str], stretch: Column, value: str) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over earlier rows of the same source.

    ``stretch`` cuts the order of a source into parts of about ``STRETCH`` rows, so no window holds a whole hot source.
    """
    rows = rows.withColumn("_stretch", stretch)
    sums = rows.groupBy("source_no", "_stretch").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy("source_no").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_stretch", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source_no", "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["source_no", "_stretch"])
    return rows.withColumn("before", F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_stretch", "_ahead")


def _hash_stretch(hash_column: str, count: Column) -> Column:
    """The part a hash falls into when its range is cut into ``count / STRETCH`` parts, in the order of the hash."""
    parts = F.ceil(count / STRETCH)
    return F.floor((F.col(hash_column) / F.lit(2.0**64) + 0.5) * parts).cast("long")


def _picks(group: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block that fill ``rest`` words: in permuted order what still fits, then one more if that is nearer."""
    group = group.sort_values("h", ignore_index=True)
    rest, taken, picked = float(group["rest"].iloc[0]), 0, []
    for h, size in zip(group["h"], group["size"], strict=True):
        if taken + size <= rest:
            taken += size
            picked.append(h)
    left = group[~group["h"].isin(picked)].sort_values(["size", "h"])
    if len(left) and abs(taken + left["size"].iloc[0] - rest) < rest - taken:
        picked.append(left["h"].iloc[0])
    return pd.DataFrame({"source_no": [group["source_no"].iloc[0]], "block": [group["block"].iloc[0]], "picks": [picked]})


def _split(seed: int, total: int, shards: int):
    """One step of the tree: a node's quotas go to at most ``FAN_OUT`` children by halving its shards again and again."""

    def room(first: int, last: int) -> int:
        full, extra = divmod(total, shards)
        return (last - first) * full + min(last, extra) - min(first, extra)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source_no")
        first, last = int(group["first"].iloc[0]), int(group["last"].iloc[0])
        names, out = group["source_no"].to_numpy(), []
        open_nodes = [(first, last, group["quota"].to_numpy(np.int64), FAN_OUT)]
        while open_nodes:
            lo, hi, quota, fan = open_nodes.pop()
            if hi - lo == 1 or fan == 1:
                some = quota > 0
                out.append(pd.DataFrame({"first": lo, "last": hi, "source_no": names[some], "quota": quota[some]}))
                continue
            middle = (lo + hi) // 2
            chance = np.random.default_rng([seed, lo, hi])
            left = chance.multivariate_hypergeometric(quota, room(lo, middle), method="marginals")
            open_nodes += [(middle, hi, quota - left, fan // 2), (lo, middle, left, fan // 2)]
        return pd.concat(out).astype("int64")

    return run


def shard_quotas(quotas: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """``source_no, shard, quota``: exact quotas of ``(source_no, quota)`` split over shards of equal size.

    A node is one task's work and holds one number per source; a level of the tree splits all its nodes side by side.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("last"), "source_no", "quota")
    for _ in range(max(0, math.ceil(math.log(max(shards, 1), FAN_OUT) - 1e-9))):
        nodes = nodes.groupBy("first", "last").applyInPandas(_split(seed, total, shards), "first long, last long, source_no long, quota long")
    return nodes.select("source_no", F.col("first").alias("shard"), "quota")


def plan(sized: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sources with targets, and for every block that is drawn its ``placements`` (pass, shard), ``partial`` pass and ``picks``.

    ``sized``: ``doc_id, source, size``, one row per document. Same rows, same plan.
    """
    sources = store(source_targets(sized), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = sources.select("source_no", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest"))
    blocked = _blocked(sized, sources, seed).select("source_no", "block", "h", "size")
    blocks = blocked.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    counts = blocks.groupBy("source_no").agg(F.count("*").alias("n"))
    blocks = blocks.join(counts, "source_no").withColumn("place", F.xxhash64(F.lit(seed + 1), "source_no", "block"))
    blocks = _running(blocks, ["place", "block"], _hash_stretch("place", F.col("n")), "words").join(goals, "source_no")
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    whole = (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0)
    blocks = store(blocks.select("source_no", "block", "passes", (F.col("rest") - F.col("before")).alias("rest"), cut.alias("cut"), whole.alias("whole")), "blocks")
    inside = blocked.join(blocks.where("cut").select("source_no", "block", "rest"), ["source_no", "block"])
    inside = inside.groupBy("source_no", "block", "h").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    picks = inside.groupBy("source_no", "block").applyInPandas(_picks, "source_no long, block long, picks array<long>")
    # a draw is one block in one pass
    last = F.when(F.col("cut") | F.col("whole"), F.col("passes") + 1).otherwise(F.col("passes"))
    draws = blocks.where(last > 0).select("source_no", "block", F.explode(F.sequence(F.lit(1), last)).alias("pass"))
    draws = store(draws.withColumn("place", F.xxhash64(F.lit(seed + 2), "source_no", "block", "pass")).withColumn("one", F.lit(1)), "draws")
    quotas = store(draws.groupBy("source_no").agg(F.count("*").alias("quota")), "quotas")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BLOCKS))
    draws = _running(draws.join(quotas, "source_no"), ["place", "block", "pass"], _hash_stretch("place", F.col("quota")), "one")
    cells = _running(shard_quotas(quotas, total, shards, seed), ["shard"], F.floor(F.col("shard") / STRETCH), "quota")
    turns = cells.select("source_no", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("quota") - 1)).alias("before"))
    placed = draws.select("source_no", "block", "pass", "before").join(turns, ["source_no", "before"])
    placed = placed.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("placements"))  # at most MOST_PASSES
    placed = placed.join(picks, ["source_no", "block"], "left").join(
        blocks.select("source_no", "block", F.when(F.col("cut"), F.col("passes") + 1).alias("partial")), ["source_no", "block"])
    return sources, store(placed, "placed-blocks")


def place(rows: DataFrame, sources: DataFrame, placed: DataFrame, seed: int = 1) -> DataFrame:
    """Adds ``source_size, target, placements`` to rows with ``doc_id, source, size``; a row not drawn has no placement."""
    rows = _blocked(rows, sources, seed).join(placed, ["source_no", "block"], "left")
    kept = F.expr("filter(placements, p -> partial is null or p.pass != partial or array_contains(picks, h))")
    none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
    return rows.withColumn("placements", F.coalesce(kept.cast("array<struct<pass:bigint,shard:bigint>>"), none)).drop("placements_", "picks", "partial")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))


def mix_shares(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per document row: ``doc_id, size, source_size, target, taken, copies, shards``.

    Null texts have size 0, null sources are the last source. ``taken`` is the size times the number of copies in the mix.
    Rows that repeat a doc_id and size in a source are drawn together. Empty tables give no row.
    """
    ready(docs.sparkSession)
    sized = store(sizes(docs), "sizes")
    sources, placed = plan(sized, seed)
    rows = place(sized, sources, placed, seed)
    copies = F.size("placements").cast("long")
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
        F.col("placements.shard").alias("shards"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: every drawn copy as a row with the given columns, dealt to its shard and shuffled inside it."""
    ready(docs.sparkSession)
    sources, placed = plan(store(sizes(docs), "sizes"), seed)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", words_in(F.col("text")).alias("size"))
    rows = place(rows, sources, placed, seed).where("size(placements) > 0")
    rows = rows.select("row", "h", F.explode("placements").alias("at")).select("row", F.col("at.shard").alias("_shard"), F.xxhash64(F.lit(seed + 3), "h", "at.pass").alias("_turn"))
    return rows.repartition("_shard").sortWithinPartitions("_shard", "_turn").select("row.*")
