"""Evidence edges of many questions at once: audience gates, counts and the best edges, on bit masks of questions.

A row stands for one edge and one word of ``graph.WORD`` questions. Hops, gates and shared tokens are masks in that row, so an
edge is never repeated per question; only the best ``n`` edges of a question leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import text as T
from tidemark.operators.graph import OPEN_AUDIENCES, WORD, bit_of, nearest, no_bits, word_of
from tidemark.operators.skew import salted_join
from tidemark.session import stored

EDGE = ["source", "target", "type", "strength", "evidence"]
MARKS = ["fixed", "context_match", "conflict", "unconfirmed", "legacy"]
TIES = ["high", "explicit"]  # after the score, then the edge's own columns
SALTS = 16
HELD = 50_000
#: A join by more columns than those both sides are dealt by moves neither of them again.
DEALT_ONCE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def touched_edges(edges: DataFrame, planes: DataFrame, questions: DataFrame, context: DataFrame, clashes: DataFrame, hops: int = 2) -> DataFrame:
    """One row per edge and word of questions that reach one of its ends.

    ``edges`` has EDGE and may have the booleans ``unconfirmed`` and ``legacy`` (absent or NULL: false); equal rows count once.
    ``planes`` comes from ``graph.planes``. ``questions`` has (question, question_tokens) and may have ``audience`` (NULL: elderly) and
    ``source_gate`` (NULL: flag_legacy_pending); questions of ``planes`` without a row here are left out. ``context`` has (node),
    ``clashes`` has (source, target). A NULL or empty token list shares nothing.

    The edges are stored with what their sources bring, then dealt by their targets: they move once to each end, and ``edges``, ``planes``
    and the others are not read again by the result.

    Result: EDGE, MARKS, word, h0 .. h<hops> (each question at the nearer end's step), shown, blocked (masks), tokens (a mask per shared token).
    """
    steps = [f"m{h}" for h in range(hops + 1)]
    nodes, known = stored(_nodes(planes, context, steps), "nodes"), stored(_gates(questions).join(_asked(questions), "word", "left"), "asked")
    clash = stored(clashes.select("source", "target").distinct(), "clashes")
    half = stored(_from_sources(edges, clash, nodes), "half-edges", DEALT_ONCE)
    whole = _met(half.withColumn("_salt", _salt("source")).repartition("target", "_salt"), nodes, "target")
    whole = whole.select(*_fixed(), _by_word(F.col("_of_source"), F.col("_of_target"), steps).alias("_reach"))  # compiled, unlike an argument of explode
    reached = whole.withColumn("_r", F.explode("_reach")).select(*EDGE, *MARKS, "_r.*")
    rows = reached.filter(" OR ".join(f"{m} <> 0" for m in steps))
    gated = salted_join(rows, known, ["word"], EDGE, "inner", SALTS)
    shared = F.transform(T.tokens(F.concat_ws(" ", "source", "target", "evidence"), ()), lambda x: F.try_element_at("_asked", x))
    gated = gated.withColumn("tokens", F.coalesce(F.array_compact(shared), F.array().cast("array<bigint>")))
    known, every = F.col("_known"), F.lit((1 << WORD) - 1).cast("long")
    hidden = F.when(F.col("unconfirmed"), every).otherwise(no_bits()).bitwiseOR(F.when(F.col("legacy"), F.col("_strict")).otherwise(no_bits()))
    hidden = hidden.bitwiseAND(F.bitwise_not(F.col("_open")))
    at = [step.bitwiseAND(known) for step in nearest(hops)]
    seen = no_bits()
    for step in at:
        seen = seen.bitwiseOR(step)
    return gated.select(
        *EDGE, *MARKS, "word", *[step.alias(f"h{h}") for h, step in enumerate(at)], seen.bitwiseAND(F.bitwise_not(hidden)).alias("shown"),
        seen.bitwiseAND(hidden).alias("blocked"), "tokens",
    )


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _nodes(planes: DataFrame, context: DataFrame, steps: list[str]) -> DataFrame:
    """(node, reach, context): all that an edge needs of its end, ``reach`` being the planes of every word."""
    reach = planes.select("node", F.struct("word", *steps).alias("_r"), F.lit(False).alias("_c"))
    listed = context.select("node", F.lit(None).cast(reach.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_c"))
    rows = reach.unionByName(listed).filter(F.col("node").isNotNull())
    return rows.groupBy("node").agg(F.array_sort(F.collect_list("_r")).alias("reach"), F.bool_or("_c").alias("context"))


def _met(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges that are dealt by (``end``, _salt), with reach and context of that end."""
    own = nodes.select(F.col("node").alias(end), F.col("reach").alias(f"_of_{end}"), F.col("context").alias(f"_{end}"))
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(end, "_salt")
    return edges.join(own, [end, "_salt"], "left").drop("_salt")


def _from_sources(edges: DataFrame, clashes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges with conflict, and reach and context of their sources; ``clashes`` has distinct (source, target).

    Under DEALT_ONCE all of it happens where the edges are dealt by (source, _salt): the salt follows the target, so equal pairs stay together.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in edges.columns else F.lit(False).alias(c) for c in ("unconfirmed", "legacy")]
    dealt = edges.select(*EDGE, *flags, _salt("target").alias("_salt")).repartition("source", "_salt").distinct()
    clash = clashes.select("source", "target", _salt("target").alias("_salt"), F.lit(True).alias("_clash")).repartition("source", "_salt")
    return _met(dealt.join(clash, ["source", "_salt", "target"], "left"), nodes, "source").select(
        *EDGE, "unconfirmed", "legacy", F.coalesce("_clash", F.lit(False)).alias("conflict"), F.coalesce("_source", F.lit(False)).alias("_source"), "_of_source",
    )


def _by_word(one: Column, two: Column, steps: list[str]) -> Column:
    """The planes of two ends together, a struct for each word of either, each given as a list in the order of words (NULL: none)."""

    def joined(x: Column, y: Column) -> Column:
        return F.struct(x["word"].alias("word"), *[x[m].bitwiseOR(y[m]).alias(m) for m in steps])

    def merged(both: Column) -> Column:  # a word stands there once or twice
        def at(x: Column, i: Column) -> Column:
            before, after = F.get(both, i - 1), F.get(both, i + 1)
            again = F.coalesce(before["word"] == x["word"], F.lit(False))
            return F.when(~again, F.when(after["word"] == x["word"], joined(x, after)).otherwise(joined(x, x)))

        return F.array_compact(F.transform(both, at))

    return (
        F.when(F.coalesce(F.size(one), F.lit(0)) < 1, two).when(F.coalesce(F.size(two), F.lit(0)) < 1, one)
        .when((F.size(one) == 1) & (F.size(two) == 1) & (one[0]["word"] == two[0]["word"]), F.array(joined(one[0], two[0])))
        .otherwise(T.bind(F.array_sort(F.concat(one, two)), merged))
    )


def _fixed() -> list[Column | str]:
    """EDGE and MARKS: ``fixed`` is what the score owes to no question: type priority, context and conflict."""
    matched = F.col("_source") | F.coalesce("_target", F.lit(False))
    priority = F.create_map(*[F.lit(x) for kv in rules.RELATION_PRIORITY.items() for x in kv])
    fixed = F.coalesce(F.element_at(priority, F.col("type")), F.lit(1)) + 3 * matched.cast("int") - 5 * F.col("conflict").cast("int")
    return [*EDGE, fixed.alias("fixed"), matched.alias("context_match"), "conflict", "unconfirmed", "legacy"]


def _gates(questions: DataFrame) -> DataFrame:
    """(word, _known, _open, _strict): the questions of a word, those that see everything and those that see no legacy source."""
    audience = F.lower(F.coalesce("audience", F.lit("elderly"))) if "audience" in questions.columns else F.lit("elderly")
    gate = F.coalesce("source_gate", F.lit("flag_legacy_pending")) if "source_gate" in questions.columns else F.lit("flag_legacy_pending")
    rows = questions.select(
        word_of("question").alias("word"), bit_of("question").alias("_bit"), audience.isin(*OPEN_AUDIENCES).alias("_o"),
        (gate == "exclude_legacy_pending").alias("_s"),
    )

    def mask(which: Column) -> Column:
        return F.coalesce(F.bit_or(F.when(which, F.col("_bit"))), no_bits())

    return rows.groupBy("word").agg(
        F.bit_or("_bit").alias("_known"), mask(F.col("_o")).alias("_open"), mask(~F.col("_o") & F.col("_s")).alias("_strict")
    )


def _asked(questions: DataFrame) -> DataFrame:
    """(word, _asked): token -> mask of the questions that hold it, for the ``WORD`` questions of a word."""
    held = questions.select(word_of("question").alias("word"), bit_of("question").alias("_bit"), F.explode(F.array_distinct("question_tokens")).alias("_key"))
    masks = held.filter(F.col("_key").isNotNull()).groupBy("word", "_key").agg(F.bit_or("_bit").alias("_mask"))
    return masks.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_mask"))).alias("_asked"))


def edge_counts(touched: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, shown, blocked, explicit, legacy_shown) for every question; one counter per bit, summed before the shuffle.

    ``explicit`` counts shown edges that are no mentions, ``legacy_shown`` those whose source awaits review. A question without edges has zeros.
    """
    real = F.coalesce(F.col("type") != "mentions", F.lit(True))
    masks = {
        "shown": F.col("shown"), "blocked": F.col("blocked"), "explicit": F.when(real, F.col("shown")), "legacy_shown": F.when(F.col("legacy"), F.col("shown")),
    }
    stacked = touched.select("word", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.coalesce(mask, no_bits()).alias("mask")) for name, mask in masks.items()
    ])).alias("_m")).select("word", "_m.*").filter("mask <> 0")
    sums = stacked.groupBy("word", "name").agg(*[F.sum(F.expr(f"shiftright(mask, {b}) & 1L")).alias(f"b{b}") for b in range(WORD)])
    cells = sums.select("word", "name", F.posexplode(F.array(*[f"b{b}" for b in range(WORD)])).alias("_b", "n"))
    counts = cells.groupBy((F.col("word") * WORD + F.col("_b")).alias("question")).agg(
        *[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in masks]
    )
    return questions.select("question").distinct().join(counts, "question", "left").select(
        "question", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in masks]
    )


def best_edges(touched: DataFrame, n: int = 12, hide_mentions: bool = True) -> DataFrame:
    """The ``n`` best shown edges of every question: EDGE, hop, score, context_match, conflict, position.

    Score: type priority, +3 context, +2 seed at an end, +0.2 per shared token, -5 conflict. Ties: high strength, explicit type, then the
    edge's columns in order, NULL as empty. Mentions come out only for questions without explicit edges, unless ``hide_mentions`` is off.
    A task looks at the scores of a batch first, ranks ties once for all questions among the edges that can be among the best, and keeps
    ``n`` per question; beyond HELD rows it gives them out and starts anew.
    """
    steps = sorted((c for c in touched.columns if c[0] == "h" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    kinds = {f.name: f.dataType.simpleString() for f in touched.schema}
    schema = ", ".join(["question long", *[f"{c} {kinds[c]}" for c in EDGE], "hop int, score double, context_match boolean, conflict boolean"])
    order = ["mention"] * hide_mentions + ["score", *TIES, *EDGE]
    rising = [True] * hide_mentions + [False, False, False] + [True] * len(EDGE)
    wanted = touched.filter("shown <> 0").select(*EDGE, "fixed", "context_match", "conflict", "word", *steps, "shown", "tokens")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows.assign(**{c: rows[c].fillna("") for c in EDGE}, _at=np.arange(len(rows)))
        first = key.sort_values(["question", *order], ascending=[True, *rising], kind="stable").groupby("question", sort=False).head(n)
        return rows.iloc[first["_at"].to_numpy()]

    def floors(held: pd.DataFrame) -> dict[tuple[int, bool], float]:
        """(question, whether explicit, where mentions come after) -> score of the n-th edge so far, of questions with n of that kind."""
        kind = held["explicit"] & hide_mentions
        worst = held.assign(kind=kind).groupby(["question", "kind"])["score"].agg(["min", "size"])
        return worst.loc[worst["size"] >= n, "min"].to_dict()

    def scored(rows: pd.DataFrame, floor: dict[tuple[int, bool], float]) -> pd.DataFrame | None:
        """Rows (edge, question) that may be among the best of these edges; scores under the ``floor`` of their question are not."""
        words = rows["word"].to_numpy()
        explicit, fixed, sizes = (rows["type"].fillna("") != "mentions").to_numpy(), rows["fixed"].to_numpy(), rows["tokens"].map(len).to_numpy()
        masks = np.concatenate(rows["tokens"].to_numpy()).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
        holder, picks = np.repeat(np.arange(len(rows)), sizes), []
        seen, planes = rows["shown"].to_numpy(np.int64), [rows[step].to_numpy(np.int64) for step in steps]
        for word in np.unique(words):
            here = words == word
            for b in np.flatnonzero(np.bitwise_or.reduce(seen[here]) >> np.arange(WORD) & 1):
                at = np.flatnonzero(here & (seen >> b & 1 == 1))
                if hide_mentions and explicit[at].any():
                    at = at[explicit[at]]
                shared = np.bincount(holder, masks >> b & 1, len(rows))[at]
                values = np.round(fixed[at] + 2.0 * (planes[0][at] >> b & 1) + 0.2 * shared, 4)
                least = floor.get((int(word) * WORD + int(b), hide_mentions and bool(explicit[at[0]])), -np.inf)
                if len(at) > n:
                    least = max(least, np.partition(values, len(at) - n)[len(at) - n])
                at, values = at[values >= least], values[values >= least]
                hop = np.full(len(at), len(steps) - 1)
                for h in range(len(steps) - 2, -1, -1):
                    hop[planes[h][at] >> b & 1 == 1] = h
                picks.append((np.full(len(at), word * WORD + b), at, values, hop))
        question, at, score, hop = (np.concatenate(x) for x in zip(*picks))
        if not len(at):
            return None
        # ties are ranked once among the edges that are left, whatever the number of questions
        left = np.unique(at)
        tied = rows.iloc[left][EDGE].fillna("").assign(
            high=(rows["strength"].iloc[left] == "high").to_numpy(), explicit=explicit[left], _at=np.arange(len(left)),
        ).sort_values([*TIES, *EDGE], ascending=rising[-len(TIES) - len(EDGE):], kind="stable")
        place = np.empty(len(left), np.int64)
        place[tied["_at"].to_numpy()] = np.arange(len(left))
        order = np.lexsort((place[np.searchsorted(left, at)], -score, question))
        start = np.searchsorted(question[order], question[order])
        order = order[np.arange(len(order)) - start < n]
        question, at, score, hop = (x[order] for x in (question, at, score, hop))
        out = rows.iloc[at][[*EDGE, "context_match", "conflict"]].reset_index(drop=True)
        return out.assign(
            question=question, hop=hop, score=score, mention=~explicit[at], explicit=explicit[at], high=(out["strength"] == "high").to_numpy(),
        )

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held, floor = [c.split()[0] for c in schema.split(", ")], None, {}
        for batch in batches:
            new = scored(batch, floor) if len(batch) else None
            if new is not None:
                held = new if held is None else cut(pd.concat([held, new], ignore_index=True))
                floor = floors(held)
            if held is not None and len(held) > HELD:
                yield held[columns]
                held, floor = None, {}
        if held is not None:
            yield held[columns]

    found = wanted.mapInPandas(best, schema)
    mention = F.coalesce(F.col("type") == "mentions", F.lit(False))
    ties = [F.coalesce(F.col("strength") == "high", F.lit(False)).desc(), mention.asc(), *[F.coalesce(c, F.lit("")) for c in EDGE]]
    rank = Window.partitionBy("question").orderBy(*([mention.asc()] if hide_mentions else []), F.col("score").desc(), *ties)
    top = found.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= n)
    if not hide_mentions:
        return top
    some = F.bool_or(~mention).over(Window.partitionBy("question"))
    return top.withColumn("_explicit", some).filter(~(F.col("_explicit") & mention)).drop("_explicit")
