"""Batch retrieval: question tokens against chunk tokens, scored top-k, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from tidemark import rules
from tidemark.functions import text as T
from tidemark.session import fresh_path


@dataclass
class Weights:
    """Scoring parameters; the defaults are the domain's own lists."""

    topics: dict[str, tuple] = field(default_factory=lambda: rules.TOPIC_ALIASES)
    danger: tuple = rules.ENTITY_TERMS["danger_sign"]
    alias: float = 2.0
    danger_bonus: float = 2.0
    authority: float = 0.5
    direct: float = 4.0
    linked: float = 1.0
    conflict: float = 2.0
    registry: float = 2.0
    terms: tuple = T.DICTIONARY


# one pass over the chunks takes at most so many questions, and so many of their tokens (one question at least)
PASS_QUESTIONS, PASS_TOKENS = 4096, 4_000_000
# one score matrix: chunks x questions; and chunk tokens that are added to it at once
TILE_CHUNKS, TILE_QUESTIONS, TILE_TOKENS = 1024, 512, 8192
NEVER = -(2**50)


def _hashed(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x)))


def chunk_profile(chunks: DataFrame, w: Weights) -> DataFrame:
    """What the score needs of a chunk: token hashes, topic hits, and the part of the score that no question changes."""
    text = F.col("text")
    base = F.col("authority").cast("int") * w.authority - F.when(F.col("registry"), w.registry).otherwise(0.0)
    return chunks.select(
        "chunk_id", "doc_id", "evidence_key", base.alias("base"), _hashed(T.tokens(text, w.terms)).alias("tokens"),
        F.array(*[F.size(T.contained(text, terms)) for terms in w.topics.values()]).cast("array<int>").alias("hits"),
        F.coalesce(T.has_any(text, w.danger), F.lit(False)).alias("has_danger"),
    )


def question_profile(questions: DataFrame, w: Weights) -> DataFrame:
    text = F.col("text")
    return questions.select(
        "question_id", _hashed(T.tokens(text, w.terms)).alias("tokens"),
        F.array(*[F.coalesce(T.has_any(text, terms), F.lit(False)).cast("int") for terms in w.topics.values()]).cast("array<int>").alias("asks"),
        F.coalesce(T.has_any(text, w.danger), F.lit(False)).alias("urgent"),
    )


def hybrid_top_k(chunks: DataFrame, questions: DataFrame, linked: DataFrame, direct: DataFrame, conflicted: DataFrame, k: int = 8, w: Weights | None = None) -> DataFrame:
    """Scored top-k chunks per question over the whole corpus; a score of zero is no result.

    ``linked`` and ``conflicted`` are evidence keys, ``direct`` is (question_id, evidence_key) and takes the place of
    ``linked``. Chunk and question ids are unique; a chunk without authority has no score. See ``_scan`` for the plan.
    """
    w = w or Weights()
    marks = linked.select("evidence_key").distinct().withColumn("link", F.lit(float(w.linked))).join(
        conflicted.select("evidence_key").distinct().withColumn("_clash", F.lit(float(w.conflict))), "evidence_key", "left"
    )
    profile = chunk_profile(_spread(chunks), w).join(marks, "evidence_key", "left").fillna(0.0, ["link", "_clash"])
    profile = profile.withColumn("base", F.col("base") - F.col("_clash")).drop("_clash")
    own = direct.select("question_id", "evidence_key").distinct()
    return _scan(profile, question_profile(questions, w), own, k, w, need_overlap=False)


def lexical_top_k(chunks: DataFrame, questions: DataFrame, k: int = 8, authority: float = 0.0, registry: float = 0.0) -> DataFrame:
    """Token overlap (at least one shared token), optionally with an authority bonus and a registry penalty.

    Tokens are words and bigrams: the lexical baselines know no dictionary.
    """
    w = Weights(topics={}, danger=("",), danger_bonus=0.0, authority=authority, registry=registry, terms=())
    tokens = _hashed(T.tokens(F.col("text"), ()))
    base = F.col("authority").cast("int") * float(authority) - F.when(F.col("registry"), float(registry)).otherwise(0.0)
    none, no = F.array().cast("array<int>"), F.lit(False)
    held = _spread(chunks).select("chunk_id", "doc_id", base.alias("base"), tokens.alias("tokens"), none.alias("hits"), no.alias("has_danger"), F.lit(0.0).alias("link"))
    asked = questions.select("question_id", tokens.alias("tokens"), none.alias("asks"), no.alias("urgent"))
    return _scan(held, asked, None, k, w, need_overlap=True)


def _scan(profile: DataFrame, asked: DataFrame, own: DataFrame | None, k: int, w: Weights, need_overlap: bool) -> DataFrame:
    """All questions against all chunks, in blocks: ``question_id, chunk_id, doc_id, score, position``.

    The chunks' profile is written once. Questions go over it in passes of a bounded size: a pass is sent to the tasks,
    which score tiles of chunks x questions and keep the best ``k`` per question while they read. Only those are shuffled,
    and no pair is ever a row. Scores count in units of 1e-4, halves away from zero; equal scores go by chunk id.
    """
    spark = profile.sparkSession
    out = Y.StructType([Y.StructField("question_id", Y.LongType()), profile.schema["chunk_id"], profile.schema["doc_id"], Y.StructField("score", Y.DoubleType())])
    stored, found = _written(profile, "chunk-profile"), None
    for block in _passes(asked):
        ids = [r["question_id"] for r in block]
        held = stored
        if own is not None:
            keyed = own.filter(F.col("question_id").between(ids[0], ids[-1])).groupBy("evidence_key").agg(F.collect_list("question_id").alias("direct"))
            held = stored.join(keyed, "evidence_key", "left").drop("evidence_key")
        sent = spark.sparkContext.broadcast(_Block(block, k, w, need_overlap))
        best = held.mapInArrow(lambda batches, sent=sent, out=out: sent.value.best(batches, out), out)
        part = _written(_top(best, k), "top-chunks")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else _top(spark.createDataFrame([], out), k)


def _spread(chunks: DataFrame) -> DataFrame:
    """Chunks over as many tasks as there are cores: few large files would leave cores without work. More tasks stay as they are."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks if chunks.rdd.getNumPartitions() >= cores else chunks.repartition(cores, "chunk_id")


def _passes(asked: DataFrame) -> Iterator[list[Row]]:
    """Questions by ascending id in blocks of bounded size; the driver holds one block and one partition of questions."""
    block, n = [], 0
    for row in asked.filter("question_id is not null").orderBy("question_id").toLocalIterator():
        if block and (len(block) == PASS_QUESTIONS or n + len(row["tokens"]) > PASS_TOKENS):
            yield block
            block, n = [], 0
        block.append(row)
        n += len(row["tokens"])
    if block:
        yield block


class _Block:
    """The questions of one pass, as arrays, and their running best chunks in a task."""

    def __init__(self, rows: list[Row], k: int, w: Weights, need_overlap: bool) -> None:
        self.k, self.w, self.need_overlap = k, w, need_overlap
        self.ids = np.array([r["question_id"] for r in rows], np.int64)
        self.asks = np.array([r["asks"] for r in rows], np.float64).reshape(len(rows), len(w.topics))
        self.urgent = np.array([r["urgent"] for r in rows], bool)
        self.tiles = []
        for at in range(0, len(rows), TILE_QUESTIONS):
            sets = [np.array(r["tokens"], np.int64) for r in rows[at : at + TILE_QUESTIONS]]
            words, place = np.unique(np.concatenate(sets), return_inverse=True)
            asker = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(words) + 1))
            self.tiles.append((at, len(sets), words, starts, asker[order]))

    def best(self, batches: Iterator[pa.RecordBatch], out: Y.StructType) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple]] = [[] for _ in self.ids]
        last = np.full(len(self.ids), NEVER, np.int64)  # rank of the k-th chunk, once there are k
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_CHUNKS):
                self._take(batch.slice(at, TILE_CHUNKS), top, last)
        rows = [(int(q), chunk, doc, -rank / 1e4) for q, kept in zip(self.ids, top) for rank, chunk, doc in kept]
        columns = list(zip(*rows)) if rows else [[]] * 4
        types = [pa.int64(), pa.string(), _arrow(out["doc_id"].dataType), pa.float64()]
        for at in range(0, max(len(rows), 1), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], t) for c, t in zip(columns, types)], out.names)

    def _take(self, some: pa.RecordBatch, top: list[list[tuple]], last: np.ndarray) -> None:
        names = some.column("chunk_id").to_pylist()
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        base, link = (some.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("base", "link"))
        danger = some.column("has_danger").to_numpy(zero_copy_only=False).astype(bool)
        hits = some.column("hits").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1) if self.w.topics else None
        lists = some.column("tokens")
        tokens, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy(zero_copy_only=False))
        pairs = self._direct(some)
        for at, n, words, starts, asker in self.tiles:
            overlap = self._overlap(tokens, owner, len(names), n, words, starts, asker)
            linked = np.repeat(link[:, None], n, axis=1)
            here = (pairs[1] >= at) & (pairs[1] < at + n)
            linked[pairs[0][here], pairs[1][here] - at] = self.w.direct
            score = overlap + linked + base[:, None]
            if hits is not None:
                score += self.w.alias * (hits @ self.asks[at : at + n].T)
            score += self.w.danger_bonus * (danger[:, None] & self.urgent[None, at : at + n])
            units = np.sign(score) * np.floor(np.abs(score) * 1e4 + 0.5)
            shut = np.isnan(units) | ((overlap == 0) if self.need_overlap else (units == 0))
            rank = np.where(shut, NEVER, units).T.astype(np.int64)
            self._merge(at, rank, place, names, some.column("doc_id"), top, last)

    def _direct(self, some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, question) positions of the direct links."""
        if "direct" not in some.schema.names:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lists = some.column("direct")
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[at] == ids
        return of[known], at[known]

    @staticmethod
    def _overlap(tokens: np.ndarray, owner: np.ndarray, rows: int, n: int, words: np.ndarray, starts: np.ndarray, asker: np.ndarray) -> np.ndarray:
        """Shared tokens of each chunk and question: the postings of the chunks' tokens, counted per cell, so many at once."""
        counts = np.zeros(rows * n, np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
            known = words[at] == tokens
            at, of, sizes = at[known], owner[known], np.diff(starts)
            for i in range(0, len(at), TILE_TOKENS):
                first, size = starts[at[i : i + TILE_TOKENS]], sizes[at[i : i + TILE_TOKENS]]
                steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                cells = np.repeat(of[i : i + TILE_TOKENS] * n, size) + asker[np.repeat(first, size) + steps]
                counts += np.bincount(cells, minlength=rows * n)
        return counts.reshape(rows, n).astype(np.float64)

    def _merge(self, at: int, rank: np.ndarray, place: np.ndarray, names: list[str], docs: pa.Array, top: list[list[tuple]], last: np.ndarray) -> None:
        n, k = rank.shape[1], min(self.k, rank.shape[1])
        highest = rank.max(axis=1)
        better = np.flatnonzero((highest > NEVER) & (highest >= last[at : at + len(rank)]))
        if not len(better):
            return
        order = rank[better] * n + (n - 1 - place)  # one number: rank, then the lower chunk id
        best = np.argpartition(-order, k - 1, axis=1)[:, :k]
        for q, chosen in zip(better, best):
            kept = top[at + q]
            edge = kept[-1][:2] if len(kept) == self.k else None
            new = [(-int(rank[q, c]), names[c], c) for c in chosen if rank[q, c] > NEVER]
            new = [(r, name, docs[int(c)].as_py()) for r, name, c in new if edge is None or (r, name) < edge]
            if new:
                kept = top[at + q] = sorted(kept + new, key=lambda x: x[:2])[: self.k]
                if len(kept) == self.k:
                    last[at + q] = -kept[-1][0]


def _arrow(kind: Y.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def passages_in(documents: DataFrame, passages: DataFrame, size: int = 8) -> DataFrame:
    """(question_id, doc_id) where the document contains the passage, checked on the whole texts.

    The first and last word of a contained passage may be cut out of longer words, the inner words are whole. So a
    hashed run of inner words finds the candidates: ``size`` words, or one word for shorter passages; ``contains``
    then decides. A passage of one or two words has no inner word and is looked for in every whole text.
    """
    n = F.size(F.filter(F.split("passage", r"\s+"), lambda x: x != ""))
    texts = passages.select("question_id", F.col("text").alias("passage")).withColumn("_n", n)
    long, short = F.col("_n") >= size + 2, (F.col("_n") >= 3) & (F.col("_n") < size + 2)
    found = None
    for pick, length in ((long, size), (short, 1)):
        key = F.element_at(T.shingle_keys(F.col("passage"), length), 2)
        wanted = texts.filter(pick).select("question_id", key.alias("key"))
        held = documents.select("doc_id", F.explode(F.array_distinct(T.shingle_keys(F.col("text"), length))).alias("key"))
        part = held.join(wanted, "key").select("question_id", "doc_id")
        found = part if found is None else found.unionByName(part)
    checked = found.distinct().join(texts.drop("_n"), "question_id").join(documents.select("doc_id", "text"), "doc_id")
    checked = checked.filter(F.contains("text", F.col("passage"))).select("question_id", "doc_id")
    tiny = texts.filter(F.col("_n") < 3).join(documents.select("doc_id", "text"), F.contains("text", F.col("passage")))
    return checked.unionByName(tiny.select("question_id", "doc_id").distinct())


def seeds(question_tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose name contains a question token or is contained in one; candidates meet on a shared gram."""
    words = question_tokens.select("question_id", F.explode("tokens").alias("token"))
    vocabulary = words.select("token").distinct()
    names = entities.select("entity", "name").distinct()
    token_in_name = vocabulary.withColumn("gram", T.lead_gram(F.col("token"))).join(
        names.withColumn("gram", F.explode(T.all_grams(F.col("name")))), "gram"
    ).filter(F.contains("name", F.col("token")))
    name_in_token = names.withColumn("gram", T.lead_gram(F.col("name"))).join(
        vocabulary.withColumn("gram", F.explode(T.all_grams(F.col("token")))), "gram"
    ).filter(F.contains("token", F.col("name")))
    pairs = token_in_name.select("token", "entity").unionByName(name_in_token.select("token", "entity")).distinct()
    return words.join(pairs, "token").select("question_id", "entity").distinct()


def case_quality(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question with a known answer: is an expected document among the results, and is every result cited?"""
    hits = results.join(expected, ["question_id", "doc_id"], "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("_h"))
    cited = results.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_results"))
    cases = expected.select("question_id").distinct()
    return cases.join(hits, "question_id", "left").join(cited, "question_id", "left").select(
        "question_id", F.col("_h").isNotNull().alias("hit"), F.coalesce("n_results", F.lit(0)).alias("n_results")
    )
