"""Ranked lexical search: term-at-a-time scoring with a limited number of accumulators, for a table of queries at once.

Documents are cut into blocks of posting lists. In a block, the terms of a query are taken rarest first. Each adds its weight
to the accumulators of its documents and makes new ones, until the bounds of the terms that remain together cannot reach the
k-th best score known (of finished documents of the task, or a partial one of the block). From then on no accumulator is made, and the
remaining terms bring the existing ones to their exact scores. A document without an accumulator could not have entered the first k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLOCK, binary_lists, discard, ready, run_hashes, store, text_bytes
from tidemark.session import fresh_path

K = 10
#: Terms of one block of queries (a longer query is a block of its own), and postings of one block of documents.
QUERY_TERMS, POSTINGS = 1 << 16, 1 << 21
#: Bits of the filter that keeps terms of no query out of the postings; its size does not follow the queries.
FILTER_BITS = 1 << 24

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RESULT = "query long, row long, doc_id long, score long"


def term_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of all terms of a text in order: runs of ASCII letters and digits and of all characters beyond ASCII.

    Works piece by piece, so that its memory does not follow the length of the text; a piece ends outside terms.
    """
    out, at = [], 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        raw = np.frombuffer(text, np.uint8, end - at, at)
        if end < len(text):
            gaps = np.flatnonzero(~_TERM[raw])
            while not len(gaps):  # one term longer than a block
                end = min(end + BLOCK, len(text))
                raw = np.frombuffer(text, np.uint8, end - at, at)
                gaps = np.flatnonzero(~_TERM[raw]) if end < len(text) else np.array([len(raw) - 1])
            if end < len(text):
                end = at + int(gaps[-1]) + 1
                raw = raw[: end - at]
        inside = np.concatenate([[False], _TERM[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edge):
            out.append(run_hashes(_LOWER[raw], edge[::2], edge[1::2]).view(np.int64))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _slots(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = terms.view(np.uint64)
    return (terms % np.uint64(FILTER_BITS)).astype(np.int64), ((terms >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, text in zip(batch.column("query").to_pylist(), binary_lists(batch.column("text")), strict=True):
            terms = np.unique(term_hashes(text))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), query, np.int64)), pa.array(terms)], ["query", "term"])


def _filter_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for slot in _slots(batch.column("term").to_numpy()):
            bits[slot] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            lengths, terms, times = [], [], []
            for text in binary_lists(batch.column("text")):
                every = term_hashes(text)
                lengths.append(len(every))
                one, two = _slots(every)
                found, tf = np.unique(every[bits[one] & bits[two]], return_counts=True)
                terms.append(found)
                times.append(tf)
            at = np.cumsum([0, *[len(t) for t in terms]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, np.concatenate(terms)),
                 pa.ListArray.from_arrays(at, np.concatenate(times).astype(np.int64))], ["doc_id", "n", "terms", "tf"])

    return run


class Queries:
    """A block of queries: the distinct terms in order, and for each query its terms rarest first."""

    def __init__(self, rows: list):
        self.terms = np.array(sorted({r["term"] for r in rows}), np.int64)
        self.plans = []
        by_query: dict[int, list] = {}
        for r in rows:
            by_query.setdefault(r["query"], []).append(r)
        for query, own in by_query.items():
            own.sort(key=lambda r: (r["df"], r["term"]))
            weight, bound = np.array([r["w"] for r in own], np.int64), np.array([r["bound"] for r in own], np.int64)
            place = np.searchsorted(self.terms, np.array([r["term"] for r in own], np.int64))
            self.plans.append((query, place, weight, int(bound.sum()) - np.cumsum(bound), np.cumsum(bound)))


class Best:
    """The first k results of each query that a task has seen."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, query: int) -> int:
        held = self.held.get(query)
        return int(held[0][self.k - 1]) if held is not None and len(held[0]) >= self.k else 0

    def add(self, query: int, score: np.ndarray, doc: np.ndarray, none: np.ndarray, row: np.ndarray) -> None:
        now = [score, doc, none, row]
        if query in self.held:
            now = [np.concatenate(x) for x in zip(self.held[query], now, strict=True)]
        first = np.lexsort((now[3], now[1], now[2], -now[0]))[: self.k]
        self.held[query] = [x[first] for x in now]


def score_block(queries: Queries, best: Best, term: np.ndarray, owner: np.ndarray, impact: np.ndarray, docs: tuple) -> int:
    """Score one block: postings ``(term, owner, impact)``, where ``owner`` numbers the documents ``(doc_id, is null, row)``.

    Returns the number of accumulators made.
    """
    place = np.searchsorted(queries.terms, term)
    known = place < len(queries.terms)
    known[known] = queries.terms[place[known]] == term[known]
    place, owner, impact = place[known], owner[known], impact[known]
    order = np.argsort(place, kind="stable")
    place, owner, impact = place[order], owner[order], impact[order]
    start = np.searchsorted(place, np.arange(len(queries.terms) + 1))
    n, made = len(docs[0]), 0
    for query, at, weight, rest, upto in queries.plans:
        held, has = np.zeros(n, np.int64), np.zeros(n, bool)
        floor, open_ = best.floor(query), True
        for j in range(len(at)):
            lo, hi = start[at[j]], start[at[j] + 1]
            if lo == hi and not open_:
                continue
            doc, add = owner[lo:hi], weight[j] * impact[lo:hi]
            if open_:
                held[doc] += add
                has[doc] = True
                if rest[j] < upto[j] or rest[j] < floor:  # else no partial score can be above what remains
                    kth = int(np.partition(held, n - best.k)[n - best.k]) if n >= best.k else 0
                    open_ = rest[j] >= max(floor, kth)
            else:
                old = has[doc]
                held[doc[old]] += add[old]
        made += int(has.sum())
        good = np.flatnonzero(has & (held >= max(floor, 1)))
        if len(good) > best.k:
            least = np.partition(held[good], len(good) - best.k)[len(good) - best.k]
            good = good[held[good] >= least]
        if len(good):
            best.add(query, held[good], *[x[good] for x in docs])
    return made


def _score(shared, k: int, n_docs: int, n_terms: int, postings: int = POSTINGS):
    def block(queries: Queries, best: Best, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held)
        term = np.concatenate([c.flatten().to_numpy() for c in table["terms"].chunks])
        tf = np.concatenate([c.flatten().to_numpy() for c in table["tf"].chunks])
        size = np.concatenate([np.asarray(c.value_lengths()) for c in table["terms"].chunks])
        owner = np.repeat(np.arange(table.num_rows), size)
        m = 10 + (90 * table["n"].to_numpy() * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
        doc_id = table["doc_id"].combine_chunks()
        score_block(queries, best, term, owner, impact, (doc_id.fill_null(0).to_numpy(), np.asarray(doc_id.is_null()), table["row"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best, held, size = Queries(shared.value), Best(k), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("terms").flatten())
                if size > postings:
                    block(queries, best, held)
                    held, size = [], 0
        if held:
            block(queries, best, held)
        for query, (score, doc, none, row) in best.held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), query, np.int64)), pa.array(row), pa.array(doc, pa.int64(), mask=none), pa.array(score)],
                ["query", "row", "doc_id", "score"])

    return run


def term_statistics(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``term, df, w, bound``: weight of each query term that occurs, and the most it adds to any document's score."""
    one = postings.select("n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("n", "p.terms", "p.tf")
    one = one.withColumn("m", F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L"))
    found = one.groupBy(F.col("terms").alias("term")).agg(F.count("*").alias("df"), F.expr("max((1000000000L * tf) div (1000 * tf + 8 * m))").alias("top"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return found.select("term", "df", weight.alias("w"), (weight * F.col("top")).alias("bound"))


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents of each query with a score above 0: ``query, item_id, rank, doc_id, score``.

    ``docs``: ``doc_id, text``; ``queries``: ``item_id, text``; other columns are not touched. Every row of either table is a document or query
    of its own, also where ids repeat or are null (``query`` numbers the rows). Equal scores go by ascending doc_id, null last, then by row.
    Null and empty texts have no terms: such documents do not count and are never found, such queries give no row. Empty tables give no row.

    One pass over the texts makes the postings of query terms; texts are not moved. Queries are taken in blocks of at most
    ``QUERY_TERMS`` terms, each against all postings; the driver holds one block. A task gives at most ``k`` rows per query.
    """
    spark = ready(docs.sparkSession)
    asked = store(queries.select("item_id", F.monotonically_increasing_id().alias("query"), text_bytes("text").alias("text")), "queries")
    terms = store(asked.mapInArrow(_query_terms, "query long, term long"), "query-terms")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in terms.select("term").distinct().coalesce(8).mapInArrow(_filter_part, "bits binary").toLocalIterator():
        bits |= np.frombuffer(part["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())  # always FILTER_BITS / 8 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    postings = texts.mapInArrow(_postings(shared), "doc_id long, n long, terms array<long>, tf array<long>").where("n > 0")
    postings = store(postings.select(F.monotonically_increasing_id().alias("row"), "*"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    stats = term_statistics(postings, n_docs, max(n_terms, 1))
    known = store(terms.join(stats, "term"), "weighted-terms")
    sizes = known.groupBy("query").agg(F.count("*").alias("size"))
    path = fresh_path(spark, "ranked")
    spark.createDataFrame([], _RESULT + ", rank int").write.parquet(path)
    for low, high in _blocks(sizes):
        rows = [r.asDict() for r in known.where(F.col("query").between(low, high)).collect()]  # at most QUERY_TERMS, or one query
        block = spark.sparkContext.broadcast(rows)
        scored = postings.select("row", "doc_id", "n", "terms", "tf").mapInArrow(_score(block, k, n_docs, n_terms), _RESULT)
        _best(scored, k).write.mode("append").parquet(path)
        block.destroy()
    discard(postings, known, terms)
    found = spark.read.schema(_RESULT + ", rank int").parquet(path)
    return found.join(asked.select("query", "item_id"), "query").select("query", "item_id", "rank", "doc_id", "score")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _blocks(sizes: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of query numbers with at most ``QUERY_TERMS`` terms together (at least one query each), read one by one."""
    low, high, held = None, None, 0
    for row in sizes.orderBy("query").toLocalIterator():
        if low is not None and held + row["size"] > QUERY_TERMS:
            yield low, high
            low, held = None, 0
        low = row["query"] if low is None else low
        high, held = row["query"], held + row["size"]
    if low is not None:
        yield low, high
