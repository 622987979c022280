"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, embed, extract, lines, minhash, mix, quality, rank, secrets, tokens, urls, warc, whiten
from tidemark.llm.common import ready, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix.mix_shares(tables(spark, sf_dir, "documents"))


@query("op2_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files."""
    return tokens.read_documents(tokens.write_ids(tables(spark, sf_dir, "documents")))


@query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = tables(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


@query("op4_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judge(tables(spark, sf_dir, "pages"))


@query("op5_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = tables(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, tables(spark, sf_dir, "labels")))


@query("op6_decontamination")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best covered benchmark item of every document."""
    docs = tables(spark, sf_dir, "documents")
    return decontaminate.contaminated(docs, tables(spark, sf_dir, "benchmark")).drop("mark")


@query("op7_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses."""
    return lines.dedup_lines(tables(spark, sf_dir, "documents")).drop("mark")


@query("op8_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embed.near_vectors(tables(spark, sf_dir, "embeddings"))


@query("op9_main_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(tables(spark, sf_dir, "pages"))


@query("op10_minhash_dedup")
def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy component of every document."""
    return minhash.near_duplicates(tables(spark, sf_dir, "documents")).drop("mark")


RECORDS_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 1000
"""


@query("op11_warc_bundles", RECORDS_SQL)
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the bundles."""
    records = warc.read_archive(warc.write_archive(tables(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS every FROM sizes),
post AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
stats AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), whole),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // every)))) AS BIGINT) AS score
  FROM asked JOIN post USING (term) JOIN stats USING (term) JOIN sizes USING (doc_id), whole GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_search", SEARCH_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = rank.search(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector."""
    return whiten.whiten(tables(spark, sf_dir, "embeddings"))
