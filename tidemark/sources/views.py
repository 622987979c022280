"""Study views: the domain inputs built from the given tables, as DataFrames and as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stored

SCHEMAS = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}

AS_OF = "2024-01-31 00:00:00"


def stable_fraction(column) -> "F.Column":
    """SHA-256 of the id, first 12 hex digits as a fraction of 16^12."""
    digits = F.conv(F.substring(F.sha2(column.cast("string"), 256), 1, 12), 16, 10)
    return digits.cast("double") / F.lit(float(16**12))


class Study:
    """Lazy access to tables and views of one data folder. Schemas are given, never inferred."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """A derived table that a query reads several times, written once to the shared folder."""
        return stored(df, name)

    @property
    def measurements(self) -> DataFrame:
        return measurement_rows(self.events)

    @property
    def profile(self) -> DataFrame:
        c = self.customer
        return c.select(
            F.col("c_custkey").alias("id"),
            (50 + F.col("c_custkey") % 45).alias("age"),
            (F.col("c_custkey") % 2).alias("sex"),
            F.col("c_nationkey").alias("site_id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("acctbal"),
            F.round(F.lit(1.5) + (F.col("c_custkey") % 40).cast("double") / 100.0, 2).alias("height"),
        )

    @property
    def panel(self) -> DataFrame:
        waves = (
            self.orders.groupBy(F.col("o_custkey").alias("id"), (F.year("o_orderdate") - 1994).alias("wave"))
            .agg(
                F.count(F.lit(1)).alias("n_orders"),
                F.round(F.sum("o_totalprice"), 2).alias("sum_price"),
                F.max("o_totalprice").alias("max_price"),
                F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"),
                F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("cond"),
            )
        )
        people = self.customer.select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("province"), F.col("c_acctbal").alias("acctbal")
        )
        return waves.join(people, "id")

    @property
    def pred_risk(self) -> DataFrame:
        price = F.col("o_totalprice")
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("y"),
            F.round(1 / (1 + F.exp(-(price - 250000.0) / 120000.0)), 6).alias("p"),
            F.round(1 / (1 + F.exp(-(price - 300000.0) / 60000.0)), 6).alias("p_alt"),
            F.col("o_orderpriority").alias("segment"),
            F.col("o_custkey").alias("participant_id"),
        )

    @property
    def pred_numeric(self) -> DataFrame:
        price = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        fraction = stable_fraction(F.col("l_orderkey"))
        joined = self.lineitem.join(price, "l_partkey")
        predicted = F.col("l_quantity") * F.col("p_retailprice")
        return joined.select(
            F.col("l_orderkey").alias("participant_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_returnflag").alias("metric"),
            F.col("l_linestatus").alias("status_group"),
            F.col("l_suppkey").alias("device"),
            F.when(fraction < 0.7, "train").when(fraction < 0.85, "validation").otherwise("test").alias("split"),
            F.col("l_extendedprice").alias("actual"),
            predicted.alias("predicted"),
            (F.col("l_quantity") * 1400.0).alias("baseline_pred"),
            (predicted * 0.8).alias("lower"),
            (predicted * 1.2).alias("upper"),
            (F.col("l_discount") < 0.09).alias("accepted"),
        )

    @property
    def paired(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_suppkey").alias("participant_id"),
            F.col("l_orderkey").alias("record"),
            F.col("l_linenumber").alias("line"),
            (F.col("l_quantity") * 4.0).alias("high"),
            (F.col("l_discount") * 1500.0).alias("low"),
        )

    @property
    def chunks(self) -> DataFrame:
        lines = self.documents.select(
            "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text")
        )
        return lines.filter(F.col("text") != "").select(
            F.concat_ws("#", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("chunk_id"),
            "doc_id",
            "line",
            F.col("lang").alias("topic"),
            "source",
            (F.substring("source", 4, 9).cast("int") % 5).alias("authority"),
            "text",
        )

    @property
    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("question_id"), "text")

    @property
    def edges(self) -> DataFrame:
        source, target = (F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")) for kind, c in (("supplier", "source"), ("part", "target")))
        return self.numbered_edges.withColumns({"source": source, "target": target})

    @property
    def numbered_edges(self) -> DataFrame:
        """The edges with numbers in place of the names of their two ends: grouped, shuffled and joined, numbers cost far less."""
        kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
        grouped = self.lineitem.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), kind.alias("kind")).agg(
            F.max("l_quantity").alias("weight"), F.min("l_linenumber").alias("section")
        )
        digits = F.regexp_extract(F.concat(F.lit(":"), F.col("target").cast("string")), r":(\d+)$", 1)
        number = F.when(F.col("target") >= 0, F.col("target")).otherwise(digits.cast("long"))
        return grouped.select(
            "source",
            "target",
            F.when(F.col("kind") == 1, "increases_risk_of").when(F.col("kind") == 2, "protective_against").otherwise("mentions").alias("type"),
            F.when(F.col("weight") >= 40, "high").when(F.col("weight") >= 20, "moderate").otherwise("low").alias("strength"),
            F.concat(F.lit("src"), (number % 20).cast("string"), F.lit("#"), F.col("section").cast("string")).alias("evidence"),
        )

    @property
    def messages(self) -> DataFrame:
        return self.conversations.select(
            F.col("conv_id").alias("user_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content")
        )


def measurement_rows(events: DataFrame) -> DataFrame:
    """Measurement columns of a raw event feed (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    conditions = F.array(*[F.lit(c) for c in ("fasting", "postprandial_2h", "random", "unknown")])
    sources = F.array(*[F.lit(c) for c in ("manual", "device", "clinic", "laboratory", "synthetic")])
    return events.select(
        F.col("event_id").alias("measurement_id"),
        F.col("user_id").alias("participant_id"),
        F.col("event_type").alias("metric"),
        "value",
        "ts",
        k.alias("k"),
        F.element_at(conditions, (k % 4) + 1).alias("condition"),
        F.element_at(sources, (k % 5) + 1).alias("source"),
        (F.col("user_id") % 3).alias("site_id"),
        (F.col("user_id") % 7).alias("region_id"),
    )


_FRACTION = "(CAST('0x' || substr(sha256(CAST({0} AS VARCHAR)),1,12) AS BIGINT) / 281474976710656.0)"

VIEWS = {
    "measurements": """
        SELECT event_id AS measurement_id, user_id AS participant_id, event_type AS metric, value, ts,
               CAST(json_extract_string(props,'$.k') AS INTEGER) AS k,
               ['fasting','postprandial_2h','random','unknown'][CAST(json_extract_string(props,'$.k') AS INTEGER)%4+1] AS condition,
               ['manual','device','clinic','laboratory','synthetic'][CAST(json_extract_string(props,'$.k') AS INTEGER)%5+1] AS source,
               user_id % 3 AS site_id, user_id % 7 AS region_id
        FROM events""",
    "profile": """
        SELECT c_custkey AS id, 50 + c_custkey % 45 AS age, c_custkey % 2 AS sex, c_nationkey AS site_id,
               c_mktsegment AS segment, c_acctbal AS acctbal,
               round(1.5 + CAST(c_custkey % 40 AS DOUBLE) / 100.0, 2) AS height
        FROM customer""",
    "panel": """
        SELECT w.*, c_nationkey AS province, c_acctbal AS acctbal FROM (
          SELECT o_custkey AS id, year(o_orderdate) - 1994 AS wave, count(*) AS n_orders,
                 round(sum(o_totalprice),2) AS sum_price, max(o_totalprice) AS max_price,
                 avg(CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END) AS share_f,
                 max(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS cond
          FROM orders GROUP BY 1,2) w JOIN customer ON c_custkey = w.id""",
    "pred_risk": """
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS y,
               round(1/(1+exp(-(o_totalprice-250000.0)/120000.0)),6) AS p,
               round(1/(1+exp(-(o_totalprice-300000.0)/60000.0)),6) AS p_alt,
               o_orderpriority AS segment, o_custkey AS participant_id
        FROM orders""",
    "pred_numeric": f"""
        SELECT l_orderkey AS participant_id, l_linenumber AS line, l_returnflag AS metric,
               l_linestatus AS status_group, l_suppkey AS device,
               CASE WHEN {_FRACTION.format('l_orderkey')} < 0.7 THEN 'train'
                    WHEN {_FRACTION.format('l_orderkey')} < 0.85 THEN 'validation' ELSE 'test' END AS split,
               l_extendedprice AS actual, l_quantity*p_retailprice AS predicted,
               CAST(l_quantity*1400.0 AS DOUBLE) AS baseline_pred,
               CAST(l_quantity*p_retailprice*0.8 AS DOUBLE) AS lower, CAST(l_quantity*p_retailprice*1.2 AS DOUBLE) AS upper,
               l_discount < 0.09 AS accepted
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "paired": """
        SELECT l_suppkey AS participant_id, l_orderkey AS record, l_linenumber AS line,
               CAST(l_quantity*4.0 AS DOUBLE) AS high, CAST(l_discount*1500.0 AS DOUBLE) AS low FROM lineitem""",
    "chunks": """
        SELECT concat_ws('#', CAST(doc_id AS VARCHAR), CAST(line AS VARCHAR)) AS chunk_id, doc_id, line, lang AS topic,
               source, CAST(substr(source,4) AS INTEGER) % 5 AS authority, text
        FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
                     generate_subscripts(string_split(text, chr(10)),1) - 1 AS line FROM documents) x
        WHERE text <> ''""",
    "questions": "SELECT item_id AS question_id, text FROM benchmark",
    "edges": """
        SELECT source, target, type,
               CASE WHEN weight >= 40 THEN 'high' WHEN weight >= 20 THEN 'moderate' ELSE 'low' END AS strength,
               'src' || CAST(CAST(regexp_extract(target, ':(\\d+)$', 1) AS BIGINT) % 20 AS VARCHAR) || '#' || CAST(section AS VARCHAR) AS evidence
        FROM (SELECT 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target,
                     CASE l_returnflag WHEN 'R' THEN 'increases_risk_of' WHEN 'A' THEN 'protective_against' ELSE 'mentions' END AS type,
                     max(l_quantity) AS weight, min(l_linenumber) AS section
              FROM lineitem GROUP BY 1,2,3) g""",
    "messages": "SELECT conv_id AS user_id, turn AS id, role, text AS content FROM conversations",
}


def view_sql(text: str) -> str:
    """Expand ``{view}`` placeholders; ``{fraction:x}`` becomes the stable id fraction of column x."""
    text = re.sub(r"\{fraction:([^}]+)\}", lambda m: _FRACTION.format(m.group(1)), text)
    for name, body in VIEWS.items():
        text = text.replace("{" + name + "}", f"({body.strip()})")
    return text.replace("{as_of}", f"TIMESTAMP '{AS_OF}'")
