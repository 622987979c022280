"""True line numbers of text files that Spark reads in splits, and the lines that do not fit their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.io import _by_header, _below

CORRUPT = "_corrupt"


def numbered_lines(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """(file, line, text) of the lines that fit ``wanted`` (a condition on ``text``; all, if absent); lines count from 1 in each file.

    A line belongs to the split it starts in. Splits count their lines, the sums of the splits before give the offset, and the position
    inside a split follows from Spark's own row ids, which rise along it. Only wanted lines meet the offsets; a window sees one row per split.
    Empty lines count. A compressed file is one split.
    """
    scan = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"),
    )
    splits = scan.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start")) - F.col("_n")
    offsets = splits.select("_path", "_start", (before - F.col("_first") + 1).alias("_offset"))
    kept = scan if wanted is None else scan.filter(wanted)
    # file_path is escaped like a URI, where a plus sign stands for itself
    name = _below(F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B"))), path)
    return kept.join(offsets, ["_path", "_start"]).select(name.alias("file"), (F.col("_id") + F.col("_offset")).alias("line"), "text")


def bad_csv_lines(spark: SparkSession, path: str, schema: str, required: set[str]) -> DataFrame:
    """(file, line, text) of the lines that do not fit ``schema``; line 1 of every file is its header, blank lines are no rows.

    Required columns are tested on the header before any row is read. A record is a line: quoted line ends are not joined.
    """
    fields = _by_header(spark, path, schema, nested=True)
    missing = sorted(required - set(fields.names))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {CORRUPT} string"
    parsed = F.from_csv("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    wanted = (F.trim("text") != "") & parsed[CORRUPT].isNotNull()
    return numbered_lines(spark, path, wanted).filter("line > 1")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, problem) of lines that hold no JSON list: ``malformed`` or ``not_a_list``; blank lines are passed over."""
    parsed = F.try_parse_json("text")
    listed = F.startswith(F.ltrim("text"), F.lit("["))
    found = numbered_lines(spark, path, (F.trim("text") != "") & (parsed.isNull() | ~listed))
    return found.withColumn("problem", F.when(F.try_parse_json("text").isNull(), "malformed").otherwise("not_a_list"))
