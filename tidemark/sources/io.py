"""Scans and sinks for CSV, JSON, text, parquet and content manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import bind

PIECE = 1 << 22  # bytes of a file held at once


def wide_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Wide survey file: the schema is given by name, whatever the order of the header; only the wanted columns are parsed."""
    return spark.read.schema(_by_header(spark, path, schema)).option("header", True).csv(path).select(*columns)


def _by_header(spark: SparkSession, path: str, schema: str, nested: bool = False) -> T.StructType:
    """The fields of ``schema`` in the order of the file's header; a column it does not name is text. ``nested``: no partition columns."""
    known = {f.name: f for f in T._parse_datatype_string(schema).fields}
    header = [c.lstrip("\ufeff") for c in spark.read.option("header", True).option("recursiveFileLookup", nested).csv(path).columns]
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])


def checked_csv(spark: SparkSession, path: str, schema: str, required: set[str]) -> DataFrame:
    """Rows with ``_corrupt`` (the raw text of a row that does not fit the schema), ``_file`` and ``_row``.

    Required columns are tested on the header before any row is read. A UTF-8 byte order mark is tolerated."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(required - {c.lstrip("\ufeff") for c in header})
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    full = _by_header(spark, path, schema).add("_corrupt", "string")
    return (
        spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
        .option("columnNameOfCorruptRecord", "_corrupt").csv(path)
        .withColumn("_file", F.col("_metadata.file_name")).withColumn("_row", F.monotonically_increasing_id())
    )


def json_arrays(spark: SparkSession, path: str, schema: str, whole_file: bool = False) -> DataFrame:
    """JSON lists become rows; an unreadable or absent file is an empty frame."""
    try:
        return spark.read.schema(schema).option("multiLine", whole_file).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:  # an absent path is the only case Spark raises for here
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file name and whole text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def header_metadata(text) -> "F.Column":
    """``key: value; key: value`` lines before the first ``## `` section as a map (the last of equal keys wins)."""
    header = F.element_at(F.split(text, "\n## "), 1)
    pairs = F.flatten(F.transform(
        F.filter(F.split(header, "\n"), lambda line: line.contains(":")),
        lambda line: F.split(F.regexp_replace(F.trim(line), r"^[#\s]+", ""), r"[;；]\s*"),
    ))
    kept = F.filter(pairs, lambda p: p.contains(":"))
    entries = F.transform(
        kept,
        lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value")),
    )
    # later entries replace earlier ones without relying on the session's map-key policy
    last = bind(entries, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["key"] == e["key"])))
    return F.map_from_entries(last)


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """``## `` sections with title and body; a text without such headings is one section.

    Sections without a body or with a ``source:`` title are dropped, positions stay.
    """
    pieces = F.split(F.col(text), "\n## ")
    parts = F.when(F.size(pieces) > 1, F.slice(pieces, 2, 2147483647)).otherwise(pieces)
    rows = df.select("*", F.posexplode(parts).alias("section_no", "_part"))
    rows = rows.withColumn("_part", F.regexp_replace("_part", r"^\s+", ""))
    title = F.trim(F.regexp_replace(F.substring_index("_part", "\n", 1), "^[# ]+", ""))
    body = F.trim(F.when(F.instr("_part", "\n") > 0, F.regexp_replace("_part", r"^[^\n]*\n", "")).otherwise(""))
    out = rows.withColumn("title", title).withColumn("body", body).drop("_part")
    return out.filter((F.col("body") != "") & ~F.startswith("title", F.lit("source:")))


def expand_registry(families: DataFrame, levels: list[str]) -> DataFrame:
    """family x topics -> one record per topic with positional evidence level and id."""
    topics = families.select("*", F.posexplode("topics").alias("_i", "topic"))
    level = F.element_at(F.array(*[F.lit(x) for x in levels]), F.pmod(F.col("_i"), F.lit(len(levels))) + 1)
    return topics.select(
        F.concat(F.col("family"), F.lit("_curated_"), F.lpad((F.col("_i") + 1).cast("string"), 2, "0")).alias("source_id"),
        "family", "topic", level.alias("evidence_level"), F.when(F.col("_i") == 0, 2025).otherwise(2024).alias("publication_year"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace: new rows win, old rows of other keys stay."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    best = F.max_by(F.struct(*rest), F.col("_v"))
    return both.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema: columns absent on one side are NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def write_report(df: DataFrame, path: str, form: str = "json") -> str:
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)
    return path


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path under the folder, bytes, sha256) of every file; executors read a file in pieces into one running digest.

    Spark lists the files, the contents never become a row: a task holds ``PIECE`` bytes, whatever the size of a file. Files are
    spread over the tasks. The folder must be one that ``pyarrow.fs`` can open (local, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    tasks = spark.sparkContext.defaultParallelism

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            yield files.assign(sha256=[_digest(p) for p in files["path"]])

    hashed = files.repartition(tasks, "path").mapInPandas(digests, "path string, bytes long, sha256 string")
    return hashed.select(_below(F.col("path"), path).alias("path"), "bytes", "sha256")


def _digest(path: str) -> str:
    """Hash of one file as Spark names it (scheme, then an unescaped path)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        system, name = fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    digest = hashlib.sha256()
    with system.open_input_stream(name) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def _below(path: Column, folder: str) -> Column:
    """The part of a file's name below the folder; the plain name where the folder is the file itself."""
    def plain(c: Column) -> Column:
        return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")

    root = F.concat(F.rtrim(plain(F.lit(folder)), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(plain(path), root), F.substr(plain(path), F.length(root) + 1)).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def artifact_manifest(spark: SparkSession, path: str, target: str, form: str = "csv") -> DataFrame:
    """The file manifest with n_total (rows) and n_positive (rows whose ``target`` is 1 as a number) of each data file.

    A target that is missing or no number is not positive; files without a row count 0."""
    reader = spark.read.option("recursiveFileLookup", True).option("header", True) if form == "csv" else spark.read.option("recursiveFileLookup", True)
    rows = reader.format(form).load(path).select(F.col("_metadata.file_path").alias("_file"), F.col(target).try_cast("double").alias("_y"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_y") == 1).alias("n_positive"))
    # file_path is escaped like a URI, where a plus sign stands for itself
    named = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    counts = counts.select(_below(named, path).alias("path"), "n_total", "n_positive")
    return file_manifest(spark, path).join(counts, "path", "left").select(
        "path", "bytes", "sha256", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_total", "n_positive")]
    )
