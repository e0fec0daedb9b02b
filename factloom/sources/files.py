"""Landed files as DataFrames: raw documents, JSON facts, JSON lines and other formats.

Fetching is not Spark's work: files are landed by whatever fetches them, and a stream's admission
control (``maxFilesPerTrigger``) paces how fast they are taken up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Benchmark questions.
QUESTIONS = (
    "id string, tier int, question string, gold_answer string, gold_numeric double, gold_unit string, canonical_concept string, ticker_filters array<string>, year_filters array<int>, "
    "gold_citations array<struct<accession_number: string, section: string>>, tags array<string>"
)


def raw_files(spark: SparkSession, path: str, glob: str = "*.htm*") -> DataFrame:
    """(path, content, sha256, text): whole files as bytes and as UTF-8 text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def raw_stream(spark: SparkSession, path: str, glob: str = "*.htm*", files_per_trigger: int = 8) -> DataFrame:
    """The same as a stream that takes up to ``files_per_trigger`` files at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): one JSON document per file, unparsed, for :func:`factloom.operators.ingest.flatten_facts`."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, first: int | None = None) -> DataFrame:
    """Rows of JSON lines with an explicit schema; malformed lines are left out.

    ``first`` keeps the first lines of a single file, in file order (the small suite of a benchmark).
    """
    if first is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    return lines.orderBy("_at", "_n").limit(first).select(F.from_json("value", schema).alias("x")).select("x.*")


def read_any(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """parquet, orc, json, csv, text or binaryFile, with the format's own options."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
