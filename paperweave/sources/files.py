"""Files and stores: converted papers, resource identity, insert-if-absent tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

BINARY = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def resource_key(path: Column) -> Column:
    """The file's stem, by which a resource is known."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), F.lit(""))


def scan_directory(spark: SparkSession, directory: str, pattern: str = "*.pdf", checksum: bool = False) -> DataFrame:
    """(resource_key, path, length) of the matching files of one directory, with the SHA-1 of the bytes on request."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(directory)
    columns = [resource_key(F.col("path")).alias("resource_key"), "path", "length"]
    return files.select(*columns, *([F.sha1("content").alias("sha1")] if checksum else []))


def read_converted(spark: SparkSession, directory: str, pattern: str = "*.html") -> DataFrame:
    """(doc_id, html) of converted papers, one whole file a row."""
    text = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(directory)
    return text.select(resource_key(F.input_file_name()).alias("doc_id"), F.col("value").alias("html"))


def stream_directory(spark: SparkSession, directory: str, pattern: str = "*.html", per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return reader.format("text").load(directory).select(resource_key(F.input_file_name()).alias("doc_id"), F.col("value").alias("html"))


def absent(new: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key is not known yet, each key once; do this before any costly parse."""
    return new.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def present(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    return rows.join(known.select(*keys), list(keys), "left_semi")


def insert_if_absent(new: DataFrame, path: str, *keys: str) -> None:
    """Append what a parquet table does not hold yet."""
    spark = new.sparkSession
    try:
        known = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.dropDuplicates(list(keys)).write.parquet(path)
        return
    absent(new, known, *keys).write.mode("append").parquet(path)
