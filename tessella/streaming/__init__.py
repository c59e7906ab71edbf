"""Files that arrive in a folder, decoded as a stream.

An extension: the codec itself works on whole images.  binaryFile as a
stream gives each new file once; decoding is stateless by file, so that a
micro-batch is an ordinary distributed decode and a restart repeats only
the files of an uncommitted batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.corpus import PERMISSIVE, decode_images, read_headers


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.jls", files_per_batch: int = 1000) -> DataFrame:
    """(image_id, path, content) of arriving files; image_id is a hash of the path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def decoded_stream(spark: SparkSession, folder: str, mode: str = PERMISSIVE, **options) -> DataFrame:
    return decode_images(image_stream(spark, folder, **options), mode)


def header_stream(spark: SparkSession, folder: str, mode: str = PERMISSIVE, **options) -> DataFrame:
    return read_headers(image_stream(spark, folder, **options), mode)
