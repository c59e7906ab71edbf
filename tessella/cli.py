"""Command line: python -m tessella.cli encode|decode|compare SOURCE TARGET.

encode: a folder of PNM or PAM files becomes JPEG-LS files; decode: a
folder of JPEG-LS files becomes PNM files; compare: images of two folders
of PNM, PAM or JPEG-LS files, by file name.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import corpus
from tessella.sources import register


def load(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(image_id, name, bits_per_sample, component, y, samples); image_id is a hash of the file's name without its ending."""
    files = spark.read.format(kind).load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.withColumn("name", name).withColumn("image_id", F.xxhash64("name"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("command", choices=("encode", "decode", "compare"))
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--format", default=None, help="of the source files: pnm, pam, bmp or jls")
    p.add_argument("--target-format", default=None, help="compare: of the target files")
    p.add_argument("--interleave", choices=("none", "line", "sample"), default=None)
    p.add_argument("--near", type=int, default=0)
    p.add_argument("--color-transform", type=int, choices=range(4), default=0)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    register(spark)
    kind = a.format or ("jls" if a.command == "decode" else "pnm")
    lines = load(spark, a.source, kind)
    if a.command == "compare":
        out = corpus.compare(lines, load(spark, a.target, a.target_format or kind))
        out.show(100, truncate=False)
        return out
    options = {"near": str(a.near), "colortransform": str(a.color_transform)} | ({"interleave": a.interleave} if a.interleave else {})
    # Images of one sample width are written together.
    for (bits,) in lines.select("bits_per_sample").distinct().collect():  # at most fifteen widths
        part = lines.filter(F.col("bits_per_sample") == bits).select("image_id", "component", "y", "samples").repartition("image_id")
        part.write.format("jls" if a.command == "encode" else "pnm").mode("append").options(bits=str(bits), **options).save(a.target)
    return None


if __name__ == "__main__":
    main()
