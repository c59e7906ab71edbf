"""Rasters made from relational tables, as one row a line: (image_id, component, y, samples array<int>).

A line a row keeps a window over an image to one sort by y, whatever the
width, and its neighbours are array slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_LINES = 50


def _byte(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1.0) * 127.5))).cast("int")


def embedding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of 50 lines: a vector is a line."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    image, y = F.expr(f"vec_id div {IMAGE_LINES}"), (F.col("vec_id") % IMAGE_LINES).cast("int")
    return e.select(image.alias("image_id"), F.lit(0).alias("component"), y.alias("y"), F.transform("embedding", _byte).alias("samples"))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with three bits a sample, which have runs."""
    return embedding_lines(spark, sf_dir).withColumn("samples", F.transform("samples", lambda s: F.shiftright(s, 5)))


def rgb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components: neighbouring positions are the components of a pixel; the last pixel is padded with zeros."""
    lines = embedding_lines(spark, sf_dir)
    part = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("component")
    lines = lines.select("image_id", part, "y", "samples")
    return lines.withColumn("samples", F.transform(F.sequence(F.lit(0), F.ceil(F.size("samples") / 3).cast("int") - 1), lambda x: F.coalesce(F.get("samples", x * 3 + F.col("component")), F.lit(0))))


def price_lines(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """16-bit images from prices: the rows of 64 order keys are an image, dealt into lines of `width`; the last line is padded with zeros."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sample = (F.round(F.col("l_extendedprice") * 100).cast("long").bitwiseAND(65535)).cast("int")
    rows = rows.select(F.expr("l_orderkey div 64").alias("image_id"), sample.alias("s"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    at = F.row_number().over(Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")) - 1
    placed = rows.select("image_id", F.struct((at % width).alias("x"), "s").alias("p"), F.floor(at / width).cast("int").alias("y"))
    lines = placed.groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]).alias("s"))
    full = F.concat("s", F.array_repeat(F.lit(0), F.lit(width) - F.size("s")))
    return lines.select("image_id", F.lit(0).alias("component"), "y", full.alias("samples"))


def pixels(lines: DataFrame) -> DataFrame:
    """(image_id, component, y, x, sample)."""
    return lines.select("image_id", "component", "y", F.posexplode("samples").alias("x", "sample"))


#: The same rasters for the oracle.
EMB_SQL = f"""
emb AS (SELECT vec_id // {IMAGE_LINES} AS image_id, 0 AS component, (vec_id % {IMAGE_LINES})::INT AS y, (i - 1)::INT AS x,
  least(255, greatest(0, floor((embedding[i]::DOUBLE + 1.0) * 127.5)))::INT AS sample
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i))"""
RUN_SQL = EMB_SQL + ", img AS (SELECT image_id, component, y, x, sample >> 5 AS sample FROM emb)"
RGB_SQL = EMB_SQL + """, wide AS (SELECT image_id, y, x, sample FROM emb
  UNION ALL SELECT image_id, y, n + i, 0 FROM (SELECT image_id, y, count(*) AS n FROM emb GROUP BY 1, 2), LATERAL (SELECT unnest(range(0, (3 - n % 3) % 3)) AS i)),
img AS (SELECT image_id, (x % 3)::INT AS component, y, (x // 3)::INT AS x, sample FROM wide)"""
PRICE_SQL = """
placed AS (SELECT l_orderkey // 64 AS image_id, (round(l_extendedprice * 100)::BIGINT & 65535)::INT AS sample,
  row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS i FROM lineitem),
img AS (SELECT image_id, 0 AS component, (i // 100)::INT AS y, (i % 100)::INT AS x, sample FROM placed
  UNION ALL SELECT image_id, 0, (n // 100)::INT, x::INT, 0 FROM (SELECT image_id, count(*) AS n FROM placed GROUP BY 1), LATERAL (SELECT unnest(range(n % 100, 100)) AS x) WHERE n % 100 > 0)"""
