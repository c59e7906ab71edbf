"""Line dedup across documents (native).

Lines are keyed by their stripped, ASCII-lower-cased form.  A key of at
least min_chars code points that occurs in at least min_docs distinct
documents loses its lines everywhere except in the largest doc_id that
holds it.

Plan: per-document distinct line keys (128-bit hashes) are exploded and
counted with map-side combine, so a line that a third of all documents
share is pre-aggregated before any shuffle.  The keys over the threshold
are a small table; it is broadcast only when its counted size is small,
else the join shuffles and AQE splits its hot keys.  The keys to drop are
gathered per document (bounded by the document's own lines) and the text
is shuffled once, by doc_id, to reassemble by position.

Edge cases: null text is one empty line; a null doc_id counts for no key
and loses no line; rows that repeat a doc_id are one document for the
counts and each keep their own row; an empty table gives an empty
result; columns other than id, text and `carry` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CHARS, broadcast_if, hash128, lower_ascii, materialize

#: A broadcast table of at most this many 40-byte rows.
BROADCAST_ROWS = 100_000


def _key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Returns id, kept text (under text_col), `carry` columns, n_lines and n_dropped (long)."""
    extra = [F.col(f"`{c}`").alias(f"__carry{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), *extra)
    lines = F.split("__text", "\n", -1)
    long_keys = F.filter(F.transform(F.filter(lines, lambda x: F.length(x) >= min_chars), _key), lambda k: F.length(k) >= min_chars)
    occurrences = base.select("__id", F.explode(F.array_distinct(F.transform(long_keys, lambda k: hash128(k)))).alias("__key"))
    frequent = occurrences.groupBy("__key").agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__keeper")).filter(F.col("__n") >= min_docs).select("__key", "__keeper")
    frequent = materialize(frequent, "line-keys")
    drops = (
        occurrences.join(broadcast_if(frequent, frequent.count(), BROADCAST_ROWS), "__key")
        .filter(F.col("__id") != F.col("__keeper"))
        .groupBy("__id")
        .agg(F.collect_set("__key").alias("__drop"))
    )
    keep = F.filter(lines, lambda x: (F.length(x) < min_chars) | ~F.array_contains(F.col("__drop"), hash128(_key(x))))
    joined = base.join(drops, "__id", "left").withColumn("__kept", F.when(F.col("__drop").isNotNull(), keep))
    n_lines = F.size(lines).cast("long")
    return joined.select(
        F.col("__id").alias(id_col),
        F.coalesce(F.array_join("__kept", "\n"), F.col("__text")).alias(text_col),
        *[F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry)],
        n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, lower_key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r,
       LATERAL (SELECT translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key) k
), frequent AS (
  SELECT lower_key, max(doc_id) AS keeper FROM lines WHERE length(lower_key) >= 40
  GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, (f.lower_key IS NOT NULL AND l.doc_id <> f.keeper) AS gone
  FROM lines l LEFT JOIN frequent f ON l.lower_key = f.lower_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
