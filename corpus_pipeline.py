"""Corpus preparation: language ID, line dedup, near-dedup, mixing, SentencePiece encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, line_dedup, mixing, neardup
from tessella.llm.common import broadcast_if, materialize
from tessella.llm.sentencepiece_codec import Vocabulary, encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the models; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text no language model accepts; lang becomes the predicted language."""
    model = langid.fit(docs)
    out = langid.identify(docs, model, carry=["doc_id", "text", "source", "n_chars"])
    return out.filter(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share, everywhere but in one document; documents left without any text go."""
    out = line_dedup.line_dedup(docs, carry=["lang", "source"])
    out = out.filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    copies = materialize(neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(broadcast_if(copies, copies.count(), neardup.BROADCAST_IDS), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins poor and toxic documents to the target token shares; good ones all stay, none is repeated."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mixing.mix(docs, labels, max_rate=1.0, keep="good", anchor="good", carry=["text", "lang", "source", "n_chars"])
    return out.filter("copies > 0").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text."""
    return encode(docs, Vocabulary.load(), carry=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
