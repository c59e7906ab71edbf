"""The pipeline's stages, one by one, against what each operator decides."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessella.llm.sentencepiece_codec import Vocabulary
from tests.llm.test_native_ops import brute_lines
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (90_003, "12345 !!", None, "s", 8)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        got = sorted((r.doc_id, r.text) for r in after.collect())
        if name == "language_id":
            assert {d for d, _ in rows} - {d for d, _ in got} == {90_001, 90_002, 90_003}
        if name == "line_dedup":
            assert got == sorted((d, t) for d, t, *_ in brute_lines(rows) if t.strip())
        if name == "near_dedup":
            kept = {d for d, _, _, ok in brute(rows, 5) if ok}
            assert got == sorted((d, t) for d, t in rows if d in kept)
        if name == "mixing":
            lost = {d for d, _ in rows} - {d for d, _ in got}
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1 or quality = 0").collect()}
            labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert lost and len((lost & labelled) - bad) <= 2
        before = after
    vocabulary = Vocabulary.load()
    encoded = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: vocabulary.decode(r.ids) for r in encoded} == texts
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.filter(F.col("n_tokens") != F.size("ids")).count() == 0
