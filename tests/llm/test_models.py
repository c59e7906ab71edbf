"""Language identification and SentencePiece coding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.langid import UND, LanguageModel, fit, identify
from tessella.llm.sentencepiece_codec import MARK, Vocabulary, decode, encode

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def full_viterbi(v, text):
    """Score of the best segmentation, over the whole text at once."""
    if not text:
        return 0.0
    text = (" " + text).replace(MARK, "\0").replace(" ", MARK)
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - v.longest), e):
            if text[s:e] in v.pieces:
                best[e] = max(best[e], best[s] + v.pieces[text[s:e]][1])
        if text[e - 1] not in v.pieces:
            best[e] = max(best[e], best[e - 1] + v.fallback)
    return best[-1]


def score_of(v, ids):
    by_id = {i: s for i, s in v.pieces.values()}
    total, run = 0.0, bytearray()
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            run.append(v.of_byte[i])
    return total + v.fallback * len(run.decode())


TEXTS = ["Hello world", " two  spaces ", "\n\nnew\nlines\n", f"a{MARK}b {MARK}", "😀 emoji é", "", "x" * 500, "ab" * 3000, " " * 100, "tab\there", "internationalisation of antidisestablishmentarianism"]


def test_viterbi_is_optimal_and_round_trips(vocabulary):
    for text in TEXTS:
        ids = vocabulary.encode(text)
        assert vocabulary.decode(ids) == text
        assert score_of(vocabulary, ids) == pytest.approx(full_viterbi(vocabulary, text))
        streamed = list(vocabulary.stream(" " + text)) if text else []
        assert score_of(vocabulary, streamed) == pytest.approx(score_of(vocabulary, ids))


def test_stream_keeps_a_bounded_window(vocabulary, monkeypatch):
    windows = []
    converged = Vocabulary._converged
    monkeypatch.setattr(Vocabulary, "_converged", staticmethod(lambda back, live: (windows.append(len(back)), converged(back, live))[1]))
    text = "abcdefghij" * 5000
    assert vocabulary.decode(list(vocabulary.stream(" " + text))) == text
    assert max(windows) <= 6 * vocabulary.longest


def test_vocabulary_whose_pieces_cross_spaces_streams_whole_texts():
    pieces = {p: (300 + i, s) for i, (p, s) in enumerate([(MARK, -3.0), ("a", -2.0), ("b", -2.0), (f"a{MARK}b", -1.0), ("ab", -3.5)])}
    v = Vocabulary(pieces, list(range(256)), [None] * 300 + [p.replace(MARK, " ") for p in pieces])
    assert v.cuts is None
    for text in ("a b", "ab a b", "a b" * 400, "ba ab"):
        assert v.decode(v.encode(text)) == text
        assert score_of(v, v.encode(text)) == pytest.approx(full_viterbi(v, text))


def test_remembered_cuts_are_bounded_and_a_mark_in_a_text_is_no_null_character(vocabulary, monkeypatch):
    text = " ".join(f"w{i % 7} x{i % 11}, {'long' * 15}{i}" for i in range(60))
    ids = vocabulary.encode(text)
    monkeypatch.setattr("tessella.llm.sentencepiece_codec.CACHE_CUTS", 5)
    vocabulary.forget()
    assert vocabulary.encode(text) == ids == list(vocabulary.stream(" " + text)) and 0 < len(vocabulary.cache) <= 5
    vocabulary.forget()
    pieces = {p: (300 + i, s) for i, (p, s) in enumerate([(MARK, -3.0), ("a", -2.0), ("b", -2.0), ("a\0b", -1.0)])}
    v = Vocabulary(pieces, list(range(256)), [None] * 300 + [p.replace(MARK, " ") for p in pieces])
    assert v.encode(f"a{MARK}b") == [300, 301, *MARK.encode(), 302] and v.encode("a\0b") == [300, 303]


def test_encode_and_decode_tables(spark, vocabulary):
    rows = [(1, "Some text.", "n"), (1, "Some text.", "n"), (None, None, "n"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df, vocabulary)
    assert [(r.doc_id, r.n_tokens > 0, r.exact) for r in out.collect()] == [(1, True, True), (1, True, True), (None, False, True), (2, False, True)]
    assert [r.text for r in decode(out, vocabulary).collect()] == ["Some text.", "Some text.", "", ""]
    assert encode(df.limit(0), vocabulary).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert encode(docs, vocabulary).filter("not exact").count() == 0


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") > 60)
    model = fit(docs, usable=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    assert model.languages == ["de", "en", "es", "fr"]
    held = [r for r in identify(docs, model, carry=["doc_id", "lang"]).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.01
    assert all(0 <= r.score <= 1 for r in held)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "Привет, как твои дела сегодня, мой друг?", "x"), (5, "the and of that " * 50_000, "x")]
    out = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == [UND] * 3 and all(out[i].rejected for i in (1, 2, 3, 4))
    assert out[5].lang_pred == "en"


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = fit(df)
    assert identify(df, model).first().lang_pred == UND
    assert identify(df.limit(0), LanguageModel.fit({"en": ["some words"]}, {})).count() == 0


def test_ranks_become_scores_that_cut_like_the_vocabulary(vocabulary):
    """About as many ids as merging gives, and a tie keeps the path whose last piece begins first."""
    import public_tokenizers
    import pyarrow.parquet as pq
    import sentencepiece

    texts = [t for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() if t][:60]
    merged = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode(texts, num_threads=1)
    assert abs(sum(len(vocabulary.encode(t)) for t in texts) / sum(map(len, merged)) - 1) < 0.03
    pieces = {p: (300 + i, s) for i, (p, s) in enumerate([(MARK, -1.0), ("a", -1.0), ("aa", -1.0)])}
    v = Vocabulary(pieces, list(range(256)), [None] * 300 + [p.replace(MARK, " ") for p in pieces])
    assert v.encode("aaa") == [300, 301, 302]


def test_language_model_against_dictionaries():
    """Interpolated Kneser-Ney probabilities from plain dictionaries of character tuples."""
    from collections import Counter

    from tessella.llm.langid import ORDER, KneserNey, chains, normalise

    gap = [32] * ORDER
    points = np.array(gap + [int(x) for t in ("the cat sat on the mat", "a hat that the bat had") for x in [*normalise(t), *gap]], np.uint32)
    start = ORDER - 1
    grams = {o: Counter(tuple(points[i - o + 1 : i + 1]) for i in range(start, len(points))) for o in range(1, ORDER + 1)}
    counts = {ORDER: grams[ORDER]} | {o: Counter(g[1:] for g in grams[o + 1]) for o in range(1, ORDER)}

    def probability(gram):
        p = 1 / (len(counts[1]) + 1)
        for o in range(1, ORDER + 1):
            c, g = counts[o], gram[-o:]
            once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
            d = once / (once + 2 * twice) if once else 0.5
            same = [v for k, v in c.items() if k[:-1] == g[:-1]]
            if same:
                p = max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p
        return p

    model, g = KneserNey.fit(points), chains(points)
    at = np.arange(ORDER, len(points))
    found = model.probability([x[at] for x in g], [x[at - 1] for x in g])
    wanted = [probability(tuple(points[i - ORDER + 1 : i + 1])) for i in at]
    assert np.allclose(found, wanted)
