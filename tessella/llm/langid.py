"""Language identification with interpolated Kneser-Ney character models.

Each language gets a character model of order ORDER.  Its n-gram tables
are sorted arrays of 64-bit hashes with parallel probabilities, and its
context tables hold the back-off weights.  The n-grams that any language
has seen are also merged into one sorted hash array with a row of
interpolated log-probabilities, so that a text costs one binary search a
character; the few others take the back-off chain.  The language with
the lowest cross-entropy a character wins.

Rejection is calibrated on documents that the models were not fitted on:
the squared deviation of a document's cross-entropy from its language's
mean is regressed on 1 / length, and a text more than `reject_z` such
deviations above the mean is rejected.  The temperature of the reported
posterior is fitted on the same documents.

Texts are lower-cased; every run of non-letters becomes one space.

The models are fitted on a bounded sample of labelled rows
(`docs_per_language` to fit and as many to calibrate, chosen by hash);
prediction reads every whole text, in bounded slices.

Edge cases: null text or one without letters gives `und`, score 0 and
rejected; rows with null labels are not learned from; without any labelled
row every prediction is `und`; repeated rows are predicted alike; ties go
to the smaller language name; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import tidy

ORDER = 5
DOCS_PER_LANGUAGE = 400
REJECT_Z = 8.0
#: Characters scored at once in a worker.
SLICE = 200_000
UND = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text between single spaces; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    body = np.where(letter, points, np.uint32(32))[keep]
    return np.concatenate([[32], body, [] if body[-1] == 32 else [32]]).astype(np.uint32)


def iterate_chains(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order o: hashes of the o-grams that end at every position (of what there is, at the start)."""
    mixed = (points.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    last = mixed
    yield last
    for _ in range(ORDER - 1):
        g = mixed.copy()
        g[1:] += last[:-1] * np.uint64(0xD1342543DE82EF95)
        last = g
        yield last


def chains(points: np.ndarray) -> list[np.ndarray]:
    return list(iterate_chains(points))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


@dataclass
class KneserNey:
    """Sorted hash arrays for each order: gram keys and discounted probabilities; context keys and back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    @staticmethod
    def fit(points: np.ndarray) -> KneserNey:
        start = ORDER - 1
        # Unique grams of an order, each with a position that shows it.  Only three orders' chains are held at a time.
        unique = lambda x: np.unique(x[start:], return_index=True, return_counts=True)
        chain = iterate_chains(points)
        shorter, g = None, next(chain)
        shown = unique(g)
        grams, contexts = [], []
        for o in range(1, ORDER + 1):
            keys, first, counts = shown
            where = first + start
            if o < ORDER:  # continuation counts: distinct characters to the left
                following = next(chain)
                shown = unique(following)
                k, n = np.unique(g[shown[1] + start], return_counts=True)
                keep = np.isin(keys, k)
                keys, where, counts = keys[keep], where[keep], n
            counts = counts.astype(float)
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            context = shorter[where - 1] if o > 1 else np.zeros(len(keys), np.uint64)
            if o < ORDER:
                shorter, g = g, following
            ctx, back = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(back, counts), np.bincount(back)
            grams.append((keys, np.maximum(counts - discount, 0) / total[back]))
            contexts.append((ctx, discount * kinds / total))
        return KneserNey(grams, contexts, 1.0 / (len(grams[0][0]) + 1))

    def probability(self, g: Sequence[np.ndarray], before: Sequence[np.ndarray]) -> np.ndarray:
        """Interpolated probability at positions given their gram hashes g[o - 1] and the gram hashes `before` each position."""
        p = np.full(len(g[0]), self.floor)
        for o in range(1, ORDER + 1):
            context = before[o - 2] if o > 1 else np.zeros(len(p), np.uint64)
            at, hit = _find(self.contexts[o - 1][0], context)
            weight = np.where(hit, self.contexts[o - 1][1][at], 1.0)
            at, seen = _find(self.grams[o - 1][0], g[o - 1])
            p = np.where(seen & hit, self.grams[o - 1][1][at], 0.0) + weight * p
        return p


def _distinct_grams(points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The chains of a text's distinct grams of full order, and those one position before."""
    for last in iterate_chains(points):
        pass
    at = np.unique(last[ORDER:], return_index=True)[1] + ORDER
    found = [(x[at], x[at - 1]) for x in iterate_chains(points)]
    return [x for x, _ in found], [x for _, x in found]


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[KneserNey]
    keys: np.ndarray
    rows: np.ndarray
    mean: np.ndarray | None = None
    spread: tuple[float, float] = (1.0, 1.0)
    temperature: float = 5.0

    @staticmethod
    def fit(texts: dict[str, Sequence[str]], held: dict[str, Sequence[str]]) -> LanguageModel:
        """texts: by language, to fit; held: others, to calibrate."""
        gap = np.full(ORDER, 32, np.uint32)
        points = {k: np.concatenate([gap, *(x for t in v for x in (normalise(t), gap))]) for k, v in texts.items()}
        languages = sorted(k for k, v in points.items() if (v != 32).any())
        models = [KneserNey.fit(points[k]) for k in languages]
        if not languages:
            return LanguageModel([], [], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
        # The grams of each language, then of all, each once with its chain and the chain before it.
        parts = [_distinct_grams(points[k]) for k in languages]
        keys, at = np.unique(np.concatenate([p[0][-1] for p in parts]), return_index=True)
        shown = tuple([np.concatenate([p[side][o] for p in parts])[at] for o in range(ORDER)] for side in (0, 1))
        rows = np.stack([np.log2(m.probability(*shown)) for m in models], axis=1).astype(np.float32)
        model = LanguageModel(languages, models, keys, rows)
        return model._calibrate([(languages.index(k), t) for k in languages for t in held.get(k, ())])

    def _calibrate(self, held: list[tuple[int, str]]) -> LanguageModel:
        total, n = self.totals([t for _, t in held])
        own = np.array([k for k, _ in held], int)
        ok = n > 0
        entropy, n, own = -total[ok] / n[ok, None], n[ok], own[ok]
        best = entropy[np.arange(len(own)), own]
        weight = np.bincount(own, n, len(self.languages))
        self.mean = np.where(weight > 0, np.bincount(own, best * n, len(self.languages)) / np.maximum(weight, 1), np.nan)
        if len(own) >= 20:
            squares = (best - self.mean[own]) ** 2
            design = np.stack([np.ones(len(n)), 1 / n], axis=1)
            # Weighted, as a square's spread follows its size.
            scale = 1 / (0.01 + 10 / n)
            a, b = np.linalg.lstsq(design * scale[:, None], squares * scale, rcond=None)[0]
            self.spread = max(float(a), 0.0025), max(float(b), 1.0)

            def loss(t: float) -> float:
                z = -entropy * t
                z -= z.max(axis=1, keepdims=True)
                return -(z[np.arange(len(own)), own] - np.log(np.exp(z).sum(axis=1))).mean()

            self.temperature = min((0.5, 1, 2, 4, 8, 16, 32), key=loss)
        return self

    def totals(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log2-likelihood by text and language, and characters counted."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        parts: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            points = normalise(text) if text else ()
            if not len(points):
                continue
            n[i] = len(points)
            padded = np.concatenate([np.full(ORDER - 1, 32, np.uint32), points])
            for at in range(0, len(points), SLICE):
                parts.append((i, padded[at : at + SLICE + ORDER - 1]))
                size += len(parts[-1][1])
                if size >= SLICE:
                    self._add(total, parts)
                    parts, size = [], 0
        if parts:
            self._add(total, parts)
        return total, n

    def _add(self, total: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
        points = np.concatenate([p for _, p in parts])
        g = chains(points)
        at, hit = _find(self.keys, g[-1])
        scores = self.rows[at]
        if not hit.all():
            miss = np.nonzero(~hit)[0]
            shown = [x[miss] for x in g], [x[np.maximum(miss - 1, 0)] for x in g]
            scores[miss] = np.stack([np.log2(m.probability(*shown)) for m in self.models], axis=1)
        sizes = np.array([len(p) for _, p in parts])
        starts = np.cumsum(sizes) - sizes
        # The first ORDER - 1 positions of a part only lead in.
        lead = (starts[:, None] + np.arange(ORDER - 1)).ravel()
        scores[lead] = 0
        np.add.at(total, [i for i, _ in parts], np.add.reduceat(scores, starts, axis=0, dtype=np.float64))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in [0, 1], cross-entropy in bits a character, rejected."""
        none = np.zeros(len(texts))
        if not self.languages:
            return [UND] * len(texts), none, none, np.ones(len(texts), bool)
        total, n = self.totals(texts)
        known = n > 0
        entropy = -total / np.maximum(n, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        score = 1 / np.exp((least[:, None] - entropy) * self.temperature).sum(axis=1)
        mean = np.where(np.isnan(self.mean), np.inf, self.mean)[best] if self.mean is not None else np.inf
        bound = np.sqrt(self.spread[0] + self.spread[1] / np.maximum(n, 1))
        rejected = ~known | (least - mean > REJECT_Z * bound)
        names = [self.languages[b] if k else UND for b, k in zip(best, known, strict=True)]
        return names, np.where(known, score, 0.0), np.where(known, least, 0.0), rejected


def fit(docs: DataFrame, usable: Column | None = None, docs_per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on about `docs_per_language` documents of each language, and calibrates on as many others."""
    rows = docs.filter(usable) if usable is not None else docs
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return LanguageModel.fit({}, {})
    span = 1 << 30
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(span, 2 * docs_per_language * span // n + 1))) for k, n in counts.items()])
    # Repeated rows share a hash: one of them is enough, or they would all come.
    sample = rows.filter(F.pmod("h", F.lit(span)) < limit).dropDuplicates(["lang", "h"]).repartition(1)
    # The sample is bounded; one task fits it, so that the driver holds no more than the model.
    return pickle.loads(sample.mapInArrow(tidy(_fit_sample), "model binary").first()["model"])


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text, h) -> one pickled model; every other row of a language, by h, is held out to calibrate."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["text"]))
    fitted, held = {}, {}
    for r in rows:
        (fitted if len(fitted.setdefault(r["lang"], [])) <= len(held.setdefault(r["lang"], [])) else held)[r["lang"]].append(r["text"])
    del rows
    yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(LanguageModel.fit(fitted, held))]})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Returns the `carry` columns, lang_pred, score, cross_entropy and rejected, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"__carry{i}" for i in range(len(carry))]
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names, score, entropy, rejected = shared.value.predict(part.column("__text").to_pylist())
                found = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + found, names=[*kept, "lang_pred", "score", "cross_entropy", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    out = rows.mapInArrow(tidy(predict), T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), *added]))
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "lang_pred", "score", "cross_entropy", "rejected")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs, usable=~F.coalesce(held_out, F.lit(True)))
    return identify(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
