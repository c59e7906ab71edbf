"""Mixing sources to target weights by soft domain membership (native).

A naive Bayes classifier, counted on labelled documents, gives every
document a posterior over domains.  Its features are which hashed words a
text has, the ends of its words, and whether it shouts.  Regularised
least squares then finds document rates whose expected domain token
totals, t_k = sum_d r_d tokens_d p_dk, match the targets b_k: of the rates
in [0, max_rate] (in [1, max_rate] for documents that most likely belong
to `keep`) with the least (t - b)' M^-1 (t - b), M_kl = sum_d tokens_d
p_dk p_dl, it takes those nearest to 1 in the norm weighted by tokens_d.
They have the form r_d = clip(1 - p_d . x) for one vector x of K numbers,
the minimum of a convex function whose value, gradient and second
derivative are sums over documents.  Damped Newton steps find it to
SOLVED of the budget, along falling regularisation, so that targets that
the bounds do not allow end at their least squares too.  A step is one
distributed aggregation that tries several dampings and lengths at once;
nothing is gathered by document.  Totals that miss a target by more than TOLERANCE of the budget
raise a MixingWarning that lists them.

Rates become whole copies by a hash of the document: floor(r) and one
more with probability r - floor(r).

The classifier is fitted on at most about `fit_rows` labelled rows chosen
by hash; posteriors, totals and rates cover every document.  Its table
has 2**BUCKET_BITS buckets a domain whatever the corpus.

Edge cases: null text counts as empty: no tokens, prior posteriors; null
and repeated ids keep their rows (equal rows get equal copies); null
labels are not learned from; domains without a labelled document are
left out and the other targets scaled up; without any labelled document
every rate is 1; an empty table gives an empty result; other columns are
ignored except `carry`.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CHARS, materialize

BUCKET_BITS = 14
FIT_ROWS = 20_000
#: Weight of the common shares in a domain's, in features.
PRIOR_FEATURES = 20_000.0
#: A word in capitals.
SHOUT = r"\p{Lu}{4}"
#: Passes before the solver gives up (it needs 10 to 30), and the miss of a target, in budgets, that is reported.
MAX_STEPS, TOLERANCE = 500, 1e-4
#: Least regularisation, and the error of the solver in budgets, at the end and on the way there.
LEAST_WEIGHT, SOLVED, ROUGH = 1e-8, 1e-9, 1e-3
#: Newton steps that a pass tries: additions to the regularisation, and lengths.
DAMPINGS, LENGTHS = (0.0, 1e-4, 1e-2, 1.0), (1.0, 0.5, 0.125, 1 / 64)
#: Domain token shares that op10 and the pipeline mix to.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


class MixingWarning(UserWarning):
    """The rates' totals miss the targets."""


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) -> (doc_id, domain): toxic, good or poor; null where neither label tells."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def _words(text: Column) -> Column:
    """Lower-cased words; string replacement and a one-character split avoid regular expressions."""
    spaced = text
    for c in SPACE_CHARS[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.lower(spaced), " "), "")


def _features(words: Column, shouted: Column) -> Column:
    """Distinct buckets of words, of word ends, and of whether the text has a shouted word."""
    bucket = lambda tag, w: F.pmod(F.xxhash64(F.lit(tag), w), F.lit(1 << BUCKET_BITS)).cast("int")

    def of(distinct: Column) -> Column:
        ends = F.array_distinct(F.transform(distinct, lambda w: F.right(w, F.lit(2))))
        return F.array_distinct(F.concat(F.transform(distinct, lambda w: bucket("word", w)), F.transform(ends, lambda e: bucket("end", e)), F.array(bucket("shout", shouted.cast("string")))))

    return F.get(F.transform(F.array(F.array_distinct(words)), of), F.lit(0))


def fit_classifier(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """docs (__id, __words, __shouted), labelled (doc_id, domain) -> domains, log P(bucket | domain) by domain and bucket, log priors."""
    labelled = labelled.filter(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), "domain")
    span = 1 << 30
    share = min(span, fit_rows * span // max(1, labelled.count()) + 1)
    chosen = labelled.filter(F.pmod(F.xxhash64("__id"), F.lit(span)) < share)  # about fit_rows rows at most
    seen = docs.join(F.broadcast(chosen), "__id").select("domain", _features(F.col("__words"), F.col("__shouted")).alias("f"))
    counts = seen.select("domain", F.explode(F.concat("f", F.array(F.lit(-1)))).alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n"))
    found = counts.toArrow()  # at most 2**BUCKET_BITS + 1 rows a domain
    names, buckets, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("domain", "b", "n"))
    domains, size = sorted({*names[buckets == -1].tolist()}), 1 << BUCKET_BITS
    if not domains:
        return [], np.zeros((0, size)), np.zeros(0)
    table, totals = np.zeros((len(domains), size)), np.zeros(len(domains))
    for i, d in enumerate(domains):
        mine = names == d
        totals[i] = n[mine & (buckets == -1)].sum()
        seen = mine & (buckets >= 0)
        table[i, buckets[seen]] = n[seen]
    # Shares of a domain's features, smoothed towards the bucket's share in all labelled documents.
    common = table.sum(axis=0) + 0.5
    smoothed = table + PRIOR_FEATURES * common / common.sum()
    return domains, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)), np.log(totals / totals.sum())


def _posteriors(features: Column, rates: np.ndarray, priors: np.ndarray) -> Column:
    """array<double> of P(domain | text), in order of domains."""
    # Log-odds against the first domain; each list folds into one literal.
    odds = [F.split(F.lit(",".join(f"{x:.5g}" for x in rate)), ",").cast("array<double>") for rate in (rates[1:] - rates[0]).tolist()]
    priors = priors.tolist()
    scores = F.transform(F.array(features), lambda f: F.array(F.lit(priors[0]), *[F.aggregate(f, F.lit(p), _adding(o)) for p, o in zip(priors[1:], odds, strict=True)]))[0]
    exps = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(F.greatest(x - F.array_max(s), F.lit(-700.0)))))[0]
    return F.transform(F.array(exps), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def _adding(table: Column):
    return lambda total, bucket: total + F.get(table, bucket)


def solve_rates(evaluate: Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray, float]]], goal: np.ndarray, gram: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The dual vector x, the domain totals that it reaches, and the passes that it took.

    evaluate: for each of some x, in one pass over the documents, the domain
    totals, the Gram matrix of the documents within their bounds, and the
    dual's value.  A pass tries Newton steps of several dampings and
    lengths, and the one that falls lowest is taken.
    """
    x, solved = np.zeros(len(goal)), SOLVED * max(budget, 1e-9)
    (reached, inner, value), steps, weight, stalled = evaluate([x])[0], 1, 0.1, False
    while True:
        slope = goal - reached + weight * gram @ x
        if abs(slope).max() <= (solved if weight <= LEAST_WEIGHT else ROUGH * max(budget, 1e-9)) or stalled:
            if weight <= LEAST_WEIGHT:
                return x, reached, steps
            weight, stalled = max(weight / 100, LEAST_WEIGHT), False
            continue
        if steps >= MAX_STEPS:
            warnings.warn(f"mixing rates are not solved after {steps} passes: slope {slope.tolist()} of {budget} tokens", MixingWarning, stacklevel=3)
            return x, reached, steps
        tried = [x - length * np.linalg.lstsq(inner + (weight + more) * gram, slope, rcond=1e-14)[0] for more in DAMPINGS for length in LENGTHS]
        found, steps = evaluate(tried), steps + 1
        heights = [v + goal @ to + weight / 2 * to @ gram @ to for to, (_, _, v) in zip(tried, found, strict=True)]
        best = int(np.argmin(heights))
        stalled = not heights[best] < value + goal @ x + weight / 2 * x @ gram @ x
        if stalled:  # at the end of the numbers' precision the slopes decide
            slopes = [abs(goal - r + weight * gram @ to).max() for to, (r, _, _) in zip(tried, found, strict=True)]
            best = int(np.argmin(slopes))
            stalled = not slopes[best] < abs(slope).max()
        if not stalled:
            x, (reached, inner, value) = tried[best], found[best]


def fit_rates(docs: DataFrame, posterior: Sequence[Column], targets: Sequence[float], floor: Column, max_rate: float, tokens: Column, total: float | None = None, anchor: int | None = None) -> tuple[Column, list[float], list[float]]:
    """The rate expression, the domain totals that it reaches and those wanted.  total: wanted tokens in all (those of docs if None); anchor: the domain whose own tokens set the total instead."""
    k = len(posterior)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def rate_at(x: Sequence[Column]) -> tuple[Column, Column]:
        """The rates before and after the bounds."""
        free = F.lit(1.0) - sum((v * p for v, p in zip(x, posterior, strict=True)), F.lit(0.0))
        return free, F.least(F.greatest(free, floor), F.lit(float(max_rate)))

    def evaluate(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """A row for each point is all that leaves the executors."""
        points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, x.tolist())).alias("x")) for i, x in enumerate(tried)])).alias("__at")
        free, rate = rate_at([F.get("__at.x", F.lit(i)) for i in range(k)])
        rows = docs.select("*", points).withColumns({"__free": free, "__r": rate})
        f, r = F.col("__free"), F.col("__r")
        within, moved = (f >= floor) & (f <= max_rate), r - 1.0
        sums = [*(r * tokens * p for p in posterior), *(F.when(within, tokens * posterior[i] * posterior[j]) for i, j in pairs), tokens * (r * (f - 1.0) - moved * moved / 2)]
        found = {row[0]: [float(v or 0.0) for v in row[1:]] for row in rows.groupBy(F.col("__at.i").alias("__i")).agg(*map(F.sum, sums)).collect()}
        out = []
        for n in range(len(tried)):
            values, inner = found.get(n, [0.0] * len(sums)), np.zeros((k, k))
            for (i, j), v in zip(pairs, values[k:], strict=False):
                inner[i, j] = inner[j, i] = v
            out.append((np.array(values[:k]), inner, values[-1]))
        return out

    row = docs.agg(*map(F.sum, [*(tokens * p for p in posterior), *(tokens * posterior[i] * posterior[j] for i, j in pairs)])).first()
    sums, gram = [float(v or 0.0) for v in row], np.zeros((k, k))
    for (i, j), v in zip(pairs, sums[k:], strict=True):
        gram[i, j] = gram[j, i] = v
    have = sums[:k]
    budget = have[anchor] / targets[anchor] if anchor is not None and targets[anchor] > 0 else total if total is not None else sum(have)
    wanted = budget * np.array(targets, float)
    # A part of the target that no rates can change is left out.
    goal = gram @ np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ wanted
    x, reached, _ = solve_rates(evaluate, goal, gram, budget)
    if abs(reached - wanted).max() > TOLERANCE * max(budget, 1e-9):
        warnings.warn(f"no rates within the bounds reach the targets: domain totals {reached.tolist()}, wanted {wanted.tolist()}", MixingWarning, stacklevel=2)
    return rate_at([F.lit(v) for v in x.tolist()])[1], reached.tolist(), wanted.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, max_rate: float = 8.0, keep: str | None = None, anchor: str | None = None, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Returns id, `carry`, tokens long, posterior map<domain, double>, rate double and copies long, for every row.

    labelled: (doc_id, domain).  keep: documents that most likely belong
    to this domain get a rate of at least 1.  anchor: the wanted total is
    such that this domain's own tokens are its share of it.
    """
    extra = [F.col(f"`{c}`").alias(f"__carry{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), *extra)
    base = base.withColumns({"__words": _words(F.col("__text")), "__shouted": F.col("__text").rlike(SHOUT)})
    domains, rates, priors = fit_classifier(base, labelled, fit_rows)
    names = [F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry)]
    tokens, draw = F.size("__words").cast("long"), F.pmod(F.xxhash64("__id", "__text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    if not domains:
        return base.select(F.col("__id").alias(id_col), *names, tokens.alias("tokens"), F.create_map().cast("map<string,double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    rated = base.select("__id", *[f"__carry{i}" for i in range(len(carry))], tokens.alias("__tokens"), draw.alias("__draw"), _posteriors(_features(F.col("__words"), F.col("__shouted")), rates, priors).alias("__p"))
    posterior = [F.col(f"__p{i}") for i in range(len(domains))]
    floor = F.lit(0.0)
    if keep in domains:
        floor = F.when(F.get("__p", F.lit(domains.index(keep))) == F.array_max("__p"), F.lit(min(1.0, float(max_rate)))).otherwise(floor)
    # Plain columns, so that a chain of steps stays a small expression.
    rated = rated.select("*", *[F.get("__p", F.lit(i)).alias(f"__p{i}") for i in range(len(domains))], floor.alias("__floor")).drop("__p")
    rated = materialize(rated, "posteriors")
    shares = [targets.get(d, 0.0) for d in domains]
    shares = [s / sum(shares) for s in shares] if sum(shares) > 0 else [1 / len(shares)] * len(shares)
    rate, *_ = fit_rates(rated, posterior, shares, F.col("__floor"), max_rate, F.col("__tokens"), anchor=domains.index(anchor) if anchor in domains else None)
    out = rated.withColumn("__rate", rate)
    copies = (F.floor("__rate") + F.when(F.col("__draw") < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("long")
    mapped = F.map_from_arrays(F.array(*map(F.lit, domains)), F.array(*posterior))
    return out.select(F.col("__id").alias(id_col), *names, F.col("__tokens").alias("tokens"), mapped.alias("posterior"), F.col("__rate").alias("rate"), copies.alias("copies"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mix(docs, label_domains(labels), carry=["source"])
    return out.select("doc_id", "source", "tokens", *[F.element_at("posterior", d).alias(f"p_{d}") for d in sorted(TARGETS)], "rate", "copies")
