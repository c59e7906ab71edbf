"""Document fingerprints: bottom-k sketches of word-shingle hashes (native).

A fingerprint is the ascending array of the k smallest distinct 64-bit
hashes of a text's five-word shingles (words [^\\x20\\x09-\\x0D]+ with A-Z
lower-cased; a text of fewer words is one shingle; no words: empty).
Sketches of parts merge into the sketch of the whole, and estimate
resemblance, containment and the number of distinct shingles.

`edited_fingerprints` pairs every document with its edited text, which
takes its second half from the next document in id order.  Next
documents are found without a global sort: quantiles of the ids cut their
range into at most MOST_RANGES parts, and each part is cut evenly until a
bucket holds about BUCKET_ROWS rows, however sparse or crowded ids are.
One shuffle brings a bucket together, and only the last row of a bucket
has to meet the first row of the next one.  An id that fills whole ranges,
and null ids, are dealt to buckets by a hash.

Edge cases: null text counts as empty; two empty fingerprints have
likeness 1, an empty and a non-empty one 0; null ids come last in the
order, in any order among themselves; rows that repeat an id are ordered
by a hash of their text (in any order where they are a hot group); the
only document follows itself; an empty table gives an empty result;
other columns are ignored; ids must be integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import lower_ascii, materialize, words

SHINGLE_WORDS = 5
SKETCH_SIZE = 64
#: Rows of a bucket, about, and quantile ranges of the ids, at most.
BUCKET_ROWS, MOST_RANGES = 512, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bottom_k(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> Column:
    """The sketch of a text: array<long>, ascending, at most k values."""
    hashed = F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))

    def sketch(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(F.size(w) >= shingle, bottom_k(rolled, k)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, sketch)


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity, from the bottom k of the union."""
    shared = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared)


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    position = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / position)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has too."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n > 0, F.least(F.lit(1.0), j * (n + m) / ((1 + j) * n))).otherwise(F.lit(1.0))


def as_string(sketch: Column) -> Column:
    """Hexadecimal, 16 digits a hash, comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str = "fingerprint", k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch for each key from the sketches of its parts: the k smallest distinct hashes, ranked with a per-task limit first."""
    hashes = parts.select(*keys, F.explode(sketch_col).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))
    return hashes.withColumn("__r", rank).filter(F.col("__r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def _buckets(base: DataFrame) -> DataFrame:
    """Adds __range and __bucket, which ascend with __id (nulls last), and __tie, the order of rows that repeat an id."""
    n, nulls = base.agg(F.count("__id"), F.count("*") - F.count("__id")).first()
    ranges = max(1, min(MOST_RANGES, n // BUCKET_ROWS))
    bounds = []
    if ranges > 1:
        bounds = base.agg(F.percentile_approx("__id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    parts = max(1, -(-n // (ranges * BUCKET_ROWS)))
    hot = sorted({b for b, c in zip(bounds, bounds[1:], strict=False) if b == c})  # ids that fill a range
    crowd = max([bounds.count(h) + 1 for h in hot], default=1) * parts
    share = lambda h, count: F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * count).cast("long")
    at = F.lit(0)
    if bounds:
        limits = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folds into one literal
        steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
        at = F.aggregate(steps, F.lit(0), lambda place, step: F.when(F.get(limits, place + step - 1) <= F.col("__id"), place + step).otherwise(place))
        low, high = F.get(limits, F.col("__range") - 1), F.get(limits, F.col("__range"))
    else:
        low = high = F.lit(None).cast("long")
    place = (F.col("__id") - low).cast("double") / (high - low)
    inside = F.least(F.coalesce(F.floor(place * parts).cast("long"), F.lit(0)), F.lit(parts - 1).cast("long"))
    is_hot = F.col("__id").isin(hot) if hot else F.lit(False)
    any_order = F.xxhash64("__text", F.monotonically_increasing_id())
    rows = base.withColumn("__tie", F.when(F.col("__id").isNull() | is_hot, any_order).otherwise(F.xxhash64("__text")))
    rows = rows.withColumn("__range", F.when(F.col("__id").isNull(), F.lit(MOST_RANGES)).otherwise(at).cast("int"))
    bucket = F.when(F.col("__id").isNull(), share(F.col("__tie"), max(1, -(-nulls // BUCKET_ROWS))))
    return rows.withColumn("__bucket", bucket.when(is_hot, share(F.col("__tie"), crowd) - crowd).otherwise(inside))


def _next_buckets(buckets: DataFrame) -> DataFrame:
    """(__range, __bucket) -> the next bucket that has rows (the first one after the last) as __to_range, __to_bucket."""
    here = F.struct("__range", "__bucket")
    inside = F.lead(here).over(Window.partitionBy("__range").orderBy("__bucket"))
    first = buckets.groupBy("__range").agg(F.min(here).alias("__first"))
    order = Window.orderBy("__range")  # at most MOST_RANGES + 1 rows
    after = first.select("__range", F.coalesce(F.lead("__first").over(order), F.first("__first").over(order)).alias("__after"))
    following = F.coalesce("__inside", "__after")
    found = buckets.withColumn("__inside", inside).join(after, "__range")
    return found.select("__range", "__bucket", following["__range"].alias("__to_range"), following["__bucket"].alias("__to_bucket"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH_SIZE) -> DataFrame:
    """Returns id, n_chars, edited_sha256, fingerprint and edited_fingerprint (array<long>), near_edited and near_next."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold integers: they tell which document is the next")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    base = _buckets(base).repartition("__range", "__bucket")
    base = base.select("*", F.length("__text").cast("long").alias("n_chars"), fingerprint(F.col("__text"), k=k).alias("__fp"))
    order = Window.partitionBy("__range", "__bucket").orderBy(F.asc_nulls_last("__id"), "__tie")
    met = base.select("*", F.lead("__text").over(order).alias("__next_text"), F.lead("__fp").over(order).alias("__next_fp"), F.row_number().over(order).alias("__row"))

    def edit(df: DataFrame) -> DataFrame:
        """Adds the edited columns; all null where there is no next text yet."""
        half = F.floor(F.col("n_chars") / 2).cast("int")
        edited = F.concat(F.substring(F.col("__text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("__next_text"), F.lit(1), half))
        df = df.withColumn("__edited", edited)
        df = df.withColumn("__edited_fp", F.when(F.col("__edited").isNotNull(), fingerprint(F.col("__edited"), k=k)))
        return df.select(
            "__range",
            "__bucket",
            "__id",
            "n_chars",
            F.sha2("__edited", 256).alias("edited_sha256"),
            F.col("__fp").alias("fingerprint"),
            F.col("__edited_fp").alias("edited_fingerprint"),
            F.when(F.col("__edited_fp").isNotNull(), resemblance(F.col("__fp"), F.col("__edited_fp"), k)).alias("near_edited"),
            F.when(F.col("__next_fp").isNotNull(), resemblance(F.col("__fp"), F.col("__next_fp"), k)).alias("near_next"),
            F.when(F.col("__next_text").isNull(), F.col("__text")).alias("__tail"),
            F.when(F.col("__row") == 1, F.col("__text")).alias("__head"),
        )

    done = materialize(edit(met), "fingerprints")
    out = ["__id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    heads = done.filter(F.col("__head").isNotNull())
    following = heads.select(F.col("__range").alias("__to_range"), F.col("__bucket").alias("__to_bucket"), F.col("__head").alias("__next_text"), F.col("fingerprint").alias("__next_fp"))
    tails = done.filter(F.col("__tail").isNotNull()).select("__range", "__bucket", "__id", "n_chars", F.col("__tail").alias("__text"), F.col("fingerprint").alias("__fp"))
    tails = tails.join(_next_buckets(heads.select("__range", "__bucket")), ["__range", "__bucket"]).join(following, ["__to_range", "__to_bucket"]).withColumn("__row", F.lit(0))
    rest = done.filter(F.col("__tail").isNull())
    whole = rest.select(*out).unionByName(edit(tails).select(*out))
    return whole.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), *out[1:])


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("fingerprint", as_string(F.col("fingerprint"))).withColumn("edited_fingerprint", as_string(F.col("edited_fingerprint")))
