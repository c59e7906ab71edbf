"""Personal data: pattern spans and information-theoretic sanitisation (native).

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and
phone numbers.  On top of them, corpus co-occurrence estimates how
strongly a term reveals a protected entity, which is a kind or one value
of it: with IC(e) = log2(N / n(e)) and PMI(term, e) = log2(N n(term, e) /
(n(term) n(e))), counted over all documents, the disclosure of a term is
the most of PMI / IC over the entities, 1 when the term never occurs
without one.  Terms at or over `remove_at` are removed from the sanitised
text, and terms at or over `generalise_at` are generalised to a
placeholder: with `everywhere` in every document that holds them, else
only in documents that hold an entity.  A term needs `min_support`
different texts with the entity, so that copies of one document do not
make evidence.

Positions come from splitting a text at the pattern and summing the
lengths of pieces and matches.  Patterns use possessive repeats and start
only at the head of a run (or where the last match ended), so that long
runs take linear time; the matches are those of the plain patterns.

Plan: candidate terms are gathered from entity documents only, then
counted over all documents by a join with the candidates, which is
broadcast only while its counted size is small.  A document's terms are
found again by a hash of its id and text: texts are shuffled once for
that and not stored.

Edge cases: null text is empty; null and repeated ids keep their own
rows; an empty table gives an empty result; other columns are ignored
except `carry`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if, hash128, materialize
from tessella.llm.fingerprint import let

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{3,}+"

SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
PIECE = "struct<a:int,b:int,k:int,v:string>"
#: Items that one fold appends to an array.
BLOCK = 256
#: A broadcast table of at most this many terms.
BROADCAST_TERMS = 100_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


_VALID: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda m: F.lit(True)),
    "ip": (IP, lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
    "card": (CARD, _valid_card),
    "phone": (PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
}


def blocks(items: Column) -> Column:
    """The array cut into arrays of BLOCK.

    A fold that appends copies what it has; folding blocks, then the blocks'
    results, keeps the copies of n items near n * (BLOCK + n / BLOCK**2).
    """
    count = lambda x: F.greatest(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), count(x)), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK))))


def spans_of(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches that pass `valid`: array of (start, kind, end, value), in code points."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def within(block: Column) -> Column:
        return F.aggregate(block, start, step)

    def shifted(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["pos"]).alias("s"), y["k"].alias("k"), (y["e"] + acc["pos"]).alias("e"), y["v"].alias("v")))
        return F.struct((acc["pos"] + x["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + x["p"]
        end = at + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(at.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("v"))
        ok = x["m"].isNotNull() & valid(x["m"])
        return F.struct(end.alias("pos"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(F.transform(blocks(steps), within), zero, shifted, lambda acc: F.flatten(acc["out"]))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    none = F.array().cast(SPAN)
    has_digit = text.rlike("[0-9]")
    when = {"email": text.contains("@"), "ip": has_digit & text.rlike(r"[0-9]\.[0-9]"), "card": has_digit & text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    found = [F.when(when[k], spans_of(text, p, KINDS.index(k), v)).otherwise(none) for k, (p, v) in _VALID.items()]
    return F.sort_array(F.concat(*found))


def terms(text: Column) -> Column:
    """Distinct lower-cased words of three letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def disclosing_terms(found: DataFrame, docs: DataFrame, min_support: int, generalise_at: float) -> DataFrame:
    """term, disclosure (the most over kinds and values), from entity documents `found` (uid, text, base) and all documents (text)."""
    n = max(1, docs.count())
    # One document of each text counts as support.
    firsts = found.groupBy(F.xxhash64("__text").alias("t"), F.xxhash64(F.lit(1), "__text").alias("u")).agg(F.min("__uid").alias("__uid")).select("__uid", F.lit(1).alias("first"))
    spans = found.join(firsts, "__uid", "left").select("__uid", F.coalesce("first", F.lit(0)).alias("first"), F.explode("__base").alias("x"))
    # An entity is a kind (h null) or a value of it.
    values = F.explode(F.array(F.lit(None).cast("long"), F.xxhash64("x.v")))
    held = materialize(spans.select("__uid", "first", F.col("x.k").alias("k"), values.alias("h")).distinct(), "pii-held")
    entities = held.groupBy("k", "h").agg(F.count("*").alias("n_entity"), F.sum("first").alias("texts")).filter(F.col("texts") >= min_support)
    entities = materialize(entities.select("k", "h", "n_entity"), "pii-entities")
    few = broadcast_if(entities.select(F.col("k").alias("ek"), F.col("h").alias("eh"), "n_entity"), entities.count(), BROADCAST_TERMS)
    same = (F.col("k") == F.col("ek")) & F.col("h").eqNullSafe(F.col("eh"))
    words = found.select("__uid", F.explode(terms(F.col("__text"))).alias("term"))
    pairs = words.join(held.join(few, same, "left_semi"), "__uid").groupBy("term", "k", "h").agg(F.count("*").alias("both"), F.sum("first").alias("texts"))
    pairs = materialize(pairs.filter(F.col("texts") >= min_support).join(few, same).select("term", "both", "n_entity"), "pii-pairs")
    candidates = pairs.select("term").distinct()
    every = docs.select(F.explode(terms(F.coalesce("__text", F.lit("")))).alias("term"))
    counts = every.join(broadcast_if(candidates, candidates.count(), BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    ic = F.log2(F.lit(float(n)) / F.col("n_entity"))
    pmi = F.log2(F.col("both") * float(n) / (F.col("n_term") * F.col("n_entity")))
    rated = pairs.join(counts, "term").filter(ic > 0).withColumn("disclosure", F.try_divide(pmi, ic))
    return rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= generalise_at)


def find_pii(docs: DataFrame, min_support: int = 5, generalise_at: float = 0.8, remove_at: float = 0.95, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), everywhere: bool = False) -> DataFrame:
    """Returns id, `carry`, n_email .. n_phone, base (spans), spans (base and term spans) and sanitised text under text_col.

    everywhere: terms are marked in every document, not only in those that hold an entity.
    """
    extra = [F.col(f"`{c}`").alias(f"__carry{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), *extra)
    spanned = base.withColumn("__base", base_spans(F.col("__text")))
    found = materialize(spanned.filter(F.size("__base") > 0).withColumn("__uid", F.monotonically_increasing_id()), "pii-found")
    revealing = materialize(disclosing_terms(found, base, min_support, generalise_at), "pii-terms")
    key = hash128(F.col("__id"), F.col("__text"))
    rates = F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("__rates")
    held = (base if everywhere else found).select(key.alias("__key"), F.explode(terms(F.col("__text"))).alias("term"))
    marked = held.join(broadcast_if(revealing, revealing.count(), BROADCAST_TERMS), "term").groupBy("__key").agg(rates)
    clean = spanned.filter(F.size("__base") == 0).withColumn("__base", F.array().cast(SPAN))
    joined = found.drop("__uid").unionByName(clean) if everywhere else found
    joined = joined.withColumn("__key", key).join(marked.hint("shuffle_hash"), "__key", "left")
    inside = lambda t: F.exists("__base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
    hits = F.filter(spans_of(F.col("__text"), TERM, 4, lambda m: F.array_contains(F.map_keys("__rates"), F.lower(m))), lambda t: ~inside(t))
    joined = joined.withColumn("__terms", F.when(F.col("__rates").isNotNull(), hits).otherwise(F.array().cast(SPAN)))
    joined = joined.withColumn("__all", F.sort_array(F.concat("__base", "__terms")))

    def placed(acc: Column, x: Column) -> Column:
        """The place up to which text is done, and each span's share: clean text from `a` up to its start, and its label; a span that begins inside an earlier one adds nothing."""
        at = acc["pos"]
        fresh = x["s"] >= at
        piece = F.struct(at.alias("a"), F.when(fresh, x["s"]).otherwise(at).alias("b"), F.when(fresh, x["k"]).otherwise(F.lit(-1)).alias("k"), x["v"].alias("v"))
        return F.struct(F.greatest(at, x["e"]).alias("pos"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def block_pieces(acc: Column, block: Column) -> Column:
        found = F.aggregate(block, F.struct(acc["pos"].alias("pos"), F.array().cast(f"array<{PIECE}>").alias("out")), placed)
        return let(found, lambda x: F.struct(x["pos"].alias("pos"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def written(pieces: Column) -> Column:
        """The text of a block's pieces: the block's stretch is taken out of the text once, so that a long text is not walked for each span."""
        first, last = F.get(pieces, F.lit(0))["a"], F.element_at(pieces, -1)["b"]
        stretch = F.substring(F.col("__text"), first + 1, last - first)

        def share(part: Column) -> Column:
            def one(x: Column) -> Column:
                rate = F.element_at("__rates", F.lower(x["v"]))
                term = F.when(rate >= remove_at, F.lit("")).otherwise(F.lit("[term]"))
                label = F.when(x["k"] == 4, term).when(x["k"] < 0, F.lit("")).otherwise(F.concat(F.lit("["), F.get(F.array(*map(F.lit, KINDS)), x["k"]), F.lit("]")))
                return F.concat(F.substring(part, x["a"] - first + 1, x["b"] - x["a"]), label)

            return F.array_join(F.transform(pieces, one), "")

        return let(stretch, share)

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{PIECE}>>").alias("out"))
    done = F.aggregate(blocks(F.col("__all")), zero, block_pieces)
    rest = lambda x: F.substring(F.col("__text"), x["pos"] + 1, F.length("__text"))
    sanitised = let(done, lambda x: F.concat(F.array_join(F.transform(x["out"], written), ""), rest(x)))
    names = [F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry)]
    count = [_count_kind(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    with_spans = joined.select(F.col("__id").alias(id_col), *names, *count, F.col("__base").alias("base"), F.col("__all").alias("spans"), sanitised.alias(text_col))
    if everywhere:
        return with_spans
    zeros = [F.lit(0).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    none = F.array().cast(SPAN)
    without = clean.select(F.col("__id").alias(id_col), *names, *zeros, none.alias("base"), none.alias("spans"), F.col("__text").alias(text_col))
    return with_spans.unionByName(without)


def _count_kind(kind: int) -> Column:
    return F.size(F.filter("__base", lambda x: x["k"] == kind)).cast("long")


def spans_text(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), everywhere=True)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
