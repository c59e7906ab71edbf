"""Secret scans: patterns, and guess costs of values in a credential context.

Base spans are credential assignments, access keys and long hexadecimal
runs.  Beyond them, values that follow a credential word (`password is
...`, `pwd: ...`, `Bearer ...`, `user:...@host`) are rated by the number
of guesses an attacker needs.  Dynamic programming finds the cheapest
segmentation of a value into dictionary words (by rank), dates, repeats,
keyboard walks and brute-force spans; the cost of k segments is the
product of theirs times k!.  Values at or over `min_log10` guesses are
added as spans of kind `guess`; cheap ones are ordinary words.

The dictionary is the corpus's own: every word of three letters or more,
ranked by its count over all documents (with map-side combine), after a
short list of common passwords.  Words and ranks stay distributed; only
the words that occur inside some document's values are gathered, by a join
of the values' letter runs with the ranked table.

The cost covers the whole value.  The number of segments enters by its
factorial, so a best segmentation for each number would be needed; a
price for each segment in its place gives bounds (Lagrangian), which leave
few numbers to follow.  Brute-force spans take a running minimum.

Edge cases: null text is empty; a method span that overlaps a base span is left out; null and repeated ids keep their
rows; an empty table gives an empty result; other columns are ignored
except `carry`.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence
from math import lgamma, log, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import broadcast_if, materialize, tidy

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer)(?![A-Za-z])[\"']?(?:\x20*(?:[:=]|=>|->)|\x20+(?:is|was)(?=\x20)|(?<=[Rr])(?=\x20))\x20*[\"']?(?P<value>[^\s\"'<>,;]{6,})"
    r"|://[^\s/:@]+:(?P<url>[^\s/@]{6,})@",
    re.ASCII | re.IGNORECASE,
)
#: Lower-case substrings without which no pattern can match.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "bearer", "://")

MIN_LOG10 = 8.0
#: Longer words are looked up by their first WORD letters.
WORD = 24
#: A periodic run of 8 * RUN_WORDS * (longest word + 8) characters is cut only near its ends: one repeat is the cheapest inside, as what
#: stands beside it there costs more than a longer repeat, but for fewer words than the period has characters.
RUN_WORDS = 8
#: A broadcast table of at most this many pieces of values.
BROADCAST_PIECES = 200_000
#: Common passwords, most frequent first.
COMMON = "password 123456 123456789 12345678 12345 qwerty abc123 111111 letmein welcome monkey dragon iloveyou admin login princess sunshine master shadow football baseball trustno1 superman michael starwars passw0rd secret changeme default guest root test".split()
#: Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Characters that often stand for letters.
LEET = str.maketrans("4@301$57!", "aaeoisstl")

_PLACE = {c: (x + y / 2, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_DATE = re.compile(r"(?:(?:19|20)\d\d|\d{1,2}([-/._]?)\d{1,2}\1(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d([-/._]?)\d{1,2}\2\d{1,2})", re.ASCII)


def _adjacent(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE or a == b:
        return False
    (x, y), (u, v) = _PLACE[a], _PLACE[b]
    return abs(x - u) <= 1 and abs(y - v) <= 1


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


class Ranks(dict):
    """word -> rank, with the length of the longest word."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__(ranks)
        self.longest = max(map(len, ranks), default=0)


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, str, float]]:
    """Segments (start, end, kind, log10 guesses) that are cheaper than brute force."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    longest = ranks.longest if isinstance(ranks, Ranks) else max(map(len, ranks), default=0)
    edge, deep = RUN_WORDS * (max(WORD, longest) + 8), set()
    for width in range(1, 9) if n > 8 * edge else ():
        for m in re.finditer(rf"(.{{{width}}})\1{{{8 * edge // width},}}", value, re.DOTALL):
            deep.update(range(m.start() + edge, m.end() - edge + 1))
    for found in _segments(value, low, plain, n, ranks, longest, deep):
        if found[1] not in deep:
            yield found


def _segments(value: str, low: str, plain: str, n: int, ranks: dict[str, int], longest: int, deep: Collection[int]) -> Iterator[tuple[int, int, str, float]]:
    for start in range(n):
        if start in deep:
            continue
        for end in range(start + 3, min(n, start + longest) + 1):
            for form, leet in ((low, 1.0), (plain, 2.0)):
                rank = ranks.get(form[start:end])
                if rank is not None:
                    cased = 1.0 if value[start:end].islower() else 2.0 if value[start:end].istitle() or value[start:end].isupper() else 2.0 ** (end - start)
                    yield start, end, "word", log10(max(2, rank) * leet * cased)
        for end in range(start + 4, min(n, start + 10) + 1):
            if _DATE.fullmatch(value, start, end):
                yield start, end, "date", log10(120) if end - start == 4 else log10(365 * 120 * 4)
        end, turns = start + 1, 0
        while end < n and _adjacent(low[end - 1], low[end]):
            end += 1
            if end - start >= 3:
                turns += ord(low[end - 1]) - ord(low[end - 2]) != ord(low[end - 2]) - ord(low[end - 3])
                yield start, end, "keyboard", log10(len(_PLACE) * (end - start)) + min(turns, end - start) * log10(4)
        end = start + 1
        while end < n and 0 < abs(step := ord(low[end]) - ord(low[end - 1])) <= 1 and (end - start < 2 or step == ord(low[end - 1]) - ord(low[end - 2])):
            end += 1
            if end - start >= 3:
                yield start, end, "sequence", log10(20 * (end - start))
        for width in range(1, min(9, (n - start) // 2 + 1)):
            end = start + width
            block = value[start:end]
            if (block + block).find(block, 1) < width:
                continue  # a repeat of a shorter width, which is cheaper
            while value[end : end + width] == value[start : start + width] and end + width <= n:
                end += width
                if end - start >= 3:
                    base = sum(log10(_alphabet(c)) for c in value[start : start + width])
                    yield start, end, "repeat", base + log10((end - start) / width)


def guess_cost(value: str, ranks: dict[str, int]) -> tuple[float, list[tuple[str, str]]]:
    """log10 of the guesses for a value, and its cheapest segmentation as (kind, text)."""
    n = len(value)
    if not n:
        return 0.0, []
    cheapest: dict[tuple[int, int], tuple[float, str]] = {}
    for start, end, kind, cost in segments(value, ranks):
        if cost < cheapest.get((start, end), (float("inf"),))[0]:
            cheapest[start, end] = cost, kind
    starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    ends: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for (start, end), (cost, kind) in cheapest.items():
        starts[start].append((end, cost))
        ends[end].append((start, cost, kind))
    brute, two = [0.0], log10(2)
    for c in value:
        brute.append(brute[-1] + log10(_alphabet(c)))

    def order(count: int) -> float:
        return lgamma(count + 1) / log(10)

    def priced(price: float) -> tuple[list[float], int, float]:
        """Least cost from every place to the end at a price for each segment; segments and cost of the whole."""
        rest, counts, low, at = [0.0] * (n + 1), [0] * (n + 1), brute[n], n
        for start in range(n - 1, -1, -1):
            best, to = low - brute[start] + two, at
            for end, cost in starts[start]:
                if rest[end] + cost < best:
                    best, to = rest[end] + cost, end
            rest[start], counts[start] = best + price, counts[to] + 1
            if brute[start] + rest[start] < low:
                low, at = brute[start] + rest[start], start
        return rest, counts[0], rest[0] - price * counts[0]

    # Prices at which the bound meets a segmentation; the order factor is at least its tangent of this slope.
    below, above, most, bound = 0.0, log10(n + 1), float("inf"), -float("inf")
    for _ in range(16):
        slope = (below + above) / 2
        left, count, cost = priced(slope)
        tangent = order(max(1, int(10**slope))) - slope * max(1, int(10**slope))
        most = min(most, cost + order(count))
        if left[0] + tangent > bound:
            bound, rest, price, least = left[0] + tangent, left, slope, tangent
        if most - bound < 1e-9:
            break
        below, above = (slope, above) if count > 10**slope else (below, slope)
    limit = most - least + 1e-9
    nearest = [0.0] * n + [brute[n]]  # the least brute force and rest from here on
    for i in range(n - 1, -1, -1):
        nearest[i] = min(nearest[i + 1], brute[i] + rest[i])
    # best[end][count]: the least cost of value[:end] in `count` segments, and the last one; only what can lead to `most` or less.
    best: list[dict[int, tuple[float, int, str]]] = [{0: (0.0, 0, "")}]
    running = {0: (0.0, 0)}
    for end in range(1, n + 1):
        row: dict[int, tuple[float, int, str]] = {}
        for count, (before, start) in running.items():
            row[count + 1] = before + brute[end] + two, start, "brute"
        for start, cost, kind in ends[end]:
            for count, (before, _, _) in best[start].items():
                if before + cost < row.get(count + 1, (float("inf"),))[0]:
                    row[count + 1] = before + cost, start, kind
        best.append({count: x for count, x in row.items() if x[0] + price * count + rest[end] <= limit})
        if end < n:
            for count, x in best[end].items():
                if x[0] - brute[end] < running.get(count, (float("inf"),))[0]:
                    running[count] = x[0] - brute[end], end
            running = {count: x for count, x in running.items() if x[0] + two + price * (count + 1) + nearest[end + 1] <= limit}
    count = min(best[n], key=lambda c: best[n][c][0] + order(c))
    cost, parts, end = best[n][count][0] + order(count), [], n
    while end > 0:
        _, start, kind = best[end][count]
        parts.append((kind, value[start:end]))
        end, count = start, count - 1
    return cost, parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind."""
    low = text.lower()
    found = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def context_values(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    return [m.span("value" if m["value"] is not None else "url") for m in CONTEXT.finditer(text)]


def letter_runs(text: str) -> set[str]:
    """Runs of letters, plain and with letters for look-alikes, of the values in a credential context."""
    found = [ASSIGN.match(text, s)[2] for s, k, _ in base_spans(text) if k == 0] + [text[s:e] for s, e in context_values(text)]
    return {run for v in found for form in (v.lower(), v.lower().translate(LEET)) for run in _LETTERS.findall(form)}


def ranked_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, rank) of every word of three letters or more: by falling count, then word, after the common passwords."""
    found = F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit(r"\p{L}{3,}+"), F.lit(0))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts.filter(~F.col("word").isin(COMMON)), "words")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(counts.orderBy(F.desc("n"), "word").select("word", F.spark_partition_id().alias("part"), place.alias("place")), "ranks")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    first, offsets = len(COMMON) + 1, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(first)
        first += sizes.get(part, 0)
    offset = F.get(F.array(*map(F.lit, offsets or [first])).cast("array<long>"), F.col("part"))
    return placed.select("word", (F.col("place") + offset).alias("rank"))


def dictionary(docs: DataFrame, text_col: str = "text", size: int | None = None) -> Ranks:
    """word -> rank of the words that occur in values of docs (the `size` most frequent of all words only, if given), and of the common passwords."""
    text = docs.select(F.col(f"`{text_col}`").alias("__text")).filter(F.col("__text").isNotNull())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                runs = {run for t in batch.column(0).slice(at, 1000).to_pylist() for run in letter_runs(t)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(runs), pa.string())], names=["run"])

    runs = materialize(text.mapInArrow(tidy(extract), "run string").distinct(), "letter-runs")
    words = ranked_words(docs, text_col)
    if size is not None:
        words = words.filter(F.col("rank") <= len(COMMON) + size)
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run") - 2)).alias("at"))
    lengths = F.sequence(F.lit(3), F.least(F.lit(WORD), F.length("run") - F.col("at") + 1))
    pieces = materialize(starts.select(F.explode(F.transform(lengths, lambda n: F.substr("run", "at", n))).alias("word")).distinct(), "pieces")
    short = words.join(broadcast_if(pieces, pieces.count(), BROADCAST_PIECES), "word", "left_semi")
    # Longer words: a run that has the first letters at a place has the word there.
    heads = starts.filter(F.length("run") - F.col("at") >= WORD).withColumn("head", F.substr("run", "at", F.lit(WORD)))
    more = words.filter(F.length("word") > WORD).withColumn("head", F.left("word", F.lit(WORD)))
    more = more.join(heads, "head").filter(F.substr("run", "at", F.length("word")) == F.col("word")).select("word", "rank").distinct()
    found = short.unionByName(more).toArrow()  # words inside values only
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    ranks.update(zip(found.column("word").to_pylist(), found.column("rank").to_pylist(), strict=True))
    return Ranks(ranks)


def find_secrets(docs: DataFrame, ranks: dict[str, int], min_log10: float = MIN_LOG10, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Returns the `carry` columns, spans array<struct<start, kind, end, log10_guesses>> (base and guess) and text with the spans redacted."""
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(ranks))
    kept = [f"__carry{i}" for i in range(len(carry))]
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)])
    span = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("log10_guesses", pa.float64())])

    def scan(text: str) -> tuple[list[dict], str]:
        base = base_spans(text)
        spans = [(s, k, e, guess_cost(ASSIGN.match(text, s)[2], shared.value)[0] if k == 0 else None) for s, k, e in base]
        for s, e in context_values(text):
            if any(s < end and start < e for start, _, end in base):
                continue
            cost = guess_cost(text[s:e], shared.value)[0]
            if cost >= min_log10:
                spans.append((s, 3, e, cost))
        spans.sort(key=lambda x: x[:3])
        out, at = [], 0
        for s, k, e, _ in spans:
            if s >= at:
                out += [text[at:s], f"[{KINDS[k]}]"]
            at = max(at, e)
        return [dict(zip(("start", "kind", "end", "log10_guesses"), (s, KINDS[k], e, g), strict=True)) for s, k, e, g in spans], "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [scan(t or "") for t in part.column("__text").to_pylist()]
                columns = [part.column(k) for k in kept] + [pa.array([s for s, _ in found], pa.list_(span)), pa.array([t for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "spans", "text"])

    spark_span = "array<struct<start:int,kind:string,end:int,log10_guesses:double>>"
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), T.StructField("spans", T._parse_datatype_string(spark_span)), T.StructField("text", T.StringType())])
    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "spans", "text")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_secrets(docs, dictionary(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind
