"""Line dedup, PII and fingerprints against brute force, with the edge cases of each."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm.fingerprint import as_string, containment, distinct_shingles, edited_fingerprints, fingerprint, merge, resemblance
from tessella.llm.line_dedup import line_dedup
from tessella.llm.pii import find_pii, op3_pii, spans_text

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_lines long"


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


SHARED = "A line that is quite long and that many documents share."
LINES = [
    (1, f"{SHARED}\nown line", "en", 7),
    (2, f"  {SHARED.upper()}\t\nshort", "en", 7),
    (3, f"{SHARED}\n{SHARED}", "en", 7),
    (4, SHARED, None, 7),
    (9, f"x\n{SHARED}\n", "en", 7),
    (5, None, "en", 7),
    (6, "", "en", 7),
    (7, "no\n\nlines", "en", None),
    (None, SHARED, "en", 7),
    (8, "é" * 39 + "\n" + "é" * 40, "fr", 7),
]


def brute_lines(rows, least=40, docs=5):
    space, upper = " \t\n\x0b\x0c\r", {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    holders = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(space).translate(upper), set()).add(d)
    out = []
    for d, t, *_ in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            k = line.strip(space).translate(upper)
            ids = {x for x in holders[k] if x is not None}
            if not (len(k) >= least and len(ids) >= docs and d is not None and d != max(ids)):
                kept.append(line)
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(spark):
    assert rows_of(line_dedup(spark.createDataFrame(LINES, SCHEMA)), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(LINES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(line_dedup(docs), "doc_id", "text", "n_lines", "n_dropped") == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_line_dedup_carries_columns_and_takes_empty_tables(spark):
    out = line_dedup(spark.createDataFrame(LINES, SCHEMA), carry=["lang"])
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute_pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))
    return [sum(x[1] == k for x in found) for k in range(4)], ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in found)


PII = [
    "write to a.b+c@x-y.example.com, or a@b.c_d@e.f.g or x@y or @@a@b.co",
    "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0000255.0.0.1, 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 5500000000000004 12 34",
    "+1 (499) 555-6503 or +12 or +1234567890123456 ++49 30 123456-7",
    "😀 é 10.0.0.1 mail é@x.y 😀a@b.cd",
    "",
    None,
    "9" * 30_000 + " " + "a" * 30_000,
    " ".join(f"u{i}@h{i}.example.org" for i in range(1500)),
]


def test_pii_base_spans_match_brute_force(spark):
    texts = PII + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, n_email string, base long")
    out = {r.doc_id: r for r in find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", spans_text(F.col("base")).alias("base"), "text").collect()}
    for i, t in enumerate(texts):
        counts, base = brute_pii(t)
        assert [out[i][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == counts and out[i].base == base, t and t[:100]
        if not base:
            assert out[i].text == (t or "")
    assert find_pii(docs.limit(0)).count() == 0


def test_pii_terms_that_reveal_an_entity_are_marked(spark):
    rows = [(i, f"write to u{i}@example.org courtesy of Quirrel and others") for i in range(8)] + [(100 + i, f"clean text number {i} and others of them write to") for i in range(60)]
    rows += [(200, "Quirrel alone is left alone"), (201, "courtesy courtesy")] + [(300 + i, "courtesy of none") for i in range(2)]
    out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.k, s.v) for s in out[0].spans] == [(0, "u0@example.org"), (4, "courtesy"), (4, "Quirrel")]
    assert out[0].text == "write to [email] [term] of [term] and others"
    assert out[200].text == rows[-4][1] and not out[200].spans


def test_pii_terms_of_one_value_are_marked_and_copies_are_no_evidence(spark):
    rows = [(i, f"note {i} to me@example.org for Quirrel") for i in range(50)] + [(100 + i, "copy of Sprout at you@example.org") for i in range(50)]
    rows += [(200 + i, f"plain words {i} without any of them") for i in range(400)]
    # Flitwick: rarely beside an e-mail, but then always beside one rare value.
    rows += [(700 + i, f"memo {i} rare@example.org Flitwick") for i in range(6)] + [(800 + i, f"memo {i} Flitwick") for i in range(8)]
    out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    term = lambda i: [s.v for s in out[i].spans if s.k == 4]
    assert "Quirrel" in term(0) and "Sprout" not in term(100) and "Flitwick" in term(700)


def test_pii_terms_are_marked_in_documents_without_an_entity(spark, tmp_path):
    rows = [(i, f"write to u{i}@example.org courtesy of Quirrel and others") for i in range(8)] + [(100 + i, f"clean text number {i} and others of them write to") for i in range(60)]
    rows += [(200, "Quirrel alone, and quirrel again"), (200, "Quirrel alone, and quirrel again"), (200, "others"), (None, "by Quirrel"), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((repr(r.doc_id), r.text, [(s.s, s.v) for s in r.spans]) for r in find_pii(docs, everywhere=True).collect())
    assert [x for x in out if x[0] in ("200", "201", "202", "None")] == [
        ("200", "[term] alone, and [term] again", [(0, "Quirrel"), (19, "quirrel")]), ("200", "[term] alone, and [term] again", [(0, "Quirrel"), (19, "quirrel")]), ("200", "others", []),
        ("201", "", []), ("202", "", []), ("None", "by [term]", [(3, "Quirrel")]),
    ]
    base = {r.doc_id: (r.text, r.spans) for r in find_pii(docs).filter("doc_id < 200").collect()}
    assert {r.doc_id: (r.text, r.spans) for r in find_pii(docs, everywhere=True).filter("doc_id < 200").collect()} == base
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op3_pii(spark, str(tmp_path))
    assert [(r.n_email, r.spans) for r in found.filter("doc_id = 200").orderBy("spans").collect()] == [(0, ""), (0, "term:0:7,term:19:26"), (0, "term:0:7,term:19:26")]
    assert found.count() == len(rows)


def brute_fingerprint_sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_and_edited_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(100_000, None), (100_001, "a b"), (100_001, "😀 one two three four five"), (10**12, "X " * 9), (-5, "first of all")]
    out = edited_fingerprints(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string")).collect()
    assert len(out) == len(rows)
    texts = {d: t or "" for d, t in rows}
    ids = sorted(texts)
    for r in out:
        if r.doc_id in (100_000, 100_001):
            continue
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = brute_fingerprint_sets(text), brute_fingerprint_sets(edited)
        if len(a) < 64:
            assert len(r.fingerprint) == len(a)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.3


def test_sketches_merge_and_estimate(spark):
    left, right = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1500, 3500))
    df = spark.createDataFrame([(left, right, "", "same text here")], "a string, b string, c string, d string")
    fp = {c: fingerprint(F.col(c), k=256) for c in "abcd"}
    df = df.select(*[fp[c].alias(c) for c in "abcd"])
    a, b = F.col("a"), F.col("b")
    r = df.select(
        resemblance(a, b, 256).alias("similar"), containment(b, a, 256).alias("held"), distinct_shingles(a, 256).alias("many"), distinct_shingles(F.col("c"), 256).alias("zero"),
        distinct_shingles(merge(a, b, 256), 256).alias("whole"), resemblance(F.col("c"), F.col("c")).alias("empty"), F.size("d").alias("short"), as_string(F.col("d")).alias("hexed"),
    ).first()
    assert r.similar == pytest.approx(1496 / 3496, abs=0.12) and r.held == pytest.approx(0.75, abs=0.15)
    assert r.many == pytest.approx(2996, rel=0.2) and r.whole == pytest.approx(3496, rel=0.2)
    assert r.zero == 0 and r["empty"] == 1 and r.short == 1 and len(r.hexed) == 16


@pytest.mark.parametrize("kind", ("dense", "sparse", "hot", "nulls"))
def test_next_documents_whatever_the_ids(spark, monkeypatch, kind):
    """Small buckets: every document meets its next one; likeness is that of the shingle sets, within a sketch's error."""
    import random

    import tessella.llm.fingerprint as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 8)
    monkeypatch.setattr(module, "MOST_RANGES", 16)
    r = random.Random(1)
    n = 300
    ids = {"dense": range(n), "sparse": r.sample(range(-(2**61), 2**61), n), "hot": [5] * 100 + list(range(6, 6 + 200)), "nulls": [None] * 100 + [r.randrange(10**9) for _ in range(200)]}[kind]
    words = [f"w{i}" for i in range(200)]
    rows = [(i, f"{j} " + " ".join(words[r.randrange(150) :][: r.randrange(60)])) for j, i in enumerate(ids)]
    out = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, (x.doc_id for x in out))) == sorted(map(repr, ids))
    loose = [(i, t) for i, t in rows if i is None or ids.count(i) > 1] if kind in ("hot", "nulls") else []
    order = sorted(x for x in rows if x not in loose)
    halves = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    got = {x.doc_id: x for x in out if x.doc_id is not None}
    for (i, text), (_, after) in zip(order, order[1:], strict=False):
        assert got[i].edited_sha256 == halves(text, after)
        a, b = brute_fingerprint_sets(text), brute_fingerprint_sets(after)
        assert abs(got[i].near_next - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
    if not loose:
        assert got[order[-1][0]].edited_sha256 == halves(order[-1][1], order[0][1])


def test_fingerprints_of_few_documents(spark):
    one = edited_fingerprints(spark.createDataFrame([(7, "a b c d e f g")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.fingerprint and one.edited_sha256 == hashlib.sha256(b"a b c da b c ").hexdigest()
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = edited_fingerprints(spark.createDataFrame([(1, "x y z"), (9, "x y z"), (None, "x y z")], "doc_id long, text string")).collect()
    assert len({tuple(r.fingerprint) for r in same}) == 1 and all(r.near_next == 1 for r in same)
    with pytest.raises(TypeError):
        edited_fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_parts_merge_to_the_whole(spark):
    from tessella.llm.fingerprint import merge_parts

    text = " ".join(f"w{i % 700}" for i in range(1000))
    words = text.split()
    parts = [(1, " ".join(words[i : i + 104])) for i in range(0, 1000, 100)] + [(2, "a b")]
    df = spark.createDataFrame(parts, "k int, t string").select("k", fingerprint(F.col("t")).alias("fingerprint"))
    got = {r.k: r.fingerprint for r in merge_parts(df, ["k"]).collect()}
    whole = spark.createDataFrame([(1, text), (2, "a b")], "k int, t string").select("k", fingerprint(F.col("t")).alias("f"))
    assert got == {r.k: r.f for r in whole.collect()}


def test_very_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"é{i} u{i}@h{i}.example.org" for i in range(40_000))
    rows = [(1, text), (1, "to a@b.org"), (None, "to a@b.org"), (None, None)]
    began = time.time()
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_email", "text", F.try_element_at("spans", F.lit(-1)).alias("last")).collect()
    assert time.time() - began < 120
    long = next(r for r in out if r.n_email > 1)
    assert long.n_email == 40_000 and long.last.e == len(text)
    assert long.text == " ".join(f"é{i} [email]" for i in range(40_000))
    assert sorted((repr(r.doc_id), r.text) for r in out if r.n_email < 2) == [("1", "to [email]"), ("None", ""), ("None", "to [email]")]
