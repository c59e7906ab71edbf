"""Near-duplicate groups and components against brute force."""

import random
import re

import numpy as np
import pytest

import tessella.llm.neardup as neardup
from tessella.llm.components import connected_components, grow_components
from tessella.llm.neardup import near_duplicates

SF = "/root/testdata/sf0.001"


def brute(rows, width, percent=80):
    sets = []
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if same or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else low[root(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=repr)


def check(spark, rows, width):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in near_duplicates(df, shingle=width).collect()), key=repr)
    assert got == brute(rows, width)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(5, "A b"), (3, "a  B\n"), (9, "a"), (8, "A"), (1, None), (2, ""), (4, " \t"), (None, "a b"), (7, long), (11, long + " w100"), (11, "a"), (6, "Ä x"), (10, "ä x"), (7, long)]
    check(spark, rows, 2)
    check(spark, [], 2)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 5)


@pytest.mark.parametrize(("window", "block"), [(64, 256), (3, 16)])
def test_large_group_of_near_copies(spark, monkeypatch, window, block):
    """Also with regions far larger than what is searched whole, in many blocks."""
    monkeypatch.setattr(neardup, "WINDOW", window)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(r.choice((1, 2, 9))):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(spark, rows, 2)


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 302), (302, 300)] + [(500, 500 + i) for i in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 150, 200)} == {100} and {got[i] for i in (300, 301, 302)} == {300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_as_if_made_anew(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(int(x) for x in rng.integers(0, 300, 2)) for _ in range(220)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for cut in (0, 60, 150, 220):
        grown = grow_components(connected_components(frame(pairs[:cut])), frame(pairs[cut:]))
        assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, connected_components(frame(pairs)).collect())), cut


def test_scan_reads_on_over_short_and_empty_partitions(spark):
    """A region of five rows, in six partitions of one row or none, gives all its pairs within reach."""
    from pyspark.sql import functions as F

    zero = [f"cast(0 as bigint) s{i}" for i in range(4)]
    node = "id - cast(id > 2 as int)"
    forest = spark.range(0, 6, 1, 6).filter("id <> 2").selectExpr("cast(7 as bigint) key", f"{node} node", "cast(10 as bigint) n", f"{node} component", *zero)
    assert forest.rdd.glom().map(len).collect() == [1, 1, 0, 1, 1, 1]
    for reach in (1, 2, 3, 64):
        found = {(r.a, r.b) for r in neardup._scan(forest, reach, True, 80).filter(F.col("kind") == neardup.PAIR).collect()}
        assert found == {(i, j) for i in range(5) for j in range(i + 1, 5) if j - i <= reach}


def test_open_regions_lose_no_link(spark, monkeypatch):
    """Many texts of one template, too dense for the window and mostly not linked; links hidden among them are found."""
    monkeypatch.setattr(neardup, "WINDOW", 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(3)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = base[:]
        for at in r.sample(range(80), 7):
            w[at] = f"x{i}y{at}"
        rows.append((3 * i, " ".join(w)))
        if i % 6 == 0:
            w[r.randrange(80)] = f"z{i}"
            rows.append((3 * i + 1, " ".join(w)))
    check(spark, rows, 2)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
