"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set holds its distinct word shingles.  Documents are linked
when their sets' Jaccard similarity reaches a threshold; groups are the
connected components.

1. Signatures of COLUMNS min-hashes are computed document by document.
   Documents with equal sets (128-bit set hash) become one node.
2. The forest: TREES sorted orders of the nodes, each by its own sequence
   of signature columns.  A region of a tree is a run of nodes that share
   the first DEPTH columns of its order; inside it nodes are sorted by
   the following columns, so that the nearest rows are those with the
   longest common prefix.
3. Depth adapts to density.  In a region of at most WINDOW nodes everyone
   meets.  In a denser one a row's candidates are the DENSE_WINDOW rows
   that follow it, and so those with the longest common prefixes, long
   enough to hold no more; step 4 settles the rest of it exactly.
   Candidates have to agree in size and in a 64-column sketch, within six
   standard deviations of the threshold.  First every node confirms its
   few nearest neighbours, and components follow; then candidates between
   different components are confirmed in rounds, the few best of every
   component, then more, then all that still join two components.
4. The rest of the denser regions is settled exactly.  Regions whose nodes
   all belong to one component are closed.  Nodes that share an open one
   are gathered into clusters, cut by set size and hash into blocks of
   about BLOCK nodes, and pairs of blocks that can hold links compare
   their full sets in one task each, which returns a spanning forest.
   This alone grows with the square of a region.
5. Links are always confirmed on full shingle sets, fetched only for the
   nodes that need them.

With TREES = 32 and DEPTH = 4 a pair at similarity 0.8 shares no region
with probability (1 - 0.8**4)**32 = 5e-8.

No stage gathers a group in one task: exact copies collapse by partial
aggregation, the orders are sorted by range, whatever a region's size
(pairs across the ends of partitions are found from their edges), and
open regions are dealt out in blocks.

Edge cases: null, empty or blank texts have an empty set and no links;
fewer words than a shingle make one shingle; rows that repeat an id are
one document, linked through all its texts; a null id is linked with
nothing and kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import broadcast_if, materialize, tidy
from tessella.llm.components import connected_components, grow_components

TREES, DEPTH = 32, 4
COLUMNS = TREES * DEPTH
#: Signature columns that sort a region, after the DEPTH that define it.
DEEPER = 8
SKETCH = 64
WINDOW = 64
#: Following rows that a row of a region of more than WINDOW nodes meets.
DENSE_WINDOW = 4
#: Nodes of a block of an open region.
BLOCK = 256
#: Neighbours that a node confirms in the first pass.
FIRST = 3
#: Candidates that a component confirms in each round.
ROUNDS = (2, 8)
BROADCAST_KEYS, BROADCAST_IDS = 50_000, 500_000

_random = np.random.default_rng(20260101)
MULTIPLIERS = _random.integers(0, 2**63, COLUMNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The order of signature columns in each tree: its own DEPTH columns first, then a walk through the others.
ORDERS = [[(t * DEPTH + i) % COLUMNS for i in range(DEPTH)] + [(t * DEPTH + DEPTH + i * 13) % COLUMNS for i in range(DEEPER)] for t in range(TREES)]
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(values: np.ndarray) -> np.ndarray:
    """COLUMNS min-hashes, 32 bits each."""
    least = np.full(COLUMNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(least, np.multiply.outer(MULTIPLIERS, values[at : at + 1024]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) -> id, n, ka, kb, sig; one row for each row, sig null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, sigs = [], [], [], []
            for value in batch.column("text"):
                s = shingle_set(value.as_py(), width)
                sizes.append(len(s))
                raw = s.tobytes()
                first.append(xxhash.xxh64_intdigest(raw) - 2**63)
                second.append(xxhash.xxh64_intdigest(raw, 1) - 2**63)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "n", "ka", "kb", "sig"])

    return docs.mapInArrow(tidy(run), "id long, n long, ka long, kb long, sig binary")


def _orders(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: key (the tree and its first DEPTH columns), p1 and p2 (the deeper ones), node, n, component, s0..s3 (sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                m = part.num_rows
                if not m:
                    continue
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(m, COLUMNS).astype(np.uint64)
                keys, paths = [], ([], [])
                for t, order in enumerate(ORDERS):
                    key = np.full(m, np.uint64(t + 1)) * MIX
                    for c in order[:DEPTH]:
                        key = (key ^ (key >> np.uint64(31)) ^ sig[:, c]) * MIX
                    keys.append(key ^ (key >> np.uint64(29)))
                    for p, columns in zip(paths, (order[DEPTH : DEPTH + 4], order[DEPTH + 4 :]), strict=True):
                        value = np.zeros(m, np.uint64)
                        for c in columns:
                            value = (value << np.uint64(16)) | (sig[:, c] & np.uint64(0xFFFF))
                        p.append(value)
                nibbles = sig[:, :: COLUMNS // SKETCH] & np.uint64(15)
                words = [(nibbles[:, i * 16 : i * 16 + 16] << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64) for i in range(4)]
                out = {"key": np.concatenate(keys).view(np.int64), "p1": np.concatenate(paths[0]).view(np.int64), "p2": np.concatenate(paths[1]).view(np.int64)}
                out |= {c: np.tile(part.column(c).to_numpy(), TREES) for c in ("node", "n", "component")}
                out |= {f"s{i}": np.tile(w, TREES) for i, w in enumerate(words)}
                yield pa.RecordBatch.from_pydict(out)

    return nodes.select("node", "n", "component", "sig").mapInArrow(tidy(run), "key long, p1 long, p2 long, node long, n long, component long, s0 long, s1 long, s2 long, s3 long")


def _forest(nodes: DataFrame, large: DataFrame, n_large: int, partitions: int) -> DataFrame:
    """The orders, sorted by range; dense is 1 for rows of large regions, else 0."""
    order = ["key", "p1", "p2", "node"]
    marked = _orders(nodes).join(broadcast_if(large.withColumn("dense", F.lit(1).cast("long")), n_large, BROADCAST_KEYS), "key", "left")
    return marked.withColumn("dense", F.coalesce("dense", F.lit(0).cast("long"))).repartitionByRange(partitions, *order).sortWithinPartitions(*order)


FOREST = ["key", "dense", "node", "n", "component", "s0", "s1", "s2", "s3"]
OUT = "kind int, key long, dense long, a long, b long, ca long, cb long, same int, at int, side int, place int, n long, component long, s0 long, s1 long, s2 long, s3 long"
PAIR, HALO = 0, 1


def _agreement(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sketch columns in which rows i and j agree."""
    same = np.full(len(i), SKETCH)
    for k in range(4):
        x = rows[f"s{k}"][i] ^ rows[f"s{k}"][j]
        x |= x >> 2
        x |= x >> 1
        same -= np.bitwise_count((x & 0x1111111111111111).view(np.uint64))
    return same


def least_agreement(percent: int) -> int:
    """The sketch agreement that a pair at the threshold falls short of with probability 1e-9."""
    p = percent / 100 + (1 - percent / 100) / 16
    return max(1, int(SKETCH * p - 6 * (SKETCH * p * (1 - p)) ** 0.5))


def _pairs(rows: dict[str, np.ndarray], fresh: int, reach: int, across: bool, percent: int) -> dict[str, np.ndarray]:
    """Candidates among sorted rows, within `reach` places (DENSE_WINDOW in large regions), whose later row is at or after position `fresh`."""
    key, n, node, component = rows["key"], rows["n"], rows["node"], rows["component"]
    found = []
    left = np.arange(len(key))
    for d in range(1, reach + 1):
        left = left[left + d < len(key)]
        left = left[key[left] == key[left + d]]
        if d > DENSE_WINDOW:
            left = left[rows["dense"][left] == 0]
        if not len(left):
            break
        i = left[left + d >= fresh]
        j = i + d
        ok = (node[i] != node[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        if across:
            ok &= component[i] != component[j]
        i, j = i[ok], j[ok]
        same = _agreement(rows, i, j)
        ok = same >= least_agreement(percent)
        found.append((i[ok], j[ok], same[ok]))
    i, j, same = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    low = node[i] < node[j]
    return {"a": np.where(low, node[i], node[j]), "b": np.where(low, node[j], node[i]), "ca": np.where(low, component[i], component[j]), "cb": np.where(low, component[j], component[i]), "same": same.astype(np.int32), "dense": rows["dense"][i]}


def _batch(kind: int, columns: dict[str, np.ndarray], size: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in OUT.split(", ")]
    columns = {"kind": np.full(size, kind)} | columns
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names=names)


def _scan(forest: DataFrame, reach: int, across: bool, percent: int) -> DataFrame:
    """Candidates of the sorted forest, also across the ends of its partitions; without a column dense all its regions are small."""
    if "dense" not in forest.columns:
        forest = forest.withColumn("dense", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        carry = {c: np.zeros(0, np.int64) for c in FOREST}
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy() for c in FOREST}
            if seen < reach:
                head = {c: v[: reach - seen] for c, v in new.items()}
                yield _halo(head, at, 1, seen)
            seen += batch.num_rows
            held = len(carry["key"])
            rows = {c: np.concatenate([carry[c], new[c]]) for c in FOREST}
            pairs = _pairs(rows, held, reach, across, percent)
            if len(pairs["a"]):
                yield _batch(PAIR, pairs, len(pairs["a"]))
            carry = {c: v[-reach:] for c, v in rows.items()}
        if seen:
            yield _halo(carry, at, 0, 0)

    def _halo(rows: dict[str, np.ndarray], at: int, side: int, place: int) -> pa.RecordBatch:
        m = len(rows["key"])
        columns = {c: rows[c] for c in FOREST if c != "node"} | {"a": rows["node"], "at": np.full(m, at), "side": np.full(m, side), "place": np.arange(place, place + m)}
        return _batch(HALO, columns, m)

    found = materialize(forest.select(*FOREST).mapInArrow(tidy(run), OUT), "candidates")
    halos = found.filter(F.col("kind") == HALO)

    def across_seam(table: pa.Table) -> pa.Table:
        """Pairs of a partition's last rows with the first rows of those that follow it (and again those among the latter)."""
        table = table.sort_by([("at", "ascending"), ("side", "descending"), ("place", "ascending")])
        rows = {c: table.column("a" if c == "node" else c).to_numpy() for c in FOREST}
        fresh = int((table.column("side").to_numpy() == 0).sum())
        pairs = _pairs(rows, fresh, reach, across, percent)
        return pa.Table.from_batches([_batch(PAIR, pairs, len(pairs["a"]))])

    # A seam reads on over short and empty partitions until it has `reach` rows.
    heads = {r["at"]: r["n"] for r in halos.filter("side = 1").groupBy("at").agg(F.count("*").alias("n")).collect()}  # a row a partition
    order, met = sorted(heads), []
    for i, at in enumerate(order):
        rows = 0
        for following in order[i + 1 :]:
            if rows >= reach:
                break
            met.append((at, following, 1))
            rows += heads[following]
    met += [(at, at, 0) for at in order]
    dealt = halos.join(F.broadcast(halos.sparkSession.createDataFrame(met, "seam int, at int, side int")), ["at", "side"])  # at most `reach` rows for each partition
    seams = dealt.groupBy("seam").applyInArrow(across_seam, OUT)
    return found.filter(F.col("kind") != HALO).unionByName(seams)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the full shingle sets of the documents whose id is in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(x.as_py(), width).view(np.int64) for x in part.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), values], names=["id", "s"])

    ids = materialize(ids.distinct(), "ids")
    # While few documents need their sets, texts stay where they are.
    wanted = docs.join(broadcast_if(ids, ids.count(), BROADCAST_IDS), "id", "left_semi")
    return materialize(wanted.mapInArrow(tidy(run), "id long, s array<long>"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), width)
    one, two = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between the sides of a pair of blocks, from full sets."""
    ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
    sets = [np.asarray(v.values) for v in table.column("s")]
    sizes = np.array([len(v) for v in sets])
    values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    often = count[column] > 1
    column, rows = number[column[often]], rows[often]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        low, high = np.searchsorted(column, (at, at + 2048))
        held = np.zeros((len(sets), 2048), np.float32)
        held[rows[low:high], column[low:high] - at] = 1
        shared += held @ held.T
    linked = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & ((side[:, None] != side[None, :]) | (side.max() == 0))
    fresh, pairs = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        waiting = [seed]
        while waiting:
            at = waiting.pop()
            for other in np.nonzero(linked[at] & fresh)[0]:
                fresh[other] = False
                waiting.append(other)
                pairs.append((at, other))
    one, two = (ids[[p[i] for p in pairs]] if pairs else ids[:0] for i in (0, 1))
    return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})


def _open_region_links(nodes: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among nodes that share an open region.  members: (key, node)."""
    hubs = members.groupBy("key").agg(F.min("node").alias("a"))
    clusters = connected_components(members.join(hubs, "key").select("a", F.col("node").alias("b")))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    placed = nodes.select("node", "n").join(clusters, "node").select("node", F.col("component").alias("cluster"), band.alias("band"))
    placed = materialize(placed, "clusters")
    units = placed.groupBy("cluster", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("units"))
    units = materialize(units.select("*", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit")), "units")
    mine = placed.join(units.select("cluster", "band", "units").distinct(), ["cluster", "band"])
    mine = mine.select("node", "cluster", "band", F.pmod(F.xxhash64("node"), F.col("units")).cast("int").alias("unit"))
    # Every unit meets the units of its own band and of the next one, each pair of units once.
    left = units.select("cluster", "band", "unit")
    right = units.select("cluster", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("band2"), F.col("unit").alias("unit2"))
    meetings = left.join(right, ["cluster", "band"]).filter((F.col("band2") > F.col("band")) | (F.col("unit2") >= F.col("unit")))
    meetings = materialize(meetings.withColumn("meeting", F.monotonically_increasing_id()), "meetings")
    first = mine.join(meetings, ["cluster", "band", "unit"]).select("meeting", F.lit(0).alias("side"), F.col("node").alias("id"))
    apart = meetings.filter((F.col("band") != F.col("band2")) | (F.col("unit") != F.col("unit2")))
    apart = apart.select("meeting", "cluster", F.col("band2").alias("band"), F.col("unit2").alias("unit"))
    second = mine.join(apart, ["cluster", "band", "unit"]).select("meeting", F.lit(1).alias("side"), F.col("node").alias("id"))
    sets = _sets(docs, placed.select(F.col("node").alias("id")), width)
    dealt = first.unionByName(second).join(sets, "id")
    return dealt.groupBy("meeting").applyInArrow(lambda t: _block_links(t, percent), "a long, b long")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, node) of regions that hold more than one component."""
    rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sides = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    keys = materialize(sides.filter("lo <> hi").select("key"), "open-regions")
    return materialize(members.join(broadcast_if(keys, keys.count(), BROADCAST_KEYS), "key", "left_semi"), "open-members")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are still in different components, with ca and cb (the smaller first)."""
    for c in "ab":
        pairs = pairs.drop(f"c{c}").join(labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs.filter("ca <> cb").withColumns({"ca": F.least("ca", "cb"), "cb": F.greatest("ca", "cb")})


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_shingles long, component_id long and kept boolean, for every row."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold integers: groups are named by their smallest id")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sigs = materialize(_signatures(rows, shingle), "signatures")
    linked = sigs.filter("n > 0 AND id IS NOT NULL")
    reps = materialize(linked.groupBy("ka", "kb").agg(F.min("id").alias("node")), "copies")
    nodes = materialize(linked.join(reps.withColumnRenamed("node", "id"), ["ka", "kb", "id"]).select(F.col("id").alias("node"), "n", "sig"), "nodes")
    texts = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    n_rows, usual = nodes.count() * TREES, int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(usual, n_rows // 4096), n_rows // 4_000_000)

    # A document that several rows give different texts joins its texts' groups.
    several = linked.join(reps, ["ka", "kb"]).groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("id")
    edges = linked.join(broadcast_if(several, several.count(), BROADCAST_KEYS), "id").join(reps, ["ka", "kb"]).select(F.col("id").alias("a"), F.col("node").alias("b"))

    # Large regions are known by their size; most are closed by the time they are looked at.
    orders = _orders(nodes.withColumn("component", F.col("node"))).drop("p1", "p2", "component")
    large = materialize(orders.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > WINDOW).select("key"), "large-regions")
    n_large = large.count()

    # First pass: nearest neighbours, a few best for each node.
    near = _scan(_forest(nodes.withColumn("component", F.col("node")), large, n_large, partitions), 1, False, percent).filter(F.col("kind") == PAIR).select("a", "b", "same").distinct()
    sides = near.select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("e"), "a", "b", "same").select("e.x", "a", "b", "same")
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("same"), F.xxhash64("a", "b")))
    first = materialize(sides.withColumn("r", rank).filter(F.col("r") <= FIRST).select("a", "b").distinct(), "first-pairs")
    edges = materialize(edges.unionByName(_confirm(first, texts, shingle, percent)), "links")
    labels = connected_components(edges)

    # Second pass: all neighbours in the window that would join two components.
    labelled = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = _scan(_forest(labelled, large, n_large, partitions), WINDOW, True, percent)
    pairs = found.filter(F.col("kind") == PAIR).groupBy("a", "b", "same", "ca", "cb").agg(F.max("dense").alias("dense"))
    pairs = materialize(pairs.join(first, ["a", "b"], "left_anti"), "cross-pairs")
    labels, pairs = _join_components(pairs, texts, labels, shingle, percent, ROUNDS)

    # What that leaves of large regions is settled in blocks; all other candidates are confirmed one by one.
    if n_large:
        members = materialize(orders.join(broadcast_if(large, n_large, BROADCAST_KEYS), "key", "left_semi").select("key", "node"), "large-members")
        left = _open_members(members, labels)
        if not left.isEmpty():
            labels = grow_components(labels, _open_region_links(nodes, left, texts, shingle, percent))
            pairs = _across(pairs.filter("dense = 0"), labels)  # a pair of a large region is settled there
    labels, _ = _join_components(pairs, texts, labels, shingle, percent, (None,))

    # Components by their smallest id, for every row.
    reps = materialize(reps.join(labels, "node", "left").select("ka", "kb", F.coalesce("component", "node").alias("component_id")), "groups")
    out = sigs.join(reps, ["ka", "kb"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _join_components(pairs: DataFrame, texts: DataFrame, labels: DataFrame, shingle: int, percent: int, rounds: tuple[int | None, ...]) -> tuple[DataFrame, DataFrame]:
    """Confirms candidates between components, in rounds: every component tries its few best (all, if None), components are joined, and so on.

    pairs: a, b, same and the components ca, cb that labels gives a and b.  Returns the new labels and the pairs left between components.
    """
    for best in rounds:
        tried = pairs
        if best:
            ends = pairs.select(F.explode(F.array("ca", "cb")).alias("x"), "a", "b", "same")
            rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("same"), F.xxhash64("a", "b")))
            tried = ends.withColumn("r", rank).filter(F.col("r") <= best).select("a", "b").distinct()
        tried = materialize(tried.select("a", "b"), "open-pairs")
        if tried.isEmpty():
            break
        more = materialize(_confirm(tried, texts, shingle, percent), "links")
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if not more.isEmpty():
            labels = grow_components(labels, more)
            pairs = _across(pairs, labels)
        if best:
            pairs = materialize(pairs, "cross-pairs")
    return labels, pairs


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END) AS g FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, c.component_id = n.doc_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id
"""
