"""Lossless encoding as a dataflow: windows, keyed folds and one packing step (planar images, NEAR 0).

Without loss every neighbour is an original sample, so context, mode and
prediction of a sample need no state.  What is adaptive is a fold by key:
each regular context of a scan by itself, and the scan's runs with their
interruptions under key 0, a context that no regular sample has.  Three
shuffles: by scan for the windows, by (scan, key) for the folds, and back
by scan to pack.  A scan has up to 365 keys of a few samples each, so that
a fold streams sorted rows, all keys of a task one after the other;
packing never holds more than one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.codec.scan import RUN_ORDERS, Encoder, Model, default_presets, stuff
from tessella.operators.corpus import spread
from tessella.operators.template import contexts, modes, neighbours, run_lengths

KEY = ["image_id", "component", "key"]
CODES = "image_id long, component int, y int, x int, word binary"


@lru_cache(maxsize=1 << 16)
def to_bytes(word: str) -> bytes:
    """A bit string behind a leading 1, as bytes."""
    value = int("1" + word, 2)
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


@lru_cache(maxsize=1 << 16)
def from_bytes(data: bytes) -> str:
    return format(int.from_bytes(data, "big"), "b")[1:]


class _Fold(Encoder):
    """The sequential coder's symbol steps, fed with one key's symbols after another's."""

    def __init__(self, bits: int):
        super().__init__(Model(bits, 0, default_presets((1 << bits) - 1, 0)))
        self.first = self.model.state[0]
        self.begin()

    def start(self, key: int) -> None:
        """The key's state at the start of a scan."""
        m, a = self.model, self.first[0]
        if key:
            m.state[key] = self.first
        else:
            self.run_index, m.run_a, m.run_n, m.run_nn = 0, [a, a], [1, 1], [0, 0]

    def run_end(self, length: int, whole: bool, ra: int, rb: int, x: int) -> str:
        """The code word of a run, and of the sample that interrupts it if it does not last for the whole of its line."""
        word, index = "", self.run_index
        while length >= 1 << RUN_ORDERS[index]:
            word, length, index = word + "1", length - (1 << RUN_ORDERS[index]), min(31, index + 1)
        self.run_index = index
        if whole:
            return word + "1" * bool(length)
        self.interrupt(int(ra == rb), ra, rb, x)
        self.run_index = max(0, index - 1)
        return word + format(length, f"0{RUN_ORDERS[index] + 1}b") + self.words.pop()


def symbols(rows: DataFrame) -> DataFrame:
    """The rows that have a code word, with their key: regular samples, and the ends of runs."""
    rows = run_lengths(rows).filter("mode = 'regular' OR length IS NOT NULL")
    key = F.when(F.col("mode") == "regular", F.abs("ctx")).otherwise(0).alias("key")
    return rows.select(F.col("image_id").cast("long"), F.col("component").cast("int"), key, F.col("y").cast("int"), F.col("x").cast("int"), "ctx", "ra", "rb", "rc", "sample", "length", (F.col("mode") == "run").alias("whole"))


def code_words(found: DataFrame, bits: int) -> DataFrame:
    """Code words of symbols(): a fold by (scan, key)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, at = _Fold(bits), None
        regular, words = f.regular, f.words
        for t in batches:
            out = []
            for image_id, component, key, q, ra, rb, rc, x, length, whole in zip(*(t.column(c).to_pylist() for c in (*KEY, "ctx", "ra", "rb", "rc", "sample", "length", "whole")), strict=True):
                if (image_id, component, key) != at:
                    at = image_id, component, key
                    f.start(key)
                if key:
                    regular(q, ra, rb, rc, x)
                    out.append(to_bytes(words.pop()))
                else:
                    out.append(to_bytes(f.run_end(length, whole, ra, rb, x)))
            names = ["image_id", "component", "y", "x"]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "word"])

    return spread(found, *KEY).sortWithinPartitions(*KEY, "y", "x").mapInArrow(fold, CODES)


def encode_lossless(lines: DataFrame, bits: int) -> DataFrame:
    """(image_id, component, data): coded data of every planar scan."""
    words = code_words(symbols(modes(contexts(neighbours(spread(lines, "image_id")), bits))), bits)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("y", "ascending"), ("x", "ascending")])
        text = "".join(map(from_bytes, t.column("word").to_pylist()))
        return pa.table({"image_id": t.column("image_id")[:1], "component": t.column("component")[:1], "data": pa.array([stuff(text)], pa.binary())})

    return spread(words, "image_id", "component").groupBy("image_id", "component").applyInArrow(pack, "image_id long, component int, data binary")
