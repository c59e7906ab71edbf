"""The dataflow of lossless coding against the sequential coder."""

import numpy as np
import pytest

from tessella.codec.scan import default_presets, encode_scan
from tessella.operators.folds import encode_lossless, from_bytes, to_bytes
from tessella.operators.template import contexts, modes, neighbours, runs


def _planes(bits: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """Noise, steps with runs and blank planes of several images and components, some of one line or one column."""
    r = np.random.default_rng(seed)
    top = (1 << bits) - 1
    out = {}
    for image_id, (h, w) in enumerate(((9, 40), (1, 70), (30, 1), (6, 300))):
        out[image_id, 0] = r.integers(0, top + 1, (h, w))
        out[image_id, 1] = np.repeat(r.integers(0, 2, (h, w // 9 + 1)) * top, 9, 1)[:, :w]
        out[image_id, 2] = np.zeros((h, w), int)
        out[image_id, 3] = np.where(r.random((h, w)) < 0.03, r.integers(0, top + 1, (h, w)), top // 2)
    return out


def _lines(spark, planes):
    rows = [(i, c, y, line.tolist()) for (i, c), p in planes.items() for y, line in enumerate(p)]
    return spark.createDataFrame(rows, "image_id long, component int, y int, samples array<int>")


@pytest.mark.parametrize("bits", (2, 8, 16))
@pytest.mark.parametrize("batch", (7, 10000))
def test_data_are_those_of_the_sequential_coder(spark, bits, batch):
    """Also when a key goes on over several batches, and a task holds many keys of several scans."""
    planes, conf = _planes(bits, bits), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, batch)
    try:
        got = {(r.image_id, r.component): bytes(r.data) for r in encode_lossless(_lines(spark, planes), bits).collect()}
    finally:
        spark.conf.set(conf, before)
    presets = default_presets((1 << bits) - 1, 0)
    assert got == {k: encode_scan([p], bits, 0, 0, presets) for k, p in planes.items()}


def test_one_pass_over_the_samples_and_no_group_by_context(spark):
    """A group of Python rows costs about a millisecond, and a scan has up to 365 contexts; windows over samples are made once."""
    plan = encode_lossless(_lines(spark, _planes(8, 0)), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    assert plan.count("FlatMapGroupsInArrow") == 1  # the packing, by scan


def test_runs_of_every_plane(spark):
    """Against a walk over the modes of each line."""
    rows = modes(contexts(neighbours(_lines(spark, _planes(8, 1))), 8)).persist()
    lines = {}
    for r in rows.select("image_id", "component", "y", "x", "mode").orderBy("image_id", "component", "y", "x").collect():
        lines.setdefault((r.image_id, r.component, r.y), []).append(r.mode)
    expected = set()
    for k, found in lines.items():
        x0 = None
        for x, mode in enumerate(found):
            if mode == "regular":
                continue
            x0 = x if x0 is None else x0
            if mode == "interrupt":
                expected.add((*k, x0, x - x0, False))
                x0 = None
        if x0 is not None:
            expected.add((*k, x0, len(found) - x0, True))
    got = [tuple(r) for r in runs(rows).collect()]
    rows.unpersist()
    assert len(got) == len(expected) and set(got) == expected


def test_words_of_any_length():
    for word in ("", "0", "1", "0000001", "00000000", "1" * 50 + "0" * 64):
        assert from_bytes(to_bytes(word)) == word
