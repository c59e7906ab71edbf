"""Every query with oracle SQL against DuckDB, and corpus operators."""

import duckdb
import numpy as np
import pytest

from tessella.codec import container
from tessella.codec.container import Options
from tessella.codec.scan import default_presets
from tessella.operators import corpus
from tessella.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), ORACLES[name]
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    listed = ", ".join(f'"{k}"' for k in columns)
    assert got == sorted(map(repr, duck.sql(f"SELECT {listed} FROM ({sql})").fetchall()))
    assert sorted(duck.sql(sql).columns) == columns and got


def test_thresholds_of_three_bits():
    p = default_presets(7, 0)
    assert (p.t1, p.t2, p.t3) == (2, 3, 4)


def test_modes_of_failure(spark):
    good, bad = container.encode(np.zeros((1, 2, 2), int), 8), b"\xff\xd8\xff\x00"
    images = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, b"")], "image_id long, content binary")
    rows = {r.image_id: r for r in corpus.read_headers(images).collect()}
    assert rows[1].errc == 0 and rows[2].errc == 13 and rows[3].errc == rows[4].errc == 4 and rows[2].error_message.startswith("Invalid JPEG-LS")
    assert corpus.decode_images(images, corpus.DROPMALFORMED).count() == 2
    assert corpus.decode_images(images).filter("errc <> 0").count() == 3
    with pytest.raises(Exception, match="image 2"):
        corpus.decode_images(images.filter("image_id < 3"), corpus.FAILFAST).collect()
    assert corpus.decode_images(images.filter("image_id = 1"), max_bytes=3).first().errc == 1
    assert corpus.read_headers(images.limit(0)).count() == 0


def test_encode_raw_images(spark):
    schema = "image_id long, width int, height int, bits_per_sample int, component_count int, ilv int, stride int, near int, content binary"
    rows = [(1, 2, 2, 8, 3, 2, 0, 0, bytes(range(12))), (2, 2, 2, 8, 1, 0, 1, 0, bytes(4)), (3, 0, 2, 8, 1, 0, 0, 0, b""), (4, 2, 2, 8, 1, 0, 0, 0, b"")]
    out = {r.image_id: r for r in corpus.encode_raw(spark.createDataFrame(rows, schema)).collect()}
    assert [out[i].errc for i in (1, 2, 3, 4)] == [0, 111, 102, 110]
    assert container.from_planes(container.decode(bytes(out[1].content))[1], 8, 2) == bytes(range(12))


def test_segments_of_a_broken_file(spark):
    whole = container.encode(np.zeros((1, 2, 2), int), 8, Options(comments=[b"note"]))
    df = spark.createDataFrame([(1, whole[:-2])], "image_id long, content binary")
    assert [r.marker_name for r in corpus.read_segments(df).orderBy("seq").collect()] == ["SOI", "COM", "SOF55", "SOS"]
