"""Data sources, file formats and the stream of arriving files."""

import numpy as np
import pytest

from tessella.codec import container
from tessella.operators import corpus
from tessella.plans.rasters import rgb_lines
from tessella.sources import netpbm, register
from tessella.streaming import decoded_stream, header_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", (8, 12, 16))
@pytest.mark.parametrize("n", (1, 3))
def test_netpbm(bits, n):
    p = np.random.default_rng(0).integers(0, 1 << bits, (n, 5, 7))
    for write, read in ((netpbm.write_pnm, netpbm.read_pnm), (netpbm.write_pam, netpbm.read_pam)):
        planes, found = read(write(p, bits))
        assert found == bits and (planes == p).all()


def test_pnm_comments_and_faults():
    planes, bits = netpbm.read_pnm(b"P5\n# made by hand\n3 2 # wide\n255\n" + bytes(range(6)))
    assert planes.tolist() == [[[0, 1, 2], [3, 4, 5]]] and bits == 8
    for bad in (b"P2\n1 1\n255\n0", b"P5\n3 3\n255\n12", b"P5\n3"):
        with pytest.raises(ValueError):
            netpbm.read_pnm(bad)


def test_bmp():
    def bmp(height):
        body = b"".join(bytes([y * 10 + x for x in range(6)]) + b"\0\0" for y in range(2))
        return b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + height.to_bytes(4, "little", signed=True) + b"\1\0\x18\0" + bytes(24) + body

    up, down = netpbm.read_bmp(bmp(2))[0], netpbm.read_bmp(bmp(-2))[0]
    assert (up[:, ::-1] == down).all() and down[0].tolist() == [[2, 5], [12, 15]]


@pytest.mark.parametrize(("name", "options"), [("jls", {"interleave": "sample"}), ("jls", {}), ("pnm", {}), ("pam", {})])
def test_written_files_read_back(spark, tmp_path, name, options):
    register(spark)
    lines = rgb_lines(spark, SF)
    lines.repartition(3, "image_id").write.format(name).mode("append").options(bits=8, **options).save(str(tmp_path))
    back = spark.read.format(name).load(str(tmp_path))
    found = back.selectExpr("cast(regexp_extract(path, '([0-9]+)[.]', 1) as long) image_id", "component", "y", "samples")
    assert found.exceptAll(lines).isEmpty() and lines.exceptAll(found).isEmpty()
    assert back.filter("width = 99").isEmpty() and back.filter("width = 22 and component_count >= 3").count() == lines.count()


def test_stream_of_files(spark, tmp_path):
    good = container.encode(np.arange(12).reshape(1, 3, 4), 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jls").write_bytes(good)
    (tmp_path / "in" / "b.jls").write_bytes(good[:-9])

    def rows(stream, name):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    lines = rows(decoded_stream(spark, str(tmp_path / "in")), "lines")
    assert sorted(r.samples for r in lines if r.errc == 0) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert sum(r.errc != 0 for r in lines) == 1
    headers = rows(header_stream(spark, str(tmp_path / "in"), corpus.DROPMALFORMED), "headers")
    assert [r.frame.width for r in headers] == [4]


def test_command_line(spark, tmp_path):
    from tessella import cli

    (tmp_path / "in").mkdir()
    p = np.random.default_rng(1).integers(0, 256, (3, 6, 5))
    (tmp_path / "in" / "a.pnm").write_bytes(netpbm.write_pnm(p, 8))
    (tmp_path / "in" / "b.pnm").write_bytes(netpbm.write_pnm(p[:1] * 16, 12))
    cli.main(["encode", str(tmp_path / "in"), str(tmp_path / "jls"), "--near", "1"], spark)
    cli.main(["decode", str(tmp_path / "jls"), str(tmp_path / "out")], spark)
    decoded = [netpbm.read_pnm(f.read_bytes())[0] for f in (tmp_path / "out").iterdir()]
    assert sorted(len(d) for d in decoded) == [1, 3] and all(abs(d - (p if len(d) == 3 else p[:1] * 16)).max() <= 1 for d in decoded)
    assert cli.main(["compare", str(tmp_path / "in"), str(tmp_path / "in")], spark).agg({"differing": "sum"}).first()[0] == 0
