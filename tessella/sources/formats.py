"""Python data sources jls, pnm, pam and bmp over files that Spark lists and reads.

Files are found with the `path` option.  Reading parses headers first, so
that filters on width, height, component_count and bits_per_sample (all
pushed down) skip the decoding of files that cannot match; selecting
samples is what makes a file be decoded.  Rows are one line each:
(path, width, height, bits_per_sample, component_count, component, y,
samples).  Writing takes (image_id, component, y, samples), an image
wholly in one partition, and makes one file an image.

These sources use the local or mounted file system of the executors.  For
object stores read spark.read.format("binaryFile") and pass the bytes to
tessella.operators.corpus, which has the same decoders as DataFrame
operators.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tessella.codec import container
from tessella.codec.container import Options
from tessella.sources import netpbm

SCHEMA = "path string, width int, height int, bits_per_sample int, component_count int, component int, y int, samples array<int>"
HEADER_COLUMNS = ("width", "height", "bits_per_sample", "component_count")
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, source: type[_Source], options: dict[str, str]):
        self.source, self.options, self.tests = source, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        paths = sorted(glob.glob(os.path.join(path, f"**/*.{self.source.name()}"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        size = max(1, int(self.options.get("filesperpartition", 16)))
        return [Files(paths[i : i + size]) for i in range(0, len(paths), size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        named = {k.__name__: v for k, v in TESTS.items()}
        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            frame = self.source.frame(data)
            values = dict(zip(HEADER_COLUMNS, frame, strict=True))
            if not all(named[t](values[column], value) for t, column, value in self.tests):
                continue
            planes, _ = self.source.decode(data)
            for c, plane in enumerate(planes):
                for y, line in enumerate(plane):
                    yield (path, *frame, c, y, line.tolist())


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, source: type[_Source], options: dict[str, str], overwrite: bool):
        self.source, self.options, self.overwrite = source, options, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        images: dict[int, list] = {}
        for r in rows:
            images.setdefault(r["image_id"], []).append((r["component"], r["y"], r["samples"]))
        os.makedirs(self.options["path"], exist_ok=True)
        done = []
        for image_id, lines in images.items():
            lines.sort(key=lambda x: x[:2])
            n = len({x[0] for x in lines})
            planes = np.array([x[2] for x in lines]).reshape(n, len(lines) // n, -1)
            bits = int(self.options.get("bits", max(2, int(planes.max(initial=0)).bit_length())))
            path = os.path.join(self.options["path"], f"{image_id}.{self.source.name()}")
            with open(f"{path}.tmp", "wb") as f:
                f.write(self.source.encode(planes, bits, self.options))
            done.append(path)
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite and os.path.isdir(self.options["path"]):
            for old in glob.glob(os.path.join(self.options["path"], f"*.{self.source.name()}")):
                os.remove(old)
        for m in messages:
            for path in m.paths if m else ():
                os.replace(f"{path}.tmp", path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for path in m.paths if m else ():
                if os.path.exists(f"{path}.tmp"):
                    os.remove(f"{path}.tmp")


class _Source(DataSource):
    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(type(self), dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(type(self), dict(self.options), overwrite)

    @staticmethod
    def decode(data: bytes) -> tuple[np.ndarray, int]:
        raise NotImplementedError

    @staticmethod
    def encode(planes: np.ndarray, bits: int, options: dict[str, str]) -> bytes:
        raise NotImplementedError

    @classmethod
    def frame(cls, data: bytes) -> tuple[int, int, int, int]:
        planes, bits = cls.decode(data)
        return planes.shape[2], planes.shape[1], bits, planes.shape[0]


class Jls(_Source):
    """Options: interleave (none, line, sample), near, colortransform (0..3), restartinterval, bits."""

    @classmethod
    def name(cls) -> str:
        return "jls"

    @classmethod
    def frame(cls, data: bytes) -> tuple[int, int, int, int]:
        h = container.read_header(data)
        return h.width, h.height, h.bits, len(h.components)

    @staticmethod
    def decode(data: bytes) -> tuple[np.ndarray, int]:
        header, planes = container.decode(data)
        return planes, header.bits

    @staticmethod
    def encode(planes: np.ndarray, bits: int, options: dict[str, str]) -> bytes:
        default = "none" if len(planes) == 1 else "line"
        ilv = ("none", "line", "sample").index(options.get("interleave", default))
        return container.encode(planes, bits, Options(near=int(options.get("near", 0)), ilv=ilv, transform=int(options.get("colortransform", 0)), restart_interval=int(options.get("restartinterval", 0))))


class Pnm(_Source):
    @classmethod
    def name(cls) -> str:
        return "pnm"

    decode = staticmethod(netpbm.read_pnm)

    @staticmethod
    def encode(planes: np.ndarray, bits: int, options: dict[str, str]) -> bytes:
        return netpbm.write_pnm(planes, bits)


class Pam(_Source):
    @classmethod
    def name(cls) -> str:
        return "pam"

    decode = staticmethod(netpbm.read_pam)

    @staticmethod
    def encode(planes: np.ndarray, bits: int, options: dict[str, str]) -> bytes:
        return netpbm.write_pam(planes, bits)


class Bmp(_Source):
    @classmethod
    def name(cls) -> str:
        return "bmp"

    decode = staticmethod(netpbm.read_bmp)


def register(spark: SparkSession) -> None:
    """Registers the formats and lets Spark hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Jls, Pnm, Pam, Bmp):
        spark.dataSource.register(source)
