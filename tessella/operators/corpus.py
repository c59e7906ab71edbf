"""Encoding, decoding, parsing and comparing corpora of images, an image (or scan, or restart interval) a unit of work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.codec import container
from tessella.codec.container import NAMES, Options, Reader
from tessella.functions.errors import JlsError, error_message

PERMISSIVE, FAILFAST, DROPMALFORMED = "PERMISSIVE", "FAILFAST", "DROPMALFORMED"
#: Samples of one batch of decoded lines.
MOST_SAMPLES = 1 << 24
PRESETS = "struct<maxval:int,t1:int,t2:int,t3:int,reset:int>"
SPIFF = "struct<profile_id:int,component_count:int,height:long,width:long,color_space:int,bits_per_sample:int,compression_type:int,resolution_units:int,vertical_resolution:long,horizontal_resolution:long>"
HEADERS = (
    "image_id long, frame struct<width:int,height:int,bits_per_sample:int,component_count:int>, components array<struct<id:int,near:int,table_id:int,ilv:int>>, "
    f"pc {PRESETS}, color_transformation int, restart_interval long, spiff {SPIFF}, data_format int, mapping_tables array<struct<table_id:int,entry_size:int,data:binary>>, errc int"
)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over spark.sql.shuffle.partitions tasks.

    Coding costs far more by byte than what adaptive execution merges
    small partitions for; a number of partitions keeps it from doing so.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def encode_lines(lines: DataFrame, bits: int, options: Options = Options()) -> DataFrame:
    """(image_id, component, y, samples) -> (image_id, content): one file for each image."""

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["image_id", "component", "y", "samples"]).sort_by([("component", "ascending"), ("y", "ascending")])
        n = len(t.column("component").unique())
        planes = t.column("samples").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, len(t) // n, -1)
        return pa.table({"image_id": t.column("image_id")[:1].cast(pa.int64()), "content": pa.array([container.encode(planes, bits, options)], pa.binary())})

    return spread(lines, "image_id").groupBy("image_id").applyInArrow(run, "image_id long, content binary")


def encode_raw(images: DataFrame) -> DataFrame:
    """Raw images (image_id, width, height, bits_per_sample, component_count, ilv, stride, near, content) -> (image_id, content, errc, error_message)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.itertuples():
                try:
                    container.check_frame(r.width, r.height, r.bits_per_sample, r.component_count)
                    planes = container.to_planes(r.content, r.width, r.height, r.bits_per_sample, r.component_count, r.ilv, r.stride)
                    out.append((r.image_id, container.encode(planes, r.bits_per_sample, Options(near=r.near, ilv=r.ilv)), 0))
                except JlsError as e:
                    out.append((r.image_id, None, e.errc))
            yield pd.DataFrame(out, columns=["image_id", "content", "errc"])

    out = images.mapInPandas(run, "image_id long, content binary, errc int")
    return out.withColumn("error_message", error_message(F.col("errc")))


def raw_buffers(lines: DataFrame, bits: int, ilv: int, stride: int = 0) -> DataFrame:
    """(image_id, component, y, samples) -> (image_id, content): the raw buffer of each image, planar for ilv 0, else pixel by pixel."""

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["image_id", "component", "y", "samples"]).sort_by([("component", "ascending"), ("y", "ascending")])
        n = len(t.column("component").unique())
        planes = t.column("samples").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, len(t) // n, -1)
        return pa.table({"image_id": t.column("image_id")[:1].cast(pa.int64()), "content": pa.array([container.from_planes(planes, bits, ilv, stride)], pa.binary())})

    return spread(lines, "image_id").groupBy("image_id").applyInArrow(run, "image_id long, content binary")


def bmp_order(lines: DataFrame) -> DataFrame:
    """Lines from the bottom up with components in reverse, as in BMP files (and back again)."""
    ends = lines.groupBy("image_id").agg(F.max("y").alias("__y"), F.max("component").alias("__c"))
    return lines.join(ends, "image_id").select("image_id", (F.col("__c") - F.col("component")).cast("int").alias("component"), (F.col("__y") - F.col("y")).cast("int").alias("y"), "samples")


def by_mode(df: DataFrame, mode: str) -> DataFrame:
    """PERMISSIVE keeps rows that failed, with errc; DROPMALFORMED drops them; FAILFAST raises on them."""
    if mode == DROPMALFORMED:
        return df.filter("errc = 0")
    if mode == FAILFAST:
        return df.filter(F.when(F.col("errc") == 0, True).otherwise(F.raise_error(F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(": "), error_message(F.col("errc")))).cast("boolean")))
    return df


def _guarded(content: bytes | None, f) -> tuple:
    """f(content) and 0, or None and the error's code."""
    try:
        return f(bytes(content) if content is not None else b""), 0
    except JlsError as e:
        return None, e.errc


def _header_row(image_id: int, h: container.Header | None, errc: int) -> dict:
    if h is None:
        return {"image_id": image_id, "errc": errc}
    return {
        "image_id": image_id,
        "frame": {"width": h.width, "height": h.height, "bits_per_sample": h.bits, "component_count": len(h.components)},
        "components": h.components,
        "pc": h.presets.__dict__,
        "color_transformation": h.transform,
        "restart_interval": h.restart_interval,
        "spiff": h.spiff,
        "data_format": h.data_format,
        "mapping_tables": h.mapping_tables,
        "errc": errc,
    }


def read_headers(images: DataFrame, mode: str = PERMISSIVE) -> DataFrame:
    """(image_id, content) -> headers and the data format, without decoding samples."""
    schema = T._parse_datatype_string(HEADERS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image_id, content in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append(_header_row(image_id, container.read_all(content or b"")[0], 0))
                except JlsError as e:
                    rows.append(_header_row(image_id, None, e.errc))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = images.select("image_id", "content").mapInArrow(run, schema)
    return by_mode(out, mode).withColumn("error_message", error_message(F.col("errc")))


def read_segments(images: DataFrame) -> DataFrame:
    """(image_id, content) -> (image_id, seq, offset, marker, marker_name, size, payload): comments and application data are rows to filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.itertuples():
                reader = Reader(bytes(r.content or b""))
                try:
                    reader.read_header()
                    at = None if reader.ended else reader.scan.offset
                    while at is not None:
                        scan = reader.next_scan(container.coded_end(reader.data, at))
                        at = scan.offset if scan else None
                except JlsError:
                    pass  # what stands before the fault is returned; headers tell the code
                out += [(r.image_id, i, o, m, NAMES.get(m, "?"), len(b) + 2 if m not in (0xD8, 0xD9) else 0, b) for i, (o, m, b) in enumerate(reader.segments)]
            yield pd.DataFrame(out, columns=["image_id", "seq", "offset", "marker", "marker_name", "size", "payload"])

    return images.select("image_id", "content").mapInPandas(run, "image_id long, seq int, offset int, marker int, marker_name string, size int, payload binary")


DECODED = "image_id long, component int, y int, samples array<int>, errc int"


def _line_rows(image_id: int, components: Sequence[int], y0: int, planes: np.ndarray) -> pa.RecordBatch:
    """The lines of planes (component, y, x) as rows of DECODED; the samples stay one buffer."""
    n, h, w = planes.shape
    offsets = pa.array(np.arange(0, n * h * w + 1, w, dtype=np.int32) if w else np.zeros(n * h + 1, np.int32))
    samples = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(planes, np.int32).ravel()))
    columns = [pa.array(np.full(n * h, image_id), pa.int64()), pa.array(np.repeat(np.asarray(components, np.int32), h)), pa.array(np.tile(np.arange(y0, y0 + h, dtype=np.int32), n)), samples, pa.array(np.zeros(n * h, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["image_id", "component", "y", "samples", "errc"])


def _failed_row(image_id: int, errc: int) -> pa.RecordBatch:
    columns = [pa.array([image_id], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([errc], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["image_id", "component", "y", "samples", "errc"])


def _pieces(planes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(component, y0, lines) of at most MOST_SAMPLES samples, so that a list's offsets never overflow."""
    step = max(1, MOST_SAMPLES // max(1, planes.shape[2]))
    for i, plane in enumerate(planes):
        for y in range(0, len(plane), step):
            yield i, y, plane[None, y : y + step]


def decode_images(images: DataFrame, mode: str = PERMISSIVE, max_bytes: int | None = container.LARGEST_IMAGE) -> DataFrame:
    """(image_id, content) -> lines (image_id, component, y, samples, errc); a file that fails, or whose header claims more than max_bytes, is one row with its errc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
                found, errc = _guarded(content.as_py(), lambda data: container.decode(data, max_bytes)[1])
                if found is None:
                    yield _failed_row(image_id, errc)
                    continue
                if found.size <= MOST_SAMPLES:
                    yield _line_rows(image_id, range(len(found)), 0, found)
                    continue
                for i, y, lines in _pieces(found):
                    yield _line_rows(image_id, [i], y, lines)

    return by_mode(images.select(F.col("image_id").cast("long"), "content").mapInArrow(run, DECODED), mode)


def decode_by_interval(images: DataFrame, mode: str = PERMISSIVE, max_bytes: int | None = container.LARGEST_IMAGE) -> DataFrame:
    """Decodes every restart interval of every scan as a row of its own: an image's intervals run in parallel.

    An interval starts with a fresh model, so that it depends on nothing
    before it.  Lines as from decode_images, with their color transform
    undone.  A file that fails before its intervals are known is one row
    with its errc; an interval that fails is such a row too.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
                found, errc = _guarded(content.as_py(), lambda data: container.intervals(data, max_bytes))
                rows = [{"image_id": image_id, "errc": 0} | x for x in found] if found is not None else [{"image_id": image_id, "errc": errc}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["errc"]:
                    yield _failed_row(r["image_id"], r["errc"])
                    continue
                planes, errc = _guarded(r["data"], lambda data, r=r: container.decode_interval(data, r))
                yield _failed_row(r["image_id"], errc) if planes is None else _line_rows(r["image_id"], r["components"], r["y0"], planes)

    schema = T._parse_datatype_string("image_id long, errc int, components array<int>, y0 int, height int, width int, bits int, near int, ilv int, transform int, pc array<int>, data binary")
    arrow = to_arrow_schema(schema)
    parts = images.select(F.col("image_id").cast("long"), "content").mapInArrow(split, schema)
    return by_mode(spread(parts, "image_id", "y0").mapInArrow(run, DECODED), mode)


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """(image_id, differing long, largest int) of two sets of lines; samples that only one side has differ by their own value."""
    a, b = (df.select("image_id", "component", "y", F.col("samples").alias(c)) for df, c in ((one, "a"), (two, "b")))
    both = a.join(b, ["image_id", "component", "y"], "full")
    gap = F.zip_with(F.coalesce("a", F.array().cast("array<int>")), F.coalesce("b", F.array().cast("array<int>")), lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    differ = F.zip_with(F.coalesce("a", F.array().cast("array<int>")), F.coalesce("b", F.array().cast("array<int>")), lambda x, y: ~x.eqNullSafe(y))
    both = both.select("image_id", F.size(F.filter(differ, lambda d: d)).alias("n"), F.coalesce(F.array_max(gap), F.lit(0)).alias("m"))
    return both.groupBy("image_id").agg(F.sum("n").cast("long").alias("differing"), F.max("m").cast("int").alias("largest"))


def data_format(headers: DataFrame) -> DataFrame:
    """(image_id, data_format) from a header's component tables against its defined tables, relationally."""
    used = headers.select("image_id", F.explode("components.table_id").alias("table_id")).filter("table_id <> 0")
    defined = headers.select("image_id", F.explode("mapping_tables.table_id").alias("table_id"))
    missing = used.join(defined, ["image_id", "table_id"], "left_anti").select("image_id").distinct().withColumn("missing", F.lit(True))
    kind = F.when(F.size("components") == 0, container.ABBREVIATED_TABLES).when(F.col("missing"), container.ABBREVIATED_IMAGE).otherwise(container.INTERCHANGE)
    return headers.join(missing, "image_id", "left").select("image_id", kind.cast("int").alias("data_format"))


def spiff_valid(headers: DataFrame) -> DataFrame:
    """(image_id, valid): whether a SPIFF header agrees with its frame; null without one."""
    s, f = "spiff", "frame"
    three, four = [1, 3, 4, 9, 10, 11, 14], [12, 13]
    space, n = F.col(f"{s}.color_space"), F.col(f"{s}.component_count")
    colors = (space == 2) | ((space == 8) & (n == 1)) | (space.isin(three) & (n == 3)) | (space.isin(four) & (n == 4))
    ok = (F.col(f"{s}.compression_type") == 6) & (F.col(f"{s}.profile_id") == 0) & F.col(f"{s}.resolution_units").between(0, 2) & (F.col(f"{s}.horizontal_resolution") != 0) & (F.col(f"{s}.vertical_resolution") != 0) & colors
    for c in ("component_count", "bits_per_sample", "height", "width"):
        ok = ok & (F.col(f"{s}.{c}") == F.col(f"{f}.{c}"))
    return headers.select("image_id", F.when(F.col(s).isNotNull(), ok).alias("valid"))
