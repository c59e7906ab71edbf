"""Queries over the raster views, one for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import __version__
from tessella.codec import container
from tessella.codec.container import Options, Scan
from tessella.codec.scan import SAMPLE, Presets
from tessella.functions import scalar as S
from tessella.functions.errors import CODES, JlsError, error_message
from tessella.operators import corpus
from tessella.operators.folds import encode_lossless
from tessella.operators.template import contexts, modes, neighbours, runs
from tessella.plans.malformed import BAD
from tessella.plans.rasters import EMB_SQL, PRICE_SQL, RGB_SQL, RUN_SQL, embedding_lines, pixels, price_lines, rgb_lines, run_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def grid(spark: SparkSession, n: int, /, **columns: str) -> DataFrame:
    return spark.range(n).select(F.col("id"), *[F.expr(e).cast("int").alias(k) for k, e in columns.items()])


def grid_sql(n: int, /, **columns: str) -> str:
    return f"SELECT id, {', '.join(f'({e.replace(" div ", " // ")})::INT AS {k}' for k, e in columns.items())} FROM range({n}) r(id)"


def over_grid(name: str, n: int, columns: dict[str, str], out: dict, sql: dict[str, str]) -> None:
    """A query of column expressions `out` over a grid, against SQL expressions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grid(spark, n, **columns).select("id", *[f().alias(k) for k, f in out.items()])

    query(name, f"SELECT id, {', '.join(f'{e} AS {k}' for k, e in sql.items())} FROM ({grid_sql(n, **columns)}) g")(run)


def _div(a: str, b: str) -> str:
    return f"(({a}) // ({b}))"


# Sizes and frames.

FRAME = {"w": "id % 17 + 1", "h": "id div 17 % 13 + 1", "n": "id % 4 + 1", "bits": "id % 15 + 2", "pad": "id % 3", "ilv": "id % 2"}
over_grid("k02_estimated_size", 5000, FRAME, {"size": lambda: S.estimated_size(c("w"), c("h"), c("n"), c("bits"))}, {"size": "w::BIGINT * h * n * ((bits + 7) // 8) + (w::BIGINT * h * n * ((bits + 7) // 8)) // 16 + 1058"})
over_grid(
    "k03_destination_size", 5000, FRAME | {"stride": "CASE WHEN id % 5 = 0 THEN 0 ELSE id % 90 END"},
    {"size": lambda: S.destination_size(c("w"), c("h"), c("n"), c("bits"), c("stride"), c("ilv") == 0)},
    {"size": "CASE WHEN stride = 0 THEN w::BIGINT * ((bits + 7) // 8) * h * n WHEN ilv = 0 AND stride >= w * ((bits + 7) // 8) THEN stride::BIGINT * h * n - (stride - w * ((bits + 7) // 8)) WHEN ilv = 1 AND stride >= w * ((bits + 7) // 8) * n THEN stride::BIGINT * h - (stride - w * ((bits + 7) // 8) * n) END"},
)

ARGS = {"w": "CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN 100001 ELSE id END", "h": "CASE WHEN id % 11 = 0 THEN 0 ELSE 5 END", "bits": "id % 19", "n": "CASE WHEN id % 13 = 0 THEN 256 ELSE id % 7 END", "ilv": "id % 4", "near": "id % 300"}


def _in_python(df: DataFrame, schema: str, f: Callable[[dict], list[tuple]]) -> DataFrame:
    """The rows that the library's own function f makes of each row."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for p in batches:
            yield pd.DataFrame([out for r in p.to_dict("records") for out in f(r)], columns=names)

    return df.mapInPandas(run, schema)


@query(
    "v01_argument_validation",
    "SELECT id, (CASE WHEN w NOT BETWEEN 1 AND 100000 THEN 102 WHEN h NOT BETWEEN 1 AND 100000 THEN 103 WHEN bits NOT BETWEEN 2 AND 16 THEN 104 WHEN n NOT BETWEEN 1 AND 255 THEN 105 WHEN ilv > 2 OR (ilv > 0 AND (n = 1 OR n > 4)) THEN 106 WHEN near > least(255, ((1 << bits) - 1) // 2) THEN 107 ELSE 0 END)::INT AS errc "
    f"FROM ({grid_sql(3000, **ARGS)}) g",
)
def v01_argument_validation(spark, sf_dir):
    def check(r):
        try:
            container.check_frame(r["w"], r["h"], r["bits"], r["n"])
            container.check_interleave(r["n"], r["ilv"])
            container.check_near(r["near"], (1 << r["bits"]) - 1)
        except JlsError as e:
            return [(r["id"], e.errc)]
        return [(r["id"], 0)]

    return _in_python(grid(spark, 3000, **ARGS), "id long, errc int", check)


over_grid("p19_color_transform_allowed", 1000, {"n": "id % 5", "bits": "id % 15 + 2", "near": "id % 2", "ilv": "id % 3"}, {"allowed": lambda: S.color_transform_allowed(c("n"), c("bits"), c("near"), c("ilv"))}, {"allowed": "n = 3 AND bits IN (8, 16) AND near = 0 AND ilv <> 0"})

# Scalar functions.

over_grid("f01_mask", 4000, {"s": "id * 37 % 65536", "bits": "id % 15 + 2"}, {"masked": lambda: S.mask(c("s"), c("bits"))}, {"masked": "s & ((1 << bits) - 1)::INT"})
over_grid("f08_error_map", 1025, {"e": "id - 512"}, {"mapped": lambda: S.map_error(c("e")), "back": lambda: S.unmap_error(S.map_error(c("e")))}, {"mapped": "(CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END)::INT", "back": "e"})
over_grid("f09_sign", 1025, {"e": "id - 512", "s": "id % 2 - 1"}, {"sign": lambda: S.sign(c("e")), "bit_sign": lambda: S.bit_sign(c("e")), "applied": lambda: S.apply_sign(c("e"), c("s"))}, {"sign": "(CASE WHEN e < 0 THEN -1 ELSE 1 END)::INT", "bit_sign": "(CASE WHEN e < 0 THEN -1 ELSE 0 END)::INT", "applied": "(CASE WHEN s < 0 THEN -e ELSE e END)::INT"})
PARAMS = {"bits": "id % 15 + 2", "near": "least(id div 15, ((1 << (id % 15 + 2)::INT) - 1) div 2)"}
SPARK_PARAMS = {"bits": "id % 15 + 2", "near": "least(id div 15, (shiftleft(1, cast(id % 15 + 2 as int)) - 1) div 2)"}
M_SQL = "((1 << bits) - 1)"
RANGE_SQL = f"(({M_SQL} + 2 * near) // (2 * near + 1) + 1)"


def over_params(name: str, out: dict, sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = grid(spark, 1500, **SPARK_PARAMS).withColumn("m", S.max_value(c("bits")))
        return g.select("id", *[f().alias(k) for k, f in out.items()])

    query(name, f"SELECT id, {', '.join(f'({e})::{"BOOLEAN" if k == "ok" else "INT"} AS {k}' for k, e in sql.items())} FROM ({grid_sql(1500, **PARAMS)}) g")(run)


over_params(
    "f10_parameters",
    {"range": lambda: S.range_parameter(c("m"), c("near")), "limit": lambda: S.limit_parameter(c("bits")), "a0": lambda: S.initial_a(S.range_parameter(c("m"), c("near"))), "qbpp": lambda: S.log2_ceiling(S.range_parameter(c("m"), c("near")))},
    {"range": RANGE_SQL, "limit": "2 * (bits + greatest(8, bits))", "a0": f"greatest(2, ({RANGE_SQL} + 32) // 64)", "qbpp": f"ceil(log2({RANGE_SQL}))"},
)
over_params("f11_bit_helpers", {"bytes": lambda: S.byte_count(c("bits")), "top": lambda: c("m"), "near_limit": lambda: S.max_near(c("m"))}, {"bytes": "(bits + 7) // 8", "top": M_SQL, "near_limit": f"least(255, {M_SQL} // 2)"})


def _threshold_sql() -> dict[str, str]:
    """The default thresholds as nested SQL."""
    factor = f"((least({M_SQL}, 4095) + 128) // 256)"
    out, before = {}, "(near + 1)"
    for name, wide, weight, low in (("t1", 3, 3, 2), ("t2", 7, 5, 3), ("t3", 21, 7, 4)):
        value = f"(CASE WHEN bits >= 7 AND {M_SQL} >= 128 THEN {factor} * {wide - low} + {low} + {weight} * near ELSE greatest({low}, {wide} // greatest(2, 256 // ({M_SQL} + 1)) + {weight} * near) END)"
        out[name] = before = f"(CASE WHEN {value} > {M_SQL} OR {value} < {before} THEN {before} ELSE {value} END)"
    return out


T_SQL = _threshold_sql()
over_params("f12_thresholds", {f"t{i + 1}": (lambda i=i: S.default_thresholds(c("m"), c("near"))[i]) for i in range(3)}, T_SQL)


@query(
    "f13_param_validity",
    f"SELECT id, bits, (reset = 0 OR reset BETWEEN 3 AND greatest(255, {M_SQL})) AND (t1 = 0 OR t1 BETWEEN near + 1 AND {M_SQL}) AND (t2 = 0 OR t2 BETWEEN (CASE WHEN t1 = 0 THEN {T_SQL['t1']} ELSE t1 END) AND {M_SQL}) AS valid, "
    f"t1 IN (0, {T_SQL['t1']}) AND t2 IN (0, {T_SQL['t2']}) AND reset IN (0, 64) AS is_default FROM ({grid_sql(4000, bits='id % 7 + 2', near='id % 2', t1='id % 13', t2='id % 9', reset='CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 64 ELSE id % 300 END')}) g",
)
def f13_param_validity(spark, sf_dir):
    g = grid(spark, 4000, bits="id % 7 + 2", near="id % 2", t1="id % 13", t2="id % 9", reset="CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 64 ELSE id % 300 END").withColumn("m", S.max_value(c("bits")))
    zero = F.lit(0)
    valid = S.resolved_parameters(zero, c("t1"), c("t2"), zero, c("reset"), c("m"), c("near"))["valid"]
    return g.select("id", "bits", valid.alias("valid"), S.is_default(zero, c("t1"), c("t2"), zero, c("reset"), c("m"), c("near")).alias("is_default"))


over_grid("f14_modulo", 1025, {"e": "id - 512", "r": "id % 100 + 2"}, {"wrapped": lambda: S.modulo_range(c("e") % c("r"), c("r")), "lossless": lambda: S.modulo_lossless(c("e"), 8)}, {"wrapped": "(CASE WHEN (CASE WHEN e % r < 0 THEN e % r + r ELSE e % r END) >= (r + 1) // 2 THEN (CASE WHEN e % r < 0 THEN e % r + r ELSE e % r END) - r ELSE (CASE WHEN e % r < 0 THEN e % r + r ELSE e % r END) END)::INT", "lossless": "(((e & 255) + 128) % 256 - 128)::INT"})
over_grid("f15_near_quantise", 1025, {"e": "id - 512", "near": "id % 6"}, {"q": lambda: S.quantise(c("e"), c("near")), "d": lambda: S.dequantise(S.quantise(c("e"), c("near")), c("near"))}, {"q": "(CASE WHEN e > 0 THEN (e + near) // (2 * near + 1) ELSE -((near - e) // (2 * near + 1)) END)::INT", "d": "((CASE WHEN e > 0 THEN (e + near) // (2 * near + 1) ELSE -((near - e) // (2 * near + 1)) END) * (2 * near + 1))::INT"})
SPAN_SQL = "(((255 + 2 * near) // (2 * near + 1) + 1) * (2 * near + 1))"
over_grid("f16_reconstruct", 6000, {"px": "id * 7 % 256", "e": "id % 61 - 30", "near": "id % 4"}, {"rx": lambda: S.reconstruct(c("px"), c("e"), c("near"), F.lit(255))}, {"rx": f"least(255, greatest(0, CASE WHEN px + e * (2 * near + 1) < -near THEN px + e * (2 * near + 1) + {SPAN_SQL} WHEN px + e * (2 * near + 1) > 255 + near THEN px + e * (2 * near + 1) - {SPAN_SQL} ELSE px + e * (2 * near + 1) END))::INT"})
over_grid("f17_is_near", 3000, {"a": "id % 50", "b": "id div 50", "near": "id % 5"}, {"near": lambda: S.is_near(c("a"), c("b"), c("near"))}, {"near": "abs(a - b) <= near"})
K_SQL = "(SELECT min(k)::INT FROM range(16) r(k) WHERE n * (1 << k) >= {a})"
over_grid("f18_golomb_k", 3000, {"n": "id % 64 + 1", "a": "id * 13 % 5000 + 1"}, {"k": lambda: S.golomb_k(c("n"), c("a"))}, {"k": K_SQL.format(a="a")})
over_grid("f19_golomb_k_run", 3000, {"n": "id % 64 + 1", "a": "id * 13 % 5000 + 1", "t": "id % 2"}, {"k": lambda: S.golomb_k_run(c("n"), c("a"), c("t"))}, {"k": K_SQL.format(a="a + (n >> 1) * t")})
over_grid(
    "f20_golomb_code", 4000, {"k": "id % 9", "m": "id % 500 + 1"},
    {"nbits": lambda: S.golomb_length(c("k"), c("m"), F.lit(32), F.lit(8)), "bits": lambda: S.golomb_bits(c("k"), c("m"), F.lit(32), F.lit(8))},
    {"nbits": "(CASE WHEN (m >> k) < 23 THEN (m >> k) + 1 + k ELSE 32 END)::INT", "bits": "(CASE WHEN (m >> k) < 23 THEN (1 << k) | (m & ((1 << k) - 1)) ELSE 256 | ((m - 1) & 255) END)::BIGINT"},
)
over_grid("f21_run_map_bit", 4000, {"e": "id % 21 - 10", "k": "id % 3", "nn": "id div 7 % 20", "n": "id div 3 % 40 + 1"}, {"bit": lambda: S.run_map_bit(c("e"), c("k"), c("nn"), c("n"))}, {"bit": "(k = 0 AND e > 0 AND 2 * nn < n) OR (e < 0 AND 2 * nn >= n) OR (e < 0 AND k <> 0)"})


@query("f25_error_messages", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v[1].replace(chr(39), chr(39) * 2)}')" for k, v in [*CODES.items(), (999, ("", "Unknown"))]) + ") t(errc, message)")
def f25_error_messages(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in [*CODES, 999]], "errc int").select("errc", error_message(c("errc")).alias("message"))


@query("f26_version", f"SELECT '{__version__}' AS version")
def f26_version(spark, sf_dir):
    return spark.range(1).select(F.lit(__version__).alias("version"))


# Color transforms and layouts over the RGB raster.


def _rgb(spark, sf_dir):
    """(image_id, y, x, r, g, b)."""
    return _pivot(rgb_lines(spark, sf_dir))


def _pivot(lines):
    lines = lines.groupBy("image_id", "y").agg(*[F.max(F.when(c("component") == i, c("samples"))).alias(k) for i, k in enumerate("rgb")])
    return lines.select("image_id", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("image_id", "y", "x", "p.*")


RGB = RGB_SQL + ", rgb AS (SELECT image_id, y, x, max(sample) FILTER (WHERE component = 0) AS r, max(sample) FILTER (WHERE component = 1) AS g, max(sample) FILTER (WHERE component = 2) AS b FROM img GROUP BY 1, 2, 3)"
HP_SQL = {
    "hp1": ("(r - g + 128) & 255", "g", "(b - g + 128) & 255"),
    "hp2": ("(r - g + 128) & 255", "g", "(b - ((r + g) >> 1) + 128) & 255"),
    "hp3": ("(g + ((((b - g + 128) & 255) + ((r - g + 128) & 255)) >> 2) - 64) & 255", "(b - g + 128) & 255", "(r - g + 128) & 255"),
}


def _transform_queries(i: int, name: str) -> None:
    forward, back = getattr(S, name), getattr(S, f"{name}_inverse")
    sql = ", ".join(f"({e})::INT AS v{j + 1}" for j, e in enumerate(HP_SQL[name]))

    @query(f"f0{i}_{name}", f"WITH {RGB} SELECT image_id, y, x, {sql} FROM rgb")
    def run(spark, sf_dir):
        return _rgb(spark, sf_dir).select("image_id", "y", "x", *[v.cast("int").alias(f"v{j + 1}") for j, v in enumerate(forward(c("r"), c("g"), c("b")))])

    @query(f"f0{i}_{name}_inverse", f"WITH {RGB} SELECT image_id, y, x, r, g, b FROM rgb")
    def inverse(spark, sf_dir):
        df = run(spark, sf_dir)
        return df.select("image_id", "y", "x", *[v.cast("int").alias(k) for k, v in zip("rgb", back(c("v1"), c("v2"), c("v3")), strict=True)])


for _i, _name in enumerate(("hp1", "hp2", "hp3"), 2):
    _transform_queries(_i, _name)


@query("e11_planar_to_pixel", f"WITH {RGB_SQL}, p AS (SELECT image_id, sample AS planar, row_number() OVER (PARTITION BY image_id ORDER BY component, y, x) - 1 AS place FROM img), q AS (SELECT image_id, sample AS pixelwise, row_number() OVER (PARTITION BY image_id ORDER BY y, x, component) - 1 AS place FROM img) SELECT image_id, place::INT AS place, planar, pixelwise FROM p JOIN q USING (image_id, place)")
def e11_planar_to_pixel(spark, sf_dir):
    """The bytes of both raw layouts, place by place."""
    lines = rgb_lines(spark, sf_dir)
    byte = lambda k: F.conv(F.hex(F.substring(c(k), c("place") + 1, F.lit(1))), 16, 10).cast("int").alias(k)
    both = corpus.raw_buffers(lines, 8, 0).withColumnRenamed("content", "planar").join(corpus.raw_buffers(lines, 8, 2).withColumnRenamed("content", "pixelwise"), "image_id")
    return both.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("planar") - 1)).alias("place")).select("image_id", "place", byte("planar"), byte("pixelwise"))


@query("f24_flip_and_swap", f"WITH {RGB} SELECT image_id, (max(y) OVER (PARTITION BY image_id) - y)::INT AS y, x, b AS r, g, r AS b FROM rgb")
def f24_flip_and_swap(spark, sf_dir):
    return _pivot(corpus.bmp_order(rgb_lines(spark, sf_dir)))


# Neighbourhoods, contexts, modes, runs.

TEMPLATE_SQL = """, above AS (SELECT *, coalesce(lag(sample) OVER v, 0) AS rb, coalesce(lag(sample, 2) OVER v, 0) AS up2 FROM img WINDOW v AS (PARTITION BY image_id, component, x ORDER BY y)),
tpl AS (SELECT image_id, component, y, x, sample, coalesce(lag(sample) OVER w, rb) AS ra, rb, coalesce(lag(rb) OVER w, up2) AS rc, coalesce(lead(rb) OVER w, rb) AS rd FROM above WINDOW w AS (PARTITION BY image_id, component, y ORDER BY x))"""
GRAY_SQL = EMB_SQL + ", img AS (SELECT * FROM emb)" + TEMPLATE_SQL
MED_SQL = "(CASE WHEN rc >= greatest(ra, rb) THEN least(ra, rb) WHEN rc <= least(ra, rb) THEN greatest(ra, rb) ELSE ra + rb - rc END)::INT"


def _quantised(d: str, t1: int, t2: int, t3: int) -> str:
    return f"((CASE WHEN abs({d}) >= {t3} THEN 4 WHEN abs({d}) >= {t2} THEN 3 WHEN abs({d}) >= {t1} THEN 2 WHEN abs({d}) > 0 THEN 1 ELSE 0 END) * (CASE WHEN {d} < 0 THEN -1 ELSE 1 END))::INT"


def _context_sql(t: tuple[int, int, int]) -> str:
    q = [_quantised(d, *t) for d in ("(rd - rb)", "(rb - rc)", "(rc - ra)")]
    return f", q AS (SELECT *, {', '.join(f'{e} AS q{i + 1}' for i, e in enumerate(q))}, {MED_SQL} AS px FROM tpl), ctx AS (SELECT *, ((q1 * 9 + q2) * 9 + q3)::INT AS ctx FROM q)"


@query("n01_template", f"WITH {GRAY_SQL} SELECT * FROM tpl")
def n01_template(spark, sf_dir):
    return neighbours(embedding_lines(spark, sf_dir))


@query("f05_med", f"WITH {GRAY_SQL} SELECT image_id, y, x, {MED_SQL} AS px FROM tpl")
def f05_med(spark, sf_dir):
    return neighbours(embedding_lines(spark, sf_dir)).select("image_id", "y", "x", S.med(c("ra"), c("rb"), c("rc")).cast("int").alias("px"))


@query("f06_gradients", f"WITH {GRAY_SQL}{_context_sql((3, 7, 21))} SELECT image_id, y, x, q1, q2, q3 FROM ctx")
def f06_gradients(spark, sf_dir):
    return contexts(neighbours(embedding_lines(spark, sf_dir)), 8).select("image_id", "y", "x", "q1", "q2", "q3")


@query("f07_context", f"WITH {GRAY_SQL}{_context_sql((3, 7, 21))} SELECT image_id, component, y, x, ctx, (CASE WHEN ctx < 0 THEN -1 ELSE 0 END)::INT AS sgn, px FROM ctx")
def f07_context(spark, sf_dir):
    return contexts(neighbours(embedding_lines(spark, sf_dir)), 8).select("image_id", "component", "y", "x", "ctx", "sgn", "px")


@query("n03_context_statistics", f"WITH {GRAY_SQL}{_context_sql((3, 7, 21))} SELECT image_id, abs(ctx)::INT AS context, count(*) AS n, sum(abs(sample - px))::BIGINT AS error FROM ctx GROUP BY 1, 2")
def n03_context_statistics(spark, sf_dir):
    """How often each context occurs in an image, and how far its predictions are off."""
    rows = contexts(neighbours(embedding_lines(spark, sf_dir)), 8)
    return rows.groupBy("image_id", F.abs("ctx").alias("context")).agg(F.count("*").alias("n"), F.sum(F.abs(c("sample") - c("px"))).cast("long").alias("error"))


#: For three bits a sample: T1, T2, T3 = 2, 3, 4 (checked in the tests).
RUN_CONTEXTS = RUN_SQL + TEMPLATE_SQL + _context_sql((2, 3, 4))
MODE_SQL = """, lg AS (SELECT *, coalesce(max(CASE WHEN ctx = 0 THEN x END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS g,
  coalesce(max(CASE WHEN sample <> ra THEN x END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM ctx WINDOW w AS (PARTITION BY image_id, component, y ORDER BY x)),
md AS (SELECT *, CASE WHEN g <= b THEN 'regular' WHEN sample = ra THEN 'run' ELSE 'interrupt' END AS mode FROM lg)"""


@query("n04_mode", f"WITH {RUN_CONTEXTS}{MODE_SQL} SELECT image_id, component, y, x, mode FROM md")
def n04_mode(spark, sf_dir):
    return modes(contexts(neighbours(run_lines(spark, sf_dir)), 3)).select("image_id", "component", "y", "x", "mode")


PIXELWISE_SQL = (
    RGB_SQL.replace("sample FROM wide", "sample >> 5 AS sample FROM wide") + TEMPLATE_SQL + _context_sql((2, 3, 4)) + """,
pm AS (SELECT *, bool_and(ctx = 0) OVER p AS calm, bool_and(sample = ra) OVER p AS same FROM ctx WINDOW p AS (PARTITION BY image_id, y, x)),
lg AS (SELECT *, coalesce(max(CASE WHEN calm THEN x END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS g, coalesce(max(CASE WHEN NOT same THEN x END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b
  FROM pm WINDOW w AS (PARTITION BY image_id, component, y ORDER BY x))"""
)


@query("n04_mode_pixelwise", f"WITH {PIXELWISE_SQL} SELECT image_id, component, y, x, CASE WHEN g <= b THEN 'regular' WHEN same THEN 'run' ELSE 'interrupt' END AS mode FROM lg")
def n04_mode_pixelwise(spark, sf_dir):
    lines = rgb_lines(spark, sf_dir).withColumn("samples", F.transform("samples", lambda s: F.shiftright(s, 5)))
    return _mode_pixelwise(lines)


def _mode_pixelwise(lines):
    return modes(contexts(neighbours(lines), 3), pixelwise=True).select("image_id", "component", "y", "x", "mode")


@query(
    "n05_run_lengths",
    f"WITH {RUN_CONTEXTS}{MODE_SQL}, fr AS (SELECT *, max(x) OVER (PARTITION BY image_id, component, y) AS last, sum(CASE WHEN mode <> 'regular' AND coalesce(pm, 'regular') <> 'run' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, component, y ORDER BY x) AS part FROM (SELECT *, lag(mode) OVER (PARTITION BY image_id, component, y ORDER BY x) AS pm FROM md)) "
    "SELECT image_id, component, y, min(x)::INT AS x0, count(*) FILTER (WHERE mode = 'run')::INT AS length, count(*) FILTER (WHERE mode = 'interrupt') = 0 AS end_of_line FROM fr WHERE mode <> 'regular' GROUP BY image_id, component, y, part",
)
def n05_run_lengths(spark, sf_dir):
    return runs(modes(contexts(neighbours(run_lines(spark, sf_dir)), 3)))


# Files: round trips through real encodes and decodes.

BACK = "SELECT image_id, component, y, x, sample FROM img"


def _round_trip(name: str, sql: str, lines: Callable, bits: int, options: Options, by_interval: bool = False) -> None:
    @query(name, f"WITH {sql} {BACK}")
    def run(spark, sf_dir):
        images = corpus.encode_lines(lines(spark, sf_dir), bits, options)
        return pixels(corpus.decode_by_interval(images, corpus.FAILFAST) if by_interval else corpus.decode_images(images, corpus.FAILFAST))


GRAY = EMB_SQL + ", img AS (SELECT * FROM emb)"
_round_trip("rt_none", GRAY, embedding_lines, 8, Options())
_round_trip("rt_runs", RUN_SQL, run_lines, 3, Options())
_round_trip("rt_line", RGB_SQL, rgb_lines, 8, Options(ilv=1))
_round_trip("rt_sample", RGB_SQL, rgb_lines, 8, Options(ilv=SAMPLE))
_round_trip("rt_planar_rgb", RGB_SQL, rgb_lines, 8, Options())
_round_trip("rt_hp1", RGB_SQL, rgb_lines, 8, Options(ilv=1, transform=1))
_round_trip("rt_hp2", RGB_SQL, rgb_lines, 8, Options(ilv=SAMPLE, transform=2))
_round_trip("rt_hp3", RGB_SQL, rgb_lines, 8, Options(ilv=1, transform=3))
_round_trip("rt_16bit", PRICE_SQL, price_lines, 16, Options())
_round_trip("rt_presets", GRAY, embedding_lines, 8, Options(presets=Presets(255, 9, 9, 9, 31)))
_round_trip("rt_mixed_scans", RGB_SQL, rgb_lines, 8, Options(scans=[Scan(1), Scan(2, 0, SAMPLE)]))
_round_trip("rt_restart", RGB_SQL, rgb_lines, 8, Options(ilv=1, restart_interval=7))
_round_trip("e09_restart_transform", RGB_SQL, rgb_lines, 8, Options(ilv=1, transform=1, restart_interval=6), by_interval=True)
_round_trip("e09_restart_parallel", RGB_SQL, rgb_lines, 8, Options(ilv=SAMPLE, restart_interval=8), by_interval=True)


def _near_images(spark, sf_dir):
    return corpus.encode_lines(embedding_lines(spark, sf_dir), 8, Options(near=3))


IMAGES_SQL = f"WITH {GRAY}"


@query("near3_error_bound", f"{IMAGES_SQL} SELECT image_id, true AS within_near FROM img GROUP BY 1")
def near3_error_bound(spark, sf_dir):
    found = corpus.compare(embedding_lines(spark, sf_dir), corpus.decode_images(_near_images(spark, sf_dir), corpus.FAILFAST))
    return found.select("image_id", (c("largest") <= 3).alias("within_near"))


@query("k06_compare", f"{IMAGES_SQL} SELECT image_id, 0::BIGINT AS lossless_differing, true AS near_differs, true AS near_bound FROM img GROUP BY 1")
def k06_compare(spark, sf_dir):
    lines = embedding_lines(spark, sf_dir)
    same = corpus.compare(lines, corpus.decode_images(corpus.encode_lines(lines, 8)))
    near = corpus.compare(lines, corpus.decode_images(_near_images(spark, sf_dir))).withColumnsRenamed({"differing": "d", "largest": "m"})
    return same.join(near, "image_id").select("image_id", c("differing").alias("lossless_differing"), (c("d") > 0).alias("near_differs"), (c("m") <= 3).alias("near_bound"))


@query("dataflow_equals_kernel", f"WITH {RUN_SQL} SELECT image_id, true AS equal FROM img GROUP BY 1")
def dataflow_equals_kernel(spark, sf_dir):
    """Coded data from windows and keyed folds is the sequential coder's, byte by byte."""
    lines = run_lines(spark, sf_dir)
    files = corpus.encode_lines(lines, 3)
    return encode_lossless(lines, 3).join(files, "image_id").select("image_id", (F.expr("substring(content, -length(data) - 2, length(data))") == c("data")).alias("equal"))


@query("k07_bytes_written", f"{IMAGES_SQL} SELECT image_id, true AS equal FROM img GROUP BY 1")
def k07_bytes_written(spark, sf_dir):
    """A file's size is that of its segments and coded data: 2 + 13 + 10 + data + 2 bytes for a plain gray image."""
    lines = embedding_lines(spark, sf_dir)
    data = encode_lossless(lines, 8).select("image_id", F.octet_length("data").alias("data"))
    files = corpus.encode_lines(lines, 8).select("image_id", F.octet_length("content").alias("content"))
    return data.join(files, "image_id").select("image_id", (c("content") == c("data") + 27).alias("equal"))


@query("p21_headers", f"{IMAGES_SQL} SELECT image_id, 64 AS width, (max(y) + 1)::INT AS height, 8 AS bits, 1 AS components, 3 AS near, 0 AS ilv, 1 AS data_format, 0 AS errc FROM img GROUP BY 1")
def p21_headers(spark, sf_dir):
    h = corpus.read_headers(_near_images(spark, sf_dir))
    first = F.get("components", F.lit(0))
    return h.select("image_id", "frame.width", "frame.height", c("frame.bits_per_sample").alias("bits"), c("frame.component_count").alias("components"), first["near"].alias("near"), first["ilv"].alias("ilv"), "data_format", "errc")


@query("p01_segments", f"{IMAGES_SQL}, s(seq, marker_name, size) AS (VALUES (0, 'SOI', 0), (1, 'COM', 7), (2, 'APP3', 5), (3, 'SOF55', 11), (4, 'SOS', 8), (5, 'EOI', 0)) SELECT image_id, seq, marker_name, size FROM (SELECT DISTINCT image_id FROM img), s")
def p01_segments(spark, sf_dir):
    images = corpus.encode_lines(embedding_lines(spark, sf_dir), 8, Options(comments=[b"hello"], application_data=[(3, b"abc")]))
    return corpus.read_segments(images).select("image_id", "seq", "marker_name", "size")


@query("p08_mapping_tables", f"{IMAGES_SQL} SELECT image_id, 5 AS table_id, 3 AS entry_size, 153600 AS size FROM img GROUP BY 1")
def p08_mapping_tables(spark, sf_dir):
    """A table over three segments comes back whole."""
    images = corpus.encode_lines(run_lines(spark, sf_dir), 3, Options(table_ids=(5,), mapping_tables=[(5, 3, bytes(range(256)) * 600)]))
    return corpus.read_headers(images).select("image_id", F.explode("mapping_tables").alias("t")).select("image_id", "t.table_id", "t.entry_size", F.octet_length("t.data").alias("size"))


@query("w06_table_chunks", "SELECT id, i::INT AS chunk, (CASE WHEN i = 0 THEN 2 ELSE 3 END)::INT AS kind, least(65530, id * 1000 - i * 65530)::INT AS size FROM range(1, 301) r(id), LATERAL (SELECT unnest(range((id * 1000 + 65529) // 65530)) AS i)")
def w06_table_chunks(spark, sf_dir):
    """The segments that a mapping table of so many bytes is written as."""

    def chunks(r):
        data, at, out = container.mapping_table_segments(7, 1, bytes(r["id"] * 1000)), 0, []
        while at < len(data):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            out.append((r["id"], len(out), data[at + 4], size - 5))
            at += size + 2
        return out

    return _in_python(spark.range(1, 301), "id long, chunk int, kind int, size int", chunks)


HEADER_CASES = [(i, 1 + i % 4, tables, defined) for i, (tables, defined) in enumerate([([0], []), ([5], [5]), ([5, 6], [5]), ([], [9]), ([0, 7, 7], [7, 8]), ([3], [])])]


@query("p18_data_format", "SELECT * FROM (VALUES (0, 1), (1, 1), (2, 2), (3, 3), (4, 1), (5, 2)) t(image_id, data_format)")
def p18_data_format(spark, sf_dir):
    rows = [(i, [(1, 0, t, 0) for t in tables], [(t, 1, b"") for t in defined]) for i, _, tables, defined in HEADER_CASES]
    df = spark.createDataFrame(rows, "image_id int, components array<struct<id:int,near:int,table_id:int,ilv:int>>, mapping_tables array<struct<table_id:int,entry_size:int,data:binary>>")
    return corpus.data_format(df)


@query(
    "p20_spiff_valid",
    f"SELECT id, (space = 2 OR (space = 8 AND n = 1) OR (space IN (1, 3, 4, 9, 10, 11, 14) AND n = 3) OR (space IN (12, 13) AND n = 4)) AND kind = 6 AND units <= 2 AND res > 0 AS valid FROM ({grid_sql(3000, space='id % 16', n='id div 16 % 4 + 1', kind='CASE WHEN id % 9 = 0 THEN 5 ELSE 6 END', units='id % 4', res='id % 7')}) g",
)
def p20_spiff_valid(spark, sf_dir):
    g = grid(spark, 3000, space="id % 16", n="id div 16 % 4 + 1", kind="CASE WHEN id % 9 = 0 THEN 5 ELSE 6 END", units="id % 4", res="id % 7")
    zero, eight = F.lit(0), F.lit(8)
    spiff = F.struct(zero.alias("profile_id"), c("n").alias("component_count"), eight.alias("height"), eight.alias("width"), c("space").alias("color_space"), eight.alias("bits_per_sample"), c("kind").alias("compression_type"), c("units").alias("resolution_units"), c("res").alias("vertical_resolution"), c("res").alias("horizontal_resolution"))
    frame = F.struct(c("n").alias("component_count"), eight.alias("height"), eight.alias("width"), eight.alias("bits_per_sample"))
    return corpus.spiff_valid(g.select(c("id").alias("image_id"), spiff.alias("spiff"), frame.alias("frame"))).withColumnRenamed("image_id", "id")


PRESET_CASES = {"bits": "id % 15 + 2", "jai": "id % 2", "own": "id % 3 div 2"}


@query("w05_preset_decision", f"SELECT id, own = 1 OR (jai = 1 AND bits > 12) AS written FROM ({grid_sql(600, **PRESET_CASES)}) g")
def w05_preset_decision(spark, sf_dir):
    """Whether files of such options hold a segment of preset parameters."""

    def written(r):
        presets = Presets(reset=31) if r["own"] else Presets()
        data = container.encode(np.zeros((1, 1, 1), int), r["bits"], Options(presets=presets, options=container.OPTION_PRESETS_OVER_12_BITS * r["jai"]))
        return [(r["id"], any(marker == container.LSE and body[0] == 1 for _, marker, body in container.read_all(data)[1]))]

    return _in_python(grid(spark, 600, **PRESET_CASES), "id long, written boolean", written)


@query("p16_pad_byte", f"WITH {GRAY} {BACK}")
def p16_pad_byte(spark, sf_dir):
    """A zero byte before the end of the image is passed over."""
    images = corpus.encode_lines(embedding_lines(spark, sf_dir), 8)
    padded = images.withColumn("content", F.expr("concat(substring(content, 1, length(content) - 2), X'00FFD9')"))
    return pixels(corpus.decode_images(padded, corpus.FAILFAST))


@query("p02_fill_bytes", f"WITH {GRAY} {BACK}")
def p02_fill_bytes(spark, sf_dir):
    """Bytes 0xFF before a marker are passed over."""
    images = corpus.encode_lines(embedding_lines(spark, sf_dir), 8)
    filled = images.withColumn("content", F.expr("concat(X'FFD8FFFFFF', substring(content, 3, length(content) - 4), X'FFFFD9')"))
    return pixels(corpus.decode_images(filled, corpus.FAILFAST))


@query("p11_number_of_lines", f"WITH {GRAY} {BACK}")
def p11_number_of_lines(spark, sf_dir):
    """The frame leaves the height open; a DNL segment behind the scan tells it."""
    images = corpus.encode_lines(embedding_lines(spark, sf_dir), 8)
    height = F.expr("substring(content, 8, 2)")
    opened = F.expr("concat(substring(content, 1, 7), X'0000', substring(content, 10, length(content) - 11))")
    return pixels(corpus.decode_images(images.withColumn("content", F.concat(opened, F.expr("X'FFDC0004'"), height, F.expr("X'FFD9'"))), corpus.FAILFAST))


@query("w02_spiff", f"{IMAGES_SQL} SELECT image_id, 64 AS width, (max(y) + 1)::INT AS height, true AS valid, 5 AS segments FROM img GROUP BY 1")
def w02_spiff(spark, sf_dir):
    """A SPIFF header with a directory entry is written, read back and agrees with its frame."""
    images = corpus.encode_lines(embedding_lines(spark, sf_dir), 8, Options(spiff={}, spiff_entries=[(2, b"title")]))
    headers = corpus.read_headers(images, corpus.FAILFAST)
    counts = corpus.read_segments(images).filter("marker_name IN ('SOI', 'APP8', 'SOF55')").groupBy("image_id").agg(F.count("*").cast("int").alias("segments"))
    found = headers.select("image_id", c("spiff.width").cast("int").alias("width"), c("spiff.height").cast("int").alias("height"))
    return found.join(corpus.spiff_valid(headers), "image_id").join(counts, "image_id")


@query("p09_oversize", "SELECT * FROM (VALUES (0, 65536, 1, 3, true), (1, 1, 70000, 3, true), (2, 99999, 2, 3, true)) t(id, width, height, components, equal)")
def p09_oversize(spark, sf_dir):
    """Sides that a frame's 16 bits cannot hold are written and read by the segment for them."""

    def back(r):
        planes = np.zeros((3, r["h"], r["w"]), int)
        planes[:, :, ::1000] = 5
        header, found = container.decode(container.encode(planes, 8, Options(ilv=1)))
        return [(r["id"], header.width, header.height, len(header.components), bool((found == planes).all()))]

    sides = spark.createDataFrame([(0, 65536, 1), (1, 1, 70000), (2, 99999, 2)], "id int, w int, h int")
    return _in_python(sides, "id int, width int, height int, components int, equal boolean", back)



@query("p03_malformed_files", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {k}, '{CODES[k][1]}')" for k in sorted(BAD)) + ") t(image_id, errc, error_message)")
def p03_malformed_files(spark, sf_dir):
    """Every malformed file fails with its own code."""
    images = spark.createDataFrame([(k, v) for k, v in BAD.items()], "image_id int, content binary").repartition(4)
    return corpus.decode_images(images).select(c("image_id").cast("int").alias("image_id"), "errc", error_message(c("errc")).alias("error_message"))
