"""A query for every operator that is checked here, over the given tables, with SQL that says the same another way."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import from_pixels, to_pixels
from ..operators import geometry, images
from ..spec import find, load
from . import flow

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, reals: str = "") -> DataFrame:
    """Real numbers to `digits` places; no negative zero. Those of `reals`, which the SQL rounds too, as DuckDB does it: the
    number is multiplied first, and at halves the product's own error decides.
    """
    unit, by_sql = 10.0**digits, set(reals.split())

    def one(c: str):
        # Written so that the number stands in few places: longer expressions are not compiled.
        return F.when(F.abs(c) <= sys.float_info.max / unit, F.round(F.col(c) * unit, 0) / unit).otherwise(F.col(c)) if c in by_sql else F.round(c, digits)

    return df.select(*[(one(c) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def add(name: str, query: Query, sql: str | None = None, reals: str = "", digits: int = 6) -> None:
    _queries[name] = lambda s, d: rounded(query(s, d), digits, reals if sql else "")
    if sql:
        _oracles[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in reals.split())}) FROM ({sql})" if reals else sql


# --- geometry: parameters from the part table, a different spread of whole numbers each


def _spread(k: int) -> str:
    return f"CAST((p_partkey * {7 + 6 * k} + {k * k * 5 + 3 * k}) % {41 + 2 * k} AS DOUBLE) - {12 + k}"


def _geometry(type_id: str) -> None:
    params, _, outs = geometry.FORMULAS[type_id]
    columns = {p: f"({_spread(k)})" for k, p in enumerate(params)}
    for p in set(params) & {"radius", "ea", "eb", "r1", "r2", "fx", "fy", "baseline", "region_size"}:
        columns[p] = f"(abs({columns[p]}) + 1.0)"
    source = "SELECT p_partkey, " + ", ".join(f"{e} AS {p}" for p, e in columns.items()) + " FROM part"

    def query(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "part").selectExpr("p_partkey", *[f"{e} AS {p}" for p, e in columns.items()])
        return geometry.scalar(rows, type_id, params).select("p_partkey", *outs)

    flags = {o for o, e in outs.items() if o in ("inside", "intersecting", "parallel", "perpendicular", "valid")}
    add(f"geo_{type_id}", query, geometry.sql(type_id, source, "p_partkey"), " ".join(o for o in outs if o not in flags))


# --- frames of 24 x 16 for every supplier: their number grows with the table, and what they show depends on its rows


W, H = 24, 16
SHIFT = "CAST(floor(abs(s_acctbal)) AS BIGINT)"
V1 = f"((x * 7 + y * 13 + s_suppkey * 31 + x * y * 3 + {SHIFT}) % 256)"
V2 = f"((x * 11 + y * 5 + s_suppkey * 17 + 40 + {SHIFT} * 3) % 256)"


def pixels(s: SparkSession, d: str, v: str) -> DataFrame:
    grid = s.range(W * H).selectExpr(f"cast(id % {W} as int) AS x", f"cast(id div {W} as int) AS y")
    return table(s, d, "supplier").crossJoin(F.broadcast(grid)).selectExpr("cast(s_suppkey as long) AS frame_id", "y", "x", "0 AS c", f"cast({v} as int) AS v")


def frames(s: SparkSession, d: str, v: str = V1) -> DataFrame:
    return from_pixels(pixels(s, d, v))


def _px(name: str, v: str) -> str:
    return f"{name} AS (SELECT s_suppkey::BIGINT AS frame_id, y::INT AS y, x::INT AS x, {v}::INT AS v FROM supplier, (SELECT unnest(range({W})) AS x) xs, (SELECT unnest(range({H})) AS y) ys)"


def _clamped(e: str) -> str:
    return f"floor(least(255, greatest(0, {e})))"


def _flat(df: DataFrame) -> DataFrame:
    return to_pixels(df).select("frame_id", "y", "x", F.col("v").cast("long").alias("v"))


def _image(type_id: str, body: str, name: str = "", **params) -> None:
    """`body` is SQL over px, with frame_id, y, x, v."""
    add(f"img_{name or type_id}", lambda s, d: _flat(images.run(frames(s, d), (type_id, params))), f"WITH {_px('px', V1)} SELECT frame_id, y, x, CAST(v AS BIGINT) AS v FROM ({body})")


def _pair(type_id: str, e: str, **params) -> None:
    op = find(type_id)
    add(f"img_{type_id}", lambda s, d: _flat(op.plan(frames(s, d), frames(s, d, V2), **op.bind(params))), f"WITH {_px('pa', V1)}, {_px('pb', V2)} SELECT a.frame_id, a.y, a.x, CAST({e} AS BIGINT) AS v FROM pa a JOIN pb b ON a.frame_id = b.frame_id AND a.y = b.y AND a.x = b.x".replace("A.", "a.v").replace("B.", "b.v"))


def _near(agg: str, k: int, source: str = "px", clamp: bool = True, where: str = "TRUE") -> str:
    """An aggregate over the (2k+1)-square around every sample: border repeated, or samples outside left out."""
    y, x = (f"least({H - 1}, greatest(0, p.y + dy))", f"least({W - 1}, greatest(0, p.x + dx))") if clamp else ("p.y + dy", "p.x + dx")
    return f"SELECT p.frame_id, p.y, p.x, {agg} AS v FROM {source} p, (SELECT unnest(range({-k}, {k + 1})) AS dy) u, (SELECT unnest(range({-k}, {k + 1})) AS dx) w JOIN {source} q ON q.frame_id = p.frame_id AND q.y = {y} AND q.x = {x} WHERE {where} GROUP BY p.frame_id, p.y, p.x, p.v"


_INSIDE = f"p.y BETWEEN 1 AND {H - 2} AND p.x BETWEEN 1 AND {W - 2}"
_LAPLACE = "sum(CASE WHEN dy = 0 AND dx = 0 THEN -4 WHEN abs(dy) + abs(dx) = 1 THEN 1 ELSE 0 END * q.v)"


def _images() -> None:
    _pair("ImageAdd", _clamped("(A. + B.) * 0.5"))
    _pair("ImageSubtract", _clamped("(A. - B.) + 128"))
    _pair("ImageMultiply", _clamped("((A. / 255.0::DOUBLE) * (B. / 255.0::DOUBLE) * 255.0::DOUBLE) * 255.0::DOUBLE"))
    _pair("ImageDivide", _clamped("A. / CASE WHEN B. = 0 THEN 1e-10 ELSE B.::DOUBLE END"))
    _pair("ImageAbsDiff", _clamped("abs(A. - B.)"))
    _pair("ImageMin", "least(A., B.)")
    _pair("ImageMax", "greatest(A., B.)")
    _pair("ImageAnd", "A. & B.")
    _pair("ImageOr", "A. | B.")
    _pair("ImageXor", "xor(A., B.)")
    _pair("ImageBlend", _clamped("A. * 0.5 + B. * 0.5"))

    each = lambda e: f"SELECT frame_id, y, x, {e} AS v FROM px"
    _image("ImageNot", each("255 - v"))
    _image("SimpleThreshold", each("CASE WHEN v > 128 THEN 255 ELSE 0 END"))
    _image("Threshold", each("CASE WHEN v >= 128 THEN 255 ELSE 0 END"))
    for kind, e in {"Binary": "CASE WHEN v > 100 THEN 255 ELSE 0 END", "BinaryInv": "CASE WHEN v > 100 THEN 0 ELSE 255 END", "Trunc": "least(v, 100)", "ToZero": "CASE WHEN v > 100 THEN v ELSE 0 END", "ToZeroInv": "CASE WHEN v > 100 THEN 0 ELSE v END"}.items():
        _image("ThresholdSegment", each(e), f"ThresholdSegment_{kind}", threshold_type=kind, threshold_value=100)
    _image("ContrastEnhance", each(_clamped("(v - 128) * 1.5 + 128")))
    _image("BrightnessAdjust", each(_clamped("v + 50")))
    _image("GammaCorrect", each(_clamped("pow(v / 255.0::DOUBLE, 1.0::DOUBLE) * 255.0::DOUBLE")))
    _image("HistogramEqualize", f"SELECT p.frame_id, y, x, floor(c / {W * H}::DOUBLE * 255) AS v FROM px p JOIN (SELECT frame_id, v, sum(n) OVER (PARTITION BY frame_id ORDER BY v) AS c FROM (SELECT frame_id, v, count(*) AS n FROM px GROUP BY 1, 2)) h ON p.frame_id = h.frame_id AND p.v = h.v")
    _image("Flip", f"SELECT frame_id, y, {W - 1} - x AS x, v FROM px")
    _image("ROICrop", "SELECT frame_id, y - 2 AS y, x - 4 AS x, v FROM px WHERE x BETWEEN 4 AND 13 AND y BETWEEN 2 AND 9", x=4, y=2, width=10, height=8)
    _image("Crop", "SELECT frame_id, y - 2 AS y, x - 4 AS x, v FROM px WHERE x BETWEEN 4 AND 13 AND y BETWEEN 2 AND 9", roi_x=4, roi_y=2, roi_width=10, roi_height=8)
    _image("Translate", "SELECT p.frame_id, p.y, p.x, coalesce(q.v, 7) AS v FROM px p LEFT JOIN px q ON q.frame_id = p.frame_id AND q.y = p.y - 2 AND q.x = p.x - 3", offset_x=3, offset_y=2, fill_value=7)
    _image("Resize", f"SELECT frame_id, t.y, t.x, v FROM px p JOIN (SELECT y, x FROM (SELECT unnest(range(8)) AS y) a, (SELECT unnest(range(12)) AS x) b) t ON p.y = t.y * {H // 8} AND p.x = t.x * {W // 12}", width=12, height=8, interpolation="nearest")
    _image("SimpleImagePreprocess", _near("floor(sum(q.v) / 9.0)", 1))
    _image("BoxFilter", _near("floor(sum(q.v) / 25.0)", 2), kernel_size=5)
    _image("MedianFilter", _near("list_sort(list(q.v))[5]", 1))
    _image("LaplacianFilter", f"SELECT px.frame_id, px.y, px.x, coalesce(n.v, 0) AS v FROM px LEFT JOIN ({_near(_clamped(f'abs({_LAPLACE})'), 1, where=_INSIDE)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x")
    _image("SharpenFilter", f"SELECT px.frame_id, px.y, px.x, coalesce(n.v, px.v) AS v FROM px LEFT JOIN ({_near(_clamped(f'p.v - {_LAPLACE}'), 1, where=_INSIDE)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x")
    gx, gy = "sum(q.v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END)", "sum(q.v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END)"
    _image("SobelEdge", f"SELECT px.frame_id, px.y, px.x, coalesce(n.v, 0) AS v FROM px LEFT JOIN ({_near(f'CASE WHEN floor(sqrt(({gx}) * ({gx}) + ({gy}) * ({gy}))) > 120 THEN 255 ELSE 0 END', 1, where=_INSIDE)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x", threshold=120)
    _image("AdaptiveThreshold", _near("CASE WHEN p.v > floor(sum(q.v) / 49.0) - 5 THEN 255 ELSE 0 END", 3), block_size=7)
    low, high = _near("min(q.v)", 1, clamp=False), _near("max(q.v)", 1, clamp=False)
    of = lambda agg, inner: f"WITH inner_ AS ({inner}) " + _near(agg, 1, "inner_", clamp=False)
    _image("Morphology", low, "Morphology_Erode")
    _image("Morphology", high, "Morphology_Dilate", operation="Dilate")
    _image("Morphology", of("max(q.v)", low), "Morphology_Open", operation="Open")
    _image("Morphology", of("min(q.v)", high), "Morphology_Close", operation="Close")
    _image("Morphology", _near("max(q.v) - min(q.v)", 1, clamp=False), "Morphology_Gradient", operation="Gradient")
    _image("ExtractBoundary", _near("p.v - min(q.v)", 1, clamp=False))
    binary = "(SELECT frame_id, y, x, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM px)"
    _image("ThresholdMorph", f"WITH bin AS {binary} " + _near("min(q.v)", 1, "bin", clamp=False))
    for name in ("GaussianFilter", "BilateralFilter", "GuidedFilter", "CannyEdge", "FillHoles", "Thinning", "Rotate", "GaussLowPass", "ButterworthHighPass", "BandPass", "HomomorphicFilter", "DenoiseNLM", "DenoiseWavelet", "AdaptiveHistogramEqualize", "PhaseSpectrum"):
        add(f"img_{name}", lambda s, d, t=name: _flat(images.run(frames(s, d), (t, {}))))


def _measures() -> None:
    bright = ("SimpleThreshold", {"threshold": 128})
    on = f"WITH {_px('px', V1)}, f AS (SELECT * FROM px WHERE v > 128), m AS (SELECT frame_id, count(*)::DOUBLE AS n, avg(x) AS cx, avg(y) AS cy FROM f GROUP BY 1)"
    run = lambda t, **p: lambda s, d: find(t).plan(images.run(frames(s, d), bright), **find(t).bind(p))
    add("measure_ShapeMoments", run("ShapeMoments"), f"{on} SELECT f.frame_id, n AS area, cx AS centroid_x, cy AS centroid_y, sum(x * x)::DOUBLE AS m20, sum(y * y)::DOUBLE AS m02, sum(x * y)::DOUBLE AS m11, sum((x - cx) ** 2) AS mu20, sum((y - cy) ** 2) AS mu02, sum((x - cx) * (y - cy)) AS mu11 FROM f JOIN m ON f.frame_id = m.frame_id GROUP BY f.frame_id, n, cx, cy", "area centroid_x centroid_y m20 m02 m11 mu20 mu02 mu11")
    plain = lambda t, **p: lambda s, d: find(t).plan(frames(s, d), **find(t).bind(p))
    add("measure_CogHistogram", plain("CogHistogram"), f"WITH {_px('px', V1)}, h AS (SELECT frame_id, v, count(*) AS n FROM px GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY v) AS c FROM h) SELECT frame_id, (sum(v * n) / {W * H}.0)::DOUBLE AS mean, sqrt(sum(v * v * n) / {W * H}.0 - pow(sum(v * n) / {W * H}.0, 2)) AS std_dev, min(v)::DOUBLE AS min_value, max(v)::DOUBLE AS max_value, min(CASE WHEN c >= {W * H} / 2.0 THEN v END)::DOUBLE AS median, -sum(n / {W * H}.0 * log2(n / {W * H}.0)) AS entropy FROM c GROUP BY frame_id", "mean std_dev min_value max_value median entropy")
    add("measure_color_histogram", plain("color_histogram", bins=16.0), f"WITH {_px('px', V1)} SELECT frame_id, 0::BIGINT AS channel, (v // 16)::BIGINT AS bin, count(*) AS n FROM px GROUP BY ALL")
    add("measure_OtsuThreshold", plain("OtsuThreshold"), f"WITH {_px('px', V1)}, h AS (SELECT frame_id, t.v AS v, sum(CASE WHEN p.v <= t.v THEN 1 ELSE 0 END) AS lo, sum(CASE WHEN p.v <= t.v THEN p.v ELSE 0 END) AS ml, sum(p.v) AS m FROM px p, (SELECT unnest(range(256)) AS v) t GROUP BY 1, 2), b AS (SELECT *, CASE WHEN lo = 0 OR lo = {W * H} THEN 0 ELSE lo::DOUBLE * ({W * H} - lo) * pow(ml / lo::DOUBLE - (m - ml) / ({W * H} - lo)::DOUBLE, 2) END AS s FROM h) SELECT frame_id, min(v)::BIGINT AS threshold FROM (SELECT *, max(round(s, 3)) OVER (PARTITION BY frame_id) AS top FROM b) WHERE round(s, 3) = top GROUP BY 1")
    spots = f"""WITH RECURSIVE {_px('px', V1)}, f AS (SELECT frame_id, y, x FROM px WHERE v > 128),
reach AS (SELECT frame_id, y, x, y * {W} + x AS seed FROM f UNION SELECT f.frame_id, f.y, f.x, r.seed FROM reach r JOIN f ON f.frame_id = r.frame_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1),
c AS (SELECT frame_id, y, x, min(seed) AS seed FROM reach GROUP BY 1, 2, 3),
b AS (SELECT frame_id, seed, count(*) AS area, min(x)::BIGINT AS bx, min(y)::BIGINT AS by_, (max(x) - min(x) + 1)::BIGINT AS width, (max(y) - min(y) + 1)::BIGINT AS height, avg(x) AS center_x, avg(y) AS center_y FROM c GROUP BY 1, 2)
SELECT * FROM (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY seed) AS blob, area, bx AS x, by_ AS y, width, height, center_x, center_y FROM b) WHERE area >= 4"""
    add("measure_BlobAnalysis", run("BlobAnalysis", min_area=4), spots, "center_x center_y")
    for name in ("HuMoments", "FlusserMoments", "ShapeFeatures", "Compactness", "Convexity", "Anisometry", "CogBlobAnalysis"):
        add(f"measure_{name}", run(name))
    for name in ("QualityEvaluate", "AdaptiveParam", "HarrisCorner", "MoravecCorner", "MeasureProfile", "MeasureThreshold", "CaliperTool", "light_direction_estimate"):
        add(f"measure_{name}", plain(name))

    def inspection(s: SparkSession, d: str) -> DataFrame:
        spec = {"id": "inspection", "nodes": [{"id": "a", "type_id": "SimpleThreshold", "params": {"threshold": 128}}, {"id": "b", "type_id": "BlobAnalysis", "params": {"min_area": 4}, "inputs": {"image": {"source_node": "a", "source_port": "image"}}}]}
        return flow.run(flow.parse(spec), {"image": frames(s, d)})["b"]

    add("flow_inspection", inspection, spots, "center_x center_y")


def _tables() -> None:
    def t(type_id: str, sql: str | None, reals: str, *sources: tuple[str, list[str]], name: str = "", digits: int = 6, pick: str = "", **params) -> None:
        op = find(type_id)

        def query(s: SparkSession, d: str) -> DataFrame:
            out = op.plan(*[table(s, d, n).selectExpr(*e) for n, e in sources], **op.bind(params))
            return out.selectExpr(*pick.split("|")) if pick else out

        add(f"tab_{name or type_id}", query, sql, reals, digits)

    parts = ("part", ["p_brand AS object_id", "cast(p_size as double) AS x", "p_retailprice / 100 AS y"])
    cov = "SELECT p_brand AS object_id, count(*) AS n, avg(p_size) AS mx, avg(p_retailprice / 100) AS my, var_pop(p_size) AS u, covar_pop(p_size, p_retailprice / 100) AS v, var_pop(p_retailprice / 100) AS w FROM part GROUP BY 1"
    t("LineFit", f"SELECT object_id, -sin(t) AS line_a, cos(t) AS line_b, sin(t) * mx - cos(t) * my AS line_c, sqrt(greatest((u + w) / 2 - sqrt(pow((u - w) / 2, 2) + v * v), 0)) AS rms_error, n AS point_count FROM (SELECT *, atan2(2 * v, u - w) / 2 AS t FROM ({cov}))", "line_a line_b line_c rms_error", parts, digits=4)
    t("EllipseMeasure", f"SELECT object_id, mx AS center_x, my AS center_y, 2 * sqrt(m + h) AS major_axis, 2 * sqrt(greatest(m - h, 0)) AS minor_axis, degrees(atan2(2 * v, u - w) / 2) AS angle_deg, 4 * sqrt(m + h) * sqrt(greatest(m - h, 0)) * pi() AS area, sqrt(greatest(m - h, 0)) / sqrt(m + h) AS ellipticity FROM (SELECT *, (u + w) / 2 AS m, sqrt(pow((u - w) / 2, 2) + v * v) AS h FROM ({cov}))", "center_x center_y major_axis minor_axis angle_deg area ellipticity", parts, digits=4)
    t("CircleFit", None, "", parts, digits=4)
    t("PolygonMeasure", "WITH p AS (SELECT l_orderkey AS object_id, l_quantity AS x, l_extendedprice AS y, coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER w) AS nx, coalesce(lead(l_extendedprice) OVER w, first_value(l_extendedprice) OVER w) AS ny FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), s AS (SELECT object_id, count(*) AS vertex_count, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) AS perimeter, avg(x) AS center_x, avg(y) AS center_y, max(x) - min(x) AS bounding_width, max(y) - min(y) AS bounding_height FROM p GROUP BY 1) SELECT *, CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0 END AS circularity, CASE WHEN bounding_width * bounding_height > 0 THEN area / (bounding_width * bounding_height) ELSE 0 END AS rectangularity FROM s",
      "area perimeter center_x center_y bounding_width bounding_height circularity rectangularity", ("lineitem", ["*"]))
    polygon = find("PolygonMeasure")
    _queries["tab_PolygonMeasure"] = lambda s, d: rounded(polygon.plan(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_quantity").alias("x"), F.min("l_extendedprice").alias("y")), **polygon.bind({})), 6)
    stats = "SELECT l_returnflag AS object_id, count(*) AS count, avg(l_quantity) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, stddev_pop(l_quantity) AS std_dev, max(l_quantity) - min(l_quantity) AS range, 60 / (6 * stddev_pop(l_quantity)) AS cp, (60 - avg(l_quantity)) / (3 * stddev_pop(l_quantity)) AS cpu, avg(l_quantity) / (3 * stddev_pop(l_quantity)) AS cpl, least(60 - avg(l_quantity), avg(l_quantity)) / (3 * stddev_pop(l_quantity)) AS cpk FROM lineitem GROUP BY 1"
    quantity = ("lineitem", ["l_returnflag AS object_id", "l_quantity AS value"])
    t("MeasureStatistics", stats, "mean min max std_dev range cp cpu cpl cpk", quantity, usl=60.0)
    t("MeasureCompare", "SELECT l_returnflag AS object_id, count(*) AS n, max(abs(l_quantity - 25)) AS max_deviation, bool_and(abs(l_quantity - 25) <= 24) AS pass FROM lineitem GROUP BY 1", "max_deviation", quantity, reference=25.0, tolerance=24.0)
    t("CogResultAnalysis", "SELECT *, total_count - pass_count AS fail_count, pass_count * 100.0::DOUBLE / total_count AS pass_rate, pass_count * 100.0::DOUBLE / total_count >= 95 AS accepted FROM (SELECT o_orderpriority AS object_id, count(*) AS total_count, count(*) FILTER (o_totalprice > 100000) AS pass_count FROM orders GROUP BY 1)", "pass_rate", ("orders", ["o_orderpriority AS object_id", "o_totalprice > 100000 AS pass"]))
    t("PrecisionReport", "SELECT l_linestatus AS object_id, count(*) AS n, avg(l_discount) AS mean_error, max(l_discount) AS max_error, stddev_pop(l_discount) AS std_error, max(l_discount) <= 0.05 AS pass FROM lineitem GROUP BY 1", "mean_error max_error std_error", ("lineitem", ["l_linestatus AS object_id", "l_discount AS error"]), target=0.05)
    t("PerformanceAnalyzer", "WITH s AS (SELECT event_type AS node_id, count(*) AS runs, count(*) FILTER (user_id % 10 = 0) AS errors, sum(round(value * 1000)::BIGINT)::BIGINT AS total_us, min(round(value * 1000)::BIGINT) AS min_us, max(round(value * 1000)::BIGINT) AS max_us, sum(round(value * 1000)::BIGINT)::DOUBLE / count(*) AS avg_us FROM events GROUP BY 1) SELECT *, total_us * 100.0::DOUBLE / sum(total_us) OVER () AS share, errors * 1.0::DOUBLE / runs AS error_rate, total_us * 100.0::DOUBLE / sum(total_us) OVER () >= 10 OR errors * 1.0 / runs > 0.1 AS bottleneck, (row_number() OVER (ORDER BY avg_us DESC, node_id))::INT AS rank FROM s",
      "avg_us share error_rate", ("events", ["event_type AS node_id", "cast(round(value * 1000) as long) AS duration_us", "user_id % 10 <> 0 AS success"]))
    t("FrameSyncCheck", "WITH e AS (SELECT user_id AS frame_id, epoch_us(ts) AS t FROM events), m AS (SELECT frame_id, count(*) AS n, max(t) - min(t) AS spread_us, (sum(t) // count(*))::BIGINT AS mean FROM e GROUP BY 1) SELECT e.frame_id, n, spread_us, CASE WHEN n < 2 THEN 0 ELSE sum(abs(t - mean))::DOUBLE / n END AS sync_offset, spread_us <= 1000000000.0 AS sync_status FROM e JOIN m ON e.frame_id = m.frame_id GROUP BY e.frame_id, n, spread_us", "sync_offset", ("events", ["user_id AS frame_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS capture_time_us"]), tolerance_us=1e9, digits=0)
    t("TimestampAlign", "SELECT f.event_id, f.user_id AS source_id, epoch_us(f.ts) AS ts, coalesce((SELECT max(epoch_us(r.ts)) FROM events r WHERE r.user_id = f.user_id AND r.event_id % 3 = 0 AND r.ts <= f.ts), -1) AS aligned_timestamp FROM events f WHERE f.event_id % 3 <> 0", "", ("events", ["event_id", "user_id AS source_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS ts", "event_id % 3 AS side"]))
    align = find("TimestampAlign")

    def aligned(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "events").selectExpr("event_id", "user_id AS source_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS ts")
        return align.plan(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0").drop("event_id"), **align.bind({})).select("event_id", "source_id", "ts", F.coalesce("aligned_timestamp", F.lit(-1)).alias("aligned_timestamp"))

    _queries["tab_TimestampAlign"] = aligned
    t("DatasetSplit", "SELECT doc_id AS image_id, CASE WHEN (doc_id * 7919 + 42) % 1000 < 700 THEN 'train' WHEN (doc_id * 7919 + 42) % 1000 < 850 THEN 'val' ELSE 'test' END AS split FROM documents", "", ("documents", ["doc_id AS image_id"]))
    t("ModelEvaluate", "WITH c AS (SELECT k, count(*) FILTER (quality = k) AS gt, count(*) FILTER (toxic = k) AS pr, count(*) FILTER (quality = k AND toxic = k) AS tp FROM labels, (SELECT unnest([0, 1]) AS k) GROUP BY k), m AS (SELECT *, CASE WHEN pr > 0 THEN tp / pr::DOUBLE ELSE 0 END AS p, CASE WHEN gt > 0 THEN tp / gt::DOUBLE ELSE 0 END AS r FROM c) SELECT sum(tp) / sum(gt)::DOUBLE AS accuracy, sum(p) / 2 AS macro_precision, sum(r) / 2 AS macro_recall, sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / 2 AS macro_f1, sum(gt)::BIGINT AS total FROM m", "accuracy macro_precision macro_recall macro_f1", ("labels", ["quality AS gt", "toxic AS pred"]))
    toxic, good = ("labels", ["doc_id AS image_id", "toxic"]), ("labels", ["doc_id + 1 AS image_id", "toxic"])
    both = "(SELECT doc_id AS image_id, toxic FROM labels) a", "(SELECT doc_id + 1 AS image_id, toxic FROM labels) b"
    t("LabelMerge", f"SELECT * FROM {both[0]} UNION SELECT * FROM {both[1]}", "", toxic, good, name="LabelMerge_union")
    t("LabelMerge", f"SELECT * FROM {both[0]} WHERE image_id IN (SELECT image_id FROM {both[1]})", "", toxic, good, name="LabelMerge_intersection", merge_mode="intersection")
    t("LabelMerge", f"SELECT * FROM {both[0]} WHERE image_id NOT IN (SELECT image_id FROM {both[1]})", "", toxic, good, name="LabelMerge_difference", merge_mode="difference")
    t("DataFormat", "SELECT n_name AS data, '<' || replace('[{}]', '{}', n_name) || '>' AS output FROM nation", "", ("nation", ["n_name AS data"]), format="[{}]", prefix="<", suffix=">")
    t("ResultOutput", "SELECT n_name AS data, 'Result: ' || n_name AS output FROM nation", "", ("nation", ["n_name AS data"]))
    t("OCRVerify", "SELECT *, CASE WHEN greatest(length(text), length(expected)) > 0 THEN 1 - distance / greatest(length(text), length(expected))::DOUBLE ELSE 1 END AS similarity, CASE WHEN greatest(length(text), length(expected)) > 0 THEN 1 - distance / greatest(length(text), length(expected))::DOUBLE ELSE 1 END >= 0.5 AS match FROM (SELECT p_name AS text, p_brand AS expected, levenshtein(p_name, p_brand)::INT AS distance FROM part)", "similarity", ("part", ["p_name AS text", "p_brand AS expected"]), min_similarity=0.5)
    t("CalibrationHistory", "SELECT user_id AS camera_id, count(*) AS history_count, max(CASE WHEN r = 1 THEN value END) AS last_offset_x, max(CASE WHEN r = 1 THEN value * 2 END) AS last_offset_y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1", "last_offset_x last_offset_y", ("events", ["user_id AS camera_id", "event_id AS ts", "value AS offset_x", "value * 2 AS offset_y"]), max_history=5)

    box = ["doc_id AS image_id", "doc_id AS object_id", "if(toxic = 1, 'bad', 'ok') AS label", "quality AS class_id", "doc_id % 90 AS x", "doc_id % 70 AS y", "doc_id % 20 AS width", "doc_id % 15 AS height", "100 AS image_width", "80 AS image_height"]
    boxes = "(SELECT doc_id AS image_id, doc_id AS object_id, CASE WHEN toxic = 1 THEN 'bad' ELSE 'ok' END AS label, quality AS class_id, doc_id % 90 AS x, doc_id % 70 AS y, doc_id % 20 AS width, doc_id % 15 AS height, 100 AS image_width, 80 AS image_height FROM labels)"
    t("LabelVerify", f"SELECT *, NOT (out_of_bounds OR empty OR duplicate) AS valid FROM (SELECT *, x + width > image_width OR y + height > image_height AS out_of_bounds, width <= 0 OR height <= 0 AS empty, row_number() OVER (PARTITION BY image_id, label, x, y, width, height ORDER BY object_id) > 1 AS duplicate FROM {boxes})", "", ("labels", box))
    t("DatasetManager", "SELECT doc_id AS image_id, CASE WHEN (doc_id * 7919 + 42) % 1000 < 700 THEN 'train' WHEN (doc_id * 7919 + 42) % 1000 < 850 THEN 'val' ELSE 'test' END AS split, ((doc_id * 104729 + 42) % 5)::INT AS fold FROM documents", "", ("documents", ["doc_id AS image_id"]))
    t("DataValidation", "WITH s AS (SELECT l_returnflag AS group_id, count(*) AS rows, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, count(*) - count(DISTINCT l_quantity) AS duplicates FROM lineitem GROUP BY 1), o AS (SELECT l_returnflag AS group_id, count(*) FILTER (abs(l_quantity - m) > 3 * d) AS outliers FROM lineitem JOIN s ON s.group_id = l_returnflag GROUP BY 1) SELECT s.group_id, rows, 0::BIGINT AS missing, duplicates, outliers, 1 - outliers / rows::DOUBLE AS quality_score, 1 - outliers / rows::DOUBLE >= 0.7 AS accepted FROM s JOIN o ON s.group_id = o.group_id", "quality_score", ("lineitem", ["l_returnflag AS group_id", "l_quantity AS value"]))
    t("TrainProgress", "SELECT user_id AS run_id, event_id AS step, value AS loss, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS running_loss, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best_loss FROM events", "loss running_loss best_loss", ("events", ["user_id AS run_id", "event_id AS step", "value AS loss"]))
    t("NinePointCalibration", "WITH s AS (SELECT p_brand AS camera_id, count(*) AS n, avg(p_size) AS mx, avg(p_retailprice / 100) AS my, var_pop(p_size) AS xx, covar_pop(p_size, p_retailprice / 100) AS xy, var_pop(p_retailprice / 100) AS yy, avg(p_partkey % 97) AS mu, avg(p_partkey % 89) AS mv, covar_pop(p_size, p_partkey % 97) AS xu, covar_pop(p_retailprice / 100, p_partkey % 97) AS yu, covar_pop(p_size, p_partkey % 89) AS xv, covar_pop(p_retailprice / 100, p_partkey % 89) AS yv, var_pop(p_partkey % 97) AS uu, var_pop(p_partkey % 89) AS vv FROM part GROUP BY 1), k AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS d, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS e FROM s) SELECT camera_id, a, b, mu - a * mx - b * my AS c, d, e, mv - d * mx - e * my AS f, sqrt(uu - a * xu - b * yu + vv - d * xv - e * yv) AS error, n, sqrt(uu - a * xu - b * yu + vv - d * xv - e * yv) <= 1 AS valid FROM k", "a b c d e f error", ("part", ["p_brand AS camera_id", "cast(p_size as double) AS x", "p_retailprice / 100 AS y", "cast(p_partkey % 97 as double) AS world_x", "cast(p_partkey % 89 as double) AS world_y"]), digits=4)
    line = ("lineitem", ["l_orderkey AS contour_id", "cast(l_linenumber as long) * 1000000 + l_partkey AS seq", "l_quantity AS x", "cast(l_suppkey % 50 as double) AS y"])
    t("ContourSignature", "WITH m AS (SELECT l_orderkey AS contour_id, avg(l_quantity) AS mx, avg(l_suppkey % 50) AS my FROM lineitem GROUP BY 1) SELECT contour_id, count(*) AS sample_count, max(d) AS max_distance, min(d) AS min_distance, avg(d) AS mean_distance FROM (SELECT contour_id, sqrt(pow(l_quantity - mx, 2) + pow(l_suppkey % 50 - my, 2)) AS d FROM lineitem JOIN m ON contour_id = l_orderkey) GROUP BY 1", "max_distance min_distance mean_distance", line)
    for name in ("SmoothContours", "SegmentContours", "CurvatureDescriptor", "SelectContours"):
        t(name, None, "", line)
    cloud = ("embeddings", ["cast(label as long) AS cloud_id", "vec_id AS point_id", "cast(embedding[0] as double) AS x", "cast(embedding[1] as double) AS y", "cast(embedding[2] as double) AS z"])
    pts = "(SELECT label::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
    t("pointcloud_boundingbox", f"SELECT *, " + ", ".join(f"(min_{a} + max_{a}) / 2 AS center_{a}, max_{a} - min_{a} AS size_{a}" for a in "xyz") + " FROM (SELECT cloud_id, " + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz") + f" FROM {pts} GROUP BY 1)", " ".join(f"{n}_{a}" for n in ("min", "max", "center", "size") for a in "xyz"), cloud)
    t("PointCloudFitMeasure", "SELECT *, sqrt(spread_x ** 2 + spread_y ** 2 + spread_z ** 2) AS total_spread FROM (SELECT cloud_id, count(*) AS point_count, " + ", ".join(f"avg({a}) AS center_{a}, stddev_pop({a}) AS spread_{a}" for a in "xyz") + f" FROM {pts} GROUP BY 1)", " ".join(f"{n}_{a}" for n in ("center", "spread") for a in "xyz") + " total_spread", cloud)
    t("pointcloud_transform", f"SELECT cloud_id, point_id, 1 - y AS x, 2 + x AS y, 3 + z AS z FROM {pts}", "x y z", cloud, tx=1.0, ty=2.0, tz=3.0, rz=90.0)
    t("PointCloudDownsample", f"SELECT cloud_id, floor(x / 0.5)::BIGINT AS cx, floor(y / 0.5)::BIGINT AS cy, floor(z / 0.5)::BIGINT AS cz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM {pts} GROUP BY 1, 2, 3, 4", "x y z", cloud, voxel_size=0.5)
    t("pointcloud_sample", f"SELECT * FROM {pts} WHERE (point_id * 7919 + cloud_id * 104729) % 10007 < 5003", "x y z", cloud)
    t("plane_detection", None, "", cloud, distance_threshold=0.2)
    t("pointcloud_normals", None, "", cloud, search_radius=0.6)
    t("icp_register", None, "", cloud, cloud)
    dist = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
    t("pointcloud_smooth", f"SELECT a.cloud_id, a.point_id, avg(b.x) AS x, avg(b.y) AS y, avg(b.z) AS z FROM {pts} a JOIN {pts} b ON a.cloud_id = b.cloud_id AND {dist} <= 0.4 GROUP BY 1, 2", "x y z", cloud, search_radius=0.4)
    t("PointCloudFilter", f"SELECT * FROM {pts} WHERE point_id IN (SELECT a.point_id FROM {pts} a JOIN {pts} b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id AND {dist} <= 0.6 GROUP BY 1 HAVING count(*) >= 3)", "x y z", cloud, radius=0.6, min_neighbors=3)


def _inspections() -> None:
    """Template places by the sums of SQL; differences between two frames, piece by piece."""
    patch = lambda s, d: images.run(frames(s, d).filter("frame_id = 3"), ("TemplateTrain", {"roi_x": 5, "roi_y": 4, "roi_width": 6, "roi_height": 5}))
    match = find("GrayMatch")
    body = f"""WITH {_px('px', V1)}, t AS (SELECT y - 4 AS ty, x - 5 AS tx, v AS tv FROM px WHERE frame_id = 3 AND x BETWEEN 5 AND 10 AND y BETWEEN 4 AND 8),
s AS (SELECT px.frame_id, px.x - tx AS x, px.y - ty AS y, corr(v, tv) AS score, count(*) AS n FROM px JOIN t ON px.x - tx BETWEEN 0 AND {W - 6} AND px.y - ty BETWEEN 0 AND {H - 5} GROUP BY 1, 2, 3)
SELECT frame_id, 3::BIGINT AS other_id, x::BIGINT AS x, y::BIGINT AS y, score FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 9) DESC, y, x) AS r FROM s) WHERE r = 1 AND score >= 0.1"""
    add("match_GrayMatch", lambda s, d: match.plan(frames(s, d), patch(s, d), **match.bind({"min_score": 0.1, "num_matches": 1})), body, "score")
    surface = find("SurfaceDefect")
    pieces = f"""WITH RECURSIVE {_px('pa', V1)}, {_px('pb', V2)}, f AS (SELECT a.frame_id, a.y, a.x FROM pa a JOIN pb b ON a.frame_id = b.frame_id AND a.y = b.y AND a.x = b.x WHERE abs(a.v - b.v) > 150),
reach AS (SELECT frame_id, y, x, y * {W} + x AS seed FROM f UNION SELECT f.frame_id, f.y, f.x, r.seed FROM reach r JOIN f ON f.frame_id = r.frame_id AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1),
c AS (SELECT frame_id, y, x, min(seed) AS seed FROM reach GROUP BY 1, 2, 3), b AS (SELECT frame_id, seed, count(*) AS area, min(x)::BIGINT AS bx, min(y)::BIGINT AS by_, (max(x) - min(x) + 1)::BIGINT AS width, (max(y) - min(y) + 1)::BIGINT AS height, avg(x) AS center_x, avg(y) AS center_y FROM c GROUP BY 1, 2)
SELECT * FROM (SELECT frame_id, frame_id AS other_id, row_number() OVER (PARTITION BY frame_id ORDER BY seed) AS blob, area, bx AS x, by_ AS y, width, height, center_x, center_y FROM b) WHERE area >= 3"""
    add("inspect_SurfaceDefect", lambda s, d: surface.plan(frames(s, d), frames(s, d, V2), **surface.bind({"threshold": 150, "min_area": 3})), pieces, "center_x center_y")
    for name in ("StainDetect", "CrackDetect", "PitDetect", "GlossDefect", "TextureDefect", "MicroDefectDetect", "DimensionDefect", "PositionDefect", "AngleDefect", "SurfaceRoughness", "CaliperFindEdge", "CaliperFindEdgePair", "CogFindLine", "CogFindCircle"):
        op = find(name)
        add(f"inspect_{name}", lambda s, d, op=op: op.plan(frames(s, d), **op.bind({})))
    for name in ("PhaseCorrelation", "ForeignObject", "PatInspect", "CogInspect"):
        op = find(name)
        add(f"inspect_{name}", lambda s, d, op=op: op.plan(frames(s, d), frames(s, d, V2), **op.bind({})))
    arc = find("GenArcContour")
    add("contour_GenArcContour", lambda s, d: arc.plan(table(s, d, "region").selectExpr("r_regionkey", "r_regionkey * 10.0D AS center_x", "5.0D AS center_y", "r_regionkey + 1.0D AS radius"), **arc.bind({})).select("r_regionkey", "seq", "x", "y"), "SELECT r_regionkey, k::INT AS seq, r_regionkey * 10 + (r_regionkey + 1) * cos(radians(k / 50.0 * 90)) AS x, 5 + (r_regionkey + 1) * sin(radians(k / 50.0 * 90)) AS y FROM region, (SELECT unnest(range(51)) AS k)", "x y")


def _products() -> None:
    """Inspections, textures and surfaces whose measures are plain sums, by SQL; the others by their rows."""
    px = f"WITH {_px('px', V1)}"

    def m(type_id: str, sql: str | None, reals: str = "", **params) -> None:
        op = find(type_id)
        add(f"inspect_{type_id}", lambda s, d: op.plan(frames(s, d), **op.bind(params)), sql, reals)

    m("PackageSeal", f"{px} SELECT *, seal_strength >= 0.7 AS is_good FROM (SELECT frame_id, greatest(0, 1 - stddev_pop(v) / avg(v)) AS seal_strength FROM px WHERE x IN (0, {W - 1}) OR y IN (0, {H - 1}) GROUP BY 1)", "seal_strength")
    m("FabricColor", f"{px}, b AS (SELECT frame_id, y // 2 AS r, x // 2 AS c, avg(v) AS m FROM px GROUP BY 1, 2, 3) SELECT *, greatest(0, 1 - color_deviation / 128) AS uniformity, color_deviation <= 10 AS is_uniform FROM (SELECT frame_id, stddev_pop(m) AS color_deviation FROM b GROUP BY 1)", "color_deviation uniformity")
    m("WaferSurfaceInspection", f"{px}, b AS (SELECT *, avg(v) OVER (PARTITION BY frame_id, y // 8, x // 8) AS m FROM px) SELECT *, roughness <= 10 AND flatness <= 5 AS is_acceptable FROM (SELECT frame_id, avg(abs(v - m)) AS roughness, stddev_pop(m) AS flatness, (max(v) - min(v))::DOUBLE AS peak_to_valley FROM b GROUP BY 1)", "roughness flatness peak_to_valley", block_size=8)
    m("WaferDie", f"{px}, c AS (SELECT frame_id, (y // 4)::BIGINT AS row, (x // 6)::BIGINT AS col, avg(v) AS mean, stddev_pop(v) AS std_dev FROM px GROUP BY 1, 2, 3) SELECT frame_id, row, col, col * 6 AS x, row * 4 AS y, mean, std_dev, abs(mean - median(mean) OVER (PARTITION BY frame_id)) <= 30 AS is_good FROM c", "mean std_dev", die_width=6, die_height=4)
    m("FoodFreshness", f"{px}, s AS (SELECT frame_id, 0.5 * avg(v) / 255 + 0.5 * greatest(0, 1 - stddev_pop(v) / avg(v)) AS score FROM px GROUP BY 1) SELECT frame_id, score, CASE WHEN score >= 0.6 THEN 'fresh' WHEN score >= 0.3 THEN 'acceptable' ELSE 'stale' END AS level FROM s", "score")
    columns = f"{px}, c AS (SELECT frame_id, x, avg(v) AS m FROM px GROUP BY 1, 2), h AS (SELECT *, m > (min(m) OVER w + max(m) OVER w) / 2 AS high FROM c WINDOW w AS (PARTITION BY frame_id)), e AS (SELECT *, high AND NOT coalesce(lag(high) OVER (PARTITION BY frame_id ORDER BY x), FALSE) AS rise FROM h)"
    m("ThreadCount", f"{columns} SELECT frame_id, count(*) FILTER (rise) AS thread_count, 3::BIGINT AS expected_count, count(*) FILTER (rise) - 3.0 AS deviation, count(*) FILTER (rise) = 3 AS is_correct FROM e GROUP BY 1", "deviation", expected_count=3)
    m("VialInspect", f"{px}, r AS (SELECT frame_id, y, avg(v) AS m FROM px GROUP BY 1, 2), d AS (SELECT frame_id, y, abs(m - lag(m) OVER (PARTITION BY frame_id ORDER BY y)) AS s FROM r), t AS (SELECT frame_id, y, row_number() OVER (PARTITION BY frame_id ORDER BY round(s, 9) DESC, y) AS k FROM d WHERE s IS NOT NULL) SELECT frame_id, 1 - y / {H}.0::DOUBLE AS liquid_level, 1 - y / {H}.0::DOUBLE >= 0.3 AS is_qualified FROM t WHERE k = 1", "liquid_level")
    m("TextureAnalysis", f"{px}, n AS (SELECT a.frame_id, a.v // 32 AS i, b.v // 32 AS j, count(*)::DOUBLE / {(W - 1) * H} AS p FROM px a JOIN px b ON a.frame_id = b.frame_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY 1, 2, 3) SELECT frame_id, sum(p * p) AS uniformity, sum(p / (1 + abs(i - j))) AS coarseness, sum(p * (i - j) ** 2) AS contrast, -sum(p * log2(p)) AS entropy FROM n GROUP BY 1", "uniformity coarseness contrast entropy")
    m("SurfaceRoughnessInspection", f"{px}, z AS (SELECT frame_id, x // 5 AS k, v * 0.5::DOUBLE AS z FROM px WHERE y = {H // 2} AND x % 5 = 0), a AS (SELECT frame_id, avg(z) AS m, max(z) - min(z) AS r FROM z GROUP BY 1) SELECT z.frame_id, avg(abs(z - m)) AS ra, 0.0::DOUBLE AS rz, r AS peak_to_valley, avg(abs(z - m)) <= 1.6 AS is_acceptable FROM z JOIN a ON z.frame_id = a.frame_id GROUP BY z.frame_id, r", "ra rz peak_to_valley")
    rows = find("SimpleImageSource")
    add("img_SimpleImageSource", lambda s, d: _flat(rows.plan(table(s, d, "region").selectExpr("cast(r_regionkey as long) AS frame_id"), width=12, height=5)), "SELECT r_regionkey::BIGINT AS frame_id, y::INT AS y, x::INT AS x, x * 255 // 11 AS v FROM region, (SELECT unnest(range(5)) AS y), (SELECT unnest(range(12)) AS x)")
    for name in ("PCBComponent", "PCBTrace", "PCBPad", "PCBDefect", "WaferDefect", "WaferDefectClassification", "DieAlignment", "WaferEdgeInspection", "WaferDicingInspection", "WaferCrackDetection", "WaferThicknessMeasurement", "PackageLabel", "PackageQuality", "PackageIntegrity", "AssemblyCheck", "QualityGrade", "PillDetect", "PillDefect", "FoodContaminate", "FabricDefect", "CapsuleInspect", "SyringeCheck", "BlisterPack", "FruitQuality", "MeatQuality", "BottleInspect", "FabricPattern", "FabricDensity", "GarmentInspect", "PaintQuality", "PaintQualityInspection", "WeldInspect", "WeldSeamInspection", "PanelGap", "GapMeasurement", "PartPresence", "AssemblyVerification", "AssemblyVerify", "DimensionCheck", "DimensionalInspection", "BodyPanelInspection", "GearInspection", "ConnectorInspection", "BoltPresenceCheck", "TrainComponentModel", "CircleGridDetect", "CharSegment", "CharBox", "CharDetect", "TextLocate"):
        m(name, None)
    for name in ("color_recognize", "TextureAnalysisFFT", "FastCorner", "SobelCorner", "FeatureCluster", "ContourDetect", "ContourApprox", "ContourHierarchy", "ContourProperty", "FourierDescriptor", "ShapeContext", "GenContoursSkeleton", "MergeContours", "SubpixelEdge", "SubpixelCorner", "SubpixelLine", "SubpixelCircle", "EdgesSubPix", "EdgesSubPixCanny", "FindLines", "FindCircles", "MeasurePairs", "MeasureFuzzy", "CaliperMeasureDistance", "CaliperFitLine", "CaliperFindCorner", "CaliperProjectEdge", "CheckerboardDetect", "CalibrationPointsExtract", "CalibrationQualityCheck", "MomentInvariants", "PrecisionBenchmark", "photometric_stereo_calibrate"):
        m(name, None)
    for name in ("Watershed", "KMeansSegment", "RegionSplitMerge", "Superpixel", "MeanShiftSegment", "GraphCut", "GrabCut", "FFTForward", "shape_from_shading", "PrecisionTest"):
        add(f"img_{name}", lambda s, d, t=name: _flat(images.run(frames(s, d), (t, {}))))
    for name in ("KeyPointMatch", "CornerMatch", "ImageRegister", "DescriptorMatch", "FeaturePointMatch", "HomographyCalc", "FeatureTrack", "WaferPatternInspection", "WaferAlignment", "ShapeDefect", "FrequencyDefectDetect", "CalibrationMonitor"):
        op = find(name)
        add(f"match_{name}", lambda s, d, op=op: op.plan(frames(s, d), frames(s, d, V2), **op.bind({})))
    for name in ("ImageStitch", "PanoramaStitch", "MosaicStitch", "MultiImageStitch", "stereo_match_ncc", "stereo_match_sgbm", "WienerFilter"):
        op = find(name)
        params = {"num_disparities": 8} if "stereo" in name else {"overlap": 4} if name == "MultiImageStitch" else {}
        add(f"img_{name}", lambda s, d, op=op, params=params: _flat(op.plan(frames(s, d), frames(s, d, V2), **op.bind(params))))


def _surfaces() -> None:
    """Point clouds and long pixel tables."""

    def t(type_id: str, sql: str | None, reals: str, *sources: tuple[str, list[str]], name: str = "", digits: int = 6, **params) -> None:
        op = find(type_id)
        add(f"tab_{name or type_id}", lambda s, d: op.plan(*[table(s, d, n).selectExpr(*e) for n, e in sources], **op.bind(params)), sql, reals, digits)

    cloud = ("embeddings", ["cast(label as long) AS cloud_id", "vec_id AS point_id", "cast(embedding[0] as double) AS x", "cast(embedding[1] as double) AS y", "cast(embedding[2] as double) AS z"])
    pts = "pts AS (SELECT label::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
    t("pointcloud_cluster", f"""WITH RECURSIVE {pts}, l AS (SELECT a.cloud_id, a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.2),
reach AS (SELECT cloud_id, a, b FROM l UNION SELECT r.cloud_id, r.a, l.b FROM reach r JOIN l ON r.cloud_id = l.cloud_id AND r.b = l.a),
c AS (SELECT cloud_id, a AS point_id, min(b) AS cluster FROM reach GROUP BY 1, 2)
SELECT cloud_id, cluster, n, center_x, center_y, center_z FROM (SELECT c.cloud_id, cluster, count(*) AS n, avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z FROM c JOIN pts ON c.cloud_id = pts.cloud_id AND c.point_id = pts.point_id GROUP BY 1, 2) WHERE n >= 2""", "center_x center_y center_z", cloud, tolerance=0.2, min_cluster_size=2)
    faces = " UNION ALL ".join(f"SELECT cloud_id, {k} AS axis, {s} AS side, " + ", ".join(f"c{a}" + (f" + {s}" if j == k else "") + f" AS c{a}" for j, a in enumerate("xyz")) + " FROM v" for k in range(3) for s in (0, 1))
    t("marching_cubes", f"WITH {pts}, v AS (SELECT DISTINCT cloud_id, floor(x / 0.5)::BIGINT AS cx, floor(y / 0.5)::BIGINT AS cy, floor(z / 0.5)::BIGINT AS cz FROM pts), f AS ({faces}) SELECT cloud_id, axis, min(side)::INT AS side, cx, cy, cz FROM f GROUP BY cloud_id, axis, cx, cy, cz HAVING count(*) = 1", "", cloud, voxel_size=0.5)
    for name, params in (("PointCloudSegmentCluster", {"tolerance": 0.3, "min_cluster_size": 2}), ("PointCloudSegmentPlane", {"distance_threshold": 0.2, "min_inliers": 3}), ("PointCloudNormalEstimation", {"search_radius": 0.6}), ("pointcloud_visualize", {}), ("delaunay_triangulation", {})):
        t(name, None, "", cloud, **params)
    for name in ("global_register", "ndt_register", "PointCloudICP", "PointCloudNDT", "PointCloudFeatureMatching"):
        t(name, None, "", cloud, cloud)
    grid = ("part", ["cast(0 as long) AS frame_id", "cast((p_partkey - 1) div 50 as int) AS y", "cast((p_partkey - 1) % 50 as int) AS x", "cast(p_size % 7 - 3 as double) AS p", "cast(p_size % 5 - 2 as double) AS q"])
    g = "g AS (SELECT 0::BIGINT AS frame_id, ((p_partkey - 1) // 50)::INT AS y, ((p_partkey - 1) % 50)::INT AS x, (p_size % 7 - 3)::DOUBLE AS p, (p_size % 5 - 2)::DOUBLE AS q FROM part)"
    slope = lambda c, part, order: f"coalesce((lead({c}) OVER w{order} - lag({c}) OVER w{order}) / 2, lead({c}) OVER w{order} - {c}, {c} - lag({c}) OVER w{order}, 0)"
    t("surface_curvature", f"WITH {g}, s AS (SELECT *, {slope('p', 'y', 'x')} AS a, {slope('p', 'x', 'y')} AS b, {slope('q', 'x', 'y')} AS c FROM g WINDOW wx AS (PARTITION BY frame_id, y ORDER BY x), wy AS (PARTITION BY frame_id, x ORDER BY y)) SELECT frame_id, y, x, ((1 + q * q) * a - 2 * p * q * b + (1 + p * p) * c) / (2 * pow(1 + p * p + q * q, 1.5)) AS mean_curvature, (a * c - b * b) / ((1 + p * p + q * q) ** 2) AS gaussian_curvature FROM s", "mean_curvature gaussian_curvature", grid)
    t("surface_height_reconstruct", f"WITH {g}, r AS (SELECT *, coalesce((p + lag(p) OVER (PARTITION BY y ORDER BY x)) / 2, 0) AS s FROM g), h AS (SELECT y, x, sum(s) OVER (PARTITION BY y ORDER BY x) AS h FROM r), e AS (SELECT y, coalesce((q + lag(q) OVER (ORDER BY y)) / 2, 0) AS s FROM g WHERE x = 0), f AS (SELECT y, sum(s) OVER (ORDER BY y) AS h0 FROM e), z AS (SELECT h.y, x, h + h0 AS z FROM h JOIN f ON h.y = f.y) SELECT 0::BIGINT AS frame_id, y, x, z - min(z) OVER () AS height FROM z", "height", grid)
    lit = ("lineitem", ["l_suppkey AS frame_id", "cast(l_quantity as int) AS y", "l_linenumber AS x", "l_extendedprice AS v"])
    t("specularity_remove", "SELECT l_suppkey AS frame_id, l_quantity::INT AS y, l_linenumber AS x, median(l_extendedprice) AS v, count(*) AS n_lights FROM lineitem GROUP BY 1, 2, 3", "v", lit, digits=3)
    t("multiple_light_acquire", "SELECT n_nationkey::BIGINT AS frame_id, k::INT AS light_id, cos(pi() / 2 * k) * sqrt(0.5) AS lx, sin(pi() / 2 * k) * sqrt(0.5) AS ly, sqrt(0.5) AS lz FROM nation, (SELECT unnest(range(4)) AS k)", "lx ly lz", ("nation", ["cast(n_nationkey as long) AS frame_id"]))
    t("TrainCheckpoint", "WITH e AS (SELECT user_id AS run_id, event_id AS step, value AS loss FROM events), r AS (SELECT *, step % 5 = 0 AND row_number() OVER (PARTITION BY run_id, step % 5 = 0 ORDER BY step DESC) <= 5 AS k, row_number() OVER (PARTITION BY run_id ORDER BY loss NULLS LAST, step) = 1 AS is_best FROM e) SELECT run_id, step, loss, k OR is_best AS kept, is_best FROM r", "loss", ("events", ["user_id AS run_id", "event_id AS step", "value AS loss"]))
    t("GenCrossContour", "SELECT n_nationkey::BIGINT AS contour_id, k::INT AS seq, n_regionkey + CASE k WHEN 0 THEN -10.0 WHEN 1 THEN 10.0 ELSE 0 END AS x, CASE k WHEN 3 THEN -10.0 WHEN 4 THEN 10.0 ELSE 0 END + 1.0 AS y FROM nation, (SELECT unnest(range(5)) AS k)", "x y", ("nation", ["cast(n_nationkey as long) AS contour_id", "cast(n_regionkey as double) AS x", "1.0D AS y"]))
    t("GenPolygonContour", "SELECT n_nationkey::BIGINT AS contour_id, k::INT AS seq, CASE k % 3 WHEN 1 THEN n_regionkey ELSE 0 END::DOUBLE AS x, CASE k % 3 WHEN 2 THEN 7 ELSE 0 END::DOUBLE AS y FROM nation, (SELECT unnest(range(4)) AS k)", "x y", ("nation", ["cast(n_nationkey as long) AS contour_id", "concat('0,', n_regionkey, ',0') AS vertices_x", "'0,0,7' AS vertices_y"]))
    parts = ("part", ["p_brand AS object_id", "cast(p_size as double) AS x", "p_retailprice / 100 AS y"])
    t("EllipseFitMeasure", "WITH c AS (SELECT p_brand AS object_id, avg(p_size) AS mx, avg(p_retailprice / 100) AS my, var_pop(p_size) AS u, covar_pop(p_size, p_retailprice / 100) AS v, var_pop(p_retailprice / 100) AS w FROM part GROUP BY 1), e AS (SELECT *, sqrt((u + w) + 2 * sqrt(pow((u - w) / 2, 2) + v * v)) AS a, sqrt(greatest((u + w) - 2 * sqrt(pow((u - w) / 2, 2) + v * v), 0)) AS b FROM c) SELECT object_id, mx AS center_x, my AS center_y, a AS major_axis, b AS minor_axis, degrees(atan2(2 * v, u - w) / 2) AS angle_deg, pi() * a * b AS area, pi() * (3 * (a + b) - sqrt((3 * a + b) * (a + 3 * b))) AS perimeter, b / a AS ellipticity, b > 1e-9 AS is_valid FROM e", "center_x center_y major_axis minor_axis angle_deg area perimeter ellipticity", parts, digits=4)


def build() -> None:
    if not _queries:
        load()
        for type_id in geometry.FORMULAS:
            _geometry(type_id)
        _images()
        _measures()
        _inspections()
        _tables()
        _products()
        _surfaces()
        from . import catalog_more, catalog_pieces, catalog_rest

        for more in (catalog_more, catalog_pieces, catalog_rest):
            more.build()


def queries() -> dict[str, Query]:
    build()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    build()
    return dict(_oracles)
