"""Queries of the remaining operators whose result SQL can say: accelerator names, templates, clouds, polygons, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images
from ..spec import find
from .catalog import H, V2, W, _clamped, _flat, _image, _near, _px, add, frames, pixels, table
from .catalog_more import _DISTANCE, PX, _back, _forward

_IN = f"p.y BETWEEN 1 AND {H - 2} AND p.x BETWEEN 1 AND {W - 2}"
_GX, _GY = "sum(q.v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END)", "sum(q.v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END)"


def _accelerated() -> None:
    each = lambda e: f"SELECT frame_id, y, x, {e} AS v FROM px"
    _image("CudaThreshold", each("CASE WHEN v > 128 THEN 255 ELSE 0 END"))
    _image("CudaSobelFilter", f"SELECT px.frame_id, px.y, px.x, coalesce(n.v, 0) AS v FROM px LEFT JOIN ({_near(f'CASE WHEN floor(sqrt(({_GX}) * ({_GX}) + ({_GY}) * ({_GY}))) > 120 THEN 255 ELSE 0 END', 1, where=_IN)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x", threshold=120)
    _image("EdgeSegment", f"SELECT px.frame_id, px.y, px.x, coalesce(n.v, 0) AS v FROM px LEFT JOIN ({_near(f'CASE WHEN floor(sqrt(({_GX}) * ({_GX}) + ({_GY}) * ({_GY}))) > 150 THEN 255 ELSE 0 END', 1, where=_IN)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x", edge_threshold=150)
    _image("CudaMorphology", _near("min(q.v)", 1, clamp=False))
    _image("CudaResize", f"SELECT frame_id, t.y, t.x, v FROM px p JOIN (SELECT y, x FROM (SELECT unnest(range({H // 2})) AS y) a, (SELECT unnest(range({W // 2})) AS x) b) t ON p.y = t.y * 2 AND p.x = t.x * 2", target_width=W // 2, target_height=H // 2, interpolation="Nearest")
    plain = lambda t, **p: lambda s, d: find(t).plan(frames(s, d), **find(t).bind(p))
    add("measure_CudaHistogram", plain("CudaHistogram"), f"WITH {PX} SELECT frame_id, v::BIGINT AS bin, count(*) AS n FROM px GROUP BY 1, 2")
    _image("AdaptiveEnhance", f"SELECT p.frame_id, y, x, floor(c / {W * H}::DOUBLE * 255) AS v FROM px p JOIN (SELECT frame_id, v, sum(n) OVER (PARTITION BY frame_id ORDER BY v) AS c FROM (SELECT frame_id, v, count(*) AS n FROM px GROUP BY 1, 2)) h ON p.frame_id = h.frame_id AND p.v = h.v")
    _image("FrequencyFilter", f"WITH {_forward('px', 'f')}, g AS (SELECT frame_id, k, u, re, im FROM (SELECT *, {_DISTANCE} AS d FROM f) WHERE d <= 0.2), {_back('g', 'b')} SELECT frame_id, y, x, floor(least(255, greatest(0, v + 1e-6))) AS v FROM b", cutoff_freq=0.2)
    _image("ReflectionRemove", _near("CASE WHEN p.v > 200 THEN list_sort(list(q.v))[25] ELSE p.v END", 3), threshold=200.0)
    near = "sum(q.v) / 49.0::DOUBLE"
    var = f"greatest(sum(q.v * q.v) / 49.0::DOUBLE - ({near}) * ({near}), 0)"
    _image("DenoiseAdaptive", _near(_clamped(f"({near}) + greatest({var} - 625, 0) / greatest({var}, 1e-9) * (p.v - ({near})) + 1e-6"), 3))
    _image("GeometricCalibration", each("v"))
    _image("PerspectiveTransform", each("v"))
    _image("TemplateTrain", "SELECT frame_id, y - 4 AS y, x - 5 AS x, v FROM px WHERE x BETWEEN 5 AND 10 AND y BETWEEN 4 AND 8", roi_x=5, roi_y=4, roi_width=6, roi_height=5)
    _image("FrequencyEdgeEnhance", f"SELECT px.frame_id, px.y, px.x, floor(least(255, px.v + coalesce(n.v, 0) / 8.0 + 1e-6)) AS v FROM px LEFT JOIN ({_near(f'abs({_GX})', 1, where=_IN)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x")
    spectrum = lambda e: f"WITH {_forward('px', 'f')}, m AS (SELECT frame_id, (k + {H // 2}) % {H} AS y, (u + {W // 2}) % {W} AS x, {e} AS v FROM f), s AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM m WINDOW w AS (PARTITION BY frame_id)) SELECT frame_id, y::INT AS y, x::INT AS x, floor((v - lo) * (255.0 / (hi - lo)) + 1e-6) AS v FROM s"
    _image("MagnitudeSpectrum", spectrum("sqrt(re * re + im * im)"), log_scale=False)
    _image("PowerSpectrum", spectrum("re * re + im * im"), log_scale=False)
    reach = f"WITH RECURSIVE {PX}, f AS (SELECT p.frame_id, p.y, p.x FROM px p JOIN px s ON s.frame_id = p.frame_id AND s.y = 4 AND s.x = 5 WHERE abs(p.v - s.v) <= 60), r AS (SELECT frame_id, y, x FROM f WHERE y = 4 AND x = 5 UNION SELECT f.frame_id, f.y, f.x FROM r JOIN f ON f.frame_id = r.frame_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1)"
    add("img_RegionGrowing", lambda s, d: _flat(images.run(frames(s, d), ("RegionGrowing", {"seed_x": 5, "seed_y": 4, "threshold": 60, "connectivity": 4}))), f"{reach} SELECT px.frame_id, px.y, px.x, CASE WHEN r.y IS NULL THEN 0 ELSE 255 END::BIGINT AS v FROM px LEFT JOIN r ON r.frame_id = px.frame_id AND r.y = px.y AND r.x = px.x")
    two = f"WITH {PX}, {_px('pz', V2)}"
    pair = lambda t, **p: lambda s, d: _flat(find(t).plan(frames(s, d), frames(s, d, V2), **find(t).bind(p)))
    add("img_ImageConcat", pair("ImageConcat"), f"{two} SELECT frame_id, y, x, v::BIGINT AS v FROM px UNION ALL SELECT frame_id, y, x + {W}, v::BIGINT FROM pz")
    add("img_Mixup", pair("Mixup", mix_ratio=0.25), f"{two} SELECT px.frame_id, px.y, px.x, floor(0.25 * px.v + 0.75 * pz.v)::BIGINT AS v FROM px JOIN pz ON pz.frame_id = px.frame_id AND pz.y = px.y AND pz.x = px.x")
    add("tab_ImageDisplay", lambda s, d: find("ImageDisplay").plan(frames(s, d)).selectExpr("frame_id", "cast(width as long) AS width", "cast(height as long) AS height", "format", "cast(bytes as long) AS bytes"), f"SELECT s_suppkey::BIGINT AS frame_id, {W}::BIGINT AS width, {H}::BIGINT AS height, 'Mono8' AS format, {W * H}::BIGINT AS bytes FROM supplier")
    add("measure_HarrisCorner", lambda s, d: find("HarrisCorner").plan(frames(s, d), **find("HarrisCorner").bind({})).selectExpr("frame_id", "x", "y"), f"""WITH {PX}, g AS (SELECT px.frame_id, px.y, px.x, coalesce(n.gx, 0) AS gx, coalesce(n.v, 0) AS gy FROM px LEFT JOIN ({_near(f'{_GX} AS gx, {_GY}', 1, where=_IN)}) n ON n.frame_id = px.frame_id AND n.y = px.y AND n.x = px.x),
v AS (SELECT frame_id, y, x, gx * gx AS a, gx * gy AS b, gy * gy AS v FROM g), s AS ({_near('sum(q.a) AS a, sum(q.b) AS b, sum(q.v)', 1, 'v')}), h AS (SELECT frame_id, y, x, round(a * v - b * b - 0.04 * (a + v) * (a + v), 3) AS v FROM s),
t AS ({_near('CASE WHEN p.v >= max(q.v) THEN p.v END', 1, 'h')}) SELECT frame_id, x::BIGINT AS x, y::BIGINT AS y FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, y, x) AS r FROM t WHERE v > 50) WHERE r <= 100""")


def _templates() -> None:
    """Where a piece of one frame stands in all: every place's correlation, the best or all of them."""
    patch = lambda s, d: images.run(frames(s, d).filter("frame_id = 3"), ("TemplateTrain", {"roi_x": 5, "roi_y": 4, "roi_width": 6, "roi_height": 5}))
    scores = f"""WITH {PX}, t AS (SELECT y - 4 AS ty, x - 5 AS tx, v AS tv FROM px WHERE frame_id = 3 AND x BETWEEN 5 AND 10 AND y BETWEEN 4 AND 8),
s AS (SELECT px.frame_id, px.x - tx AS x, px.y - ty AS y, corr(v, tv) AS score FROM px JOIN t ON px.x - tx BETWEEN 0 AND {W - 6} AND px.y - ty BETWEEN 0 AND {H - 5} GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 9) DESC, y, x) AS r FROM s)"""
    best = f"{scores} SELECT frame_id, 3::BIGINT AS other_id, x::BIGINT AS x, y::BIGINT AS y, score FROM r WHERE r = 1 AND score >= 0.5"
    for name, params in (("TemplateMatch", {"threshold": 0.5}), ("MultiTemplateMatch", {"threshold": 0.5}), ("CudaTemplateMatch", {"threshold": 0.5}), ("BestMatch", {"min_score": 0.5}), ("PMAlign", {"accept_threshold": 50.0})):
        op = find(name)
        add(f"match_{name}", lambda s, d, op=op, params=params: op.plan(frames(s, d), patch(s, d), **op.bind(params)), best, "score")
    search = find("SearchMax")
    add("match_SearchMax", lambda s, d: search.plan(frames(s, d), patch(s, d), **search.bind({})).select("frame_id", "best_x", "best_y", "best_score"), f"{scores} SELECT frame_id, CASE WHEN score >= 0.5 THEN x ELSE 0 END::BIGINT AS best_x, CASE WHEN score >= 0.5 THEN y ELSE 0 END::BIGINT AS best_y, CASE WHEN score >= 0.5 THEN score ELSE 0 END AS best_score FROM r WHERE r = 1", "best_score")


def _clouds() -> None:
    def t(type_id: str, sql: str, reals: str, *sources: tuple[str, list[str]], name: str = "", digits: int = 6, **params) -> None:
        op = find(type_id)
        add(f"tab_{name or type_id}", lambda s, d: op.plan(*[table(s, d, n).selectExpr(*e) for n, e in sources], **op.bind(params)), sql, reals, digits)

    cloud = ("embeddings", ["cast(label as long) AS cloud_id", "vec_id AS point_id", "cast(embedding[0] as double) AS x", "cast(embedding[1] as double) AS y", "cast(embedding[2] as double) AS z"])
    pts = "(SELECT label::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
    t("pointcloud_merge", f"SELECT * FROM {pts} UNION ALL SELECT * FROM {pts}", "x y z", cloud, cloud)
    t("multiview_merge", f"SELECT cloud_id, point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.3), floor(y / 0.3), floor(z / 0.3) ORDER BY cloud_id, point_id) AS r FROM {pts}) WHERE r = 1", "x y z", cloud, overlap_threshold=0.3)
    t("scan_merge", f"SELECT cloud_id, point_id, x, y + (point_id % 9) * 0.01 AS y, z, (point_id % 9)::BIGINT AS scan_index FROM {pts}", "x y z", (cloud[0], [*cloud[1], "cast(vec_id % 9 as long) AS scan_index"]))
    t("ShapeModel3DTransform", f"SELECT cloud_id, point_id, 1 - y AS x, 2 + x AS y, 3 + z AS z FROM {pts}", "x y z", cloud, tx=1.0, ty=2.0, tz=3.0, rz=90.0)
    t("pcl_pointcloud_downsample", f"SELECT cloud_id, floor(x / 0.5)::BIGINT AS cx, floor(y / 0.5)::BIGINT AS cy, floor(z / 0.5)::BIGINT AS cz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM {pts} GROUP BY 1, 2, 3, 4", "x y z", cloud, voxel_size=0.5)
    depth = lambda s, d: pixels(s, d, "((x * 7 + y * 13 + s_suppkey * 31) % 256)").selectExpr("frame_id", "y", "x", "cast(v as double) AS v")
    through = f"WITH {_px('pd', '((x * 7 + y * 13 + s_suppkey * 31) % 256)')} SELECT frame_id AS cloud_id, y::BIGINT * 1000000 + x AS point_id, (x - 0) * v / 525.0::DOUBLE AS x, (y - 0) * v / 525.0::DOUBLE AS y, v::DOUBLE AS z FROM pd WHERE v > 0"
    for name in ("depth_to_pointcloud", "PointCloudFromDepth", "pcl_pointcloud_from_depth", "pointcloud_stereo"):
        op = find(name)
        add(f"tab_{name}", lambda s, d, op=op: op.plan(depth(s, d), **op.bind({})), through, "x y z")

    parts = ("part", ["p_brand AS object_id", "cast(p_size as double) AS x", "p_retailprice / 100 AS y"])
    cov = "SELECT p_brand AS object_id, count(*) AS n, avg(p_size) AS mx, avg(p_retailprice / 100) AS my, var_pop(p_size) AS u, covar_pop(p_size, p_retailprice / 100) AS v, var_pop(p_retailprice / 100) AS w FROM part GROUP BY 1"
    t("LineFitMeasure", f"SELECT object_id, -sin(t) AS line_a, cos(t) AS line_b, sin(t) * mx - cos(t) * my AS line_c, sqrt(greatest((u + w) / 2 - sqrt(pow((u - w) / 2, 2) + v * v), 0)) AS rms_error, n AS point_count FROM (SELECT *, atan2(2 * v, u - w) / 2 AS t FROM ({cov}))", "line_a line_b line_c rms_error", parts, digits=4)
    circle = """WITH p AS (SELECT p_brand AS object_id, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part), m AS (SELECT object_id, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1),
q AS (SELECT p.object_id, mx, my, x - mx AS u, y - my AS v, pow(x - mx, 2) + pow(y - my, 2) AS q FROM p JOIN m USING (object_id)),
s AS (SELECT object_id, mx, my, count(*) AS n, avg(u * u) AS uu, avg(u * v) AS uv, avg(v * v) AS vv, avg(u * q) AS uq, avg(v * q) AS vq, avg(q) AS q, avg(q * q) AS qq FROM q GROUP BY 1, 2, 3),
c AS (SELECT *, n >= 3 AND abs(uu * vv - uv * uv) > 1e-12 AS ok, (uq * vv - vq * uv) / (uu * vv - uv * uv) / 2 AS a, (vq * uu - uq * uv) / (uu * vv - uv * uv) / 2 AS b FROM s)
SELECT object_id, mx + a AS center_x, my + b AS center_y, sqrt(a * a + b * b + q) AS radius, sqrt(greatest(qq - q * q - 2 * (a * uq + b * vq), 0) / (4 * (a * a + b * b + q))) AS fit_error, ok AS is_valid FROM c"""
    for name in ("CircleFit", "CircleFitMeasure"):
        t(name, circle, "center_x center_y radius fit_error", parts, digits=3)

    points = lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_quantity").alias("x"), F.min("l_extendedprice").alias("y"))
    polygon = "WITH p AS (SELECT object_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (SELECT l_orderkey AS object_id, l_linenumber AS seq, min(l_quantity) AS x, min(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY object_id ORDER BY seq)), s AS (SELECT object_id, count(*) AS n, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) AS perimeter, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS bw, max(y) - min(y) AS bh FROM p GROUP BY 1)"
    measures = {
        "AreaMeasure": ("area, n AS point_count", "area"),
        "PerimeterMeasure": ("perimeter, n AS point_count", "perimeter"),
        "CenterMeasure": ("cx AS center_x, cy AS center_y, n AS point_count", "center_x center_y"),
        "CircleMeasure": ("CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0 END AS circularity, 2 * sqrt(area / pi()) AS equivalent_diameter, area, perimeter, cx AS center_x, cy AS center_y, sqrt(bw * bw + bh * bh) / 2 AS bounding_radius", "circularity equivalent_diameter area perimeter center_x center_y bounding_radius"),
        "RectangleMeasure": ("bw AS width, bh AS height, area, CASE WHEN bw * bh > 0 THEN area / (bw * bh) ELSE 0 END AS rectangularity, CASE WHEN least(bw, bh) > 0 THEN greatest(bw, bh) / least(bw, bh) ELSE 0 END AS aspect_ratio, cx AS center_x, cy AS center_y", "width height area rectangularity aspect_ratio center_x center_y"),
    }
    for name, (columns, reals) in measures.items():
        op = find(name)
        add(f"tab_{name}", lambda s, d, op=op: op.plan(points(s, d), **op.bind({})), f"{polygon} SELECT object_id, {columns} FROM s", reals, 7 if name == "RectangleMeasure" else 5)
    t("MeasureResultsGet", "SELECT o_orderpriority AS object_id, o_orderkey, o_totalprice AS value FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)", "value", ("orders", ["o_orderpriority AS object_id", "o_orderkey", "o_totalprice AS value"]))
    got = find("MeasureResultsGet")

    def first_kind(s: SparkSession, d: str) -> DataFrame:
        return got.plan(table(s, d, "orders").selectExpr("o_orderpriority AS object_id", "o_orderkey", "o_totalprice AS value"), **got.bind({"object_id": "1-URGENT"}))

    add("tab_MeasureResultsGet", first_kind, "SELECT o_orderpriority AS object_id, o_orderkey, o_totalprice AS value FROM orders WHERE o_orderpriority = '1-URGENT'", "value")


def build() -> None:
    _accelerated()
    _templates()
    _clouds()
