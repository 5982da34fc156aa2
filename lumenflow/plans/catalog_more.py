"""More queries: filters, frequencies, colours, shapes and codes, each with SQL that works on long pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images
from ..spec import find
from .catalog import H, V1, V2, W, _flat, _image, _near, _px, add, frames, pixels, table

PX = _px("px", V1)


# --- frequencies: the transform as sums, first along lines, then along columns


def _wave(n: str, k: str, size: int) -> tuple[str, str]:
    angle = f"2 * pi() * {n} * {k} / {size}"
    return f"cos({angle})", f"sin({angle})"


def _forward(source: str, name: str) -> str:
    """{name}(frame_id, k, u, re, im) of source(frame_id, y, x, v)."""
    cx, sx = _wave("x", "u", W)
    cy, sy = _wave("y", "k", H)
    return f"""{name}_l AS (SELECT frame_id, y, u, sum(v * {cx}) AS re, -sum(v * {sx}) AS im FROM {source}, (SELECT unnest(range({W})) AS u) q GROUP BY 1, 2, 3),
{name} AS (SELECT frame_id, k, u, sum(re * {cy} + im * {sy}) AS re, sum(im * {cy} - re * {sy}) AS im FROM {name}_l, (SELECT unnest(range({H})) AS k) q GROUP BY 1, 2, 3)"""


def _back(source: str, name: str) -> str:
    """{name}(frame_id, y, x, v): the real part of the inverse of source(frame_id, k, u, re, im)."""
    cx, sx = _wave("x", "u", W)
    cy, sy = _wave("y", "k", H)
    return f"""{name}_c AS (SELECT frame_id, y, u, sum(re * {cy} - im * {sy}) AS re, sum(im * {cy} + re * {sy}) AS im FROM {source}, (SELECT unnest(range({H})) AS y) q GROUP BY 1, 2, 3),
{name} AS (SELECT frame_id, y, x, sum(re * {cx} - im * {sx}) / {W * H} AS v FROM {name}_c, (SELECT unnest(range({W})) AS x) q GROUP BY 1, 2, 3)"""


_DISTANCE = f"sqrt(pow(CASE WHEN k < {(H + 1) // 2} THEN k ELSE k - {H} END / {H}::DOUBLE, 2) + pow(CASE WHEN u < {(W + 1) // 2} THEN u ELSE u - {W} END / {W}::DOUBLE, 2))"
_CUT = "floor(least(255, greatest(0, v + 1e-6)))"


def _bell(sigma: float) -> str:
    return f"exp(-pow(d * 100, 2) / {2 * sigma * sigma})"


def _frequencies() -> None:
    responses = {
        "IdealLowPass": ("d <= 0.2", {"cutoff_frequency": 0.2}),
        "IdealHighPass": ("d > 0.1", {}),
        "GaussLowPass": (_bell(10), {}),
        "GaussHighPass": (f"1 - {_bell(10)}", {}),
        "ButterworthLowPass": ("1 / (1 + pow(d / 0.2, 4))", {"cutoff_frequency": 0.2}),
        "ButterworthHighPass": ("1 - 1 / (1 + pow(d / 0.1, 4))", {}),
        "BandPass": ("abs(d - 0.3) <= 0.05", {}),
        "BandStop": ("abs(d - 0.3) > 0.05", {}),
        "FrequencySmooth": (_bell(5), {}),
        "FrequencySharpen": (f"1 + 1.0 * (1 - {_bell(20)})", {}),
        "FrequencyUnsharpMask": (f"1 + 0.5 * (1 - {_bell(5)})", {}),
    }
    for name, (response, params) in responses.items():
        gain = f"({response})::INT" if "=" in response or ">" in response else response
        body = f"WITH {_forward('px', 'f')}, g AS (SELECT frame_id, k, u, re * r AS re, im * r AS im FROM (SELECT *, {gain} AS r FROM (SELECT *, {_DISTANCE} AS d FROM f))), {_back('g', 'b')} SELECT frame_id, y, x, {_CUT} AS v FROM b"
        _image(name, body, **params)
    gain = "1.5 * (1 - exp(-d * d / 0.08)) + 0.5"
    logs = "l AS (SELECT frame_id, y, x, ln(1 + v) AS v FROM px)"
    _image("HomomorphicFilter", f"WITH {logs}, {_forward('l', 'f')}, g AS (SELECT frame_id, k, u, re * r AS re, im * r AS im FROM (SELECT *, {gain} AS r FROM (SELECT *, {_DISTANCE} AS d FROM f))), {_back('g', 'b')} SELECT frame_id, y, x, floor(least(255, greatest(0, exp(v) - 1 + 1e-6))) AS v FROM b")
    both = f"WITH {PX}, {_px('pz', V2)}, {_forward('px', 'f')}, {_forward('pz', 'g')}"
    spread = "SELECT frame_id, y::INT AS y, x::INT AS x, CAST(floor(least(255, greatest(0, (v - lo) * (255.0 / (hi - lo)) + 1e-6))) AS BIGINT) AS v FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM b WINDOW w AS (PARTITION BY frame_id))"
    for name, sign in (("FrequencyMultiply", 1), ("FrequencyCorrelate", -1)):
        product = f"p AS (SELECT f.frame_id, f.k, f.u, f.re * g.re - f.im * g.im * {sign} AS re, f.re * g.im * {sign} + f.im * g.re AS im FROM f JOIN g ON f.frame_id = g.frame_id AND f.k = g.k AND f.u = g.u)"
        op = find(name)
        add(f"img_{name}", lambda s, d, op=op: _flat(op.plan(frames(s, d), frames(s, d, V2))), f"{both}, {product}, {_back('p', 'b')} {spread}")


# --- neighbourhoods


def _filters() -> None:
    far = "(dx * dx + dy * dy)"
    bell = lambda sigma: f"exp(-{far} / {2 * sigma * sigma})"
    _image("GaussianFilter", _near(f"floor(sum(q.v * {bell(1.0)}) / sum({bell(1.0)}) + 1e-6)", 2))
    _image("GaussianFilter", _near(f"floor(sum(q.v * {bell(2.0)}) / sum({bell(2.0)}) + 1e-6)", 3), "GaussianFilter_wide", kernel_size=7, sigma=2.0)
    _image("CudaGaussianBlur", _near(f"floor(sum(q.v * {bell(1.0)}) / sum({bell(1.0)}) + 1e-6)", 3), sigma=1.0)
    _image("UnsharpMask", _near(f"floor(least(255, greatest(0, p.v + 1.5 * (p.v - sum(q.v * {bell(1.0)}) / sum({bell(1.0)})) + 1e-6)))", 2))
    for name, k in (("BilateralFilter", 2), ("DenoiseBilateral", 4)):
        weight = f"exp(-{far} / {2 * 75.0 * 75.0}) * exp(-pow(q.v - p.v, 2) / {2 * 75.0 * 75.0})"
        _image(name, _near(f"floor(sum(q.v * {weight}) / sum({weight}) + 1e-6)", k))
    local = "w AS (SELECT frame_id, y, x, v / 255.0::DOUBLE AS v FROM px)"
    first = _near("avg(q.v) AS m, avg(q.v * q.v)", 2, "w")
    _image("GuidedFilter", f"WITH {local}, s AS ({first}), a AS (SELECT frame_id, y, x, m, (v - m * m) / (v - m * m + 0.01) AS v FROM s), b AS (SELECT frame_id, y, x, v AS a, m - v * m AS v FROM a), c AS ({_near('avg(q.a) AS a, avg(q.v)', 2, 'b')}) SELECT c.frame_id, c.y, c.x, floor(least(255, greatest(0, (c.a * w.v + c.v) * 255 + 1e-6))) AS v FROM c JOIN w ON w.frame_id = c.frame_id AND w.y = c.y AND w.x = c.x", radius=2)
    empty = "e AS (SELECT frame_id, y, x FROM px WHERE v <= 128)"
    reach = f"r AS (SELECT frame_id, y, x FROM e WHERE y IN (0, {H - 1}) OR x IN (0, {W - 1}) UNION SELECT e.frame_id, e.y, e.x FROM r JOIN e ON e.frame_id = r.frame_id AND abs(e.y - r.y) + abs(e.x - r.x) = 1)"
    add("img_FillHoles", lambda s, d: _flat(images.run(frames(s, d), ("SimpleThreshold", {"threshold": 128}), ("FillHoles", {}))), f"WITH RECURSIVE {PX}, {empty}, {reach} SELECT px.frame_id, px.y, px.x, CASE WHEN r.y IS NULL THEN 255 ELSE 0 END::BIGINT AS v FROM px LEFT JOIN r ON r.frame_id = px.frame_id AND r.y = px.y AND r.x = px.x")
    # A half turn, and thirty degrees within the frame: four neighbours by their shares.
    cx, cy = (W - 1) / 2, (H - 1) / 2
    place = f"SELECT i AS x, j AS y, cos(radians(30)) * (i - {cx}) + sin(radians(30)) * (j - {cy}) + {cx} AS sx, -sin(radians(30)) * (i - {cx}) + cos(radians(30)) * (j - {cy}) + {cy} AS sy FROM (SELECT unnest(range({W})) AS i) a, (SELECT unnest(range({H})) AS j) b"
    clipped = f"SELECT *, sx BETWEEN -0.5 AND {W - 0.5} AND sy BETWEEN -0.5 AND {H - 0.5} AS inside, least({W - 1}, greatest(0, sx)) AS cx, least({H - 1}, greatest(0, sy)) AS cy FROM t"
    corner = f"SELECT *, least({W - 2}, floor(cx))::INT AS x0, least({H - 2}, floor(cy))::INT AS y0 FROM c"
    share = "sum(p.v * (CASE WHEN p.x = x0 THEN 1 - (cx - x0) ELSE cx - x0 END) * (CASE WHEN p.y = y0 THEN 1 - (cy - y0) ELSE cy - y0 END))"
    turned = f"WITH t AS ({place}), c AS ({clipped}), z AS ({corner}) SELECT p.frame_id, z.y, z.x, CASE WHEN any_value(inside) THEN floor(least(255, greatest(0, {share} + 1e-9))) ELSE 0 END AS v FROM px p JOIN z ON p.x BETWEEN x0 AND x0 + 1 AND p.y BETWEEN y0 AND y0 + 1 GROUP BY p.frame_id, z.y, z.x"
    _image("Rotate", turned, angle=30.0, expand_canvas=False)
    _image("AffineTransform", f"SELECT p.frame_id, t.y, t.x, coalesce(q.v, 0) AS v FROM px p JOIN px t ON t.frame_id = p.frame_id AND t.y = p.y AND t.x = p.x LEFT JOIN px q ON q.frame_id = p.frame_id AND q.y = p.y - 1 AND q.x = p.x - 2", matrix="1,0,2,0,1,1")
    _image("DriftCorrection", f"SELECT p.frame_id, p.y, p.x, coalesce(q.v, 0) AS v FROM px p LEFT JOIN px q ON q.frame_id = p.frame_id AND q.y = p.y + 1 AND q.x = p.x + 3", drift_x=3.0, drift_y=1.0)


# --- colours: three planes


V3 = {c: v for c, v in enumerate((V1, V2, V1.replace("x * 7", "x * 5").replace("s_suppkey * 31", "s_suppkey * 53")))}


def coloured(s: SparkSession, d: str) -> DataFrame:
    from ..frames import from_pixels

    planes = [pixels(s, d, v).withColumn("c", F.lit(c)) for c, v in V3.items()]
    return from_pixels(planes[0].unionByName(planes[1]).unionByName(planes[2]))


_RGB = "rgb AS (SELECT s_suppkey::BIGINT AS frame_id, y::INT AS y, x::INT AS x, {} FROM supplier, (SELECT unnest(range({})) AS x) xs, (SELECT unnest(range({})) AS y) ys)".format(", ".join(f"{v}::INT AS {n}" for v, n in zip(V3.values(), "rgb", strict=True)), W, H)


def _samples(df: DataFrame) -> DataFrame:
    from ..frames import to_pixels

    return to_pixels(df).select("frame_id", "y", "x", "c", F.col("v").cast("long").alias("v"))


def _colour(name: str, planes: tuple[str, ...], source: str = "rgb", ctes: str = "", label: str = "", **params) -> None:
    each = " UNION ALL ".join(f"SELECT frame_id, y, x, {c}::INT AS c, CAST({e} AS BIGINT) AS v FROM {source}" for c, e in enumerate(planes))
    add(f"img_{label or name}", lambda s, d: _samples(images.run(coloured(s, d), (name, find(name).bind(params)))), f"WITH {_RGB}{', ' + ctes if ctes else ''} {each}")


_HSV = """m AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS val, (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE AS span FROM rgb),
hs AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN r = greatest(r, g, b) THEN (g - b) / 255.0::DOUBLE / span + CASE WHEN g < b THEN 6 ELSE 0 END WHEN g = greatest(r, g, b) THEN (b - r) / 255.0::DOUBLE / span + 2 ELSE (r - g) / 255.0::DOUBLE / span + 4 END AS h, CASE WHEN val = 0 THEN 0 ELSE span / val END AS s FROM m)"""


def _from_hsv(h: str, s: str) -> tuple[str, ...]:
    part = lambda n: f"(({h} + {n}) - 6 * floor(({h} + {n}) / 6))"
    return tuple(f"floor((val - val * {s} * greatest(0, least({part(n)}, 4 - {part(n)}, 1))) * 255 + 0.5 + 1e-6)" for n in (5, 3, 1))


def _colours() -> None:
    _colour("color_convert", ("floor(0.299 * r + 0.587 * g + 0.114 * b + 1e-6)",), label="color_convert_gray")
    _colour("color_convert", ("b", "g", "r"), label="color_convert_bgr", target_space="BGR")
    _colour("color_convert", ("floor(h * 30 + 1e-6)", "floor(s * 255 + 1e-6)", "greatest(r, g, b)"), "hs", _HSV, "color_convert_hsv", target_space="HSV")
    _colour("color_segment", ("CASE WHEN sqrt(pow(r - 120, 2) + pow(g - 60, 2) + pow(b - 200, 2)) <= 90 THEN 255 ELSE 0 END",), target_color="120,60,200", tolerance=90.0)
    mean = "a AS (SELECT frame_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM rgb GROUP BY 1), wb AS (SELECT rgb.*, mr, mg, mb, (mr + mg + mb) / 3 AS want FROM rgb JOIN a ON a.frame_id = rgb.frame_id)"
    balanced = tuple(f"floor(least(255, {c} * (want / m{c}) + 1e-6))" for c in "rgb")
    _colour("WhiteBalance", balanced, "wb", mean)
    _colour("color_correct", balanced, "wb", mean)
    _colour("SaturationAdjust", _from_hsv("h", "least(1, s * 0.5)"), "hs", _HSV, factor=0.5)
    _colour("HueShift", _from_hsv("((h + 1.5) - 6 * floor((h + 1.5) / 6))", "s"), "hs", _HSV, delta_h=90.0)


# --- moments


def _moments() -> None:
    bright = ("SimpleThreshold", {"threshold": 128})
    run = lambda t, **p: lambda s, d: find(t).plan(images.run(frames(s, d), bright), **find(t).bind(p))
    mu = lambda p, q: f"sum((x - cx) ** {p} * (y - cy) ** {q})"
    names = ("20", "11", "02", "30", "21", "12", "03")
    base = f"WITH {PX}, f AS (SELECT frame_id, y::DOUBLE AS y, x::DOUBLE AS x FROM px WHERE v > 128), c AS (SELECT frame_id, count(*)::DOUBLE AS n, avg(x) AS cx, avg(y) AS cy FROM f GROUP BY 1), m AS (SELECT f.frame_id, n, {', '.join(f'{mu(int(k[0]), int(k[1]))} AS u{k}' for k in names)} FROM f JOIN c ON c.frame_id = f.frame_id GROUP BY f.frame_id, n)"
    eta = f"e AS (SELECT frame_id, {', '.join(f'u{k} / pow(n, {1 + (int(k[0]) + int(k[1])) / 2}) AS e{k}' for k in names)} FROM m), t AS (SELECT *, e30 + e12 AS a, e21 + e03 AS b, e30 - 3 * e12 AS c, 3 * e21 - e03 AS d, e20 - e02 AS s, 2 * e11 AS t FROM e)"
    hu = "e20 + e02 AS hu1, s * s + t * t AS hu2, c * c + d * d AS hu3, a * a + b * b AS hu4, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b) AS hu5, s * (a * a - b * b) + 2 * t * a * b AS hu6, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b) AS hu7"
    add("measure_HuMoments", run("HuMoments"), f"{base}, {eta} SELECT frame_id, {hu} FROM t", " ".join(f"hu{k}" for k in range(1, 8)))
    flusser = "(u20 * u02 - u11 * u11) / pow(n, 4) AS f1, (u30 * u30 * u03 * u03 - 6 * u30 * u21 * u12 * u03 + 4 * u30 * pow(u12, 3) + 4 * pow(u21, 3) * u03 - 3 * u21 * u21 * u12 * u12) / pow(n, 10) AS f2, (u20 * (u21 * u03 - u12 * u12) - u11 * (u30 * u03 - u21 * u12) + u02 * (u30 * u12 - u21 * u21)) / pow(n, 7) AS f3"
    op = find("FlusserMoments")
    add("measure_FlusserMoments", lambda s, d: op.plan(images.run(frames(s, d), bright)).drop("f4"), f"{base} SELECT frame_id, {flusser} FROM m", "f1 f2 f3")
    axes = "SELECT frame_id, (u20 + u02) / n / 2 AS mid, sqrt(pow((u20 - u02) / n / 2, 2) + pow(u11 / n, 2)) AS half, degrees(0.5 * atan2(2 * u11 / n, (u20 - u02) / n)) AS turn FROM m"
    shown = [c for c in find("Anisometry").outputs]
    values = {"major_axis": "4 * sqrt(mid + half)", "minor_axis": "4 * sqrt(greatest(mid - half, 0))", "anisometry": "sqrt(mid + half) / sqrt(greatest(mid - half, 0))", "eccentricity": "sqrt(1 - greatest(mid - half, 0) / (mid + half))", "orientation": "turn"}
    if set(shown) <= set(values):
        add("measure_Anisometry", run("Anisometry"), f"{base}, x AS ({axes}) SELECT frame_id, {', '.join(f'{values[c]} AS {c}' for c in shown)} FROM x", " ".join(shown))


# --- codes, characters, inference


def _codes() -> None:
    names = lambda s, d: find("QRGenerate").plan(table(s, d, "nation").selectExpr("cast(n_nationkey as long) AS frame_id", "concat(n_name, ' ', n_nationkey) AS data"), size=150).drop("success")
    told = "SELECT n_nationkey::BIGINT AS frame_id, n_name || ' ' || n_nationkey AS {}, TRUE AS {} FROM nation"
    for name, data, found, params in (("QRCodeDecode", "data", "found", {}), ("BarcodeDecode", "data", "found", {}), ("QRCodeDecodeEnhanced", "data", "found", {}), ("IDReader", "barcode_data", "success", {}), ("BarcodeVerify", "decoded_data", "verified", {})):
        op = find(name)
        add(f"code_{name}", lambda s, d, op=op, data=data, found=found: op.plan(names(s, d), **op.bind({})).select("frame_id", data, found), told.format(data, found))
    made = find("QRGenerate")
    add("code_QRGenerate", lambda s, d: made.plan(table(s, d, "supplier").selectExpr("cast(s_suppkey as long) AS frame_id", "if(s_suppkey % 7 = 0, '', s_name) AS data"), size=100).select("frame_id", "width", "height", "success"), "SELECT s_suppkey::BIGINT AS frame_id, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 100 END::INT AS width, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 100 END::INT AS height, s_suppkey % 7 <> 0 AS success FROM supplier")
    plain = lambda t, **p: lambda s, d: find(t).plan(frames(s, d), **find(t).bind(p))
    steps = "CASE WHEN {0} >= {1} THEN 4.0 WHEN {0} >= {2} THEN 3.0 WHEN {0} >= {3} THEN 2.0 WHEN {0} >= {4} THEN 1.0 ELSE 0.0 END::DOUBLE"
    add("code_BarcodeGrade", lambda s, d: plain("BarcodeGrade")(s, d).select("frame_id", "symbol_contrast", "modulation", "defects"), f"WITH {PX}, l AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY frame_id ORDER BY y, x)) AS step FROM px), g AS (SELECT frame_id, max(v) - min(v) AS c, (quantile_cont(v, 0.9) - quantile_cont(v, 0.1)) / greatest(max(v) - min(v), 1) AS m, greatest(0, 1 - sum(step) / {W * H}.0 / 128) AS f FROM l GROUP BY 1) SELECT frame_id, {steps.format('c', 70, 55, 40, 20)} AS symbol_contrast, {steps.format('m', 0.85, 0.7, 0.5, 0.3)} AS modulation, {steps.format('f', 0.9, 0.75, 0.6, 0.4)} AS defects FROM g")
    add("code_BarcodeTrain", plain("BarcodeTrain"), f"WITH {PX} SELECT frame_id, 'BARCODE_TEMPLATE_QR_CODE_{W}x{H}:features=[avg_intensity=' || printf('%.6f', avg(v)) || ',width={W},height={H}]' AS template, CASE WHEN avg(v) < 50 OR avg(v) > 200 THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence, NOT (avg(v) < 50 OR avg(v) > 200) AS success FROM px GROUP BY 1")

    from ..operators.models import text_frames

    drawn = lambda e: lambda s, d: text_frames(table(s, d, "supplier").selectExpr("cast(s_suppkey as long) AS frame_id", f"{e} AS data"))
    for name, e, sql, top in (("DigitOCR", "cast(s_suppkey * 37 + 100 as string)", "(s_suppkey * 37 + 100)::VARCHAR", 100.0), ("EnglishOCR", "translate(cast(s_suppkey + 1000 as string), '0123456789', 'ABCDEFGHKL')", "translate((s_suppkey + 1000)::VARCHAR, '0123456789', 'ABCDEFGHKL')", 100.0), ("MixedOCR", "concat('SUP', s_suppkey, 'X')", "'SUP' || s_suppkey || 'X'", 100.0), ("OCR", "concat('SUP', s_suppkey)", "'SUP' || s_suppkey", 1.0)):
        op = find(name)
        add(f"ocr_{name}", lambda s, d, op=op, e=e: op.plan(drawn(e)(s, d), **op.bind({})), f"SELECT s_suppkey::BIGINT AS frame_id, {sql} AS text, {top}::DOUBLE AS confidence, length({sql}) AS n_chars FROM supplier", "confidence")
    add("ml_ONNXInference", plain("ONNXInference"), f"WITH {PX} SELECT frame_id, y::BIGINT AS position, avg(v) AS value FROM px GROUP BY 1, 2", "value")
    add("ml_Detection", plain("Detection", confidence_threshold=0.45), f"WITH {PX} SELECT * FROM (SELECT frame_id, (x // 8 * 8)::BIGINT AS x, (y // 8 * 8)::BIGINT AS y, 8::BIGINT AS width, 8::BIGINT AS height, avg(v) / 255 AS score, ((x // 8 + y // 8) % 2)::BIGINT AS class_id FROM px GROUP BY frame_id, x // 8, y // 8) WHERE score >= 0.45", "score")
    add("ml_Classification", plain("Classification"), f"WITH {PX}, z AS (SELECT frame_id, (y // {H // 2} * 2 + x // {W // 2})::BIGINT AS class_id, exp(avg(v) / 64) AS e FROM px GROUP BY 1, 2), p AS (SELECT frame_id, class_id, e / sum(e) OVER (PARTITION BY frame_id) AS confidence FROM z) SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY round(confidence, 12) DESC, class_id) AS rank, class_id, 'class_' || class_id AS class_name, confidence FROM p", "confidence")
    mask = find("Segmentation")
    add("ml_Segmentation", lambda s, d: _flat(mask.plan(frames(s, d), **mask.bind({}))), f"WITH {PX} SELECT frame_id, y, x, CASE WHEN abs(v - 32) <= abs(v - 128) THEN 0 WHEN abs(v - 128) <= abs(v - 224) THEN 1 ELSE 2 END::BIGINT AS v FROM px")


# --- cameras, contours, models in space


def _others() -> None:
    def t(type_id: str, sql: str, reals: str, *sources: tuple[str, list[str]], name: str = "", digits: int = 6, **params) -> None:
        op = find(type_id)
        add(f"tab_{name or type_id}", lambda s, d: op.plan(*[table(s, d, n).selectExpr(*e) for n, e in sources], **op.bind(params)), sql, reals, digits)

    op = find("MultiCameraAcquire")
    shots = ["event_id AS frame_id", "concat('cam', user_id % 4) AS source_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS timestamp_us"]
    at = "WITH e AS (SELECT event_id, 'cam' || (user_id % 4) AS camera, epoch_us(ts) AS t FROM events), k AS (SELECT *, floor(t / 60000000.0::DOUBLE + 0.5)::BIGINT AS trigger_id FROM e), n AS (SELECT trigger_id, camera, t, row_number() OVER (PARTITION BY trigger_id, camera ORDER BY abs(t - trigger_id * 60000000), event_id) AS r FROM k)"
    add("tab_MultiCameraAcquire", lambda s, d: op.plan(table(s, d, "events").selectExpr(*shots), **op.bind({"frame_rate": 1 / 60, "tolerance_us": 2e7})).selectExpr("trigger_id", "cast(size(camera_ids) as long) AS cameras", "spread_us", "sync_status"), f"{at} SELECT trigger_id, count(*) AS cameras, max(t) - min(t) AS spread_us, max(t) - min(t) <= 20000000 AS sync_status FROM n WHERE r = 1 GROUP BY 1")

    line = "(SELECT l_orderkey AS object_id, l_linenumber AS seq, min(l_quantity) AS x, min(l_suppkey % 40) AS y FROM lineitem GROUP BY 1, 2)"
    polygon = f"p AS (SELECT object_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {line} WINDOW w AS (PARTITION BY object_id ORDER BY seq)), s AS (SELECT object_id, count(*) AS n, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) AS perimeter, avg(x) AS center_x, avg(y) AS center_y, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p GROUP BY 1)"
    measured = "center_x, center_y, area, perimeter, CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0 END AS circularity, CASE WHEN (hx - lx) * (hy - ly) > 0 THEN area / ((hx - lx) * (hy - ly)) ELSE 0 END AS rectangularity"
    fit = find("ContourFitMeasure")
    points = lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_quantity").alias("x"), F.min(F.col("l_suppkey") % 40).cast("double").alias("y"))
    errors = {3: "(SELECT avg(least(x - lx, hx - x, y - ly, hy - y)) FROM p WHERE p.object_id = s.object_id)", 4: "0.0::DOUBLE"}
    for mode, error in errors.items():
        add(f"tab_ContourFitMeasure_{mode}", lambda s, d, mode=mode: fit.plan(points(s, d), **fit.bind({"fit_mode": mode})), f"WITH {polygon} SELECT object_id, {mode} AS fit_type, {measured}, {error} AS fit_error, TRUE AS is_valid FROM s WHERE n >= 3", "center_x center_y area perimeter circularity rectangularity fit_error")

    model = ("embeddings", ["cast(label as long) AS model_id", "vec_id AS point_id", "embedding[0] * 100D AS x", "embedding[1] * 100D AS y", "embedding[2] * 100D AS z"])
    pts = "(SELECT label::BIGINT AS model_id, vec_id AS point_id, embedding[1] * 100::DOUBLE AS x, embedding[2] * 100::DOUBLE AS y, embedding[3] * 100::DOUBLE AS z FROM embeddings)"
    turned = f"(SELECT model_id, k::INT AS view_id, point_id, cos(a) * x + sin(a) * z AS vx, y, cos(a) * z - sin(a) * x + 500 AS depth FROM {pts}, (SELECT k, k * 2 * pi() / 6 AS a FROM (SELECT unnest(range(6)) AS k)))"
    seen = f"SELECT model_id, view_id, point_id, u, v, depth FROM (SELECT *, vx / depth * 525 + 320 AS u, y / depth * 525 + 240 AS v FROM {turned} WHERE depth > 0) WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480"
    t("CreateShapeModel3D", seen, "u v depth", model, num_views=6)
    t("ShapeModel3DTrain", seen, "u v depth", model, num_views=6)
    raster = f"SELECT model_id, u, v, count(*) AS n, min(z2) AS depth FROM (SELECT model_id, z2, floor(x / z2 * 525 + 320)::BIGINT AS u, floor(y / z2 * 525 + 240)::BIGINT AS v FROM (SELECT *, z + 500 AS z2 FROM {pts}) WHERE z2 > 0) WHERE u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479 GROUP BY 1, 2, 3"
    t("ShapeModel3DProject", raster, "depth", model)
    t("ShapeModel3DVisualize", raster, "depth", model)

    two = f"WITH {PX}, {_px('pz', V2)}"
    rect = find("stereo_rectify")
    add("img_stereo_rectify", lambda s, d: _flat(rect.plan(frames(s, d), frames(s, d, V2), **rect.bind({}))), f"{two} SELECT frame_id, y, x, v::BIGINT AS v FROM px UNION ALL SELECT frame_id, y, x, v::BIGINT AS v FROM pz")
    depth = find("disparity_to_depth")
    from ..frames import to_pixels

    add("img_disparity_to_depth", lambda s, d: to_pixels(images.run(frames(s, d), ("disparity_to_depth", depth.bind({})))).select("frame_id", "y", "x", F.round("v", 1).alias("v")), f"WITH {PX} SELECT frame_id, y, x, round(CASE WHEN v > 0 THEN (108000.0::DOUBLE / v)::FLOAT ELSE 0 END::DOUBLE, 1) AS v FROM px", "v", 1)

    flaw = find("photometric_defect_detect")
    normal = lambda s, d: pixels(s, d, V1).selectExpr("frame_id", "y", "x", "sin(v / 255D) AS nx", "0D AS ny", "cos(v / 255D) AS nz", "v / 255D AS albedo")
    spots = f"""WITH RECURSIVE {PX}, a AS (SELECT frame_id, avg(v / 255.0::DOUBLE) AS m FROM px GROUP BY 1),
f AS (SELECT p.frame_id, p.y, p.x FROM px p JOIN a ON a.frame_id = p.frame_id LEFT JOIN px l ON l.frame_id = p.frame_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN px u ON u.frame_id = p.frame_id AND u.y = p.y - 1 AND u.x = p.x
      WHERE coalesce(abs(p.v - l.v) / 255.0::DOUBLE > 0.3, FALSE) OR coalesce(abs(p.v - u.v) / 255.0::DOUBLE > 0.3, FALSE) OR abs(p.v / 255.0::DOUBLE - m) > 0.45),
reach AS (SELECT frame_id, y, x, y * {W} + x AS seed FROM f UNION SELECT f.frame_id, f.y, f.x, r.seed FROM reach r JOIN f ON f.frame_id = r.frame_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1),
c AS (SELECT frame_id, y, x, min(seed) AS seed FROM reach GROUP BY 1, 2, 3), b AS (SELECT frame_id, seed, count(*) AS area, min(x)::BIGINT AS bx, min(y)::BIGINT AS by_, (max(x) - min(x) + 1)::BIGINT AS width, (max(y) - min(y) + 1)::BIGINT AS height, avg(x) AS center_x, avg(y) AS center_y FROM c GROUP BY 1, 2)
SELECT * FROM (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY seed) AS blob, area, bx AS x, by_ AS y, width, height, center_x, center_y FROM b) WHERE area >= 10"""
    add("inspect_photometric_defect_detect", lambda s, d: flaw.plan(normal(s, d), **flaw.bind({"albedo_threshold": 0.45})), spots, "center_x center_y")
    part = find("InspectComponent")
    wide = f"WITH {PX}, b AS (SELECT frame_id, y * 2 + i AS y, x * 2 + j AS x, v FROM px, (SELECT unnest([0, 1]) AS i) p, (SELECT unnest([0, 1]) AS j) q), m AS (SELECT b.frame_id, ty.k AS y, tx.k AS x, avg(b.v) / 255 AS score FROM b JOIN (SELECT unnest(range(4, 9)) AS k) ty ON b.y BETWEEN ty.k AND ty.k + 19 JOIN (SELECT unnest(range(12, 17)) AS k) tx ON b.x BETWEEN tx.k AND tx.k + 19 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) AS k FROM m WHERE score >= 0.5)"
    add("inspect_InspectComponent", lambda s, d: part.plan(images.run(frames(s, d), ("Resize", {"width": 2 * W, "height": 2 * H, "interpolation": "nearest"})), **part.bind({"expected_x": 14, "expected_y": 6, "tolerance": 2.0, "min_score": 0.5})), f"{wide} SELECT f.frame_id, (r.k IS NOT NULL)::BIGINT AS num_found, CASE WHEN r.k IS NULL THEN 'Not Found' ELSE 'Found' END AS inspection_result, r.k IS NOT NULL AS all_found, coalesce(r.x, 0)::BIGINT AS x, coalesce(r.y, 0)::BIGINT AS y, coalesce(r.score, 0) AS score FROM (SELECT DISTINCT frame_id FROM px) f LEFT JOIN r ON r.frame_id = f.frame_id AND r.k = 1", "score")


# --- sums over a frame


def _sums() -> None:
    plain = lambda t, **p: lambda s, d: find(t).plan(frames(s, d), **find(t).bind(p))
    inside = f"y BETWEEN 1 AND {H - 2} AND x BETWEEN 1 AND {W - 2}"
    lap = _near("sum(CASE WHEN dy = 0 AND dx = 0 THEN -4 WHEN abs(dy) + abs(dx) = 1 THEN 1 ELSE 0 END * q.v)", 1)
    add("measure_QualityEvaluate", plain("QualityEvaluate"), f"WITH {PX}, l AS (SELECT frame_id, var_pop(v) AS sharpness FROM ({lap}) WHERE {inside} GROUP BY 1), m AS (SELECT frame_id, stddev_pop(v) AS contrast, avg(v) AS brightness FROM px GROUP BY 1) SELECT m.frame_id, sharpness, contrast, brightness, 50 * least(sharpness / 10, 1) + 50 * least(contrast / 30, 1) AS quality_score FROM m JOIN l ON l.frame_id = m.frame_id", "sharpness contrast brightness quality_score")
    add("measure_AdaptiveParam", plain("AdaptiveParam"), f"WITH {PX}, m AS (SELECT frame_id, avg(v) AS brightness, stddev_pop(v) AS contrast FROM px GROUP BY 1) SELECT frame_id, 10000.0 * least(128 / greatest(brightness, 1), 4) AS exposure_us, greatest(128 / greatest(brightness, 1) / 4, 1) AS gain, brightness, contrast FROM m", "exposure_us gain brightness contrast")
    row = f"WITH {PX} SELECT frame_id, (x - 6)::BIGINT AS position, v::DOUBLE AS value FROM px WHERE y = 8 AND x BETWEEN 6 AND 16"
    add("measure_MeasureProfile", plain("MeasureProfile", row=8.0, col=11.0, length=10.0), row, "value")
    add("measure_MeasureThreshold", plain("MeasureThreshold", row=8.0, col=11.0, length=10.0), f"WITH {PX}, l AS (SELECT frame_id, x - 6 AS k, v, lag(v) OVER (PARTITION BY frame_id ORDER BY x) AS b FROM px WHERE y = 8 AND x BETWEEN 6 AND 16) SELECT frame_id, k - (v - 128) / (v - b)::DOUBLE AS position FROM l WHERE b IS NOT NULL AND (b < 128) <> (v < 128)", "position")
    bright = ("SimpleThreshold", {"threshold": 128})
    on = f"WITH {PX}, f AS (SELECT frame_id, y, x FROM px WHERE v > 128), e AS (SELECT f.frame_id, f.y, f.x, count(g.x) AS n FROM f LEFT JOIN f g ON g.frame_id = f.frame_id AND abs(g.y - f.y) + abs(g.x - f.x) = 1 GROUP BY 1, 2, 3)"
    add("measure_Compactness", lambda s, d: find("Compactness").plan(images.run(frames(s, d), bright)), f"{on} SELECT frame_id, sqrt(4 * count(*) / pi()) / count(*) FILTER (n < 4) AS compactness, count(*)::DOUBLE AS area, (count(*) FILTER (n < 4))::DOUBLE AS perimeter FROM e GROUP BY 1", "compactness area perimeter")


def build() -> None:
    _frequencies()
    _filters()
    _colours()
    _moments()
    _codes()
    _others()
    _sums()
