"""Queries of operators that look for pieces: a mask, its connected parts by recursion, and their measures."""

from __future__ import annotations

from ..operators import images
from ..spec import find
from .catalog import H, V2, W, _px, add, frames
from .catalog_more import _RGB, PX, coloured

GRAY = f"{PX}, o AS (SELECT frame_id, min(t) AS cut FROM (SELECT *, max(round(s, 3)) OVER (PARTITION BY frame_id) AS top FROM (SELECT frame_id, t, CASE WHEN lo = 0 OR lo = {W * H} THEN 0 ELSE lo::DOUBLE * ({W * H} - lo) * pow(ml / lo::DOUBLE - (m - ml) / ({W * H} - lo)::DOUBLE, 2) END AS s FROM (SELECT frame_id, t, sum(CASE WHEN v <= t THEN 1 ELSE 0 END) AS lo, sum(CASE WHEN v <= t THEN v ELSE 0 END) AS ml, sum(v) AS m FROM px, (SELECT unnest(range(256)) AS t) q GROUP BY 1, 2))) WHERE round(s, 3) = top GROUP BY 1)"
BRIGHT = f"{GRAY}, f AS (SELECT px.frame_id, y, x FROM px JOIN o ON o.frame_id = px.frame_id WHERE v > cut)"
BLOB = "frame_id, blob, area, x, y, width, height, center_x, center_y"


def _pieces(eight: bool = True) -> str:
    """b: all pieces of f, with their numbers and shapes; c: which sample is of which piece. Runs of a row are joined to
    those of the rows beside it; the first sample of a piece is the start of a run.
    """
    e = int(eight)
    return f"""runs AS (SELECT frame_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) AS g FROM f) GROUP BY frame_id, y, g),
reach AS (SELECT frame_id, y, x0, x1, y * {W} + x0 AS seed FROM runs UNION SELECT u.frame_id, u.y, u.x0, u.x1, r.seed FROM reach r JOIN runs u ON u.frame_id = r.frame_id AND abs(u.y - r.y) = 1 AND u.x0 <= r.x1 + {e} AND u.x1 >= r.x0 - {e}),
c AS (SELECT frame_id, y, unnest(range(x0, x1 + 1)) AS x, seed FROM (SELECT frame_id, y, x0, x1, min(seed) AS seed FROM reach GROUP BY 1, 2, 3, 4)),
b AS (SELECT *, least(1.0, 4 * area / (pi() * pow(greatest(width, height), 2))) AS roundness, area / (width * height)::DOUBLE AS fill, greatest(width, height) / least(width, height)::DOUBLE AS aspect, sqrt(width * width + height * height) AS len
      FROM (SELECT frame_id, seed, row_number() OVER (PARTITION BY frame_id ORDER BY seed) AS blob, count(*) AS area, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x) - min(x) + 1)::BIGINT AS width, (max(y) - min(y) + 1)::BIGINT AS height, avg(x) AS center_x, avg(y) AS center_y FROM c GROUP BY 1, 2))"""


def _difference(size: int, name: str = "d") -> str:
    """{name}(frame_id, y, x, v): each sample less the mean of the square around it, border repeated."""
    k = size // 2
    return f"""{name}_r AS (SELECT p.frame_id, p.y, p.x, sum(q.v) AS v FROM px p, (SELECT unnest(range({-k}, {k + 1})) AS dx) w JOIN px q ON q.frame_id = p.frame_id AND q.y = p.y AND q.x = least({W - 1}, greatest(0, p.x + dx)) GROUP BY 1, 2, 3),
{name}_m AS (SELECT p.frame_id, p.y, p.x, sum(q.v) AS v FROM px p, (SELECT unnest(range({-k}, {k + 1})) AS dy) w JOIN {name}_r q ON q.frame_id = p.frame_id AND q.x = p.x AND q.y = least({H - 1}, greatest(0, p.y + dy)) GROUP BY 1, 2, 3),
{name} AS (SELECT px.frame_id, px.y, px.x, px.v - {name}_m.v / {size * size}.0::DOUBLE AS v FROM px JOIN {name}_m ON {name}_m.frame_id = px.frame_id AND {name}_m.y = px.y AND {name}_m.x = px.x)"""


_PLACES = "center_x center_y"
_SHAPES = "center_x center_y roundness fill aspect"


def _single(type_id: str, mask: str, where: str, shown: str = BLOB, reals: str = _PLACES, eight: bool = True, **params) -> None:
    op = find(type_id)
    add(f"inspect_{type_id}", lambda s, d: op.plan(frames(s, d), **op.bind(params)), f"WITH RECURSIVE {mask}, {_pieces(eight)} SELECT {shown} FROM b WHERE {where}", reals)


def _mask(condition: str, ctes: str = "", source: str = "px") -> str:
    return f"{PX}{', ' + ctes if ctes else ''}, f AS (SELECT frame_id, y, x FROM {source} WHERE {condition})"


def _defects() -> None:
    _single("StainDetect", _mask("abs(v) > 25", _difference(31), "d"), "area BETWEEN 5 AND 5000", min_area=5)
    _single("ScratchDetect", _mask("abs(v) > 90", _difference(31), "d"), "len >= 4 AND area <= 5 * len", threshold=90, min_length=4)
    _single("CrackDetect", _mask("v < -40", _difference(31), "d"), "len >= 5", min_length=5)
    _single("PitDetect", _mask("v < -20", _difference(9), "d"), "sqrt(area / pi()) BETWEEN 1 AND 4 AND greatest(width, height) <= 2 * least(width, height)", min_radius=1, max_radius=4)
    _single("GlossDefect", _mask("v < 50 OR v > 200"), "area >= 5", min_area=5)
    both = f"{_difference(5, 'd')}, {_difference(15, 'e')}, j AS (SELECT d.frame_id, d.y, d.x, d.v AS a, e.v AS b FROM d JOIN e ON e.frame_id = d.frame_id AND e.y = d.y AND e.x = d.x)"
    _single("MicroDefectDetect", _mask("abs(a) > 20 AND abs(b) > 20", both, "j"), "area >= 3")
    _single("WaferContaminationDetection", _mask("abs(v - m) > 30", "g AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS m FROM px)", "g"), "area BETWEEN 10 AND 10000")
    both = f"{PX}, {_px('pz', V2)}, j AS (SELECT px.frame_id, px.y, px.x, px.v, pz.v AS w, avg(pz.v) OVER (PARTITION BY px.frame_id) AS mean FROM px JOIN pz ON pz.frame_id = px.frame_id AND pz.y = px.y AND pz.x = px.x)"
    shown = BLOB.replace("frame_id,", "frame_id, frame_id AS other_id,")
    pairs = {
        "ForeignObject": ("abs(v - w) > 150", "area BETWEEN 3 AND 1000", {"threshold": 150, "min_area": 3}),
        "OpacityDefect": ("abs(v - w) > 150", "area >= 3", {"threshold": 150, "min_area": 3}),
        "PatInspect": ("abs(v - w) > 150", "area BETWEEN 3 AND 10000", {"threshold": 150.0, "min_defect_area": 3.0}),
        "MissingObject": ("w > mean AND abs(v - w) > 100", "area >= 3", {"threshold": 100, "min_area": 3}),
        "ColorDefect": ("abs(v - w) > 150", "area >= 3", {"threshold": 150, "min_area": 3}),
    }
    for name, (condition, where, params) in pairs.items():
        op = find(name)
        add(f"inspect_{name}", lambda s, d, op=op, params=params: op.plan(frames(s, d), frames(s, d, V2), **op.bind(params)), f"WITH RECURSIVE {both}, f AS (SELECT frame_id, y, x FROM j WHERE {condition}), {_pieces()} SELECT {shown} FROM b WHERE {where}", _PLACES)
    cog = find("CogInspect")
    add("inspect_CogInspect", lambda s, d: cog.plan(frames(s, d), frames(s, d, V2), **cog.bind({"threshold": 150.0})), f"WITH RECURSIVE {both}, f AS (SELECT frame_id, y, x FROM j WHERE abs(v - w) > 150), {_pieces()}, n AS (SELECT frame_id, count(b.seed) AS k FROM (SELECT DISTINCT frame_id FROM px) LEFT JOIN b USING (frame_id) GROUP BY 1) SELECT frame_id, frame_id AS other_id, k AS defect_count, k = 0 AS pass_fail FROM n")
    largest = f"WITH RECURSIVE {_mask('v > 128')}, {_pieces(False)}, l AS (SELECT frame_id, arg_max(b, area * 100000 - blob) AS b FROM b GROUP BY 1)"
    size = find("DimensionDefect")
    add("inspect_DimensionDefect", lambda s, d: size.plan(frames(s, d), **size.bind({"expected_width": 12, "expected_height": 10})), f"{largest} SELECT frame_id, b.width AS width, b.height AS height, abs(b.width - 12) > 5 OR abs(b.height - 10) > 5 AS is_defect FROM l")
    place = find("PositionDefect")
    add("inspect_PositionDefect", lambda s, d: place.plan(frames(s, d), **place.bind({"expected_x": 12, "expected_y": 8, "tolerance": 4})), f"{largest} SELECT frame_id, b.center_x AS x, b.center_y AS y, sqrt(pow(b.center_x - 12, 2) + pow(b.center_y - 8, 2)) AS \"offset\", sqrt(pow(b.center_x - 12, 2) + pow(b.center_y - 8, 2)) > 4 AS is_defect FROM l", 'x y "offset"')
    turn = find("AngleDefect")
    add("inspect_AngleDefect", lambda s, d: turn.plan(frames(s, d), **turn.bind({})), f"WITH {_mask('v > 128')}, m AS (SELECT frame_id, degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) AS angle FROM f GROUP BY 1) SELECT frame_id, angle, abs((angle + 90) - 180 * floor((angle + 90) / 180) - 90) AS deviation, abs((angle + 90) - 180 * floor((angle + 90) / 180) - 90) > 5 AS is_defect FROM m", "angle deviation")
    rough = find("SurfaceRoughness")
    add("inspect_SurfaceRoughness", lambda s, d: rough.plan(frames(s, d), **rough.bind({})), f"WITH {PX}, m AS (SELECT *, avg(v) OVER (PARTITION BY frame_id) AS m FROM px) SELECT frame_id, avg(abs(v - m)) AS roughness_ra, (max(v) - min(v))::DOUBLE AS roughness_rz, avg(abs(v - m)) <= 10 AS is_smooth FROM m GROUP BY 1", "roughness_ra")
    bright = ("SimpleThreshold", {"threshold": 128})
    for name, eight, shown, params in (("CogBlobAnalysis", True, BLOB, {"min_area": 4.0}), ("BlobDetect", False, BLOB, {"min_area": 4}), ("CudaBlobAnalysis", False, BLOB, {"min_area": 4})):
        op = find(name)
        add(f"measure_{name}", lambda s, d, op=op, params=params: op.plan(images.run(frames(s, d), bright), **op.bind(params)), f"WITH RECURSIVE {_mask('v > 128')}, {_pieces(eight)} SELECT {shown} FROM b WHERE area >= 4", _PLACES)


_SHAPE = BLOB + ", roundness, fill, aspect"
_KIND = "CASE WHEN aspect >= 3 OR fill < 0.3 THEN CASE WHEN dark THEN 'crack' ELSE 'scratch' END WHEN roundness >= 0.6 THEN 'particle' ELSE 'contamination' END AS kind"


def _products() -> None:
    _single("PCBComponent", BRIGHT, "area >= 4 AND fill >= 0.5", _SHAPE + ", CASE WHEN fill >= 0.7 AND fill < 0.9 AND aspect < 1.2 THEN 'capacitor' WHEN aspect >= 2 THEN 'resistor' ELSE 'chip' END AS kind, fill AS confidence", _SHAPES + " confidence")
    _single("PCBPad", BRIGHT, "area >= 4", _SHAPE + ", fill AS coverage, roundness < 0.7 OR fill < 0.6 AS is_defect", _SHAPES + " coverage")
    _single("PillDetect", BRIGHT, "area >= 4 AND roundness >= 0.3", _SHAPE, _SHAPES, min_size=4, min_roundness=0.3)
    _single("CapsuleInspect", BRIGHT, "area >= 20", _SHAPE + ", fill >= 0.8 AS is_good", _SHAPES)
    _single("WaferCrackDetection", _mask("v < -24", _difference(31), "d"), "len >= 4 AND (aspect >= 3 OR fill < 0.4)", _SHAPE + ", len AS length", _SHAPES + " length", min_length=4)
    dark = "t AS (SELECT b.*, (SELECT avg(d.v) < 0 FROM d WHERE d.frame_id = b.frame_id AND d.x BETWEEN b.x AND b.x + b.width - 1 AND d.y BETWEEN b.y AND b.y + b.height - 1) AS dark FROM b)"
    for name, least, kind in (("PillDefect", 3, False), ("FoodContaminate", 5, False), ("FabricDefect", 5, False), ("PCBDefect", 3, True), ("WaferDefect", 5, True), ("WaferDefectClassification", 5, True)):
        op = find(name)
        most = "500" if name == "WaferDefectClassification" else "1e12"
        add(f"inspect_{name}", lambda s, d, op=op: op.plan(frames(s, d), **op.bind({})), f"WITH RECURSIVE {_mask('abs(v) > 30', _difference(31), 'd')}, {_pieces()}, {dark} SELECT {_SHAPE}, dark{', ' + _KIND if kind else ''} FROM t WHERE area BETWEEN {least} AND {most}", _SHAPES)
    plain = lambda t, **p: lambda s, d: find(t).plan(frames(s, d), **find(t).bind(p))
    every = "(SELECT DISTINCT frame_id FROM px) a"
    add("inspect_AssemblyCheck", plain("AssemblyCheck"), f"WITH RECURSIVE {BRIGHT}, {_pieces()}, p AS (SELECT *, median(width) OVER w AS mw, median(height) OVER w AS mh FROM b WHERE area >= 4 WINDOW w AS (PARTITION BY frame_id)), n AS (SELECT frame_id, count(*) AS n, count(*) FILTER (abs(width - mw) <= 5 AND abs(height - mh) <= 5) AS good FROM p GROUP BY 1) SELECT a.frame_id, coalesce(good / n::DOUBLE, 0) AS overall_score, coalesce(good, 0) AS pass_count, coalesce(n - good, 0) AS fail_count, coalesce(good = n, FALSE) AS is_complete FROM {every} LEFT JOIN n USING (frame_id)", "overall_score")
    add("inspect_BlisterPack", plain("BlisterPack"), f"WITH RECURSIVE {BRIGHT}, {_pieces()}, p AS (SELECT *, median(area) OVER (PARTITION BY frame_id) / 2 AS half FROM b WHERE area >= 4), n AS (SELECT frame_id, count(*) AS n, count(*) FILTER (area >= half) AS good FROM p GROUP BY 1) SELECT a.frame_id, 10::BIGINT AS total, coalesce(good, 0) AS filled, greatest(0, 10 - coalesce(n, 0)) AS empty, coalesce(n - good, 0) AS defective, least(1.0, coalesce(good, 0) / 10.0) AS integrity FROM {every} LEFT JOIN n USING (frame_id)", "integrity")
    middle = f"WITH {BRIGHT}, m AS (SELECT frame_id, avg(x) - {(W - 1) / 2} AS ox, avg(y) - {(H - 1) / 2} AS oy, degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) AS turn FROM f GROUP BY 1)"
    add("inspect_DieAlignment", plain("DieAlignment", tolerance_x=1.0, tolerance_y=1.0), f"{middle} SELECT frame_id, ox AS offset_x, oy AS offset_y, turn AS rotation, abs(ox) <= 1 AND abs(oy) <= 1 AS is_aligned FROM m", "offset_x offset_y rotation")
    add("inspect_MeatQuality", plain("MeatQuality"), f"WITH {PX}, s AS (SELECT frame_id, avg(v) / 255 AS c, greatest(0, 1 - stddev_pop(v) / avg(v)) AS e FROM px GROUP BY 1) SELECT frame_id, c AS color_score, e AS texture_score, CASE WHEN (c + e) / 2 >= 0.6 THEN 1 WHEN (c + e) / 2 >= 0.3 THEN 2 ELSE 3 END::BIGINT AS quality_grade FROM s", "color_score texture_score")
    line = lambda a: f"{a}s AS (SELECT frame_id, count(*) FILTER (high AND NOT before) AS n FROM (SELECT *, coalesce(lag(high) OVER (PARTITION BY frame_id ORDER BY {a}), FALSE) AS before FROM (SELECT *, m > (min(m) OVER w + max(m) OVER w) / 2 AS high FROM (SELECT frame_id, {a}, avg(v) AS m FROM px GROUP BY 1, 2) WINDOW w AS (PARTITION BY frame_id))) GROUP BY 1)"
    add("inspect_FabricDensity", plain("FabricDensity", expected_warp=3, expected_weft=2), f"WITH {PX}, {line('x')}, {line('y')} SELECT xs.frame_id, xs.n AS warp_density, ys.n AS weft_density, abs(xs.n - 3) <= 0.3 AND abs(ys.n - 2) <= 0.2 AS is_uniform FROM xs JOIN ys USING (frame_id)")
    add("inspect_WaferDieDetection", plain("WaferDieDetection", die_width=6, die_height=4, margin_x=0, margin_y=0), f"WITH {PX}, c AS (SELECT frame_id, (y // 4)::BIGINT AS row, (x // 6)::BIGINT AS col, avg(v) AS mean, stddev_pop(v) AS std_dev FROM px GROUP BY 1, 2, 3) SELECT frame_id, row, col, col * 6 AS x, row * 4 AS y, mean, std_dev, abs(mean - median(mean) OVER (PARTITION BY frame_id)) <= 30 AS is_good FROM c", "mean std_dev")
    street = lambda name, a: f"SELECT frame_id, '{name}' AS direction, (min({a}) + max({a})) / 2.0::DOUBLE AS position, count(*)::DOUBLE AS width FROM (SELECT *, {a} - row_number() OVER (PARTITION BY frame_id ORDER BY {a}) AS g FROM (SELECT frame_id, {a}, avg(v) AS m, any_value(mean) AS mean FROM w GROUP BY 1, 2) WHERE m < mean - 5) GROUP BY frame_id, g"
    add("inspect_WaferDicingInspection", plain("WaferDicingInspection", expected_width=3, width_tolerance=1, min_contrast=5.0), f"WITH {PX}, w AS (SELECT *, avg(v) OVER (PARTITION BY frame_id) AS mean FROM px) SELECT *, abs(width - 3) > 1 AS is_defect FROM ({street('horizontal', 'y')} UNION ALL {street('vertical', 'x')})", "position width")
    steps = f"r AS (SELECT frame_id, y, avg(v) AS m FROM px GROUP BY 1, 2), s AS (SELECT frame_id, y, abs(m - lag(m) OVER (PARTITION BY frame_id ORDER BY y)) AS s FROM r), t AS (SELECT frame_id, 1 - arg_max(y, round(s, 6) - y / 1e9) / {H}.0::DOUBLE AS level FROM s WHERE s IS NOT NULL GROUP BY 1)"
    add("inspect_BottleInspect", plain("BottleInspect"), f"WITH {PX}, {steps}, q AS (SELECT frame_id, stddev_pop(v) FILTER (y BETWEEN {H // 3} AND {2 * H // 3}) > 20 AS label_present, avg(v) FILTER (y < {max(1, H // 10)}) > quantile_cont(v, 0.25) AS is_sealed FROM px GROUP BY 1) SELECT q.frame_id, level AS liquid_level, label_present, is_sealed FROM q JOIN t USING (frame_id)", "liquid_level")
    score = find("WaferPatternInspection")
    add("match_WaferPatternInspection", lambda s, d: score.plan(frames(s, d), frames(s, d, V2), **score.bind({"min_contrast": 150.0})).select("frame_id", "match_score", "defect_count", "is_match"), f"WITH RECURSIVE {PX}, {_px('pz', V2)}, j AS (SELECT px.frame_id, px.y, px.x, px.v, pz.v AS w FROM px JOIN pz ON pz.frame_id = px.frame_id AND pz.y = px.y AND pz.x = px.x), f AS (SELECT frame_id, y, x FROM j WHERE abs(v - w) > 150), {_pieces()}, r AS (SELECT frame_id, corr(v, w) AS match_score FROM j GROUP BY 1) SELECT r.frame_id, match_score, count(b.seed) AS defect_count, match_score >= 0.85 AS is_match FROM r LEFT JOIN b USING (frame_id) GROUP BY ALL", "match_score")
    match = find("color_match")
    add("inspect_color_match", lambda s, d: match.plan(coloured(s, d), **match.bind({"reference_color": "120,60,200", "tolerance": 90.0, "min_area": 3.0})), f"WITH RECURSIVE {_RGB}, f AS (SELECT frame_id, y, x FROM rgb WHERE sqrt(pow(r - 120, 2) + pow(g - 60, 2) + pow(b - 200, 2)) <= 90), {_pieces()} SELECT {BLOB} FROM b WHERE area >= 3", _PLACES)


def build() -> None:
    _defects()
    _products()
