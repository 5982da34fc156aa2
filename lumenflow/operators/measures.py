"""Operators from an image to numbers, and fits over tables of points or measured values."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import measure_images
from ..spec import Operator, register
from .images import correlate, element, extreme, gradient, gray, laplacian, otsu, windows


def measure_op(type_id: str, fields: str, **params):
    """Register step(image, **params) -> dict, or a list of dicts for a row per item."""

    def add(step):
        names = tuple(f.split()[0] for f in fields.split(", "))
        register(Operator(type_id, "measure", params, ("image",), names, lambda image, **p: measure_images(image, partial(step, **p), fields)))
        return step

    return add


def table_op(type_id: str, inputs: str, outputs: str, *aliases: str, **params):
    """Register plan(*inputs, **params) over DataFrames."""

    def add(plan):
        register(Operator(type_id, "table", params, tuple(inputs.split()), tuple(outputs.split()), plan), *aliases)
        return plan

    return add


# --- moments and shape


def moments(on: np.ndarray) -> dict[str, float]:
    y, x = np.nonzero(on)
    n = float(len(x))
    if not n:
        return dict.fromkeys(("area", "centroid_x", "centroid_y", "m20", "m02", "m11", "mu20", "mu02", "mu11", "mu30", "mu03", "mu21", "mu12"), 0.0)
    cx, cy = x.mean(), y.mean()
    mu = {f"mu{p}{q}": float((((x - cx) ** p) * ((y - cy) ** q)).sum()) for p, q in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))}
    return {"area": n, "centroid_x": float(cx), "centroid_y": float(cy), "m20": float((x * x).sum()), "m02": float((y * y).sum()), "m11": float((x * y).sum())} | mu


def foreground(image: np.ndarray) -> np.ndarray:
    return gray(image) > 0


@measure_op("ShapeMoments", "area double, centroid_x double, centroid_y double, m20 double, m02 double, m11 double, mu20 double, mu02 double, mu11 double")
def shape_moments(image):
    return moments(foreground(image))


@measure_op("HuMoments", ", ".join(f"hu{k} double" for k in range(1, 8)))
def hu(image):
    m = moments(foreground(image))
    if not m["area"]:
        return {f"hu{k}": 0.0 for k in range(1, 8)}
    e = {k[2:]: v / m["area"] ** (1 + (int(k[2]) + int(k[3])) / 2) for k, v in m.items() if k[:2] == "mu"}
    a, b = e["30"] + e["12"], e["21"] + e["03"]
    c, d = e["30"] - 3 * e["12"], 3 * e["21"] - e["03"]
    s, t = e["20"] - e["02"], 2 * e["11"]
    values = [e["20"] + e["02"], s * s + t * t, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), s * (a * a - b * b) + 2 * t * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)]
    return {f"hu{k}": float(v) for k, v in enumerate(values, 1)}


@measure_op("FlusserMoments", ", ".join(f"f{k} double" for k in range(1, 5)))
def flusser(image):
    """The four affine invariants of second and third central moments."""
    m = moments(foreground(image))
    n = m["area"]
    if not n:
        return {f"f{k}": 0.0 for k in range(1, 5)}
    a, b, c, d, e, f, g = (m["mu" + k] for k in ("20", "11", "02", "30", "21", "12", "03"))
    return {
        "f1": (a * c - b * b) / n**4,
        "f2": (d * d * g * g - 6 * d * e * f * g + 4 * d * f**3 + 4 * e**3 * g - 3 * e * e * f * f) / n**10,
        "f3": (a * (e * g - f * f) - b * (d * g - e * f) + c * (d * f - e * e)) / n**7,
        "f4": (a**3 * g * g - 6 * a * a * b * f * g - 6 * a * a * c * e * g + 9 * a * a * c * f * f + 12 * a * b * b * e * g + 6 * a * b * c * d * g - 18 * a * b * c * e * f - 8 * b**3 * d * g - 6 * a * c * c * d * f + 9 * a * c * c * e * e + 12 * b * b * c * d * f - 6 * b * c * c * d * e + c**3 * d * d) / n**11,
    }


def axes(on: np.ndarray) -> dict[str, float]:
    """Of the ellipse with the same second moments."""
    m = moments(on)
    n = max(m["area"], 1.0)
    a, b, c = m["mu20"] / n, m["mu11"] / n, m["mu02"] / n
    mid, half = (a + c) / 2, np.hypot((a - c) / 2, b)
    major, minor = 2 * np.sqrt(mid + half), 2 * np.sqrt(max(mid - half, 0))
    return {"major_axis": float(2 * major), "minor_axis": float(2 * minor), "anisometry": float(major / minor) if minor else 0.0, "eccentricity": float(np.sqrt(1 - (minor / major) ** 2)) if major else 0.0, "orientation": float(np.degrees(0.5 * np.arctan2(2 * b, a - c)))}


def edge_length(on: np.ndarray) -> float:
    """Foreground samples with a neighbour in the background, over four sides."""
    plane = np.where(on, 255, 0).astype(np.uint8)[:, :, None]
    inner = extreme(np.pad(plane, ((1, 1), (1, 1), (0, 0))), element("Cross", 3), True)[1:-1, 1:-1, 0] > 0
    return float((on & ~inner).sum())


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in order around it."""
    points = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(points) < 3:
        return np.array(points)

    def chain(items):
        out: list[tuple] = []
        for p in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def polygon(points: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of a closed polygon."""
    if len(points) < 2:
        return 0.0, 0.0
    after = np.roll(points, -1, axis=0)
    return abs(float((points[:, 0] * after[:, 1] - after[:, 0] * points[:, 1]).sum())) / 2, float(np.hypot(*(after - points).T).sum())


@measure_op("Compactness", "compactness double, area double, perimeter double")
def compactness(image):
    on = foreground(image)
    area, around = float(on.sum()), edge_length(on)
    return {"compactness": float(np.sqrt(4 * area / np.pi) / around) if around else 0.0, "area": area, "perimeter": around}


@measure_op("Convexity", "convexity double, area double, hull_area double, hull_perimeter double")
def convexity(image):
    on = foreground(image)
    y, x = np.nonzero(on)
    corners = np.concatenate([np.stack((x + dx, y + dy), 1) for dx in (0, 1) for dy in (0, 1)]) if len(x) else np.zeros((0, 2))
    area, around = polygon(hull(corners))
    return {"convexity": float(on.sum() / area) if area else 0.0, "area": float(on.sum()), "hull_area": area, "hull_perimeter": around}


@measure_op("Anisometry", "anisometry double, major_axis double, minor_axis double, orientation double, eccentricity double")
def anisometry(image):
    return axes(foreground(image))


@measure_op("ShapeFeatures", "area double, perimeter double, circularity double, rectangularity double, convexity double, compactness double, anisometry double, eccentricity double, orientation double, major_axis double, minor_axis double, width double, height double")
def shape_features(image):
    on = foreground(image)
    y, x = np.nonzero(on)
    w, h = (float(np.ptp(x) + 1), float(np.ptp(y) + 1)) if len(x) else (0.0, 0.0)
    c = compactness(image)
    return c | convexity(image) | axes(on) | {"area": c["area"], "circularity": 4 * np.pi * c["area"] / c["perimeter"] ** 2 if c["perimeter"] else 0.0, "rectangularity": c["area"] / (w * h) if w else 0.0, "width": w, "height": h}


# --- connected components


def label(on: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Labels from 1, in order of each component's first sample. Runs of a row are joined with the row above by union-find."""
    h, w = on.shape
    edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    _, stops = np.nonzero(edge == -1)
    parent = np.arange(len(rows))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first, slack = np.searchsorted(rows, np.arange(h + 1)), int(eight)
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < stops[j] + slack and starts[j] < stops[i] + slack:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(k) for k in range(len(rows))], np.int64)
    names, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for r, a, b, n in zip(rows, starts, stops, number, strict=True):
        out[r, a:b] = n + 1
    return out, len(names)


def blobs(on: np.ndarray, min_area: float, max_area: float, eight: bool = False) -> list[dict]:
    labels, n = label(on, eight)
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    area = np.bincount(k, minlength=n)
    low_x, low_y, high_x, high_y = np.full(n, 1 << 30), np.full(n, 1 << 30), np.zeros(n, int), np.zeros(n, int)
    for f, a, v in ((np.minimum, low_x, x), (np.minimum, low_y, y), (np.maximum, high_x, x), (np.maximum, high_y, y)):
        f.at(a, k, v)
    cx, cy = np.bincount(k, x, n) / np.maximum(area, 1), np.bincount(k, y, n) / np.maximum(area, 1)
    return [{"blob": i + 1, "area": int(area[i]), "x": int(low_x[i]), "y": int(low_y[i]), "width": int(high_x[i] - low_x[i] + 1), "height": int(high_y[i] - low_y[i] + 1), "center_x": float(cx[i]), "center_y": float(cy[i])} for i in range(n) if min_area <= area[i] <= max_area]


BLOB = "blob long, area long, x long, y long, width long, height long, center_x double, center_y double"
for _name, _params in {"BlobAnalysis": {"min_area": 10, "max_area": 100000, "draw_boxes": True}, "BlobDetect": {"min_area": 10, "max_area": 100000, "draw_keypoints": True}}.items():
    measure_op(_name, BLOB, **_params)(lambda image, min_area, max_area, **_: blobs(foreground(image), min_area, max_area))


@measure_op("CogBlobAnalysis", BLOB, min_area=10.0, max_area=100000.0, min_circularity=0.0, max_circularity=1.0, connectivity=8)
def cog_blobs(image, min_area, max_area, min_circularity, max_circularity, connectivity):
    """Circularity is the blob's share of the disc over its longer side, at most 1."""
    found = blobs(foreground(image), min_area, max_area, connectivity == 8)
    round_ = lambda b: min(1.0, 4 * b["area"] / (np.pi * max(b["width"], b["height"]) ** 2))
    return [b for b in found if min_circularity <= round_(b) <= max_circularity]


# --- histograms and quality


@measure_op("CogHistogram", "mean double, std_dev double, min_value double, max_value double, median double, entropy double", region_x=0.0, region_y=0.0, region_w=0.0, region_h=0.0, bin_count=256, channel=0)
def histogram(image, region_x, region_y, region_w, region_h, bin_count, channel):
    part = image[int(region_y) : int(region_y + region_h) if region_h else None, int(region_x) : int(region_x + region_w) if region_w else None, int(channel)]
    n = np.bincount(part.ravel(), minlength=256)
    p = n[n > 0] / max(n.sum(), 1)
    middle = int(np.searchsorted(n.cumsum(), n.sum() / 2))
    return {"mean": float(part.mean()), "std_dev": float(part.std()), "min_value": float(part.min()), "max_value": float(part.max()), "median": float(middle), "entropy": float(-(p * np.log2(p)).sum() + 0.0)}


@measure_op("OtsuThreshold", "threshold long")
def otsu_threshold(image):
    return {"threshold": otsu(gray(image))}


@measure_op("color_histogram", "channel long, bin long, n long", bins=256.0, compute_stats=True)
def color_histogram(image, bins, compute_stats):
    width = 256 / max(int(bins), 1)
    out = []
    for c in range(min(image.shape[2], 3)):
        n = np.bincount((image[:, :, c].ravel() / width).astype(int))
        out += [{"channel": c, "bin": int(k), "n": int(n[k])} for k in np.flatnonzero(n)]
    return out


@measure_op("QualityEvaluate", "sharpness double, contrast double, brightness double, quality_score double", sharpness_threshold=10.0, contrast_threshold=30.0)
def quality(image, sharpness_threshold, contrast_threshold):
    v = gray(image).astype(np.float64)
    sharp, spread = float(laplacian(v[:, :, None])[1:-1, 1:-1].var()) if min(v.shape) > 2 else 0.0, float(v.std())
    return {"sharpness": sharp, "contrast": spread, "brightness": float(v.mean()), "quality_score": 50 * min(sharp / sharpness_threshold, 1) + 50 * min(spread / contrast_threshold, 1)}


@measure_op("AdaptiveParam", "exposure_us double, gain double, brightness double, contrast double", target_brightness=128.0, enable_adaptive=True)
def adaptive_param(image, target_brightness, enable_adaptive):
    v = gray(image).astype(np.float64)
    factor = target_brightness / max(v.mean(), 1.0) if enable_adaptive else 1.0
    return {"exposure_us": 10000.0 * min(factor, 4.0), "gain": max(factor / 4.0, 1.0), "brightness": float(v.mean()), "contrast": float(v.std())}


@measure_op("light_direction_estimate", "x double, y double, z double", known_albedo=0.5)
def light_direction(image, known_albedo):
    gx, gy = gradient(gray(image))
    d = np.array([gx.mean(), gy.mean(), max(gray(image).mean() / 255 / known_albedo, 1e-9)])
    d /= np.linalg.norm(d)
    return {"x": float(d[0]), "y": float(d[1]), "z": float(d[2])}


# --- corners


def _peaks(response: np.ndarray, threshold: float, most: int) -> list[dict]:
    """Local maxima over 3 x 3 above a threshold: strongest first, then by place."""
    top = windows(response[:, :, None], 1).max((-1, -2))[:, :, 0]
    y, x = np.nonzero((response >= top) & (response > threshold))
    order = np.lexsort((x, y, -response[y, x]))[: int(most)]
    return [{"x": int(x[k]), "y": int(y[k]), "response": float(response[y[k], x[k]])} for k in order]


CORNER = "x long, y long, response double"


@measure_op("HarrisCorner", CORNER, threshold=50, k=0.04, block_size=3, max_corners=100, draw_corners=True)
def harris(image, threshold, k, block_size, max_corners, draw_corners):
    gx, gy = gradient(gray(image))
    box = np.ones((int(block_size) | 1, int(block_size) | 1))
    a, b, c = (correlate(v[:, :, None], box)[:, :, 0] for v in (gx * gx, gx * gy, gy * gy))
    return _peaks(a * c - b * b - k * (a + c) ** 2, threshold, max_corners)


@measure_op("MoravecCorner", CORNER, threshold=10000, window_size=3, max_corners=100, draw_corners=True)
def moravec(image, threshold, window_size, max_corners, draw_corners):
    v = gray(image).astype(np.float64)
    wide, box = np.pad(v, 1, mode="edge"), np.ones((int(window_size) | 1, int(window_size) | 1))
    shifts = [(v - wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx]) ** 2 for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    return _peaks(np.min([correlate(s[:, :, None], box)[:, :, 0] for s in shifts], axis=0), threshold, max_corners)


# --- profiles


def profile(plane: np.ndarray, x1: float, y1: float, x2: float, y2: float, width: int = 1) -> np.ndarray:
    """Samples one apart along a segment, averaged over `width` lines beside it."""
    n = max(int(np.hypot(x2 - x1, y2 - y1)), 1)
    t = np.arange(n + 1) / n
    nx, ny = -(y2 - y1) / max(np.hypot(x2 - x1, y2 - y1), 1e-9), (x2 - x1) / max(np.hypot(x2 - x1, y2 - y1), 1e-9)
    side = np.arange(int(width)) - (int(width) - 1) / 2
    x = np.clip(np.floor(x1 + (x2 - x1) * t[:, None] + nx * side + 0.5), 0, plane.shape[1] - 1).astype(int)
    y = np.clip(np.floor(y1 + (y2 - y1) * t[:, None] + ny * side + 0.5), 0, plane.shape[0] - 1).astype(int)
    return plane[y, x].astype(np.float64).mean(1)


def edges_on(p: np.ndarray, threshold: float, polarity: int) -> list[tuple[float, float]]:
    """(position, strength) of steps over the threshold; polarity 1 rising, 2 falling, 0 both. The place is refined by a parabola."""
    d = np.diff(p)
    m = abs(d)
    out = []
    for k in range(len(d)):
        if m[k] <= threshold or polarity == 1 and d[k] < 0 or polarity == 2 and d[k] > 0:
            continue
        if (k and m[k - 1] > m[k]) or (k + 1 < len(m) and m[k + 1] >= m[k]):
            continue
        low, high = (m[k - 1] if k else 0.0), (m[k + 1] if k + 1 < len(m) else 0.0)
        bend = low - 2 * m[k] + high
        out.append((k + 0.5 + (0.5 * (low - high) / bend if bend else 0.0), float(d[k])))
    return out


def _caliper(image, start_x, start_y, end_x, end_y, width, threshold, polarity):
    found = edges_on(profile(gray(image), start_x, start_y, end_x, end_y, width), threshold, int(polarity))
    n = max(np.hypot(end_x - start_x, end_y - start_y), 1e-9)
    at = lambda s: (start_x + (end_x - start_x) * s / n, start_y + (end_y - start_y) * s / n)
    x, y = at(found[0][0]) if found else (0.0, 0.0)
    return {"edge_count": len(found), "first_edge_x": float(x), "first_edge_y": float(y), "distance": float(found[-1][0] - found[0][0]) if len(found) > 1 else 0.0}


for _name in ("CaliperTool", "CogCaliper"):
    measure_op(_name, "edge_count long, first_edge_x double, first_edge_y double, distance double", start_x=0.0, start_y=0.0, end_x=100.0, end_y=100.0, width=5, threshold=20.0, polarity=0)(_caliper)


def _along(image, row, col, angle, length):
    dx, dy = np.cos(np.radians(angle)) * length / 2, -np.sin(np.radians(angle)) * length / 2
    return profile(gray(image), col - dx, row - dy, col + dx, row + dy)


@measure_op("MeasureProfile", "position long, value double", row=100.0, col=100.0, angle=0.0, length=50.0)
def measure_profile(image, row, col, angle, length):
    return [{"position": k, "value": float(v)} for k, v in enumerate(_along(image, row, col, angle, length))]


@measure_op("MeasureThreshold", "position double", row=100.0, col=100.0, angle=0.0, length=50.0, threshold=128.0)
def measure_threshold(image, row, col, angle, length, threshold):
    p = _along(image, row, col, angle, length)
    return [{"position": float(k - (p[k] - threshold) / (p[k] - p[k - 1]))} for k in range(1, len(p)) if (p[k - 1] < threshold) != (p[k] < threshold)]


@measure_op("MeasurePos", "position double, amplitude double", row=100.0, col=100.0, angle=0.0, length=50.0, threshold=30.0, sigma=1.0, transition="all", select="all")
def measure_pos(image, row, col, angle, length, threshold, sigma, transition, select):
    found = edges_on(_along(image, row, col, angle, length), threshold, {"positive": 1, "negative": 2}.get(transition, 0))
    found = found[:1] if select == "first" else found[-1:] if select == "last" else found
    return [{"position": p, "amplitude": a} for p, a in found]


# --- template matching


@measure_op("TemplateScore", "x long, y long, score double", template_x=0, template_y=0, template_w=8, template_h=8)
def template_score(image, template_x, template_y, template_w, template_h):
    """The best normalised correlation with a patch of the frame itself; first of equals by row, then column."""
    v = gray(image).astype(np.float64)
    t = v[template_y : template_y + template_h, template_x : template_x + template_w]
    near = np.lib.stride_tricks.sliding_window_view(v, t.shape)
    zero = near - near.mean((-1, -2), keepdims=True)
    t = t - t.mean()
    base = np.sqrt((zero**2).sum((-1, -2)) * (t**2).sum())
    score = np.where(base > 0, (zero * t).sum((-1, -2)) / np.where(base > 0, base, 1), 0)
    y, x = np.unravel_index(int(np.round(score, 9).argmax()), score.shape)
    return {"x": int(x), "y": int(y), "score": float(score[y, x])}


# --- tables of points: one aggregation each, no order within a group needed unless stated


def _line(n, sx, sy, sxx, sxy, syy) -> dict[str, Column]:
    """Total least squares: the line a x + b y + c = 0 of unit normal through the mean, across the main axis."""
    u, v, w = sxx / n - sx * sx / n / n, sxy / n - sx * sy / n / n, syy / n - sy * sy / n / n
    t = F.atan2(v * 2, u - w) / 2
    a, b = -F.sin(t), F.cos(t)
    return {"line_a": a, "line_b": b, "line_c": -(a * sx + b * sy) / n, "rms_error": F.sqrt(F.greatest((u + w) / 2 - F.sqrt(((u - w) / 2) ** 2 + v * v), F.lit(0.0)))}


def _point_sums(points: DataFrame, key: str, extra: dict[str, Column] | None = None) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y} | (extra or {})
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(key).agg(*[F.sum(v).alias(k) for k, v in terms.items()])


@table_op("LineFit", "points", "line_a line_b line_c point_count rms_error", "LineFitMeasure", key="object_id")
def line_fit(points, key):
    s = _point_sums(points, key)
    out = _line(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    return s.select(key, *[v.alias(k) for k, v in out.items()], F.col("n").cast("long").alias("point_count"))


@table_op("CircleFit", "points", "center_x center_y radius fit_error is_valid", "CircleFitMeasure", key="object_id")
def circle_fit(points, key):
    """Least squares of x^2 + y^2 + d x + e y + f, about the mean for good numbers: sums only."""
    mean = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    near = points.join(mean, key).select(key, "mx", "my", u.alias("u"), v.alias("v"), (u * u + v * v).alias("q"))
    s = near.groupBy(key, "mx", "my").agg(F.count("q").alias("n"), *[F.avg(e).alias(k) for k, e in {"uu": F.col("u") ** 2, "uv": F.col("u") * F.col("v"), "vv": F.col("v") ** 2, "uq": F.col("u") * F.col("q"), "vq": F.col("v") * F.col("q"), "q": F.col("q"), "qq": F.col("q") ** 2}.items()])
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    ok = (F.col("n") >= 3) & (F.abs(det) > 1e-12)
    a = F.when(ok, (F.col("uq") * F.col("vv") - F.col("vq") * F.col("uv")) / (det * 2)).otherwise(0.0)
    b = F.when(ok, (F.col("vq") * F.col("uu") - F.col("uq") * F.col("uv")) / (det * 2)).otherwise(0.0)
    s = s.select("*", a.alias("a"), b.alias("b"), ok.alias("is_valid"))
    r2 = F.col("a") ** 2 + F.col("b") ** 2 + F.col("q")
    # The mean square of u^2 + v^2 - 2 a u - 2 b v - q, over 4 r^2: to first order that of the radial error.
    spread = F.col("qq") - F.col("q") ** 2 - (F.col("a") * F.col("uq") + F.col("b") * F.col("vq")) * 2
    return s.select(key, (F.col("mx") + F.col("a")).alias("center_x"), (F.col("my") + F.col("b")).alias("center_y"), F.when(F.col("is_valid"), F.sqrt(r2)).otherwise(0.0).alias("radius"), F.when(F.col("is_valid"), F.sqrt(F.greatest(spread, F.lit(0.0)) / (r2 * 4))).otherwise(0.0).alias("fit_error"), "is_valid")


@table_op("EllipseMeasure", "points", "center_x center_y major_axis minor_axis angle_deg area ellipticity", key="object_id")
def ellipse_measure(points, key):
    s = _point_sums(points, key)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    u, v, w = F.col("sxx") / n - sx * sx / n / n, F.col("sxy") / n - sx * sy / n / n, F.col("syy") / n - sy * sy / n / n
    half = F.sqrt(((u - w) / 2) ** 2 + v * v)
    big, small = F.sqrt((u + w) / 2 + half) * 2, F.sqrt(F.greatest((u + w) / 2 - half, F.lit(0.0))) * 2
    return s.select(key, (sx / n).alias("center_x"), (sy / n).alias("center_y"), big.alias("major_axis"), small.alias("minor_axis"), F.degrees(F.atan2(v * 2, u - w) / 2).alias("angle_deg"), (big * small * F.pi()).alias("area"), F.when(big > 0, small / big).otherwise(0.0).alias("ellipticity"))


@table_op("PolygonMeasure", "points", "vertex_count area perimeter center_x center_y bounding_width bounding_height circularity rectangularity", key="object_id", order="seq")
def polygon_measure(points, key, order):
    """Vertices in order of `seq`; the last joins the first."""
    w = Window.partitionBy(key)
    step = w.orderBy(order)
    after = lambda c: F.coalesce(F.lead(c).over(step), F.first(c).over(step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = points.select(key, "x", "y", after("x").alias("nx"), after("y").alias("ny"))
    s = p.groupBy(key).agg(F.count("*").alias("vertex_count"), (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"), F.sum(F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2)).alias("perimeter"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y"), (F.max("x") - F.min("x")).alias("bounding_width"), (F.max("y") - F.min("y")).alias("bounding_height"))
    box = F.col("bounding_width") * F.col("bounding_height")
    return s.select("*", F.when(F.col("perimeter") > 0, F.col("area") * 4 * F.pi() / F.col("perimeter") ** 2).otherwise(0.0).alias("circularity"), F.when(box > 0, F.col("area") / box).otherwise(0.0).alias("rectangularity"))


def _part(type_id: str, **columns: str) -> None:
    """Register what one measure of a polygon gives, as expressions over the polygon's measures."""

    def plan(points, key, order):
        return polygon_measure(points, key, order).select(key, *[F.expr(e).alias(k) for k, e in columns.items()])

    table_op(type_id, "points", " ".join(columns), key="object_id", order="seq")(plan)


_part("AreaMeasure", area="area", point_count="vertex_count")
_part("PerimeterMeasure", perimeter="perimeter", point_count="vertex_count")
_part("CenterMeasure", center_x="center_x", center_y="center_y", point_count="vertex_count")
_part("CircleMeasure", circularity="circularity", equivalent_diameter="sqrt(area * 4 / pi())", area="area", perimeter="perimeter", center_x="center_x", center_y="center_y", bounding_radius="sqrt(pow(bounding_width, 2) + pow(bounding_height, 2)) / 2")
_part("RectangleMeasure", width="bounding_width", height="bounding_height", area="area", rectangularity="rectangularity", aspect_ratio="if(least(bounding_width, bounding_height) > 0, greatest(bounding_width, bounding_height) / least(bounding_width, bounding_height), 0D)", center_x="center_x", center_y="center_y")


# --- tables of measured values


@table_op("MeasureStatistics", "results", "count mean min max std_dev range cp cpu cpl cpk", object_id="", key="object_id", value="value", lsl=0.0, usl=0.0, nominal=0.0)
def measure_statistics(results, object_id, key, value, lsl, usl, nominal):
    """Capability from the population's standard deviation; without spread or limits the indices are 0."""
    rows = results.filter(F.col(key) == object_id) if object_id else results
    v = F.col(value).cast("double")
    s = rows.filter(v.isNotNull()).groupBy(key).agg(F.count("*").alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std_dev"))
    ok = (F.col("std_dev") > 0) & F.lit(usl > lsl)
    high, low = (F.lit(usl) - F.col("mean")) / (F.col("std_dev") * 3), (F.col("mean") - F.lit(lsl)) / (F.col("std_dev") * 3)
    pick = lambda e: F.when(ok, e).otherwise(0.0)
    return s.select("*", (F.col("max") - F.col("min")).alias("range"), pick(F.lit(usl - lsl) / (F.col("std_dev") * 6)).alias("cp"), pick(high).alias("cpu"), pick(low).alias("cpl"), pick(F.least(high, low)).alias("cpk"))


@table_op("MeasureCompare", "results", "n max_deviation pass", key="object_id", value="value", reference=0.0, tolerance=1.0, tolerance_type="absolute")
def measure_compare(results, key, value, reference, tolerance, tolerance_type):
    d = F.abs(F.col(value).cast("double") - reference)
    d = d / abs(reference) * 100 if tolerance_type == "relative" and reference else d
    return results.groupBy(key).agg(F.count(d).alias("n"), F.max(d).alias("max_deviation"), F.coalesce(F.bool_and(d <= tolerance), F.lit(True)).alias("pass"))


@table_op("CogResultAnalysis", "results", "total_count pass_count fail_count pass_rate accepted", key="object_id", passed="pass", pass_threshold=95.0, analysis_mode=0)
def result_analysis(results, key, passed, pass_threshold, analysis_mode):
    s = results.groupBy(key).agg(F.count("*").alias("total_count"), F.count_if(F.col(passed)).alias("pass_count"))
    rate = F.col("pass_count") * 100.0 / F.col("total_count")
    return s.select("*", (F.col("total_count") - F.col("pass_count")).alias("fail_count"), rate.alias("pass_rate"), (rate >= pass_threshold).alias("accepted"))


@table_op("PrecisionReport", "errors", "n mean_error max_error std_error pass", key="object_id", value="error", target=0.005)
def precision_report(errors, key, value, target):
    e = F.abs(F.col(value).cast("double"))
    s = errors.groupBy(key).agg(F.count(e).alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.stddev_pop(e).alias("std_error"))
    return s.select("*", ((F.col("max_error") <= target) & (F.col("mean_error") <= target)).alias("pass"))
