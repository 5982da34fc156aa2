"""Shape models, key points of scale space, contour fits, rectification, projected models, characters and inference."""

from __future__ import annotations

import importlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import against_all, from_pixels, image_of, map_images, measure_images, pair_images, to_pixels
from ..shipping import ship
from ..spec import FlowError, Operator, find, register
from .clouds import rotation
from .features import char_segment, otsu
from .images import block_match, blurred, gradient, gray, sample
from .measures import BLOB, blobs, measure_op, table_op

# --- shape models: directions of steep places


def steep(image: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and unit directions of places whose gradient is at least `least`."""
    gx, gy = (v.astype(np.float64) for v in gradient(gray(image)))
    size = np.hypot(gx, gy)
    y, x = np.nonzero(size >= max(least, 1e-9))
    return y, x, gx[y, x] / size[y, x], gy[y, x] / size[y, x]


_CREATE = {"roi_x": 0, "roi_y": 0, "roi_width": 100, "roi_height": 100, "num_levels": 4, "min_contrast": 30.0, "angle_start": 0.0, "angle_extent": 360.0, "angle_step": 1.0}


@measure_op("CreateShapeModel", "model_id long, num_edges long, width long, height long, edges string", **_CREATE)
def create_shape_model(image, roi_x, roi_y, roi_width, roi_height, num_levels, min_contrast, angle_start, angle_extent, angle_step):
    """The steep places of a region, about its middle: x:y:gx:gy, in thousandths, separated by blanks."""
    part = image[int(roi_y) : int(roi_y + roi_height), int(roi_x) : int(roi_x + roi_width)]
    h, w = part.shape[:2]
    y, x, gx, gy = steep(part, min_contrast) if min(h, w) > 2 else ([], [], [], [])
    edges = " ".join(f"{round((a - (w - 1) / 2) * 1000)}:{round((b - (h - 1) / 2) * 1000)}:{round(c * 1000)}:{round(d * 1000)}" for a, b, c, d in zip(x, y, gx, gy, strict=True))
    return {"model_id": 0, "num_edges": len(x), "width": w, "height": h, "edges": edges}


def shape_scores(image: np.ndarray, model: np.ndarray, turn: float) -> np.ndarray:
    """At every place as the model's middle: the mean cosine between the model's directions, turned, and the image's."""
    gx, gy = (v.astype(np.float64) for v in gradient(gray(image)))
    size = np.maximum(np.hypot(gx, gy), 1e-9)
    gx, gy = np.where(size > 1e-6, gx / size, 0), np.where(size > 1e-6, gy / size, 0)
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    h, w = gx.shape
    out = np.zeros((h, w))
    for x, y, a, b in model:
        dx, dy = math.floor(c * x - s * y + 0.5), math.floor(s * x + c * y + 0.5)
        u, v = c * a - s * b, s * a + c * b
        y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
        if y0 < y1 and x0 < x1:
            out[y0:y1, x0:x1] += u * gx[y0 + dy : y1 + dy, x0 + dx : x1 + dx] + v * gy[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return np.minimum(out / max(len(model), 1), 1)


def _edges(text: str) -> np.ndarray:
    return np.array([[float(v) for v in e.split(":")] for e in text.split()], np.float64).reshape(-1, 4) / 1000


def _found(frames: DataFrame, model: DataFrame, min_score, num_matches, max_overlap, angle_start, angle_extent, angle_step) -> DataFrame:
    """Matches of each model in each frame, best first; one whose middle is nearer to a better one's than `max_overlap`
    leaves of the model's size is dropped. Models travel as frames whose samples are their description.
    """
    as_frames = model.select(F.col("model_id").alias("frame_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(1).alias("channels"), F.lit("Mono8").alias("format"), F.col("edges").cast("binary").alias("data"))

    ship(frames.sparkSession)
    other = as_frames.select(F.col("frame_id").alias("other_id"), F.struct("width", "height", "channels", "format", "data").alias("other"))
    joined = against_all(frames, other)
    names = ["frame_id", "model_id", "x", "y", "score", "angle"]

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["data"] is None:
                    continue
                edges = _edges(row["other"]["data"].decode())
                if not len(edges):
                    continue
                image, got = image_of(row), []
                for turn in np.arange(angle_start, angle_start + max(angle_extent, 1e-9), max(angle_step, 1e-3)):
                    s = np.round(shape_scores(image, edges, turn), 9)
                    y, x = np.nonzero(s >= min_score)
                    got += [(-s[b, a], int(b), int(a), float(turn)) for b, a in zip(y, x, strict=True)]
                apart, kept = (1 - max_overlap) * max(row["other"]["width"], row["other"]["height"]), []
                for score, y, x, turn in sorted(got):
                    if len(kept) < num_matches and all(math.hypot(x - k[2], y - k[1]) >= apart for k in kept):
                        kept.append((score, y, x, turn))
                if kept:
                    score, y, x, turn = zip(*kept, strict=True)
                    columns = [[row["frame_id"]] * len(kept), [row["other_id"]] * len(kept), x, y, [-float(v) for v in score], turn]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.float64()] * 2, strict=True)], names=names)

    return joined.mapInArrow(run, "frame_id long, model_id long, x long, y long, score double, angle double")


register(Operator("FindShapeModel", "pair measure", {"min_score": 0.7, "num_matches": 1, "max_overlap": 0.5, "angle_start": 0.0, "angle_extent": 360.0, "angle_step": 10.0}, ("image", "model"), ("frame_id", "model_id", "x", "y", "score", "angle"), _found))


def _written_model(model: DataFrame, filepath: str) -> DataFrame:
    """The model table as Parquet at `filepath`; one row tells what was written."""
    model.write.mode("overwrite").parquet(filepath)
    return model.sparkSession.read.parquet(filepath).agg(F.count("*").alias("models")).select((F.col("models") > 0).alias("success"), F.lit(filepath).alias("filepath"), "models")


for _id, _params in {"WriteShapeModel": {"filepath": "shape_model.bin"}, "ShapeModel3DSerialize": {"filepath": "", "mode": "save"}}.items():
    register(Operator(_id, "sink", _params, ("model",), ("success", "filepath", "models"), (lambda model, filepath, mode="save": _written_model(model, filepath) if mode == "save" else model.sparkSession.read.parquet(filepath))))


def component(image: np.ndarray, expected_x: int, expected_y: int, tolerance: float, min_score: float) -> dict:
    """The first place, by rows, within the tolerance whose 20 x 20 samples are bright enough on average; without an
    expected place, the first of every tenth place with a mean over 100.
    """
    total = np.pad(gray(image).astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    if min(image.shape[:2]) <= 20:
        return {"found": False, "x": 0, "y": 0, "score": 0.0}
    mean = (total[20:, 20:] - total[:-20, 20:] - total[20:, :-20] + total[:-20, :-20])[:-1, :-1] / 400
    on = mean / 255 >= min_score
    if expected_x == 0 and expected_y == 0:
        on, step = mean > 100, 10
        on[np.arange(len(on)) % step != 0] = False
        on[:, np.arange(on.shape[1]) % step != 0] = False
    else:
        r = int(tolerance)
        y, x = np.indices(on.shape)
        on = on & (abs(y - expected_y) <= r) & (abs(x - expected_x) <= r)
    y, x = np.nonzero(on)
    return {"found": bool(len(y)), "x": int(x[0]) if len(y) else 0, "y": int(y[0]) if len(y) else 0, "score": float(mean[y[0], x[0]] / 255) if len(y) else 0.0}


def _inspected(image: DataFrame, tolerance: float, min_score: float, expected_x: int, expected_y: int) -> DataFrame:
    step = partial(component, expected_x=int(expected_x), expected_y=int(expected_y), tolerance=tolerance, min_score=min_score)
    got = measure_images(image, step, "found boolean, x long, y long, score double")
    return got.select("frame_id", F.col("found").cast("long").alias("num_found"), F.col("found").alias("all_found"), F.when(F.col("found"), "Found").otherwise("Not Found").alias("inspection_result"), "x", "y", "score")


register(Operator("InspectComponent", "measure", {"tolerance": 10.0, "min_score": 0.6, "expected_x": 0, "expected_y": 0}, ("image",), ("num_found", "inspection_result", "all_found", "x", "y", "score"), _inspected))


@measure_op("SIFT", "x double, y double, octave long, response double", n_octaves=4, threshold=10, max_keypoints=100, draw_keypoints=True)
def sift(image, n_octaves, threshold, max_keypoints, draw_keypoints):
    """Extremes of differences of Gaussians over place and scale, strongest first; every octave halves the image."""
    plane, out = gray(image).astype(np.float64), []
    for octave in range(int(n_octaves)):
        if min(plane.shape) <= 16:
            break
        levels = [blurred(plane[:, :, None], 2 * int(3 * s) + 1, s)[:, :, 0] for s in (1.6 * 2 ** (k / 2) for k in range(5))]
        d = np.diff(np.stack(levels), axis=0)
        near = np.lib.stride_tricks.sliding_window_view(d, (3, 3, 3))
        mid = d[1:-1, 1:-1, 1:-1]
        top = (abs(mid) > threshold / 10) & ((mid == near.max((-1, -2, -3))) | (mid == near.min((-1, -2, -3))))
        for _, y, x in np.argwhere(top):
            value = float(abs(mid[:, y, x]).max())
            out.append({"x": float((x + 1) << octave), "y": float((y + 1) << octave), "octave": octave, "response": value})
        plane = plane[::2, ::2]
    unique = {(p["octave"], p["y"], p["x"]): p for p in out}
    return sorted(unique.values(), key=lambda p: (-round(p["response"], 9), p["octave"], p["y"], p["x"]))[: int(max_keypoints)]


# --- fits


@table_op("ContourFitMeasure", "points", "fit_type center_x center_y area perimeter circularity rectangularity fit_error is_valid", fit_mode=1, key="object_id", order="seq")
def contour_fit(points, fit_mode, key, order):
    """A polygon's measures beside the error of a circle (1), an ellipse (2), its box (3) or the polygon itself (4)."""
    if fit_mode not in (1, 2, 3, 4):
        raise FlowError("fit_mode is 1 to 4")
    polygon = find("PolygonMeasure").plan(points, key=key, order=order).filter("vertex_count >= 3")
    if fit_mode == 1:
        fit = find("CircleFit").plan(points, key=key).select(key, "fit_error", "is_valid")
    elif fit_mode == 2:
        mean = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"))
        det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
        u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        # Of an ellipse with these second moments every point has a squared distance of 2 in its own measure.
        off = (u * u * F.col("yy") - u * v * F.col("xy") * 2 + v * v * F.col("xx")) / det - 2
        ok = F.first((F.col("n") >= 5) & (det > 1e-9))
        fit = points.join(mean, key).groupBy(key).agg(F.when(ok, F.sqrt(F.avg(off * off))).otherwise(0.0).alias("fit_error"), ok.alias("is_valid"))
    elif fit_mode == 3:
        box = points.groupBy(key).agg(*[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xy"])
        side = lambda a: F.least(F.col(a) - F.col("lo" + a), F.col("hi" + a) - F.col(a))
        fit = points.join(box, key).groupBy(key).agg(F.avg(F.least(side("x"), side("y"))).alias("fit_error")).withColumn("is_valid", F.lit(True))
    else:
        fit = polygon.select(key, F.lit(0.0).alias("fit_error"), F.lit(True).alias("is_valid"))
    return polygon.join(fit, key).select(key, F.lit(int(fit_mode)).alias("fit_type"), "center_x", "center_y", "area", "perimeter", "circularity", "rectangularity", "fit_error", "is_valid")


@table_op("photometric_defect_detect", "surface", BLOB.replace(" long", "").replace(" double", "").replace(",", ""), normal_threshold=0.3, albedo_threshold=0.2, curvature_threshold=0.5, height_threshold=1.0, min_defect_area=10)
def photometric_defects(surface, normal_threshold, albedo_threshold, curvature_threshold, height_threshold, min_defect_area):
    """Pieces of samples (frame_id, y, x with nx, ny, nz and, where there are any, albedo, curvature, height) whose normal
    turns by more than its threshold against the left or upper neighbour, or whose other values lie further from the
    frame's mean than theirs.
    """
    own, cols = F.col, surface.columns
    beside = surface.select("frame_id", "y", "x", "nx", "ny", "nz")
    out = surface
    for name, dy, dx in (("left", 0, 1), ("up", 1, 0)):
        other = beside.select("frame_id", (own("y") + dy).alias("y"), (own("x") + dx).alias("x"), *[own(a).alias(f"{name}_{a}") for a in ("nx", "ny", "nz")])
        out = out.join(other, ["frame_id", "y", "x"], "left")
    turned = lambda n: F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((own(a) * own(f"{n}_{a}") for a in ("ny", "nz")), own("nx") * own(f"{n}_nx"))))) > normal_threshold, F.lit(False))
    bad = turned("left") | turned("up")
    limits = {"albedo": albedo_threshold, "curvature": curvature_threshold, "height": height_threshold}
    here = [c for c in limits if c in cols]
    if here:
        means = surface.groupBy("frame_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in here])
        out = out.join(means, "frame_id")
        for c in here:
            bad = bad | F.coalesce(F.abs(own(c) - own(f"mean_{c}")) > limits[c], F.lit(False))
    mask = from_pixels(out.select("frame_id", "y", "x", F.lit(0).alias("c"), F.when(bad, 255).otherwise(0).alias("v")))
    return measure_images(mask, lambda image: blobs(gray(image) > 0, min_defect_area, 1e12), BLOB)


# --- stereo


def _rectified(left: DataFrame, right: DataFrame, fx_left, fy_left, cx_left, cy_left, baseline, rx, ry, rz) -> DataFrame:
    """Both frames, their source_id ending in .left and .right; the right one is turned back by the angles (degrees) that
    its camera is turned against the left one's, through a pinhole whose focal length is the frame's width unless given.
    """
    back = np.array(rotation(rx, ry, rz))

    def turn(image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        fx, fy = fx_left or w, fy_left or fx_left or w
        cx, cy = cx_left or (w - 1) / 2, cy_left or (h - 1) / 2
        y, x = np.mgrid[:h, :w].astype(np.float64)
        ray = np.stack(((x - cx) / fx, (y - cy) / fy, np.ones_like(x)), 2) @ back.T
        return sample(image, ray[..., 0] / ray[..., 2] * fx + cx, ray[..., 1] / ray[..., 2] * fy + cy)

    named = lambda df, side: df.withColumn("source_id", F.concat_ws(".", "source_id", F.lit(side)))
    turned = map_images(right, turn) if rx or ry or rz else right
    return named(left, "left").unionByName(named(turned, "right").select(*left.columns))


register(Operator("stereo_rectify", "image pair", {"fx_left": 0.0, "fy_left": 0.0, "cx_left": 0.0, "cy_left": 0.0, "baseline": 60.0, "rx": 0.0, "ry": 0.0, "rz": 0.0}, ("left_image", "right_image"), ("left_rectified", "right_rectified"), lambda left_image, right_image, **p: _rectified(left_image, right_image, **p)))


def _stereo_points(left: DataFrame, right: DataFrame, baseline, focal_length, disparity_scale, num_disparities, block_size) -> DataFrame:
    """Depth baseline * focal length / disparity of every matched sample, through a pinhole about the frame's middle."""
    flat = to_pixels(pair_images(left, right, partial(block_match, num_disparities=int(num_disparities), block_size=int(block_size), min_disparity=0)))
    size = left.select("frame_id", "width", "height")
    b, f = baseline or 60.0, focal_length or 525.0
    z = F.lit(b * f) / (F.col("v") * disparity_scale)
    p = flat.filter("v > 0").join(size, "frame_id")
    return p.select(F.col("frame_id").alias("cloud_id"), (F.col("y").cast("long") * 1_000_000 + F.col("x")).alias("point_id"), ((F.col("x") - F.col("width") / 2) * z / f).alias("x"), ((F.col("y") - F.col("height") / 2) * z / f).alias("y"), z.alias("z"))


register(Operator("PointCloudFromStereo", "image pair", {"baseline": 0.0, "focal_length": 0.0, "disparity_scale": 1.0, "num_disparities": 64, "block_size": 15}, ("left_image", "right_image"), ("cloud_id", "point_id", "x", "y", "z"), lambda left_image, right_image, **p: _stereo_points(left_image, right_image, **p)))


# --- models in space


def _views(model: DataFrame, num_views: int, image_width: int, image_height: int, fx: float, fy: float, cx: float, cy: float, distance: float) -> DataFrame:
    """Every point (model_id, point_id, x, y, z) as each view sees it: views stand evenly around the vertical axis, looking
    at the origin from `distance`. The number of views is a parameter, so the rows are that many times the points.
    """
    turn = F.col("view_id") * F.lit(2 * math.pi / max(int(num_views), 1))
    rows = model.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(max(int(num_views), 1) - 1))))
    x = F.cos(turn) * F.col("x") + F.sin(turn) * F.col("z")
    z = F.cos(turn) * F.col("z") - F.sin(turn) * F.col("x") + F.lit(float(distance))
    rows = rows.select("model_id", "view_id", "point_id", x.alias("vx"), F.col("y").alias("vy"), z.alias("depth")).filter("depth > 0")
    u, v = F.col("vx") / F.col("depth") * F.lit(fx) + F.lit(cx or image_width / 2), F.col("vy") / F.col("depth") * F.lit(fy) + F.lit(cy or image_height / 2)
    return rows.select("model_id", "view_id", "point_id", u.alias("u"), v.alias("v"), "depth").filter((F.col("u") >= 0) & (F.col("u") < image_width) & (F.col("v") >= 0) & (F.col("v") < image_height))


_VIEW = "model_id view_id point_id u v depth"
table_op("CreateShapeModel3D", "geometry", _VIEW, num_views=20, image_width=640, image_height=480, min_score=0.5, greediness=0.8, cam_param_fx=525.0, cam_param_fy=525.0, cam_param_cx=0.0, cam_param_cy=0.0, view_distance=500.0)(lambda geometry, num_views, image_width, image_height, min_score, greediness, cam_param_fx, cam_param_fy, cam_param_cx, cam_param_cy, view_distance: _views(geometry, num_views, image_width, image_height, cam_param_fx, cam_param_fy, cam_param_cx, cam_param_cy, view_distance))
table_op("ShapeModel3DTrain", "model", _VIEW, num_views=20, image_width=640, image_height=480, use_sphere_sampling=True, view_distance=500.0)(lambda model, num_views, image_width, image_height, use_sphere_sampling, view_distance: _views(model, num_views, image_width, image_height, 525.0, 525.0, 0.0, 0.0, view_distance))


@table_op("ShapeModel3DProject", "model", "model_id u v n depth", "ShapeModel3DVisualize", output_width=640, output_height=480, draw_edges=True, draw_filled=False, edge_color_r=0, edge_color_g=255, edge_color_b=0, edge_thickness=2, tx=0.0, ty=0.0, tz=500.0, rx=0.0, ry=0.0, rz=0.0, focal_length=525.0)
def project_model(model, output_width, output_height, draw_edges, draw_filled, edge_color_r, edge_color_g, edge_color_b, edge_thickness, tx, ty, tz, rx, ry, rz, focal_length):
    """The raster that a pose of the model covers: every sample with how many points fall there and the nearest depth."""
    moved = find("pointcloud_transform").plan(model, tx=tx, ty=ty, tz=tz, rx=rx, ry=ry, rz=rz).filter("z > 0")
    u, v = (F.floor(F.col(a) / F.col("z") * focal_length + size / 2).cast("long") for a, size in (("x", output_width), ("y", output_height)))
    on = moved.select("model_id", u.alias("u"), v.alias("v"), "z").filter((F.col("u") >= 0) & (F.col("u") < output_width) & (F.col("v") >= 0) & (F.col("v") < output_height))
    return on.groupBy("model_id", "u", "v").agg(F.count("*").alias("n"), F.min("z").alias("depth"))


# --- characters

#: A usual 5 x 7 type face, seven rows of five bits each, in hexadecimal.
FACE = {
    "0": "0E 11 13 15 19 11 0E", "1": "04 0C 04 04 04 04 0E", "2": "0E 11 01 02 04 08 1F", "3": "1F 02 04 02 01 11 0E", "4": "02 06 0A 12 1F 02 02", "5": "1F 10 1E 01 01 11 0E",
    "6": "06 08 10 1E 11 11 0E", "7": "1F 01 02 04 08 08 08", "8": "0E 11 11 0E 11 11 0E", "9": "0E 11 11 0F 01 02 0C", "A": "0E 11 11 1F 11 11 11", "B": "1E 11 11 1E 11 11 1E",
    "C": "0E 11 10 10 10 11 0E", "D": "1C 12 11 11 11 12 1C", "E": "1F 10 10 1E 10 10 1F", "F": "1F 10 10 1E 10 10 10", "G": "0E 11 10 17 11 11 0F", "H": "11 11 11 1F 11 11 11",
    "I": "0E 04 04 04 04 04 0E", "J": "07 02 02 02 02 12 0C", "K": "11 12 14 18 14 12 11", "L": "10 10 10 10 10 10 1F", "M": "11 1B 15 15 11 11 11", "N": "11 11 19 15 13 11 11",
    "O": "0E 11 11 11 11 11 0E", "P": "1E 11 11 1E 10 10 10", "Q": "0E 11 11 11 15 12 0D", "R": "1E 11 11 1E 14 12 11", "S": "0F 10 10 0E 01 01 1E", "T": "1F 04 04 04 04 04 04",
    "U": "11 11 11 11 11 11 0E", "V": "11 11 11 11 11 0A 04", "W": "11 11 11 15 15 15 0A", "X": "11 11 0A 04 0A 11 11", "Y": "11 11 11 0A 04 04 04", "Z": "1F 01 02 04 08 10 1F",
}
GRID = 14


def glyph(char: str) -> np.ndarray:
    return np.array([[int(row, 16) >> (4 - k) & 1 for k in range(5)] for row in FACE[char].split()], bool)


def write_text(text: str, scale: int = 3, border: int = 4) -> np.ndarray:
    """Dark letters of the face on light ground; characters that it lacks leave a gap."""
    cells = np.zeros((7, 6 * len(text)), bool)
    for k, c in enumerate(text):
        if c in FACE:
            cells[:, 6 * k : 6 * k + 5] = glyph(c)
    return np.pad(np.where(np.kron(cells, np.ones((scale, scale), bool)), 0, 255).astype(np.uint8), border, constant_values=255)


def shape_of(ink: np.ndarray) -> tuple[np.ndarray, float]:
    """A crop to its ink on a grid of GRID x GRID cells, as shares of ink, and its width over height."""
    y, x = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    ink = ink[y[0] : y[-1] + 1, x[0] : x[-1] + 1].astype(np.float64)
    h, w = ink.shape
    rows = np.add.reduceat(np.repeat(ink, GRID, axis=0), np.arange(GRID) * h, axis=0) / h
    return np.add.reduceat(np.repeat(rows, GRID, axis=1), np.arange(GRID) * w, axis=1) / w, w / h


def _face(chars: str) -> dict[str, tuple[np.ndarray, float]]:
    return {c: shape_of(glyph(c)) for c in chars}


DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FACES = {"digit": DIGITS, "english": LETTERS, "mixed": DIGITS + LETTERS, "chinese": ""}


def trained(model_path: str, most: int = 20_000) -> dict[str, tuple[np.ndarray, float]]:
    """Glyphs of a model table (label, aspect, cells), at most `most`, on the driver."""
    rows = SparkSession.active().read.parquet(model_path).select("label", "aspect", "cells").limit(most + 1).collect()
    if len(rows) > most:
        raise FlowError(f"more than {most} glyphs")
    return {r["label"]: (np.frombuffer(bytes.fromhex(r["cells"]), np.uint8).reshape(GRID, GRID) / 255, r["aspect"]) for r in sorted(rows, key=lambda r: (r["label"], r["cells"]))}


def read_text(image: np.ndarray, glyphs: dict, low: int, high: int, least: float) -> dict:
    """Characters from left to right: the glyph whose cells and proportions are nearest, if it is near enough."""
    plane = gray(image)
    ink = plane <= otsu(plane)
    ink = ~ink if ink.mean() > 0.5 else ink
    out, sure = "", []
    for box in char_segment(image, low, high) if glyphs else []:
        cells, aspect = shape_of(ink[box["y"] : box["y"] + box["height"], box["x"] : box["x"] + box["width"]])
        score, char = min((float(abs(cells - g).mean()) + 0.5 * abs(math.log(aspect / a)), c) for c, (g, a) in glyphs.items())
        if (score := max(0.0, 1 - score) * 100) >= least:
            out += char
            sure.append(score)
    return {"text": out, "confidence": float(np.mean(sure)) if sure else 0.0, "n_chars": len(sure)}


def _ocr(image: DataFrame, char_set, min_char_size, max_char_size, confidence_threshold, model_path) -> DataFrame:
    glyphs = _face(FACES.get(char_set, DIGITS + LETTERS)) | (trained(model_path) if model_path else {})
    return measure_images(image, partial(read_text, glyphs=glyphs, low=min_char_size, high=max_char_size, least=confidence_threshold), "text string, confidence double, n_chars long")


for _id, _set, _low, _high in (("ChineseOCR", "chinese", 8, 120), ("DigitOCR", "digit", 5, 80), ("EnglishOCR", "english", 5, 80), ("MixedOCR", "mixed", 5, 120)):
    register(Operator(_id, "measure", {"char_set": _set, "min_char_size": _low, "max_char_size": _high, "confidence_threshold": 50.0, "model_path": ""}, ("image",), ("text", "confidence", "n_chars"), _ocr))


def _any_ocr(image: DataFrame, language, whitelist, blacklist, model_path, min_confidence) -> DataFrame:
    """The face's characters, only those listed or none of those listed; confidence from 0 to 1."""
    glyphs = _face(DIGITS + LETTERS) | (trained(model_path) if model_path else {})
    glyphs = {c: g for c, g in glyphs.items() if (not whitelist or c in whitelist) and c not in blacklist}
    got = measure_images(image, partial(read_text, glyphs=glyphs, low=5, high=10_000, least=min_confidence * 100), "text string, confidence double, n_chars long")
    return got.withColumn("confidence", F.col("confidence") / 100)


register(Operator("OCR", "measure", {"language": "eng", "whitelist": "", "blacklist": "", "model_path": "", "min_confidence": 0.0}, ("image",), ("text", "confidence", "n_chars"), _any_ocr))


def _glyph_rows(image: np.ndarray, labels: str, low: int = 3, high: int = 10_000) -> list[dict]:
    plane = gray(image)
    ink = plane <= otsu(plane)
    ink = ~ink if ink.mean() > 0.5 else ink
    out = []
    for char, box in zip(labels, char_segment(image, low, high), strict=False):
        cells, aspect = shape_of(ink[box["y"] : box["y"] + box["height"], box["x"] : box["x"] + box["width"]])
        out.append({"label": char, "aspect": float(aspect), "cells": np.round(cells * 255).astype(np.uint8).tobytes().hex()})
    return out


def _learnt(image: DataFrame, label: str, model_path: str, action: str) -> DataFrame:
    """Glyph rows of the frames' characters, labelled in order by the characters of `label`; with a path they are added to
    the model table there.
    """
    rows = measure_images(image, partial(_glyph_rows, labels=label), "label string, aspect double, cells string").drop("frame_id")
    if not model_path:
        return rows
    rows.write.mode(action).parquet(model_path)
    return image.sparkSession.read.parquet(model_path)


register(Operator("OCRTrain", "sink", {"char_set": "chinese", "model_path": "", "confidence_threshold": 95.0, "label": ""}, ("image",), ("label", "aspect", "cells"), lambda image, char_set, model_path, confidence_threshold, label: _learnt(image, label, model_path, "append")))
register(Operator("FontTrain", "sink", {"font_name": "CustomFont", "output_path": "", "char_set": ""}, ("sample_image",), ("label", "aspect", "cells"), lambda sample_image, font_name, output_path, char_set: _learnt(sample_image, char_set, output_path, "overwrite")))


def _model_table(action: str, model_path: str, char_set: str, model_name: str) -> DataFrame:
    """info and load: the number of glyphs of each label; clear: an empty table in its place."""
    spark = SparkSession.active()
    if action == "clear":
        spark.createDataFrame([], "label string, aspect double, cells string").write.mode("overwrite").parquet(model_path)
    elif action not in ("info", "load"):
        raise FlowError(f"unknown action {action}")
    return spark.read.parquet(model_path).agg(F.count("*").alias("model_size"), F.count_distinct("label").alias("labels")).select("model_size", "labels", F.lit(model_path).alias("model_path"), F.lit(model_name).alias("model_name"))


register(Operator("OCRModel", "source", {"action": "info", "model_path": "./chinese_ocr_model", "char_set": "chinese", "model_name": "default"}, (), ("model_size", "labels", "model_path", "model_name"), _model_table))


# --- inference with a pluggable model


def model_of(path: str):
    """`package.module:function`, a function of one image, or a path that ends in .onnx, through onnxruntime."""
    if path.endswith(".onnx"):
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda image: session.run(None, {name: np.moveaxis(image.astype(np.float32) / 255, 2, 0)[None]})[0][0]
    if ":" not in path:
        raise FlowError("model_path is package.module:function or the path of an .onnx file")
    module, _, name = path.rpartition(":")
    return getattr(importlib.import_module(module), name)


def suppressed(boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, least: float, most: float) -> np.ndarray:
    """Indices that stay: by falling score, those that meet no better one of their class by more than `most` (intersection
    over union). Boxes are x, y, width, height.
    """
    order = [i for i in np.lexsort((np.arange(len(scores)), -scores)) if scores[i] >= least]
    kept: list[int] = []
    for i in order:
        x, y, w, h = boxes[i]
        clash = False
        for j in kept:
            if classes[i] == classes[j]:
                a, b, c, d = boxes[j]
                common = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
                clash |= common > most * (w * h + c * d - common)
        if not clash:
            kept.append(i)
    return np.array(kept, int)


TOY = "lumenflow.operators.toy_models:"


@measure_op("Detection", "x long, y long, width long, height long, score double, class_id long", model_path=TOY + "bright_tiles", confidence_threshold=0.5, nms_threshold=0.45, execution_provider="CPU")
def detection(image, model_path, confidence_threshold, nms_threshold, execution_provider):
    """The model gives rows x, y, width, height, score, class."""
    got = np.asarray(model_of(model_path)(image), np.float64).reshape(-1, 6)
    keep = suppressed(got[:, :4], got[:, 4], got[:, 5], confidence_threshold, nms_threshold)
    return [{"x": int(r[0]), "y": int(r[1]), "width": int(r[2]), "height": int(r[3]), "score": float(r[4]), "class_id": int(r[5])} for r in got[keep]]


@measure_op("Classification", "rank long, class_id long, class_name string, confidence double", model_path=TOY + "quadrant_logits", top_k=5, label_file="", execution_provider="CPU")
def classification(image, model_path, top_k, label_file, execution_provider):
    """The model gives a number for each class; softmax makes them probabilities. Names are the label file's lines."""
    z = np.asarray(model_of(model_path)(image), np.float64).ravel()
    p = np.exp(z - z.max())
    p /= p.sum()
    names = _labels(label_file)
    best = np.lexsort((np.arange(len(p)), -np.round(p, 12)))[: int(top_k)]
    return [{"rank": r + 1, "class_id": int(k), "class_name": names[k] if k < len(names) else f"class_{k}", "confidence": float(p[k])} for r, k in enumerate(best)]


def _labels(path: str) -> list[str]:
    if not path:
        return []
    from .devices import store

    system, at = store(path)
    with system.open_input_stream(at) as f:
        return f.read().decode().splitlines()


def _segmented(image: DataFrame, model_path, output_type, execution_provider) -> DataFrame:
    """The class of every sample, the one with the highest number (the first of equals), as a frame."""
    return map_images(image, lambda v: np.asarray(model_of(model_path)(v)).argmax(0).astype(np.uint8)[:, :, None])


register(Operator("Segmentation", "image", {"model_path": TOY + "three_levels", "output_type": "semantic", "execution_provider": "CPU"}, ("image",), ("mask",), _segmented))


@measure_op("ONNXInference", "position long, value double", model_path=TOY + "row_means", input_name="input", output_name="output", execution_provider="CPU")
def inference(image, model_path, input_name, output_name, execution_provider):
    return [{"position": k, "value": float(v)} for k, v in enumerate(np.asarray(model_of(model_path)(image), np.float64).ravel())]


@table_op("ExportONNX", "model_info", "export_path export_status model_info", input_shape="1,3,224,224", output_names="output", opset_version=11, dynamic_batch=False, optimize=True, output_path="./models", model_name="model", weights_path="")
def export_onnx(model_info, input_shape, output_names, opset_version, dynamic_batch, optimize, output_path, model_name, weights_path):
    """What an export would hold, a row for each model_info; with weights (an .onnx file) the file is copied to the path."""
    path = f"{output_path.rstrip('/')}/{model_name}.onnx"
    if weights_path:
        from .devices import store

        (a, at), (b, to) = store(weights_path), store(path)
        b.create_dir(to.rsplit("/", 1)[0], recursive=True)
        with a.open_input_stream(at) as source, b.open_output_stream(to) as target:
            target.write(source.read())
    told = F.to_json(F.struct(F.col("model_info"), F.lit(input_shape).alias("input_shape"), F.lit(output_names).alias("output_names"), F.lit(int(opset_version)).alias("opset_version"), F.lit(dynamic_batch).alias("dynamic_batch")))
    return model_info.select(F.lit(path).alias("export_path"), F.lit(bool(weights_path)).alias("export_status"), told.alias("model_info"))


# --- registration of many clouds


@table_op("PointCloudGlobalRegistration", "clouds", "cloud_id point_id x y z", use_pairwise=True, max_iterations=50, convergence_threshold=1e-6)
def register_all(clouds, use_pairwise, max_iterations, convergence_threshold):
    """Every cloud moved onto the one of the least id by nearest points, all as one table."""
    first = clouds.agg(F.min("cloud_id").alias("first"))
    both = clouds.join(F.broadcast(first), F.lit(True))
    target, others = both.filter("cloud_id = first").drop("first"), both.filter("cloud_id <> first").drop("first")
    # The least cloud is copied for each of the others, so that each pair meets in a task of its own; the list of ids is one row.
    ids = others.agg(F.collect_set("cloud_id").alias("ids"))
    copies = target.select("point_id", "x", "y", "z").join(F.broadcast(ids), F.lit(True)).select(F.explode("ids").alias("cloud_id"), *[F.col(c).alias(c) for c in ("point_id", "x", "y", "z")])
    icp = find("PointCloudICP")
    motion = icp.plan(others, copies, **icp.bind({"max_iterations": int(max_iterations), "tolerance": float(convergence_threshold), "max_correspondence_distance": 1e9}))
    turned = lambda k: sum((F.col(f"r{k}{j}") * F.col(b) for j, b in ((2, "y"), (3, "z"))), F.col(f"r{k}1") * F.col("x"))
    moved = others.join(motion, "cloud_id").select("cloud_id", "point_id", *[(turned(k) + F.col("t" + a)).alias(a) for k, a in enumerate("xyz", 1)])
    return target.select("cloud_id", "point_id", "x", "y", "z").unionByName(moved)


def text_frames(rows: DataFrame, scale: int = 3) -> DataFrame:
    """A frame of dark letters for each row's frame_id and data."""
    from ..frames import SCHEMA

    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                image = write_text(b.column(1)[i].as_py() or "", scale)
                row = {"frame_id": b.column(0)[i].as_py(), "width": image.shape[1], "height": image.shape[0], "channels": 1, "format": "Mono8", "timestamp_us": 0, "source_id": "text", "data": image.tobytes()}
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    return rows.select("frame_id", "data").mapInArrow(run, SCHEMA)
