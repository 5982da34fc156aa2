"""Positioning, labels and data sets, augmentation, contours, registration of point clouds, photometric stereo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clouds import AXES, neighbours
from .geometry import _op
from .images import _plane, clamp, flip, gradient, gray, hue_shift, image_op, pair_op, resize, rotate, saturation
from .measures import table_op

# --- positioning

_op("CoordinateTransform", "image_x=0 image_y=0 a=0 b=0 c=0 d=0 e=0 f=0", {"world_x": "a*image_x+b*image_y+c", "world_y": "d*image_x+e*image_y+f"})
_op("AlignmentCorrection", "target_x=0 target_y=0 actual_x=0 actual_y=0 target_angle=0 actual_angle=0", {"offset_x": "target_x-actual_x", "offset_y": "target_y-actual_y", "rotation": "target_angle-actual_angle", "scale_x": "1.0", "scale_y": "1.0"})
_op("RobotGuide", "offset_x=0 offset_y=0 rotation=0 base_x=0 base_y=0 base_z=0 base_rx=0 base_ry=0 base_rz=0 use_rotation=0", {"target_x": "base_x+offset_x", "target_y": "base_y+offset_y", "target_z": "base_z", "target_rx": "base_rx", "target_ry": "base_ry", "target_rz": "base_rz+CASE WHEN use_rotation > 0 THEN rotation ELSE 0.0 END"})
_DET = "(src_x1*(src_y2-src_y3)+src_x2*(src_y3-src_y1)+src_x3*(src_y1-src_y2))"


def _affine_row(v: str) -> dict[str, str]:
    a, b, c = f"{v}1", f"{v}2", f"{v}3"
    return {
        "x": f"({a}*(src_y2-src_y3)+{b}*(src_y3-src_y1)+{c}*(src_y1-src_y2))/det",
        "y": f"({a}*(src_x3-src_x2)+{b}*(src_x1-src_x3)+{c}*(src_x2-src_x1))/det",
        "o": f"({a}*(src_x2*src_y3-src_x3*src_y2)+{b}*(src_x3*src_y1-src_x1*src_y3)+{c}*(src_x1*src_y2-src_x2*src_y1))/det",
    }


_op("AffineTransformCalc", "src_x1=0 src_y1=0 tgt_x1=0 tgt_y1=0 src_x2=1 src_y2=0 tgt_x2=1 tgt_y2=0 src_x3=0 src_y3=1 tgt_x3=0 tgt_y3=1",
    {"a": "ma", "b": "mb", "c": "mc", "d": "md", "e": "me", "f": "mf", "translation_x": "mc", "translation_y": "mf", "rotation": "atan2(CASE WHEN md = 0 THEN 0.0 ELSE md END,ma)*180.0/pi()", "scale_x": "sqrt(ma*ma+md*md)", "scale_y": "sqrt(mb*mb+me*me)"},
    {"det": f"CASE WHEN abs({_DET}) < 1e-12 THEN 1e12 ELSE {_DET} END"} | {m: _affine_row(v)[k] for v, names in (("tgt_x", "abc"), ("tgt_y", "def")) for m, k in zip(("m" + n for n in names), "xyo", strict=True)})
_R = {"cx": "cos(rx*pi()/180)", "sx": "sin(rx*pi()/180)", "cy": "cos(ry*pi()/180)", "sy": "sin(ry*pi()/180)", "cz": "cos(rz*pi()/180)", "sz": "sin(rz*pi()/180)"}
_op("robot_pose_convert", "x=0 y=0 z=0 rx=0 ry=0 rz=0", {"r11": "cz*cy", "r12": "cz*sy*sx-sz*cx", "r13": "cz*sy*cx+sz*sx", "r21": "sz*cy", "r22": "sz*sy*sx+cz*cx", "r23": "sz*sy*cx-cz*sx", "r31": "-sy", "r32": "cy*sx", "r33": "cy*cx", "tx": "x", "ty": "y", "tz": "z"}, _R)
_op("depth_measure", "u1=0 v1=0 d1=1 u2=1 v2=1 d2=1 depth_scale=1 focal_length_x=525 focal_length_y=525 center_x=0 center_y=0",
    {"distance_3d": "sqrt(pow((u1-center_x)*d1/fx-(u2-center_x)*d2/fx,2)+pow((v1-center_y)*d1/fy-(v2-center_y)*d2/fy,2)+pow((d1-d2)*depth_scale,2))"},
    {"fx": "CASE WHEN abs(focal_length_x) < 1e-9 THEN 1.0 ELSE focal_length_x/CASE WHEN abs(depth_scale) < 1e-9 THEN 1.0 ELSE depth_scale END END", "fy": "CASE WHEN abs(focal_length_y) < 1e-9 THEN 1.0 ELSE focal_length_y/CASE WHEN abs(depth_scale) < 1e-9 THEN 1.0 ELSE depth_scale END END"})


@table_op("NinePointCalibration", "points", "a b c d e f error n valid", key="camera_id", min_points=3, max_error_threshold=1.0)
def nine_point(points, key, min_points, max_error_threshold):
    """The affine map of least squares from image (x, y) to world (world_x, world_y): sums about the mean, closed form."""
    m = points.groupBy(key).agg(*[F.avg(c).alias("m" + c) for c in ("x", "y", "world_x", "world_y")])
    u = points.join(m, key).select(key, *["m" + c for c in ("x", "y", "world_x", "world_y")], *[(F.col(c) - F.col("m" + c)).alias("u" + c) for c in ("x", "y", "world_x", "world_y")])
    sums = {"n": F.count("*"), "xx": F.sum(F.col("ux") ** 2), "xy": F.sum(F.col("ux") * F.col("uy")), "yy": F.sum(F.col("uy") ** 2)}
    for w in ("world_x", "world_y"):
        sums |= {f"x{w}": F.sum(F.col("ux") * F.col("u" + w)), f"y{w}": F.sum(F.col("uy") * F.col("u" + w)), f"q{w}": F.sum(F.col("u" + w) ** 2)}
    s = u.groupBy(key, "mx", "my", "mworld_x", "mworld_y").agg(*[v.alias(k) for k, v in sums.items()])
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    ok = (F.col("n") >= int(min_points)) & (det > 1e-12)
    part = lambda e: F.when(ok, e / det).otherwise(0.0)
    rows = {}
    for w, (p, q, o) in (("world_x", "abc"), ("world_y", "def")):
        rows[p] = part(F.col("x" + w) * F.col("yy") - F.col("y" + w) * F.col("xy"))
        rows[q] = part(F.col("y" + w) * F.col("xx") - F.col("x" + w) * F.col("xy"))
    s = s.select("*", *[v.alias(k) for k, v in rows.items()])
    s = s.withColumns({o: F.col("m" + w) - F.col(p) * F.col("mx") - F.col(q) * F.col("my") for w, (p, q, o) in (("world_x", "abc"), ("world_y", "def"))})
    left = sum((F.col("q" + w) - F.col(p) * F.col("x" + w) - F.col(q) * F.col("y" + w) for w, (p, q, _) in (("world_y", "def"),)), F.col("qworld_x") - F.col("a") * F.col("xworld_x") - F.col("b") * F.col("yworld_x"))
    error = F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("n"))
    return s.select(key, "a", "b", "c", "d", "e", "f", error.alias("error"), "n", (ok & (error <= max_error_threshold)).alias("valid"))


# --- measurement models: a row per model with an array of objects

_OBJECT = "object_id string, kind string, transition string, params map<string,double>"


@table_op("MeasureModelCreate", "ids", "model_id objects", model_id="measure_model", model_name="", pixel_size=1.0)
def model_create(ids, model_id, model_name, pixel_size):
    rows = ids if "model_id" in ids.columns else ids.withColumn("model_id", F.lit(model_id))
    return rows.select("*", F.lit(model_name).alias("model_name"), F.lit(float(pixel_size)).alias("pixel_size"), F.array().cast(f"array<struct<{_OBJECT.replace(' string', ':string').replace(' map', ':map')}>>").alias("objects"))


def _adder(kind: str, **params):
    @table_op(f"MeasureModelAdd{kind}", "model", "objects", object_id=kind.lower() + "1", transition="all", **params)
    def add(model, object_id, transition, **p):
        one = F.struct(F.lit(object_id).alias("object_id"), F.lit(kind.lower()).alias("kind"), F.lit(transition).alias("transition"), F.create_map(*[x for k, v in p.items() for x in (F.lit(k), F.lit(float(v)))]).alias("params"))
        return model.withColumn("objects", F.array_append("objects", one))

    return add


_adder("Line", center_row=100.0, center_col=100.0, length=50.0, angle=0.0, threshold=30.0, sigma=1.0)
_adder("Circle", center_row=100.0, center_col=100.0, radius=30.0, threshold=30.0, sigma=1.0, num_points=36.0)
_adder("Rectangle", center_row=100.0, center_col=100.0, length1=50.0, length2=30.0, angle=0.0, threshold=30.0)
_adder("Arc", center_row=100.0, center_col=100.0, radius=30.0, start_angle=0.0, end_angle=90.0, threshold=30.0)


@table_op("MeasureReport", "results", "report", report_id="report_001", inspection_id="insp_001", model_name="")
def measure_report(results, report_id, inspection_id, model_name):
    return results.select("*", F.to_json(F.struct(F.lit(report_id).alias("report_id"), F.lit(inspection_id).alias("inspection_id"), F.lit(model_name).alias("model_name"), F.struct("*").alias("results"))).alias("report"))


# --- labels and data sets


@table_op("LabelVerify", "annotations", "out_of_bounds empty duplicate valid", check_bounds=True, check_duplicate=True, check_empty=True, auto_correct=False)
def label_verify(annotations, check_bounds, check_duplicate, check_empty, auto_correct):
    """Against image_width and image_height; of equal boxes of one image and label, all but the least object_id are duplicates."""
    box = Window.partitionBy("image_id", "label", "x", "y", "width", "height").orderBy("object_id")
    out = F.lit(bool(check_bounds)) & ((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("width") > F.col("image_width")) | (F.col("y") + F.col("height") > F.col("image_height")))
    empty = F.lit(bool(check_empty)) & ((F.col("width") <= 0) | (F.col("height") <= 0) | F.col("label").isNull() | (F.col("label") == ""))
    again = F.lit(bool(check_duplicate)) & (F.row_number().over(box) > 1)
    rows = annotations.select("*", out.alias("out_of_bounds"), empty.alias("empty"), again.alias("duplicate"))
    return rows.withColumn("valid", ~(F.col("out_of_bounds") | F.col("empty") | F.col("duplicate")))


@table_op("LabelExport", "annotations", "line", format="YOLO", output_dir="./labels", filename="annotations", include_images=True)
def label_export(annotations, format, output_dir, filename, include_images):
    """A line per object: centre and size as shares (YOLO) or JSON with a box of corner and size (COCO)."""
    if format == "YOLO":
        share = lambda e: F.format_number(e, 6)
        parts = [(F.col("x") + F.col("width") / 2) / F.col("image_width"), (F.col("y") + F.col("height") / 2) / F.col("image_height"), F.col("width") / F.col("image_width"), F.col("height") / F.col("image_height")]
        return annotations.select("*", F.concat_ws(" ", F.col("class_id").cast("string"), *[share(e) for e in parts]).alias("line"))
    return annotations.select("*", F.to_json(F.struct("image_id", F.col("class_id").alias("category_id"), F.array("x", "y", "width", "height").alias("bbox"), (F.col("width") * F.col("height")).alias("area"))).alias("line"))


@table_op("DatasetManager", "dataset", "split fold", key="image_id", split_strategy="random", train_ratio=0.7, val_ratio=0.15, test_ratio=0.15, k_fold=5, random_seed=42)
def dataset_manager(dataset, key, split_strategy, train_ratio, val_ratio, test_ratio, k_fold, random_seed):
    from .relational import dataset_split

    return dataset_split(dataset, key, train_ratio, val_ratio, 1 - train_ratio - val_ratio, False, "", random_seed).withColumn("fold", F.pmod(F.col(key) * 104729 + int(random_seed), F.lit(int(k_fold))).cast("int"))


@table_op("DataValidation", "dataset", "rows missing duplicates outliers quality_score", key="group_id", value="value", check_duplicate=True, check_missing=True, check_outliers=True, min_quality_score=0.7)
def data_validation(dataset, key, value, check_duplicate, check_missing, check_outliers, min_quality_score):
    """Per group: null values, repeated values, and values over three deviations from the mean. Counts only: no group is gathered."""
    s = dataset.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
    distinct = dataset.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c")).groupBy(key).agg(F.sum(F.col("c") - 1).alias("duplicates"))
    far = dataset.join(s.select(key, "m", "d"), key).groupBy(key).agg(F.count_if(F.abs(F.col(value) - F.col("m")) > F.col("d") * 3).alias("outliers"))
    out = s.join(distinct, key, "left").join(far, key, "left").select(key, "rows", *[(F.coalesce(c, F.lit(0)) if on else F.lit(0)).cast("long").alias(c) for c, on in (("missing", check_missing), ("duplicates", check_duplicate), ("outliers", check_outliers))])
    score = F.greatest(F.lit(0.0), 1 - (F.col("missing") + F.col("outliers")) / F.col("rows"))
    return out.select("*", score.alias("quality_score"), (score >= min_quality_score).alias("accepted"))


@table_op("TrainConfig", "models", "config", learning_rate=0.001, batch_size=32, epochs=100, optimizer="Adam", lr_scheduler="cosine", weight_decay=0.0001, momentum=0.9, dropout=0.5)
def train_config(models, **p):
    return models.withColumn("config", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in p.items()])))


@table_op("TrainProgress", "metrics", "running_loss best_loss", key="run_id", step="step", loss="loss", log_interval=10)
def train_progress(metrics, key, step, loss, log_interval):
    w = Window.partitionBy(key).orderBy(step)
    return metrics.select("*", F.avg(loss).over(w.rowsBetween(1 - int(log_interval), 0)).alias("running_loss"), F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best_loss"))


@table_op("ImageAnnotate", "frames", "annotation", "DataLabeling", label="object", annotation_type="rectangle", class_id=0, x=0, y=0, width=100, height=100, polygon_points="", color="255,0,0", show_label=True)
def annotate(frames, label, annotation_type, class_id, x, y, width, height, polygon_points, color, show_label):
    """A polygon has its points x,y,x,y; other shapes their box. A label that is not shown is left out."""
    parts = [F.lit(annotation_type).alias("type"), F.lit(int(class_id)).alias("class_id"), F.lit(color).alias("color")]
    parts.append(F.array(*[F.lit(float(v)) for v in polygon_points.split(",")]).alias("points") if polygon_points else F.array(*[F.lit(int(v)) for v in (x, y, width, height)]).alias("box"))
    return frames.select("frame_id", F.to_json(F.struct(*([F.lit(label).alias("label")] if show_label else []), *parts)).alias("annotation"))


@table_op("ImageDisplay", "image", "frame_id width height channels format bytes")
def image_display(image):
    return image.select("frame_id", "width", "height", "channels", "format", F.length("data").alias("bytes"))


# --- augmentation: seeded, so that a run can be repeated


@image_op("DataAugment", augment_type="combined", rotate_angle="-30,30", flip_direction="horizontal", scale_range="0.8,1.2", crop_ratio=0.8, random_seed=0)
def augment(image, augment_type, rotate_angle, flip_direction, scale_range, crop_ratio, random_seed):
    rng = np.random.default_rng(int(random_seed))
    low, high = (float(v) for v in rotate_angle.split(","))
    small, large = (float(v) for v in scale_range.split(","))
    if augment_type in ("rotate", "combined"):
        image = rotate(image, rng.uniform(low, high), -1.0, -1.0, False)
    if augment_type in ("flip", "combined"):
        image = flip(image, flip_direction == "horizontal", flip_direction == "vertical")
    if augment_type in ("scale", "combined"):
        s = rng.uniform(small, large)
        image = resize(image, 0, 0, s, s, "bilinear")
    return image


@image_op("ColorAugment", brightness_range="-0.2,0.2", contrast_range="0.8,1.2", saturation_range="0.8,1.2", hue_range="-0.1,0.1", random_apply=True, random_seed=0)
def color_augment(image, brightness_range, contrast_range, saturation_range, hue_range, random_apply, random_seed):
    """A draw from each range; without random_apply the ranges' middles. Colour frames change in saturation and hue (turns) too."""
    rng = np.random.default_rng(int(random_seed))
    ranges = ([float(v) for v in r.split(",")] for r in (brightness_range, contrast_range, saturation_range, hue_range))
    shift, factor, richer, turn = (rng.uniform(*r) if random_apply else sum(r) / 2 for r in ranges)
    out = clamp((image.astype(np.float64) - 128) * factor + 128 + 255 * shift)
    return hue_shift(saturation(out, richer), 360 * turn) if out.shape[2] >= 3 else out


@image_op("RandomCrop", crop_width=0, crop_height=0, crop_ratio_min=0.5, crop_ratio_max=1.0, ensure_object=True, num_outputs=1, random_seed=0)
def random_crop(image, crop_width, crop_height, crop_ratio_min, crop_ratio_max, ensure_object, num_outputs, random_seed):
    """With ensure_object, of ten draws the first that varies as much as the frame does, else the one that varies most. Of
    several outputs a run gives one frame: the seed's; give other seeds for others.
    """
    rng, best = np.random.default_rng(int(random_seed)), None
    for _ in range(10 if ensure_object else 1):
        crop = _one_crop(rng, image, crop_width, crop_height, crop_ratio_min, crop_ratio_max)
        if best is None or crop.std() > best.std():
            best = crop
        if crop.std() >= image.std():
            return crop
    return best


def _one_crop(rng, image, crop_width, crop_height, crop_ratio_min, crop_ratio_max):
    ratio = rng.uniform(crop_ratio_min, crop_ratio_max)
    w, h = min(int(crop_width) or max(int(image.shape[1] * ratio), 1), image.shape[1]), min(int(crop_height) or max(int(image.shape[0] * ratio), 1), image.shape[0])
    x, y = rng.integers(0, image.shape[1] - w + 1), rng.integers(0, image.shape[0] - h + 1)
    return image[y : y + h, x : x + w]


@pair_op("Mixup", mix_ratio=0.5, blend_mode="linear", random_ratio="", random_seed=0)
def mixup(a, b, mix_ratio, blend_mode, random_ratio, random_seed):
    """With a random_ratio low,high the share is drawn from it."""
    if random_ratio:
        mix_ratio = np.random.default_rng(int(random_seed)).uniform(*(float(v) for v in random_ratio.split(",")))
    return clamp(mix_ratio * a + (1 - mix_ratio) * b)


@pair_op("ExposureCompensate", compensate="match", target_brightness=128)
def exposure(a, b, compensate, target_brightness):
    return clamp(a * ((b.mean() if compensate == "match" else target_brightness) / max(a.mean(), 1e-9)))


@pair_op("SeamBlend", blend_width=20, draw_seam=False)
def seam_blend(a, b, blend_width, draw_seam):
    """Side by side; the last columns of the first fade into the first columns of the second."""
    k = min(int(blend_width), a.shape[1])
    t = (np.arange(k) + 1) / (k + 1)
    mid = a[:, a.shape[1] - k :] * (1 - t)[None, :, None] + b[:, :k] * t[None, :, None]
    return np.concatenate((a[:, : a.shape[1] - k], clamp(mid), b[:, k:]), axis=1)


image_op("PowerSpectrum", log_scale=True, center_shift=True)(lambda image, log_scale, center_shift: _plane((np.log1p if log_scale else np.asarray)(abs((np.fft.fftshift if center_shift else np.asarray)(np.fft.fft2(gray(image)))) ** 2)))


@image_op("RemovePeriodicNoise", threshold_ratio=0.1, notch_radius=5)
def remove_periodic(image, threshold_ratio, notch_radius):
    """Peaks away from the middle of the spectrum are cut out, with what stands within the radius of them in both directions."""
    f = np.fft.fft2(gray(image).astype(np.float64))
    y, x = (np.fft.fftfreq(n) * n for n in f.shape)
    far = np.hypot(y[:, None], x[None, :]) > notch_radius
    peak = far & (abs(f) > threshold_ratio * abs(f).max())
    f[peak] = 0
    return clamp(np.fft.ifft2(f).real + 1e-6)[:, :, None]


@image_op("FrequencyEdgeEnhance", strength=1.0, direction=0.0)
def edge_enhance(image, strength, direction):
    gx, gy = gradient(gray(image))
    t = np.radians(direction)
    return clamp(image + strength * abs(gx * np.cos(t) + gy * np.sin(t))[:, :, None] / 8)


# --- contours: contour_id, seq, x, y


@table_op("SelectContours", "contours", "contour_id seq x y", min_length=10.0, max_length=10000.0, min_area=0.0, max_area=100000.0, min_circularity=0.0)
def select_contours(contours, min_length, max_length, min_area, max_area, min_circularity):
    from .measures import polygon_measure

    s = polygon_measure(contours, "contour_id", "seq")
    good = s.filter(F.col("perimeter").between(min_length, max_length) & F.col("area").between(min_area, max_area) & (F.col("circularity") >= min_circularity))
    return contours.join(good.select("contour_id"), "contour_id", "left_semi")


@table_op("SmoothContours", "contours", "contour_id seq x y", sigma=1.0)
def smooth_contours(contours, sigma):
    """Gaussian weights over neighbours in order; at the ends over those that exist."""
    k = max(int(np.ceil(3 * sigma)), 1)
    w = Window.partitionBy("contour_id").orderBy("seq")
    g = {d: float(np.exp(-d * d / (2 * sigma * sigma))) for d in range(-k, k + 1)}
    near = lambda c, d: F.lead(c, d).over(w) if d >= 0 else F.lag(c, -d).over(w)
    weight = sum((F.when(near("x", d).isNotNull(), v).otherwise(0.0) for d, v in g.items()), F.lit(0.0))
    mean = lambda c: sum((F.coalesce(near(c, d) * v, F.lit(0.0)) for d, v in g.items()), F.lit(0.0)) / weight
    return contours.select(*[c for c in contours.columns if c not in ("x", "y")], mean("x").alias("x"), mean("y").alias("y"))


def _turn(contours: DataFrame) -> DataFrame:
    w = Window.partitionBy("contour_id").orderBy("seq")
    a = F.atan2(F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w))
    b = F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x"))
    d = F.abs(b - a)
    return contours.withColumn("turn", F.when(d > F.pi(), F.pi() * 2 - d).otherwise(d))


@table_op("SegmentContours", "contours", "contour_id seq x y segment", curvature_threshold=0.5, min_segment_length=5.0)
def segment_contours(contours, curvature_threshold, min_segment_length):
    w = Window.partitionBy("contour_id").orderBy("seq")
    return _turn(contours).withColumn("segment", F.sum(F.when(F.col("turn") > curvature_threshold, 1).otherwise(0)).over(w)).drop("turn")


@table_op("CurvatureDescriptor", "contours", "point_count max_curvature mean_curvature std_curvature", num_points=64)
def curvature(contours, num_points):
    return _turn(contours).groupBy("contour_id").agg(F.count("*").alias("point_count"), F.max("turn").alias("max_curvature"), F.avg("turn").alias("mean_curvature"), F.stddev_pop("turn").alias("std_curvature"))


@table_op("ContourSignature", "contours", "sample_count max_distance min_distance mean_distance", num_samples=64)
def contour_signature(contours, num_samples):
    m = contours.groupBy("contour_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    return contours.join(m, "contour_id").groupBy("contour_id").agg(F.count("*").alias("sample_count"), F.max(d).alias("max_distance"), F.min(d).alias("min_distance"), F.avg(d).alias("mean_distance"))


# --- clouds: a cloud is one group, as a frame is


def fit_plane(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    c = p.mean(0)
    n = np.linalg.svd(p - c, full_matrices=False)[2][-1]
    n = n * (1 if n[np.argmax(abs(n))] > 0 else -1)
    return c, n, float(np.sqrt((((p - c) @ n) ** 2).mean()))


@table_op("plane_detection", "pointcloud", "center_x center_y center_z normal_x normal_y normal_z fit_error inliers", "pcl_plane_segmentation", distance_threshold=0.01, max_iterations=100)
def plane_detection(pointcloud, distance_threshold, max_iterations):
    """The plane through three of a cloud's points, of seeded choice, that most points are near; refined over those."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        p, rng, best = pdf[list(AXES)].to_numpy(float), np.random.default_rng(0), None
        for _ in range(int(max_iterations) if len(p) >= 3 else 0):
            a, b, c = p[rng.choice(len(p), 3, replace=False)]
            n = np.cross(b - a, c - a)
            if (size := np.linalg.norm(n)) > 1e-12:
                near = abs((p - a) @ (n / size)) <= distance_threshold
                best = near if best is None or near.sum() > best.sum() else best
        if best is None:
            return pd.DataFrame(columns=[x.split()[0] for x in fields.split(", ")])
        c, n, error = fit_plane(p[best])
        return pd.DataFrame([[int(pdf.cloud_id.iloc[0]), *c, *n, error, int(best.sum())]], columns=[x.split()[0] for x in fields.split(", ")])

    fields = "cloud_id long, center_x double, center_y double, center_z double, normal_x double, normal_y double, normal_z double, fit_error double, inliers long"
    return pointcloud.select("cloud_id", "point_id", *AXES).groupBy("cloud_id").applyInPandas(one, fields)


@table_op("pointcloud_normals", "pointcloud", "cloud_id point_id nx ny nz curvature", "pcl_normal_estimation", search_radius=0.05)
def normals(pointcloud, search_radius):
    """From the covariance of the neighbours, summed natively; only the 3 x 3 eigenvectors are taken in numpy."""
    near = neighbours(pointcloud, search_radius)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    d = {a: F.col("o" + a) - F.col(a) for a in AXES}
    s = near.groupBy("cloud_id", "point_id").agg(F.count("*").alias("n"), *[F.avg(d[a]).alias("m" + a) for a in AXES], *[F.avg(d[a] * d[b]).alias(a + b) for a, b in pairs])

    def solve(batches):
        for b in batches:
            m = b[["mx", "my", "mz"]].to_numpy()
            full = np.empty((len(b), 3, 3))
            for a, c in pairs:
                i, j = AXES.index(a), AXES.index(c)
                full[:, i, j] = full[:, j, i] = b[a + c].to_numpy() - m[:, i] * m[:, j]
            values, vectors = np.linalg.eigh(full)
            v = vectors[:, :, 0]
            v = v * np.where(v[np.arange(len(v)), abs(v).argmax(1)] < 0, -1, 1)[:, None]
            out = b[["cloud_id", "point_id"]].copy()
            out["nx"], out["ny"], out["nz"] = v.T
            out["curvature"] = np.maximum(values[:, 0], 0) / np.maximum(values.sum(1), 1e-12)
            yield out

    return s.mapInPandas(solve, "cloud_id long, point_id long, nx double, ny double, nz double, curvature double")


@table_op("icp_register", "source target", "r11 r12 r13 r21 r22 r23 r31 r32 r33 tx ty tz rmse", "pcl_icp_registration", max_iterations=50, tolerance=0.000001, max_distance=1.0)
def icp(source, target, max_iterations, tolerance, max_distance):
    """Rigid motion of each source cloud onto the target cloud of the same id: nearest points, then the best rotation, until it stands."""
    fields = "cloud_id long, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", tx double, ty double, tz double, rmse double"

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in fields.split(", ")]
        p, q = a[list(AXES)].to_numpy(float), b[list(AXES)].to_numpy(float)
        if not len(p) or not len(q):
            return pd.DataFrame(columns=names)
        r, t, before = np.eye(3), np.zeros(3), np.inf
        for _ in range(int(max_iterations)):
            moved = p @ r.T + t
            at, gap = np.empty(len(p), int), np.empty(len(p))
            for i in range(0, len(p), 512):  # bounded memory
                d = ((moved[i : i + 512, None] - q[None]) ** 2).sum(2)
                at[i : i + 512], gap[i : i + 512] = d.argmin(1), d.min(1)
            near = gap <= max_distance**2
            if near.sum() < 3:
                break
            x, y = p[near], q[at[near]]
            u, _, v = np.linalg.svd((x - x.mean(0)).T @ (y - y.mean(0)))
            r = v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T
            t = y.mean(0) - r @ x.mean(0)
            error = float(np.sqrt(gap[near].mean()))
            if abs(before - error) < tolerance:
                break
            before = error
        return pd.DataFrame([[int(a.cloud_id.iloc[0]), *r.ravel(), *t, error if near.sum() >= 3 else np.nan]], columns=names)

    return source.select("cloud_id", *AXES).groupBy("cloud_id").cogroup(target.select("cloud_id", *AXES).groupBy("cloud_id")).applyInPandas(one, fields)


# --- photometric stereo: pixels (frame_id, light_id, y, x, v) and lights (light_id, lx, ly, lz)


@table_op("photometric_stereo_reconstruct", "pixels lights", "nx ny nz albedo", estimate_albedo=True, normalize_result=True)
def photometric(pixels, lights, estimate_albedo, normalize_result):
    """Least squares per pixel over its lights: nine sums and the inverse of a symmetric 3 x 3 matrix, in columns."""
    j = pixels.join(lights, "light_id")
    s = j.groupBy("frame_id", "y", "x").agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for n, a, b in (("a", "lx", "lx"), ("b", "lx", "ly"), ("c", "lx", "lz"), ("d", "ly", "ly"), ("e", "ly", "lz"), ("f", "lz", "lz"), ("p", "lx", "v"), ("q", "ly", "v"), ("r", "lz", "v"))])
    a, b, c, d, e, f, p, q, r = (F.col(k) for k in "abcdefpqr")
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    g = [(p * (d * f - e * e) + q * (c * e - b * f) + r * (b * e - c * d)) / det, (p * (c * e - b * f) + q * (a * f - c * c) + r * (b * c - a * e)) / det, (p * (b * e - c * d) + q * (b * c - a * e) + r * (a * d - b * b)) / det]
    s = s.filter(F.abs(det) > 1e-12).select("frame_id", "y", "x", *[v.alias(k) for k, v in zip(("gx", "gy", "gz"), g, strict=True)])
    size = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    unit = lambda k: F.when(size > 0, F.col(k) / size).otherwise(0.0)
    return s.select("frame_id", "y", "x", unit("gx").alias("nx"), unit("gy").alias("ny"), unit("gz").alias("nz"), size.alias("albedo"))


@table_op("surface_gradient", "normals", "p q", gradient_scale=1.0)
def surface_gradient(normals, gradient_scale):
    slope = lambda c: F.when(F.abs("nz") > 1e-9, -F.col(c) / F.col("nz") * gradient_scale).otherwise(0.0)
    return normals.select("*", slope("nx").alias("p"), slope("ny").alias("q"))
