import random

import numpy as np
import pytest

from lumenflow.frames import map_images
from lumenflow.functions import apply
from lumenflow.operators import models as M
from lumenflow.operators import reconstruct as R
from lumenflow.spec import FlowError

FRAME = "frame_id long, width int, height int, channels int, format string, timestamp_us long, source_id string, data binary"


def frames(spark, *images):
    return spark.createDataFrame([(i, v.shape[1], v.shape[0], 1, "Mono8", 0, "t", bytearray(v.tobytes())) for i, v in enumerate(images)], FRAME)


def square(at, size=60):
    v = np.full((size, size), 40, np.uint8)
    v[at[0] : at[0] + 12, at[1] : at[1] + 20] = 200
    return v


def test_shape_model_is_found_where_it_moved(spark, tmp_path):
    model = apply("CreateShapeModel", frames(spark, square((20, 20))), roi_x=15, roi_y=15, roi_width=31, roi_height=23)
    assert model.first()["num_edges"] > 50
    scenes = frames(spark, square((20, 20)), square((31, 12)), np.rot90(square((20, 20))).copy(), np.full((60, 60), 9, np.uint8))
    at = {r["frame_id"]: r for r in apply("FindShapeModel", scenes, model, angle_extent=1.0).collect()}
    assert (at[0]["x"], at[0]["y"], at[0]["score"]) == (30, 26, 1.0) and (at[1]["x"], at[1]["y"]) == (22, 37)
    assert 2 not in at
    at = {r["frame_id"]: r for r in apply("FindShapeModel", scenes, model, angle_step=90.0).collect()}
    assert at[2]["angle"] in (90.0, 270.0) and at[2]["score"] > 0.9 and 3 not in at
    assert apply("WriteShapeModel", model, filepath=str(tmp_path / "m")).first()["success"]


def test_key_points_stand_on_a_blob(spark):
    y, x = np.mgrid[:64, :64]
    v = (40 + 200 * np.exp(-((x - 30) ** 2 + (y - 34) ** 2) / 18)).astype(np.uint8)
    got = apply("SIFT", frames(spark, v)).collect()
    assert got and abs(got[0]["x"] - 30) <= 2 and abs(got[0]["y"] - 34) <= 2


def test_characters(spark, tmp_path):
    text = frames(spark, M.write_text("A7Q0"), M.write_text("2031", 5))
    assert [r["text"] for r in apply("MixedOCR", text).orderBy("frame_id").collect()] == ["A7Q0", "2031"]
    assert apply("DigitOCR", text).orderBy("frame_id").collect()[1]["confidence"] == 100
    assert apply("OCR", text, whitelist="2301").orderBy("frame_id").collect()[1]["text"] == "2031"
    path = str(tmp_path / "glyphs")
    zoo = np.kron(np.random.default_rng(1).integers(0, 2, (7, 7)), np.ones((4, 4))).astype(bool)
    zoo[:, [0, -1]] = True
    image = np.pad(np.where(zoo, 0, 255).astype(np.uint8), 6, constant_values=255)
    assert apply("OCRTrain", frames(spark, image), label="漢", model_path=path).count() == 1
    assert apply("OCRModel", model_path=path).first()["model_size"] == 1
    assert apply("ChineseOCR", frames(spark, image), model_path=path).first()["text"] == "漢"
    assert apply("FontTrain", frames(spark, M.write_text("AB")), char_set="AB").count() == 2


def test_suppression_against_pairs():
    rng = random.Random(2)
    for _ in range(50):
        boxes = np.array([[rng.randint(0, 40), rng.randint(0, 40), rng.randint(5, 30), rng.randint(5, 30)] for _ in range(30)])
        scores, classes = np.array([round(rng.random(), 2) for _ in boxes]), np.array([rng.randint(0, 1) for _ in boxes])
        kept = M.suppressed(boxes, scores, classes, 0.2, 0.45).tolist()

        def iou(i, j, boxes=boxes):
            (x, y, w, h), (a, b, c, d) = boxes[i], boxes[j]
            n = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
            return n / (w * h + c * d - n)

        for i in range(len(boxes)):
            clash = [j for j in kept if j != i and classes[i] == classes[j] and iou(i, j) > 0.45 and (-scores[j], j) < (-scores[i], i)]
            assert (i in kept) == (scores[i] >= 0.2 and not clash)


def test_models_are_functions_by_name(spark):
    with pytest.raises(FlowError):
        M.model_of("nothing")
    assert apply("ONNXInference", frames(spark, np.full((4, 6), 9, np.uint8))).collect()[0]["value"] == 9
    assert apply("ExportONNX", spark.createDataFrame([("m",)], "model_info string")).first()["export_status"] is False


def test_rectified_frames_turn_back(spark):
    left = frames(spark, square((20, 20)))
    same = apply("stereo_rectify", left, left).collect()
    assert same[0]["data"] == same[1]["data"]
    turned = apply("stereo_rectify", left, left, rz=90.0).filter("source_id LIKE '%right'").first()
    got = np.frombuffer(turned["data"], np.uint8).reshape(60, 60)
    assert (got == np.rot90(square((20, 20)), 1)).mean() > 0.99 or (got == np.rot90(square((20, 20)), -1)).mean() > 0.99


def test_cameras_and_poses(spark):
    rng = np.random.default_rng(5)
    grid = np.array([(x * 25.0, y * 25.0) for y in range(6) for x in range(9)])
    rel = np.eye(4)
    rel[:3, :3], rel[:3, 3] = R._turn(np.array([0.02, -0.1, 0.05])), [-60, 2, 5]
    rows, poses = [], []
    for view in range(4):
        first = np.eye(4)
        first[:3, :3], first[:3, 3] = R._turn(rng.normal(0, 0.3, 3)), [-80 + 20 * view, -60, 700]
        for camera, pose in enumerate((first, rel @ first)):
            p = np.column_stack((grid, np.zeros(len(grid)))) @ pose[:3, :3].T + pose[:3, 3]
            rows += [(1, camera, view, float(u), float(v), float(a), float(b)) for (u, v), (a, b) in zip(p[:, :2] / p[:, 2:] * 1000 + [320, 240], grid, strict=True)]
            wrong = pose.copy()
            wrong[:3, 3] += 3
            poses.append((1, camera, view, *map(float, wrong[:3, :3].ravel()), *map(float, wrong[:3, 3])))
    corners = spark.createDataFrame(rows, "rig_id long, camera_id long, view_id long, u double, v double, wx double, wy double")
    for name, params in (("multi_camera_calibrate", {}), ("calibrate_cameras", {}), ("stereo_calibrate_extended", {"min_images": 4})):
        r = apply(name, corners, **params).filter("camera_id = 1").first()
        assert np.allclose([r["tx"], r["ty"], r["tz"]], rel[:3, 3], atol=1e-3) and abs(r["r12"] - rel[0, 1]) < 1e-6 and r["reprojection_error"] < 1e-4
    assert apply("stereo_calibrate_extended", corners).count() == 0
    schema = "rig_id long, camera_id long, view_id long, " + R._MATRIX
    got = apply("calibration_refine", spark.createDataFrame(poses, schema), corners).collect()
    assert len(got) == 8 and all(r["initial_error"] > 1 and r["refined_error"] < 1e-3 for r in got)


def test_clouds_come_together(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(0, 1, (120, 3))
    q = p @ np.array([[0.995, -0.0998, 0], [0.0998, 0.995, 0], [0, 0, 1]]).T + [0.05, 0, 0.02]
    rows = [(c, i, *map(float, v)) for c, cloud in enumerate((p, q, q[::-1])) for i, v in enumerate(cloud)]
    got = apply("PointCloudGlobalRegistration", spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")).toPandas()
    assert len(got) == 360
    moved = got[got.cloud_id == 1].sort_values("point_id")[["x", "y", "z"]].to_numpy()
    assert np.abs(moved - p).max() < 0.02


def test_components(spark):
    v = np.full((60, 60), 10, np.uint8)
    v[25:50, 22:48] = 220
    got = apply("InspectComponent", frames(spark, v, np.full((60, 60), 10, np.uint8)), expected_x=24, expected_y=27, tolerance=5.0).orderBy("frame_id").collect()
    assert got[0]["all_found"] and got[0]["inspection_result"] == "Found" and not got[1]["all_found"]
    assert map_images(frames(spark, v), lambda x: x).count() == 1
