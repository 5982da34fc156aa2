"""Registration, planes, photometric stereo, calibration and labels on known answers."""

import numpy as np

from lumenflow.functions import apply
from lumenflow.operators.clouds import rotation


def cloud(spark, p, k=0):
    return spark.createDataFrame([(k, i, *map(float, v)) for i, v in enumerate(p)], "cloud_id long, point_id long, x double, y double, z double")


def test_icp_finds_a_small_motion(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1, 1, (200, 3))
    r, t = np.array(rotation(2.0, -3.0, 4.0)), np.array([0.02, -0.01, 0.03])
    (m,) = apply("icp_register", cloud(spark, p), cloud(spark, p @ r.T + t)).collect()
    assert np.allclose([m[f"r{i}{j}"] for i in (1, 2, 3) for j in (1, 2, 3)], r.ravel(), atol=1e-6) and np.allclose([m.tx, m.ty, m.tz], t, atol=1e-6)


def test_plane_and_normals(spark):
    rng = np.random.default_rng(4)
    flat = np.column_stack((rng.uniform(-1, 1, (150, 2)), np.zeros(150)))
    p = np.concatenate((flat, rng.uniform(-1, 1, (30, 3)) + [0, 0, 2.5]))
    (f,) = apply("plane_detection", cloud(spark, p)).collect()
    assert f.inliers >= 150 and abs(f.normal_z) > 0.999
    assert all(abs(r.nz) > 0.999 and r.curvature < 1e-6 for r in apply("pointcloud_normals", cloud(spark, flat), search_radius=0.5).collect())


def test_photometric_normal(spark):
    n, lights = np.array([0.36, 0.48, 0.8]), [(0, 0.0, 0.0, 1.0), (1, 0.6, 0.0, 0.8), (2, 0.0, 0.6, 0.8), (3, -0.6, 0.0, 0.8)]
    pixels = spark.createDataFrame([(1, k, 0, 0, float(100 * n @ v)) for k, *v in lights], "frame_id long, light_id int, y int, x int, v double")
    (r,) = apply("photometric_stereo_reconstruct", pixels, spark.createDataFrame(lights, "light_id int, lx double, ly double, lz double")).collect()
    assert np.allclose([r.nx, r.ny, r.nz, r.albedo], [*n, 100])


def test_calibration_recovers_the_map(spark):
    rows = [(1, float(x), float(y), 2.0 * x - y + 5, 0.5 * x + 3 * y - 1) for x in range(3) for y in range(3)]
    (c,) = apply("NinePointCalibration", spark.createDataFrame(rows, "camera_id long, x double, y double, world_x double, world_y double")).collect()
    assert np.allclose([c.a, c.b, c.c, c.d, c.e, c.f, c.error], [2, -1, 5, 0.5, 3, -1, 0], atol=1e-6) and c.valid
    (c,) = apply("NinePointCalibration", spark.createDataFrame(rows[:2], "camera_id long, x double, y double, world_x double, world_y double")).collect()
    assert not c.valid


def test_model_gathers_objects(spark):
    m = apply("MeasureModelCreate", spark.createDataFrame([("m",)], "model_id string"))
    m = apply("MeasureModelAddCircle", apply("MeasureModelAddLine", m, length=80.0), object_id="c")
    (r,) = m.collect()
    assert [(o.object_id, o.kind) for o in r.objects] == [("line1", "line"), ("c", "circle")] and r.objects[0].params["length"] == 80


def test_square_contour_has_four_corners(spark):
    side = [(x, 0) for x in range(5)] + [(5, y) for y in range(5)] + [(5 - x, 5) for x in range(5)]
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(side)], "contour_id long, seq long, x double, y double")
    assert apply("SegmentContours", df).agg({"segment": "max"}).first()[0] == 2
    assert apply("SelectContours", df, max_area=1.0).count() == 0
