"""Segmentation, features, contours, sub-pixel edges, stitching, stereo and reconstruction on known answers."""

import time

import numpy as np

from lumenflow.functions import apply
from lumenflow.operators import features, reconstruct
from lumenflow.operators.clouds import rotation
from lumenflow.operators.reconstruct import delaunay
from tests.test_operators import frames
from tests.test_scene import cloud


def kernel(type_id, p, **params):
    from lumenflow.spec import find

    op = find(type_id)
    return op.kernel(np.atleast_3d(p).astype(np.uint8), **op.bind(params))


def textured(h=60, w=80, seed=5):
    v = np.random.default_rng(seed).integers(0, 255, (h // 4 + 2, w // 4 + 2))
    return np.kron(v, np.ones((4, 4), int))[:h, :w]


def test_segments(spark):
    halves = np.full((20, 40), 50)
    halves[:, 20:] = 200
    k = kernel("KMeansSegment", halves, k=2)
    assert set(np.unique(k)) == {50, 200} and (k[:, :, 0] == halves).all()
    assert len(np.unique(kernel("Watershed", halves))) == 2
    m = kernel("RegionSplitMerge", halves)[:, :, 0]
    assert (m == halves).all()
    g = kernel("GraphCut", halves, fg_seed_x=30, fg_seed_y=5, bg_seed_x=5, bg_seed_y=5)[:, :, 0]
    assert g[:, 25:].all() and not g[:, :15].any()
    assert np.allclose(kernel("FFTInverse", kernel_float(halves))[:, :, 0], halves)


def kernel_float(p):
    from lumenflow.spec import find

    return _keep(find("FFTForward").kernel(np.atleast_3d(p).astype(np.uint8)))


class _keep(np.ndarray):
    def __new__(cls, v):
        return np.asarray(v).view(cls)

    def astype(self, *_):
        return np.asarray(self)


def test_corners_and_contours():
    box = np.zeros((40, 50), int)
    box[10:30, 15:40] = 255
    found = {(c["x"], c["y"]) for c in features.fast(np.atleast_3d(box).astype(np.uint8), 20, 100, True)}
    assert all(any(abs(x - a) <= 1 and abs(y - b) <= 1 for a, b in found) for x, y in ((15, 10), (39, 10), (15, 29), (39, 29)))
    (path,) = features.trace(box > 0)
    assert len(path) == 2 * (20 + 25) - 4 and set(map(tuple, path.tolist())) == {(x, y) for y in range(10, 30) for x in range(15, 40) if x in (15, 39) or y in (10, 29)}
    assert len(features.simplify(np.concatenate((path, path[:1])), 1.0)) == 5
    ring = box.copy()
    ring[15:20, 20:25] = 0
    rows = features.hierarchy(np.atleast_3d(ring).astype(np.uint8), True)
    assert [(r["is_hole"], r["parent_id"], r["area"]) for r in rows] == [(False, 0, 475), (True, 1, 25)]
    f = features.fourier(np.atleast_3d(box).astype(np.uint8), 8)
    moved = features.fourier(np.atleast_3d(np.roll(box, 3, 1)).astype(np.uint8), 8)
    assert np.allclose([r["magnitude"] for r in f], [r["magnitude"] for r in moved])


def test_subpixel(spark):
    y, x = np.indices((100, 100))
    disc = 50 + 150 * np.clip(30.3 - np.hypot(x - 49.7, y - 50.4) + 0.5, 0, 1)
    (c,) = apply("SubpixelCircle", frames(spark, np.round(disc).astype(int))).collect()
    assert c.valid and abs(c.center_x - 49.7) < 0.05 and abs(c.center_y - 50.4) < 0.05 and abs(c.radius - 30.3) < 0.2
    edge = np.round(50 + 150 * np.clip(x - 40.25 + 0.5, 0, 1)).astype(int)
    (s,) = apply("SubpixelLine", frames(spark, edge)).collect()
    assert s.valid and abs(abs(s.line_c / s.line_a) - 40) < 0.6
    (f,) = apply("FindCircles", frames(spark, np.round(disc).astype(int))).collect()
    assert abs(f.radius - 30.3) < 0.3
    (k,) = apply("CaliperFitLine", frames(spark, edge), roi_x=20.0, roi_y=20.0, roi_width=40.0, roi_height=20.0).collect()
    assert k.valid and k.point_count == 20 and abs(k.line_angle - 90) < 1


def test_frames_are_matched_and_stitched(spark):
    p = textured(60, 120)
    a, b = p[:, :80], p[:, 30:110]
    (r,) = apply("ImageRegister", frames(spark, a), frames(spark, b)).collect()
    assert r.success and (r.shift_x, r.shift_y) == (30, 0)
    (s,) = apply("ImageStitch", frames(spark, a), frames(spark, b)).collect()
    assert (s.width, s.height) == (110, 60) and np.abs(np.frombuffer(s.data, np.uint8).reshape(60, 110).astype(int) - p[:, :110]).max() <= 1
    (h,) = apply("HomographyCalc", frames(spark, a), frames(spark, b), ransac_iter=50).collect()
    assert h.valid and abs(h.h13 - 30) < 0.5 and abs(h.h11 - 1) < 0.02
    (m,) = apply("MosaicStitch", frames(spark, a), frames(spark, a), frames(spark, a), cols=2).collect()
    assert (m.width, m.height) == (160, 120)
    lost = apply("FeatureTrack", frames(spark, a), frames(spark, np.roll(a, 1, 1))).filter("not is_lost").collect()
    assert np.median([t.new_x - t.x for t in lost]) > 0.7


def test_checkerboard(spark):
    y, x = np.indices((100, 100))
    board = np.where((y // 20 + x // 20) % 2, 230, 20)
    (c,) = apply("CheckerboardDetect", frames(spark, board), pattern_rows=5, pattern_cols=5).collect()
    assert c.pattern_found and c.corner_count == 16
    pts = apply("CalibrationPointsExtract", frames(spark, board), pattern_rows=5, pattern_cols=5).collect()
    assert np.allclose([(p.x, p.y) for p in pts], [(19.5 + 20 * (k % 4), 19.5 + 20 * (k // 4)) for k in range(16)], atol=0.6)


def test_stereo():
    from lumenflow.spec import find

    p = np.random.default_rng(1).integers(0, 255, (30, 60)).astype(np.uint8)
    right = np.roll(p, -5, 1)
    for name in ("stereo_match_ncc", "stereo_match_sgbm"):
        op = find(name)
        step = next(c.cell_contents for c in op.plan.__closure__ if callable(c.cell_contents))
        d = step(p[:, :, None], right[:, :, None], **op.bind({"num_disparities": 16}))
        assert (d[5:-5, 20:-10, 0] == 5).mean() > 0.95


def test_clusters_of_points(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate((rng.uniform(0, 0.05, (40, 3)), rng.uniform(1, 1.05, (30, 3)), [[5, 5, 5]]))
    rows = apply("pointcloud_cluster", cloud(spark, p), tolerance=0.05).orderBy("cluster").collect()
    assert [(r.cluster, r.n) for r in rows] == [(0, 40), (40, 30)]
    faces = apply("marching_cubes", cloud(spark, [[0.5, 0.5, 0.5], [1.5, 0.5, 0.5]]), voxel_size=1.0)
    assert faces.count() == 10


def test_registration_finds_the_motion(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1, 1, (150, 3)) * (3, 2, 1) + np.where(rng.uniform(size=(150, 1)) < 0.3, 1.0, 0.0)
    r, t = np.array(rotation(50, -30, 70)), np.array([2.0, -1.0, 0.5])
    for name, turn, shift in (("global_register", r, t), ("feature_register", r, t), ("ndt_register", np.array(rotation(2, 1, -2)), t * 0.02)):
        params = {"voxel_size": 1.0} if name == "ndt_register" else {}
        (m,) = apply(name, cloud(spark, p), cloud(spark, p @ turn.T + shift), **params).collect()
        tol = 0.05 if name == "ndt_register" else 1e-6
        assert np.allclose([m[f"r{i}{j}"] for i in (1, 2, 3) for j in (1, 2, 3)], turn.ravel(), atol=tol), name


def test_nearest_points_are_those_of_all_pairs_and_large_clouds_are_registered_soon():
    rng = np.random.default_rng(6)
    for n in (1, 5, 13, 300):
        for d in (2, 3, 5):
            for q in (rng.normal(size=(n, d)), rng.integers(0, 3, (n, d)).astype(float), np.ones((n, d))):  # also ties and equal points
                p = np.concatenate((rng.normal(size=(40, d)) * 2, q[:20]))
                gaps = np.sqrt(((p[:, None] - q) ** 2).sum(2))
                for guess in (None, rng.integers(0, n, len(p))):
                    at, gap = reconstruct._Near(q)(p, guess)
                    assert (at == gaps.argmin(1)).all() and (gap == gaps.min(1)).all()
    p = rng.normal(size=(3000, 3)) * (3, 2, 1)
    turn = np.array(rotation(50, -30, 70))
    began = time.time()
    for noise in (0.0, 0.01):
        r, t, error = reconstruct._by_axes(p, p @ turn.T + (2, -1, 0.5) + rng.normal(size=p.shape) * noise, 50, 1e-9)
        assert np.allclose(r, turn, atol=1e-9 + noise / 5) and np.allclose(t, (2, -1, 0.5), atol=1e-9 + noise / 5) and error <= 2 * noise + 1e-12
    assert time.time() - began < 20


def test_delaunay_is_empty_of_other_points():
    p = np.random.default_rng(4).uniform(0, 1, (40, 2))
    t = delaunay(p)
    for a, b, c in t:
        m = np.array([p[b] - p[a], p[c] - p[a]]) * 2
        o = np.linalg.solve(m, [(p[b] ** 2 - p[a] ** 2).sum(), (p[c] ** 2 - p[a] ** 2).sum()])
        assert (np.hypot(*(p - o).T) >= np.hypot(*(p[a] - o)) - 1e-9).all()
    from lumenflow.operators.measures import hull

    assert len(t) >= 2 * 40 - 2 - len(hull(p)) - 2


def test_delaunay_reaches_the_hull_of_flat_even_equal_and_many_points():
    x = np.linspace(-1, 1, 41)
    assert len(delaunay(np.stack((x, x * x * 1e-4), 1))) == 39  # all of them on the hull
    y, x = np.divmod(np.arange(56), 8)
    even = np.stack((x, y), 1) * 0.1  # many points on each circle
    t = delaunay(even)
    (ax, ay), (bx, by), (cx, cy) = (even[t[:, k]].T for k in range(3))
    assert len(t) == 2 * 7 * 6 and np.isclose(abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).sum() / 2, 0.7 * 0.6)
    assert len(delaunay(np.stack((x, x * 0.5), 1))) == 0 and len(delaunay(np.full((5, 2), 2.0))) == 0
    odd = np.array([[0, 0], [1, 0], [0, 0], [0, 1], [np.nan, 3]])
    assert delaunay(odd).tolist() == [[0, 1, 3]]
    many = np.random.default_rng(8).normal(size=(5000, 2))
    began = time.time()
    t = delaunay(many)
    assert time.time() - began < 10
    from lumenflow.operators.measures import hull

    assert len(t) == 2 * 5000 - 2 - len(hull(many))


def test_hand_eye(spark):
    rng = np.random.default_rng(6)

    def pose(turn, shift):
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = rotation(*turn), shift
        return m

    eye, target = pose((10, 20, 30), (0.1, 0.2, 0.3)), pose((5, 5, 5), (1, 2, 3))
    rows = []
    for k in range(6):
        hand = pose(rng.uniform(-60, 60, 3), rng.uniform(-1, 1, 3))
        camera = np.linalg.inv(hand @ eye) @ target
        rows.append((1, k, *[float(v) for m in (hand, camera) for v in (*m[:3, :3].ravel(), *m[:3, 3])]))
    from lumenflow.operators.reconstruct import _POSE

    poses = spark.createDataFrame(rows, "rig_id long, pose_id long, " + ", ".join(f"{c} double" for c in _POSE))
    found = apply("hand_eye_calibration", poses)
    (x,) = found.collect()
    assert x.is_valid and np.allclose([x[f"r{i}{j}"] for i in (1, 2, 3) for j in (1, 2, 3)] + [x.tx, x.ty, x.tz], [*eye[:3, :3].ravel(), *eye[:3, 3]], atol=1e-6)
    assert all(np.allclose([e.tx, e.ty, e.tz], [1, 2, 3], atol=1e-6) for e in apply("hand_eye_pose_estimate", poses, found).collect())
    assert apply("hand_eye_verify", poses, found).first().is_valid


def test_heights_and_curvature(spark):
    rows = [(1, y, x, 2.0, -1.0) for y in range(4) for x in range(5)]
    g = spark.createDataFrame(rows, "frame_id long, y int, x int, p double, q double")
    h = {(r.y, r.x): r.height for r in apply("surface_height_reconstruct", g).collect()}
    assert all(abs(h[y, x] - (2 * x - y + 3)) < 1e-9 for y, x in h)
    assert all(abs(r.mean_curvature) < 1e-12 for r in apply("surface_curvature", g).collect())


def test_contours_from_numbers(spark):
    v = spark.createDataFrame([(1, "0,4, 4", "0,0,3"), (2, None, "1")], "contour_id long, vertices_x string, vertices_y string")
    assert [(r.contour_id, r.seq, r.x, r.y) for r in apply("GenPolygonContour", v).orderBy("seq").collect()] == [(1, 0, 0, 0), (1, 1, 4, 0), (1, 2, 4, 3), (1, 3, 0, 0)]
    assert apply("GenCrossContour", spark.createDataFrame([(1, 5.0, 6.0)], "contour_id long, x double, y double"), size=4.0).count() == 5


def test_model_measures_a_disc(spark):
    y, x = np.indices((200, 200))
    m = apply("MeasureModelAddCircle", apply("MeasureModelCreate", spark.createDataFrame([("m",)], "model_id string")), radius=28.0)
    (r,) = apply("MeasureModelApply", frames(spark, np.where(np.hypot(x - 101, y - 99) <= 30, 200, 50)), m).collect()
    assert r.valid and abs(r.value - 30.5) < 1 and abs(r.x - 101) < 0.5


def test_remap_moves_samples(spark):
    from lumenflow.frames import map_images

    p = frames(spark, np.arange(12).reshape(3, 4))
    x = map_images(p, lambda i: np.tile(np.arange(i.shape[1])[::-1].astype(np.float32), (i.shape[0], 1))[:, :, None])
    y = map_images(p, lambda i: np.tile(np.arange(i.shape[0])[:, None].astype(np.float32), (1, i.shape[1]))[:, :, None])
    (r,) = apply("Remap", p, x, y).collect()
    assert list(r.data) == [3, 2, 1, 0, 7, 6, 5, 4, 11, 10, 9, 8]


def test_checkpoints_that_stay(spark):
    c = spark.createDataFrame([(1, k, abs(k - 7) + 1.0) for k in range(0, 40)], "run_id long, step long, loss double")
    kept = {r.step for r in apply("TrainCheckpoint", c).filter("kept").collect()}
    assert kept == {7, 15, 20, 25, 30, 35}
