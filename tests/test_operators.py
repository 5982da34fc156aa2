"""Operators against small frames and shapes with known answers."""

import numpy as np
import pytest

from lumenflow import spec
from lumenflow.frames import SCHEMA, from_pixels, gradient_frames, image_of, to_pixels
from lumenflow.functions import apply
from lumenflow.operators import images, measures
from lumenflow.spec import FlowError

spec.load()


def frames(spark, *planes):
    return spark.createDataFrame([(k, p.shape[1], p.shape[0], 1 if p.ndim == 2 else p.shape[2], "Mono8" if p.ndim == 2 else "RGB8", 0, "", bytearray(p.astype(np.uint8).tobytes())) for k, p in enumerate(planes)], SCHEMA)


def pixels_of(df):
    return {r["frame_id"]: image_of(r.asDict()) for r in df.collect()}


def square(value=200, back=50):
    p = np.full((300, 300), back)
    p[100:200, 100:200] = value
    return p


def disc(n=101, r=40):
    y, x = np.mgrid[:n, :n] - n // 2
    return np.where(x * x + y * y <= r * r, 200, 0)


def test_gradient_and_round_trip(spark):
    df = gradient_frames(spark, 2, 16, 4)
    got = pixels_of(df)
    assert (got[0][0, :, 0] == np.arange(16) * 255 // 15).all()
    assert pixels_of(from_pixels(to_pixels(df)))[1].tolist() == got[1].tolist()


def test_square_is_one_blob(spark):
    on = apply("SimpleThreshold", frames(spark, square()))
    (b,) = apply("BlobAnalysis", on).collect()
    assert (b.area, b.x, b.y, b.width, b.height) == (10000, 100, 100, 100, 100)


def test_constant_frame(spark):
    (h,) = apply("CogHistogram", frames(spark, np.full((8, 8), 128))).collect()
    assert (h.mean, h.std_dev, h.entropy, h.median) == (128, 0, 0, 128)


def test_disc_measures(spark):
    (s,) = apply("ShapeFeatures", frames(spark, disc())).collect()
    assert abs(s.area - np.pi * 1600) < 30 and abs(s.anisometry - 1) < 0.01
    (c,) = apply("Convexity", frames(spark, disc())).collect()
    assert 0.95 < c.convexity <= 1


def test_hu_moments_do_not_turn(spark):
    p = np.zeros((60, 60))
    p[10:50, 20:30] = 255
    p[10:20, 20:45] = 255
    a, b = apply("HuMoments", frames(spark, p, np.rot90(p))).orderBy("frame_id").collect()
    assert np.allclose(a[1:], b[1:], atol=1e-9)


def test_step_edge_is_found(spark):
    p = np.where(np.arange(100) < 40, 50, 200)[None, :].repeat(60, 0)
    (c,) = apply("CaliperTool", frames(spark, p), start_x=0.0, start_y=30.0, end_x=99.0, end_y=30.0).collect()
    assert c.edge_count == 1 and abs(c.first_edge_x - 39.5) < 0.6


def test_median_and_opening_remove_a_speck():
    p = np.full((9, 9, 1), 10, np.uint8)
    p[4, 4] = 255
    assert (images.median_filter(p, 3) == 10).all()
    assert (images.morph(p, "Open", "Rect", 3, 1) == 10).all()


def test_holes_thinning_canny():
    p = square()[80:220, 80:220, None].astype(np.uint8)
    p[p == 50] = 0
    p[60:70, 60:70] = 0
    assert images.fill_holes(p)[65, 65] == 255
    thin = images.thinning(p, 200)
    assert 0 < (thin > 0).sum() < (p > 0).sum() / 5
    edges = images.canny(square()[:, :, None].astype(np.uint8), 50, 100)
    assert (edges > 0).sum() in range(350, 420)


def test_low_pass_keeps_the_mean_and_all_pass_keeps_all():
    p = np.random.default_rng(1).integers(40, 200, (16, 24, 1)).astype(np.uint8)
    assert (spec.find("IdealLowPass").kernel(p, cutoff_frequency=1.0) == p).all()
    assert abs(float(spec.find("GaussLowPass").kernel(p, sigma=1.0).mean()) - p.mean()) < 1


def test_rotate_and_resize():
    p = np.random.default_rng(2).integers(0, 255, (10, 14, 1)).astype(np.uint8)
    assert (images.rotate(p, 90.0, -1.0, -1.0, True) == np.rot90(p, -1)).all() or (images.rotate(p, 90.0, -1.0, -1.0, True) == np.rot90(p)).all()
    assert (images.resize(p, 0, 0, 1.0, 1.0, "bilinear") == p).all()


def test_labels_match_flood_fill():
    on = np.random.default_rng(3).random((30, 40)) < 0.5
    for eight in (False, True):
        labels, n = measures.label(on, eight)
        near = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
        for y, x in np.argwhere(on):
            for dy, dx in near:
                if 0 <= y + dy < 30 and 0 <= x + dx < 40 and on[y + dy, x + dx]:
                    assert labels[y, x] == labels[y + dy, x + dx]
        assert set(np.unique(labels)) == set(range(n + 1))


def test_pair_of_other_size_gives_nothing(spark):
    a, b = frames(spark, np.zeros((4, 4))), frames(spark, np.zeros((4, 5)))
    assert apply("ImageAdd", a, b).count() == 0


def test_null_frame_stays_null(spark):
    df = spark.createDataFrame([(1, 2, 2, 1, "Mono8", 0, "", None)], SCHEMA)
    assert apply("ImageNot", df).first()["data"] is None


def test_circle_and_line_fit(spark):
    t = np.linspace(0, 5, 40)
    rows = [(1, float(30 + 7 * np.cos(a)), float(-4 + 7 * np.sin(a))) for a in t] + [(2, 1.0, 1.0)]
    got = {r.object_id: r for r in apply("CircleFit", spark.createDataFrame(rows, "object_id long, x double, y double")).collect()}
    assert np.allclose([got[1].center_x, got[1].center_y, got[1].radius], [30, -4, 7]) and got[1].fit_error < 1e-5 and not got[2].is_valid
    rows = [(1, float(x), 2.0 * x + 1) for x in range(10)]
    (f,) = apply("LineFit", spark.createDataFrame(rows, "object_id long, x double, y double")).collect()
    assert abs(f.line_a * 3 + f.line_b * 7 + f.line_c) < 1e-9 and f.rms_error < 1e-9


def test_parameters():
    op = spec.find("SimpleThreshold")
    assert op.bind({"threshold": None, "max_value": "x"}) == {"threshold": 128, "max_value": 255}
    with pytest.raises(FlowError):
        op.bind({"nothing": 1})
    with pytest.raises(FlowError):
        spec.find("ImageSource")


def test_scalars_are_rounded_and_turned_as_the_sql_does_it(spark):
    import duckdb

    from lumenflow.operators import geometry
    from lumenflow.plans.catalog import rounded

    # Halves of the last place whose product with a million lies on either side, and numbers too large for it.
    values = [n / d for n in range(-4001, 4001, 37) for d in (640, 320, 1280, 11)] + [132.6609375, -0.0634665, 8.0515625, 0.4999995, 1e200, 1e305, -0.0]
    spread = spark.createDataFrame([(v,) for v in values], "x double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    for digits in (6, 3):
        want = sorted(v for (v,) in con.execute(f"SELECT round(x, {digits}) + 0.0 FROM t").fetchall())
        assert sorted(r.x for r in rounded(spread, digits, "x").collect()) == want
    # A map with a = -0.0 and d = 0: the angle of (-0.0, 0) is a half turn; and a nested call keeps its signs.
    points = "0.0::DOUBLE AS src_x1, 0.0::DOUBLE AS src_y1, 5.0::DOUBLE AS tgt_x1, 1.0::DOUBLE AS tgt_y1, 0.0::DOUBLE AS src_x2, 2.0::DOUBLE AS src_y2, 3.0::DOUBLE AS tgt_x2, 4.0::DOUBLE AS tgt_y2, 3.0::DOUBLE AS src_x3, 0.0::DOUBLE AS src_y3, 5.0::DOUBLE AS tgt_x3, 1.0::DOUBLE AS tgt_y3, 1 AS id"
    want = con.execute(geometry.sql("AffineTransformCalc", f"SELECT {points}", "id")).fetchall()
    got = apply("AffineTransformCalc", spark.sql("SELECT " + points.replace("::DOUBLE", "D"))).select("id", *spec.find("AffineTransformCalc").outputs).collect()
    assert want[0][9] == 180.0 and [tuple(r) for r in got] == want
    pairs = [(y, x) for y in (0.0, -0.0, 1.0, -2.0) for x in (0.0, -0.0, 1.0, -3.0)]
    e = geometry._signed("1.0+atan2(abs(y)*CASE WHEN pow(y,-1) < 0 THEN -1.0 ELSE 1.0 END,x)*2.0+atan2(y,greatest(x,x))")
    rows = spark.createDataFrame(pairs, "y double, x double").selectExpr(f"{e} AS v").collect()
    assert np.allclose([r.v for r in rows], [1 + 3 * np.arctan2(y, x) for y, x in pairs])
