"""Inspections on drawn products with known answers."""

import numpy as np

from lumenflow.functions import apply
from tests.test_operators import frames


def drawn(h, w, *boxes, back=20, front=220):
    p = np.full((h, w), back)
    for y, x, bh, bw in boxes:
        p[y : y + bh, x : x + bw] = front
    return p


def disc(p, cx, cy, r, v=220):
    y, x = np.indices(p.shape)
    p[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = v
    return p


def one(spark, type_id, p, **params):
    (row,) = apply(type_id, frames(spark, p), **params).collect()
    return row


def test_board(spark):
    trace = drawn(40, 80, (10, 5, 6, 70))
    trace[10:15, 40] = 20
    t = one(spark, "PCBTrace", trace)
    assert t.is_open and not t.is_short and (t.thinnest, t.widest) == (1, 6)
    assert not one(spark, "PCBTrace", drawn(40, 80, (10, 5, 6, 70))).is_open
    kinds = {r.kind for r in apply("PCBComponent", frames(spark, drawn(60, 60, (5, 5, 5, 30), (30, 30, 12, 12)))).collect()}
    assert kinds == {"resistor", "chip"}
    assert not one(spark, "PCBPad", disc(drawn(60, 60), 30, 30, 12)).is_defect


def test_wafer(spark):
    p = drawn(120, 160, back=120)
    p[40:80, 80:120] = 250
    dies = apply("WaferDie", frames(spark, p), die_width=40, die_height=40).collect()
    assert len(dies) == 12 and [(d.row, d.col) for d in dies if not d.is_good] == [(1, 2)]
    round_ = disc(drawn(200, 200), 100, 100, 80)
    assert one(spark, "WaferEdgeInspection", round_).chipping_count == 0
    round_[95:106, 160:] = 20
    e = one(spark, "WaferEdgeInspection", round_)
    assert e.notch_detected and e.chipping_count == 0
    streets = drawn(100, 100, back=200)
    streets[40:50] = 10
    (s,) = apply("WaferDicingInspection", frames(spark, streets), expected_width=10, detect_direction="horizontal").collect()
    assert (s.position, s.width, s.is_defect) == (44.5, 10, False)
    crack = drawn(80, 80, back=150)
    crack[40, 10:60] = 20
    assert [c.width for c in apply("WaferCrackDetection", frames(spark, crack)).collect()] == [50]


def test_counts_and_extents(spark):
    grid = drawn(100, 100, *[(10 + 20 * r, 10 + 20 * c, 8, 8) for r in range(4) for c in range(4)])
    assert one(spark, "PartPresence", grid, expected_parts=16).is_complete
    assert one(spark, "AssemblyVerification", grid, expected_parts=17).missing_parts == 1
    c = one(spark, "ConnectorInspection", grid)
    assert c.is_acceptable and c.total_pins == 16
    assert one(spark, "DimensionCheck", drawn(60, 90, (10, 10, 20, 50)), expected_value=50.0).is_correct
    assert abs(one(spark, "DimensionalInspection", drawn(60, 90, (10, 10, 20, 50)), nominal_value=5.0).deviation) < 1e-9
    g = one(spark, "PanelGap", drawn(40, 60, (0, 0, 40, 20), (0, 25, 40, 35)))
    assert g.gap_size == 5 and g.is_uniform
    b = one(spark, "BlisterPack", grid, expected_cavities=18)
    assert (b.filled, b.empty, b.defective) == (16, 2, 0)
    threads = np.tile(np.where(np.arange(100) % 10 < 5, 200, 50), (40, 1))
    assert one(spark, "ThreadCount", threads, expected_count=10).is_correct
    f = one(spark, "FabricPattern", threads)
    assert f.is_matched and f.period_x == 10


def test_gear_has_its_teeth(spark):
    y, x = np.indices((300, 300))
    t, r = np.arctan2(y - 150, x - 150), np.hypot(y - 150, x - 150)
    p = np.where(r <= 90 + 20 * (np.sin(20 * t) > 0), 220, 20)
    g = one(spark, "GearInspection", p, min_thickness=0.1, max_pitch_error=0.2)
    assert g.total_teeth == 20 and g.is_acceptable


def test_levels_and_grades(spark):
    vial = drawn(100, 40, (60, 0, 40, 40))
    assert abs(one(spark, "VialInspect", vial).liquid_level - 0.4) < 1e-9
    assert one(spark, "QualityGrade", drawn(64, 64, back=128)).grade == "A"
    assert one(spark, "PackageSeal", drawn(64, 64, back=128)).is_good
    assert apply("PillDetect", frames(spark, disc(disc(drawn(80, 160), 40, 40, 20), 110, 40, 20))).count() == 2
    assert apply("FabricDefect", frames(spark, drawn(64, 64, back=128))).count() == 0
    d = apply("WaferDefectClassification", frames(spark, disc(drawn(80, 80, back=100), 40, 40, 4))).collect()
    assert [r.kind for r in d] == ["particle"]


def test_flat_and_tiny_frames_crash_nothing(spark):
    from lumenflow.spec import REGISTRY, load

    load()
    flat, dot = frames(spark, np.full((24, 24), 90)), frames(spark, np.full((1, 1), 7))
    from lumenflow.operators import features, industry  # noqa: F401

    names = [n for n, op in REGISTRY.items() if op.plan.__module__ == "lumenflow.operators.measures" and op.family == "measure" and op.inputs == ("image",)]
    assert len(names) > 100
    broken = []
    from lumenflow.frames import image_of

    for n in names:
        for f in (np.full((24, 24, 1), 90, np.uint8), np.full((1, 1, 1), 7, np.uint8)):
            try:
                step = next(c.cell_contents for c in REGISTRY[n].plan.__closure__ if callable(c.cell_contents))
                step(f, **REGISTRY[n].params)
            except Exception as e:  # noqa: BLE001
                broken.append((n, f.shape, repr(e)[:80]))
    assert not broken, broken
    assert image_of and flat.count() == dot.count() == 1
