"""Scalar geometry: every operator is a set of column expressions over a row of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Operator, register

#: type id -> (parameters with defaults, steps, outputs). Steps and outputs are SQL that any engine reads.
FORMULAS: dict[str, tuple[dict[str, float], dict[str, str], dict[str, str]]] = {}


def _op(type_id: str, params: str, outs: dict[str, str], steps: dict[str, str] | None = None) -> None:
    given = {k: float(v) for k, v in (p.split("=") for p in params.split())}
    FORMULAS[type_id] = given, steps or {}, outs
    register(Operator(type_id, "geometry", given, (), tuple(outs), lambda df, **p: scalar(df, type_id, p)))


def _near(px: str, py: str, a: str, b: str, c: str, d: str) -> str:
    """Where on the segment (a, b)-(c, d), from 0 to 1, the nearest point to (px, py) is."""
    square = f"(({c}-{a})*({c}-{a})+({d}-{b})*({d}-{b}))"
    return f"CASE WHEN {square} < 1e-10 THEN 0.0 ELSE greatest(0.0, least(1.0, (({px}-{a})*({c}-{a})+({py}-{b})*({d}-{b}))/{square})) END"


def _to(px: str, py: str, t: str, a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow({px}-({a}+{t}*({c}-{a})),2)+pow({py}-({b}+{t}*({d}-{b})),2))"


def _deg(x: str) -> str:
    return f"({x})*180.0/pi()"


_POINTS = "x1=0 y1=0 x2=100 y2=100"
_op("DistancePointPoint", "x1=0 y1=0 x2=100 y2=0", {"distance": "sqrt(pow(x2-x1,2)+pow(y2-y1,2))"})
_op("DistancePointLine", "px=0 py=0 a=1 b=0 c=0", {"distance": "CASE WHEN a*a+b*b < 1e-20 THEN 0.0 ELSE abs(a*px+b*py+c)/sqrt(a*a+b*b) END"})
_op("DistancePointCircle", "px=0 py=0 cx=0 cy=0 radius=50", {"distance": "abs(d-radius)", "inside": "d < radius"}, {"d": "sqrt(pow(px-cx,2)+pow(py-cy,2))"})
_op("DistancePointEllipse", "px=0 py=0 cx=0 cy=0 ea=100 eb=50 angle=0", {"distance": "CASE WHEN n < 1e-6 THEN abs(eb) ELSE abs(1-1/n)*sqrt(u*u+v*v) END", "inside": "n <= 1"},
    {"u": "(px-cx)*cos(-angle*pi()/180)-(py-cy)*sin(-angle*pi()/180)", "v": "(px-cx)*sin(-angle*pi()/180)+(py-cy)*cos(-angle*pi()/180)", "n": "sqrt(pow(u/greatest(ea,1e-9),2)+pow(v/greatest(eb,1e-9),2))"})
_op("DistancePointSegment", "px=0 py=0 x1=0 y1=0 x2=100 y2=0", {"distance": _to("px", "py", "t", "x1", "y1", "x2", "y2"), "nearest_x": "x1+t*(x2-x1)", "nearest_y": "y1+t*(y2-y1)"}, {"t": _near("px", "py", "x1", "y1", "x2", "y2")})
_op("DistanceLineCircle", "a=1 b=0 c=0 cx=0 cy=0 radius=50", {"distance": "abs(d)", "intersecting": "d <= 0"}, {"d": "abs(a*cx+b*cy+c)/greatest(sqrt(a*a+b*b),1e-10)-radius"})
_op("DistanceLineEllipse", "a=1 b=0 c=0 cx=0 cy=0 ea=100 eb=50 angle=0", {"distance": "abs(d)", "intersecting": "d <= 0"}, {"d": "abs(a*cx+b*cy+c)/greatest(sqrt(a*a+b*b),1e-10)-greatest(ea,eb)"})
_op("DistanceLineLine", "a1=1 b1=0 c1=0 a2=1 b2=0 c2=-50", {"distance": "CASE WHEN parallel THEN abs(c1/n1-c2/n2*CASE WHEN a1*a2+b1*b2 < 0 THEN -1 ELSE 1 END) ELSE 0.0 END", "parallel": "parallel"},
    {"n1": "greatest(sqrt(a1*a1+b1*b1),1e-10)", "n2": "greatest(sqrt(a2*a2+b2*b2),1e-10)", "parallel": "abs((a1*a2+b1*b2)/(n1*n2)) > 0.999"})
_op("DistanceSegmentCircle", "x1=0 y1=0 x2=100 y2=0 cx=0 cy=0 radius=50", {"distance": "abs(d)", "intersecting": "d <= 0"}, {"t": _near("cx", "cy", "x1", "y1", "x2", "y2"), "d": _to("cx", "cy", "t", "x1", "y1", "x2", "y2") + "-radius"})
_SEGS = {"t1": _near("x1", "y1", "x3", "y3", "x4", "y4"), "t2": _near("x2", "y2", "x3", "y3", "x4", "y4"), "t3": _near("x3", "y3", "x1", "y1", "x2", "y2"), "t4": _near("x4", "y4", "x1", "y1", "x2", "y2")}
_CROSS = {"det": "(x2-x1)*(y4-y3)-(y2-y1)*(x4-x3)", "t": "CASE WHEN abs(det) < 1e-10 THEN -1.0 ELSE ((x3-x1)*(y4-y3)-(y3-y1)*(x4-x3))/det END", "u": "CASE WHEN abs(det) < 1e-10 THEN -1.0 ELSE ((x3-x1)*(y2-y1)-(y3-y1)*(x2-x1))/det END", "hit": "t >= 0 AND t <= 1 AND u >= 0 AND u <= 1"}
_op("DistanceSegmentSegment", "x1=0 y1=0 x2=100 y2=0 x3=50 y3=-50 x4=50 y4=50",
    {"distance": "CASE WHEN hit THEN 0.0 ELSE least({},{},{},{}) END".format(_to("x1", "y1", "t1", "x3", "y3", "x4", "y4"), _to("x2", "y2", "t2", "x3", "y3", "x4", "y4"), _to("x3", "y3", "t3", "x1", "y1", "x2", "y2"), _to("x4", "y4", "t4", "x1", "y1", "x2", "y2")), "intersecting": "hit"}, _SEGS | _CROSS)
_ANGLE = {"n": "sqrt(a1*a1+b1*b1)*sqrt(a2*a2+b2*b2)", "r": "CASE WHEN n < 1e-10 THEN 0.0 ELSE atan2(abs(a1*b2-b1*a2),abs(a1*a2+b1*b2)) END"}
_FOLDED = {"angle_rad": "r", "angle_deg": _deg("r"), "parallel": "r < 0.01", "perpendicular": "abs(r-pi()/2) < 0.01"}
_op("AngleLineLine", "a1=1 b1=0 a2=0 b2=1", _FOLDED, _ANGLE)
_op("AnglePointPoint", _POINTS, {"angle_rad": "atan2(y2-y1,x2-x1)", "angle_deg": _deg("atan2(y2-y1,x2-x1)")})
_op("AngleThreePoints", "x1=0 y1=100 x2=0 y2=0 x3=100 y3=0", {"angle_rad": "r", "angle_deg": _deg("r")}, {"d": "abs(atan2(y3-y2,x3-x2)-atan2(y1-y2,x1-x2))", "r": "CASE WHEN d > pi() THEN 2*pi()-d ELSE d END"})
_op("AngleVectorVector", "vx1=1 vy1=0 vx2=0 vy2=1", _FOLDED, {"a1": "vx1", "b1": "vy1", "a2": "vx2", "b2": "vy2"} | _ANGLE)
_op("IntersectLineLine", "a1=1 b1=0 c1=0 a2=0 b2=1 c2=0", {"x": "CASE WHEN valid THEN (b1*c2-b2*c1)/det ELSE 0.0 END", "y": "CASE WHEN valid THEN (a2*c1-a1*c2)/det ELSE 0.0 END", "valid": "valid"}, {"det": "a1*b2-a2*b1", "valid": "abs(det) >= 1e-10"})
_CHORD = {"n": "greatest(sqrt(a*a+b*b),1e-10)", "d": "(a*cx+b*cy+c)/n", "h": "sqrt(greatest(radius*radius-d*d,0.0))", "k": "CASE WHEN sqrt(a*a+b*b) < 1e-10 OR abs(d) > radius THEN 0 WHEN abs(d) = radius THEN 1 ELSE 2 END"}
_op("IntersectLineCircle", "a=1 b=0 c=0 cx=0 cy=0 radius=50", {"count": "CAST(k AS DOUBLE)", "x1": "CASE WHEN k > 0 THEN cx-d*a/n-h*b/n ELSE 0.0 END", "y1": "CASE WHEN k > 0 THEN cy-d*b/n+h*a/n ELSE 0.0 END", "x2": "CASE WHEN k > 0 THEN cx-d*a/n+h*b/n ELSE 0.0 END", "y2": "CASE WHEN k > 0 THEN cy-d*b/n-h*a/n ELSE 0.0 END"}, _CHORD)
# A line or segment against an ellipse is solved exactly, in the ellipse's own frame.
_ELL = {"ca": "cos(angle*pi()/180)", "sa": "sin(angle*pi()/180)", "ua": "((p1-cx)*ca+(q1-cy)*sa)/greatest(ea,1e-9)", "va": "((q1-cy)*ca-(p1-cx)*sa)/greatest(eb,1e-9)", "ub": "((p2-cx)*ca+(q2-cy)*sa)/greatest(ea,1e-9)", "vb": "((q2-cy)*ca-(p2-cx)*sa)/greatest(eb,1e-9)",
        "qa": "pow(ub-ua,2)+pow(vb-va,2)", "qb": "ua*(ub-ua)+va*(vb-va)", "qd": "qb*qb-qa*(ua*ua+va*va-1)", "ok": "qa > 1e-12 AND qd >= 0", "ta": "CASE WHEN ok THEN (-qb-sqrt(qd))/qa ELSE -1e9 END", "tb": "CASE WHEN ok THEN (-qb+sqrt(qd))/qa ELSE -1e9 END"}
_op("IntersectLineEllipse", "a=1 b=0 c=0 cx=0 cy=0 ea=100 eb=50 angle=0", {"count": "CASE WHEN NOT ok THEN 0.0 WHEN qd = 0 THEN 1.0 ELSE 2.0 END", **{f"{v}{i}": f"CASE WHEN ok THEN {p}1+{t}*({p}2-{p}1) ELSE 0.0 END" for i, t in ((1, "ta"), (2, "tb")) for v, p in (("x", "p"), ("y", "q"))}},
    {"n": "greatest(sqrt(a*a+b*b),1e-10)", "p1": "cx-(a*cx+b*cy+c)/n*a/n", "q1": "cy-(a*cx+b*cy+c)/n*b/n", "p2": "p1-b/n", "q2": "q1+a/n"} | _ELL)
_op("IntersectSegmentEllipse", "x1=-100 y1=0 x2=100 y2=0 cx=0 cy=0 ea=100 eb=50 angle=0",
    {"count": "(CASE WHEN in1 THEN 1.0 ELSE 0.0 END)+(CASE WHEN in2 THEN 1.0 ELSE 0.0 END)", "ix1": "CASE WHEN in1 THEN p1+ta*(p2-p1) ELSE 0.0 END", "iy1": "CASE WHEN in1 THEN q1+ta*(q2-q1) ELSE 0.0 END", "ix2": "CASE WHEN in2 THEN p1+tb*(p2-p1) ELSE 0.0 END", "iy2": "CASE WHEN in2 THEN q1+tb*(q2-q1) ELSE 0.0 END"},
    {"p1": "x1", "q1": "y1", "p2": "x2", "q2": "y2"} | _ELL | {"in1": "ok AND ta >= 0 AND ta <= 1", "in2": "ok AND qd > 0 AND tb >= 0 AND tb <= 1"})
_op("IntersectSegmentCircle", "x1=0 y1=0 x2=100 y2=0 cx=50 cy=0 radius=50", FORMULAS["IntersectSegmentEllipse"][2], {"ea": "radius", "eb": "radius", "angle": "0.0*radius"} | FORMULAS["IntersectSegmentEllipse"][1])
_op("IntersectCircleCircle", "c1x=0 c1y=0 r1=50 c2x=80 c2y=0 r2=50",
    {"count": "CASE WHEN NOT ok THEN 0.0 WHEN h < 1e-6 THEN 1.0 ELSE 2.0 END", "x1": "CASE WHEN ok THEN c1x+(e*(c2x-c1x)-h*(c2y-c1y))/d ELSE 0.0 END", "y1": "CASE WHEN ok THEN c1y+(e*(c2y-c1y)+h*(c2x-c1x))/d ELSE 0.0 END", "x2": "CASE WHEN ok THEN c1x+(e*(c2x-c1x)+h*(c2y-c1y))/d ELSE 0.0 END", "y2": "CASE WHEN ok THEN c1y+(e*(c2y-c1y)-h*(c2x-c1x))/d ELSE 0.0 END"},
    {"d": "sqrt(pow(c2x-c1x,2)+pow(c2y-c1y,2))", "ok": "d >= 1e-10 AND d <= r1+r2 AND d >= abs(r1-r2)", "e": "CASE WHEN ok THEN (r1*r1-r2*r2+d*d)/(2*d) ELSE 0.0 END", "h": "sqrt(greatest(r1*r1-e*e,0.0))"})
_op("IntersectSegmentLine", "x1=0 y1=0 x2=100 y2=100 a=1 b=-1 c=0", {"x": "CASE WHEN ok THEN x1+t*(x2-x1) ELSE 0.0 END", "y": "CASE WHEN ok THEN y1+t*(y2-y1) ELSE 0.0 END", "valid": "ok"}, {"m": "a*(x2-x1)+b*(y2-y1)", "t": "CASE WHEN abs(m) < 1e-10 THEN -1.0 ELSE -(a*x1+b*y1+c)/m END", "ok": "t >= 0 AND t <= 1"})
_op("IntersectSegmentSegment", "x1=0 y1=0 x2=100 y2=100 x3=0 y3=100 x4=100 y4=0", {"x": "CASE WHEN hit THEN x1+t*(x2-x1) ELSE 0.0 END", "y": "CASE WHEN hit THEN y1+t*(y2-y1) ELSE 0.0 END", "valid": "hit"}, _CROSS)
_op("CreateLineParallel", "a=1 b=0 c=0 distance=50", {"line_a": "a", "line_b": "b", "line_c": "c+distance*sqrt(a*a+b*b)"})
_op("CreateLinePerpendicular", "a=1 b=0 c=0 px=50 py=50", {"line_a": "-b", "line_b": "a", "line_c": "b*px-a*py"})
_op("CreateLineBisectPoints", "x1=0 y1=0 x2=100 y2=0", {"line_a": "x2-x1", "line_b": "y2-y1", "line_c": "-(x2-x1)*(x1+x2)/2-(y2-y1)*(y1+y2)/2", "mid_x": "(x1+x2)/2", "mid_y": "(y1+y2)/2"})
_op("DistanceMeasure", "mode=1 point1_x=0 point1_y=0 point2_x=0 point2_y=0 point_x=0 point_y=0 line_a=1 line_b=0 line_c=0", {"distance": "CASE WHEN mode = 2 THEN abs(line_a*point_x+line_b*point_y+line_c)/greatest(sqrt(line_a*line_a+line_b*line_b),1e-10) ELSE sqrt(pow(point2_x-point1_x,2)+pow(point2_y-point1_y,2)) END"})
_op("AngleMeasure", "line1_a=1 line1_b=0 line1_c=0 line2_a=0 line2_b=1 line2_c=0", {"angle_rad": "r", "angle_deg": _deg("r")}, {"n": "sqrt(line1_a*line1_a+line1_b*line1_b)*sqrt(line2_a*line2_a+line2_b*line2_b)", "r": "CASE WHEN n < 1e-10 THEN 0.0 ELSE acos(greatest(-1.0,least(1.0,(line1_a*line2_a+line1_b*line2_b)/n))) END"})
_op("LineMeasure", "start_x=0 start_y=0 end_x=100 end_y=100", {"length": "sqrt(pow(end_x-start_x,2)+pow(end_y-start_y,2))", "angle_rad": "atan2(end_y-start_y,end_x-start_x)", "angle_deg": _deg("atan2(end_y-start_y,end_x-start_x)")})
_op("triangulate", "left_x=1000 left_y=540 right_x=960 right_y=540 fx=1800 fy=1800 cx=960 cy=540 baseline=60", {"x": "CASE WHEN d > 0 THEN (left_x-cx)*baseline/d ELSE 0.0 END", "y": "CASE WHEN d > 0 THEN (left_y-cy)*fx*baseline/d/greatest(fy,1e-9) ELSE 0.0 END", "depth": "CASE WHEN d > 0 THEN fx*baseline/d ELSE 0.0 END"}, {"d": "left_x-right_x"})
_op("stereo_params", "fx=1800 baseline=60", {"out_baseline": "baseline", "focal_length": "fx", "depth_unit": "fx*baseline"})
_op("stereo_measure", "x1=0 y1=0 z1=0 x2=1 y2=1 z2=1 depth_scale=1", {"distance_3d": "sqrt(vx*vx+vy*vy+vz*vz)", "vx": "vx", "vy": "vy", "vz": "vz"}, {"vx": "(x2-x1)*depth_scale", "vy": "(y2-y1)*depth_scale", "vz": "(z2-z1)*depth_scale"})
_op("hand_eye_compensate", "rx=0 ry=0 rz=0 mx=0 my=0 mz=0 tx=0 ty=0 tz=0 compensation_factor=1", {"offset_x": "(tx-mx)*compensation_factor", "offset_y": "(ty-my)*compensation_factor", "offset_z": "(tz-mz)*compensation_factor", "out_x": "rx+(tx-mx)*compensation_factor", "out_y": "ry+(ty-my)*compensation_factor", "out_z": "rz+(tz-mz)*compensation_factor"})
_op("gripper_pose_calc", "x=0 y=0 z=0 rz=0 gripper_offset_x=0 gripper_offset_y=0 gripper_offset_z=50 gripper_rotation=0", {"out_x": "x+cos(rz*pi()/180)*gripper_offset_x-sin(rz*pi()/180)*gripper_offset_y", "out_y": "y+sin(rz*pi()/180)*gripper_offset_x+cos(rz*pi()/180)*gripper_offset_y", "out_z": "z+gripper_offset_z", "out_rz": "rz+gripper_rotation", "approach_distance": "abs(gripper_offset_z)"})
_op("MeasureResultsToRegions", "x=0 y=0 region_size=5", {"region_x": "x-region_size/2", "region_y": "y-region_size/2", "region_width": "region_size", "region_height": "region_size"})
_op("AutoCalibration", "drift_x=0 drift_y=0 drift_threshold=0.5", {"offset_x": "CASE WHEN valid THEN -drift_x ELSE 0.0 END", "offset_y": "CASE WHEN valid THEN -drift_y ELSE 0.0 END", "valid": "valid"}, {"valid": "sqrt(drift_x*drift_x+drift_y*drift_y) > drift_threshold"})


def _signed(e: str) -> str:
    """The expression for Spark, whose atan2 takes -0.0 for 0.0: of zeros over -0.0, or of -0.0 over a number below 0, the
    angle is a half turn, in the sense of the first one's sign, as C and DuckDB have it.
    """
    start = e.find("atan2(")
    if start < 0:
        return e
    first, depth, cut = start + len("atan2("), 0, 0
    for end in range(first, len(e)):
        if not depth and e[end] == ",":
            cut = end
        elif not depth and e[end] == ")":
            break
        depth += (e[end] == "(") - (e[end] == ")")
    y, x = _signed(e[first:cut]), _signed(e[cut + 1 : end])
    below = lambda v: f"pow({v},-1) < 0"
    turned = f"CASE WHEN ({y}) = 0 AND ({x}) <= 0 AND {below(x)} THEN CASE WHEN {below(y)} THEN -pi() ELSE pi() END ELSE atan2({y},{x}) END"
    return f"{e[:start]}({turned}){_signed(e[end + 1 :])}"


def scalar(df: DataFrame, type_id: str, params: dict) -> DataFrame:
    """df with the operator's outputs. A parameter is the column of its name where df has one, else its value.

    A null number gives null outputs. Outputs replace columns of the same name.
    """
    defaults, steps, outs = FORMULAS[type_id]
    keep = [c for c in df.columns if c not in outs]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), *[(F.col(f"`{k}`").cast("double") if k in df.columns else F.lit(float(params.get(k, v)))).alias(k) for k, v in defaults.items()])
    for k, e in steps.items():
        row = row.withColumn(k, F.expr(_signed(e)))
    out = row.select("__row.*", *[F.expr(_signed(e)).alias(k) for k, e in outs.items()])
    # Literals are decimals in SQL; a number is a double here.
    return out.withColumns({k: F.col(k).cast("double") for k, kind in out.dtypes if k in outs and kind not in ("double", "boolean")})


def sql(type_id: str, source: str, key: str) -> str:
    """The same operator as one SQL statement over a subquery with the key and the parameters."""
    _, steps, outs = FORMULAS[type_id]
    inner = f"({source}) t"
    for k, e in steps.items():
        inner = f"(SELECT *, {e} AS {k} FROM {inner}) t"
    return f"SELECT {key}, " + ", ".join(f"{e} AS {k}" for k, e in outs.items()) + f" FROM {inner}"
