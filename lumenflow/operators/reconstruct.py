"""Clusters, registration and meshes of point clouds, hand-eye calibration, photometric surfaces, model application, checkpoints."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import measure_images
from ..scratch import settled
from .clouds import AXES, _cell, neighbours, rotation
from .features import _scans
from .images import clamp, gradient, gray, image_op
from .inspect import fit_circle, fit_line, ring
from .measures import ellipse_measure, measure_op, table_op
from .scene import normals, plane_detection

# --- clusters: points within the tolerance are of one cluster


def clusters(pointcloud: DataFrame, tolerance: float) -> DataFrame:
    """pointcloud with `cluster`, the least point id that steps of at most the tolerance lead to.

    Neighbours are found by an equi-join on cells; labels spread along them and jump to their label's label, so
    the rounds grow with the logarithm of the longest path. Every round is a written table.
    """
    links = settled(neighbours(pointcloud, tolerance).select("cloud_id", "point_id", "other").filter("point_id <> other"), "links")
    labels = settled(pointcloud.select("cloud_id", "point_id", F.col("point_id").alias("cluster")), "labels")
    while True:
        near = links.join(labels.select("cloud_id", F.col("point_id").alias("other"), "cluster"), ["cloud_id", "other"]).groupBy("cloud_id", "point_id").agg(F.min("cluster").alias("least"))
        step = settled(labels.join(near, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("least", "cluster")).alias("cluster")), "step")
        jump = step.select("cloud_id", F.col("point_id").alias("cluster"), F.col("cluster").alias("further"))
        new = settled(step.join(jump, ["cloud_id", "cluster"]).select("cloud_id", "point_id", "old", F.least("cluster", "further").alias("cluster")), "labels")
        done = new.filter("cluster <> old").isEmpty()
        labels = new.drop("old")
        if done:
            return pointcloud.join(labels, ["cloud_id", "point_id"])


@table_op("pointcloud_cluster", "pointcloud", "cloud_id cluster n center_x center_y center_z", tolerance=0.02, min_cluster_size=10, max_cluster_size=100000)
def cloud_clusters(pointcloud, tolerance, min_cluster_size, max_cluster_size):
    s = clusters(pointcloud, tolerance).groupBy("cloud_id", "cluster").agg(F.count("*").alias("n"), *[F.avg(a).alias("center_" + a) for a in AXES])
    return s.filter(F.col("n").between(int(min_cluster_size), int(max_cluster_size)))


@table_op("PointCloudSegmentCluster", "pointcloud", "cloud_id cluster_count largest", tolerance=0.02, min_cluster_size=100, max_cluster_size=25000)
def segment_cluster(pointcloud, tolerance, min_cluster_size, max_cluster_size):
    """How many clusters of fitting size a cloud has, and the largest of them."""
    s = cloud_clusters(pointcloud, tolerance, min_cluster_size, max_cluster_size)
    return s.groupBy("cloud_id").agg(F.count("*").alias("cluster_count"), F.max(F.struct("n", -F.col("cluster"))).alias("l")).select("cloud_id", "cluster_count", (-F.col("l")["col2"]).alias("largest"))


# --- registration: pairs of clouds of equal id; a cloud fits in one task

_MOTION = "cloud_id long, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", tx double, ty double, tz double, fitness double"


def _rigid(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and shift of least squares from x to y."""
    u, _, v = np.linalg.svd((x - x.mean(0)).T @ (y - y.mean(0)))
    r = v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T
    return r, y.mean(0) - r @ x.mean(0)


class _Near:
    """Nearest points of q, exact: halves of halves along their widest axis, down to few points each, and searched for many
    points at a time. Of equally near ones the first counts, as does the first of equal ones.
    """

    LEAF, CHUNK = 12, 1 << 14

    def __init__(self, q: np.ndarray):
        order = np.lexsort((np.arange(len(q)), *q.T[::-1]))
        new = np.ones(len(q), bool)
        new[1:] = (q[order[1:]] != q[order[:-1]]).any(1)
        at = np.sort(order[new])
        self.q, n = q, len(at)
        self.depth = max(0, int(np.ceil(np.log2(n / self.LEAF))))
        self.boxes = []
        for level in range(self.depth + 1):
            starts = n * np.arange(1 << level) >> level
            part = np.repeat(np.arange(1 << level), np.diff(np.append(starts, n)))
            low, high = (f.reduceat(q[at], starts) for f in (np.minimum, np.maximum))
            self.boxes.append((low, high))
            if level < self.depth:
                at = at[np.lexsort((q[at, (high - low).argmax(1)[part]], part))]
        sizes = np.diff(np.append(starts, n))
        # Leaves of one width, their points in order; what is beyond a leaf's end is infinitely far.
        at = at[np.lexsort((at, part))]
        self.leaves = np.full((len(starts), sizes.max()), -1)
        self.leaves[part, np.arange(n) - starts[part]] = at
        self.places = np.where(self.leaves[..., None] < 0, np.inf, q[self.leaves])

    @staticmethod
    def _square(d: np.ndarray) -> np.ndarray:
        out = d[..., 0] * d[..., 0]
        for k in range(1, d.shape[-1]):
            out += d[..., k] * d[..., k]
        return out

    def _gap(self, p: np.ndarray, level: int, box: np.ndarray) -> np.ndarray:
        """Squared distance to the box: no more than that to any point in it, rounding included."""
        low, high = self.boxes[level]
        return self._square(np.maximum(np.maximum(low[box] - p, p - high[box]), 0))

    def __call__(self, p: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of p the place in q and the distance of its nearest; near guesses save time, whatever they are."""
        at, gap = np.empty(len(p), int), np.empty(len(p))
        for i in range(0, len(p), self.CHUNK):
            part = slice(i, i + self.CHUNK)
            at[part], gap[part] = self._searched(p[part], None if guess is None else guess[part])
        return at, gap

    def _searched(self, p: np.ndarray, guess: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if guess is None:
            box = np.zeros(len(p), int)
            for level in range(1, self.depth + 1):
                box = box * 2 + (self._gap(p, level, box * 2 + 1) < self._gap(p, level, box * 2))
            most = self._square(p[:, None] - self.places[box]).min(1)
        else:
            most = self._square(p - self.q[guess])
        who, box = np.arange(len(p)), np.zeros(len(p), int)
        for level in range(1, self.depth + 1):
            who, box = np.concatenate((who, who)), np.concatenate((box * 2, box * 2 + 1))
            near = self._gap(p[who], level, box) <= most[who]
            who, box = who[near], box[near]
        best, at = np.full(len(p), np.inf), np.full(len(p), len(self.q))
        found = []
        for i in range(0, len(who), 4 * self.CHUNK):
            w, b = who[i : i + 4 * self.CHUNK], box[i : i + 4 * self.CHUNK]
            d = self._square(p[w, None] - self.places[b])
            k = d.argmin(1)
            found.append((w, d[np.arange(len(w)), k], self.leaves[b, k]))
            np.minimum.at(best, w, found[-1][1])
        for w, d, leaf in found:
            first = d == best[w]
            np.minimum.at(at, w[first], leaf[first])
        return at, np.sqrt(best)


def _nearest(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _Near(q)(p)


def _refined(p, q, r, t, rounds: int, tolerance: float, most: float = np.inf, search: _Near | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Nearest points, at most `most` apart, laid on each other until the mean distance stands; with under three it stops."""
    before, at, search = np.inf, None, search or _Near(q)
    for _ in range(rounds):
        at, gap = search(p @ r.T + t, at)
        near = gap <= most
        if near.sum() < 3:
            break
        r, t = _rigid(p[near], q[at[near]])
        if abs(before - gap.mean()) < tolerance:
            break
        before = gap.mean()
    return r, t, float(search(p @ r.T + t, at)[1].mean())


def _by_axes(p, q, rounds: int, tolerance: float):
    """Principal axes laid on each other in the four ways that keep handedness, each refined; the best stays. A way that
    leaves nothing but rounding cannot be bettered.
    """
    (cp, ap), (cq, aq) = ((v.mean(0), np.linalg.svd(v - v.mean(0), full_matrices=False)[2]) for v in (p, q))
    best, search = None, _Near(q)
    rounding = 1e-14 * max(np.abs(q).max(), np.abs(p).max())
    for a in (1, -1):
        for b in (1, -1):
            m = aq.T @ np.diag([a, b, 1.0]) @ ap
            m = m if np.linalg.det(m) > 0 else aq.T @ np.diag([a, b, -1.0]) @ ap
            found = _refined(p, q, m, cq - m @ cp, rounds, tolerance, search=search)
            best = found if best is None or found[2] < best[2] else best
            if best[2] <= rounding:
                return best
    return best


def register_op(type_id: str, *aliases: str, **params):
    """Register solve(p, q, **params) -> rotation, shift, mean distance to the nearest target point."""

    def add(solve):
        def plan(source, target, **given):
            def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
                names = [x.split()[0] for x in _MOTION.split(", ")]
                if len(a) < 3 or len(b) < 3:
                    return pd.DataFrame(columns=names)
                r, t, error = solve(*(v.sort_values("point_id")[list(AXES)].to_numpy(float) for v in (a, b)), **given)
                return pd.DataFrame([[int(a.cloud_id.iloc[0]), *r.ravel(), *t, float(error)]], columns=names)

            cols = ("cloud_id", "point_id", *AXES)
            return source.select(*cols).groupBy("cloud_id").cogroup(target.select(*cols).groupBy("cloud_id")).applyInPandas(one, _MOTION)

        table_op(type_id, "source target", " ".join(x.split()[0] for x in _MOTION.split(", ")), *aliases, **params)(plan)
        return solve

    return add


register_op("global_register", distance_threshold=0.05)(lambda p, q, distance_threshold: _by_axes(p, q, 50, 1e-9))


def shape_features(p: np.ndarray, radius: float) -> np.ndarray:
    """Of every point: the neighbours' count share, and the sorted singular values and mean distance of its nearest sixteen."""
    out = np.zeros((len(p), 5))
    for i, x in enumerate(p):
        d = np.sqrt(((p - x) ** 2).sum(1))
        near = p[np.argsort(d, kind="stable")[:16]]
        out[i] = [(d <= radius).mean(), *np.linalg.svd(near - near.mean(0), compute_uv=False)[:3], np.sort(d)[1:16].mean()]
    return (out - out.mean(0)) / np.maximum(out.std(0), 1e-9)


@register_op("feature_register", feature_radius=0.05)
def by_features(p, q, feature_radius):
    """Points matched by the shape around them; of seeded triples the motion that most matches agree with, refined by nearest points."""
    f, g = shape_features(p, feature_radius), shape_features(q, feature_radius)
    at, _ = _nearest(f, g)
    rng, size, best = np.random.default_rng(0), np.ptp(q, axis=0).max(), (None, -1)
    for _ in range(500):
        k = rng.choice(len(p), 3, replace=False)
        r, t = _rigid(p[k], q[at[k]])
        n = int((np.sqrt(((p @ r.T + t - q[at]) ** 2).sum(1)) < 0.05 * size).sum())
        best = ((r, t), n) if n > best[1] else best
    return _refined(p, q, *best[0], 50, 1e-9)


register_op("PointCloudFeatureMatching", feature_type=0, feature_radius=0.05, sac_iterations=100)(lambda p, q, feature_type, feature_radius, sac_iterations: by_features(p, q, feature_radius))
register_op("PointCloudICP", method=0, max_iterations=50, tolerance=0.000001, max_correspondence_distance=0.05)(lambda p, q, method, max_iterations, tolerance, max_correspondence_distance: _refined(p, q, np.eye(3), np.zeros(3), int(max_iterations), tolerance, max_correspondence_distance))


def _ndt(p, q, voxel_size, max_iterations, step_size=0.1, tolerance=1e-6):
    """The target as a normal distribution for each voxel of three points or more; Gauss-Newton over turn and shift."""
    keys, back, n = np.unique(np.floor(q / voxel_size).astype(int), axis=0, return_inverse=True, return_counts=True)
    back = back.ravel()
    mean = np.stack([np.bincount(back, q[:, k]) for k in range(3)], 1) / n[:, None]
    inverse = {}
    for k in np.flatnonzero(n >= 3):
        c = np.cov(q[back == k].T)
        inverse[k] = np.linalg.inv(c + np.eye(3) * max(1e-3 * np.trace(c), 1e-9))
    if not inverse:
        return _refined(p, q, np.eye(3), np.zeros(3), int(max_iterations), tolerance)
    have = np.array(sorted(inverse))
    info = np.stack([inverse[k] for k in have])
    r, t = np.eye(3), np.zeros(3)
    for _ in range(int(max_iterations)):
        moved = p @ r.T + t
        at, gap = _nearest(moved, mean[have])
        on = gap <= 2 * voxel_size
        if on.sum() < 3:
            break
        d, w = (moved - mean[have][at])[on], info[at][on]
        e = np.exp(-0.5 * np.einsum("ni,nij,nj->n", d, w, d)) + 1e-6
        x = moved[on]
        j = np.zeros((len(x), 3, 6))
        j[:, 0, 1], j[:, 0, 2], j[:, 1, 0], j[:, 1, 2], j[:, 2, 0], j[:, 2, 1] = x[:, 2], -x[:, 1], -x[:, 2], x[:, 0], x[:, 1], -x[:, 0]
        j[:, :, 3:] = np.eye(3)
        h = np.einsum("n,nia,nij,njb->ab", e, j, w, j) + 1e-9 * np.eye(6)
        s = -np.linalg.solve(h, np.einsum("n,nia,nij,nj->a", e, j, w, d))
        turn = np.array(rotation(*np.degrees(s[:3])))
        r, t = turn @ r, turn @ t + s[3:]
        if abs(s).max() < tolerance:
            break
    return r, t, float(_nearest(p @ r.T + t, q)[1].mean())


register_op("ndt_register", voxel_size=0.1, step_size=0.1, max_iterations=50)(_ndt)
register_op("PointCloudNDT", voxel_size=1.0, max_iterations=50, tolerance=0.000001, step_size=0.1)(_ndt)


@table_op("PointCloudSegmentPlane", "pointcloud", "cloud_id point_id on_plane", distance_threshold=0.01, max_iterations=100, min_inliers=100)
def segment_plane(pointcloud, distance_threshold, max_iterations, min_inliers):
    """Every point with whether it is near its cloud's plane; clouds whose plane has too few points have none."""
    planes = plane_detection(pointcloud, distance_threshold, max_iterations).filter(F.col("inliers") >= int(min_inliers))
    gap = F.abs(sum(((F.col(a) - F.col("center_" + a)) * F.col("normal_" + a) for a in AXES[1:]), (F.col("x") - F.col("center_x")) * F.col("normal_x")))
    return pointcloud.join(planes.select("cloud_id", *[f"{k}_{a}" for k in ("center", "normal") for a in AXES]), "cloud_id", "left").select(*pointcloud.columns, F.coalesce(gap <= distance_threshold, F.lit(False)).alias("on_plane"))


@table_op("PointCloudNormalEstimation", "pointcloud", "cloud_id normals_count avg_curvature", method=0, search_radius=0.03, k_neighbors=20)
def normal_summary(pointcloud, method, search_radius, k_neighbors):
    return normals(pointcloud, search_radius).groupBy("cloud_id").agg(F.count("*").alias("normals_count"), F.avg("curvature").alias("avg_curvature"))


@table_op("pointcloud_visualize", "pointcloud", "cloud_id v u shade", image_width=800, image_height=600, view_distance=500.0, rotation_x=30.0, rotation_y=45.0, rotation_z=0.0, zoom=1.0, show_colors=True)
def visualize(pointcloud, image_width, image_height, view_distance, rotation_x, rotation_y, rotation_z, zoom, show_colors):
    """Pixels that points are seen at after turning about the cloud's centre; the nearest point of each, as a depth shade."""
    m = rotation(rotation_x, rotation_y, rotation_z)
    c = pointcloud.groupBy("cloud_id").agg(*[F.avg(a).alias("c" + a) for a in AXES])
    p = pointcloud.join(c, "cloud_id")
    q = {b: sum(((F.col(a) - F.col("c" + a)) * m[k][j] for j, a in enumerate(AXES)), F.lit(0.0)) for k, b in enumerate(("px", "py", "pz"))}
    p = p.select("cloud_id", *[v.alias(k) for k, v in q.items()])
    scale = F.lit(float(view_distance * zoom)) / (F.col("pz") + view_distance)
    p = p.filter(F.col("pz") + view_distance > 1e-9).select("cloud_id", F.floor(F.col("px") * scale + image_width / 2).alias("u"), F.floor(F.col("py") * scale + image_height / 2).alias("v"), "pz")
    p = p.filter(F.col("u").between(0, int(image_width) - 1) & F.col("v").between(0, int(image_height) - 1))
    return p.groupBy("cloud_id", "v", "u").agg(F.min("pz").alias("depth"), F.count("*").alias("n"))


# --- meshes: triangles as rows (mesh_id, triangle_id, a, b, c) over vertices (mesh_id, vertex_id, x, y, z)


@table_op("mesh_simplify", "vertices triangles", "mesh_id a b c", cell_size=0.05)
def mesh_simplify(vertices, triangles, cell_size):
    """Vertices of one cell become one; triangles that lose a corner go, equal ones count once. Two joins and one distinct."""
    v = vertices.select("mesh_id", "vertex_id", *_cell(cell_size))
    rep = v.withColumn("rep", F.min("vertex_id").over(Window.partitionBy("mesh_id", "cx", "cy", "cz"))).select("mesh_id", "vertex_id", "rep")
    out = triangles.select("mesh_id", F.posexplode(F.array("a", "b", "c")).alias("k", "vertex_id"), F.col("triangle_id"))
    out = out.join(rep, ["mesh_id", "vertex_id"]).groupBy("mesh_id", "triangle_id").agg(F.sort_array(F.collect_set("rep")).alias("r"))
    return out.filter(F.size("r") == 3).select("mesh_id", *[F.col("r")[k].alias(n) for k, n in enumerate("abc")]).distinct()


def _whole(p: np.ndarray) -> list[tuple[int, int]]:
    """The points as whole numbers, all times the same power of two."""
    parts = [[v.as_integer_ratio() for v in row] for row in p.tolist()]
    unit = max(d for row in parts for _, d in row)
    return [tuple(n * (unit // d) for n, d in row) for row in parts]


class _Mesh:
    """The triangulation of different points sorted by place: halves are meshed and then joined along their seam.

    Edge e leads from org[e] to org[e ^ 1]; ahead[e] and back[e] are the next edges to the left and to the right around its
    origin. Signs come from doubles where their error allows it, else from whole numbers: they are right for all points.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.p = points, [tuple(v) for v in points.tolist()]
        self.org, self.ahead, self.back = [], [], []
        if len(points) > 1:
            self._meshed(0, len(points))

    @cached_property
    def whole(self) -> list[tuple[int, int]]:
        return _whole(self.points)

    def side(self, a: int, b: int, c: int) -> float:
        """Above 0 where a, b, c turn left, below where they turn right."""
        (ax, ay), (bx, by), (cx, cy) = self.p[a], self.p[b], self.p[c]
        left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
        det = left - right
        if abs(det) > 4e-16 * (abs(left) + abs(right)) > 1e-290:
            return det
        (ax, ay), (bx, by), (cx, cy) = self.whole[a], self.whole[b], self.whole[c]
        return (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)

    def within(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d is inside the circle through a, b and c, which turn left."""
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = self.p[a], self.p[b], self.p[c], self.p[d]
        for exact in (False, True):
            ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
            bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
            a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            det = a2 * (bc - cb) + b2 * (ca - ac) + c2 * (ab - ba)
            if exact or abs(det) > 1.2e-15 * ((abs(bc) + abs(cb)) * a2 + (abs(ca) + abs(ac)) * b2 + (abs(ab) + abs(ba)) * c2) > 1e-290:
                return det > 0
            (ax, ay), (bx, by), (cx, cy), (dx, dy) = self.whole[a], self.whole[b], self.whole[c], self.whole[d]

    def _edge(self, a: int, b: int) -> int:
        e = len(self.org)
        self.org += (a, b)
        self.ahead += (e, e + 1)
        self.back += (e, e + 1)
        return e

    def _splice(self, a: int, b: int) -> None:
        ahead, back = self.ahead, self.back
        x, y = ahead[a], ahead[b]
        ahead[a], ahead[b], back[x], back[y] = y, x, b, a

    def _joined(self, a: int, b: int) -> int:
        """A new edge from where a ends to where b begins, left of both."""
        e = self._edge(self.org[a ^ 1], self.org[b])
        self._splice(e, self.back[a ^ 1])
        self._splice(e ^ 1, b)
        return e

    def _cut(self, e: int) -> None:
        self._splice(e, self.back[e])
        self._splice(e ^ 1, self.back[e ^ 1])

    def _meshed(self, low: int, high: int) -> tuple[int, int]:
        """Mesh points low to high; the hull's edge to the left from the first point and that to the right from the last."""
        org, ahead, back, side, within = self.org, self.ahead, self.back, self.side, self.within
        if high - low == 2:
            a = self._edge(low, low + 1)
            return a, a ^ 1
        if high - low == 3:
            a, b = self._edge(low, low + 1), self._edge(low + 1, low + 2)
            self._splice(a ^ 1, b)
            turn = side(low, low + 1, low + 2)
            c = self._joined(b, a) if turn else None
            return (c ^ 1, c) if turn < 0 else (a, b ^ 1)
        mid = (low + high) // 2
        (first, left), (right, last) = self._meshed(low, mid), self._meshed(mid, high)
        while True:  # down to the edge below both
            if side(org[right], org[left], org[left ^ 1]) > 0:
                left = back[left ^ 1]
            elif side(org[left], org[right ^ 1], org[right]) > 0:
                right = ahead[right ^ 1]
            else:
                break
        base = self._joined(right ^ 1, left)
        if org[left] == org[first]:
            first = base ^ 1
        if org[right] == org[last]:
            last = base
        while True:  # up along the seam
            r, l = org[base], org[base ^ 1]  # noqa: E741
            left, right = ahead[base ^ 1], back[base]
            a, b = org[left ^ 1], org[right ^ 1]
            left_up, right_up = side(a, l, r) > 0, side(b, l, r) > 0
            if left_up:
                while side(n := org[ahead[left] ^ 1], l, r) > 0 and within(l, r, a, n):
                    left, a, old = ahead[left], n, left
                    self._cut(old)
            if right_up:
                while side(n := org[back[right] ^ 1], l, r) > 0 and within(l, r, b, n):
                    right, b, old = back[right], n, right
                    self._cut(old)
            if not left_up and not right_up:
                return first, last
            if not left_up or (right_up and within(a, l, r, b)):
                base = self._joined(right, base ^ 1)
            else:
                base = self._joined(base ^ 1, left ^ 1)

    def triangles(self) -> np.ndarray:
        """Faces of three edges that turn left."""
        org, back = np.array(self.org, int), np.array(self.back, int)
        one = np.arange(len(org))
        two = back[one ^ 1]
        three = back[two ^ 1]
        faces = (back[three ^ 1] == one) & (one < two) & (one < three)
        corners = org[np.stack((one, two, three), 1)[faces]]
        return corners[np.array([self.side(*t) > 0 for t in corners.tolist()], bool)]


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles of the plane whose circumcircles hold no other point, out to the convex hull, in n log n steps: places in p,
    ascending. Of equal points the first counts; points without a finite place are in no triangle.
    """
    at = np.flatnonzero(np.isfinite(p).all(1))
    at = at[np.lexsort((at, p[at, 1], p[at, 0]))]
    q = p[at]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]).any(1)
    at = at[first]
    t = np.sort(at[_Mesh(q[first]).triangles()], axis=1)
    return t[np.lexsort(t.T[::-1])]


@table_op("delaunay_triangulation", "pointcloud", "cloud_id a b c")
def triangulate(pointcloud):
    """Of every cloud, seen along z: the ids of each triangle's points. A cloud fits in one task; equal places count once."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").drop_duplicates(["x", "y"])
        ids = pdf.point_id.to_numpy()
        t = delaunay(pdf[["x", "y"]].to_numpy(float)) if len(pdf) >= 3 else np.zeros((0, 3), int)
        return pd.DataFrame({"cloud_id": np.full(len(t), pdf.cloud_id.iloc[0]), "a": ids[t[:, 0]], "b": ids[t[:, 1]], "c": ids[t[:, 2]]})

    return pointcloud.select("cloud_id", "point_id", *AXES).groupBy("cloud_id").applyInPandas(one, "cloud_id long, a long, b long, c long")


@table_op("marching_cubes", "pointcloud", "cloud_id axis side cx cy cz", "PointCloudSurface", voxel_size=0.01)
def voxel_surface(pointcloud, voxel_size):
    """The faces between occupied and empty voxels, two triangles each: every voxel offers six, those that two voxels offer are inside."""
    v = pointcloud.select("cloud_id", *_cell(voxel_size)).distinct()
    faces = F.array(*[F.struct(F.lit(k).alias("axis"), F.lit(s).alias("side"), *[(F.col("c" + a) + (s if j == k else 0)).alias("f" + a) for j, a in enumerate(AXES)]) for k in range(3) for s in (0, 1)])
    f = v.select("cloud_id", F.explode(faces).alias("f")).select("cloud_id", "f.*")
    only = f.groupBy("cloud_id", "axis", "fx", "fy", "fz").agg(F.count("*").alias("n"), F.min("side").alias("side")).filter("n = 1")
    return only.select("cloud_id", "axis", "side", *[F.col("f" + a).alias("c" + a) for a in AXES])


# --- hand and eye: poses as rows of a rotation and a shift


def _poses(pdf: pd.DataFrame, name: str) -> np.ndarray:
    m = np.tile(np.eye(4), (len(pdf), 1, 1))
    for i in range(3):
        for j in range(3):
            m[:, i, j] = pdf[f"{name}_r{i + 1}{j + 1}"]
        m[:, i, 3] = pdf[f"{name}_t{'xyz'[i]}"]
    return m


def _log(r: np.ndarray) -> np.ndarray:
    """The turn vector of a rotation."""
    c = np.clip((np.trace(r) - 1) / 2, -1, 1)
    t = np.arccos(c)
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if t < 1e-9:
        return v / 2
    if np.pi - t < 1e-6:
        w, u = np.linalg.eigh((r + r.T) / 2)
        return t * u[:, -1]
    return t * v / (2 * np.sin(t))


def hand_eye(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """X with A X = X B over motions A of the hand and B of the eye: rotation by aligning turn vectors, then a linear shift."""
    u, v = np.array([_log(m[:3, :3]) for m in a]), np.array([_log(m[:3, :3]) for m in b])
    s, _, w = np.linalg.svd(v.T @ u)
    r = w.T @ np.diag([1, 1, np.sign(np.linalg.det(w.T @ s.T))]) @ s.T
    left = np.concatenate([m[:3, :3] - np.eye(3) for m in a])
    right = np.concatenate([r @ n[:3, 3] - m[:3, 3] for m, n in zip(a, b, strict=True)])
    x = np.eye(4)
    x[:3, :3], x[:3, 3] = r, np.linalg.lstsq(left, right, rcond=None)[0]
    return x


_POSE = [f"{n}_{k}" for n in ("robot", "camera") for k in [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["tx", "ty", "tz"]]
_EYE = "rig_id long, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", tx double, ty double, tz double, rotation_error double, translation_error double, num_poses long, is_valid boolean"


def _residual(a, b, x) -> tuple[float, float]:
    d = [(m @ x, x @ n) for m, n in zip(a, b, strict=True)]
    return float(np.mean([np.degrees(np.linalg.norm(_log(p[:3, :3].T @ q[:3, :3]))) for p, q in d])), float(np.mean([np.linalg.norm(p[:3, 3] - q[:3, 3]) for p, q in d]))


@table_op("hand_eye_calibration", "poses", _EYE.replace(" long", "").replace(" double", "").replace(" boolean", "").replace(",", ""), calibration_mode="eye_in_hand", optimization_method="tsai", num_poses=15, max_rotation_error=2.0, max_translation_error=5.0)
def hand_eye_calibration(poses, calibration_mode, optimization_method, num_poses, max_rotation_error, max_translation_error):
    """Rows (rig_id, pose_id, robot_*, camera_*): robot is hand to base, camera is target to camera. A rig's poses fit in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in _EYE.split(", ")]
        pdf = pdf.sort_values("pose_id")
        g, c = _poses(pdf, "robot"), _poses(pdf, "camera")
        if len(g) < 3:
            return pd.DataFrame(columns=names)
        g = np.linalg.inv(g) if calibration_mode == "eye_to_hand" else g
        a = np.stack([np.linalg.inv(g[j]) @ g[i] for i in range(len(g)) for j in range(i)])
        b = np.stack([c[j] @ np.linalg.inv(c[i]) for i in range(len(g)) for j in range(i)])
        x = hand_eye(a, b)
        turn, shift = _residual(a, b, x)
        return pd.DataFrame([[int(pdf.rig_id.iloc[0]), *x[:3, :3].ravel(), *x[:3, 3], turn, shift, len(g), turn <= max_rotation_error and shift <= max_translation_error]], columns=names)

    return poses.select("rig_id", "pose_id", *_POSE).groupBy("rig_id").applyInPandas(one, _EYE)


def _times(a: str, b: str) -> dict:
    """The product of the poses of two prefixes, as columns."""
    m = lambda p, i, j: F.col(f"{p}r{i}{j}")
    out = {f"r{i}{j}": sum((m(a, i, k) * m(b, k, j) for k in (2, 3)), m(a, i, 1) * m(b, 1, j)) for i in (1, 2, 3) for j in (1, 2, 3)}
    return out | {f"t{n}": F.col(f"{a}t{n}") + sum((m(a, i, k) * F.col(f"{b}t{'xyz'[k - 1]}") for k in (2, 3)), m(a, i, 1) * F.col(f"{b}tx")) for i, n in enumerate("xyz", 1)}


@table_op("hand_eye_pose_estimate", "poses calibration", "pose_id r11 r12 r13 r21 r22 r23 r31 r32 r33 tx ty tz", calibration_mode="eye_in_hand")
def pose_estimate(poses, calibration, calibration_mode):
    """The target in the base's frame: robot x hand-eye x camera, native products of columns."""
    cells = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["tx", "ty", "tz"]
    j = poses.join(calibration.select("rig_id", *[F.col(c).alias("eye_" + c) for c in cells]), "rig_id")
    first = _times("robot_", "eye_") if calibration_mode == "eye_in_hand" else {c: F.col("eye_" + c) for c in cells}
    j = j.select("rig_id", "pose_id", *[F.col("camera_" + c) for c in cells], *[v.alias("hand_" + k) for k, v in first.items()])
    return j.select("rig_id", "pose_id", *[v.alias(k) for k, v in _times("hand_", "camera_").items()])


@table_op("hand_eye_verify", "poses calibration", "rig_id rotation_error translation_error is_valid", max_rotation_error=2.0, max_translation_error=5.0)
def hand_eye_verify(poses, calibration, max_rotation_error, max_translation_error):
    """A target at rest has one place in the base's frame: the mean turn and distance of each pose's estimate from the rig's first."""
    e = pose_estimate(poses, calibration, "eye_in_hand")
    w = Window.partitionBy("rig_id").orderBy("pose_id")
    cells = [c for c in e.columns if c not in ("rig_id", "pose_id")]
    e = e.select("rig_id", *cells, *[F.first(c).over(w).alias("f_" + c) for c in cells])
    trace = sum((F.col(f"r{i}{j}") * F.col(f"f_r{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)), F.lit(0.0))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    gap = F.sqrt(sum(((F.col("t" + a) - F.col("f_t" + a)) ** 2 for a in AXES), F.lit(0.0)))
    s = e.groupBy("rig_id").agg(F.avg(turn).alias("rotation_error"), F.avg(gap).alias("translation_error"))
    return s.withColumn("is_valid", (F.col("rotation_error") <= max_rotation_error) & (F.col("translation_error") <= max_translation_error))


# --- photometric surfaces: rows (frame_id, y, x, ...)


@table_op("albedo_estimate", "pixels normals lights", "albedo", normalize_albedo=True, albedo_min=0.0, albedo_max=1.0)
def albedo(pixels, normals, lights, normalize_albedo, albedo_min, albedo_max):
    """Least squares of v = albedo (n . l) over a pixel's lights; normalised to the limits within a frame."""
    j = pixels.join(lights, "light_id").join(normals.select("frame_id", "y", "x", "nx", "ny", "nz"), ["frame_id", "y", "x"])
    d = F.greatest(F.lit(0.0), F.col("nx") * F.col("lx") + F.col("ny") * F.col("ly") + F.col("nz") * F.col("lz"))
    s = j.groupBy("frame_id", "y", "x").agg((F.sum(F.col("v") * d) / F.nullif(F.sum(d * d), F.lit(0.0))).alias("albedo")).withColumn("albedo", F.coalesce("albedo", F.lit(0.0)))
    if not normalize_albedo:
        return s
    span = s.groupBy("frame_id").agg(F.min("albedo").alias("lo"), F.max("albedo").alias("hi"))
    u = F.when(F.col("hi") > F.col("lo"), (F.col("albedo") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return s.join(span, "frame_id").select("frame_id", "y", "x", (u * (albedo_max - albedo_min) + albedo_min).alias("albedo"))


@table_op("specularity_remove", "pixels", "frame_id y x v n_lights", method=0, threshold=0.1)
def specularity(pixels, method, threshold):
    """Of a pixel's lights the median, or the least with method 1: highlights are seen under few of them."""
    pick = F.min("v") if method == 1 else F.expr("percentile(v, 0.5)")
    return pixels.groupBy("frame_id", "y", "x").agg(pick.alias("v"), F.count("*").alias("n_lights"))


@table_op("surface_normal_estimate", "normals", "red green blue", smooth_normals=True, smooth_window_size=3)
def normal_colours(normals, smooth_normals, smooth_window_size):
    """Each component from -1..1 to 0..255."""
    return normals.select("*", *[F.floor((F.col(n) + 1) * 127.5 + 1e-9).cast("int").alias(c) for n, c in (("nx", "red"), ("ny", "green"), ("nz", "blue"))])


@table_op("surface_height_reconstruct", "gradients", "height", integration_method=0, height_scale=1.0)
def heights(gradients, integration_method, height_scale):
    """Along the first column, then along each row: running sums of q and p by trapezoids. Least height of a frame is 0."""
    down = Window.partitionBy("frame_id").orderBy("y")
    along = Window.partitionBy("frame_id", "y").orderBy("x")
    first = gradients.filter("x = 0").withColumn("s", F.coalesce((F.col("q") + F.lag("q").over(down)) / 2, F.lit(0.0)))
    edge = first.select("frame_id", "y", F.sum("s").over(down).alias("h0"))
    rows = gradients.withColumn("s", F.coalesce((F.col("p") + F.lag("p").over(along)) / 2, F.lit(0.0))).withColumn("h", F.sum("s").over(along))
    h = rows.join(edge, ["frame_id", "y"]).select("frame_id", "y", "x", (F.col("h") + F.col("h0")).alias("h"))
    low = h.groupBy("frame_id").agg(F.min("h").alias("lo"))
    return h.join(low, "frame_id").select("frame_id", "y", "x", ((F.col("h") - F.col("lo")) * height_scale).alias("height"))


@table_op("surface_curvature", "gradients", "mean_curvature gaussian_curvature", compute_mean_curvature=True, compute_gaussian_curvature=True)
def curvatures(gradients, compute_mean_curvature, compute_gaussian_curvature):
    """From p = dz/dx and q = dz/dy by central differences (one-sided at the ends)."""
    def slope(c, part, order):
        w = Window.partitionBy("frame_id", part).orderBy(order)
        a, b = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce((b - a) / 2, b - F.col(c), F.col(c) - a, F.lit(0.0))

    s = gradients.select("*", slope("p", "y", "x").alias("zxx"), slope("p", "x", "y").alias("zxy"), slope("q", "x", "y").alias("zyy"))
    p, q, xx, xy, yy = (F.col(k) for k in ("p", "q", "zxx", "zxy", "zyy"))
    n = p * p + q * q + 1
    return s.select("frame_id", "y", "x", (((q * q + 1) * xx - p * q * xy * 2 + (p * p + 1) * yy) / (F.pow(n, F.lit(1.5)) * 2)).alias("mean_curvature"), ((xx * yy - xy * xy) / (n * n)).alias("gaussian_curvature"))


@table_op("multiple_light_acquire", "frames", "light_id lx ly lz", num_light_directions=4)
def light_rows(frames, num_light_directions):
    """Every frame once for each light, evenly around at 45 degrees."""
    n = int(num_light_directions)
    at = F.array(*[F.struct(F.lit(k).alias("light_id"), F.lit(float(np.cos(2 * np.pi * k / n) * 0.5**0.5)).alias("lx"), F.lit(float(np.sin(2 * np.pi * k / n) * 0.5**0.5)).alias("ly"), F.lit(0.5**0.5).alias("lz")) for k in range(n)])
    return frames.select("*", F.explode(at).alias("__l")).select(*frames.columns, "__l.*")


@measure_op("photometric_stereo_calibrate", "lx double, ly double, lz double", target_type=0, sphere_radius=25.0, plane_normal_x=0.0, plane_normal_y=0.0, plane_normal_z=1.0)
def sphere_light(image, target_type, sphere_radius, plane_normal_x, plane_normal_y, plane_normal_z):
    """On a sphere about the frame's middle the brightest place's normal halves the angle between view and light."""
    v = gray(image)
    y, x = np.nonzero(v == v.max())
    n = np.array([x.mean() - (v.shape[1] - 1) / 2, y.mean() - (v.shape[0] - 1) / 2]) / sphere_radius
    n = np.append(n, np.sqrt(max(0.0, 1 - n @ n))) if target_type == 0 else np.array([plane_normal_x, plane_normal_y, plane_normal_z])
    light = 2 * n[2] * n - (0, 0, 1)
    light = light / max(np.linalg.norm(light), 1e-9)
    return {"lx": float(light[0]), "ly": float(light[1]), "lz": float(light[2])}


@image_op("shape_from_shading", light_direction_x=0.0, light_direction_y=0.0, light_direction_z=1.0, albedo=0.5, iterations=100)
def shading(image, light_direction_x, light_direction_y, light_direction_z, albedo, iterations):
    """Height that is flat where the frame is brightest: Poisson relaxation of slopes whose size follows from the brightness."""
    v = gray(image).astype(np.float64) / max(float(gray(image).max()), 1.0)
    slope = np.sqrt(np.maximum(1 / np.maximum(v, 0.1) ** 2 - 1, 0))
    gx, gy = gradient(gray(image))
    size = np.maximum(np.hypot(gx, gy), 1e-9)
    p, q = slope * gx / size, slope * gy / size
    d = np.gradient(p, axis=1) + np.gradient(q, axis=0)
    z = np.zeros_like(v)
    for _ in range(int(iterations)):
        w = np.pad(z, 1, mode="edge")
        z = (w[:-2, 1:-1] + w[2:, 1:-1] + w[1:-1, :-2] + w[1:-1, 2:] - d) / 4
        z -= z.mean()
    span = np.ptp(z)
    return clamp((z - z.min()) * (255 / span if span > 1e-9 else 0))[:, :, None]


# --- measuring models applied to frames


@table_op("MeasureModelApply", "image model", "frame_id object_id kind value x y valid", pixel_size=1.0)
def model_apply(image, model, pixel_size):
    """Every object of every model measured in every frame: models are few rows, sent to the frames as an argument would be.

    Lines give the scanned line's angle, circles and arcs the radius, rectangles the width across.
    """
    objects = model.select(F.explode("objects").alias("o")).select("o.*").collect()
    todo = [(o.object_id, o.kind, dict(o.params)) for o in objects]

    def step(frame):
        out = []
        for name, kind, p in todo:
            row, col, t = p["center_row"], p["center_col"], p.get("threshold", 30.0)
            if kind in ("circle", "arc"):
                c = fit_circle(ring(frame, col, row, p["radius"], p.get("start_angle", 0.0), p.get("end_angle", 360.0), p.get("num_points", 36.0), t, 0))
                value, x, y, ok = c["radius"], c["center_x"], c["center_y"], c["valid"]
            else:
                w, h = (p["length1"], p["length2"]) if kind == "rectangle" else (20.0, p["length"])
                found = _scans(frame, col - w / 2, row - h / 2, w, h, 0.0, t, p.get("sigma", 1.0))
                line = fit_line(found)
                ok = line["valid"]
                value, (x, y) = (float(np.degrees(np.arctan2(-line["line_a"], line["line_b"])) % 180), found.mean(0)) if ok else (0.0, (0.0, 0.0))
            out.append({"object_id": name, "kind": kind, "value": float(value if kind == "line" else value * pixel_size), "x": float(x), "y": float(y), "valid": bool(ok)})
        return out

    return measure_images(image, step, "object_id string, kind string, value double, x double, y double, valid boolean")


# --- fits over long tables


@table_op("EllipseFitMeasure", "points", "center_x center_y major_axis minor_axis angle_deg area perimeter ellipticity is_valid", key="object_id")
def ellipse_fit(points, key):
    """The ellipse of equal second moments, for points spread over its border; Ramanujan's perimeter. Axes are half lengths."""
    e = ellipse_measure(points, key)
    a, b = F.col("major_axis") / F.sqrt(F.lit(2.0)), F.col("minor_axis") / F.sqrt(F.lit(2.0))
    e = e.select("*", a.alias("__a"), b.alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    around = F.pi() * ((a + b) * 3 - F.sqrt((a * 3 + b) * (a + b * 3)))
    return e.select(key, "center_x", "center_y", a.alias("major_axis"), b.alias("minor_axis"), "angle_deg", (F.pi() * a * b).alias("area"), around.alias("perimeter"), F.when(a > 0, b / a).otherwise(0.0).alias("ellipticity"), (b > 1e-9).alias("is_valid"))


# --- checkpoints of training


@table_op("TrainCheckpoint", "checkpoints", "kept is_best", key="run_id", step="step", loss="loss", checkpoint_dir="./checkpoints", save_interval=5, max_checkpoints=5, save_best=True, restore_from="")
def train_checkpoint(checkpoints, key, step, loss, checkpoint_dir, save_interval, max_checkpoints, save_best, restore_from):
    """Of the steps on the interval the latest so many stay, with the best of all if asked."""
    due = F.col(step) % int(save_interval) == 0
    latest = F.row_number().over(Window.partitionBy(key, due).orderBy(F.desc(step)))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col(loss).asc_nulls_last(), step)) == 1
    out = checkpoints.select("*", (due & (latest <= int(max_checkpoints))).alias("__k"), best.alias("is_best"))
    return out.select(*checkpoints.columns, (F.col("__k") | (F.col("is_best") & F.lit(bool(save_best)))).alias("kept"), "is_best")


# --- several cameras: poses from the corners of a flat pattern


def plane_pose(world: np.ndarray, image: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, float]:
    """The pattern's pose (4 x 4) from its plane points and their images, through a pinhole, and the mean reprojection error."""
    x = (image - [cx, cy]) / [fx, fy]
    mid, size = world.mean(0), max(float(np.abs(world - world.mean(0)).max()), 1e-9)
    w = (world - mid) / size
    rows = np.zeros((2 * len(w), 9))
    rows[::2, :3], rows[1::2, 3:6] = np.column_stack((w, np.ones(len(w)))), np.column_stack((w, np.ones(len(w))))
    rows[::2, 6:], rows[1::2, 6:] = -x[:, :1] * rows[::2, :3], -x[:, 1:] * rows[1::2, 3:6]
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3) @ np.array([[1 / size, 0, -mid[0] / size], [0, 1 / size, -mid[1] / size], [0, 0, 1]])
    h /= np.sqrt(np.linalg.norm(h[:, 0]) * np.linalg.norm(h[:, 1])) * (np.sign(h[2] @ [*mid, 1]) or 1)
    u, _, v = np.linalg.svd(np.column_stack((h[:, 0], h[:, 1], np.cross(h[:, 0], h[:, 1]))))
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v, h[:, 2]
    return refined_pose(pose, world, image, fx, fy, cx, cy, 20, 1e-10)


def _turn(v: np.ndarray) -> np.ndarray:
    """The rotation of a turn vector."""
    t = np.linalg.norm(v)
    if t < 1e-12:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / t
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def _off(pose: np.ndarray, world: np.ndarray, image: np.ndarray, fx, fy, cx, cy) -> np.ndarray:
    p = np.column_stack((world, np.zeros(len(world)))) @ pose[:3, :3].T + pose[:3, 3]
    return (p[:, :2] / p[:, 2:] * [fx, fy] + [cx, cy] - image).ravel()


def refined_pose(pose, world, image, fx, fy, cx, cy, rounds: int, threshold: float, turn: bool = True, shift: bool = True) -> tuple[np.ndarray, float]:
    """Gauss and Newton's steps on the reprojection error, of at most six numbers."""
    free = [k for k in range(6) if (turn if k < 3 else shift)]
    step_of = lambda d: np.block([[_turn(d[:3]), d[3:, None]], [np.zeros((1, 3)), np.ones((1, 1))]])
    e = _off(pose, world, image, fx, fy, cx, cy)
    for _ in range(int(rounds)):
        j = np.column_stack([(_off(step_of(np.eye(6)[k] * 1e-6) @ pose, world, image, fx, fy, cx, cy) - e) / 1e-6 for k in free]) if free else np.zeros((len(e), 0))
        d = np.zeros(6)
        d[free] = -np.linalg.lstsq(j, e, rcond=None)[0]
        new = step_of(d) @ pose
        f = _off(new, world, image, fx, fy, cx, cy)
        if f @ f >= e @ e - threshold * 1e-6:
            break
        pose, e = new, f
    return pose, float(np.hypot(*e.reshape(-1, 2).T).mean())


_MATRIX = ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", tx double, ty double, tz double"
_CAMERA = f"rig_id long, camera_id long, {_MATRIX}, baseline double, reprojection_error double, num_views long"
_LENS = {"fx": 1000.0, "fy": 1000.0, "cx": 320.0, "cy": 240.0}


def _rigs(corners: DataFrame, reference: int, fx, fy, cx, cy, least: int = 1) -> DataFrame:
    """Rows (rig_id, camera_id, view_id, u, v, wx, wy): each camera's pose against the reference camera's, averaged over the
    views that both have. A rig's corners fit in one task; rigs are dealt over all.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in _CAMERA.split(", ")]
        poses, errors = {}, {}
        for (camera, view), g in pdf.sort_values(["camera_id", "view_id", "wy", "wx"]).groupby(["camera_id", "view_id"]):
            if len(g) >= 4:
                pose, error = plane_pose(g[["wx", "wy"]].to_numpy(float), g[["u", "v"]].to_numpy(float), fx, fy, cx, cy)
                poses[camera, view] = pose
                errors.setdefault(camera, []).append(error)
        out = []
        for camera in sorted(errors):
            both = [v for c, v in poses if c == camera and (reference, v) in poses]
            if len(both) < least:
                continue
            rel = [poses[camera, v] @ np.linalg.inv(poses[reference, v]) for v in both]
            u, _, w = np.linalg.svd(np.mean([m[:3, :3] for m in rel], axis=0))
            r, t = u @ np.diag([1, 1, np.linalg.det(u @ w)]) @ w, np.mean([m[:3, 3] for m in rel], axis=0)
            out.append([int(pdf.rig_id.iloc[0]), int(camera), *r.ravel(), *t, float(np.linalg.norm(t)), float(np.mean(errors[camera])), len(both)])
        return pd.DataFrame(out, columns=names)

    return corners.select("rig_id", "camera_id", "view_id", "u", "v", "wx", "wy").groupBy("rig_id").applyInPandas(one, _CAMERA)


_OUT = _CAMERA.replace(" long", "").replace(" double", "").replace(",", "")
_PATTERN = {"pattern_width": 9, "pattern_height": 6, "square_size": 25.0}
table_op("multi_camera_calibrate", "corner_points", _OUT, num_cameras=2, **_PATTERN, **_LENS)(lambda corner_points, num_cameras, pattern_width, pattern_height, square_size, fx, fy, cx, cy: _rigs(corner_points.filter(F.col("camera_id") < int(num_cameras)), 0, fx, fy, cx, cy))
table_op("calibrate_cameras", "corner_points", _OUT, num_cameras=4, **_PATTERN, reference_camera=0, **_LENS)(lambda corner_points, num_cameras, pattern_width, pattern_height, square_size, reference_camera, fx, fy, cx, cy: _rigs(corner_points.filter(F.col("camera_id") < int(num_cameras)), int(reference_camera), fx, fy, cx, cy))
table_op("stereo_calibrate_extended", "corner_points", _OUT, **_PATTERN, min_images=10, **_LENS)(lambda corner_points, pattern_width, pattern_height, square_size, min_images, fx, fy, cx, cy: _rigs(corner_points.filter("camera_id < 2"), 0, fx, fy, cx, cy, int(min_images)).filter("camera_id = 1"))

_REFINED = f"rig_id long, camera_id long, view_id long, {_MATRIX}, initial_error double, refined_error double, improvement double"


@table_op("calibration_refine", "calibration_result corner_points", _REFINED.replace(" long", "").replace(" double", "").replace(",", ""), max_iterations=100, convergence_threshold=1e-6, enable_rotation_refinement=True, enable_translation_refinement=True, **_LENS)
def calibration_refine(calibration_result, corner_points, max_iterations, convergence_threshold, enable_rotation_refinement, enable_translation_refinement, fx, fy, cx, cy):
    """Poses (rig_id, camera_id, view_id, r11 to tz) moved to the least reprojection error of their view's corners."""
    cells = [x.split()[0] for x in _MATRIX.split(", ")]
    keys = ["rig_id", "camera_id", "view_id"]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in _REFINED.split(", ")]
        if not len(a) or len(b) < 4:
            return pd.DataFrame(columns=names)
        b = b.sort_values(["wy", "wx"])
        pose = np.eye(4)
        pose[:3, :3], pose[:3, 3] = a[cells[:9]].iloc[0].to_numpy(float).reshape(3, 3), a[cells[9:]].iloc[0].to_numpy(float)
        world, image = b[["wx", "wy"]].to_numpy(float), b[["u", "v"]].to_numpy(float)
        before = float(np.hypot(*_off(pose, world, image, fx, fy, cx, cy).reshape(-1, 2).T).mean())
        pose, after = refined_pose(pose, world, image, fx, fy, cx, cy, max_iterations, convergence_threshold, enable_rotation_refinement, enable_translation_refinement)
        return pd.DataFrame([[*[int(a[k].iloc[0]) for k in keys], *pose[:3, :3].ravel(), *pose[:3, 3], before, after, before - after]], columns=names)

    return calibration_result.select(*keys, *cells).groupBy(*keys).cogroup(corner_points.select(*keys, "u", "v", "wx", "wy").groupBy(*keys)).applyInPandas(one, _REFINED)
