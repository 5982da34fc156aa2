"""Segmentation, corners and their matching, traced contours, sub-pixel edges, calipers on corners, stitching, stereo."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from ..frames import zip_images
from ..spec import Operator, register
from .images import box_sum, canny, clamp, gradient, gray, image_op, odd, otsu, pair_op, sample, thinning, windows
from .industry import SHAPE, evenness, parts
from .inspect import _ROI, _edges, _swept, find_edge, fit_circle, fit_line, hits, pair_measure, phase_correlation
from .measures import CORNER, _along, _peaks, edge_length, edges_on, flusser, hu, label, measure_op, profile, table_op

# --- segmentation


def flood(plane: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Watershed: basins grow from labelled seeds in order of height, first come first served among equals."""
    h, w = plane.shape
    out, queue, n = seeds.copy(), [], 0
    for y, x in np.argwhere(seeds > 0):
        heapq.heappush(queue, (int(plane[y, x]), n, int(y), int(x)))
        n += 1
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for v, u in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= v < h and 0 <= u < w and not out[v, u]:
                out[v, u] = out[y, x]
                heapq.heappush(queue, (max(int(plane[v, u]), int(plane[y, x])), n, v, u))
                n += 1
    return out


@image_op("Watershed", marker_method="Auto", min_region_size=10)
def watershed(image, marker_method, min_region_size):
    """Regions of the gradient's height; seeds are the level parts of it. Samples hold the region's number modulo 255, from 1."""
    plane = gray(image)
    wide = np.pad(plane.astype(np.float64), 1, mode="edge")
    height = np.hypot(wide[1:-1, 2:] - wide[1:-1, :-2], wide[2:, 1:-1] - wide[:-2, 1:-1]) / 2
    flat, n = label(height <= max(np.median(height), 1))
    size = np.bincount(flat.ravel(), minlength=n + 1)
    seeds = np.where(size[flat] >= min_region_size, flat, 0)
    if not seeds.any():
        seeds = np.ones_like(flat)
    out = flood(clamp(height), seeds)
    _, names = np.unique(out, return_inverse=True)
    return (names.reshape(out.shape) % 255 + 1).astype(np.uint8)[:, :, None]


def k_means(points: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres start at even ranks of brightness, so reruns agree; an empty cluster keeps its centre."""
    order = np.argsort(points.sum(1), kind="stable")
    at = ((np.arange(k) + 0.5) / k * len(points)).astype(int)
    centers = points[order[at]].astype(np.float64)
    for _ in range(max(1, int(rounds))):
        near = (-2 * points @ centers.T + (centers**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        new = np.stack([np.bincount(near, points[:, c], k) for c in range(points.shape[1])], 1) / np.maximum(n, 1)[:, None]
        new = np.where(n[:, None] > 0, new, centers)
        if np.allclose(new, centers):
            break
        centers = new
    return near, centers


@image_op("KMeansSegment", k=4, max_iterations=100)
def kmeans_segment(image, k, max_iterations):
    """Every sample takes its cluster's colour."""
    flat = image.reshape(-1, image.shape[2]).astype(np.float64)
    near, centers = k_means(flat, max(1, min(int(k), len(flat))), max_iterations)
    return clamp(np.round(centers))[near].reshape(image.shape)


@image_op("RegionSplitMerge", min_size=16, threshold=20, merge_threshold=10)
def split_merge(image, min_size, threshold, merge_threshold):
    """Blocks split in four while their range exceeds the threshold; neighbouring blocks of like means are joined. Samples take their region's mean."""
    v = gray(image).astype(np.float64)
    todo, ids, means = [(0, 0, *v.shape)], np.zeros(v.shape, int), []
    while todo:
        y, x, h, w = todo.pop()
        b = v[y : y + h, x : x + w]
        if h * w > min_size and h > 1 and w > 1 and np.ptp(b) > threshold:
            todo += [(y, x, h // 2, w // 2), (y, x + w // 2, h // 2, w - w // 2), (y + h // 2, x, h - h // 2, w // 2), (y + h // 2, x + w // 2, h - h // 2, w - w // 2)]
        else:
            ids[y : y + h, x : x + w] = len(means)
            means.append(b.mean())
    means, parent = np.array(means), list(range(len(means)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    pairs = np.concatenate([np.stack((a.ravel(), b.ravel()), 1) for a, b in ((ids[1:], ids[:-1]), (ids[:, 1:], ids[:, :-1]))])
    for a, b in np.unique(np.sort(pairs, 1), axis=0):
        if abs(means[a] - means[b]) <= merge_threshold:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    roots = np.array([root(k) for k in range(len(means))])[ids]
    total, n = np.bincount(roots.ravel(), v.ravel(), len(means)), np.bincount(roots.ravel(), minlength=len(means))
    return clamp(np.round(total / np.maximum(n, 1)))[roots][:, :, None]


@image_op("Superpixel", num_superpixels=100, compactness=10, iterations=10)
def superpixel(image, num_superpixels, compactness, iterations):
    """Local k-means over place and colour: each sample compares the centres of its own and the eight neighbouring grid cells."""
    h, w, c = image.shape
    step = max(1, int(np.sqrt(h * w / max(1, num_superpixels))))
    rows, cols = -(-h // step), -(-w // step)
    y, x = np.indices((h, w))
    home = (y // step, x // step)
    color = image.astype(np.float64)
    name = home[0] * cols + home[1]
    scale = (compactness / step) ** 2
    for _ in range(max(1, int(iterations))):
        n = np.maximum(np.bincount(name.ravel(), minlength=rows * cols), 1)
        mean = [np.bincount(name.ravel(), v.ravel(), rows * cols) / n for v in (y, x, *np.moveaxis(color, 2, 0))]
        best, at = np.full((h, w), np.inf), name
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                r, q = home[0] + dy, home[1] + dx
                k = np.clip(r, 0, rows - 1) * cols + np.clip(q, 0, cols - 1)
                d = scale * ((y - mean[0][k]) ** 2 + (x - mean[1][k]) ** 2) + sum((color[:, :, i] - mean[2 + i][k]) ** 2 for i in range(c))
                d = np.where((r >= 0) & (r < rows) & (q >= 0) & (q < cols), d, np.inf)
                at, best = np.where(d < best, k, at), np.minimum(d, best)
        name = at
    n = np.maximum(np.bincount(name.ravel(), minlength=rows * cols), 1)
    return np.stack([clamp(np.round(np.bincount(name.ravel(), color[:, :, i].ravel(), rows * cols) / n))[name] for i in range(c)], 2)


@image_op("MeanShiftSegment", spatial_radius=10, color_radius=20, min_density=50)
def mean_shift(image, spatial_radius, color_radius, min_density):
    """Every sample moves, five times, to the mean of the neighbours of like grey level; a frame of the settled levels."""
    v, k = gray(image).astype(np.float64), max(1, int(spatial_radius) // 2)
    out = v.copy()
    wide = np.pad(v, k, mode="edge")
    for _ in range(5):
        total, n = np.zeros_like(v), np.zeros_like(v)
        for dy in range(2 * k + 1):
            for dx in range(2 * k + 1):
                near = wide[dy : dy + v.shape[0], dx : dx + v.shape[1]]
                like = abs(near - out) <= color_radius
                total += np.where(like, near, 0)
                n += like
        out = np.where(n > 0, total / np.maximum(n, 1), out)
    return clamp(np.round(out))[:, :, None]


def _two_colours(image, front: np.ndarray, back: np.ndarray, rounds: int) -> np.ndarray:
    """Foreground by the nearer of two mean colours, smoothed by the majority of the neighbourhood, refitted `rounds` times."""
    v = image.astype(np.float64)
    on = front.copy()
    for _ in range(max(1, rounds)):
        a, b = v[on & ~back].mean(0) if (on & ~back).any() else v[front].mean(0), v[~on].mean(0) if (~on).any() else v[back].mean(0)
        near = ((v - a) ** 2).sum(2) < ((v - b) ** 2).sum(2)
        new = windows(near[:, :, None].astype(np.uint8), 1).sum((-1, -2))[:, :, 0] >= 5
        if (new == on).all():
            break
        on = new
    return on


@image_op("GraphCut", fg_seed_x=0, fg_seed_y=0, bg_seed_x=0, bg_seed_y=0)
def graph_cut(image, fg_seed_x, fg_seed_y, bg_seed_x, bg_seed_y):
    """A least cut between the seeds, found as a watershed of the gradient from both."""
    seeds = np.zeros(image.shape[:2], int)
    seeds[int(bg_seed_y), int(bg_seed_x)], seeds[int(fg_seed_y), int(fg_seed_x)] = 1, 2
    cut = flood(clamp(np.hypot(*gradient(gray(image))) / 4), seeds)
    return np.where(cut == 2, 255, 0).astype(np.uint8)[:, :, None]


@image_op("GrabCut", rect_x=0, rect_y=0, rect_w=100, rect_h=100, iterations=5, auto_rect=True)
def grab_cut(image, rect_x, rect_y, rect_w, rect_h, iterations, auto_rect):
    """Inside the box whatever is nearer the box's colour than the outside's; all outside is background."""
    h, w = image.shape[:2]
    x, y, rw, rh = (w // 8, h // 8, w * 3 // 4, h * 3 // 4) if auto_rect else (int(rect_x), int(rect_y), int(rect_w), int(rect_h))
    front = np.zeros((h, w), bool)
    front[y : y + rh, x : x + rw] = True
    on = _two_colours(image, front, ~front, int(iterations)) & front if front.any() and not front.all() else front
    return np.where(on, 255, 0).astype(np.uint8)[:, :, None]


NAMED = {"black": (0, 0, 0), "white": (255, 255, 255), "gray": (128, 128, 128), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "orange": (255, 165, 0)}


@measure_op("color_recognize", "rank long, red long, green long, blue long, share double, color_name string", max_colors=5.0, method="histogram")
def color_recognize(image, max_colors, method):
    """The commonest colours, in bins of 32 levels; each is its bin's mean with the nearest name."""
    v = (image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, 2)).reshape(-1, 3).astype(int)
    key = (v // 32) @ np.array([64, 8, 1])
    n = np.bincount(key, minlength=512)
    out = []
    for rank, k in enumerate(np.lexsort((np.arange(512), -n))[: int(max_colors)]):
        if n[k]:
            mean = v[key == k].mean(0)
            name = min(NAMED, key=lambda c: (float(((mean - NAMED[c]) ** 2).sum()), c))
            out.append({"rank": rank + 1, "red": int(mean[0]), "green": int(mean[1]), "blue": int(mean[2]), "share": float(n[k] / len(v)), "color_name": name})
    return out


@measure_op("TextureAnalysis", "uniformity double, coarseness double, contrast double, entropy double")
def texture(image):
    """Of pairs of horizontal neighbours in eight grey levels: sum of squared shares, mean of 1 / (1 + difference), contrast, entropy."""
    v = gray(image).astype(int) // 32
    a, b = v[:, :-1].ravel(), v[:, 1:].ravel()
    p = np.bincount(a * 8 + b, minlength=64) / max(len(a), 1)
    i, j = np.divmod(np.arange(64), 8)
    return {"uniformity": float((p**2).sum()), "coarseness": float((p / (1 + abs(i - j))).sum()), "contrast": float((p * (i - j) ** 2).sum()), "entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum() + 0.0)}


# --- frequency domain: a spectrum is a Float32 frame of real and imaginary samples, two channels


image_op("FFTForward")(lambda image: (lambda f: np.stack((f.real, f.imag), 2).astype(np.float32))(np.fft.fft2(gray(image).astype(np.float64))))
image_op("FFTInverse")(lambda image: clamp(np.round(np.fft.ifft2(image[:, :, 0] + 1j * image[:, :, 1]).real, 3))[:, :, None])


@pair_op("WienerFilter", noise_power=0.01)
def wiener_deconvolve(image, other, noise_power):
    """Undo the blur whose kernel `other` holds about its centre."""
    k = gray(other).astype(np.float64)
    h = np.fft.fft2(np.fft.ifftshift(k / max(k.sum(), 1e-9)))
    return clamp(np.fft.ifft2(np.fft.fft2(gray(image).astype(np.float64)) * np.conj(h) / (abs(h) ** 2 + noise_power)).real + 1e-6)[:, :, None]


@pair_measure("FrequencyDefectDetect", SHAPE, low_cutoff=0.05, high_cutoff=0.4, threshold=30.0)
def frequency_defect(image, other, low_cutoff, high_cutoff, threshold):
    """What the difference from the template holds between the cutoffs, in pieces."""
    d = gray(image).astype(np.float64) - gray(other)
    f = np.hypot(np.fft.fftfreq(d.shape[0])[:, None], np.fft.fftfreq(d.shape[1]))
    return parts(abs(np.fft.ifft2(np.fft.fft2(d) * ((f >= low_cutoff) & (f <= high_cutoff))).real) > threshold)


@measure_op("TextureAnalysisFFT", "ring long, energy double", num_features=10)
def texture_fft(image, num_features):
    """Shares of spectral energy, without the mean, in rings of equal width up to half a cycle a sample."""
    v = gray(image).astype(np.float64)
    power = abs(np.fft.fft2(v - v.mean())) ** 2
    r = np.hypot(np.fft.fftfreq(v.shape[0])[:, None], np.fft.fftfreq(v.shape[1]))
    k = np.minimum((r * 2 * num_features).astype(int), int(num_features) - 1)
    e = np.bincount(k.ravel(), power.ravel(), int(num_features))
    return [{"ring": i, "energy": float(x / e.sum()) if e.sum() > 0 else 0.0} for i, x in enumerate(e)]


# --- corners, descriptors, matching

RING = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]


@measure_op("FastCorner", CORNER, threshold=20, max_corners=100, draw_corners=True)
def fast(image, threshold, max_corners, draw_corners):
    """Nine neighbours in a row on the ring of sixteen, all brighter or all darker by the threshold; the response is the sum of excesses."""
    v = gray(image).astype(np.int32)
    if min(v.shape) < 7:
        return []
    mid = v[3:-3, 3:-3]
    d = np.stack([v[3 + dy : v.shape[0] - 3 + dy, 3 + dx : v.shape[1] - 3 + dx] - mid for dx, dy in RING])
    score = np.zeros(v.shape)
    for sign in (1, -1):
        on = sign * d > threshold
        run = np.any([np.all([on[(k + j) % 16] for j in range(9)], axis=0) for k in range(16)], axis=0)
        score[3:-3, 3:-3] = np.maximum(score[3:-3, 3:-3], np.where(run, np.where(on, sign * d - threshold, 0).sum(0), 0))
    return _peaks(score, 0, max_corners)


def corners(image, most: int, threshold: float = 1.0) -> np.ndarray:
    """Corners by the smaller eigenvalue of the gradient's second moments: x, y, strongest first."""
    gx, gy = gradient(gray(image))
    box = lambda v: windows(v[:, :, None], 2).sum((-1, -2))[:, :, 0]
    a, b, c = box(gx * gx), box(gx * gy), box(gy * gy)
    found = _peaks((a + c) / 2 - np.hypot((a - c) / 2, b), threshold, most)
    return np.array([(p["x"], p["y"]) for p in found], int).reshape(-1, 2)


@measure_op("SobelCorner", CORNER, threshold=50, max_corners=100, draw_corners=True)
def sobel_corner(image, threshold, max_corners, draw_corners):
    gx, gy = gradient(gray(image))
    box = lambda v: windows(v[:, :, None], 1).mean((-1, -2))[:, :, 0]
    return _peaks(np.minimum(box(abs(gx)), box(abs(gy))), threshold, max_corners)


def described(image, most: int, reach: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Corners off the border with their normalised surroundings."""
    plane = gray(image).astype(np.float64)
    p = corners(image, most)
    p = p[(p >= reach).all(1) & (p[:, 0] < plane.shape[1] - reach) & (p[:, 1] < plane.shape[0] - reach)]
    d = np.array([plane[y - reach : y + reach + 1, x - reach : x + reach + 1].ravel() for x, y in p]).reshape(len(p), (2 * reach + 1) ** 2)
    d = d - d.mean(1, keepdims=True) if len(d) else d
    return p, d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9) if len(d) else d


def matched(a, b, ratio: float, most: int) -> np.ndarray:
    """Places (x1, y1, x2, y2) whose descriptors are each other's nearest and clearly nearer than the second."""
    (p, d), (q, e) = described(a, most), described(b, most)
    if not len(p) or not len(q):
        return np.zeros((0, 4))
    gap = np.sqrt(np.maximum(2 - 2 * d @ e.T, 0))
    near = gap.argmin(1)
    two = np.partition(gap, 1, axis=1)[:, 1] if len(q) > 1 else np.full(len(p), np.inf)
    one = gap[np.arange(len(p)), near]
    keep = (one <= ratio * two) & (gap.argmin(0)[near] == np.arange(len(p)))
    return np.concatenate((p[keep], q[near[keep]]), 1).astype(np.float64)


_MATCH = "x1 double, y1 double, x2 double, y2 double"
_as_rows = lambda m: [dict(zip(("x1", "y1", "x2", "y2"), map(float, r), strict=True)) for r in m]
for _name, _params in {"KeyPointMatch": {}, "FeatureMatch": {"method": "SIFT"}}.items():
    pair_measure(_name, _MATCH, ratio_threshold=0.75, **_params)(lambda image, other, ratio_threshold, **_: _as_rows(matched(image, other, ratio_threshold, 300)))
pair_measure("ImageRegister", "match_count long, shift_x double, shift_y double, success boolean", max_corners=500, ratio_threshold=0.75, min_matches=10)(lambda image, other, max_corners, ratio_threshold, min_matches: (lambda m: {"match_count": len(m), "shift_x": float(np.median(m[:, 0] - m[:, 2])) if len(m) else 0.0, "shift_y": float(np.median(m[:, 1] - m[:, 3])) if len(m) else 0.0, "success": len(m) >= min_matches})(matched(image, other, ratio_threshold, int(max_corners))))


@pair_measure("CornerMatch", _MATCH, search_radius=50)
def corner_match(image, other, search_radius):
    """The best of the corners within the radius, where both choose each other."""
    (p, d), (q, e) = described(image, 300), described(other, 300)
    if not len(p) or not len(q):
        return []
    s = np.where(abs(p[:, None] - q).max(2) <= search_radius, d @ e.T, -2)
    near = s.argmax(1)
    keep = (s[np.arange(len(p)), near] > 0) & (s.argmax(0)[near] == np.arange(len(p)))
    return _as_rows(np.concatenate((p[keep], q[near[keep]]), 1))


def similarity(m: np.ndarray) -> tuple[float, float, float, float]:
    """Scale, angle in degrees and shift of least squares that carry (x1, y1) to (x2, y2)."""
    p, q = m[:, 0] + 1j * m[:, 1], m[:, 2] + 1j * m[:, 3]
    u, v = p - p.mean(), q - q.mean()
    f = (np.conj(u) @ v) / max((abs(u) ** 2).sum(), 1e-12)
    t = q.mean() - f * p.mean()
    return float(abs(f)), float(np.degrees(np.angle(f))), float(t.real), float(t.imag)


def _pose(m: np.ndarray, inside: float = 3.0, tries: int = 200) -> tuple[int, tuple[float, float, float, float]]:
    """Of seeded pairs the similarity that most matches agree with, refitted over those."""
    if len(m) < 2:
        return 0, (1.0, 0.0, 0.0, 0.0)
    rng, best = np.random.default_rng(0), np.zeros(len(m), bool)
    for _ in range(tries):
        s, t, x, y = similarity(m[rng.choice(len(m), 2, replace=False)])
        c, n = s * np.cos(np.radians(t)), s * np.sin(np.radians(t))
        near = np.hypot(c * m[:, 0] - n * m[:, 1] + x - m[:, 2], n * m[:, 0] + c * m[:, 1] + y - m[:, 3]) <= inside
        best = near if near.sum() > best.sum() else best
    return int(best.sum()), similarity(m[best] if best.sum() >= 2 else m)


@pair_measure("DescriptorMatch", "num_matches long, result_x double, result_y double, result_angle double, result_scale double", max_features=300, match_threshold=0.75)
def descriptor_match(image, other, max_features, match_threshold):
    n, (s, t, x, y) = _pose(matched(other, image, match_threshold, int(max_features)))
    return {"num_matches": n, "result_x": x, "result_y": y, "result_angle": t, "result_scale": s}


@pair_measure("FeaturePointMatch", "num_features long, num_matches long, transform_tx double, transform_ty double, transform_angle double, transform_scale double", max_features=500, method="Harris")
def feature_point_match(image, other, max_features, method):
    n, (s, t, x, y) = _pose(matched(other, image, 0.8, int(max_features)))
    return {"num_features": len(corners(image, int(max_features))), "num_matches": n, "transform_tx": x, "transform_ty": y, "transform_angle": t, "transform_scale": s}


pair_measure("FeatureMatchRegister", "match_count long, inlier_count long", max_corners=500, ransac_threshold=3.0, draw_matches=True)(lambda image, other, max_corners, ransac_threshold, draw_matches: (lambda m: {"match_count": len(m), "inlier_count": _pose(m, ransac_threshold)[0]})(matched(image, other, 0.75, int(max_corners))))


def homography(m: np.ndarray) -> np.ndarray:
    """From (x1, y1) to (x2, y2), by the least singular vector of normalised coordinates."""
    def norm(p):
        c, s = p.mean(0), max(np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean(), 1e-9)
        return np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])

    a, b = norm(m[:, :2]), norm(m[:, 2:])
    p, q = (np.column_stack((v, np.ones(len(v)))) @ t.T for v, t in ((m[:, :2], a), (m[:, 2:], b)))
    rows = np.concatenate([np.stack([np.concatenate((-u, np.zeros(3), w[0] * u)), np.concatenate((np.zeros(3), -u, w[1] * u))]) for u, w in zip(p, q, strict=True)])
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


@pair_measure("HomographyCalc", "valid boolean, inlier_count long, " + ", ".join(f"h{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)), ransac_iter=1000, ransac_threshold=3.0)
def homography_calc(image, other, ransac_iter, ransac_threshold):
    """Over matches from the other frame to the image: of seeded quads the map that most agree with, refitted over those."""
    m, best = matched(other, image, 0.8, 500), None
    rng = np.random.default_rng(0)
    for _ in range(min(int(ransac_iter), 1000) if len(m) >= 4 else 0):
        h = homography(m[rng.choice(len(m), 4, replace=False)])
        q = np.column_stack((m[:, :2], np.ones(len(m)))) @ h.T
        near = np.hypot(*(q[:, :2] / np.where(abs(q[:, 2:]) < 1e-9, 1e-9, q[:, 2:]) - m[:, 2:]).T) <= ransac_threshold
        best = near if best is None or near.sum() > best.sum() else best
    ok = best is not None and best.sum() >= 4
    h = homography(m[best]) if ok else np.eye(3)
    return {"valid": bool(ok), "inlier_count": int(best.sum()) if ok else 0} | {f"h{i + 1}{j + 1}": float(h[i, j]) for i in range(3) for j in range(3)}


@pair_measure("FeatureTrack", "x double, y double, new_x double, new_y double, is_lost boolean", window_size=15, max_iter=20, max_features=100)
def track(image, other, window_size, max_iter, max_features):
    """Corners of the first frame followed into the second by iterated gradient steps over a window."""
    a, b, k = gray(image).astype(np.float64)[:, :, None], gray(other).astype(np.float64)[:, :, None], max(2, int(window_size) // 2)
    gx, gy = (g / 8 for g in gradient(a[:, :, 0]))
    dy, dx = np.mgrid[-k : k + 1, -k : k + 1].astype(np.float64)
    out = []

    def at(v, x, y):
        h, w = v.shape[:2]
        x, y = np.clip(x, 0, w - 1.001), np.clip(y, 0, h - 1.001)
        i, j = y.astype(int), x.astype(int)
        p, q = (y - i), (x - j)
        i2, j2 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
        v = v.reshape(h, w)
        return (v[i, j] * (1 - q) + v[i, j2] * q) * (1 - p) + (v[i2, j] * (1 - q) + v[i2, j2] * q) * p

    for x, y in corners(image, int(max_features)):
        u, v, t = at(gx, x + dx, y + dy), at(gy, x + dx, y + dy), at(a, x + dx, y + dy)
        m = np.array([[(u * u).sum(), (u * v).sum()], [(u * v).sum(), (v * v).sum()]])
        d, lost = np.zeros(2), np.linalg.det(m) < 1e-6
        for _ in range(0 if lost else int(max_iter)):
            e = t - at(b, x + d[0] + dx, y + d[1] + dy)
            step = np.linalg.solve(m, [(e * u).sum(), (e * v).sum()])
            d += step
            if abs(step).max() < 0.01:
                break
        lost = bool(lost or not (0 <= x + d[0] < a.shape[1] and 0 <= y + d[1] < a.shape[0]) or abs(t - at(b, x + d[0] + dx, y + d[1] + dy)).mean() > 20)
        out.append({"x": float(x), "y": float(y), "new_x": float(x + d[0]), "new_y": float(y + d[1]), "is_lost": lost})
    return out


@measure_op("FeatureCluster", "cluster long, x double, y double, n long", k=4, max_iter=10, method="Harris", draw_clusters=True)
def feature_cluster(image, k, max_iter, method, draw_clusters):
    p = corners(image, 500).astype(np.float64)
    if not len(p):
        return []
    near, c = k_means(p, max(1, min(int(k), len(p))), max_iter)
    return [{"cluster": i, "x": float(x), "y": float(y), "n": int((near == i).sum())} for i, (x, y) in enumerate(c)]


# --- traced contours


def trace(on: np.ndarray) -> list[np.ndarray]:
    """The outer border of every eight-connected piece, sample after sample, clockwise from its first: arrays of (x, y)."""
    turns = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
    labels, n = label(on, True)
    wide = np.pad(labels, 1)
    out = []
    first = {}
    for y, x in np.argwhere(labels > 0):
        first.setdefault(int(labels[y, x]), (int(x) + 1, int(y) + 1))
        if len(first) == n:
            break
    for k in sorted(first):
        start = at = first[k]
        path, back, begun = [start], 4, None
        while True:
            for j in range(1, 9):
                d = (back + j) % 8
                to = (at[0] + turns[d][0], at[1] + turns[d][1])
                if wide[to[1], to[0]] == k:
                    break
            else:
                break
            if at == start and begun == d:
                path.pop()
                break
            begun = d if begun is None else begun
            at, back = to, (d + 4) % 8
            path.append(at)
        out.append(np.array(path) - 1)
    return out


def simplify(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Keep the ends and, again and again, the point farthest from a chord while it is farther than epsilon."""
    if len(p) < 3:
        return p
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = (p[b] - p[a]).astype(float), (p[a + 1 : b] - p[a]).astype(float)
        size = np.hypot(*d)
        far = abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / size if size else np.hypot(*q.T)
        k = int(far.argmax())
        if far[k] > epsilon:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[sorted(keep)]


_POINT = "contour_id long, seq long, x double, y double"


def _points(paths) -> list[dict]:
    return [{"contour_id": k, "seq": i, "x": float(x), "y": float(y)} for k, p in enumerate(paths, 1) for i, (x, y) in enumerate(p)]


def _length(p: np.ndarray) -> float:
    return float(np.hypot(*np.diff(p, axis=0).T).sum()) if len(p) > 1 else 0.0


measure_op("ContourDetect", _POINT, draw_contours=True)(lambda image, draw_contours: _points(trace(gray(image) > 0)))
measure_op("ContourApprox", _POINT, epsilon=2.0, draw_contours=True)(lambda image, epsilon, draw_contours: _points([simplify(np.concatenate((p, p[:1])), epsilon)[:-1] if len(p) > 2 else p for p in trace(gray(image) > 0)]))
measure_op("ApproxChain", _POINT, epsilon=2.0)(lambda image, epsilon: _points([simplify(p, epsilon) for p in trace(gray(image) > 0)]))
measure_op("GenContourRegion", _POINT, min_length=10.0)(lambda image, min_length: _points([p for p in trace(gray(image) > 0) if _length(p) >= min_length]))
measure_op("GenContoursSkeleton", _POINT)(lambda image: _points(trace(gray(thinning(image, 100)) > 0)))


@measure_op("ContourHierarchy", "contour_id long, parent_id long, is_hole boolean, area long", draw_hierarchy=True)
def hierarchy(image, draw_hierarchy):
    """Outer pieces (eight-connected) and holes (four-connected background off the frame's edge), each within what surrounds its first sample."""
    on = np.pad(gray(image) > 0, 1)
    front, n = label(on, True)
    back, m = label(~on)
    out = []
    for hole, labels, count in ((False, front, n), (True, back, m)):
        size = np.bincount(labels.ravel(), minlength=count + 1)
        _, first = np.unique(labels.ravel(), return_index=True)
        for spot in first:
            k = int(labels.ravel()[spot])
            if not k or (hole and k == back[0, 0]):
                continue
            other = int((front if hole else back).ravel()[spot - 1])
            parent = other if hole else (n + other if other != back[0, 0] else 0)
            out.append({"contour_id": n + k if hole else k, "parent_id": int(parent), "is_hole": hole, "area": int(size[k])})
    return out


@measure_op("ContourProperty", SHAPE + ", perimeter double, circularity double", compute_hull=True, draw_props=True)
def contour_property(image, compute_hull, draw_props):
    on, out = gray(image) > 0, []
    for p in parts(on):
        around = edge_length(np.pad(on[p["y"] : p["y"] + p["height"], p["x"] : p["x"] + p["width"]], 1))
        out.append(p | {"perimeter": around, "circularity": float(4 * np.pi * p["area"] / around**2) if around else 0.0})
    return out


@measure_op("MergeContours", _POINT, max_gap=5.0)
def merge_contours(image, max_gap):
    """Contours whose nearest points are within the gap become one."""
    paths = trace(gray(image) > 0)
    name = list(range(len(paths)))
    for i in range(len(paths)):
        for j in range(i):
            if name[i] != name[j] and np.hypot(*(paths[i][:, None] - paths[j]).transpose(2, 0, 1)).min() <= max_gap:
                low, high = sorted((name[i], name[j]))
                name = [low if v == high else v for v in name]
    return _points([np.concatenate([p for p, k in zip(paths, name, strict=True) if k == v]) for v in sorted(set(name))])


def _outer(image) -> np.ndarray:
    return max(trace(gray(image) > 0), key=len, default=np.zeros((0, 2)))


@measure_op("FourierDescriptor", "k long, real double, imag double, magnitude double", num_descriptors=32)
def fourier(image, num_descriptors):
    """Of the longest contour as complex numbers, over the first frequency's size: unchanged by shift and scale."""
    p = _outer(image)
    if len(p) < 3:
        return []
    f = np.fft.fft(p[:, 0] + 1j * p[:, 1]) / len(p)
    f = f / max(abs(f[1]), 1e-12)
    return [{"k": k, "real": float(f[k].real), "imag": float(f[k].imag), "magnitude": float(abs(f[k]))} for k in range(1, min(int(num_descriptors), len(f) - 1) + 1)]


@measure_op("ShapeContext", "r_bin long, theta_bin long, n long", num_points=64, num_r_bins=5, num_theta_bins=12)
def shape_context(image, num_points, num_r_bins, num_theta_bins):
    """Pairs of evenly chosen contour points by log distance (over the mean distance) and direction."""
    p = _outer(image).astype(np.float64)
    if len(p) < 2:
        return []
    p = p[np.unique(np.linspace(0, len(p) - 1, int(num_points)).astype(int))]
    d = p[None] - p[:, None]
    off = ~np.eye(len(p), dtype=bool)
    r, t = np.hypot(d[..., 0], d[..., 1])[off], np.arctan2(d[..., 1], d[..., 0])[off]
    edges = np.logspace(np.log10(0.125), np.log10(2), int(num_r_bins))
    i = np.minimum(np.searchsorted(edges, r / max(r.mean(), 1e-9)), int(num_r_bins) - 1)
    j = ((t + np.pi) / (2 * np.pi) * num_theta_bins).astype(int) % int(num_theta_bins)
    n = np.bincount(i * int(num_theta_bins) + j, minlength=int(num_r_bins * num_theta_bins))
    return [{"r_bin": k // int(num_theta_bins), "theta_bin": k % int(num_theta_bins), "n": int(c)} for k, c in enumerate(n)]


@table_op("GenCrossContour", "points", "contour_id seq x y", size=20.0)
def cross_contour(points, size):
    """Two strokes about each point (contour_id, x, y): five points that pass the centre."""
    at = [(-1, 0), (1, 0), (0, 0), (0, -1), (0, 1)]
    strokes = F.array(*[F.struct(F.lit(k).alias("seq"), (F.col("x") + dx * size / 2).alias("x"), (F.col("y") + dy * size / 2).alias("y")) for k, (dx, dy) in enumerate(at)])
    return points.select("contour_id", F.explode(strokes).alias("p")).select("contour_id", "p.seq", "p.x", "p.y")


@table_op("GenPolygonContour", "vertices", "contour_id seq x y", closed=True)
def polygon_contour(vertices, closed):
    """Rows with lists of numbers in vertices_x and vertices_y; the shorter list counts; closed repeats the first vertex."""
    xs, ys = (F.transform(F.split(F.col(c), r"\s*,\s*"), lambda v: v.try_cast("double")) for c in ("vertices_x", "vertices_y"))
    n = F.least(F.size(xs), F.size(ys))
    pts = F.arrays_zip(F.slice(xs, F.lit(1), n).alias("x"), F.slice(ys, F.lit(1), n).alias("y"))
    pts = F.concat(pts, F.slice(pts, 1, 1)) if closed else pts
    return vertices.select("contour_id", F.posexplode(pts).alias("seq", "p")).select("contour_id", "seq", "p.x", "p.y")


# --- sub-pixel edges


def edge_points(image, threshold: float) -> np.ndarray:
    """x, y, strength of every maximum along the gradient, moved to the peak of the parabola through its neighbours."""
    gx, gy = gradient(gray(image))
    m = np.hypot(gx, gy)
    out = []
    for y, x in np.argwhere(m > threshold):
        if not (0 < y < m.shape[0] - 1 and 0 < x < m.shape[1] - 1):
            continue
        ux, uy = gx[y, x] / m[y, x], gy[y, x] / m[y, x]
        k = (1, 0) if abs(ux) >= abs(uy) else (0, 1)
        sign = 1 if (ux if k[0] else uy) > 0 else -1
        a, b = m[y - sign * k[1], x - sign * k[0]], m[y + sign * k[1], x + sign * k[0]]
        if m[y, x] < a or m[y, x] <= b:
            continue
        bend = a - 2 * m[y, x] + b
        s = sign * (0.5 * (a - b) / bend if bend else 0.0)
        out.append((x + k[0] * s, y + k[1] * s, m[y, x]))
    return np.array(out).reshape(-1, 3)


_EDGE = "x double, y double, strength double"
_edge_rows = lambda p: [{"x": float(a), "y": float(b), "strength": float(c)} for a, b, c in p]
measure_op("SubpixelEdge", _EDGE, method="taylor", threshold=30.0, sigma=1.0, max_edges=1000.0)(lambda image, method, threshold, sigma, max_edges: _edge_rows(edge_points(image, threshold)[: int(max_edges)]))
measure_op("SubpixelContour", _EDGE, method="taylor", threshold=30.0, sigma=1.0, max_points=2000.0)(lambda image, method, threshold, sigma, max_points: _edge_rows(edge_points(image, threshold)[: int(max_points)]))
measure_op("EdgesSubPixSobel", _EDGE, threshold=20.0)(lambda image, threshold: _edge_rows(edge_points(image, threshold)))


def _long_edges(image, threshold: float, min_length: float) -> np.ndarray:
    """Edge points whose piece of neighbouring edge samples is that long."""
    p = edge_points(image, threshold)
    on = np.zeros(image.shape[:2], bool)
    at = (np.clip(np.round(p[:, 1]), 0, image.shape[0] - 1).astype(int), np.clip(np.round(p[:, 0]), 0, image.shape[1] - 1).astype(int))
    on[at] = True
    labels, _ = label(on, True)
    return p[np.bincount(labels.ravel())[labels[at]] >= min_length] if len(p) else p


measure_op("EdgesSubPix", _EDGE, threshold=30.0, min_length=5.0)(lambda image, threshold, min_length: _edge_rows(_long_edges(image, threshold, min_length)))


@measure_op("EdgesSubPixCanny", _EDGE, low_threshold=20.0, high_threshold=50.0)
def edges_canny(image, low_threshold, high_threshold):
    """The refined points that stand on or beside an edge that the two thresholds keep."""
    keep = windows(canny(image, low_threshold, high_threshold), 1).any((-1, -2))[:, :, 0]
    p = edge_points(image, low_threshold)
    return _edge_rows(p[keep[np.round(p[:, 1]).astype(int), np.round(p[:, 0]).astype(int)]] if len(p) else p)


@measure_op("SubpixelCorner", "x double, y double, response double", threshold=1000.0, sigma=1.0, k=0.04, max_corners=100.0)
def subpixel_corner(image, threshold, sigma, k, max_corners):
    """Peaks of the corner response, each moved to the top of the parabolas through its neighbours."""
    gx, gy = gradient(gray(image))
    box = lambda v: windows(v[:, :, None], 1).sum((-1, -2))[:, :, 0]
    a, b, c = box(gx * gx), box(gx * gy), box(gy * gy)
    r = a * c - b * b - k * (a + c) ** 2
    out = []
    for p in _peaks(r, threshold, max_corners):
        x, y = p["x"], p["y"]
        if 0 < x < r.shape[1] - 1 and 0 < y < r.shape[0] - 1:
            bend = [r[y, x - 1] - 2 * r[y, x] + r[y, x + 1], r[y - 1, x] - 2 * r[y, x] + r[y + 1, x]]
            lean = [r[y, x - 1] - r[y, x + 1], r[y - 1, x] - r[y + 1, x]]
            dx, dy = (0.5 * s / q if q else 0.0 for s, q in zip(lean, bend, strict=True))
            out.append({"x": float(x + dx), "y": float(y + dy), "response": p["response"]})
    return out


@measure_op("SubpixelLine", "line_a double, line_b double, line_c double, rms_error double, point_count long, valid boolean", method="taylor", threshold=30.0, sigma=1.0, min_points=10.0)
def subpixel_line(image, method, threshold, sigma, min_points):
    p = edge_points(image, threshold)
    line = fit_line(p[:, :2] if len(p) >= min_points else p[:0, :2])
    return {k: line[k] for k in ("line_a", "line_b", "line_c")} | {"rms_error": line["fit_error"], "point_count": len(p), "valid": line["valid"]}


@measure_op("SubpixelCircle", "center_x double, center_y double, radius double, rms_error double, point_count long, valid boolean", method="taylor", threshold=30.0, sigma=1.0, min_points=20.0)
def subpixel_circle(image, method, threshold, sigma, min_points):
    p = edge_points(image, threshold)
    c = fit_circle(p[:, :2] if len(p) >= max(min_points, 3) else p[:0, :2])
    return {k: c[k] for k in ("center_x", "center_y", "radius", "valid")} | {"rms_error": c["fit_error"], "point_count": len(p)}


def _consensus(p: np.ndarray, fit, need: int, near: float, tries: int, least: float, accept) -> list[dict]:
    """Shapes one after another: of seeded samples the one that most points are near; its points then leave."""
    out, rng = [], np.random.default_rng(0)
    while len(p) >= max(need, least):
        best, shape = None, None
        for _ in range(int(tries)):
            s = fit(p[rng.choice(len(p), need, replace=False)])
            if s["valid"] and accept(s):
                on = _off(s, p) <= near
                if best is None or on.sum() > best.sum():
                    best, shape = on, s
        if best is None or best.sum() < least:
            break
        again = fit(p[best])
        shape = again if again["valid"] and accept(again) else shape
        out.append(shape | {"point_count": int(best.sum())})
        p = p[~best]
    return out


def _off(s: dict, p: np.ndarray) -> np.ndarray:
    return abs(p @ (s["line_a"], s["line_b"]) + s["line_c"]) if "line_a" in s else abs(np.hypot(p[:, 0] - s["center_x"], p[:, 1] - s["center_y"]) - s["radius"])


_LINE = "line_a double, line_b double, line_c double, fit_error double, valid boolean, point_count long"
measure_op("FindLines", _LINE, threshold=30.0, ransac_threshold=2.0, min_line_length=30.0, max_iterations=100)(lambda image, threshold, ransac_threshold, min_line_length, max_iterations: _consensus(edge_points(image, threshold)[:, :2], fit_line, 2, ransac_threshold, max_iterations, min_line_length, lambda s: True))
measure_op("FindCircles", "center_x double, center_y double, radius double, fit_error double, valid boolean, point_count long", threshold=30.0, ransac_threshold=2.0, min_radius=5.0, max_radius=500.0, max_iterations=100)(lambda image, threshold, ransac_threshold, min_radius, max_radius, max_iterations: _consensus(edge_points(image, threshold)[:, :2], fit_circle, 3, ransac_threshold, max_iterations, 20, lambda s: min_radius <= s["radius"] <= max_radius))
measure_op("LinesSubPix", _LINE, threshold=30.0, min_length=20.0, max_gap=5.0)(lambda image, threshold, min_length, max_gap: _consensus(_long_edges(image, threshold, 5)[:, :2], fit_line, 2, 1.0, 100, min_length, lambda s: True))


@measure_op("MeasurePairs", "first double, second double, distance double, center double", start_x=0.0, start_y=0.0, end_x=100.0, end_y=0.0, threshold=20.0, width=1.0, polarity="positive")
def measure_pairs_(image, start_x, start_y, end_x, end_y, threshold, width, polarity):
    """A rising step and the next falling one (or the other way round), along the segment."""
    sign, out, last = (1 if polarity == "positive" else -1), [], None
    for s, d in edges_on(profile(gray(image), start_x, start_y, end_x, end_y, max(1, int(width))), threshold, 0):
        if sign * d > 0:
            last = s
        elif last is not None:
            out.append({"first": float(last), "second": float(s), "distance": float(s - last), "center": float(s + last) / 2})
            last = None
    return out


@measure_op("MeasureFuzzy", "position double, score double", row=100.0, col=100.0, angle=0.0, length=50.0, fuzzy_threshold=0.5)
def measure_fuzzy(image, row, col, angle, length, fuzzy_threshold):
    """Steps whose share of the strongest one reaches the threshold; that share is the score."""
    found = edges_on(_along(image, row, col, angle, length), 1.0, 0)
    top = max((abs(d) for _, d in found), default=0.0)
    return [{"position": float(s), "score": float(abs(d) / top)} for s, d in found if abs(d) / top >= fuzzy_threshold]


# --- calipers over two places


def _part(p: dict, name: str) -> dict:
    return {f"roi_{k}": p[f"{name}_{k}"] for k in ("x", "y", "width", "height")} | {"search_direction": p[f"{name}_direction"], "threshold": p["threshold"], "smoothing": p["smoothing"], "polarity": 0}


_TWO = {"roi1_x": 50.0, "roi1_y": 100.0, "roi1_width": 50.0, "roi1_height": 20.0, "roi1_direction": 0.0, "roi2_x": 150.0, "roi2_y": 100.0, "roi2_width": 50.0, "roi2_height": 20.0, "roi2_direction": 0.0, "threshold": 15.0, "smoothing": 1.0}


@measure_op("CaliperMeasureDistance", "distance double, edge1_x double, edge1_y double, edge2_x double, edge2_y double, valid boolean", mode=1, **_TWO)
def measure_distance(image, mode, **p):
    a, b = (find_edge(image, **_part(p, k)) for k in ("roi1", "roi2"))
    ok = a["found"] and b["found"]
    d = float(np.hypot(a["edge_x"] - b["edge_x"], a["edge_y"] - b["edge_y"])) if ok else 0.0
    return {"distance": d, "edge1_x": a["edge_x"], "edge1_y": a["edge_y"], "edge2_x": b["edge_x"], "edge2_y": b["edge_y"], "valid": ok}


def _scans(image, roi_x, roi_y, roi_width, roi_height, search_direction, threshold, smoothing, polarity=0) -> np.ndarray:
    """The strongest step of every scan of the box, one sample apart across its direction."""
    level_ = abs(np.cos(np.radians(search_direction))) >= abs(np.sin(np.radians(search_direction)))
    out = []
    for k in range(int(roi_height if level_ else roi_width)):
        box = {"roi_x": roi_x, "roi_y": roi_y + k, "roi_width": roi_width, "roi_height": 1.0} if level_ else {"roi_x": roi_x + k, "roi_y": roi_y, "roi_width": 1.0, "roi_height": roi_height}
        found, place = _edges(image, threshold, polarity, search_direction=search_direction, smoothing=smoothing, **box)
        if found:
            out.append(place(max(found, key=lambda e: abs(e[1]))[0]))
    return np.array(out).reshape(-1, 2)


@measure_op("CaliperFitLine", "line_a double, line_b double, line_c double, line_angle double, point_count long, valid boolean", min_points=2, **({k: v for k, v in _ROI.items() if k != "polarity"} | {"roi_width": 200.0, "roi_height": 30.0, "threshold": 15.0}))
def caliper_line(image, min_points, **box):
    p = _scans(image, **box)
    line = fit_line(p if len(p) >= max(2, min_points) else p[:0])
    return {k: line[k] for k in ("line_a", "line_b", "line_c", "valid")} | {"line_angle": float(np.degrees(np.arctan2(-line["line_a"], line["line_b"])) % 180) if line["valid"] else 0.0, "point_count": len(p)}


@measure_op("CaliperFindCorner", "corner_x double, corner_y double, corner_angle double, valid boolean", **(_TWO | {"roi1_x": 100.0, "roi1_y": 80.0, "roi1_direction": 90.0, "roi2_x": 80.0, "roi2_y": 100.0}))
def caliper_corner(image, **p):
    """Where the lines through the steps of both boxes meet, and the angle between them."""
    a, b = (fit_line(_scans(image, **_part(p, k))) for k in ("roi1", "roi2"))
    det = a["line_a"] * b["line_b"] - b["line_a"] * a["line_b"]
    if not (a["valid"] and b["valid"]) or abs(det) < 1e-9:
        return {"corner_x": 0.0, "corner_y": 0.0, "corner_angle": 0.0, "valid": False}
    x, y = (a["line_b"] * b["line_c"] - b["line_b"] * a["line_c"]) / det, (b["line_a"] * a["line_c"] - a["line_a"] * b["line_c"]) / det
    turn = np.degrees(np.arccos(min(1.0, abs(a["line_a"] * b["line_a"] + a["line_b"] * b["line_b"]))))
    return {"corner_x": float(x), "corner_y": float(y), "corner_angle": float(turn), "valid": True}


@measure_op("CaliperProjectEdge", "project_length double, edge_x double, edge_y double, projection_value double, valid boolean", start_x=0.0, start_y=0.0, end_x=200.0, end_y=0.0, projection_width=20.0, threshold=15.0, polarity=0, smoothing=1.0)
def project_edge(image, start_x, start_y, end_x, end_y, projection_width, threshold, polarity, smoothing):
    """The strongest step of the profile averaged across the segment."""
    p = profile(gray(image), start_x, start_y, end_x, end_y, max(1, int(projection_width)))
    found, n = edges_on(p, threshold, int(polarity)), max(np.hypot(end_x - start_x, end_y - start_y), 1e-9)
    if not found:
        return {"project_length": 0.0, "edge_x": 0.0, "edge_y": 0.0, "projection_value": 0.0, "valid": False}
    s, d = max(found, key=lambda e: abs(e[1]))
    return {"project_length": float(s), "edge_x": float(start_x + (end_x - start_x) * s / n), "edge_y": float(start_y + (end_y - start_y) * s / n), "projection_value": float(abs(d)), "valid": True}


# --- matching over pose, calibration patterns


pair_measure("ShapeMatchScaleRotate", "x long, y long, score double, angle double, scale double", True, scale_min=0.8, scale_max=1.2, scale_step=0.1, angle_start=-30.0, angle_extent=60.0, angle_step=15.0, min_score=0.6, num_matches=3)(lambda image, other, scale_min, scale_max, scale_step, angle_start, angle_extent, angle_step, min_score, num_matches: _swept(image, other, np.arange(angle_start, angle_start + angle_extent + 1e-9, angle_step), np.arange(scale_min, scale_max + 1e-9, scale_step), min_score, num_matches))
pair_measure("PositionMatch", "x long, y long, score double", True, min_score=0.7, max_matches=1, find_angle=False)(lambda image, other, min_score, max_matches, find_angle: hits(gray(image), gray(other), "NCC", min_score, max_matches, 0.5))
pair_measure("CalibrationPatternMatch", "x long, y long, score double, angle double, scale double", True, pattern_rows=8, pattern_cols=8, search_scale=0.5, match_threshold=0.7, draw_match=True)(lambda image, other, search_scale, match_threshold, **_: _swept(image, other, [0.0], np.unique(np.round(np.linspace(1 - search_scale, 1 + search_scale, 5), 6)), match_threshold, 1))


def saddles(image, threshold: float, most: int) -> np.ndarray:
    """Inner corners of a checkerboard: opposite quarters alike, neighbouring ones unlike. x, y, response; centre of mass of the response."""
    v, k = gray(image).astype(np.float64), 3
    wide = np.pad(v, k, mode="edge").cumsum(0).cumsum(1)
    wide = np.pad(wide, ((1, 0), (1, 0)))
    box = lambda y, x: (lambda a: a)(wide[y + k : y + k + v.shape[0], x + k : x + k + v.shape[1]] - wide[y : y + v.shape[0], x + k : x + k + v.shape[1]] - wide[y + k : y + k + v.shape[0], x : x + v.shape[1]] + wide[y : y + v.shape[0], x : x + v.shape[1]]) / k**2
    a, b, c, d = box(0, 0), box(0, k), box(k, 0), box(k, k)
    r = np.minimum(np.minimum(abs(a - b), abs(a - c)), np.minimum(abs(d - b), abs(d - c))) - np.maximum(abs(a - d), abs(b - c))
    r[:k], r[-k:], r[:, :k], r[:, -k:] = 0, 0, 0, 0
    labels, n = label(r > threshold, True)
    weight = np.bincount(labels.ravel(), r.ravel(), n + 1)
    y, x = np.indices(r.shape)
    at = np.stack([np.bincount(labels.ravel(), (r * q).ravel(), n + 1)[1:] / np.maximum(weight[1:], 1e-9) - 0.5 for q in (x, y)] + [weight[1:]], 1)
    return at[np.argsort(-at[:, 2], kind="stable")][: int(most)]


def _grid(image, rows, cols, threshold):
    """Corners in rows from the top, from the left in each; spacing is the median gap to the nearest other."""
    p = saddles(image, threshold, 4 * int(rows) * int(cols))
    if len(p) < 2:
        return p, np.zeros(0)
    gap = np.sqrt(((p[:, None, :2] - p[None, :, :2]) ** 2).sum(2)) + np.diag(np.full(len(p), np.inf))
    near = gap.min(1)
    line = np.round((p[:, 1] - p[:, 1].min()) / max(np.median(near), 1e-9))
    order = np.lexsort((p[:, 0], line))
    return p[order], near[order]


@measure_op("CheckerboardDetect", "pattern_found boolean, corner_count long, confidence double", pattern_rows=8, pattern_cols=8, square_size=25.0, threshold=50, min_corners=100, draw_corners=True, draw_numbers=False)
def checkerboard(image, pattern_rows, pattern_cols, threshold, **_):
    """A board of rows x cols squares has one inner corner fewer each way."""
    p, _near = _grid(image, pattern_rows, pattern_cols, threshold)
    want = max(1, (int(pattern_rows) - 1) * (int(pattern_cols) - 1))
    return {"pattern_found": len(p) == want, "corner_count": len(p), "confidence": min(len(p), want) / max(len(p), want)}


measure_op("CalibrationPointsExtract", "seq long, x double, y double", pattern_rows=8, pattern_cols=8, unit_size=25.0, refine_window=5, threshold=50)(lambda image, pattern_rows, pattern_cols, threshold, **_: [{"seq": k, "x": float(q[0]), "y": float(q[1])} for k, q in enumerate(_grid(image, pattern_rows, pattern_cols, threshold)[0])])


@measure_op("CalibrationQualityCheck", "quality_valid boolean, quality_level string, coverage double, uniformity double, valid_points long", pattern_rows=8, pattern_cols=8, pattern_type="Checkerboard", threshold=50, draw_quality=True)
def calibration_quality(image, pattern_rows, pattern_cols, pattern_type, threshold, draw_quality):
    """Coverage is found over expected corners, uniformity the evenness of the gaps between neighbours."""
    p, near = _grid(image, pattern_rows, pattern_cols, threshold)
    cover = min(1.0, len(p) / max(1, (int(pattern_rows) - 1) * (int(pattern_cols) - 1)))
    even = evenness(near) if len(near) else 0.0
    s = (cover + even) / 2
    return {"quality_valid": s >= 0.7, "quality_level": "excellent" if s >= 0.9 else "good" if s >= 0.7 else "fair" if s >= 0.5 else "poor", "coverage": cover, "uniformity": even, "valid_points": len(p)}


# --- stitching: frames side by side by known or found shifts


def laid(images: list[np.ndarray], places: list[tuple[int, int]]) -> np.ndarray:
    """Frames on a common canvas; where several lie, their mean, each weighted by the distance from its own border."""
    x0, y0 = min(p[0] for p in places), min(p[1] for p in places)
    w = max(p[0] + i.shape[1] for i, p in zip(images, places, strict=True)) - x0
    h = max(p[1] + i.shape[0] for i, p in zip(images, places, strict=True)) - y0
    total, weight = np.zeros((h, w, images[0].shape[2])), np.zeros((h, w, 1))
    for i, (x, y) in zip(images, places, strict=True):
        r, c = np.arange(i.shape[0]), np.arange(i.shape[1])
        own = (np.minimum(r, r[::-1])[:, None] + 1.0) * (np.minimum(c, c[::-1]) + 1.0)
        total[y - y0 : y - y0 + i.shape[0], x - x0 : x - x0 + i.shape[1]] += i * own[:, :, None]
        weight[y - y0 : y - y0 + i.shape[0], x - x0 : x - x0 + i.shape[1], 0] += own
    return clamp(np.floor(total / np.maximum(weight, 1e-9) + 0.5))


def _stitched(a, b):
    m = matched(a, b, 0.8, 500)
    if len(m) < 3:
        return a
    d = np.round(np.median(m[:, :2] - m[:, 2:], axis=0)).astype(int)
    return laid([a, b], [(0, 0), (int(d[0]), int(d[1]))])


pair_op("ImageStitch", blend_width=50, blend_method="linear")(lambda a, b, blend_width, blend_method: _stitched(a, b))
pair_op("PanoramaStitch", blend_width=100, projection="flat")(lambda a, b, blend_width, projection: _stitched(*(curved(v, projection) for v in (a, b))))


def _row_of(*images, overlap, direction):
    """Frames one after another, each over the last by the overlap."""
    places, at = [], 0
    for i in images:
        places.append((at, 0) if direction == "horizontal" else (0, at))
        at += (i.shape[1] if direction == "horizontal" else i.shape[0]) - int(overlap)
    return laid(list(images), places)


def _tiles(*images, cols, rows, spacing):
    """Frames row by row in a grid of cells as large as the largest."""
    w, h = (max(i.shape[k] for i in images) + int(spacing) for k in (1, 0))
    return laid(list(images), [(k % int(cols) * w, k // int(cols) * h) for k in range(len(images))])


for _name, _step, _params in (("MultiImageStitch", _row_of, {"overlap": 100, "direction": "horizontal"}), ("MosaicStitch", _tiles, {"cols": 3, "rows": 2, "spacing": 0})):
    # Any number of inputs: frames are joined by frame_id.
    register(Operator(_name, "image", _params, (), ("image",), lambda *images, step=_step, **p: zip_images(list(images), partial(step, **p))))


def curved(image: np.ndarray, projection: str) -> np.ndarray:
    """On a cylinder or sphere whose radius is the frame's width; flat leaves it."""
    if projection == "flat":
        return image
    h, w = image.shape[:2]
    y, x = np.mgrid[:h, :w].astype(np.float64)
    t, v = (x - (w - 1) / 2) / w, (y - (h - 1) / 2) / w
    return sample(image, np.tan(t) * w + (w - 1) / 2, (v / np.cos(t) if projection == "cylindrical" else np.tan(v) / np.cos(t)) * w + (h - 1) / 2)


register(Operator("Remap", "image", {}, ("image", "map_x", "map_y"), ("image",), lambda image, map_x, map_y: zip_images([image, map_x, map_y], lambda v, x, y: sample(v, x[:, :, 0].astype(np.float64), y[:, :, 0].astype(np.float64)))))


# --- stereo


def _disparities(cost, least: int, count: int, shape) -> np.ndarray:
    best, at = np.full(shape, np.inf), np.zeros(shape)
    for d in range(least, least + count):
        c = cost(d)
        at, best = np.where(c < best, d, at), np.minimum(c, best)
    return at


@pair_op("stereo_match_ncc", num_disparities=64, window_size=9, min_disparity=0, baseline=60.0, focal_length=1800.0)
def stereo_ncc(left, right, num_disparities, window_size, min_disparity, baseline, focal_length):
    """Disparity of greatest correlation over a window; the smallest of equals."""
    a, b, k = gray(left).astype(np.float64), gray(right).astype(np.float64), odd(window_size) // 2
    total = lambda v: box_sum(v[:, :, None], k)[:, :, 0] / (2 * k + 1) ** 2
    ma, mb = total(a), total(b)
    sa, sb = total(a * a) - ma**2, total(b * b) - mb**2

    def cost(d):
        moved = lambda v: np.roll(v, d, 1)
        c = total(a * moved(b)) - ma * moved(mb)
        out = -np.round(c / np.sqrt(np.maximum(sa * moved(sb), 1e-6)), 9)
        out[:, :d] = 2
        return out

    return _disparities(cost, int(min_disparity), int(num_disparities), a.shape).astype(np.float32)[:, :, None]


@pair_op("stereo_match_sgbm", num_disparities=64, block_size=3, min_disparity=0, P1=8, P2=32, uniqueness_ratio=10, baseline=60.0, focal_length=1800.0)
def stereo_sgbm(left, right, num_disparities, block_size, min_disparity, P1, P2, uniqueness_ratio, baseline, focal_length):
    """Absolute differences summed along four directions, with a small price for a step of one and a larger for a jump."""
    a, b, n = gray(left).astype(np.float64), gray(right).astype(np.float64), int(num_disparities)
    cost = np.full((*a.shape, n), 255.0)
    for i in range(n):
        d = int(min_disparity) + i
        if d < a.shape[1]:
            cost[:, d:, i] = abs(a[:, d:] - b[:, : a.shape[1] - d])

    def swept(c):
        out = c.copy()
        for k in range(1, len(c)):
            p = out[k - 1]
            low = p.min(1, keepdims=True)
            step = np.pad(p, ((0, 0), (1, 1)), constant_values=np.inf)
            out[k] += np.minimum(np.minimum(p, low + P2), np.minimum(step[:, :-2], step[:, 2:]) + P1) - low
        return out

    total = swept(cost) + swept(cost[::-1])[::-1]
    turned = cost.transpose(1, 0, 2)
    total += (swept(turned) + swept(turned[::-1])[::-1]).transpose(1, 0, 2)
    return (total.argmin(2) + int(min_disparity)).astype(np.float32)[:, :, None]


image_op("depth_reconstruct", fx=1800.0, fy=1800.0, cx=960.0, cy=540.0, baseline=60.0)(lambda image, fx, fy, cx, cy, baseline: np.where(image > 0, fx * baseline / np.maximum(image.astype(np.float64), 1e-9), 0).astype(np.float32))


@measure_op("stereo_obstacle", SHAPE + ", nearest double", min_depth=0.0, max_depth=1000.0, min_area=100)
def obstacles(image, min_depth, max_depth, min_area):
    """Pieces of depth within the limits, with the least depth in the piece's box."""
    v = image[:, :, 0].astype(np.float64)
    on = (v > min_depth) & (v <= max_depth)
    box = lambda p: (slice(p["y"], p["y"] + p["height"]), slice(p["x"], p["x"] + p["width"]))
    return [p | {"nearest": float(v[box(p)][on[box(p)]].min())} for p in parts(on, min_area)]


@pair_measure("CalibrationMonitor", "drift_x double, drift_y double, needs_calibration boolean", temp_threshold=5.0, drift_threshold=0.5)
def calibration_monitor(image, other, temp_threshold, drift_threshold):
    """Shift of the other (current) frame against the image (reference) by phase correlation."""
    s = phase_correlation(other, image, 0.5)
    return {"drift_x": s["shift_x"], "drift_y": s["shift_y"], "needs_calibration": bool(np.hypot(s["shift_x"], s["shift_y"]) > drift_threshold)}


@measure_op("CharSegment", "x long, width long, y long, height long", min_char_size=5, max_char_size=100)
def char_segment(image, min_char_size, max_char_size):
    """Runs of columns that hold ink (darker than Otsu's threshold), and the rows of ink within each."""
    plane = gray(image)
    ink = plane <= otsu(plane)
    ink = ~ink if ink.mean() > 0.5 else ink
    edge = np.diff(np.pad(ink.any(0).astype(int), 1))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        rows = np.flatnonzero(ink[:, a:b].any(1))
        h = int(rows[-1] - rows[0] + 1)
        if min_char_size <= max(h, b - a) <= max_char_size:
            out.append({"x": int(a), "width": int(b - a), "y": int(rows[0]), "height": h})
    return out


def _ink(image) -> np.ndarray:
    plane = gray(image)
    on = plane <= otsu(plane)
    return ~on if on.mean() > 0.5 else on


measure_op("CharBox", SHAPE, min_char_size=5, max_char_size=100, aspect_ratio=2.0)(lambda image, min_char_size, max_char_size, aspect_ratio: [p for p in parts(_ink(image)) if min_char_size <= max(p["width"], p["height"]) <= max_char_size and p["width"] <= aspect_ratio * p["height"]])
measure_op("CharDetect", SHAPE, min_char_size=8, max_char_size=120, delta=5)(lambda image, min_char_size, max_char_size, delta: [p for p in parts(_ink(image)) if min_char_size <= max(p["width"], p["height"]) <= max_char_size])


@measure_op("TextLocate", SHAPE, min_area=100, max_area=10000, sensitivity=0.5)
def text_locate(image, min_area, max_area, sensitivity):
    """Regions of dense edges: steep samples, spread by two, in pieces."""
    steep = np.hypot(*gradient(gray(image))) > 200 * (1 - sensitivity)
    return parts(windows(steep[:, :, None], 2).any((-1, -2))[:, :, 0], min_area, max_area)


measure_op("MomentInvariants", ", ".join([f"hu{k} double" for k in range(1, 8)] + [f"f{k} double" for k in range(1, 5)]))(lambda image: hu(image) | flusser(image))


@measure_op("PrecisionBenchmark", "measured double, error double", theoretical=0.0, method="taylor", threshold=30.0, sigma=1.0, direction="horizontal")
def precision_benchmark(image, theoretical, method, threshold, sigma, direction):
    """The mean place of the edge points along the direction, less the true one."""
    p = edge_points(image, threshold)
    at = float(p[:, 0 if direction == "horizontal" else 1].mean()) if len(p) else 0.0
    return {"measured": at, "error": at - theoretical}


def _synthetic(image, pattern_type, width, height, param1, param2, noise_level, fg_value, bg_value):
    """A frame of the given size, or of the input's where it is 0, with an edge of one sample's ramp: at x = param1 (vertical), y = param1 (horizontal), or a disc about the middle of radius param1."""
    y, x = np.indices((int(height) or image.shape[0], int(width) or image.shape[1]))
    d = {"vertical": x - param1, "horizontal": y - param1}.get(pattern_type)
    if d is None:
        d = param1 - np.hypot(x - (x.shape[1] - 1) / 2, y - (y.shape[0] - 1) / 2)
    v = bg_value + (fg_value - bg_value) * np.clip(d + 0.5, 0, 1)
    if noise_level > 0:
        v = v + np.random.default_rng(0).normal(0, noise_level, v.shape)
    return clamp(np.round(v))[:, :, None]


image_op("PrecisionTest", pattern_type="vertical", width=0.0, height=0.0, param1=128.5, param2=128.0, noise_level=0.0, fg_value=200.0, bg_value=50.0)(_synthetic)


register(Operator("SimpleImageSource", "source", {"width": 512, "height": 512}, ("ids",), ("image",), lambda ids, width, height: _ramps(ids, width, height)))


def _ramps(ids, width, height):
    """A frame with a horizontal ramp for each row's frame_id."""
    line = np.tile((np.arange(int(width)) * 255 // max(int(width) - 1, 1)).astype(np.uint8), (int(height), 1)).tobytes()
    fixed = {"width": int(width), "height": int(height), "channels": 1}
    return ids.select("frame_id", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit("Mono8").alias("format"), F.lit(0).cast("long").alias("timestamp_us"), F.lit("synthetic").alias("source_id"), F.lit(line).alias("data"))
