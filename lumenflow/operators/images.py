"""Operators from image to image. Each is a function of one frame; chains of them run in one pass over the frames."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from ..frames import map_images, pair_images
from ..spec import Operator, register


def image_op(type_id: str, *aliases: str, **params):
    """Register kernel(image, **params): height x width x channels in, the same or another size out."""

    def add(kernel):
        register(Operator(type_id, "image", params, ("image",), ("image",), lambda image, **p: map_images(image, partial(kernel, **p)), kernel), *aliases)
        return kernel

    return add


def pair_op(type_id: str, **params):
    """Register kernel(a, b, **params) over frames joined by frame_id."""

    def add(kernel):
        register(Operator(type_id, "image pair", params, ("image_a", "image_b"), ("image",), lambda image_a, image_b, **p: pair_images(image_a, image_b, partial(kernel, **p))))
        return kernel

    return add


def clamp(v: np.ndarray) -> np.ndarray:
    """To 8 bits: saturate, then cut the fraction off."""
    return np.clip(v, 0, 255).astype(np.uint8)


def gray(image: np.ndarray, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """One plane: the mean of the colour channels rounded down, or a weighted sum."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    colour = image[:, :, :3].astype(np.float64)
    return clamp(colour @ np.array(weights) + 1e-6) if weights else (image[:, :, :3].astype(np.int32).sum(axis=2) // 3).astype(np.uint8)


def padded(image: np.ndarray, k: int) -> np.ndarray:
    """Border samples repeated k times on every side."""
    return np.pad(image, ((k, k), (k, k), (0, 0)), mode="edge")


def windows(image: np.ndarray, k: int) -> np.ndarray:
    """All (2k+1) x (2k+1) neighbourhoods, border repeated: height x width x channels x (2k+1) x (2k+1)."""
    return np.lib.stride_tricks.sliding_window_view(padded(image, k), (2 * k + 1, 2 * k + 1), axis=(0, 1))


def correlate(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    k = kernel.shape[0] // 2
    wide, out = padded(image.astype(np.float64), k), np.zeros(image.shape)
    for dy, dx in np.argwhere(kernel != 0):
        out += kernel[dy, dx] * wide[dy : dy + image.shape[0], dx : dx + image.shape[1]]
    return out


def box_sum(image: np.ndarray, k: int) -> np.ndarray:
    """Sums over (2k+1)-square neighbourhoods by an integral image."""
    total = np.pad(padded(image.astype(np.float64), k).cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    s = 2 * k + 1
    return total[s:, s:] - total[:-s, s:] - total[s:, :-s] + total[:-s, :-s]


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - size // 2
    g = np.exp(-(x * x) / (2 * sigma * sigma))
    g = np.outer(g, g)
    return g / g.sum()


def odd(n: float) -> int:
    n = max(int(n), 1)
    return n if n % 2 else n + 1


# --- two images, sample by sample


def _scaled(f):
    return lambda a, b, scale_factor, offset, saturate: clamp(f(a.astype(np.float64), b.astype(np.float64)) * scale_factor + offset)


pair_op("ImageAdd", scale_factor=0.5, offset=0.0, saturate=True)(_scaled(np.add))
pair_op("ImageSubtract", scale_factor=1.0, offset=128.0, saturate=True)(_scaled(np.subtract))
pair_op("ImageAbsDiff", scale_factor=1.0, offset=0.0, saturate=True)(_scaled(lambda a, b: abs(a - b)))
pair_op("ImageDivide", scale_factor=1.0, offset=0.0, saturate=True)(_scaled(lambda a, b: a / np.where(b == 0, 1e-10, b)))
pair_op("ImageMin")(np.minimum)
pair_op("ImageMax")(np.maximum)
pair_op("ImageAnd")(np.bitwise_and)
pair_op("ImageOr")(np.bitwise_or)
pair_op("ImageXor")(np.bitwise_xor)


@pair_op("ImageMultiply", scale_factor=255.0, offset=0.0, saturate=True)
def multiply(a, b, scale_factor, offset, saturate):
    """8-bit samples count as fractions of 255; with saturate the result is brought back to that range."""
    v = (a / 255.0) * (b / 255.0) * scale_factor + offset
    return clamp(v * 255.0 if saturate else v)


@pair_op("ImageBlend", blend_weight=0.5, saturate=True)
def blend(a, b, blend_weight, saturate):
    return clamp(blend_weight * a + (1 - blend_weight) * b)


@pair_op("ImageConcat", direction="horizontal")
def concat(a, b, direction):
    return np.concatenate((a, b), axis=1 if direction == "horizontal" else 0)


# --- one image, sample by sample


@image_op("ImageNot")
def invert(image):
    return 1 - image if image.dtype == np.float32 else 255 - image


@image_op("SimpleThreshold", threshold=128, max_value=255)
def simple_threshold(image, threshold, max_value):
    return np.where(image > threshold, max_value, 0).astype(np.uint8)


@image_op("Threshold", "nodes.Threshold", threshold=128, invert=False)
def node_threshold(image, threshold, invert):
    return np.where((image >= threshold) != invert, 255, 0).astype(np.uint8)


def otsu(plane: np.ndarray) -> int:
    """The first threshold of greatest variance between the classes v <= t and v > t."""
    n = np.bincount(plane.ravel(), minlength=256).astype(np.float64)
    low, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    return int(np.nan_to_num(between).argmax())


@image_op("ThresholdSegment", threshold_type="Binary", threshold_value=128, max_value=255, auto_threshold=False)
def threshold_segment(image, threshold_type, threshold_value, max_value, auto_threshold):
    v = gray(image)
    t = otsu(v) if auto_threshold else threshold_value
    kinds = {"Binary": (max_value, 0), "BinaryInv": (0, max_value), "Trunc": (t, v), "ToZero": (v, 0), "ToZeroInv": (0, v)}
    return np.where(v > t, *kinds[threshold_type]).astype(np.uint8)[:, :, None]


@image_op("ContrastEnhance", factor=1.5)
def contrast(image, factor):
    return clamp((image.astype(np.float64) - 128) * factor + 128)


@image_op("BrightnessAdjust", delta=50)
def brightness(image, delta):
    return clamp(image.astype(np.int32) + int(delta))


@image_op("GammaCorrect", gamma=1.0)
def gamma_correct(image, gamma):
    return clamp(np.power(np.arange(256) / 255.0, 1 / gamma) * 255)[image]


@image_op("HistogramEqualize")
def equalize(image):
    out = np.empty_like(image)
    for c in range(image.shape[2]):
        cdf = np.bincount(image[:, :, c].ravel(), minlength=256).cumsum() / image[:, :, c].size
        out[:, :, c] = clamp(cdf * 255)[image[:, :, c]]
    return out


@image_op("AdaptiveHistogramEqualize", clip_limit=40, tile_size=8)
def adaptive_equalize(image, clip_limit, tile_size):
    """Tile by tile, counts clipped and the excess spread evenly."""
    out, s = np.empty_like(image), max(int(tile_size), 1)
    for y in range(0, image.shape[0], s):
        for x in range(0, image.shape[1], s):
            tile = image[y : y + s, x : x + s]
            for c in range(image.shape[2]):
                n = np.bincount(tile[:, :, c].ravel(), minlength=256).astype(np.float64)
                spare = np.maximum(n - clip_limit, 0).sum()
                cdf = (np.minimum(n, clip_limit) + spare / 256).cumsum() / tile[:, :, c].size
                out[y : y + s, x : x + s, c] = clamp(cdf * 255)[tile[:, :, c]]
    return out


def to_hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value from 0 to 1."""
    rgb = image[:, :, :3] / 255.0
    high, low = rgb.max(2), rgb.min(2)
    span = high - low
    safe = np.where(span == 0, 1, span)
    r, g, b = (rgb[:, :, k] for k in range(3))
    hue = np.select([span == 0, high == r, high == g], [0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4) * 60
    return hue, np.where(high == 0, 0, span / np.where(high == 0, 1, high)), high


def from_hsv(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    k = [(n + h / 60) % 6 for n in (5, 3, 1)]
    return clamp(np.stack([v - v * s * np.clip(np.minimum(x, 4 - x), 0, 1) for x in k], 2) * 255 + 0.5 + 1e-6)


@image_op("SaturationAdjust", factor=1.0)
def saturation(image, factor):
    if image.shape[2] < 3:
        return image
    h, s, v = to_hsv(image)
    return from_hsv(h, np.clip(s * factor, 0, 1), v)


@image_op("HueShift", delta_h=0.0)
def hue_shift(image, delta_h):
    if image.shape[2] < 3:
        return image
    h, s, v = to_hsv(image)
    return from_hsv((h + delta_h) % 360, s, v)


@image_op("WhiteBalance", method="gray_world")
def white_balance(image, method):
    mean = image.reshape(-1, image.shape[2]).mean(0)
    want = image.reshape(-1, image.shape[2]).max(0).max() if method == "max_white" else mean.mean()
    base = image.reshape(-1, image.shape[2]).max(0) if method == "max_white" else mean
    return clamp(image * (want / np.maximum(base, 1e-9)) + 1e-6)


@image_op("color_correct", method="white_balance", white_point="", gamma=1.0, low_clip=0.01, high_clip=0.01)
def color_correct(image, method, white_point, gamma, low_clip, high_clip):
    """A white point r,g,b becomes white; without one the planes' means become alike."""
    if method == "white_balance" and white_point:
        return clamp(image * (255.0 / np.maximum([float(v) for v in white_point.split(",")][: image.shape[2]], 1e-9)) + 1e-6)
    if method == "gamma":
        return gamma_correct(image, gamma)
    if method == "auto_levels":
        low, high = np.quantile(image, low_clip), np.quantile(image, 1 - high_clip)
        return clamp((image - low) * 255.0 / max(high - low, 1e-9))
    return white_balance(image, "gray_world")


@image_op("color_convert", source_space="RGB", target_space="GRAY")
def color_convert(image, source_space, target_space):
    if source_space == "BGR":
        image = image[:, :, ::-1]
    if target_space == "GRAY":
        return gray(image, (0.299, 0.587, 0.114))[:, :, None]
    if target_space == "HSV":
        h, s, v = to_hsv(image)
        return clamp(np.stack((h / 2, s * 255, v * 255), 2) + 1e-6)
    if target_space == "BGR":
        return image[:, :, ::-1]
    return image


@image_op("color_segment", target_color="255,0,0", tolerance=30.0, color_space="RGB")
def color_segment(image, target_color, tolerance, color_space):
    d = image[:, :, :3].astype(np.float64) - np.array([float(x) for x in target_color.split(",")])
    return np.where(np.sqrt((d * d).sum(2)) <= tolerance, 255, 0).astype(np.uint8)[:, :, None]


# --- neighbourhoods


@image_op("SimpleImagePreprocess")
def blur3(image):
    return clamp(box_sum(image, 1) // 9)


@image_op("BoxFilter", kernel_size=3)
def box_filter(image, kernel_size):
    k = odd(kernel_size)
    return clamp(box_sum(image, k // 2) // (k * k))


@image_op("MedianFilter", kernel_size=3)
def median_filter(image, kernel_size):
    k = odd(kernel_size)
    near = windows(image, k // 2).reshape(*image.shape, k * k)
    return np.partition(near, k * k // 2, axis=-1)[..., k * k // 2]


def blurred(image: np.ndarray, size: int, sigma: float, kind: type = np.float64) -> np.ndarray:
    """The Gaussian as two passes of one dimension each."""
    k, (h, w) = size // 2, image.shape[:2]
    g = np.exp(-((np.arange(size) - k) ** 2) / (2 * sigma * sigma))
    g = (g / g.sum()).astype(kind)
    wide = padded(image.astype(kind), k)
    rows = sum(g[i] * wide[i : i + h] for i in range(size))
    return sum(g[i] * rows[:, i : i + w] for i in range(size))


@image_op("GaussianFilter", kernel_size=5, sigma=1.0)
def gaussian_filter(image, kernel_size, sigma):
    """In single precision; the few sums so near a whole number that this could cut them wrongly are taken again in double."""
    size = odd(kernel_size)
    out = blurred(image, size, sigma, np.float32)
    doubt = np.argwhere(abs(out - np.round(out)) < 1e-3)
    if len(doubt) and image.dtype == np.uint8:
        y, x, c = doubt.T
        near = np.lib.stride_tricks.sliding_window_view(padded(image, size // 2), (size, size), axis=(0, 1))
        for i in range(0, len(doubt), 4096):
            j = slice(i, i + 4096)
            out[y[j], x[j], c[j]] = np.floor((near[y[j], x[j], c[j]] * gaussian(size, sigma)).sum((1, 2)) + 1e-6)
    return clamp(out)


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], np.float64)


def laplacian(image: np.ndarray) -> np.ndarray:
    """Second differences inside; the border is zero."""
    out = np.zeros(image.shape)
    out[1:-1, 1:-1] = correlate(image, LAPLACE)[1:-1, 1:-1]
    return out


@image_op("LaplacianFilter")
def laplacian_filter(image):
    return clamp(abs(laplacian(image)))


@image_op("SharpenFilter", strength=1.0)
def sharpen(image, strength):
    return clamp(image - strength * laplacian(image))


@image_op("UnsharpMask", radius=5, sigma=1.0, amount=1.5, threshold=0)
def unsharp(image, radius, sigma, amount, threshold):
    """A Gaussian of `radius` samples across; differences up to the threshold stay as they are."""
    off = image - blurred(image, odd(radius), sigma)
    return clamp(image + np.where(abs(off) > threshold, amount * off, 0) + 1e-6)


def _bilateral(image, d, sigma_color, sigma_space):
    k = odd(d) // 2
    near = windows(image.astype(np.float64), k)
    y, x = np.mgrid[-k : k + 1, -k : k + 1]
    w = np.exp(-(x * x + y * y) / (2 * sigma_space**2)) * np.exp(-((near - image[..., None, None]) ** 2) / (2 * sigma_color**2))
    return clamp((near * w).sum((-1, -2)) / w.sum((-1, -2)) + 1e-6)


image_op("BilateralFilter", d=5, sigma_color=75.0, sigma_space=75.0)(_bilateral)
image_op("DenoiseBilateral", d=9, sigma_color=75.0, sigma_space=75.0)(_bilateral)


@image_op("GuidedFilter", radius=8, epsilon=0.01)
def guided(image, radius, epsilon):
    v, k = image / 255.0, int(radius)
    area = (2 * k + 1) ** 2
    mean, square = box_sum(v, k) / area, box_sum(v * v, k) / area
    a = (square - mean * mean) / (square - mean * mean + epsilon)
    return clamp((box_sum(a, k) * v + box_sum(mean - a * mean, k)) / area * 255 + 1e-6)


@image_op("DenoiseNLM", search_window=7, template_size=3, h=10.0)
def non_local_means(image, search_window, template_size, h):
    s, t = odd(search_window) // 2, odd(template_size) // 2
    v, wide = image.astype(np.float64), padded(image.astype(np.float64), s)
    total, weight = np.zeros(v.shape), np.zeros(v.shape)
    for dy in range(2 * s + 1):
        for dx in range(2 * s + 1):
            other = wide[dy : dy + v.shape[0], dx : dx + v.shape[1]]
            w = np.exp(-box_sum((v - other) ** 2, t) / (2 * t + 1) ** 2 / (h * h))
            total += w * other
            weight += w
    return clamp(total / weight)


@image_op("DenoiseAdaptive", window_size=7, noise_level=25.0)
def wiener(image, window_size, noise_level):
    k = odd(window_size) // 2
    area = (2 * k + 1) ** 2
    mean = box_sum(image, k) / area
    var = np.maximum(box_sum(image.astype(np.float64) ** 2, k) / area - mean**2, 0)
    return clamp(mean + np.maximum(var - noise_level**2, 0) / np.maximum(var, 1e-9) * (image - mean))


@image_op("DenoiseWavelet", threshold=20.0)
def haar(image, threshold):
    """One Haar level with soft-thresholded details; an odd last row or column stays."""
    out = image.astype(np.float64)
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    a, b, c, d = out[0:h:2, 0:w:2].copy(), out[0:h:2, 1:w:2].copy(), out[1:h:2, 0:w:2].copy(), out[1:h:2, 1:w:2].copy()
    soft = lambda x: np.sign(x) * np.maximum(abs(x) - threshold, 0)
    low, x, y, z = (a + b + c + d) / 2, soft((a - b + c - d) / 2), soft((a + b - c - d) / 2), soft((a - b - c + d) / 2)
    out[0:h:2, 0:w:2], out[0:h:2, 1:w:2], out[1:h:2, 0:w:2], out[1:h:2, 1:w:2] = (low + x + y + z) / 2, (low - x + y - z) / 2, (low + x - y - z) / 2, (low - x - y + z) / 2
    return clamp(out)


SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], np.float64)


def gradient(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel responses inside; zero on the border."""
    gx, gy = np.zeros(plane.shape), np.zeros(plane.shape)
    gx[1:-1, 1:-1] = correlate(plane[:, :, None], SOBEL)[1:-1, 1:-1, 0]
    gy[1:-1, 1:-1] = correlate(plane[:, :, None], SOBEL.T)[1:-1, 1:-1, 0]
    return gx, gy


@image_op("SobelEdge", threshold=50)
def sobel(image, threshold):
    gx, gy = gradient(gray(image))
    return np.where(np.floor(np.sqrt(gx * gx + gy * gy)) > threshold, 255, 0).astype(np.uint8)[:, :, None]


@image_op("CannyEdge", low_threshold=50, high_threshold=100)
def canny(image, low_threshold, high_threshold):
    """Non-maximum suppression along the gradient, then edges above low that touch one above high."""
    gx, gy = gradient(gray(image))
    m = np.hypot(gx, gy)
    step = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    wide, thin = np.pad(m, 1), np.zeros(m.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        a, b = wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx], wide[1 - dy : wide.shape[0] - 1 - dy, 1 - dx : wide.shape[1] - 1 - dx]
        thin |= (step == k) & (m >= a) & (m > b)
    weak, keep = thin & (m > low_threshold), thin & (m > high_threshold)
    while True:
        more = weak & (windows(keep[:, :, None], 1).any((-1, -2))[:, :, 0])
        if (more == keep).all():
            return np.where(keep, 255, 0).astype(np.uint8)[:, :, None]
        keep = more


@image_op("AdaptiveThreshold", method="Mean", block_size=31, c=5, threshold_type="Binary")
def adaptive_threshold(image, method, block_size, c, threshold_type):
    """Against the box mean rounded down; both methods use it."""
    v, k = gray(image).astype(np.int64), max(odd(block_size), 3)
    on = v > box_sum(v[:, :, None], k // 2)[:, :, 0] // (k * k) - int(c)
    return np.where(on != (threshold_type == "BinaryInv"), 255, 0).astype(np.uint8)[:, :, None]


# --- morphology: samples outside the image take no part


def element(shape: str, size: int) -> np.ndarray:
    k = odd(size) // 2
    y, x = np.mgrid[-k : k + 1, -k : k + 1]
    return {"Cross": (x == 0) | (y == 0), "Ellipse": x * x + y * y <= k * k, "Diamond": abs(x) + abs(y) <= k}.get(shape, np.ones_like(x, bool))


def extreme(image: np.ndarray, shape: np.ndarray, erode: bool) -> np.ndarray:
    k, fill = shape.shape[0] // 2, 255 if erode else 0
    wide = np.pad(image, ((k, k), (k, k), (0, 0)), constant_values=fill)
    out = np.full_like(image, fill)
    for dy, dx in np.argwhere(shape):
        (np.minimum if erode else np.maximum)(out, wide[dy : dy + image.shape[0], dx : dx + image.shape[1]], out=out)
    return out


def morph(image: np.ndarray, operation: str, kernel_shape: str, kernel_size: int, iterations: int) -> np.ndarray:
    shape, n = element(kernel_shape, int(kernel_size)), int(iterations)

    def run(v, *kinds):
        for erode in kinds:
            for _ in range(n):
                v = extreme(v, shape, erode)
        return v

    opened, closed = (True, False), (False, True)
    wide = image.astype(np.int32)
    return {
        "Erode": lambda: run(image, True), "Dilate": lambda: run(image, False), "Open": lambda: run(image, *opened), "Close": lambda: run(image, *closed),
        "Gradient": lambda: clamp(run(image, False).astype(np.int32) - run(image, True)), "TopHat": lambda: clamp(wide - run(image, *opened)), "BlackHat": lambda: clamp(run(image, *closed) - wide),
    }[operation]()


image_op("Morphology", operation="Erode", kernel_shape="Rect", kernel_size=3, iterations=1)(morph)


@image_op("ThresholdMorph", threshold=128, morph_op="Erode", kernel_shape="Rect", kernel_size=3, iterations=1)
def threshold_morph(image, threshold, morph_op, kernel_shape, kernel_size, iterations):
    return morph(simple_threshold(gray(image)[:, :, None], threshold, 255), morph_op, kernel_shape, kernel_size, iterations)


@image_op("ExtractBoundary")
def boundary(image):
    return clamp(image.astype(np.int32) - extreme(image, element("Rect", 3), True))


@image_op("FillHoles")
def fill_holes(image):
    """Background that no path of background joins to the border becomes foreground."""
    empty = gray(image) == 0
    outside = np.zeros(empty.shape, bool)
    outside[[0, -1]], outside[:, [0, -1]] = empty[[0, -1]], empty[:, [0, -1]]
    cross = element("Cross", 3)
    while True:
        more = extreme(outside[:, :, None].astype(np.uint8) * 255, cross, False)[:, :, 0].astype(bool) & empty
        if (more == outside).all():
            return np.where(outside, 0, 255).astype(np.uint8)[:, :, None]
        outside = more


@image_op("Thinning", max_iterations=100)
def thinning(image, max_iterations):
    """Peel border points in two alternating passes while each keeps its neighbourhood in one piece."""
    on = gray(image) > 0
    for _ in range(int(max_iterations)):
        before = on.copy()
        for first in (True, False):
            w = np.pad(on, 1)
            at = lambda dy, dx, w=w: w[1 + dy : w.shape[0] - 1 + dy, 1 + dx : w.shape[1] - 1 + dx]
            ring = [at(*d) for d in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count = sum(r.astype(int) for r in ring)
            turns = sum((~ring[k] & ring[(k + 1) % 8]).astype(int) for k in range(8))
            n, e, s, west = ring[0], ring[2], ring[4], ring[6]
            gone = on & (count >= 2) & (count <= 6) & (turns == 1) & (~(n & e & s) & ~(e & s & west) if first else ~(n & e & west) & ~(n & s & west))
            on = on & ~gone
        if (on == before).all():
            break
    return np.where(on, 255, 0).astype(np.uint8)[:, :, None]


# --- geometry


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, smooth: bool = True, fill: int = 0) -> np.ndarray:
    """The image at real positions: bilinear or nearest; `fill` outside."""
    h, w = image.shape[:2]
    inside = (x >= -0.5) & (x <= w - 0.5) & (y >= -0.5) & (y <= h - 0.5)
    if not smooth:
        out = image[np.clip(np.floor(y + 0.5), 0, h - 1).astype(int), np.clip(np.floor(x + 0.5), 0, w - 1).astype(int)]
        return np.where(inside[..., None], out, fill).astype(image.dtype)
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    out = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.where(inside[..., None], clamp(out + 1e-9), fill).astype(image.dtype)


@image_op("Flip", horizontal=True, vertical=False)
def flip(image, horizontal, vertical):
    return image[:: -1 if vertical else 1, :: -1 if horizontal else 1]


def _crop(image, x, y, width, height):
    x, y = max(int(x), 0), max(int(y), 0)
    return image[y : y + int(height), x : x + int(width)]


image_op("ROICrop", x=0, y=0, width=100, height=100)(_crop)
image_op("Crop", roi_x=0, roi_y=0, roi_width=100, roi_height=100)(lambda image, roi_x, roi_y, roi_width, roi_height: _crop(image, roi_x, roi_y, roi_width, roi_height))


@image_op("Translate", offset_x=0, offset_y=0, fill_value=0)
def translate(image, offset_x, offset_y, fill_value):
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(np.float64)
    return sample(image, x - int(offset_x), y - int(offset_y), False, int(fill_value))


@image_op("Resize", width=0, height=0, scale_x=1.0, scale_y=1.0, interpolation="bilinear")
def resize(image, width, height, scale_x, scale_y, interpolation):
    w, h = int(width) or max(int(image.shape[1] * scale_x), 1), int(height) or max(int(image.shape[0] * scale_y), 1)
    y, x = np.mgrid[:h, :w].astype(np.float64)
    fx, fy = image.shape[1] / w, image.shape[0] / h
    if interpolation == "nearest":
        return image[np.minimum((y * fy).astype(int), image.shape[0] - 1), np.minimum((x * fx).astype(int), image.shape[1] - 1)]
    return sample(image, np.clip((x + 0.5) * fx - 0.5, 0, image.shape[1] - 1), np.clip((y + 0.5) * fy - 0.5, 0, image.shape[0] - 1))


@image_op("Rotate", angle=0.0, center_x=-1.0, center_y=-1.0, expand_canvas=True)
def rotate(image, angle, center_x, center_y, expand_canvas):
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    cx, cy = (center_x if center_x >= 0 else (w - 1) / 2), (center_y if center_y >= 0 else (h - 1) / 2)
    nw, nh = (int(np.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(np.ceil(abs(w * s) + abs(h * c) - 1e-9))) if expand_canvas else (w, h)
    y, x = np.mgrid[:nh, :nw].astype(np.float64)
    x, y = x - ((nw - 1) / 2 if expand_canvas else cx), y - ((nh - 1) / 2 if expand_canvas else cy)
    return sample(image, c * x + s * y + cx, -s * x + c * y + cy)


@image_op("AffineTransform", matrix="1,0,0,0,1,0")
def affine(image, matrix):
    m = np.array([float(v) for v in matrix.strip("[]").split(",")]).reshape(2, 3)
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(np.float64)
    back = np.linalg.inv(m[:, :2])
    x, y = x - m[0, 2], y - m[1, 2]
    return sample(image, back[0, 0] * x + back[0, 1] * y, back[1, 0] * x + back[1, 1] * y)


@image_op("PerspectiveTransform", src_points="", dst_points="")
def perspective(image, src_points, dst_points):
    """The homography from four points to four; without points the image stays."""
    if not src_points or not dst_points:
        return image
    src, dst = (np.array([float(v) for v in p.strip("[]").split(",")]).reshape(4, 2) for p in (src_points, dst_points))
    rows = [r for (x, y), (u, v) in zip(dst, src, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    m = np.append(np.linalg.solve(np.array(rows), src.ravel()), 1).reshape(3, 3)
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(np.float64)
    w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    return sample(image, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w)


@image_op("GeometricCalibration", pixel_size_x=1.0, pixel_size_y=1.0, distortion_k1=0.0, distortion_k2=0.0)
def undistort(image, pixel_size_x, pixel_size_y, distortion_k1, distortion_k2):
    h, w = image.shape[:2]
    y, x = np.mgrid[:h, :w].astype(np.float64)
    x, y = (x - w / 2) * pixel_size_x, (y - h / 2) * pixel_size_y
    r = (x * x + y * y) / max((w / 2) ** 2 + (h / 2) ** 2, 1)
    f = 1 + distortion_k1 * r + distortion_k2 * r * r
    return sample(image, x * f / pixel_size_x + w / 2, y * f / pixel_size_y + h / 2)


@image_op("DriftCorrection", drift_x=0.0, drift_y=0.0, apply_offset=True)
def drift(image, drift_x, drift_y, apply_offset):
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(np.float64)
    return sample(image, x + drift_x, y + drift_y) if apply_offset else image


# --- frequency domain


def spectrum_op(type_id: str, **params):
    """Register response(distance, **params): the factor at each frequency, 0.5 being half a cycle a sample."""

    def add(response):
        def kernel(image, **p):
            out = np.empty(image.shape)
            fy, fx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None, :]
            for c in range(image.shape[2]):
                out[:, :, c] = np.fft.ifft2(np.fft.fft2(image[:, :, c].astype(np.float64)) * response(np.hypot(fy, fx), **p)).real
            return clamp(out + 1e-6)

        return image_op(type_id, **params)(kernel)

    return add


def _bell(d: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-((d * 100) ** 2) / (2 * sigma * sigma))  # sigma in hundredths of a cycle


spectrum_op("IdealLowPass", cutoff_frequency=0.5)(lambda d, cutoff_frequency: d <= cutoff_frequency)
spectrum_op("IdealHighPass", cutoff_frequency=0.1)(lambda d, cutoff_frequency: d > cutoff_frequency)
spectrum_op("GaussLowPass", sigma=10.0)(lambda d, sigma: _bell(d, sigma))
spectrum_op("GaussHighPass", sigma=10.0)(lambda d, sigma: 1 - _bell(d, sigma))
spectrum_op("ButterworthLowPass", cutoff_frequency=0.5, order=2)(lambda d, cutoff_frequency, order: 1 / (1 + (d / cutoff_frequency) ** (2 * order)))
spectrum_op("ButterworthHighPass", cutoff_frequency=0.1, order=2)(lambda d, cutoff_frequency, order: 1 - 1 / (1 + (d / cutoff_frequency) ** (2 * order)))
spectrum_op("BandPass", center_frequency=0.3, bandwidth=0.1)(lambda d, center_frequency, bandwidth: abs(d - center_frequency) <= bandwidth / 2)
spectrum_op("BandStop", center_frequency=0.3, bandwidth=0.1)(lambda d, center_frequency, bandwidth: abs(d - center_frequency) > bandwidth / 2)
spectrum_op("FrequencySmooth", sigma=5.0)(lambda d, sigma: _bell(d, sigma))
spectrum_op("FrequencySharpen", amount=1.0, radius=20.0)(lambda d, amount, radius: 1 + amount * (1 - _bell(d, radius)))
spectrum_op("FrequencyUnsharpMask", sigma=5.0, amount=0.5)(lambda d, sigma, amount: 1 + amount * (1 - _bell(d, sigma)))


@image_op("HomomorphicFilter", high_frequency_gain=2.0, low_frequency_gain=0.5, cutoff_frequency=0.2)
def homomorphic(image, high_frequency_gain, low_frequency_gain, cutoff_frequency):
    out = np.empty(image.shape)
    d = np.hypot(np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None, :])
    gain = (high_frequency_gain - low_frequency_gain) * (1 - np.exp(-(d**2) / (2 * cutoff_frequency**2))) + low_frequency_gain
    for c in range(image.shape[2]):
        out[:, :, c] = np.expm1(np.fft.ifft2(np.fft.fft2(np.log1p(image[:, :, c].astype(np.float64))) * gain).real)
    return clamp(out + 1e-6)


def _plane(v: np.ndarray) -> np.ndarray:
    span = v.max() - v.min()
    return clamp((v - v.min()) * (255.0 / span if span else 0) + 1e-6)[:, :, None]


image_op("MagnitudeSpectrum", log_scale=True)(lambda image, log_scale: _plane(np.log1p(abs(np.fft.fftshift(np.fft.fft2(gray(image))))) if log_scale else abs(np.fft.fftshift(np.fft.fft2(gray(image))))))
image_op("PhaseSpectrum")(lambda image: _plane(np.angle(np.fft.fftshift(np.fft.fft2(gray(image))))))
pair_op("FrequencyMultiply")(lambda a, b: _plane(np.fft.ifft2(np.fft.fft2(gray(a)) * np.fft.fft2(gray(b))).real))
pair_op("FrequencyCorrelate")(lambda a, b: _plane(np.fft.ifft2(np.fft.fft2(gray(a)) * np.conj(np.fft.fft2(gray(b)))).real))


# --- stereo and depth, per sample


@pair_op("stereo_match_bm", num_disparities=64, block_size=15, min_disparity=0)
def block_match(left, right, num_disparities, block_size, min_disparity):
    """Disparity of least absolute difference over a block; the smallest of equals."""
    a, b, k = gray(left).astype(np.float64)[:, :, None], gray(right).astype(np.float64)[:, :, None], odd(block_size) // 2
    best, at = np.full(a.shape, np.inf), np.zeros(a.shape)
    for d in range(int(min_disparity), int(min_disparity) + int(num_disparities)):
        moved = np.roll(b, d, axis=1)
        moved[:, :d] = 1e6
        cost = box_sum(abs(a - moved), k)
        at, best = np.where(cost < best, d, at), np.minimum(cost, best)
    return at.astype(np.float32)


image_op("disparity_to_depth", baseline=60.0, focal_length=1800.0)(lambda image, baseline, focal_length: np.where(image > 0, focal_length * baseline / np.maximum(image.astype(np.float64), 1e-9), 0).astype(np.float32))


def run(frames: DataFrame, *steps: tuple[str, dict]) -> DataFrame:
    """A chain of image operators in one pass."""
    from ..spec import find

    return map_images(frames, *[partial(find(t).kernel, **find(t).bind(p)) for t, p in steps])
