"""Models of a few lines that show what the inference operators expect of a function."""

from __future__ import annotations

import numpy as np

from .images import gray


def bright_tiles(image: np.ndarray, size: int = 8) -> np.ndarray:
    """x, y, width, height, score, class of every whole tile: the score is its mean brightness, the class tells light halves."""
    plane = gray(image).astype(np.float64)
    out = []
    for y in range(0, plane.shape[0] - size + 1, size):
        for x in range(0, plane.shape[1] - size + 1, size):
            score = plane[y : y + size, x : x + size].mean() / 255
            out.append((x, y, size, size, score, (x // size + y // size) % 2))
    return np.array(out).reshape(-1, 6)


def quadrant_logits(image: np.ndarray) -> np.ndarray:
    """Mean brightness, over 64, of the four quarters."""
    plane = gray(image).astype(np.float64)
    h, w = plane.shape[0] // 2, plane.shape[1] // 2
    return np.array([plane[:h, :w].mean(), plane[:h, w:].mean(), plane[h:, :w].mean(), plane[h:, w:].mean()]) / 64


def three_levels(image: np.ndarray) -> np.ndarray:
    """Scores of dark, middle and light."""
    plane = gray(image).astype(np.float64)
    return np.stack([-abs(plane - v) for v in (32, 128, 224)])


def row_means(image: np.ndarray) -> np.ndarray:
    return gray(image).astype(np.float64).mean(1)
