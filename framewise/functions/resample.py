"""Smaller pictures by a windowed sinc, one axis after the other."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Lobes of the sinc on each side.
LOBES = 3


@lru_cache(maxsize=64)
def weights(length: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``to`` new positions the first of the old ones that it takes, and their weights; rows are as long as the longest, filled with 0."""
    scale = max(length / to, 1.0)
    middle = (np.arange(to) + 0.5) * length / to
    first = np.maximum(0, np.floor(middle - LOBES * scale).astype(int))
    n = int(min(length, np.ceil(2 * LOBES * scale) + 2))
    first = np.minimum(first, length - n)
    x = (first[:, None] + np.arange(n)[None] + 0.5 - middle[:, None]) / scale
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return first, w / w.sum(1, keepdims=True)


def _along_columns(pixels: np.ndarray, to: int) -> np.ndarray:
    """The second axis in ``to`` steps; one weight of all positions at a time, so the working memory is the result's."""
    if pixels.shape[1] == to:
        return pixels
    first, w = weights(pixels.shape[1], to)
    out = np.zeros((pixels.shape[0], to, *pixels.shape[2:]), np.float32)
    for k in range(w.shape[1]):
        one = w[:, k].astype(np.float32)
        if one.any():
            out += pixels[:, first + k] * one.reshape(1, -1, *[1] * (pixels.ndim - 2))
    return out


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture in that size, as bytes."""
    if pixels.shape[:2] == (height, width):
        return pixels
    made = _along_columns(pixels, width).swapaxes(0, 1)
    made = _along_columns(np.ascontiguousarray(made), height).swapaxes(0, 1)
    return np.clip(np.rint(made), 0, 255).astype(np.uint8)


def fitted(pixels: np.ndarray, longest: int) -> np.ndarray:
    """The picture with its longest side ``longest`` and the other to match; one that is not larger stays."""
    height, width = pixels.shape[:2]
    if max(height, width) <= longest:
        return pixels
    if width >= height:
        return resized(pixels, max(1, round(longest * height / width)), longest)
    return resized(pixels, longest, max(1, round(longest * width / height)))
