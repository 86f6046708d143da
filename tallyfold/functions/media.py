"""Perceptual hashes of gray images, and what a video probe prints."""

from __future__ import annotations

import math
import re

import numpy as np

SIDE, LOW = 32, 8


def dct_basis(n: int = SIDE) -> np.ndarray:
    """Rows of the DCT-II, the first scaled by 1 / sqrt 2."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * n))
    basis[0] /= math.sqrt(2)
    return basis


_BASIS = dct_basis()


def box_scale(gray: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means of boxes; each box has one pixel at least."""
    h, w = gray.shape
    sums = np.pad(gray.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cut = lambda n: (np.arange(side) * n // side, np.maximum((np.arange(side) + 1) * n // side, np.arange(side) * n // side + 1).clip(max=n))
    (y0, y1), (x0, x1) = cut(h), cut(w)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    box = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return box / np.maximum(area, 1)


def triangle_weights(n: int, side: int) -> np.ndarray:
    """[side, n]: the share of each of n samples in each of ``side``, a triangle as wide as the scale on both sides."""
    ratio = n / side
    scale = max(ratio, 1.0)
    away = np.abs(np.arange(n)[None, :] + 0.5 - (np.arange(side)[:, None] + 0.5) * ratio)
    w = np.maximum(1.0 - away / scale, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def luma(pixels: np.ndarray) -> np.ndarray:
    """Gray of whole-number red, green and blue."""
    return (pixels[..., :3].astype(np.int64) @ np.array([2126, 7152, 722])) // 10_000


def image_phash(pixels: np.ndarray) -> int | None:
    """The hash of an image (gray, or red, green and blue), scaled with a triangle filter before it turns gray; None without pixels."""
    if pixels.ndim not in (2, 3) or 0 in pixels.shape:
        return None
    tall, wide = triangle_weights(pixels.shape[0], SIDE), triangle_weights(pixels.shape[1], SIDE)
    small = np.tensordot(wide, np.tensordot(tall, pixels.astype(np.float64), (1, 0)), (1, 1)).swapaxes(0, 1)
    small = np.floor(small.clip(0, 255) + 0.5).astype(np.int64)
    return phash(small if small.ndim == 2 else luma(small))


def phash(gray: np.ndarray) -> int | None:
    """63 bits, one for each low frequency above their mean; None without pixels."""
    if gray.ndim != 2 or 0 in gray.shape:
        return None
    low = (_BASIS @ box_scale(gray) @ _BASIS.T)[:LOW, :LOW].ravel()[1:]
    return int(sum(1 << i for i in np.flatnonzero(low > low.mean()).tolist()))


def parse_duration(text: str) -> float | None:
    """Seconds of the first ``Duration: HH:MM:SS.ff``."""
    m = re.search(r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", text)
    return int(m[1]) * 3600 + int(m[2]) * 60 + float(m[3]) if m else None


def frame_rate(duration: float, frames: int = 24) -> float:
    """Frames a second, so that ``frames`` are spread over the whole video; two a second at most."""
    return min(frames / duration, 2.0) if duration > 0 else 2.0
