"""Shifts of pictures given as arrays (height, width, channels) of bytes. Decoding and encoding of files are the caller's: no codec is assumed.

A condition is written ``name`` or ``name_severity``, the severity from 1 to 5.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Strength by severity 1 to 5.
STRENGTHS = {
    "blur": (1.0, 2.0, 3.0, 4.0, 6.0),
    "noise": (0.04, 0.06, 0.08, 0.12, 0.18),
    "downsample": (0.6, 0.5, 0.4, 0.3, 0.25),
    "contrast": (0.75, 0.5, 0.4, 0.3, 0.15),
    "brightness": (0.05, 0.1, 0.15, 0.2, 0.3),
    "occlusion": (0.1, 0.2, 0.3, 0.4, 0.5),
}


def parse_condition(condition: str) -> tuple[str, int]:
    """(name, severity); clean has severity 0, a name alone 3."""
    name, _, level = condition.rpartition("_")
    if condition == "clean":
        return "clean", 0
    if not name:
        name, level = condition, "3"
    if name not in STRENGTHS or not level.isdigit() or not 1 <= int(level) <= 5:
        raise ValueError(f"there is no condition {condition}")
    return name, int(level)


def _seed(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little"))


def _blur(x: np.ndarray, radius: float) -> np.ndarray:
    k = int(3 * radius) + 1
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / radius) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = [(k, k) if a == axis else (0, 0) for a in range(x.ndim)]
        y = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        x = sum(c * np.take(y, np.arange(i, i + n), axis=axis) for i, c in enumerate(w))
    return x


def corrupt(picture: np.ndarray, condition: str, image_id: str = "") -> np.ndarray:
    """The picture under a condition; the noise is the same for the same image and condition."""
    name, level = parse_condition(condition)
    if name == "clean" or picture.size == 0:
        return picture.copy()
    s, x = STRENGTHS[name][level - 1], picture.astype(float)
    if name == "blur":
        x = _blur(x, s)
    elif name == "noise":
        x = x + _seed(image_id, condition).normal(0, 255 * s, x.shape)
    elif name == "contrast":
        x = (x - x.mean()) * s + x.mean()
    elif name == "brightness":
        x = x + 255 * s
    elif name == "downsample":
        h, w = (max(1, int(round(n * s))) for n in x.shape[:2])
        rows, cols = ((np.arange(n) * k // n) * n // k for n, k in ((x.shape[0], h), (x.shape[1], w)))
        x = x[rows][:, cols]
    elif name == "occlusion":
        h, w = (max(1, int(n * s)) for n in x.shape[:2])
        r = _seed(image_id, condition)
        top, left = (int(r.integers(0, n - k + 1)) for n, k in ((x.shape[0], h), (x.shape[1], w)))
        x[top : top + h, left : left + w] = 0
    return np.clip(np.round(x), 0, 255).astype(np.uint8)


def mask_boxes(picture: np.ndarray, boxes: list[tuple[float, float, float, float]], pad: float = 0.0) -> np.ndarray:
    """Boxes (x, y, width, height), widened by a share of their size, filled with the picture's mean colour."""
    out = picture.copy()
    mean = np.round(picture.reshape(-1, picture.shape[-1]).mean(axis=0)).astype(np.uint8)
    for x, y, w, h in boxes:
        x0, y0 = max(0, int(np.floor(x - pad * w))), max(0, int(np.floor(y - pad * h)))
        out[y0 : int(np.ceil(y + h + pad * h)), x0 : int(np.ceil(x + w + pad * w))] = mean
    return out


def padded_crop(picture: np.ndarray, box: tuple[float, float, float, float], pad: float = 0.1) -> np.ndarray:
    """The box (x0, y0, x1, y1) widened by a share of its size, inside the picture; at least one pixel."""
    x0, y0, x1, y1 = box
    w, h = pad * (x1 - x0), pad * (y1 - y0)
    a, b = max(0, int(np.floor(x0 - w))), max(0, int(np.floor(y0 - h)))
    return picture[b : max(b + 1, int(np.ceil(y1 + h))), a : max(a + 1, int(np.ceil(x1 + w)))]


def cap_pixels(height: int, width: int, most: int) -> tuple[int, int]:
    """The size that keeps the shape and has at most ``most`` pixels."""
    if height * width <= most:
        return height, width
    f = (most / (height * width)) ** 0.5
    return max(1, int(height * f)), max(1, int(width * f))
