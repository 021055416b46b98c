"""Image kernels that no column expression holds: a page's action list folded over its pixels, one image at a time.

Images are (image_id, height, width, data) with data the gray bytes in row order. Filters go over a page in strips.
Contrast, shadow and skew kernels are the plain NumPy forms of their methods, not bit-equal to an image library's;
denoising is a median in place of non-local means; the others are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .parts import edges, gauss, medians, parts, straight_lines, weighted

Kernel = Callable[[np.ndarray], np.ndarray]


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def threshold(img: np.ndarray) -> int:
    """Otsu's threshold; the smallest on a tie."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    n1, total = n0[-1] - n0, s0[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        b = (s0 * n0[-1] - total * n0) ** 2 / (n0 * n1)
    return int(np.argmax(np.nan_to_num(b, nan=0.0, posinf=0.0)))


def equalize(img: np.ndarray) -> np.ndarray:
    cdf = np.cumsum(np.bincount(img.ravel(), minlength=256))
    low = cdf[cdf > 0][0]
    return img if cdf[-1] == low else _byte((cdf - low) * 255.0 / (cdf[-1] - low))[img]


def local_contrast(img: np.ndarray, tiles: int = 8, clip: float = 3.0) -> np.ndarray:
    """Equalisation with clipped histograms of tiles, each pixel between the four tiles around it by distance."""
    h, w = img.shape
    rows, cols = min(tiles, h), min(tiles, w)
    maps = np.empty((rows, cols, 256))
    for i, ys in enumerate(np.array_split(np.arange(h), rows)):
        for j, xs in enumerate(np.array_split(np.arange(w), cols)):
            part = img[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            cdf = np.cumsum(np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256)
            maps[i, j] = cdf / cdf[-1] * 255

    def between(n, count):
        at = np.clip((np.arange(n) + 0.5) * count / n - 0.5, 0, count - 1)
        low = np.minimum(at.astype(int), max(count - 2, 0))
        return low, np.minimum(low + 1, count - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, rows), between(w, cols)
    out = np.empty_like(img)
    for y in range(h):
        v = img[y]
        top = (1 - fx) * maps[y0[y], x0, v] + fx * maps[y0[y], x1, v]
        low = (1 - fx) * maps[y1[y], x0, v] + fx * maps[y1[y], x1, v]
        out[y] = _byte((1 - fy[y]) * top + fy[y] * low)
    return out


def crisp(img: np.ndarray) -> np.ndarray:
    """Nine times a pixel less its eight neighbours, within a byte; edges are mirrored. What PDF pages get."""
    return _byte(10 * img.astype(float) - weighted(img, np.ones(3), "reflect"))


def basic(img: np.ndarray, contrast: float = 1.2, sharpness: float = 1.1, value: float = 0.8) -> np.ndarray:
    """The basic level: contrast about the mean, a little sharpening against the smoothed image, gamma."""
    x = np.clip(img.mean() + contrast * (img.astype(float) - img.mean()), 0, 255)
    smooth = (weighted(x, np.ones(3)) + 4 * x) / 13
    return gamma(_byte(smooth + sharpness * (x - smooth)), value)


def sharpen(img: np.ndarray) -> np.ndarray:
    return _byte(0.3 * img + 0.7 * crisp(img))


def gamma(img: np.ndarray, value: float = 1.2) -> np.ndarray:
    return (np.power(np.arange(256) / 255.0, 1 / value) * 255).astype(np.uint8)[img]


def adaptive(img: np.ndarray, size: int = 11, offset: float = 2.0) -> np.ndarray:
    return np.where(img > weighted(img, gauss(size)) - offset, 255, 0).astype(np.uint8)


def unshadow(img: np.ndarray, size: int = 21) -> np.ndarray:
    """A page over its background: the smoothed maximum around each pixel."""
    pad, (h, w) = size // 2, img.shape
    wide = np.pad(img, pad, mode="edge")
    across = np.maximum.reduce([wide[:, i : i + w] for i in range(size)])
    back = np.maximum.reduce([across[i : i + h] for i in range(size)])
    return _byte(img / np.maximum(weighted(back, np.full(size, 1 / size)), 1) * 255)


def crop(img: np.ndarray, margin: int = 20) -> np.ndarray:
    """The box of the largest part of the ink, with a margin; the first of equal ones."""
    if img.min() == img.max():
        return img
    found = parts(img <= threshold(img))
    x0, y0, x1, y1 = max(found, key=lambda p: p["area"])["box"]
    x, y = max(0, x0 - margin), max(0, y0 - margin)
    return img[y : y + min(img.shape[0] - y, y1 - y0 + 2 * margin), x : x + min(img.shape[1] - x, x1 - x0 + 2 * margin)]


def deskew(img: np.ndarray) -> np.ndarray:
    """Turned by the median angle of its near-horizontal lines, on white, large enough to hold the whole page."""
    angles = [d - 90 for _, d in straight_lines(edges(img), 100) if abs(d - 90) < 45]
    angle = float(np.median(angles)) if angles else 0.0
    return turned(img, angle) if angle else img


def turned(img: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned about its centre, counter-clockwise, by the nearest four pixels; beyond it white."""
    h, w = img.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    out = np.empty((nh, nw), np.uint8)
    wide = np.pad(img.astype(float), 1, constant_values=255)
    x = np.arange(nw) - nw / 2
    for y in range(nh):
        dy = y - nh / 2
        sx, sy = np.clip(c * x - s * dy + w / 2, -1, w), np.clip(s * x + c * dy + h / 2, -1, h)
        x0, y0 = np.minimum(np.floor(sx), w - 1).astype(int), np.minimum(np.floor(sy), h - 1).astype(int)
        fx, fy = sx - x0, sy - y0
        four = [wide[y0 + 1 + a, x0 + 1 + b] * (fy if a else 1 - fy) * (fx if b else 1 - fx) for a in (0, 1) for b in (0, 1)]
        out[y] = _byte(sum(four))
    return out


def outlined(img: np.ndarray, boxes: list[tuple[int, int, int, int, int, int]]) -> np.ndarray:
    """The page with boxes (x, y, width, height, line width, gray) drawn on it, inwards, later ones on top."""
    out = img.copy()
    for x, y, w, h, line, gray in boxes:
        part = out[y : y + h + 1, x : x + w + 1]
        hole = part[line:-line, line:-line].copy() if min(part.shape) > 2 * line else None
        part[:] = gray
        if hole is not None:
            part[line:-line, line:-line] = hole
    return out


#: Action -> kernel. An action without a kernel leaves the image as it is.
KERNELS: dict[str, Kernel] = {
    "rotate_90_cw": lambda i: np.rot90(i, -1), "rotate_90_ccw": lambda i: np.rot90(i, 1), "rotate_180": lambda i: np.rot90(i, 2), "straighten_perspective": lambda i: i,
    "binarize": lambda i: np.where(i > threshold(i), 255, 0).astype(np.uint8), "histogram_equalization": equalize, "enhance_contrast": local_contrast, "sharpen": sharpen,
    "gamma_correction": gamma, "adaptive_threshold": adaptive, "remove_shadows": unshadow, "crop_margins": crop, "deskew": deskew, "basic": basic,
    "denoise": lambda i: medians(i, 3),
}


def apply_actions(images: DataFrame, kernels: dict[str, Kernel] | None = None) -> DataFrame:
    """images (image_id, height, width, data, actions, already in order) -> image_id, height, width, data, applied,
    success, error. A failing action is skipped; an image that can't be read comes back unchanged with success false."""
    table = kernels or KERNELS

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                applied, error, size = [], None, (r.height, r.width)
                data = r.data
                try:
                    img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                    for a in r.actions if r.actions is not None else []:
                        try:
                            img = np.ascontiguousarray(table.get(a, lambda i: i)(img))
                            applied.append(a)
                        except Exception as e:  # the action is skipped by contract
                            error = f"{a}: {e}"
                    data, size = img.tobytes(), img.shape
                except (TypeError, ValueError) as e:
                    applied, error = [], f"image: {e}"
                rows.append((r.image_id, int(size[0]), int(size[1]), data, applied, not (error or "").startswith("image: "), error))
            yield pd.DataFrame(rows, columns=["image_id", "height", "width", "data", "applied", "success", "error"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "height", "width", "data", "actions").mapInPandas(fold, f"image_id {kind}, height int, width int, data binary, applied array<string>, success boolean, error string")
