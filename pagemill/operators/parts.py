"""What a page's pixels hold as shapes: parts (connected ink), edges and straight lines, and the measures made of them.

One gray page at a time, in NumPy: parts are found by their runs, so work follows the ink, and filters go over a page in
strips, so memory stays a small multiple of the page. Outlines, edges and lines follow the usual definitions (outer
boundary by pixel centres, Sobel edges with hysteresis, normal form of lines with one pixel and one degree), without an
image library; equal votes come in order of distance, then angle.
"""

from __future__ import annotations

import math

import numpy as np

STRIP = 256
#: Parts, and lines, that count for the orientation of a page.
MOST_PARTS, MOST_LINES = 100, 200
MEASURES = {
    "contrast": "double", "brightness": "double", "sharpness": "double", "noise": "double", "columns": "int", "aspect": "double", "text_angle": "double", "edge_angle": "double",
    "skew": "double", "skew_confidence": "double", "handwriting": "double", "contours": "int", "area_mean": "double", "area_std": "double", "laplacian": "double", "deviation": "double",
}
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def strips(img: np.ndarray, pad: int, mode: str = "edge"):
    """(first row, last row, those rows with pad more pixels to all sides), for all rows."""
    wide = np.pad(img, pad, mode=mode if min(img.shape) > pad or mode == "edge" else "edge")
    for lo in range(0, img.shape[0], STRIP):
        hi = min(img.shape[0], lo + STRIP)
        yield lo, hi, wide[lo : hi + 2 * pad]


def medians(img: np.ndarray, size: int) -> np.ndarray:
    """Median of the size by size neighbours; edges are repeated."""
    out = np.empty_like(img)
    for lo, hi, rows in strips(img, size // 2):
        view = np.lib.stride_tricks.sliding_window_view(rows, (size, size)).reshape(hi - lo, img.shape[1], -1)
        out[lo:hi] = np.partition(view, size * size // 2, axis=2)[:, :, size * size // 2]
    return out


def weighted(img: np.ndarray, k: np.ndarray, mode: str = "edge") -> np.ndarray:
    """Sums of neighbours in rows, then columns, by weights k (an odd number of them)."""
    pad = len(k) // 2
    out = np.empty(img.shape)
    for lo, hi, rows in strips(img, pad, mode):
        across = sum(w * rows[:, i : i + img.shape[1]].astype(float) for i, w in enumerate(k))
        out[lo:hi] = sum(w * across[i : i + hi - lo] for i, w in enumerate(k))
    return out


def gauss(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


def below_mean(img: np.ndarray, size: int, offset: float) -> np.ndarray:
    """Pixels darker than the Gaussian mean around them less offset."""
    return img <= weighted(img, gauss(size)) - offset


def labelled(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ink (row, first column, end) and the number of each one's part; pixels that touch at corners are one part."""
    h, w = ink.shape
    steps = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    runs = np.stack([*np.nonzero(steps == 1), np.nonzero(steps == -1)[1]], axis=1)
    root = np.arange(len(runs))
    first = np.searchsorted(runs[:, 0], np.arange(h + 1))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        i_end, j_end = j, int(first[y + 1])
        while i < i_end and j < j_end:
            if runs[i, 2] >= runs[j, 1] and runs[j, 2] >= runs[i, 1]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
            if runs[i, 2] < runs[j, 2]:
                i += 1
            else:
                j += 1
    return runs, np.unique([find(i) for i in range(len(runs))], return_inverse=True)[1] if len(runs) else root


def outline(ink: np.ndarray, y: int, x: int) -> list[tuple[int, int]]:
    """The outer boundary of the part whose first pixel, row by row, is (y, x): pixels in clockwise order."""
    h, w = ink.shape
    out, at, back = [(y, x)], (y, x), 4
    start = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            ny, nx = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
            if 0 <= ny < h and 0 <= nx < w and ink[ny, nx]:
                break
        else:
            return out
        if start is None:
            start = d
        elif at == (y, x) and d == start:
            return out[:-1]
        at, back = (ny, nx), (d + 4) % 8
        out.append(at)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, float)
    sides = []
    for q in (p, p[::-1]):
        side: list = []
        for c in q:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (c[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (c[0] - side[-2][0]):
                side.pop()
            side.append(c)
        sides += side[:-1]
    return np.array(sides, float)


def smallest_box_angle(points: np.ndarray) -> float:
    """Angle in degrees, from 0 to 90, of the rectangle of least area around points (x, y); the first corner's on a tie."""
    c = hull(points)
    if len(c) < 3:
        dx, dy = (c[-1] - c[0]) if len(c) > 1 else (1.0, 0.0)
        return float(np.degrees(math.atan2(dy, dx)) % 90) or 90.0
    edges = np.roll(c, -1, axis=0) - c
    angles = np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2)
    u, v = np.stack([np.cos(angles), np.sin(angles)]), np.stack([-np.sin(angles), np.cos(angles)])
    area = np.ptp(c @ u, axis=0) * np.ptp(c @ v, axis=0)
    return float(np.degrees(angles[np.argmin(np.round(area, 6))])) or 90.0


def parts(ink: np.ndarray) -> list[dict]:
    """Each part's area (of the polygon through its boundary pixels' centres), perimeter, sides w and h, and boundary, in
    the order of their last rows from the bottom up, as outer outlines are listed."""
    runs, part = labelled(ink)
    out = []
    if not len(runs):
        return out
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.diff(part[order], prepend=-1))
    for at in np.split(order, heads[1:]):
        own = runs[at]
        y0, y1, x0, x1 = own[:, 0].min(), own[:, 0].max() + 1, own[:, 1].min(), own[:, 2].max()
        box = np.zeros((y1 - y0, x1 - x0), bool)
        for y, a, b in (own - [y0, x0, x0]).tolist():
            box[y, a:b] = True
        edge = np.array(outline(box, 0, int(own[own[:, 0] == y0, 1].min() - x0)))
        step = np.roll(edge, -1, axis=0) - edge
        x, y = edge[:, 1].astype(float), edge[:, 0].astype(float)
        area = abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2
        out.append({"area": area, "perimeter": float(np.hypot(step[:, 0], step[:, 1]).sum()), "w": int(x1 - x0), "h": int(y1 - y0), "edge": edge[:, ::-1] + [x0, y0], "box": (int(x0), int(y0), int(x1), int(y1))})
    return sorted(out, key=lambda p: (-p["box"][1], -p["box"][0]))


def edges(img: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: gradients (Sobel, sum of both directions' lengths) that are the largest across the edge and over high,
    or over low and joined to such."""
    if min(img.shape) < 3:
        return np.zeros(img.shape, bool)
    g = np.pad(img.astype(np.int32), 1, mode="edge")
    dx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    dy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    ax, ay, same = np.abs(dx), np.abs(dy), (dx >= 0) == (dy >= 0)
    flat, steep = ay < 0.41421356 * ax, ay > 2.41421356 * ax
    h, w = img.shape
    near = lambda y, x: m[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    before = np.where(flat, near(0, -1), np.where(steep, near(-1, 0), np.where(same, near(-1, -1), near(-1, 1))))
    after = np.where(flat, near(0, 1), np.where(steep, near(1, 0), np.where(same, near(1, 1), near(1, -1))))
    ridge = (size > before) & (size >= after) & (size > low)
    runs, part = labelled(ridge)
    if not len(runs):
        return ridge
    strong = np.zeros(part.max() + 1, bool)
    sure = np.cumsum(np.pad(ridge & (size > high), ((0, 0), (1, 0))), axis=1)
    np.logical_or.at(strong, part, sure[runs[:, 0], runs[:, 2]] > sure[runs[:, 0], runs[:, 1]])
    out = np.zeros(img.shape, bool)
    for y, a, b in runs[strong[part]].tolist():
        out[y, a:b] = True
    return out


def grown(ink: np.ndarray, ys: range, xs: range) -> np.ndarray:
    """Pixels with ink at one of the offsets."""
    out = np.zeros_like(ink)
    h, w = ink.shape
    for dy in ys:
        for dx in xs:
            out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] |= ink[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def straight_lines(ink: np.ndarray, least: int) -> list[tuple[float, float]]:
    """(rho, degrees from 0) of lines with more than least pixels that are local maxima, most pixels first."""
    h, w = ink.shape
    ys, xs = np.nonzero(ink)
    reach = h + w
    votes = np.zeros((182, 2 * reach + 3), np.int32)
    for t in range(180):
        r = np.rint(xs * math.cos(math.radians(t)) + ys * math.sin(math.radians(t))).astype(np.int64) + reach + 1
        votes[t + 1] = np.bincount(r, minlength=2 * reach + 3)
    v = votes[1:-1, 1:-1]
    peak = (v > least) & (v > votes[1:-1, :-2]) & (v >= votes[1:-1, 2:]) & (v > votes[:-2, 1:-1]) & (v >= votes[2:, 1:-1])
    t, r = np.nonzero(peak)
    order = np.lexsort((r, t, -v[t, r]))
    return [(float(r[i] - reach), float(t[i])) for i in order]


def text_angle(img: np.ndarray) -> float:
    """Area-weighted mean of the angles, within 45 degrees, of the first parts of usable size; 0 without one."""
    some = [p for p in parts(below_mean(img, 11, 2)) if 50 < p["area"] < 20000 and 0.1 < p["w"] / p["h"] < 10][:MOST_PARTS]
    if not some:
        return 0.0
    angles = np.array([smallest_box_angle(p["edge"]) for p in some])
    return float(np.average(np.where(angles > 45, angles - 90, angles), weights=[p["area"] for p in some]))


def edge_angle(img: np.ndarray) -> float:
    """Centre of the fullest of 36 bins of the lines' angles, each counted by its distance; 0 without a vote."""
    ink = edges(img)
    closed = ~grown(~grown(ink, range(-1, 2), range(-1, 2)), range(-1, 2), range(-1, 2)) | ink
    found = straight_lines(closed, max(50, min(img.shape) // 4))[:MOST_LINES]
    bins = np.zeros(36, np.int64)
    for rho, deg in found:
        angle = deg - 180 if deg > 90 else deg
        bins[min(int((angle + 90) // 5), 35)] += int(abs(rho) / max(img.shape) * 10)
    return float(np.argmax(bins) * 5 - 87.5) if bins.sum() else 0.0


def skew_angle(img: np.ndarray) -> tuple[float, float]:
    """Median angle of near-horizontal lines, and how sure it is; 0, 0 without such a line."""
    smooth = np.rint(weighted(img, np.array([0.25, 0.5, 0.25]), "reflect"))
    ink = grown(below_mean(smooth, 15, 5), range(-1, 1), range(-1, 1))
    angles = np.array([d - 90 for _, d in straight_lines(edges(ink.astype(np.uint8) * 255), 100) if abs(d - 90) < 45])
    if not len(angles):
        return 0.0, 0.0
    mid = float(np.median(angles))
    return mid, min(1.0, max(0.0, min(1.0, 1 - float(angles.std()) / 10)) + (0.1 if abs(mid) > 1 else 0.0))


def handwriting(found: list[dict]) -> float:
    some = [p for p in found if 20 < p["area"] < 5000 and p["perimeter"] > 0]
    if not some:
        return 0.0
    irregular = np.mean([1 - 4 * np.pi * p["area"] / p["perimeter"] ** 2 for p in some])
    varied = np.mean([min(p["w"] / p["h"], p["h"] / p["w"]) for p in some])
    return float(min(max(0.7 * irregular + 0.3 * (1 - varied), 0.0), 1.0))


def page_measures(data: bytes, height: int, width: int) -> tuple:
    """The values of MEASURES for one page of gray bytes."""
    from .kernels import threshold

    g = np.frombuffer(data, np.uint8).reshape(height, width)
    n, mean = g.size, float(g.mean())
    bright = mean / 120 if mean < 120 else max(0.0, 1 - (mean - 200) / 55) if mean > 200 else 1.0
    total, square, far = 0, 0, 0
    for lo, hi, rows in strips(g, 1, "reflect"):
        r = rows.astype(np.int64)
        lap = r[:-2, 1:-1] + r[2:, 1:-1] + r[1:-1, :-2] + r[1:-1, 2:] - 4 * r[1:-1, 1:-1]
        total, square = total + int(lap.sum()), square + int((lap * lap).sum())
    laplacian = (n * square - total * total) / (n * n)
    for lo in range(0, height, STRIP):  # of 5 by 5 neighbours, in strips with their neighbours' rows
        top, end = max(0, lo - 2), min(height, lo + STRIP + 2)
        mid = medians(g[top:end], 5)[lo - top : lo - top + min(STRIP, height - lo)]
        far += int(np.abs(g[lo : lo + STRIP].astype(np.int64) - mid).sum())
    ink = (g < 128).sum(axis=0)
    k = max(5, min(20, width // 50))
    smooth = np.convolve(ink, np.ones(k) / k)[(k - 1) // 2 :][:width]
    runs = np.split(smooth, np.flatnonzero(smooth < 0.3 * smooth.mean()))
    columns = sum((len(x) if i == 0 else len(x) - 1) > width // 10 for i, x in enumerate(runs))
    found = parts(g <= threshold(g)) if g.min() < g.max() else []
    areas = np.array([p["area"] for p in found if p["area"] > 100])
    skew, sure = skew_angle(g)
    deviation = float(g.std())
    return (
        min(deviation / 80, 1.0), bright, min(laplacian / 1000, 1.0), min(far / n / 20, 1.0), max(1, int(columns)), width / height, text_angle(g), edge_angle(g),
        skew, sure, handwriting(found), len(found), float(areas.mean()) if len(areas) else None, float(areas.std()) if len(areas) else None, laplacian, deviation,
    )
