"""Outlines, quadrangles and lines of grey images: perspective (P17) and rotation by the dominant line (P18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from parchmint.functions import kernels as k
from parchmint.functions.kernels import Image

#: Steps to the eight neighbours (y, x), clockwise from the right.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def components(mask: np.ndarray, diagonal: bool = True) -> Iterator[tuple[int, int, np.ndarray]]:
    """(y, x, mask) of each connected part, cut to its box; largest boxes first."""
    h, w = mask.shape
    n = int(mask.sum())
    if not n:
        return
    at = np.full((h + 1, w + 2), -1)
    at[:h, 1 : w + 1][mask] = np.arange(n)
    here = at[:h, 1 : w + 1]
    near = [at[:h, 2:], at[1:, 1 : w + 1], *([at[1:, 2:], at[1:, :w]] if diagonal else [])]
    pairs = np.concatenate([np.stack([here, x])[:, (here >= 0) & (x >= 0)] for x in near], axis=1)
    label = np.arange(n)
    while (label[pairs[0]] != label[pairs[1]]).any():
        a, b = label[pairs[0]], label[pairs[1]]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    ys, xs = np.nonzero(mask)
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    boxes = [(ys[p].min(), xs[p].min(), ys[p].max() + 1, xs[p].max() + 1) for p in parts]
    for i in sorted(range(len(parts)), key=lambda i: -(boxes[i][2] - boxes[i][0]) * (boxes[i][3] - boxes[i][1])):
        y0, x0, y1, x1 = boxes[i]
        part = np.zeros((y1 - y0, x1 - x0), dtype=bool)
        part[ys[parts[i]] - y0, xs[parts[i]] - x0] = True
        yield int(y0), int(x0), part


def outline(part: np.ndarray) -> np.ndarray:
    """The outer border of one connected part as points (x, y), clockwise."""
    m = np.pad(part, 1).tolist()
    start = (1, m[1].index(True))
    at, look, first, out = start, 5, None, []
    while True:
        for i in range(8):
            d = (look + i) % 8
            if m[at[0] + AROUND[d][0]][at[1] + AROUND[d][1]]:
                break
        else:
            return np.array([[start[1] - 1, start[0] - 1]])
        if at == start and d == first:
            return np.array(out)
        first = d if first is None else first
        out.append((at[1] - 1, at[0] - 1))
        at, look = (at[0] + AROUND[d][0], at[1] + AROUND[d][1]), (d + (6 if d % 2 else 7)) % 8


def area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(np.float64), points[:, 1].astype(np.float64)
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def largest(mask: np.ndarray, most: int, holes: bool) -> list[np.ndarray]:
    """The outlines of the largest areas, of holes as well if asked."""
    h, w = mask.shape
    found: list[tuple[float, np.ndarray]] = []
    for of, inner in ((mask, False), *([(~mask, True)] if holes else [])):
        for y, x, part in components(of, not inner):
            if inner and (y == 0 or x == 0 or y + part.shape[0] == h or x + part.shape[1] == w):
                continue
            # A part's area is less than its box's, and boxes fall.
            if len(found) >= most and found[most - 1][0] >= part.size:
                break
            points = outline(part) + (x, y)
            found = sorted([*found, (area(points), points)], key=lambda f: -f[0])[:most]
    return [points for _, points in found]


def _off(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points from the line through a and b, or from a if they are one."""
    d, v = (b - a).astype(np.float64), (points - a).astype(np.float64)
    n = np.hypot(*d)
    return np.abs(v[:, 0] * d[1] - v[:, 1] * d[0]) / n if n else np.hypot(v[:, 0], v[:, 1])


def corners(points: np.ndarray, share: float = 0.02) -> np.ndarray:
    """A closed outline by Douglas and Peucker, within this share of its length."""
    eps = share * float(np.hypot(*(points - np.roll(points, -1, axis=0)).T).sum())
    far = lambda i: int(np.argmax(np.hypot(*(points - points[i]).T)))
    first = far(far(0))
    p = np.roll(points, -first, axis=0)
    other = int(np.argmax(np.hypot(*(p - p[0]).T)))
    p = np.vstack([p, p[:1]])
    keep, todo = {0, other}, [(0, other), (other, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            off = _off(p[a + 1 : b], p[a], p[b])
            if off.max() > eps:
                c = a + 1 + int(np.argmax(off))
                keep.add(c)
                todo += [(a, c), (c, b)]
    out = p[sorted(keep)]
    i = 0
    while len(out) > 3 and i < len(out):
        if _off(out[i : i + 1], out[i - 1], out[(i + 1) % len(out)])[0] <= eps * 0.5**0.5:
            out = np.delete(out, i, axis=0)
        else:
            i += 1
    return out


def ordered(quad: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: as operators.images.ordered_points."""
    by_x = quad[np.lexsort((quad[:, 1], quad[:, 0]))]
    left, right = by_x[:2], by_x[2:]
    tl, bl = left[np.argsort(left[:, 1], kind="stable")]
    tr, br = right[np.argsort(np.hypot(*(right - tl).T), kind="stable")]
    return np.array([tl, tr, br, bl])


def sign_corrected(image: Image) -> Image | None:
    """The largest outline, if it is a quadrangle of a fifth of the image at least, as a rectangle."""
    for points in largest(k.edges(image, 50, 150) > 0, 1, False):
        if area(points) >= 0.2 * image.size and len(quad := corners(points)) == 4:
            return k.warped(image, ordered(quad))
    return None


def page_corrected(image: Image) -> Image | None:
    """The first quadrangle of the five largest outlines whose rectangle has over 100 pixels a side."""
    for points in largest(k.edges(k.levels(k.gauss(image, 5)), 75, 200) > 0, 5, True):
        if len(quad := corners(points)) == 4:
            out = k.warped(image, ordered(quad))
            if min(out.shape) > 100:
                return out
    return None


def segments(mask: np.ndarray, votes: int, least: float, gap: float) -> list[tuple[float, float, float, float]]:
    """Straight lines (x1, y1, x2, y2) of set pixels by Hough votes, the most voted first; lines take their pixels."""
    ys, xs = np.nonzero(mask)
    t = np.deg2rad(np.arange(180))
    reach = int(np.hypot(*mask.shape)) + 1
    rho = lambda i, x, y: np.rint(x * np.cos(t[i]) + y * np.sin(t[i])).astype(int) + reach
    count = lambda x, y: np.stack([np.bincount(rho(i, x, y), minlength=2 * reach + 1) for i in range(180)])
    if len(xs) < votes:
        return []
    acc, out = count(xs, ys), []
    while acc.max() >= votes:
        i, r = np.unravel_index(int(np.argmax(acc)), acc.shape)
        on = rho(i, xs, ys) == r
        x, y = xs[on], ys[on]
        along = y * np.cos(t[i]) - x * np.sin(t[i])
        order = np.argsort(along, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(along[order]) > gap) + 1):
            a, b = run[0], run[-1]
            if max(abs(x[b] - x[a]), abs(y[b] - y[a])) >= least:
                out.append((float(x[a]), float(y[a]), float(x[b]), float(y[b])))
        acc -= count(x, y)
        xs, ys = xs[~on], ys[~on]
    return out


def turn(image: Image) -> float:
    """Degrees of the most frequent line angle, in steps of 2, from the nearer of horizontal and vertical."""
    bins: dict[int, int] = {}
    for x1, y1, x2, y2 in segments(k.edges(image, 50, 150) > 0, 100, image.shape[1] / 4, 20):
        if x1 != x2:
            angle = round(np.rad2deg(np.arctan2(y2 - y1, x2 - x1)) % 180 / 2) * 2 % 180
            bins[angle] = bins.get(angle, 0) + 1
    if not bins:
        return 0.0
    main = max(bins, key=lambda a: bins[a])
    # Beyond 135 the way back to horizontal is the short one; the angle itself would turn the page over.
    return float(main - 90 if 45 <= main <= 135 else main - 180 if main > 135 else main)


def auto_rotated(image: Image) -> Image:
    angle = turn(image)
    return k.rotated(image, angle) if abs(angle) >= 1 else image
