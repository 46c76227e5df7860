"""Filters over image planes in NumPy: smoothing, rank filters, morphology, labels, resampling.

Borders: smoothing repeats the edge value (``nearest``) or mirrors it
(``reflect``); rank filters mirror; masks end outside the plane.
"""

from __future__ import annotations

import ctypes
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def keep_memory() -> None:
    """Let this process keep freed memory for its next planes, where the C library can; else each new plane is paged in anew."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    for what, size in ((-3, 32 << 20), (-1, 64 << 20)):  # from which size memory is mapped by itself, and how much may stay free
        mallopt(what, size)


def _along(plane: np.ndarray, axis: int, before: int, after: int, mode: str) -> np.ndarray:
    n = plane.shape[axis]
    if mode == "reflect" and max(before, after) > n:
        return _wide(plane, axis, before, after)
    at = lambda a, b, step=1: (slice(None),) * axis + (slice(a, b, step),)
    out = np.empty([m + (before + after) * (k == axis) for k, m in enumerate(plane.shape)], plane.dtype)
    out[at(before, before + n)] = plane
    if before:
        out[at(0, before)] = plane[at(0, 1)] if mode == "nearest" else plane[at(0, before)][at(None, None, -1)]
    if after:
        out[at(before + n, None)] = plane[at(n - 1, n)] if mode == "nearest" else plane[at(n - after, n)][at(None, None, -1)]
    return out


@lru_cache(maxsize=64)
def _weights(sigma: float, order: int = 0) -> np.ndarray:
    reach = int(4.0 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    return w if order == 0 else -x / sigma**2 * w


#: Rows of a band matrix that are taken at once.
BAND = 64


@lru_cache(maxsize=64)
def _matrix(n: int, sigma: float, order: int, mode: str) -> np.ndarray:
    """A short side's smoothing, borders included, as one matrix."""
    w = _weights(sigma, order)[:: -1 if order else 1]
    reach = len(w) // 2
    at = np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None, :]
    if mode == "nearest":
        at = np.clip(at, 0, n - 1)
    else:
        at = at % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), len(w)), at.ravel()), np.tile(w, n))
    return out


def _filtered(plane: np.ndarray, sigma: float, order: int, axis: int, mode: str) -> np.ndarray:
    """One pass along an axis, summed in double precision so that an even plane keeps its exact level.

    Few weights are summed in pairs, as both sides have the same; many over a
    short side are one matrix.
    """
    n = plane.shape[axis]
    weights = _weights(sigma, order)[:: -1 if order else 1]
    reach = len(weights) // 2
    if n <= 512 and reach * 16 > n or reach > n:
        m = _matrix(n, float(sigma), order, mode)
        wide = plane.astype(np.float64)
        out = np.empty(plane.shape, np.float32)
        for a in range(0, n, BAND):  # the matrix is a band, but for mirrored borders, which are within reach too
            near, rows = slice(max(0, a - reach), a + BAND + reach), slice(a, a + BAND)
            if axis == 0:
                out[rows] = m[rows, near] @ wide[near]
            else:
                out[:, rows] = wide[:, near] @ m[rows, near].T
        return out
    wide = _along(plane.astype(np.float64), axis, reach, reach, mode)
    at = lambda i: wide[(slice(None),) * axis + (slice(i, i + n),)]
    out = at(reach) * weights[reach]
    pair = np.empty_like(out)
    for i in range(reach):
        (np.subtract if order else np.add)(at(2 * reach - i), at(i), out=pair)
        pair *= weights[2 * reach - i]
        out += pair
    return out.astype(np.float32)


def smooth(plane: np.ndarray, sigma: float, mode: str = "nearest") -> np.ndarray:
    """Gaussian smoothing, cut at four sigmas."""
    return _filtered(_filtered(plane.astype(np.float32), sigma, 0, 0, mode), sigma, 0, 1, mode)


def steepness(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Magnitude of the Gaussian gradient, mirrored at the borders."""
    plane = plane.astype(np.float32)
    dy = _filtered(_filtered(plane, sigma, 1, 0, "reflect"), sigma, 0, 1, "reflect")
    dx = _filtered(_filtered(plane, sigma, 0, 0, "reflect"), sigma, 1, 1, "reflect")
    return np.hypot(dy, dx)


def extreme(plane: np.ndarray, size: int, axis: int, highest: bool) -> np.ndarray:
    """Highest or lowest value in a window along an axis, the window doubled until it has its size."""
    if size <= 1:
        return plane
    before = size // 2
    op = np.maximum if highest else np.minimum
    after = size - 1 - before
    out = _along(plane, axis, before, after, "reflect")

    def joined(step: int) -> np.ndarray:
        low, high = [slice(None)] * out.ndim, [slice(None)] * out.ndim
        low[axis], high[axis] = slice(0, out.shape[axis] - step), slice(step, None)
        return op(out[tuple(low)], out[tuple(high)])

    span = 1
    while span * 2 <= size:
        out, span = joined(span), span * 2
    return joined(size - span) if size > span else out


def _wide(plane: np.ndarray, axis: int, before: int, after: int) -> np.ndarray:
    n = plane.shape[axis]
    at = np.arange(-before, n + after) % (2 * n)
    return np.take(plane, np.where(at < n, at, 2 * n - 1 - at), axis=axis)


def closing(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Grey closing: dark objects narrower than the window vanish."""
    up = extreme(extreme(plane, height, 0, True), width, 1, True)
    return extreme(extreme(up, height, 0, False), width, 1, False)


def opening(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Grey opening: bright objects narrower than the window vanish."""
    down = extreme(extreme(plane, height, 0, False), width, 1, False)
    return extreme(extreme(down, height, 0, True), width, 1, True)


def box_mean(plane: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, mirrored at the borders."""
    out = plane.astype(np.float64)
    for axis in (0, 1):
        before = size // 2
        wide = np.moveaxis(_wide(out, axis, before, size - 1 - before), axis, 0)
        sums = np.concatenate([np.zeros((1, *wide.shape[1:])), np.cumsum(wide, axis=0)])
        out = np.moveaxis((sums[size:] - sums[:-size]) / size, 0, axis)
    return out.astype(np.float32)


CROSS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
SQUARE = np.ones((3, 3), bool)


def disk(radius: int) -> np.ndarray:
    """A disk-shaped neighbourhood."""
    span = np.arange(-radius, radius + 1)
    return span[:, None] ** 2 + span[None, :] ** 2 <= radius**2


def _neighbours(mask: np.ndarray, shape: np.ndarray, times: int, op: np.ufunc) -> np.ndarray:
    """A mask joined with itself at each place of a neighbourhood; outside the plane nothing is set."""
    (h, w), (ry, rx) = mask.shape, (n // 2 for n in shape.shape)
    places = list(zip(*np.nonzero(shape)))
    for _ in range(times):
        if not mask.any():  # nothing grows or shrinks
            return mask.copy()
        wide = np.zeros((h + 2 * ry, w + 2 * rx), bool)
        wide[ry : ry + h, rx : rx + w] = mask
        mask = np.full((h, w), op is np.logical_and)
        for y, x in places:
            op(mask, wide[y : y + h, x : x + w], out=mask)
    return mask


def dilate(mask: np.ndarray, shape: np.ndarray = CROSS, times: int = 1) -> np.ndarray:
    """The mask grown by a neighbourhood."""
    return _neighbours(mask, shape[::-1, ::-1], times, np.logical_or)


def erode(mask: np.ndarray, shape: np.ndarray = CROSS, times: int = 1) -> np.ndarray:
    """The mask shrunk by a neighbourhood; what lies outside the plane counts as not set."""
    return _neighbours(mask, shape, times, np.logical_and)


def opened(mask: np.ndarray, shape: np.ndarray = CROSS, times: int = 1) -> np.ndarray:
    return dilate(erode(mask, shape, times), shape, times)


def closed(mask: np.ndarray, shape: np.ndarray = SQUARE, times: int = 1) -> np.ndarray:
    return erode(dilate(mask, shape, times), shape, times)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, starts and stops of the runs of set pixels, the number of each one's 8-connected part, and how many parts there are.

    Runs of set pixels are joined with the runs they touch in the row above;
    the joins are resolved for all runs at once, by hooking each root to the
    least one it meets and halving the paths.
    """
    h, w = mask.shape
    wide = np.zeros((h, w + 2), bool)
    wide[:, 1:-1] = mask
    row, ends = np.divmod(np.flatnonzero(wide[:, 1:] != wide[:, :-1]), w + 1)
    row, start, stop = row[::2], ends[::2], ends[1::2]
    n = len(row)
    key = row * (w + 2)
    first = np.searchsorted(key + stop, key - (w + 2) + start, "left")
    count = np.maximum(np.searchsorted(key + start, key - (w + 2) + stop, "right") - first, 0)
    below = np.repeat(np.arange(n), count)
    above = np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(n)
    while True:
        x, y = root[below], root[above]
        apart = x != y
        if not apart.any():
            break
        below, above = below[apart], above[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    roots, number = np.unique(root, return_inverse=True)
    return row, start, stop, number, len(roots)


def _marked(shape: tuple[int, int], row: np.ndarray, start: np.ndarray, stop: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A plane with each run's number plus one."""
    h, w = shape
    out = np.zeros(h * w + 1, np.int32)
    np.add.at(out, row * w + start, number + 1)
    np.subtract.at(out, row * w + stop, number + 1)
    return np.cumsum(out[:-1], dtype=np.int32).reshape(h, w)


def labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the 8-connected parts, in the order of their first pixels."""
    *runs, n = _runs(mask)
    return _marked(mask.shape, *runs), n


@dataclass(frozen=True)
class Parts:
    """The 8-connected parts of a mask: one plane of numbers, and each part's area and bounding box (ends included)."""

    marks: np.ndarray
    area: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def __len__(self) -> int:
        return len(self.area)

    @property
    def height(self) -> np.ndarray:
        return self.bottom - self.top + 1

    @property
    def width(self) -> np.ndarray:
        return self.right - self.left + 1

    def painted(self, chosen: np.ndarray) -> np.ndarray:
        """The mask of the chosen parts."""
        if not np.any(chosen):
            return np.zeros(self.marks.shape, bool)
        return np.append(False, chosen)[self.marks]


def parts(mask: np.ndarray) -> Parts:
    """All parts of a mask, measured by their runs; memory grows with the plane, not with the number of parts."""
    row, start, stop, number, n = _runs(mask)
    top, left, bottom, right = np.full(n, mask.shape[0]), np.full(n, mask.shape[1]), np.zeros(n, int), np.zeros(n, int)
    for op, to, at in ((np.minimum, top, row), (np.maximum, bottom, row), (np.minimum, left, start), (np.maximum, right, stop - 1)):
        op.at(to, number, at)
    return Parts(_marked(mask.shape, row, start, stop, number), np.bincount(number, stop - start, n).astype(int), top, bottom, left, right)


def nearest_up(plane: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Nearest sampling to a larger plane."""
    ys = (np.arange(shape[0]) + 0.5) * plane.shape[0] / shape[0]
    xs = (np.arange(shape[1]) + 0.5) * plane.shape[1] / shape[1]
    return plane[ys.astype(int)][:, xs.astype(int)]


#: Resampling kernels and their reach.
KERNELS = {
    "box": (lambda x: ((x > -0.5) & (x <= 0.5)).astype(float), 0.5),
    "bilinear": (lambda x: np.clip(1 - np.abs(x), 0, None), 1.0),
    "bicubic": (lambda x: np.where(np.abs(x) < 1, (1.5 * np.abs(x) - 2.5) * x * x + 1, np.where(np.abs(x) < 2, -0.5 * (((np.abs(x) - 5) * np.abs(x) + 8) * np.abs(x) - 4), 0)), 2.0),
    "lanczos": (lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0), 3.0),
}
#: Bits behind the point of the kernels' whole-number weights.
BITS = 22


@lru_cache(maxsize=32)
def _taps(n: int, size: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """For each output sample the first input sample it takes and its weights, as whole numbers."""
    weight, reach = KERNELS[kernel]
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    first = np.maximum((centre - reach * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + reach * wide + 0.5).astype(int), n)
    at = first[:, None] + np.arange((last - first).max())
    w = np.where(at < last[:, None], weight((at - centre[:, None] + 0.5) / wide), 0)
    w /= w.sum(axis=1, keepdims=True)
    return first, np.where(w < 0, np.ceil(w * 2**BITS - 0.5), np.floor(w * 2**BITS + 0.5)).astype(np.int64)


def resample(plane: np.ndarray, shape: tuple[int, int], kernel: str) -> np.ndarray:
    """An 8-bit plane at another size: a kernel as wide as the reduction, along rows and then along columns, in whole numbers."""
    out = np.ascontiguousarray(plane, np.uint8)
    for axis in (1, 0):
        n, size = out.shape[axis], shape[axis]
        if n == size:
            continue
        first, weights = _taps(n, size, kernel)
        total = np.full([size if k == axis else m for k, m in enumerate(out.shape)], 1 << (BITS - 1), np.int64)
        for k in range(weights.shape[1]):
            w = weights[:, k] if axis else weights[:, k, None]
            total += np.take(out, np.minimum(first + k, n - 1), axis) * w
        out = np.clip(total >> BITS, 0, 255).astype(np.uint8)
    return out


def resampled(rgb: np.ndarray, shape: tuple[int, int], kernel: str) -> np.ndarray:
    """The same for each channel."""
    return np.stack([resample(rgb[..., c], shape, kernel) for c in range(rgb.shape[2])], axis=2)


def shrunk(rgb: np.ndarray, factor: int) -> np.ndarray:
    """Rounded means of square blocks of an image; the last blocks may be incomplete."""
    h, w = rgb.shape[:2]
    ys, xs = np.arange(0, h, factor), np.arange(0, w, factor)
    sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.int64), ys, axis=0), xs, axis=1)
    size = np.diff(np.append(ys, h))[:, None, None] * np.diff(np.append(xs, w))[None, :, None]
    return ((sums + size // 2) // size).astype(np.uint8)


def thumbnail(rgb: np.ndarray, edge: int) -> np.ndarray:
    """An image that fits a square: block means down to twice its size, then the bicubic kernel; a small one stays as it is."""
    h, w = rgb.shape[:2]
    if max(h, w) <= edge:
        return rgb
    short = min(h, w) * edge / max(h, w)
    near = max(1, min((math.floor(short), math.ceil(short)), key=lambda n: abs(min(h, w) / max(h, w) - n / edge)))
    shape = (edge, near) if h >= w else (near, edge)
    factors = [int(n / m / 2) or 1 for n, m in zip((h, w), shape)]
    return resampled(shrunk(rgb, min(factors)) if min(factors) > 1 else rgb, shape, "bicubic")
