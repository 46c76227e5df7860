"""Cleaning of page images: illumination, folds, bands, corners, specks, output modes.

One page at a time in NumPy, inside Arrow batches of few rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pageloom.functions import planes as P

LUMA = (0.299, 0.587, 0.114)
MODES = ("gray", "color", "binary", "document")


@dataclass(frozen=True)
class Settings:
    """Limits of the cleaning; the values are defaults that a run may replace."""

    enabled: bool = True
    max_edge: int = 2600
    output: str = "auto"
    background_edge: int = 900
    background_sigma: float = 6.0
    gradient_edge: int = 0
    sheet_edge: int = 800
    paper: float = 247.0
    paper_chroma: float = 16.0
    wash_bright: float = 210.0
    wash_chroma: float = 60.0
    wash_grad: float = 14.0
    wash_dilate: int = 2
    wash_neutral: float = 14.0
    fold_dev: float = 10.0
    fold_sigma: float = 32.0
    fold_erode: int = 2
    fold_ink: float = 150.0
    corners: bool = True
    corner_margin: float = 0.075
    corner_area: tuple[float, float] = (0.002, 0.22)
    corner_dev: float = 18.0
    corner_grad: float = 9.0
    bands: bool = True
    band_length: float = 0.28
    band_dark: tuple[float, float] = (7.0, 42.0)
    band_luma_floor: float = 205.0
    band_grad: float = 8.0
    mark_area: int = 600
    mark_length: int = 320
    mark_width: int = 14
    mark_ratio: float = 12.0
    local_sigma: float = 7.0
    local_contrast: float = 8.0
    foreground: float = 225.0
    dark: float = 185.0
    edge_grad: float = 12.0
    white: float = 248.0
    remove_specks: bool = False


DEFAULTS = Settings()


def luma_of(rgb: np.ndarray) -> np.ndarray:
    """Brightness of an image."""
    r, g, b = (rgb[..., c].astype(np.float32) * np.float32(w) for c, w in enumerate(LUMA))
    return r + g + b


def chroma_of(rgb: np.ndarray) -> np.ndarray:
    """Spread of the channels."""
    return _highest(rgb) - np.minimum(np.minimum(rgb[..., 0], rgb[..., 1]), rgb[..., 2])


def _highest(rgb: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(rgb[..., 0], rgb[..., 1]), rgb[..., 2])


def flat(plane: np.ndarray, sigma: float, limit: float, s: Settings = DEFAULTS) -> np.ndarray:
    """Where the gradient is at most ``limit``; on large pages measured smaller, if settings say so."""
    factor = max(1, int(max(plane.shape) / s.gradient_edge)) if s.gradient_edge else 1
    if factor == 1:
        return P.steepness(plane, sigma) <= limit
    small = _boxed(plane, factor)
    return P.nearest_up(P.steepness(small, sigma / factor) <= limit / factor, plane.shape)


def _boxed(plane: np.ndarray, factor: int) -> np.ndarray:
    h, w = (max(1, n // factor) for n in plane.shape)
    return P.resample(np.clip(plane, 0, 255), (h, w), "box").astype(np.float32)


def _field(plane: np.ndarray, window, s: Settings) -> np.ndarray:
    """The paper's own level: ink closed away on a thinned plane, smoothed, and brought back to size."""
    step = max(1, int(max(plane.shape) / s.background_edge))
    thin = plane[::step, ::step].astype(np.float32)
    k = window(min(thin.shape))
    level = P.smooth(P.closing(thin, k, k), s.background_sigma)
    return P.resample(np.clip(level, 0, 255), plane.shape, "bilinear").astype(np.float32) + 1.0


def channel_backgrounds(rgb: np.ndarray, s: Settings = DEFAULTS) -> list[np.ndarray]:
    """The paper level of each channel."""
    return [_field(rgb[..., c], lambda n: max(3, min(41, (n // 48) | 1)), s) for c in range(3)]


def luma_background(luma: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """The paper level of the brightness."""
    return _field(luma, lambda n: max(9, (n // 28) | 1), s)


def flat_field(rgb: np.ndarray, backgrounds: list[np.ndarray]) -> np.ndarray:
    """Each channel divided by its paper level."""
    out = np.empty(rgb.shape, np.float32)
    for c, level in enumerate(backgrounds):
        out[..., c] = np.clip(rgb[..., c].astype(np.float32) / level * 255.0, 0, 255)
    return out


def _scaled(rgb: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each channel times a plane, within 0 to 255."""
    out = np.empty(rgb.shape, np.float32)
    for c in range(3):
        out[..., c] = np.clip(rgb[..., c] * by, 0, 255)
    return out


def whitened(luma: np.ndarray, background: np.ndarray, beta: float, s: Settings = DEFAULTS) -> np.ndarray:
    """Brightness against the paper, paper itself fully white."""
    out = 255.0 * np.clip(luma / background, 0, 1) ** beta
    return np.where(out >= s.paper, 255.0, out).astype(np.float32)


def washed(plane: np.ndarray, chroma: np.ndarray | None = None, s: Settings = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """Smooth bright patches lifted to paper; sharp content stays. Also where it was lifted."""
    level = luma_background(plane, s)
    lift = np.clip(max(float(np.percentile(level, 99)) + 2.0, s.paper) - level, 0, 255)
    edge = ~flat(plane, 1.2, s.wash_grad, s)
    if s.wash_dilate:
        edge = P.dilate(edge, times=s.wash_dilate)
    where = plane >= s.wash_bright
    where &= ~edge if chroma is None else (chroma < s.wash_chroma) & ~(edge & (chroma < s.wash_neutral))
    return np.clip(np.where(where, plane + lift, plane), 0, 255).astype(np.float32), where


def fold_zone(background: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """Wide zones where the paper leaves its own smooth sheet."""
    factor = max(1, int(max(background.shape) / s.sheet_edge)) if s.sheet_edge else 1
    if factor == 1 and float(background.max()) - float(background.min()) < s.fold_dev - 0.01:
        return np.zeros(background.shape, bool)  # a mean of levels lies between them
    if factor > 1:
        small = _boxed(background, factor)
        zone = P.nearest_up(np.abs(small - P.smooth(small, s.fold_sigma / factor)) * factor > s.fold_dev, background.shape)
    else:
        zone = np.abs(background - P.smooth(background, s.fold_sigma)) > s.fold_dev
    return P.opened(zone, times=s.fold_erode) if s.fold_erode else zone


def fold_ink(plane: np.ndarray, fold: np.ndarray, even: np.ndarray, chroma: np.ndarray | None = None, s: Settings = DEFAULTS) -> np.ndarray:
    """Smooth neutral half-tones within a fold: its shadow, not ink."""
    zone = fold & even & (plane >= s.fold_ink) & (plane < s.wash_bright)
    return zone if chroma is None else zone & (chroma < s.wash_chroma)


def corner_shadows(luma: np.ndarray, background: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """Smooth dark parts that touch a corner of the page."""
    h, w = luma.shape
    out = np.zeros((h, w), bool)
    if not s.corners or min(h, w) < 64:
        return out
    size = min(max(24, round(min(h, w) * s.corner_margin)), max(24, min(h, w) // 3))
    shadow = background - luma >= s.corner_dev
    corners = {(top, left): (slice(0, size) if top else slice(h - size, h), slice(0, size) if left else slice(w - size, w)) for top in (True, False) for left in (True, False)}
    if not any(shadow[at].any() for at in corners.values()):
        return out
    even = flat(luma, 1.2, s.corner_grad, s)
    shadow &= even
    for (top, left), at in corners.items():
        patch = shadow[at]
        own = P.parts(patch)
        at_edge = (own.top == 0 if top else own.bottom == size - 1) & (own.left == 0 if left else own.right == size - 1)
        share, filled = own.area / patch.size, own.area / (own.height * own.width)
        out[at] |= own.painted(at_edge & (share >= s.corner_area[0]) & (share <= s.corner_area[1]) & (filled >= 0.12) & (filled <= 0.92))
    return out & even


def band_streaks(luma: np.ndarray, background: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """Long shallow streaks across or down the page."""
    h, w = luma.shape
    if not s.bands or min(h, w) < 128:
        return np.zeros((h, w), bool)
    low, high = s.band_dark
    rest = np.clip(background - luma, 0, 255)
    band = (rest >= low) & (rest <= high) & (luma >= s.band_luma_floor)
    if not band.any():
        return band
    across, down = (min(max(31, round(n * s.band_length)), max(31, n)) for n in (w, h))
    response = np.maximum(P.opening(rest, 1, across), P.opening(rest, down, 1))
    band &= (response >= low) & (response <= high)
    return P.closed(band & flat(luma, 1.0, s.band_grad, s)) if band.any() else band


def tiny_specks(dark: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """Single dots far from other ink.

    By default nothing, as the plain rule asks for dots outside a halo that
    contains them; ``remove_specks`` takes the halo of what survives an opening.
    """
    if not s.remove_specks or not dark.any():
        return np.zeros_like(dark)
    core = P.opened(dark, P.disk(1))
    return dark & ~core & ~P.dilate(core, P.disk(2))


def stray_marks(dark: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """Very long thin straight parts: creases and scratches."""
    own = P.parts(dark)
    long, short = np.maximum(own.height, own.width), np.minimum(own.height, own.width)
    return own.painted((own.area >= s.mark_area) & (long >= s.mark_length) & (short <= s.mark_width) & (long / short >= s.mark_ratio))


def darker_than_paper(luma: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Clearly darker than the paper around."""
    return (luma < np.clip(background * 0.94, 0, 255)) & (background > 8)


def ink_mask(luma: np.ndarray, k: float = 0.25, radius: float = 128.0, window: int | None = None) -> np.ndarray:
    """Ink by a threshold that follows local mean and spread."""
    size = window or max(15, (min(luma.shape) // 16) | 1)
    mean = P.box_mean(luma, size)
    spread = np.sqrt(np.clip(P.box_mean(luma.astype(np.float32) ** 2, size) - mean * mean, 0, None))
    return luma < mean * (1.0 + k * (spread / radius - 1.0))


def without_holes(ink: np.ndarray) -> np.ndarray:
    """Ink with its small holes filled."""
    h, w = ink.shape
    own = P.parts(~ink)
    inside = (own.top > 0) & (own.left > 0) & (own.bottom < h - 1) & (own.right < w - 1)
    return ink | own.painted(inside & (own.area < max(8, int(0.00006 * ink.size))))


@dataclass
class Page:
    """A page's planes; each is computed when first asked for and then kept."""

    luma: np.ndarray
    s: Settings = field(default=DEFAULTS)

    @cached_property
    def background(self) -> np.ndarray:
        return luma_background(self.luma, self.s)

    @cached_property
    def artefacts(self) -> np.ndarray:
        """Corners and bands."""
        return corner_shadows(self.luma, self.background, self.s) | band_streaks(self.luma, self.background, self.s)

    @cached_property
    def dirt(self) -> np.ndarray:
        """Specks and scratches."""
        dark = darker_than_paper(self.luma, self.background)
        return tiny_specks(dark, self.s) | stray_marks(dark, self.s)

    @cached_property
    def fold(self) -> np.ndarray:
        return fold_zone(self.background, self.s)

    def gray(self, beta: float = 0.9) -> np.ndarray:
        out, _ = washed(whitened(self.luma, self.background, beta, self.s), s=self.s)
        shade = fold_ink(out, self.fold, flat(out, 1.2, self.s.wash_grad, self.s), s=self.s)
        return np.where(shade | self.artefacts | self.dirt, 255.0, out).astype(np.uint8)

    def color(self, rgb: np.ndarray, beta: float = 0.9) -> np.ndarray:
        s, base = self.s, np.maximum(self.luma, 1.0)
        most = 255.0 / np.maximum(_highest(rgb), 1.0)
        white = whitened(self.luma, self.background, beta, s)
        tint = chroma_of(_scaled(rgb, np.minimum(white / base, most)))
        lifted, where = washed(white, tint, s)
        out = _scaled(rgb, np.minimum(lifted / base, most))
        out[where] = lifted[where, None]
        shade = fold_ink(lifted, self.fold, flat(lifted, 1.2, s.wash_grad, s), tint, s)
        paper = (lifted >= s.paper) & (self.luma >= self.background * 0.94) & (tint < s.paper_chroma)
        out[shade | self.artefacts | paper | self.dirt] = 255.0
        return out.astype(np.uint8)

    def binary(self) -> np.ndarray:
        ink = without_holes(ink_mask(self.luma))
        ink &= ~(tiny_specks(ink, self.s) | stray_marks(ink, self.s))
        return np.where(ink, 0, 255).astype(np.uint8)

    def document(self, beta: float = 0.84) -> np.ndarray:
        s = self.s
        level = np.clip(255.0 * np.clip(self.luma / np.maximum(self.background, 1.0), 0, 1) ** beta, 0, 255).astype(np.float32)
        sharp = ~flat(level, 1.0, s.edge_grad, s)
        content = ((level < s.foreground) | (P.smooth(level, s.local_sigma) - level > s.local_contrast)) & ((level < s.dark) | sharp)
        out = np.where(content, level, 255.0)
        shade = fold_ink(out, self.fold, flat(level, 1.0, s.wash_grad, s), s=s)
        out[self.artefacts | shade | self.dirt] = 255.0
        out[out >= s.white] = 255.0
        return out.astype(np.uint8)


def metrics(luma: np.ndarray, corrected: np.ndarray, backgrounds: list[np.ndarray]) -> dict[str, float]:
    """Evenness of the paper, spread of the background, contrast and colour of a page."""
    paper, ink = luma >= 0.85 * 255.0, luma < 0.9 * 255.0
    level = float(np.percentile(luma[paper], 50)) / 255.0 if paper.any() else 1.0
    dark = float(np.percentile(luma[ink], 30)) / 255.0 if ink.sum() > 1000 else 0.9
    spread = chroma_of(corrected.astype(np.int16))
    return {
        "paper_std": round(float(luma[paper].std()) / 255.0 if paper.any() else 1.0, 4),
        "background_spread": round(float(max(b.max() for b in backgrounds) - min(b.min() for b in backgrounds)) / 255.0, 4),
        "contrast": round(level - dark, 4),
        "chroma": round(float(spread[ink].mean()) / 255.0 if ink.any() else 0.0, 4),
    }


def mode_of(m: dict[str, float], wanted: str | None, s: Settings = DEFAULTS) -> str:
    """Output mode: what is asked for, the setting, or by the metrics."""
    name = (wanted or s.output or "auto").lower()
    if name != "auto":
        return name if name in MODES else "gray"
    if m["chroma"] > 0.05:
        return "color"
    return "binary" if m["paper_std"] > 0.06 or m["background_spread"] > 0.35 else "gray"


@dataclass(frozen=True)
class Measured:
    """A page at the size at which it is cleaned, its paper levels, what is left once they are even, and its metrics, mode and scale."""

    rgb: np.ndarray
    backgrounds: list[np.ndarray]
    corrected: np.ndarray
    page: Page
    info: dict


def measured_page(rgb: np.ndarray, wanted: str | None = None, s: Settings = DEFAULTS) -> Measured:
    """What is known of a page before it is cleaned."""
    if not s.enabled:
        raise ValueError("cleaning is disabled")
    edge = max(rgb.shape[:2])
    if edge > s.max_edge:
        shape = tuple(max(1, round(n * s.max_edge / edge)) for n in rgb.shape[:2])
        rgb = P.resampled(rgb, shape, "lanczos")
    backgrounds = channel_backgrounds(rgb, s)
    corrected = flat_field(rgb, backgrounds)
    page = Page(luma_of(corrected), s)
    m = metrics(page.luma, corrected, backgrounds)
    return Measured(rgb, backgrounds, corrected, page, {**m, "mode": mode_of(m, wanted, s), "scaled": edge > s.max_edge, "original_edge": int(edge)})


def clean_page(rgb: np.ndarray, wanted: str | None = None, s: Settings = DEFAULTS) -> tuple[np.ndarray, dict]:
    """The cleaned page (RGB) and its metrics, mode and scale."""
    m = measured_page(rgb, wanted, s)
    rgb, page, mode = m.rgb, m.page, m.info["mode"]
    if mode == "color":
        out = page.color(m.corrected)
        own = np.clip((chroma_of(rgb.astype(np.float32)) - 22.0) / 10.0, 0, 1)
        shade = np.clip((180.0 - (m.backgrounds[0] * 0.3 + m.backgrounds[1] * 0.6 + m.backgrounds[2] * 0.1)) / 30.0, 0, 1)
        blend = np.maximum(own, shade)
        out = np.stack([(out[..., c] * (1.0 - blend) + rgb[..., c] * blend).astype(np.uint8) for c in range(3)], axis=2)
    else:
        out = np.repeat({"gray": page.gray, "binary": page.binary, "document": page.document}[mode]()[..., None], 3, axis=2)
    return out, m.info


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Brightness in whole numbers, with weights of 16 bits."""
    r, g, b = (rgb[..., c].astype(np.int64) for c in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def stretched(grey: np.ndarray) -> np.ndarray:
    """Brightness spread over the whole range."""
    low, high = int(grey.min()), int(grey.max())
    if high <= low:
        return grey
    scale = 255.0 / (high - low)
    return np.clip((np.arange(256) * scale - low * scale).astype(int), 0, 255).astype(np.uint8)[grey]


def has_colour(rgb: np.ndarray, threshold: int = 16, sample: int = 400) -> bool:
    """Does any channel of a thumbnail differ clearly from its brightness?"""
    small = P.thumbnail(rgb, sample)
    return bool((np.abs(small.astype(np.int16) - grey_of(small).astype(np.int16)[..., None]) > threshold).any())


def is_bilevel(rgb: np.ndarray, share: float = 0.92) -> bool:
    """Are nearly all pixels near black or white once the range is stretched?"""
    level = stretched(grey_of(rgb))
    return bool(((level < 26) | (level >= 230)).mean() > share)


def prepared(rgb: np.ndarray, rotate: int = 0) -> np.ndarray:
    """A gray, stretched copy for recognition, turned by right angles."""
    return stretched(grey_of(np.rot90(rgb, -(rotate // 90) % 4)))


class Once:
    """A function of images that works out equal ones, such as blank sheets and copies, once.

    The images are compared in full; the latest are kept, up to a number of
    bytes with their results, so memory doesn't grow with the pages.
    """

    def __init__(self, f: Callable, most: int = 48 << 20):
        self.f, self.most, self.held, self.kept = f, most, 0, OrderedDict()
        P.keep_memory()

    def __call__(self, data: bytes, height: int, width: int):
        key = (data, height, width)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key][0]
        out = self.f(np.frombuffer(data, np.uint8).reshape(height, width, 3))
        size = len(data) + sum(len(x) if isinstance(x, bytes) else 100 for x in (out.values() if isinstance(out, dict) else out))
        self.kept[key] = out, size
        self.held += size
        while self.held > self.most:
            self.held -= self.kept.popitem(last=False)[1][1]
        return out


_INFO = "paper_std double, background_spread double, contrast double, chroma double, mode string, scaled boolean, original_edge int"


def _each_page(pages: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Rows ``doc_id, page`` with what ``f`` gives for each image; an error code if its bytes don't fit its size."""
    schema = f"doc_id long, page int, {schema}, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = Once(f)
        for batch in batches:
            rows, held = [], 0
            for r in batch.itertuples(index=False):
                try:
                    own = once(r.data, r.height, r.width)
                except (ValueError, TypeError):
                    own = {"error": "clean_render_failed"}
                rows.append([r.doc_id, r.page, *map(own.get, names[2:])])
                held += len(own.get("data") or b"")
                if held > 16 << 20:  # images are handed on in batches of some MB
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("doc_id", "page", "height", "width", "data").mapInPandas(run, schema)


def measure_pages(pages: DataFrame, wanted: str | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """The metrics, mode and scale of rows ``doc_id, page, height, width, data`` (RGB bytes), as ``clean_pages`` has them; nothing is cleaned."""
    return _each_page(pages, lambda rgb: measured_page(rgb, wanted, s).info, _INFO)


def clean_pages(pages: DataFrame, wanted: str | None = None, s: Settings = DEFAULTS, restore: bool = False, images: bool = True) -> DataFrame:
    """Clean rows ``doc_id, page, height, width, data`` (RGB bytes): metrics, and the cleaned bytes.

    With ``restore`` a page that was cleaned at a smaller size gets its own
    size back; without ``images`` the cleaned bytes aren't handed on. A page
    whose bytes don't fit its size gets an error code instead of an image.
    """

    def clean(rgb: np.ndarray) -> dict:
        out, info = clean_page(rgb, wanted, s)
        if restore and info["scaled"]:
            out = P.resampled(out, rgb.shape[:2], "lanczos")
        return {**info, "height": out.shape[0], "width": out.shape[1], "data": out.tobytes() if images else None}

    return _each_page(pages, clean, f"{_INFO}, height int, width int, data binary")
