"""Queries of the image operators over drawn test pages.

The pages are drawn so that each operator's exact result can be told from the
drawing: even paper, strokes two pixels wide (which the estimates of the paper
leave out), one long line, a ring with a small hole and coloured strokes. The
queries run the operators themselves and return how many pixels have each
value, with the sums of their coordinates; the SQL derives the same from the
list of rectangles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import planes as P
from pageloom.operators import base as B
from pageloom.operators import documents as O
from pageloom.operators import images as I
from pageloom.session import parted

HEIGHT, WIDTH = 140, 360
#: What is drawn: kind, first and last row, first and last column.
RECTS = (
    [("bar", 20, 29, 20 + 16 * k, 21 + 16 * k) for k in range(20)]
    + [("line", 60, 61, 15, 344)]
    + [("ring", 90, 90, 30, 34), ("ring", 93, 93, 30, 34), ("ring", 91, 92, 30, 30), ("ring", 91, 92, 34, 34), ("hole", 91, 92, 31, 33)]
    + [("stamp", 110, 119, 30 + 10 * k, 31 + 10 * k) for k in range(30)]
)
INK, LINE, STAMP = 60, 70, (200, 40, 45)
#: Rows and depth of a shallow streak, of a fold and of a dark right half.
BAND, FOLD, HALF = (60, 61, 10), (50, 89, 30), 100
EDGE = 100


def draw(doc: int, colour: bool, kind: str = "full", width: int = WIDTH) -> np.ndarray:
    """A page: ``full``, or ``plain`` paper, or paper with a ``band``, a ``corner`` shadow, an ``edge``; ``stepped``: full, its right half darker."""
    top = 200 + doc % 40
    rgb = np.empty((HEIGHT, width, 3), np.uint8)
    rgb[:] = (top, top - 3, top - 6) if colour else top
    if kind == "stepped":
        rgb[:, width // 2 :] -= HALF
    if kind in ("full", "stepped"):
        for name, y0, y1, x0, x1 in RECTS:
            if name != "hole":
                rgb[y0 : y1 + 1, x0 : x1 + 1] = LINE if name == "line" else STAMP if name == "stamp" and colour else INK
    elif kind == "band":
        rgb[BAND[0] : BAND[1] + 1] -= BAND[2]
    elif kind == "corner":
        y, x = np.mgrid[0:HEIGHT, 0:width]
        rgb -= np.clip(41 - 2 * (x + y), 0, None).astype(np.uint8)[..., None]
    elif kind == "edge":
        rgb[:, EDGE:] -= 60
    return rgb


def _asked(findings: DataFrame, kind="full", width=None) -> DataFrame:
    """``doc_id, page, colour, kind, width``: what to draw for each finding."""
    wide = F.lit(WIDTH) if width is None else width
    name = F.lit(kind) if isinstance(kind, str) else kind
    return parted(findings.select("doc_id", "page", F.coalesce("colour", F.lit(False)).alias("colour"), name.alias("kind"), wide.alias("width")))


def drawn_pages(findings: DataFrame, kind: str = "full", width=None) -> DataFrame:
    """``doc_id, page, height, width, data``: a page image for each finding; ``width`` may be a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 100):  # some MB of images at once
                rows = [(d, p, HEIGHT, w, draw(int(d), bool(c), k, int(w)).tobytes()) for d, p, c, k, w in batch[i : i + 100].itertuples(index=False)]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "height", "width", "data"])

    return _asked(findings, kind, width).mapInPandas(run, "doc_id long, page int, height int, width int, data binary")


def sheets(findings: DataFrame) -> DataFrame:
    """An A4 sheet of text-like strokes for each native resolution that occurs among the findings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dpi in batch["native_dpi"]:
                h, w = round(dpi * 11.69), round(dpi * 8.27)
                luma = 210 + 20 * np.sin(np.arange(w) / w * 5)[None, :] + 10 * np.cos(np.arange(h) / h * 4)[:, None]
                rgb = np.repeat(luma.astype(np.uint8)[..., None], 3, axis=2)
                unit = max(1, dpi // 60)
                for y in range(unit * 20, h - unit * 20, unit * 10):
                    for x in range(unit * 20, w - unit * 20, unit * 7):
                        rgb[y : y + unit * 4, x : x + unit] = rgb[y : y + unit, x : x + unit * 4] = 50
                yield pd.DataFrame({"doc_id": [int(dpi)], "page": [1], "height": [h], "width": [w], "data": [rgb.tobytes()]})

    one = findings.select("native_dpi").where("native_dpi is not null").distinct()
    return parted(one).mapInPandas(run, "doc_id long, page int, height int, width int, data binary")


def _figures(f: Callable, schema: str, kind: str = "full") -> Callable:
    """A query of rows ``doc_id, page, ...``: those that ``f`` gives for each drawn page."""
    names = ["doc_id", "page", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        once = I.Once(f)
        for batch in batches:
            rows = [(d, p, *x) for d, p, c, k, w in batch.itertuples(index=False) for x in once(draw(int(d), bool(c), k, int(w)).tobytes(), HEIGHT, int(w))]
            yield pd.DataFrame(rows, columns=names)

    return lambda s, d: _asked(B.findings(s, d), kind).mapInPandas(run, f"doc_id long, page int, {schema}")


def _values(plane: np.ndarray) -> list[tuple]:
    """Each value of a plane: how often it occurs, and the sums of the rows and columns where it does."""
    values, of = np.unique(np.floor(plane.astype(np.float64) * 10 + 0.5) / 10, return_inverse=True)
    of = of.ravel()
    ys, xs = (np.bincount(of, at.ravel(), len(values)) for at in np.mgrid[0 : plane.shape[0], 0 : plane.shape[1]])
    return [(float(v), int(n), int(y), int(x)) for v, n, y, x in zip(values, np.bincount(of), ys, xs)]


def _plane(f: Callable, kind: str = "full") -> Callable:
    return _figures(lambda a: _values(f(a)), "level double, n long, y long, x long", kind)


def _channels(f: Callable) -> Callable:
    return _figures(lambda a: [(c, *v) for c, p in enumerate(np.moveaxis(f(a), 2, 0)) for v in _values(p)], "channel int, level double, n long, y long, x long")


def _mask(f: Callable, kind: str = "full") -> Callable:
    """The pixels that are set; no row if there are none."""
    return _figures(lambda a: [v[1:] for v in _values(f(a)) if v[0]], "n long, y long, x long", kind)


def _corrected(a: np.ndarray) -> np.ndarray:
    return I.flat_field(a, I.channel_backgrounds(a))


def _page(a: np.ndarray) -> I.Page:
    return I.Page(I.luma_of(_corrected(a)))


def _background(a: np.ndarray) -> np.ndarray:
    return I.luma_background(I.luma_of(a))


def _even(a: np.ndarray) -> np.ndarray:
    """A level background of the paper's brightness."""
    return np.full(a.shape[:2], I.luma_of(a)[-1, -1])


def _folded(a: np.ndarray) -> np.ndarray:
    out = _even(a)
    out[FOLD[0] : FOLD[1] + 1] -= FOLD[2]
    return out


# --- SQL ----------------------------------------------------------------------


def _luma(r: str, g: str, b: str) -> str:
    """Brightness in single precision, as the operators have it."""
    return f"({r}::FLOAT * 0.299::FLOAT + {g}::FLOAT * 0.587::FLOAT + {b}::FLOAT * 0.114::FLOAT)"


_RECTS = ", ".join(f"('{k}', {y0}, {y1}, {x0}, {x1})" for k, y0, y1, x0, x1 in RECTS)
_TOTALS = f"{HEIGHT * WIDTH}, {WIDTH * HEIGHT * (HEIGHT - 1) // 2}, {HEIGHT * WIDTH * (WIDTH - 1) // 2}"
_CLASSES = f"""{B.FINDINGS}, rects(kind, y0, y1, x0, x1) AS (VALUES {_RECTS}),
  drawn AS MATERIALIZED (SELECT kind, count(*)::BIGINT AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM rects, range({HEIGHT}) a(y), range({WIDTH}) b(x) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY kind),
  cells AS (SELECT kind, n, y, x FROM drawn UNION ALL SELECT 'paper', (t.n - sum(d.n))::BIGINT, (t.y - sum(d.y))::BIGINT, (t.x - sum(d.x))::BIGINT FROM drawn d, (VALUES ({_TOTALS})) t(n, y, x) GROUP BY t.n, t.y, t.x),
  papers AS (SELECT doc_id, page, native_dpi, coalesce(colour, false) AS c, (200 + doc_id % 40)::DOUBLE AS pr, (200 + doc_id % 40 - CASE WHEN colour THEN 3 ELSE 0 END)::DOUBLE AS pg, (200 + doc_id % 40 - CASE WHEN colour THEN 6 ELSE 0 END)::DOUBLE AS pb FROM findings),
  raw AS (SELECT *, kind IN ('paper', 'hole') AS bare, {', '.join(f"(CASE WHEN kind IN ('paper', 'hole') THEN p{c} WHEN kind = 'line' THEN {LINE} WHEN kind = 'stamp' AND c THEN {STAMP[i]} ELSE {INK} END)::DOUBLE AS {c}" for i, c in enumerate('rgb'))} FROM papers, cells),
  lit AS (SELECT *, {_luma('r', 'g', 'b')} AS luma, {_luma('pr', 'pg', 'pb')} AS paper, {', '.join(f'least(255::FLOAT, {c}::FLOAT / (p{c} + 1)::FLOAT * 255::FLOAT) AS c{c}' for c in 'rgb')}, {_luma(*(f'(p{c}::FLOAT / (p{c} + 1)::FLOAT * 255::FLOAT)' for c in 'rgb'))} AS even_paper FROM raw),
  even AS (SELECT *, {_luma('cr', 'cg', 'cb')} AS even, floor(even_paper) + 1 AS bg FROM lit),
  white AS (SELECT *, CASE WHEN w >= 247.0 THEN 255.0::DOUBLE ELSE w END AS white FROM (SELECT *, 255.0 * pow(least(1.0::DOUBLE, even / bg), 0.9::DOUBLE) AS w FROM even)),
  shown AS (SELECT *, {', '.join(f"CASE WHEN bare OR kind = 'line' THEN 255.0::DOUBLE ELSE floor(c{c} * least(white::FLOAT / greatest(even, 1::FLOAT), 255::FLOAT / greatest(cr, cg, cb, 1::FLOAT))) END AS o{c}" for c in 'rgb')}, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (greatest(r, g, b) - least(r, g, b) - 22.0) / 10.0)) AS own FROM white)"""


def _levels(level: str, source: str = "white", more: str = "") -> str:
    return f"WITH {_CLASSES} SELECT doc_id, page, {more}round(({level})::DOUBLE, 1) AS level, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM {source} GROUP BY ALL"


def _each_channel(names: tuple[str, str, str], source: str = "shown") -> str:
    union = " UNION ALL ".join(f"SELECT doc_id, page, {i} AS channel, {e} AS v, n, y, x FROM {source}" for i, e in enumerate(names))
    return f"WITH {_CLASSES} SELECT doc_id, page, channel, round(v::DOUBLE, 1) AS level, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM ({union}) GROUP BY ALL"


def _set(where: str, source: str = "even") -> str:
    return f"WITH {_CLASSES} SELECT doc_id, page, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM {source} WHERE {where} GROUP BY ALL"


def _area(where: str) -> str:
    """The pixels of each page for which a condition on ``y``, ``x`` and the paper holds."""
    return f"""WITH {_CLASSES}, grid AS MATERIALIZED (SELECT y::BIGINT AS y, x::BIGINT AS x FROM range({HEIGHT}) a(y), range({WIDTH}) b(x)),
    lumas AS (SELECT DISTINCT doc_id, page, paper FROM lit) SELECT doc_id, page, count(*) AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM lumas, grid WHERE {where} GROUP BY ALL"""


_METRICS = f"""{_CLASSES}, inked AS (SELECT doc_id, page, even FROM even, range(0, n) t(i) WHERE even < 229.5),
  dark AS (SELECT doc_id, page, quantile_cont(even, 0.3) AS q, count(*) AS k FROM inked GROUP BY ALL),
  metrics AS (SELECT e.doc_id, e.page, 0.0::DOUBLE AS paper_std, round((max(greatest(pr, pg, pb)) - min(least(pr, pg, pb))) / 255.0, 4) AS background_spread,
    round(any_value(even_paper) / 255.0 - CASE WHEN any_value(k) > 1000 THEN any_value(q) / 255.0 ELSE 0.9::DOUBLE END, 4) AS contrast,
    round(sum(n * (floor(greatest(cr, cg, cb)) - floor(least(cr, cg, cb)))) FILTER (even < 229.5) / sum(n) FILTER (even < 229.5) / 255.0, 4)::DOUBLE AS chroma
    FROM even e JOIN dark USING (doc_id, page) GROUP BY e.doc_id, e.page)"""
#: Pages that are drawn with a dark half, which the metrics call binary.
_STEPPED = "NOT coalesce(colour, false) AND page % 3 = 0"
_MODED = f"{B.FINDINGS}, moded AS (SELECT doc_id, page, CASE WHEN coalesce(colour, false) THEN 'color' WHEN {_STEPPED} THEN 'binary' ELSE 'gray' END AS mode FROM findings)"


def _cleaned(s, d):
    return I.clean_pages(drawn_pages(B.findings(s, d)))


def _stepped():
    return F.when(F.expr(_STEPPED), "stepped").otherwise("full")


def _moded(s, d):
    return I.clean_pages(drawn_pages(B.findings(s, d), _stepped()), images=False)


def _measured(s, d, kind="full"):
    return I.measure_pages(drawn_pages(B.findings(s, d), kind))


def _scaled(s, d):
    return I.clean_pages(drawn_pages(B.findings(s, d), width=F.when(F.col("native_dpi") > 300, WIDTH).otherwise(346)), s=I.Settings(max_edge=350))


_INK = "NOT bare"
_GRAY = "CASE WHEN bare OR kind = 'line' THEN 255.0::DOUBLE ELSE floor(white) END"
_DOCUMENT = "CASE WHEN bare OR kind = 'line' THEN 255.0::DOUBLE ELSE floor(255.0 * pow(least(1.0::DOUBLE, even / bg), 0.84::DOUBLE)) END"
_GREY = "(((r * 19595 + g * 38470 + b * 7471)::BIGINT + 32768) >> 16)"
_SCALE = f"(255::DOUBLE / (max({_GREY}) OVER pg - min({_GREY}) OVER pg))"
_STRETCH = f"floor({_GREY} * {_SCALE} - (min({_GREY}) OVER pg) * {_SCALE})"

QUERIES = {
    "M1_luma": (_plane(I.luma_of), _levels("luma")),
    "P1_rgb_l8": (_plane(lambda a: np.clip(I.luma_of(a), 0, 255).astype(np.uint8)), _levels("floor(luma)")),
    "P2_gradient_masks": (
        _mask(lambda a: ~I.flat(I.luma_of(a), 1.2, 14.0), "edge"),
        _area(f"""x IN (SELECT c FROM (SELECT c, sum(CASE WHEN c + k >= {EDGE} THEN 60.0 * k / 1.44 * exp(-0.5 * (k / 1.2) ** 2) ELSE 0 END) / sum(exp(-0.5 * (k / 1.2) ** 2)) AS slope
            FROM range({EDGE - 12}, {EDGE + 12}) u(c), range(-5, 6) t(k) GROUP BY c) WHERE abs(slope) > 14)"""),
    ),
    "P3_background_maps": (_channels(lambda a: np.stack(I.channel_backgrounds(a), axis=2)), _each_channel(("pr + 1", "pg + 1", "pb + 1"), "raw")),
    "P4_flat_field": (_channels(_corrected), _each_channel(("cr", "cg", "cb"), "lit")),
    "P5_background_luma": (_plane(_background), _levels("floor(paper) + 1")),
    "P6_whiten_luma": (_plane(lambda a: I.whitened(_page(a).luma, _page(a).background, 0.9)), _levels("white")),
    "P7_residual_wash": (
        _plane(lambda a: I.washed(I.luma_of(a))[0], "plain"),
        f"""WITH {_CLASSES}, p AS (SELECT DISTINCT doc_id, page, paper, floor(paper) + 1 AS bg FROM lit)
        SELECT doc_id, page, round((CASE WHEN paper >= 210 THEN least(255::FLOAT, paper + greatest(bg + 2, 247::FLOAT) - bg) ELSE paper END)::DOUBLE, 1) AS level, t.n::BIGINT AS n, t.y::BIGINT AS y, t.x::BIGINT AS x FROM p, (VALUES ({_TOTALS})) t(n, y, x)""",
    ),
    "P8_fold_map": (
        _mask(lambda a: I.fold_zone(_folded(a)), "plain"),
        f"""WITH {_CLASSES}, w AS (SELECT k, exp(-0.5 * (k / 32.0) ** 2) / sum(exp(-0.5 * (k / 32.0) ** 2)) OVER () AS w FROM range(-128, 129) t(k)),
        dips AS (SELECT y, CASE WHEN y BETWEEN {FOLD[0]} AND {FOLD[1]} THEN {FOLD[2]} ELSE 0 END AS own, sum(w * CASE WHEN least({HEIGHT - 1}, greatest(0, y + k)) BETWEEN {FOLD[0]} AND {FOLD[1]} THEN {FOLD[2]} ELSE 0 END) AS sheet FROM range({HEIGHT}) a(y), w GROUP BY y),
        zone AS (SELECT min(y) AS a, max(y) AS b FROM dips WHERE abs(own - sheet) > 10),
        px AS (SELECT y, x FROM zone, range({HEIGHT}) u(y), range({WIDTH}) v(x) WHERE greatest(0, a + 2 - y, y - b + 2) + greatest(0, 2 - x, x - {WIDTH - 3}) <= 2),
        t AS (SELECT count(*) AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM px) SELECT doc_id, page, n, y, x FROM papers, t WHERE n > 0""",
    ),
    "P9_fold_ink": (
        _mask(lambda a: I.fold_ink(I.luma_of(a), np.arange(HEIGHT)[:, None] + np.zeros(a.shape[1]) < 50, np.ones(a.shape[:2], bool), I.chroma_of(a.astype(np.float32))), "plain"),
        _area("paper >= 150 AND paper < 210 AND y < 50"),
    ),
    "P10_corner_mask": (_mask(lambda a: I.corner_shadows(I.luma_of(a), _even(a)), "corner"), _area("x + y <= 11")),
    "P11_band_mask": (
        _mask(lambda a: I.band_streaks(I.luma_of(a), _background(a)), "band"),
        _area(f"y BETWEEN {BAND[0]} AND {BAND[1]} AND x BETWEEN 1 AND {WIDTH - 2} AND paper - {BAND[2]} >= 204.99"),
    ),
    "P12_disk": (lambda s, d: s.createDataFrame([(r, int(P.disk(r).sum())) for r in range(1, 6)], "radius int, cells int"), "SELECT r::INTEGER AS radius, count(*)::INTEGER AS cells FROM range(1, 6) t(r), range(-5, 6) a(y), range(-5, 6) b(x) WHERE x * x + y * y <= r * r GROUP BY r"),
    "P13_tiny_specks": (
        _mask(lambda a: I.tiny_specks(I.luma_of(a) < 120, I.Settings(remove_specks=True))),
        _set(_INK),  # an opening by a disk leaves nothing of strokes two pixels wide, and there is no other ink
    ),
    "P14_stray_marks": (_mask(lambda a: I.stray_marks(I.luma_of(a) < 120)), _set("kind = 'line'")),
    "A15_components": (
        _figures(lambda a: (lambda p: list(zip(*(x.tolist() for x in (p.area, p.top, p.bottom, p.left, p.right)))))(P.parts(I.luma_of(a) < 120)), "area int, top int, bottom int, left_ int, right_ int"),
        f"""WITH {_CLASSES}, p AS (SELECT ((y1 - y0 + 1) * (x1 - x0 + 1)) AS area, y0, y1, x0, x1 FROM rects WHERE kind NOT IN ('ring', 'hole') UNION ALL SELECT sum((y1 - y0 + 1) * (x1 - x0 + 1)), min(y0), max(y1), min(x0), max(x1) FROM rects WHERE kind = 'ring')
        SELECT doc_id, page, area::INTEGER AS area, y0 AS top, y1 AS bottom, x0 AS left_, x1 AS right_ FROM papers, p""",
    ),
    "P15_residual_dark": (_mask(lambda a: I.darker_than_paper(I.luma_of(a), _background(a))), _set(_INK)),
    "P16_document_mode": (_plane(lambda a: _page(a).document()), _levels(_DOCUMENT)),
    "P17_clean_gray": (_plane(lambda a: _page(a).gray()), _levels(_GRAY)),
    "P18_clean_color": (_channels(lambda a: _page(a).color(_corrected(a))), _each_channel(("or_", "og", "ob")).replace("or_ AS v", '"or" AS v')),
    "P19_sauvola": (_mask(lambda a: I.ink_mask(I.luma_of(a))), _set(_INK)),
    "P20_fill_holes": (_mask(lambda a: I.without_holes(I.luma_of(a) < 120)), _set("kind <> 'paper'")),
    "P21_clean_binary": (_plane(lambda a: _page(a).binary()), _levels("CASE WHEN kind IN ('paper', 'line') THEN 255.0 ELSE 0.0 END")),
    "P22_colour_blend": (_channels(lambda a: I.clean_page(a, "color")[0]), _each_channel(tuple(f'floor("o{c}" * (1 - own) + {c} * own)' for c in "rgb"))),
    "U2_mask_union": (_mask(lambda a: _page(a).artefacts | _page(a).dirt | _page(a).fold), _set("kind = 'line'")),
    "P23_clean_page": (
        lambda s, d: _cleaned(s, d).select("doc_id", "page", "paper_std", "background_spread", "contrast", "chroma", "mode", "scaled", "original_edge", "error"),
        f"WITH {_METRICS} SELECT doc_id, page, paper_std, background_spread, contrast, chroma, CASE WHEN chroma > 0.05 THEN 'color' ELSE 'gray' END AS mode, false AS scaled, {WIDTH} AS original_edge, NULL::VARCHAR AS error FROM metrics",
    ),
    "P23_clean_sheets": (
        lambda s, d: I.clean_pages(sheets(B.findings(s, d))).select(F.col("doc_id").cast("int").alias("dpi"), "mode", "scaled", "original_edge", "height", "width", "error"),
        """SELECT DISTINCT native_dpi AS dpi, 'gray' AS mode, round_even(native_dpi * 11.69, 0) > 2600 AS scaled, round_even(native_dpi * 11.69, 0)::INTEGER AS original_edge, least(2600, round_even(native_dpi * 11.69, 0))::INTEGER AS height,
        round_even(round_even(native_dpi * 8.27, 0) * least(1.0::DOUBLE, 2600 / round_even(native_dpi * 11.69, 0)::DOUBLE), 0)::INTEGER AS width, NULL::VARCHAR AS error FROM page_finding WHERE native_dpi IS NOT NULL""",
    ),
    "A1_page_metrics": (lambda s, d: _cleaned(s, d).select("doc_id", "page", "paper_std", "background_spread", "contrast", "chroma"), f"WITH {_METRICS} SELECT * FROM metrics"),
    "A2_document_averages": (
        lambda s, d: O.document_averages(_measured(s, d)).select("doc_id", "paper_std", "background_spread", "contrast", "chroma"),
        f"WITH {_METRICS} SELECT doc_id, {', '.join(f'round_even(avg({c}) * 10000, 0) / 10000 AS {c}' for c in ('paper_std', 'background_spread', 'contrast', 'chroma'))} FROM metrics GROUP BY doc_id",
    ),
    "F8_output_mode": (lambda s, d: _moded(s, d).select("doc_id", "page", "mode"), f"WITH {_MODED} SELECT doc_id, page, mode FROM moded"),
    "A3_modal_mode": (
        lambda s, d: O.document_averages(_measured(s, d, _stepped())).select("doc_id", "mode"),
        f"WITH {_MODED}, c AS (SELECT doc_id, mode, count(*) AS n, min(page) AS first FROM moded GROUP BY 1, 2) SELECT doc_id, arg_max(mode, n * 1000000 - first) AS mode FROM c GROUP BY doc_id",
    ),
    "A4_any_scaled": (lambda s, d: O.document_averages(_scaled(s, d)).select("doc_id", "scaled"), f"WITH {B.FINDINGS} SELECT doc_id, bool_or(coalesce(native_dpi > 300, false)) AS scaled FROM findings GROUP BY doc_id"),
    "P24_clean_document": (
        lambda s, d: O.document_averages(_moded(s, d)).select("doc_id", "pages", "mode", "scaled"),
        f"WITH {_MODED}, c AS (SELECT doc_id, mode, count(*) AS n, min(page) AS first FROM moded GROUP BY 1, 2) SELECT doc_id, sum(n)::BIGINT AS pages, arg_max(mode, n * 1000000 - first) AS mode, false AS scaled FROM c GROUP BY doc_id",
    ),
    "F6_is_bilevel": (
        _figures(lambda a: [(I.is_bilevel(a),)], "bilevel boolean", "edge"),
        f"WITH {_CLASSES} SELECT DISTINCT doc_id, page, true AS bilevel FROM papers",  # two levels, whichever they are
    ),
    "F6_is_not_bilevel": (
        _figures(lambda a: [(I.is_bilevel(a),)], "bilevel boolean", "stepped"),
        f"WITH {_CLASSES} SELECT DISTINCT doc_id, page, false AS bilevel FROM papers",  # half of the page lies between ink and paper
    ),
    "F7_has_colour": (_figures(lambda a: [(I.has_colour(a),)], "colour boolean"), f"WITH {B.FINDINGS} SELECT doc_id, page, coalesce(colour, false) AS colour FROM findings"),
    "P25_prepare": (
        _plane(lambda a: I.prepared(a, 90)),
        f"WITH {_CLASSES}, g AS (SELECT *, {_STRETCH} AS v FROM raw WINDOW pg AS (PARTITION BY doc_id, page)) SELECT doc_id, page, v::DOUBLE AS level, sum(n)::BIGINT AS n, sum(x)::BIGINT AS y, sum({HEIGHT - 1} * n - y)::BIGINT AS x FROM g GROUP BY ALL",
    ),
    "P26_mono": (_mask(lambda a: I.prepared(a) > 128), _set("kind IN ('paper', 'hole') OR kind = 'stamp' AND c AND false")),
}
