"""Problem 2: cut oversized documents at natural boundaries, with an overlap.

Method: agglomerative merging. A text is first cut into atomic segments
(sentences; words where a sentence is too long; runs of characters where there
is no boundary at all). Adjacent pairs lie in a heap by the strength of the
boundary between them, and the weakest are merged first while the combined size
plus the overlap stays under the limit.

Defined results: a null text counts as an empty one and comes out as one empty
piece; a document within the limits as one piece, unchanged; of redelivered
rows of a document one is taken; a document too long in pages only is cut at
page starts if its pages are known to make up the text, else it stays one
piece; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import per_batch

#: Pieces have fewer characters than this; documents over this or over MAX_PAGES are oversized.
MAX_CHARS = 6000
MAX_PAGES = 12
#: Characters that a piece repeats of the one before.
OVERLAP = 200

#: Signs that end a sentence.
MARKS = ".!?…。！？؟।"
STRENGTH = {"none": 0, "word": 1, "sentence": 2, "paragraph": 3, "page": 4}
_NAMES = list(STRENGTH)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[。！？؟।][”’」』»)）]*\s*")
_WORD = re.compile(rf"\s+|(?<=[{MARKS}])")
_STRETCH = re.compile(rf"[^\s{MARKS}]+")


def longest_stretch(text: str) -> int:
    """Length of the longest run without white space and sentence-ending marks."""
    return max((x.end() - x.start() for x in _STRETCH.finditer(text)), default=0)


def _cuts(text: str, starts: list[int], room: int) -> list[tuple[int, int]]:
    """Places to cut at, each with its strength, such that no segment is longer than ``room``."""
    places: dict[int, int] = {}

    def add(at: int, strength: int) -> None:
        if 0 < at < len(text):
            places[at] = max(places.get(at, 0), strength)

    for at in starts:
        add(at, STRENGTH["page"])
    for x in _PARAGRAPH.finditer(text):
        add(x.end(), STRENGTH["paragraph"])
    for x in _SENTENCE.finditer(text):
        add(x.end(), STRENGTH["sentence"])
    for strength in ("word", "none"):
        edges = [0, *sorted(places), len(text)]
        for a, b in zip(edges, edges[1:]):
            if b - a > room:
                if strength == "word":
                    for x in _WORD.finditer(text, a, b):
                        add(x.end(), STRENGTH["word"])
                else:
                    for at in range(a + room, b, room):
                        add(at, STRENGTH["none"])
    return sorted(places.items())


def merge(edges: list[int], strengths: list[int], pages: list[int], room: int, max_pages: int) -> list[int]:
    """Indices of the inner edges that stay when the weakest boundaries have been merged away.

    ``edges`` has the start of each segment and the end of the last;
    ``strengths[i]`` is that of the boundary at ``edges[i]``; ``pages`` the
    number of the page at each edge, by which a piece is held to ``max_pages``.
    """
    n = len(edges) - 1
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    end = list(range(1, n + 1))
    version = [0] * n
    heap = [(strengths[i], edges[i + 1] - edges[i - 1], i, 0) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, _, i, seen = heapq.heappop(heap)
        if not alive[i] or seen != version[i]:
            continue
        a = left[i]
        if edges[end[i]] - edges[a] > room or pages[end[i]] - pages[a] > max_pages:
            continue
        alive[i], end[a], right[a] = False, end[i], right[i]
        if right[i] < n:
            left[right[i]] = a
        for b in (a, right[i]):
            if 0 < b < n:
                version[b] += 1
                heapq.heappush(heap, (strengths[b], edges[end[b]] - edges[left[b]], b, version[b]))
    return [i for i in range(1, n) if alive[i]]


def split_text(text: str, page_sizes: list[int] | None = None, pages: int = 0, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces of a text: start with the overlap, start of what is new, end, and what the start is cut at."""
    starts: list[int] = []
    if page_sizes and sum(page_sizes) + 2 * (len(page_sizes) - 1) == len(text):
        at = 0
        for size in page_sizes[:-1]:
            at += size + 2
            starts.append(at)
    if len(text) <= max_chars and (pages <= max_pages or not starts):
        return [(0, 0, len(text), "start")]
    room = max_chars - 1 - overlap
    cuts = _cuts(text, starts, room)
    edges = [0, *(at for at, _ in cuts), len(text)]
    strengths = [9, *(s for _, s in cuts), 9]
    number, on_page = [], 0
    marks = [*starts, len(text) + 1]
    for at in edges[:-1]:
        while marks[on_page] <= at:
            on_page += 1
        number.append(on_page)
    number.append(len(starts) + 1)
    kept = merge(edges, strengths, number, room, max_pages if starts else len(edges))
    out = []
    for i, j in zip([0, *kept], [*kept, len(edges) - 1]):
        body, back = edges[i], edges[i]
        if i:
            back = max(0, body - overlap)
            bound = re.compile(r"\s+").search(text, back, body) if back and not text[back - 1].isspace() else None
            if bound and bound.end() < body:
                back = bound.end()
        out.append((back, body, edges[j], "start" if i == 0 else _NAMES[strengths[i]]))
    return out


def done_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, text, pages, page_sizes``: one row for each document with status done."""
    own = (
        documents.where("status = 'done'").groupBy("doc_id")
        .agg(F.coalesce(F.max("text"), F.lit("")).alias("text"), F.max("page_count").alias("page_count"))
    )
    sizes = (
        pages.groupBy("doc_id", "page").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("size"))
        .groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("page", "size"))).alias("sizes"))
    )
    return own.join(sizes, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("page_count", "n", F.lit(0)).cast("int").alias("pages"), F.col("sizes.size").alias("page_sizes")
    )


def split(documents: DataFrame, pages: DataFrame, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of each finished document.

    ``doc_id, piece, start_at, body_at, end_at, cut, oversized, stretch, text``:
    the piece is ``text[start_at:end_at]``, of which the part before ``body_at``
    repeats the piece before; ``stretch`` is the document's longest run without
    a boundary.
    """

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, text, n, sizes in zip(batch["doc_id"], batch["text"], batch["pages"], batch["page_sizes"]):
            oversized = len(text) > max_chars or n > max_pages
            stretch = longest_stretch(text) if oversized else 0
            for k, (a, b, c, cut) in enumerate(split_text(text, list(sizes) if sizes is not None else None, n, max_chars, max_pages, overlap), 1):
                out.append((doc, k, a, b, c, cut, oversized, stretch, text[a:c]))
        return pd.DataFrame(out, columns=["doc_id", "piece", "start_at", "body_at", "end_at", "cut", "oversized", "stretch", "text"])

    schema = "doc_id long, piece int, start_at int, body_at int, end_at int, cut string, oversized boolean, stretch int, text string"
    return per_batch(done_documents(documents, pages), step, schema)


def found(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, kind``: the documents that had to be cut, and those among them without a boundary for too long."""
    rows = split(documents, pages).where("oversized").groupBy("doc_id").agg(F.max("stretch").alias("stretch"))
    hard = F.when(F.col("stretch") > MAX_CHARS, F.array(F.lit("oversized"), F.lit("hard"))).otherwise(F.array(F.lit("oversized")))
    return rows.select("doc_id", F.explode(hard).alias("kind"))
