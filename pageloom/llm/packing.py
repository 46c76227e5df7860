"""Problem 8: place items of varying size in containers of fixed capacity.

Method: Martello-Toth dominance reduction, then best-fit for the remainder.
Both look only at how many items there are of each size. That histogram has at
most ``capacity + 1`` rows whatever the number of items, so it may go to the
driver; the items themselves stay distributed and find their place by their
rank among the items of the same size.

Defined results: null and empty texts are items of size 0 and are spread evenly
over the containers (container 0 if there is none else); an item larger than
the capacity is cut into full pieces and a rest; repeated rows are items of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import written

#: Items of one size that are ranked together; a size that more items share is ranked in parts.
RANKED = 50_000


@dataclass(frozen=True)
class Pattern:
    """``copies`` containers that each hold the same sizes."""

    sizes: tuple[int, ...]
    copies: int


def _largest_pair(sizes: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of two items, other than a single one, that fits into ``room``; 0 if none does."""
    best, high = 0, len(sizes) - 1
    for low, a in enumerate(sizes):
        while high >= low and a + sizes[high] > room:
            high -= 1
        if high < low:
            break
        b = high
        if b == low and left[a] < 2:
            b -= 1
        if b >= low:
            best = max(best, a + sizes[b])
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Containers that some optimal solution has, and the counts that remain.

    For the largest item j: nothing fits beside it, or one item fills the
    container with it exactly, or only one more item can fit (then the largest
    that does), or the largest single companion is at least as large as any
    pair that fits: each time the set dominates every other set with j. The
    fourth test is sound where no three items fit beside j.
    """
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    order = sorted(left)
    fixed: list[Pattern] = []
    skipped: set[int] = set()

    def take(sizes: tuple[int, ...], copies: int) -> None:
        fixed.append(Pattern(sizes, copies))
        for s in sizes:
            left[s] -= copies
        for s in set(sizes):
            if not left[s]:
                del left[s]
                order.pop(bisect_left(order, s))

    # Each test stays true while its set is taken again: taking items only raises the least ones that are left. So a set
    # is taken as often as its items last, and each step but one of a size uses a size up.
    while True:
        j = next((s for s in reversed(order) if s not in skipped), None)
        if j is None:
            return fixed, left
        room = capacity - j
        low = [s for s in order[:3] if s != j or left[j] > 1]
        if not low or low[0] > room:
            take((j,), left[j] if j > room else 1)
            continue
        at = bisect_left(order, room + 1) - 1
        best = order[at]
        if best == j and left[j] < 2:
            at -= 1
            best = order[at]
        copies = left[j] // 2 if best == j else min(left[j], left[best])
        small = low[0]
        second = small if left[small] - (small == j) > 1 else (low[1] if len(low) > 1 else capacity)
        alone = best == room or small + second > room
        if alone or small + 2 * second > room and _largest_pair(order[: at + 1], left, room) <= best:
            take((j, best), copies)
            continue
        skipped.add(j)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal containers are filled at once."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    full: list[Pattern] = []

    def put(sizes: tuple[int, ...], room: int, copies: int) -> None:
        if room == 0:
            full.append(Pattern(sizes, copies))
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((sizes, copies))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                sizes, room, copies = (), capacity, -(-n // (capacity // size))
            else:
                room = rooms[at]
                sizes, copies = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            each = min(room // size, n)
            whole = min(copies, n // each)
            put(sizes + (size,) * each, room - size * each, whole)
            n -= whole * each
            rest = copies - whole
            if rest and n:  # fewer than ``each`` are left: one more container takes them
                put(sizes + (size,) * n, room - size * n, 1)
                rest, n = rest - 1, 0
            if rest and sizes:
                put(sizes, room, rest)
    return full + [Pattern(s, k) for bins in open_bins.values() for s, k in bins]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """All containers for a histogram of sizes up to the capacity."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By size: rank of the first item, items a container, first container, first place."""
    seen: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for p in patterns:
        place = 0
        for size in dict.fromkeys(p.sizes):
            each = p.sizes.count(size)
            start = seen.get(size, 0)
            out.setdefault(size, []).append((start, each, base, place))
            seen[size] = start + each * p.copies
            place += each
        base += p.copies
    return out


def pieces(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key, piece, n_tokens``: items, those over the capacity cut into full pieces and a rest."""
    n = F.coalesce(F.col(size), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int")
    return sizes.select(key, n.alias("_n"), F.explode(F.sequence(F.lit(1), count)).alias("piece")).select(
        key, "piece", F.least(F.lit(capacity), F.col("_n") - (F.col("piece") - 1) * capacity).cast("int").alias("n_tokens")
    )


def pack(sizes: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key, piece, n_tokens, container, place``: where each item or piece goes.

    ``sizes`` should be cheap to read three times (a written table): for the
    histogram, for the counts of parts and for the ranks. A size is ranked in
    parts of about RANKED items, so no task holds all items of a size.
    """
    items = pieces(sizes, capacity, key, size)
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    # as many rows as the histogram
    shares = F.broadcast(items.sparkSession.createDataFrame([(s, -(-n // RANKED)) for s, n in histogram.items()], "n_tokens int, parts int"))
    items = items.join(shares, "n_tokens").withColumn("part", F.pmod(F.xxhash64(key, "piece"), "parts").cast("int")).drop("parts")
    counted = items.groupBy("n_tokens", "part").agg(F.count("*").alias("n"))
    offsets = counted.select(
        "n_tokens",
        "part",
        F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    patterns = plan(histogram, capacity)
    slots = {s: tuple(np.array(x, np.int64) for x in zip(*runs)) for s, runs in _slots(patterns).items()}
    total = max(1, sum(p.copies for p in patterns))
    first = np.cumsum([0, *(p.copies for p in patterns)][:-1]) if patterns else np.zeros(1, np.int64)
    held = np.array([len(p.sizes) for p in patterns] or [0])
    kind = sizes.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, rank = batch["n_tokens"].to_numpy(), batch["rank"].to_numpy()
            container, place = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for s in np.unique(n):
                mine = n == s
                r = rank[mine]
                if s == 0:
                    container[mine] = r % total
                    place[mine] = held[np.searchsorted(first, r % total, "right") - 1] + r // total
                    continue
                start, each, base, at = slots[int(s)]
                k = np.searchsorted(start, r, "right") - 1
                container[mine] = base[k] + (r - start[k]) // each[k]
                place[mine] = at[k] + (r - start[k]) % each[k]
            yield pd.DataFrame({key: batch[key], "piece": batch["piece"], "n_tokens": n, "container": container, "place": place.astype("int32")})

    local = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy(key, "piece")) - 1
    ranked = (
        items.withColumn("local", local)
        .join(offsets, ["n_tokens", "part"])
        .select(key, "piece", "n_tokens", (F.col("local") + F.col("offset")).cast("long").alias("rank"))
    )
    return ranked.mapInPandas(run, f"{key} {kind}, piece int, n_tokens int, container long, place int")


def pack_texts(documents: DataFrame, count_tokens, capacity: int = 2048) -> DataFrame:
    """Pack the texts of documents, measured by ``count_tokens(df) -> doc_id, n_tokens``."""
    return pack(written(count_tokens(documents), "sizes"), capacity)
