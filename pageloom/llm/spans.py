"""Problem 9: long spans that stand verbatim in more than one record.

Method: Rabin-Karp hashes of every window of ``k`` characters, computed by one
rolling pass. Of these, winnowing keeps the minimum of each run of ``w``
successive windows (k + w - 1 = the least span), so any two records with a
common span of at least that length keep a common window; the kept ones are
counted in Spark. Around repeated windows the texts are compared character by
character, and the matches merge into maximal intervals.

Exact copies are one class: only its first record takes part in the search.
A window of few records compares each two of them; a window of many (boilerplate)
is split into all its windows of the full length, which are grouped by content,
so that no pair is looked at that doesn't share such a span. The spans, their
groups (which records hold them) and the number of links of each record come
out without a list of pairs of copies; ``shared_pairs`` derives that last, with
groups of any size cut into blocks of BLOCK_OF records.

Defined results: null, empty and short texts share nothing (0 shared
characters); repeated rows of a record count once; spans repeated within one
record only don't count; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import written

#: Least length of a shared span, in characters.
LEAST = 200
#: Length of a hashed window; runs of LEAST - WINDOW + 1 windows keep their minimum.
WINDOW = 100
#: Records that a window may have before it is split by content instead of compared in pairs.
FEW = 64
#: Records of a group that meet the whole group in one task.
BLOCK_OF = 500
#: Matches that are cut out of a text at once.
SLICE = 5_000
#: Characters of a text that are hashed at once.
BLOCK = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each window of ``k`` codes, modulo 2**64, mixed."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    powers, back = np.ones(n, np.uint64), np.ones(n - k + 1, np.uint64)
    np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64), out=powers[1:])
    np.multiply.accumulate(np.full(n - k, _BACK, np.uint64), out=back[1:])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * back
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the (last) minimum of each run of ``w`` hashes, each once."""
    n = len(h)
    if n < w:
        return np.empty(0, np.int64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()[w - 1 : n]
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()[: n - w + 1]
    low = np.minimum(ahead, behind)
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    out = []
    ends = np.append(starts[1:], len(low))
    for a, b in zip(starts.tolist(), ends.tolist()):
        hits = np.flatnonzero(h[a : b + w - 1] == low[a])
        out.extend((hits + a).tolist())
    return np.unique(np.array(out, np.int64))


def kept_windows(text: str, least: int = LEAST, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows that winnowing keeps of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, places = [], []
    for at in range(0, max(1, len(codes) - least + 1), BLOCK):
        h = window_hashes(codes[at : at + BLOCK + least - 1], k)
        p = winnow(h, least - k + 1)
        hashes.append(h[p])
        places.append(p + at)
    h, p = np.concatenate(hashes), np.concatenate(places)
    p, first = np.unique(p, return_index=True)
    return h[first].view(np.int64), p


def _records(documents: DataFrame, least: int, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= least)


def classes(documents: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, rep``: the class of records with one same text, named by its smallest id."""
    named = _records(documents, least, key, text).select("doc", F.sha2("text", 256).alias("same")).distinct()
    reps = named.groupBy("same").agg(F.min("doc").alias("rep"))
    return named.join(reps, "same").select("doc", "rep")


def _kept(records: DataFrame, least: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [kept_windows(t, least, k) for t in batch["text"]]
            sizes = [len(h) for h, _ in rows]
            yield pd.DataFrame({
                "doc": np.repeat(batch["doc"].to_numpy(), sizes),
                "h": np.concatenate([np.empty(0, np.int64), *(h for h, _ in rows)]),
                "at": np.concatenate([np.empty(0, np.int64), *(p for _, p in rows)]).astype(np.int32),
            })

    return records.mapInPandas(run, "doc long, h long, at int")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def matches(documents: DataFrame, least: int = LEAST, k: int = WINDOW, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of copies; pairs ``a, b`` of class representatives with a shared span; intervals ``doc, start, end`` of representatives.

    ``end`` is exclusive; intervals may overlap and touch.
    """
    members = written(classes(documents, least, key, text), "classes")
    reps = members.where("doc = rep").select("doc")
    records = _records(documents, least, key, text)
    side = least - k
    kept = written(_kept(records, least, k), "windows").join(reps, "doc", "left_semi")
    repeated = kept.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b").select("h", "n")
    hits = kept.join(repeated, "h")
    by_doc = hits.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "n")).alias("hits"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "h", "at", "n", "left", "mid", "right"]
        for batch in batches:
            out = []
            for doc, t, own in zip(batch["doc"], batch["text"], batch["hits"]):
                for x in own:
                    at = x["at"]
                    out.append((doc, x["h"], at, x["n"], t[max(0, at - side) : at], t[at : at + k], t[at + k : at + k + side]))
                    if len(out) == SLICE:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    first = records.dropDuplicates(["doc"])
    around = written(
        first.join(by_doc, "doc").mapInPandas(cut, "doc long, h long, at int, n long, left string, mid string, right string"), "around"
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, i, j, l1, l2, m1, m2, r1, r2 in batch.itertuples(index=False):
                if m1 != m2:
                    continue
                left, right = _common(l1[::-1], l2[::-1]), _common(r1, r2)
                if left + right >= side:
                    out.append((a, b, i - left, i + k + right, j - left, j + k + right))
            yield pd.DataFrame(out, columns=["a", "b", "a_start", "a_end", "b_start", "b_end"])

    few = around.where(F.col("n") <= FEW)
    x, y = (few.select(F.col("h").alias("h"), *(F.col(c).alias(f"{s}_{c}") for c in ("doc", "at", "left", "mid", "right"))) for s in "xy")
    found = written(
        x.join(y, "h").where("x_doc < y_doc")
        .select("x_doc", "y_doc", "x_at", "y_at", "x_left", "y_left", "x_mid", "y_mid", "x_right", "y_right")
        .mapInPandas(compare, "a long, b long, a_start int, a_end int, b_start int, b_end int"),
        "found",
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for doc, at, left, mid, right in batch[["doc", "at", "left", "mid", "right"]].itertuples(index=False):
                whole, start = left + mid + right, at - len(left)
                for i in range(len(whole) - least + 1):
                    out.append((doc, start + i, xxhash.xxh3_128_hexdigest(whole[i : i + least].encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(out, columns=["doc", "start", "same"])

    windows = around.where(F.col("n") > FEW).mapInPandas(split, "doc long, start int, same string")
    groups = windows.groupBy("same").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.countDistinct("doc").alias("n"), F.sum(F.xxhash64("doc").cast("decimal(30,0)")).alias("sum")).where("a < b")
    shared = written(windows.join(groups.select("same", "n", "sum"), "same"), "shared")
    # windows with one same set of records give the same pairs: one of them stands for all
    sets = shared.groupBy("n", "sum").agg(F.min("same").alias("same")).select("same")
    owners = shared.join(sets, "same", "left_semi").select("same", "doc", "n").distinct()
    many = _each_two(owners, "same", "doc").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = found.select("a", "b").unionByName(many).distinct()
    intervals = (
        found.select(F.col("a").alias("doc"), F.col("a_start").alias("start"), F.col("a_end").alias("end"))
        .unionByName(found.select(F.col("b").alias("doc"), F.col("b_start").alias("start"), F.col("b_end").alias("end")))
        .unionByName(shared.select("doc", "start", (F.col("start") + least).alias("end")))
    )
    return members, pairs, intervals


def _each_two(groups: DataFrame, key: str, member: str) -> DataFrame:
    """``x, y`` (x < y) of each group of rows ``key, member, n``, where ``n`` is the group's size.

    A group is cut into blocks of about BLOCK_OF members; a member stands on
    the left in its own block and on the right in every block, so that no task
    joins more than a block with its group. The number of rows is that of the
    pairs, which a list of pairs has to have.
    """
    blocks = _blocks("n")
    left = groups.select(key, F.col(member).alias("x"), F.pmod(F.xxhash64(member), blocks).cast("int").alias("block"))
    right = groups.select(key, F.col(member).alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return left.join(right, [key, "block"]).where("x < y").select("x", "y")


def shared_pairs(documents: DataFrame, least: int = LEAST, k: int = WINDOW) -> DataFrame:
    """``doc_a, doc_b`` (a < b): two records with a span of at least ``least`` characters in common."""
    members, pairs, _ = matches(documents, least, k)
    sized = members.join(members.groupBy("rep").agg(F.count("*").alias("n")), "rep").withColumn("block", F.pmod(F.xxhash64("doc"), _blocks("n")).cast("int"))
    # classes of many copies meet block by block
    blocks = sized.select("rep", F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("block")).distinct()
    across = pairs
    for end, doc in (("a", "x"), ("b", "y")):
        across = across.join(blocks.select(F.col("rep").alias(end), F.col("block").alias(f"block_{end}")), end)
    for end, doc in (("a", "x"), ("b", "y")):
        own = sized.select(F.col("rep").alias(end), F.col("block").alias(f"block_{end}"), F.col("doc").alias(doc))
        across = across.join(own, [end, f"block_{end}"])
    across = across.select("x", "y")
    within = _each_two(sized.where("n > 1"), "rep", "doc")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def _blocks(n: str):
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_OF)).cast("int")


def links(documents: DataFrame, least: int = LEAST, k: int = WINDOW) -> DataFrame:
    """``doc_id, class_id, n_links``: each record, the class of its exact copies (the smallest id) and with how many other records it shares a span.

    Links are counted between classes and weighed with their sizes, so copies
    are never paired. A record without a text of the least length is a class
    of its own without links.
    """
    members, pairs, _ = matches(documents, least, k)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = ends.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("n").alias("beyond"))
    counted = sizes.join(beyond.withColumnRenamed("a", "rep"), "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    known = members.join(counted, "rep").select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "n_links")
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known, "doc_id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def removal_intervals(documents: DataFrame, least: int = LEAST, k: int = WINDOW) -> DataFrame:
    """``doc_id, start, end``: maximal intervals of each record that also stand in other records."""
    members, _, intervals = matches(documents, least, k)
    copied = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("doc"))
    whole = (
        _records(documents, least, "doc_id", "text").join(copied, "doc", "left_semi")
        .select("doc", F.lit(0).alias("start"), F.length("text").alias("end")).distinct()
    )
    every = intervals.unionByName(whole).distinct()
    before = Window.partitionBy("doc").orderBy("start", "end")
    fresh = F.when(F.col("start") <= F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    merged = (
        every.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(before))
        .groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return members.join(merged.withColumnRenamed("doc", "rep"), "rep").select(F.col("doc").alias("doc_id"), "start", "end")


def shared_amount(documents: DataFrame, least: int = LEAST, k: int = WINDOW) -> DataFrame:
    """``doc_id, n_chars, n_spans, shared_chars, share``: how much of each record stands in others too."""
    spans = removal_intervals(documents, least, k).groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars")
    )
    sizes = documents.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))
    some = F.coalesce(F.col("shared_chars"), F.lit(0))
    return sizes.join(spans, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), some.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, some / F.col("n_chars")).otherwise(0.0).alias("share"),
    )
