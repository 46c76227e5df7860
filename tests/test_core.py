"""Core operators against plain Python on small fixtures, with the awkward cases."""

import glob
import io
import os
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import planes as P
from pageloom.functions import text as T
from pageloom.operators import base as B
from pageloom.operators import context as C
from pageloom.operators import detection as D
from pageloom.operators import documents as O
from pageloom.operators import images as I
from pageloom.operators import jobs as J
from pageloom import session
from pageloom.sources import archives, backends, files, pdf
from pageloom.streaming import jobs as streaming
from pageloom.sources import settings as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- text ---------------------------------------------------------------------


def test_matching_form():
    assert T.matching_form(None) == "" and T.matching_form("") == ""
    assert T.matching_form("  É\tß  Ａb ﬁ ") == "e ss ab fi"
    assert T.matching_form("أَلِفـ") == "الف"


def repaired(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r["r"] for r in df.select("k", T.repair_text("t").alias("r")).orderBy("k").collect()]


def test_repair_turns_only_what_gains_words(spark):
    # two runs of letters, each from its end to its start, and in between the marks in their own order
    line, turned = "الاسم الكامل نادية 12/05/2020 a.b@c.test", "a.b@c.test 12/05/2020 ةيدان لماكلا مسالا"
    given = [turned, line, "plain\r\ntext", None, "", f"{turned}\n\u200eab\n{line}\n", "مس\u202e", "رقم"]
    assert repaired(spark, given) == [line, line, "plain\r\ntext", "", "", f"{line}\nab\n{line}", "مس", "رقم"]


def test_arabic_word_score(spark):
    df = spark.createDataFrame([(0, "الهاتف رقم رقم"), (1, "plain"), (2, None), (3, "\ufead\ufed7\ufee2"), (4, "رَقْم")], "k int, t string")
    assert rows(df.select("k", T.arabic_word_score("t").alias("n"))) == [(0, 2), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_reverse_line(spark):
    cases = {"": "", "abc": "abc", "الاسم 12/05 x": "x 12/05 مسالا", "م a.b@c ن": "ن a.b@c م", "12": "12", "ab مم cd": "cd مم ab"}
    got = spark.createDataFrame([(x,) for x in cases], "t string").select("t", T.reverse_line(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases


def test_budget_and_ratio(spark):
    cases = {"": 4.0, "abc": 4.0, "é" * 10 + "a" * 90: 3.0, "ا" * 50 + "a" * 50: 1.8, "漢" * 50 + "a": 1.2}
    got = spark.createDataFrame([(x,) for x in [*cases, None]], "t string").select("t", T.chars_per_token(F.col("t")).alias("r"), T.budget_characters(F.col("t")).alias("b")).collect()
    for r in got:
        ratio = cases.get(r["t"] or "")
        assert r["r"] == ratio and r["b"] == max(min(18000, int(3500 * ratio)), 1000)


def test_lines_page_modes_origins_flags(spark):
    df = spark.createDataFrame([("a\r\n\n  b \tc  d", "6, 11;99 x 13", "a, b,,"), (None, None, None), ("", "", "x,*")], "t string, m string, o string")
    got = [tuple(r) for r in df.select(T.lines_of(F.col("t")), T.page_modes(F.col("m")), T.allowed_origins(F.col("o"))).collect()]
    assert got == [(["a", "b c", "d"], [6, 11, 13], ["a", "b"]), ([], [], []), ([], [], ["*"])]
    flags = spark.createDataFrame([(" Yes ",), ("0",), (None,), ("on",)], "v string").select(T.truthy(F.col("v")).alias("f"))
    assert [r["f"] for r in flags.collect()] == [True, False, False, True]


# --- excerpts -----------------------------------------------------------------


def merged_plainly(windows):
    out = []
    for key in sorted({w[:2] for w in windows}):
        spans = sorted(w[2:] for w in windows if w[:2] == key)
        a, b = spans[0]
        for c, d in spans[1:]:
            if c <= b + 1:
                b = max(b, d)
            else:
                out.append((*key, a, b))
                a, b = c, d
        out.append((*key, a, b))
    return sorted(out)


def test_merge_bridges_one_line(spark):
    rng = random.Random(3)
    windows = [(d, p, s, s + rng.randint(1, 6)) for d in range(4) for p in range(3) for s in rng.sample(range(60), 8)] + [(9, 1, 0, 3), (9, 1, 4, 6), (9, 1, 8, 9)]
    df = spark.createDataFrame(windows, "doc_id long, page int, start int, end int")
    assert rows(C.merged(df)) == merged_plainly(windows)
    assert C.merged(df.where("false")).count() == 0


def test_fill_passes_over_what_does_not_fit(spark):
    rng = random.Random(5)
    data, want = [], {}
    for doc in range(30):
        used, kept, cut = 0, 0, False
        for k in range(rng.randint(1, 12)):
            size = rng.randint(1, 60)
            data.append((doc, k, 1, k, k + 1, size))
            if used + size > 100:
                cut = True
            else:
                used, kept = used + size, kept + 1
        want[doc] = (kept, used, cut)
    df = spark.createDataFrame(data, "doc_id long, priority int, page int, start int, end int, size int")
    got = {r["doc_id"]: (len(r["kept"]), r["used"], r["truncated"]) for r in C.fill(df, F.lit(100)).collect()}
    assert got == want


def context_plainly(pages, labels, budget_cap):
    own = []
    for page, text in sorted(pages.items()):
        lines = [" ".join(x.replace(" ", " ").split()) for x in (text or "").splitlines()]
        own.append((page, [x for x in lines if x]))
    whole = "\n".join(f"<<<PAGE {p}>>>\n" + "\n".join(ls) for p, ls in own if ls)
    budget = max(min(budget_cap, 14000), min(1000, budget_cap))
    if not whole:
        return "", "full", False
    if len(whole) <= budget:
        return whole, "full", False
    windows = []
    first = next((p, ls) for p, ls in own if ls)
    windows.append((first[0], 0, min(12, len(first[1]))))
    for label in labels:
        for term in label.terms:
            hits = [(p, max(0, i - 4), min(len(ls), i + 7)) for p, ls in own for i, x in enumerate(ls) if T.matching_form(term) in T.matching_form(x)]
            if hits:
                windows += hits
                break
    by, used, kept, cut = dict(own), 0, [], False
    for p, a, b in windows:
        size = sum(len(x) + 1 for x in by[p][a:b]) + 16
        if used + size > budget:
            cut = True
        else:
            used += size
            kept.append((0, p, a, b))
    chunks, last = [], None
    for _, p, a, b in merged_plainly(kept):
        chunks += [f"<<<PAGE {p}>>>" if p != last else "[...]", "\n".join(by[p][a:b])]
        last = p
    return "\n".join(chunks), "selected", cut


def test_build_context(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta registre invoice archive plain text lines".split()
    data = {}
    for doc in range(12):
        for page in range(1, rng.randint(2, 6)):
            n = 0 if rng.random() < 0.1 else rng.randint(1, 40)
            data[doc, page] = "\n".join(" ".join(rng.choices(words[:4] if rng.random() < 0.93 else words, k=6)) for _ in range(n)) or None
    df = spark.createDataFrame([(d, p, t) for (d, p), t in data.items()], "doc_id long, page int, text string")
    labels = (C.Label("a", ("registre",)), C.Label("b", ("missing term", "invoice", "archive")))
    got = {r["doc_id"]: r for r in C.build_context(df, labels, max_characters=1500).collect()}
    for doc in {d for d, _ in data}:
        text, strategy, cut = context_plainly({p: t for (d, p), t in data.items() if d == doc}, labels, 1500)
        r = got[doc]
        assert (r["text"], r["strategy"], r["truncated"]) == (text, strategy, cut)
        assert r["characters"] == len(text)


# --- detection ----------------------------------------------------------------


def test_nearest_finding_equals_brute_force(spark):
    rng = random.Random(2)
    pages = [(d, p) for d in range(5) for p in rng.sample(range(1, 200), 60)]
    found = [(d, p) for d in range(4) for p in rng.sample(range(1, 200), 9)]
    got = rows(D.nearest_findings(spark.createDataFrame(pages, "doc_id long, page int"), spark.createDataFrame(found, "doc_id long, page int"), block=16))
    want = sorted((d, p, min((abs(q - p), q) for e, q in found if e == d)[1]) for d, p in pages if any(e == d for e, _ in found))
    assert got == want


def test_merge_languages_ties_and_order(spark):
    df = spark.createDataFrame([(1, 1, "ara+fra"), (1, 2, "fra"), (1, 3, "eng"), (1, 4, "deu"), (2, 1, "spa"), (2, 2, None)], "doc_id long, page int, lang string")
    assert rows(D.merge_languages(df)) == [(1, "fra+ara+eng"), (2, "spa")]


def test_sampling_and_dpi(spark):
    df = spark.createDataFrame([([1],), (list(range(1, 14)),), ([1, 2, 3, 4],), ([],)], "p array<int>")
    got = [tuple(r) for r in df.select(D.sampled(F.col("p")), D.detection_pages(F.col("p"), F.lit("auto")), D.median_dpi(F.col("p"))).collect()]
    assert got == [([1], [1], 300), ([1, 7, 13], [1, 7, 13], 300), ([1, 3, 4], [1, 2, 3, 4], 300), ([], [], 300)]


def test_equal_scores_favour_the_later_code(spark):
    data = [(1, 1, k, lang, 90.0, "abcdef") for k, lang in enumerate(["eng", "fra", "deu"])] + [(1, 1, 9, "eng", -1.0, "x"), (1, 1, 10, None, 50.0, None)]
    df = spark.createDataFrame(data, "doc_id long, page int, tok_no int, lang string, conf double, text string")
    assert rows(D.picked(D.scored(df))) == [(1, 1, "Latin", "fra+eng")]


# --- documents, names, jobs ---------------------------------------------------


def test_text_threshold_and_work_list(spark):
    pages = spark.createDataFrame([(1, 1, " " + "a" * 19 + "\n"), (1, 2, " " + "a" * 20), (1, 3, None)], "doc_id long, page int, text string")
    docs = spark.createDataFrame([(1, 4), (2, None), (3, 0)], "doc_id long, page_count int")
    assert rows(O.pages_with_text(pages)) == [(1, 2)]
    assert rows(O.work_list(docs, pages)) == [(1, 1), (1, 3), (1, 4)]
    assert rows(O.assembled(docs, pages.withColumn("extra", F.lit(1)))) == [(1, " " + "a" * 19 + "\n\n\n " + "a" * 20 + "\n\n\n\n")]


def test_names_apart(spark):
    cases = [["a.pdf", "A.pdf", "a (2).pdf", "a.pdf"], ["x", "x", "X"], ["..", "", None, "d/e\\..\\f?.pdf"], ["b.pdf"] * 4, ["c (2).pdf", "c.pdf", "c.pdf"]]
    data = [(str(b), i, n) for b, names in enumerate(cases) for i, n in enumerate(names)]
    got = rows(O.safe_names(spark.createDataFrame(data, "batch_id string, ord int, filename string")))
    for b, names in enumerate(cases):
        bare = [{"..": "document.pdf", "": "document.pdf", None: "document.pdf", "d/e\\..\\f?.pdf": "f.pdf"}.get(n, n) for n in names]
        assert [r[3] for r in sorted((x for x in got if x[0] == str(b)), key=lambda x: x[1])] == O.named_apart(bare)
    assert O.named_apart(["a.pdf", "A.pdf", "a (2).pdf"]) == ["a.pdf", "A (2).pdf", "a (2) (2).pdf"]


def test_modal_mode_and_averages(spark):
    df = spark.createDataFrame([(1, 1, 0.1, None, 0.0, 0.0, False, "gray"), (1, 2, 0.3, 0.2, 0.0, 0.0, True, "color")], "doc_id long, page int, paper_std double, background_spread double, contrast double, chroma double, scaled boolean, mode string")
    r = O.document_averages(df).first()
    assert (r["mode"], r["paper_std"], r["background_spread"], r["scaled"]) == ("gray", 0.2, 0.1, True)


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", "2024-01-01 00:30:00"), ("b", "2024-01-01 00:00:00", "2024-01-01 00:29:59"), ("c", "2023-12-31 20:59:00", None), ("d", None, None)], "job_id string, c string, f string").select("job_id", F.col("c").cast("timestamp").alias("created_at"), F.col("f").cast("timestamp").alias("finished_at"))
    assert rows(J.expired(df, F.lit("2024-01-01 01:00:00").cast("timestamp"))) == [("b",), ("c",)]


def test_queue_depth_equals_running_sum(spark):
    data = [(str(k), f"2024-01-01 0{k % 6}:1{k % 5}:00", f"2024-01-01 0{k % 6 + 2}:00:3{k % 7}" if k % 4 else None) for k in range(40)]
    df = spark.createDataFrame(data, "job_id string, c string, f string").select("job_id", F.col("c").cast("timestamp").alias("created_at"), F.col("f").cast("timestamp").alias("finished_at"))
    events = {}
    for _, c, f in data:
        events[c] = events.get(c, 0) + 1
        if f:
            events[f] = events.get(f, 0) - 1
    depth, want = 0, []
    for at in sorted(events):
        depth += events[at]
        want.append((at, depth))
    got = [(r["at"].strftime("%Y-%m-%d %H:%M:%S"), r["depth"]) for r in J.queue_depth(df).orderBy("at").collect()]
    assert got == want


# --- planes and images --------------------------------------------------------


def window_plainly(plane, h, w, f):
    py, px = h // 2, w // 2
    wide = np.pad(plane, ((py, h - 1 - py), (px, w - 1 - px)), mode="symmetric")
    return np.array([[f(wide[y : y + h, x : x + w]) for x in range(plane.shape[1])] for y in range(plane.shape[0])])


def test_rank_filters_and_means():
    plane = np.random.default_rng(0).integers(0, 255, (23, 31)).astype(np.float32)
    assert np.array_equal(P.extreme(P.extreme(plane, 5, 0, True), 7, 1, True), window_plainly(plane, 5, 7, np.max))
    assert np.array_equal(P.extreme(P.extreme(plane, 9, 0, False), 1, 1, False), window_plainly(plane, 9, 1, np.min))
    assert np.allclose(P.box_mean(plane, 5), window_plainly(plane, 5, 5, np.mean), atol=1e-3)


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=25, deadline=None)
def test_labels_equal_flood_fill(seed):
    mask = np.random.default_rng(seed).random((14, 17)) < 0.45
    marks, n = P.labels(mask)
    seen, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            seen[y, x] = count
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(14, a + 2)):
                    for d in range(max(0, b - 1), min(17, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = count
                            todo.append((c, d))
    assert n == count and len({(a, b) for a, b in zip(marks[mask], seen[mask])}) == count and not marks[~mask].any()


def test_parts_of_a_full_page_need_little_memory():
    import tracemalloc

    mask = np.zeros((2600, 1838), bool)
    for y in range(20, 2580, 30):
        for x in range(20, 1800, 20):
            mask[y : y + 12, x : x + 9] = True
    tracemalloc.start()
    own = P.parts(mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(own) == len(range(20, 2580, 30)) * len(range(20, 1800, 20)) > 7_000 and (own.area == 108).all() and (own.width == 9).all()
    assert peak < 500e6
    assert own.painted(np.arange(len(own)) == 0).sum() == 108


def resample_plainly(row, size, kernel, reach):
    """Weights of each output sample by the kernel's definition, without whole numbers."""
    n, out = len(row), []
    wide = max(n / size, 1.0)
    for i in range(size):
        centre = (i + 0.5) * n / size
        low, high = max(0, int(centre - reach * wide + 0.5)), min(n, int(centre + reach * wide + 0.5))
        w = [kernel((k + 0.5 - centre) / wide) for k in range(low, high)]
        out.append(sum(a * b for a, b in zip(w, row[low:high])) / sum(w))
    return np.clip(np.floor(np.array(out) + 0.5), 0, 255)


def test_resampling_equals_its_definition():
    import math

    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    kernels = {"lanczos": (lambda x: sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0, 3), "bilinear": (lambda x: max(0.0, 1 - abs(x)), 1), "box": (lambda x: 1.0 if -0.5 < x <= 0.5 else 0.0, 0.5)}
    row = np.random.default_rng(5).integers(0, 256, 97)
    for name, (kernel, reach) in kernels.items():
        for size in (31, 60, 97, 240):
            got = P.resample(np.tile(row, (3, 1)).astype(np.uint8), (3, size), name)
            want = row if size == 97 else resample_plainly(row.tolist(), size, kernel, reach)
            assert np.abs(got[1].astype(int) - want).max() <= 1 and (got[0] == got[2]).all()
            assert (P.resample(np.tile(row[:, None], (1, 3)).astype(np.uint8), (size, 3), name)[:, 1] == got[1]).all()


def test_colour_of_a_large_page_is_seen_in_its_thumbnail():
    page = np.full((3508, 2480, 3), 230, np.uint8)
    assert P.thumbnail(page, 400).shape == (400, 283, 3) and not I.has_colour(page)
    page[100:300, 100:300] = (200, 40, 40)
    assert I.has_colour(page)
    few = np.full((3508, 2480, 3), 230, np.uint8)
    few[10, 10] = (255, 0, 0)  # one pixel is lost in the thumbnail
    assert not I.has_colour(few)


def paper(h, w, seed, sd, base):
    y, x = np.mgrid[0:h, 0:w]
    return base(y, x) + np.random.default_rng(seed).normal(0, sd, (h, w))


def test_gray_keeps_content():
    y, x = np.mgrid[0:180, 0:180]
    page = np.clip(200 + 30 * np.sin(x / 22) + 18 * np.cos(y / 30), 150, 230)
    page[62:75, 42:65], page[82:94, 92:110] = 105, 127
    page = np.clip(page + np.random.default_rng(0).normal(0, 4, page.shape), 0, 255)
    out = I.clean_page(np.dstack([page] * 3).astype(np.uint8), "gray")[0][..., 0]
    content = np.concatenate([out[62:75, 42:65].ravel(), out[82:94, 92:110].ravel()])
    paper_level = out[out > 220].mean()
    assert paper_level > 240 and content.mean() < paper_level - 15 and content.min() > 100


def test_fold_corner_band_masks():
    y, x = np.mgrid[0:200, 0:200]
    field = 200 + 12 * np.sin(x / 45)
    field[80:110] -= 20
    zone = I.fold_zone(I.luma_background(np.floor(np.clip(field, 0, 255))))
    assert zone[85:105, 20:180].mean() > 0.4 and zone[10:50, 20:180].mean() < 0.05 and zone[115:170].mean() < 0.05
    y, x = np.mgrid[0:300, 0:300]
    luma = 235 - 42 * np.exp(-(((x + y) / 12) ** 2)) + np.random.default_rng(3).normal(0, 0.6, (300, 300))
    mask = I.corner_shadows(luma, np.full((300, 300), 235.0))
    assert mask[:24, :24].mean() > 0.05 and mask[120:, 120:].mean() < 0.005
    luma = np.full((260, 360), 238.0) + np.random.default_rng(4).normal(0, 0.5, (260, 360))
    luma[115:119, 20:340] -= 18
    luma[70:105, 90:96] = 70
    band = I.band_streaks(luma, np.full((260, 360), 238.0))
    assert band[115:119, 40:330].mean() > 0.25 and band[65:110, 80:135].mean() < 0.03


def test_fold_ink_is_selective():
    l2, fold, chroma = np.full((200, 200), 255.0), np.zeros((200, 200), bool), np.zeros((200, 200))
    fold[70:105] = True
    l2[82:92, 40:44] = l2[150:160, 40:44] = 90
    l2[75:83, 120:132] = l2[120:128, 150:160] = 185
    l2[74:80, 60:74], chroma[74:80, 60:74] = 185, 110
    mask = I.fold_ink(l2, fold, np.ones_like(fold), chroma)
    assert mask[75:83, 120:132].all() and not mask[120:128, 150:160].any() and not mask[82:92, 40:44].any() and not mask[74:80, 60:74].any()


def test_document_mode_and_bad_bytes(spark):
    luma = paper(260, 360, 9, 2, lambda y, x: 188 + 28 * np.sin(x / 43) + 18 * np.cos(y / 37) - 24 * ((y >= 112) & (y < 132)))
    luma[55:105, 85:91], luma[55:105, 125:131], luma[175:188, 180:250] = 55, 65, 70
    rgb = np.repeat(np.clip(luma, 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    out = I.clean_page(rgb, "document")[0]
    back = np.ones((260, 360), bool)
    back[55:105, 85:91] = back[55:105, 125:131] = back[175:188, 180:250] = False
    assert out[..., 0][back].mean() > 247 and out[55:105, 85:91].mean() < 180 and out[55:105, 125:131].mean() < 190
    df = spark.createDataFrame([(1, 1, 4, 4, b"short"), (1, 2, None, None, None)], "doc_id long, page int, height int, width int, data binary")
    assert [r["error"] for r in I.clean_pages(df).collect()] == ["clean_render_failed"] * 2


def test_specks_stay_unless_asked():
    dark = np.zeros((40, 40), bool)
    dark[5, 5], dark[20:30, 20:30] = True, True
    assert not I.tiny_specks(dark).any()
    assert I.tiny_specks(dark, I.Settings(remove_specks=True))[5, 5]


def plan_of(spark, name):
    from pageloom.plans import catalogue

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return catalogue.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_a_document_are_cleaned_once(spark):
    assert plan_of(spark, "P24_clean_document").count("MapInPandas") == 2  # drawn, and cleaned


def test_averages_measure_pages_once_and_alike(spark):
    assert plan_of(spark, "A2_document_averages").count("MapInPandas") == 2
    rng = np.random.default_rng(2)
    pages = [(1, k, 90, 120, rng.integers(0, 256, 90 * 120 * 3).astype(np.uint8).tobytes()) for k in range(3)] + [(1, 3, 400, 90, bytes([250, 240, 120]) * 36000), (1, 4, 4, 4, b"short"), (1, 5, None, None, None)]
    df = spark.createDataFrame(pages, "doc_id long, page int, height int, width int, data binary")
    for settings_ in (I.DEFAULTS, I.Settings(max_edge=100), I.Settings(enabled=False)):
        measured, cleaned = I.measure_pages(df, s=settings_), I.clean_pages(df, s=settings_)
        assert "data" not in measured.columns and sorted(measured.collect()) == sorted(cleaned.select(measured.columns).collect())


def test_modal_mode_measures_pages_once(spark):
    assert plan_of(spark, "A3_modal_mode").count("MapInPandas") == 2


def test_figures_are_taken_where_pages_are_drawn(spark):
    assert plan_of(spark, "P22_colour_blend").count("MapInPandas") == 1  # no image is handed on


def test_equal_images_are_worked_out_once():
    seen = []
    once = I.Once(lambda a: seen.append(a.shape) or (int(a.sum()),), most=2000)
    white, other = b"\xff" * 300, b"\xff" * 299 + b"\xfe"
    assert [once(white, 10, 10), once(other, 10, 10), once(white, 10, 10), once(white, 5, 20)] == [(76500,), (76499,), (76500,), (76500,)]
    assert seen == [(10, 10, 3), (10, 10, 3), (5, 20, 3)]
    for k in range(50):
        assert once(bytes([k]) * 300, 10, 10) == (300 * k,)
    assert once.held <= 2000 and len(once.kept) == 5
    with pytest.raises(ValueError):
        once(b"short", 4, 4)


@pytest.mark.parametrize("shape, sigma, order, mode", [((70, 300), 1.2, 1, "reflect"), ((70, 300), 6.0, 0, "nearest"), ((130, 9), 6.0, 1, "reflect"), ((20, 600), 32.0, 0, "nearest"), ((3, 4), 6.0, 0, "reflect")])
def test_smoothing_equals_plain_sums(shape, sigma, order, mode):
    plane = np.random.default_rng(1).integers(0, 256, shape).astype(np.float32)
    w = P._weights(sigma, order)[:: -1 if order else 1]
    for axis in (0, 1):
        wide = np.pad(plane.astype(float), [(len(w) // 2,) * 2 if k == axis else (0, 0) for k in (0, 1)], mode={"nearest": "edge", "reflect": "symmetric"}[mode])
        want = np.apply_along_axis(lambda line: np.convolve(line, w[::-1], "valid"), axis, wide)
        assert np.allclose(P._filtered(plane, sigma, order, axis, mode), want, atol=1e-4)
    even = np.full(shape, 231.3, np.float32)
    assert (P.smooth(even, sigma, mode) == even).all()


# --- files --------------------------------------------------------------------


def archive_bytes(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = archive_bytes([("in/a.pdf", b"1"), ("A.PDF", b"22"), ("__MACOSX/x.pdf", b"3"), (".b.pdf", b"4"), ("c.txt", b"5"), ("a (2).pdf", b"6")])
    cases = {"good": good, "empty": archive_bytes([("c.txt", b"")]), "bad": b"no zip", "bomb": archive_bytes([("z.pdf", b"0" * 3_000_000)])}
    for name, content in cases.items():
        (tmp_path / f"{name}.zip").write_bytes(content)
    spark.dataSource.register(archives.ZipSource)
    for df in (archives.entries_of(spark.read.format("binaryFile").load(str(tmp_path))), spark.read.format("pageloom_zip").load(f"{tmp_path}/*.zip")):
        got = {(r["archive"].rsplit("/", 1)[-1], r["name"], r["error"]) for r in df.collect()}
        assert got == {("good.zip", "a.pdf", None), ("good.zip", "A (2).PDF", None), ("good.zip", "a (2) (2).pdf", None), ("empty.zip", None, "empty_zip"), ("bad.zip", None, "corrupt_zip"), ("bomb.zip", None, "suspicious_zip")}


def test_digits_are_read_from_pixels():
    for text in ("7000000123 4", "0123456789 1", "11 17 71", "8"):
        assert backends.DigitRecogniser().read_image(I.prepared(backends.drawn_digits(text)), "eng", 300, 3) == text
    assert backends.DigitRecogniser().read_image(np.full((40, 40, 3), 255, np.uint8), "eng", 300, 3) == ""
    noisy = np.clip(backends.drawn_digits("90 12\n345", 4) + np.random.default_rng(1).normal(0, 12, (120, 160, 1))[: 40 + 80, : 40 + 120], 0, 255).astype(np.uint8)
    assert backends.DigitRecogniser().read_image(noisy, "eng", 300, 3) == "90 12\n345"


def test_commands_get_and_give_through_pipes(tmp_path, monkeypatch):
    def command(name, body):
        file = tmp_path / name
        file.write_text("#!/bin/sh\n" + body)
        file.chmod(0o755)

    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert isinstance(backends.recogniser(), backends.DigitRecogniser) and isinstance(backends.renderer(), backends.BlankRenderer) and backends.system_packs() is None
    command("tesseract", 'if [ "$1" = --list-langs ]; then printf "List of available languages (3):\\neng\\nosd\\nara\\n"; else head -c 2; echo " $*"; fi\n')
    command("pdftoppm", 'cat > /dev/null; printf "P6\\n# made here\\n2 1\\n255\\nabcdef"\n')
    assert backends.system_packs() == ["ara", "eng"]
    page = backends.renderer().render(b"%PDF", 3, 150)
    assert page.shape == (1, 2, 3) and page.tobytes() == b"abcdef"
    assert backends.recogniser().read_image(page, "eng+ara", 200, 6) == "P6 stdin stdout -l eng+ara --dpi 200 --psm 6\n"
    command("tesseract", "exit 3\n")
    assert backends.recogniser().read_image(page, "eng", 200, 6) == "" and backends.system_packs() is None


def test_files_stand_under_their_names_only_when_whole(tmp_path):
    for folder in (f"{tmp_path}/a b", f"file://{tmp_path}/c"):
        with files.written_file(folder, "x.bin") as out:
            out.write(b"12")
            assert not glob.glob(f"{tmp_path}/*/x.bin") or folder.startswith("file")
        with pytest.raises(ValueError), files.written_file(folder, "y.bin") as out:
            out.write(b"1")
            raise ValueError
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/*/*")) == ["x.bin", "x.bin"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://somewhere:7077", "x"

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_folder(Session)


def test_stream_state_expires():
    class State:
        exists, hasTimedOut, removed = True, True, False

        def remove(self):
            self.removed = True

    state = State()
    assert list(streaming._close(("a",), iter(()), state)) == [] and state.removed


def test_pdf_round_trip():
    out = io.BytesIO()
    writer = pdf.PdfWriter(out)
    texts = ["héllo\nمرحبا", "", "日本 😀"]
    for t in texts:
        writer.page(t)
    writer.page("over an image", 100, 50, bytes(12), (2, 2))
    writer.close()
    got = list(pdf.read_pages(out.getvalue()))
    assert [g[3] for g in got] == [*texts, "over an image"] and got[3][1:3] == (100.0, 50.0)
    assert list(pdf.read_pages(b"broken")) == [] and list(pdf.read_pages(None)) == []


def test_settings_fall_back(monkeypatch):
    monkeypatch.setenv("PAGELOOM_MAX_MB", "x")
    monkeypatch.setenv("PAGELOOM_MAX_BATCH_MB", "7")
    limits = S.Limits.from_environment()
    assert (limits.max_mb, limits.max_batch_mb) == (100, 100) and S.decimal("PAGELOOM_NONE", 1.5) == 1.5


# --- queries ------------------------------------------------------------------


def test_queries_match_their_sql(spark):
    """Every native query equals its SQL on the smallest tables."""
    import glob
    import os

    import duckdb

    from pageloom.plans import catalogue

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    queries, wrong = catalogue.queries(), []

    def plain(frame):
        frame = frame[sorted(frame.columns)].map(lambda v: str([getattr(x, "item", lambda x=x: x)() for x in v]) if isinstance(v, (list, np.ndarray)) else v)
        return sorted(tuple("" if not isinstance(v, (list, np.ndarray)) and pd.isna(v) else str(round(float(v), 5)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r) for r in frame.itertuples(index=False))

    for name, sql in catalogue.oracle_sql().items():
        if name.startswith(("S1_", "S3_", "K1_", "K3_", "T1_job_stream")):
            continue
        if plain(queries[name](spark, folder).toPandas()) != plain(con.execute(sql).fetch_df()):
            wrong.append(name)
    assert not wrong


def test_empty_tables(spark, tmp_path):
    """Queries over empty tables give empty results of the same columns."""
    import os

    from pageloom.plans import catalogue

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    for t in ("documents", "ocr_job", "ocr_document", "page_text", "ocr_token", "page_finding", "upload_file", "lang_sample"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in catalogue.queries().items():
        if name[:3] in ("S8_", "J7_", "P12", "K10") or "_stream" in name or name.startswith(("K", "S", "P")):
            continue
        assert query(spark, str(tmp_path)).count() == 0, name


def test_base_views_take_the_latest(spark):
    df = spark.createDataFrame([(1, "running", 1, None, "2024-01-01"), (1, "done", 3, 9, "2024-01-02"), (1, "done", 3, 9, "2024-01-02"), (2, "error", None, None, None)], "doc_id long, status string, pages_done int, chars_after int, seen_at string")
    assert rows(B.latest_documents(df).select("doc_id", "status")) == [(1, "done"), (2, "error")]
