"""Which language and script a page has, from recognised tokens and sampled findings."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import base as B
from pageloom.sources.backends import system_packs

#: Packs of each script, the likelier first.
SCRIPT_PACKS = {
    "Latin": ["eng", "fra", "spa", "deu", "por", "ita", "nld"],
    "Arabic": ["ara", "fas", "urd"],
    "Cyrillic": ["rus", "ukr", "bul"],
    "Han": ["chi_sim", "chi_tra"],
    "HanS": ["chi_sim"],
    "HanT": ["chi_tra"],
    "Japanese": ["jpn"],
    "Hangul": ["kor"],
    "Greek": ["ell"],
    "Hebrew": ["heb"],
    "Thai": ["tha"],
    "Devanagari": ["hin"],
}
#: Scripts that share a page with another.
PARTNERS = {"Latin": ["Arabic"], "Arabic": ["Latin"], "Cyrillic": ["Latin"], "Greek": ["Latin"], "Hebrew": ["Latin"]}
#: Packs taken for installed where no recogniser can be asked; packs that only describe a page are no languages.
INSTALLED = ("ara", "chi_sim", "deu", "ell", "eng", "equ", "fra", "hin", "jpn", "osd", "por", "rus", "spa", "tha")
MIN_CHARS, MIN_CONF, MIN_SHARE, CLOSE = 12, 55, 0.25, 0.93


@lru_cache(maxsize=1)
def _of_system() -> tuple[str, ...]:
    return tuple(system_packs() or INSTALLED)


def installed(packs=None) -> list[str]:
    """Installed languages, by default those of this machine's recogniser; English if none is known."""
    return sorted(set(_of_system() if packs is None else packs) - {"osd", "equ"}) or ["eng"]


def catalogue(spark) -> DataFrame:
    """``script, pack, pack_pos``: the fixed table of scripts and packs (fewer than 30 rows)."""
    rows = [(s, p, i) for s, packs in SCRIPT_PACKS.items() for i, p in enumerate(packs)]
    return spark.createDataFrame(rows, "script string, pack string, pack_pos int")


def script_groups(spark, packs=None) -> DataFrame:
    """``script, pack, pack_pos``: installed packs of the scripts that characters can prove, in order."""
    have = catalogue(spark).where(F.col("script").isin(*T.SCRIPTS) & F.col("pack").isin(*installed(packs)))
    return have.withColumn("pack_pos", (F.row_number().over(Window.partitionBy("script").orderBy("pack_pos")) - 1).cast("int"))


def _first_pack(lang: str) -> Column:
    return F.lower(F.try_element_at(T.packs_of(F.col(lang)), F.lit(1)))


def scored(tokens: DataFrame) -> DataFrame:
    """``doc_id, page, script, pack, score, n_chars, evidence`` by page and each script of the table.

    Score: mean confidence of tokens that hold characters of the script,
    weighted by how many, up to 400. Evidence: characters in tokens recognised
    with some confidence. A null or not positive confidence and a blank text
    don't count.
    """
    own = tokens.withColumn("pack", _first_pack("lang")).where(F.col("conf").isNotNull() & F.col("text").isNotNull() & (B.stripped(F.col("text")) != ""))
    counts = F.array(*(F.struct(F.lit(k).alias("script"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in T.SCRIPTS.items()))
    each = own.withColumn("x", F.explode(counts)).select("doc_id", "page", "pack", "conf", F.col("x.script").alias("script"), F.col("x.n").alias("n"))
    good = (F.col("conf") > 0) & (F.col("n") > 0)
    return each.groupBy("doc_id", "page", "pack", "script").agg(
        F.round(F.coalesce(F.sum(F.when(good, F.col("conf").cast("decimal(12,4)"))).cast("double") / F.count_if(good) * F.least(F.sum(F.when(good, F.col("n")).otherwise(0)), F.lit(400)) / 400, F.lit(0.0)), 6).alias("score"),
        F.sum(F.when(good, F.col("n")).otherwise(0)).cast("long").alias("n_chars"),
        F.sum(F.when(F.col("conf") >= MIN_CONF, F.col("n")).otherwise(0)).cast("long").alias("evidence"),
    )


def measured(scores: DataFrame) -> DataFrame:
    """``doc_id, page, script, chars``: the most characters that one of the script's first two packs recognised."""
    groups = F.broadcast(script_groups(scores.sparkSession).where("pack_pos < 2").select("script", "pack"))
    return scores.join(groups, ["script", "pack"]).groupBy("doc_id", "page", "script").agg(F.max("evidence").alias("chars"))


def picked(scores: DataFrame) -> DataFrame:
    """``doc_id, page, script, lang``: the best of the script's first four packs, or the best two if close.

    Of equal scores the later code leads.
    """
    groups = F.broadcast(script_groups(scores.sparkSession).where("pack_pos < 4").select("script", "pack"))
    ranked = scores.join(groups, ["script", "pack"]).groupBy("doc_id", "page", "script").agg(F.sort_array(F.collect_list(F.struct("score", "pack")), asc=False).alias("r"))
    close = F.try_element_at("r", F.lit(2))["score"] > F.element_at("r", 1)["score"] * CLOSE
    return ranked.select("doc_id", "page", "script", F.when(F.coalesce(close, F.lit(False)), F.concat_ws("+", F.element_at("r", 1)["pack"], F.try_element_at("r", F.lit(2))["pack"])).otherwise(F.element_at("r", 1)["pack"]).alias("lang"))


def ranked_scripts(chars: DataFrame, hints: DataFrame) -> DataFrame:
    """``doc_id, page, primary_script, primary_chars, secondary_script``.

    ``hints``: ``doc_id, page, script``; the hint leads if it has nearly as many
    characters. A second script must be a partner with enough of its own.
    """
    position = F.array_position(F.array(*map(F.lit, T.SCRIPTS)), F.col("script")).cast("int")
    listed = chars.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("less"), position.alias("pos"), "script", "chars"))).alias("r")
    )
    hinted = listed.join(hints.select("doc_id", "page", F.col("script").alias("hint")), ["doc_id", "page"], "left")
    top, own = F.element_at("r", 1), F.try_element_at(F.filter("r", lambda x: x["script"] == F.col("hint")), F.lit(1))
    lead = F.when(own["chars"] >= top["chars"] * 0.8, own).otherwise(top)
    partners = F.create_map(*(x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    first = hinted.withColumn("lead", lead).withColumn("partners", F.coalesce(partners[F.col("lead.script")], F.array().cast("array<string>")))
    other = F.filter("r", lambda x: (x["script"] != F.col("lead.script")) & F.array_contains(F.col("partners"), x["script"]) & (x["chars"] >= MIN_CHARS) & (x["chars"] >= F.col("lead.chars") * MIN_SHARE))
    return first.select("doc_id", "page", F.col("lead.script").alias("primary_script"), F.col("lead.chars").alias("primary_chars"), F.try_element_at(other, F.lit(1))["script"].alias("secondary_script"))


def detected(tokens: DataFrame, hints: DataFrame) -> DataFrame:
    """``doc_id, page, lang, primary_script, secondary_script``: the packs to read a page with, at most three."""
    scores = scored(tokens)
    scripts = ranked_scripts(measured(scores), hints)
    packs = picked(scores)
    first = packs.select("doc_id", "page", F.col("script").alias("primary_script"), F.col("lang").alias("a"))
    second = packs.select("doc_id", "page", F.col("script").alias("secondary_script"), F.col("lang").alias("b"))
    both = scripts.join(first, ["doc_id", "page", "primary_script"], "left").join(second, ["doc_id", "page", "secondary_script"], "left")
    return both.select(
        "doc_id", "page",
        F.when(F.col("primary_chars") == 0, "eng").otherwise(combined(F.col("a"), F.col("b"))).alias("lang"), "primary_script", "secondary_script",
    )


def combined(a: Column, b: Column, limit: int = 3) -> Column:
    """Packs of both strings, each once, in order, up to a limit."""
    return F.array_join(F.slice(F.array_distinct(F.concat(T.packs_of(a), T.packs_of(b))), 1, limit), "+")


def merge_languages(findings: DataFrame, limit: int = 3) -> DataFrame:
    """``doc_id, languages``: packs of a document's findings by weight, earlier ones first.

    Weights are kept in tenths, so that equal ones are equal exactly.
    """
    order = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1).alias("ord")
    each = findings.where("lang is not null").select("doc_id", order, F.posexplode(F.split("lang", r"\+")).alias("pos", "pack"))
    weights = each.groupBy("doc_id", "pack").agg(F.sum(100 - 10 * F.col("pos") - F.col("ord")).alias("w"), F.min(F.col("ord") * 100 + F.col("pos")).alias("first"))
    return weights.groupBy("doc_id").agg(
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "first", "pack"))), lambda x: x["pack"]), 1, limit), "+").alias("languages")
    )


def described(findings: DataFrame) -> DataFrame:
    """``doc_id, summary``: a sentence on what was detected, by the first finding and all languages."""
    head = findings.groupBy("doc_id").agg(F.min_by(F.struct("rotate", "mixed", "lang_detected", "colour"), "page").alias("s"), F.count_distinct("lang").alias("n"))
    langs = F.replace(F.coalesce("languages", F.lit("")), F.lit("+"), F.lit(" and "))
    what = (
        F.when(F.coalesce(F.col("s.mixed"), F.lit(False)) | (F.col("n") > 1), F.concat(F.lit("found more than one script, reading it as "), langs))
        .when(F.col("s.lang_detected"), F.concat(F.lit("detected "), langs)).otherwise(F.concat(F.lit("read as "), F.coalesce("languages", F.lit(""))))
    )
    turned = F.when(F.coalesce(F.col("s.rotate"), F.lit(0)) != 0, F.concat(F.lit("rotated "), F.col("s.rotate").cast("string"), F.lit("° to straighten it")))
    tone = F.when(F.col("s.colour"), "kept in colour").otherwise("black and white original")
    return head.join(merge_languages(findings), "doc_id", "left").select("doc_id", F.concat(F.lit("Auto: "), F.concat_ws(", ", turned, what, tone), F.lit(".")).alias("summary"))


#: Pages of a block in which the nearest finding is searched; what lies outside comes from the blocks' ends.
BLOCK = 512


def nearest_findings(pages: DataFrame, findings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, page, found_page``: the finding of the page itself, or the nearest; of two at one distance the lower page.

    A document may have any number of pages: each block of pages is looked at
    by itself, with the last finding before and the first one behind it.
    """
    at = F.floor(F.col("page") / block).cast("int")
    own = findings.select("doc_id", "page").distinct().withColumn("block", at)
    asked = pages.select("doc_id", "page").distinct().withColumn("block", at)
    ends = own.groupBy("doc_id", "block").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    blocks = asked.select("doc_id", "block").unionByName(ends.select("doc_id", "block")).distinct().join(ends, ["doc_id", "block"], "left")
    w = Window.partitionBy("doc_id").orderBy("block")
    edged = blocks.select(
        "doc_id", "block",
        F.last("high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("behind"),
    )
    every = asked.withColumn("asked", F.lit(True)).withColumn("found", F.lit(None).cast("int")).unionByName(
        own.withColumn("asked", F.lit(False)).withColumn("found", F.col("page").cast("int"))
    )
    within = Window.partitionBy("doc_id", "block").orderBy("page")
    near = every.select(
        "doc_id", "block", "page", "asked",
        F.last("found", True).over(within.rangeBetween(Window.unboundedPreceding, 0)).alias("low"),
        F.first("found", True).over(within.rangeBetween(0, Window.unboundedFollowing)).alias("high"),
    ).where("asked").join(edged, ["doc_id", "block"])
    low, high = F.coalesce("low", "before"), F.coalesce("high", "behind")
    best = F.when(high.isNull() | (low.isNotNull() & (F.col("page") - low <= high - F.col("page"))), low).otherwise(high)
    return near.select("doc_id", "page", best.cast("int").alias("found_page")).where("found_page is not null")


def page_language(packs: Column, primary: Column, fallback: str = "eng") -> Column:
    """The pack for a page: one Arabic pack where that script leads, else what was detected."""
    parts = T.packs_of(packs)
    arabic = F.try_element_at(F.filter(parts, lambda p: p.isin(*SCRIPT_PACKS["Arabic"])), F.lit(1))
    own = F.when(F.array_contains(parts, "ara"), F.lit("ara")).otherwise(F.coalesce(arabic, F.lit("ara") if "ara" in installed() else packs))
    return F.when(packs.isNull(), F.lit(fallback)).when(F.lower(F.coalesce(primary, F.lit(""))) == "arabic", own).otherwise(packs)


def language_for_page(pages: DataFrame, findings: DataFrame, requested: DataFrame) -> DataFrame:
    """``doc_id, page, lang``: a language asked for wins; else that of the nearest finding.

    ``requested``: ``doc_id, language``; null, empty or ``auto`` asks for none.
    """
    near = nearest_findings(pages, findings)
    info = findings.select("doc_id", F.col("page").alias("found_page"), "lang", F.coalesce("primary_script", "script").alias("primary"))
    every = pages.select("doc_id", "page").distinct().join(near, ["doc_id", "page"], "left").join(info, ["doc_id", "found_page"], "left").join(requested, "doc_id", "left")
    asked = F.col("language").isNotNull() & ~F.col("language").isin("", "auto")
    return every.select("doc_id", "page", F.when(asked, F.col("language")).otherwise(page_language(F.col("lang"), F.col("primary"))).alias("lang"))


def median_dpi(values: Column, low: int = 300, high: int = 450, default: int = 300, raw: bool = False) -> Column:
    """The upper median of positive resolutions, held between two bounds; a default if there is none."""
    own = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    middle = F.try_element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int"))
    good = middle.isNotNull() & (middle > 0)
    return F.when(good, middle if raw else F.greatest(F.lit(low), F.least(F.lit(high), middle))).otherwise(F.lit(default))


def sampled(pages: Column, count: int = 3) -> Column:
    """``count`` pages spread over a sorted list, the first and the last among them; all if there are no more."""
    n = F.size(pages)
    spot = lambda i: F.bround(i * (n - 1) / F.lit(float(count - 1))).cast("int") + 1
    return F.when(n <= count, pages).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(pages, spot(i)))))


def detection_pages(pages: Column, requested: Column, limit: int = 12, count: int = 3) -> Column:
    """Pages to detect the language on: all of a short document if no language is asked for, else a sample."""
    limit = max(1, min(limit, 100))
    return F.when((F.coalesce(requested, F.lit("auto")) == "auto") & (F.size(pages) <= limit), pages).otherwise(sampled(pages, count))


# --- queries ------------------------------------------------------------------

_CAT = "(VALUES " + ", ".join(f"('{s}', '{p}', {i})" for s, packs in SCRIPT_PACKS.items() for i, p in enumerate(packs)) + ") AS c(script, pack, pack_pos)"
_HAVE = ", ".join(f"'{x}'" for x in installed())
_GROUPS = f"""groups AS (SELECT script, pack, (row_number() OVER (PARTITION BY script ORDER BY pack_pos) - 1)::INTEGER AS pack_pos FROM {_CAT}
    WHERE script IN ({', '.join(f"'{x}'" for x in T.SCRIPTS)}) AND pack IN ({_HAVE}))"""
_N = " UNION ALL ".join(f"SELECT doc_id, page, pack, conf, '{k}' AS script, len(regexp_extract_all(text, '{p}')) AS n FROM good" for k, p in T.SCRIPTS.items())
_SCORES = f"""{B.TOKENS}, {_GROUPS},
  good AS (SELECT doc_id, page, lower(list_filter(string_split(lang, '+'), lambda x: x <> '')[1]) AS pack, conf, text FROM tokens
           WHERE conf IS NOT NULL AND text IS NOT NULL AND {B.stripped_sql('text')} <> ''),
  each AS ({_N}),
  scores AS (SELECT doc_id, page, pack, script,
      round(coalesce(sum(conf::DECIMAL(12, 4)) FILTER (conf > 0 AND n > 0)::DOUBLE / count(*) FILTER (conf > 0 AND n > 0) * least(coalesce(sum(n) FILTER (conf > 0 AND n > 0), 0), 400) / 400, 0.0), 6) AS score,
      coalesce(sum(n) FILTER (conf > 0 AND n > 0), 0)::BIGINT AS n_chars, coalesce(sum(n) FILTER (conf >= {MIN_CONF}), 0)::BIGINT AS evidence
    FROM each GROUP BY doc_id, page, pack, script),
  measured AS (SELECT doc_id, page, script, max(evidence) AS chars FROM scores JOIN groups USING (script, pack) WHERE pack_pos < 2 GROUP BY doc_id, page, script),
  order4 AS (SELECT doc_id, page, script, pack, score, row_number() OVER (PARTITION BY doc_id, page, script ORDER BY score DESC, pack DESC) AS rk
    FROM scores JOIN groups USING (script, pack) WHERE pack_pos < 4),
  picked AS (SELECT a.doc_id, a.page, a.script, CASE WHEN b.score > a.score * {CLOSE} THEN a.pack || '+' || b.pack ELSE a.pack END AS lang
    FROM order4 a LEFT JOIN order4 b ON a.doc_id = b.doc_id AND a.page = b.page AND a.script = b.script AND b.rk = 2 WHERE a.rk = 1)"""
_SPOT = "CASE script " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(T.SCRIPTS)) + " END"
_PART = "(" + " OR ".join(f"(l.script = '{k}' AND m.script = '{v}')" for k, vs in PARTNERS.items() for v in vs) + ")"
_SCRIPTS = f"""{_SCORES}, {B.FINDINGS},
  top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY chars DESC, {_SPOT}) AS rk FROM measured),
  hinted AS (SELECT t.doc_id, t.page, t.chars AS top_chars, t.script AS top_script, h.script AS hint, h.chars AS hint_chars FROM top t
    LEFT JOIN findings f ON f.doc_id = t.doc_id AND f.page = t.page
    LEFT JOIN measured h ON h.doc_id = t.doc_id AND h.page = t.page AND h.script = f.script WHERE t.rk = 1),
  lead AS (SELECT doc_id, page, CASE WHEN hint_chars >= top_chars * 0.8 THEN hint ELSE top_script END AS script,
    CASE WHEN hint_chars >= top_chars * 0.8 THEN hint_chars ELSE top_chars END AS chars FROM hinted),
  second AS (SELECT l.doc_id, l.page, arg_min(m.script, m.rk) AS script FROM lead l JOIN top m ON m.doc_id = l.doc_id AND m.page = l.page
    AND m.script <> l.script AND {_PART} AND m.chars >= {MIN_CHARS} AND m.chars >= l.chars * {MIN_SHARE} GROUP BY l.doc_id, l.page),
  ranked AS (SELECT l.doc_id, l.page, l.script AS primary_script, l.chars AS primary_chars, s.script AS secondary_script FROM lead l LEFT JOIN second s USING (doc_id, page))"""
_MERGE = f"""{B.FINDINGS},
  o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS ord FROM findings WHERE lang IS NOT NULL),
  e AS (SELECT doc_id, ord, unnest(range(0, len(p))) AS pos, unnest(p) AS pack FROM (SELECT *, string_split(lang, '+') AS p FROM o)),
  w AS (SELECT doc_id, pack, sum(100 - 10 * pos - ord) AS w, min(ord * 100 + pos) AS first FROM e GROUP BY doc_id, pack),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) AS rk FROM w),
  languages AS (SELECT doc_id, string_agg(pack, '+' ORDER BY rk) AS languages FROM r WHERE rk <= 3 GROUP BY doc_id)"""
_NEAR = f"""{B.PAGES}, {B.FINDINGS},
  near AS (SELECT doc_id, page, found_page FROM (SELECT p.doc_id, p.page, f.page AS found_page, row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY abs(f.page - p.page), f.page) AS rk
    FROM pages p JOIN findings f ON f.doc_id = p.doc_id) WHERE rk = 1)"""
_WORK = f"""{B.DOCS}, {B.PAGES}, todo AS (SELECT doc_id, language, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0),
  listed AS (SELECT doc_id, any_value(language) AS language, list(page ORDER BY page) AS p FROM todo GROUP BY doc_id)"""
_SAMPLE = "CASE WHEN len(p) <= 3 THEN p ELSE list_sort(list_distinct([p[round_even(i * (len(p) - 1) / 2.0, 0)::INTEGER + 1] for i in range(0, 3)])) END"


def _hints(s, d):
    return B.findings(s, d).select("doc_id", "page", "script")


def _listed(s, d):
    own = B.documents(s, d).where("page_count > 0").select("doc_id", "language", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return own.groupBy("doc_id").agg(F.first("language", True).alias("language"), F.sort_array(F.collect_list("page")).alias("p"))


QUERIES = {
    "S8_installed_languages": (lambda s, d: s.createDataFrame([(x,) for x in installed()], "pack string"), "SELECT unnest([" + _HAVE + "]) AS pack"),
    "J7_script_groups": (lambda s, d: script_groups(s), f"WITH {_GROUPS} SELECT * FROM groups"),
    "A7_score_language": (lambda s, d: scored(B.tokens(s, d)).select("doc_id", "page", "pack", "script", "score", "n_chars"), f"WITH {_SCORES} SELECT doc_id, page, pack, script, score, n_chars FROM scores"),
    "A8_script_evidence": (lambda s, d: scored(B.tokens(s, d)).select("doc_id", "page", "pack", "script", "evidence"), f"WITH {_SCORES} SELECT doc_id, page, pack, script, evidence FROM scores"),
    "A9_measure_scripts": (lambda s, d: measured(scored(B.tokens(s, d))), f"WITH {_SCORES} SELECT doc_id, page, script, chars FROM measured"),
    "O1_pick": (  # all of a job's tokens as one page, so that several packs compete
        lambda s, d: picked(scored(B.tokens(s, d).withColumn("doc_id", F.col("doc_id") % 7).withColumn("page", F.lit(0)))),
        f"WITH {_SCORES.replace('SELECT DISTINCT doc_id, page, tok_no, lang, conf, text FROM ocr_token', 'SELECT doc_id % 7 AS doc_id, 0 AS page, lang, conf, text FROM (SELECT DISTINCT doc_id, page, tok_no, lang, conf, text FROM ocr_token)')} SELECT * FROM picked",
    ),
    "O2_languages_for_script": (lambda s, d: picked(scored(B.tokens(s, d))), f"WITH {_SCORES} SELECT * FROM picked"),
    "J8_mixed_partner": (lambda s, d: ranked_scripts(measured(scored(B.tokens(s, d))), _hints(s, d)), f"WITH {_SCRIPTS} SELECT * FROM ranked"),
    "O3_detect_language": (
        lambda s, d: detected(B.tokens(s, d), _hints(s, d)),
        f"""WITH {_SCRIPTS} SELECT r.doc_id, r.page, CASE WHEN primary_chars = 0 THEN 'eng' ELSE coalesce(a.lang, '') || CASE WHEN b.lang IS NULL THEN '' ELSE CASE WHEN a.lang IS NULL THEN '' ELSE '+' END || b.lang END END AS lang,
        primary_script, secondary_script FROM ranked r LEFT JOIN picked a ON a.doc_id = r.doc_id AND a.page = r.page AND a.script = primary_script
        LEFT JOIN picked b ON b.doc_id = r.doc_id AND b.page = r.page AND b.script = secondary_script""",
    ),
    "A6_merge_languages": (lambda s, d: merge_languages(B.findings(s, d)), f"WITH {_MERGE} SELECT * FROM languages"),
    "A13_describe": (
        lambda s, d: described(B.findings(s, d)),
        f"""WITH {_MERGE}, h AS (SELECT doc_id, arg_min(coalesce(rotate, 0), page) AS rotate, arg_min(coalesce(mixed, false), page) AS mixed, arg_min(coalesce(lang_detected, false), page) AS chosen,
          arg_min(coalesce(colour, false), page) AS colour, count(DISTINCT lang) AS n FROM findings GROUP BY doc_id)
        SELECT doc_id, 'Auto: ' || CASE WHEN rotate <> 0 THEN 'rotated ' || rotate || '° to straighten it, ' ELSE '' END ||
          CASE WHEN mixed OR n > 1 THEN 'found more than one script, reading it as ' || replace(coalesce(languages, ''), '+', ' and ')
               WHEN chosen THEN 'detected ' || replace(coalesce(languages, ''), '+', ' and ') ELSE 'read as ' || coalesce(languages, '') END || ', ' ||
          CASE WHEN colour THEN 'kept in colour' ELSE 'black and white original' END || '.' AS summary FROM h LEFT JOIN languages USING (doc_id)""",
    ),
    "A14_inspect": (
        lambda s, d: B.findings(s, d).join(detected(B.tokens(s, d), _hints(s, d)).select("doc_id", "page", F.col("lang").alias("read_as"), F.col("primary_script").alias("measured"), F.col("secondary_script").alias("second")), ["doc_id", "page"])
        .select("doc_id", "page", F.greatest(F.lit(300), F.least(F.lit(450), "native_dpi")).alias("dpi"), "rotate", "read_as", F.coalesce("measured", "script").alias("primary_script"), F.col("second").isNotNull().alias("mixed"), (F.col("bilevel") & ~F.col("colour")).alias("bilevel"), "colour"),
        f"""WITH {_SCRIPTS}, det AS (SELECT r.doc_id, r.page, CASE WHEN primary_chars = 0 THEN 'eng' ELSE coalesce(a.lang, '') || CASE WHEN b.lang IS NULL THEN '' ELSE CASE WHEN a.lang IS NULL THEN '' ELSE '+' END || b.lang END END AS lang,
        primary_script, secondary_script FROM ranked r LEFT JOIN picked a ON a.doc_id = r.doc_id AND a.page = r.page AND a.script = primary_script
        LEFT JOIN picked b ON b.doc_id = r.doc_id AND b.page = r.page AND b.script = secondary_script)
        SELECT doc_id, page, greatest(300, least(450, native_dpi)) AS dpi, rotate, det.lang AS read_as, coalesce(det.primary_script, f.script) AS primary_script, secondary_script IS NOT NULL AS mixed, bilevel AND NOT colour AS bilevel, colour
        FROM findings f JOIN det USING (doc_id, page)""",
    ),
    "J1_nearest_finding": (lambda s, d: nearest_findings(B.pages(s, d), B.findings(s, d)), f"WITH {_NEAR} SELECT * FROM near"),
    "J2_page_language": (
        lambda s, d: language_for_page(B.pages(s, d), B.findings(s, d), B.documents(s, d).select("doc_id", "language")),
        f"""WITH {_NEAR}, {B.DOCS}, x AS (SELECT p.doc_id, p.page, d.language, f.lang, lower(coalesce(f.primary_script, f.script, '')) AS pri FROM pages p LEFT JOIN near USING (doc_id, page)
          LEFT JOIN findings f ON f.doc_id = p.doc_id AND f.page = near.found_page LEFT JOIN docs d ON d.doc_id = p.doc_id)
        SELECT doc_id, page, CASE WHEN language IS NOT NULL AND language NOT IN ('', 'auto') THEN language WHEN lang IS NULL THEN 'eng' WHEN pri = 'arabic' THEN
          CASE WHEN list_contains(string_split(lang, '+'), 'ara') THEN 'ara' ELSE coalesce(list_filter(string_split(lang, '+'), lambda x: x IN ('ara', 'fas', 'urd'))[1], 'ara') END ELSE lang END AS lang FROM x""",
    ),
    "S7_native_dpi": (
        lambda s, d: B.findings(s, d).groupBy("doc_id").agg(F.collect_list("native_dpi").alias("v")).select("doc_id", median_dpi(F.col("v")).alias("dpi"), median_dpi(F.col("v"), raw=True).alias("native")),
        f"""WITH {B.FINDINGS}, v AS (SELECT doc_id, list(native_dpi ORDER BY native_dpi) FILTER (native_dpi IS NOT NULL) AS l FROM findings GROUP BY doc_id), m AS (SELECT doc_id, l[len(l) // 2 + 1] AS m FROM v)
        SELECT doc_id, CASE WHEN m > 0 THEN greatest(300, least(450, m)) ELSE 300 END::INTEGER AS dpi, CASE WHEN m > 0 THEN m ELSE 300 END::INTEGER AS native FROM m""",
    ),
    "W6_sample_pages": (lambda s, d: _listed(s, d).select("doc_id", F.explode(sampled(F.col("p"))).alias("page")), f"WITH {_WORK} SELECT doc_id, unnest({_SAMPLE}) AS page FROM listed"),
    "W7_detection_pages": (
        lambda s, d: _listed(s, d).select("doc_id", F.explode(detection_pages(F.col("p"), F.col("language"))).alias("page")),
        f"WITH {_WORK} SELECT doc_id, unnest(CASE WHEN coalesce(language, 'auto') = 'auto' AND len(p) <= 12 THEN p ELSE {_SAMPLE} END) AS page FROM listed",
    ),
    "F4_pack_availability": (
        lambda s, d: B.documents(s, d).select("doc_id", ((F.coalesce("language", F.lit("auto")) == "auto") | (F.size(F.array_except(T.packs_of(F.col("language")), F.array(*map(F.lit, installed())))) == 0)).alias("available")),
        f"""WITH {B.DOCS} SELECT doc_id, coalesce(language, 'auto') = 'auto' OR len(list_filter(string_split(coalesce(language, ''), '+'), lambda x: x <> '' AND x NOT IN ({_HAVE}))) = 0 AS available FROM docs""",
    ),
    "U5_missing_packs": (
        lambda s, d: B.documents(s, d).where("coalesce(language, 'auto') <> 'auto'").select("doc_id", F.explode(F.array_except(T.packs_of(F.col("language")), F.array(*map(F.lit, installed())))).alias("missing")),
        f"""WITH {B.DOCS} SELECT DISTINCT doc_id, unnest(list_filter(string_split(coalesce(language, ''), '+'), lambda x: x <> '' AND x NOT IN ({_HAVE}))) AS missing FROM docs WHERE coalesce(language, 'auto') <> 'auto'""",
    ),
    "U4_combine_packs": (
        lambda s, d: B.documents(s, d).join(merge_languages(B.findings(s, d)), "doc_id", "left").select("doc_id", combined(F.col("language"), F.col("languages")).alias("packs")),
        f"""WITH {B.DOCS}, {_MERGE}, p AS (SELECT doc_id, list_filter(string_split(coalesce(language, ''), '+') || string_split(coalesce(languages, ''), '+'), lambda x: x <> '') AS l FROM docs LEFT JOIN languages USING (doc_id))
        SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '+') AS packs FROM p""",
    ),
}
