"""Queries of the text functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import base as B
from pageloom.session import table


@lru_cache(maxsize=1)
def matching_table() -> tuple[str, str, str, str]:
    """How single characters are brought to the matching form: those that become one other, what they become, those that vanish, and those that
    need their neighbours or become several (as a character class)."""
    changed, to, gone, several = [], [], [], set()
    for i in range(65, 0x10000):
        ch = chr(i)
        if 0xD800 <= i <= 0xDFFF or 0xAC00 <= i <= 0xD7A3:
            continue
        form = "" if T.DROPPED.match(ch) else "".join(c for c in unicodedata.normalize("NFD", T.DROPPED.sub("", unicodedata.normalize("NFKC", ch))) if unicodedata.category(c) != "Mn")
        form = unicodedata.normalize("NFC", form).casefold()
        if form.isspace():
            form = " "
        if not form:
            gone.append(ch)
        elif len(form) > 1 or "\u1100" <= form <= "\u11ff":
            several.add(i)
        elif form != ch:
            changed.append(ch)
            to.append(form)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.category(parts[-1]) != "Mn" and unicodedata.normalize("NFC", ch) == ch:
            several.add(ord(parts[-1]))  # may join what stands before it
    several.update(range(0x1100, 0x1200))
    runs: list[list[int]] = []
    for i in sorted(several):
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    inside = "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in runs)
    return "".join(changed), "".join(to), "".join(gone), f"[{inside}\\x{{10000}}-\\x{{10ffff}}]"


def _length(expression: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expression}, '{pattern}'))"


RATIO_SQL = f"""CASE WHEN length(probe) = 0 THEN 4.0 WHEN {_length('probe', T.CJK)} / greatest(length(probe), 1) > 0.10 THEN 1.2
    WHEN {_length('probe', T.ARABIC)} / greatest(length(probe), 1) > 0.10 THEN 1.8
    WHEN {_length('probe', r'[^\x00-\x7F]')} / greatest(length(probe), 1) > 0.05 THEN 3.0 ELSE 4.0 END::DOUBLE"""


def _pages(f):
    return lambda s, d: f(B.pages(s, d))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _several() -> str:
    """The characters that become several, with what they become, as rows."""
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", matching_table()[3]))
    chars = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i <= 0xDFFF and pattern.match(chr(i))]
    # white space at the ends of a part would be lost
    forms = {c: T.matching_form(f"x{c}x")[1:-1] for c in chars}
    return ", ".join(f"({_quoted(c)}, {_quoted(f)})" for c, f in forms.items() if f != c)


_CHANGED, _TO, _GONE, _ = matching_table()
#: Characters of an expression one by one, each as its own form, put together and tidied.
_FORMED = f"""several(c, f) AS (VALUES {_several()}), wide AS (SELECT map(list(c), list(f)) AS m, '[' || string_agg(regexp_escape(c), '') || ']' AS p FROM several)"""


def form_sql(text: str) -> str:
    """The matching form of an expression, over the table ``wide``."""
    long = f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: coalesce(m[c], c)), '')"
    some = f"CASE WHEN regexp_matches({text}, p) THEN {long} ELSE {text} END"
    plain = f"translate(translate({some}, {_quoted(_CHANGED)}, {_quoted(_TO)}), {_quoted(_GONE)}, '')"
    return f"regexp_replace(regexp_replace({plain}, '{B.SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def _common_sql(form: str) -> str:
    return f"len(list_filter([{', '.join(map(_quoted, T.ARABIC_WORDS))}], lambda w: contains({form}, w)))::INTEGER"


_RUN = r"[A-Za-z0-9@._+:/,\-]"


def _turned_sql(line: str) -> str:
    parts = f"list_reverse(regexp_extract_all({line}, '({_RUN}+|[^{_RUN[1:]}+)'))"
    return f"array_to_string(list_transform({parts}, lambda p: CASE WHEN regexp_matches(p, '^{_RUN}') THEN p ELSE array_to_string(list_reverse(regexp_extract_all(p, '(?s).')), '') END), '')"


_SPLIT = f"""split AS (SELECT doc_id, page, unnest(range(1, len(parts) + 1)) AS n, unnest(parts) AS line FROM
    (SELECT doc_id, page, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, page, regexp_split_to_array(regexp_replace(text, '{T.BIDI}', '', 'g'), '{T.LINE_END}') AS parts FROM pages WHERE regexp_matches(text, '{T.ARABIC}'))))"""
#: ``repaired``: pages with their Arabic lines in reading order.
REPAIRED_SQL = f"""{B.PAGES}, {_FORMED}, {_SPLIT}, turned AS (SELECT *, {_turned_sql('line')} AS other, {_length('line', T.ARABIC)} >= 3 AS asked FROM split),
    formed AS (SELECT turned.*, CASE WHEN asked THEN {form_sql('line')} END AS a, CASE WHEN asked THEN {form_sql('other')} END AS b FROM turned, wide),
    chosen AS (SELECT doc_id, page, string_agg(CASE WHEN asked AND {_common_sql('b')} > {_common_sql('a')} THEN {B.stripped_sql('other')} ELSE line END, chr(10) ORDER BY n) AS own FROM formed GROUP BY doc_id, page),
    repaired AS (SELECT p.doc_id, p.page, CASE WHEN regexp_matches(p.text, '{T.ARABIC}') THEN coalesce(own, '') ELSE coalesce(p.text, '') END AS text FROM pages p LEFT JOIN chosen c ON p.doc_id = c.doc_id AND p.page = c.page)"""

QUERIES = {
    "X1_normalise_for_match": (
        _pages(lambda p: p.select("doc_id", "page", T.normalise_for_match("text").alias("form"))),
        f"WITH {B.PAGES}, {_FORMED} SELECT doc_id, page, coalesce({form_sql('text')}, '') AS form FROM pages, wide",
    ),
    "A10_arabic_word_score": (
        _pages(lambda p: p.select("doc_id", "page", T.arabic_word_score("text").alias("score"))),
        f"WITH {B.PAGES}, {_FORMED}, f AS (SELECT doc_id, page, coalesce({form_sql('text')}, '') AS form FROM pages, wide) SELECT doc_id, page, {_common_sql('form')} AS score FROM f",
    ),
    "X2_repair_text": (
        _pages(lambda p: p.select("doc_id", "page", T.repair_text("text").alias("text"))),
        f"WITH {REPAIRED_SQL} SELECT doc_id, page, text FROM repaired",
    ),
    "X3_reverse_line": (
        _pages(lambda p: p.select("doc_id", "page", F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line")).select("doc_id", "page", "line_no", T.reverse_line(F.col("line")).alias("turned"))),
        f"""WITH {B.PAGES}, raw AS (SELECT doc_id, page, unnest(range(0, len(parts))) AS ord, unnest(parts) AS raw FROM (SELECT doc_id, page, regexp_split_to_array(coalesce(text, ''), '{T.LINE_END}') AS parts FROM pages)),
        tidy AS (SELECT doc_id, page, ord, {B.stripped_sql(r"regexp_replace(raw, '[ \t\x{a0}]+', ' ', 'g')")} AS line FROM raw)
        SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1)::INTEGER AS line_no, {_turned_sql(f"regexp_replace(line, '{T.BIDI}', '', 'g')")} AS turned FROM tidy WHERE line <> ''""",
    ),
    "X4_script_counts": (
        _pages(lambda p: p.select("doc_id", "page", *(T.count_of(F.col("text"), x).cast("long").alias(k.lower()) for k, x in T.SCRIPTS.items()),
                                  T.count_of(F.col("text"), T.ARABIC).cast("long").alias("arabic_text"), T.count_of(F.col("text"), T.CJK).cast("long").alias("cjk_text"))),
        f"WITH {B.PAGES} SELECT doc_id, page, "
        + ", ".join(f"coalesce({_length('text', x)}, 0)::BIGINT AS {k.lower()}" for k, x in T.SCRIPTS.items())
        + f", coalesce({_length('text', T.ARABIC)}, 0)::BIGINT AS arabic_text, coalesce({_length('text', T.CJK)}, 0)::BIGINT AS cjk_text FROM pages",
    ),
    "X5_chars_per_token": (
        _pages(lambda p: p.select("doc_id", "page", T.chars_per_token(F.col("text")).alias("ratio"))),
        f"WITH {B.PAGES}, q AS (SELECT doc_id, page, substring(coalesce(text, ''), 1, 4000) AS probe FROM pages) SELECT doc_id, page, {RATIO_SQL} AS ratio FROM q",
    ),
    "X6_budget_characters": (
        _pages(lambda p: p.select("doc_id", "page", T.budget_characters(F.col("text")).alias("budget"))),
        f"""WITH {B.PAGES}, q AS (SELECT doc_id, page, substring(coalesce(text, ''), 1, 4000) AS probe FROM pages)
        SELECT doc_id, page, greatest(least(18000, floor(3500 * ({RATIO_SQL}))), 1000)::INTEGER AS budget FROM q""",
    ),
    "X10_flatten": (
        _pages(lambda p: p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))),
        f"WITH {B.PAGES} SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_id",
    ),
    "X12_download_name": (
        lambda s, d: B.uploads(s, d).select("batch_id", "ord", "filename", T.stem(F.col("filename")).alias("stem"), T.download_name(F.col("filename")).alias("download")),
        f"""WITH {B.UPLOADS} SELECT batch_id, ord, filename, regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') AS stem,
        regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') || '-searchable.pdf' AS download FROM uploads""",
    ),
    "X14_rotation_and_script": (
        lambda s, d: B.findings(s, d).select("doc_id", "page", T.rotation_and_script(F.concat(F.lit("Rotate: "), "rotate", F.lit("\nOrientation confidence: "), F.round(F.col("dpi") / 200.0, 2), F.lit("\nScript: "), "script")).alias("r")).select("doc_id", "page", F.col("r.rotate").alias("rotate"), F.col("r.script").alias("script")),
        f"""WITH {B.FINDINGS} SELECT doc_id, page, CASE WHEN script IS NOT NULL AND round(dpi / 200.0, 2) >= 2.0 THEN rotate ELSE 0 END AS rotate,
        coalesce(script, 'Latin') AS script FROM findings""",
    ),
    "X15_packs": (
        lambda s, d: B.documents(s, d).select("doc_id", F.posexplode(T.packs_of(F.col("language"))).alias("pos", "pack")),
        f"""WITH {B.DOCS}, q AS (SELECT doc_id, list_filter(string_split(coalesce(language, ''), '+'), lambda x: x <> '') AS p FROM docs)
        SELECT doc_id, (unnest(range(0, len(p))))::INTEGER AS pos, unnest(p) AS pack FROM q""",
    ),
    "X16_page_modes": (
        lambda s, d: B.uploads(s, d).select("batch_id", "ord", F.explode(T.page_modes(F.regexp_replace("filename", "[^0-9]+", ","))).alias("mode")),
        f"""WITH {B.UPLOADS}, q AS (SELECT batch_id, ord, unnest(regexp_split_to_array(regexp_replace(filename, '[^0-9]+', ',', 'g'), '[,;\\s]+')) AS x FROM uploads)
        SELECT batch_id, ord, x::INTEGER AS mode FROM q WHERE regexp_matches(x, '^[0-9]{{1,4}}$') AND try_cast(x AS INTEGER) <= 13""",
    ),
    "X17_allowed_origins": (
        lambda s, d: table(s, d, "documents").select("host").where("host is not null").distinct().select("host", F.array_join(T.allowed_origins(F.concat(F.lit(" "), "host", F.lit(" , ,"), F.when(F.col("host").startswith("m."), "*").otherwise("localhost"))), "|").alias("origins")),
        "SELECT host, CASE WHEN starts_with(host, 'm.') THEN '*' ELSE host || '|localhost' END AS origins FROM (SELECT DISTINCT host FROM documents WHERE host IS NOT NULL)",
    ),
    "F5_form_flag": (
        lambda s, d: B.jobs(s, d).select("job_id", T.truthy(F.col("clean").cast("string")).alias("clean"), T.truthy(F.col("clean_mode")).alias("mode_flag")),
        f"""WITH {B.JOBS} SELECT job_id, coalesce(lower(trim(clean::VARCHAR)) IN ('1', 'true', 'yes', 'on'), false) AS clean,
        coalesce(lower(trim(clean_mode)) IN ('1', 'true', 'yes', 'on'), false) AS mode_flag FROM jobs""",
    ),
}
