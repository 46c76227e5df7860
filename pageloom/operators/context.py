"""Excerpts of a document's lines around the labels asked for, within a size budget.

``build_context`` works on whole documents: lines get a document-wide order by
aggregates over (document, page), label hits come from a join with a small
literal table of fields, and the budget is filled by one fold over a document's
windows. Windows are few against lines; the fold holds only their sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import base as B
from pageloom.operators.text_queries import RATIO_SQL, REPAIRED_SQL, form_sql
from pageloom.session import parted, written

BEFORE, AFTER, HEAD, MAX_HITS, MARGIN = 4, 6, 12, 24, 16


@dataclass(frozen=True)
class Label:
    """What is looked for: search terms in order, and the language it is confined to, if any."""

    field_id: str
    terms: tuple[str, ...]
    language_mode: str = "any"
    language: str = ""
    type: str = "string"


#: Labels of the example queries.
LABELS = (
    Label("register", ("registre de", "register", "registro de")),
    Label("invoice", ("facture", "invoice", "rechnung", "factura")),
    Label("archive", ("service des archives", "archive", "archiv", "الأرشيف")),
)
ARABIC_LABELS = (Label("name", ("Nom", "الاسم الكامل"), "specific_language", "ar-MA"), Label("file", ("dossier", "الملف"), "specific_language", "ar"))


def lines(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """``doc_id, page, line_no, line, n_lines`` (line_no from 0): the tidy lines of pages; pages without lines drop out."""
    own = pages.select("doc_id", "page", T.lines_of(F.col("text") if text is None else text).alias("lines"))
    return own.select("doc_id", "page", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line_no", "line"))


def _needles(labels: tuple[Label, ...], form) -> list[tuple[int, str, int, str]]:
    """Number and id of a label, number of a term, and the term's form; short terms and terms of another script than the label's language are left out."""
    return [
        (k, x.field_id, i, form(term))
        for k, x in enumerate(labels)
        for i, term in enumerate(x.terms)
        if len(form(term)) >= 3 and not (_arabic(x) and not any("؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" for c in term))
    ]


def _fields(spark: SparkSession, labels: tuple[Label, ...], form) -> DataFrame:
    return spark.createDataFrame(_needles(labels, form), "field_ord int, field_id string, term_ord int, needle string")


def _arabic(x: Label) -> bool:
    return x.language_mode == "specific_language" and x.language.split("-", 1)[0] == "ar"


def label_hits(own: DataFrame, labels: tuple[Label, ...], form=T.matching_form) -> DataFrame:
    """Lines (with a column ``key``) that hold a label's term; of each label only the first term with any hit in the document.

    The fields are a handful of literals, so they are broadcast.
    """
    fields = F.broadcast(_fields(own.sparkSession, labels, form))
    hits = own.join(fields, F.contains(F.col("key"), F.col("needle")))
    first = hits.groupBy("doc_id", "field_ord").agg(F.min("term_ord").alias("term_ord"))
    return hits.join(first, ["doc_id", "field_ord", "term_ord"])


def windows_of(hits: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``start`` and ``end`` (exclusive) around each hit, within its page."""
    return hits.withColumn("start", F.greatest(F.lit(0), F.col("line_no") - before)).withColumn("end", F.least(F.col("n_lines"), F.col("line_no") + after + 1))


def script_windows(own: DataFrame, labels: tuple[Label, ...], before: int = BEFORE, after: int = AFTER, max_hits: int = MAX_HITS) -> DataFrame:
    """Windows around the first lines in Arabic script, once for each label confined to that language."""
    wanted = [(k, x.field_id) for k, x in enumerate(labels) if _arabic(x) and x.type in ("string", "array")]
    marked = own.where(F.col("line").rlike(T.ARABIC))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_no"))
    some = windows_of(marked.withColumn("rank", rank).where(F.col("rank") <= max_hits), before, after)
    fields = own.sparkSession.createDataFrame(wanted, "field_ord int, field_id string")
    return some.crossJoin(F.broadcast(fields)) if wanted else some.withColumn("field_ord", F.lit(0)).withColumn("field_id", F.lit("")).where("false")


def head_windows(own: DataFrame, head: int = HEAD) -> DataFrame:
    """The first lines of each document's first page with any."""
    return own.groupBy("doc_id").agg(F.min_by(F.struct("page", "n_lines"), "page").alias("p")).select(
        "doc_id", F.col("p.page").alias("page"), F.lit(0).alias("start"), F.least(F.lit(head), F.col("p.n_lines")).alias("end")
    )


def merged(windows: DataFrame) -> DataFrame:
    """``doc_id, page, start, end``: windows of a page that overlap, touch or leave out one line, as one."""
    order = Window.partitionBy("doc_id", "page").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = windows.select("doc_id", "page", "start", "end").withColumn("fresh", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    return (
        flagged.withColumn("island", F.sum("fresh").over(order)).groupBy("doc_id", "page", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    )


def sized(windows: DataFrame, own: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Windows with their size: characters and a line end each, and a margin."""
    texts = own.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", F.length("line").alias("n")))).alias("sizes"))
    size = F.aggregate(F.slice("sizes", F.col("start") + 1, F.col("end") - F.col("start")), F.lit(margin), lambda s, x: s + x["n"] + 1)
    return windows.join(texts, ["doc_id", "page"]).withColumn("size", size).drop("sizes")


def fill(windows: DataFrame, budget: Column) -> DataFrame:
    """``doc_id, kept, used, truncated``: windows in order of ``priority`` that fit; one that doesn't is passed over.

    ``windows``: ``doc_id, priority, page, start, end, size``, and what ``budget`` refers to.
    """
    listed = windows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("priority", "page", "start", "end", "size"))).alias("all"), F.first(budget).alias("budget")
    )
    kind = "struct<kept:array<struct<page:int,start:int,end:int>>,used:int,truncated:boolean>"
    empty = F.struct(F.array().cast("array<struct<page:int,start:int,end:int>>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("truncated")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["size"] <= F.col("budget")
        window = F.struct(x["page"].cast("int").alias("page"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
        return F.struct(
            F.when(fits, F.concat(s["kept"], F.array(window))).otherwise(s["kept"]).alias("kept"),
            F.when(fits, s["used"] + x["size"]).otherwise(s["used"]).cast("int").alias("used"),
            (s["truncated"] | ~fits).alias("truncated"),
        ).cast(kind)

    return listed.select("doc_id", F.aggregate("all", empty, step).alias("r")).select("doc_id", "r.kept", "r.used", "r.truncated")


def rendered(own: DataFrame) -> DataFrame:
    """``doc_id, text, pages``: all lines of a document with page marks."""
    by_page = own.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    marked = F.concat(F.lit("<<<PAGE "), F.col("page").cast("string"), F.lit(">>>\n"), F.col("body"))
    listed = F.array_sort(F.collect_list(F.struct("page", marked.alias("text"))))
    return by_page.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"), F.transform(listed, lambda x: x["page"]).alias("pages"))


def build_context(pages: DataFrame, labels: tuple[Label, ...], max_characters: int = T.MAX_CHARACTERS, max_tokens: int = T.MAX_TOKENS) -> DataFrame:
    """``doc_id, text, strategy, pages, characters, budget, truncated``: what to show of each document for the labels.

    A document that fits goes in whole, unless all labels are confined to a
    language. Otherwise windows are taken in order (head, then each label's
    windows and its script's) while they fit. Without any window the start of
    the document is cut to the budget. A document without lines gives an empty
    text; null texts count as empty.
    """
    # the lines are used several times below; their Python functions run once
    own = written(lines(parted(pages), T.repair_text("text")).withColumn("key", T.normalise_for_match("line")), "lines")
    focused = bool(labels) and all(x.language_mode == "specific_language" for x in labels)
    whole = pages.select("doc_id").distinct().join(rendered(own), "doc_id", "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("whole"), F.coalesce("pages", F.array().cast("array<int>")).alias("whole_pages")
    )
    whole = whole.withColumn("budget", T.budget_characters(F.col("whole"), max_characters, max_tokens))
    full = (F.length("whole") == 0) | ((F.length("whole") <= F.col("budget")) & F.lit(not focused))
    order = ["doc_id", "page", "start", "end"]
    parts = []
    if not focused:
        parts.append(head_windows(own).select(*order, F.struct(F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("priority")))
    rank = lambda b: F.struct(F.col("field_ord").alias("a"), F.lit(b).alias("b"), F.col("page").alias("c"), F.col("line_no").alias("d")).alias("priority")
    parts.append(windows_of(label_hits(own, labels)).select(*order, rank(0)))
    parts.append(script_windows(own, labels).select(*order, rank(1)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    chosen = fill(sized(every.join(whole.where(~full).select("doc_id", "budget"), "doc_id"), own), F.col("budget"))
    spans = merged(chosen.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.*"))
    texts = own.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("body"))
    cut = spans.join(texts, ["doc_id", "page"]).select("doc_id", "page", "start", F.array_join(F.slice("body", F.col("start") + 1, F.col("end") - F.col("start")), "\n").alias("piece"))
    by_page = cut.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "\n[...]\n").alias("piece"))
    listed = F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("<<<PAGE "), F.col("page").cast("string"), F.lit(">>>\n"), "piece").alias("text"))))
    selected = by_page.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"), F.transform(listed, lambda x: x["page"]).alias("pages"))
    all_of = whole.join(chosen.select("doc_id", "truncated"), "doc_id", "left").join(selected, "doc_id", "left")
    clipped = F.expr("substring(whole, 1, budget)")
    text = F.when(full, F.col("whole")).when(F.col("truncated").isNull(), clipped).otherwise(F.coalesce("text", F.lit("")))
    return all_of.select(
        "doc_id",
        text.alias("text"),
        F.when(full, "full").otherwise("selected").alias("strategy"),
        F.when(full | F.col("truncated").isNull(), F.col("whole_pages")).otherwise(F.coalesce("pages", F.array().cast("array<int>"))).alias("pages"),
        F.length(text).alias("characters"),
        "budget",
        F.when(full, False).when(F.col("truncated").isNull(), F.length("whole") > F.col("budget")).otherwise(F.col("truncated")).alias("truncated"),
    )


# --- queries ------------------------------------------------------------------

_LINES = f"""{B.PAGES},
  split AS (SELECT doc_id, page, unnest(range(0, len(parts))) AS ord, unnest(parts) AS raw
            FROM (SELECT doc_id, page, regexp_split_to_array(coalesce(text, ''), '{T.LINE_END}') AS parts FROM pages)),
  tidy AS (SELECT doc_id, page, ord, {B.stripped_sql(r"regexp_replace(raw, '[ \t\x{a0}]+', ' ', 'g')")} AS line FROM split),
  lines AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1)::INTEGER AS line_no, line,
            (count(*) OVER (PARTITION BY doc_id, page))::INTEGER AS n_lines FROM tidy WHERE line <> '')"""
_NEEDLES = ", ".join(f"({k}, {i}, '{term.lower()}')" for k, x in enumerate(LABELS) for i, term in enumerate(x.terms))
_HITS = f"""{_LINES},
  fields AS (SELECT * FROM (VALUES {_NEEDLES}) AS t(field_ord, term_ord, needle)),
  every_hit AS (SELECT * FROM lines JOIN fields ON contains(lower(line), needle)),
  hits AS (SELECT h.* FROM every_hit h JOIN (SELECT doc_id, field_ord, min(term_ord) AS term_ord FROM every_hit GROUP BY 1, 2) f
           USING (doc_id, field_ord, term_ord)),
  windows AS (SELECT doc_id, page, field_ord, line_no, greatest(0, line_no - 4)::INTEGER AS "start", least(n_lines, line_no + 7)::INTEGER AS "end" FROM hits),
  head AS (SELECT doc_id, min(page) AS page FROM lines GROUP BY doc_id),
  heads AS (SELECT DISTINCT l.doc_id, l.page, 0 AS "start", least(12, l.n_lines)::INTEGER AS "end" FROM lines l JOIN head USING (doc_id, page))"""
_MERGED = """flagged AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY doc_id, page ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM source),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM flagged)"""
BUDGET = 1500


def _own(s, d):
    return lines(B.pages(s, d)).withColumn("key", F.lower("line"))


def _lower(x: str) -> str:
    return x.lower()


def _windows(s, d):
    return windows_of(label_hits(_own(s, d), LABELS, _lower)).select("doc_id", "page", "field_ord", "line_no", "start", "end")


def _sized(s, d):
    own = _own(s, d)
    ranked = _windows(s, d).withColumn("priority", F.row_number().over(Window.partitionBy("doc_id").orderBy("field_ord", "page", "line_no")))
    return sized(ranked, own)


def _excerpts(s, d):
    own = _own(s, d)
    spans = merged(_windows(s, d))
    body = own.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("body"))
    return spans.join(body, ["doc_id", "page"]).select("doc_id", "page", "start", "end", F.array_join(F.slice("body", F.col("start") + 1, F.col("end") - F.col("start")), "\n").alias("excerpt"))


_SIZED = f"""WITH RECURSIVE {_HITS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY field_ord, page, line_no) AS priority FROM windows),
  sized AS (SELECT r.doc_id, r.priority, r.page, r."start", r."end", (sum(length(l.line) + 1) + 16)::INTEGER AS size FROM ranked r
            JOIN lines l ON l.doc_id = r.doc_id AND l.page = r.page AND l.line_no >= r."start" AND l.line_no < r."end" GROUP BY 1, 2, 3, 4, 5)"""

_REPAIRED_LINES = _LINES.replace(f"{B.PAGES},", "").replace("FROM pages)", "FROM repaired)").replace("split AS", "raws AS").replace("FROM split", "FROM raws")


def _context_sql(labels: tuple[Label, ...], max_characters: int) -> str:
    """The excerpts by one walk over each document's windows."""
    needles = ", ".join(f"({k}, {i}, '{form}')" for k, _, i, form in _needles(labels, T.matching_form))
    arabic = [k for k, x in enumerate(labels) if _arabic(x) and x.type in ("string", "array")]
    focused = all(x.language_mode == "specific_language" for x in labels)
    scripts = f"UNION ALL SELECT doc_id, page, greatest(0, line_no - {BEFORE}), least(n_lines, line_no + {AFTER + 1}), k, 1, page, line_no FROM arabic, unnest({arabic}) f(k) WHERE rank <= {MAX_HITS}" if arabic else ""
    heads = "" if focused else f"""UNION ALL SELECT DISTINCT l.doc_id, l.page, 0, least({HEAD}, l.n_lines), -1, 0, 0, 0 FROM lines l JOIN (SELECT doc_id, min(page) AS page FROM lines GROUP BY doc_id) USING (doc_id, page)"""
    return f"""WITH RECURSIVE {REPAIRED_SQL}, {_REPAIRED_LINES},
  keyed AS (SELECT lines.*, {form_sql('line')} AS key FROM lines, wide),
  fields AS (SELECT * FROM (VALUES {needles}) AS t(field_ord, term_ord, needle)),
  every_hit AS (SELECT * FROM keyed JOIN fields ON contains(key, needle)),
  hits AS (SELECT h.* FROM every_hit h JOIN (SELECT doc_id, field_ord, min(term_ord) AS term_ord FROM every_hit GROUP BY 1, 2) f USING (doc_id, field_ord, term_ord)),
  arabic AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS rank FROM lines WHERE regexp_matches(line, '{T.ARABIC}')),
  bodies AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY doc_id, page),
  wholes AS (SELECT d.doc_id, coalesce(string_agg('<<<PAGE ' || page || '>>>' || chr(10) || body, chr(10) ORDER BY page), '') AS whole, coalesce(list(page ORDER BY page) FILTER (page IS NOT NULL), []) AS whole_pages
    FROM (SELECT DISTINCT doc_id FROM pages) d LEFT JOIN bodies USING (doc_id) GROUP BY d.doc_id),
  budgets AS (SELECT *, greatest(least({max_characters}, floor({T.MAX_TOKENS} * ({RATIO_SQL}))), {min(1000, max_characters)})::INTEGER AS budget FROM (SELECT *, substring(whole, 1, 4000) AS probe FROM wholes)),
  decided AS (SELECT *, length(whole) = 0 OR length(whole) <= budget AND {not focused} AS whole_fits FROM budgets),
  wanted(doc_id, page, "start", "end", a, b, c, d) AS (SELECT doc_id, page, greatest(0, line_no - {BEFORE}), least(n_lines, line_no + {AFTER + 1}), field_ord, 0, page, line_no FROM hits {scripts} {heads}),
  ranked AS (SELECT w.*, budget, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c, d, page, "start", "end") AS turn FROM wanted w JOIN decided USING (doc_id) WHERE NOT whole_fits),
  sized AS (SELECT r.doc_id, r.turn, r.page, r."start", r."end", r.budget, (sum(length(l.line) + 1) + {MARGIN})::INTEGER AS size FROM ranked r
    JOIN lines l ON l.doc_id = r.doc_id AND l.page = r.page AND l.line_no >= r."start" AND l.line_no < r."end" GROUP BY ALL),
  walk AS (SELECT doc_id, 0::BIGINT AS turn, []::BIGINT[] AS kept, 0 AS used, false AS truncated FROM (SELECT DISTINCT doc_id FROM sized)
    UNION ALL SELECT w.doc_id, s.turn, CASE WHEN w.used + s.size <= s.budget THEN list_append(w.kept, s.turn) ELSE w.kept END, w.used + CASE WHEN w.used + s.size <= s.budget THEN s.size ELSE 0 END, w.truncated OR w.used + s.size > s.budget
    FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.turn = w.turn + 1),
  taken AS (SELECT doc_id, arg_max(kept, turn) AS kept, arg_max(truncated, turn) AS truncated FROM walk GROUP BY doc_id),
  source AS (SELECT s.doc_id, s.page, s."start", s."end" FROM sized s JOIN taken c ON c.doc_id = s.doc_id AND list_contains(c.kept, s.turn)), {_MERGED},
  spans AS (SELECT doc_id, page, min("start") AS "start", max("end") AS "end" FROM islands GROUP BY doc_id, page, island),
  pieces AS (SELECT s.doc_id, s.page, s."start", string_agg(l.line, chr(10) ORDER BY l.line_no) AS piece FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.page = s.page AND l.line_no >= s."start" AND l.line_no < s."end" GROUP BY 1, 2, 3),
  by_page AS (SELECT doc_id, page, string_agg(piece, chr(10) || '[...]' || chr(10) ORDER BY "start") AS piece FROM pieces GROUP BY doc_id, page),
  selected AS (SELECT doc_id, string_agg('<<<PAGE ' || page || '>>>' || chr(10) || piece, chr(10) ORDER BY page) AS text, list(page ORDER BY page) AS pages FROM by_page GROUP BY doc_id),
  put AS (SELECT d.doc_id, CASE WHEN whole_fits THEN whole WHEN truncated IS NULL THEN substring(whole, 1, budget) ELSE coalesce(s.text, '') END AS text, whole, whole_fits, whole_pages, s.pages AS own, truncated, budget
    FROM decided d LEFT JOIN taken USING (doc_id) LEFT JOIN selected s USING (doc_id))
  SELECT doc_id, text, CASE WHEN whole_fits THEN 'full' ELSE 'selected' END AS strategy, CASE WHEN whole_fits OR truncated IS NULL THEN whole_pages ELSE coalesce(own, []) END AS pages, length(text)::INTEGER AS characters, budget,
    CASE WHEN whole_fits THEN false WHEN truncated IS NULL THEN length(whole) > budget ELSE truncated END AS truncated FROM put"""


QUERIES = {
    "X7_normalise_pages": (
        lambda s, d: lines(B.pages(s, d), T.repair_text("text")).select("doc_id", "page", "line_no", "line"),
        f"WITH {REPAIRED_SQL}, {_REPAIRED_LINES} SELECT doc_id, page, line_no, line FROM lines",
    ),
    "X7_lines": (lambda s, d: lines(B.pages(s, d)).select("doc_id", "page", "line_no", "line"), f"WITH {_LINES} SELECT doc_id, page, line_no, line FROM lines"),
    "X8_render": (
        lambda s, d: rendered(lines(B.pages(s, d))).select("doc_id", "text"),
        f"""WITH {_LINES}, bodies AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY doc_id, page)
        SELECT doc_id, string_agg('<<<PAGE ' || page || '>>>' || chr(10) || body, chr(10) ORDER BY page) AS text FROM bodies GROUP BY doc_id""",
    ),
    "X9_build_context": (lambda s, d: build_context(B.pages(s, d), LABELS), _context_sql(LABELS, T.MAX_CHARACTERS)),
    "X9_build_context_small": (lambda s, d: build_context(B.pages(s, d), LABELS, max_characters=BUDGET), _context_sql(LABELS, BUDGET)),
    "X9_build_context_arabic": (lambda s, d: build_context(B.pages(s, d), ARABIC_LABELS, max_characters=BUDGET), _context_sql(ARABIC_LABELS, BUDGET)),
    "J5_label_hits": (
        lambda s, d: label_hits(_own(s, d), LABELS, _lower).select("doc_id", "page", "line_no", "field_ord", "term_ord"),
        f"WITH {_HITS} SELECT doc_id, page, line_no, field_ord, term_ord FROM hits",
    ),
    "W2_label_windows": (_windows, f'WITH {_HITS} SELECT doc_id, page, field_ord, line_no, "start", "end" FROM windows'),
    "W3_script_windows": (
        lambda s, d: script_windows(_own(s, d), ARABIC_LABELS).select("doc_id", "page", "line_no", "start", "end", "field_id"),
        f"""WITH {_LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS rank FROM lines WHERE regexp_matches(line, '{T.ARABIC}'))
        SELECT doc_id, page, line_no, greatest(0, line_no - 4)::INTEGER AS "start", least(n_lines, line_no + 7)::INTEGER AS "end", field_id
        FROM ranked, (VALUES ('name'), ('file')) AS f(field_id) WHERE rank <= 24""",
    ),
    "W4_head_windows": (lambda s, d: head_windows(_own(s, d)), f"WITH {_HITS} SELECT * FROM heads"),
    "W1_merge_windows": (
        lambda s, d: merged(_windows(s, d)),
        f"""WITH {_HITS}, source AS (SELECT doc_id, page, "start", "end" FROM windows), {_MERGED}
        SELECT doc_id, page, min("start") AS "start", max("end") AS "end" FROM islands GROUP BY doc_id, page, island""",
    ),
    "U3_window_union": (
        lambda s, d: head_windows(_own(s, d)).withColumn("kind", F.lit("head")).unionByName(_windows(s, d).select("doc_id", "page", "start", "end", F.lit("label").alias("kind"))),
        f"""WITH {_HITS} SELECT *, 'head' AS kind FROM heads UNION ALL SELECT doc_id, page, "start", "end", 'label' AS kind FROM windows""",
    ),
    "J6_window_lines": (
        _excerpts,
        f"""WITH {_HITS}, source AS (SELECT doc_id, page, "start", "end" FROM windows), {_MERGED},
        m AS (SELECT doc_id, page, min("start") AS "start", max("end") AS "end" FROM islands GROUP BY doc_id, page, island)
        SELECT m.doc_id, m.page, m."start", m."end", string_agg(l.line, chr(10) ORDER BY l.line_no) AS excerpt
        FROM m JOIN lines l ON l.doc_id = m.doc_id AND l.page = m.page AND l.line_no >= m."start" AND l.line_no < m."end" GROUP BY 1, 2, 3, 4""",
    ),
    "W5_budget_fill": (
        lambda s, d: fill(_sized(s, d), F.lit(BUDGET)).select("doc_id", F.size("kept").alias("n_kept"), "used", "truncated"),
        f"""{_SIZED},
        walk AS (SELECT doc_id, 0::BIGINT AS priority, 0 AS n_kept, 0 AS used, false AS truncated FROM (SELECT DISTINCT doc_id FROM sized)
          UNION ALL
          SELECT w.doc_id, s.priority, w.n_kept + (w.used + s.size <= {BUDGET})::INTEGER, w.used + CASE WHEN w.used + s.size <= {BUDGET} THEN s.size ELSE 0 END,
                 w.truncated OR w.used + s.size > {BUDGET} FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.priority = w.priority + 1)
        SELECT doc_id, arg_max(n_kept, priority)::INTEGER AS n_kept, arg_max(used, priority)::INTEGER AS used, arg_max(truncated, priority) AS truncated FROM walk GROUP BY doc_id""",
    ),
}
