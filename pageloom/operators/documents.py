"""Documents and pages: what is left to recognise, assembled texts, rollups, names and views."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import base as B
from pageloom.operators.text_queries import REPAIRED_SQL
from pageloom.session import table
from pageloom.sources.backends import capabilities

MIN_CHARS, MAX_FILES, MAX_TOTAL, MAX_RATIO = 20, 100, 500 * 1024 * 1024, 200
MAX_SINGLE = 100 * 1024 * 1024
#: Entries of an archive that are documents and not what archivers add, for Java and Python alike.
WANTED = r"^(?!__MACOSX/)(?!.*/\.,)(?:.*/)?[^/.][^/]*(?i:\.pdf)$"
#: The part of a path that names the file, what file systems refuse in a name, and the name of what has none left.
LAST_PART, NAME_CUTS, NAMELESS = r"[^\\/]*$", (r'[<>:"|?*]', r"^[. ]+|[. ]+$"), "document.pdf"


# --- pages --------------------------------------------------------------------


def pages_with_text(pages: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Pages whose stripped text has at least so many characters; null has none."""
    return pages.where(F.length(B.stripped(F.coalesce("text", F.lit("")))) >= least).select("doc_id", "page")


def work_list(documents: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """``doc_id, page``: pages 1 to ``page_count`` that have no usable text yet; all if ``force``."""
    every = documents.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return every if force else every.join(pages_with_text(pages), ["doc_id", "page"], "left_anti")


def assembled(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, text``: page texts 1 to ``page_count`` in order, joined by a blank line; absent pages are empty."""
    spine = documents.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    each = spine.join(pages, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def merged_pages(native: DataFrame, recognised: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``doc_id, page, text, source``: a page with enough text of its own keeps it, others take what was recognised."""
    own = native.select("doc_id", "page", F.col("text").alias("own"))
    new = recognised.select("doc_id", "page", F.col("text").alias("new"))
    keeps = F.length(B.stripped(F.coalesce("own", F.lit("")))) >= least
    return own.join(new, ["doc_id", "page"], "full").select(
        "doc_id", "page", F.when(keeps, F.col("own")).otherwise(F.coalesce("new", F.lit(""))).alias("text"), F.when(keeps, "native").otherwise("recognised").alias("source")
    )


def char_counts(before: Column, after: Column) -> Column:
    """Stripped lengths and whether recognition added enough to call the result searchable."""
    a, b = (F.length(B.stripped(F.coalesce(x, F.lit("")))) for x in (before, after))
    return F.struct(a.alias("chars_before"), b.alias("chars_after"), (b > a + MIN_CHARS).alias("searchable"))


# --- rollups ------------------------------------------------------------------


def output_mode(paper_std: Column, spread: Column, chroma: Column, wanted: Column | None = None) -> Column:
    """How a page is to be stored; a mode that is named is kept, an unknown one means gray."""
    scattered = (paper_std > 0.06) | (spread > 0.35)
    own = F.when(scattered & (chroma <= 0.05), "binary").when(chroma > 0.05, "color").otherwise("gray")
    if wanted is None:
        return own
    name = F.lower(F.coalesce(wanted, F.lit("auto")))
    return F.when(name == "auto", own).when(name.isin("gray", "color", "binary", "document"), name).otherwise("gray")


def _round4(x: Column) -> Column:
    """Four decimals of the binary value; ties that it holds exactly go to the even digit."""
    return F.rint(x * 10000) / 10000


def document_averages(metrics: DataFrame) -> DataFrame:
    """Means of the page metrics (null counts as 0), the most frequent mode (of equal ones that of the earliest page), any scaled page, the number of pages."""
    names = ["paper_std", "background_spread", "contrast", "chroma"]
    # one pass over the pages, whose metrics may be costly: sums of each mode, then of each document
    modes = metrics.groupBy("doc_id", "mode").agg(
        F.count("*").alias("n"), F.min("page").alias("first"), F.bool_or("scaled").alias("scaled"), *(F.sum(F.coalesce(n, F.lit(0.0))).alias(n) for n in names)
    )
    return modes.groupBy("doc_id").agg(
        *(_round4(F.sum(n) / F.sum("n")).alias(n) for n in names), F.bool_or("scaled").alias("scaled"), F.sum("n").alias("pages"),
        F.max_by("mode", F.struct("n", (-F.col("first")).alias("first"))).alias("mode"),
    )


#: What is told of a failure.
SAID = {"password_protected": "This PDF is password protected.", "corrupt_pdf": "This PDF could not be read; it may be damaged."}


def classified(message: Column) -> Column:
    """A code for a failure by its message; what the message says comes before anything else."""
    m = F.lower(F.coalesce(message, F.lit("")))
    code = (
        F.when(F.contains(m, F.lit("password")) | F.contains(m, F.lit("encrypt")), "password_protected")
        .when(F.contains(m, F.lit("eof")) | F.contains(m, F.lit("damaged")) | F.contains(m, F.lit("startxref")), "corrupt_pdf").otherwise("processing_failed")
    )
    said = F.when(code == "password_protected", SAID["password_protected"]).when(code == "corrupt_pdf", SAID["corrupt_pdf"])
    return F.struct(code.alias("code"), F.coalesce(said, F.concat(F.lit("OCR failed: "), F.substring(F.coalesce(message, F.lit("")), 1, 200))).alias("message"))


def job_rollup(documents: DataFrame) -> DataFrame:
    """``job_id, status, chars_after, searchable, documents_done, error_code``: done with any document done, else the first one's error."""
    done = F.col("status") == "done"
    return documents.groupBy("job_id").agg(
        F.when(F.bool_or(done), "done").otherwise("error").alias("status"),
        F.coalesce(F.sum(F.when(done, F.col("chars_after"))), F.lit(0)).cast("long").alias("chars_after"),
        F.coalesce(F.bool_or(F.when(done, F.col("searchable"))), F.lit(False)).alias("searchable"),
        F.count_if(done).alias("documents_done"),
        F.when(~F.bool_or(done), F.coalesce(F.min_by("error.code", F.struct("doc_index", "doc_id")), F.lit("processing_failed"))).alias("error_code"),
    )


def upload_checks(uploads: DataFrame) -> DataFrame:
    """``batch_id, n_files, declared, actual, code``: the first limit that a batch breaks, null if none."""
    low = F.lower("filename")
    odd = ~(low.endswith(".pdf") | low.endswith(".zip"))
    g = uploads.groupBy("batch_id").agg(
        F.count_if(F.coalesce("filename", F.lit("")) != "").alias("n_files"), F.coalesce(F.sum("declared_bytes"), F.lit(0)).cast("long").alias("declared"),
        F.coalesce(F.sum("actual_bytes"), F.lit(0)).cast("long").alias("actual"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd"), F.coalesce(F.bool_or(low.endswith(".zip")), F.lit(False)).alias("zip"),
    )
    limit = F.when(F.col("n_files") == 1, MAX_SINGLE).otherwise(MAX_TOTAL)
    code = (
        F.when(F.col("n_files") == 0, "no_file").when(F.col("n_files") > MAX_FILES, "too_many_files").when(F.col("odd"), "unsupported_type")
        .when((F.col("n_files") > 1) & F.col("zip"), "mixed_uploads").when((F.col("declared") > limit) | (F.col("actual") > limit), "file_too_large")
    )
    return g.select("batch_id", "n_files", "declared", "actual", code.alias("code"))


def wanted_entry(name: Column) -> Column:
    """Is an archive entry a document, and not what archivers add?"""
    return name.rlike(WANTED)


def archive_checks(entries: DataFrame) -> DataFrame:
    """``archive_id, n_entries, unpacked, packed, code`` over the wanted entries ``archive_id, name, file_size, compress_size``."""
    w = wanted_entry(F.col("name"))
    g = entries.groupBy("archive_id").agg(
        F.count_if(w).alias("n_entries"), F.coalesce(F.sum(F.when(w, F.col("file_size"))), F.lit(0)).cast("long").alias("unpacked"), F.coalesce(F.sum(F.when(w, F.col("compress_size"))), F.lit(0)).cast("long").alias("packed")
    )
    code = (
        F.when(F.col("n_entries") == 0, "empty_zip").when(F.col("n_entries") > MAX_FILES, "too_many_files").when(F.col("unpacked") > MAX_TOTAL, "zip_too_large")
        .when(F.col("unpacked") / F.greatest("packed", F.lit(1)) > MAX_RATIO, "suspicious_zip")
    )
    return g.select("archive_id", "n_entries", "unpacked", "packed", code.alias("code"))


# --- names --------------------------------------------------------------------


def bare_name(name: Column) -> Column:
    """The last part of a path without signs that file systems refuse; a default for nothing."""
    clean = B.stripped(F.regexp_extract(F.coalesce(name, F.lit("")), LAST_PART, 0))
    for cut in NAME_CUTS:
        clean = F.regexp_replace(clean, cut, "")
    return F.when(clean == "", NAMELESS).otherwise(clean)


def _numbered(base: str, n: int) -> str:
    stem, dot, ext = base.rpartition(".")
    return f"{stem} ({n}).{ext}" if dot and stem else f"{base} ({n})"


def named_apart(names: list[str]) -> list[str]:
    """Names in order, each taken one followed by the next free number; letter case doesn't tell names apart."""
    taken: set[str] = set()
    out = []
    for base in names:
        own, n = base, 2
        while own.lower() in taken:
            own, n = _numbered(base, n), n + 1
        taken.add(own.lower())
        out.append(own)
    return out


def safe_names(uploads: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """``batch_id, ord, filename, name``: names that are distinct in their batch, in the order of ``ord``.

    Only names with one root (that is, without numbers in brackets) can meet.
    Where no name of a root carries such a number, the place among equal names
    gives the number; the others are named one after another, which batches
    within the limit of ``max_files`` bound. Larger batches, which are refused
    anyway, are numbered by place.
    """
    base = uploads.select("batch_id", "ord", "filename", bare_name(F.col("filename")).alias("base"))
    root = F.lower(F.regexp_replace("base", r"(?: \(\d+\))+(?=(?:\.[^.]*)?$)", ""))
    keyed = base.withColumn("root", root).withColumn("plain", F.lower("base") == F.col("root"))
    facts = keyed.groupBy("batch_id", "root").agg(F.bool_and("plain").alias("simple"), F.count("*").alias("n"))
    keyed = keyed.join(facts, ["batch_id", "root"])
    direct = F.col("simple") | (F.col("n") > max_files)
    place = F.row_number().over(Window.partitionBy("batch_id", F.lower("base")).orderBy("ord", "filename"))
    ext = F.regexp_extract("base", r"^.+(\.[^.]*)$", 1)
    stem = F.expr("substring(base, 1, length(base) - length(ext))")
    one = keyed.where(direct).withColumn("place", place).withColumn("ext", ext).select(
        "batch_id", "ord", "filename", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat(stem, F.lit(" ("), F.col("place").cast("string"), F.lit(")"), "ext")).alias("name")
    )

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ord", "filename"], kind="stable")
        return group[["batch_id", "ord", "filename"]].assign(name=named_apart(group["base"].tolist()))

    rest = keyed.where(~direct).select("batch_id", "ord", "filename", "base", "root").groupBy("batch_id", "root").applyInPandas(fold, "batch_id string, ord int, filename string, name string")
    return one.unionByName(rest)


def upload_names(uploads: DataFrame) -> DataFrame:
    """``batch_id, ord, name, is_zip``: a single upload keeps a plain name, several are named apart."""
    counts = uploads.groupBy("batch_id").agg(F.count("*").alias("n"))
    plain = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.regexp_replace("filename", r"[\\ ]", "/"), "/"), -1), r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
    plain = F.when(F.lower(plain).rlike(r"\.(pdf|zip)$"), plain).otherwise(F.col("name"))
    return safe_names(uploads).join(counts, "batch_id").select("batch_id", "ord", F.when(F.col("n") == 1, plain).otherwise(F.col("name")).alias("name"), F.lower("filename").endswith(".zip").alias("is_zip"))


def preview_pages(pages: Column, count: int = 10) -> Column:
    """The first pages; no count, or 0, means the default."""
    return F.slice(F.sort_array(F.array_distinct(pages)), 1, count or 10)


# --- queries ------------------------------------------------------------------

_STRIP = B.stripped_sql("coalesce(text, '')")
def _entries(s, d):
    return B.uploads(s, d).select(F.col("batch_id").alias("archive_id"), F.concat(F.when(F.col("ord") % 5 == 4, "__MACOSX/").otherwise("in/"), "filename").alias("name"), F.col("declared_bytes").alias("file_size"), (F.col("actual_bytes") / 150).cast("long").alias("compress_size"))


_ENTRIES = f"""{B.UPLOADS}, entries AS (SELECT batch_id AS archive_id, CASE WHEN ord % 5 = 4 THEN '__MACOSX/' ELSE 'in/' END || filename AS name, declared_bytes AS file_size,
  trunc(actual_bytes / 150)::BIGINT AS compress_size FROM uploads),
  wanted AS (SELECT *, NOT starts_with(string_split(name, '/')[-1], '.') AND string_split(name, '/')[-1] <> '' AND NOT starts_with(name, '__MACOSX/') AND NOT contains(name, '/.,')
    AND ends_with(lower(name), '.pdf') AS w FROM entries)"""

#: Names by a walk through each batch: a name that is taken gets the next free number.
NAMED_SQL = f"""RECURSIVE {B.UPLOADS}, bare AS (SELECT *, CASE WHEN b = '' THEN 'document.pdf' ELSE b END AS base FROM
    (SELECT batch_id, ord, filename, regexp_replace(regexp_replace({B.stripped_sql("regexp_extract(coalesce(filename, ''), '[^\\/]*$')")}, '[<>:"|?*]', '', 'g'), '^[. ]+|[. ]+$', '', 'g') AS b FROM uploads)),
  turns AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord, filename) AS turn, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext FROM bare),
  walk AS (SELECT batch_id, ord, filename, base AS name, turn, [lower(base)] AS taken FROM turns WHERE turn = 1
    UNION ALL SELECT t.batch_id, t.ord, t.filename, n.name, t.turn, list_append(w.taken, lower(n.name)) FROM walk w JOIN turns t ON t.batch_id = w.batch_id AND t.turn = w.turn + 1,
      LATERAL (SELECT CASE WHEN NOT list_contains(w.taken, lower(t.base)) THEN t.base ELSE
        list_filter(list_transform(range(2, 102), lambda i: left(t.base, length(t.base) - length(t.ext)) || ' (' || i || ')' || t.ext), lambda x: NOT list_contains(w.taken, lower(x)))[1] END AS name) n),
  named AS (SELECT * FROM walk)"""

QUERIES = {
    "F2_pages_with_text": (lambda s, d: pages_with_text(B.pages(s, d)), f"WITH {B.PAGES} SELECT doc_id, page FROM pages WHERE length({_STRIP}) >= 20"),
    "F3_page_work_list": (
        lambda s, d: work_list(B.documents(s, d), B.pages(s, d)),
        f"""WITH {B.DOCS}, {B.PAGES} SELECT doc_id, page FROM (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0) t
        WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.doc_id = t.doc_id AND p.page = t.page AND length({_STRIP}) >= 20)""",
    ),
    "U1_pages_minus_skip": (
        lambda s, d: work_list(B.documents(s, d), B.pages(s, d), force=True).exceptAll(pages_with_text(B.pages(s, d))),
        f"""WITH {B.DOCS}, {B.PAGES} SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0
        EXCEPT SELECT doc_id, page FROM pages WHERE length({_STRIP}) >= 20""",
    ),
    "J3_page_text_assembly": (
        lambda s, d: assembled(B.documents(s, d), B.pages(s, d)),
        f"""WITH {B.DOCS}, {B.PAGES}, spine AS (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0)
        SELECT s.doc_id, string_agg(coalesce(p.text, ''), chr(10) || chr(10) ORDER BY s.page) AS text FROM spine s LEFT JOIN pages p USING (doc_id, page) GROUP BY s.doc_id""",
    ),
    "S4_read_text": (
        lambda s, d: B.pages(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n").alias("text")),
        f"WITH {B.PAGES} SELECT doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_id",
    ),
    "S5_read_pages_text": (lambda s, d: B.pages(s, d).select("doc_id", "page", T.repair_text("text").alias("text")), f"WITH {REPAIRED_SQL} SELECT doc_id, page, text FROM repaired"),
    "J4_page_merge": (
        lambda s, d: merged_pages(B.pages(s, d), work_list(B.documents(s, d), B.pages(s, d)).select("doc_id", "page", F.concat(F.lit("read "), "doc_id", F.lit("/"), "page").alias("text"))),
        f"""WITH {B.DOCS}, {B.PAGES}, b AS (SELECT doc_id, page, 'read ' || doc_id || '/' || page AS new FROM (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0) t
          WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.doc_id = t.doc_id AND p.page = t.page AND length({_STRIP}) >= 20)),
        j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, a.text AS own, new, length({B.stripped_sql("coalesce(a.text, '')")}) >= 20 AS keeps FROM pages a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page)
        SELECT doc_id, page, CASE WHEN keeps THEN own ELSE coalesce(new, '') END AS text, CASE WHEN keeps THEN 'native' ELSE 'recognised' END AS source FROM j""",
    ),
    "J9_image_page_size": (
        lambda s, d: B.findings(s, d).alias("f").join(B.pages(s, d).alias("p"), ["doc_id", "page"]).select("doc_id", "page", F.round(F.least(F.lit(595.0) / (F.col("native_dpi") * 8), F.lit(842.0) / (F.col("native_dpi") * 11)), 6).alias("scale")),
        f"WITH {B.FINDINGS}, {B.PAGES} SELECT doc_id, page, round(least(595.0::DOUBLE / (native_dpi * 8), 842.0::DOUBLE / (native_dpi * 11)), 6) AS scale FROM findings JOIN pages USING (doc_id, page)",
    ),
    "A11_char_counts": (
        lambda s, d: B.documents(s, d).select("doc_id", char_counts(F.col("note"), F.col("text")).alias("c")).select("doc_id", "c.*"),
        f"""WITH {B.DOCS} SELECT doc_id, length({B.stripped_sql("coalesce(note, '')")})::INTEGER AS chars_before, length({_STRIP})::INTEGER AS chars_after,
        length({_STRIP}) > length({B.stripped_sql("coalesce(note, '')")}) + 20 AS searchable FROM docs""",
    ),
    "A12_size_totals": (
        lambda s, d: B.uploads(s, d).groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("declared_bytes").cast("long").alias("declared"), F.sum("actual_bytes").cast("long").alias("actual")),
        f"WITH {B.UPLOADS} SELECT batch_id, count(*) AS files, sum(declared_bytes)::BIGINT AS declared, sum(actual_bytes)::BIGINT AS actual FROM uploads GROUP BY batch_id",
    ),
    "A5_job_rollup": (
        lambda s, d: job_rollup(B.documents(s, d)),
        f"""WITH {B.DOCS} SELECT job_id, CASE WHEN bool_or(status = 'done') THEN 'done' ELSE 'error' END AS status, coalesce(sum(chars_after) FILTER (status = 'done'), 0)::BIGINT AS chars_after,
        coalesce(bool_or(searchable) FILTER (status = 'done'), false) AS searchable, count(*) FILTER (status = 'done') AS documents_done,
        CASE WHEN NOT bool_or(status = 'done') THEN coalesce(first(error.code ORDER BY doc_index, doc_id), 'processing_failed') END AS error_code FROM docs GROUP BY job_id""",
    ),
    "F9_classify_error": (
        lambda s, d: B.documents(s, d).where("error is not null").select("doc_id", classified(F.col("error.message")).alias("e")).select("doc_id", "e.code", "e.message"),
        f"""WITH {B.DOCS}, m AS (SELECT doc_id, lower(coalesce(error.message, '')) AS m, coalesce(error.message, '') AS said FROM docs WHERE error IS NOT NULL),
        c AS (SELECT *, CASE WHEN contains(m, 'password') OR contains(m, 'encrypt') THEN 'password_protected' WHEN contains(m, 'eof') OR contains(m, 'damaged') OR contains(m, 'startxref') THEN 'corrupt_pdf' ELSE 'processing_failed' END AS code FROM m)
        SELECT doc_id, code, CASE code WHEN 'password_protected' THEN 'This PDF is password protected.' WHEN 'corrupt_pdf' THEN 'This PDF could not be read; it may be damaged.' ELSE 'OCR failed: ' || substring(said, 1, 200) END AS message FROM c""",
    ),
    "F10_upload_checks": (
        lambda s, d: upload_checks(B.uploads(s, d)),
        f"""WITH {B.UPLOADS}, g AS (SELECT batch_id, count(*) FILTER (coalesce(filename, '') <> '') AS n_files, coalesce(sum(declared_bytes), 0)::BIGINT AS declared, coalesce(sum(actual_bytes), 0)::BIGINT AS actual,
          coalesce(bool_or(NOT (ends_with(lower(filename), '.pdf') OR ends_with(lower(filename), '.zip'))), false) AS odd, coalesce(bool_or(ends_with(lower(filename), '.zip')), false) AS zip FROM uploads GROUP BY batch_id)
        SELECT batch_id, n_files, declared, actual, CASE WHEN n_files = 0 THEN 'no_file' WHEN n_files > 100 THEN 'too_many_files' WHEN odd THEN 'unsupported_type' WHEN n_files > 1 AND zip THEN 'mixed_uploads'
          WHEN greatest(declared, actual) > CASE WHEN n_files = 1 THEN 104857600 ELSE 524288000 END THEN 'file_too_large' END AS code FROM g""",
    ),
    "F1_wanted_entries": (lambda s, d: _entries(s, d).where(wanted_entry(F.col("name"))).select("archive_id", "name"), f"WITH {_ENTRIES} SELECT archive_id, name FROM wanted WHERE w"),
    "F11_archive_checks": (
        lambda s, d: archive_checks(_entries(s, d)),
        f"""WITH {_ENTRIES}, g AS (SELECT archive_id, count(*) FILTER (w) AS n_entries, coalesce(sum(file_size) FILTER (w), 0)::BIGINT AS unpacked, coalesce(sum(compress_size) FILTER (w), 0)::BIGINT AS packed FROM wanted GROUP BY archive_id)
        SELECT *, CASE WHEN n_entries = 0 THEN 'empty_zip' WHEN n_entries > 100 THEN 'too_many_files' WHEN unpacked > 524288000 THEN 'zip_too_large' WHEN unpacked / greatest(packed, 1) > 200 THEN 'suspicious_zip' END AS code FROM g""",
    ),
    "X11_safe_names": (lambda s, d: safe_names(B.uploads(s, d)), f"WITH {NAMED_SQL} SELECT batch_id, ord, filename, name FROM named"),
    "X13_upload_names": (
        lambda s, d: upload_names(B.uploads(s, d)),
        f"""WITH {NAMED_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS k, regexp_replace(regexp_replace(string_split(regexp_replace(filename, '[\\\\ ]', '/', 'g'), '/')[-1], '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS plain FROM named)
        SELECT batch_id, ord, CASE WHEN k = 1 AND regexp_matches(lower(plain), '\\.(pdf|zip)$') THEN plain ELSE name END AS name, ends_with(lower(filename), '.zip') AS is_zip FROM n""",
    ),
    "F16_preview_pages": (
        lambda s, d: B.pages(s, d).groupBy("doc_id").agg(preview_pages(F.collect_list("page")).alias("p")).select("doc_id", F.explode("p").alias("page")),
        f"WITH {B.PAGES} SELECT doc_id, page FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rk FROM pages) WHERE rk <= 10",
    ),
    "F15_size_gate": (
        lambda s, d: B.findings(s, d).select("doc_id", "page", (F.col("native_dpi") * 11 > 2600).alias("scaled"), F.least(F.lit(2600), F.col("native_dpi") * 11).alias("edge"), F.round(F.least(F.lit(1.0), F.lit(2600.0) / (F.col("native_dpi") * 11)), 6).alias("factor")),
        f"WITH {B.FINDINGS} SELECT doc_id, page, native_dpi * 11 > 2600 AS scaled, least(2600, native_dpi * 11) AS edge, round(least(1.0::DOUBLE, 2600.0::DOUBLE / (native_dpi * 11)), 6) AS factor FROM findings",
    ),
    "K2_sidecar_text": (
        lambda s, d: assembled(B.documents(s, d).where("status = 'done'"), B.pages(s, d)).join(B.documents(s, d).select("doc_id", T.stem(F.col("filename")).alias("stem")), "doc_id").select(F.concat("stem", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), "text"),
        f"""WITH {B.DOCS}, {B.PAGES}, spine AS (SELECT doc_id, filename, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0 AND status = 'done')
        SELECT regexp_replace(any_value(filename), '^(.+)\\.[^.]*$', '\\1') || '-' || s.doc_id || '.txt' AS file, string_agg(coalesce(p.text, ''), chr(10) || chr(10) ORDER BY s.page) AS text FROM spine s LEFT JOIN pages p USING (doc_id, page) GROUP BY s.doc_id""",
    ),
    "K4_page_layout": (
        lambda s, d: B.findings(s, d).select("doc_id", "page", F.round(F.col("native_dpi") * 8 * F.least(F.lit(595.0) / (F.col("native_dpi") * 8), F.lit(842.0) / (F.col("native_dpi") * 11)), 4).alias("width"), F.round(F.col("native_dpi") * 11 * F.least(F.lit(595.0) / (F.col("native_dpi") * 8), F.lit(842.0) / (F.col("native_dpi") * 11)), 4).alias("height")),
        f"""WITH {B.FINDINGS}, q AS (SELECT doc_id, page, native_dpi, least(595.0::DOUBLE / (native_dpi * 8), 842.0::DOUBLE / (native_dpi * 11)) AS s FROM findings)
        SELECT doc_id, page, round(native_dpi * 8 * s, 4) AS width, round(native_dpi * 11 * s, 4) AS height FROM q""",
    ),
    "K5_result_entries": (
        lambda s, d: B.documents(s, d).where("status = 'done'").select("job_id", "doc_index", T.download_name(F.col("filename")).alias("entry")),
        f"WITH {B.DOCS} SELECT job_id, doc_index, regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') || '-searchable.pdf' AS entry FROM docs WHERE status = 'done'",
    ),
    "K8_text_endpoint": (
        lambda s, d: B.documents(s, d).where("status = 'done'").join(B.jobs(s, d).where("status = 'done'").select("job_id"), "job_id", "left_semi").select("job_id", F.col("doc_index").alias("index"), "filename", F.coalesce("text", F.lit("")).alias("text")),
        f"""WITH {B.DOCS}, {B.JOBS} SELECT job_id, doc_index AS "index", filename, coalesce(text, '') AS text FROM docs WHERE status = 'done' AND job_id IN (SELECT job_id FROM jobs WHERE status = 'done')""",
    ),
    "K9_document_lookup": (
        lambda s, d: B.documents(s, d).join(B.jobs(s, d).select("job_id", F.col("status").alias("job_status")), "job_id", "left").select("doc_id", F.when(F.col("job_status").isNull(), "job_not_found").when(F.col("status") != "done", "not_ready").alias("refused"), T.download_name(F.col("filename")).alias("download")),
        f"""WITH {B.DOCS}, {B.JOBS} SELECT doc_id, CASE WHEN j.status IS NULL THEN 'job_not_found' WHEN d.status <> 'done' THEN 'not_ready' END AS refused, regexp_replace(d.filename, '^(.+)\\.[^.]*$', '\\1') || '-searchable.pdf' AS download FROM docs d LEFT JOIN jobs j USING (job_id)""",
    ),
    "O4_sorted_pages": (
        lambda s, d: B.pages(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("pages")),
        f"WITH {B.PAGES} SELECT doc_id, string_agg(page, ',' ORDER BY page) AS pages FROM pages GROUP BY doc_id",
    ),
    "O5_top_per_group": (
        lambda s, d: B.tokens(s, d).where("conf is not null").withColumn("rk", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("conf"), "page", "tok_no"))).where("rk <= 3").select("doc_id", "rk", "page", "tok_no", "conf"),
        f"WITH {B.TOKENS} SELECT doc_id, rk, page, tok_no, conf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, page, tok_no)::INTEGER AS rk FROM tokens WHERE conf IS NOT NULL) WHERE rk <= 3",
    ),
    "O6_reorder_by_page": (
        lambda s, d: table(s, d, "page_text").groupBy("doc_id", "page").agg(F.min("seen_at").alias("done_at"), F.max("text").alias("text")).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "|"), 256).alias("digest")),
        f"WITH {B.PAGES} SELECT doc_id, sha256(string_agg(coalesce(text, ''), '|' ORDER BY page)) AS digest FROM pages GROUP BY doc_id",
    ),
    "M6_elapsed_age": (
        lambda s, d: B.jobs(s, d).select("job_id", (F.unix_timestamp("finished_at") - F.unix_timestamp("created_at")).alias("elapsed"), (F.unix_timestamp(F.lit("2024-03-02 00:00:00").cast("timestamp")) - F.unix_timestamp("created_at")).alias("age")),
        f"WITH {B.JOBS} SELECT job_id, (floor(epoch(finished_at)) - floor(epoch(created_at)))::BIGINT AS elapsed, (epoch(TIMESTAMPTZ '2024-03-02 00:00:00+00') - floor(epoch(created_at)))::BIGINT AS age FROM jobs",
    ),
    "M5_percentiles": (
        lambda s, d: B.tokens(s, d).where("conf > 0").groupBy("doc_id").agg(F.round(F.percentile("conf", 0.5), 6).alias("p50"), F.round(F.percentile("conf", 0.3), 6).alias("p30")),
        f"WITH {B.TOKENS} SELECT doc_id, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.3), 6) AS p30 FROM tokens WHERE conf > 0 GROUP BY doc_id",
    ),
    "R3_text_variants": (
        lambda s, d: B.pages(s, d).join(B.findings(s, d).where("lang = 'ara'").select("doc_id", "page", "dpi"), ["doc_id", "page"]).withColumn("psm", F.explode(F.array_except(F.array(F.lit(6), F.lit(11)), F.array(F.lit(6))))).where(B.stripped(F.coalesce("text", F.lit(""))) != "").select("doc_id", "page", "psm", F.greatest(F.lit(120), F.least("dpi", F.lit(220))).alias("dpi"), "text"),
        f"WITH {B.PAGES}, {B.FINDINGS} SELECT doc_id, page, 11 AS psm, greatest(120, least(dpi, 220)) AS dpi, text FROM pages JOIN findings USING (doc_id, page) WHERE lang = 'ara' AND {_STRIP} <> ''",
    ),
    "M2_clamp": (
        lambda s, d: B.findings(s, d).select("doc_id", "page", F.least(F.lit(450), F.greatest(F.lit(300), "native_dpi")).alias("dpi")),
        f"WITH {B.FINDINGS} SELECT doc_id, page, least(450, greatest(300, native_dpi)) AS dpi FROM findings",
    ),
    "M3_round4": (
        lambda s, d: B.tokens(s, d).where("conf is not null").select("doc_id", "page", "tok_no", F.round(F.col("conf") / 7, 4).alias("share")).distinct(),
        f"WITH {B.TOKENS} SELECT DISTINCT doc_id, page, tok_no, round(conf / 7, 4) AS share FROM tokens WHERE conf IS NOT NULL",
    ),
    "M4_fit_factor": (
        lambda s, d: B.findings(s, d).select("doc_id", "page", F.round(F.least(F.lit(1.0), F.lit(900.0) / (F.col("native_dpi") * 11)), 6).alias("factor")),
        f"WITH {B.FINDINGS} SELECT doc_id, page, round(least(1.0::DOUBLE, 900.0::DOUBLE / (native_dpi * 11)), 6) AS factor FROM findings",
    ),
    "M7_overlay_guard": (
        lambda s, d: B.findings(s, d).where(F.abs(F.col("native_dpi") * 8.27 - F.col("dpi") * 8.27) > 1.5).select("doc_id", "page"),
        f"WITH {B.FINDINGS} SELECT doc_id, page FROM findings WHERE abs(native_dpi * 8.27 - dpi * 8.27) > 1.5",
    ),
    "M8_default_jobs": (
        lambda s, d: B.documents(s, d).select("doc_id", F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce("page_count", F.lit(1)))).alias("jobs")),
        f"WITH {B.DOCS} SELECT doc_id, greatest(1, least(4, coalesce(page_count, 1))) AS jobs FROM docs",
    ),
    "M9_defaults": (
        lambda s, d: B.documents(s, d).select("doc_id", F.coalesce("pages_done", F.lit(0)).alias("pages_done"), F.coalesce("searchable", F.lit(False)).alias("searchable"), F.coalesce("note", F.lit("")).alias("note")),
        f"WITH {B.DOCS} SELECT doc_id, coalesce(pages_done, 0) AS pages_done, coalesce(searchable, false) AS searchable, coalesce(note, '') AS note FROM docs",
    ),
    "K10_capabilities": (lambda s, d: s.createDataFrame(sorted(capabilities().items()), "tool string, found boolean"), None),
}
