"""From stored pages to searchable documents: what to read, in which language, merged and written."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import asdict
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import base as B
from pageloom.operators import detection, documents, images
from pageloom.operators.image_queries import drawn_pages
from pageloom.session import parted, shared_folder, table
from pageloom.sources.archives import entries_of
from pageloom.sources.backends import BlankRenderer, DigitRecogniser, drawn_digits
from pageloom.sources.files import written_file
from pageloom.sources.pdf import PdfWriter, read_pages
from pageloom.sources.settings import Limits


def digit_page(doc_id: int, page: int, dpi: int):
    """The image of a page where none is stored: its document's and its own number, in block digits."""
    return drawn_digits(f"{doc_id} {page}")


def recognised(work: DataFrame, reader=None, render=digit_page, psm: int = 3) -> DataFrame:
    """``doc_id, page, text`` of rows ``doc_id, page, lang, dpi``: each page is rendered, made ready and read; one that fails is empty and fails no other."""
    reader = reader or DigitRecogniser()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for r in batch.itertuples(index=False):
                try:
                    texts.append(reader.read_image(images.prepared(render(int(r.doc_id), int(r.page), int(r.dpi))), r.lang, int(r.dpi), psm))
                except Exception:  # noqa: BLE001 a reader's failure concerns its page only
                    texts.append("")
            yield batch[["doc_id", "page"]].assign(text=texts)

    return parted(work.select("doc_id", "page", "lang", "dpi")).mapInPandas(run, "doc_id long, page int, text string")


def searchable_pages(docs: DataFrame, pages: DataFrame, findings: DataFrame, reader=None) -> DataFrame:
    """``doc_id, page, text, source``: stored text where there is enough, else what is recognised in the page's language."""
    work = documents.work_list(docs, pages)
    langs = detection.language_for_page(work, findings, docs.select("doc_id", "language"))
    dpi = findings.groupBy("doc_id").agg(detection.median_dpi(F.collect_list("native_dpi")).alias("dpi"))
    todo = langs.join(dpi, "doc_id", "left").select("doc_id", "page", "lang", F.coalesce("dpi", F.lit(300)).alias("dpi"))
    spine = docs.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    own = spine.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left")
    return documents.merged_pages(own, recognised(todo, reader))


def _files(batches: Iterator[pd.DataFrame], folder: str, put) -> Iterator[tuple]:
    """Write rows sorted by document as one PDF each, ``put`` adding a row's page; document, path, pages and bytes of each."""
    for doc, own in groupby((r for batch in batches for r in batch.itertuples(index=False)), lambda r: r.doc_id):
        with written_file(folder, f"{doc}.pdf") as file:
            writer = PdfWriter(file)
            for r in own:
                put(writer, r)
            n, size = len(writer.kids), writer.close()
        yield doc, f"{folder}/{doc}.pdf", n, size


def write_documents(pages: DataFrame, folder: str) -> DataFrame:
    """``doc_id, path, pages, bytes``: one PDF for each document, its pages in order.

    Rows are brought together by document and sorted; each task then writes
    page after page, so a document of any length needs the memory of one page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(list(_files(batches, folder, lambda writer, r: writer.page(r.text or ""))), columns=["doc_id", "path", "pages", "bytes"])

    ordered = pages.select("doc_id", "page", "text").repartition("doc_id").sortWithinPartitions("doc_id", "page")
    return ordered.mapInPandas(run, "doc_id long, path string, pages int, bytes long")


def pdf_pages(files: DataFrame) -> DataFrame:
    """``path, page, width, height, text`` of rows ``path, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch["path"], batch["content"]) for x in read_pages(c)]
            yield pd.DataFrame(rows, columns=["path", "page", "width", "height", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, width double, height double, text string")


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """``archive, entries``: one ZIP for each ``archive`` of rows ``archive, ord, name, content``, written entry by entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        for archive, own in groupby((r for batch in batches for r in batch.itertuples(index=False)), lambda r: r.archive):
            with written_file(folder, f"{archive}.zip") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as opened:
                for r in own:
                    opened.writestr(r.name, bytes(r.content))
                done.append((archive, len(opened.filelist)))
        yield pd.DataFrame(done, columns=["archive", "entries"])

    ordered = entries.select("archive", "ord", "name", "content").repartition("archive").sortWithinPartitions("archive", "ord")
    return ordered.mapInPandas(run, "archive string, entries int")


# --- queries ------------------------------------------------------------------


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _searchable(s, d):
    return searchable_pages(B.documents(s, d).where("status = 'done'"), B.pages(s, d), B.findings(s, d))


def _written(s, d):
    folder = _folder(s, "documents")
    return folder, write_documents(_searchable(s, d), folder)


def _read_back(s, d):
    folder, out = _written(s, d)
    out.write.format("noop").mode("overwrite").save()
    return s.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def _zipped(s, d):
    folder = _folder(s, "archives")
    names = documents.safe_names(B.uploads(s, d)).select(F.col("batch_id").alias("archive"), "ord", F.regexp_replace("name", "/", "_").alias("name"), F.encode(F.repeat(F.concat("name", F.lit(" ")), 30), "utf-8").alias("content"))
    write_archives(names, folder).write.format("noop").mode("overwrite").save()
    return s.read.format("binaryFile").load(folder)


def _cleaned_files(s, d):
    folder = _folder(s, "cleaned")
    pages = images.clean_pages(drawn_pages(B.findings(s, d)), restore=True).where("error is null")

    def put(writer: PdfWriter, r) -> None:
        scale = min(595.0 / r.width, 842.0 / r.height)
        writer.page("", r.width * scale, r.height * scale, bytes(r.data), (r.height, r.width))

    def run(batches):
        yield pd.DataFrame([(doc, n, size) for doc, _, n, size in _files(batches, folder, put)], columns=["doc_id", "pages", "bytes"])

    return pages.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInPandas(run, "doc_id long, pages int, bytes long")


def previews(pages: DataFrame, edge: int = 90) -> DataFrame:
    """``doc_id, page, height, width, data``: page images no longer than ``edge``; smaller ones stay as they are."""
    from pageloom.functions.planes import resampled

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a, longest = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3), max(r.height, r.width)
                if longest > edge:
                    a = resampled(a, tuple(max(1, round(n * edge / longest)) for n in a.shape[:2]), "bilinear")
                out.append((r.doc_id, r.page, *a.shape[:2], a.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "page", "height", "width", "data"])

    return pages.select("doc_id", "page", "height", "width", "data").mapInPandas(run, "doc_id long, page int, height int, width int, data binary")


def _previews(s, d):
    wanted = B.findings(s, d).groupBy("doc_id").agg(documents.preview_pages(F.collect_list("page")).alias("p")).select("doc_id", F.explode("p").alias("page"))
    return previews(drawn_pages(B.findings(s, d).join(wanted, ["doc_id", "page"]))).select("doc_id", "page", "height", "width", F.octet_length("data").alias("bytes"))


_DONE_PAGES = f"WITH {B.DOCS} SELECT doc_id, page_count AS pages FROM docs WHERE status = 'done' AND page_count > 0"

_WORK = f"""{B.DOCS}, {B.PAGES}, work AS (SELECT doc_id, page FROM (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0) t
    WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.doc_id = t.doc_id AND p.page = t.page AND length({B.stripped_sql("coalesce(text, '')")}) >= 20))"""

QUERIES = {
    "S1_landed_uploads": (
        lambda s, d: _zipped(s, d).select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("batch_id"), (F.col("length") > 0).alias("landed")),
        f"WITH {B.UPLOADS} SELECT DISTINCT batch_id, true AS landed FROM uploads",
    ),
    "S2_extract_archives": (
        lambda s, d: entries_of(_zipped(s, d)).select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("batch_id"), "ord", "name", "file_size", "error"),
        f"""WITH {documents.NAMED_SQL}, own AS (SELECT batch_id, name, ord FROM named WHERE regexp_matches(lower(name), '\\.pdf$') AND NOT starts_with(name, '.')),
        k AS (SELECT batch_id, count(o.name) AS n FROM (SELECT DISTINCT batch_id FROM uploads) u LEFT JOIN own o USING (batch_id) GROUP BY batch_id)
        SELECT batch_id, (row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1)::INTEGER AS ord, name, 30 * (strlen(name) + 1) AS file_size, NULL::VARCHAR AS error FROM own JOIN k USING (batch_id) WHERE n <= 100
        UNION ALL SELECT batch_id, NULL, NULL, NULL, CASE WHEN n = 0 THEN 'empty_zip' ELSE 'too_many_files' END FROM k WHERE n = 0 OR n > 100""",
    ),
    "S3_pdf_page_counts": (
        lambda s, d: pdf_pages(_read_back(s, d)).groupBy(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("pages"), F.max("width").alias("width"), F.max("height").alias("height")),
        f"WITH {B.DOCS} SELECT doc_id, page_count AS pages, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height FROM docs WHERE status = 'done' AND page_count > 0",
    ),
    "S6_render_pages": (
        lambda s, d: documents.work_list(B.documents(s, d), B.pages(s, d)).mapInPandas(
            lambda batches: (b.assign(height=[BlankRenderer().render(b"", p, 72).shape[0] for p in b["page"]]) for b in batches), "doc_id long, page int, height int"
        ),
        f"""WITH {B.DOCS}, {B.PAGES} SELECT doc_id, page, 842 AS height FROM (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0) t
        WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.doc_id = t.doc_id AND p.page = t.page AND length({B.stripped_sql("coalesce(text, '')")}) >= 20)""",
    ),
    "K1_searchable_pdf": (lambda s, d: write_documents(_searchable(s, d), _folder(s, "documents")).select("doc_id", "pages"), _DONE_PAGES),
    "K3_cleaned_pdf": (
        lambda s, d: _cleaned_files(s, d).select("doc_id", "pages"),
        f"WITH {B.FINDINGS} SELECT doc_id, count(*)::INTEGER AS pages FROM findings GROUP BY doc_id",
    ),
    "K6_previews": (
        _previews,
        f"""WITH {B.FINDINGS} SELECT doc_id, page, 35 AS height, 90 AS width, 35 * 90 * 3 AS bytes FROM
        (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rk FROM findings) WHERE rk <= 10""",
    ),
    "R1_ocr_page_pdf": (
        lambda s, d: recognised(detection.language_for_page(documents.work_list(B.documents(s, d), B.pages(s, d)), B.findings(s, d), B.documents(s, d).select("doc_id", "language")).withColumn("dpi", F.lit(300))),
        f"WITH {_WORK} SELECT doc_id, page, doc_id || ' ' || page AS text FROM work",
    ),
    "R2_ocr_image_text": (
        lambda s, d: recognised(B.findings(s, d).select("doc_id", "page", F.coalesce("lang", F.lit("eng")).alias("lang"), "dpi")),
        f"WITH {B.FINDINGS} SELECT doc_id, page, doc_id || ' ' || page AS text FROM findings",
    ),
    "R4_make_searchable": (
        _searchable,
        f"""WITH {B.DOCS}, {B.PAGES}, spine AS (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM docs WHERE page_count > 0 AND status = 'done'),
        j AS (SELECT s.doc_id, s.page, p.text, coalesce(length({B.stripped_sql("coalesce(p.text, '')")}) >= 20, false) AS keeps FROM spine s LEFT JOIN pages p USING (doc_id, page))
        SELECT doc_id, page, CASE WHEN keeps THEN text ELSE doc_id || ' ' || page END AS text, CASE WHEN keeps THEN 'native' ELSE 'recognised' END AS source FROM j""",
    ),
    "S9_settings": (
        lambda s, d: s.createDataFrame(sorted((k, int(v)) for k, v in asdict(Limits.from_environment()).items()), "name string, value int"),
        "SELECT * FROM (VALUES ('detect_all_pages', 12), ('max_age_min', 240), ('max_batch_mb', 500), ('max_mb', 100), ('page_jobs', 4), ('ttl_min', 30)) t(name, value)" if Limits.from_environment() == Limits(100, 500, 30, 240, 4, 12) else None,
    ),
    "R5_dependencies": (
        lambda s, d: B.documents(s, d).select("doc_id", F.array_join(F.array_except(T.packs_of(F.col("language")), F.array(*map(F.lit, detection.installed()))), ",").alias("missing")),
        f"""WITH {B.DOCS} SELECT doc_id, array_to_string(list_filter(string_split(coalesce(language, ''), '+'), lambda x: x <> '' AND x NOT IN ({', '.join(f"'{x}'" for x in detection.installed())})), ',') AS missing FROM docs""",
    ),
    "F13_language_help": (
        lambda s, d: table(s, d, "lang_sample").select("pack").distinct().select("pack", F.when(F.col("pack").isin(*detection.installed()), "installed").otherwise("missing").alias("state")),
        f"""SELECT DISTINCT pack, CASE WHEN pack IN ({', '.join(f"'{x}'" for x in detection.installed())}) THEN 'installed' ELSE 'missing' END AS state FROM lang_sample""",
    ),
}
