"""The queries of this subpackage, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import folding, languages, packing, privacy, scans, sentences, spans, splitting, tokens
from pageloom.llm.common import page_and_web_texts, spread
from pageloom.session import small_batches, table

CAPACITY = 2048


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def t(spark: SparkSession, d: str, name: str) -> DataFrame:
        small_batches(spark)
        return table(spark, d, name)

    def scanned(spark: SparkSession, d: str) -> DataFrame:
        small_batches(spark, 500)  # a page becomes lists of its words
        return table(spark, d, "page_text")

    def both(spark: SparkSession, d: str) -> DataFrame:
        return page_and_web_texts(t(spark, d, "documents"), t(spark, d, "page_text"))

    return {
        "p1_found": lambda s, d: scans.found(scanned(s, d)),
        "p1_paragraphs": lambda s, d: scans.paragraphs(scanned(s, d)),
        "p2_found": lambda s, d: splitting.found(t(s, d, "ocr_document"), t(s, d, "page_text")),
        "p2_pieces": lambda s, d: splitting.split(t(s, d, "ocr_document"), t(s, d, "page_text")),
        "p3_found": lambda s, d: languages.found(t(s, d, "documents"), t(s, d, "ocr_document"), t(s, d, "lang_sample")),
        "p3_languages": lambda s, d: languages.languages(t(s, d, "documents"), t(s, d, "ocr_document"), t(s, d, "lang_sample")),
        "p4_found": lambda s, d: privacy.found(t(s, d, "documents"), t(s, d, "page_text")),
        "p4_redacted": lambda s, d: privacy.redact(both(s, d)),
        "p4_collisions": lambda s, d: privacy.collisions(privacy.found(t(s, d, "documents"), t(s, d, "page_text"))),
        "p5_found": lambda s, d: sentences.found(t(s, d, "documents")),
        "p5_sentences": lambda s, d: sentences.split(
            t(s, d, "documents").select("doc_id", "text").unionByName(splitting.done_documents(t(s, d, "ocr_document"), t(s, d, "page_text")).select("doc_id", "text"))
        ),
        "p6_found": lambda s, d: folding.found(t(s, d, "documents"), t(s, d, "page_text")),
        "p6_plain_kinds": lambda s, d: folding.found(t(s, d, "documents"), t(s, d, "page_text")).where("kind <> 'lookalike'"),
        "p6_folded": lambda s, d: folding.fold(both(s, d)).select("doc_id", "page", "folded"),
        "p7_ids": lambda s, d: tokens.encode(spread(t(s, d, "documents").select("doc_id", "text"))),
        "p7_round_trip": lambda s, d: tokens.round_trip(t(s, d, "documents")),
        "p7_decoded": lambda s, d: tokens.decode(tokens.encode(spread(t(s, d, "documents").select("doc_id", "text")))).select("doc_id", F.md5("raw").alias("digest")),
        "p8_packed": lambda s, d: packing.pack_texts(t(s, d, "documents"), tokens.count, CAPACITY),
        "p9_found": lambda s, d: spans.shared_pairs(t(s, d, "documents")),
        "p9_links": lambda s, d: spans.links(t(s, d, "documents")),
        "p9_intervals": lambda s, d: spans.removal_intervals(t(s, d, "documents")),
        "p9_shared": lambda s, d: spans.shared_amount(t(s, d, "documents")),
    }


_WINDOWS = """
              t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
              w AS (SELECT doc_id, i, substring(text, i::INTEGER, 200) AS s FROM t, LATERAL (SELECT unnest(range(1, length(text) - 198)) AS i)),
              r AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
              hits AS (SELECT w.* FROM w SEMI JOIN r USING (s))"""
_ISLANDS = """
              f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits),
              g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f),
              spans AS (SELECT doc_id, (min(i) - 1)::INTEGER AS "start", (max(i) + 199)::INTEGER AS "end" FROM g GROUP BY doc_id, island)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH d AS (
              SELECT doc_id, max(text) AS text, max(page_count) AS page_count FROM ocr_document WHERE status = 'done' GROUP BY doc_id
            ), p AS (
              SELECT doc_id, count(DISTINCT page) AS n FROM page_text GROUP BY doc_id
            ), o AS (
              SELECT d.doc_id, coalesce(d.text, '') AS text FROM d LEFT JOIN p USING (doc_id)
              WHERE length(coalesce(d.text, '')) > 6000 OR coalesce(d.page_count, p.n, 0) > 12
            )
            SELECT doc_id, 'oversized' AS kind FROM o
            UNION ALL
            SELECT doc_id, 'hard' AS kind FROM o
            WHERE list_max(list_transform(regexp_split_to_array(text, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}.!?…。！？؟।]+'), lambda x: length(x))) > 6000
        """,
        "p6_plain_kinds": """
            WITH x AS (SELECT doc_id, 0 AS page, text FROM documents UNION ALL SELECT doc_id, page, max(text) FROM page_text GROUP BY doc_id, page)
            SELECT DISTINCT doc_id, page, kind FROM (SELECT doc_id, page, unnest(list_filter([
              CASE WHEN regexp_matches(text, '[\\x{ff10}-\\x{ff19}\\x{ff21}-\\x{ff3a}\\x{ff41}-\\x{ff5a}\\x{ff66}-\\x{ff9f}]') THEN 'width' END,
              CASE WHEN text <> nfc_normalize(text) THEN 'combining' END,
              CASE WHEN regexp_matches(text, '\\p{Cf}') THEN 'invisible' END,
              CASE WHEN regexp_matches(text, '[\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]') THEN 'space' END
            ], lambda k: k IS NOT NULL)) AS kind FROM x)
        """,
        "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p9_found": f"""
            WITH {_WINDOWS}
            SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hits a JOIN hits b ON a.s = b.s AND a.doc_id < b.doc_id
        """,
        "p9_links": f"""
            WITH {_WINDOWS},
            p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM hits a JOIN hits b ON a.s = b.s AND a.doc_id <> b.doc_id),
            c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM t)
            SELECT d.doc_id, coalesce(any_value(c.class_id), d.doc_id) AS class_id, count(p.y) AS n_links
            FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN c USING (doc_id) LEFT JOIN p ON p.x = d.doc_id GROUP BY d.doc_id
        """,
        "p9_intervals": f"""
            WITH {_WINDOWS}, {_ISLANDS}
            SELECT doc_id, "start", "end" FROM spans
        """,
        "p9_shared": f"""
            WITH {_WINDOWS}, {_ISLANDS},
            a AS (SELECT doc_id, count(*) AS n_spans, sum("end" - "start")::BIGINT AS shared_chars FROM spans GROUP BY doc_id),
            n AS (SELECT doc_id, coalesce(max(length(text)), 0)::BIGINT AS n_chars FROM documents GROUP BY doc_id)
            SELECT doc_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars,
              CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0 END::DOUBLE AS share FROM n LEFT JOIN a USING (doc_id)
        """,
    }
