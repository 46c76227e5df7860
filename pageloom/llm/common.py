"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ISO two-letter code, pack name of recognition, English and own names of a language.
LANGUAGES = {
    "ar": ("ara", "arabic", "العربية"),
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "castellano"),
    "fr": ("fra", "fre", "french", "français"),
    "hi": ("hin", "hindi", "हिन्दी"),
    "ja": ("jpn", "japanese", "日本語"),
    "pt": ("por", "portuguese", "português"),
    "ru": ("rus", "russian", "русский"),
    "th": ("tha", "thai", "ไทย"),
    "zh": ("zho", "chi", "chi_sim", "chi_tra", "chinese", "中文"),
}


def per_batch(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``step`` over Arrow batches; empty batches are passed by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield step(batch)

    return df.mapInPandas(run, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over at least as many tasks as the session shuffles to.

    A file is read as one task for each 16-128 MB of compressed text, while
    Python work costs far more than the read; a scan that already yields
    enough tasks is left as it is.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys) if keys else df.repartition(wanted)


def page_and_web_texts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, text`` of web documents (page 0) and scanned pages.

    Repeated rows of a page carry the same text and count once: one row for
    each key stays, one with a text before one without. Null texts stay.
    """
    web = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("page"), "text")
    scans = (
        pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text")
        .groupBy("doc_id", "page")
        .agg(F.max("text").alias("text"))
    )
    return web.unionByName(scans)
