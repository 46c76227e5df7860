"""Problem 7: encode all texts with a public byte-level tokenizer.

Method: the tiktoken library over a local rank file; long texts are cut at
boundaries that no token crosses; ids are decoded to raw bytes.

Defined results: a null or an empty text gives an empty list; strings that look
like special tokens are plain text; repeated rows each give a row; an empty
table gives an empty table; columns other than the id and the text are dropped.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; every operator takes it as ``path``.
RANKS = os.environ.get("PAGELOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are encoded in pieces.
PIECE = 50_000


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    """The encoder of a rank file, made once for each Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of about ``size`` characters whose ids, one after another, are the text's ids.

    No branch of the pattern takes white space after another character, so the
    place between a visible character and a following white space is a
    boundary of every encoding. A stretch without such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(text: str | None, path: str = RANKS) -> np.ndarray:
    """Ids of one text, without special tokens."""
    if not text:
        return np.empty(0, np.int32)
    own = encoder(path)
    if len(text) <= PIECE:
        return np.asarray(own.encode_ordinary(text), np.int32)
    return np.concatenate([np.asarray(own.encode_ordinary(x), np.int32) for x in safe_pieces(text)])


def encode(df: DataFrame, path: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of each row's text, as array<int>."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [encode_text(x, path) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *lists])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count(df: DataFrame, path: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens``: the number of token ids of each row's text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(encode_text(x, path)) for x in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens int")


def decode(df: DataFrame, path: str = RANKS, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, raw``: the bytes that the ids stand for (a null list gives no bytes).

    Single tokens may end within a character, so ids are joined as bytes
    before anything is read as text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([encoder(path).decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=[key, "raw"])

    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, raw binary")


def round_trip(df: DataFrame, path: str = RANKS) -> DataFrame:
    """``doc_id, n_tokens, n_bytes, same``: is each text what its ids decode to?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lengths, same = [], [], []
            for text in batch.column(1).to_pylist():
                ids, raw = encode_text(text, path), (text or "").encode()
                sizes.append(len(ids))
                lengths.append(len(raw))
                same.append(encoder(path).decode_bytes(ids.tolist()) == raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(lengths, pa.int32()), pa.array(same)],
                names=["doc_id", "n_tokens", "n_bytes", "same"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens int, n_bytes int, same boolean"
    )
