"""Problem 5: sentence boundaries across languages and scripts.

Method: the boundary rules are compiled into a finite transducer over token
classes: every reachable state of ``_rule`` becomes a row of two tables, next
state and output (does a sentence start at this token?). The token classes of a
batch of texts, of whatever length each, are laid out as equal blocks; every
block is turned into its state-transition function (for all start states at
once), the functions are composed by a parallel prefix scan, and then all
blocks run at once from their true start states. A blank line takes every state
to the start, so one between two texts keeps them apart.

Defined results: null, empty and blank texts have no sentences; a text without
any mark is one sentence for each paragraph; a quotation or bracket that is
opened is part of its sentence up to its end or to the next blank line;
repeated rows give repeated sentences; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import per_batch
from pageloom.llm.folding import plain_view

#: Abbreviations after which a sentence always goes on.
NEVER = (
    "Dr. Prof. Mr. Mrs. Ms. Rev. Gen. St. Mt. No. Nos. nos. fig. Fig. figs. p. pp. P. vol. vols. ch. sec. art. Art. ed. eds. cf. Cf. "
    "vs. approx. ca. c. i.e. e.g. viz. incl. resp. Jan. Feb. Apr. Aug. Sept. Oct. Nov. Dec. "
    "Nr. Abb. S. Bd. Hrsg. Kap. Tab. Anm. Vgl. vgl. z.B. d.h. u.a. bzw. sog. Hr. Fr. evtl. ggf. inkl. zzgl. z.T. i.d.R. o.g. St. Str. "
    "M. MM. Mme. Mlle. Me. env. éd. réf. n°. c.-à-d. p.ex. chap. "
    "Sr. Sra. Srta. D. Dña. pág. págs. aprox. núm. Cía. Véase. p.ej. tel. Tel. "
    "Sr.ª D.ª Exmo. Eng. nº. n.º n.ª "
    "Av. av. Ave. Avda. avda. Bd. bd. Pl. Pza. pza. Rd. Blvd. Apt. apt. appt. izq. dcha. esq. dto. "
    "см. См. ср. Ср. стр. с. рис. Рис. ок. т.е. т.к. т.н. напр. г. гг. ул. пер. пр-т. пл. д. кв. им. тов. № "
    "د. أ. م. ص. डॉ. प्रो. श्री. पं. रु."
).split()
#: Abbreviations that may end a sentence.
MAYBE = (
    "etc. a.m. p.m. A.M. P.M. Ltd. Inc. Co. Corp. Jr. Sr. ff. f. al. seq. "
    "usw. usf. etc. o.ä. u.ä. GmbH. suiv. S.A. S.L. S.A.R.L. Lda. Ltda. ss. segs. sig. Cía. и.т.д. т.д. т.п. др. пр. руб. коп. тыс. млн. млрд. н.э. обл. "
    "U.S. U.K. U.N. E.U. D.C."
).split()
#: Names of months, before which a number with a point is a day.
MONTHS = (
    "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember "
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря"
).split()

_PAIRS = {"«": "»", "“": "”", "„": "“", "‘": "’", "(": ")", "（": "）", "「": "」", "『": "』", "[": "]", "‹": "›", "《": "》", "【": "】"}
_BRACKETS = "(（[【"
_OPEN = "".join(map(re.escape, _PAIRS))
_CLOSE = "".join(map(re.escape, dict.fromkeys([*_PAIRS.values(), '"'])))


def _listed(words: list[str]) -> str:
    """One pattern for abbreviations; parts may stand apart, the first letter may be a capital."""
    out = []
    for w in sorted(set(words), key=len, reverse=True):
        parts = [re.escape(x) + r"\." for x in w.split(".") if x] if w.endswith(".") else [re.escape(w)]
        body = r"[   ]?".join(parts)
        out.append(body)
    return "|".join(out)


#: The token classes, in the order in which they are tried.
_TOKEN = re.compile(
    rf"""(?P<para>[^\S\n]*\n[^\S\n]*\n\s*)
    |(?P<line>[^\S\n]*\n[^\S\n]*)
    |(?P<space>\s+)
    |(?P<never>(?<![^\W_])(?:{_listed(NEVER)})(?![^\W_])|(?<=[^\W\d_])str\.(?=\s?\d)|(?<![^\W_])(?:[Nn]o|[Nn]r|[Vv]ol|[Tt]el|ext|lot|line|box)\.(?=\s?[A-Z]*\d))
    |(?P<maybe>(?<![^\W_])(?:{_listed(MAYBE)})(?![^\W_])|(?<![^\W_])(?:[^\W\d_]\.){{2,}}(?![^\W_]))
    |(?P<initial>(?<![^\W_])[A-ZÀ-ÖØ-ÞА-ЯЁ]\.(?=\s|[A-ZÀ-ÖØ-ÞА-ЯЁ]\.))
    |(?P<number>\d+(?:[.,:/\-]\d+)*)
    |(?P<face>[:;=]-?[()DP](?!\w))
    |(?P<dots>\.{{2,}}|…+)
    |(?P<full>[。！？।؟۔｡]+)
    |(?P<mark>[.!?]+)
    |(?P<open>[{_OPEN}])
    |(?P<close>[{_CLOSE}])
    |(?P<word>(?:[^\W\d_]|[̀-ͯऀ-ॣॱ-෿ั-๎​-‏­⁠﻿])+)
    |(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)
_FIXED = {g: i for i, g in enumerate(("para", "line", "space", "never", "maybe", "initial", "number", "face", "dots", "full", "mark", "other"))}
SYMBOLS = [*_FIXED, "upper", "lower", "caseless", "kana", "thai", "month", "invert", *(f"o{c}" for c in _PAIRS), 'o"', *(f"c{c}" for c in dict.fromkeys(_PAIRS.values()))]
_CODE = {s: i for i, s in enumerate(SYMBOLS)}


def _word_code(word: str) -> int:
    """Class of a word, by its first letter."""
    if word in MONTHS:
        return _CODE["month"]
    for ch in word:
        if ch.isupper():
            return _CODE["upper"]
        if ch.islower():
            return _CODE["lower"]
        if "฀" <= ch <= "๿":
            return _CODE["thai"]
        if "぀" <= ch <= "ゟ":
            return _CODE["kana"]
        if ch.isalpha():
            return _CODE["caseless"]
    return _CODE["other"]


def tokens(text: str) -> tuple[list[int], list[int]]:
    """Classes and positions of a text's tokens."""
    codes, places, seen = [], [], {}
    for x in _TOKEN.finditer(text):
        group = x.lastgroup
        code = _FIXED.get(group)
        if code is None or group == "other":
            token = x.group()
            code = seen.get(token)
            if code is None:
                if group == "word":
                    code = _word_code(token)
                elif group == "open":
                    code = _CODE[f"o{token}"]
                elif group == "close":
                    code = _CODE['o"'] if token == '"' else _CODE[f"c{token}"]
                else:
                    code = _CODE["invert"] if token in "¿¡" else _FIXED["other"]
                seen[token] = code
        codes.append(code)
        places.append(x.start())
    return codes, places


def _rule(state: tuple, symbol: str) -> tuple[tuple, bool]:
    """Next state, and whether a sentence starts at this token.

    States: ("start",) nothing of a sentence yet; ("mid", last) within one,
    after a token of class ``last``; ("end", last, apart) after a mark that may
    end it, with white space since if ``apart``; ("in", opener, first, done)
    within a quotation or bracket, which began the sentence if ``first`` and
    whose text ends in a mark if ``done``; ("out", bracket, first, apart) after
    one whose text ended in a mark.
    """
    space = symbol in ("space", "line")
    kind = state[0]
    if symbol == "para":
        return ("start",), False
    if kind == "start":
        if space:
            return state, False
        return _within(symbol, True), True
    if kind == "in":
        _, opener, first, done = state
        if symbol[1:] == _PAIRS.get(opener, '"') and symbol[0] in "co":
            if done:
                return ("out", opener in _BRACKETS, first, False), False
            return ("mid", "close"), False
        if symbol in ("mark", "full", "dots", "maybe"):
            return ("in", opener, first, True), False
        return ("in", opener, first, done and (space or symbol[0] == "c" and len(symbol) == 2)), False
    if kind == "out":
        _, bracket, first, apart = state
        if space:
            return ("out", bracket, first, True), False
        if symbol[0] == "c" and len(symbol) == 2:
            return state, False
        if symbol in ("mark", "full"):
            return ("end", symbol, False), False
        if symbol in ("caseless", "thai"):
            fresh = bracket or not first
        else:
            fresh = symbol in ("upper", "month", "number", "invert", "never", "initial", "maybe") and apart or symbol[0] == "o" and symbol != "other"
        return _within(symbol, fresh), fresh
    if kind == "end":
        _, last, apart = state
        if space:
            return ("end", last, True), False
        if symbol in ("mark", "full") and not apart:
            return ("end", "full" if symbol == "full" or last == "full" else "mark", False), False
        if symbol[0] == "c" and len(symbol) == 2:
            return state, False
        if last == "full":
            fresh = symbol != "other" or apart
        elif not apart or symbol in ("lower", "other", "face", "mark", "full", "dots"):
            fresh = False
        elif last == "number":
            fresh = symbol not in ("month", "number")
        elif last == "maybe":
            fresh = symbol not in ("number", "caseless", "thai")
        elif last == "dots":
            fresh = symbol in ("upper", "month", "invert")
        else:
            fresh = True
        return _within(symbol, fresh), fresh
    # mid
    last = state[1]
    if space:
        if last == "thai" and symbol == "line":
            return ("start",), False
        return ("mid", {"thai": "thai_space", "number": "number_space"}.get(last, "space" if last not in ("thai_space", "number_space") else last)), False
    if last == "thai_space":
        fresh = symbol not in ("number", "other", "mark", "face")
        return _within(symbol, fresh), fresh
    if symbol == "thai" and last == "space":
        return _within(symbol, True), True
    if symbol == "mark":
        return ("end", "number" if last == "number" else "mark", False), False
    if symbol == "dots":
        return (("mid", "other") if last in ("space", "number_space") else ("end", "dots", False)), False
    if symbol in ("full", "maybe"):
        return ("end", symbol, False), False
    return _within(symbol, False), False


def _within(symbol: str, first: bool) -> tuple:
    """State after a token that belongs to a sentence."""
    if symbol[0] == "o" and len(symbol) == 2:
        return ("in", symbol[1], first, False)
    if symbol in ("mark", "full", "maybe"):
        return ("end", symbol, False)
    return ("mid", symbol if symbol in ("thai", "number") else "other")


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """The compiled tables: next state and output by state and token class; state 0 is the start."""
    states, todo = {("start",): 0}, [("start",)]
    rows = []
    while todo:
        row = []
        for symbol in SYMBOLS:
            to, fresh = _rule(todo[0], symbol)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append((states[to], fresh))
        rows.append(row)
        todo.pop(0)
    table = np.array(rows)
    return np.ascontiguousarray(table[:, :, 0]).astype(np.int32), np.ascontiguousarray(table[:, :, 1]).astype(bool)


#: Most tokens of a block. Shorter runs have shorter blocks, at least BLOCKS of them.
BLOCK, BLOCKS = 256, 64


def run_blocks(codes: np.ndarray, block: int | None = None) -> np.ndarray:
    """Indices of the tokens at which a sentence starts, by composing the blocks' state-transition functions in a prefix scan."""
    to, out = transducer()
    n, states = len(codes), len(to)
    block = block or max(1, min(BLOCK, -(-n // BLOCKS)))
    count = -(-n // block)
    grid = np.full((count, block), _FIXED["space"], np.int32)
    grid.ravel()[:n] = codes
    grid = np.ascontiguousarray(grid.T)
    # by token class and state, so that a step is one look-up for all blocks and states
    step, gives = np.ascontiguousarray(to.T).ravel(), np.ascontiguousarray(out.T).ravel()
    functions = np.tile(np.arange(states, dtype=np.int32), (count, 1))
    for row in grid:
        functions = step[functions + row[:, None] * states]
    prefix, reach = functions, 1
    while reach < count:  # inclusive scan: after round r each entry spans 2**r blocks
        later = np.take_along_axis(prefix[reach:], prefix[:-reach], axis=1)
        prefix = np.concatenate([prefix[:reach], later])
        reach *= 2
    state = np.concatenate([np.zeros(1, np.int32), prefix[:-1, 0]])
    starts = np.zeros((block, count), bool)
    for i, row in enumerate(grid):
        at = state + row * states
        starts[i], state = gives[at], step[at]
    return np.flatnonzero(starts.T.ravel()[:n])


#: Tokens that are run at once.
RUN = 1_000_000


def batch_starts(texts: list[str | None]) -> list[list[int]]:
    """Positions of the first characters of each text's sentences."""
    found: list[list[int]] = [[] for _ in texts]
    owners: list[tuple[int, list[int], list[int] | None]] = []
    codes: list[int] = []

    def run() -> None:
        if not owners:
            return
        hits, at = run_blocks(np.array(codes, np.int32)), 0
        for k, places, kept in owners:
            own = hits[np.searchsorted(hits, at) : np.searchsorted(hits, at + len(places))] - at
            found[k] = [places[i] if kept is None else kept[places[i]] for i in own.tolist()]
            at += len(places) + 1
        owners.clear()
        codes.clear()

    for k, text in enumerate(texts):
        if not text or text.isspace():
            continue
        view, kept = plain_view(text)  # abbreviations may hold look-alikes or invisible signs
        own, places = tokens(view)
        codes += own
        codes.append(_FIXED["para"])
        owners.append((k, places, kept))
        if len(codes) >= RUN:
            run()
    run()
    return found


def spans_of(text: str | None, starts: list[int]) -> list[tuple[int, int]]:
    """Start and end of each sentence; white space between them belongs to neither."""
    return [(a, a + len(text[a:b].rstrip())) for a, b in zip(starts, [*starts[1:], len(text or "")])]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence of one text."""
    return spans_of(text, batch_starts([text])[0])


def split(texts: DataFrame) -> DataFrame:
    """``doc_id, sent_no, start_at, sentence`` of rows with ``doc_id, text``."""

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, text, starts in zip(batch["doc_id"], batch["text"], batch_starts(batch["text"].tolist())):
            out.extend((doc, k, a, text[a:b]) for k, (a, b) in enumerate(spans_of(text, starts), 1))
        return pd.DataFrame(out, columns=["doc_id", "sent_no", "start_at", "sentence"])

    return per_batch(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, sent_no int, start_at int, sentence string")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id, sent_no, start_at`` for running prose (source ``feed``)."""
    return split(documents.where("source = 'feed'")).select("doc_id", "sent_no", "start_at")
