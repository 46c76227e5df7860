"""Problem 3: the language of each text, and of each passage in a further one.

Method: a linear-chain conditional random field over words (runs of signs in
scripts without spaces). Its features are affixes, character n-grams, the word
itself and its script; weights and transitions are learned by gradient ascent
on the likelihood, with sentences of several languages put together. All texts
are labelled by forward-backward; a word's confidence is its posterior.

The model is fitted on ``lang_sample``, a table of fixed size (at most
``MAX_SAMPLES`` rows are read) with labelled sentences. The rest covers all data.

Defined results: a text with fewer than ``MIN_LETTERS`` letters of prose (null,
empty, code, tables) gets no language; a tie goes to the language first in the
alphabet; repeated rows of a document count once; an empty table gives an empty
table; without samples no text gets a language.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import LANGUAGES

MIN_LETTERS = 40
MIN_PASSAGE = 60
MAX_SAMPLES = 20_000

#: Codes that name no language.
NO_LANGUAGE = frozenset("und unknown none null auto osd equ mul zxx mis unk xx zz na n/a nan default".split())
#: Codes of further languages that a label may name.
OTHER_LANGUAGES = frozenset("it nl pl sv da no fi cs sk hu ro bg uk el tr ko vi he fa ur id ms ta te bn ca eu gl hr sr sl lt lv et".split())
_BY_NAME = {name: code for code, names in LANGUAGES.items() for name in (code, *names)}


def label_languages(label: str | None) -> list[str]:
    """Codes of the languages that a label names, in any notation; of others their own code."""
    found = []
    for part in re.split(r"[+,;/|]", label or ""):
        part = part.strip().lower()
        code = _BY_NAME.get(part) or _BY_NAME.get(re.split(r"[-_. (]", part)[0])
        if not code:
            first = re.split(r"[-_. (]", part)[0]
            code = first if first in OTHER_LANGUAGES else None
        if code and code not in found:
            found.append(code)
    return found


_SIGNS = "ऀ-ॣॱ-ෲ฀-๎ً-ٰٟ̀-ͯ​-‍­⁠﻿"
_CJK = "々〆぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_WORD = re.compile(rf"[{_CJK}]+|(?:[^\W\d_{_CJK}]|[{_SIGNS}])+(?:['’](?:[^\W\d_{_CJK}]|[{_SIGNS}])+)*")
_ADDRESS = re.compile(r"\S*[@＠]\S*|\S*(?:\[at\]|\(at\))\s?\S*|(?:https?://|www\.)\S+|[\w-]+(?:\.[\w-]+)*\.(?:test|example|invalid|com|org|net)\b\S*|[#@]\w+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def _script(ch: str) -> str:
    o = ord(ch)
    for name, a, b in (("L", 0x41, 0x24F), ("C", 0x400, 0x52F), ("A", 0x600, 0x77F), ("D", 0x900, 0x97F), ("T", 0xE00, 0xE7F), ("K", 0x3040, 0x30FF), ("H", 0x3400, 0x9FFF)):
        if a <= o <= b:
            return name
    return "?"


def features(word: str) -> list[str]:
    """Names of a word's features."""
    w = _INVISIBLE.sub("", word).lower()
    if not w:
        return ["empty"]
    out = ["w=" + w, "s=" + "".join(sorted({_script(c) for c in w}))]
    if _script(w[0]) in "KHT":
        out += ["c=" + c for c in set(w)] + ["b=" + w[i : i + 2] for i in range(len(w) - 1)]
        return out
    out += [f"p{n}=" + w[:n] for n in (1, 2, 3, 4) if len(w) >= n]
    out += [f"x{n}=" + w[-n:] for n in (1, 2, 3, 4) if len(w) >= n]
    padded = f"^{w}$"
    out += ["g=" + padded[i : i + 3] for i in range(len(padded) - 2)]
    out += ["m=" + c for c in w if c > "\x7f"]
    return out


_DOUBT = re.compile(r"[@＠=#©]|\[at\]|\(at\)|https?:|www\.|[!-~]{40}")
_SOLID = re.compile(r"[!-~]{40,}")
_ADDRESS_SIGN = re.compile(r"@|\[at\]|\(at\)|https?:|www\.")
_ASSIGNED = re.compile(r"(?:[!-<>-~]+[ \t]{0,3})?=+[ \t]{0,3}[!-~]*")
_CODE_SIGN = re.compile(r"[=(){}<>\[\];_\\$&|#]")


def _blanked(x: re.Match) -> str:
    return " " * (x.end() - x.start())


def _is_prose(left: str, solid: int, assigned: int) -> bool:
    """Whether what is left of a line is prose: mostly plain words, and not just some words of code."""
    total = assigned + sum(map(letters_of, left.split()))
    plain = sum(letters_of(w) for w in left.split() if not _CODE_SIGN.search(w.strip("()[]{}<>\"';,.:!?")))
    return plain >= 0.7 * total and (plain >= MIN_PASSAGE or plain * 4 >= solid)


def prose(text: str) -> str:
    """The text with addresses, assignments, encoded runs and lines of little but code blanked out; places stay the same."""
    if not _DOUBT.search(text):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if _DOUBT.search(line):
            # long runs go first, since the search for addresses takes time by the square of a run
            solid = sum(letters_of(x) for x in _SOLID.findall(line) if not _ADDRESS_SIGN.search(x))
            left = named = _ADDRESS.sub(_blanked, _SOLID.sub(_blanked, line))
            if "=" in named:
                left = _ASSIGNED.sub(_blanked, named)
            if (solid or left != named) and not _is_prose(left, solid, letters_of(named) - letters_of(left)):
                left = " " * len(line)
            lines[i] = left
    return "\n".join(lines)


def prose_words(text: str) -> list[tuple[int, str]]:
    """Words of a text's prose, with their places."""
    return [(x.start(), x.group()) for x in _WORD.finditer(prose(text))]


@dataclass
class Model:
    """A fitted field: languages, feature weights, transitions and starts (log scale)."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        ids = [i for i in map(self.index.get, features(word)) if i is not None]
        return self.weights[ids].sum(0) if ids else np.zeros(len(self.languages), np.float32)


def _forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of one sequence and the expected transitions; all in scaled probabilities."""
    n, k = e.shape
    p = np.exp(e - e.max(1, keepdims=True))
    a, b = np.empty((n, k)), np.empty((n, k))
    x = np.exp(start) * p[0]
    a[0] = x / x.sum()
    for t in range(1, n):
        x = (a[t - 1] @ trans) * p[t]
        a[t] = x / x.sum()
    b[-1] = 1
    for t in range(n - 2, -1, -1):
        x = trans @ (p[t + 1] * b[t + 1])
        b[t] = x / x.sum()
    post = a * b
    post /= post.sum(1, keepdims=True)
    pair = np.zeros((k, k))
    for t in range(n - 1):
        x = a[t][:, None] * trans * (p[t + 1] * b[t + 1])[None, :]
        pair += x / x.sum()
    return post, pair


def fit(samples: list[tuple[str, str]], epochs: int = 12, rate: float = 0.25, penalty: float = 1e-4, seed: int = 7) -> Model:
    """Fit a field on sentences with their language, put together into texts of up to three languages."""
    langs = sorted({lang for lang, _ in samples})
    k = len(langs)
    rng = np.random.default_rng(seed)
    data = [(langs.index(lang), [features(w) for _, w in prose_words(text)] or [["empty"]]) for lang, text in samples]
    index: dict[str, int] = {}
    for _, rows in data:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    data = [(y, [np.array([index[f] for f in row]) for row in rows]) for y, rows in data]
    w, grown = np.zeros((len(index), k)), np.full((len(index), k), 1e-6)
    trans, start = np.eye(k) * 2.0, np.zeros(k)
    for _ in range(epochs):
        order = rng.permutation(len(data)).tolist()
        while order:
            rows, labels = [], []
            for _ in range(rng.integers(1, 4)):
                if order:
                    y, r = data[order.pop()]
                    rows += r
                    labels += [y] * len(r)
            y = np.array(labels)
            e = np.array([w[r].sum(0) for r in rows])
            post, pair = _forward_backward(e, np.exp(trans - trans.max()), start)
            gold = np.zeros_like(post)
            gold[np.arange(len(y)), y] = 1
            grad = gold - post
            ids = np.concatenate(rows)
            step = np.repeat(grad, [len(r) for r in rows], axis=0)
            np.add.at(grown, ids, step**2)
            np.add.at(w, ids, rate * step / np.sqrt(grown[ids] + 1))
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            trans += rate * 0.05 * (seen - pair)
            start += rate * 0.05 * grad[0]
        w *= 1 - penalty
    # passages are far longer than the sentences put together above
    stay = np.log(np.exp(trans) / np.exp(trans).sum(1, keepdims=True))
    return Model(langs, index, w.astype(np.float32), stay, start - np.log(np.exp(start).sum()))


def fit_table(lang_sample: DataFrame) -> Model | None:
    """Fit on a table ``lang, text``, of at most MAX_SAMPLES rows, as many of each language; None if it is empty."""
    some = lang_sample.where("text is not null and lang is not null").select("lang", "text")
    each = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    ranked = some.withColumn("place", F.row_number().over(each))
    # the first of each language, then the second of each and so on
    rows = ranked.orderBy("place", "lang").limit(MAX_SAMPLES).orderBy("lang", "text").select("lang", "text").collect()
    return fit([(r["lang"], r["text"]) for r in rows]) if rows else None


#: Words of a batch of forward-backward.
CELLS = 150_000


class Labeller:
    """Labels texts in batches; word scores are kept for the words met so far, up to a bound."""

    def __init__(self, model: Model, keep: int = 300_000) -> None:
        self.model, self.keep = model, keep
        self.trans, self.start = np.exp(model.transitions).astype(np.float32), np.exp(model.starts).astype(np.float32)
        self.ids: dict[str, int] = {}
        self.scores = np.empty((1024, len(model.languages)), np.float32)
        self.sizes = np.empty(1024, np.int32)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in the tables of scores and of letters."""
        ids = self.ids
        for word in set(words).difference(ids):
            n = len(ids)
            if n == len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
                self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
            self.scores[n], self.sizes[n] = self.model.emission(word), letters_of(word)
            ids[word] = n
        return np.array([ids[w] for w in words], np.int64)

    def label(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Posteriors of each text's words, and their numbers."""
        if len(self.ids) > self.keep:
            self.ids.clear()
        numbers = [self.lookup(words) for words in texts]
        out = [(np.empty((0, len(self.model.languages)), np.float32), x) for x in numbers]
        order = [i for i in sorted(range(len(texts)), key=lambda i: len(texts[i])) if len(numbers[i])]
        while order:  # texts of about one length together, the longest first, and at most CELLS words at once
            group = order[-max(1, CELLS // len(numbers[order[-1]])) :][-512:]
            del order[-len(group) :]
            for i, p in zip(group, self._run([numbers[i] for i in group])):
                out[i] = (p, numbers[i])
        return out

    def _run(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(x) for x in numbers])
        n, size, k = len(numbers), int(lengths.max()), len(self.model.languages)
        grid = np.zeros((size, n), np.int64)
        inside = np.arange(size)[:, None] < lengths[None, :]
        grid.T[inside.T] = np.concatenate(numbers)
        p = self.scores[grid]
        p -= p.max(2, keepdims=True)
        np.exp(np.maximum(p, -30, out=p), out=p)
        p[~inside] = 1
        trans, back = self.trans, np.ascontiguousarray(self.trans.T)
        a, b = np.empty_like(p), np.empty_like(p)
        x = p[0] * self.start
        a[0] = x / x.sum(1, keepdims=True)
        for t in range(1, size):
            x = (a[t - 1] @ trans) * p[t]
            x /= x.sum(1, keepdims=True)
            a[t] = x
        # behind a text's end nothing is known: rows of ``trans`` sum to 1, so its last word gets the same value for all
        b[-1] = 1
        for t in range(size - 2, -1, -1):
            x = (p[t + 1] * b[t + 1]) @ back
            x /= x.max(1, keepdims=True)
            b[t] = x
        a *= b
        a /= a.sum(2, keepdims=True)
        return [a[: lengths[i], i] for i in range(n)]


#: Least mean advantage per word (log scale) of a passage's language over the main one.
MARGIN = 1.0


@dataclass
class Passage:
    """A run of words of one language: numbers of its first word and the one behind, and letters."""

    first: int
    stop: int
    lang: str
    letters: int
    confidence: float


def passages(post: np.ndarray, numbers: np.ndarray, labeller: Labeller) -> list[Passage]:
    """Maximal runs of one label; a run that its words hardly tell from the main language joins it."""
    if not len(post):
        return []
    best, top, sizes = post.argmax(1), post.max(1), labeller.sizes[numbers]
    total = np.bincount(best, weights=sizes, minlength=post.shape[1])
    main = int(total.argmax())
    names = labeller.model.languages
    for again in (True, False):
        cuts = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        ends = [*cuts[1:].tolist(), len(best)]
        if again:
            for a, b in zip(cuts.tolist(), ends):
                if best[a] != main:
                    rows = labeller.scores[numbers[a:b]]
                    if (rows[:, best[a]] - rows[:, main]).mean() < MARGIN:
                        top[a:b], best[a:b] = post[a:b, main], main
    out = []
    for a, b in zip(cuts.tolist(), ends):
        n = int(sizes[a:b].sum())
        if best[a] != main and n >= MIN_PASSAGE:  # names and numbers at its ends belong to either language
            rows = labeller.scores[numbers[a:b]]
            sure = np.flatnonzero(rows[:, best[a]] - rows[:, main] > 0.5)
            if len(sure):
                a, b = a + int(sure[0]), a + int(sure[-1]) + 1
                n = int(sizes[a:b].sum())
        out.append(Passage(a, b, names[best[a]], n, float((top[a:b] * sizes[a:b]).sum() / max(1, n))))
    return out


def letters_of(word: str) -> int:
    """Letters of a word; vowel signs and marks that aren't letters don't count."""
    return len(word) if word.isalpha() else sum(c.isalpha() for c in word)


# --- garbled texts ------------------------------------------------------------

_WRONG = re.compile("[\u0080-\u0084\u0086-\u009f�]|[ÃÂâ][\u0080-¿‚-™]|[РС][\u0080-¿‚-™Ѐ-џ]|Г[ -¿]|[╨╤]")
_CHARSETS = ("utf-8", "cp1252", "cp1251", "koi8-r", "shift_jis", "gb18030", "iso-8859-2")
_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>", re.DOTALL | re.IGNORECASE)
_BREAKS = re.compile(r"\s*\n\s*")


#: Words with a sign outside ASCII.
_OUTSIDE = re.compile(rf"(?:[A-Za-z]|[{_SIGNS}])*[^\x00-\x7f\W\d_](?:[^\W\d_]|[{_SIGNS}])*")


def page_text(source: str) -> str:
    """What stands between the tags of a page."""
    return _BREAKS.sub("\n", html.unescape(_TAG.sub("\n", source))).strip()


def readable(text: str | None, raw: bytes | None, charset: str | None, model: Model) -> str | None:
    """The text itself, or what its bytes say if it was decoded by a wrong charset.

    Without a declared charset the text stays if its words are among those of
    its bytes in UTF-8, or else in the charset in which most words are known.
    """
    if not text or not raw:
        return text
    own = (charset or "").strip().lower()

    def other(source: str) -> bool:
        return not set(_OUTSIDE.findall(text)) <= set(_OUTSIDE.findall(source)) or "�" in text and "�" not in source

    try:
        plain = bytes(raw).decode("utf-8")
        if plain.isascii() or own.replace("_", "-") in ("utf-8", "utf8"):
            return text
        source = page_text(plain)
        return source if own or other(source) else text
    except UnicodeDecodeError:
        pass
    options = {}
    for name in _CHARSETS[1:]:
        try:
            options[name] = bytes(raw).decode(name)
        except (UnicodeDecodeError, LookupError):
            continue

    def known(source: str) -> float:
        outside = _OUTSIDE.findall(page_text(source))
        hits = sum(f"w={w.lower()}" in model.index or w[0] >= "぀" and sum("b=" + w[i : i + 2] in model.index for i in range(len(w) - 1)) > 0.3 * len(w) for w in outside)
        return hits / max(1, len(outside)) - 0.5 * len(_WRONG.findall(source)) / max(1, len(outside))

    score = {name: known(source) for name, source in options.items()}
    best = max(score, key=lambda x: (score[x], x == own), default=None)
    if best is None or best == own and "�" not in text:
        return text
    source = page_text(options[best])
    return source if own or other(source) else text


# --- operators ----------------------------------------------------------------


def _web(documents: DataFrame) -> DataFrame:
    # only a text whose charset is in doubt, or not declared, needs its bytes
    odd = (F.lower(F.coalesce("charset", F.lit(""))) != "utf-8") | F.col("text").rlike("�")
    return documents.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(odd, F.col("raw")).alias("raw"), "charset", F.col("lang").alias("label")
    )


def _scanned(ocr: DataFrame) -> DataFrame:
    latest = Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), F.col("language").isNull(), "language", "text")
    return (
        ocr.where("status = 'done'").withColumn("_n", F.row_number().over(latest)).where("_n = 1 and text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("charset"), F.col("language").alias("label"))
    )


def _labelled(texts: DataFrame, model: Model, schema: str, rows) -> DataFrame:
    """Run ``rows(doc_id, label, text, passages)`` over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # its size follows the sample table, which is bounded
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for low in range(0, len(batch), 5000):
                part = batch.iloc[low : low + 5000]
                texts_ = [
                    readable(t, r, c, labeller.model) if r is not None else t for t, r, c in zip(part["text"], part["raw"], part["charset"])
                ]
                labels = labeller.label([_WORD.findall(prose(t or "")) for t in texts_])
                out = [
                    row
                    for doc, label, text, (post, numbers) in zip(part["doc_id"], part["label"], texts_, labels)
                    for row in rows(doc, label, text or "", passages(post, numbers, labeller))
                ]
                yield pd.DataFrame(out, columns=names)

    return texts.mapInPandas(run, schema)


def main_language(parts: list[Passage]) -> tuple[str | None, float]:
    """The language with most letters, and its share weighted by confidence; none for too little prose."""
    total: dict[str, list[float]] = {}
    for x in parts:
        entry = total.setdefault(x.lang, [0, 0.0])
        entry[0] += x.letters
        entry[1] += x.letters * x.confidence
    if sum(n for n, _ in total.values()) < MIN_LETTERS:
        return None, 0.0
    best = min(total, key=lambda k: (-total[k][0], k))
    return best, total[best][1] / sum(n for n, _ in total.values())


def _report(doc, label, text: str, parts: list[Passage]):
    main, sure = main_language(parts)
    if main is None:
        return
    k, words = 0, prose_words(text)
    for x in parts:
        if x.lang == main or x.letters >= MIN_PASSAGE:
            k += 1
            end = words[x.stop - 1]
            yield doc, main, round(sure, 4), k, words[x.first][0], end[0] + len(end[1]), x.lang, x.letters, round(x.confidence, 4)


def languages(documents: DataFrame, ocr: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence, part, start_at, end_at, part_lang, letters, part_confidence``: each text and its passages."""
    model = fit_table(lang_sample)
    schema = "doc_id long, lang string, confidence double, part int, start_at int, end_at int, part_lang string, letters int, part_confidence double"
    texts = _web(documents).unionByName(_scanned(ocr))
    if model is None:
        return texts.sparkSession.createDataFrame([], schema)
    return _labelled(texts, model, schema, _report)


def _judge(doc, label, text: str, parts: list[Passage]):
    main, _ = main_language(parts)
    if main is None:
        return
    named = label_languages(label)
    if not named:
        yield doc, "missing", main
    elif main not in named:
        yield doc, "wrong", main
    for lang in sorted({x.lang for x in parts if x.lang != main and x.letters >= MIN_PASSAGE}):
        yield doc, "mixed", lang


def found(documents: DataFrame, ocr: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``doc_id, kind, lang``: labels that are missing or wrong, and further languages."""
    model = fit_table(lang_sample)
    schema = "doc_id long, kind string, lang string"
    texts = _web(documents).unionByName(_scanned(ocr))
    if model is None:
        return texts.sparkSession.createDataFrame([], schema)
    return _labelled(texts, model, schema, _judge)
