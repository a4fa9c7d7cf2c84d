"""Languages of spans and of whole texts: scripts, per-word scores and Viterbi."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.common import packed, query, table, text_or_empty
from layerflow.llm.quality import held_out

UNKNOWN = "und"
#: Labelled documents that are read for each language, on average. They are chosen by the hash
#: of their ids, so the model is fitted on a bounded sample of any corpus.
SAMPLE_DOCS = 2000
#: Trigrams of letters share this many counters, by hash.
COUNTERS = 1 << 18
SMOOTHING = 0.1
#: A word can speak against a language by this much (natural logarithms) and not more.
WORD_LIMIT = 12.0
#: What a switch of language costs, on the same scale.
SWITCH = 14.0
#: Letters of a script by which a language is taken to be written in it.
SCRIPT_SHARE = 0.01
#: Code points that are worked on at a time.
BATCH = 1 << 18

#: First and last code point of the blocks of each script (Unicode).
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower case, whether it is part of a word (1 letter, 2 mark), and the
    number of its script (0: none of the list)."""
    size = 0x110000
    lower, part, script = np.arange(size, dtype=np.uint32), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for c in (*range(0x3400), *range(0xA000, 0x20000)):
        kind = unicodedata.category(chr(c))[0]
        part[c] = 1 if kind == "L" else 2 if kind == "M" else 0
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    part[0x3400:0x4DC0] = part[0x4E00:0xA000] = part[0x20000:0x323B0] = 1
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return lower, part, script


@dataclass
class Words:
    """The words of several texts: for each letter its counter, for each word where its letters
    begin in that list, its text, its place in it, its script and its number of letters."""

    counters: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def words_of(texts: list[str]) -> Words:
    lower, part, script = _letters()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = part[points]
    inside = kind > 0
    opens = np.zeros(len(points) + 1, dtype=bool)  # a text begins here
    opens[starts[:-1]] = True
    before = np.concatenate([[False], inside[:-1]]) & ~opens[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~opens[1:]
    small = lower[points].astype(np.uint64)
    left = np.concatenate([[np.uint64(0)], small[:-1]]) * before
    right = np.concatenate([small[1:], [np.uint64(0)]]) * after
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + small * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    counted = np.cumsum(inside)
    doc = np.searchsorted(starts, begin, side="right") - 1
    return Words(
        mixed[inside].astype(np.int64),
        counted[begin] - 1 if len(begin) else begin,
        doc,
        begin - starts[doc],
        end - starts[doc],
        script[points[begin]],
        np.add.reduceat(np.append(kind == 1, False).astype(np.int64), np.column_stack([begin, end]).ravel())[::2]
        if len(begin)
        else begin,
    )


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BATCH code points; a longer text is a run of its own."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > BATCH:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, texts[at:]


@dataclass
class Model:
    """Languages by name, the trigrams' log probabilities, which script has which, and which
    trigrams were seen in which."""

    languages: list[str]
    scores: np.ndarray
    written: np.ndarray
    seen: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """A row for each word: how far each language lies behind the best one."""
        if not len(words.first) or not self.languages:
            return np.zeros((len(words.first), len(self.languages)), np.float32)
        out = np.add.reduceat(self.scores[words.counters], words.first, axis=0)
        candidates = self.written[words.script]
        some = candidates.any(axis=1, keepdims=True)
        out = np.where(candidates, out, np.float32(-1e9))
        out = np.maximum(out - out.max(axis=1, keepdims=True), np.float32(-WORD_LIMIT))
        return np.where(some, out, np.float32(0))


    def known(self, words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its letters and marks, and those of them whose trigram was seen in the
        word's language; none if that language is not written in the word's script."""
        sizes = np.diff(np.append(words.first, len(words.counters)))
        found = self.seen[words.counters, np.repeat(labels, sizes)]
        found = np.add.reduceat(found.astype(np.int64), words.first) if len(sizes) else sizes
        return sizes, np.where(self.written[words.script, labels], found, 0)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The labels of a sequence with the highest sum of scores, less ``switch`` for each change
    of label.

    If even the best stretch of other labels gains no more than one switch costs, the label
    with the highest sum is right for the whole sequence; only other sequences are decoded
    step by step.
    """
    best = int(scores.sum(axis=0).argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int64)
    rival = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    total = np.concatenate([[0.0], np.cumsum(rival, dtype=np.float64)])
    if (total - np.minimum.accumulate(total)).max() <= switch:
        return np.full(len(scores), best, np.int64)
    labels = range(scores.shape[1])
    value, back = [0.0] * scores.shape[1], []
    for row in scores.tolist():
        top = max(value)
        source = value.index(top)
        floor = top - switch
        back.append([label if value[label] >= floor else source for label in labels])
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    label = value.index(max(value))
    out = [0] * len(scores)
    for i in range(len(scores) - 1, -1, -1):
        out[i] = label
        label = back[i][label]
    return np.array(out)


def label_texts(model: Model, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
    """For each text: its language, the score, and its spans as (language, start, end) in code
    points from its first to its last word of one language."""
    for lang, score, spans, _ in _labelled(model, texts):
        yield lang, score, spans


def _labelled(model: Model, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[str, int, int]], float]]:
    """What label_texts gives, and the evidence."""
    names = [*model.languages]
    for _, some in _chunks(texts):
        words = words_of(some)
        scores = model.word_scores(words)
        bounds = np.searchsorted(words.doc, np.arange(len(some) + 1))
        chosen = np.zeros(len(words.doc), np.int64)
        decoded = []
        for i in range(len(some)):
            a, b = bounds[i], bounds[i + 1]
            letters = words.letters[a:b]
            if a == b or not letters.sum() or not names:
                decoded.append((UNKNOWN, 0.0, []))
                continue
            labels = chosen[a:b] = viterbi(scores[a:b])
            share = np.bincount(labels, weights=letters, minlength=len(names))
            best = int(share.argmax())
            sums = np.sort(scores[a:b].sum(axis=0, dtype=np.float64))
            lead = sums[-1] - sums[-2] if len(names) > 1 else 0.0
            score = float(share[best] / letters.sum() * (1.0 - 0.5 * np.exp(-lead)))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [b - a]])
            spans = [
                (names[labels[x]], int(words.begin[a + x]), int(words.end[a + y - 1])) for x, y in zip(cuts[:-1], cuts[1:])
            ]
            decoded.append((names[best], score, spans))
        if not names:
            yield from ((*d, 0.0) for d in decoded)
            continue
        sizes, known = model.known(words, chosen)
        size = np.bincount(words.doc, weights=sizes, minlength=len(some))
        evidence = np.bincount(words.doc, weights=known, minlength=len(some)) / np.maximum(size, 1.0)
        yield from ((*d, float(e)) for d, e in zip(decoded, evidence))


def fit_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn the languages of the column ``lang`` from whole texts.

    Rows with a null language or id are left out. Of each language the documents with the
    lowest hashes of their ids are read, ``sample_docs`` of them on average. Trigrams are
    counted by Spark; the driver gets at most COUNTERS counts for each language.
    """
    known = docs.select("doc_id", "lang", text_or_empty().alias("text")).where("lang is not null and doc_id is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((COUNTERS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool), np.zeros((COUNTERS, 0), bool))
    names = sorted(sizes)
    shares = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(sample_docs / sizes[n]))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sampled = known.where(place < F.element_at(shares, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for _, some in _chunks(list(group["text"])):
                    words = words_of(some)
                    counter, n = np.unique(words.counters, return_counts=True)
                    script = np.bincount(words.script, weights=words.letters, minlength=len(SCRIPTS) + 1)
                    used = np.flatnonzero(script)
                    yield pd.DataFrame({"lang": lang, "counter": counter, "n": n})
                    yield pd.DataFrame({"lang": lang, "counter": -1 - used, "n": script[used].astype(np.int64)})

    counts = sampled.mapInPandas(count, "lang string, counter long, n long")
    rows = counts.groupBy("lang", "counter").agg(F.sum("n").alias("n")).toPandas()
    column = {n: i for i, n in enumerate(names)}
    n = np.zeros((COUNTERS, len(names)))
    scripts = np.zeros((len(SCRIPTS) + 1, len(names)))
    for lang, group in rows.groupby("lang"):
        counter, found = group["counter"].to_numpy(), group["n"].to_numpy()
        n[counter[counter >= 0], column[lang]] = found[counter >= 0]
        scripts[-1 - counter[counter < 0], column[lang]] = found[counter < 0]
    seen = n.sum(axis=1) > 0
    scores = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * max(1, seen.sum())))
    scores[~seen] = 0.0
    written = scripts >= np.maximum(1.0, SCRIPT_SHARE * scripts.sum(axis=0))
    return Model(names, scores.astype(np.float32), written, n > 0)


LABELS = "lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>, evidence double"


def label_documents(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """All rows as (row, lang_pred, score, spans, evidence): ``row`` has the columns of the input.

    A null text, and one without letters, is ``und`` with score 0 and no spans; so is every
    text if nothing was learnt. A text whose letters belong to no known script gets the first
    language by name. The score is the part of the letters that the language's spans have,
    lowered where its lead over the next language is small; it tells languages from each other
    and not from unknown ones. The evidence is the part of the letters and marks that were seen
    between the same neighbours in the language of their span, in a script of that language;
    it does not depend on how many languages a text has. Nothing is shuffled.
    """

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _labelled(model, list(batch))
            rows = [
                (lang, score, [{"lang": s[0], "start": s[1], "end": s[2]} for s in own] if spans else [], evidence)
                for lang, score, own, evidence in found
            ]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans", "evidence"])

    run = F.pandas_udf(label, LABELS)
    return packed(docs, found=run(text_or_empty())).select("row", "found.*")


def learnt(docs: DataFrame) -> Model:
    """The model of the documents outside the held-out part."""
    return fit_languages(docs.where(~held_out(F.col("doc_id"), 3, 1)))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents and its spans (lang:start:end in code points, end
    exclusive), learnt from the rows outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    found = label_documents(docs.select("doc_id", "text"), learnt(docs))
    put = lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id"), 3, 1).alias("held_out"),
        "lang_pred",
        "score",
        F.array_join(F.transform("spans", put), ",").alias("spans"),
    )
