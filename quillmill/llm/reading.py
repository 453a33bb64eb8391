"""Problem 8: a reading level from 1 to 5 for every English document.

Boosted regression trees over distributions of length, vocabulary, syntax and cohesion, trained on
a bounded sample of graded documents. Predictions are cross-validated with whole sources held out,
and the held-out predictions calibrate the cut points between levels. All documents are scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.ml import GradientBoosting

#: Graded documents used for training (lowest hash first), their greatest length in characters, and folds.
TRAIN_DOCS, TRAIN_CHARS, FOLDS = 4000, 40_000, 5
MIN_WORDS, LEVELS = 50, 5
_CHUNK = 1_500_000
_MASK = (1 << 20) - 1

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(97, 123)) + list(range(128, 256)) + [39]] = True
_POWERS = np.array([pow(1_000_003, k, 1 << 32) for k in range(64)], dtype=np.uint64)

#: Function words that tell languages apart, and word classes of English.
_LANGUAGE_WORDS = {
    "en": "the of and that is to our this every not we which it on for be with from by what must an its would can if whether one who these those their you my was when look there how but has as so or than only",
    "fr": "le les des du une est qui ne pas dans pour ce cette aux par il nous se sa ses mais ou donc parce cependant avec rien pourtant lorsque notre",
    "de": "der die das und nicht ist ein eine dass zu den dem des von mit sich auf für wie wenn jede wird aber denn doch hier was man",
    "es": "el los las del una es no en por para con su lo como pero esta nuestra entonces todo al sin porque que nada",
    "la": "et non est quod cum ad nec ergo quia itaque tamen quamquam aut enim vel ut ex omnis haec hoc quam autem aliquis vix sequitur rerum",
}
_CLASSES = {
    "and": "and", "that": "that", "relative": "which who whom whose where", "subordinate": "because although though unless whether if since while inasmuch insofar whereas lest granting suppose so",
    "preposition": "of in on to by from with about upon under within without beneath over behind between against", "article": "the a an", "pronoun": "i you we he she it they me us them my your our his her its their",
    "be": "is are be was were been being am", "connective": "however therefore thus hence moreover nevertheless consequently furthermore indeed then but yet first", "question": "how what why does do can",
}


def _hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), dtype=np.uint8).astype(np.uint64)
        out.append(int((b * _POWERS[np.minimum(np.arange(len(b)), 63)]).sum()) & 0xFFFFFFFF)
    return np.array(out, dtype=np.int64)


def _table(words: dict[str, str]) -> np.ndarray:
    """Bit k of the entry of a word's hash is set if the word is in the k-th list."""
    table = np.zeros(_MASK + 1, dtype=np.uint16)
    for k, v in enumerate(words.values()):
        table[_hash(v.split()) & _MASK] |= np.uint16(1 << k)
    return table


_LANG, _CLASS = _table(_LANGUAGE_WORDS), _table(_CLASSES)
FEATURES = 22 + LEVELS + len(_CLASSES) + 9


class Parsed:
    """Words and sentences of a block of texts as flat arrays."""

    def __init__(self, texts: list[str]):
        buffer = np.frombuffer(("\x00".join(t.replace("\x00", " ") for t in texts) + "\x00").lower().encode("utf-8", "replace"), dtype=np.uint8)
        self.n = len(texts)
        zeros = np.flatnonzero(buffer == 0)
        letter = _LETTER[buffer]
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.length = end - start
        at = np.flatnonzero(letter)
        first = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if len(start) else np.zeros(0, dtype=np.int64)
        position = np.arange(len(at)) - np.repeat(first, self.length)
        values = buffer[at].astype(np.uint64) * _POWERS[np.minimum(position, 63)]
        self.word = (np.add.reduceat(values, first) & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(first) else np.zeros(0, dtype=np.int64)
        self.doc = np.searchsorted(zeros, start)
        after = np.append(buffer[1:], 0)
        stop = ((buffer == 46) | (buffer == 33) | (buffer == 63)) & (after <= 34) | (buffer == 0) | (buffer == 10) & (after == 10)
        raw = np.searchsorted(np.flatnonzero(stop), start)
        new = np.diff(raw, prepend=-1) != 0
        self.sentence = np.cumsum(new) - 1
        self.sentence_doc = self.doc[new]
        comma = np.flatnonzero(buffer == 44)
        pause = np.flatnonzero((buffer == 59) | (buffer == 58))
        self.commas = np.bincount(np.searchsorted(zeros, comma), minlength=self.n)[: self.n]
        self.pauses = np.bincount(np.searchsorted(zeros, pause), minlength=self.n)[: self.n]
        self.words = np.bincount(self.doc, minlength=self.n)

    def english(self) -> np.ndarray:
        counts = np.stack([np.bincount(self.doc, (_LANG[self.word & _MASK] >> k) & 1, self.n) for k in range(len(_LANGUAGE_WORDS))])
        return (counts[0] > 2 * counts[1:].max(0)) & (counts[0] >= 0.08 * self.words)


def _spread(group: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    """Mean, deviation and 10/50/90 % points of the values of each group."""
    count = np.bincount(group, minlength=n)
    safe = np.maximum(count, 1)
    mean = np.bincount(group, value, n) / safe
    deviation = np.sqrt(np.maximum(np.bincount(group, value * value, n) / safe - mean**2, 0))
    order = np.lexsort((value, group))
    first = np.cumsum(count) - count
    ranked = np.append(value[order], 0.0)
    points = [ranked[np.minimum(first + (q * np.maximum(count - 1, 0)).astype(int), len(value))] for q in (0.1, 0.5, 0.9)]
    return [mean, deviation, *points]


def features(p: Parsed, difficulty: np.ndarray) -> np.ndarray:
    """One row per text. `difficulty`: mean level of the graded documents with a word, by hash; nan if unknown."""
    n, words = p.n, np.maximum(p.words, 1)
    share = lambda mask: np.bincount(p.doc, mask, n) / words
    sentences = len(p.sentence_doc)
    size = np.bincount(p.sentence, minlength=sentences).astype(float)
    hard = difficulty[p.word & _MASK]
    known = ~np.isnan(hard)
    hard = np.where(known, hard, 0.0)
    known_in = np.bincount(p.sentence, known, sentences)
    sentence_hard = np.bincount(p.sentence, hard, sentences) / np.maximum(known_in, 1)
    sentence_hard = np.where(known_in > 0, sentence_hard, 3.0)
    sentence_length = np.bincount(p.sentence, p.length, sentences) / np.maximum(size, 1)
    cls = _CLASS[p.word & _MASK]
    key = (p.doc.astype(np.int64) << 32) | p.word
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    distinct = np.bincount(p.doc[order][np.append(True, ~same)] if len(order) else p.doc, minlength=n)
    gap = np.diff(p.sentence[order])
    near = same & (gap == 1) & (p.length[order][1:] > 3)
    repeated = np.bincount(p.doc[order][1:][near], minlength=n) / words
    known_words = np.maximum(np.bincount(p.doc, known, n), 1)
    bands = np.clip(np.rint(hard), 1, LEVELS)
    columns = [
        np.log1p(p.words), np.log1p(np.bincount(p.sentence_doc, minlength=n)), *_spread(p.sentence_doc, size, n), *_spread(p.doc, p.length.astype(float), n)[:2], *[share(p.length >= k) for k in (7, 10, 13)],
        distinct / np.sqrt(words), *_spread(p.sentence_doc, sentence_hard, n), *_spread(p.sentence_doc, sentence_length, n)[2:], np.bincount(p.doc, hard, n) / known_words,
        *[np.bincount(p.doc, known & (bands == k), n) / known_words for k in range(1, LEVELS + 1)],
        *[share((cls >> k) & 1) for k in range(len(_CLASSES))],
        p.commas / words, p.pauses / words, repeated, share(~known),
        *[np.bincount(p.sentence_doc, size * ((sentence_hard > k - 0.5) & (sentence_hard <= k + 0.5)), n) / words for k in range(1, LEVELS + 1)],
    ]
    return np.stack(columns, axis=1)


def word_levels(p: Parsed, level: np.ndarray, prior: float = 2.0) -> np.ndarray:
    """For each word hash the mean level of the texts it stands in, drawn to 3; nan for words seen once or never."""
    total = np.bincount(p.word & _MASK, level[p.doc], _MASK + 1)
    count = np.bincount(p.word & _MASK, minlength=_MASK + 1)
    return np.where(count > 1, (total + 3 * prior) / (count + prior), np.nan).astype(np.float32)


def calibrate(predicted: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Cut points between neighbouring levels with the fewest wrong sides among held-out predictions."""
    cuts = []
    for k in range(1, LEVELS):
        grid = np.arange(k + 0.2, k + 0.8, 0.01)
        # graded levels are means; those on the border count half on either side
        low, high = predicted[level < k + 0.5], predicted[level > k + 0.5]
        wrong = [(low > g).sum() + (high <= g).sum() for g in grid]
        best = np.flatnonzero(np.array(wrong) == min(wrong))
        cuts.append(float(grid[best[len(best) // 2]]))
    return np.maximum.accumulate(np.array(cuts))


class LevelModel:
    """Word levels, trees and cut points."""

    def fit(self, texts: list[str], level: np.ndarray, source: np.ndarray) -> "LevelModel":
        n = len(texts)
        codes = pd.factorize(pd.Series(source).fillna("").astype(str), sort=True)[0] if n else np.zeros(0, int)
        fold = codes % FOLDS
        x, out = np.zeros((n, FEATURES)), np.full(n, 3.0)
        whole = Parsed(texts)
        for k in range(FOLDS):
            held, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(held) and len(rest):
                x[held] = features(Parsed([texts[i] for i in held]), word_levels(Parsed([texts[i] for i in rest]), level[rest]))
        for k in range(FOLDS):
            held, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(held) and len(rest):
                out[held] = GradientBoosting(trees=80, depth=3, rate=0.1).fit(x[rest], level[rest]).predict(x[held])
        self.cuts = calibrate(out, level) if n else np.arange(1.5, LEVELS)
        self.held_out, self.level, self.source = out, level, source
        self.trees = GradientBoosting(trees=120, depth=3, rate=0.08).fit(x, level)
        if not n:
            self.trees.base = 3.0
        self.difficulty = word_levels(whole, level)
        rounded = np.rint(level)
        got = 1 + np.searchsorted(self.cuts, out)
        self.scores = {"exact": float((got == rounded).mean()) if n else 0.0, "within_one": float((abs(got - rounded) <= 1).mean()) if n else 0.0, "mean_error": float(abs(out - level).mean()) if n else 0.0}
        return self

    def predict(self, p: Parsed) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, self.trees.predict(features(p, self.difficulty)))


def train(documents: DataFrame, labels: DataFrame, docs: int = TRAIN_DOCS) -> LevelModel:
    """A model from at most `docs` graded documents: the mean over graders counts (repeated rows and nulls dropped)."""
    graded = labels.filter("reading_level is not null").select("doc_id", "grader", "reading_level").distinct().groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    picked = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs).select(F.col("doc_id").alias("_id"), "level")
    texts = documents.filter((F.length("text") > 0) & (F.length("text") <= TRAIN_CHARS)).select("doc_id", "source", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = texts.select("doc_id", "source", "text", "level").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return LevelModel().fit([r.text for r in rows], np.array([r.level for r in rows], dtype=float), np.array([r.source for r in rows], dtype=object))


def held_out_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, exact, within_one, mean_error): calibrated predictions for the graded documents of each source
    by trees that saw none of that source. One row per source of the training sample."""
    m = train(documents, labels)
    schema = "source string, n_docs bigint, exact double, within_one double, mean_error double"
    if not len(m.held_out):
        return documents.sparkSession.createDataFrame([], schema)
    got, true = 1 + np.searchsorted(m.cuts, m.held_out), np.rint(m.level)
    p = pd.DataFrame({"source": m.source, "n": 1, "exact": got == true, "near": abs(got - true) <= 1, "error": abs(m.held_out - m.level)}).groupby("source", dropna=False).agg({"n": "sum", "exact": "mean", "near": "mean", "error": "mean"})
    return documents.sparkSession.createDataFrame([(s if isinstance(s, str) else None, int(r.n), round(float(r.exact), 4), round(float(r.near), 4), round(float(r.error), 4)) for s, r in p.iterrows()], schema)


_LEVEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("reading_level", T.LongType()), T.StructField("n_words", T.LongType())])


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level, n_words) of every document that is in English by its text and has 50 words.

    Null, short and other texts are left out; repeated rows get the same level. Without any labels
    every document gets level 3.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def blocks(ids, texts):
        block, size = [], 0
        for i, t in zip(ids, texts):
            if t:
                block.append((i, t))
                size += len(t)
                if size > _CHUNK:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    def run(batches):
        m = model.value
        for b in batches:
            for block in blocks(b["doc_id"], b["text"]):
                p = Parsed([t for _, t in block])
                keep = p.english() & np.array([len(t.split()) >= MIN_WORDS for _, t in block])
                level = m.predict(p)
                yield pd.DataFrame({"doc_id": np.array([i for i, _ in block])[keep], "reading_level": level[keep], "n_words": p.words[keep]})

    return documents.select("doc_id", "text").mapInPandas(run, _LEVEL)


def levels_found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return reading_levels(documents, labels).select("doc_id", "reading_level").distinct()


def level_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus by level: documents, words and share of all scored documents."""
    by = reading_levels(documents, labels).groupBy("reading_level").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))
    everything = F.sum("n_docs").over(Window.partitionBy())  # over one row per level
    return by.withColumn("doc_share", F.round(F.col("n_docs") / everything, 6))
