"""Language of whole texts: script ranges, word scores and Viterbi with a switching penalty.

Counts of hashed letter trigrams are summed over all training rows. The script
of a word's first letter narrows the languages to those that use that script;
Viterbi over the word scores pays a penalty for each switch and so labels spans
of mixed-language text. A text whose best single language cannot be beaten by
any switch is labelled without the recursion: no run of words gains the penalty.

Defined results: null text or a text without a letter is ``und`` with score 0;
null languages teach nothing; a null doc_id is never held out and never taught
from; repeated rows are scored alike; with nothing learned all texts are
``und``; languages of equal score go by name, the first one wins; very long texts are read
whole, one at a time; an empty table has no rows; extra columns play no part. The
learned counts are brought to the driver, ``BUCKETS`` numbers a language, so more than
``MAX_LANGUAGES`` different names are refused: such a column is no list of languages.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import few_rows

BUCKETS = 1 << 16
MAX_LANGUAGES = 1_000
# fixed values: first code points of script ranges and the script that begins there
SCRIPTS = [(0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 3), (0x900, 6), (0x980, 3), (0xE00, 7), (0xE80, 3), (0x1E00, 0), (0x1F00, 1), (0x2000, 3), (0x3040, 8), (0x3100, 3), (0x3400, 9), (0xA000, 3), (0xAC00, 10), (0xD7B0, 3), (0xF900, 9), (0xFB00, 3), (0x20000, 9)]
N_SCRIPTS = 11
_STARTS, _NAMES = np.array([a for a, _ in SCRIPTS]), np.array([b for _, b in SCRIPTS])
_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0][codes]


def lower(text: str) -> str:
    """Lower case with the same number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := c.lower()) == 1 else c for c in text)


def letter_trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter; index of each word's first letter among the letters; first and last positions of words in the text."""
    codes = np.frombuffer(("\0" + lower(text) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _is_letter(codes)
    codes = np.where(letter, codes, 0)
    at = np.flatnonzero(letter)
    mixed = codes[at - 1] * 0x9E3779B1 + codes[at] * 0x85EBCA6B + codes[at + 1] * 0xC2B2AE35
    buckets = ((mixed ^ (mixed >> 15)) * 0x27D4EB2F >> 13) & (BUCKETS - 1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.diff(at) > 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return buckets, first, at[first] - 1, at[last] - 1 if len(at) else at


def script_of(codes: np.ndarray) -> np.ndarray:
    return _NAMES[np.searchsorted(_STARTS, codes, side="right") - 1]


class Model:
    """Learned scores: log probabilities by bucket and language, languages by script."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray, penalty: float):
        self.languages, self.penalty = languages, penalty
        smooth = counts + 0.05
        self.logs = (np.log(smooth) - np.log(smooth.sum(axis=0))).astype(np.float32) if languages else counts
        uses = letters >= 0.01 * np.maximum(1, letters.sum(axis=1, keepdims=True))
        uses &= letters > 0
        self.barred = np.where(uses | ~uses.any(axis=0), 0.0, -1e4).T if languages else letters.T  # script x language

    def word_scores(self, text: str):
        buckets, first, begin, end = letter_trigrams(text)
        if not len(first) or not self.languages:
            return None
        scores = np.add.reduceat(self.logs[buckets], first, axis=0).astype(np.float64)
        codes = np.fromiter((ord(text[i]) for i in begin.tolist()), dtype=np.int64, count=len(begin)) if not text.isascii() else None
        if codes is not None:
            scores = scores + self.barred[script_of(codes)]
        else:
            scores = scores + self.barred[0]
        return scores, begin, end

    def labels(self, scores: np.ndarray) -> np.ndarray:
        """Best language of each word under the switching penalty."""
        best = int(scores.sum(axis=0).argmax())
        if scores.shape[1] == 1:
            return np.zeros(len(scores), dtype=np.int64)
        other = scores.copy()
        other[:, best] = -np.inf
        gain = np.concatenate([[0.0], np.cumsum(other.max(axis=1) - scores[:, best])])
        if (gain - np.minimum.accumulate(gain)).max() <= self.penalty:
            return np.full(len(scores), best)
        back = np.zeros(scores.shape, dtype=np.int16)
        now = scores[0].tolist()
        own = range(len(now))
        for t, row in enumerate(scores[1:].tolist(), 1):
            top = max(own, key=now.__getitem__)
            switched = now[top] - self.penalty
            step = [(i, now[i]) if now[i] >= switched else (top, switched) for i in own]
            back[t] = [i for i, _ in step]
            now = [v + s for (_, v), s in zip(step, row, strict=True)]
        at = max(own, key=now.__getitem__)
        out = np.empty(len(scores), dtype=np.int64)
        for t in range(len(scores) - 1, -1, -1):
            out[t] = at
            at = back[t][at]
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) over the words of a text; end exclusive."""
        found = self.word_scores(text) if text else None
        if found is None:
            return []
        scores, begin, end = found
        label = self.labels(scores)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]])
        return [(int(begin[a]), int(end[b - 1]) + 1, self.languages[label[a]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters, and its share of them."""
        found = self.word_scores(text) if text else None
        if found is None:
            return "und", 0.0
        scores, begin, end = found
        letters = np.bincount(self.labels(scores), weights=end - begin + 1, minlength=len(self.languages))
        top = int(letters.argmax())
        return self.languages[top], float(letters[top] / letters.sum())


def fit(docs: DataFrame, penalty: float = 12.0) -> Model:
    """Learn from every row with a language whose id is not held out. The sums have BUCKETS + N_SCRIPTS rows a language at most."""
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    own = docs.where("doc_id is not null and lang is not null and text is not null").where(bucket != 0).select(F.col("lang").cast("string"), F.col("text").cast("string"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in few_rows(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buckets, first, begin, end = letter_trigrams(text)
                row = sums.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
                if len(buckets) < BUCKETS // 16:
                    np.add.at(row, buckets, 1)
                else:
                    row[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                if text.isascii():
                    row[BUCKETS] += len(buckets)
                elif len(begin):
                    codes = np.fromiter((ord(text[i]) for i in begin.tolist()), dtype=np.int64, count=len(begin))
                    np.add.at(row, BUCKETS + script_of(codes), end - begin + 1)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "at", "n"])

    parts = own.mapInArrow(run, "lang string, at int, n long")
    names = own.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    rows = parts.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()  # ``BUCKETS`` rows a language at most
    languages = sorted(rows["lang"].unique().tolist())
    sums = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    sums[rows["at"], rows["lang"].map({x: i for i, x in enumerate(languages)}).astype(int)] = rows["n"]
    return Model(languages, sums[:BUCKETS], sums[BUCKETS:].T, penalty)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    from .quality import held_out

    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed buckets for each language

    def run(batches):
        for batch in few_rows(batches):
            found = [shared.value.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], type=pa.string()), pa.array([y for _, y in found], type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
