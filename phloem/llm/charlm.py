"""Smoothed character n-gram models over hashed counts of fixed size."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the count table: a model has at most this many counts whatever the corpus, so its size is known.
BUCKETS = 1 << 20
_M1, _M2, _M3 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
_MASK = (1 << 64) - 1
#: Distinct words that a task holds before it hands on their counts.
_HELD = 200_000


def _mix(h):
    return (h ^ (h >> 15)) % BUCKETS


def _ids(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of each 1-, 2- and 3-gram that ends at each place (from the third on)."""
    c = codes.astype(np.uint64)
    one = c * np.uint64(_M1)
    two = c[1:] * np.uint64(_M1) + c[:-1] * np.uint64(_M2) + np.uint64(1)
    three = c[2:] * np.uint64(_M1) + c[1:-1] * np.uint64(_M2) + c[:-2] * np.uint64(_M3) + np.uint64(2)
    return [((h ^ (h >> np.uint64(15))) % np.uint64(BUCKETS)).astype(np.int64) for h in (one, two, three)]


def word_table(texts: DataFrame, reader: Callable[[], Callable[[str], list[str]]], folds: int = 1) -> DataFrame:
    """(word, n): how often each word stands in the column ``text`` of all rows; (fold, word, n) of several ``folds``, numbered in the column ``fold``.

    ``reader()`` gives, once a task, the function that takes a text apart; empty words are not counted. A task adds its words up before they are
    shuffled and hands on what it has whenever ``_HELD`` distinct words have gathered.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, seen = reader(), defaultdict(Counter)
        for batch in batches:
            for fold, text in zip(batch["fold"] if folds > 1 else repeat(0), batch["text"]):
                if text is not None:
                    seen[fold].update(read(text))
                if len(seen[fold]) > _HELD // folds:
                    yield frame(fold, seen.pop(fold))
        for fold, words in seen.items():
            if words:
                yield frame(fold, words)

    def frame(fold: int, words: Counter) -> pd.DataFrame:
        return pd.DataFrame(({"fold": fold} if folds > 1 else {}) | {"word": list(words.keys()), "n": list(words.values())})

    key = ["fold"] if folds > 1 else []
    counted = texts.select(*key, "text").mapInPandas(count, f"{'fold int, ' if key else ''}word string, n long")
    return counted.filter("word <> ''").groupBy(*key, "word").agg(F.sum("n").alias("n"))


def ngram_counts(words: DataFrame, form: str = "NFC", folds: int = 1) -> np.ndarray:
    """Counts of all 1- to 3-grams of a ``word_table``, each word between blanks: summed on the executors, at most BUCKETS rows a fold to the driver.

    Of several folds, those of each stand one after the other.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(folds * BUCKETS)
        for batch in batches:
            if not len(batch):
                continue
            read = [unicodedata.normalize(form, w) for w in batch["word"]]
            codes = np.frombuffer(("  " + "  ".join([*read, ""])).encode("utf-32-le"), dtype=np.uint32)
            spans = [len(w) + 2 for w in read]
            weights = np.repeat(batch["n"].to_numpy(), spans)
            weights = np.concatenate([weights[:1], weights[:1], weights])
            if folds == 1:
                for ids in _ids(codes):
                    counts += np.bincount(ids, weights[len(codes) - len(ids) :], BUCKETS)
                continue
            first = np.repeat(batch["fold"].to_numpy().astype(np.int64) * BUCKETS, spans)
            first = np.concatenate([first[:1], first[:1], first])
            for ids in _ids(codes):
                at = len(codes) - len(ids)
                np.add.at(counts, ids + first[at:], weights[at:].astype(float))
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": counts[at].astype(np.int64)})

    summed = words.select(*(["fold"] if folds > 1 else []), "word", "n").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    counts = np.zeros(folds * BUCKETS, dtype=np.float32)
    counts[np.asarray(got["bucket"])] = np.asarray(got["n"])
    return counts


class CharModel:
    """p(c|ab), smoothed by the shorter contexts down to a uniform one. An unseen character costs about ln(total)."""

    def __init__(self, counts: np.ndarray, weight: float = 2.0, held: int = 200_000):
        self.counts, self.weight, self.held = counts, weight, held
        self.total = float(counts.sum()) / 3 + 1
        self._seen: dict[str, float] = {}
        self._grams: dict[str, float] = {}

    def score(self, word: str) -> float:
        """Log probability of a word between two blanks."""
        known = self._seen.get(word)
        if known is not None:
            return known
        text, grams, total = f"  {word} ", self._grams, 0.0
        for i in range(len(word) + 1):
            gram = text[i : i + 3]
            part = grams.get(gram)
            if part is None:
                part = self._log(gram)
                if len(grams) < self.held:
                    grams[gram] = part
            total += part
        if len(self._seen) < self.held:
            self._seen[word] = total
        return total

    def _log(self, gram: str) -> float:
        """Log probability of the last of three characters after the others."""
        counts, a = self.counts, self.weight
        b2, b1, c = map(ord, gram)
        i1 = _mix((c * _M1) & _MASK)
        i2 = _mix((c * _M1 + b1 * _M2 + 1) & _MASK)
        i3 = _mix((c * _M1 + b1 * _M2 + b2 * _M3 + 2) & _MASK)
        j1 = _mix((b1 * _M1) & _MASK)
        j2 = _mix((b1 * _M1 + b2 * _M2 + 1) & _MASK)
        p1 = (counts[i1] + 0.5) / (self.total + 500)
        p2 = (counts[i2] + a * p1) / (counts[j1] + a)
        p3 = (counts[i3] + a * p2) / (max(counts[j2], counts[i3]) + a)
        return math.log(p3)
