"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-cased words and their longer
prefixes (so that inflected forms share a term). The machine scores
w0 + sum w_i + sum_{i<j} <v_i, v_j>, the pair part through (sum v)^2 - sum v^2,
so that a pair of terms may weigh more than both alone. Hashes have 31 bits.

Every term of the training texts has a weight and factors; how far they may
move is a matter of evidence. The penalty of both falls with the number of
texts that have the term (a name met once stays near zero), that of the weight
also with how far the term's toxic share is from the overall share. The factors
don't depend on the latter, so terms that tell only in pairs are learnt.

Training takes at most TRAIN_ROWS labelled rows (a documented bound of the
fit), counted after repeated rows are joined; scoring covers every text whole.
Null texts score as empty ones, repeated rows alike. Without labels the score is
that of the prior, 0.5; an empty table gives an empty result. Columns of the
input that are named ``score`` or ``predicted`` keep their values as
``score_input`` and ``predicted_input``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import added
from .labelled import bounded, fold, training_rows

TRAIN_ROWS, FACTORS, STEPS, RATE = 6_000, 3, 60, 0.1
#: Penalties of weights and factors; texts a term needs, and standard deviations its share is off (LEAST_OFF at least), for a penalty near that.
RIDGE, FACTOR_RIDGE, SEEN, TOLD, LEAST_OFF = 0.1, 40.0, 8, 6.0, 1.0
COMMON = 300  # texts from which on a term's share tells enough by itself
PREFIXES, CACHE = (5, 6, 7), 1 << 18
_WORDS = re.compile(r"\w+").findall


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its proper prefixes of the lengths in PREFIXES, which end in a star."""
    b, n = word.encode("utf-8"), len(word)
    whole = crc32(b) >> 1
    if n <= PREFIXES[0]:
        return (whole,)
    ends = PREFIXES if len(b) == n else [len(word[:k].encode("utf-8")) for k in PREFIXES]
    return (whole, *[crc32(b"*", crc32(b[:end])) >> 1 for k, end in zip(PREFIXES, ends, strict=True) if n > k])


def text_terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text, ascending."""
    found: set[int] = set()
    for w in set(_WORDS((text or "").lower())):
        found.update(word_terms(w))
    return np.array(sorted(found), dtype=np.int64)


def _chunks(sizes: list[int], most: int = 1 << 20) -> list[tuple[int, int, int, int]]:
    """(first row, end, first posting, end) of runs of rows with some ``most`` postings each."""
    out, a, i, j = [], 0, 0, 0
    for k, n in enumerate(sizes):
        j += n
        if j - i >= most or k + 1 == len(sizes):
            out.append((a, k + 1, i, j))
            a, i = k + 1, j
    return out


class FactorizationMachine:
    """Weights and factors of all terms met in training."""

    def fit(self, rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, steps: int = STEPS, seed: int = 5) -> FactorizationMachine:
        """``rows``: the distinct hashed terms of each text. Penalised likelihood by full-batch steps."""
        m, sizes = len(y), [len(r) for r in rows]
        self.key = uuid.uuid4().hex
        self.terms, ids = np.unique(np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int32), return_inverse=True)
        n, ids = len(self.terms), ids.astype(np.int32)
        self.w, self.v = np.zeros(n, np.float32), np.zeros((factors, n), np.float32)
        share = (y.sum() + 1) / (m + 2)
        self.w0 = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        self.v = np.random.default_rng(seed).normal(0, 0.02, (factors, n)).astype(np.float32)
        chunks = _chunks(sizes)
        met, toxic = np.bincount(ids, minlength=n), np.zeros(n)
        for a, b, i, j in chunks:
            toxic += np.bincount(ids[i:j], np.repeat(y[a:b], sizes[a:b]), n)
        off = np.abs(toxic - met * share) / np.sqrt(met * share * (1 - share))
        few = 1 + (SEEN / met) ** 2
        ridge = (RIDGE * few * (1 + (TOLD / np.maximum(off, LEAST_OFF)) ** 4 * np.minimum(1, COMMON / met))).astype(np.float32)
        penalties = [ridge] + [(FACTOR_RIDGE * few).astype(np.float32)] * factors
        parts = [self.w, *self.v]
        mean, square = [np.zeros(n, np.float32) for _ in parts], [np.zeros(n, np.float32) for _ in parts]
        for step in range(1, steps + 1):
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            slopes, slope0 = [np.zeros(n, np.float32) for _ in parts], 0.0
            for a, b, i, j in chunks:  # the gradient is that of all rows, summed up in chunks
                at, row = ids[i:j], np.repeat(np.arange(b - a), sizes[a:b])
                seen = [v[at] for v in self.v]
                totals = [np.bincount(row, x, b - a) for x in seen]
                z = self.w0 + np.bincount(row, self.w[at], b - a)
                for x, t in zip(seen, totals, strict=True):
                    z += 0.5 * (t * t - np.bincount(row, x * x, b - a))
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]
                e = err[row]
                slope0 += err.sum()
                slopes[0] += np.bincount(at, e, n)
                for g, x, t in zip(slopes[1:], seen, totals, strict=True):
                    g += np.bincount(at, e * (t[row] - x), n)
            for x, g, penalty, first, second in zip(parts, slopes, penalties, mean, square, strict=True):
                g += penalty * x
                first += 0.1 * (g - first)
                second += 0.02 * (g * g - second)
                x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-6)
            self.w0 -= rate * slope0 / (0.25 * m)
        return self

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores of texts. The terms of words are looked up together for a batch, and kept until CACHE words are and all are let go."""

    def __init__(self, model: FactorizationMachine):
        self.w0, self.terms, self.known = model.w0, model.terms, {}
        self.table = np.column_stack([model.w, *model.v])  # a term's weight and factors lie side by side

    def _learn(self, words: list[str]) -> None:
        found = [word_terms(w) for w in words]
        sizes = list(map(len, found))
        at = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=sum(sizes))
        i = np.searchsorted(self.terms, at)
        met = np.flatnonzero(self.terms[np.minimum(i, len(self.terms) - 1)] == at) if len(self.terms) else np.zeros(0, dtype=np.int64)
        ends = np.searchsorted(met, np.cumsum(sizes)).tolist()
        ids, start = i[met].tolist(), 0
        for w, end in zip(words, ends, strict=True):
            self.known[w] = tuple(ids[start:end])
            start = end

    def many(self, texts) -> list[float]:
        bags = [set(_WORDS((t or "").lower())) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn(list(set().union(*bags).difference(self.known)))
        out = []
        for bag in bags:
            ids, z = set().union(*map(self.known.__getitem__, bag)), self.w0
            if ids:
                i = np.fromiter(ids, dtype=np.int64, count=len(ids))
                i.sort()
                x = self.table[i].astype(np.float64)
                total = x.sum(0)
                z += total[0] + 0.5 * (total[1:] @ total[1:] - np.einsum("ij,ij->", x[:, 1:], x[:, 1:]))
            out.append(float(1 / (1 + np.exp(-min(max(z, -30), 30)))))
        return out

    def __call__(self, text: str | None) -> float:
        return self.many([text])[0]


_KEPT: dict = {}


def _kept_scorer(model: FactorizationMachine) -> Scorer:
    """This process's scorer of that model; a worker keeps one, the latest."""
    if model.key not in _KEPT:
        _KEPT.clear()
        _KEPT[model.key] = model.scorer()
    return _KEPT[model.key]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on the driver from the terms of at most ``rows`` texts. An action."""

    def termed(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [text_terms(t).astype(np.int32) for t in pdf["text"]]})

    got = bounded(training_rows(docs, labels, label, folds, held_out, rows).mapInPandas(termed, "doc_id long, y double, x array<int>"), rows).toPandas()
    return FactorizationMachine().fit(list(got["x"]), got["y"].to_numpy(dtype=float))


def toxicity_of(spark, model: FactorizationMachine, text: Column) -> Column:
    """The score of a text column. The broadcast model is bounded by the training sample."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _kept_scorer(shared.value)
        for texts in batches:
            yield pd.Series(one.many(texts), dtype=float)

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7) -> DataFrame:
    """Add ``score`` and ``predicted``."""
    out = added(docs, score=toxicity_of(docs.sparkSession, model, F.col("text")))
    return added(out, predicted=(F.col("score") >= threshold).cast("int"))


def op7_toxicity_scores(spark, sf_dir) -> DataFrame:
    from ..session import share_code, table

    share_code(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
