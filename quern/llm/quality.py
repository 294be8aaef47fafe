"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by a fixed list of numbers (no label, language, source
or id among them). Boosting goes round the features; at each turn a shallow
tree on one binned feature is fitted to the gradients and added, at a small
rate, to that feature's lookup table. Then the pairs of features that explain
most of the remaining gradient get two-way tables in the same way. Scoring bins
the features of a batch at once and adds table entries.

Training takes at most TRAIN_ROWS labelled rows (a documented bound of the
fit), counted after repeated rows are joined; scoring covers every text whole.
Null texts score as empty ones, repeated rows alike. Without labels the score is
0.5 everywhere; an empty table gives an empty result. Columns of the input that
are named ``score`` or ``predicted`` keep their values as ``score_input`` and
``predicted_input``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import added
from .labelled import bounded, fold, training_rows

TRAIN_ROWS = 12_000
FEATURES = ("log_chars", "log_words", "word_chars", "upper", "digit", "punct", "symbol", "space", "distinct", "top_word", "repeat_next", "distinct_pairs", "log_lines", "repeated_lines", "line_words", "closed_lines", "bare_marks", "marked_ends", "long_word", "short_words")


def _classes() -> np.ndarray:
    """Code point to class: 0 letter or other, 1 upper case, 2 digit, 3 space, 4 punctuation of prose, 5 symbol."""
    lut = np.zeros(0x251, dtype=np.uint8)
    for i in range(0x250):
        c = chr(i)
        lut[i] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() or i < 32 else 4 if c in ".,;:'\"?()-" else 0 if c.isalpha() else 5
    return lut


_LUT = _classes()


def describe(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    text = text or ""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), 0x250)
    kinds = np.bincount(_LUT[points], minlength=6)
    n, w = max(len(text), 1), text.split()
    m = max(len(w), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    top = max(Counter(w).values(), default=0)
    pairs = max(len(w) - 1, 1)
    return [
        np.log1p(len(text)), np.log1p(len(w)), sum(map(len, w)) / m, kinds[1] / n, kinds[2] / n, kinds[4] / n, kinds[5] / n, kinds[3] / n,
        len(set(w)) / m, top / m, sum(map(str.__eq__, w, w[1:])) / pairs, len(set(zip(w, w[1:], strict=False))) / pairs,
        np.log1p(len(lines)), 1 - len(set(lines)) / k, len(w) / k, sum(x.rstrip()[-1] in ".?" for x in lines) / k,
        sum(not any(map(str.isalnum, x)) for x in w[:]) / m if kinds[5] + kinds[4] else 0.0,
        sum(not x[-1].isalnum() and x[-1] not in ".,;:?" for x in w) / m, np.log1p(max(map(len, w), default=0)), sum(len(x) <= 3 for x in w) / m,
    ]


def _stump_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values per bin of a greedy tree with that many leaves on one ordered feature."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    cuts, score = [0, len(g)], lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = (cg[c] - cg[a]) ** 2 / (ch[c] - ch[a] + ridge) + (cg[b] - cg[c]) ** 2 / (ch[b] - ch[c] + ridge) - score(a, b)
                best = max(best, (gain.max(), int(c[gain.argmax()])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.pairs, self.rate, self.leaves, self.ridge = bins, coarse, rounds, pair_rounds, pairs, rate, leaves, ridge

    def _binned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.nan_to_num(x)
        fine = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)
        rough = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.rough)], axis=1)
        return fine, rough

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        x, d = np.nan_to_num(x), x.shape[1]
        q = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
        self.cuts, self.rough = q(self.bins), q(self.coarse)
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base, self.tables, self.two_way = float(np.log(rate / (1 - rate))), [np.zeros(len(c) + 1) for c in self.cuts], []
        if len(y) == 0 or y.min() == y.max():
            return self
        fine, rough = self._binned(x)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                n = len(self.tables[j])
                step = self.rate * _stump_tree(np.bincount(fine[:, j], y - p, n), np.bincount(fine[:, j], p * (1 - p), n), self.leaves, self.ridge)
                self.tables[j] += step
                f += step[fine[:, j]]
        p = 1 / (1 + np.exp(-f))
        gains = []
        for a in range(d):
            for b in range(a + 1, d):
                n = (len(self.rough[a]) + 1, len(self.rough[b]) + 1)
                cell = rough[:, a] * n[1] + rough[:, b]
                g, h = np.bincount(cell, y - p, n[0] * n[1]), np.bincount(cell, p * (1 - p), n[0] * n[1])
                gains.append(((g**2 / (h + self.ridge)).sum() - (g.reshape(n).sum(1) ** 2 / (h.reshape(n).sum(1) + self.ridge)).sum() - (g.reshape(n).sum(0) ** 2 / (h.reshape(n).sum(0) + self.ridge)).sum(), a, b, cell, n))
        gains.sort(key=lambda t: (-t[0], t[1], t[2]))
        self.two_way = [(a, b, np.zeros(n)) for _, a, b, _, n in gains[: self.pairs]]
        for _ in range(self.pair_rounds):
            for (_, _, cell, n), (_, _, table) in zip((t[1:] for t in gains[: self.pairs]), self.two_way, strict=True):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(cell, y - p, n[0] * n[1]).reshape(n), np.bincount(cell, p * (1 - p), n[0] * n[1]).reshape(n)
                # A two-level tree: the best cut of the first feature, then one cut of the second on each side.
                cg, ch = g.sum(1).cumsum()[:-1], h.sum(1).cumsum()[:-1]
                at = int((cg**2 / (ch + self.ridge) + (g.sum() - cg) ** 2 / (h.sum() - ch + self.ridge)).argmax()) + 1 if n[0] > 1 else 0
                step = np.zeros(n)
                for side in (slice(0, at), slice(at, None)):
                    if g[side].size:
                        step[side] = self.rate * _stump_tree(g[side].sum(0), h[side].sum(0), 2, self.ridge)
                table += step
                f += step.reshape(-1)[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self._binned(x)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[fine[:, j]]
        for a, b, t in self.two_way:
            f += t[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-f))


def features_of(texts) -> np.ndarray:
    return np.array([describe(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on the driver from at most ``rows`` rows of features. An action."""

    def described(batches):
        for pdf in batches:
            x = features_of(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": list(x)})

    got = bounded(training_rows(docs, labels, label, folds, held_out, rows).mapInPandas(described, "doc_id long, y double, x array<double>"), rows).toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, got["y"].to_numpy(dtype=float))


def quality_of(spark, model: AdditiveModel, text: Column) -> Column:
    """The score of a text column. The model's tables are broadcast; their size is fixed."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(features_of(texts)))

    return score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted``."""
    out = added(docs, score=quality_of(docs.sparkSession, model, F.col("text")))
    return added(out, predicted=(F.col("score") >= threshold).cast("int"))


def op5_quality_scores(spark, sf_dir) -> DataFrame:
    from ..session import share_code, table

    share_code(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
