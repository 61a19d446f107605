"""Quality by regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of shape statistics (lengths, shares of kinds of characters, repetition),
transformed towards normality. Each class gets a mean and a covariance shrunk towards the pooled covariance
and a scaled identity; its Cholesky factor is computed once and kept, so a score is two triangular solves: the
difference of Mahalanobis log-densities plus the log prior odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_texts, table

#: Bound of the training sample: so many labelled texts at most, taken by hash.
SAMPLE = 8000
#: Weight of the pooled covariance in each class covariance, and of the scaled identity in the result.
POOLED, SPHERE = 0.3, 0.1
CUT = 0.7

_KINDS = np.zeros(256, np.uint8)
for _lo, _hi, _kind in ((0x30, 0x39, 1), (0x41, 0x5A, 2), (0x61, 0x7A, 3), (0x80, 0xFF, 4)):
    _KINDS[_lo : _hi + 1] = _kind
for _c in b" ":
    _KINDS[_c] = 5
for _c in b"\n\r":
    _KINDS[_c] = 6
for _c in b".,;:'\"-()?":
    _KINDS[_c] = 7
for _c in b"!":
    _KINDS[_c] = 8
for _c in b"|":
    _KINDS[_c] = 9


def statistics(text: str) -> list[float]:
    """Shape statistics of a whole text; all finite, for the empty text too."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=10)
    other, digit, upper, lower, high, _, line, stop, shout, bar = kinds.tolist()
    words = text.split()
    k = len(words)
    sizes = np.fromiter(map(len, words), np.int64, k) if k else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    logit = lambda a, b: float(np.log((a + 0.5) / (max(b - a, 0) + 0.5)))
    again = sum(a == b for a, b in zip(words, words[1:]))
    letters = upper + lower + high
    return [
        float(np.log1p(k)),
        float(sizes.mean()),
        float(np.log1p(sizes.std())),
        float(np.log1p(len(set(words)) / max(k, 1) * 20)),
        float(np.log1p(50 * again / max(k, 1))),
        float(np.log1p(50 * (len(lines) - len(set(lines))) / max(len(lines), 1))),
        float(np.log1p(100 * other / max(n, 1))),
        float(np.log1p(100 * shout / max(n, 1))),
        float(np.log1p(100 * bar / max(n, 1))),
        float(np.log1p(100 * digit / max(n, 1))),
        float(np.log1p(100 * upper / max(letters, 1))),
        float(np.log1p(100 * stop / max(n, 1))),
        float(np.log1p(100 * line / max(n, 1))),
        logit(letters, n) if n else 0.0,
    ]


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a lower triangular system for the columns of ``b``."""
    y = np.empty_like(b)
    for i in range(len(factor)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


@dataclass(frozen=True)
class Model:
    """Per class (0, 1): mean, lower Cholesky factor, log density constant with log prior; and the scaling."""

    centre: np.ndarray
    scale: np.ndarray
    means: list
    factors: list
    constants: list
    flat: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if not self.means:
            return np.full(len(x), self.flat)
        z = (x - self.centre) / self.scale
        d = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            y = forward(factor, (z - mean).T)
            d.append(constant - 0.5 * (y * y).sum(0))
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -500, 500)))


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    """Trains on rows of statistics; with one class only (or none) every score is its share (or one half)."""
    n = [int((label == c).sum()) for c in (0, 1)]
    if min(n) < 2:
        return Model(np.empty(0), np.empty(0), [], [], [], n[1] / sum(n) if sum(n) else 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    own = [np.cov(z[label == c].T, bias=True) for c in (0, 1)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / sum(n)
    means, factors, constants = [], [], []
    for c in (0, 1):
        cov = (1 - POOLED) * own[c] + POOLED * pooled
        cov = (1 - SPHERE) * cov + SPHERE * np.trace(cov) / len(cov) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        means.append(z[label == c].mean(0))
        factors.append(factor)
        constants.append(float(np.log(n[c] / sum(n)) - np.log(np.diag(factor)).sum()))
    return Model(centre, scale, means, factors, constants, 0.5)


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most SAMPLE labelled rows that are not held out, the least by hash.

    Of several labels of a doc_id the least counts, and of several texts one. The driver receives their statistics
    only. Defined cases: with labels of one class, or none, every score is their share, or one half; null doc_ids and
    null labels are left out.
    """
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    drawn = F.broadcast(drawn)
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")
    rows = map_texts(sample, lambda k, texts: {"doc_id": k, "x": [statistics(t) for t in texts]}, "doc_id long, x array<double>")
    # of rows that share a doc_id one counts, so the bound on doc_ids is one on rows
    got = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(drawn, "doc_id").select("quality", "x").collect()
    got.sort(key=lambda r: (r.quality, r.x))
    return fit(np.array([r.x for r in got]), np.array([int(r.quality == 1) for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, however long.

    Defined cases: null and empty texts are scored by their (zero) statistics; equal texts get equal scores; repeated
    rows are scored one by one; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda k, texts: {"doc_id": k, "score": shared.value.score(np.array([statistics(t) for t in texts]))}, "doc_id long, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
