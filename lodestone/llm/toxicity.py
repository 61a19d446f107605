"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all else is unlabelled, toxic texts among it. With the class prior p
the risk is p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)): the second part estimates the risk on negatives
and is kept from turning negative by stepping back along its gradient whenever it does.

A text is the set of its word forms: each lower-cased word without outer punctuation, and its prefixes of four
and five letters, hashed to a fixed space. The model is linear over the features that separate positives from
unlabelled texts most, chosen on the training sample, so a very long text is as cheap per byte as a short one.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_texts, ship, table

#: Bounds of the training sample: so many confirmed toxic and so many unlabelled texts at most, taken by hash.
POSITIVES = 3000
UNLABELLED = 9000
#: Features kept, and the hashed space they come from.
FEATURES = 1500
SPACE_BITS = 22
#: Documents in which a feature must be seen among the positives.
SUPPORT = 4
STEPS, RATE, BETA, CEILING = 400, 0.05, 0.05, 3.0
#: Weight decay times the number of positives: few of them allow small weights only.
DECAY = 0.02
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """Linear scores: hashes of the features in rising order, a weight for each, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            g = self.bias + float(self.weights[at[self.hashes[at] == found]].sum())
        else:
            g = self.bias
        return float(1 / (1 + np.exp(-np.clip(g, -500, 500))))


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a text, in rising order."""
    crc, mask = zlib.crc32, (1 << SPACE_BITS) - 1
    words = set(WORD.findall(text.lower()))
    heads = {w[:4] for w in words if len(w) > 4} | {w[:5] for w in words if len(w) > 5}
    made = [crc(w.encode("utf-8", "surrogatepass")) & mask for w in words]
    made += [crc(w.encode("utf-8", "surrogatepass"), 1) & mask for w in heads]
    return np.unique(np.array(made, np.int64))


def _design(sets: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(hashes)), np.float32)
    if len(hashes):
        for row, s in zip(x, sets):
            at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
            row[at[hashes[at] == s]] = 1
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Trains on feature sets. Without positives, or without unlabelled texts, every score is the prior."""
    prior = min(max(prior, 1e-4), 0.9999)
    if not positive or not unlabelled:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    (ph, pc), (uh, uc) = (np.unique(np.concatenate(s), return_counts=True) for s in (positive, unlabelled))
    at = np.minimum(np.searchsorted(uh, ph), max(len(uh) - 1, 0))
    in_u = np.where(uh[at] == ph, uc[at], 0) if len(uh) else np.zeros(len(ph))
    rate_p, rate_u = (pc + 0.5) / (len(positive) + 1), (in_u + 0.5) / (len(unlabelled) + 1)
    sure = np.log(rate_p / rate_u) > 2 * np.sqrt(1 / pc + 1 / (in_u + 0.5))
    gain = np.where(sure & (pc >= min(SUPPORT, len(positive))), np.log(rate_p / rate_u) * rate_p, -1)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    hashes = np.sort(ph[best[gain[best] > 0]])
    xp, xu = _design(positive, hashes), _design(unlabelled, hashes)
    decay = np.float32(DECAY / len(positive))
    w, b = np.zeros(len(hashes), np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -500, 500)))
    for step in range(1, STEPS + 1):
        gp, gu = (xp @ w).astype(float) + b, (xu @ w).astype(float) + b
        sp, su = sig(gp), sig(gu)
        # logistic loss; as a negative, a text costs no more than at CEILING, so what the prior takes back is bounded
        cost = np.log1p(np.exp(np.minimum(gu, CEILING))).mean() - prior * np.log1p(np.exp(np.minimum(gp, CEILING))).mean()
        pull = prior * (sp - 1) / len(sp)
        push_u, push_p = su * (gu < CEILING) / len(su), -prior * sp * (gp < CEILING) / len(sp)
        if cost < -BETA * prior:
            push_u, push_p, pull = -push_u, -push_p, np.zeros_like(pull)
        both = pull + push_p
        grad = np.append(both.astype(np.float32) @ xp + push_u.astype(np.float32) @ xu + decay * w, both.sum() + push_u.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(hashes, w.astype(float), float(b))


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the doc_id as text, mod 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` doc_ids, the least by hash: the same ones however the table is cut."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on a bounded sample of the rows that are not held out.

    The prior is the toxic share of the labelled training rows; a doc_id with several labels is toxic if any
    says so. The driver receives hashed feature sets of at most POSITIVES + UNLABELLED texts, one for each doc_id,
    whatever repeats. Defined cases: without positives every score is the prior; labels of unknown doc_ids count in
    the prior only; null doc_ids and null labels are left out; empty tables give a model with a prior near 0.
    """
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    positive = _drawn(marked.filter("toxic = 1").select("doc_id"), POSITIVES).select("doc_id", F.lit(1).alias("side"))
    pool = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unlabelled = _drawn(pool, UNLABELLED).select("doc_id", F.lit(2).alias("side"))
    # a confirmed text that is drawn among the unlabelled ones too counts on both sides (3): those are a sample of
    # all texts, or the prior would not hold; bounded by the limits above, so safe to broadcast
    drawn = F.broadcast(positive.union(unlabelled).groupBy("doc_id").agg(F.sum("side").cast("int").alias("side")))
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")
    packed = lambda t: features(t).astype("<i4").tobytes()  # noqa: E731  as bytes, a feature takes four on the driver
    sets = map_texts(sample, lambda k, texts: {"doc_id": k, "f": [packed(t) for t in texts]}, "doc_id long, f binary")
    # of rows that share a doc_id one counts, so the bound on doc_ids is one on rows
    sets = sets.groupBy("doc_id").agg(F.min("f").alias("f")).join(drawn, "doc_id").select("side", "f").toArrow()
    sides, raws = sets.column("side").to_pylist(), sets.column("f").to_pylist()
    of = lambda side: [np.frombuffer(f, "<i4") for f in sorted(f for s, f in zip(sides, raws) if s & side)]
    return fit(of(1), of(2), (toxic or 0) / n if n else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, however long.

    Defined cases: null and empty texts get the score of no features; equal texts get equal scores; repeated rows are
    scored one by one; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda k, texts: {"doc_id": k, "score": [shared.value.score(features(t)) for t in texts]}, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is under the threshold.

    The rows pass through Python whole, so no join is needed to tell which they are.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def over(batches):
        for batch in batches:
            clean = [shared.value.score(features(t or "")) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(over, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
