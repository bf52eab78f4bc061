"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text is trained in numpy from confirmed toxic examples and
unlabelled text with the non-negative estimator of the classification risk

    pi * R(P, +1) + max(0, R(U, -1) - pi * R(P, -1))

where pi is the class prior. A word's features are itself and its byte 5-grams with boundary marks,
hashed; a text's features are the union over its words, so one insult counts the same in a long
text as in a short one. Weights are kept non-negative: words can only add evidence of toxicity.
The step to stop at and the decision threshold minimise the same estimator, with the 0-1 loss, on
rows that the gradients have not seen.

Defined results
  null or empty text       the score of a text without features (below 0.5)
  no toxic example         every score is 0.01
  repeated rows            scored row by row; an id on several texts is learned from once (smallest text)
  ties, extra columns      a score of 0.5 counts as toxic; extra columns are ignored
  very long texts          scored whole; features are a set, so memory follows the distinct words
  empty table              no rows
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._labels import draw, draw_unlabelled, learnable, with_text
from lexiquarry.llm._scratch import arrow_map, held_out
from lexiquarry.llm._words import Memo, raw

#: Bounds of the training sample: confirmed toxic documents and unlabelled documents.
TOXIC_DOCS, UNLABELLED_DOCS = 2500, 7500
BITS = 18
GRAM = 5
_EDGE = b".,;:!?\"'()#*$%&|<>-"


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of one lower-cased word, from 0 to 2**BITS - 1."""
    core = b"<" + word.strip(_EDGE) + b">"
    mask = (1 << BITS) - 1
    grams = {xxhash.xxh3_64_intdigest(core[i : i + GRAM], 1) & mask for i in range(len(core) - GRAM + 1)}
    return tuple(grams | {xxhash.xxh3_64_intdigest(core) & mask})


@dataclass
class ToxicityModel:
    active: dict | None = None  # feature -> weight > 0
    bias: float = 0.0
    constant: float = 0.01

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.active is None:
            return np.full(len(texts), self.constant)
        weights = self.active
        if not hasattr(self, "memo"):
            self.memo = Memo(lambda w: tuple(f for f in word_features(w) if f in weights))
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            found = set()
            for f in map(self.memo.__getitem__, set(t.lower().split())):
                if f:
                    found.update(f)
            z[i] = self.bias + sum(sorted(weights[f] for f in found))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Feature lists of several documents, restricted to the active features."""

    def __init__(self, lists: list[np.ndarray]):
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.n = len(lists)

    def take(self, rows: np.ndarray) -> "_Rows":
        return _Rows([self.flat[self.at[i] : self.at[i + 1]] for i in rows])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        c = np.concatenate(([0.0], np.cumsum(w[self.flat])))
        return c[self.at[1:]] - c[self.at[:-1]] + b

    def spread(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(g, np.diff(self.at)), minlength=size)


def risk(sp: np.ndarray, su: np.ndarray, prior: float) -> float:
    """The non-negative estimate of the logistic risk from scores of toxic and of unlabelled texts."""
    negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
    return float(prior * np.logaddexp(0, -sp).mean() + max(0.0, negative))


def step_gradient(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By score: the gradient of :func:`risk`, or, where the estimate of the negative risk has fallen below
    zero, the step back that raises it (its own gradient, reversed)."""
    if np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean() >= 0:
        return np.full(len(sp), -prior / len(sp)), _sig(su) / len(su)
    return prior * _sig(sp) / len(sp), -_sig(su) / len(su)


def _risk01(sp: np.ndarray, su: np.ndarray, prior: float, at: np.ndarray) -> np.ndarray:
    """Non-negative estimate of the 0-1 risk at each threshold of ``at``."""
    tpr = 1 - np.searchsorted(np.sort(sp), at, side="left") / len(sp)
    upr = 1 - np.searchsorted(np.sort(su), at, side="left") / len(su)
    return prior * (1 - tpr) + np.maximum(0, upr - prior * tpr)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, epochs: int = 16, seed: int = 17) -> ToxicityModel:
    """Train on feature-index arrays of toxic (``pos``) and unlabelled (``unl``) documents."""
    size = 1 << BITS
    cp, cu = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for count, lists in ((cp, pos), (cu, unl)):
        for x in lists:  # a document's features are distinct
            count[x] += 1
    fp, fu = cp / len(pos), cu / max(1, len(unl))
    fn = np.maximum(fu - prior * fp, 0) / (1 - prior)  # share among negatives, corrected by the prior
    ratio = np.log((fp + 0.5 / len(pos)) / (fn + 0.5 / max(1, len(unl))))
    err = np.sqrt((1 - fp) / (cp + 1) + (1 - fn) / (fn * len(unl) + 1))
    for sigmas, support in ((3.5, 4), (2.5, 3), (1.5, 2), (0.5, 1)):
        keep = np.flatnonzero((ratio > sigmas * err) & (cp >= support))
        if len(keep) >= 20:
            break
    if not len(keep):
        return ToxicityModel()
    slot = np.full(size, -1, dtype=np.int64)
    slot[keep] = np.arange(len(keep))
    narrow = lambda lists: [x[x >= 0] for x in (slot[a] for a in lists)]
    rng = np.random.default_rng(seed)
    p_all, u_all = _Rows(narrow(pos)), _Rows(narrow(unl))
    p_order, u_order = rng.permutation(p_all.n), rng.permutation(u_all.n)
    pv, uv = max(1, p_all.n // 5), max(1, u_all.n // 5)
    p_val, u_val = p_all.take(p_order[:pv]), u_all.take(u_order[:uv])
    p_fit, u_fit = p_order[pv:] if p_all.n > 4 else p_order, u_order[uv:] if u_all.n > 4 else u_order
    w, b = np.maximum(ratio[keep], 0) / 4, float(np.log(prior / (1 - prior)))
    m, v, mb, vb, step, lr = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0, 0.03
    best = (np.inf, np.inf, w.copy(), 0.0)
    for _ in range(epochs):
        parts = max(1, len(u_fit) // 500)
        for pb, ub in zip(np.array_split(rng.permutation(p_fit), parts), np.array_split(rng.permutation(u_fit), parts)):
            if not len(pb) or not len(ub):
                continue
            p, u = p_all.take(pb), u_all.take(ub)
            gp, gu = step_gradient(p.scores(w, b), u.scores(w, b), prior)
            g = p.spread(gp, len(w)) + u.spread(gu, len(w)) + 1e-4 * w
            gb = gp.sum() + gu.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w = np.maximum(0, w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            b -= lr * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
        sp, su = p_val.scores(w, 0.0), u_val.scores(w, 0.0)
        cuts = np.unique(np.concatenate((sp, su)))
        at = np.concatenate((cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1))
        risk = _risk01(sp, su, prior, at)
        low = np.flatnonzero(risk <= risk.min() + 1e-12)
        soft = prior * np.logaddexp(0, -(sp - at[low].mean())).mean()
        if (risk.min(), soft) < best[:2]:
            gaps = [(cuts[i] - cuts[i - 1]) if 0 < i < len(cuts) else 0 for i in low]
            best = (risk.min(), soft, w.copy(), float(at[low[int(np.argmax(gaps))]]))
    _, _, w, threshold = best
    return ToxicityModel({int(k): float(x) for k, x in zip(keep, w) if x > 1e-9}, -threshold)


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, unlabelled_docs: int = UNLABELLED_DOCS) -> ToxicityModel:
    """Fit on at most ``toxic_docs`` confirmed toxic and ``unlabelled_docs`` unlabelled documents.

    The unlabelled side is drawn from all documents outside the held-out fold, labelled or not, and no
    label of theirs is read; the prior is the toxic share of the labelled rows. Texts become feature
    lists in the tasks; these, one per drawn id, go to the driver.
    """
    rows = learnable(labels, "toxic")
    n = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return ToxicityModel()
    prior = min(0.9, max(1e-3, n[1] / sum(n.values())))
    sample = draw(rows, toxic_docs, 21, F.col("label") == 1).select("doc_id", F.lit(1).alias("label"))
    sample = sample.unionByName(draw_unlabelled(docs, unlabelled_docs, 22).select("doc_id", F.lit(0).alias("label")))

    def run(batches):
        memo = Memo(word_features)
        for b in batches:
            out = []
            for t in raw(b.column(1)):
                found = set()
                for f in map(memo.__getitem__, set(t.lower().split())):
                    found.update(f)
                out.append(np.sort(np.fromiter(found, np.int32, len(found))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["doc_id", "label", "f"])

    got = arrow_map(with_text(docs, sample).select("doc_id", "text", "label"), run, "doc_id long, label int, f binary").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    lists = lambda k: [np.frombuffer(x, np.int32) for x in got["f"][got["label"] == k]]
    pos, unl = lists(1), lists(0)
    return fit(pos, unl, prior) if pos and unl else ToxicityModel()


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(raw(b.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
