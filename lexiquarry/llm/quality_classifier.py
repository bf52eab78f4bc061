"""Quality classification by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is
compressed with each; the difference of the sizes, normalised by their sum and by the text's length,
says which kind it resembles. That alone cannot see texts that repeat themselves (both sizes are
small), so the normalised size itself is the third signal; without it seven times as many bad texts
pass (see the README). A logistic fit on labelled rows that the dictionaries have not seen turns these
into a probability of label 1 at the labels' own base rate.

Defined results
  null or empty text        scored like any other text (features of the empty text)
  labels of one kind only   every document gets that kind's smoothed base rate
  no labels                 every score is 0.5
  repeated rows             scored row by row; an id on several texts is learned from once (smallest text)
  ties, extra columns       a score of KEEP_AT is kept; extra columns are ignored
  very long texts           scored whole, one at a time
  empty table               no rows
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._labels import SAMPLE_BYTES, draw, learnable, with_text
from lexiquarry.llm._scratch import arrow_map, held_out
from lexiquarry.llm._words import raw

#: Bounds of the training sample: documents of each kind for the dictionaries and for calibration,
#: bytes of the pieces in which the dictionary trainer gets whole texts, and bytes of a dictionary.
DICT_DOCS, FIT_DOCS, DICT_BYTES_EACH, DICT_BYTES = 800, 2000, 6000, 110_000
LEVEL = 3
#: Documents with at least this score are kept.
KEEP_AT = 0.3


@dataclass
class CompressionModel:
    good: bytes | None = None
    bad: bytes | None = None
    weights: np.ndarray | None = None
    constant: float = 0.5

    def compressors(self):
        out = []
        for blob in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(blob)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad = self.compressors()
        x = np.empty((len(texts), 3))
        for i, t in enumerate(texts):
            a, b, n = len(good.compress(t)), len(bad.compress(t)), max(1, len(t))
            x[i] = (a - b) / (a + b), (a - b) / n, min(2.0, a / n)
        return x

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        z = self.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps; weights for the raw features, then the intercept."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    theta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        h = (z * (w * (p * (1 - p) + 1e-6))[:, None]).T @ z + ridge * np.eye(len(theta))
        move = np.linalg.solve(h, z.T @ (w * (p - y)) + ridge * theta)
        theta -= move
        if np.abs(move).max() < 1e-8:
            break
    out = np.append(theta[:-1] / spread, 0.0)
    out[-1] = theta[-1] - float((theta[:-1] * mean / spread).sum())
    return out


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:] or b"\n" * 8


def pieces(texts: list[bytes], size: int) -> list[bytes]:
    """Whole texts cut into pieces of at most ``size`` bytes."""
    return [t[i : i + size] for t in texts for i in range(0, len(t), size)]


def _scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(raw(b.column(1))))], names=["doc_id", "score"])

    return arrow_map(docs, run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, dict_docs: int = DICT_DOCS, fit_docs: int = FIT_DOCS, piece_bytes: int = DICT_BYTES_EACH) -> CompressionModel:
    """Fit on at most ``2 * (dict_docs + fit_docs)`` labelled rows outside the held-out fold, and at most
    ``SAMPLE_BYTES`` of texts of each kind.

    Dictionaries are trained on whole texts in pieces of ``piece_bytes``."""
    rows = learnable(labels, "quality")
    n = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    if not good or not bad:
        return CompressionModel(constant=(good + 1) / (good + bad + 2))
    kind = F.when(F.col("label") == 1, 1).otherwise(0)
    sample = None
    for k in (1, 0):
        # ceil(half): a kind with few labels is shared between dictionary and calibration
        part = draw(rows.withColumn("label", kind), dict_docs + fit_docs, 3, F.col("label") == k)
        sample = part if sample is None else sample.unionByName(part)
    got = with_text(docs, sample, most=SAMPLE_BYTES).withColumn("o", F.xxhash64("doc_id", F.lit(3))).toPandas().sort_values(["o", "doc_id", "text"], kind="stable")
    texts, y = [t.encode() for t in got["text"]], got["label"].to_numpy()
    groups, rest = {}, []
    for k in (1, 0):
        own = np.flatnonzero(y == k)
        cutoff = max(1, min(dict_docs, len(own) * 2 // 5))
        groups[k], rest = pieces([texts[i] for i in own[:cutoff]], piece_bytes), [*rest, *own[cutoff:]]
    model = CompressionModel(dictionary(groups[1]), dictionary(groups[0]))
    if len(rest) < 2 or len(set(y[rest])) < 2:
        return CompressionModel(constant=(good + 1) / (good + bad + 2))
    ys = y[rest].astype(float)
    share = good / (good + bad)
    w = np.where(ys == 1, share / max(1, (ys == 1).sum()), (1 - share) / max(1, (ys == 0).sum())) * len(ys)
    model.weights = logistic(model.features([texts[i] for i in rest]), ys, w)
    return model


def classify(docs: DataFrame, model: CompressionModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every whole text."""
    return _scores(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), model)


def keep_good(docs: DataFrame, model: CompressionModel, text: str = "text", at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is at least ``at``; no join, no shuffle."""
    index = docs.columns.index(text)

    def run(batches):
        for b in batches:
            ok = model.score(raw(b.column(index))) >= at
            yield b.filter(pa.array(ok))

    return arrow_map(docs, run, docs.schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted")
    )
