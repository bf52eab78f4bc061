"""Language identification with a byte convolutional network written in numpy.

The network reads fixed windows of raw UTF-8 bytes: one-hot bytes, convolutions of several widths,
max pooling over the window, ReLU, a dense layer and softmax. It is trained on a bounded sample of
documents with a known language and applied to *every* window of every whole text; a document's
class is the mean of its windows' log-probabilities.

Defined results
  null text, or no letter in it     ``und`` with score 0
  null ``lang``                     not a training row
  no training row at all            ``und`` with score 0 for every document
  one single language               that language with score 1
  repeated rows, extra columns      scored row by row; extra columns are ignored by the query
  ties                              the language that comes first by code point
  very long texts                   all windows count, at most a group of them in memory
  empty table                       no rows
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm._scratch import arrow_map, held_out, join_checked
from lexiquarry.llm._words import raw

#: Bytes in a window, convolution widths and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Bounds of the training sample: documents of a language, of all languages together (but LEAST_DOCS of
#: each), and windows of a document. Every language that occurs is learned.
SAMPLE_DOCS, TOTAL_DOCS, LEAST_DOCS, SAMPLE_WINDOWS = 1500, 8000, 20, 4

_LETTER = regex.compile(r"\p{L}")


def cut(text: bytes) -> np.ndarray:
    """All windows of ``text``; the last one is filled up with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class ByteConvNet:
    """Multi-width byte convolution, max pooling and softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0] = 0
        self.dense = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)
        self.tables = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, lr: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.dense, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                grads = self.gradients(x[rows], y[rows])
                step += 1
                rate = lr * (1 - epoch / epochs)
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate / (1 - 0.9**step)) * a / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)

    def gradients(self, xb: np.ndarray, yb: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy of a batch by all parameters (none by the padding byte)."""
        pooled, where = [], []
        for w, c in zip(WIDTHS, self.conv):
            n = WINDOW - w + 1
            a = c[0][xb[:, :n]]
            for o in range(1, w):
                a = a + c[o][xb[:, o : o + n]]
            p = a.argmax(axis=1)
            where.append(p)
            pooled.append(np.take_along_axis(a, p[:, None, :], axis=1)[:, 0])
        z = np.concatenate(pooled, axis=1)
        r = np.maximum(z, 0)
        s = r @ self.dense + self.bias
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[np.arange(len(yb)), yb] -= 1
        s /= len(yb)
        grads = [np.zeros_like(p) for p in (*self.conv, self.dense, self.bias)]
        grads[-2][:] = r.T @ s
        grads[-1][:] = s.sum(axis=0)
        back = (s @ self.dense.T) * (z > 0)
        for k, (w, p) in enumerate(zip(WIDTHS, where)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            col = np.broadcast_to(np.arange(FILTERS), p.shape)
            for o in range(w):
                np.add.at(grads[k][o], (np.take_along_axis(xb, p + o, axis=1), col), g)
            grads[k][:, 0] = 0
        return grads

    def prepare(self) -> None:
        """Fold successive bytes into pair tables: one gather serves two bytes."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.tables = [[pair(c[i], c[i + 1]) if i + 1 < w else c[i] for i in range(0, w, 2)] for w, c in zip(WIDTHS, self.conv)]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.prepare()
        pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled = []
        for w, tables in zip(WIDTHS, self.tables):
            n = WINDOW - w + 1
            a = np.take(tables[0], pairs[:, :n], axis=0)
            for i, t in enumerate(tables[1:], start=1):
                a += np.take(t, (pairs if len(t) == 65536 else x)[:, 2 * i : 2 * i + n], axis=0)
            while a.shape[1] > 1:  # halving keeps the maximum on long contiguous rows
                h = a.shape[1] // 2
                top = np.maximum(a[:, :h], a[:, h : 2 * h])
                a = np.concatenate((top, a[:, 2 * h :]), axis=1) if a.shape[1] % 2 else top
            pooled.append(a[:, 0])
        s = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Class index and score per text; at most ``group`` windows are in memory at once."""
        total = np.zeros((len(texts), len(self.langs)))
        parts, owners, held = [], [], 0

        def flush():
            nonlocal parts, owners, held
            if held:
                np.add.at(total, np.concatenate(owners), self.log_probs(np.concatenate(parts)))
            parts, owners, held = [], [], 0

        for i, t in enumerate(texts):
            w = cut(t)
            if 0 < len(t) % WINDOW < 16 and len(w) > 1:  # a short rest is read with the bytes before it
                w[-1] = np.frombuffer(t[-WINDOW:], dtype=np.uint8)
            for at in range(0, len(w), group):
                piece = w[at : at + group]
                parts.append(piece)
                owners.append(np.full(len(piece), i))
                held += len(piece)
                if held >= group:
                    flush()
        flush()
        counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        p = np.exp(total / counts[:, None])
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> ByteConvNet | None:
    """Fit on at most ``sample_docs`` documents of each language (see the bounds above).

    Held-out rows are never read for training. The sample is picked by a hash of id and text, so reruns
    agree, rows without an id are drawn like others, and repeated rows are drawn once.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.length("t") > 0) & ~held_out(F.col("i")))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted(r.l for r in sizes.collect())
    if not langs:
        return None
    each = min(sample_docs, max(LEAST_DOCS, TOTAL_DOCS // len(langs)))
    # A hash threshold per language leaves about 1.1 * each rows; the first of them by hash are taken.
    share = sizes.select(F.col("l").alias("_l"), F.least(F.lit(1.0), F.lit(1.1 * each) / F.col("n")).alias("share"))
    drawn = join_checked(rows.withColumn("h", F.xxhash64("i", "t")), share, F.col("l") == F.col("_l"))
    drawn = drawn.where(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    # Window starts are spread over the whole text by hash; a window is cut out in the JVM.
    start = lambda k: F.pmod(F.xxhash64("h", F.lit(100 + k)), F.greatest(F.lit(1), F.length("t") - F.lit(WINDOW))).cast("int")
    pieces = drawn.select("l", "h", F.array(*[F.substring(F.col("t"), start(k) + 1, F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)]).alias("w"))
    pieces = pieces.groupBy("l", "h").agg(F.min("w").alias("w"))
    first = Window.partitionBy("l").orderBy("h")  # over about 1.1 * each rows of a language
    got = pieces.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).toPandas().sort_values(["l", "h"], kind="stable")
    number = {k: i for i, k in enumerate(langs)}
    x, y = [], []
    for name, ws in zip(got["l"], got["w"]):
        for w in dict.fromkeys(ws):
            x.append(cut(w.encode()[:WINDOW])[0])
            y.append(number[name])
    net = ByteConvNet(langs)
    if len(langs) > 1 and x:
        net.fit(np.array(x), np.array(y))
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, over whole texts."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            lettered = [bool(x and _LETTER.search(x)) for x in col.to_pylist()] if net else [False] * len(col)
            names, scores = np.full(len(col), "und", dtype=object), np.zeros(len(col))
            rows = np.flatnonzero(lettered)
            if len(rows):
                texts = raw(col)
                best, p = net.predict([texts[i] for i in rows])
                names[rows], scores[rows] = np.array(net.langs, dtype=object)[best], p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(names), pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
