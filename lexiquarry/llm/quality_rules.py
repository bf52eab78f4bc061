"""Quality rules as a short-circuit cascade.

A rule rejects documents by integer arithmetic on a few metrics of the whole text. On a bounded
sample, drawn by hash, the cascade measures what each metric and each rule's own arithmetic cost. The
order is built greedily: next comes the rule that rejects most of the documents that the rules before
it left, per cost; a metric that is computed already (by an earlier rule, or because it is reported)
costs nothing more. Within an Arrow batch, a metric is computed only for documents that no earlier
rule rejected (and only once). The order never changes a verdict: a document is kept if and only if
no rule rejects it.

Defined results
  null or empty text   no words; all metrics 0; rejected by ``few_words``
  repeated rows        judged row by row
  ties                 rules of equal rejections per cost go by name
  very long texts      judged whole, one at a time
  extra columns        are ignored, whatever their names
  empty table          no rows
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm._labels import SAMPLE_BYTES, with_text
from lexiquarry.llm._scratch import arrow_map
from lexiquarry.llm._words import Memo, raw, windows, word_hashes, word_memo

#: Most documents in the sample that orders the rules.
SAMPLE_DOCS = 500
#: Successive words that make a window of ``n_repeat_words``.
WINDOW = 8

_SPACES, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def _without(t: bytes, drop: bytes) -> int:
    return len(t.translate(None, drop))


def _dup_lines(t: bytes) -> int:
    lines = [x for x in t.split(b"\n") if _HAS_WORD.search(x)]
    return len(lines) - len(set(lines))


def _repeat_words(h: np.ndarray) -> int:
    if len(h) <= WINDOW:
        return 0
    w = windows(h, WINDOW)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    again = np.zeros(len(w), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return 0
    step = np.zeros(len(h) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    step[starts] += 1
    np.add.at(step, starts + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


class Metrics:
    """Lazily computed metrics of a batch; ``get(name, rows)`` fills in only what is missing."""

    def __init__(self, texts: list[bytes], memo: Memo):
        self.texts, self.memo = texts, memo
        self.values: dict[str, np.ndarray] = {}
        self.words: dict[int, list[bytes]] = {}

    def _split(self, i: int) -> list[bytes]:
        if i not in self.words:
            self.words[i] = self.texts[i].split()
        return self.words[i]

    def _one(self, name: str, i: int) -> int:
        t = self.texts[i]
        if name == "n_words":
            return len(self._split(i))
        if name == "word_chars":
            return len(t.decode()) - (len(t) - _without(t, _SPACES))
        if name == "n_symbols":
            return len(t) - _without(t, _SYMBOLS)
        if name == "n_dup_lines":
            return _dup_lines(t)
        if name == "n_text_lines":
            return sum(1 for x in t.split(b"\n") if _HAS_WORD.search(x))
        if name == "n_repeat_words":
            return _repeat_words(word_hashes(self._split(i), self.memo))
        if name == "n_upper":
            return len(t) - _without(t, _UPPER)
        if name == "n_lower":
            return len(t) - _without(t, _LOWER)
        raise KeyError(name)

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        v = self.values.setdefault(name, np.full(len(self.texts), -1, dtype=np.int64))
        for i in rows[v[rows] < 0]:
            v[i] = self._one(name, i)
        return v[rows]


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the arrays of ``needs`` and returns a boolean array."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[..., np.ndarray]


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
#: The method's own rules; deliberately far from what clean prose reaches.
RULES = (
    Rule("symbols", ("n_symbols", "word_chars"), lambda s, c: 100 * s > 10 * c),
    Rule("repeated_lines", ("n_dup_lines", "n_text_lines"), lambda d, n: 100 * d > 30 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    Rule("capitals", ("n_upper", "n_lower"), lambda u, w: (u + w >= 20) & (100 * u > 70 * (u + w))),
)


def order_rules(texts: list[bytes], rules: tuple[Rule, ...], paid: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a document) in the order of the cascade.

    Share and cost are those at the rule's place: of the documents left, for the metrics not yet paid.
    """
    rows = np.arange(len(texts))
    m, price, verdict = Metrics(texts, word_memo()), {}, {}
    for name in sorted({n for r in rules for n in r.needs}):
        began = time.perf_counter()
        m.get(name, rows)
        price[name] = (time.perf_counter() - began) / max(1, len(rows))
    for r in rules:
        began = time.perf_counter()
        verdict[r.name] = r.reject(*[m.get(n, rows) for n in r.needs])
        price[r.name, "own"] = (time.perf_counter() - began) / max(1, len(rows))
    out, known, alive, left = [], set(paid), rows, list(rules)
    while left:
        judged = []
        for r in left:
            cost = price[r.name, "own"] + sum(price[n] for n in r.needs if n not in known)
            judged.append((r, float(verdict[r.name][alive].mean()) if len(alive) else 0.0, cost))
        best = min(judged, key=lambda x: (-x[1] / max(x[2], 1e-9), x[0].name))
        out.append(best)
        known |= set(best[0].needs)
        alive = alive[~verdict[best[0].name][alive]]
        left.remove(best[0])
    return out


def sample(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id") -> list[bytes]:
    """At most ``sample_docs`` texts of at most SAMPLE_BYTES bytes together, by hashed id.

    The ids are drawn first (a scan of one column and a top-k). Ids that several rows share, or that are
    null, count once.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id")).where(F.col("doc_id").isNotNull())
    rate = int(min(1.0, 3.0 * sample_docs / max(1, ids.count())) * (1 << 30))
    drawn = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) < rate).distinct()
    drawn = drawn.orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(sample_docs).withColumn("label", F.lit(0))
    return [r.text.encode() for r in with_text(docs, drawn, text, doc_id, SAMPLE_BYTES).orderBy("doc_id").collect()]


def plan(texts: list[bytes], rules: tuple[Rule, ...], paid: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """``rules`` in the order that :func:`order_rules` finds on the sample."""
    return tuple(r for r, _, _ in order_rules(texts, rules, paid))


def cascade(m: Metrics, rules: tuple[Rule, ...], alive: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """Indices that survive, and for every document the rule that rejected it first."""
    failed: list[str | None] = [None] * len(m.texts)
    for rule in rules:
        if not len(alive):
            break
        bad = rule.reject(*[m.get(n, alive) for n in rule.needs])
        for i in alive[bad]:
            failed[i] = rule.name
        alive = alive[~bad]
    return alive, failed


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...],
    columns: tuple[str, ...] = (),
    first: tuple[Rule, ...] = (),
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, *columns, base_failed, kept, failed_rule) of every whole text.

    ``columns`` are metrics to report for all documents. ``first`` rules come before the cascade
    and set ``base_failed``.
    """
    schema = "doc_id long, " + "".join(f"{c} long, " for c in columns) + "base_failed boolean, kept boolean, failed_rule string"

    def run(batches):
        memo = word_memo()
        for b in batches:
            m = Metrics(raw(b.column(1)), memo)
            rows = np.arange(b.num_rows)
            shown = [pa.array(m.get(c, rows), pa.int64()) for c in columns]
            base, why_base = cascade(m, first, rows)
            kept, why = cascade(m, rules, base)
            base_failed, ok = np.ones(b.num_rows, bool), np.zeros(b.num_rows, bool)
            base_failed[base], ok[kept] = False, True
            named = pa.array([x or y for x, y in zip(why_base, why)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *shown, pa.array(base_failed), pa.array(ok), named], names=["doc_id", *columns, "base_failed", "kept", "failed_rule"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, run, schema)


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = sample(docs)
    return judge(docs, plan(texts, RULES, REPORTED), REPORTED, plan(texts, BASE, REPORTED)).drop("failed_rule")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS BIGINT) AS n_lower,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_upper + n_lower >= 20 AND 100 * n_upper > 70 * (n_upper + n_lower))) AS kept
FROM b
"""
