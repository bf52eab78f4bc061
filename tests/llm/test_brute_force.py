"""Learned operators against plain loops, and edge inputs that several operators share."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from lexiquarry.llm import exact_dedup, language_id, line_dedup, mixing, quality_classifier, quality_rules, toxicity
from lexiquarry.llm._labels import draw_unlabelled, with_text
from lexiquarry.llm._scratch import few


# -- op2 ---------------------------------------------------------------------------------------------


def plain_risk(sp, su, prior):
    positive = sum(math.log1p(math.exp(-s)) for s in sp) / len(sp)
    wrong = sum(math.log1p(math.exp(s)) for s in sp) / len(sp)
    negative = sum(math.log1p(math.exp(s)) for s in su) / len(su) - prior * wrong
    return prior * positive + max(0.0, negative), negative


@pytest.mark.parametrize("shift", [-6.0, 0.0, 2.0])
def test_risk_and_its_gradient(shift):
    rng = random.Random(1)
    sp, su, prior = [rng.gauss(1, 2) for _ in range(7)], [rng.gauss(shift, 2) for _ in range(11)], 0.3
    want, negative = plain_risk(sp, su, prior)
    assert toxicity.risk(np.array(sp), np.array(su), prior) == pytest.approx(want)
    gp, gu = toxicity.step_gradient(np.array(sp), np.array(su), prior)
    # below zero the step climbs the negative risk alone
    target = (lambda a, b: plain_risk(a, b, prior)[0]) if negative >= 0 else (lambda a, b: -plain_risk(a, b, prior)[1])
    e = 1e-6
    for grads, which in ((gp, 0), (gu, 1)):
        for i in range(len(grads)):
            up, down = [list(sp), list(su)], [list(sp), list(su)]
            up[which][i] += e
            down[which][i] -= e
            assert grads[i] == pytest.approx((target(*up) - target(*down)) / (2 * e), abs=1e-6)


def test_scores_are_sums_over_distinct_features():
    model = toxicity.ToxicityModel({f: 0.5 for f in toxicity.word_features(b"zornik")}, -1.0)
    n = len(toxicity.word_features(b"zornik"))
    want = 1 / (1 + math.exp(-(0.5 * n - 1)))
    got = model.score([b"a Zornik b", b"zornik " * 500, b"ZORNIK, (zornik)!", b""])
    assert got[:3] == pytest.approx([want] * 3) and got[3] < 0.5


# -- op3 ---------------------------------------------------------------------------------------------


def test_quality_scores_against_direct_compression():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["plain", "words", "here", "###", "x9"], k=rng.choice([0, 3, 50, 4000]))).encode() for _ in range(12)]
    model = quality_classifier.CompressionModel(b"plain words here " * 30, b"### x9 " * 60, np.array([3.0, -2.0, 1.0, 0.25]))
    for t, got in zip(texts, model.score(texts)):
        sizes = []
        for blob in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(blob)
            c = zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(c.compress(t)))
        a, b, n = *sizes, max(1, len(t))
        z = 3.0 * (a - b) / (a + b) - 2.0 * (a - b) / n + min(2.0, a / n) + 0.25
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


# -- op5 ---------------------------------------------------------------------------------------------


def plain_log_probs(net, window):
    pooled = []
    for w, c in zip(language_id.WIDTHS, net.conv):
        for f in range(language_id.FILTERS):
            best = max(sum(float(c[o][window[i + o]][f]) for o in range(w)) for i in range(language_id.WINDOW - w + 1))
            pooled.append(max(0.0, best))
    s = [sum(p * float(net.dense[k][j]) for k, p in enumerate(pooled)) + float(net.bias[j]) for j in range(len(net.langs))]
    top = max(s)
    return [x - top - math.log(sum(math.exp(y - top) for y in s)) for x in s]


def test_forward_pass_against_a_loop_over_windows():
    net = language_id.ByteConvNet(["a", "b", "c"])
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc dé\n", k=n)).encode() for n in (1, 40, 256, 257, 600)]
    for t, best, p in zip(texts, *net.predict(texts)):
        windows = language_id.cut(t)
        if 0 < len(t) % language_id.WINDOW < 16 and len(windows) > 1:
            windows[-1] = np.frombuffer(t[-language_id.WINDOW :], np.uint8)
        mean = np.mean([plain_log_probs(net, w) for w in windows], axis=0)
        share = np.exp(mean) / np.exp(mean).sum()
        assert best == share.argmax() and p == pytest.approx(share.max(), rel=1e-3)


def test_gradients_against_differences():
    net = language_id.ByteConvNet(["a", "b", "c"])
    rng = np.random.default_rng(4)
    for k, c in enumerate(net.conv):
        net.conv[k] = c.astype(np.float64)
    net.dense, net.bias = net.dense.astype(np.float64), net.bias.astype(np.float64)
    x, y = rng.integers(1, 40, (3, language_id.WINDOW)).astype(np.uint8), np.array([0, 2, 1])

    def loss():
        return -np.mean([plain_log_probs(net, w)[k] for w, k in zip(x, y)])

    grads = net.gradients(x, y)
    for p, g in zip((*net.conv, net.dense, net.bias), grads):
        flat, by = p.reshape(-1), g.reshape(-1)
        for i in rng.choice(np.flatnonzero(by) if by.any() else np.arange(len(by)), size=2):
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert by[i] == pytest.approx((up - down) / (2 * e), abs=1e-4)


def test_every_one_of_many_languages_is_learned(docs, monkeypatch):
    monkeypatch.setattr(language_id.ByteConvNet, "fit", lambda self, x, y: setattr(self, "seen", set(y.tolist())))
    rows = [(i, f"word{i % 201} text", f"l{i % 201:03}") for i in range(201 * 4)]
    net = language_id.train(docs(*rows))
    assert len(net.langs) == 201 and net.seen == set(range(201))


# -- samples -----------------------------------------------------------------------------------------


def test_samples_do_not_grow_with_repeated_ids(spark, docs):
    many = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "concat('text ', cast(id as string)) as text")
    one = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int")
    assert [(r.doc_id, r.text) for r in with_text(many, one).collect()] == [(7, "text 0")]
    texts = spark.range(50).selectExpr("id as doc_id", "repeat('x', 100) as text")
    drawn = texts.selectExpr("doc_id", "1 as label")
    assert with_text(texts, drawn, most=1000).count() == 10
    got = {r.doc_id for r in draw_unlabelled(texts, 20, 1).collect()}
    assert len(got) == 20 and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in got)
    hot = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'same text' as text", "'xx' as lang")
    net = language_id.train(hot)
    assert net.langs == ["xx"]


def test_broadcasts_are_measured_in_bytes(spark):
    wide = spark.range(10).selectExpr("repeat('x', 1000) as t")
    assert few(wide) and not few(wide, most=5000) and not few(wide, limit=9)


# -- op1 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1 << 12, 1 << 29])
def test_exact_dedup_against_brute_force(docs, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "TABLE_BITS", bits)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "b ", "\tc"], k=rng.choice([0, 1, 2, 9])))) for i in range(6000)]
    rows += [(6000, "long " * 200_000), (6001, "long  " * 200_000), (None, "a"), (6002, None)]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for t, ids in groups.items():
        low = min(i for i in ids if i is not None)
        want += [(i, low, len(ids), i == low, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_dedup(docs(*rows, extra=["sha", "word", "hit", "row"])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# -- inputs that clash, are empty, or are very long --------------------------------------------------


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns_empty_tables_and_long_texts(spark, docs, empty):
    rows = docs((1, "plain words " * 300_000), (1, "plain words"), (2, None), (None, ""), (3, "one\n" * 50_000), extra=["label", "score", "t", "l", "i", "h", "w", "f", "n"])
    rows = rows.limit(0) if empty else rows
    n = 0 if empty else 5
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(rows, quality_classifier.train(rows, labels)).count() == n
    assert toxicity.score(rows, toxicity.train(rows, labels)).count() == n
    assert language_id.identify(rows, language_id.train(rows)).count() == n
    assert quality_rules.judge(rows, quality_rules.plan(quality_rules.sample(rows), quality_rules.RULES)).count() == n
    assert mixing.mix(rows).count() == n
    assert line_dedup.apply(rows).count() == n


def test_ties_between_rules_go_by_name():
    never = lambda *_: np.zeros(4, bool)
    rules = tuple(quality_rules.Rule(k, ("n_words",), never) for k in "cab")
    assert [r.name for r, _, _ in quality_rules.order_rules([b"x"] * 4, rules, ("n_words",))] == ["a", "b", "c"]


def test_order_follows_what_earlier_rules_left_and_what_is_paid():
    texts = [b"### ### ###"] * 60 + [b"a a"] * 20 + [b"plain words in here"] * 20
    slow = quality_rules.Rule("slow", ("n_repeat_words", "n_symbols"), lambda r, s: s > 0)
    same = quality_rules.Rule("same", ("n_symbols",), lambda s: s > 0)
    short = quality_rules.Rule("short", ("n_words",), lambda n: n == 2)
    order = quality_rules.order_rules(texts, (slow, same, short))
    names = [r.name for r, _, _ in order]
    assert names.index("same") < names.index("slow") and [share for r, share, _ in order if r is slow] == [0.0]
    paid = quality_rules.order_rules(texts, (slow, same, short), ("n_words", "n_symbols", "n_repeat_words"))
    assert sum(c for _, _, c in paid) <= sum(c for _, _, c in order) + 1e-3
