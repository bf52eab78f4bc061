import random

import numpy as np
from lexiquarry.llm import language_id, quality_classifier, toxicity

WORDS = {"xx": ["bala", "tolu", "miri", "sano", "kuti"], "yy": ["grond", "stelk", "vrumt", "schak", "plenz"]}


def make(spark, docs, n=400, seed=10):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "a", "en", "os"]) for _ in range(rng.randint(20, 80))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zornik", "zornak", "zornul"])
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(not bad), int(toxic)))
    return docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, at):
    rows = scored.join(labels, "doc_id").collect()
    return np.mean([(r.score >= at) == bool(r[column]) for r in rows])


def test_quality(spark, docs):
    df, labels = make(spark, docs)
    model = quality_classifier.train(df, labels, 60, 150)
    assert accuracy(quality_classifier.classify(df, model), labels, "quality", 0.3) > 0.95
    kept = quality_classifier.keep_good(df, model)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_toxicity(spark, docs):
    df, labels = make(spark, docs)
    model = toxicity.train(df, labels)
    assert accuracy(toxicity.score(df, model), labels, "toxic", 0.5) > 0.95
    assert all(w >= 0 for w in model.active.values())


def test_language(spark, docs):
    df, _ = make(spark, docs)
    net = language_id.train(df)
    got = language_id.identify(df, net).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    odd = language_id.identify(docs((1, None), (2, ""), (3, "12 34 !!"), (4, "bala " * 30000)), net).collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "xx"] and all(0 <= r.score <= 1 for r in odd)


def test_no_labels_one_kind_and_empty(spark, docs):
    df, labels = make(spark, docs, 30)
    none = labels.limit(0)
    assert {r.score for r in quality_classifier.classify(df, quality_classifier.train(df, none)).collect()} == {0.5}
    assert all(r.score < 0.5 for r in toxicity.score(df, toxicity.train(df, none)).collect())
    assert quality_classifier.train(df, labels.where("quality = 1")).constant > 0.5
    assert language_id.train(df.where("lang = 'zz'")) is None
    one = language_id.identify(df, language_id.train(df.where("lang = 'xx'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}
    nulls = docs((None, None), (1, ""), (1, "x"))
    model = quality_classifier.train(df, labels)
    assert quality_classifier.classify(nulls, model).count() == 3
    assert toxicity.score(docs().limit(0), toxicity.ToxicityModel()).count() == 0


def test_held_out_rows_are_not_learned_from(spark, docs):
    """A model trained with or without the held-out rows is the same."""
    import zlib

    df, labels = make(spark, docs)
    train_only = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    fewer = labels.where(labels.doc_id.isin(train_only))
    a, b = quality_classifier.train(df, labels), quality_classifier.train(df, fewer)
    assert a.good == b.good and np.allclose(a.weights, b.weights)
    assert toxicity.train(df, labels).active == toxicity.train(df, fewer).active
    x, y = language_id.train(df), language_id.train(df.where(df.doc_id.isin(train_only)))
    assert np.array_equal(x.dense, y.dense)
