import hashlib
import math
import random
from collections import Counter

import corpus_pipeline as P
import pytest
from lexiquarry.llm import line_dedup, near_dedup, quality_classifier
from test_near_dedup import brute as brute_near, flagged
from lexiquarry.llm._scratch import materialize

SF = "/root/testdata/sf0.001"


def test_stages_have_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["quality"]
    model = quality_classifier.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality_classifier.classify(before, model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = seen["lines"]
    assert after.count() == before.count()
    assert line_dedup.dropped(after).count() <= line_dedup.dropped(before).count()
    before, after = seen["near"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert {r.doc_id for r in after.collect()} == {low for _, _, low in brute_near(rows)}
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def test_edge_rows(spark, docs):
    rows = docs((1, "a b c d e f g"), (1, "a b c d e f g"), (None, None), (2, ""), (3, "a b c d e f g"), extra=["th", "taken"])
    assert sorted(str(r.doc_id) for r in P.near(spark, rows, SF).collect()) == ["1", "2", "None"]
    assert P.lines(spark, rows, SF).count() == 5
    assert P.mix(spark, rows, SF).columns == rows.columns
    assert P.near(spark, rows.limit(0), SF).count() == 0


def test_near_counts_common_shingles_over_all_texts(spark, docs, monkeypatch):
    tables, plain = [], near_dedup.classes
    monkeypatch.setattr(near_dedup, "classes", lambda docs, slices, common, *a: tables.append(common) or plain(docs, slices, common, *a))
    monkeypatch.setattr(near_dedup, "SAMPLE_SHINGLES", 100, raising=False)  # no sample stands for the rest
    words = [f"v{k}" for k in range(900)]
    rows = [(k, " ".join(words[30 * k : 30 * k + 60])) for k in range(28)] + [(50, " ".join(words[:59]))]  # each shares half with the next
    assert sorted(r.doc_id for r in P.near(spark, docs(*rows), SF).collect()) == sorted({low for _, _, low in brute_near(rows)})
    memo, counts = near_dedup.word_memo(), Counter()
    for _, t in rows:
        counts.update((near_dedup.shingle_set(t.encode(), memo) >> near_dedup.U(64 - near_dedup.TABLE_BITS)).tolist())
    assert set(flagged(tables[0]).tolist()) == {at for at, n in counts.items() if n > 1}


def brute_mix(rows):
    """(doc_id, words) of every use in the order of training, from rows (doc_id, text, lang, source)."""
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    slope = {s: (0.5, -0.5, 0.0)[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = {s: float(2 * total[s]) if s in full else level * weight[s] for s in names}
    out = []
    for s in names:
        left, use, before = math.floor(target[s] + 0.5), 0, 0
        order = sorted((i for i in size if source[i] == s and size[i]), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        while left > 0 and order:
            for i in order:
                if left <= 0:
                    break
                n = min(size[i], left)
                c, k, a = before / target[s], 1 + slope[s], slope[s]
                out.append((c if a == 0 else (k - math.sqrt(k * k - 4 * a * c)) / (2 * a), i, n))
                left, before = left - n, before + n
            use += 1
    return [(i, n) for _, i, n in sorted(out)]


@pytest.mark.parametrize("seed", range(2))
def test_mix_is_the_curriculum(spark, docs, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n ", "  "]).join(f"w{k}" for k in range(rng.choice([0, 1, 3, 20, 60]))), "en", rng.choice(["a", "a", "a", "b", "Z", None])) for i in range(60)]
    got = P.mix(spark, docs(*rows, extra=["position", "use", "words", "th"]), SF).collect()
    want = brute_mix(rows)
    assert [(r.doc_id, len(r.text.split())) for r in got] == want
    text = {i: t for i, t, *_ in rows}
    for r in got:
        assert text[r.doc_id].startswith(r.text) and (r.text == text[r.doc_id] or len(r.text.split()) < len(text[r.doc_id].split()))
    assert sum(r.text != text[r.doc_id] for r in got) <= 4


def test_mix_of_repeated_and_null_rows(spark, docs):
    rows = docs((1, "a b", "en", "s"), (1, "a b", "fr", "s"), (1, "a b", "en", "t"), (None, "c d e", "en", None), (2, None, "en", "s"), (3, "", "en", "s"))
    got = Counter((r.doc_id, r.text, r.source) for r in P.mix(spark, rows, SF).collect())
    words = sum(len(t.split()) * n for (_, t, _), n in got.items())
    assert words == round(1.5 * 9) or abs(words - 13.5) <= 2
    assert all(t for _, t, _ in got)


def test_stages_on_null_empty_and_clashing(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "label", "th", "h", "pos", "taken", "size", "piece", "c", "n", "hit"]
    full = docs((1, None), (None, ""), (2, "x " * 100), (2, "x " * 100), (None, None), (3, "long " * 200_000), extra=names)
    for rows in (full, full.limit(0)):
        out = rows
        for name, stage in P.STAGES:
            out = materialize(stage(spark, out, str(tmp_path)), f"edge-{name}")
            if name != "pack":
                assert out.schema.simpleString() == rows.schema.simpleString(), name
            if name in ("quality", "lines"):
                assert out.count() == rows.count()
    got = P.pack(spark, full, str(tmp_path))
    assert got.where("piece = 0").count() == 6
