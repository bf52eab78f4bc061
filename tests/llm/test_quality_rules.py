import random

from lexiquarry.llm import quality_rules as R


def brute(t):
    t = t or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_metrics_against_brute_force(docs):
    rng = random.Random(11)
    vocab = ["a", "bb", "é", "x#", "%%", "\n", "\t\n", "ccc"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 5, 30, 200])))) for i in range(80)] + [(80, None), (81, "word " * 20000)]
    got = R.judge(docs(*rows, extra=["n_words", "kept"]), R.RULES, R.REPORTED, R.BASE).collect()
    want = {i: brute(t) for i, t in rows}
    for r in got:
        assert tuple(r[c] for c in R.REPORTED) == want[r.doc_id]
        n = want[r.doc_id]
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_order_does_not_change_verdicts(docs):
    rows = [(1, "clean words in a sentence " * 3 + "and some more to say here today"), (2, "W### X### " * 30), (3, "SHOUTED WORDS " * 5), (4, "line\nline\nline\nline"), (5, "")]
    runs = []
    for rules in (R.RULES, R.RULES[::-1]):
        runs.append({r.doc_id: r.kept for r in R.judge(docs(*rows), rules).collect()})
    assert runs[0] == runs[1] and runs[0][1] and not runs[0][2] and not runs[0][3] and not runs[0][4]


def test_rules_are_ordered_by_rejections_per_cost():
    texts = [b"x### y### z###"] * 50 + [b"plain words here"] * 50
    ordered = R.order_rules(texts, R.RULES)
    assert ordered[0][0].name in ("symbols", "repeated_lines") and ordered[0][1] > 0
    assert [r for r, share, _ in ordered if not share][0] not in [ordered[0][0]]
    assert R.order_rules([], R.RULES)


def test_empty_table(docs):
    assert R.judge(docs().limit(0), R.RULES).count() == 0
