import pytest
from lexiquarry.functions import features as X
from lexiquarry.operators import cascade as K
from lexiquarry.operators import learning as L
from lexiquarry.operators import search as S
from lexiquarry.sources.readers import TOKEN
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(spark, *cases):
    """Cases: (sentence as word/POS, arg1 ids, rel ids, arg2s ids, kind)."""
    tok = T.ArrayType(TOKEN)
    schema = T.StructType([T.StructField(n, tok) for n in ("tokens", "arg1", "rel", "arg2s")] + [T.StructField("kind", T.StringType())])
    out = []
    for text, *parts, kind in cases:
        all_ = [(i, *w.split("/"), None, w.split("/")[0]) for i, w in enumerate(text.split())]
        out.append((all_, *[[all_[i] for i in p] for p in parts], kind))
    return spark.createDataFrame(out, schema)


def test_counts_and_values(spark):
    f = X.definition_features()
    assert len(f) == 41 and len(X.graph_features()) == 42
    df = rows(
        spark,
        ("if/IN Dogs/NNPS or/CC cats/NNS is/VBZ of/IN a/DT kind/NN of/IN animal/NN", [1], [4], [7], "simple"),
        ("it/PRP may/MD runs/VBZ fast/RB in/IN it/PRP", [0], [2, 3, 4], [5], "tupleRelObj"),
        ("x/NN", [0], [], [], "simple"),
    )
    a, b, c = df.select(*[v.alias(k.replace(".", "_")) for k, v in f.items()]).collect()
    on = lambda r: {k for k in f if r[k.replace(".", "_")] == 1.0}
    assert {"if right before arg1", "arg1 contains proper noun", "arg2s consists of blacklisted words", "of right after arg2s", "rel is single verb", "rel contains VBZ", "arg1 contains < 3 tokens"} <= on(a)
    assert {"relational object is a tuple", "arg1 contains a pronoun or EX", "rel matches VW+P", "arg2s borders rel", "arg1 equals arg2s", "rel contiguous"} <= on(b)
    assert "sentence contains < 10 tokens" in on(b) and "sentence contains < 10 tokens" not in on(a)
    assert {"arg2s consists of blacklisted words", "rel contiguous"} <= on(c)


def test_score(spark):
    df = spark.range(1)
    zero = {k: F.lit(0.0) for k in X.definition_features()}
    assert df.select(X.score(zero)).first()[0] == pytest.approx(X.sigmoid(-1.7849105806514818))
    with pytest.raises(ValueError):
        X.score(zero, {"Intercept": 0, "no such feature": 1.0})


def test_cascade():
    got = K.first_with_facts("Gill", "The gill is the organ that can filter water.")
    assert ("DefinedTerm", "", "", "gill", "") in got and ("IsA", "gill", "isa", "organ", "") in got
    got = K.first_with_facts("Brine", "A brine is a famous liquid with a number of sodium grains.")
    assert {("IsA", "brine", "isa", "liquid", ""), ("IsA", "brine", "isa", "famous liquid", ""), ("Quality", "brine", "is", "famous", "")} <= set(got)
    assert any(x[0] == "Property" for x in got)
    got = K.first_with_facts("Slope", "In masonry, slope is the ratio of rise of ground to length.")
    assert ("Context", "slope", "", "masonry", "") in got and ("IsA", "slope", "isa", "ratio of rise of ground", "") in got
    assert K.first_with_facts("harvest", "a golden period of weeks")[0] == ("DefinedTerm", "", "", "harvest", "")  # second form


def test_matcher_backtracks_and_does_not_overlap():
    toks = [K.Token(w, "X", w) for w in "a a b a b".split()]
    ctx = K.run_cascade(toks, (((("AB"), K.Rep(K.W(string="a"), 1) + K.W(string="b")),), (("Twice", K.Ref("AB") + K.Ref("AB")),)))
    assert [(s.kind, s.start, s.end) for s in ctx.spans] == [("AB", 0, 3), ("AB", 3, 5), ("Twice", 0, 5)]


def test_search_and_bootstrap(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "the red fox and the red fox"), (3, "red. fox"), (4, "redfox"), (5, "the red fox and the red fox")], "id int, t string")
    assert [r.id for r in S.search(docs, {"t": "Red fox"}, 10, "id", "t").orderBy("id").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        S.search(docs, {"t": " "}, 1, "id", "t")
    seven = spark.range(7).withColumn("kp", F.lit("p"))
    assert S.capped(seven, ["kp"], [F.col("id")], 5).count() == 5
    r = spark.createDataFrame([("a: x y", "x", "y"), ("x: y", "x", "y"), ("z", "x", "y")], "s string, a string, b string")
    assert [x[0] for x in r.select(S.sentence_holds(F.col("s"), F.col("a"), F.col("b"))).collect()] == ["x y", "x: y", None]
    f = S.phrase_frequency(spark.createDataFrame([("e", "p"), ("e", "p"), ("e", "q"), ("c", "p")], "disrel string, kp string")).collect()
    assert {(x.disrel, x.kp): round(x.share, 3) for x in f} == {("e", "p"): 0.667, ("e", "q"): 0.333, ("c", "p"): 1.0}
    rule = spark.createDataFrame([('rule1:: isa(E1S2-eat, "eats") -> effect(E1S2-eat, E1S5-grow), isa(E1S5-grow, "grows").',)], "rule string")
    assert [(x.rel, x.arg1, x.arg2) for x in S.parse_rule(rule).collect()] == [("effect", "eats", "grows")]


def test_learning(spark):
    rows_ = spark.createDataFrame([(i, float(i % 2), "a" if i % 2 else "b", float(i % 2) * 2 + i % 3 * 0.1) for i in range(60)], "i int, label double, kind string, x double")
    assert L.useful(rows_.withColumn("same", F.lit(1)), ["x", "same"]) == ["x"]
    got = L.cross_validate(L.folds(rows_, F.col("i"), 3), L.trainer(["x"], ["kind"], "J48"), 3)
    m = L.precision_recall(got, "label", "prediction").first()
    assert (m.n, m.accuracy, m.precision, m.recall) == (60, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        L.trainer(["x"], [], "JRip")
    s = spark.createDataFrame([("a b  c", "B x"), ("", "")], "s string, t string").select(L.log_length(F.col("s")), L.log_overlap(F.col("s"), F.col("t"))).collect()
    assert s[0][0] == pytest.approx(1.0986, abs=1e-4) and s[0][1] == pytest.approx(0.6931, abs=1e-4) and tuple(s[1]) == (0.0, 0.0)


def test_stream(spark, tmp_path):
    from lexiquarry.streaming.lines import definition_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("gill\tnoun\t# A 'gill' breathes; a part.\nrun\tverb\tto go\nbad line\n")
    q = definition_stream(spark, str(src), ["NOUN"]).writeStream.format("memory").queryName("defs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.part for r in spark.table("defs").collect()) == ["A gill breathes", "a part."]


def test_facts_scan_no_further_than_asked():
    """The tail of a long sentence is not scanned, and the facts are those of whole scans."""
    import random
    import time

    rng = random.Random(7)
    vocabulary = "a the slope is ratio of rise with that which when where steep run running , : and to water by used for such as causes it grounds".split()
    found = 0
    for _ in range(300):
        tokens = K.surrogate_tokens(" ".join(["slope", rng.choice(("is", ":")), "a", *rng.choices(vocabulary, k=rng.randint(1, 14))]))
        whole = K.run_cascade(tokens, K.LEVELS)
        lazy = K.Lazy(tokens, {k: K.Scan(k, p) for level in K.LEVELS for k, p in level})
        for level in reversed(K.LEVELS):
            for kind, _ in level:
                assert [s for s in whole.spans if s.kind == kind] == lazy.upto(kind, len(tokens)), (kind, tokens)
        top = next((k for k in K.KINDS if any(s.kind == k for s in whole.spans)), None)
        assert (top is None) == (not K.facts(tokens))
        found += top is not None
    assert found > 50
    long = K.surrogate_tokens("Rain is water that falls . " + " ".join(rng.choices(vocabulary, k=60_000)))
    began = time.process_time()
    assert ("IsA", "Rain", "isa", "water", "") in K.facts(long)
    assert time.process_time() - began < 2
