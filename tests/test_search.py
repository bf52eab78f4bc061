"""Phrase search, sentence search and question rules on small inputs."""

import pytest
from lexiquarry.operators import graph as G
from lexiquarry.operators import rules as R
from lexiquarry.operators import search as S
from lexiquarry.plans.patterns import GraphTables
from pyspark.sql import functions as F


@pytest.fixture
def foxes(spark):
    rows = [(1, "The red fox, the red fox."), (2, "Red! Fox?"), (3, "a redfox"), (4, "fox red"), (5, None), (6, "the the the")]
    return spark.createDataFrame(rows, "id int, text string")


@pytest.mark.parametrize("phrase", ["red fox", '"red fox"', "Red, fox", " (RED) fox! "])
def test_quotes_and_punctuation_of_a_phrase_do_not_matter(foxes, phrase):
    assert [r.id for r in S.search(foxes, {"text": phrase}, 10, "id", "text").collect()] == [2, 1]


def test_hits_may_overlap(foxes):
    got = {r.id: r.n for r in foxes.select("id", S.phrase_hits(F.col("text"), "the the").alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: None, 6: 2}


@pytest.mark.parametrize("phrase", ["", "  ", "?!"])
def test_a_phrase_without_a_word_is_an_error(foxes, phrase):
    with pytest.raises(ValueError, match="empty"):
        S.search(foxes, {"text": phrase}, 10, "id", "text")


def test_sentences_with_both_arguments_as_phrases(spark, foxes):
    pairs = spark.createDataFrame([("red", "the red"), ("fox", "red"), ("red", "re"), ("?", "fox"), (None, "fox")], "arg1 string, arg2 string")
    got = S.sentence_search(pairs, foxes.withColumnRenamed("text", "sen"), "id").collect()
    assert sorted((r.arg1, r.arg2, r.id) for r in got) == [("fox", "red", 1), ("fox", "red", 2), ("fox", "red", 4), ("red", "the red", 1)]


def test_patterns_are_rendered_with_letters(spark):
    row = spark.range(1).select(S.render_pattern(F.expr("array(struct('w9' as head, 'dobj' as label, 'w3' as tail), struct('w3' as head, 'amod' as label, 'w5' as tail))")).alias("p"))
    assert row.first().p == 'dep(a,"dobj",b), dep(b,"amod",c)'


def test_closure_of_a_deep_chain(spark):
    chain = spark.range(600).select(F.lit("g").alias("t"), F.col("id").alias("head"), (F.col("id") + 1).alias("tail"))
    got = G.closure(chain, ["t"])
    assert got.count() == 601 * 602 // 2
    assert got.where("node = 0").agg(F.max("below")).first()[0] == 600
    ring = spark.createDataFrame([("g", i, (i + 1) % 5) for i in range(5)], "t string, head long, tail long")
    assert G.closure(ring, ["t"]).count() == 25


def test_paths_of_every_length(spark):
    e = spark.createDataFrame([("g", 1, 2, "a"), ("g", 2, 3, "b")], "t string, head int, tail int, label string")
    got = {(r.k, tuple(r.nodes)) for r in G.paths_up_to(e, ["t"], 2).collect()}
    assert got == {(0, (1,)), (0, (2,)), (0, (3,)), (1, (1, 2)), (1, (2, 1)), (1, (2, 3)), (1, (3, 2)), (2, (1, 2, 3)), (2, (3, 2, 1))}


PLACED = "corpus string, sentence_id int"


def test_texts_leave_out_exactly_the_listed_labels(spark):
    others = ["ccomp", "auxpass", "advmod", "xcomp", "ref", "npadvmod", "acomp", "cop", "expl", "attr", "vmod", "partmod", "infmod", "punct", "amod", "conj", "cc", "nn", "prepc"]
    tokens = [("c", 1, 1, "go", "go", "VB"), ("c", 1, 2, "ice", "ice", "NN")]
    deps = []
    for k, label in enumerate(others):
        for node in (1, 2):
            i = 10 * (k + 1) + node
            tokens.append(("c", 1, i, f"{label}{node}", "x", "NN"))
            deps += [("c", 1, "basic", node, i, label)]
    tokens.append(("c", 1, 999, "deep", "x", "NN"))
    deps.append(("c", 1, "basic", 10 * (others.index("amod") + 1) + 2, 999, "cc"))  # excluded labels count at the node itself only
    g = GraphTables(spark.createDataFrame(tokens, f"{PLACED}, token_id int, text string, lemma string, pos string"), spark.createDataFrame(deps, f"{PLACED}, graph string, head int, tail int, label string"))
    preds = spark.createDataFrame([("c", 1, 1, "object", 2)], f"{PLACED}, node int, role string, arg int")
    rels = spark.createDataFrame([], f"{PLACED}, head int, tail int, rel string")
    none = spark.createDataFrame([], f"{PLACED}, node int, verb string")
    got = {r.node: r.comment for r in R.labels(g, preds, rels, none).collect()}
    assert got[1] == "go " + " ".join(f"{x}1" for x in others if x in {"ref", "infmod", "punct", "amod", "nn", "prepc"})
    assert got[2] == "ice " + " ".join(f"{x}2" for x in others if x in {"ccomp", "auxpass", "npadvmod", "acomp", "expl", "attr", "punct", "amod", "nn", "prepc"}) + " deep"


def test_relative_clauses_are_followed_to_any_depth(spark):
    tokens = [("c", 1, i, w, w, "NN") for i, w in enumerate(["dog", "saw", "cat", "ate", "mouse", "ran"], 1)]
    deps = [("c", 1, "dep", h, t, label) for h, label, t in [(1, "rcmod", 2), (2, "dobj", 3), (3, "rcmod", 4), (4, "nsubj", 6), (4, "rcmod", 6)]]
    g = GraphTables(spark.createDataFrame(tokens, f"{PLACED}, token_id int, text string, lemma string, pos string"), spark.createDataFrame(deps, f"{PLACED}, graph string, head int, tail int, label string"))
    none = spark.createDataFrame([], f"{PLACED}, node int, verb string")
    one = spark.createDataFrame([("c", 1, 3)], f"{PLACED}, node int")
    got = sorted((r.node, r.role, r.arg) for r in R.roles(g, one, none).collect())
    assert got == [(4, "agent", 6), (4, "object", 3), (6, "agent", 4)]  # 2 is not below 3


def question(words, tree, relations, roles, names, clauses, focus):
    """The rule of one question of one sentence, step by step."""
    wanted = set(focus.split(" "))
    hits = [i for i, w in enumerate(words, 1) if w in wanted]
    if not hits:
        return None
    runs, run = [], [hits[0]]
    for i in hits[1:]:
        if i == run[-1] + 1:
            run.append(i)
        else:
            runs, run = [*runs, run], [i]
    run = max([*runs, run], key=len)

    def under(n):
        return {n}.union(*[under(c) for c in tree.get(n, ())])

    node = min((n for n in range(1, len(words) + 1) if set(run) <= under(n)), key=lambda n: (len(under(n)), -n))
    name = lambda n: f"Eq/1_{n}-{names[n][0]}"
    isa = lambda n: f'isa({name(n)}, "{names[n][1]}")'

    def described(n, skip):
        out = [isa(n)]
        for of in [n, *sorted(c for m, c in clauses if m == n)]:
            for role, arg in sorted((r, a) for m, r, a in roles if m == of):
                out.append(f"{role}({name(of)}, {name(arg)})")
                if arg not in skip:
                    out.append(isa(arg))
        return out

    met, left, right = [node], [], []
    for x, y, rel in sorted(relations):
        for end in (x, y):
            if end not in met:
                left += described(end, met)
                met.append(end)
        (right if node in (x, y) else left).append(f"{rel}({name(x)}, {name(y)})")
    return "rule1:: " + ", ".join(left) + " -> " + ", ".join(right + described(node, [])) + "."


def test_question_rules_against_a_plain_loop(spark):
    words = ["big", "dogs", "chase", "cats", "that", "fear", "dogs", "big"]
    tree = {3: [2, 4], 2: [1], 4: [6], 6: [5, 7], 7: [8]}
    relations = [(3, 6, "effect"), (2, 4, "enable"), (6, 7, "cause"), (1, 6, "part")]
    roles = [(3, "agent", 2), (3, "object", 4), (6, "object", 7), (6, "agent", 4)]
    names = {i: (w, f"the {w}") for i, w in enumerate(words, 1)}
    clauses = [(4, 6)]
    tokens = spark.createDataFrame([("q", 1, i, w, w, "NN") for i, w in enumerate(words, 1)] + [("r", 1, 1, "x", "x", "NN")], f"{PLACED}, token_id int, text string, lemma string, pos string")
    deps = [("q", 1, "basic", h, t, "x") for h, ts in tree.items() for t in ts] + [("q", 1, "dep", h, t, "rcmod") for h, t in clauses]
    g = GraphTables(tokens, spark.createDataFrame(deps, f"{PLACED}, graph string, head int, tail int, label string"))
    rels = spark.createDataFrame([("q", 1, *r) for r in relations], f"{PLACED}, head int, tail int, rel string")
    preds = spark.createDataFrame([("q", 1, *r) for r in roles], f"{PLACED}, node int, role string, arg int")
    named = spark.createDataFrame([("q", 1, n, *v) for n, v in names.items()] + [("r", 1, 1, "x", "an x")], f"{PLACED}, node int, label string, comment string")
    for focus in ("big dogs", "cats", "dogs big fear", "chase", "nothing here"):
        rows = spark.createDataFrame([("q", focus), ("r", "x")], "corpus string, focus string")
        got = {r.corpus: r for r in R.question_rules(g, rels, named, preds, rows).collect()}
        want = question(words, tree, relations, roles, names, clauses, focus)
        assert got["q"].rule == want, focus
        assert (got["q"].problem is None) == (want is not None)
        assert got["r"].rule == 'rule1::  -> isa(Er/1_1-x, "an x").'
