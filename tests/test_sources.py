"""Readers and sinks that have no query of their own."""

import io

import pytest
from lexiquarry.operators import learning as L
from lexiquarry.operators.lines import weave_rules
from lexiquarry.plans.pipeline import REGISTRY, PipelineError, run_each
from lexiquarry.sources import readers, sinks
from pyspark.sql import functions as F

TURTLE = """@prefix n: <http://x/n#> .
# a comment
n:a n:p n:b , n:c ;
    n:label "say \\"hi\\"\\n" , "x"@en ; n:at 7 .
<http://y> a n:Thing . _q:1 p:z "5"^^<http://w#integer> ."""


def test_turtle_with_prefixes_and_lists():
    n = "http://x/n#"
    assert readers.parse_turtle(TURTLE) == [
        (f"{n}a", f"{n}p", f"{n}b", "uri"),
        (f"{n}a", f"{n}p", f"{n}c", "uri"),
        (f"{n}a", f"{n}label", 'say "hi"\n', "string"),
        (f"{n}a", f"{n}label", "x", "string"),
        (f"{n}a", f"{n}at", "7", "integer"),
        ("http://y", "rdf:type", f"{n}Thing", "uri"),
        ("_q:1", "p:z", "5", "integer"),
    ]
    for bad in ("<a> <b> .", "<a> <b> <c>", "<a> ? <c> ."):
        with pytest.raises(ValueError):
            readers.parse_turtle(bad)


def test_turtle_documents(spark):
    texts = spark.createDataFrame([("f", TURTLE), ("g", None)], "source string, value string")
    got = readers.turtle_documents(texts).collect()
    assert len(got) == 7 and {r.source for r in got} == {"f"}


def test_sections_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, f"l{i}", 1 + i // 2) for i in range(5)], "source string, line_no int, line string, section_index int")
    sinks.sections(rows, str(tmp_path / "out"), "part", ".txt")
    assert [(r.value, r.file) for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == [(f"l{i}", f"part-{1 + i // 2}.txt") for i in range(5)]
    lines = spark.createDataFrame([("a.txt", 1, "x\r"), ("a.txt", 0, "w"), ("b.txt", 0, "y")], "source string, line_no int, line string")
    run_each(REGISTRY.get("cat"), lines, str(tmp_path / "each"))
    assert sorted((r.source, r.value) for r in spark.read.text(str(tmp_path / "each")).collect()) == [("a.txt", "w"), ("a.txt", "x"), ("b.txt", "y")]
    (tmp_path / "file").write_text("")
    with pytest.raises(PipelineError, match="directory"):
        run_each(REGISTRY.get("cat"), lines, str(tmp_path / "file"))
    with pytest.raises(PipelineError, match="one input"):
        run_each(REGISTRY.get("merge"), lines, str(tmp_path / "more"))


def test_small_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n")
    assert sorted(r.line for r in readers.split_lines(spark, str(tmp_path / "a.txt")).collect()) == ["1", "2"]
    assert [(r.source, r.line_no, r.line) for r in readers.stdin_lines(spark, io.StringIO("p\nq\n")).collect()] == [("stdin", 0, "p"), ("stdin", 1, "q")]
    lines = spark.createDataFrame([("be\t_\t_\t7",), ("short\t1",)], "line string")
    assert [(r.phrase, r.n) for r in readers.phrase_counts(lines).collect()] == [("be", 7)]
    names = spark.createDataFrame([("a.b.txt",), (".hidden",), ("plain",)], "d string")
    assert [r[0] for r in names.select(readers.corpus_name(F.col("d"))).collect()] == ["a.b", ".hidden", "plain"]


def test_facts_are_appended(spark, tmp_path):
    for term in ("Reef", "WINCH"):
        sinks.append_facts(spark.createDataFrame([(term, "f")], "term string, fact string"), str(tmp_path / "facts"))
    assert sorted(r.term for r in spark.read.parquet(str(tmp_path / "facts")).collect()) == ["reef", "winch"]


def test_a_failed_commit_keeps_the_former_dataset(spark, tmp_path):
    root, df = str(tmp_path / "ds"), spark.range(3)
    sinks.commit_dataset({"x": df}, root)
    with pytest.raises(Exception, match="boom"):
        sinks.commit_dataset({"x": df.select(F.raise_error(F.lit("boom")).alias("y"))}, root)
    assert spark.read.parquet(f"{root}/x").count() == 3


def test_rules_with_their_sentences(spark):
    pairs = spark.createDataFrame([(0, "p", "isa(E3S2-x)"), (1, "q", "none")], "pair long, first string, second string")
    sentences = spark.createDataFrame([(3, "third")], "sentence_id int, text string")
    assert {r.pair: r.sentence for r in weave_rules(pairs, sentences).collect()} == {0: "third", 1: None}


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 2), float(i % 2) * 2) for i in range(20)], "label double, x double")
    model = L.trainer(["x"], [], "J48").fit(rows)
    for _ in range(2):
        L.save(model, str(tmp_path / "model"))
    got = L.load(str(tmp_path / "model")).transform(rows)
    assert L.positives(got).count() == 10


def test_connecting_words_and_path_features(spark):
    paths = spark.createDataFrame([("i", "eff", 2, "p(_1, _3)", ["of", "x"], [1, 5, 2]), ("i", "eff", 3, "q", ["to"], [1, 5, 6, 2])], "id string, disrel string, k int, pattern string, lemmas array<string>, nodes array<int>")
    f = L.path_features(paths, ["id"]).first()
    assert (f.dep2, f.dep3, f.has2, f.has3, f.prep_for, f.prep_of, f.prep_to, f.lengths) == ("eff => p(_1, _3)", "eff => q", True, True, False, True, True, [2, 3])
    tokens = spark.createDataFrame([("i", 5, "mid"), ("i", 6, "end"), ("i", 1, "first")], "id string, token_id int, text string")
    assert L.connecting_words(paths, tokens, ["id"]).first().connecting == ["end", "mid"]


def test_places_of_phrases(spark):
    r = spark.createDataFrame([("a b c a d", "c a", "b"), ("a b", "b c", "a"), ("a", "", "a"), ("", "a", "a")], "s string, x string, y string")
    got = r.select(L.place_of(F.col("x"), F.col("s")), L.distance(F.col("x"), F.col("y"), F.col("s"))).collect()
    assert [tuple(x) for x in got] == [(3, 1), (0, None), (0, None), (0, None)]


def test_places_of_phrases_are_those_of_a_plain_loop(spark):
    """First places in words; a sentence of 100,000 words is read once, not once a word."""
    import random
    import time

    from pyspark.sql import functions as F

    rng = random.Random(1)
    words = ["a", "b", "ab", "é", "a b"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 3))), "\t ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(200)] + [(None, "a"), ("a", None), ("b c", "ab c")]
    got = spark.createDataFrame(rows, "p string, s string").select("p", "s", L.place_of(F.col("p"), F.col("s")).alias("at"), L.distance(F.lit("a"), F.col("p"), F.col("s")).alias("d")).collect()

    def place(p, s):
        cut = lambda x: [w for w in x.replace("\t", " ").split(" ") if w]
        if p is None or s is None or not cut(p):
            return 0
        return next((i + 1 for i in range(len(cut(s))) if cut(s)[i : i + len(cut(p))] == cut(p)), 0)

    for r in got:
        a, b = place("a", r.s), place(r.p, r.s)
        assert (r["at"], r.d) == (b, abs(a - b) if a and b else None), (r.p, r.s)
    long = spark.createDataFrame([("x y", "a b " * 50_000 + "x y")], "p string, s string")
    began = time.time()
    assert long.select(L.place_of(F.col("p"), F.col("s"))).first()[0] == 100_001
    assert time.time() - began < 20


def test_tuples_of_a_long_row_do_not_carry_the_row(spark):
    import time

    from pyspark.sql import functions as F

    row = "\t".join(str(i) for i in range(9 + 12 * 20_000 + 9))
    began = time.time()
    got = readers.strided(spark.createDataFrame([(1, row), (2, "x"), (3, None)], "k int, line string"), "line", "\t", "k")
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("sen").cast("int") == F.col("at") + 6).cast("int")).alias("ok"), F.max("at").alias("last")).first()
    assert tuple(r) == (20_001, 20_001, 9 + 12 * 20_000)
    assert time.time() - began < 30
