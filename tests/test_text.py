import pytest
from lexiquarry.functions import text as X
from lexiquarry.functions.ranks import number
from lexiquarry.operators.definitions import lookup, post_filter, preprocess
from lexiquarry.operators.lines import parse_numbered, split_runs
from lexiquarry.sources import readers, sinks
from pyspark.sql import functions as F

CASES = [
    ("# Beyond the last bridge.", ["Beyond the last bridge."], []),
    ("A 'gantry' is a frame over a track.", ["A gantry is a frame over a track."], []),
    ("A 'tinker' is one who is 'drawn to' repairs.", ["A tinker is one who is drawn to repairs."], []),
    ("With the colour of a plum's skin.", ["With the colour of a plum's skin."], []),
    ("{{plural}} A 'reef' is a ridge.", ["A reef is a ridge."], ["plural"]),
    ("# A 'q' is round. {{see|m|n}}", ["A q is round."], ["see|m|n"]),
    ("{{IE}} {{rare}} 'Dulse' is a red weed.", ["Dulse is a red weed."], ["IE", "rare"]),
    ("('rates') Up to ()", ["Up to"], []),
    ("#{{field|ships}} ; {{plural}} A 'winch' has drums (reels) on it.", ["A winch has drums  on it."], ["field|ships", "plural"]),
    ("({{A+B}}, 'under' &amp; {{B-end}}) If M is 'under' N, so be it.", ["If M is under N, so be it."], ["A+B", "B-end"]),
    ("Turning off a road; losing one's way.", ["Turning off a road", "losing one's way."], []),
    ("#{{plural of|gantry}}", [], ["plural of|gantry"]),
    ("The heron '' is grey.", ["The heron  is grey."], []),
    ("A 'b' 'c' d", ["A b 'c' d"], []),
    ("&amp;lt;x&amp;gt;", ["<x>"], []),
]


@pytest.mark.parametrize("full", [False, True])
def test_clean_up(spark, full):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, definition string")
    got = {r.i: (r.parts, r.meta) for r in preprocess(df, full_entities=full).collect()}
    for i, (raw, parts, meta) in enumerate(CASES):
        assert got[i] == (parts, meta), raw


def test_runs_and_numbering(spark):
    rows = [("d", k, f"1.{s}\tt{k}") for k, s in enumerate([1, 1, 2, 1])]
    df = spark.createDataFrame(rows, "source string, line_no int, line string")
    got = split_runs(parse_numbered(df), ["source"], ["line_no"], "section").orderBy("line_no").collect()
    assert [r.section_index for r in got] == [1, 1, 2, 3] and got[2].body == "t2"
    with pytest.raises(Exception, match="not a numbered line"):
        parse_numbered(spark.createDataFrame([("d", 0, "no number")], "source string, line_no int, line string")).collect()
    n = number(spark.range(0, 1000, 3), F.floor(F.col("id") / 64), [F.col("id")], "n").orderBy("id").collect()
    assert [r.n for r in n] == list(range(1, 335))


def test_readers(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([("s", i, t) for i, t in enumerate(x)], "source string, line_no int, line string")
    assert readers.tab_dictionary(lines("a\tnoun\tdef\tx", "bad\tline")).select("term", "definition").collect() == [("a", "def")]
    got = readers.tagged_dictionary(lines('7\t"<reef> <_noun> <_book> A long ridge."', "8\tno tags")).collect()
    assert [(r.term, r.word_class, r.dictionary, r.definition) for r in got] == [("reef", "noun", "book", "A long ridge.")]
    row = "\t".join(f"f{k}" for k in range(31))
    assert [(r.arg1, r.kp, r.arg2, r.sen) for r in readers.strided(lines(row, "short")).collect()] == [("f9", "f10", "f11", "f15"), ("f21", "f22", "f23", "f27")]
    assert readers.id_sentences(lines("1\tx", "2")).count() == 1
    lab = readers.labeled(lines("sid\tsentence\td\tr\ta\tb\tl", "1\tIt's X\tEffect\tR\tA\tB\t1", "2\ty\tCause\tr\ta\tb")).collect()
    assert [(r.sentence, r.label) for r in lab] == [("its x", "1"), ("y", None)]
    assert readers.counts(lines("a\t3", "b")).collect() == [("a", 3)]
    pw = readers.pattern_weights(lines("dep=effect => (a(_1, _2))\t0.5", "dep=x => (b)\t-1")).collect()
    assert [(r.disrel, r.weight) for r in pw] == [("effect", 0.5)]
    b = readers.blocks(lines(";;; s one", '%a\t"go"/EFFECT\tb', ";;; s two", '%c\t"x"/CAUSE\td'), ["source"]).orderBy("line_no").collect()
    assert [(r.sentence, r.disrel, r.phrase, r.arg1, r.arg2) for r in b] == [("s one", "EFFECT", "go", "a", "b"), ("s two", "CAUSE", "x", "c", "d")]
    (tmp_path / "w.txt").write_text("# c\nIntercept\t-1.5\nx\t2\nbad\n")
    assert readers.weights(spark, str(tmp_path / "w.txt")) == {"Intercept": -1.5, "x": 2.0}
    d = tmp_path / "dir"
    d.mkdir()
    (d / "a.txt").write_text("1\n2\n")
    (d / "b.txt").write_text("3")
    assert sorted(map(tuple, readers.text_lines(spark, str(d)).collect())) == [("a.txt", 0, "1"), ("a.txt", 1, "2"), ("b.txt", 0, "3")]
    assert readers.dataset("/r", "store://file/d/x") == "/r/d/x"
    with pytest.raises(ValueError):
        readers.dataset("/r", "store://file/../x")
    v = spark.createDataFrame([("http://h/id#corp/12_3",)], "u string").select(*[c.alias(k) for k, c in readers.vertex(F.col("u")).items()]).first()
    assert tuple(v) == ("corp", 12, 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, 'a"')], "k int, t string")
    lines = [r.line for r in sinks.bracketed_json(df, ["k"]).collect()]
    assert lines == ["[", '{"k":1,"t":"a\\""},', '{"k":2,"t":"b"}', "]"]
    back = readers.bracketed_json(spark.createDataFrame([(x,) for x in lines], "line string"), df.schema).orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, 'a"'), (2, "b")]
    assert [r.line for r in sinks.tsv(df.orderBy("k"), "k", "t").collect()] == ['1\ta"', "2\tb"]
    head, body = sinks.arff(df.withColumn("label", F.lit("1")), "r")
    assert "@attribute label {1,0}" in head and body.count() == 2
    root = str(tmp_path / "ds")
    sinks.commit_dataset({"x": df}, root)
    sinks.commit_dataset({"x": df, "y": df}, root)
    assert spark.read.parquet(f"{root}/y").count() == 2


def test_post_filter_and_lookup(spark):
    rows = [("x", "IsA", "X", 0), ("x", "IsA", "someone", 0), ("x", "IsA", "part", 0), ("x", "IsA", "part", 1), ("x", "Quality", "x", 0), ("x", "IsA", "y", 0)]
    got = post_filter(spark.createDataFrame(rows, "agent string, rel_type string, obj string, n_modifiers int")).collect()
    assert sorted((r.rel_type, r.obj) for r in got) == [("IsA", "part"), ("IsA", "person"), ("IsA", "y"), ("Quality", "x")]
    facts = spark.createDataFrame([("gantry", "noun", "w", "d", "f2"), ("gantry", "noun", "w", "d", "f1"), ("b", "noun", "w", "d", "f")], "term string, word_class string, source string, alternate_definition string, fact string")
    assert [r.extractions for r in lookup(facts, " Gantry ").collect()] == [["f1", "f2"]]


def test_small_functions(spark):
    df = spark.createDataFrame([('say "a" and "b" and "a"', "good phrase", "x1", "A man")], "q string, a string, b string, c string")
    r = df.select(X.quoted(F.col("q")), X.sane_query(F.col("a")), X.sane_query(F.col("b")), X.sane_query(F.col("c")), X.initcap_first(F.col("a"))).first()
    assert tuple(r) == (["a", "b"], True, False, False, "Good phrase")


def test_plain_texts_are_not_searched_for_signs(spark):
    """Texts without signs are split only; those with signs come out as by the whole chain."""
    import re
    import time

    from lexiquarry.functions import text as X
    from pyspark.sql import functions as F

    odd = ["a; b", "x {{m}} y; z", "(a) b;(c", "say 'it' now", 'say "it" now; ""x', "''a''", "&amp;lt; b", "{one}", "", ";", "a 'b", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, c string").select("i", X.parts(F.col("c")).alias("p"), X.meta(F.col("c")).alias("m"), X.unescape(F.col("c")).alias("u")).collect()

    def parts(c):
        for shape, to in ((X.META_CLUSTER, ""), (r"\([^)]*\)", ""), (r"(^|[^A-Za-z0-9_])'([^']+)'([^A-Za-z0-9_]|$)", r"\1\2\3"), (r'(^|[^A-Za-z0-9_])"([^"]+)"([^A-Za-z0-9_]|$)', r"\1\2\3"), ("''", ""), ('""', "")):
            c = re.sub(shape, to, c)
        return [p for p in (re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", x) for x in c.split(";")) if p]

    for r in got:
        t = odd[r.i]
        assert (r.p, r.m, r.u) == ((None, None, None) if t is None else (parts(t), re.findall(X.META, t), "< b" if "amp" in t else t)), t
    plain = spark.createDataFrame([("plain words of a text " * 400_000,)], "c string")
    began = time.time()
    assert plain.select(F.size(X.parts(X.unescape(F.col("c")))), F.size(X.meta(F.col("c")))).first()[:] == (1, 0)
    assert time.time() - began < 8
