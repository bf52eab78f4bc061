"""The loader of rule files and its cascades."""

import pytest
from lexiquarry.operators import rule_files as R
from lexiquarry.operators.cascade import Token, facts, surrogate_tokens


def toks(text):
    return [Token(*x.split("/"), x.split("/")[0].lower()) for x in text.split()]


def found(files, text):
    ctx, last = R.apply(toks(text), R.cascade(files))
    return [(s.kind, s.start, s.end) for s in ctx.spans], [s.kind for s in last]


def test_levels_references_and_named_groups():
    one = """
    // a comment with "quotes" and <brackets
    Det := OpenRegex { <pos="DT"> | <pos='CD'> }
    Noun := OpenRegex { <pos=/NN.*/ & !string="way">+ }  // trailing
    """
    two = 'NP := TypedOpenRegex { (<Art>: @Det)? (<Head>: @Noun) (?: <string="of"> @Noun)* }'
    spans, last = found([one, two], "the/DT big/JJ dog/NN of/IN war/NN way/NN")
    assert spans == [("Det", 0, 1), ("Noun", 2, 3), ("Noun", 4, 5), ("NP", 2, 5)] and last == ["NP"]
    ctx, _ = R.apply(toks("two/CD dogs/NNS"), R.cascade([one, two]))
    assert {k: ctx.text(v) for k, v in ctx.spans[-1].names.items()} == {"Art": "two", "Head": "dogs"}


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ('<string="a">*', "a/X a/X b/X a/X", [(0, 2), (3, 4)]),
        ('<string="a">{2}', "a/X a/X a/X", [(0, 2)]),
        ('<string="a">{1,2} <string="b">', "a/X a/X a/X b/X", [(1, 4)]),
        ('^ <string="a">', "a/X a/X", [(0, 1)]),
        ('<string="a"> $', "a/X a/X", [(1, 2)]),
        ("<(pos='X' | pos='Y') & !string=\"b\">+", "a/X b/X c/Y d/Z", [(0, 1), (2, 3)]),
        (r"<string=/and\/or|,/>", "and/or", []),
        ('(<string="a"> | <string="a"> <string="b">) <string="c">', "a/X b/X c/X", [(0, 3)]),
        ("<string=\"'\">", "'/X", [(0, 1)]),
    ],
)
def test_patterns(pattern, text, want):
    tokens = [Token("and/or", "CC", "and/or")] if text == "and/or" else toks(text)
    ctx, _ = R.apply(tokens, R.cascade([f"P := OpenRegex {{ {pattern} }}"]))
    assert [(s.start, s.end) for s in ctx.spans] == (want or [(0, 1)])


def test_consuming_rules_take_their_tokens():
    files = ['consume A := OpenRegex { <string="a"> <string="b"> } B := OpenRegex { <string="b"> }', 'C := OpenRegex { <string="b"> }']
    assert found(files, "a/X b/X b/X")[0] == [("A", 0, 2), ("B", 2, 3), ("C", 1, 2), ("C", 2, 3)]


def test_keywords():
    file = "K := CaseInsensitiveKeywordTagger {\n  new york // a city\n  york\n}\nS := KeywordTagger { It }"
    assert found([file], "New/X York/X york/X it/X It/X")[0] == [("K", 0, 2), ("K", 2, 3), ("S", 4, 5)]


@pytest.mark.parametrize(
    ("text", "what"),
    [
        ("P := OpenRegex { <pos=> }", "value"),
        ("P := OpenRegex { <size=1> }", "one of string"),
        ("P := OpenRegex { (<pos='X'> }", "expected"),
        ("P := TypedOpenRegex { @Q }", "unknown Q"),
        ("P = x", "line 1: expected a rule"),
        ("\n\nP := OpenRegex { <pos=/(/> }", "line 3: bad expression"),
    ],
)
def test_errors_say_where(text, what):
    with pytest.raises(R.RuleError, match=what):
        R.cascade([text])


def test_spans_of_texts_and_cascade_files(spark, tmp_path):
    (tmp_path / "one.rules").write_text('Be := OpenRegex { <lemma="be"> }')
    (tmp_path / "two.rules").write_text('Isa := TypedOpenRegex { (<What>: <pos=/NN.*/>+) @Be }')
    (tmp_path / "top.cascade").write_text("one.rules\ntwo.rules\n")
    assert [[r.name for r in level] for level in R.load(str(tmp_path / "top.cascade"))] == [["Be"], ["Isa"]]
    files = [(tmp_path / f).read_text() for f in ("one.rules", "two.rules")]
    rows = spark.createDataFrame([(1, "A gate is open"), (2, None), (3, "")], "id int, text string")
    got = sorted((r.id, r.kind, r.text, r["last"], dict(r.names)) for r in R.spans(rows, files, surrogate_tokens).collect())
    assert got == [("1", "Be", "is", False, {}), ("1", "Isa", "gate is", True, {"What": "gate"})]


LEMMAS = {"is": "be", "helps": "help", "causes": "cause", "includes": "include", "needed": "need", "used": "use"}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("A/DT dam/NN is/VBZ a/DT wall/NN that/WDT helps/VBZ farms/NNS", "Effect"),
        ("A/DT leak/NN is/VBZ a/DT gap/NN that/WDT results/VBZ in/IN losses/NNS", "Effect"),
        ("Rust/NN is/VBZ a/DT layer/NN that/WDT may/MD cause/VB damage/NN", "Cause"),
        ("A/DT menu/NN is/VBZ a/DT list/NN that/WDT includes/VBZ soups/NNS", "Example"),
        ("A/DT key/NN is/VBZ a/DT tool/NN that/WDT is/VBZ needed/VBN for/IN doors/NNS", "Require"),
        ("A/DT pan/NN is/VBZ a/DT dish/NN that/WDT is/VBZ used/VBN for/IN frying/NN", "Function"),
        ("A/DT pan/NN is/VBZ a/DT dish/NN that/WDT holds/VBZ eggs/NNS", "Fact"),
    ],
)
def test_special_relations(text, kind):
    tokens = [Token(w, pos, LEMMAS.get(w, w.lower())) for w, pos in (x.split("/") for x in text.split())]
    assert [f[0] for f in facts(tokens) if f[0] not in ("DefinedTerm", "IsA", "Quality", "Property")] == [kind]


def test_rules_are_tried_only_where_they_can_begin(monkeypatch):
    """Tokens that no match begins with start no matcher."""
    from lexiquarry.operators.cascade import Rep

    tried = []
    at = Rep.at
    monkeypatch.setattr(Rep, "at", lambda self, ctx, i, names, n=0: (tried.append(i), at(self, ctx, i, names, n))[1])
    ctx, _ = R.apply(surrogate_tokens("some words and 12 13 of them " * 50), R.cascade(["Amount := OpenRegex { <string=/[0-9]+/>+ }"]))
    assert len(ctx.spans) == 50 == len(tried)
