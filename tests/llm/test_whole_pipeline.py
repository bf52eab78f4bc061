import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
A = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees above"
B = "every morning our baker kneads fresh dough and shapes round loaves before dawn so that whole streets smell of warm bread and butter"
C = "an entirely unrelated report lists monthly figures for copper zinc and tin as traded by several northern ports during last winter"


def left(spark, rows):
    return sorted((r.doc_id, r.text[:3]) for r in P.near(spark, rows, SF).collect())


def test_repeated_id_on_an_unrelated_text_stays(spark, docs):
    rows = docs((7, A), (7, A.upper()), (7, C), (8, A), extra=["th"])
    got = left(spark, rows)
    assert len(got) == 2 and (7, "an ") in got and {i for i, _ in got} == {7}


def test_groups_with_the_same_smallest_id_each_keep_one(spark, docs):
    rows = docs((7, A), (8, A), (7, B), (9, B), (7, C), extra=["th"])
    assert left(spark, rows) == [(7, "an "), (7, "eve"), (7, "the")]
    rows = docs((7, A), (7, A), (8, A), (7, B), (9, B), (5, C), extra=["th"])
    assert left(spark, rows) == [(5, "an "), (7, "eve"), (7, "the")]
