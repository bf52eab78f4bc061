from lexiquarry.llm import quality_classifier as Q


def test_dictionaries_see_whole_texts(spark, docs, monkeypatch):
    assert b"".join(Q.pieces([b"abcdefg"], 3)) == b"abcdefg" and Q.pieces([b"", b"ab"], 3) == [b"ab"]
    seen = []
    real = Q.dictionary
    monkeypatch.setattr(Q, "dictionary", lambda texts: seen.append(b"".join(texts)) or real(texts))
    rows = docs(*[(i, f"word{i} " * 1500 + f"end{i}.") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    Q.train(rows, labels)
    good, bad = seen
    assert good and bad and all(x.count(b"end") >= 5 for x in seen)
    assert sum(x.count(b"end") for x in seen) == sum(x.count(b".") for x in seen)
