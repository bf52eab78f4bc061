"""Queries do the whole job: checked against whole-job SQL of this file, or on fixtures."""

import glob
import os

import pytest
from lexiquarry.plans.registry import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(spark, con, name, sql):
    df, rel = QUERIES[name](spark, SF), con.sql(sql)
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    cell = lambda x: round(float(x), 6) if isinstance(x, float) else x
    rows = [tuple(cell(r[c]) for c in columns) for r in df.collect()]
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rows, key=str) == sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_pattern_frequency_takes_whole_orders(spark, con):
    same(
        spark,
        con,
        "pattern_frequency",
        """WITH s AS (SELECT o_orderkey, o_orderpriority AS disrel, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS pattern
             FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
           SELECT disrel, pattern, count(*) AS n FROM s GROUP BY ALL""",
    )


def talk(spark, tmp_path, *rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_every_line_of_a_turn_has_features_and_a_score(spark, tmp_path):
    long = " ".join(["She", "said", "it", "has"] + ["word"] * 16)
    d = talk(spark, tmp_path, (1, 0, "user", f"too short\nThe dog is eating the bone\n{long}"), (2, 0, "user", "a b c d e f"))
    got = {(r.conv_id, r.turn, r.line_no): r for r in QUERIES["token_features"](spark, d).collect()}
    assert sorted(got) == [(1, 0, 1), (1, 0, 2), (2, 0, 0)]
    one, two = got[1, 0, 1], got[1, 0, 2]
    assert (one.short, one.long, one.rel_vbz, one.arg1_pronoun, one.arg2s_noun) == (1, 0, 1, 0, 1)
    assert (two.short, two.long, two.rel_vbz, two.arg1_pronoun, two.blacklisted) == (0, 1, 1, 1, 1)
    scores = {(r.conv_id, r.turn, r.line_no): r.confidence for r in QUERIES["logistic_score"](spark, d).collect()}
    assert sorted(scores) == sorted(got) and scores[1, 0, 1] > scores[1, 0, 2]


def test_label_text_joins_whole_turns(spark, con, tmp_path):
    same(spark, con, "label_text", "SELECT conv_id, max(role) FILTER (turn = 0) AS label, string_agg(text, ' ' ORDER BY turn) AS comment FROM conversations GROUP BY conv_id")
    d = talk(spark, tmp_path, (1, 1, "assistant", "c\nd"), (1, 0, "user", "a\nb"))
    assert [tuple(r) for r in QUERIES["label_text"](spark, d).select("label", "comment").collect()] == [("user", "a\nb c\nd")]


_LEAVES = """leaf AS (SELECT s_nationkey AS n, 's' || s_suppkey AS x, (1000 + s_suppkey)::VARCHAR AS y FROM supplier UNION ALL SELECT c_nationkey, 'c' || c_custkey, 'c' || c_custkey FROM customer)"""
_WALK = f"""{_LEAVES}, e AS (SELECT n_regionkey::VARCHAR AS a, (100 + n_nationkey)::VARCHAR AS b, 'has' AS l FROM nation UNION ALL SELECT (100 + n)::VARCHAR, y, 'of' FROM leaf),
  w AS (SELECT a, b, l, true AS d FROM e UNION ALL SELECT b, a, l, false FROM e),
  p2 AS (SELECT x.a, x.b AS m, z.b AS c, x.l AS l1, x.d AS d1, z.l AS l2, z.d AS d2 FROM w x JOIN w z ON x.b = z.a WHERE z.b <> x.a)"""


def test_descendants_reach_customers(spark, con):
    same(
        spark,
        con,
        "descendants",
        f"""WITH {_LEAVES}, t AS (SELECT 'r' || n_regionkey AS r, 'n' || n_nationkey AS n, x FROM nation LEFT JOIN leaf ON n_nationkey = n),
            p AS (SELECT r AS node, r AS below FROM t UNION SELECT n, n FROM t UNION SELECT x, x FROM t UNION SELECT r, n FROM t UNION SELECT n, x FROM t UNION SELECT r, x FROM t)
            SELECT 'world' AS tree, * FROM p WHERE below IS NOT NULL""",
    )


def test_paths_pass_customers(spark, con):
    same(
        spark,
        con,
        "paths_len_k",
        f"""WITH {_WALK} SELECT 1 AS k, a || '-' || b AS path FROM w UNION SELECT 2, a || '-' || m || '-' || c FROM p2
            UNION SELECT 3, p.a || '-' || m || '-' || c || '-' || w.b FROM p2 p JOIN w ON p.c = w.a WHERE w.b NOT IN (p.a, p.m)""",
    )
    same(
        spark,
        con,
        "path_patterns",
        f"""WITH {_WALK} SELECT array_to_string(list_sort([l1 || CASE WHEN d1 THEN '(_1, _3)' ELSE '(_3, _1)' END, l2 || CASE WHEN d2 THEN '(_3, _2)' ELSE '(_2, _3)' END]), ', ') AS pattern, count(*) AS n
            FROM p2 GROUP BY 1""",
    )


def test_covering_place_of_every_order(spark, con):
    same(
        spark,
        con,
        "covering_ancestor",
        f"""WITH {_LEAVES}, t AS (SELECT 'r' || n_regionkey AS r, 'n' || n_nationkey AS n, x FROM nation JOIN leaf ON n_nationkey = n),
            f AS (SELECT o_orderkey, 'c' || o_custkey AS x FROM orders UNION SELECT l_orderkey, 's' || l_suppkey FROM lineitem),
            g AS (SELECT o_orderkey, count(*) AS k, count(DISTINCT x) AS xs, count(DISTINCT n) AS ns, count(DISTINCT r) AS rs, min(x) AS x, min(n) AS n, min(r) AS r FROM f JOIN t USING (x) GROUP BY o_orderkey),
            a AS (SELECT o_orderkey, CASE WHEN xs = 1 THEN x WHEN ns = 1 THEN n ELSE r END AS node FROM g WHERE rs = 1),
            z AS (SELECT n AS node, 1 + count(*) AS size FROM t GROUP BY n UNION ALL SELECT r, 1 + count(*) + count(DISTINCT n) FROM t GROUP BY r UNION ALL SELECT x, 1 FROM t)
            SELECT o_orderkey, 'world' AS tree, node, size FROM a JOIN z USING (node)""",
    )


def test_overlap_with_every_benchmark_item(spark, con):
    ws = "list_filter(string_split_regex({0}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
    same(
        spark,
        con,
        "numeric_features",
        f"""WITH d AS (SELECT doc_id, {ws.format('text')} AS ws, list_distinct({ws.format('lower(text)')}) AS lw FROM documents JOIN labels USING (doc_id)),
            b AS (SELECT item_id, {ws.format('lower(text)')} AS bw FROM benchmark), p AS (SELECT doc_id, item_id, len(list_intersect(lw, bw)) AS n FROM d, b WHERE list_has_any(lw, bw))
            SELECT doc_id, item_id, round(CASE WHEN len(ws) > 0 THEN ln(len(ws)) ELSE 0 END, 6) AS log_length, round(ln(coalesce(n, 0) + 1), 6) AS log_overlap FROM d LEFT JOIN p USING (doc_id)""",
    )


def test_overlap_keeps_documents_without_common_words(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha beta beta"), (2, "gamma"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "none"), (7, "beta alpha"), (8, "x Beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.log_overlap for r in QUERIES["numeric_features"](spark, str(tmp_path)).collect()}
    assert got == {(1, 7): 1.098612, (1, 8): 0.693147, (2, None): 0.0, (3, None): 0.0}


def test_inverted_index_is_over_documents(spark, tmp_path):
    spark.createDataFrame([(5, "To be, or not to be"), (6, "be")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.term, r.doc_id): r.positions for r in QUERIES["inverted_index"](spark, str(tmp_path)).collect()}
    assert got == {("to", 5): "0 4", ("be", 5): "1 5", ("or", 5): "2", ("not", 5): "3", ("be", 6): "0"}


def test_definitions_with_a_long_subject_are_read():
    from lexiquarry.operators.cascade import facts, surrogate_tokens

    nouns = " ".join(f"noun{'abcdefghijklmnop'[i]}" for i in range(14))
    got = facts(surrogate_tokens(f"{nouns} is a small engine ."))
    assert ("DefinedTerm", "", "", nouns, "") in got and any(kind == "IsA" for kind, *_ in got)
