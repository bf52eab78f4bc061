"""Search, bootstrapping and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions.text import words
from lexiquarry.operators import graph, learning, search
from lexiquarry.plans._book import Book
from lexiquarry.sources.readers import table

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

_TOK = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"


def _hits(field: str, phrase: str) -> str:
    body = " " + "  ".join(phrase.split()) + " "
    padded = f"(' ' || array_to_string({_TOK.format(field)}, '  ') || ' ')"
    return f"((length({padded}) - length(replace({padded}, '{body}', ''))) // {len(body)})"


@book(
    "phrase_search",
    f"""WITH s AS (SELECT doc_id, text, round(sqrt({_hits('text', 'of the')}::DOUBLE / len({_TOK.format('text')})::DOUBLE), 6) AS score FROM documents WHERE {_hits('text', 'of the')} > 0),
        k AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 100), d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS n FROM k)
        SELECT doc_id, score FROM d WHERE n = 1""",
)
def phrase_search(spark, sf_dir):
    """Top 100 by score, then without repeated texts."""
    return search.search(table(spark, sf_dir, "documents"), {"text": "of the"}, 100, "doc_id", "text").select("doc_id", "score")


@book(
    "two_field_search",
    f"""WITH p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS ask, max(CASE WHEN turn = 1 THEN text END) AS answer FROM conversations GROUP BY conv_id),
        s AS (SELECT conv_id, answer, round(sqrt({_hits('ask', 'the')}::DOUBLE / len({_TOK.format('ask')})::DOUBLE) + sqrt({_hits('answer', 'the')}::DOUBLE / len({_TOK.format('answer')})::DOUBLE), 6) AS score
              FROM p WHERE {_hits('ask', 'the')} > 0 AND {_hits('answer', 'the')} > 0),
        k AS (SELECT * FROM s ORDER BY score DESC, conv_id LIMIT 50), d AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY score DESC, conv_id) AS n FROM k)
        SELECT conv_id, score FROM d WHERE n = 1""",
)
def two_field_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("ask"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("answer"))
    return search.search(p, {"ask": "the", "answer": "the"}, 50, "conv_id", "answer").select("conv_id", "score")


@book(
    "quoted_search",
    f"""WITH s AS (SELECT doc_id, text, round(sqrt({_hits('text', 'and the')}::DOUBLE / len({_TOK.format('text')})::DOUBLE), 6) AS score FROM documents WHERE {_hits('text', 'and the')} > 0),
        k AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 100), d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS n FROM k)
        SELECT doc_id, score FROM d WHERE n = 1""",
)
def quoted_search(spark, sf_dir):
    """Quotes, punctuation and case of a phrase do not matter."""
    return search.search(table(spark, sf_dir, "documents"), {"text": '"And, the"'}, 100, "doc_id", "text").select("doc_id", "score")


@book(
    "rarity_search",
    f"""WITH n AS (SELECT count(*) AS total, count(*) FILTER ({_hits('text', 'the')} > 0) AS a, count(*) FILTER ({_hits('source', 'src3')} > 0) AS b FROM documents),
        s AS (SELECT doc_id, text, round((1 + ln(total / (a + 1.0::DOUBLE))) ** 2 * sqrt({_hits('text', 'the')}::DOUBLE / len({_TOK.format('text')})::DOUBLE)
                                       + (1 + ln(total / (b + 1.0::DOUBLE))) ** 2 * sqrt({_hits('source', 'src3')}::DOUBLE / len({_TOK.format('source')})::DOUBLE), 6) AS score
              FROM documents, n WHERE {_hits('text', 'the')} > 0 AND {_hits('source', 'src3')} > 0),
        k AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 100), d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS n FROM k)
        SELECT doc_id, score FROM d WHERE n = 1""",
)
def rarity_search(spark, sf_dir):
    """Two fields, each weighed by how rare its phrase is."""
    return search.search(table(spark, sf_dir, "documents"), {"text": "the", "source": "src3"}, 100, "doc_id", "text", rarity=True).select("doc_id", "score")


@book(
    "inverted_index",
    f"""WITH t AS (SELECT doc_id, {_TOK.format('text')} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS term, CAST(unnest(range(len(ws))) AS INTEGER) AS pos FROM t)
        SELECT term, 'text' AS field, doc_id, array_to_string(list_sort(list(pos)), ' ') AS positions FROM u GROUP BY term, doc_id""",
)
def inverted_index(spark, sf_dir):
    """Every term of the corpus, with its places in each document."""
    got = search.index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), " "))


def _words(spark, sf_dir, name, key):
    return table(spark, sf_dir, name).select(F.col(key), F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("entity"))


@book(
    "entity_counts",
    f"""WITH e AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS entity FROM benchmark),
        d AS (SELECT DISTINCT text, unnest({_TOK.format('text')}) AS entity FROM (SELECT DISTINCT text FROM documents))
        SELECT e.entity, count(*) AS n FROM e JOIN d ON e.entity = d.entity GROUP BY e.entity""",
)
def entity_counts(spark, sf_dir):
    """In how many different texts of the corpus each benchmark word occurs."""
    e = _words(spark, sf_dir, "benchmark", "item_id").select("entity").distinct()
    d = table(spark, sf_dir, "documents").select("text").distinct().select(F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("entity"))
    return d.join(e, "entity", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@book(
    "instance_filter",
    """WITH n AS (SELECT p_brand AS entity, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 80 UNION ALL SELECT p_type, count(*) FROM part GROUP BY p_type HAVING count(*) >= 80),
       g AS (SELECT DISTINCT lower(entity) AS e FROM n WHERE lower(entity) NOT IN ('brand#1', 'standard'))
       SELECT p_partkey, p_brand AS arg1, p_type AS arg2 FROM part WHERE lower(p_brand) IN (SELECT e FROM g) AND lower(p_type) IN (SELECT e FROM g)""",
)
def instance_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = p.groupBy(F.col("p_brand").alias("entity")).agg(F.count(F.lit(1)).alias("n")).unionByName(p.groupBy(F.col("p_type").alias("entity")).agg(F.count(F.lit(1)).alias("n")))
    stop = spark.createDataFrame([("Brand#1",), ("STANDARD",)], "word string")
    return search.frequent_pairs(p.select("p_partkey", F.col("p_brand").alias("arg1"), F.col("p_type").alias("arg2")), n, 80, stop)


@book(
    "seed_instances",
    """SELECT DISTINCT s.disrel, p_partkey, p_brand AS arg1, p_type AS kp FROM part JOIN (VALUES ('Effect', 'economy'), ('Cause', 'Promo'), ('Cause', 'standard')) s(disrel, kp) ON lower(p_type) = lower(s.kp)""",
)
def seed_instances(spark, sf_dir):
    seeds = spark.createDataFrame([("Effect", "economy"), ("Cause", "Promo"), ("Cause", "standard")], "disrel string, kp string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("arg1"), F.col("p_type").alias("kp"))
    return search.instances(rows, seeds)


@book(
    "per_phrase_cap",
    "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 5",
)
def per_phrase_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return search.capped(rows, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 5)


@book(
    "good_phrases",
    f"""WITH w AS (SELECT unnest({_TOK.format('text')}) AS phrase FROM documents), c AS (SELECT phrase, count(*) AS n FROM w GROUP BY phrase HAVING count(*) >= 10)
        SELECT phrase, n FROM c WHERE phrase NOT IN ('the', 'of', 'de') ORDER BY n DESC, phrase LIMIT 300""",
)
def good_phrases(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(search.tokens(F.col("text"))).alias("phrase"))
    stop = spark.createDataFrame([("the",), ("of",), ("de",)], "word string")
    return search.good_phrases(w.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")), 10, 300, stop)


@book(
    "top_per_group",
    """WITH w AS (SELECT p_type AS disrel, p_name AS pattern, sum(p_retailprice) AS weight FROM part GROUP BY p_type, p_name),
       r AS (SELECT *, row_number() OVER (PARTITION BY disrel ORDER BY round(weight, 2) DESC, pattern) AS n FROM w) SELECT disrel, pattern, round(weight, 2) AS weight FROM r WHERE n <= 10""",
)
def top_per_group(spark, sf_dir):
    w = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("disrel"), F.col("p_name").alias("pattern")).agg(F.round(F.sum("p_retailprice"), 2).alias("weight"))
    return learning.top_patterns(w, ["disrel"], 10)


@book(
    "pattern_frequency",
    """WITH s AS (SELECT o_orderpriority AS disrel, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS pattern, o_orderkey
         FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_orderpriority)
       SELECT disrel, pattern, count(*) AS n FROM s GROUP BY disrel, pattern""",
)
def pattern_frequency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("disrel"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("steps"))
    return search.pattern_frequency(rows.join(o, F.col("l_orderkey") == F.col("o_orderkey")))


@book(
    "pattern_share",
    """WITH c AS (SELECT o_orderpriority AS disrel, o_orderstatus AS kp, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT disrel, kp, n, round(n / sum(n) OVER (PARTITION BY disrel), 9) AS share FROM c""",
)
def pattern_share(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("disrel"), F.col("o_orderstatus").alias("kp"))
    return search.phrase_frequency(rows).withColumn("share", F.round("share", 9))


@book(
    "phrase_in_corpus",
    f"""WITH c AS (SELECT p_type AS disrel, lower(p_name) AS kp, count(*) AS n FROM part GROUP BY 1, 2), w AS (SELECT DISTINCT kp FROM c),
        o AS (SELECT lower(p_name) AS kp, count(*) AS corpus_n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), j AS (SELECT c.*, coalesce(corpus_n, 0) AS corpus_n FROM c LEFT JOIN o USING (kp))
        SELECT disrel, kp, n, round(n / sum(n) OVER (PARTITION BY disrel), 9) AS share, corpus_n, round(corpus_n / sum(corpus_n) OVER (PARTITION BY disrel), 9) AS corpus_share FROM j""",
)
def phrase_in_corpus(spark, sf_dir):
    """Phrases per relation with their share, and with the share of their occurrences in the orders."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("disrel"), F.lower("p_name").alias("kp"))
    sold = table(spark, sf_dir, "lineitem").select("l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("kp")
    got = search.phrase_frequency(p, sold)
    return got.withColumns({c: F.round(c, 9) for c in ("share", "corpus_share")})


@book(
    "pattern_rendering",
    """SELECT o_orderkey, 'dep(a,"by",b), dep(a,"is ' || o_orderstatus || '",c)' || CASE WHEN o_custkey % 2 = 0 THEN ', dep(b,"even",b)' ELSE '' END AS pattern FROM orders""",
)
def pattern_rendering(spark, sf_dir):
    """Steps between an order, its customer and its status, with variables for the ends."""
    o = table(spark, sf_dir, "orders")
    step = lambda a, label, b: F.struct(a.alias("head"), label.alias("label"), b.alias("tail"))
    order, customer = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    steps = F.array(step(order, F.lit("by"), customer), step(order, F.concat(F.lit("is "), "o_orderstatus"), F.col("o_orderstatus")))
    steps = F.when(F.col("o_custkey") % 2 == 0, F.concat(steps, F.array(step(customer, F.lit("even"), customer)))).otherwise(steps)
    return o.select("o_orderkey", search.render_pattern(steps).alias("pattern"))


@book(
    "sentence_search",
    f"""WITH c AS (SELECT doc_id, text AS sen, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS t FROM documents),
        p AS (SELECT DISTINCT {_TOK.format('text')}[1] AS arg1, {_TOK.format('text')}[2] || ' ' || {_TOK.format('text')}[3] AS arg2 FROM benchmark)
        SELECT arg1, arg2, doc_id FROM p, c WHERE contains(t, ' ' || arg1 || ' ') AND contains(t, ' ' || arg2 || ' ')""",
)
def sentence_search(spark, sf_dir):
    """Documents that hold the first word of a benchmark item and its next two."""
    t = search.tokens(F.col("text"))
    b = table(spark, sf_dir, "benchmark").select(F.get(t, F.lit(0)).alias("arg1"), F.array_join(F.slice(t, 2, 2), " ").alias("arg2"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sen"))
    return search.sentence_search(b, d, "doc_id").drop("sen")


@book(
    "sentence_lookup",
    "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON lower(n_name) = 'nation_' || s_nationkey",
)
def sentence_lookup(spark, sf_dir):
    """Exact lookup by two arguments, whatever their case."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("arg1"), F.lit("Supplier").alias("arg2"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("arg1"), F.lit("supplier").alias("arg2"))
    return search.sentences_of(n, s).select("n_nationkey", "s_suppkey")


@book(
    "sentence_check",
    """WITH s AS (SELECT conv_id, turn, text || ': and the of' AS sen, CASE WHEN turn % 2 = 0 THEN 'The' ELSE 'un' END AS a, CASE WHEN turn % 3 = 0 THEN 'of' ELSE 'de' END AS b FROM conversations),
       t AS (SELECT *, trim(string_split(sen, ':')[-1]) AS tail FROM s)
       SELECT conv_id, turn, CASE WHEN contains(lower(tail), lower(a)) AND contains(lower(tail), lower(b)) THEN tail WHEN contains(lower(sen), lower(a)) AND contains(lower(sen), lower(b)) THEN sen END AS kept FROM t""",
)
def sentence_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(": and the of")).alias("sen"))
    a, b = F.when(F.col("turn") % 2 == 0, "The").otherwise("un"), F.when(F.col("turn") % 3 == 0, "of").otherwise("de")
    return c.select("conv_id", "turn", search.sentence_holds(F.col("sen"), a, b).alias("kept"))


@book(
    "query_sanity",
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS q FROM conversations UNION ALL SELECT conv_id, turn, 'A man' FROM conversations)
       SELECT conv_id, turn, q FROM w WHERE NOT regexp_matches(q, '[^A-Za-z ''\\-]') AND length(trim(q)) > 1 AND lower(trim(q)) <> 'a man'""",
)
def query_sanity(spark, sf_dir):
    from lexiquarry.functions.text import sane_query

    c = table(spark, sf_dir, "conversations")
    q = c.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("q")).unionByName(c.select("conv_id", "turn", F.lit("A man").alias("q")))
    return q.where(sane_query(F.col("q")))


@book("distant_supervision", "SELECT l.doc_id, d.disrel, l.quality FROM labels l CROSS JOIN (VALUES ('Cause'), ('Effect'), ('Example'), ('Function'), ('Require')) d(disrel)")
def distant_supervision(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return search.for_each_relation(rows, ["Cause", "Effect", "Example", "Function", "Require"])


@book(
    "quoted_spans",
    """SELECT page_id, array_to_string(list_distinct(regexp_extract_all(html, '<html lang="([^"]*)"', 1)), '|') AS langs, len(list_distinct(regexp_extract_all(html, '"([^"]*)"', 1))) AS n FROM pages""",
)
def quoted_spans(spark, sf_dir):
    from lexiquarry.functions.text import quoted

    p = table(spark, sf_dir, "pages")
    langs = F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('<html lang="([^"]*)"'), F.lit(1))), "|")
    return p.select("page_id", langs.alias("langs"), F.size(quoted(F.col("html"))).cast("long").alias("n"))


@book(
    "rule_parse",
    """SELECT n_nationkey, 'in' AS rel, n_name AS arg1, 'region ' || n_regionkey AS arg2 FROM nation""",
)
def rule_parse(spark, sf_dir):
    """Rules written from nations are read back: the relation and the texts of its ends."""
    n = table(spark, sf_dir, "nation")
    a = F.concat(F.lit("E1S"), F.col("n_nationkey").cast("string"), F.lit("-nation"))
    b = F.concat(F.lit("E2S"), F.col("n_regionkey").cast("string"), F.lit("-region"))
    said = lambda i, t: F.concat(F.lit("isa("), i, F.lit(', "'), t, F.lit('")'))
    rule = F.concat(F.lit("rule1:: "), said(a, F.col("n_name")), F.lit(" -> in("), a, F.lit(", "), b, F.lit("), "), said(b, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))), F.lit("."))
    return search.parse_rule(n.select("n_nationkey", rule.alias("rule"))).drop("rule")


_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


@book(
    "numeric_features",
    f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws, list_distinct({_WORDS.format('lower(text)')}) AS lw FROM documents JOIN labels USING (doc_id)),
        w AS (SELECT doc_id, unnest(lw) AS word FROM d), b AS (SELECT item_id, unnest(list_distinct({_WORDS.format('lower(text)')})) AS word FROM benchmark),
        p AS (SELECT doc_id, item_id, count(*) AS n FROM w JOIN b USING (word) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, round(CASE WHEN len(ws) > 0 THEN ln(len(ws)) ELSE 0 END, 6) AS log_length, round(ln(coalesce(n, 0) + 1), 6) AS log_overlap FROM d LEFT JOIN p USING (doc_id)""",
)
def numeric_features(spark, sf_dir):
    """Every labelled document with each benchmark item it shares words with; once without item if there is none."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "text")
    x = d.select("doc_id", F.xxhash64("text").alias("th"), learning.log_length(F.col("text")).alias("log_length"), words(F.lower("text")).alias("ws"))
    w = x.select("doc_id", "th", F.explode(F.array_distinct("ws")).alias("word")).distinct()
    b = table(spark, sf_dir, "benchmark").select("item_id", F.xxhash64("text").alias("ih"), F.explode(F.array_distinct(words(F.lower("text")))).alias("word"))
    pairs = w.join(b, "word").groupBy("doc_id", "th", "item_id", "ih").agg(F.count(F.lit(1)).alias("n"))
    overlap = F.log(F.coalesce("n", F.lit(0)) + F.lit(1.0))
    return x.join(pairs, ["doc_id", "th"], "left").select("doc_id", "item_id", F.round("log_length", 6).alias("log_length"), F.round(overlap, 6).alias("log_overlap"))


@book(
    "lexical_seeds",
    "SELECT p_type AS disrel, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS seeds FROM part WHERE p_size % 2 = 1 GROUP BY p_type",
)
def lexical_seeds(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("disrel"), F.col("p_name").alias("relphrase"), (F.col("p_size") % 2).cast("string").alias("label"))
    return learning.lexical_seeds(rows).withColumn("seeds", F.array_join("seeds", "|"))


_PRED = "SELECT doc_id, quality AS label, CAST(length(text) > 1200 AS INTEGER) AS predicted FROM labels JOIN documents USING (doc_id)"


def _predicted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n") > 1200).cast("int").alias("predicted"))


@book("confusion_matrix", f"WITH p AS ({_PRED}) SELECT label, predicted, count(*) AS n FROM p GROUP BY label, predicted")
def confusion_matrix(spark, sf_dir):
    return learning.confusion(_predicted(spark, sf_dir), "label", "predicted")


@book(
    "precision_recall",
    f"""WITH p AS ({_PRED}), s AS (SELECT count(*) AS n, sum((label = predicted)::INT) AS ok, sum((label = 1 AND predicted = 1)::INT) AS tp, sum((predicted = 1)::INT) AS pp, sum((label = 1)::INT) AS yy FROM p)
        SELECT n, round(ok / n, 6) AS accuracy, CASE WHEN pp > 0 THEN round(tp / pp, 6) END AS precision, CASE WHEN yy > 0 THEN round(tp / yy, 6) END AS recall FROM s""",
)
def precision_recall(spark, sf_dir):
    return learning.precision_recall(_predicted(spark, sf_dir), "label", "predicted")


@book(
    "class_metrics",
    f"""WITH p AS ({_PRED}), c AS (SELECT label AS class, 1 AS y, 0 AS p, (label = predicted)::INT AS hit FROM p UNION ALL SELECT predicted, 0, 1, 0 FROM p),
        s AS (SELECT class, CAST(sum(y) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted_n, CAST(sum(y * hit) AS BIGINT) AS correct FROM c GROUP BY class)
        SELECT *, CASE WHEN predicted_n > 0 THEN round(correct / predicted_n, 6) END AS precision, CASE WHEN support > 0 THEN round(correct / support, 6) END AS recall FROM s""",
)
def class_metrics(spark, sf_dir):
    return learning.per_class(_predicted(spark, sf_dir), "label", "predicted")


@book(
    "phrase_distance",
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS.format('text')} AS ws FROM conversations), a AS (SELECT conv_id, turn, ws, ws[2:3] AS x, ws[5:5] AS y FROM w WHERE len(ws) >= 5),
        l AS (SELECT conv_id, turn, list_min(list_filter(range(1, len(ws)), lambda i: ws[i:i+1] = x)) AS i, list_min(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i] = y)) AS j FROM a)
        SELECT conv_id, turn, CAST(abs(i - j) AS INTEGER) AS distance FROM l""",
)
def phrase_distance(spark, sf_dir):
    """Words between the places of a turn's second and third word, and of its fifth."""
    ws = words(F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", ws.alias("ws")).where(F.size("ws") >= 5)
    return c.select("conv_id", "turn", learning.distance(F.array_join(F.slice("ws", 2, 2), " "), F.get("ws", F.lit(4)), F.col("text")).alias("distance"))


@book(
    "span_containment",
    """SELECT a.user_id, a.event_id AS inner_start, a.event_id + 3 AS inner_end, b.event_id AS outer_start, CAST(b.event_id + floor(b.value) AS BIGINT) AS outer_end FROM events a JOIN events b
       ON a.user_id = b.user_id AND b.event_id <= a.event_id AND a.event_id + 3 <= b.event_id + floor(b.value)""",
)
def span_containment(spark, sf_dir):
    """Short spans at every event inside the spans that events of the same user open."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), "value")
    inner = e.select("user_id", "start", (F.col("start") + 3).alias("end"))
    return graph.contained(inner, e.select("user_id", "start", (F.col("start") + F.floor("value")).alias("end")), ["user_id"])


@book(
    "path_mining",
    """WITH l AS (SELECT 'c' || c_custkey AS x, c_nationkey AS n FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
       o AS (SELECT DISTINCT o_orderpriority AS disrel, 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
       p AS (SELECT o.disrel, o.a, o.b, CASE WHEN x.n = y.n THEN 'of(_3, _1), of(_3, _2)' ELSE 'has(_4, _3), has(_4, _5), of(_3, _1), of(_5, _2)' END AS pattern
             FROM o JOIN l x ON x.x = o.a JOIN l y ON y.x = o.b JOIN nation m ON m.n_nationkey = x.n JOIN nation k ON k.n_nationkey = y.n WHERE m.n_regionkey = k.n_regionkey)
       SELECT disrel, pattern, count(*) AS weight FROM p GROUP BY ALL""",
)
def path_mining(spark, sf_dir):
    """Paths through places between the customers and the suppliers of orders, by priority."""
    t = lambda name: table(spark, sf_dir, name)
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda df, head, tail, label: df.select(F.lit("world").alias("tree"), head.alias("head"), tail.alias("tail"), F.lit(label).alias("label"))
    edges = edge(t("nation"), name("r", "n_regionkey"), name("n", "n_nationkey"), "has")
    edges = edges.unionByName(edge(t("supplier"), name("n", "s_nationkey"), name("s", "s_suppkey"), "of")).unionByName(edge(t("customer"), name("n", "c_nationkey"), name("c", "c_custkey"), "of"))
    li = t("lineitem").select("l_orderkey", name("s", "l_suppkey").alias("arg2"))
    ends = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("disrel"), name("c", "o_custkey").alias("arg1")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return learning.mine_paths(edges, ends.select(F.lit("world").alias("tree"), "disrel", "arg1", "arg2").distinct(), ["tree"])


@book(
    "nominal_to_binary",
    "SELECT event_id, (event_type = 'click')::INT AS is_click, (event_type = 'view')::INT AS is_view, (event_type = 'purchase')::INT AS is_purchase, (event_type = 'error')::INT AS is_error FROM events",
)
def nominal_to_binary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *[(F.col("event_type") == k).cast("int").alias(f"is_{k}") for k in ("click", "view", "purchase", "error")])


def _instances(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    lined = F.size(F.split("text", "\n"))
    x = rows.select("doc_id", F.col("quality").cast("double").alias("label"), learning.log_length(F.col("text")).alias("log_length"), F.log(lined.cast("double")).alias("log_lines"), F.col("lang").alias("disrel"))
    return learning.folds(x, F.col("doc_id"), 3)


@book("train_classifier")
def train_classifier(spark, sf_dir):
    """Cross-validated predictions of a logistic model (rows only)."""
    rows = _instances(spark, sf_dir).cache()
    numeric = learning.useful(rows, ["log_length", "log_lines"])
    return learning.cross_validate(rows, learning.trainer(numeric, ["disrel"]), 3).select("doc_id", "fold", "label", "prediction")


@book("score_relations")
def score_relations(spark, sf_dir):
    """Every instance under every relation, best first (rows only)."""
    rows = _instances(spark, sf_dir)
    model = learning.trainer(["log_length", "log_lines"], ["disrel"]).fit(rows)
    return learning.score_relations(rows.drop("disrel"), model, ["en", "fr", "de", "es"]).select("doc_id", "disrel", "confidence")


@book("row_lookup", "WITH n AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS row_id FROM labels) SELECT row_id, doc_id, quality FROM n")
def row_lookup(spark, sf_dir):
    """Data rows by running number."""
    from lexiquarry.functions.ranks import number

    return number(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.floor(F.col("doc_id") / 5000), [F.col("doc_id")], "row_id").select("row_id", "doc_id", "quality")
