"""Graph queries over the star schema as a typed triple graph, and over annotated text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiquarry.operators import annotate, graph, rules
from lexiquarry.plans._book import Book
from lexiquarry.plans.patterns import PLACE, Bind, Differ, Edge, Either, GraphTables, Not, Prop, Tok, as_sql, construct, match, path_candidates
from lexiquarry.session import cut
from lexiquarry.sources.readers import table

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql


def _star(spark, sf_dir) -> GraphTables:
    """The star schema as a typed graph of one place: nodes with properties, edges by foreign key.

    Ids are a letter and the key; a line of an order is named by its four keys.
    """
    place = [F.lit("world").alias("corpus"), F.lit(0).alias("sentence_id")]
    ident = lambda letter, *keys: F.concat(F.lit(f"{letter}:"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    line = ident("l", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nodes = [
        ("region", ident("r", "r_regionkey"), {"name": "r_name", "key": "r_regionkey"}),
        ("nation", ident("n", "n_nationkey"), {"name": "n_name", "key": "n_nationkey"}),
        ("customer", ident("c", "c_custkey"), {"name": "c_name", "key": "c_custkey", "segment": "c_mktsegment"}),
        ("supplier", ident("s", "s_suppkey"), {"name": "s_name", "key": "s_suppkey"}),
        ("part", ident("p", "p_partkey"), {"name": "p_name", "key": "p_partkey", "type": "p_type", "brand": "p_brand"}),
        ("orders", ident("o", "o_orderkey"), {"key": "o_orderkey", "status": "o_orderstatus", "priority": "o_orderpriority"}),
        ("lineitem", line, {"key": "l_orderkey", "number": "l_linenumber"}),
    ]
    links = [
        ("customer", ident("c", "c_custkey"), "in:nation", ident("n", "c_nationkey")),
        ("supplier", ident("s", "s_suppkey"), "in:nation", ident("n", "s_nationkey")),
        ("nation", ident("n", "n_nationkey"), "in:region", ident("r", "n_regionkey")),
        ("nation", ident("n", "n_nationkey"), "rdfs:label", F.col("n_name")),
        ("orders", ident("o", "o_orderkey"), "by:customer", ident("c", "o_custkey")),
        ("lineitem", line, "of:order", ident("o", "l_orderkey")),
        ("lineitem", line, "of:part", ident("p", "l_partkey")),
        ("lineitem", line, "from:supplier", ident("s", "l_suppkey")),
    ]
    props = ("name", "key", "segment", "type", "brand", "status", "priority", "number")
    tokens = deps = None
    for kind, node, have in nodes:
        columns = [(F.col(have[p]).cast("string") if p in have else F.lit(None).cast("string")).alias(p) for p in props]
        rows = t[kind].select(*place, node.alias("token_id"), F.lit(kind).alias("kind"), *columns)
        tokens = rows if tokens is None else tokens.unionByName(rows)
    for kind, head, label, tail in links:
        rows = t[kind].select(*place, F.lit("dep").alias("graph"), head.alias("head"), tail.alias("tail"), F.lit(label).alias("label"))
        deps = rows if deps is None else deps.unionByName(rows)
    return GraphTables(tokens, deps)


def _key(var: str, type_: str = "long"):
    """The key in a node's id."""
    return F.substring_index(F.col(var), ":", -1).cast(type_)


@book(
    "bgp_chain",
    """SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'REGION_1' OR r_regionkey = 1""",
)
def bgp_chain(spark, sf_dir):
    """A chain of patterns from its constant end."""
    g = _star(spark, sf_dir)
    named = [Either([Tok("r", "name", "REGION_1")], [Tok("r", "key", "1")])]
    chain = [Edge("n", "in:region", "r"), Edge("c", "in:nation", "n"), Edge("o", "by:customer", "c"), Prop("n", "name", "n_name"), Prop("r", "name", "r_name")]
    m = match(g, chain, match(g, named).distinct())
    return m.select(_key("o").alias("o_orderkey"), _key("c").alias("c_custkey"), "n_name", "r_name")


@book(
    "bgp_star",
    """SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN orders ON l_orderkey = o_orderkey WHERE p_type = 'ECONOMY' AND o_orderstatus = 'F'""",
)
def bgp_star(spark, sf_dir):
    """Patterns around one variable; constants on two of its neighbours."""
    star = [
        Tok("p", "type", "ECONOMY"), Prop("p", "brand", "p_brand"), Edge("l", "of:part", "p"), Edge("l", "of:order", "o"), Tok("o", "status", "F"),
        Edge("l", "from:supplier", "s"), Prop("s", "name", "s_name"),
    ]
    keys = F.split(F.substring_index("l", ":", -1), "-")
    return match(_star(spark, sf_dir), star).select(F.get(keys, F.lit(0)).cast("long").alias("l_orderkey"), F.get(keys, F.lit(1)).cast("int").alias("l_linenumber"), "p_brand", "s_name")


_TRIPLES = """t AS (SELECT 'c:' || c_custkey AS s, 'in:nation' AS p, 'n:' || c_nationkey AS o FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'in:nation', 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'in:region', 'r:' || n_regionkey FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 'rdfs:label', n_name FROM nation)"""


@book("var_predicate", f"WITH {_TRIPLES} SELECT s, substr(p, 4) AS rel, o FROM t WHERE starts_with(p, 'in:')")
def var_predicate(spark, sf_dir):
    """A variable predicate with a prefix test, and the part after the prefix."""
    return match(_star(spark, sf_dir), [Edge("s", "in:*", "o", keep="p")]).select("s", F.regexp_extract("p", "^in:(.*)$", 1).alias("rel"), "o")


@book("path_alternative", f"WITH {_TRIPLES} SELECT s, o FROM t WHERE p IN ('in:region', 'rdfs:label')")
def path_alternative(spark, sf_dir):
    return match(_star(spark, sf_dir), [Edge("s", "in:region|rdfs:label", "o")]).select("s", "o")


@book("filter_regex", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_matches(c_name, '[05]$') AND NOT regexp_matches(c_mktsegment, '^(MACHINERY|BUILDING)$')")
def filter_regex(spark, sf_dir):
    atoms = [
        Tok("c", "kind", "customer"), Tok("c", "name", "[05]$", "regex"), Tok("c", "segment", "^(MACHINERY|BUILDING)$", "not_regex"),
        Prop("c", "name", "c_name"), Prop("c", "segment", "c_mktsegment"),
    ]
    return match(_star(spark, sf_dir), atoms).select(_key("c").alias("c_custkey"), "c_name", "c_mktsegment")


@book("not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark, sf_dir):
    atoms = [Tok("c", "kind", "customer"), Prop("c", "name", "c_name"), Not(Edge("o", "by:customer", "c"), Tok("o", "status", "P"))]
    return match(_star(spark, sf_dir), atoms).select(_key("c").alias("c_custkey"), "c_name")


@book("union_patterns", "SELECT o_orderkey, 'F' AS why FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'LOW' FROM orders WHERE o_orderpriority = '5-LOW'")
def union_patterns(spark, sf_dir):
    """Branches of a union are a bag."""
    atoms = [Either([Tok("o", "status", "F"), Bind("why", F.lit("F"))], [Tok("o", "priority", "5-LOW"), Bind("why", F.lit("LOW"))])]
    return match(_star(spark, sf_dir), atoms).select(_key("o").alias("o_orderkey"), "why")


@book("construct_concat", "SELECT DISTINCT 'n:' || n_nationkey AS s, 'sold_' || lower(c_mktsegment) AS p, 'r:' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def construct_concat(spark, sf_dir):
    """A predicate built from data; constructed edges are a set."""
    atoms = [Edge("c", "in:nation", "n"), Prop("c", "segment", "segment"), Edge("n", "in:region", "r")]
    made = construct(_star(spark, sf_dir), atoms, "n", "r", F.concat(F.lit("sold_"), F.lower("segment")))
    return made.select(F.col("head").alias("s"), F.col("label").alias("p"), F.col("tail").alias("o"))


@book("unequal_ends", "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey WHERE a.c_name LIKE '%7' AND 'c:' || a.c_custkey <> 's:' || b.s_suppkey")
def unequal_ends(spark, sf_dir):
    """Two variables that meet in a third and must differ."""
    g = _star(spark, sf_dir)
    # Both ends have their keys before they meet, and pairs are dealt by number, as a nation has many.
    x = match(g, [Tok("x", "kind", "customer"), Tok("x", "name", "7$", "regex"), Edge("x", "in:nation", "n")]).select(*PLACE, "n", "x", _key("x").alias("a"))
    y = match(g, [Edge("y", "in:nation", "n"), Tok("y", "kind", "supplier")]).select(*PLACE, "n", "y", _key("y").alias("b"))
    return graph.met(cut(x), cut(y), [*PLACE, "n"]).where("x <> y").select("a", "b")


def _line_sets(spark, sf_dir):
    words = lambda t: table(spark, sf_dir, t).select(F.explode(F.split("text", "\n")).alias("line"))
    return words("documents"), words("benchmark")


@book("graph_union", "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT unnest(string_split(text, chr(10))) FROM benchmark)")
def graph_union(spark, sf_dir):
    return graph.union(*_line_sets(spark, sf_dir))


@book("graph_diff", "SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark EXCEPT SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
def graph_diff(spark, sf_dir):
    """What benchmark has and documents lacks."""
    return graph.added(*_line_sets(spark, sf_dir))


def _place_edges(spark, sf_dir):
    """region -> nation -> supplier or customer as one tree of string ids."""
    n = table(spark, sf_dir, "nation").select(F.lit("world").alias("tree"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("head"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("tail"), F.lit("has").alias("label"))
    s = table(spark, sf_dir, "supplier").select(F.lit("world").alias("tree"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("head"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("tail"), F.lit("of").alias("label"))
    c = table(spark, sf_dir, "customer").select(F.lit("world").alias("tree"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("head"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tail"), F.lit("of").alias("label"))
    return n.unionByName(s).unionByName(c)


_TREE = """e(head, tail) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
   UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
 below(node, under) AS (SELECT DISTINCT x, x FROM (SELECT head AS x FROM e UNION ALL SELECT tail FROM e)
   UNION ALL SELECT b.node, e.tail FROM below b JOIN e ON e.head = b.under)"""


@book("descendants", f"WITH RECURSIVE {_TREE} SELECT DISTINCT 'world' AS tree, node, under AS below FROM below")
def descendants(spark, sf_dir):
    return graph.descendants(_place_edges(spark, sf_dir), ["tree"])


@book("conjunct_min", "SELECT a.n_nationkey AS node, min(b.n_nationkey) AS conj FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey")
def conjunct_min(spark, sf_dir):
    """Smallest neighbour over symmetric edges; here nations of one region, through a successor chain closed by min."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("k"))
    low = n.groupBy("region").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    edges = low.select(F.explode(F.expr("transform(slice(ks, 2, size(ks)), x -> struct(ks[0] as head, x as tail))")).alias("e")).select("e.head", "e.tail")
    return graph.conjuncts(edges, []).select("node", "conj")


@book(
    "longest_run",
    """WITH d AS (SELECT DISTINCT user_id, event_type, event_id // 50 AS slot FROM events),
       g AS (SELECT *, slot - row_number() OVER (PARTITION BY user_id, event_type ORDER BY slot) AS g FROM d),
       r AS (SELECT user_id, event_type, min(slot) AS start, max(slot) AS stop, count(*) AS n FROM g GROUP BY user_id, event_type, g),
       b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ascii(event_type), event_type, start) AS k FROM r)
       SELECT user_id, start, stop AS "end", n AS length FROM b WHERE k = 1""",
)
def longest_run(spark, sf_dir):
    """A user's longest run of successive time slots with one event type (ties: the type's code, then the start)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("event_id") / 50).alias("slot"))
    order = e.select("event_type").distinct().withColumn("code", F.ascii("event_type"))
    e = e.join(F.broadcast(order), "event_type").withColumn("rank", F.col("code"))
    return graph.longest_run(e, ["user_id"], "rank", "slot").select("user_id", "start", "end", "length")


@book(
    "covering_ancestor",
    f"""WITH RECURSIVE {_TREE}, c AS (SELECT DISTINCT node, under FROM below),
        f AS (SELECT o_orderkey, 'c' || o_custkey AS under FROM orders UNION SELECT l_orderkey, 's' || l_suppkey FROM lineitem),
        k AS (SELECT o_orderkey, count(*) AS k FROM f GROUP BY o_orderkey), s AS (SELECT node, count(*) AS size FROM c GROUP BY node),
        h AS (SELECT f.o_orderkey, c.node, count(*) AS n FROM f JOIN c ON c.under = f.under GROUP BY f.o_orderkey, c.node),
        r AS (SELECT h.o_orderkey, h.node, s.size, row_number() OVER (PARTITION BY h.o_orderkey ORDER BY s.size, h.node DESC) AS i
              FROM h JOIN k ON k.o_orderkey = h.o_orderkey AND k.k = h.n JOIN s ON s.node = h.node)
        SELECT o_orderkey, 'world' AS tree, node, size FROM r WHERE i = 1""",
)
def covering_ancestor(spark, sf_dir):
    """Per order, the smallest place over its customer and all its suppliers; orders across regions have none."""
    closure = graph.descendants(_place_edges(spark, sf_dir), ["tree"])
    tree = F.lit("world").alias("tree")
    o = table(spark, sf_dir, "orders").select(tree, "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("below"))
    li = table(spark, sf_dir, "lineitem").select(tree, F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("below"))
    return graph.covering(closure, o.unionByName(li), ["tree"], ("o_orderkey",))


_SYM = """e AS (SELECT n_regionkey::VARCHAR AS a, (100 + n_nationkey)::VARCHAR AS b, 'has' AS label FROM nation
   UNION ALL SELECT (100 + s_nationkey)::VARCHAR, (1000 + s_suppkey)::VARCHAR, 'of' FROM supplier UNION ALL SELECT (100 + c_nationkey)::VARCHAR, 'c' || c_custkey, 'of' FROM customer),
 y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"""


def _number_edges(spark, sf_dir):
    """Regions, nations and suppliers by number, customers as c and their key."""
    at = lambda c: c.cast("string")
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("place"), at(F.col("n_regionkey")).alias("head"), at(F.col("n_nationkey") + 100).alias("tail"), F.lit("has").alias("label"))
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("place"), at(F.col("s_nationkey") + 100).alias("head"), at(F.col("s_suppkey") + 1000).alias("tail"), F.lit("of").alias("label"))
    c = table(spark, sf_dir, "customer").select(F.lit(0).alias("place"), at(F.col("c_nationkey") + 100).alias("head"), F.concat(F.lit("c"), at(F.col("c_custkey"))).alias("tail"), F.lit("of").alias("label"))
    return n.unionByName(s).unionByName(c)


@book(
    "paths_len_k",
    f"""WITH {_SYM}, p AS (
         SELECT 1 AS k, [x.a, x.b] AS n FROM y x UNION SELECT 2, [x.a, x.b, z.b] FROM y x JOIN y z ON x.b = z.a WHERE z.b <> x.a
         UNION SELECT 3, [x.a, x.b, z.b, u.b] FROM y x JOIN y z ON x.b = z.a JOIN y u ON z.b = u.a WHERE z.b <> x.a AND u.b NOT IN (x.a, x.b))
       SELECT k, array_to_string(n, '-') AS path FROM p""",
)
def paths_len_k(spark, sf_dir):
    """Simple undirected paths of 1 to 3 edges between regions, nations, suppliers and customers."""
    e, out = _number_edges(spark, sf_dir), None
    for k in (1, 2, 3):
        p = graph.paths(e, ["place"], k).select(F.lit(k).alias("k"), F.array_join("nodes", "-").alias("path"))
        out = p if out is None else out.unionByName(p)
    return out


@book(
    "path_patterns",
    f"""WITH {_SYM}, w AS (SELECT a, b, label, true AS down FROM e UNION ALL SELECT b, a, label, false FROM e),
       p AS (SELECT DISTINCT x.a AS a, x.b AS m, z.b AS c, x.label AS l1, x.down AS d1, z.label AS l2, z.down AS d2 FROM w x JOIN w z ON x.b = z.a WHERE z.b <> x.a)
       SELECT array_to_string(list_sort([l1 || CASE WHEN d1 THEN '(_1, _3)' ELSE '(_3, _1)' END, l2 || CASE WHEN d2 THEN '(_3, _2)' ELSE '(_2, _3)' END]), ', ') AS pattern, count(*) AS n
       FROM p GROUP BY 1""",
)
def path_patterns(spark, sf_dir):
    """Generalized paths of two edges and how often each occurs."""
    return graph.two_step_patterns(_number_edges(spark, sf_dir), ["place"])


@book(
    "rule_pairs",
    """WITH n AS (SELECT n_nationkey, n_regionkey, 'E' || n_regionkey || 'S' || n_nationkey || '-nation' AS x, 'E' || n_regionkey || 'S' || (1000 + n_regionkey) || '-region' AS y,
                 n_name, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
       s AS (SELECT *, 'isa(' || y || ', "' || r_name || '")' AS there FROM n),
       h AS (SELECT *, 'isa(' || x || ', "' || n_name || '"), in(' || x || ', ' || y || '), ' || there AS here, 'part(' || x || ', ' || y || '), ' AS rel FROM s)
       SELECT n_nationkey, n_regionkey, CAST(2 * k - 1 AS INTEGER) AS rule_no, 'rule' || (2 * k - 1) || ':: ' || here || ' -> ' || rel || there || '.' AS rule FROM h
       UNION ALL SELECT n_nationkey, n_regionkey, CAST(2 * k AS INTEGER), 'rule' || (2 * k) || ':: ' || there || ' -> ' || rel || here || '.' FROM h""",
)
def rule_pairs(spark, sf_dir):
    """Two rules per relation, numbered within its place: every nation is part of its region, and in it."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = [F.lit("world").alias("corpus"), F.col("n_regionkey").alias("sentence_id")]
    there = (F.col("n_regionkey") + 1000).alias("tail")
    rels = n.select(*place, F.col("n_nationkey").alias("head"), there, F.lit("part").alias("rel"))
    preds = n.select(*place, F.col("n_nationkey").alias("node"), F.lit("in").alias("role"), there.alias("arg"))
    named = n.select(*place, F.col("n_nationkey").alias("node"), F.lit("nation").alias("label"), F.col("n_name").alias("comment"))
    named = named.unionByName(n.select(*place, there.alias("node"), F.lit("region").alias("label"), F.col("r_name").alias("comment")).distinct())
    got = rules.inference_rules(rels, named, preds)
    return got.select(F.col("head").alias("n_nationkey"), F.col("sentence_id").alias("n_regionkey"), "rule_no", "rule")


_ROLE = {"click": "agent", "view": "object", "purchase": "arg", "error": "arg"}
_LABEL = {"click": "nsubj", "view": "dobj", "purchase": "iobj", "error": "advmod"}


@book(
    "role_mapping",
    f"""SELECT event_id, user_id, m.role FROM events JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _ROLE.items())}) m(event_type, role) ON events.event_type = m.event_type
        WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 400)""",
)
def role_mapping(spark, sf_dir):
    """Users as nodes, events as their arguments, event types as labels; a copula suppresses a node's roles."""
    e = table(spark, sf_dir, "events")
    label = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _LABEL.items()])
    place = [F.lit("all").alias("corpus"), F.lit(0).alias("sentence_id"), F.lit("dep").alias("graph"), F.col("user_id").alias("head"), F.col("event_id").alias("tail")]
    deps = e.select(*place, label.alias("label")).where("label is not null").unionByName(e.where("value > 400").select(*place, F.lit("cop").alias("label")))
    tokens = e.select(F.lit("all").alias("corpus"), F.lit(0).alias("sentence_id"), F.col("event_id").alias("token_id"), F.lit("NN").alias("pos"))
    nodes = e.select(F.lit("all").alias("corpus"), F.lit(0).alias("sentence_id"), F.col("user_id").alias("node")).distinct()
    none = spark.createDataFrame([], "corpus string, sentence_id int, node long, verb string")
    return rules.roles(GraphTables(tokens, deps), nodes, none).select(F.col("arg").alias("event_id"), F.col("node").alias("user_id"), "role")


@book(
    "first_missing_role",
    """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'click') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY ALL)
       SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN NOT a THEN 'agent' WHEN NOT b THEN 'object' WHEN NOT c THEN 'arg' END AS role FROM h WHERE NOT (a AND b AND c)""",
)
def first_missing_role(spark, sf_dir):
    """For every user and day, the first role that no event of that day fills."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    m = spark.createDataFrame([("click", "agent"), ("view", "object"), ("purchase", "arg"), ("error", "other")], "event_type string, role string")
    place = [F.col("day").alias("corpus"), F.lit(0).alias("sentence_id")]
    filled = e.join(F.broadcast(m), "event_type", "left").select(*place, F.col("user_id").alias("node"), "role", F.lit(0).cast("long").alias("arg"))
    clause = e.select(*place, F.lit(0).cast("long").alias("noun"), F.col("user_id").alias("node")).distinct()
    return rules.first_missing(filled, clause).select(F.col("node").alias("user_id"), F.col("corpus").alias("day"), "role")


@book(
    "label_text",
    """SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS label, string_agg(text, ' ' ORDER BY turn) AS comment FROM conversations GROUP BY conv_id""",
)
def label_text(spark, sf_dir):
    """Conversations as sentences: the first turn is a node with a role, every later turn hangs on it."""
    c = table(spark, sf_dir, "conversations")
    place = [F.lit("all").alias("corpus"), F.col("conv_id").alias("sentence_id")]
    tokens = c.select(*place, F.col("turn").alias("token_id"), "text", F.col("role").alias("lemma"))
    first = F.lit(0).cast("long")
    deps = c.where("turn > 0").select(*place, F.lit("basic").alias("graph"), first.alias("head"), F.col("turn").alias("tail"), F.lit("parataxis").alias("label"))
    preds = c.select(*place, first.alias("node"), F.lit("agent").alias("role"), first.alias("arg")).distinct()
    rels = spark.createDataFrame([], "corpus string, sentence_id long, head long, tail long, rel string")
    none = spark.createDataFrame([], "corpus string, sentence_id long, node long, verb string")
    got = rules.labels(GraphTables(tokens, deps), preds, rels, none)
    return got.select(F.col("sentence_id").alias("conv_id"), "label", "comment")


# Edges of a turn's words by their place: the label of word i hangs it on word i // 2.
_KINDS = ("amod", "ccomp", "advmod", "conj", "det", "aux", "nn", "cc", "prep", "auxpass", "rcmod")


def _pick(at: str) -> str:
    return "CASE " + " ".join(f"WHEN {at} % {len(_KINDS)} = {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@book(
    "constituent_text",
    f"""WITH RECURSIVE w AS (SELECT conv_id, turn, unnest(string_split_regex(trim(text), '[ \t\n\r\f]+')) AS word, unnest(range(1, len(string_split_regex(trim(text), '[ \t\n\r\f]+')) + 1)) AS i FROM conversations),
        e AS (SELECT conv_id, turn, i, i // 2 AS up, {_pick('i')} AS label FROM w WHERE i > 1),
        d AS (SELECT conv_id, turn, up AS top, i FROM e WHERE (up = 1 AND label NOT IN ({', '.join(map(repr, rules.NOT_IN_VERB))})) OR (up = 2 AND label NOT IN ({', '.join(map(repr, rules.NOT_IN_ARG))}))
          UNION ALL SELECT d.conv_id, d.turn, d.top, e.i FROM d JOIN e ON e.conv_id = d.conv_id AND e.turn = d.turn AND e.up = d.i),
        a AS (SELECT conv_id, turn, top, i FROM d UNION ALL SELECT conv_id, turn, i, i FROM w WHERE i <= 2)
        SELECT a.conv_id, a.turn, CAST(a.top AS INTEGER) AS node, (SELECT lower(x.word) FROM w x WHERE x.conv_id = a.conv_id AND x.turn = a.turn AND x.i = a.top) AS label,
               string_agg(w.word, ' ' ORDER BY a.i) AS comment
        FROM a JOIN w ON w.conv_id = a.conv_id AND w.turn = a.turn AND w.i = a.i GROUP BY a.conv_id, a.turn, a.top""",
)
def constituent_text(spark, sf_dir):
    """Words of a turn as a tree: texts of its root as a verb and of its second word as an argument, with
    the edges left out that either does not follow from its own node."""
    c = table(spark, sf_dir, "conversations")
    word = F.split(F.trim("text"), "[ \\t\\n\\r\\f]+")
    place = [F.col("conv_id").cast("string").alias("corpus"), F.col("turn").alias("sentence_id")]
    w = c.select(*place, F.posexplode(word).alias("n", "text")).withColumn("token_id", F.col("n") + 1)
    tokens = w.select(*PLACE, "token_id", "text", F.lower("text").alias("lemma"))
    i = F.col("token_id")
    label = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), i % len(_KINDS) + 1)
    deps = w.where("token_id > 1").select(*PLACE, F.lit("basic").alias("graph"), F.floor(i / 2).cast("int").alias("head"), i.alias("tail"), label.alias("label"))
    preds = w.where("token_id = 2").select(*PLACE, F.lit(1).alias("node"), F.lit("object").alias("role"), i.alias("arg"))
    rels = w.where("token_id = 1").select(*PLACE, i.alias("head"), i.alias("tail"), F.lit("r").alias("rel"))
    none = spark.createDataFrame([], "corpus string, sentence_id long, node int, verb string")
    # One-word turns have no argument; their word is an end of a relation.
    got = rules.labels(GraphTables(tokens, deps), preds, rels, none)
    return got.select(F.col("corpus").cast("long").alias("conv_id"), F.col("sentence_id").alias("turn"), "node", "label", "comment")


# Events as a graph that every rule and fix-up meets: an event's properties and its edges to events of
# the same user are picked from these lists by its number.
_WORDS = ("must", "help", "way", "part", "cause", "necessary", "so", "when", "go", "see", "example", "by", "for", "in", "allow", "thing", "called", "used", "eat")
_TAGS = ("VB", "VBG", "NN", "NNS", "IN", "VBZ", "MD")
_NAMES = ("DATE", "TIME", "PLACE")
_DEPS = (
    "xcomp", "ccomp", "vmod", "prepc_by", "auxpass", "advcl", "csubjpass", "nsubjpass", "rcmod", "prep_by", "mark", "aux", "cop", "csubj", "prep_of", "nsubj", "det",
    "partmod", "infmod", "agent", "advmod", "conj_and", "prep", "dep", "dobj", "tmod", "pobj", "prep_for",
)
_STEPS = (1, 2, 3, 5, 8, 13, 21)
# An edge goes from an event to the one ``step`` places before it; picks are by products of numbers.
_PICK = {"text": (_WORDS, 7), "lemma": (_WORDS, 11), "pos": (_TAGS, 13)}


def _sql_list(x) -> str:
    return f"[{', '.join(map(repr, x))}]"


_EVENT_GRAPH = f"""n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  tokens AS (SELECT 'e' AS corpus, user_id AS sentence_id, event_id AS token_id, {', '.join(f"{_sql_list(w)}[event_id * {m} // 5 % {len(w)} + 1] AS {c}" for c, (w, m) in _PICK.items())},
    CASE WHEN event_id % 4 < 3 THEN {_sql_list(_NAMES)}[event_id % 4 + 1] END AS ne_type FROM events),
  s AS (SELECT a.user_id, a.event_id AS head, b.event_id AS tail, a.k - b.k AS step FROM n a JOIN n b ON a.user_id = b.user_id AND a.k - b.k IN {_STEPS}),
  d0 AS (SELECT DISTINCT 'e' AS corpus, user_id AS sentence_id, CASE WHEN (head + step) % 3 = 0 THEN 'basic' ELSE 'dep' END AS graph, head, tail,
    {_sql_list(_DEPS)}[(head * step * 17 + tail) // 3 % {len(_DEPS)} + 1] AS label FROM s)"""


def _event_graph(spark, sf_dir) -> GraphTables:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    pick = lambda words, at: F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))
    place = [F.lit("e").alias("corpus"), F.col("user_id").alias("sentence_id")]
    i = F.col("event_id")
    made = [pick(w, F.floor(i * m / 5)).alias(c) for c, (w, m) in _PICK.items()]
    tokens = e.select(*place, i.alias("token_id"), *made, F.when(i % 4 < 3, pick((*_NAMES, "-"), i % 4)).alias("ne_type"))
    back = Window.partitionBy("user_id").orderBy("event_id")
    ahead = e.select("user_id", i.alias("head"), *[F.lag("event_id", s).over(back).alias(f"_{s}") for s in _STEPS])
    steps = ahead.select("user_id", "head", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"_{s}").alias("tail")) for s in _STEPS])).alias("s"))
    steps = steps.select(*place, "head", "s.tail", "s.step").where("tail is not null")
    graph_ = F.when((F.col("head") + F.col("step")) % 3 == 0, "basic").otherwise("dep")
    label = pick(_DEPS, F.floor((F.col("head") * F.col("step") * 17 + F.col("tail")) / 3))
    return GraphTables(tokens, steps.select(*PLACE, graph_.alias("graph"), "head", "tail", label.alias("label")).distinct())


def _fixed_sql() -> str:
    """CTEs d1 to d5: the edges after each fix-up."""
    out = []
    for k, (atoms, head, tail, before, var) in enumerate(rules.FIX_UPS, 1):
        label = f"'{before}' || {{{var}}}" if var else f"'{before}'"
        new = as_sql(atoms, {"head": f"{{{head}}}", "tail": f"{{{tail}}}", "label": label}, f"d{k - 1}")
        out.append(f"d{k} AS (SELECT * FROM d{k - 1} UNION SELECT corpus, sentence_id, 'dep', head, tail, label FROM ({new}))")
    return ", ".join(out)


def _relations_sql() -> str:
    """CTE found: every rule over the fixed edges (d5)."""
    parts = [f"SELECT *, '{rel}' AS rel, '{rule}' AS rule_id FROM ({as_sql(atoms, {'head': '{root}', 'tail': '{comp}'}, 'd5')})" for rule, rel, atoms in rules.RULES]
    return "found AS (" + " UNION ALL ".join(parts) + ")"


@book("fix_ups", f"WITH {_EVENT_GRAPH}, {_fixed_sql()} SELECT sentence_id, graph, head, tail, label FROM (SELECT * FROM d5 EXCEPT SELECT * FROM d0)")
def fix_ups(spark, sf_dir):
    """Edges that the five fix-ups add, each seeing those of the ones before."""
    g = _event_graph(spark, sf_dir)
    columns = [*PLACE, "graph", "head", "tail", "label"]
    return rules.fix(g).deps.select(*columns).subtract(g.deps.select(*columns)).drop("corpus")


@book(
    "relation_rules",
    f"""WITH {_EVENT_GRAPH}, {_fixed_sql()}, {_relations_sql()},
        pairs AS (SELECT sentence_id, head AS node, tail AS other FROM d5 WHERE graph = 'dep' AND label = 'conj_and' UNION ALL SELECT sentence_id, tail, head FROM d5 WHERE graph = 'dep' AND label = 'conj_and'),
        c AS (SELECT sentence_id, node, min(other) AS conj FROM pairs GROUP BY ALL),
        h AS (SELECT * FROM found UNION ALL SELECT f.corpus, f.sentence_id, c.conj, f.tail, f.rel, f.rule_id FROM found f JOIN c ON c.sentence_id = f.sentence_id AND c.node = f.head),
        t AS (SELECT * FROM h UNION ALL SELECT h.corpus, h.sentence_id, h.head, c.conj, h.rel, h.rule_id FROM h JOIN c ON c.sentence_id = h.sentence_id AND c.node = h.tail)
        SELECT DISTINCT sentence_id, head, tail, rel, rule_id FROM t""",
)
def relation_rules(spark, sf_dir):
    """Fix-ups, all 21 rules and the expansion over conjuncts."""
    return rules.relations(rules.fix(_event_graph(spark, sf_dir))).drop("corpus")


@book(
    "path_arguments",
    f"""WITH {_EVENT_GRAPH} SELECT sentence_id, 'has' AS rel, arg1, arg2 FROM ({as_sql([Edge("v3", "nsubj", "v1", "basic"), Edge("v3", "dobj", "v2", "basic"), Differ("v1", "v2")], {"arg1": "{v1}", "arg2": "{v2}"}, "d0")})""",
)
def path_arguments(spark, sf_dir):
    """A mined path pattern compiled to joins."""
    return path_candidates(_event_graph(spark, sf_dir), "has => (nsubj(_3, _1), dobj(_3, _2))").drop("corpus")


@book("relation_rules_surrogate")
def relation_rules_surrogate(spark, sf_dir):
    """Fix-ups and all 21 relation rules over surrogate parses of every document (rows only)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = rules.fix(annotate.surrogate(annotate.sentences(docs, "text", "doc_id")))
    return rules.relations(g).select(*PLACE, "head", "tail", "rel", "rule_id")


@book("question_rules")
def question_rules(spark, sf_dir):
    """Every document as a question about the words at the start of its text, over surrogate parses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = annotate.surrogate(annotate.sentences(docs, "text", "doc_id"))
    g = GraphTables(cut(g.tokens), cut(g.deps))  # many rules read them
    focus = docs.select(F.col("doc_id").cast("string").alias("corpus"), F.array_join(F.slice(F.split(F.trim("text"), "[ \\t\\n\\r\\f]+"), 1, 2), " ").alias("focus"))
    rels = cut(rules.relations(g))
    none = spark.createDataFrame([], "corpus string, sentence_id int, node int, verb string")
    ends = rels.select(*PLACE, F.col("head").alias("node")).unionByName(rels.select(*PLACE, F.col("tail").alias("node")))
    preds = rules.roles(g, ends, none)
    # the focus may be any token, so every token has a name
    named = g.tokens.select(*PLACE, F.col("token_id").alias("node"), F.col("lemma").alias("label"), F.col("text").alias("comment"))
    return rules.question_rules(g, rels, named, preds, focus)


@book("pattern_arguments")
def pattern_arguments(spark, sf_dir):
    """A mined path pattern compiled to joins over surrogate parses (rows only)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = annotate.surrogate(annotate.sentences(docs, "text", "doc_id"))
    return path_candidates(g, "has => (dobj(_3, _1), dobj(_3, _2))")
