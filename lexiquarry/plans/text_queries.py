"""Queries over lines, dictionaries, pages and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions import text as X
from lexiquarry.functions.features import definition_features, score
from lexiquarry.functions.ranks import totals_before, with_offsets
from lexiquarry.operators import annotate, cascade, definitions, lines, rule_files
from lexiquarry.plans._book import Book
from lexiquarry.sources import readers, sinks
from lexiquarry.session import cut
from lexiquarry.sources.readers import table

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

_LINES = """SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents"""

# The clean-up chain of definitions as SQL, from the column ``line``.
_UNESC = "line"
for _ in range(2):
    for _a, _b in X.ENTITIES:
        _UNESC = f"replace({_UNESC}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
_PLAIN = f"regexp_replace(replace({_UNESC}, chr(160), ' '), '^#', '')"
_CLEAN = f"""
replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PLAIN},
  '\\{{\\{{[^}}]*\\}}\\}}([ \\t\\n\\r\\f]*[,;][ \\t\\n\\r\\f]*\\{{\\{{[^}}]*\\}}\\}})*', '', 'g'),
  '\\([^)]*\\)', '', 'g'),
  '(^|[^A-Za-z0-9_])''([^'']+)''([^A-Za-z0-9_]|$)', '\\1\\2\\3', 'g'),
  '(^|[^A-Za-z0-9_])"([^"]+)"([^A-Za-z0-9_]|$)', '\\1\\2\\3', 'g'), '''''', ''), '""', '')"""
_TRIM = r"regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@book(
    "definition_preprocess",
    f"""WITH l AS ({_LINES}), n AS (
          SELECT l.*, d.lang AS word_class, row_number() OVER (ORDER BY l.doc_id, l.line_no) AS raw_definition_id
          FROM l JOIN documents d ON l.doc_id = d.doc_id WHERE lower(d.lang) IN ('en', 'fr')
        ), p AS (
          SELECT raw_definition_id, doc_id, word_class,
                 list_filter(list_transform(string_split({_CLEAN}, ';'), lambda x: {_TRIM}), lambda x: length(x) > 0) AS parts,
                 regexp_extract_all({_PLAIN}, '\\{{\\{{([^}}]*)\\}}\\}}', 1) AS meta
          FROM n
        )
        SELECT raw_definition_id, doc_id, word_class, CAST(unnest(range(len(parts))) AS INTEGER) AS alternate_no, unnest(parts) AS alternate,
               array_to_string(meta, '|') AS meta FROM p""",
)
def definition_preprocess(spark, sf_dir):
    """Lines of documents as raw definitions: class filter, numbering, clean-up, one row per alternative.

    Lines are numbered by their place in the document and the lines before the document; only ids and
    counts are added up, texts stay where they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("word_class"))
    docs = definitions.of_classes(docs, ["EN", "FR"]).where("text is not null")
    sizes = docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    docs = with_offsets(docs, cut(totals_before(sizes, "doc_id", "n", "lines_before")), "doc_id")
    rows = lines.explode_lines(docs, "text", "doc_id", "word_class", "lines_before")
    rows = rows.withColumn("raw_definition_id", F.col("lines_before") + F.col("line_no") + 1).drop("lines_before")
    made = definitions.preprocess(rows, "line").withColumn("meta", F.array_join("meta", "|"))
    return made.select("raw_definition_id", "doc_id", "word_class", F.posexplode("parts").alias("alternate_no", "alternate"), "meta")


@book("cat_lines", _LINES)
def cat_lines(spark, sf_dir):
    return lines.cat(lines.explode_lines(table(spark, sf_dir, "documents"), "text", "doc_id")).select("doc_id", "line", "line_no")


@book(
    "merge_sources",
    """SELECT 0 AS source_no, doc_id AS item, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
       UNION ALL SELECT 1, item_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER), unnest(string_split(text, chr(10))) FROM benchmark""",
)
def merge_sources(spark, sf_dir):
    a = lines.explode_lines(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item"), "text", "item")
    b = lines.explode_lines(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "item"), "text", "item")
    return lines.merge(a, b).select("source_no", "item", "line_no", "line")


@book(
    "corpus_split",
    """WITH s AS (
         SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p,
                row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
       SELECT user_id, event_id, event_type,
              CAST(sum(CASE WHEN n = 1 OR p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS section_index
       FROM s""",
)
def corpus_split(spark, sf_dir):
    """A new section every time a user's event type changes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return lines.split_runs(rows, ["user_id"], ["event_id"], "event_type")


@book(
    "english_weave",
    """WITH n AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
       SELECT conv_id, n // 2 AS pair, max(CASE WHEN n % 2 = 0 THEN text END) AS first, max(CASE WHEN n % 2 = 1 THEN text END) AS second
       FROM n GROUP BY conv_id, n // 2""",
)
def english_weave(spark, sf_dir):
    return lines.weave(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@book(
    "fanout_capture",
    r"""SELECT event_id, u.processor, u.result, u.result IS NULL AS failed FROM (
          SELECT event_id, unnest([
            {'processor': 'upper', 'result': upper(props)},
            {'processor': 'number', 'result': CAST(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS VARCHAR)},
            {'processor': 'bare', 'result': CAST(TRY_CAST(props AS BIGINT) AS VARCHAR)}]) AS u FROM events)""",
)
def fanout_capture(spark, sf_dir):
    processors = {
        "upper": F.upper,
        "number": lambda c: F.regexp_extract(c, '"k": ([0-9]+)', 1).try_cast("long"),
        "bare": lambda c: c.try_cast("long"),
    }
    return lines.fan_out(table(spark, sf_dir, "events"), "props", processors, ["event_id"])


@book("json_lines", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS line FROM events""")
def json_lines(spark, sf_dir):
    """Framing lines between objects are skipped; objects are parsed strictly and written back."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit("["), F.to_json(F.struct("event_id", F.from_json("props", "k long").alias("p"))), F.lit(","))).alias("line"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("p", T.StructType([T.StructField("k", T.LongType())]))])
    got = readers.bracketed_json(rows, schema).select("event_id", F.col("p.k").alias("k"))
    return got.withColumn("line", F.to_json(F.struct("event_id", "k")))


@book(
    "strided_unpack",
    r"""WITH f AS (SELECT doc_id, string_split(text, ' ') AS f FROM documents),
       a AS (SELECT doc_id, f, unnest(range(9, len(f) - 9 + 1, 12)) AS i FROM f WHERE len(f) >= 18)
       SELECT doc_id, CAST(i AS INTEGER) AS "at", f[i + 1] AS arg1, f[i + 2] AS kp, f[i + 3] AS arg2, f[i + 7] AS sen FROM a""",
)
def strided_unpack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return readers.strided(docs, "text", " ", "doc_id")


_VISIBLE = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))""".replace("\\\\", "\\")


@book("html_to_text", f"SELECT page_id, url, {_VISIBLE} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return readers.pages_text(table(spark, sf_dir, "pages"), "html", "page_id", "url")


@book("meta_capture", r"""SELECT page_id, unnest(regexp_extract_all(html, '<meta ([^>]*)>', 1)) AS meta FROM pages""")
def meta_capture(spark, sf_dir):
    """All captures of a repeated group, one row each."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<meta ([^>]*)>"), F.lit(1))).alias("meta"))


@book(
    "glossary_semi",
    """SELECT doc_id, lang, source FROM documents WHERE lower(trim(source)) IN (SELECT DISTINCT lower(trim(d.source)) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""",
)
def glossary_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    terms = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("source").alias("term"))
    return definitions.in_glossary(docs, terms, "source")


@book(
    "class_check",
    """SELECT doc_id, lang, CASE WHEN lower(lang) IN ('en') THEN array_to_string(string_split(source, 'c'), '|') ELSE '' END AS extractions FROM documents""",
)
def class_check(spark, sf_dir):
    """Rows of other classes keep their row and lose their extractions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("lang").alias("word_class"), F.split("source", "c").alias("extractions"))
    return definitions.extractions_for(docs, ["EN"]).select("doc_id", "lang", F.array_join("extractions", "|").alias("extractions"))


@book(
    "post_filter",
    f"""WITH f AS (
          SELECT p_partkey, string_split(p_name, ' ')[1] AS agent, string_split(p_name, ' ')[2] AS obj, p_size % 3 AS n_modifiers FROM part
          UNION ALL SELECT p_partkey, p_brand, lower(p_brand), p_size % 2 FROM part
          UNION ALL SELECT p_partkey, p_brand, 'Someone', p_size % 2 FROM part
          UNION ALL SELECT p_partkey, p_brand, 'Thing', p_size % 2 FROM part)
        SELECT p_partkey, agent, n_modifiers,
               CASE WHEN n_modifiers = 0 AND lower(obj) IN ({', '.join(repr(x) for x in definitions.PERSONS)}) THEN 'person' ELSE obj END AS obj
        FROM f WHERE NOT (n_modifiers = 0 AND (lower(trim(agent)) = lower(obj) OR lower(obj) IN ({', '.join(repr(x) for x in definitions.EMPTY_OBJECTS)})))""",
)
def post_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = F.split("p_name", " ")
    rows = p.select("p_partkey", f.getItem(0).alias("agent"), f.getItem(1).alias("obj"), (F.col("p_size") % 3).alias("n_modifiers"))
    for obj in (F.lower("p_brand"), F.lit("Someone"), F.lit("Thing")):
        rows = rows.unionByName(p.select("p_partkey", F.col("p_brand").alias("agent"), obj.alias("obj"), (F.col("p_size") % 2).alias("n_modifiers")))
    return definitions.post_filter(rows.withColumn("rel_type", F.lit("IsA"))).select("p_partkey", "agent", "obj", "n_modifiers")


_FACTS = """SELECT lower(p_name) AS term, p_type AS word_class, p_brand AS source, p_name || ' of size ' || p_size AS alternate_definition,
            unnest(['IsA: (' || p_name || ', isa, ' || p_type || ')', 'Fact: size ' || p_size]) AS fact FROM part"""


def _facts(spark, sf_dir):
    """Parts as definitions: two tuples each, flattened."""
    p = table(spark, sf_dir, "part")
    rel = lambda kind, text: F.struct(F.lit(kind).cast("string").alias("rel_type"), text.alias("text"))
    isa = definitions.render(F.col("p_name"), F.lit("is"), F.col("p_type"), F.array().cast("array<string>"), F.lit("IsA"))
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    alternate = F.struct(F.concat("p_name", F.lit(" of "), size).alias("text"), F.array(rel("IsA", isa), rel(None, size)).alias("tuples"))
    rows = p.select(F.col("p_name").alias("term"), F.col("p_type").alias("word_class"), F.col("p_brand").alias("source"), F.array(alternate).alias("alternates"))
    return definitions.flatten(rows)


@book("facts_flat", _FACTS)
def facts_flat(spark, sf_dir):
    return _facts(spark, sf_dir)


@book(
    "term_lookup",
    f"""WITH f AS ({_FACTS}) SELECT alternate_definition, source, word_class, array_to_string(list_sort(list(DISTINCT fact)), '|') AS extractions
        FROM f WHERE term = 'red widget' GROUP BY ALL""",
)
def term_lookup(spark, sf_dir):
    got = definitions.lookup(_facts(spark, sf_dir), " Red Widget ")
    return got.withColumn("extractions", F.array_join("extractions", "|"))


@book("extraction_stats", f"WITH f AS ({_FACTS}) SELECT count(DISTINCT term) AS terms, count(DISTINCT lower(alternate_definition)) AS definitions, count(DISTINCT lower(source)) AS sources FROM f")
def extraction_stats(spark, sf_dir):
    return definitions.statistics(_facts(spark, sf_dir))


@book(
    "readable_report",
    f"""WITH f AS ({_FACTS}) SELECT term, word_class, alternate_definition,
          'DEFINITION: ' || alternate_definition || chr(10) || 'WORD CLASS: ' || word_class || chr(10) || 'EXTRACTIONS:' || chr(10) || array_to_string(list_sort(list(fact)), chr(10)) AS block
        FROM f GROUP BY term, word_class, alternate_definition""",
)
def readable_report(spark, sf_dir):
    return sinks.readable(_facts(spark, sf_dir))


# Surrogate tokens of every line of a turn: arg1, rel and arg2s by position.
_TAGS = " ".join(f"WHEN lower(w) IN ({', '.join(repr(x) for x in ws.split())}) THEN '{pos}'" for pos, ws in annotate.LEXICON.items())
_TOKENS = f"""
  l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM conversations),
  w AS (SELECT conv_id, turn, line_no, list_filter(string_split_regex(line, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM l),
  t AS (SELECT conv_id, turn, line_no, ws, list_transform(ws, lambda w: CASE WHEN NOT regexp_matches(w, '[A-Za-z0-9]') THEN '.' {_TAGS}
          WHEN regexp_matches(w, '^[0-9.,]+$') THEN 'CD' WHEN lower(w) LIKE '%ing' THEN 'VBG' WHEN lower(w) LIKE '%ed' THEN 'VBD' WHEN lower(w) LIKE '%ly' THEN 'RB'
          WHEN regexp_matches(lower(w), '(ous|ful|ive|able|al)$') THEN 'JJ' WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' WHEN lower(w) LIKE '%s' THEN 'NNS' ELSE 'NN' END) AS ps
        FROM w WHERE len(ws) >= 6)"""


def _tagged(spark, sf_dir):
    """Every line of a turn with token arrays: arg1 is tokens 0-1, rel 2-3, arg2s the rest (two at least)."""
    c = lines.explode_lines(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn")
    c = c.select("conv_id", "turn", "line_no", X.words(F.col("line")).alias("ws")).where(F.size("ws") >= 6)
    tok = F.transform("ws", lambda w, i: F.struct(i.alias("id"), w.alias("string"), annotate.tag(w).alias("pos"), annotate.lemma(w).alias("lemma")))
    t = c.select("conv_id", "turn", "line_no", tok.alias("tokens"))
    return t.select("*", F.slice("tokens", 1, 2).alias("arg1"), F.slice("tokens", 3, 2).alias("rel"), F.expr("slice(tokens, 5, size(tokens))").alias("arg2s"), F.lit("simple").alias("kind"))


_FEATURE_SQL = {
    "arg1_pronoun": "len(list_filter(ps[1:2], lambda p: p IN ('PRP', 'PRP$', 'EX'))) > 0",
    "arg2s_noun": "len(list_filter(ps[5:], lambda p: p IN ('NN', 'NNS', 'NNP', 'NNPS', 'PRP', 'PRP$'))) > 0",
    "arg1_proper": "len(list_filter(ps[1:2], lambda p: p IN ('NNP', 'NNPS'))) > 0",
    "arg2s_proper": "len(list_filter(ps[5:], lambda p: p IN ('NNP', 'NNPS'))) > 0",
    "rel_verb": "len(list_filter(ps[3:4], lambda p: p LIKE 'VB%')) > 0",
    "rel_vbz": "len(list_filter(ps[3:4], lambda p: p = 'VBZ')) > 0",
    "blacklisted": "len(list_filter(ws[5:], lambda w: w NOT IN ('word', 'something', 'piece', 'part', 'kind', 'number', 'way', 'type', 'form'))) = 0",
    "short": "len(ws) < 10",
    "long": "len(ws) >= 20",
    "arg2s_long": "len(ws) - 4 >= 10",
    "equal": "lower(array_to_string(ws[1:2], ' ')) = lower(array_to_string(ws[5:], ' '))",
    "or_before": "regexp_matches(lower(ws[4]), '^(?:or)$')",
}
_FEATURE_NAME = {
    "arg1_pronoun": "arg1 contains a pronoun or EX",
    "arg2s_noun": "arg2s contains noun",
    "arg1_proper": "arg1 contains proper noun",
    "arg2s_proper": "arg2s contains proper noun",
    "rel_verb": "rel contains verb",
    "rel_vbz": "rel contains VBZ",
    "blacklisted": "arg2s consists of blacklisted words",
    "short": "sentence contains < 10 tokens",
    "long": "sentence contains >= 20 tokens",
    "arg2s_long": "arg2s contains >= 10 tokens",
    "equal": "arg1 equals arg2s",
    "or_before": "or right before arg2s",
}


@book("token_features", f"WITH {_TOKENS} SELECT conv_id, turn, line_no, {', '.join(f'CAST({s} AS DOUBLE) AS {k}' for k, s in _FEATURE_SQL.items())} FROM t")
def token_features(spark, sf_dir):
    f = definition_features()
    return _tagged(spark, sf_dir).select("conv_id", "turn", "line_no", *[f[n].alias(k) for k, n in _FEATURE_NAME.items()])


@book(
    "logistic_score",
    f"""WITH {_TOKENS}, f AS (SELECT conv_id, turn, line_no, {', '.join(f'CAST({s} AS DOUBLE) AS {k}' for k, s in _FEATURE_SQL.items())} FROM t)
        SELECT conv_id, turn, line_no, round(1 / (1 + exp(-(-1.7849105806514818 + 1.3156797196216592 - 1.179126526712237 - 0.3110058835172233 * arg1_proper - 19.369759988810635 * equal
          - 4.44341733258207 * blacklisted + 2.0116032326487256 * arg2s_noun + 0.38164715354550843 * arg2s_proper - 0.5285279758657727 * or_before
          + 1.3231318516426451 * rel_vbz + 16.167013015487424 * rel_verb + 0.6596866166826654 * short - 0.6098126269434833 * long))), 6) AS confidence FROM f""",
)
def logistic_score(spark, sf_dir):
    """Fixed weights; features of weight 0 are not computed."""
    return _tagged(spark, sf_dir).select("conv_id", "turn", "line_no", F.round(score(), 6).alias("confidence"))


_RULES = [
    'Year := OpenRegex { <string=/[12][0-9][0-9][0-9]/> }\nAmount := OpenRegex { <string=/[0-9]+/ & !string=/[12][0-9][0-9][0-9]/>+ }',
    'Range := TypedOpenRegex { (<From>: @Year | @Amount) <string="-" | string="to"> (<To>: @Year | @Amount) }',
]


@book("rule_file_spans")
def rule_file_spans(spark, sf_dir):
    """Two levels of token rules, given as text, over every line of documents (rows only: surrogate tags)."""
    rows = lines.explode_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return rule_files.spans(rows, _RULES, cascade.surrogate_tokens, "doc_id", "line")


@book("noun_definitions")
def noun_definitions(spark, sf_dir):
    """The token cascade over every line of documents (rows only: surrogate tags)."""
    docs = table(spark, sf_dir, "documents")
    rows = lines.explode_lines(docs, "text", "doc_id").where(F.length("line") > 0)
    rows = rows.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("term"), F.explode(annotate_sentences(F.col("line"))).alias("part"))
    return cascade.extract(rows)


def annotate_sentences(c):
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])[ \t\n\r\f]+"), F.trim), lambda s: s != "")


@book(
    "turtle_round_trip",
    """SELECT 'n:' || n_nationkey AS s, 'in:region' AS p, 'r:' || n_regionkey AS o, 'uri' AS o_kind FROM nation
       UNION ALL SELECT 'n:' || n_nationkey, 'rdfs:label', n_name || ' "x" \\', 'string' FROM nation
       UNION ALL SELECT 'n:' || n_nationkey, 'token:begin', CAST(n_nationkey AS VARCHAR), 'integer' FROM nation""".replace("\\\\", "\\"),
)
def turtle_round_trip(spark, sf_dir):
    """Triples written as Turtle lines and read again."""
    n = table(spark, sf_dir, "nation")
    s = F.concat(F.lit("n:"), F.col("n_nationkey").cast("string"))
    t = n.select(s.alias("s"), F.lit("in:region").alias("p"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("o"), F.lit("uri").alias("o_kind"))
    t = t.unionByName(n.select(s.alias("s"), F.lit("rdfs:label").alias("p"), F.concat("n_name", F.lit(' "x" \\')).alias("o"), F.lit("string").alias("o_kind")))
    t = t.unionByName(n.select(s.alias("s"), F.lit("token:begin").alias("p"), F.col("n_nationkey").cast("string").alias("o"), F.lit("integer").alias("o_kind")))
    return readers.turtle(sinks.turtle(t))
