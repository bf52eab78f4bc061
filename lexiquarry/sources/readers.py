"""Readers: every input becomes a DataFrame with explicit columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions.text import html_text, strip_controls

#: Lines that only frame a bracketed JSON file.
FRAMING = ("", "[", "]", ",")

TOKEN = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("string", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("lemma", T.StringType()),
    ]
)
PREPROCESSED = T.StructType(
    [
        T.StructField("definition_corpus", T.StringType()),
        T.StructField("raw_definition_id", T.LongType()),
        T.StructField("raw_definition", T.StringType()),
        T.StructField("defined_term", T.StringType()),
        T.StructField("word_class", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("meta", T.ArrayType(T.StringType())),
    ]
)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file or the files of one directory (not below it): (source, line_no, line).

    Files are read whole so that line numbers are exact; ``source`` is the file's name.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), "value")
    body = F.regexp_replace(F.col("value"), r"\r?\n$", "")
    return files.select("source", F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Large line files, splittable: (source, line). Line numbers are not known without a pass."""
    return spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("value").alias("line"))


def memory_lines(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """In-memory sources (bounded: request bodies, test inputs)."""
    rows = [(k, i, line) for k, v in texts.items() for i, line in enumerate(v.split("\n"))]
    return spark.createDataFrame(rows, "source string, line_no int, line string")


def stdin_lines(spark: SparkSession, stream=None) -> DataFrame:
    """Standard input of the driver, or another open text stream, as one source (bounded: it is read whole)."""
    import sys

    return memory_lines(spark, {"stdin": (stream or sys.stdin).read().removesuffix("\n")})


def corpus_name(c):
    """A description up to its last '.', if that is not its first character."""
    return F.regexp_replace(c, r"^(.+)\.[^.]*$", "$1")


def bracketed_json(lines: DataFrame, schema, line: str = "line") -> DataFrame:
    """Bracketed JSON, one object a line: framing lines are skipped, a bad object is an error."""
    body = F.regexp_replace(strip_controls(F.col(line)), ",$", "")
    rows = lines.where(~strip_controls(F.col(line)).isin(*FRAMING)).select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("_j"))
    return rows.select("_j.*")


def tab_dictionary(lines: DataFrame) -> DataFrame:
    """``term TAB class TAB definition``; lines of fewer fields go."""
    f = F.split("line", "\t")
    keep = lines.where(F.size(f) >= 3)
    cols = {n: strip_controls(F.get(f, F.lit(i))) for i, n in enumerate(("term", "word_class", "definition"))}
    return keep.withColumns(cols).drop("line")


def tagged_dictionary(lines: DataFrame) -> DataFrame:
    """``id TAB "<term>..<_pos>..<_source>..text"``: (def_id, term, word_class, dictionary, definition)."""
    shape = r'^([^\t]+)\t"?<(.+)>.*?<_(.+?)>.*?<_(.+?)>(.*?)"?$'
    got = {n: F.regexp_extract("line", shape, i + 1) for i, n in enumerate(("def_id", "term", "word_class", "dictionary", "definition"))}
    out = lines.withColumns({k: strip_controls(v) for k, v in got.items()}).drop("line")
    return out.where((F.col("term") != "") & (F.col("word_class") != "") & (F.col("dictionary") != "") & (F.col("definition") != ""))


#: Strided tuples: where they begin, how far apart, and the offsets of their four fields.
STRIDE_START, STRIDE = 9, 12
STRIDE_FIELDS = {"arg1": 0, "kp": 1, "arg2": 2, "sen": 6}


def strided(lines: DataFrame, line: str = "line", sep: str = "\t", *keep: str) -> DataFrame:
    """Tuples packed side by side in a row: one output row per tuple. A row is cut once, and a tuple takes
    its fields along, not the whole row's."""
    last = lambda f: F.size(f) - STRIDE_START
    made = lambda f: F.transform(
        F.sequence(F.lit(STRIDE_START), last(f), F.lit(STRIDE)), lambda at: F.struct(at.alias("at"), *[F.get(f, at + o).alias(n) for n, o in STRIDE_FIELDS.items()])
    )
    each = F.get(F.transform(F.array(F.split(F.col(line), sep)), lambda f: F.when(last(f) >= STRIDE_START, made(f))), F.lit(0))
    return lines.select(*keep, F.explode(each).alias("_t")).select(*keep, "_t.*")


def id_sentences(lines: DataFrame) -> DataFrame:
    """``id TAB sentence``; rows of fewer columns go."""
    f = F.split("line", "\t")
    return lines.where(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).alias("sen"))


LABELED = ("sid", "sentence", "disrel", "relphrase", "arg1", "arg2", "label")


def labeled(lines: DataFrame) -> DataFrame:
    """Labelled instances: lower-cased, apostrophes deleted, trimmed; the 7th column may be missing."""
    f = F.split(F.replace(F.lower("line"), F.lit("'"), F.lit("")), "\t")
    rows = lines.where(~F.lower("line").startswith("sid\t")).where(F.size(f) >= 6)
    return rows.select(*[F.trim(F.get(f, F.lit(i))).alias(n) for i, n in enumerate(LABELED)])


def counts(lines: DataFrame) -> DataFrame:
    """``entity TAB count``."""
    f = F.split("line", "\t")
    return lines.where(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("entity"), F.get(f, F.lit(1)).try_cast("long").alias("n"))


def phrase_counts(lines: DataFrame) -> DataFrame:
    """``phrase TAB _ TAB _ TAB count``."""
    f = F.split("line", "\t")
    return lines.where(F.size(f) >= 4).select(F.get(f, F.lit(0)).alias("phrase"), F.get(f, F.lit(3)).try_cast("long").alias("n"))


def weights(spark: SparkSession, path: str) -> dict[str, float]:
    """A model's ``name TAB weight`` file (bounded by its feature list) as a dict; '#' lines are comments."""
    rows = spark.read.text(path).where(F.col("value").contains("\t") & ~F.col("value").startswith("#")).collect()
    return {k: float(v) for k, v in (r.value.split("\t")[:2] for r in rows)}


def pattern_weights(lines: DataFrame) -> DataFrame:
    """``name=relation => (paths) TAB weight`` with weight > 0: (disrel, pattern, weight)."""
    shape = r"^[^=]*=(.*?) => \((.*)\)\t(-?[0-9.eE]+)$"
    out = lines.where(F.col("line").rlike(shape)).select(
        F.regexp_extract("line", shape, 1).alias("disrel"), F.regexp_extract("line", shape, 2).alias("pattern"), F.regexp_extract("line", shape, 3).cast("double").alias("weight")
    )
    return out.where("weight > 0").distinct()


def blocks(lines: DataFrame, by: list[str], order: str = "line_no") -> DataFrame:
    """Blocks of a ``;;; sentence`` line and its ``%`` lines: (by, line_no, sentence, disrel, phrase, arg1, arg2)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith(";;;")
    carried = lines.withColumn("sentence", F.last(F.when(head, F.trim(F.expr("substring(line, 4)"))), True).over(w))
    f = F.split(F.expr("substring(line, 2)"), "\t")
    shape = r'"?([^"]*)"?/(.*)$'
    return carried.where(F.col("line").startswith("%") & (F.size(f) >= 3)).select(
        *by,
        order,
        "sentence",
        F.trim(F.regexp_extract(F.get(f, F.lit(1)), shape, 2)).alias("disrel"),
        F.regexp_extract(F.get(f, F.lit(1)), shape, 1).alias("phrase"),
        F.trim(F.get(f, F.lit(0))).alias("arg1"),
        F.trim(F.get(f, F.lit(2))).alias("arg2"),
    )


def pages_text(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """Visible text of stored pages; nothing is fetched."""
    return pages.select(*keep, html_text(F.col(html)).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(root: str, uri: str) -> str:
    """``store://file/dataset[/document]`` -> a path below ``root``; other schemes are refused."""
    scheme, _, rest = uri.partition("://")
    kind, _, name = rest.partition("/")
    if scheme != "store" or kind != "file" or not name or ".." in name.split("/"):
        raise ValueError(f"not a dataset URI: {uri}")
    return f"{root.rstrip('/')}/{name}"


#: One triple of a Turtle line: prefixed or absolute subject and predicate, object of any kind.
TRIPLE = r'^(\S+)\s+(\S+)\s+("(?:[^"\\]|\\.)*"(?:\^\^\S+)?|\S+)\s*[.;]\s*$'


def turtle(lines: DataFrame) -> DataFrame:
    """Turtle with one triple a line (as :func:`lexiquarry.sources.sinks.turtle` writes): (s, p, o, o_kind)."""
    rows = lines.where(F.col("line").rlike(TRIPLE))
    o = F.regexp_extract("line", TRIPLE, 3)
    literal = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(literal, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    kind = F.when(o.contains("^^xsd:integer") & o.startswith('"'), "integer").when(o.startswith('"'), "string").otherwise("uri")
    return rows.select(
        F.regexp_extract("line", TRIPLE, 1).alias("s"), F.regexp_extract("line", TRIPLE, 2).alias("p"), F.when(kind == "uri", o).otherwise(plain).alias("o"), kind.alias("o_kind")
    )


_TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<prefix>@prefix\s+([\w.-]*):\s*<([^>]*)>\s*\.)|<(?P<uri>[^>\s]*)>
      |(?P<long>\"{3}(?P<text3>(?:[^"\\]|\\.|"(?!""))*)\"{3}|"(?P<text>(?:[^"\\\n]|\\.)*)")(?:\^\^(?:<(?P<type>[^>]*)>|(?P<short>[\w.-]*:[\w.-]*))|@[\w-]+)?
      |(?P<number>[+-]?\d+(?![\w.:]*:))|(?P<name>[\w.-]*:[\w./%-]*[\w/%-]|[\w.-]*:|a(?=[\s<]))|(?P<mark>[.;,])""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def parse_turtle(text: str) -> list[tuple[str, str, str, str]]:
    """(s, p, o, o_kind) of a Turtle text with prefixes, ``;`` and ``,`` lists, comments, literals and ``a``.

    Prefixed names become whole URIs if their prefix is declared, else stay as written.
    """
    prefixes: dict[str, str] = {}
    full = lambda n: prefixes[n.partition(":")[0]] + n.partition(":")[2] if n.partition(":")[0] in prefixes else n
    out, terms, at = [], [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: not Turtle: {text[at : at + 20]!r}")
        at = m.end()
        if m["skip"]:
            continue
        if m["prefix"]:
            prefixes[m[3]] = m[4]
        elif m["mark"]:
            if len(terms) != 3:
                if m["mark"] in ";." and len(terms) in (0, 1):  # an empty list entry before the end
                    terms = terms if m["mark"] == ";" else []
                    continue
                raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: a triple has three parts")
            (s, _), (p, _), (o, kind) = terms
            out.append((s, p, o, kind))
            terms = {".": [], ";": terms[:1], ",": terms[:2]}[m["mark"]]
        elif m["long"]:
            body = m["text3"] if m["text3"] is not None else m["text"]
            body = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if e[1][0] == "u" and len(e[1]) == 5 else _ESCAPES.get(e[1], e[1]), body, flags=re.S)
            terms.append((body, "integer" if (m["type"] or m["short"] or "").endswith("integer") else "string"))
        elif m["number"]:
            terms.append((m["number"], "integer"))
        else:
            uri = m["uri"] if m["uri"] is not None else "rdf:type" if m["name"] == "a" else full(m["name"])
            terms.append((uri, "uri"))
    if terms:
        raise ValueError("the last triple is not closed")
    return out


def turtle_documents(texts: DataFrame) -> DataFrame:
    """Whole Turtle texts (source, value) as (source, s, p, o, o_kind); a text that is not Turtle is an error."""
    from lexiquarry.session import ship

    ship(texts.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(s, *t) for s, v in zip(b["source"], b["value"]) for t in parse_turtle(v or "")]
            yield pd.DataFrame(rows, columns=["source", "s", "p", "o", "o_kind"])

    return texts.select("source", "value").mapInPandas(run, "source string, s string, p string, o string, o_kind string")


#: A token vertex: namespace#corpus/sentence_token.
VERTEX = r"/id#([^/]+)/(\d+)_(\d+)$"


def vertex(c) -> dict:
    """Corpus, sentence and token of a vertex URI."""
    return {
        "corpus": F.regexp_extract(c, VERTEX, 1),
        "sentence_id": F.regexp_extract(c, VERTEX, 2).try_cast("int"),
        "token_id": F.regexp_extract(c, VERTEX, 3).try_cast("int"),
    }
