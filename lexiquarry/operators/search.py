"""Phrase search over token arrays, and bootstrapping of relation phrases."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-case search tokens: runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def phrase_tokens(phrase: str) -> list[str]:
    """Search tokens of a phrase: quotes, punctuation and case do not matter."""
    return [w for w in re.split("[^a-z0-9]+", phrase.lower()) if w]


def _hits(found: Column, phrase: str) -> Column:
    """Places in a token array where the phrase's tokens occur in succession; matches may overlap."""
    padded = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    return F.regexp_count(padded, F.lit(f"(?= {'  '.join(phrase_tokens(phrase))} )")).cast("long")


def _counted(phrase: str):
    return lambda t: F.struct(_hits(t, phrase).alias("hits"), F.size(t).alias("size"))


def phrase_hits(c: Column, phrase: str) -> Column:
    """How often the phrase's tokens occur in succession in a text; matches may overlap."""
    return _hits(tokens(c), phrase)


def search(docs: DataFrame, fields: dict[str, str], k: int, doc_id: str, result: str, rarity: bool = False) -> DataFrame:
    """Top ``k`` rows that contain every field's phrase, then without repeated ``result`` texts.

    Score: sum over fields of sqrt(hits / number of tokens), rounded; ties go to the smaller id. With
    ``rarity`` a field counts by the square of 1 + ln(rows / (rows with its phrase + 1)), counted in
    one pass. A top-k: only ``k`` rows per task are kept. A phrase without a token is an error.
    """
    if not fields or not all(phrase_tokens(p) for p in fields.values()):
        raise ValueError("empty query")
    weight = dict.fromkeys(fields, 1.0)
    if rarity:
        n = docs.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(phrase_hits(F.col(f), p) > 0).alias(f) for f, p in fields.items()]).first()
        weight = {f: (1.0 + math.log(max(1, n["_all"]) / (n[f] + 1.0))) ** 2 for f in fields}
    for field, phrase in fields.items():  # a cheap test before the exact one
        docs = docs.where(F.lower(field).contains(phrase_tokens(phrase)[0]))
    s, cond = F.lit(0.0), F.lit(True)
    for i, (field, phrase) in enumerate(fields.items()):
        # A text is divided once: the token array is bound, not repeated for count and length.
        docs = docs.withColumn(f"_f{i}", F.get(F.transform(F.array(tokens(F.col(field))), _counted(phrase)), F.lit(0)))
        cond = cond & (F.col(f"_f{i}.hits") > 0)
        s = s + F.lit(weight[field]) * F.sqrt(F.col(f"_f{i}.hits") / F.col(f"_f{i}.size"))
    top = docs.where(cond).withColumn("score", F.round(s, 6)).drop(*[f"_f{i}" for i in range(len(fields))]).orderBy(F.desc("score"), doc_id).limit(k)
    w = Window.partitionBy(result).orderBy(F.desc("score"), doc_id)
    return top.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def index(docs: DataFrame, doc_id: str, *fields: str) -> DataFrame:
    """Inverted index (term, field, doc_id, positions), for writing bucketed by term."""
    out = None
    for f in fields:
        t = docs.select(F.col(doc_id).alias("doc_id"), F.lit(f).alias("field"), F.posexplode(tokens(F.col(f))).alias("pos", "term"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("term", "field", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def instances(docs: DataFrame, seeds: DataFrame, phrase: str = "kp") -> DataFrame:
    """Rows of ``docs`` (arg1, kp, arg2, sen) whose phrase is a seed (disrel, kp): adds ``disrel``.

    Equality on normalised phrases: a hash join, whichever side is small.
    """
    norm = lambda c: F.array_join(tokens(F.col(c)), " ")
    s = seeds.select("disrel", norm("kp").alias("_k")).distinct()
    return docs.withColumn("_k", norm(phrase)).join(s, "_k").drop("_k").distinct()


def frequent_pairs(rows: DataFrame, entity_counts: DataFrame, least: int, stopwords: DataFrame) -> DataFrame:
    """Rows whose two arguments are frequent enough and no stopwords (exact, lower case)."""
    good = entity_counts.where(F.col("n") >= least).select(F.lower("entity").alias("_e")).distinct()
    good = good.join(stopwords.select(F.lower("word").alias("_e")).distinct(), "_e", "left_anti")
    for a in ("arg1", "arg2"):
        rows = rows.join(good, F.lower(a) == F.col("_e"), "left_semi")
    return rows


def sentence_holds(sen: Column, arg1: Column, arg2: Column) -> Column:
    """The part of a sentence with both arguments: after the last ':' if both are there, else the
    whole sentence if they are in it, else null. Arguments are literal, case does not matter."""
    has = lambda s: F.lower(s).contains(F.lower(arg1)) & F.lower(s).contains(F.lower(arg2))
    tail = F.trim(F.substring_index(sen, ":", -1))
    return F.when(has(tail), tail).when(has(sen), sen)


def capped(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows of each group: a top-k per group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def good_phrases(phrases: DataFrame, least: int, most: int, stopwords: DataFrame) -> DataFrame:
    """The ``most`` most frequent phrases of at least ``least`` occurrences that are no stopwords."""
    keep = phrases.where(F.col("n") >= least).join(stopwords.select(F.lower("word").alias("_w")).distinct(), F.lower("phrase") == F.col("_w"), "left_anti")
    return keep.orderBy(F.desc("n"), "phrase").limit(most)


def with_share(rows: DataFrame, by: list[str], count: str, name: str) -> DataFrame:
    """Adds each row's share of its group's total (group totals are joined, groups are not gathered)."""
    total = rows.groupBy(*by).agg(F.sum(count).alias("_t"))
    return rows.join(total, by).withColumn(name, F.col(count) / F.col("_t")).drop("_t")


def phrase_frequency(rows: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(disrel, kp, n, share) over rows (disrel, kp, ..).

    With ``corpus`` (kp, .., a row per occurrence) also corpus_n and corpus_share: how often the phrase
    occurs there, and its share of the occurrences of all phrases of the relation.
    """
    out = with_share(rows.groupBy("disrel", "kp").agg(F.count(F.lit(1)).alias("n")), ["disrel"], "n", "share")
    if corpus is None:
        return out
    found = corpus.groupBy("kp").agg(F.count(F.lit(1)).alias("corpus_n"))
    out = out.join(found, "kp", "left").withColumn("corpus_n", F.coalesce("corpus_n", F.lit(0).cast("long")))
    return with_share(out, ["disrel"], "corpus_n", "corpus_share").select("disrel", "kp", "n", "share", "corpus_n", "corpus_share")


def pattern_frequency(rows: DataFrame) -> DataFrame:
    """(disrel, pattern, n); a pattern is the sorted, joined array ``steps``."""
    return rows.groupBy("disrel", F.array_join(F.array_sort("steps"), "|").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def render_pattern(steps: Column) -> Column:
    """``dep(x,"label",y)`` per step (head, label, tail) of an array, sorted; variables are a, b, c, ..
    by their first place in the steps as given."""
    ends = F.array_distinct(F.flatten(F.transform(steps, lambda s: F.array(s["head"], s["tail"]))))
    name = lambda x: F.char(F.lit(96) + F.array_position(ends, x))
    each = F.transform(steps, lambda s: F.concat(F.lit("dep("), name(s["head"]), F.lit(',"'), s["label"], F.lit('",'), name(s["tail"]), F.lit(")")))
    return F.array_join(F.array_sort(each), ", ")


def sentences_of(instances_: DataFrame, sentences: DataFrame) -> DataFrame:
    """Exact lookup: every sentence (arg1, arg2, ..) of each instance (arg1, arg2, ..); case does not matter."""
    s = sentences.withColumns({"_a": F.lower("arg1"), "_b": F.lower("arg2")}).drop("arg1", "arg2")
    return instances_.withColumns({"_a": F.lower("arg1"), "_b": F.lower("arg2")}).join(s, ["_a", "_b"]).drop("_a", "_b")


def sentence_search(pairs: DataFrame, sentences: DataFrame, key: str, sen: str = "sen") -> DataFrame:
    """(pair columns, key, sen): sentences that contain both arguments of a pair as phrases.

    Sentences are found by a word of each argument (its rarest in the corpus) through joins, so no
    pair meets every sentence; the phrases are then tested exactly. Arguments without a word find nothing.
    """
    p = pairs.distinct()
    words = sentences.select(F.col(key).alias("_k"), F.explode(F.array_distinct(tokens(F.col(sen)))).alias("_w"))
    often = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    found = None
    for arg in ("arg1", "arg2"):
        own = p.select(*pairs.columns, F.explode(tokens(F.col(arg))).alias("_w")).join(often, "_w")
        rare = own.groupBy(*pairs.columns).agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
        at = rare.join(words, "_w").select(*pairs.columns, "_k").distinct()
        found = at if found is None else found.join(at, [*pairs.columns, "_k"], "left_semi")
    hit = found.join(sentences.select(F.col(key).alias("_k"), F.col(sen).alias("_s")), "_k")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    holds = padded(F.col("_s")).contains(padded(F.col("arg1"))) & padded(F.col("_s")).contains(padded(F.col("arg2")))
    return hit.where(holds).select(*pairs.columns, F.col("_k").alias(key), F.col("_s").alias(sen))


def parse_rule(rows: DataFrame, rule: str = "rule") -> DataFrame:
    """(.., rel, arg1, arg2): the relation of a rule and the texts that isa() gives its two ends."""
    body = F.regexp_extract(rule, r"^rule\d+:: (.*)\.$", 1)
    rel = F.regexp_extract(body, r"-> (\w+)\(([^,()]+), ([^()]+)\)", 1)
    ids = [F.regexp_extract(body, r"-> (\w+)\(([^,()]+), ([^()]+)\)", i) for i in (2, 3)]
    keys = F.regexp_extract_all(body, F.lit(r'isa\(([^,()]+), "([^"]*)"\)'), F.lit(1))
    names = F.regexp_extract_all(body, F.lit(r'isa\(([^,()]+), "([^"]*)"\)'), F.lit(2))
    said = lambda i: F.get(names, (F.array_position(keys, i) - 1).cast("int"))
    return rows.withColumns({"rel": rel, "arg1": said(ids[0]), "arg2": said(ids[1])})


def for_each_relation(rows: DataFrame, relations: list[str]) -> DataFrame:
    """Each row once per relation of a literal list (no join)."""
    return rows.withColumn("disrel", F.explode(F.array(*[F.lit(r) for r in relations])))


def join_phrase(rows: DataFrame) -> DataFrame:
    """The second argument takes the relation phrase along."""
    return rows.withColumn("arg2", F.concat_ws(" ", "relphrase", "arg2"))
