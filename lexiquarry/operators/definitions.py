"""Dictionary definitions: preprocessing, filters, post-processing, flattening, lookup and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import text as X
from lexiquarry.functions.features import score


def preprocess(rows: DataFrame, definition: str = "definition", full_entities: bool = False) -> DataFrame:
    """Adds ``meta`` and ``parts``. ``full_entities`` resolves all HTML entities (Arrow function)."""
    c = F.col(definition)
    c = F.when(c.contains("&"), X.unescape_all(c)).otherwise(c) if full_entities else X.unescape(c)
    flat = X.plain(c)
    return rows.withColumns({"meta": X.meta(flat), "parts": X.parts(flat)})


def of_classes(rows: DataFrame, classes: list[str], column: str = "word_class") -> DataFrame:
    """Rows of the given classes (case does not matter); no class given: all rows."""
    return rows.where(F.lower(column).isin(*[c.lower() for c in classes])) if classes else rows


def in_glossary(rows: DataFrame, glossary: DataFrame | None, term: str = "term") -> DataFrame:
    """Rows whose term is in ``glossary`` (column ``term``, lower case); no glossary: all rows."""
    if glossary is None:
        return rows
    g = glossary.select(F.lower(F.trim("term")).alias("_g")).distinct()
    return rows.join(g, F.lower(F.trim(term)) == F.col("_g"), "left_semi")


def extractions_for(rows: DataFrame, classes: list[str], extracted: str = "extractions") -> DataFrame:
    """Rows of other classes stay, with no extractions."""
    none = F.array().cast(rows.schema[extracted].dataType)
    return rows.withColumn(extracted, F.when(F.lower("word_class").isin(*[c.lower() for c in classes]), F.col(extracted)).otherwise(none))


# Objects that say nothing as the object of an IsA, and those that mean a person.
EMPTY_OBJECTS = (
    "part", "piece", "thing", "something", "kind", "type", "sort", "variety", "way", "manner", "style", "form", "group", "set", "class", "category", "means",
    "mode", "format", "word", "term",
)
PERSONS = ("someone", "anyone", "somebody", "anybody", "one")


def post_filter(facts: DataFrame) -> DataFrame:
    """(agent, rel_type, obj, n_modifiers, ..): cleans IsA facts that have no modifiers.

    Such a fact goes if its object repeats the agent or is an empty word; a person word becomes
    'person'. Everything else stays as it is.
    """
    bare = F.coalesce((F.col("rel_type") == "IsA") & (F.col("n_modifiers") == 0) & F.col("agent").isNotNull() & F.col("obj").isNotNull(), F.lit(False))
    obj = F.lower("obj")
    void = bare & ((F.lower(F.trim("agent")) == obj) | obj.isin(*EMPTY_OBJECTS))
    return facts.where(~void).withColumn("obj", F.when(bare & obj.isin(*PERSONS), "person").otherwise(F.col("obj")))


def scored(extractions: DataFrame) -> DataFrame:
    """Adds ``confidence``: a score for IsA, null for any other relation."""
    return extractions.withColumn("confidence", F.when(F.col("rel_type") == "IsA", score()))


def render(agent: Column, rel: Column, obj: Column, mods: Column, rel_type: Column) -> Column:
    """Text of a tuple: (agent, rel, obj[, modifiers]); IsA prints 'isa', terms and contexts only the object."""
    shown = F.when(rel_type == "IsA", F.lit("isa")).otherwise(rel)
    full = F.concat(F.lit("("), F.concat_ws(", ", agent, shown, obj, F.when(F.size(mods) > 0, F.array_join(mods, ", "))), F.lit(")"))
    return F.when(rel_type.isin("DefinedTerm", "Context"), obj).otherwise(full)


def flatten(rows: DataFrame) -> DataFrame:
    """(term, word_class, source, alternate_definition, fact): one row per tuple, with its type or 'Fact'."""
    each = rows.select("term", "word_class", "source", F.explode("alternates").alias("a"))
    each = each.select("term", "word_class", "source", F.col("a.text").alias("alternate_definition"), F.explode("a.tuples").alias("t"))
    fact = F.concat(F.coalesce("t.rel_type", F.lit("Fact")), F.lit(": "), F.col("t.text"))
    return each.select(F.lower("term").alias("term"), "word_class", "source", "alternate_definition", fact.alias("fact"))


def lookup(facts: DataFrame, query: str) -> DataFrame:
    """Report of a term: (alternate_definition, source, word_class, extractions), all sorted.

    The query is trimmed and lower-cased, as stored terms are.
    """
    hit = facts.where(F.lower("term") == query.strip().lower())
    return hit.groupBy("alternate_definition", "source", "word_class").agg(F.sort_array(F.collect_set("fact")).alias("extractions")).orderBy("alternate_definition", "source", "word_class")


def statistics(facts: DataFrame) -> DataFrame:
    """Distinct terms (exact), definitions and sources (case does not matter): one row."""
    return facts.agg(
        F.countDistinct("term").alias("terms"), F.countDistinct(F.lower("alternate_definition")).alias("definitions"), F.countDistinct(F.lower("source")).alias("sources")
    )
