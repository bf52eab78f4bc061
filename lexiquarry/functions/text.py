"""Text functions as column expressions (and one Arrow function where no expression exists).

White space is always spelled out, never ``\\s``: engines disagree on it.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities that the expression form resolves; the ampersand goes last in each round.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_controls(c: Column) -> Column:
    """Remove characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def unescape(c: Column, rounds: int = 2) -> Column:
    """Resolve the common entities, ``rounds`` times over (texts escaped twice)."""
    t = c
    for _ in range(rounds):
        for entity, char in ENTITIES:
            t = F.replace(t, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), t).otherwise(c)


@F.pandas_udf(StringType())
def unescape_all(texts: pd.Series) -> pd.Series:
    """Resolve every HTML entity until nothing changes. Arrow batches; use only if '&' occurs."""

    def fix(t):
        while t is not None:
            u = html.unescape(t)
            if u == t:
                return t
            t = u
        return None

    return texts.map(fix)


META = r"\{\{([^}]*)\}\}"
META_CLUSTER = r"\{\{[^}]*\}\}([ \t\n\r\f]*[,;][ \t\n\r\f]*\{\{[^}]*\}\})*"


def plain(c: Column) -> Column:
    """No-break spaces become spaces; one leading '#' goes."""
    return F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), "^#", "")


def meta(c: Column) -> Column:
    """The insides of all ``{{...}}``."""
    return F.when(~c.contains("{{"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(c, F.lit(META), F.lit(1)))


def parts(c: Column) -> Column:
    """Definition text -> its alternatives: parentheses and quotes cleaned, split at ';', trimmed. A text
    without any of their signs is not searched for them."""
    t = F.regexp_replace(c, META_CLUSTER, "")
    t = F.regexp_replace(t, r"\([^)]*\)", "")
    t = F.regexp_replace(t, r"(^|[^A-Za-z0-9_])'([^']+)'([^A-Za-z0-9_]|$)", "$1$2$3")
    t = F.regexp_replace(t, r'(^|[^A-Za-z0-9_])"([^"]+)"([^A-Za-z0-9_]|$)', "$1$2$3")
    t = F.replace(F.replace(t, F.lit("''"), F.lit("")), F.lit('""'), F.lit(""))
    signs = c.contains("{{") | c.contains("(") | c.contains("'") | c.contains('"')
    t = F.when(signs, t).otherwise(c)
    return F.filter(F.transform(F.split(t, ";"), strip_controls), lambda x: F.length(x) > 0)


def words(c: Column) -> Column:
    """Runs of characters outside ``[ \\t\\n\\r\\f]``."""
    return F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda w: w != "")


def html_text(c: Column) -> Column:
    """Visible text of a page: comments, scripts, styles and tags go; entities are resolved."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = unescape(F.regexp_replace(c, r"(?s)<[^>]*>", " "), 1)
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def quoted(c: Column) -> Column:
    """The set of double-quoted substrings, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit('"([^"]*)"'), F.lit(1)))


def initcap_first(c: Column) -> Column:
    """Upper-case the first character only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def sane_query(c: Column) -> Column:
    """Whether a search phrase is fit to use: no digit or symbol, not one letter, not 'A man'."""
    return ~c.rlike(r"[^A-Za-z '\-]") & (F.length(F.trim(c)) > 1) & (F.lower(F.trim(c)) != "a man")
