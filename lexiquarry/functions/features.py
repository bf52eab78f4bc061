"""Confidence features of an extraction as column expressions, and their fixed logistic score.

A row has ``tokens`` (all tokens of the sentence, structs id, string, pos, lemma; ids from 0) and the
token arrays ``arg1``, ``rel`` and ``arg2s``, and ``kind`` (simple, tupleRelObj, complex).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and part-of-speech sets of the features.
BLACKLIST = ("word", "something", "piece", "part", "kind", "number", "way", "type", "form")
COMMUNICATION = (
    "acknowledge add address admit advertise advise agree allege announce answer appear argue ask assert assume assure believe boast claim comment "
    "complain conclude confirm consider contend convince decide declare demand demonstrate deny describe determine disclose discover discuss doubt "
    "emphasize expect explain express fear feel figure forget hear hope imply indicate inform insist instruct know learn maintain mean mention note "
    "notice observe pray predict proclaim promise propose repeat reply report request respond reveal say signal specify speculate state suggest teach "
    "tell testify warn write"
).split()
COGNITION = "estimate pretend prove realise realize recognize remember remind saw seem surmise suspect theorize think understand verify wish worry".split()
NOUN = ("NN", "NNS", "NNP", "NNPS")
PRONOUN = ("PRP", "PRP$")
PROPER = ("NNP", "NNPS")

# The weights of the score (features not named weigh 0).
WEIGHTS = {
    "Intercept": -1.7849105806514818,
    "arg1 contains < 3 tokens": 1.3156797196216592,
    "arg1 contains proper noun": -0.3110058835172233,
    "arg1 equals arg2s": -19.369759988810635,
    "arg2s borders rel": -1.179126526712237,
    "arg2s consists of blacklisted words": -4.44341733258207,
    "arg2s contains noun": 2.0116032326487256,
    "arg2s contains proper noun": 0.38164715354550843,
    "of right after arg2s": 0.6585862864764879,
    "or right before arg2s": -0.5285279758657727,
    "rel contains VBZ": 1.3231318516426451,
    "rel contains verb": 16.167013015487424,
    "rel is single verb": -16.660014908645437,
    "sentence contains < 10 tokens": 0.6596866166826654,
    "sentence contains >= 20 tokens": -0.6098126269434833,
}


def _has_pos(part: str, pos) -> Column:
    return F.exists(part, lambda t: t["pos"].isin(*pos))


def _low(part: str) -> Column:
    return F.array_min(F.transform(part, lambda t: t["id"]))


def _high(part: str) -> Column:
    return F.array_max(F.transform(part, lambda t: t["id"]))


def _text(part: str) -> Column:
    return F.lower(F.array_join(F.transform(part, lambda t: t["string"]), " "))


def _before(part: str, pattern: str) -> Column:
    at = _low(part)
    word = F.lower(F.get(F.col("tokens"), at - 1)["string"])
    return (at >= 1) & (at <= F.size("tokens")) & word.rlike(f"^(?:{pattern})$")


def _after(part: str, pattern: str) -> Column:
    at = _high(part)
    word = F.lower(F.get(F.col("tokens"), at + 1)["string"])
    return (at >= 0) & (at < F.size("tokens") - 1) & word.rlike(f"^(?:{pattern})$")


def _anywhere_before(part: str, pattern: str) -> Column:
    return F.exists(F.filter("tokens", lambda t: t["id"] < _low(part)), lambda t: F.lower(t["string"]).rlike(f"^(?:{pattern})$"))


def _builders() -> dict[str, Column]:
    f: dict[str, Column] = {
        "relational object is a tuple": F.col("kind") == "tupleRelObj",
        "arg1 contains a pronoun or EX": _has_pos("arg1", (*PRONOUN, "EX")),
        "arg2s contains a pronoun or EX": _has_pos("arg2s", (*PRONOUN, "EX")),
        "arg2s consists of blacklisted words": F.forall("arg2s", lambda t: t["string"].isin(*BLACKLIST)),
        "arg1 contains noun": _has_pos("arg1", (*NOUN, *PRONOUN)),
        "arg2s contains noun": _has_pos("arg2s", (*NOUN, *PRONOUN)),
        "arg1 contains proper noun": _has_pos("arg1", PROPER),
        "arg2s contains proper noun": _has_pos("arg2s", PROPER),
        "arg1 appears before rel in sentence": _high("arg1") < _low("rel"),
        "arg2s appears after rel in sentence": _low("arg2s") > _high("rel"),
        "arg1 borders rel": (_high("arg1") + 1 == _low("rel")) | (_high("rel") + 1 == _low("arg1")),
        "arg2s borders rel": (_high("arg2s") + 1 == _low("rel")) | (_high("rel") + 1 == _low("arg2s")),
        "rel contains verb": F.exists("rel", lambda t: t["pos"].startswith("VB")),
        "rel is single verb": (F.size("rel") == 1) & F.exists("rel", lambda t: t["pos"].startswith("VB")),
        "rel contiguous": F.coalesce(_high("rel") - _low("rel") + 1, F.lit(0)) == F.size("rel"),
        "arg1 contains >= 10 tokens": F.size("arg1") >= 10,
        "arg2s contains >= 10 tokens": F.size("arg2s") >= 10,
        "arg1 contains < 3 tokens": F.size("arg1") < 3,
        "sentence contains < 10 tokens": F.size("tokens") < 10,
        "sentence contains >= 20 tokens": F.size("tokens") >= 20,
        "rel matches VW+P": (F.size("rel") > 2) & F.get("rel", F.lit(0))["pos"].startswith("VB") & (F.get("rel", F.size("rel") - 1)["pos"] == "IN"),
        "arg1 equals arg2s": _text("arg1") == _text("arg2s"),
    }
    for part, word in (("arg1", "if"), ("arg1", "in"), ("arg1", "that|which|who"), ("arg1", ","), ("arg2s", "or"), ("rel", "that"), ("rel", "who|which")):
        f[f"{word} right before {part}"] = _before(part, word)
    for word in ("'s", "of"):
        f[f"{word} right after arg2s"] = _after("arg2s", word)
    for name, pattern in (("if|whether|though|although",) * 2, ("may|might|would|could|should|suppose",) * 2, ("communic words", "|".join(COMMUNICATION)), ("cognitive words", "|".join(COGNITION))):
        f[f"{name} anywhere before arg1"] = _anywhere_before("arg1", pattern)
    for pos in ("VBZ", "VBG", "VBD", "VBN", "VBP", "VB"):
        f[f"rel contains {pos}"] = _has_pos("rel", (pos,))
    return f


def definition_features() -> dict[str, Column]:
    """The 41 features of definition extractions, by name in name order, as 0.0 / 1.0."""
    return {k: F.coalesce(c, F.lit(False)).cast("double") for k, c in sorted(_builders().items())}


def graph_features() -> dict[str, Column]:
    """The 42 features of graph extractions: the nested-object feature is told apart by side."""
    f = definition_features()
    del f["relational object is a tuple"]
    f["antecedent is a tuple"] = F.coalesce(F.col("antecedent_tuple"), F.lit(False)).cast("double")
    f["consequent is a tuple"] = F.coalesce(F.col("consequent_tuple"), F.lit(False)).cast("double")
    return dict(sorted(f.items()))


def check_weights(features: dict[str, Column], weights: dict[str, float]) -> None:
    """Every weight must belong to a feature."""
    if unknown := set(weights) - set(features) - {"Intercept"}:
        raise ValueError(f"weights without a feature: {sorted(unknown)}")


def score(features: dict[str, Column] | None = None, weights: dict[str, float] = WEIGHTS) -> Column:
    """Logistic score; features of weight 0 are not part of the plan."""
    features = definition_features() if features is None else features
    check_weights(features, weights)
    z = F.lit(weights.get("Intercept", 0.0))
    for name, c in features.items():
        if weights.get(name):
            z = z + F.lit(weights[name]) * c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def dump(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per instance with a column per feature (names made safe), for writing."""
    safe = {k: "".join(ch if ch.isalnum() else "_" for ch in k) for k in definition_features()}
    return rows.select(*keep, *[c.alias(safe[k]) for k, c in definition_features().items()])
