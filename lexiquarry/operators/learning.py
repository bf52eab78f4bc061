"""Features, training and evaluation of the relation classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions.text import words
from lexiquarry.operators.graph import generalize, onward, symmetric
from lexiquarry.session import cut


def log_length(sentence: Column) -> Column:
    """ln of the number of words; 0 for none."""
    n = F.size(words(sentence))
    return F.when(n > 0, F.log(n.cast("double"))).otherwise(0.0)


def log_overlap(a: Column, b: Column) -> Column:
    """ln(1 + distinct common words): unlike ln(n), it tells none from one."""
    return F.log(F.size(F.array_intersect(words(F.lower(a)), words(F.lower(b)))) + F.lit(1.0))


def entailment(a: Column, b: Column) -> Column:
    """Hook for an entailment service; without one the score is 0."""
    return F.lit(0.0)


def place_of(phrase: Column, sentence: Column) -> Column:
    """Place (from 1) of the first occurrence of a phrase's words in succession; 0 if there is none.

    Words have no space, so they are looked for as one text between spaces: linear in the sentence.
    """
    said = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    found = lambda w, p: F.call_function("instr", w, p)
    at = lambda w, p: F.when((F.length(p) > 2) & (found(w, p) > 0), F.size(F.split(F.substring(w, F.lit(1), found(w, p)), " ")) - 1).otherwise(0)
    return at(said(sentence), said(phrase))


def distance(a: Column, b: Column, sentence: Column) -> Column:
    """Words between the first places of two phrases, as whole phrases; null if one is missing."""
    both = F.transform(F.array(F.struct(place_of(a, sentence).alias("a"), place_of(b, sentence).alias("b"))), lambda x: F.when((x["a"] > 0) & (x["b"] > 0), F.abs(x["a"] - x["b"])))
    return F.get(both, F.lit(0))


PREPOSITIONS = ("for", "of", "to")


def path_features(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Per instance from its generalized paths (keys, k, pattern, lemmas).

    dep2 and dep3 (smallest pattern of that length or 'null', after the relation), has2 and has3 as two
    columns, flags for three prepositions on the paths, and the map of path lengths.
    """
    one = lambda k: F.concat(F.col("disrel"), F.lit(" => "), F.coalesce(F.min(F.when(F.col("k") == k, F.col("pattern"))), F.lit("null")))
    flags = [F.bool_or(F.array_contains("lemmas", p)).alias(f"prep_{p}") for p in PREPOSITIONS]
    return paths.groupBy(*keys, "disrel").agg(
        one(2).alias("dep2"), one(3).alias("dep3"), F.bool_or(F.col("k") == 2).alias("has2"), F.bool_or(F.col("k") == 3).alias("has3"), *flags,
        F.array_sort(F.collect_set("k")).alias("lengths"),
    )


def connecting_words(paths: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Words on an instance's paths that are not its arguments: (keys, connecting)."""
    inner = paths.select(*keys, F.explode(F.slice("nodes", F.lit(2), F.greatest(F.lit(0), F.size("nodes") - 2))).alias("token_id"))
    return inner.distinct().join(tokens.select(*[c for c in keys if c in tokens.columns], "token_id", "text"), [*[c for c in keys if c in tokens.columns], "token_id"]).groupBy(*keys).agg(F.array_sort(F.collect_set("text")).alias("connecting"))


def lexical_seeds(rows: DataFrame) -> DataFrame:
    """(disrel, seeds): distinct phrases of positive rows, sorted."""
    return rows.where("label = '1'").groupBy("disrel").agg(F.array_sort(F.collect_set("relphrase")).alias("seeds"))


def top_patterns(rows: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The ``k`` heaviest patterns of each group (weight, then name)."""
    from lexiquarry.operators.search import capped

    return capped(rows, by, [F.desc("weight"), F.col("pattern")], k)


ALGORITHMS = {
    "J48": lambda: DecisionTreeClassifier(seed=2),
    "REPTree": lambda: DecisionTreeClassifier(seed=2, maxDepth=3),
    "RandomForest": lambda: RandomForestClassifier(seed=2),
    "Logistic": lambda: LogisticRegression(maxIter=50, regParam=1e-3),
    "SMO": lambda: LinearSVC(maxIter=50),
    "NaiveBayes": lambda: NaiveBayes(),
}


def trainer(numeric: list[str], nominal: list[str], algorithm: str = "Logistic", label: str = "label") -> Pipeline:
    """Nominal columns become indicator columns; then one of ALGORITHMS. Rule learners have no
    equivalent and are refused by name."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm}; one of {sorted(ALGORITHMS)}")
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in nominal]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in nominal], outputCols=[f"{c}_v" for c in nominal])] if nominal else []
    return Pipeline(stages=[*index, *hot, VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in nominal]], outputCol="features"), ALGORITHMS[algorithm]().setLabelCol(label)])


def useful(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value (nulls do not count): one aggregation over all of them."""
    r = rows.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if r[c]]


def folds(rows: DataFrame, key: Column, n: int = 10, seed: int = 2) -> DataFrame:
    """Adds ``fold`` (0 to n - 1) by hash, so that reruns agree."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int"))


def cross_validate(rows: DataFrame, pipeline: Pipeline, n: int = 10) -> DataFrame:
    """Predictions (all columns, prediction) of each fold by a model fitted on the others."""
    out = None
    for k in range(n):
        got = pipeline.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))
        keep = got.select(*rows.columns, "prediction")
        out = keep if out is None else out.unionByName(keep)
    return out


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, precision and recall of class 1."""
    hit = lambda c: F.sum(c.cast("long"))
    y, p = F.col(label) == 1, F.col(predicted) == 1
    r = rows.agg(F.count(F.lit(1)).alias("n"), hit(F.col(label) == F.col(predicted)).alias("ok"), hit(y & p).alias("tp"), hit(p).alias("pp"), hit(y).alias("yy"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return r.select("n", ratio("ok", "n").alias("accuracy"), ratio("tp", "pp").alias("precision"), ratio("tp", "yy").alias("recall"))


def per_class(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, predicted_n, correct, precision, recall) of every class that is labelled or predicted."""
    one = rows.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("y"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("y"), F.lit(1).alias("p")))).alias("x"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    n = one.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.y").alias("support"), F.sum("x.p").alias("predicted_n"), F.sum(F.col("x.y") * F.col("hit")).alias("correct"))
    ratio = lambda b: F.when(F.col(b) > 0, F.round(F.col("correct") / F.col(b), 6))
    return n.withColumns({"precision": ratio("predicted_n"), "recall": ratio("support")})


def save(model, path: str) -> None:
    """Write a fitted pipeline; an older one at ``path`` is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def mine_paths(edges: DataFrame, ends: DataFrame, by: list[str], lengths: tuple[int, ...] = (2, 3, 4), k: int = 10) -> DataFrame:
    """The ``k`` most frequent generalized paths of each relation: (disrel, pattern, weight).

    ``ends`` (by, disrel, arg1, arg2) are instances; paths of the given lengths from arg1 to arg2 count,
    each pattern once an instance.
    """
    # A node between two others has two neighbours: others are never walked through. The last step is not
    # walked, but looked up by the instance's end: instances meet the last steps once and the walks to their
    # other ends once, whatever the length. Both ends need not go with the nodes between.
    sym, most = cut(symmetric(edges, by).distinct()), max(lengths)
    through = onward(sym, by).select(*by, F.col("a").alias("end"), F.col("b").alias("_n"), F.col("label").alias("_l"), F.col("down").alias("_d"))
    none = F.array()
    starts = ends.select(*by, "arg1").distinct()
    walk = starts.select("*", F.array("arg1").alias("nodes"), none.cast("array<string>").alias("labels"), none.cast("array<boolean>").alias("downs"), F.col("arg1").alias("end"))
    walks = None
    for n in range(1, most + 1):
        if n in lengths:
            walks = walk if walks is None else walks.unionByName(walk)
        if n < most:
            step = walk.join(through, [*by, "end"]).where(~F.array_contains("nodes", F.col("_n")))
            walk = step.select(*by, "arg1", F.concat("nodes", F.array("_n")).alias("nodes"), F.concat("labels", F.array("_l")).alias("labels"), F.concat("downs", F.array("_d")).alias("downs"), F.col("_n").alias("end"))
    last = sym.select(*by, F.col("b").alias("arg2"), F.col("a").alias("end"), F.col("label").alias("_l"), F.col("down").alias("_d"))
    closed = ends.join(last, [*by, "arg2"]).join(walks, [*by, "arg1", "end"]).where(~F.array_contains("nodes", F.col("arg2")))
    grown = closed.select(*by, "disrel", "arg1", "arg2", F.concat("labels", F.array("_l")).alias("labels"), F.concat("downs", F.array("_d")).alias("downs"))
    out = generalize(grown).select(*by, "disrel", "arg1", "arg2", "pattern")
    return top_patterns(out.distinct().groupBy("disrel", "pattern").agg(F.count(F.lit(1)).alias("weight")), ["disrel"], k)


def score_relations(rows: DataFrame, model, relations: list[str]) -> DataFrame:
    """Each instance under every relation, best first: (columns, disrel, confidence)."""
    from lexiquarry.operators.search import for_each_relation

    got = model.transform(for_each_relation(rows, relations))
    return got.select(*rows.columns, "disrel", vector_to_array("probability")[1].alias("confidence")).orderBy(F.desc("confidence"), "disrel")


def positives(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("prediction") == 1)
