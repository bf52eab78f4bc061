"""Writers. Values are rendered by column expressions; Spark's writers do the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def sections(rows: DataFrame, path: str, prefix: str, suffix: str = "", section: str = "section_index", order: str = "line_no", line: str = "line") -> None:
    """One text output per section, ``{prefix}-{n}{suffix}`` (a folder ``file=..`` below ``path``), in line order."""
    named = rows.select(F.concat(F.lit(f"{prefix}-"), F.col(section).cast("string"), F.lit(suffix)).alias("file"), F.col(order).alias("_at"), F.col(line).alias("value"))
    named.repartition("file").sortWithinPartitions("file", "_at").drop("_at").write.partitionBy("file").mode("overwrite").text(path)


def commit_dataset(outputs: dict[str, DataFrame], root: str) -> None:
    """All outputs of a dataset or none: written to a staging folder that is renamed at the end.

    The former dataset is moved aside first and goes last, so a crash between never loses both.
    """
    spark = next(iter(outputs.values())).sparkSession
    stage = f"{root.rstrip('/')}._staging_{uuid.uuid4().hex}"
    for name, df in outputs.items():
        df.write.parquet(f"{stage}/{name}")
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(root)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{stage}_old")
    replaced = fs.exists(dst)
    if replaced and not fs.rename(dst, old):
        raise OSError(f"cannot move {root} aside")
    if not fs.rename(src, dst):
        if replaced:
            fs.rename(old, dst)
        raise OSError(f"cannot move {stage} to {root}")
    if replaced:  # only now is the former dataset not needed any more
        fs.delete(old, True)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def turtle(triples: DataFrame) -> DataFrame:
    """(s, p, o, o_kind) -> one Turtle line a triple."""
    o = F.when(F.col("o_kind") == "uri", F.col("o")).when(F.col("o_kind") == "integer", F.concat(F.lit('"'), F.col("o"), F.lit('"^^xsd:integer'))).otherwise(F.concat(F.lit('"'), escape(F.col("o")), F.lit('"')))
    return triples.select(F.concat_ws(" ", "s", "p", o, F.lit(".")).alias("line"))


def bracketed_json(df: DataFrame, order: list[str]) -> DataFrame:
    """(seq, line): '[', one object a line, commas between, ']'. ``order`` numbers the objects."""
    last = df.agg(F.max(F.struct(*order)).alias("m"))
    body = df.crossJoin(F.broadcast(last)).select(  # one row on the right
        F.lit(1).alias("seq"), *[F.col(c) for c in order],
        F.concat(F.to_json(F.struct(*df.columns)), F.when(F.struct(*order) == F.col("m"), "").otherwise(",")).alias("line"),
    )
    spark = df.sparkSession
    frame = spark.createDataFrame([(0, "["), (2, "]")], "seq int, line string")
    return body.unionByName(frame, allowMissingColumns=True).orderBy("seq", *order).select("line")


def tsv(df: DataFrame, *columns: str, name: str = "line") -> DataFrame:
    """Tab-separated lines; null is an empty field."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias(name))


def arff(df: DataFrame, relation: str, label: str = "label") -> tuple[list[str], DataFrame]:
    """Header lines (one per attribute) and data lines of an ARFF file."""
    head = [f"@relation {relation}", ""]
    for name, kind in df.dtypes:
        head.append(f"@attribute {name} " + ("{1,0}" if name == label else "numeric" if kind in ("double", "int", "bigint", "float") else "string"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns]
    return [*head, "", "@data"], df.select(F.concat_ws(",", *cells).alias("line"))


def append_facts(facts: DataFrame, path: str) -> None:
    """Append flat facts; the term is stored in lower case."""
    facts.withColumn("term", F.lower("term")).write.mode("append").parquet(path)


def readable(facts: DataFrame) -> DataFrame:
    """One block per definition: DEFINITION, WORD CLASS and its sorted extractions."""
    g = facts.groupBy("term", "word_class", "alternate_definition").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    return g.select(
        "term", "word_class", "alternate_definition",
        F.concat_ws("\n", F.concat(F.lit("DEFINITION: "), "alternate_definition"), F.concat(F.lit("WORD CLASS: "), F.coalesce("word_class", F.lit(""))), F.lit("EXTRACTIONS:"), F.array_join("facts", "\n")).alias("block"),
    )
