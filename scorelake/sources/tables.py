"""Benchmark and prediction tables: reading by suffix, column rules, unions with lineage, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import FAILURE
from ..operators.ordered import dense_index

def load(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None) -> DataFrame:
    """By suffix: tsv, csv, jsonl, json (one document), parquet, orc, txt. A list of paths is one table."""
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or paths[0].rstrip("/").rpartition(".")[2].lower()
    if fmt in ("tsv", "csv"):
        return spark.read.options(header=True, sep="\t" if fmt == "tsv" else ",", multiLine=True, quote='"', escape='"').csv(paths)
    if fmt in ("json", "jsonl"):
        return spark.read.option("multiLine", fmt == "json").json(paths)
    if fmt == "txt":
        return spark.read.text(paths)
    if fmt in ("parquet", "orc"):
        return spark.read.format(fmt).load(paths)
    raise ValueError(f"no reader for {fmt}")


def dump(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """By suffix; every field of csv and tsv is quoted."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2].lower()
    w = df.write.mode(mode)
    if fmt in ("tsv", "csv"):
        w.options(header=True, sep="\t" if fmt == "tsv" else ",", quoteAll=True, escape='"').csv(path)
    elif fmt in ("json", "jsonl"):
        w.json(path)
    else:
        w.format(fmt).save(path)


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All JSON documents under a folder, but role metadata, with their paths."""
    d = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.json", multiLine=True).json(path)
    return d.withColumn("path", F.input_file_name()).where(~F.col("path").contains("role_metadata"))


def lower_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case, but single capitals (options)."""
    return df.toDF(*[c if len(c) == 1 and c.isupper() else c.lower() for c in df.columns])


def integer_index(df: DataFrame, column: str = "index") -> DataFrame:
    """The index as a long if every value is a whole number, else as text."""
    whole = df.agg(F.bool_and(F.col(column).cast("string").rlike(r"^-?\d+$"))).first()[0]
    return df.withColumn(column, F.col(column).cast("long" if whole else "string"))


def kind_of(df: DataFrame) -> str:
    """'mcq' with option columns A and B, 'yorn' with Yes/No answers, else 'vqa'."""
    if {"A", "B"} <= set(df.columns):
        return "mcq"
    if "answer" in df.columns and df.where("answer is not null").limit(1000).agg(F.bool_and(F.lower("answer").isin("yes", "no"))).first()[0]:
        return "yorn"
    return "vqa"


def concat_tables(tables: Mapping[str, DataFrame], index: str = "index") -> DataFrame:
    """UNION ALL with the member's name, its own index and a new dense one by (member, index)."""
    parts = [d.withColumnRenamed(index, "original_index").withColumns({"member": F.lit(n), "__m": F.lit(k)}) for k, (n, d) in enumerate(tables.items())]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return dense_index(u, ["__m", "original_index"], index).drop("__m")


def predictions_complete(benchmark: DataFrame, predictions: DataFrame, key: str = "index") -> DataFrame:
    """Predictions of unknown keys; empty for a sound file."""
    return predictions.join(benchmark.select(key), key, "left_anti")


def attach(benchmark: DataFrame, predictions: DataFrame, key: str = "index") -> DataFrame:
    """Benchmark rows, without images, with their predictions where there are any."""
    return benchmark.drop("image").join(predictions.select(key, "prediction"), key, "left")


def answered(df: DataFrame, column: str = "prediction", ignore_failed: bool = False) -> Column:
    """Rows that need no new model call."""
    c = F.col(column)
    return c.isNotNull() if ignore_failed else c.isNotNull() & ~c.contains(f"{FAILURE}.")


def localise_images(df: DataFrame, image: str = "image") -> DataFrame:
    """Base64 images as bytes."""
    return df.withColumn("content", F.unbase64(image)).drop(image)


def option_submission(df: DataFrame, label: Column, key: str = "index") -> DataFrame:
    """key and option, for a JSON or TSV sink."""
    return df.select(key, F.coalesce(label, F.lit("Z")).alias("prediction"))


def pack(df: DataFrame, video: str = "video", order: str = "index") -> DataFrame:
    """All questions of a video in one row, in order."""
    return df.groupBy(video).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (order, video)]))).alias("questions"))


def newest(files: DataFrame, by: str = "name", at: str = "eval_id") -> DataFrame:
    """The newest of earlier runs' files of each name."""
    return files.groupBy(by).agg(F.max_by(F.struct(*[c for c in files.columns if c != by]), at).alias("r")).select(by, "r.*")


def parse_subtitles(df: DataFrame, text: str = "value") -> DataFrame:
    """Rows start, end, line of .srt text, one cue each; the other columns stay."""
    from ..functions.text import clock_seconds

    cue = F.explode(F.split(F.regexp_replace(text, "\r", ""), r"\n\s*\n"))
    c = df.withColumn("__cue", cue).withColumn("__t", F.regexp_extract("__cue", r"([\d:,.]+ --> [\d:,.]+)", 1)).where("__t <> ''")
    span = F.split("__t", " --> ")
    line = F.trim(F.regexp_extract("__cue", r"(?s)--> [\d:,.]+\s*\n(.*)", 1))
    return c.select(*[x for x in df.columns if x != text], clock_seconds(span[0]).alias("start"), clock_seconds(span[1]).alias("end"), line.alias("line"))
