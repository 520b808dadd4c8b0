"""Registry of queries, and the inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import FAILURE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: doc_id, source, lang, truth and pred (0 or 1)."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return t(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("truth"), F.col("toxic").alias("pred"))


R = "r AS (SELECT doc_id, source, lang, quality AS truth, toxic AS pred, CASE WHEN quality = toxic THEN 1 ELSE 0 END AS hit FROM labels JOIN documents USING (doc_id))"


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers: hit where the quantity is no multiple of three."""
    return t(spark, sf_dir, "lineitem").withColumn("hit", F.col("l_quantity").cast("long") % 3 != 0)


L = "li AS (SELECT *, CAST(l_quantity AS BIGINT) % 3 <> 0 AS hit FROM lineitem)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice questions made of parts: key, answer label, prediction text, split, l2, category."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ABCD")), (c + 1).cast("int"))
    pred = F.when(k % 5 == 0, F.concat(F.lit("The answer is ("), letter(k % 4), F.lit(").")))
    pred = pred.when(k % 5 == 1, F.concat(letter((k + 1) % 4), F.lit(". because of the text"))).when(k % 5 == 2, F.concat(F.lit("I think it is "), letter(k % 4))).when(k % 5 == 3, F.concat(F.lit("Either A or "), letter((k + 2) % 4))).otherwise("no idea at all")
    odd = [(13, "Cannot determine the answer"), (17, "I'm sorry, but without the image provided B"), (19, ""), (23, f"{FAILURE}. A"), (29, "Z"), (31, "I cannot see it all but B")]
    for m, said in reversed(odd):
        pred = F.when(k % m == 0, said).otherwise(pred)
    return p.select(k.alias("key"), letter(k % 4).alias("answer"), pred.alias("prediction"), F.when(k % 3 == 0, "dev").otherwise("test").alias("split"), F.col("p_brand").alias("l2"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("category"), "p_name", "p_size", "p_retailprice")


P = """p AS (SELECT p_partkey AS key, ['A','B','C','D'][CAST(p_partkey % 4 + 1 AS INT)] AS answer,
  CASE WHEN p_partkey % 13 = 0 THEN 'Cannot determine the answer' WHEN p_partkey % 17 = 0 THEN 'I''m sorry, but without the image provided B' WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'Failed to obtain answer via API. A' WHEN p_partkey % 29 = 0 THEN 'Z' WHEN p_partkey % 31 = 0 THEN 'I cannot see it all but B' ELSE
  CASE p_partkey % 5 WHEN 0 THEN 'The answer is (' || ['A','B','C','D'][CAST(p_partkey % 4 + 1 AS INT)] || ').'
    WHEN 1 THEN ['A','B','C','D'][CAST((p_partkey + 1) % 4 + 1 AS INT)] || '. because of the text'
    WHEN 2 THEN 'I think it is ' || ['A','B','C','D'][CAST(p_partkey % 4 + 1 AS INT)]
    WHEN 3 THEN 'Either A or ' || ['A','B','C','D'][CAST((p_partkey + 2) % 4 + 1 AS INT)] ELSE 'no idea at all' END END AS prediction,
  CASE WHEN p_partkey % 3 = 0 THEN 'dev' ELSE 'test' END AS split, p_brand AS l2, p_brand || '/' || p_size AS category, p_name, p_size, p_retailprice FROM part)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments per user: start in seconds since the user's first event, end 1 to 90 seconds later."""
    e = t(spark, sf_dir, "events")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    first = e.groupBy("user_id").agg(F.min(second).alias("first"))
    j = e.join(first, "user_id").withColumn("start", second - F.col("first"))
    return j.select("user_id", "event_id", "event_type", "value", F.col("start").cast("long"), (F.col("start") + F.col("event_id") % 90 + 1).cast("long").alias("end"))


S = """s AS (SELECT user_id, event_id, event_type, value, CAST(epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS BIGINT) AS start0,
  ts, floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY user_id) AS f FROM events),
g AS (SELECT user_id, event_id, event_type, value, CAST(f AS BIGINT) AS start, CAST(f AS BIGINT) + event_id % 90 + 1 AS "end" FROM s)"""
