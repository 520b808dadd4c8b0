"""Reports of single benchmarks: each groups, averages and names scores as its benchmark does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text
from ..operators import report
from .base import L, query, t

_r6 = lambda c: F.round(c, 6)

# Capabilities that a category text names.
CAPABILITIES = ["rec", "ocr", "know", "gen", "spat", "math"]
_BITS = ", ".join(f"CASE WHEN (l_orderkey // {2**i}) % 2 = 1 THEN '{c}' END" for i, c in enumerate(CAPABILITIES))
_GRADED = f"g AS (SELECT array_to_string(list_filter([{_BITS}], lambda x: x IS NOT NULL), ',') AS category, l_discount * 10 AS score FROM lineitem)"


@query(f"WITH {_GRADED}, u AS (SELECT 'capability' AS kind, c AS name, score FROM g, unnest({CAPABILITIES!r}) x(c) WHERE contains(category, c) UNION ALL SELECT 'combination', replace(category, ',', '_'), score FROM g UNION ALL SELECT 'all', 'Overall', score FROM g) SELECT kind, name, count(*) AS tot, round(avg(score) * 100, 6) AS acc FROM u GROUP BY ALL")
def capability_report(spark, sf):
    """A row counts for every capability that its category names, for the category as a whole, and overall."""
    k = F.col("l_orderkey")
    parts = F.array(*[F.when(F.floor(k / 2**i) % 2 == 1, c) for i, c in enumerate(CAPABILITIES)])
    g = t(spark, sf, "lineitem").select(F.array_join(parts, ",").alias("category"), (F.col("l_discount") * 10).alias("score"))
    named = F.filter(F.array(*map(F.lit, CAPABILITIES)), lambda c: F.col("category").contains(c))
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    every = F.concat(F.transform(named, lambda c: entry("capability", c)), F.array(entry("combination", F.replace("category", F.lit(","), F.lit("_"))), entry("all", F.lit("Overall"))))
    u = g.select(F.explode(every).alias("u"), "score")
    return u.groupBy("u.kind", "u.name").agg(F.count(F.lit(1)).alias("tot"), _r6(F.avg("score") * 100).alias("acc"))


_VIDEO = "v AS (SELECT ['short','medium','long'][CAST(event_id % 3 + 1 AS INT)] AS duration, event_type AS domain, user_id % 5 AS sub_category, event_id % 7 AS task_type, event_id % 4 - 1 AS score FROM events)"
_VSETS = {"overall": "'all'", "domain": "domain", "sub_category": "sub_category::VARCHAR", "task_type": "task_type::VARCHAR"}


@query(f"WITH {_VIDEO}, u AS (SELECT * FROM v UNION ALL SELECT 'overall', domain, sub_category, task_type, score FROM v), k AS (" + " UNION ALL ".join(f"SELECT duration, '{k}' AS kind, {c} AS name, score FROM u" for k, c in _VSETS.items()) + ") SELECT duration, kind, name, printf('%.3f', round(avg(score) FILTER (score >= 0) * 1000) / 1000) AS rating FROM k GROUP BY ALL")
def duration_report(spark, sf):
    """Means of valid scores, as text with three decimals, for each duration and all, by domain, subcategory and task."""
    e = F.col("event_id")
    v = t(spark, sf, "events").select(F.get(F.array(*map(F.lit, ("short", "medium", "long"))), (e % 3).cast("int")).alias("duration"), F.col("event_type").alias("domain"), (F.col("user_id") % 5).cast("string").alias("sub_category"), (e % 7).cast("string").alias("task_type"), (e % 4 - 1).alias("score"))
    rating = {"rating": F.format_string("%.3f", F.round(F.avg(F.when(F.col("score") >= 0, F.col("score"))), 3))}
    kinds = {"overall": None, "domain": "domain", "sub_category": "sub_category", "task_type": "task_type"}
    each = report.levels(v, kinds, rating, ["duration"])
    out = each.unionByName(report.levels(v, kinds, rating).withColumn("duration", F.lit("overall")))
    return out.select("duration", "kind", F.when(F.col("kind") == "overall", "all").otherwise(F.col("name")).alias("name"), "rating")


@query("SELECT l_returnflag || '. ' || l_linestatus AS name, sum((l_quantity::BIGINT % 3 <> 0)::INT)::BIGINT AS success, count(*) AS total, round(sum((l_quantity::BIGINT % 3 <> 0)::INT)::DOUBLE / count(*) * 100, 1) AS acc FROM lineitem GROUP BY ALL")
def success_totals(spark, sf):
    """Successes and totals by 'dimension. task'."""
    hit = (F.col("l_quantity").cast("long") % 3 != 0).cast("int")
    return t(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", F.lit(". "), "l_linestatus").alias("name")).agg(F.sum(hit).alias("success"), F.count(F.lit(1)).alias("total"), F.round(F.avg(hit) * 100, 1).alias("acc"))


@query("WITH s AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 / 2.0 END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS b, NULL::DOUBLE AS c FROM events), m AS (SELECT coalesce(avg(a), 0) AS a, coalesce(avg(b), 0) AS b, coalesce(avg(c), 0) AS c FROM s) SELECT round((a + b + c) / 3 * 100, 2) AS overall, round(a * 100, 2) AS reality, round(b * 100, 2) AS aesthetics, round(c * 100, 2) AS consistency FROM m")
def column_means(spark, sf):
    """Means of columns in which -1 is no score, 0 for a column without any, and the mean of the means."""
    e = F.col("event_id")
    s = t(spark, sf, "events").select(F.when(e % 5 == 0, -1.0).otherwise(e % 3 / 2.0).alias("reality"), F.when(e % 7 == 0, -1.0).otherwise(F.col("value")).alias("aesthetics"), F.lit(-1.0).alias("consistency"))
    names = s.columns
    m = s.agg(*[F.coalesce(F.avg(F.nullif(F.col(c), F.lit(-1.0))), F.lit(0.0)).alias(c) for c in names])
    return m.select(F.round(sum(F.col(c) for c in names) / len(names) * 100, 2).alias("overall"), *[F.round(F.col(c) * 100, 2).alias(c) for c in names])


@query("WITH x AS (SELECT o_orderstatus AS split, o_orderpriority AS category, o_orderkey % 10 AS score FROM orders) SELECT split, 'Overall' AS name, round(avg(score) / 9 * 100, 6) AS score FROM x GROUP BY split UNION ALL SELECT split, category, round(avg(score) / 9 * 100, 6) FROM x GROUP BY ALL")
def nine_point_report(spark, sf):
    """Scores of 0 to 9 as percentages, by split, overall and by category."""
    x = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 10).alias("s"))
    return report.levels(x, {"Overall": None, "category": "category"}, {"score": _r6(F.avg("s") / 9 * 100)}, ["split"]).select("split", "name", "score")


_NEEDLES = ("find-image", "count-text", "find-text", "infer-choose", "count-image", "visual-reasoning")


@query("WITH x AS (SELECT " + repr(list(_NEEDLES)) + "[CAST(event_id % 5 + 1 AS INT)] AS category, (event_id % 3 = 0)::INT AS hit FROM events), n AS (SELECT unnest(" + repr(list(_NEEDLES)) + ") AS category) SELECT n.category, round(avg(hit), 6) AS rate FROM n LEFT JOIN x USING (category) GROUP BY n.category UNION ALL SELECT 'total', round(avg(hit), 6) FROM x")
def fixed_category_rates(spark, sf):
    """Rates of fixed categories, null for one without rows, and of all rows."""
    e = F.col("event_id")
    x = t(spark, sf, "events").select(F.get(F.array(*map(F.lit, _NEEDLES)), (e % 5).cast("int")).alias("category"), (e % 3 == 0).cast("int").alias("hit"))
    rates = x.agg(*[_r6(F.avg(F.when(F.col("category") == c, F.col("hit")))).alias(c) for c in _NEEDLES], _r6(F.avg("hit")).alias("total"))
    return rates.unpivot([], [*_NEEDLES, "total"], "category", "rate")


@query("WITH x AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'P-Level' ELSE 'C-Level' END AS tag, value AS s FROM events), m AS (SELECT avg(s) FILTER (tag = 'P-Level') AS p, avg(s) FILTER (tag = 'C-Level') AS c, count(*) FILTER (tag = 'P-Level') AS np, count(*) FILTER (tag = 'C-Level') AS nc FROM x) SELECT round(p, 6) AS p_level_accuracy, round(c, 6) AS c_level_accuracy, np AS p_level_cnt, nc AS c_level_cnt, round((p * np + c * nc) / (np + nc), 6) AS overall_accuracy FROM m")
def two_level_means(spark, sf):
    """Means and counts of two levels, and the mean weighted by count."""
    x = t(spark, sf, "events").select((F.col("event_id") % 4 == 0).alias("p"), F.col("value").alias("s"))
    m = x.agg(F.avg(F.when(F.col("p"), F.col("s"))).alias("pa"), F.avg(F.when(~F.col("p"), F.col("s"))).alias("ca"), F.count_if("p").alias("p_level_cnt"), F.count_if(~F.col("p")).alias("c_level_cnt"))
    over = (F.col("pa") * F.col("p_level_cnt") + F.col("ca") * F.col("c_level_cnt")) / (F.col("p_level_cnt") + F.col("c_level_cnt"))
    return m.select(_r6("pa").alias("p_level_accuracy"), _r6("ca").alias("c_level_accuracy"), "p_level_cnt", "c_level_cnt", _r6(over).alias("overall_accuracy"))


@query("WITH w AS (SELECT string_split(p_type, ' ') AS k, [x::DOUBLE FOR x IN range(1, CAST(1 + p_size % 4 AS BIGINT) + 1)] AS s FROM part), e AS (SELECT unnest(k) AS component, unnest(s) AS score FROM w WHERE len(k) = len(s)) SELECT component, count(*) AS n, round(avg(score), 6) AS mean FROM e GROUP BY component")
def component_means(spark, sf):
    """Mean score of each component; rows whose lists do not match in length are left out whole."""
    k, s = F.split("p_type", " "), F.transform(F.sequence(F.lit(1), (1 + F.col("p_size") % 4).cast("int")), lambda x: x.cast("double"))
    e = t(spark, sf, "part").where(F.size(k) == F.size(s)).select(F.explode(F.arrays_zip(k.alias("k"), s.alias("s"))).alias("e"))
    return e.groupBy(F.col("e.k").alias("component")).agg(F.count(F.lit(1)).alias("n"), _r6(F.avg("e.s")).alias("mean"))


@query("WITH x AS (SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN '(A) or (B)' WHEN 1 THEN '(A) yes' WHEN 2 THEN ' (B' ELSE 'A' END AS pred, CASE WHEN p_partkey % 2 = 0 THEN '(B)' ELSE '(A)' END AS answer FROM part) SELECT p_brand AS name, round(avg((len(regexp_extract_all(pred, '\\([A-Z]\\)')) <= 1 AND trim(string_split(pred, ')')[1]) = trim(string_split(answer, ')')[1]))::INT) * 100, 6) AS acc FROM x GROUP BY p_brand")
def group_choice(spark, sf):
    """Choices of a group: naming several options is wrong; else what stands before the first bracket's end decides."""
    k = F.col("p_partkey")
    x = t(spark, sf, "part").select("p_brand", F.when(k % 4 == 0, "(A) or (B)").when(k % 4 == 1, "(A) yes").when(k % 4 == 2, " (B").otherwise("A").alias("pred"), F.when(k % 2 == 0, "(B)").otherwise("(A)").alias("answer"))
    clean = lambda c: F.trim(F.split(c, r"\)")[0])
    one = F.regexp_count("pred", F.lit(r"\([A-Z]\)")) <= 1
    return x.groupBy(F.col("p_brand").alias("name")).agg(report.percent(one & (clean(F.col("pred")) == clean(F.col("answer")))).alias("acc"))


@query("WITH x AS (SELECT o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS a, o_totalprice * (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) + o_orderkey % 50 * 20 AS p, CASE WHEN o_orderkey % 3 = 0 THEN 500.0 END AS tol FROM orders) SELECT name, round(avg((abs(p - a) < coalesce(tol, a * 0.01))::INT), 6) AS acc FROM x GROUP BY name UNION ALL SELECT 'Overall', round(avg((abs(p - a) < coalesce(tol, a * 0.01))::INT), 6) FROM x")
def tolerance_accuracy(spark, sf):
    """Numbers right within a given tolerance, else a hundredth of the answer with its sign; ratio of sums, overall and by group."""
    k = F.col("o_orderkey")
    a = F.when(k % 2 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    x = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), text.within_tolerance(a + k % 50 * 20, a, F.when(k % 3 == 0, 500.0)).cast("int").alias("hit"))
    return report.levels(x, {"Overall": None, "category": "category"}, {"acc": _r6(F.avg("hit"))}).select("name", "acc")


_GROUPS = [{"lang": "en"}, {"lang": "en", "toxic": "1"}, {"quality": "0", "toxic": "0"}]


@query("WITH x AS (SELECT lang, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, length(text)::DOUBLE AS score FROM documents JOIN labels USING (doc_id)), u AS (SELECT 'all' AS name, score FROM x UNION ALL " + " UNION ALL ".join(f"SELECT '{','.join(f'{k}={v}' for k, v in g.items())}', score FROM x WHERE {' AND '.join(f'{k} = {chr(39)}{v}{chr(39)}' for k, v in g.items())}" for g in _GROUPS) + ") SELECT name, count(*) AS n, round(avg(score), 4) AS mean FROM u GROUP BY name")
def attribute_groups(spark, sf):
    """A sample counts for every group all of whose attribute values it has; one without attributes only for all."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    x = d.select(F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")).alias("a"), F.length("text").alias("score"))
    fits = lambda g: reduce(lambda p, q: p & q, [F.col("a")[k] == v for k, v in g.items()])
    name = lambda g: ",".join(f"{k}={v}" for k, v in g.items())
    groups = F.concat(F.array(F.lit("all")), *[F.when(F.coalesce(fits(g), F.lit(False)), F.array(F.lit(name(g)))).otherwise(F.array().cast("array<string>")) for g in _GROUPS])
    return x.select(F.explode(groups).alias("name"), "score").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query("WITH x AS (SELECT list_distinct(['lang: ' || lang, 'toxic: ' || toxic, 'quality: ' || quality, 'lang: ' || lang]) AS l, length(text)::DOUBLE AS score FROM documents JOIN labels USING (doc_id)), e AS (SELECT unnest(l) AS attribute, score FROM x) SELECT attribute, count(*) AS sample_count, round(avg(score), 4) AS mean FROM e WHERE attribute IS NOT NULL GROUP BY attribute")
def annotation_labels(spark, sf):
    """Mean and number of samples of each 'attribute: value' that a sample's annotations hold, each once a sample."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    label = lambda k: F.concat(F.lit(f"{k}: "), F.col(k).cast("string"))
    x = d.select(F.explode(F.array_distinct(F.array(label("lang"), label("toxic"), label("quality"), label("lang")))).alias("attribute"), F.length("text").alias("score"))
    return x.where("attribute is not null").groupBy("attribute").agg(F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("score"), 4).alias("mean"))


@query(f"WITH {L} SELECT l_linestatus AS level, count(*) AS n, sum((l_linenumber = 7)::INT)::BIGINT AS format_errors, round(avg((l_linenumber <> 7 AND hit)::INT) * 100, 6) AS acc FROM li GROUP BY l_linestatus UNION ALL SELECT 'Overall', count(*), sum((l_linenumber = 7)::INT)::BIGINT, round(avg((l_linenumber <> 7 AND hit)::INT) * 100, 6) FROM li")
def level_format_errors(spark, sf):
    """Accuracy by level, where a badly formed answer is wrong, and how many answers are badly formed."""
    from .base import line_hits

    bad = F.col("l_linenumber") == 7
    m = {"n": F.count(F.lit(1)), "format_errors": F.count_if(bad), "acc": report.percent(~bad & F.col("hit"))}
    return report.levels(line_hits(spark, sf), {"Overall": None, "level": "l_linestatus"}, m).select(F.col("name").alias("level"), "n", "format_errors", "acc")


@query("WITH x AS (SELECT event_type AS name, CASE WHEN event_id % 6 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v, 1 + event_id % 3 AS w FROM events) SELECT name, count(*) FILTER (v IS NOT NULL AND NOT isnan(v)) AS n, round(sum(v * w) FILTER (v IS NOT NULL AND NOT isnan(v)) / sum(w) FILTER (v IS NOT NULL AND NOT isnan(v)), 6) AS mean FROM x GROUP BY name")
def running_average(spark, sf):
    """Weighted means that leave out scores that failed (null) or are no numbers."""
    e = F.col("event_id")
    x = t(spark, sf, "events").select(F.col("event_type").alias("name"), F.when(e % 6 == 0, float("nan")).when(e % 11 != 0, F.col("value")).alias("v"), (1 + e % 3).alias("w"))
    fine = x.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return fine.groupBy("name").agg(F.count(F.lit(1)).alias("n"), _r6(F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
