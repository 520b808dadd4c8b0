"""Yes/no ratings and multiple-choice reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import similarity, text
from ..operators import consistency, report
from .base import L, P, R, line_hits, parts, query, rated, t

_PRF = """count(*) AS n, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp,
 count(*) FILTER (truth = 1 AND pred = 0) AS fn, count(*) FILTER (truth = 0 AND pred = 0) AS tn"""
_RATES = """round(100 * (tp + tn) / n, 6) AS acc, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE 100.0 * tp / (tp + fp) END, 6) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE 100.0 * tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0.0 ELSE 200.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


@query(f"WITH {R}, e AS (SELECT *, unnest([source, lang]) AS category FROM r), c AS (SELECT 'Overall' AS kind, 'Overall' AS name, {_PRF} FROM e UNION ALL SELECT 'category', category, {_PRF} FROM e GROUP BY category) SELECT kind, name, n, tp, fp, fn, tn, {_RATES} FROM c")
def yorn_prf_by_category(spark, sf):
    """Precision, recall and F1 overall and by category; rows with several categories count in each, and so in Overall."""
    e = rated(spark, sf).withColumn("category", F.explode(F.split(F.concat_ws(",", "source", "lang"), ",")))
    out = report.levels(e, {"Overall": None, "category": "category"}, report.confusion(F.col("truth") == 1, F.col("pred") == 1))
    return report.prf(out)


@query(f"WITH {R} SELECT 'Overall' AS kind, 'Overall' AS name, round(avg(hit) * 100, 6) AS acc FROM r UNION ALL SELECT 'category', source, round(avg(hit) * 100, 6) FROM r GROUP BY source UNION ALL SELECT 'l2', lang, round(avg(hit) * 100, 6) FROM r GROUP BY lang")
def yorn_default_rating(spark, sf):
    return report.levels(rated(spark, sf), {"Overall": None, "category": "source", "l2": "lang"}, {"acc": report.percent(F.col("truth") == F.col("pred"))})


@query(f"""WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) AS k FROM r),
v AS (SELECT source, doc_id // 100 AS image, max(hit) FILTER (k = 1) AS v0, max(hit) FILTER (k = 2) AS v1 FROM k GROUP BY ALL),
a AS (SELECT source, round(avg(hit) * 100, 6) AS acc FROM r GROUP BY source),
b AS (SELECT source, round(avg(v0 * v1) * 100, 6) AS acc_plus FROM v WHERE v0 IS NOT NULL AND v1 IS NOT NULL GROUP BY source)
SELECT source AS category, acc, coalesce(acc_plus, 0.0) AS acc_plus, round(acc + coalesce(acc_plus, 0.0), 6) AS score FROM a LEFT JOIN b USING (source)""")
def yorn_pair_plus(spark, sf):
    r = rated(spark, sf).withColumns({"hit": (F.col("truth") == F.col("pred")).cast("int"), "image": F.floor(F.col("doc_id") / 100)})
    two = consistency.first_two(r, ["source", "image"], ["doc_id"], F.col("hit")).groupBy("source").agg(F.round(F.avg(F.col("v0") * F.col("v1")) * 100, 6).alias("acc_plus"))
    one = r.groupBy("source").agg(F.round(F.avg("hit") * 100, 6).alias("acc"))
    return one.join(two, "source", "left").select(F.col("source").alias("category"), "acc", F.coalesce("acc_plus", F.lit(0.0)).alias("acc_plus"), F.round(F.col("acc") + F.coalesce("acc_plus", F.lit(0.0)), 6).alias("score"))


_ALL = lambda key, by: f"SELECT '{key}' AS measure, {by or chr(39) + 'Overall' + chr(39)} AS name, count(*) AS groups, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) * 100, 6) AS acc FROM (SELECT l_returnflag, {key}, bool_and(hit) AS a FROM li GROUP BY l_returnflag, {key}) {'GROUP BY ' + by if by else ''}"


@query(f"WITH {L} " + " UNION ALL ".join(_ALL(k, b) for k in ("l_partkey", "l_suppkey") for b in ("", "l_returnflag")) + " UNION ALL SELECT 'answer', 'Overall', count(*), round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) * 100, 6) FROM li UNION ALL SELECT 'answer', l_returnflag, count(*), round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) * 100, 6) FROM li GROUP BY l_returnflag")
def all_in_group(spark, sf):
    """Accuracy by answer, and by question and figure, where every answer of the group must be right."""
    li = line_hits(spark, sf)
    out = report.levels(li, {"answer": None, "answer ": "l_returnflag"}, {"groups": F.count(F.lit(1)), "acc": report.percent(F.col("hit"))}).select(F.lit("answer").alias("measure"), "name", "groups", "acc")
    for key in ("l_partkey", "l_suppkey"):
        each = li.groupBy("l_returnflag", key).agg(F.bool_and("hit").alias("a"))
        out = out.unionByName(report.levels(each, {"o": None, "f": "l_returnflag"}, {"groups": F.count(F.lit(1)), "acc": report.percent(F.col("a"))}).select(F.lit(key).alias("measure"), "name", "groups", "acc"))
    return out


@query(f"WITH {R}, d AS (SELECT hit, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS dim, lang FROM r), a AS (SELECT dim, lang, avg(hit) * 100 AS acc FROM d GROUP BY ALL), b AS (SELECT dim, avg(acc) AS acc FROM a GROUP BY dim) SELECT dim AS name, round(acc, 6) AS acc FROM b UNION ALL SELECT 'Avg', round(avg(acc), 6) FROM b")
def macro_remap(spark, sf):
    r = rated(spark, sf).withColumns({"dim": F.when(F.col("lang") == "en", "english").otherwise("other"), "hit": (F.col("truth") == F.col("pred")).cast("double") * 100})
    b = report.mean_of_means(r, F.col("hit"), ["lang"], ["dim"])
    return b.select(F.col("dim").alias("name"), F.round("mean", 6).alias("acc")).unionByName(b.agg(F.round(F.avg("mean"), 6).alias("acc")).select(F.lit("Avg").alias("name"), "acc"))


def _hits(spark, sf):
    p = parts(spark, sf)
    return p.withColumn("hit", F.coalesce(text.option_label(F.col("prediction"), list("ABCD")) == F.col("answer"), F.lit(False)))


# A label stands alone and among the last four tokens.
_TOK = "list_filter(string_split(translate(prediction, '.()[],:;!*#{}', '             '), ' '), lambda x: x <> '')"
H = P + f""", k AS (SELECT *, {_TOK} AS tok FROM p), f AS (SELECT *, list_distinct(list_filter(tok, lambda x: x IN ('A','B','C','D'))) AS found FROM k),
o AS (SELECT *, CASE WHEN contains(prediction, 'Failed to obtain answer via API') THEN NULL WHEN contains(prediction, 'Cannot determine the answer') OR contains(prediction, 'I''m sorry, but without the image provided') THEN 'Z'
  WHEN len(found) = 1 AND list_position(tok, found[1]) > len(tok) - 4 THEN found[1] WHEN len(found) = 0 AND list_contains(tok, 'Z') THEN 'Z' END AS label FROM f),
h AS (SELECT *, coalesce(label = answer, false) AS hit FROM o)"""


@query(f"WITH {H}, u AS (SELECT split, 'Overall' AS kind, 'Overall' AS name, hit FROM h UNION ALL SELECT split, 'l2', l2, hit FROM h UNION ALL SELECT split, 'category', category, hit FROM h) SELECT split, kind, name, count(*) AS n, round(avg(hit::INT) * 100, 6) AS acc FROM u GROUP BY ALL")
def mcq_report(spark, sf):
    return report.levels(_hits(spark, sf), {"Overall": None, "l2": "l2", "category": "category"}, {"n": F.count(F.lit(1)), "acc": report.percent(F.col("hit"))}, ["split"]).select("split", "kind", "name", "n", "acc")


@query(f"WITH {H}, c AS (SELECT l2, category, avg(hit::INT) AS a FROM h GROUP BY ALL), l AS (SELECT l2, avg(a) AS a FROM c GROUP BY l2) SELECT l2 AS name, round(a * 100, 6) AS acc FROM l UNION ALL SELECT 'ALL', round(avg(hit::INT) * 100, 6) FROM h")
def mcq_macro_l2(spark, sf):
    """Second-level groups as means of their categories' means, and the plain mean of all rows."""
    h = _hits(spark, sf)
    l2 = report.mean_of_means(h, F.col("hit").cast("double"), ["category"], ["l2"]).select(F.col("l2").alias("name"), F.round(F.col("mean") * 100, 6).alias("acc"))
    return l2.unionByName(h.agg(report.percent(F.col("hit")).alias("acc")).select(F.lit("ALL").alias("name"), "acc"))


_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")


@query("WITH o AS (SELECT o_orderpriority AS subject, c_mktsegment AS setting, (o_orderkey % 3 = 0)::INT AS hit FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT DISTINCT subject FROM o) SELECT s.subject, " + ", ".join(f"round(coalesce((SELECT avg(hit) FROM o WHERE o.subject = s.subject AND setting = '{x}'), 0.0), 6) AS {x.lower()}" for x in _SEG) + ", round((" + " + ".join(f"coalesce((SELECT avg(hit) FROM o WHERE o.subject = s.subject AND setting = '{x}'), 0.0)" for x in _SEG) + ") / 5, 6) AS average FROM s")
def mcq_pivot_avg(spark, sf):
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("subject"), F.col("c_mktsegment").alias("setting"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("hit"))
    w = report.pivot_report(o, "subject", "setting", _SEG, F.col("hit"))
    return w.select("subject", *[F.round(x, 6).alias(x.lower()) for x in _SEG], F.round("Avg", 6).alias("average"))


@query(f"WITH {H} SELECT key, label FROM h")
def mcq_option_extract(spark, sf):
    return parts(spark, sf).select("key", text.option_label(F.col("prediction"), list("ABCD")).alias("label"))


@query(f"""WITH {P}, x AS (SELECT key, lower(p_name || ' of size ' || p_size) AS ans, lower(p_name) AS a, 'size ' || (p_size + 100) AS b, 'other' AS c FROM p),
y AS (SELECT key, list_filter([CASE WHEN contains(ans, a) THEN 'A' END, CASE WHEN contains(ans, b) THEN 'B' END, CASE WHEN contains(ans, c) THEN 'C' END], lambda v: v IS NOT NULL) AS hits, length(ans) <= 2 * (length(a) + length(b) + length(c)) AS fits FROM x)
SELECT key, CASE WHEN fits AND len(hits) = 1 THEN hits[1] END AS label FROM y""")
def mcq_text_match(spark, sf):
    p = parts(spark, sf)
    options = F.create_map(F.lit("A"), F.col("p_name"), F.lit("B"), F.concat(F.lit("size "), (F.col("p_size") + 100).cast("string")), F.lit("C"), F.lit("other"))
    return p.select("key", text.option_text(F.concat("p_name", F.lit(" of size "), F.col("p_size").cast("string")), options).alias("label"))


@query("""WITH q AS (SELECT p_partkey AS key, ['A','B','C','D'][CAST(p_partkey % 4 + 1 AS INT)] AS answer, [p_name, p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'size' || p_size END] AS o FROM part),
v AS (SELECT *, list_filter(o, lambda x: x IS NOT NULL) AS txt FROM q),
r AS (SELECT *, len(txt) AS k, unnest(range(0, len(txt))) AS rot FROM v)
SELECT key + 1000000 * rot AS key, key % 1000000 AS g_index, CAST(rot AS INT) AS rotation,
 txt[((0 - rot + k) % k) + 1] AS a, txt[((1 - rot + k) % k) + 1] AS b, txt[((2 - rot + k) % k) + 1] AS c, CASE WHEN k = 4 THEN txt[((3 - rot + k) % k) + 1] END AS d,
 CASE WHEN list_position(['A','B','C','D'][1:k], answer) > 0 THEN ['A','B','C','D'][1:k][((list_position(['A','B','C','D'][1:k], answer) - 1 + rot) % k) + 1] ELSE answer END AS answer FROM r""")
def circular_expand(spark, sf):
    from ..operators import generate

    k = F.col("p_partkey")
    q = t(spark, sf, "part").select(k.alias("key"), F.element_at(F.array(*map(F.lit, "ABCD")), (k % 4 + 1).cast("int")).alias("answer"), F.col("p_name").alias("A"), F.col("p_brand").alias("B"), F.col("p_type").alias("C"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("D"))
    return generate.circular_options(q, "key", list("ABCD"), "answer").select("key", "g_index", "rotation", F.col("A").alias("a"), F.col("B").alias("b"), F.col("C").alias("c"), F.col("D").alias("d"), "answer")


@query(f"WITH {L} SELECT l_orderkey AS g_index, bool_and(hit)::INT AS hit, count(*) AS n FROM li GROUP BY l_orderkey")
def circular_eval(spark, sf):
    return consistency.circular(line_hits(spark, sf), "l_orderkey", F.col("hit"), F.lit(True)).withColumnRenamed("l_orderkey", "g_index")


@query(f"WITH {L}, c AS (SELECT l_linenumber AS cycle, l_shipmode AS category, avg(hit::INT) * 100 AS a FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM li) GROUP BY ALL) SELECT CAST(cycle AS VARCHAR) AS cycle, category, round(a, 6) AS acc FROM c UNION ALL SELECT 'Average', category, round(avg(a), 6) FROM c GROUP BY category")
def cycle_average(spark, sf):
    c = line_hits(spark, sf).groupBy(F.col("l_linenumber").cast("string").alias("cycle"), F.concat("l_returnflag", "l_linestatus").alias("category")).agg((F.avg(F.col("hit").cast("double")) * 100).alias("a"))
    return c.select("cycle", "category", F.round("a", 6).alias("acc")).unionByName(c.groupBy("category").agg(F.round(F.avg("a"), 6).alias("acc")).select(F.lit("Average").alias("cycle"), "category", "acc"))


@query(f"""WITH {L}, x AS (SELECT l_orderkey, l_linenumber AS r, max(hit::INT) AS hit FROM li WHERE l_linenumber <= 4 GROUP BY ALL),
w AS (SELECT l_orderkey, max(hit) FILTER (r = 1) AS a, max(hit) FILTER (r = 2) AS b, max(hit) FILTER (r = 3) AS c, max(hit) FILTER (r = 4) AS d FROM x GROUP BY l_orderkey)
SELECT l_orderkey % 10 AS category, count(*) AS n, round(avg(a * b * c * d) * 100, 3) AS hit_all, round(avg((1 - a) * (1 - b) * (1 - c) * (1 - d)) * 100, 3) AS miss_all FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL GROUP BY ALL""")
def rotation_consistency(spark, sf):
    w = consistency.rotations(line_hits(spark, sf).where("l_linenumber <= 4"), ["l_orderkey"], "l_linenumber", "hit", [1, 2, 3, 4])
    return w.groupBy((F.col("l_orderkey") % 10).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit_all") * 100, 3).alias("hit_all"), F.round(F.avg("miss_all") * 100, 3).alias("miss_all"))


@query(f"""WITH {L}, w AS (SELECT l_orderkey, max(hit::INT) FILTER (l_linenumber = 1) AS a, max(hit::INT) FILTER (l_linenumber = 2) AS b, max(hit::INT) FILTER (l_linenumber = 3) AS c, max(hit::INT) FILTER (l_linenumber = 4) AS d FROM li GROUP BY l_orderkey)
SELECT count(*) AS groups, round(avg((a * b + c * d) / 2.0) * 100, 6) AS q_acc, round(avg((a * c + b * d) / 2.0) * 100, 6) AS i_acc, round(avg(a * b * c * d) * 100, 6) AS g_acc, round(avg((a + b + c + d) / 4.0) * 100, 6) AS acc FROM w WHERE a + b + c + d IS NOT NULL""")
def four_cell_groups(spark, sf):
    return consistency.four_cells(line_hits(spark, sf).withColumn("cell", F.col("l_linenumber") - 1), "l_orderkey", "cell", "hit")


@query(f"WITH {L}, k AS (SELECT l_returnflag AS subject, l_orderkey, min(hit::INT) AS w, sum(hit::INT) AS s, count(*) AS n FROM li GROUP BY ALL) SELECT subject, round(sum(s) / sum(n) * 100, 6) AS average, round(avg(w) * 100, 6) AS worst_case FROM k GROUP BY subject")
def worst_case(spark, sf):
    return consistency.worst_case(line_hits(spark, sf).withColumnRenamed("l_returnflag", "subject"), "l_orderkey", F.col("hit"), ["subject"])


@query(f"""WITH {L}, s AS (SELECT l_orderkey AS id, bool_or(hit) FILTER (l_linenumber = 1) AS h1, bool_or(hit) FILTER (l_linenumber = 2) AS h2, bool_or(hit) FILTER (l_linenumber = 3) AS h FROM li GROUP BY l_orderkey HAVING bool_or(l_linenumber = 3)),
c AS (SELECT id, coalesce(h1, false) AS h1, coalesce(h2, false) AS h2, h FROM s)
SELECT count(*) AS n, count(*) FILTER (h AND h1 AND h2) AS cm_strict, count(*) FILTER (h AND (h1 OR h2)) AS cm_loose, count(*) FILTER (NOT h AND h1 AND h2) AS ig, count(*) FILTER (NOT h AND NOT (h1 AND h2)) AS ik, count(*) FILTER (h AND NOT (h1 AND h2)) AS rm_strict, count(*) FILTER (h AND NOT h1 AND NOT h2) AS rm_loose FROM c""")
def step_chain_4d(spark, sf):
    li = line_hits(spark, sf)
    step = lambda k, name: li.where(F.col("l_linenumber") == k).groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or("hit").alias(name))
    c = consistency.step_chain(step(1, "hit_1").join(step(2, "hit_2"), "id", "full"), step(3, "hit"))
    return c.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in ("cm_strict", "cm_loose", "ig", "ik", "rm_strict", "rm_loose")])


@query(f"WITH {L}, a AS (SELECT l_returnflag AS category, l_partkey, bool_and(hit)::INT AS a FROM li GROUP BY ALL), m AS (SELECT category, avg(a) * 100 AS m FROM a GROUP BY category) SELECT category AS name, round(m, 6) AS acc FROM m UNION ALL SELECT 'Overall', round(avg(m), 6) FROM m")
def nested_all_mean(spark, sf):
    m = consistency.all_right(line_hits(spark, sf), ["l_partkey"], F.col("hit"), ["l_returnflag"]).select(F.col("l_returnflag").alias("name"), "acc")
    each = line_hits(spark, sf).groupBy("l_returnflag", "l_partkey").agg(F.bool_and("hit").alias("a"))
    overall = report.mean_of_means(each, F.col("a").cast("double") * 100, ["l_returnflag"]).select(F.lit("Overall").alias("name"), F.round("mean", 6).alias("acc"))
    return m.unionByName(overall)


@query("WITH v AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'A>>B' WHEN 1 THEN 'A>B' WHEN 2 THEN 'A=B' WHEN 3 THEN 'B>A' ELSE 'B>>A' END AS v, o_orderkey % 2 = 1 AS rev FROM orders), s AS (SELECT CASE WHEN rev THEN -1 ELSE 1 END * CASE v WHEN 'A>>B' THEN 2 WHEN 'A>B' THEN 1 WHEN 'A=B' THEN 0 WHEN 'B>A' THEN -1 ELSE -2 END AS s FROM v) SELECT count(*) AS n, count(*) FILTER (s = 2) AS much_better, count(*) FILTER (s = 1) AS better, count(*) FILTER (s = 0) AS tie, count(*) FILTER (s = -1) AS worse, count(*) FILTER (s = -2) AS much_worse, round(sum(s) * 50.0 / count(*), 6) AS reward, round(count(*) FILTER (s > 0) * 100.0 / count(*), 6) AS win_rate FROM s")
def pairwise_reward(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").withColumn("v", F.element_at(F.array(*map(F.lit, ("A>>B", "A>B", "A=B", "B>A", "B>>A"))), (k % 5 + 1).cast("int")))
    return report.pairwise(o, F.col("v"), k % 2 == 1)


@query(f"""WITH {R}, x AS (SELECT CASE WHEN lang = 'en' THEN 'original' ELSE lang END AS g, truth, pred FROM r),
u AS (SELECT g, truth, pred FROM x WHERE g <> 'original' UNION ALL SELECT o.g, truth, pred FROM x, (SELECT DISTINCT g FROM x WHERE g <> 'original') o WHERE x.g = 'original'),
c AS (SELECT g, {_PRF} FROM u GROUP BY g), m AS (SELECT g AS name, n, tp, fp, fn, tn, {_RATES} FROM c)
SELECT name, acc, precision, recall, f1 FROM m UNION ALL SELECT 'macro', round(avg(acc), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM m""")
def control_group_metrics(spark, sf):
    x = rated(spark, sf).select(F.when(F.col("lang") == "en", "original").otherwise(F.col("lang")).alias("g"), "truth", "pred")
    u = report.control_groups(x, "g", "original")
    m = report.prf(u.groupBy(F.col("g").alias("name")).agg(*[c.alias(k) for k, c in report.confusion(F.col("truth") == 1, F.col("pred") == 1).items()])).select("name", "acc", "precision", "recall", "f1")
    return m.unionByName(m.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("acc", "precision", "recall", "f1")]).select(F.lit("macro").alias("name"), "acc", "precision", "recall", "f1"))


@query(f"WITH {R}, e AS (SELECT hit, unnest(['Overall', lang, source]) AS skill FROM r) SELECT skill, count(*) AS tot, CAST(sum(hit) AS DOUBLE) AS hit, round(avg(hit) * 100, 6) AS rate FROM e GROUP BY skill")
def multi_label_skill(spark, sf):
    r = rated(spark, sf)
    return report.multi_valued(r, F.array("lang", "source"), F.col("truth") == F.col("pred"))


@query("""WITH f AS (SELECT event_type AS task, user_id AS q, event_id % 4 AS field, 1.0 + event_id % 3 AS weight, CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE (event_id % 7) / 6.0 END AS score FROM events),
q AS (SELECT task, q, coalesce(sum(score * weight) FILTER (score >= 0) / nullif(sum(weight) FILTER (score >= 0), 0), -1.0) AS s FROM f GROUP BY ALL),
k AS (SELECT task, avg(greatest(s, 0.0)) AS mean, count(*) AS n FROM q GROUP BY task)
SELECT task AS name, round(mean, 6) AS score, n FROM k UNION ALL SELECT 'macro', round(avg(mean), 6), CAST(sum(n) AS BIGINT) FROM k UNION ALL SELECT 'micro', round(sum(mean * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM k""")
def weighted_fields_macro_micro(spark, sf):
    e = F.col("event_id")
    f = t(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("query"), (e % 4).alias("field"), (1.0 + e % 3).alias("weight"), F.when(e % 11 == 0, -1.0).otherwise((e % 7) / 6.0).alias("score"))
    tasks, both = report.field_task_report(f)
    both = both.crossJoin(tasks.agg(F.sum("n").alias("n")))
    return tasks.select(F.col("task").alias("name"), F.round("mean", 6).alias("score"), "n").unionByName(both.select(F.lit("macro").alias("name"), F.round("macro", 6).alias("score"), "n")).unionByName(both.select(F.lit("micro").alias("name"), F.round("micro", 6).alias("score"), "n"))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * p_retailprice) / abs(l_quantity * p_retailprice) <= 0.05 AS hit FROM lineitem JOIN part ON l_partkey = p_partkey")
def relaxed_accuracy(spark, sf):
    j = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", similarity.relaxed(F.col("l_extendedprice").cast("string"), (F.col("l_quantity") * F.col("p_retailprice")).cast("string")).alias("hit"))


_ROOM = "[" + ", ".join(f"{1 - (0.5 + 0.05 * k)!r}::DOUBLE" for k in range(20)) + "]"


@query(f"WITH j AS (SELECT l_returnflag, abs(l_extendedprice - s * l_quantity * p_retailprice) / nullif(s * l_quantity * p_retailprice, 0) AS e FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS s FROM lineitem) JOIN part ON l_partkey = p_partkey) SELECT l_returnflag AS name, count(*) AS n, round(avg(coalesce(len(list_filter({_ROOM}, lambda x: e < x)), 0) / 10.0), 6) AS mra FROM j GROUP BY l_returnflag")
def mra_score(spark, sf):
    j = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    target = F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1) * F.col("l_quantity") * F.col("p_retailprice")
    return j.groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(similarity.mean_relative_accuracy(F.col("l_extendedprice"), target)), 6).alias("mra"))
