"""Statistics, set operations, vectors and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from ..functions import similarity
from ..operators import consistency, report, stats
from ..streaming import processors
from .base import R, query, rated, t


def _draw_sql(*parts: str, n: str) -> str:
    x = "12345::BIGINT"
    for p in parts:
        x = f"((({x}) * 1103515245 + ({p})::BIGINT * 12820163 + 12345) % 2147483647)"
    return f"(((({x}) // 65536) * 31 + ({x})) % ({n}))"


@query(f"""WITH {R}, p AS (SELECT lang, doc_id, hit, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM r), z AS (SELECT lang, count(*) AS n, min(doc_id) AS seed FROM r GROUP BY lang),
s AS (SELECT p.lang, p.place AS slot, n, seed, unnest(range(0, 1000)) AS replicate FROM p JOIN z USING (lang)), d AS (SELECT lang, replicate, {_draw_sql('seed', 'replicate', 'slot', n='n')} AS place FROM s),
m AS (SELECT replicate, d.lang, avg(hit) AS m FROM d JOIN p ON d.lang = p.lang AND d.place = p.place GROUP BY ALL), e AS (SELECT replicate, avg(m) AS mean FROM m GROUP BY replicate)
SELECT round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM e""")
def bootstrap_ci(spark, sf):
    r = rated(spark, sf).withColumn("hit", (F.col("truth") == F.col("pred")).cast("int"))
    return stats.bootstrap(r, "lang", "doc_id", "hit", 1000)


@query(f"""WITH {R}, x AS (SELECT lang, doc_id, hit, doc_id % 2 = 0 AS a FROM r), z AS (SELECT lang, count(*) FILTER (a) AS na, count(*) AS n FROM x GROUP BY lang HAVING count(*) FILTER (a) BETWEEN 1 AND count(*) - 1), b AS (SELECT x.*, na FROM x JOIN z USING (lang)),
o AS (SELECT round(avg(g), 9) AS d FROM (SELECT lang, avg(hit) FILTER (a) - avg(hit) FILTER (NOT a) AS g FROM b GROUP BY lang)),
e AS (SELECT b.*, unnest(range(0, 10000)) AS replicate FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY replicate, lang ORDER BY {_draw_sql('replicate', 'doc_id', n='2147483647')}, doc_id) <= na AS s FROM e),
p AS (SELECT replicate, round(avg(g), 9) AS d FROM (SELECT replicate, lang, avg(hit) FILTER (s) - avg(hit) FILTER (NOT s) AS g FROM k GROUP BY ALL) GROUP BY replicate)
SELECT max(o.d) AS observed, round(avg((abs(p.d) >= abs(o.d))::INT), 6) AS p FROM p, o""")
def permutation_test(spark, sf):
    r = rated(spark, sf).withColumns({"hit": (F.col("truth") == F.col("pred")).cast("int"), "a": F.col("doc_id") % 2 == 0})
    return stats.permutation(r.select("lang", "doc_id", "hit", F.col("a").alias("g")), "lang", "doc_id", "g", "hit", 10000)


@query("""WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
SELECT e.label, count(*) AS n, round(avg(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c)), 6) AS cosine FROM embeddings e JOIN c USING (label) GROUP BY e.label""")
def cosine_pairs(spark, sf):
    """Mean cosine of each label's vectors with their mean vector."""
    e = t(spark, sf, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(c, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(similarity.cosine(F.col("embedding"), F.col("c"))), 6).alias("cosine"))


@query()
def frechet_by_label(spark, sf):
    """Fréchet distance of each label's vectors to those of the smallest label, over all components; only moments (dimensions squared) reach the driver."""
    found = stats.moments(t(spark, sf, "embeddings"), "embedding", ["label"]).collect()  # labels * dimensions squared rows
    size = max((r["i"] for r in found), default=-1) + 1
    held: dict = {}
    for r in found:
        mean, cov = held.setdefault(r["label"], (np.zeros(size), np.zeros((size, size))))
        mean[r["i"]], cov[r["i"], r["j"]] = r["mean"], r["cov"]
    first = held[min(held)] if held else None
    return spark.createDataFrame([(int(k), round(stats.frechet(*first, *v), 6)) for k, v in sorted(held.items())], "label int, distance double")


@query("SELECT c.c_custkey, p.p AS priority FROM customer c, (SELECT DISTINCT o_orderpriority AS p FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = p.p)")
def missing_matrix(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"))
    return consistency.missing(t(spark, sf, "customer").select("c_custkey"), o.select("priority").distinct(), o)


_REG = "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()


@query("WITH o AS (SELECT n_name, c_mktsegment AS s, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, " + ", ".join(f"round(avg(v) FILTER (s = '{x}'), 4) AS {x.lower()}" for x in _REG) + " FROM o GROUP BY n_name")
def summary_pivot(spark, sf):
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    w = o.groupBy("n_name").pivot("c_mktsegment", _REG).agg(F.round(F.avg("o_totalprice"), 4))
    return w.select("n_name", *[F.col(x).alias(x.lower()) for x in _REG])


@query("WITH u AS (SELECT 'region' AS member, 0 AS m, r_regionkey AS original_index, r_name AS name FROM region UNION ALL SELECT 'nation', 1, n_nationkey, n_name FROM nation) SELECT member, CAST(original_index AS INTEGER) AS original_index, name, row_number() OVER (ORDER BY m, original_index) - 1 AS \"index\" FROM u")
def union_lineage(spark, sf):
    from ..sources.tables import concat_tables

    r = t(spark, sf, "region").select(F.col("r_regionkey").alias("index"), F.col("r_name").alias("name"))
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))
    return concat_tables({"region": r, "nation": n}).select("member", "original_index", "name", "index")


@query("WITH done AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) SELECT d.doc_id, q AS result, q IS NULL AS todo FROM documents d LEFT JOIN done USING (doc_id)")
def resume_anti_join(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id")
    done = consistency.last_wins(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")
    todo = consistency.resume(docs, done, "doc_id").select("doc_id", F.lit(None).cast("int").alias("result"), F.lit(True).alias("todo"))
    return todo.unionByName(docs.join(done, "doc_id").select("doc_id", F.col("quality").alias("result"), F.lit(False).alias("todo")))


@query("SELECT l_returnflag AS type, round(sum((1 + l_linenumber % 3) * (l_quantity::BIGINT % 3 <> 0)::INT)::DOUBLE / sum(1 + l_linenumber % 3), 6) AS acc FROM lineitem GROUP BY ALL")
def weighted_accuracy(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.round(report.weighted_accuracy(1 + F.col("l_linenumber") % 3, F.col("l_quantity").cast("long") % 3 != 0), 6).alias("acc"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS k FROM n) SELECT user_id, event_type FROM k WHERE k = 1")
def majority_vote(spark, sf):
    return consistency.majority(t(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT o_orderpriority AS kind, round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 6) AS scaled, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def shared_range_scaling(spark, sf):
    o = stats.shared_range(t(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return o.select(F.col("o_orderpriority").alias("kind"), F.round("scaled", 6).alias("scaled"), "o_orderkey")


@query("WITH e AS (SELECT e.user_id, e.event_id, e.ts, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS seen FROM events e WHERE event_type <> 'purchase') SELECT user_id, event_id, CAST(floor(epoch(ts)) - floor(epoch(seen)) AS BIGINT) AS gap FROM e")
def as_of_join(spark, sf):
    """Each event with the user's latest purchase before it."""
    from ..operators import joins

    e = t(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("seen"))
    j = joins.as_of(e.where("event_type <> 'purchase'").select("user_id", "event_id", "at"), p, ["user_id"], "at", "seen")
    return j.select("user_id", "event_id", (F.unix_timestamp("at") - F.unix_timestamp("seen")).alias("gap"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS seq, event_id % 50 + 1 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
p AS (SELECT session, [0::BIGINT] || list(s ORDER BY k) AS p FROM (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY k)::BIGINT AS s FROM e) GROUP BY session),
st AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS seq, 1::BIGINT AS f, 0::BIGINT AS held, 0::BIGINT AS evicted FROM p
 UNION ALL SELECT session, k, seq, g, p[k + 1] - p[g], p[g] - p[f] FROM (SELECT st.session, e.k, e.seq, st.f, p.p,
  CASE WHEN p.p[e.k + 1] - p.p[st.f] > 200 THEN coalesce(list_min(list_filter(range(st.f, e.k + 2), lambda j: p.p[j] - p.p[st.f] >= 40)), e.k + 1) ELSE st.f END AS g
  FROM st JOIN e ON e.session = st.session AND e.k = st.k + 1 JOIN p ON p.session = st.session))
SELECT session, seq, held, evicted FROM st WHERE k > 0""")
def budget_eviction(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 50 + 1).cast("int").alias("tokens"))
    return processors.budget_batch(e, budget=200)


@query(r"""WITH RECURSIVE c AS (SELECT conv_id AS session, role, CASE WHEN suffix(text, ' ...') THEN regexp_replace(substr(text, 1, length(text) - 4), '^\s+|\s+$', '', 'g') ELSE text END AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE regexp_matches(text, '\S')),
st AS (SELECT session, 0::BIGINT AS k, NULL::VARCHAR AS speaker, '' AS buffer, NULL::VARCHAR AS teller, []::VARCHAR[] AS said FROM (SELECT DISTINCT session FROM c)
 UNION ALL SELECT session, k, CASE WHEN ten THEN NULL ELSE role END, CASE WHEN ends THEN regexp_replace(regexp_extract(b, '[^.!?]*$'), '^\s+|\s+$', '', 'g') WHEN ten THEN '' ELSE b END, CASE WHEN same THEN role ELSE before END,
  CASE WHEN ends THEN [regexp_replace(v, '^\s+|\s+$', '', 'g') FOR v IN regexp_extract_all(b, '[^.!?]*[.!?]')] WHEN ten THEN [regexp_replace(b, '^\s+|\s+$', '', 'g')] WHEN NOT same AND regexp_matches(old, '\S') THEN [regexp_replace(old, '^\s+|\s+$', '', 'g')] ELSE []::VARCHAR[] END
  FROM (SELECT *, same AND regexp_matches(b, '[.!?]') AS ends, same AND NOT regexp_matches(b, '[.!?]') AND len(string_split(regexp_replace(b, '^\s+|\s+$', '', 'g'), ' ')) >= 10 AS ten FROM
   (SELECT st.session, c.k, c.role, st.speaker AS before, st.buffer AS old, st.speaker IS NULL OR st.speaker = c.role AS same, CASE WHEN st.speaker IS NULL OR st.speaker = c.role THEN st.buffer || ' ' || c.x ELSE c.x END AS b FROM st JOIN c ON c.session = st.session AND c.k = st.k + 1))),
l AS (SELECT session, max(k) AS k FROM st GROUP BY session),
o AS (SELECT session, k, unnest(said) AS sentence, unnest(range(0, len(said))) AS i, teller AS speaker FROM st UNION ALL SELECT st.session, st.k + 1, regexp_replace(buffer, '^\s+|\s+$', '', 'g'), 0, speaker FROM st JOIN l ON st.session = l.session AND st.k = l.k WHERE regexp_matches(buffer, '\S'))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY k, i) - 1 AS n, speaker, sentence FROM o""")
def sentence_emission(spark, sf):
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")
    return processors.sentences_batch(c)


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS tick, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tick_stream(spark, sf):
    """Tumbling windows by Structured Streaming over the event files, run to the end of what is there."""
    return processors.tick_table(spark, f"{sf}/events.parquet", "1 day")
