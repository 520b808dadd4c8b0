"""Segments, clips, ticks and boxes."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geometry
from ..operators import generate, joins, ordered, report
from ..streaming import sessions
from .base import S, query, segments, t


def _boxes(spark, sf):
    q, k, n = F.col("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")
    target = geometry.box_from_size(k % 50, k % 40, q, q + 5)
    pred = geometry.box_from_size(k % 50 + n, k % 40 + 1, q, q + n)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", target.alias("target"), pred.alias("pred"))


_IOU = """b AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_partkey % 50)::DOUBLE AS x1, (l_partkey % 40)::DOUBLE AS y1, l_partkey % 50 + l_quantity AS x2, l_partkey % 40 + l_quantity + 5 AS y2,
 (l_partkey % 50 + l_linenumber)::DOUBLE AS u1, (l_partkey % 40 + 1)::DOUBLE AS v1, l_partkey % 50 + l_linenumber + l_quantity AS u2, l_partkey % 40 + 1 + l_quantity + l_linenumber AS v2 FROM lineitem),
w AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS i FROM b),
m AS (SELECT *, CASE WHEN (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - i > 0 THEN i / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - i) ELSE 0.0 END AS iou, ((u1 + u2) / 2 BETWEEN x1 AND x2 AND (v1 + v2) / 2 BETWEEN y1 AND y2)::INT AS c FROM w)"""
_AT = (0.1, 0.3, 0.5, 0.7, 0.9)


@query(f"WITH {_IOU}, u AS (SELECT 'Overall' AS kind, 'Overall' AS name, * FROM m UNION ALL SELECT 'type', l_returnflag, * FROM m) SELECT kind, name, count(*) AS n, round(avg(iou), 6) AS iou, round(avg(c) * 100, 6) AS center_acc, " + ", ".join(f"round(avg((iou >= {a})::INT) * 100, 6) AS acc_{int(a * 10)}" for a in _AT) + " FROM u GROUP BY ALL")
def bbox_iou_report(spark, sf):
    b = _boxes(spark, sf).withColumns({"iou": geometry.iou(F.col("target"), F.col("pred")), "c": geometry.center_inside(F.col("pred"), F.col("target"))})
    measures = {"n": F.count(F.lit(1)), "iou": F.round(F.avg("iou"), 6), "center_acc": report.percent(F.col("c"))} | {f"acc_{int(a * 10)}": report.percent(F.col("iou") >= a) for a in _AT}
    return report.levels(b, {"Overall": None, "type": "l_returnflag"}, measures)


@query(f"""WITH {_IOU.split('w AS (')[0].rstrip().rstrip(',')}, n AS (SELECT *, row_number() OVER () AS rid FROM b), p AS (SELECT a.l_orderkey, a.rid, greatest(0, least(a.x2, z.u2) - greatest(a.x1, z.u1)) * greatest(0, least(a.y2, z.v2) - greatest(a.y1, z.v1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (z.u2 - z.u1) * (z.v2 - z.v1) AS s FROM n a JOIN n z USING (l_orderkey)),
o AS (SELECT l_orderkey, rid, max(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0.0 END) AS best FROM p GROUP BY ALL) SELECT l_orderkey, count(*) AS n, round(avg(best), 6) AS iou FROM o GROUP BY l_orderkey""")
def best_iou_match(spark, sf):
    g = _boxes(spark, sf).groupBy("l_orderkey").agg(F.collect_list("target").alias("ts"), F.collect_list("pred").alias("ps"))
    best = geometry.best_iou(F.col("ts"), F.col("ps"))
    return g.select("l_orderkey", F.size("ts").cast("long").alias("n"), F.round(F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size("ts"), 6).alias("iou"))


_MERGED = lambda src, name: f"""{name}0 AS (SELECT user_id, start, "end", max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {src}), {name}1 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM {name}0), {name} AS (SELECT user_id, g, min(start) AS start, max("end") AS "end" FROM {name}1 GROUP BY ALL)"""


@query(f"""WITH {S}, ga AS (SELECT * FROM g WHERE event_id % 2 = 0), gb AS (SELECT * FROM g WHERE event_id % 2 = 1), {_MERGED('ga', 'a')}, {_MERGED('gb', 'b')},
la AS (SELECT user_id, sum("end" - start) AS la FROM a GROUP BY user_id), lb AS (SELECT user_id, sum("end" - start) AS lb FROM b GROUP BY user_id),
c AS (SELECT user_id, sum(greatest(0, least(a."end", b."end") - greatest(a.start, b.start))) AS c FROM a JOIN b USING (user_id) GROUP BY user_id)
SELECT user_id, round(coalesce(c, 0) / (la + lb - coalesce(c, 0))::DOUBLE, 6) AS iou FROM la JOIN lb USING (user_id) LEFT JOIN c USING (user_id)""")
def interval_set_iou(spark, sf):
    s = segments(spark, sf).withColumn("iv", F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))
    g = s.groupBy("user_id").agg(F.collect_list(F.when(F.col("event_id") % 2 == 0, F.col("iv"))).alias("a"), F.collect_list(F.when(F.col("event_id") % 2 == 1, F.col("iv"))).alias("b"))
    return g.where("size(a) > 0 and size(b) > 0").select("user_id", F.round(geometry.interval_sets_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(f"""WITH {S}, x AS (SELECT event_type, "end" - start AS d, (event_id % 3 = 0)::INT AS long_acc, (event_id % 2 = 0)::INT AS clue_acc, (event_id % 10) / 10.0 AS iou FROM g),
k AS (SELECT *, CASE WHEN d > 0 AND d <= 30 THEN '(0,30]' WHEN d > 30 AND d <= 60 THEN '(30,60]' WHEN d > 60 AND d <= 90 THEN '(60,90]' END AS bin FROM x),
u AS (SELECT 'Overall' AS kind, 'Overall' AS name, * FROM k UNION ALL SELECT 'duration', bin, * FROM k UNION ALL SELECT 'domain', event_type, * FROM k)
SELECT kind, name, count(*) AS n, round(avg(long_acc), 6) AS long_acc, round(avg(clue_acc), 6) AS clue_acc, round(avg(iou), 6) AS miou, round(CASE WHEN avg(clue_acc) > 0 THEN least(avg(long_acc), avg(clue_acc)) / avg(clue_acc) END, 6) AS crr,
 round(avg((iou > 0.1 AND long_acc = 1)::INT + (iou > 0.2 AND long_acc = 1)::INT + (iou > 0.3 AND long_acc = 1)::INT + (iou > 0.4 AND long_acc = 1)::INT + (iou > 0.5 AND long_acc = 1)::INT) / 5, 6) AS acc_iou FROM u GROUP BY ALL""")
def duration_bins_crr(spark, sf):
    """By duration bin and domain: accuracies, mean IoU, clue recovery rate, and accuracy where the IoU also passes, over five thresholds."""
    e = F.col("event_id")
    x = segments(spark, sf).select("event_type", report.right_closed_bin(F.col("end") - F.col("start"), [0, 30, 60, 90]).alias("bin"), (e % 3 == 0).cast("int").alias("l"), (e % 2 == 0).cast("int").alias("c"), ((e % 10) / 10.0).alias("iou"))
    passed = sum(((F.col("iou") > v) & (F.col("l") == 1)).cast("int") for v in (0.1, 0.2, 0.3, 0.4, 0.5))
    m = {"n": F.count(F.lit(1)), "long_acc": F.round(F.avg("l"), 6), "clue_acc": F.round(F.avg("c"), 6), "miou": F.round(F.avg("iou"), 6), "crr": F.round(F.try_divide(F.least(F.avg("l"), F.avg("c")), F.avg("c")), 6), "acc_iou": F.round(F.avg(passed) / 5, 6)}
    return report.levels(x, {"Overall": None, "duration": "bin", "domain": "event_type"}, m)


@query(f"""WITH {S} SELECT p.user_id, p.event_id, count(*) AS n, min(i.event_id) AS first_id FROM g p JOIN g i ON p.user_id = i.user_id AND p.start > i.start AND p.start < i."end" GROUP BY ALL""")
def interval_join_subtitles(spark, sf):
    s = segments(spark, sf)
    p = s.select("user_id", "event_id", F.col("start").alias("at"))
    i = s.select("user_id", F.col("event_id").alias("sub"), "start", "end")
    return joins.points_in_intervals(p, i, "at", "start", "end", ["user_id"]).groupBy("user_id", "event_id").agg(F.count(F.lit(1)).alias("n"), F.min("sub").alias("first_id"))


@query(f"""WITH {S}, w AS (SELECT *, lag("end") OVER o AS b, lead(start) OVER o AS a FROM g WINDOW o AS (PARTITION BY user_id ORDER BY start, event_id)) SELECT event_id, CASE WHEN b > start THEN (b + start) / 2.0::DOUBLE ELSE start END::DOUBLE AS new_start, CASE WHEN "end" > a THEN ("end" + a) / 2.0::DOUBLE ELSE "end" END::DOUBLE AS new_end FROM w""")
def timestamp_smoothing(spark, sf):
    s = segments(spark, sf).withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    return ordered.smooth(s, ["user_id"], ["start", "event_id"]).select("event_id", "new_start", "new_end")


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w, 1 + length(text) % 5 AS n FROM conversations), k AS (SELECT *, len(w) // n AS small, len(w) % n AS more FROM w), e AS (SELECT *, unnest(range(0, n)) AS i FROM k)
SELECT conv_id, turn, CAST(i AS BIGINT) AS second, coalesce(array_to_string(list_slice(w, i * small + least(i, more) + 1, (i + 1) * small + least(i + 1, more)), ' '), '') AS segment FROM e""")
def split_to_seconds(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit(0.0).alias("start"), (1 + F.length("text") % 5).cast("double").alias("end"))
    return generate.to_seconds(c, "text", "start", "end").select("conv_id", "turn", "second", "segment")


@query(f"""WITH {S}, d AS (SELECT user_id, max("end") AS duration FROM g GROUP BY user_id), c AS (SELECT user_id, duration, unnest(range(0, duration, 36000)) AS b FROM d), k AS (SELECT user_id, b AS clip_begin, least(b + 72000, duration) AS clip_end FROM c WHERE least(b + 72000, duration) - b >= 18000)
SELECT k.user_id, clip_begin, clip_end, count(g.event_id) AS n, coalesce(sum(g."end" - g.start), 0)::BIGINT AS active FROM k LEFT JOIN g ON k.user_id = g.user_id AND g.start >= clip_begin AND g."end" <= clip_end GROUP BY ALL""")
def sliding_clips(spark, sf):
    """Overlapping clips with the segments that lie wholly inside, and how long these are."""
    s = segments(spark, sf)
    d = s.groupBy("user_id").agg(F.max("end").alias("duration"))
    k = generate.windows(d, "duration", 72000, 36000, 18000).select("user_id", F.col("clip_begin").cast("long").alias("clip_begin"), "clip_end")
    inside = joins.contained(k, s.select("user_id", "event_id", "start", "end"), "clip_begin", "clip_end", "start", "end", ["user_id"], 36000.0)
    n = inside.groupBy("user_id", "clip_begin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("active"))
    return k.join(n, ["user_id", "clip_begin"], "left").na.fill(0, ["n", "active"])


@query(f"""WITH {S} SELECT user_id, start // 3600 AS second, count(*) AS n, string_agg(event_type, ' ' ORDER BY start, event_id) AS text FROM g GROUP BY ALL""")
def one_second_concat(spark, sf):
    """Tumbling concatenation in order; the test stream is sparse, so its tick is an hour."""
    s = segments(spark, sf).withColumn("second", F.floor(F.col("start") / 3600))
    return s.groupBy("user_id", "second").agg(F.count(F.lit(1)).alias("n"), ordered.ordered_concat(["start", "event_id"], "event_type").alias("text"))


@query("""WITH l AS (SELECT *, CASE WHEN lag(role) OVER o <> role THEN 1 ELSE 0 END AS new FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM l) SELECT conv_id, CAST(island AS BIGINT) AS island, role, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n FROM i GROUP BY ALL""")
def history_islands(spark, sf):
    return ordered.history(t(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "text")


@query(f"""WITH {S}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END AS x FROM g) SELECT event_id, round(coalesce(last_value(nullif(x, 0.0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS UNBOUNDED PRECEDING), 0.0), 6) AS filled FROM v""")
def forward_fill(spark, sf):
    s = segments(spark, sf).withColumn("x", F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0))
    return ordered.forward_fill(s, ["user_id"], ["start", "event_id"], "x").select("event_id", F.round("filled", 6).alias("filled"))


@query("""WITH e AS (SELECT floor(epoch(ts) / 86400)::BIGINT AS tick, user_id, max(value) AS score FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY score DESC, user_id) AS k FROM e WHERE score > 0.5) SELECT tick, user_id, round(score, 6) AS score FROM k WHERE k = 1""")
def speaker_top1(spark, sf):
    """Per tick (a day in the sparse test stream) the user with the highest score above the threshold."""
    e = t(spark, sf, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("tick"), "user_id").agg(F.max("value").alias("score"))
    return ordered.speaker_top1(e, ["tick"], "user_id", "score", 0.5).select("tick", "user_id", F.round("score", 6).alias("score"))


@query()
def session_log(spark, sf):
    """Events as messages of their user's session: hello, inferences and settings, refused while an inference runs."""
    kind = F.when(F.col("event_type") == "purchase", "infer").when(F.col("event_type") == "click", "set_params").when(F.col("event_type") == "view", "set_assistant_count").otherwise("hello")
    value = F.to_json(F.struct(kind.alias("type"), F.col("event_id").alias("request_id"), F.col("event_id").alias("ts"), (F.col("value") / 100).alias("threshold"), F.floor("value").alias("count"), F.array().cast("array<string>").alias("frames"), F.col("event_type").alias("query")))
    e = t(spark, sf, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), value.alias("value"))
    return sessions.sessions_batch(e, infer_ms=12 * 3_600_000, idle_ms=3 * 86_400_000)
