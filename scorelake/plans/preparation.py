"""Preparation of rows, and choices of frames and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algorithms, text
from ..operators import prepare
from .base import S, query, segments, t

# Questions made of parts: four options, of which D is null for odd sizes and all are for every seventh part; a hint for every third.
_Q = """q AS (SELECT p_partkey AS key, 'Which fits ' || p_name || '?' AS question, p_name AS answer, CASE WHEN p_partkey % 3 = 0 THEN 'size ' || p_size END AS hint,
 CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS "A", CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS "B", CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS "C", CASE WHEN p_partkey % 7 <> 0 AND p_size % 2 = 0 THEN 'size ' || p_size END AS "D" FROM part)"""


def _questions(spark, sf):
    k, size = F.col("p_partkey"), F.concat(F.lit("size "), F.col("p_size").cast("string"))
    some = k % 7 != 0
    options = {"A": F.when(some, F.col("p_name")), "B": F.when(some, F.col("p_brand")), "C": F.when(some, F.col("p_type")), "D": F.when(some & (F.col("p_size") % 2 == 0), size)}
    return t(spark, sf, "part").select(k.alias("key"), F.concat(F.lit("Which fits "), "p_name", F.lit("?")).alias("question"), F.col("p_name").alias("answer"), F.when(k % 3 == 0, size).alias("hint"), *[c.alias(n) for n, c in options.items()])


@query(f"""WITH {_Q} SELECT key, coalesce('Hint: ' || hint || chr(10), '') || 'Question: ' || question || chr(10) || CASE WHEN "A" IS NULL THEN '' ELSE 'Options:' || chr(10) || 'A. ' || "A" || chr(10) || 'B. ' || "B" || chr(10) || 'C. ' || "C" || chr(10) || coalesce('D. ' || "D" || chr(10), '') || 'Please select the correct answer from the options above. ' || chr(10) END AS prompt FROM q""")
def choice_prompt(spark, sf):
    q = _questions(spark, sf)
    return q.select("key", prepare.choice_prompt(F.col("question"), text.options_map(q.columns), F.col("hint")).alias("prompt"))


@query(f"""WITH {_Q} SELECT key, coalesce("A", answer) AS "A", CASE WHEN "A" IS NULL THEN 'Other Answers' ELSE "B" END AS "B" FROM q""")
def open_to_choice(spark, sf):
    return prepare.open_to_choice(_questions(spark, sf)).select("key", "A", "B")


@query("""WITH c AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM conversations), k AS (SELECT *, [w[i] FOR i IN range(1, len(w) + 1) IF length(w[i]) > 6] AS images, [CASE WHEN length(w[i]) > 5 THEN '' ELSE w[i] END FOR i IN range(1, len(w) + 1)] AS p FROM c),
s AS (SELECT conv_id, turn, images, string_split(array_to_string([CASE WHEN x = '' THEN '<image>' ELSE x END FOR x IN p], ' '), '<image>') AS p FROM k), i AS (SELECT conv_id, turn, images, p, unnest(range(0, len(p))) AS i FROM s),
m AS (SELECT conv_id, turn, 2 * i AS o, 'image' AS type, images[i] AS value FROM i WHERE i > 0 AND i <= len(images) UNION ALL SELECT conv_id, turn, 2 * i + 1, 'text', p[i + 1] FROM i WHERE p[i + 1] <> '')
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS place, type, value FROM m""")
def interleaved_message(spark, sf):
    """Turns as messages: words of over five characters are placeholders, those of over six the images that are there."""
    w = text.words(F.col("text"))
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.filter(w, lambda x: F.length(x) > 6).alias("images"), F.array_join(F.transform(w, lambda x: F.when(F.length(x) > 5, prepare.IMAGE).otherwise(x)), " ").alias("p"))
    m = c.select("conv_id", "turn", F.posexplode(prepare.interleaved(F.col("p"), F.col("images"))).alias("place", "m"))
    return m.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "m.type", "m.value")


@query("""SELECT p_partkey AS key, contains(p_type, 'STEEL') AS steel, list_contains(['STANDARD', 'PROMO'], string_split(p_type, ' ')[1]) AS allowed, len(string_split(p_type, ' ')) > 1 AS several, CASE WHEN suffix(p_brand || '_' || p_size, '.jpg') THEN p_brand ELSE 'x_' || p_brand END AS page, string_split('a_b_c_' || p_size || '_fig_' || p_partkey, '_')[4] AS set_id, string_split('a_b_c_' || p_size || '_fig_' || p_partkey, '_')[6] AS question_id FROM part""")
def attribute_filters(spark, sf):
    """Flags that filters use: a substring, membership in allowed values, a list's size; the page of an element's id and parts of an id."""
    kinds = F.split("p_type", " ")
    ident = F.concat(F.lit("a_b_c_"), F.col("p_size").cast("string"), F.lit("_fig_"), F.col("p_partkey").cast("string"))
    set_id, _, question = prepare.id_parts(ident, ["set_id", "figure_id", "question_id"])
    page = prepare.page_name(F.concat(F.lit("x_"), "p_brand", F.lit("_"), F.col("p_size").cast("string"))).alias("page")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").contains("STEEL").alias("steel"), kinds[0].isin("STANDARD", "PROMO").alias("allowed"), (F.size(kinds) > 1).alias("several"), page, set_id, question)


@query(f"""WITH {S} SELECT event_id, round_even(start + (event_id % 4) / 4.0::DOUBLE, 0)::BIGINT AS start, least(round_even("end" + (event_id % 4) / 4.0::DOUBLE, 0)::BIGINT, floor("end" + 0.5)::BIGINT) AS "end", floor("end" + 0.5)::BIGINT AS duration FROM g""")
def whole_seconds(spark, sf):
    s, shift = segments(spark, sf), (F.col("event_id") % 4) / 4.0
    return s.select("event_id", *[c.alias(n) for n, c in prepare.whole_seconds(F.col("start") + shift, F.col("end") + shift, F.col("end") + 0.5).items()])


@query("""WITH w AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM conversations), k AS (SELECT conv_id, turn, CASE WHEN len(w) <= 8 THEN w ELSE [w[CAST(floor(i * (len(w) / 8.0::DOUBLE)) AS INT) + 1] FOR i IN range(0, 8)] END AS k FROM w) SELECT conv_id, turn, len(k)::BIGINT AS n, array_to_string(k, ' ') AS picked FROM k""")
def strided_sample(spark, sf):
    """At most eight words of each turn, at even strides."""
    k = prepare.strided(text.words(F.col("text")), 8)
    return t(spark, sf, "conversations").select("conv_id", "turn", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("picked"))


@query(f"""WITH {S}, c AS (SELECT user_id, event_id, start AS a, "end" AS b, start + 100 AS c, "end" + 110 AS d FROM g), x AS (SELECT *, b - a + d - c AS total FROM c),
f AS (SELECT event_id, CASE WHEN total <= 24 THEN range(a, b) || range(c, d) ELSE [CAST(floor(a + (b - a)::DOUBLE / greatest(1, floor(24 * ((b - a)::DOUBLE / total))) / 2 + (b - a)::DOUBLE / greatest(1, floor(24 * ((b - a)::DOUBLE / total))) * i) AS BIGINT) FOR i IN range(0, CAST(greatest(1, floor(24 * ((b - a)::DOUBLE / total))) AS BIGINT))]
 || [CAST(floor(c + (d - c)::DOUBLE / greatest(1, floor(24 * ((d - c)::DOUBLE / total))) / 2 + (d - c)::DOUBLE / greatest(1, floor(24 * ((d - c)::DOUBLE / total))) * i) AS BIGINT) FOR i IN range(0, CAST(greatest(1, floor(24 * ((d - c)::DOUBLE / total))) AS BIGINT))] END AS f FROM x)
SELECT event_id, len(f)::BIGINT AS n, list_sum(f)::BIGINT AS total, list_min(f)::BIGINT AS first, list_max(f)::BIGINT AS last FROM f""")
def clue_frames(spark, sf):
    """24 frames from two clues of each segment."""
    clue = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    s = segments(spark, sf).withColumn("f", prepare.clue_frames(F.array(clue(F.col("start"), F.col("end")), clue(F.col("start") + 100, F.col("end") + 110)), 24, 1.0))
    return s.select("event_id", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("f").cast("long").alias("first"), F.array_max("f").cast("long").alias("last"))


@query(f"""WITH {S}, d AS (SELECT *, max("end") OVER (PARTITION BY user_id) AS stop, 37 * (user_id % 7) AS begun FROM g), r AS (SELECT *, begun + (start - begun) // 60 * 60 AS a FROM d WHERE start < stop AND start >= begun)
SELECT event_id, a AS read_begin, least(a + 60, stop) AS read_end, (least(a + 60, stop) - a) * 2 AS frames, (start - a) * 2 AS first_frame FROM r""")
def read_buffer(spark, sf):
    """The minute-long read, two frames a second, that each segment's start falls into; videos begin at odd seconds."""
    s = segments(spark, sf)
    d = s.join(s.groupBy("user_id").agg(F.max("end").alias("stop")), "user_id").withColumn("begun", 37 * (F.col("user_id") % 7))
    return prepare.read_buffer(d, "start", until="stop", since="begun").select("event_id", "read_begin", "read_end", "frames", "first_frame")


@query("""WITH s AS (SELECT DISTINCT user_id % 10 AS session, floor(epoch(ts) / 86400)::BIGINT AS tick, event_id % 4 AS speaker FROM events), c AS (SELECT *, CASE WHEN (tick + speaker) % 5 = 0 THEN '<SILENCE>' WHEN (tick + speaker) % 5 = 1 THEN '' ELSE 'c' || (tick % 7) END AS comment, (tick + session) % 3 <> 0 AS active FROM s)
SELECT a.session, a.tick, a.speaker, coalesce(string_agg('[SPEAKER_' || b.speaker || ']: ' || b.comment, '' ORDER BY b.speaker), '') AS context FROM c a LEFT JOIN c b ON a.session = b.session AND b.tick = a.tick - 1 AND b.speaker <> a.speaker AND b.active AND b.comment <> '' AND b.comment <> '<SILENCE>' GROUP BY ALL""")
def others_comments(spark, sf):
    """Per session, tick and speaker, what the others said at the tick before."""
    e = t(spark, sf, "events")
    s = e.select((F.col("user_id") % 10).alias("session"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("tick"), (F.col("event_id") % 4).alias("speaker")).distinct()
    k = (F.col("tick") + F.col("speaker")) % 5
    c = s.withColumns({"comment": F.when(k == 0, "<SILENCE>").when(k == 1, "").otherwise(F.concat(F.lit("c"), (F.col("tick") % 7).cast("string"))), "active": (F.col("tick") + F.col("session")) % 3 != 0})
    return prepare.others_comments(c, "session", "tick", "speaker", "comment", "active", "<SILENCE>").select("session", "tick", "speaker", "context")


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN -100 ELSE event_id % 3 END AS label, event_id % 2 AS pred FROM events), n AS (SELECT *, lead(label) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM x) SELECT user_id, count(*) AS n, round(avg((pred = target)::INT), 6) AS acc FROM n WHERE target IS NOT NULL AND target <> -100 GROUP BY user_id""")
def shifted_labels(spark, sf):
    e = F.col("event_id")
    x = t(spark, sf, "events").select("user_id", "event_id", F.when(e % 5 == 0, -100).otherwise(e % 3).alias("label"), (e % 2).alias("pred"))
    return prepare.shifted_labels(x, ["user_id"], ["event_id"], "label").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("target")).cast("int")), 6).alias("acc"))


_SAID = """CASE p_partkey % 6 WHEN 0 THEN 'so BADC it is' WHEN 1 THEN 'first C, second A, third d and fourth B' WHEN 2 THEN 'step 1: D. step 2: C then step 3 - A; step 4 B' WHEN 3 THEN 'AABC' WHEN 4 THEN 'first A, second A' ELSE 'nothing' END"""


@query(f"SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN 'BADC' WHEN 1 THEN 'CADB' WHEN 2 THEN 'DCAB' END AS label, CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE 12 END AS number FROM part WHERE {_SAID} IS NOT NULL")
def sequence_extract(spark, sf):
    """Orders from texts in several forms, and whole numbers from digits and words; the SQL states the values by hand."""
    k = F.col("p_partkey")
    said = F.when(k % 6 == 0, "so BADC it is").when(k % 6 == 1, "first C, second A, third d and fourth B").when(k % 6 == 2, "step 1: D. step 2: C then step 3 - A; step 4 B").when(k % 6 == 3, "AABC").when(k % 6 == 4, "first A, second A").otherwise("nothing")
    told = F.when(k % 4 == 0, "It is Seven").when(k % 4 == 1, "3").when(k % 4 == 2, "3.0").otherwise("12")
    return t(spark, sf, "part").select(k.alias("key"), text.option_sequence(said).alias("label"), text.number_word(told).alias("number"))


@query("SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'B' END AS label FROM part")
def choice_parse(spark, sf):
    """Choices named in brackets, alone, or by their text; the SQL states the values by hand."""
    k = F.col("p_partkey")
    said = F.when(k % 5 == 0, "(A) or (C)").when(k % 5 == 1, "so A or B!").when(k % 5 == 2, F.concat(F.lit("I take it that they mean "), "p_name")).when(k % 5 == 3, "B. because").otherwise("no")
    p = t(spark, sf, "part").select(k.alias("key"), said.alias("said"), F.array(*map(F.lit, "ABC")).alias("labels"), F.array("p_name", F.lit("green tree"), F.lit("other thing")).alias("texts"))
    return p.select("key", algorithms.vectorised(algorithms.choice_of, "string")("said", "labels", "texts").alias("label"))


@query("SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN (p_size % 2 = 0)::INT::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN round(1 - 1.0::DOUBLE / (length(p_name) + 1), 6) ELSE 1.0 END AS score FROM part")
def typed_scores(spark, sf):
    """Answers by kind: whole numbers, numbers within a hundredth or as a percentage, exact texts, alike texts, lists."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pick = lambda *v: F.get(F.array(*v), (k % 6).cast("int"))
    target = pick(size, F.lit("200"), F.lit("5%"), F.concat(F.lit("page "), size), F.concat("p_name", F.lit("x")), F.lit("['b', 'a']"))
    pred = pick(F.concat(size, F.lit(".7")), F.when(F.col("p_size") % 2 == 0, "201").otherwise("210"), F.lit("0.05"), F.concat(F.lit("page "), size, F.lit("0")), F.col("p_name"), F.lit("['A', 'b']"))
    kind = pick(*map(F.lit, ("Int", "Float", "Float", "Str", "Str", "List")))
    s = t(spark, sf, "part").select(k.alias("key"), target.alias("t"), pred.alias("p"), kind.alias("kind"))
    return s.select("key", F.round(algorithms.vectorised(algorithms.typed_score, "double")("t", "p", "kind"), 6).alias("score"))
