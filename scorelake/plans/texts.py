"""Scores of free text: edit distance, sets, sequences, tokens, normalisation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import algorithms, similarity, text
from ..operators import joins, ordered, report
from .base import query, t

_W = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> '')"


def _turns(spark, sf):
    """Pairs of a user turn and the assistant's next one."""
    c = t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = c.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return n.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("target"), F.col("next_text").alias("pred"))


_T = "n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations), u AS (SELECT conv_id, turn, text AS target, nt AS pred FROM n WHERE role = 'user' AND nr = 'assistant')"


@query()
def anls_best(spark, sf):
    """For each benchmark item, the document nearest by edit distance of the whole texts, the smallest doc_id among equals:
    a stated query set, held by every worker, against all rows. A null document is near to nothing; a null item has no document."""
    return joins.nearest_texts(t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark").select("item_id", "text"))


@query("""WITH a AS (SELECT conv_id, list(length(text) % 3 ORDER BY turn) AS t, min(length(text) % 3) AS p FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, p, t, unnest(t) AS x FROM a), s AS (SELECT conv_id, least(1.0, (len(list_filter(t, lambda y: y = p)) - (x = p)::INT) / 3.0) AS s FROM e)
SELECT conv_id, round(avg(s), 6) AS score FROM s GROUP BY conv_id""")
def vqa_leave_one_out(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", (F.length("text") % 3).alias("v"))
    a = c.groupBy("conv_id").agg(F.collect_list("v").alias("targets"), F.min("v").alias("pred"))
    return a.select("conv_id", F.round(similarity.hit(similarity.leave_one_out(F.col("pred"), F.col("targets")), "mean"), 6).alias("score"))


def _plain_sql() -> str:
    """Normalisation step by step; RE2 has no look-around, so periods go piece by piece."""
    x = "x"
    for p in text.PUNCTUATION:
        p = p.replace("'", "''")
        x = f"replace({x}, '{p}', CASE WHEN contains(x, '{p} ') OR contains(x, ' {p}') OR regexp_matches(x, '[0-9],[0-9]') THEN '' ELSE ' ' END)"
    fixed = {**{k: v for k, v in text.CONTRACTIONS.items()}, **text.NUMBER_WORDS}
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    names = f"MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in fixed.items())}}}"
    return f"""WITH a AS (SELECT conv_id, turn, trim(replace(replace(text, chr(10), ' '), chr(9), ' ')) AS x FROM conversations),
b AS (SELECT conv_id, turn, string_split({x}, '.') AS p FROM a),
c AS (SELECT conv_id, turn, p, [NOT regexp_matches(p[i], '[0-9]$') AND NOT regexp_matches(p[i + 1], '^[0-9]') FOR i IN range(1, len(p))] AS g FROM b),
d AS (SELECT conv_id, turn, array_to_string([p[i] || CASE WHEN i = len(p) OR (g[i] AND len(list_filter(g[1:i], lambda v: v)) <= {text.PERIODS}) THEN '' ELSE '.' END FOR i IN range(1, len(p) + 1)], '') AS x FROM c),
e AS (SELECT conv_id, turn, list_filter({_W('x')}, lambda w: w NOT IN ('a', 'an', 'the')) AS w FROM d), m AS (SELECT {names} AS m)
SELECT conv_id, turn, coalesce(array_to_string([coalesce(m[v], v) FOR v IN w], ' '), '') AS normalized FROM e, m"""


@query(_plain_sql())
def normalize_answer(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("normalized"))


@query(f"WITH {_T}, w AS (SELECT conv_id, turn, list_distinct({_W('target')}) AS t, list_distinct({_W('pred')}) AS p FROM u), s AS (SELECT *, len(list_intersect(p, t)) AS i FROM w) SELECT conv_id, turn, round(CASE WHEN len(p) + len(t) - i = 0 THEN 1.0 ELSE i::DOUBLE / (len(p) + len(t) - i) END, 6) AS jaccard, round(CASE WHEN len(p) = 0 THEN 1.0 ELSE i::DOUBLE / len(p) END, 6) AS set_precision, CASE WHEN i = len(p) AND i = len(t) THEN 1.0::DOUBLE ELSE 0.0 END AS set_equality FROM s")
def set_metrics(spark, sf):
    u = _turns(spark, sf).select("conv_id", "turn", text.words(F.lower("target")).alias("t"), text.words(F.lower("pred")).alias("p"))
    p, tg = F.col("p"), F.col("t")
    return u.select("conv_id", "turn", F.round(similarity.jaccard(p, tg), 6).alias("jaccard"), F.round(similarity.set_precision(p, tg), 6).alias("set_precision"), similarity.set_equality(p, tg).alias("set_equality"))


@query(f"""WITH {_T}, w AS (SELECT conv_id, turn, {_W('target')} AS t, {_W('pred')} AS p FROM u),
s AS (SELECT *, least(len(t), len(p)) AS n, len(list_filter(range(1, least(len(t), len(p)) + 1), lambda i: t[i] = p[i])) AS same, list_min(list_filter(range(1, least(len(t), len(p)) + 1), lambda i: t[i] <> p[i])) AS bad FROM w)
SELECT conv_id, turn, CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0.0 END AS equality, round(CASE WHEN len(t) <> len(p) THEN 0.0 WHEN len(t) = 0 THEN 1.0 ELSE same::DOUBLE / len(t) END, 6) AS accuracy, round(CASE WHEN len(t) = 0 THEN 1.0 ELSE coalesce(bad - 1, n)::DOUBLE / len(t) END, 6) AS prefix_ratio FROM s""")
def sequence_metrics(spark, sf):
    u = _turns(spark, sf).select("conv_id", "turn", text.words(F.lower("target")).alias("t"), text.words(F.lower("pred")).alias("p"))
    p, tg = F.col("p"), F.col("t")
    return u.select("conv_id", "turn", similarity.sequence_equality(p, tg).alias("equality"), F.round(similarity.sequence_accuracy(p, tg), 6).alias("accuracy"), F.round(similarity.prefix_ratio(p, tg), 6).alias("prefix_ratio"))


@query(f"""WITH {_T}, tt AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_W('target')}) AS w FROM u) GROUP BY ALL), pp AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_W('pred')}) AS w FROM u) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(tt.n, pp.n)) AS hit FROM tt JOIN pp USING (conv_id, turn, w) GROUP BY ALL),
s AS (SELECT conv_id, turn, coalesce(hit, 0) AS hit, len({_W('target')}) AS t, len({_W('pred')}) AS p FROM u LEFT JOIN o USING (conv_id, turn)),
r AS (SELECT *, hit / (p + 1e-9) AS pr, hit / (t + 1e-9) AS rc FROM s)
SELECT count(*) AS n, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(2 * pr * rc / (pr + rc + 1e-9)), 6) AS macro_f1, round(sum(hit) / (sum(p) + 1e-9), 6) AS micro_precision, round(sum(hit) / (sum(t) + 1e-9), 6) AS micro_recall FROM r""")
def token_multiset_prf(spark, sf):
    u = _turns(spark, sf)
    count = lambda c: u.select("conv_id", "turn", F.explode(text.words(F.lower(c))).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    o = count("target").join(count("pred"), ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n_target", "n_pred")).alias("hit"))
    s = u.join(o, ["conv_id", "turn"], "left").select(F.coalesce("hit", F.lit(0)).alias("hit"), F.size(text.words(F.lower("target"))).alias("t"), F.size(text.words(F.lower("pred"))).alias("p"))
    pr, rc = F.col("hit") / (F.col("p") + 1e-9), F.col("hit") / (F.col("t") + 1e-9)
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(pr), 6).alias("macro_precision"), F.round(F.avg(rc), 6).alias("macro_recall"), F.round(F.avg(2 * pr * rc / (pr + rc + 1e-9)), 6).alias("macro_f1"), F.round(F.sum("hit") / (F.sum("p") + 1e-9), 6).alias("micro_precision"), F.round(F.sum("hit") / (F.sum("t") + 1e-9), 6).alias("micro_recall"))


@query(f"""WITH {_T}, w AS (SELECT conv_id, turn, {_W('target')} AS t, {_W('pred')} AS p FROM u), s AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_filter(p, lambda x: list_contains(t, x)))::DOUBLE / len(p) END AS a, CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda x: list_contains(p, x)))::DOUBLE / len(t) END AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN a + b = 0 THEN 0.0 ELSE 2 * a * b / (a + b) END, 6) AS f1 FROM s""")
def bag_f1(spark, sf):
    w = lambda c: text.words(F.lower(c))
    return _turns(spark, sf).select("conv_id", "turn", F.round(similarity.bag_f1(w("pred"), w("target")), 6).alias("f1"))


#: A paragraph: any attributes, and line ends, up to its end tag.
_P = r"""(?is)<p(?:\s(?:[^>"']|"[^"]*"|'[^']*')*+)?>(.*?)</p\s*>"""


@query()
def page_attribute_edit(spark, sf):
    """Edit distance of consecutive paragraphs, whole: sums over a page, means over pages of an attribute."""
    l = F.transform(F.regexp_extract_all("html", F.lit(_P), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    p = t(spark, sf, "pages").select("page_id", l.alias("l"))
    e = p.select("page_id", F.posexplode("l").alias("i", "x"), "l").select("page_id", "x", F.coalesce(F.get("l", F.col("i") + 1), F.lit("")).alias("y"))
    g = e.withColumn("d", algorithms.edit_distance("x", "y")).groupBy("page_id").agg(F.try_divide(F.sum("d").cast("double"), F.sum(F.greatest(F.length("x"), F.length("y")))).alias("r"))
    return g.groupBy((F.col("page_id") % 4).alias("attribute")).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("r"), 6).alias("edit"))


@query()
def line_assignment(spark, sf):
    """All lines of each page against the next page's, matched for least edit distance."""
    lines = F.regexp_extract_all("html", F.lit(r"<a href=\"[^\"]*\">([^<]*)</a>"), 1)
    p = t(spark, sf, "pages").select(F.col("page_id").alias("page"), lines.alias("targets"))
    nxt = p.select((F.col("page") - 1).alias("page"), F.col("targets").alias("preds"))
    return joins.match_lines(p.join(nxt, "page"))


_BACK = r"reverse(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"WITH b AS (SELECT doc_id, {_BACK} AS r FROM documents) SELECT doc_id, n::INT AS n, (CASE WHEN length(r) < n THEN 0 ELSE length(regexp_extract(r, '^(?s:' || regexp_escape(substr(r, 1, n)) || ')+')) // n END)::INT AS repeats FROM b, range(1, 6) t(n)")
def tail_repeats(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(ordered.tail_repeats(F.col("text"), 5)).alias("n", "repeats"))
    return d.withColumn("n", F.col("n") + 1)


@query()
def profanity_filter(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text"), ["idiot", "scum", "moron"]).alias("clean"))


_PAR = "list_filter(regexp_split_to_array(array_to_string([trim(x) FOR x IN string_split(text, chr(10))], chr(10)), '\\n\\n+'), lambda x: x <> '')"


@query(rf"SELECT doc_id, len({_PAR}) AS paragraphs, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) BETWEEN 50 AND 500 AS in_range FROM documents")
def constraint_checks(spark, sf):
    n = F.size(text.words(F.col("text"))).cast("long")
    return t(spark, sf, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("paragraphs"), n.alias("words"), n.between(50, 500).alias("in_range"))


@query("SELECT event_id, CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) AS k, coalesce(json_valid(props), false) AS parsed FROM events")
def json_props_extract(spark, sf):
    v = F.try_parse_json(text.fenced(F.col("props")))
    return t(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("parsed"))


@query("WITH s AS (SELECT lang, source, length(text) % 5 AS v FROM documents) SELECT lang AS name, count(*) AS n, round(coalesce(avg(v) FILTER (v > 0), 0.0), 6) AS valid, round(avg(v), 6) AS whole, CASE WHEN avg(length(lang)) > 0 THEN round(avg(v) / avg(length(lang)), 6) END AS relative FROM s GROUP BY lang")
def valid_and_ratio_means(spark, sf):
    """Means of valid scores only, of all, and a ratio of means."""
    s = t(spark, sf, "documents").select("lang", (F.length("text") % 5).alias("v"))
    return s.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(report.valid_mean(F.when(F.col("v") > 0, F.col("v")).otherwise(-1)), F.lit(0.0)), 6).alias("valid"), F.round(F.avg("v"), 6).alias("whole"), F.round(report.ratio_of_means(F.col("v"), F.length("lang")), 6).alias("relative"))


@query(rf"""WITH {_T}, v AS (SELECT conv_id, turn, pred, target, string_split(target, chr(10))[1] AS line, left(target, 1) AS letter, replace(replace(pred, '.', ' '), ',', chr(10)) AS marked FROM u),
m AS (SELECT *, regexp_extract(pred, '^\(?([A-Za-z])', 1) AS lead, trim(lower(pred), ' ' || chr(10) || chr(9)) AS p, trim(lower(line), ' ' || chr(10) || chr(9)) AS t, lower(translate(pred, ' -.' || chr(10) || chr(9), '')) AS a, lower(translate(marked, ' -.' || chr(10) || chr(9), '')) AS b FROM v)
SELECT conv_id, turn, CASE WHEN regexp_full_match(letter, '\p{{L}}') AND length(pred) > 1 AND lead <> '' THEN lead = letter ELSE pred = letter END::INT::DOUBLE AS letter,
  (pred = target)::INT::DOUBLE AS whole, (a = replace(b, ',', ''))::INT::DOUBLE AS simple,
  (CASE WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) < 5 AND contains(replace(p, chr(10), ' '), replace(t, chr(10), ' ')) THEN 1 ELSE 0 END)::DOUBLE AS held FROM m""")
def string_scores(spark, sf):
    """Turns as answers: to the other turn's first letter, to all of it, to themselves with other marks, and to its first line."""
    u = _turns(spark, sf)
    marked = F.replace(F.replace("pred", F.lit("."), F.lit(" ")), F.lit(","), F.lit("\n"))
    line = F.substring_index("target", "\n", 1)
    held = similarity.short_or_anls(F.col("pred"), line)
    return u.select("conv_id", "turn", similarity.exact(F.col("pred"), F.left("target", F.lit(1))).alias("letter"), similarity.exact(F.col("pred"), F.col("target")).alias("whole"), similarity.simple_match(F.col("pred"), marked).alias("simple"), (held == 1).cast("double").alias("held"))
