"""Queries over pages and orders: matching of lines, reading order, windows of words, spotted boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, orders, text
from ..operators import documents, passages, spotting
from .base import query, t

#: A block of a page, up to its own end tag.
_BLOCK = r"(?is)<(p|h[1-6]|li|td|th|blockquote|figcaption)\b[^>]*>(.*?)</\1\s*>"


def _plain(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_lines(pages):
    """page, targets (text of each block) and preds (each text node inside a block by itself: blocks with tags in them are cut)."""
    blocks = F.regexp_extract_all("html", F.lit(_BLOCK), 2)
    some = lambda c: F.filter(c, lambda x: x != "")
    targets = some(F.transform(blocks, lambda x: _plain(F.regexp_replace(x, "<[^>]*>", " "))))
    preds = some(F.transform(F.flatten(F.transform(blocks, lambda x: F.split(x, "<[^>]*>"))), _plain))
    return pages.select(F.col("page_id").alias("page"), targets.alias("targets"), preds.alias("preds"))


@query()
def quick_match(spark, sf):
    """Blocks of every page against its text nodes."""
    pages = t(spark, sf, "pages").repartition(4 * spark.sparkContext.defaultParallelism)  # a table of one file is one task otherwise
    return documents.quick_match(page_lines(pages)).select("page", F.to_json("targets").alias("targets"), F.to_json("preds").alias("preds"), F.round("edit", 6).alias("edit"))


@query("""WITH RECURSIVE o AS (
  SELECT conv_id, list(turn ORDER BY turn) AS gt, list(turn ORDER BY length(text), turn) AS pred, list(turn ORDER BY turn) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id),
lev(conv_id, i, r) AS (
  SELECT conv_id, 0, range(0, len(pred) + 1) FROM o
  UNION ALL
  SELECT conv_id, i + 1, [list_min([v + (k - j + 1) FOR v, j IN list_slice(direct, 1, k + 1)]) FOR k IN range(0, len(direct))]
  FROM (SELECT lev.conv_id, i, [CASE WHEN j = 0 THEN r[1] + 1 ELSE least(r[j + 1] + 1, r[j] + CASE WHEN gt[i + 1] = pred[j] THEN 0 ELSE 1 END) END FOR j IN range(0, len(pred) + 1)] AS direct
        FROM lev JOIN o ON lev.conv_id = o.conv_id WHERE i < len(gt))),
mov(conv_id, i, own, cost) AS (
  SELECT conv_id, 0, pred, 0::BIGINT FROM o
  UNION ALL
  SELECT conv_id, i + 1, CASE WHEN p < i THEN [CASE WHEN k = p THEN own[i + 1] WHEN k = i THEN own[p + 1] ELSE own[k + 1] END FOR k IN range(0, len(own))] ELSE own END, cost + abs(i - p)
  FROM (SELECT mov.conv_id, i, own, cost, list_position(own, gt[i + 1]) - 1 AS p FROM mov JOIN o ON mov.conv_id = o.conv_id WHERE i < len(gt)))
SELECT o.conv_id, round(r[len(r)] / len(gt), 6) AS edit, round(cost / len(gt), 6) AS moved, round(cost / len(gt), 6) >= 1 AS far, len(asked) AS asked
FROM o JOIN lev ON lev.conv_id = o.conv_id AND lev.i = len(gt) JOIN mov ON mov.conv_id = o.conv_id AND mov.i = len(gt)""")
def reading_order(spark, sf):
    """Turns as they were said against turns by length: edit distance of the orders, and displacement."""
    each = F.sort_array(F.collect_list(F.struct(F.length("text").alias("n"), "turn")))["turn"]
    o = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("gt"), each.alias("pred"), F.count_if(F.col("role") == "user").alias("asked"))
    moved = F.round(orders.move_distance(F.col("gt"), F.col("pred")), 6)
    return o.select("conv_id", F.round(orders.order_edit(F.col("gt"), F.col("pred")), 6).alias("edit"), moved.alias("moved"), (moved >= 1).alias("far"), "asked")


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_SCORES = ["likeness", "precision", "recall", "f1", "jaccard", "rouge1", "exact_match"]


def _sentences(df, *keys):
    """keys, span (which sentence) and needle of every sentence of a text."""
    return df.select(*keys, F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("span", "needle"))


@query()
def window_matches(spark, sf):
    """Every sentence of eight words or more of the benchmark's items in documents: the window most like it, among those that
    hold its rarest token."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    items = _sentences(t(spark, sf, "benchmark"), "item_id").where(F.size(text.words(F.col("needle"))) >= 8).select(F.struct("item_id", "span").alias("of"), "needle")
    best = passages.best_windows(docs, items, "doc_id", "of", rarest=1)
    return _rounded(best.select("doc_id", "of.item_id", "of.span", "start", *_SCORES), *_SCORES)


@query()
def restored_spans(spark, sf):
    """Every sentence of what was said before, looked for in the answer to it, as covered texts are in restored ones."""
    c = t(spark, sf, "conversations")
    said = _sentences(c, "conv_id", (F.col("turn") + 1).alias("turn"))
    answers = c.where("role = 'assistant'").select("conv_id", "turn", F.col("turn").alias("answer"), "text")
    return _rounded(passages.best_windows(answers, said, "answer", "span", on=["conv_id", "turn"], rarest=1).drop("needle", "best"), *_SCORES)


_BOXES = """b AS (SELECT l_orderkey AS image, l_linenumber AS g, l_quantity AS x1, l_linenumber * 10.0 AS y1, l_quantity + 20 AS x2, l_linenumber * 10.0 + 14 AS y2,
  l_quantity + l_discount * 80 AS u1, l_linenumber * 10.0 + l_tax * 50 AS v1, l_quantity + 20 + l_discount * 40 AS u2, l_linenumber * 10.0 + 14 AS v2,
  CASE WHEN l_returnflag = 'A' THEN '###' ELSE l_linestatus || '.' END AS target, lower(o_orderstatus) AS read
  FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
        FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH RECURSIVE {_BOXES},
i AS (SELECT p.image, p.g, q.g AS d, p.target, q.read, greatest(least(p.x2, q.u2) - greatest(p.x1, q.u1), 0) * greatest(least(p.y2, q.v2) - greatest(p.y1, q.v1), 0) AS shared,
        (p.x2 - p.x1) * (p.y2 - p.y1) AS own, (q.u2 - q.u1) * (q.v2 - q.v1) AS other FROM b p JOIN b q ON p.image = q.image),
o AS (SELECT DISTINCT image, d FROM i WHERE target = '###' AND round(shared / other, 9) > 0.5),
n AS (SELECT image, g, d, upper(read) = left(target, 1) AS ok, row_number() OVER (PARTITION BY image ORDER BY g, d) AS k
      FROM i ANTI JOIN o USING (image, d) WHERE target <> '###' AND round(shared / (own + other - shared), 9) > 0.5),
w(image, k, gs, ds, ok) AS (
  SELECT DISTINCT image, 0::BIGINT, []::INTEGER[], []::INTEGER[], 0::BIGINT FROM b
  UNION ALL
  SELECT image, k, CASE WHEN f THEN list_append(gs, g) ELSE gs END, CASE WHEN f THEN list_append(ds, d) ELSE ds END, had + CASE WHEN f AND good THEN 1 ELSE 0 END
  FROM (SELECT w.image, n.k, gs, ds, n.g::INTEGER AS g, n.d::INTEGER AS d, w.ok AS had, n.ok AS good, NOT list_contains(gs, n.g::INTEGER) AND NOT list_contains(ds, n.d::INTEGER) AS f FROM w JOIN n ON w.image = n.image AND n.k = w.k + 1)),
e AS (SELECT image, max_by(len(gs), k) AS matched, max_by(ok, k) AS correct FROM w GROUP BY image),
c AS (SELECT b.image, count(*) FILTER (target <> '###') AS targets, count(*) FILTER (o.d IS NULL) AS spotted FROM b LEFT JOIN o ON b.image = o.image AND b.g = o.d GROUP BY b.image),
m AS (SELECT c.image, targets, spotted, matched, correct FROM c JOIN e ON c.image = e.image),
r AS (SELECT targets, sum(spotted) AS spotted, sum(matched) AS matched, sum(correct) AS correct, count(*) AS images FROM m GROUP BY targets)
SELECT targets, images, CAST(spotted AS BIGINT) AS spotted, CAST(matched AS BIGINT) AS matched, CAST(correct AS BIGINT) AS correct,
  round(CASE WHEN targets = 0 THEN 1.0 ELSE correct / (targets * images) END, 6) AS recall,
  round(CASE WHEN targets = 0 THEN CASE WHEN spotted = 0 THEN 1.0 ELSE 0.0 END WHEN spotted = 0 THEN 0.0 ELSE correct / spotted END, 6) AS precision FROM r""")
def spotting_report(spark, sf):
    """Boxes of line items against shifted ones, by the number of an image's targets."""
    one = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    l = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in one])  # a line number names a box
    l = l.join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x, y, dx, dy = F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_discount"), F.col("l_tax")
    image = F.col("l_orderkey").alias("image")
    targets = l.select(image, F.col("l_linenumber").alias("g"), geometry.rectangle(x, y, x + 20, y + 14).alias("polygon"), F.when(F.col("l_returnflag") == "A", spotting.IGNORED).otherwise(F.concat("l_linestatus", F.lit("."))).alias("text"))
    found = l.select(image, F.col("l_linenumber").alias("d"), geometry.rectangle(x + dx * 80, y + dy * 50, x + 20 + dx * 40, y + 14).alias("polygon"), F.lower("o_orderstatus").alias("text"))
    m = spotting.spotting(targets, found, ["image"])
    r = m.groupBy("targets").agg(F.count("*").alias("images"), *[F.sum(c).alias(c) for c in ("spotted", "matched", "correct")])
    recall, precision, _ = spotting.rates(F.col("targets") * F.col("images"), F.col("spotted"), F.col("correct"))
    return r.select("targets", "images", "spotted", "matched", "correct", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))
