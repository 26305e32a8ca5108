"""Driver queries for text objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cues, labels
from ..operators import objects as ob
from .bindings import LINES_SQL, OBJECTS_SQL, sql_re
from .label_queries import OWN_TYPE_SQL
from .registry import query
from .scale import cut_lineage

_W = "(PARTITION BY book ORDER BY page, reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NB = ", ".join(f"'{x}'" for x in cues.NON_BLEEDING)


def _last(types: str) -> str:
    return f"max(CASE WHEN own_type IN ({types}) THEN reading_order END) OVER {_W}"


TYPED_SQL = f"""{OWN_TYPE_SQL},
c1 AS (SELECT *, {_last("'heading', 'exercise', 'in_text_question'")} AS rs, {_last("'worked_example'")} AS ex0, {_last("'exercise'")} AS xr0,
       {_last("'heading', 'in_text_question'")} AS xe, {_last("'theorem', 'property'")} AS th0 FROM own),
c2 AS (SELECT *, CASE WHEN ex0 > coalesce(rs, -1) THEN ex0 END AS ex, CASE WHEN xr0 > coalesce(xe, -1) THEN xr0 END AS xr, CASE WHEN th0 > coalesce(rs, -1) THEN th0 END AS th FROM c1),
c3 AS (SELECT *, max(CASE WHEN own_type = 'example_solution' AND ex IS NOT NULL THEN reading_order END) OVER {_W} AS so0 FROM c2),
c4 AS (SELECT *, CASE WHEN so0 > ex THEN so0 END AS so FROM c3),
c5 AS (SELECT *, CASE WHEN own_type IS NOT NULL THEN own_type WHEN so IS NOT NULL THEN CASE WHEN {sql_re("trim(text)", cues.FINAL_ANSWER)} THEN 'final_answer' ELSE 'calculation_step' END
       WHEN ex IS NOT NULL THEN 'example_question' WHEN xr IS NOT NULL THEN 'exercise_question' END AS known FROM c4),
c6 AS (SELECT *, last_value(CASE WHEN known IN ({_NB}) THEN 'paragraph' ELSE known END IGNORE NULLS) OVER (PARTITION BY book, page ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flow FROM c5),
typed AS (SELECT id, book, subject, chapter, page, reading_order, text, coalesce(known, flow, 'paragraph') AS type, ex, th, so, xr FROM c6),
linked AS (SELECT *, book || ':' || CASE WHEN type = 'proof' THEN th WHEN type IN ('example_question', 'example_solution') THEN ex
       WHEN type IN ('calculation_step', 'final_answer') THEN so WHEN type IN ('exercise_question', 'exercise_answer') THEN xr END AS parent_id FROM typed)"""


@query("reading_order_links", "W1", f"""WITH {OBJECTS_SQL} SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM objects
  WINDOW w AS (PARTITION BY book ORDER BY page, reading_order)""")
def _(t):
    return ob.reading_links(t.objects()).select("id", "previous_id", "next_id")


@query("object_types", "W2", f"WITH {TYPED_SQL} SELECT id, type FROM typed")
def _(t):
    return ob.typed_objects(t.objects()).select("id", "type")


@query("object_parents", "W3", f"WITH {TYPED_SQL} SELECT parent_id, id AS child_id FROM linked WHERE parent_id IS NOT NULL")
def _(t):
    return ob.children(ob.typed_objects(t.objects())).select("parent_id", "child_id")


LEVELS_SQL = f"""{OWN_TYPE_SQL},
n1 AS (SELECT *, CASE WHEN own_type = 'heading' THEN regexp_extract(trim(text), '^(\\d+(\\.\\d+)*)\\s', 1) END AS no FROM own),
n2 AS (SELECT *, CASE WHEN no <> '' AND CAST(string_split(no, '.')[1] AS INT) <= 30 THEN no END AS num FROM n1),
leveled AS (SELECT * EXCLUDE (no, num), last_value(string_split(num, '.')[1] IGNORE NULLS) OVER w AS chapter_no,
  nullif(last_value(CASE WHEN num IS NOT NULL THEN CASE WHEN contains(num, '.') THEN num ELSE '' END END IGNORE NULLS) OVER w, '') AS section_no
  FROM n2 WINDOW w AS (PARTITION BY book ORDER BY page, reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def leveled(t):
    o = t.objects()
    return ob.heading_levels(o, labels.own_type(F.col("text")) == "heading", F.col("subject"))


@query("heading_levels", "W4", f"WITH {LEVELS_SQL} SELECT id, chapter_no, section_no FROM leveled")
def _(t):
    return leveled(t).select("id", "chapter_no", "section_no")


@query("proof_edges", "W5", f"""WITH {TYPED_SQL}, b AS (SELECT *, last_value(CASE WHEN trim(text) <> '' THEN id END IGNORE NULLS) OVER {_W} AS bid,
   last_value(CASE WHEN trim(text) <> '' THEN type END IGNORE NULLS) OVER {_W} AS bt FROM typed)
  SELECT id AS source_id, bid AS target_id, 'explains' AS type, CAST(0.8 AS DOUBLE) AS confidence FROM b WHERE type = 'proof' AND bt IN ('theorem', 'property', 'concept')""")
def _(t):
    return ob.proof_edges(ob.typed_objects(t.objects()))


@query("worked_examples", "W8")
def _(t):
    return ob.worked_examples(ob.typed_objects(t.objects()))


# Three parsers over the same lines, with their own confidence, notation and coordinates.
_PARSED_SQL = f"""{LINES_SQL}, parsed AS (SELECT doc_id AS book, 'paragraph' AS type, pos // 20 + 1 AS page, pos AS reading_order, line AS text, p AS parser_rank,
   ['alpha', 'beta', 'gamma'][p + 1] AS parser, doc_id || ':' || pos || ':' || p AS id, ((doc_id * (2 * p + 3) + pos * 7) % 10) / 10 AS confidence,
   'f' || (pos + p) % 2 AS latex, CASE WHEN (doc_id + pos + p) % 3 = 0 THEN p + 0.5 END AS y0 FROM lines, range(3) r(p))"""


def _parsed(t):
    lines = t.lines().withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return lines.select(
        F.col("doc_id").alias("book"), F.lit("paragraph").alias("type"), (F.floor(F.col("pos") / 20) + 1).alias("page"), F.col("pos").alias("reading_order"),
        F.col("line").alias("text"), F.col("p").alias("parser_rank"), F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))[F.col("p")].alias("parser"),
        F.concat_ws(":", "doc_id", "pos", "p").alias("id"), (((F.col("doc_id") * (2 * F.col("p") + 3) + F.col("pos") * 7) % 10) / 10).alias("confidence"),
        F.array(F.concat(F.lit("f"), ((F.col("pos") + F.col("p")) % 2).cast("string"))).alias("latex"),
        F.when((F.col("doc_id") + F.col("pos") + F.col("p")) % 3 == 0, F.struct((F.col("p") + 0.5).alias("y0"))).alias("coordinates"))


@query("parser_merge", "W9", f"""WITH {_PARSED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY book, reading_order ORDER BY confidence DESC, parser_rank) AS rn FROM parsed)
  SELECT book, reading_order, max(CASE WHEN rn = 1 THEN id END) AS id, max(CASE WHEN rn = 1 THEN parser END) AS parser, max(CASE WHEN rn = 1 THEN confidence END) AS confidence,
     CASE WHEN count(DISTINCT latex) = 1 THEN any_value(latex) ELSE max(CASE WHEN rn = 1 THEN latex END) || ',' || max(CASE WHEN latex <> (SELECT latex FROM r r2 WHERE r2.book = r.book AND r2.reading_order = r.reading_order AND rn = 1) THEN latex END) END AS latex,
     CAST(arg_min(y0, rn) FILTER (y0 IS NOT NULL) AS DOUBLE) AS y0 FROM r GROUP BY book, reading_order""")
def _(t):
    m = ob.merge_parsers(_parsed(t))
    return m.select("book", "reading_order", "id", "parser", "confidence", F.array_join("latex", ",").alias("latex"), F.col("coordinates.y0").cast("double").alias("y0"))


@query("duplicate_collapse", "A14", f"""WITH {LINES_SQL}, d AS (SELECT sha1(line) AS key, doc_id || ':' || pos AS id, doc_id % 3 AS parser_rank FROM lines)
  SELECT key, arg_min(id, (parser_rank, id)) AS id, count(*) OVER () AS n_keys FROM d GROUP BY key""")
def _(t):
    rows = t.lines().select(F.sha1("line").alias("key"), F.concat_ws(":", "doc_id", "pos").alias("id"), (F.col("doc_id") % 3).alias("parser_rank"))
    kept = ob.collapse_duplicates(rows, ["key"])
    n = kept.agg(F.count("*").alias("n_keys"))
    return kept.select("key", "id").join(F.broadcast(n))


@query("heading_tree", "W10", f"""WITH {LEVELS_SQL}, h AS (SELECT book, page, reading_order, 'Chapter ' || chapter_no AS chapter, CASE WHEN section_no IS NOT NULL THEN 'Section ' || section_no END AS section FROM leveled WHERE own_type = 'heading'),
  f AS (SELECT book, section, arg_min(chapter, reading_order) AS chapter, arg_min(page, reading_order) AS page_start FROM h WHERE chapter IS NOT NULL AND section IS NOT NULL GROUP BY 1, 2)
  SELECT book, chapter, NULL AS section, arg_min(page, reading_order) AS page_start FROM h WHERE chapter IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT book, chapter, section, page_start FROM f""")
def _(t):
    # Only headings set numbers, and only headings are asked for: nothing else is carried.
    o = cut_lineage(t.objects().where(labels.own_type(F.col("text")) == "heading"))
    h = ob.heading_levels(o, F.lit(True), F.col("subject"))
    h = h.withColumn("chapter", F.concat(F.lit("Chapter "), "chapter_no")).withColumn("section", F.concat(F.lit("Section "), "section_no"))
    return ob.heading_tree(h)


_Y = "CAST((reading_order * 37) % 101 AS DOUBLE)"


@query("nearest_caption", "J10", f"""WITH {OWN_TYPE_SQL}, f AS (SELECT id AS figure_id, book, page, {_Y} AS y0 FROM own WHERE own_type = 'caption'),
  c AS (SELECT id AS match_id, book, page, {_Y} AS c_y0, reading_order, own_type <> 'theorem' AS other FROM own WHERE own_type IN ('theorem', 'definition', 'proof', 'worked_example'))
  SELECT figure_id, arg_min(match_id, (other, abs(c_y0 - y0), reading_order)) AS match_id FROM f JOIN c USING (book, page) GROUP BY 1""")
def _(t):
    own = t.objects().withColumn("own_type", labels.own_type(F.col("text"))).withColumn("y0", ((F.col("reading_order") * 37) % 101).cast("double"))
    figures = own.where("own_type = 'caption'").select(F.col("id").alias("figure_id"), "book", "page", "y0")
    cand = own.where(F.col("own_type").isin("theorem", "definition", "proof", "worked_example")).withColumnRenamed("id", "match_id")
    return ob.nearest_on_page(figures, cand, F.col("own_type") == "theorem")


@query("best_overlap", "J11", f"""WITH {OWN_TYPE_SQL}, b AS (SELECT book * 1000000 + reading_order AS id, book, page, own_type, (reading_order * 13) % 50 AS x0, (reading_order * 29) % 50 AS y0 FROM own),
  j AS (SELECT i.id AS image_id, r.id AS region_id, least(i.x0, r.x0) + 20 - greatest(i.x0, r.x0) AS w, least(i.y0, r.y0) + 15 - greatest(i.y0, r.y0) AS h
        FROM b i JOIN b r USING (book, page) WHERE i.own_type = 'caption' AND r.own_type = 'definition')
  SELECT image_id, arg_max(region_id, (w * h, -region_id)) AS region_id, max(w * h) AS area FROM j WHERE w > 0 AND h > 0 GROUP BY 1""")
def _(t):
    o = t.objects().withColumn("own_type", labels.own_type(F.col("text")))
    ro = F.col("reading_order")
    b = o.select((F.col("book") * 1000000 + ro).alias("id"), "book", "page", "own_type", ((ro * 13) % 50).alias("x0"), ((ro * 29) % 50).alias("y0"))
    b = b.select("*", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 15).alias("y1"))
    return ob.best_overlap(b.where("own_type = 'caption'").drop("own_type"), b.where("own_type = 'definition'").drop("own_type"))


_ISSUES_SQL = f"""{TYPED_SQL}, q AS (SELECT *, ((book + reading_order) % 10) / 10 AS confidence FROM typed),
issues AS (SELECT id, type, 'confidence' AS field, 'review' AS severity, 'low confidence' AS message FROM q WHERE confidence < 0.5
  UNION ALL SELECT id, type, 'text', 'warning', 'empty text' FROM q WHERE trim(text) = '' AND type NOT IN ('figure', 'diagram')
  UNION ALL SELECT id, type, 'text', 'review', 'very short' FROM q WHERE type IN ('definition', 'theorem', 'property') AND length(text) < 10
  UNION ALL SELECT id, type, 'page', 'warning', 'no page number' FROM q WHERE page < 1)"""


def _graded(t):
    return ob.typed_objects(t.objects()).withColumn("confidence", ((F.col("book") + F.col("reading_order")) % 10) / 10)


@query("object_issues", "P20", f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def _(t):
    return ob.object_issues(_graded(t))


@query("object_validation_report", "A9", f"""WITH {_ISSUES_SQL} SELECT coalesce(field, 'all') AS field, coalesce(severity, 'all') AS severity, count(*) AS n_issues, count(DISTINCT id) AS n_objects
  FROM issues GROUP BY ROLLUP (field, severity)""")
def _(t):
    return ob.validation_report(_graded(t))
