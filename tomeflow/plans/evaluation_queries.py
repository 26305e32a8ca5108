"""Driver queries for the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as ev
from ..operators import fusion, search
from .bindings import QUERIES_SQL, SEARCH_DOCS_SQL
from .registry import query
from .search_queries import RANKED_SQL
from .vector_queries import CANDIDATES_SQL

# Relevance: a benchmark query expects the names of its lexical winner's chapter.
def _expect_sql(item: str) -> str:
    return f"""top1 AS (SELECT query_id, subject, chapter FROM ranked WHERE rank = 1),
expect AS (SELECT DISTINCT query_id, {item} FROM top1 JOIN search_docs USING (subject, chapter)),
n_expect AS (SELECT query_id, count(*) AS n FROM expect GROUP BY 1),
ideal AS (SELECT query_id, n, (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) g(i) WHERE i <= n) AS idcg FROM n_expect)"""


_EXPECT_SQL = _expect_sql("concept_id")
_JUDGED = f"""{RANKED_SQL}, {_expect_sql("lower(name) AS label")},
judged AS (SELECT r.query_id, r.rank, CAST(e.label IS NOT NULL AS INT) AS rel FROM ranked r JOIN search_docs d USING (concept_id)
           LEFT JOIN expect e ON e.query_id = r.query_id AND e.label = lower(d.name) WHERE rank <= 5)"""
_METRICS = """metrics AS (SELECT q.query_id, coalesce(max(CASE WHEN rel = 1 THEN 1 / rank END), 0) AS mrr,
   coalesce(sum(rel) FILTER (rank <= 1) / any_value(n), 0) AS recall_1, coalesce(sum(rel) FILTER (rank <= 3) / any_value(n), 0) AS recall_3, coalesce(sum(rel) / any_value(n), 0) AS recall_5,
   coalesce(sum(rel) FILTER (rank <= 1), 0) / 1 AS precision_1, coalesce(sum(rel) FILTER (rank <= 3), 0) / 3 AS precision_3, coalesce(sum(rel), 0) / 5 AS precision_5,
   coalesce(sum(rel / log2(rank + 1)) / any_value(idcg), 0) AS ndcg_5
   FROM queries q LEFT JOIN judged USING (query_id) LEFT JOIN ideal USING (query_id) GROUP BY q.query_id)"""
_NAMES = ["mrr", "recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5", "ndcg_5"]
_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in _NAMES)
_MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in _NAMES)


def _plain_labels(docs):
    return docs.select("concept_id", F.lower("name").alias("label"))


def _judged(t):
    docs, queries = t.search_docs(), t.queries()
    hits = t.hits().select("query_id", "rank", "concept_id")
    homes = docs.select("concept_id", "subject", "chapter")
    top = hits.where("rank = 1").join(homes, "concept_id").select("query_id", "subject", "chapter")
    names = docs.select("subject", "chapter", F.lower("name").alias("expected")).distinct()
    qrels = top.join(names, ["subject", "chapter"]).select("query_id", "expected")
    asked = queries.select("query_id").join(qrels.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    return ev.relevance(hits, _plain_labels(docs), qrels), asked.select("query_id", F.coalesce("n", F.lit(0)).alias("n_expected"))


@query("relevance_flags", "E1", f"WITH {_JUDGED} SELECT query_id, rank, rel FROM judged")
def _(t):
    judged, _ = _judged(t)
    return judged.select("query_id", "rank", "rel")


@query("retrieval_metrics", "E2", f"WITH {_JUDGED}, {_METRICS} SELECT query_id, {_ROUNDED} FROM metrics")
def _(t):
    m = ev.retrieval_metrics(*_judged(t))
    return m.select("query_id", *[F.round(c, 4).alias(c) for c in _NAMES])


@query("mean_retrieval_metrics", "E2", f"WITH {_JUDGED}, {_METRICS} SELECT count(*) AS n_queries, {_MEANS} FROM metrics")
def _(t):
    m = ev.mean_metrics(ev.retrieval_metrics(*_judged(t)))
    return m.select("n_queries", *[F.round(c, 4).alias(c) for c in _NAMES])


_GRID = [(k, a, b) for k in (10, 20, 60) for a, b in ((1.0, 1.0), (1.0, 2.0), (2.0, 1.0))]
_GRID_SQL = ", ".join(f"({k}, {a}, {b})" for k, a, b in _GRID)


def _expected(t, lists, docs):
    top = lists.where("list = 'lexical' AND rank = 1").join(docs.select("concept_id", "subject", "chapter"), "concept_id").select("query_id", "subject", "chapter")
    return top.join(docs.select("concept_id", "subject", "chapter"), ["subject", "chapter"]).select("query_id", "concept_id")


@query("fusion_weight_sweep", "R12", f"""WITH {CANDIDATES_SQL}, {_EXPECT_SQL}, grid(rrf_k, w_lexical, w_dense) AS (VALUES {_GRID_SQL}),
  f AS (SELECT rrf_k, w_lexical, w_dense, query_id, concept_id, round(sum(CASE list WHEN 'lexical' THEN w_lexical ELSE w_dense END / (rrf_k + rank)), 9) AS score
        FROM lists, grid GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY rrf_k, w_lexical, w_dense, query_id ORDER BY score DESC, concept_id) AS rank FROM f),
  j AS (SELECT r.*, CAST(e.concept_id IS NOT NULL AS INT) AS rel FROM r LEFT JOIN expect e USING (query_id, concept_id) WHERE rank <= 5),
  m AS (SELECT rrf_k, w_lexical, w_dense, j.query_id, coalesce(max(CASE WHEN rel = 1 THEN 1 / rank END), 0) AS mrr,
               sum(rel) / any_value(n) AS recall_5, sum(rel / log2(rank + 1)) / any_value(idcg) AS ndcg_5 FROM j JOIN ideal USING (query_id) GROUP BY ALL)
  SELECT CAST(rrf_k AS INT) AS rrf_k, CAST(w_lexical AS DOUBLE) AS w_lexical, CAST(w_dense AS DOUBLE) AS w_dense, count(*) AS n_queries,
         round(avg(mrr), 6) AS mrr, round(avg(recall_5), 6) AS recall_5, round(avg(ndcg_5), 6) AS ndcg_5 FROM m GROUP BY ALL""")
def _(t):
    docs = t.search_docs()
    lists = t.candidate_lists()
    expected = _expected(t, lists, docs)
    fused = fusion.weight_sweep(lists, _GRID)
    judged = fused.join(expected.withColumn("rel", F.lit(1)), ["query_id", "concept_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    n = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    cell = ["rrf_k", "w_lexical", "w_dense"]
    m = ev.mean_metrics(ev.retrieval_metrics(judged, n, cell), cell)
    return m.select(*cell, "n_queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_5", "ndcg_5")])


@query("strategy_report", "R13", f"""WITH {CANDIDATES_SQL}, {_EXPECT_SQL},
  fu AS (SELECT query_id, concept_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY ALL),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS rank FROM fu),
  every AS (SELECT list AS strategy, query_id, concept_id, rank FROM lists WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, concept_id, rank FROM fr WHERE rank <= 5),
  j AS (SELECT every.*, CAST(e.concept_id IS NOT NULL AS INT) AS rel FROM every LEFT JOIN expect e USING (query_id, concept_id)),
  m AS (SELECT strategy, j.query_id, coalesce(max(CASE WHEN rel = 1 THEN 1 / rank END), 0) AS mrr, sum(rel) / any_value(n) AS recall_5,
               sum(rel / log2(rank + 1)) / any_value(idcg) AS ndcg_5 FROM j JOIN ideal USING (query_id) GROUP BY ALL)
  SELECT strategy, count(*) AS n_queries, round(avg(mrr), 4) AS mrr, round(avg(recall_5), 4) AS recall_5, round(avg(ndcg_5), 4) AS ndcg_5,
         CASE WHEN strategy = 'lexical' THEN 0 ELSE (SELECT count(*) FROM search_docs) * 256 * 8 END AS vector_bytes FROM m GROUP BY ALL""")
def _(t):
    docs = t.search_docs()
    lists = t.candidate_lists()
    fused = fusion.fuse(lists, {"lexical": 1.0, "dense": 1.0}).select("query_id", F.lit("hybrid").alias("list"), "concept_id", "rank")
    every = lists.unionByName(fused).where("rank <= 5").withColumnRenamed("list", "strategy")
    expected = _expected(t, lists, docs)
    judged = every.join(expected.withColumn("rel", F.lit(1)), ["query_id", "concept_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    n = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    m = ev.mean_metrics(ev.retrieval_metrics(judged, n, ["strategy"]), ["strategy"])
    size = docs.agg((F.count("*") * 256 * 8).alias("vector_bytes"))
    m = m.join(F.broadcast(size))
    return m.select("strategy", "n_queries", *[F.round(c, 4).alias(c) for c in ("mrr", "recall_5", "ndcg_5")],
                    F.when(F.col("strategy") == "lexical", 0).otherwise(F.col("vector_bytes")).alias("vector_bytes"))


# Found names: opening words of documents. Gold: the same of labelled documents, with a second name as alias.
_FOUND_SQL = f"""{SEARCH_DOCS_SQL}, found AS (SELECT chapter, lower(name) AS name FROM search_docs),
gold AS (SELECT chapter, concept_id AS gold_id, unnest([lower(name), lower(subject || ' ' || name)]) AS label FROM search_docs JOIN labels ON doc_id = concept_id)"""


@query("name_extraction_scores", "E3", f"""WITH {_FOUND_SQL},
  d AS (SELECT DISTINCT chapter, name FROM found), p AS (SELECT d.chapter, name, gold_id FROM d JOIN gold ON gold.chapter = d.chapter AND label = name),
  s AS (SELECT chapter, count(DISTINCT name) AS mf, count(DISTINCT gold_id) AS mg FROM p GROUP BY 1),
  x AS (SELECT chapter, n_found, n_gold, coalesce(mf, 0) / n_found AS pr, coalesce(mg, 0) / n_gold AS re FROM (SELECT chapter, count(*) AS n_found FROM d GROUP BY 1)
        JOIN (SELECT chapter, count(DISTINCT gold_id) AS n_gold FROM gold GROUP BY 1) USING (chapter) LEFT JOIN s USING (chapter))
  SELECT chapter, n_found, n_gold, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM x""")
def _(t):
    docs = t.search_docs()
    found = docs.select("chapter", F.lower("name").alias("name"))
    labelled = docs.join(t.labels.select(F.col("doc_id").alias("concept_id")), "concept_id")
    gold = labelled.select("chapter", F.col("concept_id").alias("gold_id"),
                           F.explode(F.array(F.lower("name"), F.lower(F.concat_ws(" ", "subject", "name")))).alias("label"))
    s = ev.name_extraction_scores(found, gold, ["chapter"])
    return s.select("chapter", "n_found", "n_gold", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("hierarchy_accuracy", "E4", """SELECT p_brand AS brand, count(*) AS n_checked,
    round(avg(CASE WHEN p_partkey // 2 = p_partkey // (2 + p_size % 2) THEN 1 ELSE 0 END), 4) AS accuracy FROM part GROUP BY 1""")
def _(t):
    p = t.part
    gold = p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("name"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    actual = p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("name"), F.floor(F.col("p_partkey") / (2 + F.col("p_size") % 2)).alias("parent"))
    return ev.hierarchy_accuracy(gold, actual, ["brand"]).select("brand", "n_checked", F.round("accuracy", 4).alias("accuracy"))


# Gold edges: part bought from supplier with returns; inferred: with a discount.
_EDGES_SQL = """gold AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target, l_linestatus AS type FROM lineitem WHERE l_returnflag = 'R'),
inferred AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target, l_linestatus AS type FROM lineitem WHERE l_discount >= 0.05)"""


def _edges(t):
    e = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("type"), "l_returnflag", "l_discount")
    keys = ["source", "target", "type"]
    return ev.edge_sets(e.where("l_returnflag = 'R'").select(*keys), e.where("l_discount >= 0.05").select(*keys), keys)


@query("edge_set_differences", "U1", f"""WITH {_EDGES_SQL}
  SELECT source, target, type, CAST(g.source IS NOT NULL AS INT) AS in_gold, CAST(i.source IS NOT NULL AS INT) AS in_inferred FROM (SELECT * FROM gold UNION SELECT * FROM inferred) u
  LEFT JOIN gold g USING (source, target, type) LEFT JOIN inferred i USING (source, target, type)""")
def _(t):
    return _edges(t)


@query("edge_scores", "E5", f"""WITH {_EDGES_SQL}, c AS (SELECT type, (SELECT count(*) FROM (SELECT * FROM gold INTERSECT SELECT * FROM inferred) x WHERE x.type = g.type) AS tp,
    (SELECT count(*) FROM inferred i WHERE i.type = g.type) AS n_inferred, count(*) AS n_gold FROM gold g GROUP BY type)
  SELECT type, tp AS true_positives, n_inferred, n_gold, round(tp / n_inferred, 4) AS precision, round(tp / n_gold, 4) AS recall,
         round(2 * (tp / n_inferred) * (tp / n_gold) / (tp / n_inferred + tp / n_gold), 4) AS f1 FROM c""")
def _(t):
    s = ev.edge_scores(_edges(t), ["type"])
    return s.select("type", "true_positives", "n_inferred", "n_gold", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


_KW = ["the", "and", "is", "que", "und", "los"]


@query("keyword_linking", "E6", f"""WITH linked AS (SELECT source, lang, text FROM documents),
  e AS (SELECT source, lang, unnest({_KW!r}) AS keyword FROM (SELECT DISTINCT source, lang FROM documents))
  SELECT source, count(*) AS n_expected, round(avg(CAST(hit AS INT)), 4) AS accuracy FROM (
    SELECT e.source, e.lang, keyword, bool_or(contains(lower(text), keyword)) AS hit FROM e JOIN linked USING (source, lang) GROUP BY ALL) GROUP BY 1""")
def _(t):
    d = t.documents.select("doc_id", "source", F.concat_ws("/", "source", "lang").alias("concept_id"), "text")
    expected = d.select("source", "concept_id").distinct().select("source", "concept_id", F.explode(F.array(*[F.lit(k) for k in _KW])).alias("keyword"))
    links = d.select("concept_id", F.col("doc_id").alias("object_id"))
    texts = d.select(F.col("doc_id").alias("object_id"), "text")
    out = ev.keyword_linking(expected, links, texts, ["source"])
    return out.select("source", "n_expected", F.round("accuracy", 4).alias("accuracy"))


@query("order_agreement", "E7", """WITH e AS (SELECT source, doc_id AS item, doc_id AS e_pos, n_chars AS a_pos FROM documents WHERE lang <> 'de'),
  p AS (SELECT x.source, count(*) AS pairs, count(*) FILTER (x.a_pos < y.a_pos) AS conc FROM e x JOIN e y ON x.source = y.source AND x.e_pos < y.e_pos GROUP BY 1),
  n AS (SELECT source, count(*) AS n_expected, count(*) FILTER (lang <> 'de') AS n_common FROM documents GROUP BY 1)
  SELECT source, n_expected, n_common, round(n_common / n_expected, 4) AS coverage,
         round(CASE WHEN n_common >= 2 THEN conc / pairs WHEN n_common = 1 THEN 1 ELSE 0 END, 4) AS agreement FROM n LEFT JOIN p USING (source)""")
def _(t):
    d = t.documents
    expected = d.select("source", F.col("doc_id").alias("item"), F.col("doc_id").alias("pos"))
    actual = d.where("lang <> 'de'").select("source", F.col("doc_id").alias("item"), F.col("n_chars").alias("pos"))
    out = ev.order_agreement(expected, actual, ["source"])
    return out.select("source", "n_expected", "n_common", F.round("coverage", 4).alias("coverage"), F.round("agreement", 4).alias("agreement"))


@query("order_details", "E7", """SELECT source, doc_id AS item, doc_id % 100 AS expected_pos, CASE WHEN lang <> 'de' THEN n_chars % 100 END AS actual_pos,
    CASE WHEN lang = 'de' THEN 'missing' ELSE 'misordered' END AS status FROM documents WHERE lang = 'de' OR doc_id % 100 <> n_chars % 100""")
def _(t):
    d = t.documents
    expected = d.select("source", F.col("doc_id").alias("item"), (F.col("doc_id") % 100).alias("pos"))
    actual = d.where("lang <> 'de'").select("source", F.col("doc_id").alias("item"), (F.col("n_chars") % 100).alias("pos"))
    return ev.path_details(expected, actual, ["source"])


# Predictions over documents against the given labels: long texts are called good, digits in a text toxic.
_CASES_SQL = """cases AS (SELECT source, lang, n_chars, CASE WHEN l.doc_id IS NULL THEN NULL ELSE (n_chars > 500) = (quality = 1) END AS quality_ok,
   CASE WHEN l.doc_id IS NULL THEN NULL ELSE regexp_matches(text, '[0-9]') = (toxic = 1) END AS toxic_ok,
   len(string_split(text, chr(10))) AS n_refs, len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 40)) AS n_invalid
   FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _cases(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    lines = F.split("text", "\n")
    return d.select("source", "lang", "n_chars", ((F.col("n_chars") > 500) == (F.col("quality") == 1)).alias("quality_ok"),
                    (F.col("text").rlike("[0-9]") == (F.col("toxic") == 1)).alias("toxic_ok"),
                    F.size(lines).alias("n_refs"), F.size(F.filter(lines, lambda x: F.length(x) < 40)).alias("n_invalid"))


@query("label_accuracy", "E8", f"""WITH {_CASES_SQL} SELECT lang, count(*) AS n_cases, round(coalesce(avg(CAST(quality_ok AS INT)), 0), 6) AS quality_ok_accuracy,
   round(coalesce(avg(CAST(toxic_ok AS INT)), 0), 6) AS toxic_ok_accuracy, round((sum(n_refs) - sum(n_invalid)) / sum(n_refs), 6) AS citation_validity,
   round(avg(CAST(n_invalid = 0 AS INT)), 6) AS clean_rate FROM cases GROUP BY lang""")
def _(t):
    return ev.label_accuracy(_cases(t), ["quality_ok", "toxic_ok"], group=["lang"])


@query("regression_report", "E9", f"""WITH {_CASES_SQL}, r AS (SELECT lang, coalesce(quality_ok, FALSE) AS quality, coalesce(toxic_ok, FALSE) AS toxicity, n_chars AS latency_ms FROM cases)
  SELECT coalesce(lang, 'all') AS lang, count(*) AS total, round(100 * avg(CAST(quality AND toxicity AS INT)), 4) AS overall_accuracy,
   round(100 * avg(CAST(quality AS INT)), 4) AS quality_rate, round(100 * avg(CAST(toxicity AS INT)), 4) AS toxicity_rate, round(avg(latency_ms), 4) AS avg_latency_ms
  FROM r GROUP BY ROLLUP (lang)""")
def _(t):
    c = _cases(t).select("lang", F.coalesce("quality_ok", F.lit(False)).alias("quality"), F.coalesce("toxic_ok", F.lit(False)).alias("toxicity"), F.col("n_chars").alias("latency_ms"))
    r = ev.regression_report(c, ["quality", "toxicity"], "lang")
    return r.select(F.coalesce("lang", F.lit("all")).alias("lang"), "total", *[F.round(c, 4).alias(c) for c in ("overall_accuracy", "quality_rate", "toxicity_rate", "avg_latency_ms")])


@query("regression_gate", "E10", """WITH m AS (SELECT l_shipmode_key AS subject, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) AS quantity, is_new FROM (
     SELECT l_returnflag || l_linestatus AS l_shipmode_key, l_discount, l_tax, l_quantity, l_shipdate >= TIMESTAMP '1998-01-01' AS is_new FROM lineitem) GROUP BY 1, 5),
  u AS (SELECT subject, is_new, metric, value FROM m UNPIVOT (value FOR metric IN (discount, tax, quantity)))
  SELECT c.subject, c.metric, round(c.value, 6) AS value, round(b.value, 6) AS baseline, CASE WHEN b.value IS NULL THEN 'no usable baseline' ELSE 'regression' END AS problem
  FROM (SELECT * FROM u WHERE is_new) c LEFT JOIN (SELECT * FROM u WHERE NOT is_new) b USING (subject, metric) WHERE b.value IS NULL OR c.value + 1e-12 < b.value""")
def _(t):
    li = t.lineitem.withColumn("subject", F.concat("l_returnflag", "l_linestatus")).withColumn("is_new", F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    m = li.groupBy("subject", "is_new").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    u = m.unpivot(["subject", "is_new"], ["discount", "tax", "quantity"], "metric", "value").withColumn("status", F.lit("ok"))
    g = ev.regression_gate(u.where("is_new"), u.where("NOT is_new"))
    return g.select("subject", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "problem")


@query("reference_data_issues", "E11", """WITH c AS (SELECT p_brand AS book, p_name AS name, CASE WHEN p_size > 25 THEN p_type || ' ' || p_name END AS parent_name,
     CASE WHEN p_size > 49 THEN 1 ELSE 0 END AS n_req FROM part), nm AS (SELECT DISTINCT book, name FROM c),
  e AS (SELECT p_brand AS book, p_name AS source, upper(p_name) AS target FROM part WHERE p_retailprice > 1000),
  v AS (SELECT DISTINCT p_brand AS book, replace(p_brand, 'Brand#', '1.0.') AS version FROM part UNION ALL SELECT DISTINCT p_brand, p_type FROM part)
  SELECT book, 'duplicate name' AS issue, name AS entry FROM c GROUP BY book, name HAVING count(*) > 1
  UNION ALL SELECT book, 'unknown parent', parent_name FROM c WHERE parent_name IS NOT NULL AND (book, parent_name) NOT IN (SELECT book, name FROM nm)
  UNION ALL SELECT book, 'unknown source', source FROM e WHERE (book, source) NOT IN (SELECT book, name FROM nm)
  UNION ALL SELECT book, 'unknown target', target FROM e WHERE (book, target) NOT IN (SELECT book, name FROM nm)
  UNION ALL SELECT p_brand, 'unknown path entry', p_type FROM part WHERE (p_brand, p_type) NOT IN (SELECT book, name FROM nm)
  UNION ALL SELECT book, 'bad version', version FROM v WHERE NOT regexp_matches(version, '^\\d+\\.\\d+\\.\\d+$')
  UNION ALL SELECT book, 'no annotations', '' FROM c GROUP BY book HAVING max(n_req) = 0""")
def _(t):
    p = t.part.withColumn("book", F.col("p_brand"))
    concepts = p.select("book", F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.concat_ws(" ", "p_type", "p_name")).alias("parent_name"),
                        F.when(F.col("p_size") > 49, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("required"))
    edges = p.where("p_retailprice > 1000").select("book", F.col("p_name").alias("source"), F.upper("p_name").alias("target"))
    versions = p.select("book", F.replace("p_brand", F.lit("Brand#"), F.lit("1.0.")).alias("version")).distinct().unionByName(p.select("book", F.col("p_type").alias("version")).distinct())
    return ev.gold_issues(concepts, edges, p.select("book", F.col("p_type").alias("name")), versions)


@query("content_hash", "E12", """SELECT source, count(*) AS n_rows, sum(CAST('0x' || left(md5(doc_id || '|' || text || '|' || lang), 8) AS BIGINT)) AS hash_sum FROM documents GROUP BY source""")
def _(t):
    return ev.content_hash(t.documents.select("source", "doc_id", "text", "lang"), ["source"])


@query("determinism_check", "E12", "SELECT lang, TRUE AS deterministic FROM documents GROUP BY lang")
def _(t):
    run = t.documents.select("lang", "doc_id", F.md5("text").alias("digest"))
    again = t.documents.repartition(13, "text").select("lang", "doc_id", F.md5("text").alias("digest"))
    return ev.same_content(run, again, ["lang"])


_AQ = ["the", "que"]


@query("answer_quality", "E14", """SELECT lang, count(*) AS n, round(avg(CAST(n > 50 AND (contains(lower(answer), 'the') OR contains(lower(answer), 'que')) AS INT)), 4) AS quality_rate,
    round(avg(CAST(n > 20 AND n_sources > 0 AS INT)), 4) AS sourced_rate FROM (SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS lang, text AS answer, turn AS n_sources,
    len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations WHERE role = 'assistant') GROUP BY lang""")
def _(t):
    a = t.conversations.where("role = 'assistant'").select(F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("lang"), F.col("text").alias("answer"), F.col("turn").alias("n_sources"))
    q = ev.answer_quality(a, _AQ, "lang")
    return q.select("lang", "n", F.round("quality_rate", 4).alias("quality_rate"), F.round("sourced_rate", 4).alias("sourced_rate"))
