"""Driver queries for lexical search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import search
from .bindings import QUERIES_SQL, SEARCH_DOCS_SQL, LINES_SQL, sql_tokens
from .registry import query

_TOK = f"""tok AS (
  SELECT concept_id, field, unnest({sql_tokens("txt", vocab.SEARCH_STOP_WORDS, stem=True)}) AS term
  FROM (SELECT concept_id, 'name' AS field, name AS txt FROM search_docs
        UNION ALL SELECT concept_id, 'definition', unnest(definition_texts) FROM search_docs
        UNION ALL SELECT concept_id, 'example', unnest(example_texts) FROM search_docs))"""

BM25_SQL = f"""{SEARCH_DOCS_SQL}, {QUERIES_SQL}, {_TOK},
n AS (SELECT count(*) AS n FROM search_docs),
len AS (SELECT concept_id, count(*) FILTER (field='name') AS ln, count(*) FILTER (field='definition') AS ld,
               count(*) FILTER (field='example') AS le FROM tok GROUP BY 1),
av AS (SELECT sum(ln)/any_value(n) AS an, sum(ld)/any_value(n) AS ad, sum(le)/any_value(n) AS ae FROM len, n),
tf AS (SELECT concept_id, term, count(*) FILTER (field='name') AS tn, count(*) FILTER (field='definition') AS td,
              count(*) FILTER (field='example') AS te FROM tok GROUP BY 1, 2),
idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term),
qtoks AS (SELECT query_id, {sql_tokens("query", vocab.SEARCH_STOP_WORDS, stem=True)} AS qt FROM queries),
q AS (SELECT query_id, array_to_string(qt, ' ') AS qkey, len(list_distinct(qt)) AS n_terms,
             unnest(list_distinct(qt)) AS term FROM qtoks),
w AS (SELECT tf.concept_id, term, tn, 3.0*tn/(0.25+0.75*ln/CASE an WHEN 0 THEN 1 ELSE an END)
          + 1.0*td/(0.25+0.75*ld/CASE ad WHEN 0 THEN 1 ELSE ad END)
          + 0.5*te/(0.25+0.75*le/CASE ae WHEN 0 THEN 1 ELSE ae END) AS wtf
      FROM tf JOIN len USING (concept_id), av),
sc AS (SELECT query_id, concept_id, qkey, n_terms, sum(idf * wtf * 2.5 / (1.5 + wtf)) AS bm25, count(*) FILTER (tn > 0) AS in_name
       FROM q JOIN w USING (term) JOIN idf USING (term) GROUP BY 1, 2, 3, 4),
boosted AS (SELECT sc.*, lower(name) AS sort_name, subject, chapter,
        CASE WHEN qkey = array_to_string({sql_tokens("name", vocab.SEARCH_STOP_WORDS, stem=True)}, ' ') THEN 1000.0
             WHEN in_name = n_terms THEN 100.0 ELSE 0.0 END AS boost
        FROM sc JOIN search_docs USING (concept_id)),
scored AS (SELECT *, round(bm25 + boost, 6) AS score FROM boosted)"""

RANKED_SQL = f"""{BM25_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sort_name, concept_id) AS rank
           FROM scored WHERE score > 0)"""


@query("bm25f_search", "R1 T1", f"WITH {RANKED_SQL} SELECT query_id, rank, concept_id, round(score, 4) AS score FROM ranked WHERE rank <= 5")
def _(t):
    hits = search.bm25f_search(t.search_docs(), t.queries())
    return hits.select("query_id", "rank", "concept_id", text.round_half_up(F.col("score"), 4).alias("score"))


@query("exact_name_boost", "R2", f"""WITH {BM25_SQL.replace(QUERIES_SQL, '''queries AS (
  SELECT concept_id AS query_id, name AS query FROM search_docs)''')}
  SELECT query_id, concept_id, CAST(boost AS DOUBLE) AS boost FROM scored WHERE boost > 0""")
def _(t):
    docs = t.search_docs()
    queries = docs.select(F.col("concept_id").alias("query_id"), F.col("name").alias("query"))
    return search.exact_hits(docs, queries)


@query("bm25f_batch_search", "R3", f"""WITH {RANKED_SQL.replace(QUERIES_SQL, '''queries AS (
  SELECT item_id AS query_id, text AS query FROM benchmark)''')}
  SELECT query_id, rank, concept_id, round(score, 4) AS score FROM ranked WHERE rank <= 10""")
def _(t):
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = search.bm25f_search(t.search_docs(), queries, 10)
    return hits.select("query_id", "rank", "concept_id", text.round_half_up(F.col("score"), 4).alias("score"))


@query("bm25f_filtered_search", "T3 P21", f"""WITH {BM25_SQL},
  kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sort_name, concept_id) AS rank
           FROM scored WHERE score > 0 AND subject = 'en' AND chapter IN ('src1', 'src3', 'src5'))
  SELECT query_id, rank, concept_id, round(score, 4) AS score FROM kept WHERE rank <= 5""")
def _(t):
    keep = (F.col("subject") == "en") & F.col("chapter").isin("src1", "src3", "src5")
    hits = search.bm25f_search(t.search_docs(), t.queries(), keep=keep)
    return hits.select("query_id", "rank", "concept_id", text.round_half_up(F.col("score"), 4).alias("score"))


@query("corpus_statistics", "A1", f"""WITH {SEARCH_DOCS_SQL}, {_TOK}
  SELECT term, count(DISTINCT concept_id) AS df,
         round(ln(1 + ((SELECT count(*) FROM search_docs) - count(DISTINCT concept_id) + 0.5) / (count(DISTINCT concept_id) + 0.5)), 4) AS idf
  FROM tok GROUP BY term""")
def _(t):
    return search.corpus_statistics(t.search_docs()).select("term", "df", text.round_half_up(F.col("idf"), 4).alias("idf"))


@query("field_length_averages", "A1", f"""WITH {SEARCH_DOCS_SQL}, {_TOK}
  SELECT (SELECT count(*) FROM search_docs) AS n_docs,
         round(count(*) FILTER (field='name') / (SELECT count(*) FROM search_docs), 4) AS avg_name,
         round(count(*) FILTER (field='definition') / (SELECT count(*) FROM search_docs), 4) AS avg_definition,
         round(count(*) FILTER (field='example') / (SELECT count(*) FROM search_docs), 4) AS avg_example FROM tok""")
def _(t):
    s = search.length_stats(t.search_docs())
    return s.select("n_docs", *[text.round_half_up(F.col(f"avg_{f}"), 4).alias(f"avg_{f}") for f in ("name", "definition", "example")])


@query("content_token_counts", "P1 P2", f"""WITH {LINES_SQL}
  SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({sql_tokens("line", vocab.SEARCH_STOP_WORDS, stem=True)}) AS term FROM lines)
  GROUP BY ALL""")
def _(t):
    toks = t.lines().select("lang", F.explode(text.words(F.col("line"))).alias("w"))
    toks = toks.where(text.is_content(F.col("w"), vocab.SEARCH_STOP_WORDS))
    return toks.groupBy("lang", text.plural_stem(F.col("w")).alias("term")).agg(F.count("*").alias("n"))


@query("grounding_token_counts", "P3", f"""WITH {LINES_SQL}
  SELECT source, term, count(*) AS n FROM (SELECT source, unnest({sql_tokens("line", vocab.GROUNDING_STOP_WORDS)}) AS term FROM lines)
  GROUP BY ALL""")
def _(t):
    toks = t.lines().select("source", F.explode(text.words(F.col("line"))).alias("term"))
    return toks.where(text.is_content(F.col("term"), vocab.GROUNDING_STOP_WORDS)).groupBy("source", "term").agg(F.count("*").alias("n"))


@query("content_share_by_source", "P4", f"""WITH {LINES_SQL}
  SELECT source, len({sql_tokens("line", vocab.SEARCH_STOP_WORDS)}) > 0 AS has_content, count(*) AS n FROM lines GROUP BY ALL""")
def _(t):
    return t.lines().groupBy("source", text.has_content(F.col("line")).alias("has_content")).agg(F.count("*").alias("n"))


@query("name_search", "T5", f"""WITH {SEARCH_DOCS_SQL}, {QUERIES_SQL},
  q AS (SELECT query_id, lower(query) AS q, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2) AS ws FROM queries),
  hit AS (SELECT query_id, concept_id, name, row_number() OVER (PARTITION BY query_id ORDER BY lower(name), concept_id) AS rank
          FROM q JOIN search_docs ON contains(lower(name), q) OR contains(q, lower(name))
             OR len(list_filter(ws, lambda w: contains(lower(name), w))) > 0)
  SELECT query_id, rank, concept_id, name FROM hit WHERE rank <= 5""")
def _(t):
    return search.name_search(t.search_docs(), t.queries())
