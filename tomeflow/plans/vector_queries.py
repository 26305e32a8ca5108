"""Driver queries for embeddings, vector search, fusion and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text, vocab
from ..operators import fusion, vectors
from .bindings import QUERIES_SQL, SEARCH_DOCS_SQL, sql_re, sql_tokens
from .label_queries import EXACT_SQL, FEATURES_SQL, ROUTED_SQL
from .registry import query
from .search_queries import BM25_SQL, RANKED_SQL

DOC_TEXT_SQL = """texts AS (
  SELECT concept_id AS id, array_to_string(list_filter([trim(name), array_to_string(list_filter(
           list_transform(definition_texts, lambda d: trim(d)), lambda d: d <> ''), ' ')], lambda p: p <> ''), chr(10)) AS text FROM search_docs)"""


def hashed_sql(src: str, out: str) -> str:
    """CTEs turning (id, text) rows of ``src`` into (id, bucket, weight) rows of ``out``."""
    return f"""{out}_t AS (SELECT id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tok FROM {src}),
{out}_c AS (SELECT id, CAST('0x' || substr(sha1(tok), 1, 8) AS BIGINT) % 256 AS bucket,
       sum(CASE WHEN CAST('0x' || substr(sha1(tok), 10, 1) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS s FROM {out}_t WHERE tok <> '' GROUP BY 1, 2),
{out} AS (SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS weight FROM {out}_c WHERE s <> 0)"""


DENSE_SQL = f"""{DOC_TEXT_SQL}, {hashed_sql("texts", "dv")},
qtexts AS (SELECT query_id AS id, query AS text FROM queries WHERE len({sql_tokens("query", vocab.SEARCH_STOP_WORDS)}) > 0),
{hashed_sql("qtexts", "qv")},
dots AS (SELECT q.id AS query_id, d.id AS concept_id, sum(q.weight * d.weight) AS s FROM qv q JOIN dv d USING (bucket) GROUP BY 1, 2),
cos AS (SELECT q.id AS query_id, d.id AS concept_id, round(coalesce(s, 0), 6) AS score
        FROM qtexts q CROSS JOIN texts d LEFT JOIN dots ON dots.query_id = q.id AND dots.concept_id = d.id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS rank FROM cos)"""


@query("hashing_embedding", "R4", f"""WITH {SEARCH_DOCS_SQL}, {DOC_TEXT_SQL}, {hashed_sql("texts", "dv")}
  SELECT id, bucket, round(weight, 5) AS weight FROM dv""")
def _(t):
    w = vectors.hashed_weights(vectors.embedding_text(t.search_docs()))
    return w.select("id", "bucket", text.round_half_up(F.col("weight"), 5).alias("weight"))


@query("embedding_texts", "P23", f"WITH {SEARCH_DOCS_SQL}, {DOC_TEXT_SQL} SELECT id, md5(text) AS text_md5, length(text) AS n FROM texts")
def _(t):
    return vectors.embedding_text(t.search_docs()).select("id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


@query("checksums", "P24", f"""WITH {SEARCH_DOCS_SQL}, {DOC_TEXT_SQL}
  SELECT id, left(sha256(text || '|hashing|hashing-bow-256|256'), 16) AS checksum FROM texts""")
def _(t):
    e = vectors.embedding_text(t.search_docs())
    return e.select("id", text.checksum(F.col("text"), F.lit("hashing"), F.lit("hashing-bow-256"), F.lit("256")).alias("checksum"))


def _centroids(t):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vector"))


def _stored(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


_CENTROID_SQL = """cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
means AS (SELECT label AS query_id, pos, avg(v) AS m FROM cells GROUP BY 1, 2),
qn AS (SELECT query_id, sqrt(sum(m * m)) AS n FROM means GROUP BY 1), vn AS (SELECT vec_id, any_value(label) AS label, sqrt(sum(v * v)) AS n FROM cells GROUP BY 1),
dot AS (SELECT query_id, vec_id, sum(v * m) AS s FROM cells JOIN means USING (pos) GROUP BY 1, 2),
cos AS (SELECT query_id, vec_id AS id, vn.label, round(s / (qn.n * vn.n), 6) AS score FROM dot JOIN qn USING (query_id) JOIN vn USING (vec_id))"""


@query("vector_topk", "R5 T2", f"""WITH {_CENTROID_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos)
  SELECT query_id, rank, id, round(score, 4) AS score FROM r WHERE rank <= 10""")
def _(t):
    hits = vectors.vector_topk(_stored(t), _centroids(t), 10)
    return hits.select("query_id", "rank", "id", text.round_half_up(F.col("score"), 4).alias("score"))


@query("vector_topk_with_payload", "P22", f"""WITH {_CENTROID_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos WHERE label = 3)
  SELECT query_id, rank, id, round(score, 4) AS score FROM r WHERE rank <= 10""")
def _(t):
    hits = vectors.vector_topk(_stored(t).where("label = 3"), _centroids(t), 10)
    return hits.select("query_id", "rank", "id", text.round_half_up(F.col("score"), 4).alias("score"))


@query("dense_search", "R6", f"""WITH {SEARCH_DOCS_SQL}, {QUERIES_SQL}, {DENSE_SQL}
  SELECT query_id, rank, concept_id, round(score, 4) AS score FROM dense WHERE rank <= 5""")
def _(t):
    hits = vectors.dense_search(t.search_docs(), t.queries(), 5)
    return hits.select("query_id", "rank", "concept_id", text.round_half_up(F.col("score"), 4).alias("score"))


CANDIDATES_SQL = f"""{RANKED_SQL}, {DENSE_SQL},
lists AS (SELECT query_id, 'lexical' AS list, concept_id, rank FROM ranked WHERE rank <= 50
          UNION ALL SELECT query_id, 'dense', concept_id, rank FROM dense WHERE rank <= 50)"""

_FUSED = """fused AS (SELECT query_id, concept_id, round(sum({w} / ({k} + rank)), 9) AS score FROM lists GROUP BY 1, 2),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS rank FROM fused)"""


@query("reciprocal_rank_fusion", "R7", f"""WITH {CANDIDATES_SQL}, {_FUSED.format(w="CASE list WHEN 'dense' THEN 2.0 ELSE 1.0 END", k=20)}
  SELECT query_id, rank, concept_id, round(score, 7) AS score FROM hybrid""")
def _(t):
    fused = fusion.fuse(t.candidate_lists(), {"lexical": 1.0, "dense": 2.0}, 20)
    return fused.select("query_id", "rank", "concept_id", text.round_half_up(F.col("score"), 7).alias("score"))


HYBRID_SQL = f"{CANDIDATES_SQL}, {_FUSED.format(w='1.0', k=60)}"


@query("hybrid_search", "R8 F2", f"WITH {HYBRID_SQL} SELECT query_id, rank, concept_id, round(score, 7) AS score FROM hybrid WHERE rank <= 5")
def _(t):
    hits = fusion.fused_top(t.candidate_lists(), 5)
    return hits.select("query_id", "rank", "concept_id", text.round_half_up(F.col("score"), 7).alias("score"))


_BENCH_FLAGS = f"""{FEATURES_SQL[FEATURES_SQL.index("features AS"):]}, {EXACT_SQL}"""
_CHOICE = "CASE WHEN is_exact OR is_quoted THEN 'hybrid' WHEN is_math THEN 'bm25f' ELSE 'dense' END"


@query("routed_search", "R10", f"""WITH {HYBRID_SQL}, {_BENCH_FLAGS}, choice AS (SELECT query_id, {_CHOICE} AS strategy FROM flagged)
  SELECT query_id, strategy, rank, concept_id, round(score, 4) AS score FROM choice JOIN (
    SELECT query_id, 'bm25f' AS strategy, rank, concept_id, score FROM ranked WHERE rank <= 5
    UNION ALL SELECT query_id, 'dense', rank, concept_id, score FROM dense WHERE rank <= 5
    UNION ALL SELECT query_id, 'hybrid', rank, concept_id, score FROM hybrid WHERE rank <= 5) USING (query_id, strategy)""")
def _(t):
    docs = t.search_docs()
    flagged = labels.routing_flags(t.queries(), docs)
    rules = [("exact_or_quoted", F.col("is_exact") | F.col("is_quoted"), "hybrid"), ("math", F.col("is_math"), "bm25f")]
    chosen = labels.route(flagged, rules, "dense").select("query_id", "query", "chosen_strategy")
    out = fusion.routed(chosen, docs, 5)
    return out.select("query_id", "strategy", "rank", "concept_id", text.round_half_up(F.col("score"), 4).alias("score"))
