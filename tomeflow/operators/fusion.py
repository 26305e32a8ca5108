"""Fusing, routing and re-ranking of ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import top_k
from . import lexical_index, search, vectors

RRF_K = 60
CANDIDATES = 50

# A retrieval strategy: (queries, docs, k, keep) -> (query_id, rank, concept_id, score).
Strategy = Callable[[DataFrame, DataFrame, int, Column | None], DataFrame]


def lexical(queries: DataFrame, docs: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    return search.bm25f_search(docs, queries, k, keep).select("query_id", "rank", "concept_id", "score")


def dense(queries: DataFrame, docs: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    return vectors.dense_search(docs, queries, k, keep).select("query_id", "rank", "concept_id", "score")


def fuse(lists: DataFrame, weights: dict[str, float], k: int = RRF_K, group: list[str] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, list, concept_id, rank): adds score and final rank.

    A document counts once per list, at its best rank. ``group`` adds columns that separate fusions.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    keys = [*(group or []), "query_id"]
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    best = lists.groupBy(*keys, "list", "concept_id").agg(F.min("rank").alias("rank"))
    scored = best.groupBy(*keys, "concept_id").agg(F.round(F.sum(w[F.col("list")] / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("concept_id"))
    return scored.withColumn("rank", F.row_number().over(order))


def indexed(index: lexical_index.Index) -> Strategy:
    """The lexical strategy over a stored index; the documents are those indexed."""
    return lambda queries, docs, k, keep=None: lexical_index.search_index(index, queries, k, keep).select("query_id", "rank", "concept_id", "score")


def candidate_lists(queries: DataFrame, docs: DataFrame, k: int = 5, keep: Column | None = None, lexical: Strategy = lexical) -> DataFrame:
    """Lexical and dense candidates, ``max(50, k)`` deep: (query_id, list, concept_id, rank)."""
    depth = max(CANDIDATES, k)
    named = lambda df, name: df.select("query_id", F.lit(name).alias("list"), "concept_id", "rank")
    return named(lexical(queries, docs, depth, keep), "lexical").unionByName(named(dense(queries, docs, depth, keep), "dense"))


def fused_top(lists: DataFrame, k: int, weights: dict[str, float] | None = None, rrf_k: int = RRF_K) -> DataFrame:
    fused = fuse(lists, weights or {"lexical": 1.0, "dense": 1.0}, rrf_k)
    return fused.where(F.col("rank") <= k).select("query_id", "rank", "concept_id", "score")


def hybrid(queries: DataFrame, docs: DataFrame, k: int, keep: Column | None = None,
           weights: dict[str, float] | None = None, rrf_k: int = RRF_K, lexical: Strategy = lexical) -> DataFrame:
    return fused_top(candidate_lists(queries, docs, k, keep, lexical), k, weights, rrf_k)


STRATEGIES: dict[str, Strategy] = {"bm25f": lexical, "dense": dense, "hybrid": hybrid}


def routed(queries: DataFrame, docs: DataFrame, k: int, strategies: dict[str, Strategy] | None = None,
           choice: str = "chosen_strategy") -> DataFrame:
    """Answer each query by the strategy named in its ``choice`` column. One job per strategy, not per query."""
    out = None
    for name, run in (strategies or STRATEGIES).items():
        part = run(queries.where(F.col(choice) == name), docs, k, None)
        part = part.select("query_id", F.lit(name).alias("strategy"), "rank", "concept_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def weight_sweep(lists: DataFrame, grid: list[tuple[int, float, float]]) -> DataFrame:
    """Re-fuse cached candidate lists for each (k, lexical weight, dense weight) of a small fixed grid."""
    cells = F.array(*[F.struct(F.lit(k).alias("rrf_k"), F.lit(a).alias("w_lexical"), F.lit(b).alias("w_dense")) for k, a, b in grid])
    best = lists.groupBy("query_id", "list", "concept_id").agg(F.min("rank").alias("rank"))
    rows = best.select("*", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    w = F.when(F.col("list") == "lexical", F.col("w_lexical")).otherwise(F.col("w_dense"))
    keys = ["rrf_k", "w_lexical", "w_dense", "query_id"]
    scored = rows.groupBy(*keys, "concept_id").agg(F.round(F.sum(w / (F.col("rrf_k") + F.col("rank"))), 9).alias("score"))
    return top_k(scored, keys, [F.col("score").desc(), F.col("concept_id")], 5)
