"""A stored lexical index: the corpus is tokenised once, and searches read the postings of their terms, without those that cannot matter.

A posting's saturation lies between 0 and ``k1 + 1``; its level, that range cut into ``LEVELS_PER_UNIT`` steps a unit, is its block. A block's
upper score bound is the upper edge of its level times the term's inverse document frequency. Postings lie in folders by a hash of the
term, spread within a folder by document, each file sorted by term and level. Per (term, level) counts are kept beside them, so what to read
is planned before a posting is read.

A search of a table of queries:

1. of each term the highest levels are read until they hold enough postings; the k-th best of the partial sums is a threshold that no
   result can be below;
2. terms whose bounds sum to less than the threshold cannot make a result alone. Of the others, levels are read whose bound, with the bounds
   of the other terms, reaches it: their documents, and those with an exact-name boost, are the candidates;
3. only candidates are scored.

The result is that of scoring every document, whatever the threshold. Both sides of each join are equi-joined on term and level or on document.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scale import BROADCAST_ROWS, SALTS, cut_lineage, fits, hot_join, top_k
from . import search

LEVELS_PER_UNIT = 16
FOLDERS = 32
# Postings of a term read for the threshold, as a multiple of k.
FIRST_READ = 8
# Scores are rounded to six places before they are ranked.
SLACK = 2e-6


class Index(NamedTuple):
    """``postings``: (folder, term, level, concept_id, sat, in_name); ``levels``: (term, level, n); ``names``: the fields that rank and filter;
    ``statistics``: one row, n_docs and average field lengths."""

    postings: DataFrame
    levels: DataFrame
    names: DataFrame
    statistics: DataFrame


def _folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def build(docs: DataFrame, folder: str) -> Index:
    """Write the index of ``docs`` into a new folder and read it back."""
    spark = docs.sparkSession
    search.term_counts(docs).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    search.length_stats(docs.select("concept_id"), counts).write.parquet(f"{folder}/statistics")
    statistics = spark.read.parquet(f"{folder}/statistics")
    postings = search.saturations(counts, statistics)
    level = F.floor(F.col("sat") * LEVELS_PER_UNIT).cast("int")
    postings = postings.select(_folder_of(F.col("term")).alias("folder"), "term", level.alias("level"), "concept_id", "sat", "in_name")
    spread = F.pmod(F.xxhash64("concept_id"), F.lit(SALTS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = postings.repartition(tasks, "folder", spread).sortWithinPartitions("folder", "term", "level")
    postings.write.partitionBy("folder").parquet(f"{folder}/postings")
    stored = spark.read.schema(postings.schema).parquet(f"{folder}/postings")
    stored.groupBy("term", "level").agg(F.count("*").alias("n")).sortWithinPartitions("term").write.parquet(f"{folder}/levels")
    docs.select("concept_id", "name", "aliases", "subject", "chapter").write.parquet(f"{folder}/names")
    return read(spark, folder)


def fresh_folder(shared: str) -> str:
    return f"{shared}/lexical-index-{uuid.uuid4().hex}"


def read(spark: SparkSession, folder: str) -> Index:
    """The index of a folder. Postings of no documents have no file, so their columns are stated."""
    levels, names, statistics = (spark.read.parquet(f"{folder}/{name}") for name in ("levels", "names", "statistics"))
    id_type = names.schema["concept_id"].dataType.simpleString()
    postings = spark.read.schema(f"term string, level int, concept_id {id_type}, sat double, in_name int, folder int").parquet(f"{folder}/postings")
    return Index(postings, levels, names, statistics)


def _asked_levels(index: Index, terms: DataFrame, max_rows: int) -> DataFrame:
    """(query_id, term, level, n, idf): the blocks of every query's terms."""
    mine = hot_join(index.levels, terms.select("query_id", "term"), ["term"], F.col("level"), max_rows=max_rows)
    df = F.sum("n").over(Window.partitionBy("query_id", "term"))
    rows = mine.withColumn("df", df).join(F.broadcast(index.statistics.select("n_docs")))
    return rows.select("query_id", "term", "level", "n", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _read(index: Index, asked: DataFrame, on: list[str], max_rows: int) -> DataFrame:
    """The postings that ``asked`` wants: by few queries only the folders of their terms are opened."""
    if fits(asked, max_rows):
        wanted = asked.withColumn("folder", _folder_of(F.col("term")))
        return index.postings.join(F.broadcast(wanted), ["folder", *on])
    return hot_join(index.postings, asked, on, F.col("concept_id"), max_rows=0)


def _thresholds(index: Index, blocks: DataFrame, k: int, keep: Column | None, max_rows: int) -> DataFrame:
    """(query_id, threshold): the k-th best partial score of the highest blocks, if there are k."""
    down = Window.partitionBy("query_id", "term").orderBy(F.col("level").desc())
    first = blocks.withColumn("_before", F.sum("n").over(down) - F.col("n")).where(F.col("_before") < FIRST_READ * k)
    hits = _read(index, first.select("query_id", "term", "level", "idf"), ["term", "level"], max_rows)
    if keep is not None:
        hits = hits.join(index.names.select("concept_id", "subject", "chapter"), "concept_id").where(keep)
    partial = hits.groupBy("query_id", "concept_id").agg(F.sum(F.col("idf") * F.col("sat")).alias("part"))
    best = top_k(partial, ["query_id"], [F.col("part").desc()], k)
    return best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("part")).otherwise(0.0).alias("threshold"))


def _needed_blocks(blocks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(query_id, term, level): the blocks that can hold a result, of terms that can make one."""
    bounds = blocks.groupBy("query_id", "term").agg(F.max((F.col("level") + 1) / LEVELS_PER_UNIT * F.col("idf")).alias("bound"))
    whole = Window.partitionBy("query_id")
    up = whole.orderBy("bound", "term")
    bounds = bounds.select("query_id", "term", "bound", F.sum("bound").over(whole).alias("_all"), F.sum("bound").over(up).alias("_up_to"))
    bounds = bounds.join(thresholds, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)) - SLACK)
    essential = bounds.where(F.col("_up_to") >= F.col("threshold"))
    reach = (F.col("level") + 1) / LEVELS_PER_UNIT * F.col("idf") + F.col("_all") - F.col("bound")
    return blocks.join(essential, ["query_id", "term"]).where(reach >= F.col("threshold")).select("query_id", "term", "level")


def candidates(index: Index, queries: DataFrame, blocks: DataFrame, k: int = 5, keep: Column | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, concept_id): every document that can be among a query's first ``k``."""
    needed = _needed_blocks(blocks, _thresholds(index, blocks, k, keep, max_rows))
    found = _read(index, needed, ["term", "level"], max_rows).select("query_id", "concept_id")
    boosted = search.exact_hits(index.names, queries).select("query_id", "concept_id")
    return found.unionByName(boosted).distinct()


def search_index(index: Index, queries: DataFrame, k: int = 5, keep: Column | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Top ``k`` documents per query, the same as :func:`search.bm25f_search` over the indexed documents."""
    terms = search.query_terms(queries)
    blocks = cut_lineage(_asked_levels(index, terms, max_rows))
    idf = blocks.select("query_id", "term", "idf").distinct().join(terms, ["query_id", "term"])
    hits = _read(index, idf, ["term"], max_rows)
    found = cut_lineage(candidates(index, queries, blocks, k, keep, max_rows))
    hits = hot_join(hits, found, ["query_id", "concept_id"], F.col("term"), max_rows=max_rows)
    scored = hits.groupBy("concept_id", "query_id", "query_key", "n_terms").agg(F.sum(F.col("idf") * F.col("sat")).alias("bm25"), F.sum("in_name").alias("in_name"))
    scored = search.boosted(scored, index.names).where("score > 0")
    if keep is not None:
        scored = scored.join(index.names.select("concept_id", "subject", "chapter"), "concept_id").where(keep)
    order = [F.col("score").desc(), F.col("sort_name"), F.col("concept_id")]
    return top_k(scored, ["query_id"], order, k).select("query_id", "rank", "concept_id", "score", F.round("bm25", 9).alias("bm25"), "boost")
