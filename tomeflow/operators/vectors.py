"""Embeddings and exact vector search."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text
from ..plans.scale import top_k

DIMENSION = 256
TOKEN = re.compile("[a-z0-9]+")
KNOWN_TOKENS = 200_000
QUERY_BYTES = 32 << 20
VECTOR_BYTES = 64 << 20
TILE_BYTES = 48 << 20


def embedding_text(docs: DataFrame) -> DataFrame:
    """(id, text): name, aliases and definitions, one line each, blanks dropped."""
    joined = lambda c: F.array_join(F.filter(F.transform(c, text.trim), lambda x: x != ""), " ")
    parts = F.array(text.trim("name"), joined(F.col("aliases")), joined(F.col("definition_texts")))
    return docs.select(F.col("concept_id").alias("id"), F.array_join(F.filter(parts, lambda x: x != ""), "\n").alias("text"))


class _Cells(dict):
    """(bucket, sign) of a token. Bounded."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, tok: str) -> tuple[int, int]:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        digest = hashlib.sha1(tok.encode()).hexdigest()
        self[tok] = cell = int(digest[:8], 16) % self.dim, 1 if int(digest[9], 16) % 2 else -1
        return cell


def _hashed(dim: int) -> Callable:
    @F.pandas_udf(ArrayType(DoubleType()))
    def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cells = _Cells(dim)
        for texts in batches:
            out = []
            for txt in texts:
                v = [0] * dim
                for tok in TOKEN.findall(txt or ""):
                    bucket, sign = cells[tok]
                    v[bucket] += sign
                norm = math.sqrt(sum(x * x for x in v))
                out.append(np.array(v) / norm if norm else np.zeros(dim))
            yield pd.Series(out)

    return fill


def hashing_vectors(texts: DataFrame, dim: int = DIMENSION) -> DataFrame:
    """(id, vector): signed token counts of each text, unit length, made where the text is read. A text without tokens gives the
    zero vector."""
    return texts.select("id", _hashed(dim)(F.lower("text")).alias("vector"))


def hashed_weights(texts: DataFrame, dim: int = DIMENSION) -> DataFrame:
    """(id, bucket, weight): the cells of :func:`hashing_vectors` that are not zero."""
    return hashing_vectors(texts, dim).select("id", F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0")


def provider_vectors(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, vector) from any model. ``load`` runs once per worker and gives texts -> matrix."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([np.asarray(v, dtype=float) for v in model(batch.tolist())])

    return texts.select("id", embed("text").alias("vector"))


def tile_shape(n_vectors: int, n_queries: int, tile_bytes: int) -> tuple[int, int]:
    """Rows of vectors and of queries per tile. A tile's scores, norms' products and ranks are three float matrices."""
    cells = max(1, tile_bytes // 24)
    q = max(1, min(n_queries, 1024, cells))
    return max(1, min(n_vectors, cells // q)), q


class _Running:
    """The best ``k`` vectors of every query over all that a task has seen, scored tile by tile. Scores are rounded
    before they are compared; ties go by id."""

    def __init__(self, qids: np.ndarray, qmatrix: np.ndarray, k: int, tile_bytes: int):
        self.qids, self.q, self.k, self.tile_bytes = qids, qmatrix, k, tile_bytes
        self.qn = np.linalg.norm(qmatrix, axis=1) if len(qids) else np.zeros(0)
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(qids)

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        rows, cols = tile_shape(len(ids), len(self.qids), self.tile_bytes)
        vn = np.linalg.norm(matrix, axis=1)
        for a in range(0, len(ids), rows):
            part, pn, pid = matrix[a:a + rows], vn[a:a + rows], ids[a:a + rows]
            for b in range(0, len(self.qids), cols):
                denominator = np.outer(pn, self.qn[b:b + cols])
                scores = part @ self.q[b:b + cols].T
                scores = np.round(np.divide(scores, denominator, out=np.zeros_like(scores), where=denominator > 0), 6) + 0.0
                for j in range(scores.shape[1]):
                    self._merge(b + j, pid, scores[:, j])

    def _merge(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        n, k = len(ids), self.k
        at = np.flatnonzero(scores >= np.partition(scores, n - k)[n - k]) if n > k else np.arange(n)
        ids, scores = ids[at], scores[at]
        if self.best[j] is not None:
            ids, scores = np.concatenate([self.best[j][0], ids]), np.concatenate([self.best[j][1], scores])
        order = np.lexsort((ids, -scores))[:k]
        self.best[j] = (ids[order], scores[order])

    def frame(self) -> Iterator[pd.DataFrame]:
        found = [(q, *b) for q, b in zip(self.qids, self.best) if b is not None]
        if found:
            yield pd.DataFrame({"query_id": np.repeat(np.array([q for q, _, _ in found]), [len(i) for _, i, _ in found]),
                                "id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, max_query_bytes: int = QUERY_BYTES,
                max_vector_bytes: int = VECTOR_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Exact cosine top ``k``: (query_id, rank, id, score). Filter ``vectors`` first for payload conditions.

    Query vectors of up to ``max_query_bytes`` ride along with every scan task. Beyond that, queries and vectors are cut
    into cells of bounded bytes by a hash of their ids, and each pair of cells meets in one task. Either way products are
    made in tiles of ``tile_bytes``, and a task hands on k rows per query for all it has seen.
    """
    id_type = dict(vectors.dtypes)["id"]
    qid_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {qid_type}, id {id_type}, score double"
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"query_id {qid_type}, rank int, id {id_type}, score double")
    asked = queries.select("query_id", "vector")
    one = asked.first()
    width = 8 * max(1, len(one["vector"])) if one is not None else 8
    most = max(1, max_query_bytes // width)
    held = asked.limit(most + 1).toPandas()  # at most max_query_bytes and one row
    if len(held) <= most:
        shared = vectors.sparkSession.sparkContext.broadcast(
            (held["query_id"].to_numpy(), np.array(held["vector"].tolist(), dtype=float)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            running = _Running(*shared.value, k, tile_bytes)
            for b in batches:
                if len(b) and len(running.qids):
                    running.add(b["id"].to_numpy(), np.array(b["vector"].tolist(), dtype=float))
            yield from running.frame()

        local = vectors.select("id", "vector").mapInPandas(scan, schema)
    else:
        nv = max(1, math.ceil(vectors.count() * width / max_vector_bytes))
        nq = max(1, math.ceil(queries.count() * width / max_query_bytes))
        cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        v = vectors.select("id", "vector", cell("id", nv).alias("vc")).withColumn("qc", all_of(nq))
        q = queries.select("query_id", "vector", cell("query_id", nq).alias("qc")).withColumn("vc", all_of(nv))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": right["query_id"][:0], "id": left["id"][:0], "score": np.zeros(0)})
            if not len(left) or not len(right):
                return none
            running = _Running(right["query_id"].to_numpy(), np.array(right["vector"].tolist(), dtype=float), k, tile_bytes)
            running.add(left["id"].to_numpy(), np.array(left["vector"].tolist(), dtype=float))
            return next(running.frame(), none)

        local = v.groupBy("vc", "qc").cogroup(q.groupBy("vc", "qc")).applyInPandas(meet, schema)
    return top_k(local, ["query_id"], [F.col("score").desc(), F.col("id")], k).select("query_id", "rank", "id", "score")


def dense_search(docs: DataFrame, queries: DataFrame, k: int = 5, keep: Column | None = None,
                 dim: int = DIMENSION) -> DataFrame:
    """Vector search of query texts over documents: (query_id, rank, concept_id, score).

    ``keep`` (over document columns) is applied before ranking. Queries without content give no rows.
    """
    if keep is not None:
        docs = docs.where(keep)
    stored = hashing_vectors(embedding_text(docs), dim)
    asked = queries.where(text.has_content(F.col("query"))).select(F.col("query_id").alias("id"), F.col("query").alias("text"))
    asked = hashing_vectors(asked, dim).withColumnRenamed("id", "query_id")
    return vector_topk(stored, asked, k).withColumnRenamed("id", "concept_id")


def split_reusable(new: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose stored vector still matches, rows to embed again) by id and checksum."""
    keys = ["id", "checksum"]
    known = stored.select(*keys)
    return new.join(known, keys, "left_semi"), new.join(known, keys, "left_anti")


def hydrate(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors with the payload columns of their documents; vectors without a document are dropped."""
    return vectors.join(docs, "id")
