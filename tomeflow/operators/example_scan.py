"""Examples for a bounded table of queries: words are looked for where the texts are read, and nothing but winners moves.

A task looks up the different pieces of some texts, adds up words a query in blocks of bounded size, and hands on ``k`` rows a
query of each block, and of later blocks only rows that can still be among its own best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .containment import NameFilter, held_names, name_filter

TEXTS_AT_ONCE = 2048
BLOCK = 256
CELLS = 1 << 20


class Asked:
    """The different words of the queries; those that ask for word ``w`` are ``queries[ends[w]:ends[w + 1]]``, by number."""

    def __init__(self, rows: list[tuple[str, int]], n_queries: int):
        rows = sorted(rows)
        words = list(dict.fromkeys(w for w, _ in rows))
        self.words = pa.array(words, pa.string())
        places = {w: i for i, w in enumerate(words)}
        at = np.array([places[w] for w, _ in rows], np.int64)
        self.queries = np.array([q for _, q in rows], np.int64)
        self.ends = np.searchsorted(at, np.arange(len(words) + 1))
        self.n_queries = n_queries

    def inside(self, names: NameFilter, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, word): the words inside piece ``p`` are ``word[ends[p]:ends[p + 1]]``."""
        at, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, _, rows, cuts in held_names(names, pieces):
            # A piece that the filter lets through by chance is no word.
            found = pc.fill_null(pc.index_in(cuts, value_set=self.words), -1).to_numpy(zero_copy_only=False)
            at.append(a + rows[found >= 0])
            word.append(found[found >= 0])
        return np.searchsorted(np.concatenate(at), np.arange(len(pieces) + 1)), np.concatenate(word)


def _spread(ends: np.ndarray, values: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of every value of the lists ``at``."""
    n = ends[at + 1] - ends[at]
    start = np.repeat(ends[at] - (np.cumsum(n) - n), n)
    return np.repeat(owner, n), values[start + np.arange(len(start))]


class _Best:
    """The ``k`` largest counts of every query so far."""

    def __init__(self, n_queries: int, k: int, least: int):
        self.top, self.least = np.zeros((n_queries, k), np.int64), least

    def take(self, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of the best of a block of rows, which ``order`` ranks where counts are equal."""
        k = self.top.shape[1]
        row, query = np.nonzero(counts >= np.maximum(self.top.min(axis=1), self.least))
        n = counts[row, query]
        by = np.lexsort((order[row], -n, query))
        row, query, n = row[by], query[by], n[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        first = place < k
        here = np.zeros_like(self.top)
        here[query[first], place[first]] = n[first]
        self.top = np.sort(np.concatenate([self.top, here], axis=1), axis=1)[:, -k:]
        return row[first], query[first]


def best_matches(examples: DataFrame, words: DataFrame, k: int, least: int) -> DataFrame:
    """(query_id, id, matches): of every query the examples that hold most of its words, ``least`` or more: the best ``k`` and
    further ones. ``examples``: (id, pieces), pieces without blanks; ``words``: (query_id, name), a word without blanks."""
    spark = examples.sparkSession
    ids = [r[0] for r in words.select("query_id").distinct().collect()]
    number = {q: i for i, q in enumerate(ids)}
    asked = spark.sparkContext.broadcast(Asked([(r["name"], number[r["query_id"]]) for r in words.collect()], len(ids)))
    names = name_filter(words.select("name").distinct())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        best, step = _Best(a.n_queries, k, least), max(1, min(BLOCK, CELLS // max(1, a.n_queries)))
        for whole in batches:
            for batch in (whole.slice(i, TEXTS_AT_ONCE) for i in range(0, whole.num_rows, TEXTS_AT_ONCE)):
                lists, n = batch.column("pieces"), batch.num_rows
                pieces = lists.flatten().dictionary_encode()
                ends, held = a.inside(names.value, pieces.dictionary)
                text = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                text, word = _spread(ends, held, pieces.indices.to_numpy(zero_copy_only=False), text)
                # A word counts once a text.
                text, word = np.divmod(np.unique(text * len(a.words) + word), max(1, len(a.words)))
                order = np.empty(n, np.int64)
                order[pc.array_sort_indices(batch.column("id"), null_placement="at_start").to_numpy()] = np.arange(n)
                for first in range(0, n, step):
                    lo, hi = np.searchsorted(text, [first, first + step])
                    row, query = _spread(a.ends, a.queries, word[lo:hi], text[lo:hi] - first)
                    counts = np.bincount(row * a.n_queries + query, minlength=step * a.n_queries).reshape(step, a.n_queries)[:n - first]
                    row, query = best.take(counts, order[first:first + step])
                    yield pa.record_batch({"q": pa.array(query, pa.int32()), "id": batch.column("id").take(pa.array(first + row)), "matches": pa.array(counts[row, query], pa.int64())})

    found = examples.select("id", "pieces").mapInArrow(scan, f"q int, id {examples.schema['id'].dataType.simpleString()}, matches long")
    asker = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("q", IntegerType()), StructField("query_id", words.schema["query_id"].dataType)]))
    return found.join(F.broadcast(asker), "q").select("query_id", "id", "matches")
