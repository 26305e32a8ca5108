"""Benchmark decontamination with suffix arrays over the training documents.

Training documents are read as words. Each task packs whole documents into shards of about ``SHARD_WORDS`` words and
sorts all word positions of a shard into a suffix array. Every suffix of every test item is then searched by bisection
in every shard, which gives its longest verbatim match and all places of it. Documents stay whole inside a shard, so
their verdicts need no shuffle, and a passage shared by many documents costs each task only its own documents.

Test items are a query set: they are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents per block, so that nothing unbounded is broadcast.

Defined cases: null or wordless documents have no words and no hits; null or wordless items have no windows; a document
longer than a shard is a shard of its own; equal items each count; rows with equal or null ``doc_id`` stay rows of their
own; further columns of the input are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SHARD_WORDS = 1 << 17
BLOCK_BYTES = 8 << 20
WINDOW = 10


class SuffixArray:
    """Word positions of a run of documents, sorted by the words that follow, up to ``depth`` words."""

    def __init__(self, tokens: np.ndarray, depth: int):
        """``tokens``: positive word codes with a 0 after each document."""
        self.tokens = tokens
        self.bits = max(1, int(tokens.max(initial=0)).bit_length())
        self.pack = max(1, 62 // self.bits)
        key = self._packed(tokens)
        order = np.argsort(key)
        self.keys = key[order]
        self.order = self._refine(order, depth)

    def _packed(self, tokens: np.ndarray) -> np.ndarray:
        """The first ``pack`` words of each position in one integer; after a document's end only zeros."""
        key = np.zeros(len(tokens), np.int64)
        alive = np.ones(len(tokens), bool)
        for j in range(self.pack):
            t = np.zeros(len(tokens), np.int64)
            t[:max(0, len(tokens) - j)] = tokens[j:]
            alive &= t > 0
            key = (key << self.bits) | np.where(alive, t, 0)
        return key

    def _refine(self, order: np.ndarray, depth: int) -> np.ndarray:
        """Sort ties by the order of the rest, doubling the compared length; only tied positions are touched."""
        n = len(order)
        full = (self.keys & ((1 << self.bits) - 1)) > 0  # positions whose document has not ended yet
        fresh = np.ones(n, bool)
        fresh[1:] = self.keys[1:] != self.keys[:-1]
        group = np.cumsum(fresh) - 1
        rank = np.empty(n + 1, np.int64)
        rank[order] = group
        rank[n] = -1
        reach = self.pack
        while reach < depth:
            size = np.bincount(group, minlength=n)
            tied = np.flatnonzero((size[group] > 1) & full)
            if len(tied) == 0:
                break
            at = order[tied]
            rest = rank[np.minimum(at + reach, n)]
            sort = np.lexsort((rest, group[tied]))
            at, rest, g = at[sort], rest[sort], group[tied][sort]
            order[tied] = at
            step = np.zeros(len(tied), bool)
            step[1:] = (g[1:] == g[:-1]) & (rest[1:] != rest[:-1])
            fresh[tied[step]] = True
            group = np.cumsum(fresh) - 1
            rank[order] = group
            reach *= 2
        return order

    def _bound(self, lo: np.ndarray, hi: np.ndarray, at: int, word: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if len(live) == 0:
                return lo
            mid = (lo[live] + hi[live]) >> 1
            got = self.tokens[self.order[mid] + at]
            below = got <= word[live] if right else got < word[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]

    def search(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, stop: np.ndarray | None = None):
        """Longest match of each test suffix ``words[start:end]``; -1 is a word the shard does not hold.

        Returns (length, first, last) as an interval of the suffix array, and the interval after ``stop`` words.
        """
        m = len(start)
        length, first, last = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, len(self.order))
        at_first, at_last = np.zeros(m, np.int64), np.zeros(m, np.int64)
        live, d, prefix = np.arange(m), 0, np.zeros(m, np.int64)
        while len(live):
            live = live[start[live] + d < end[live]]
            word = words[start[live] + d]
            live, word = live[word > 0], word[word > 0]
            if len(live) == 0:
                break
            if d < self.pack:
                prefix[live] = (prefix[live] << self.bits) | word
                shift = self.bits * (self.pack - 1 - d)
                lo = np.searchsorted(self.keys, prefix[live] << shift, "left")
                hi = np.searchsorted(self.keys, (prefix[live] + 1) << shift, "left")
            else:
                lo = self._bound(first[live], last[live], d, word, False)
                hi = self._bound(lo, last[live], d, word, True)
            found = lo < hi
            live, lo, hi = live[found], lo[found], hi[found]
            d += 1
            length[live], first[live], last[live] = d, lo, hi
            if stop is not None:
                here = stop[live] == d
                at_first[live[here]], at_last[live[here]] = lo[here], hi[here]
        return length, first, last, at_first, at_last


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the interval, place in the suffix array) for every place of every interval."""
    counts = last - first
    owner = np.repeat(np.arange(len(first)), counts)
    skipped = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return owner, np.arange(int(counts.sum())) - np.repeat(skipped - first, counts)


class TestSet:
    """Words and suffixes of a block of test items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        off = np.zeros(len(items) + 1, np.int64)
        raw = [t.encode() for _, t in items]
        off[1:] = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, woff = K.word_spans(data, off, K.ALNUM)
        self.ids = [i for i, _ in items]
        self.hashes = K.word_hashes(data, starts, ends)
        sizes = np.diff(woff)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.start = np.arange(len(self.hashes))
        self.end = woff[1:][self.item]
        self.pos = self.start - woff[:-1][self.item]
        width = np.minimum(sizes, window)
        self.width = width[self.item]
        # A suffix that is long enough starts a window.
        self.stop = np.where(self.end - self.start >= self.width, self.width, -1)
        self.depth = int(sizes.max(initial=0))


def _shards(batches: Iterator[pa.RecordBatch], limit: int):
    """(rows, words per row, word hashes) of shards of whole documents."""
    rows, sizes, parts, held = [], [], [], 0
    for batch in batches:
        for a, b, data, off in K.chunks(batch.column("text")):
            starts, ends, woff = K.word_spans(data, off, K.ALNUM)
            rows.append(batch.slice(a, b - a))
            sizes.append(np.diff(woff))
            parts.append(K.word_hashes(data, starts, ends))
            held += len(starts)
            if held >= limit:
                yield pa.Table.from_batches(rows), np.concatenate(sizes), np.concatenate(parts)
                rows, sizes, parts, held = [], [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), np.concatenate(sizes), np.concatenate(parts)


def _index(tests: TestSet, sizes: np.ndarray, hashes: np.ndarray) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
    """(suffix array, codes of the test words, first position of each document) of one shard."""
    import pandas as pd

    codes, _ = pd.factorize(np.concatenate([tests.hashes, hashes]))
    mine, theirs = codes[:len(tests.hashes)] + 1, codes[len(tests.hashes):] + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.zeros(int(begin[-1]), np.int64)
    tokens[np.arange(len(theirs)) + np.repeat(np.arange(len(sizes)), sizes)] = theirs
    return SuffixArray(tokens, tests.depth), mine, begin


def _hits(tests: TestSet, sizes: np.ndarray, hashes: np.ndarray):
    """(hit flag per position, first position per document, document and item of each occurrence) of one shard."""
    sa, words, begin = _index(tests, sizes, hashes)
    _, _, _, lo, hi = sa.search(words, tests.start, tests.end, tests.stop)
    suffix, place = _expand(lo, hi)
    pos = sa.order[place]
    edge = np.zeros(len(sa.tokens) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + tests.width[suffix], -1)
    return np.cumsum(edge[:-1]) > 0, begin, np.searchsorted(begin, pos, "right") - 1, tests.item[suffix]


def _verdicts(tests: TestSet, limit: int, last: bool):
    """Adds one block's items and hit runs to the rows; all but the last block pass the text on."""
    lists = [("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32())))]
    schema = pa.schema([("doc_id", pa.int64()), *([] if last else [("text", pa.string())]), *([("n_words", pa.int64()), ("n_hit", pa.int64())] if last else []), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes, hashes in _shards(batches, limit):
            hit, begin, doc, item = _hits(tests, sizes, hashes)
            items, spans = rows.column("items").to_pylist(), rows.column("spans").to_pylist()
            met = np.unique(doc * max(1, len(tests.ids)) + item)
            for d, i in zip(met // max(1, len(tests.ids)), met % max(1, len(tests.ids))):
                items[d].append(tests.ids[i])
            for d, s in enumerate(spans):
                for a, b in s:
                    hit[begin[d] + a:begin[d] + b] = True
                spans[d] = []
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            owner = np.searchsorted(begin, change[::2], "right") - 1
            for d, a, b in zip(owner, change[::2], change[1::2]):
                spans[d].append([int(a - begin[d]), int(b - begin[d])])
            n_hit = np.add.reduceat(hit, begin[:-1], dtype=np.int64) if len(sizes) else np.zeros(0, np.int64)
            columns = {"doc_id": rows.column("doc_id").combine_chunks(), "items": pa.array(items, lists[0][1]), "spans": pa.array(spans, lists[1][1]),
                       "n_words": pa.array(sizes), "n_hit": pa.array(n_hit)}
            if not last:
                columns["text"] = rows.column("text").combine_chunks()
            yield pa.record_batch([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _cleaned(tests: TestSet, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes, hashes in _shards(batches, limit):
            _, _, doc, _ = _hits(tests, sizes, hashes)
            clean = np.ones(len(sizes), bool)
            clean[doc] = False
            yield from rows.filter(pa.array(clean)).to_batches()

    return run


def _matches(tests: TestSet, least: int, limit: int):
    schema = pa.schema([("item_id", pa.string()), ("item_pos", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("doc_pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes, hashes in _shards(batches, limit):
            ids = rows.column("doc_id").combine_chunks()
            sa, words, begin = _index(tests, sizes, hashes)
            length, lo, hi, _, _ = sa.search(words, tests.start, tests.end)
            long = np.flatnonzero(length >= np.minimum(least, np.maximum(tests.width, 1)))
            owner, place = _expand(lo[long], hi[long])
            suffix, pos = long[owner], sa.order[place]
            doc = np.searchsorted(begin, pos, "right") - 1
            names = pa.array(tests.ids, pa.string())
            yield pa.record_batch([names.take(pa.array(tests.item[suffix])), pa.array(tests.pos[suffix]), pa.array(length[suffix]),
                                   ids.cast(pa.int64()).take(pa.array(doc)), pa.array(pos - begin[doc])], schema=schema)

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The query set in blocks of at most ``limit`` bytes (or one longer item), streamed partition by partition."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        size = len(r["t"].encode())
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += size
    yield block


def longest_matches(documents: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_pos, length, doc_id, doc_pos): for each suffix of each item, the places of its longest match in each
    shard that has ``least`` words or more (or the whole of a shorter item). Positions count words from 0."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, block_bytes):
        found = docs.mapInArrow(_matches(TestSet(block, WINDOW), least, shard_words), "item_id string, item_pos long, length long, doc_id long, doc_pos long")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) per document: words inside occurrences of a window of an item, the items
    with such windows as sorted strings, and the hit runs as [first word, end word)."""
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.array().cast("array<string>").alias("items"), F.array().cast("array<array<int>>").alias("spans"))
    lists = "items array<string>, spans array<array<int>>"
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        schema = f"doc_id long, n_words long, n_hit long, {lists}" if following is None else f"doc_id long, text string, {lists}"
        out = out.mapInArrow(_verdicts(TestSet(block, window), shard_words, following is None), schema)
        block = following
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` without a hit, with all their columns. Nothing is shuffled."""
    out = documents
    for block in _blocks(benchmark, block_bytes):
        out = out.mapInArrow(_cleaned(TestSet(block, window), shard_words), documents.schema)
    return out
