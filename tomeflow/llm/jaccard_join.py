"""N-gram Jaccard join by partitioning the universe of shingles (pigeonhole), exact.

A text is its set of distinct five-word shingles. Sets with a Jaccard index of 4/5 or more differ in at most
(r + s) / 9 elements, r and s being their sizes. Sizes fall into bands [2^k, 2^(k+1)); a band cuts the hash universe into
segments, in order. A pair is compared under the band of its smaller set, so a set is indexed under its own band, and under
the band below if a partner can be there.

Round 1, segment subsets: with at most H differences, one of any H + 1 segments has none, so a set indexes its first H + 1
non-empty segments by a hash of the subset, and linked sets share one of them. A segment subset that more than
``COLD`` sets share is costly: no pairs are made from it, its sets are only compared with two centres. That joins
large groups of near copies, and a costly subset whose sets are then one component is settled. Two linked sets that are not
joined yet both hold a costly subset of several components.

Allocation by cost: such sets are indexed again by their first H + 1 segments that are not costly. The argument holds for any
order of the subsets that is the same for all sets, so this settles all but sets with too few cheap segments, and those that
meet a subset which only now shows itself as costly.

Round 2, one-deletion neighbourhoods: the sets left are few. They index all segments, and each segment's one-deletions, which stand one difference each: a segment of two or more
elements then pays for two differences, one whose subset is costly pays for none, one with a costly deletion pays for one.
A set is settled when its cheap segments pay for more than H.

Round 3, blocks: what is left is mostly made of widely shared shingles: stragglers of large groups of near copies, mainly.
Only blocks of sets of different components that share a costly subset are compared, by counting through an inverted list
of the block's shingles.

Every candidate is verified exactly on the whole sets of 64-bit shingle hashes. Equal sets are one node from the start, so
copies cost nothing. Nothing is capped: each round hands what it cannot settle to the next, and the last one settles all.

Defined cases: a null text, or one without words, has no shingles and is linked with nothing; a text of fewer than five
words is one shingle; rows with equal or null ids are rows of their own; a component without ids has a null one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .components import components
from .storage import free_name, written

COLD = 8
BUCKET_BYTES = 8 << 20
BLOCK = 1000
BROADCAST_SETS = 2_000_000
SHINGLES_PER_TASK = 2_000_000
LEAST_TASKS = 8
FLUSH_SIGNATURES = 1 << 19
_SHORT = 1 << 62
_SALT = np.uint64(0x9FB21C651E98DF25)


# --- sets ------------------------------------------------------------------------------------------------------------
def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets, set id per row) of a batch's shingle sets."""
    for a, b, data, off in K.chunks(batch.column("text")):
        starts, ends, woff = K.word_spans(data, off, K.NOT_SPACE)
        hashes, soff = K.shingle_hashes(K.word_hashes(data, starts, ends), woff)
        sets, off = K.sorted_sets(hashes, soff)
        sums = K.run_sums(K.mix(sets ^ _SALT), off)
        yield a, b, sets, off, K.mix(sums + np.diff(off).astype(np.uint64) * _SALT).view(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, sets, off, sid in _sets(batch):
            n, short = np.diff(off), np.zeros(b - a, bool)
            short[_first_round(sets, off)[2]] = True
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(sid, mask=n == 0), pa.array(short)], names=["doc_id", "n_shingles", "sid", "short"])


def _sketch(x: np.ndarray) -> bytes:
    """Distinct low 16 bits of the half of a set with lower hashes. Two sketches differ no more than their sets do."""
    return np.unique((x[:np.searchsorted(x, np.uint64(1 << 63))] & np.uint64(0xFFFF)).astype(np.uint16)).tobytes()


def _packed(with_set: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, off, sid in _sets(batch):
                full = np.flatnonzero(np.diff(off) > 0)
                each = [sets[off[d]:off[d + 1]] for d in full]
                held = pa.array([x.tobytes() if with_set else _sketch(x) for x in each], pa.binary())
                yield pa.record_batch([pa.array(sid[full]), pa.array(np.diff(off)[full]), held], names=["sid", "n", "set" if with_set else "sketch"])

    return run


# --- signatures ------------------------------------------------------------------------------------------------------
def _options(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, band, most differences) for each band a set is indexed under: its own, and the one below."""
    band = np.where(n > 0, np.frexp(np.maximum(n, 1).astype(float))[1] - 1, 0).astype(np.int64)
    own = np.flatnonzero(n > 0)
    upper = n[own] * 5 // 4
    top = (1 << band) - 1  # the largest size of the band below
    below = np.flatnonzero((n > 0) & (band > 0) & (-(-4 * n // 5) <= top))
    return [(own, band[own], (n[own] + upper) // 9), (below, band[below] - 1, (n[below] + top[below]) // 9)]


def _segments(sets: np.ndarray, off: np.ndarray, rows: np.ndarray, band: np.ndarray):
    """(element index, owner in ``rows``, start of each run of one segment, run's segment number)."""
    n = np.diff(off)[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(int(begin[-1])) - np.repeat(begin[:-1] - off[:-1][rows], n)
    many = np.maximum(1, 3 * (1 << band) // 4).astype(np.uint64)
    segment = ((sets[at] >> np.uint64(32)) * many[owner]) >> np.uint64(32)
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    start = np.flatnonzero(new)
    return at, owner, start, segment[start]


def _signature(sums: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return K.mix(sums + K.mix((band.astype(np.uint64) << np.uint64(40)) + segment + np.uint64(1)))


def _first_round(sets: np.ndarray, off: np.ndarray, costly: np.ndarray | None = None, buckets: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, row of each, rows with too few segments) of the first H + 1 non-empty segments.

    With the sorted names of ``costly`` subsets, only of sets that hold one of them there or are short of segments, and of
    their first H + 1 segments that are not costly."""
    sigs, rows_out, short = [], [], []
    for rows, band, most in _options(np.diff(off)):
        if len(rows) == 0:
            continue
        at, owner, start, segment = _segments(sets, off, rows, band)
        who = owner[start]
        found = _signature(np.add.reduceat(K.mix(sets[at]), start), band[who], segment)
        first = np.searchsorted(who, np.arange(len(rows)))
        keep = np.arange(len(start)) - first[who] <= most[who]
        few = np.bincount(who, minlength=len(rows)) <= most
        if costly is not None:
            name = _name(found, buckets)
            hot = costly[np.minimum(np.searchsorted(costly, name), len(costly) - 1)] == name if len(costly) else np.zeros(len(name), bool)
            again = few | (np.bincount(who, keep & hot, minlength=len(rows)) > 0)
            cheap = np.cumsum(~hot)
            rank = cheap - (cheap - ~hot)[first][who]
            keep = ~hot & (rank <= most[who] + 1) & again[who]
            few = again & (np.bincount(who, ~hot, minlength=len(rows)) <= most)
        sigs.append(found[keep])
        rows_out.append(rows[who[keep]])
        short.append(rows[few])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows_out), np.concatenate(short)


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)


def _name(sig: np.ndarray, buckets: int) -> np.ndarray:
    """What a signature is called once its bucket and its low 48 bits are all that is left of it."""
    return K.mix((sig & np.uint64(0xFFFFFFFFFFFF)) + (_bucket(sig, buckets).astype(np.uint64) << np.uint64(48))).view(np.int64)


def _second_round(sets: np.ndarray, off: np.ndarray):
    """(signatures, row, tag) of all segments and their one-deletions, and (row, option, slack) per set.

    A tag names the option, the segment, whether the subset is whole, and the differences that the segment pays for.
    """
    sigs, rows_out, tags, slacks = [], [], [], []
    for option, (rows, band, most) in enumerate(_options(np.diff(off))):
        if len(rows) == 0:
            continue
        at, owner, start, segment = _segments(sets, off, rows, band)
        who = owner[start]
        mixed = K.mix(sets[at])
        sums = np.add.reduceat(mixed, start)
        size = np.diff(np.concatenate([start, [len(at)]]))
        pays = np.minimum(size, 2)
        tag = (segment.astype(np.int64) << 8) | (option << 4) | (pays << 1)
        run = np.repeat(np.arange(len(start)), size)
        dropped = np.flatnonzero(size[run] >= 2)
        sigs += [_signature(sums, band[who], segment), _signature(sums[run[dropped]] - mixed[dropped], band[who[run[dropped]]], segment[run[dropped]])]
        rows_out += [rows[who], rows[who[run[dropped]]]]
        tags += [tag | 1, tag[run[dropped]]]
        slacks.append((rows, np.full(len(rows), option), np.bincount(who, pays, minlength=len(rows)).astype(np.int64) - most - 1))
    if not sigs:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, (none, none, none)
    return np.concatenate(sigs), np.concatenate(rows_out), np.concatenate(tags), tuple(np.concatenate(x) for x in zip(*slacks))


class _Packer:
    """Gathers signatures and hands them out as one packed row per bucket: 6 bytes of signature, the set id, the tag."""

    schema = pa.schema([("bucket", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("sid", pa.binary()), ("tag", pa.binary())])

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, sigs: np.ndarray, sid: np.ndarray, tag: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        self.held.append((sigs, sid, tag if tag is not None else np.zeros(0, np.int64)))
        self.size += len(sigs)
        if self.size >= FLUSH_SIGNATURES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size == 0:
            self.held = []
            return
        sigs, sid, tag = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        bucket = _bucket(sigs, self.buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sigs, sid, tag = sigs[order], sid[order], tag[order] if len(tag) else tag
        high, low = ((sigs >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sigs & np.uint64(0xFFFF)).astype(np.uint16)
        full = np.flatnonzero(np.diff(edges) > 0)
        cut = lambda x: pa.array([x[edges[b]:edges[b + 1]].tobytes() for b in full], pa.binary())
        yield pa.record_batch([pa.array(full.astype(np.int32)), cut(high), cut(low), cut(sid), cut(tag)], schema=self.schema)


_PACKED = "bucket int, high binary, low binary, sid binary, tag binary"


def _index_texts(buckets: int, costly=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            for _, _, sets, off, sid in _sets(batch):
                sigs, rows, short = _first_round(sets, off, None if costly is None else costly.value, buckets)
                if costly is None:
                    yield from packer.add(sigs, sid[rows], None)
                else:
                    # A set short of cheap segments says so under a signature of its own, which _meet hands on.
                    short = np.unique(short)
                    yield from packer.add(np.concatenate([sigs, K.mix(sid[short].view(np.uint64))]), np.concatenate([sid[rows], sid[short]]),
                                          np.concatenate([np.zeros(len(rows), np.int64), np.full(len(short), _SHORT)]))
        yield from packer.flush()

    return run


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [x.as_py() for x in batch.column("set")]
    off = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
    return batch.column("sid").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(raw), np.uint64), off


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _index_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            for part in _parts(batch):
                sid, sets, off = _unpack(part)
                sigs, rows, tags, _ = _second_round(sets, off)
                yield from packer.add(sigs, sid[rows], tags)
        yield from packer.flush()

    return run


def _slacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            sid, sets, off = _unpack(part)
            rows, option, slack = _second_round(sets, off)[3]
            yield pa.record_batch([pa.array(sid[rows]), pa.array(option.astype(np.int32)), pa.array(slack)], names=["sid", "option", "slack"])


_FOUND = "hot boolean, a long, b long, tag long"
_FOUND_ARROW = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("tag", pa.int64())])


def _meet(cold: int):
    """Sets of one bucket that share a signature: pairs of cheap ones with the number of those, members of costly ones."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        sig = (read("high", np.uint32).astype(np.uint64) << np.uint64(16)) | read("low", np.uint16)
        sid, tag = read("sid", np.int64), read("tag", np.int64)
        short = np.zeros(0, np.int64)
        if len(tag):
            told = tag == _SHORT
            short, sig, sid, tag = np.unique(sid[told]), sig[~told], sid[~told], tag[~told]
        order = np.argsort(sig)
        sig = sig[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([start, [len(sig)]]))
        shared = np.repeat(size > 1, size)
        sig, at = sig[shared], order[shared]
        s, t = sid[at], (tag[at] if len(tag) else np.zeros(len(at), np.int64))
        # A set counts once per signature; its whole subset stands before its deletions.
        order = np.lexsort((-(t & 1), s, sig))
        sig, s, t = sig[order], s[order], t[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (s[1:] != s[:-1])
        sig, s, t = sig[new], s[new], t[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([start, [len(sig)]]))
        pairs = [np.zeros((0, 2), np.int64)]
        for f in np.unique(size[(size > 1) & (size <= cold)]):
            members = s[start[size == f][:, None] + np.arange(f)]
            i, j = np.triu_indices(f, 1)
            pairs.append(np.stack([members[:, i].ravel(), members[:, j].ravel()], axis=1))
        found = np.concatenate(pairs)
        if len(found):
            order = np.lexsort((found[:, 1], found[:, 0]))
            found = found[order]
            new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)]))
            shares, found = np.diff(np.concatenate([new, [len(found)]])), found[new]
        else:
            shares = np.zeros(0, np.int64)
        hot = np.repeat(size > cold, size)
        bucket = int(table.column("bucket")[0].as_py())
        name = K.mix(sig[hot] + (np.uint64(bucket) << np.uint64(48))).view(np.int64)
        n, m = len(found), int(hot.sum()) + len(short)
        return pa.table([pa.array(np.arange(n + m) >= n), pa.array(np.concatenate([found[:, 0], name, short])), pa.array(np.concatenate([found[:, 1], s[hot], short])),
                         pa.array(np.concatenate([shares, t[hot], np.full(len(short), _SHORT)]))], schema=_FOUND_ARROW)

    return run


# --- verification ----------------------------------------------------------------------------------------------------
def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = ([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(c)] for c in ("left", "right"))
        most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) // 9
        apart = np.array([len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
        yield batch.select(["a", "b", "shares"]).filter(pa.array(apart <= most))


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b, shares) whose sizes and sketches do not rule out a link, at an eighth of the bytes of the sets."""
    sizes = lambda c: sketches.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"))
    held = lambda c, name: sketches.select(F.col("sid").alias(c), F.col("sketch").alias(name))
    sized = pairs.join(sizes("a"), "a").join(sizes("b"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    both = sized.join(held("a", "left"), "a").join(held("b", "right"), "b")
    return both.select("a", "b", "shares", "na", "nb", "left", "right").mapInArrow(_may_link, "a long, b long, shares long").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("left", "right"))
        ok = pa.array([_linked(x, y) for x, y in zip(left, right)], pa.bool_())
        yield batch.select(["a", "b"]).filter(ok)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard index of 4/5 or more."""
    left = sets.select(F.col("sid").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("sid").alias("b"), F.col("set").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify, "a long, b long")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs (a, b, shares) with smaller sets a, the one with the most shared signatures."""
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("shares", "a")).alias("a")).select("a", "b")


class _Classes:
    """What is joined so far: (node, component), and what a round of candidates adds to it. Its tables are written by
    ``tasks`` tasks at most."""

    def __init__(self, spark, tasks: int):
        self.named: DataFrame = spark.createDataFrame([], "node long, component long")
        self.tasks = tasks

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.tasks)

    def of(self, column: str, name: str) -> DataFrame:
        return self.named.select(F.col("node").alias(column), F.col("component").alias(name))

    def add(self, links: DataFrame) -> None:
        """Join the ends of new links (a, b)."""
        links = self.written(links, "links")
        if not links.isEmpty():
            known = self.named.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            self.named = components(links.select("a", "b").unionByName(known))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are not joined."""
        return pairs.join(self.of("a", "of_a"), "a", "left").join(self.of("b", "of_b"), "b", "left").where("coalesce(of_a, a) != coalesce(of_b, b)").drop("of_a", "of_b")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Verify candidate pairs (a, b, shares): each set's most promising one first, which joins most classes; of the
        rest, all that are not joined by then."""
        best = self.written(_best(pairs), "best")
        self.add(verified(best, sets))
        self.add(verified(self.apart(pairs).join(best, ["a", "b"], "left_anti"), sets))

    def several(self, hot: DataFrame) -> DataFrame:
        """Names (a) of the costly subsets that hold sets of several components."""
        of = hot.join(self.of("b", "component"), "b", "left").select("a", F.coalesce("component", "b").alias("component"))
        return self.written(of.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("a"), "several")

    def mixed(self, hot: DataFrame, several: DataFrame | None = None) -> DataFrame:
        """Members (a, b, tag) of those subsets."""
        return self.written(hot.join(self.several(hot) if several is None else several, "a", "left_semi").select("a", "b", "tag"), "mixed")


def _cheap(found: DataFrame) -> DataFrame:
    """(a, b, shares): pairs of sets that share cheap subsets."""
    return found.where("not hot").groupBy("a", "b").agg(F.sum("tag").alias("shares"))


def _stars(hot: DataFrame, classes: _Classes) -> DataFrame:
    """(a, b, shares): each member b of costly subsets with the two centres a that it shares most of them with.

    The centre of a subset is its member that holds most costly subsets: among near copies, the one with the fewest edits.
    """
    degree = hot.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    held = classes.written(hot.join(degree, "b").select("a", "b", "degree"), "held")
    top = lambda df: df.groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("centre"))
    first = held.join(top(held), "a").where("b != centre")
    second = first.join(top(first).withColumnRenamed("centre", "next"), "a").where("b != next").select(F.col("next").alias("centre"), "b")
    star = lambda df, n: _best(df.groupBy(F.col("centre").alias("a"), "b").agg(F.count(F.lit(1)).alias("shares"))).withColumn("shares", F.lit(n).cast("long"))
    return star(first, 2).unionByName(star(second, 1))


def _blocks_meet(table: pa.Table) -> pa.Table:
    """Links between the two blocks of one task, at most one for each set and component of the other side.

    ``side`` is 0 for the first block and 1 for the second; a block meets itself when only one side is there.
    """
    sides = np.array(table.column("side").to_pylist())
    sid, comp = (table.column(c).to_numpy() for c in ("sid", "component"))
    raw = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
    first = np.flatnonzero(sides == 0)
    second = np.flatnonzero(sides == 1)
    second = second if len(second) else first
    n = np.array([len(x) for x in raw])
    hashes = np.concatenate([raw[i] for i in first])
    owner = np.repeat(np.arange(len(first)), n[first])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    out: list[tuple[int, int]] = []
    for j in second:
        lo, hi = np.searchsorted(hashes, raw[j], "left"), np.searchsorted(hashes, raw[j], "right")
        met = lo < hi
        if not met.any():
            continue
        count = hi[met] - lo[met]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo[met], count)
        both = np.bincount(owner[place], minlength=len(first))
        ok = np.flatnonzero((100 * both >= 80 * (n[first] + n[j] - both)) & (comp[first] != comp[j]))
        _, one = np.unique(comp[first][ok], return_index=True)
        out += [(int(sid[first[i]]), int(sid[j])) for i in ok[one]]
    a = pa.array([x for x, _ in out], pa.int64())
    return pa.table([a, pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _settle(left: DataFrame, hot: DataFrame, sets: DataFrame, classes: _Classes, block: int) -> None:
    """All links that the sets of ``left`` need among themselves, from blocks of different components."""
    members = hot.join(left, hot["b"] == left["sid"], "left_semi")
    # A set whose shingles crowd into too few segments (odds of one in 10^5 at most, for sets of under 20) may share no
    # subset with a linked one: it is grouped with all sets left of its band and the two beside it.
    band = lambda n: F.floor(F.log2(n.cast("double")))
    sized = left.join(sets.select("sid", "n"), "sid")
    crowded = sized.where("crowded").select(F.explode(F.sequence(band(F.col("n")) - 1, band(F.col("n")) + 1)).alias("a")).distinct()
    members = members.unionByName(sized.select(band(F.col("n")).alias("a"), F.col("sid").alias("b")).join(crowded, "a", "left_semi"))
    centres = members.groupBy("a").agg(F.min("b").alias("centre"))
    stars = members.join(centres, "a").where("b != centre").select(F.col("centre").alias("a"), "b").distinct()
    # Sets that share costly subsets, directly or through others, form a cluster. A pair inside one component needs no link.
    clusters = components(stars).withColumnRenamed("node", "sid").withColumnRenamed("component", "cluster")
    rows = clusters.join(left, "sid", "left_semi").join(classes.of("sid", "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = rows.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("cluster")
    rows = rows.join(mixed, "cluster", "left_semi")
    # Blocks follow components, so that most blocks of a large component hold nothing else and are not compared.
    from pyspark.sql import Window

    order = Window.partitionBy("cluster").orderBy("component", "sid")
    rows = classes.written(rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / block)), "blocks")
    each = rows.groupBy("cluster", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = each.select("cluster", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = each.join(other, "cluster").where("block <= block2 and not (lo = hi and lo2 = hi2 and lo = lo2)").select("cluster", "block", "block2")
    sides = F.when(F.col("block") == F.col("block2"), F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("mine")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("mine")), F.struct(F.lit(1).alias("side"), F.col("block2").alias("mine"))))
    tasks = meet.select("cluster", F.col("block").alias("i"), F.col("block2").alias("j"), F.explode(sides).alias("s")).select("cluster", "i", "j", "s.side", F.col("s.mine").alias("block"))
    asked = rows.join(sets, "sid").join(tasks, ["cluster", "block"]).select("cluster", "i", "j", "side", "sid", "component", "set")
    classes.add(asked.groupBy("cluster", "i", "j").applyInArrow(_blocks_meet, "a long, b long"))


# --- the join --------------------------------------------------------------------------------------------------------
def _texts_of(texts: DataFrame, sizes: DataFrame, wanted: DataFrame, most: int, classes: _Classes) -> DataFrame:
    """One text for each wanted set; rows that repeat an id may bring more, which does no harm. Ids are sent if few."""
    ids = classes.written(sizes.join(wanted, "sid").groupBy("sid").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "ids")
    small = ids.limit(most + 1).count() <= most
    return texts.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def jaccard_components(documents: DataFrame, cold: int = COLD, block: int = BLOCK, broadcast_sets: int = BROADCAST_SETS, bucket_bytes: int = BUCKET_BYTES,
                       most_names: int = BROADCAST_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents joined by links of Jaccard 4/5 or more, exactly."""
    return classed(documents, cold, block, broadcast_sets, bucket_bytes, most_names).select("doc_id", "n_shingles", "component_id")


def classed(documents: DataFrame, cold: int = COLD, block: int = BLOCK, broadcast_sets: int = BROADCAST_SETS, bucket_bytes: int = BUCKET_BYTES,
            most_names: int = BROADCAST_SETS) -> DataFrame:
    """(doc_id, n_shingles, sid, component, component_id): each row with its set's name, its class's, and the class's smallest
    id. The names are null for rows without shingles, which are their own classes."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = written(texts.mapInArrow(_sizes, "doc_id long, n_shingles long, sid long, short boolean"), "sizes")
    total = sizes.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    buckets = max(16, math.ceil(total / 3 * 14 / bucket_bytes))
    classes = _Classes(documents.sparkSession, max(LEAST_TASKS, total // SHINGLES_PER_TASK))
    keep = classes.written
    found = keep(texts.mapInArrow(_index_texts(buckets), _PACKED).groupBy("bucket").applyInArrow(_meet(cold), _FOUND), "round1")
    both = lambda df: df.select(F.explode(F.array("a", "b")).alias("sid")).distinct()

    def absorb(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verify what a round over the texts found; the members of its costly subsets, and the names of those that are still
        of several components."""
        hot = found.where(F.col("hot") & (F.col("tag") != _SHORT)).select("a", "b", "tag")
        pairs = keep(classes.apart(_cheap(found).unionByName(_stars(hot.select("a", "b").distinct(), classes))), "pairs")
        sketches = keep(_texts_of(texts, sizes, both(pairs), broadcast_sets, classes).mapInArrow(_packed(False), "sid long, n long, sketch binary"), "sketches")
        pairs = keep(promising(pairs, sketches), "promising")
        classes.verify(pairs, keep(_texts_of(texts, sizes, both(pairs), broadcast_sets, classes).mapInArrow(_packed(True), "sid long, n long, set binary"), "sets"))
        return hot, classes.several(hot)

    hot, names = absorb(found)
    # Names of costly subsets: at most one for each COLD signatures, and sent to the tasks only if few; the sets that hold
    # one are then found in the texts again. Otherwise, and in any case for what is then left, the next round settles the
    # sets that hold them.
    if names.limit(most_names + 1).count() <= most_names:
        costly = documents.sparkSession.sparkContext.broadcast(np.sort(names.toArrow().column("a").to_numpy()))
        found = keep(texts.mapInArrow(_index_texts(buckets, costly), _PACKED).groupBy("bucket").applyInArrow(_meet(cold), _FOUND), "allocated")
        hot, names = absorb(found)
        short = found.where(F.col("tag") == _SHORT).select(F.col("b").alias("sid"))
    else:
        short = sizes.where("short").select("sid")
    second = keep(classes.mixed(hot, names).select(F.col("b").alias("sid")).unionByName(short).distinct(), "second")
    if not second.isEmpty():
        sets = keep(_texts_of(texts, sizes, second, broadcast_sets, classes).mapInArrow(_packed(True), "sid long, n long, set binary").join(second, "sid", "left_semi"), "sets2")
        buckets = max(16, math.ceil((sets.agg(F.sum("n").alias("n")).first()["n"] or 0) * 2 * 22 / bucket_bytes))
        found = keep(sets.mapInArrow(_index_sets(buckets), _PACKED).groupBy("bucket").applyInArrow(_meet(cold), _FOUND), "round2")
        classes.verify(keep(classes.apart(_cheap(found)), "pairs2"), sets)
        hot = classes.mixed(found.where("hot"))
        # What costly signatures take from each segment's pay, against what the set can spare.
        option, pays = F.shiftright("tag", 4).bitwiseAND(3).cast("int"), F.shiftright("tag", 1).bitwiseAND(7)
        taken = hot.groupBy(F.col("b").alias("sid"), option.alias("option"), F.shiftright("tag", 8).alias("segment")).agg(
            F.max(F.when(F.col("tag").bitwiseAND(1) == 1, pays).otherwise(1)).alias("lost")).groupBy("sid", "option").agg(F.sum("lost").alias("lost"))
        spare = sets.mapInArrow(_slacks, "sid long, option int, slack long")
        left = keep(spare.join(taken, ["sid", "option"], "left").where(F.coalesce("lost", F.lit(0)) > F.col("slack")).groupBy("sid").agg((F.min("slack") < 0).alias("crowded")), "left")
        if not left.isEmpty():
            _settle(left, hot.select("a", "b"), sets, classes, block)
    named = classes.named.withColumnRenamed("node", "sid")
    # The smallest document of each class, from one row per set.
    firsts = sizes.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    of_set = firsts.join(named, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    lowest = of_set.groupBy("component").agg(F.min("first").alias("component_id"))
    out = sizes.join(of_set.join(lowest, "component").select("sid", "component", "component_id"), "sid", "left")
    return out.select("doc_id", "n_shingles", "sid", "component", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _named_rows(text: str):
    """Whole rows, with the name of their set instead of the last column, which holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.record_batch([batch.column(text)], names=["text"])
            sid = [pa.array(sid, mask=np.diff(off) == 0) for _, _, _, off, sid in _sets(only)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(sid) if sid else pa.array([], pa.int64())], names=batch.schema.names)

    return run


def one_per_component(documents: DataFrame, most: int = BROADCAST_SETS) -> DataFrame:
    """One row of ``documents`` of each class, with all its columns: one with the class's smallest id, or without an id where
    no row of the class has one. Rows without shingles stay.

    A row whose id no other row has is told by its id. Of the others, those that share an id or have none, the texts are
    hashed once more, so that two texts under one id are two rows.
    """
    rows = written(classed(documents), "classes")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("head")
    heads = written(rows.where("sid is not null").groupBy("component").agg(head).select("component", F.col("head.doc_id").alias("head_id"), F.col("head.sid").alias("head_sid")), "heads")
    gone, again, name = (free_name(documents.columns, c) for c in ("_gone", "_again", "_set"))
    lost = F.col("doc_id").isNotNull() & (~F.col("doc_id").eqNullSafe(F.col("head_id")) | (F.col("sid") != F.col("head_sid")))
    left_out = written(rows.where("sid is not null").join(heads, "component").where(lost).select(F.col("doc_id").alias(gone)).distinct(), "gone")
    repeated = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(again)), "again")
    sent = lambda df: F.broadcast(df) if df.limit(most + 1).count() <= most else df
    of = F.col("doc_id").cast("long")
    single, shared = documents.where(of.isNotNull()), documents.where(of.isNull())
    if not repeated.isEmpty():
        twice = sent(repeated)
        shared = shared.unionByName(single.join(twice, of == F.col(again), "left_semi"))
        single = single.join(twice, of == F.col(again), "left_anti")
    kept = single.join(sent(left_out), of == F.col(gone), "left_anti")
    if repeated.isEmpty() and rows.where("doc_id is null").isEmpty():
        return kept
    made = shared.select("*", F.col("text").cast("string").alias(name))
    schema = StructType([*made.schema.fields[:-1], StructField(name, LongType())])
    named = made.mapInArrow(_named_rows(name), schema)
    # Equal rows combine before they are moved, so a large group of copies without ids does not meet in one task.
    one = named.where(F.col(name).isNotNull()).dropDuplicates(["doc_id", name])
    chosen = one.join(heads, of.eqNullSafe(F.col("head_id")) & (F.col(name) == F.col("head_sid")), "left_semi")
    return kept.unionByName(chosen.unionByName(named.where(F.col(name).isNull())).drop(name))
