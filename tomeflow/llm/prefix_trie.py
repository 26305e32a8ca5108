"""Prefix trie of conversations by vertical bitmaps.

A turn is its role and text (two 64-bit hashes and its length go on, texts are left behind). Conversations are dealt by ranges of ids
into shards of bounded size. A shard indexes each (position, turn) to the bitset of its conversations that have that turn there. From a
parent's bitset the trie goes down depth first: the lowest conversation left names a posting, the intersection of parent and posting is
a child, its popcount the number of members, and so on until no conversation is left; those that end at the node are its end list.
Nodes of different shards are the same if depth and prefix hash are (a polynomial over the turns' hashes, 128 bits), and are summed by an
aggregation.

What spans shards is made additive. The owner of a node is its smallest member. A conversation owns a last part of its path, from
depth ``o`` on, or nothing. A leaf is counted by its owner, so leaves below a node are members that own a leaf. Each node below counts
its text once per member but the owner, so a member adds the characters of its path from the node to ``o``. A first walk tells owners, a
second sums.

Very long conversations are cut into bands of ``BAND`` positions, whose prefix state is carried between bands, so no task holds one whole.

Defined cases: rows without a conversation id belong to no conversation and are left out (a null id has no decimal form); null roles and
texts are empty; null turns come first; rows of equal turn are ordered by the hash of role and text; equal rows are turns of their own;
other columns are ignored, whatever their names; an empty table has no node, not even a root. The list of ids that end at one node is hashed
in one stream, as SHA-256 demands, but never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import hot_join, running
from .storage import written

BAND = 4096
TURN_BLOCK = 256
SHARD_ROWS = 1 << 17
SHARD_CONVERSATIONS = 4096
SALT = "second"
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
NODE = ["depth", "k1", "k2"]
WALKED = "kind int, depth long, k1 long, k2 long, n long, ends long, conv_id long, before long, leaves long, saved long, goes_on long, p1 long, p2 long"


def turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, p, h1, h2, chars): position, hashes and characters of every turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(F.col(f"`{conversation}`").isNotNull()).select(
        F.col(f"`{conversation}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(SALT), text, role).alias("h2"), F.length(text).cast("long").alias("chars"),
    )
    # A null turn comes before all blocks.
    block = F.coalesce(F.floor(F.col("turn") / TURN_BLOCK).cast("long"), F.lit(-(1 << 62)))
    ranked = running(rows, ["conv_id"], ["turn", "h1", "h2"], {"p": F.lit(1).cast("long")}, block, inclusive=False)
    return ranked.select("conv_id", "p", "h1", "h2", "chars")


def _taken(conversation: Column, most: int) -> Column:
    """How many first turns a conversation takes of its span's first one."""
    return (F.crc32(conversation.cast("string").cast("binary")) % most).cast("long")


def rebuilt(turned: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Turns of the rebuilt conversations, and a row at position -1 for each conversation: whether it goes on beyond the first band.

    A conversation takes its first turns, as many as its CRC-32 says, from the first conversation of its span.
    """
    first = F.col("conv_id") - F.col("conv_id") % span
    heads = turned.where((F.col("conv_id") == first) & (F.col("p") < most - 1)).groupBy(F.col("conv_id").alias("first"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("p", "h1", "h2", "chars"))).alias("firsts"))
    every = turned.groupBy("conv_id").agg(F.max("p").alias("last")).withColumn("first", first).join(heads, "first", "left")
    every = every.withColumn("taken", _taken(F.col("conv_id"), most))
    # What a conversation is made of besides its own turns: a row of its own and the turns it takes.
    mark = F.struct(F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("chars"))
    head = F.slice("firsts", F.lit(1), F.col("taken").cast("int"))
    lead = every.select("conv_id", (F.col("last") >= BAND).alias("more"), F.inline(F.concat(F.array(mark), F.coalesce(head, F.array().cast(head_type())))))
    own = turned.where(F.col("p") >= _taken(F.col("conv_id"), most)).withColumn("more", F.lit(None).cast("boolean"))
    rows = lead.unionByName(own)
    return rows.select(
        F.floor(F.greatest("p", F.lit(0)) / BAND).cast("long").alias("band"), "conv_id", "p", "h1", "h2", "chars",
        F.when(F.col("p") < 0, F.lit(0).cast("long")).alias("depth"), F.when(F.col("p") < 0, F.col("more")).alias("more"),
    )


def head_type() -> str:
    return "array<struct<p:bigint,h1:bigint,h2:bigint,chars:bigint>>"


def _powers(base: int, start: int, n: int) -> np.ndarray:
    """``base`` to the powers start, start + 1, ..., modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = pow(base, start, 1 << 64)
    return np.multiply.accumulate(out)[:n]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal first ``keys`` columns, of a sorted stream."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cols = {n: held.column(n).to_numpy() for n in held.column_names}
        change = np.zeros(max(held.num_rows - 1, 0), bool)
        for n in held.column_names[:keys]:
            change |= cols[n][1:] != cols[n][:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield {n: c[a:b] for n, c in cols.items()}
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield {n: held.column(n).to_numpy() for n in held.column_names}


def _band_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (conversation, band): turns, characters, and the hash polynomial counted from the band's start."""
    for g in _groups(batches, 2):
        n = len(g["p"])
        sums = [int((g[h].view(np.uint64) * _powers(b, 1, n)).sum(dtype=np.uint64).view(np.int64)) for h, b in zip(("h1", "h2"), _BASES)]
        values = [g["conv_id"][0], g["band"][0], n, int(g["chars"].sum()), *sums]
        yield pa.record_batch([pa.array([v], pa.int64()) for v in values], names=["conv_id", "band", "n", "chars", "s1", "s2"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row at the start of each later band of a conversation, from sorted band sums: depth, characters and hash of all before."""
    names = ["band", "conv_id", "p", "h1", "h2", "chars", "depth", "more"]
    at, state, held = None, (0, 0, 0, 0), None
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            conv, band, n, chars, s1, s2 = row
            same = conv == at
            if held is not None:
                out.append((*held, same))
            depth, before, k1, k2 = state if same else (0, 0, 0, 0)
            held = (band, conv, -1, _signed(k1), _signed(k2), before, depth) if same else None
            at, state = conv, (depth + n, before + chars, (k1 + s1 * pow(_BASES[0], depth, 1 << 64)) % (1 << 64), (k2 + s2 * pow(_BASES[1], depth, 1 << 64)) % (1 << 64))
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)
    if held is not None:
        yield pa.record_batch([pa.array([v]) for v in (*held, False)], names=names)


def _signed(k: int) -> int:
    return k - (1 << 64) if k >> 63 else k


def banded(rows: DataFrame) -> DataFrame:
    """``rows`` with a row at position -1 at the start of every later band, which says what came before."""
    long = rows.where((F.col("p") < 0) & F.col("more")).select("conv_id")
    turned = rows.where(F.col("p") >= 0).select("conv_id", "band", "p", "h1", "h2", "chars")
    turned = hot_join(turned, long, ["conv_id"], F.col("p"), "leftsemi")
    sums = turned.repartition("conv_id", "band").sortWithinPartitions("conv_id", "band", "p").mapInArrow(_band_sums, "conv_id long, band long, n long, chars long, s1 long, s2 long")
    starts = sums.repartition("conv_id").sortWithinPartitions("conv_id", "band").mapInArrow(_carried, rows.schema)
    return rows.unionByName(starts)


class Shard:
    """Conversations of one band and a range of ids, in order, with their turns; a row at position -1 opens each."""

    def __init__(self, cols: dict[str, np.ndarray]) -> None:
        marks = np.flatnonzero(cols["p"] < 0)
        self.n = len(marks)
        self.conv = cols["conv_id"][marks]
        self.more = cols["more"][marks].astype(bool)
        self.start = cols["depth"][marks].astype(np.int64)
        self.state = [cols[h][marks] for h in ("h1", "h2")]
        # Turns of conversation i are the rows first[i] up to first[i] + length[i].
        self.length = np.diff(np.append(marks, len(cols["p"]))) - 1
        self.first = np.cumsum(self.length) - self.length
        turn = cols["p"] >= 0
        h, chars = [cols[k][turn] for k in ("h1", "h2")], cols["chars"][turn]
        self.owner = np.repeat(np.arange(self.n), self.length)
        step = np.arange(len(chars)) - self.first[self.owner]
        self.depth = self.start[self.owner] + step + 1
        self.last = self.start + self.length
        self.before = self._sums(chars, cols["chars"][marks]) - chars
        self.keys = []
        for j, base in enumerate(_BASES):
            power = _powers(base, 1, int(self.length.max(initial=0)) + 1)
            lift = np.array([pow(base, int(d), 1 << 64) for d in self.start], np.uint64)
            terms = h[j].view(np.uint64) * power[step] * lift[self.owner]
            self.keys.append(self._sums(terms, self.state[j].view(np.uint64)).view(np.int64))
        # The vertical index: (depth, turn) to the bitset of the conversations that have it.
        order = np.lexsort((h[1], h[0], self.depth))
        d, a, b = self.depth[order], h[0][order], h[1][order]
        new = np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
        self.posting = np.zeros(len(order), np.int64)
        self.posting[order] = np.cumsum(new) - 1
        self.bits = [0] * int(new.sum())
        for p, i in zip(self.posting.tolist(), self.owner.tolist()):
            self.bits[p] |= 1 << i
        self.ending: dict[int, int] = {}
        for i, d in enumerate(self.last.tolist()):
            self.ending[d] = self.ending.get(d, 0) | 1 << i

    def _sums(self, terms: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Running sums within each conversation, from its state."""
        total = np.concatenate([np.zeros(1, terms.dtype), np.cumsum(terms, dtype=terms.dtype)])
        return total[1:] - total[self.first[self.owner]] + start[self.owner]

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """(row, members, parent, tail) of each node below the start states, and the members that stop at each.

        Nodes come before their children. ``row`` is the lowest member's; the node of a start state has row -1 minus a member. ``tail`` tells
        nodes of one member: the rest of its path, which is not walked further.
        """
        starts: dict[tuple, int] = {}
        for i, key in enumerate(zip(self.start.tolist(), self.state[0].tolist(), self.state[1].tolist())):
            starts[key] = starts.get(key, 0) | 1 << i
        rows, members, parents, tails, stops = [], [], [], [], []
        first, posting, begin, bits, ending = self.first.tolist(), self.posting.tolist(), self.start.tolist(), self.bits, self.ending
        stack = []

        def node(row: int, count: int, parent: int, tail: bool) -> int:
            rows.append(row)
            members.append(count)
            parents.append(parent)
            tails.append(tail)
            stops.append([])
            return len(rows) - 1

        for (depth, _, _), some in starts.items():
            low = (some & -some).bit_length() - 1
            stack.append((some, depth, node(-1 - low, some.bit_count(), -1, False)))
        while stack:
            some, depth, at = stack.pop()
            left = some
            stop = some & ending.get(depth, 0)
            left ^= stop
            while stop:
                low = stop & -stop
                stops[at].append(low.bit_length() - 1)
                stop ^= low
            while left:
                low = (left & -left).bit_length() - 1
                row = first[low] + depth - begin[low]
                child = left & bits[posting[row]]
                left ^= child
                count = child.bit_count()
                if count == 1:
                    stops[node(row, 1, at, True)].append(low)
                else:
                    stack.append((child, depth + 1, node(row, count, at, False)))
        return np.array(rows), np.array(members), np.array(parents), np.array(tails), stops

    def nodes(self, o: np.ndarray | None = None, lo: np.ndarray | None = None, leaf: np.ndarray | None = None) -> pa.RecordBatch:
        """Rows of ``WALKED``: of each local node (kind 0) and, once owners are known, of each end (kind 1)."""
        rows, members, parents, tails, stops = self.walk()
        sums = {"ends": np.zeros(len(rows), np.int64), "lo": np.zeros(len(rows), np.int64), "leaves": np.zeros(len(rows), np.int64)}
        done, zero = ~self.more, np.zeros(self.n, np.int64)
        lo, leaf = zero if lo is None else lo, zero if leaf is None else leaf
        at = np.repeat(np.arange(len(rows)), [len(s) for s in stops])
        who = np.array([i for s in stops for i in s], np.int64)
        np.add.at(sums["lo"], at, lo[who])
        np.add.at(sums["leaves"], at, leaf[who])
        for name in ("lo", "leaves"):
            total = sums[name].tolist()
            for i in range(len(total) - 1, -1, -1):
                if parents[i] >= 0:
                    total[parents[i]] += total[i]
            sums[name] = np.array(total, np.int64)
        np.add.at(sums["ends"], at, done[who])
        # Tails become one node a turn.
        begin = np.where(rows < 0, -1 - rows, self.owner[np.maximum(rows, 0)] if len(self.owner) else 0)
        width = np.where(tails, self.first[begin] + self.length[begin] - rows, 1)
        sums["ends"][tails] = 0
        pick = np.repeat(np.arange(len(rows)), width)
        row = rows[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(width) - width, width)
        conv, inside = begin[pick], row >= 0
        safe = np.maximum(row, 0)
        get = (lambda x, y: np.where(inside, x[safe], y[conv])) if len(self.owner) else (lambda x, y: y[conv])
        depth = get(self.depth, self.start)
        ends = sums["ends"][pick] + (tails[pick] & done[conv] & (depth == self.last[conv]))
        before = get(self.before, np.zeros(self.n, np.int64))
        k1, k2 = (get(self.keys[j], self.state[j]) for j in (0, 1))
        # The node of a later band's start state belongs to the band before.
        kept = inside | (self.start[conv] == 0)
        out = {"kind": zero[conv].astype(np.int32), "depth": depth, "k1": k1, "k2": k2, "n": members[pick], "ends": ends, "conv_id": self.conv[conv], "before": before}
        if o is None:
            extra = [pa.nulls(int(kept.sum()), pa.int64())] * 5
        else:
            owned = o[conv] <= depth
            saved = sums["lo"][pick] - np.where(owned, lo[conv], 0) - before * (members[pick] - owned)
            head = owned & (o[conv] == depth) & (depth > 0)
            up = np.maximum(row - 1, 0)
            inner = depth - 1 > self.start[conv]
            above = [np.where(inner, self.keys[j][up] if len(self.owner) else 0, self.state[j][conv]) for j in (0, 1)]
            goes_on = owned & ((depth < self.last[conv]) | self.more[conv])
            extra = [pa.array(x[kept]) for x in (sums["leaves"][pick], saved, goes_on.astype(np.int64))]
            extra += [pa.array(x[kept], mask=~head[kept]) for x in above]
        names = [f.split()[0] for f in WALKED.split(", ")]
        batch = pa.record_batch([*[pa.array(x[kept]) for x in out.values()], *extra], names=names)
        if o is None:
            return batch
        # Where each conversation that is done ends: its last turn's node, or its start state.
        over = np.flatnonzero(done)
        tip = np.maximum(self.first[over] + self.length[over] - 1, 0)
        has = self.length[over] > 0
        key = [np.where(has, self.keys[j][tip] if len(self.owner) else 0, self.state[j][over]) for j in (0, 1)]
        known = {"kind": np.ones(len(over), np.int32), "depth": self.last[over], "k1": key[0], "k2": key[1], "conv_id": self.conv[over]}
        ends = pa.record_batch([pa.array(known[c]) if c in known else pa.nulls(len(over), pa.int64()) for c in names], names=names)
        return pa.Table.from_batches([batch, ends]).combine_chunks().to_batches()[0]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole conversations of one band, up to a bounded number of rows and conversations, from a sorted stream."""
    held, rows, conversations = [], 0, 0
    for g in _groups(batches, 2):
        if held and (g["band"][0] != held[0]["band"][0] or rows + len(g["p"]) > SHARD_ROWS or conversations == SHARD_CONVERSATIONS):
            yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            held, rows, conversations = [], 0, 0
        held.append(g)
        rows, conversations = rows + len(g["p"]), conversations + 1
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _first_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _shards(batches):
        yield Shard(cols).nodes()


def _second_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _shards(batches):
        marks = cols["p"] < 0
        yield Shard(cols).nodes(*[cols[c][marks].astype(np.int64) for c in ("o", "lo", "leaf")])


def _dealt(rows: DataFrame) -> DataFrame:
    """Sorted ranges of (band, conversation): a shard is cut from the stream of one task."""
    return rows.repartitionByRange("band", "conv_id").sortWithinPartitions("band", "conv_id", "p")


def _owners(rows: DataFrame) -> DataFrame:
    """(conv_id, o, lo, leaf): from which depth a conversation owns its path, the characters before, and whether it owns a leaf."""
    local = _dealt(rows).mapInArrow(_first_walk, WALKED)
    nodes = local.groupBy(*NODE).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("conv_id").alias("conv_id"), F.min("before").alias("before"))
    # All members end at a leaf, its owner too.
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("o"), F.min_by("before", "depth").alias("lo"), F.max((F.col("n") == F.col("ends")).cast("long")).alias("leaf"))
    totals = rows.groupBy("conv_id").agg(F.sum(F.when(F.col("p") >= 0, F.col("chars")).otherwise(0)).alias("total"))
    never = F.lit(1 << 62)
    return totals.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("o", never).alias("o"), F.coalesce("lo", "total").alias("lo"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, from a sorted stream; only the hash under way is held."""
    node, digest = None, None
    for batch in batches:
        out = []
        for *key, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=[*NODE, "digest"])
    if node is not None:
        yield pa.record_batch([pa.array([v]) for v in (*node, digest.hexdigest())], names=[*NODE, "digest"])


def trie(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, each with its owner, parent, counts and digest of ends."""
    rows = written(banded(written(rows, "turns")), "bands")
    owners = _owners(rows)
    marks = rows.where("p < 0").join(owners, "conv_id")
    others = rows.where("p >= 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("o", "lo", "leaf")])
    walked = written(_dealt(marks.select(*others.columns).unionByName(others)).mapInArrow(_second_walk, WALKED), "walked")
    nodes = walked.where("kind = 0")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    digests = walked.where("kind = 1").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(
        _digests, "depth long, k1 long, k2 long, digest string")
    # What a node is told by its shards, by children of other owners, and by its ends.
    columns = ["n", "conv_id", "children", "leaves", "saved"]
    told = nodes.select(*NODE, "n", "conv_id", F.col("goes_on").alias("children"), "leaves", "saved", "p1", "p2", none.cast("string").alias("digest"))
    branches = nodes.where("p1 is not null").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("branches"))
    branches = branches.groupBy(*NODE).agg(F.sum("branches").alias("branches"))
    none_of = lambda names: [none.cast("long").alias(c) for c in names]
    told = told.withColumn("branches", zero).unionByName(
        branches.select(*NODE, *none_of(columns), *none_of(["p1", "p2"]), none.cast("string").alias("digest"), "branches")).unionByName(
        digests.select(*NODE, *none_of(columns), *none_of(["p1", "p2"]), "digest", zero.alias("branches")))
    merged = told.groupBy(*NODE).agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), (F.sum("children") + F.sum("branches")).alias("n_children"), F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("digest").alias("digest"), F.sum("branches").alias("branches"))
    merged = written(merged, "nodes")
    # A node's parent has the same owner, unless the owner's own part begins here.
    begun = F.col("p1").isNotNull()
    above = merged.where("branches > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    inner = merged.where(~begun).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    linked = hot_join(merged.where(begun), above, ["depth", "p1", "p2"], F.col("conv_id")).unionByName(inner)
    return linked.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
