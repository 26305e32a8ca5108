"""SentencePiece encoding and decoding of whole texts by a prefix table over merge-type (BPE) pieces.

A sequence of pieces is what merging makes of its text if and only if each two neighbours are what merging makes of their
joint text: until a merge crosses a border, the two sides merge as they would alone. So every prefix of a text has exactly
one last token: the piece that ends there and is compatible with the last token of the prefix before it. The table
of last tokens is filled from left to right with the matches of an automaton of all pieces, and ids are read from it
backwards. Its time is linear in the text, however long the text is without a space.

No merge makes a piece that is not in the vocabulary. A border that no piece can span, before a run of spaces or at a
character of no piece, thus cuts the text exactly; the segments between such borders repeat, and their ids are kept in
a bounded cache.

Defined cases: a null text counts as the empty one, whose only id is the end id; a character that is no piece becomes its
UTF-8 bytes; other columns pass through, unless they have the name of an output, which is refused; equal rows stay equal
rows; an empty table gives an empty table. The model is sent to the tasks as bytes once its size is checked.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import free_name, refuse

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20
CACHE_SEGMENTS = 300_000
PAIR_BITS = 21
WIDTHS = (6, 10, 16, 32)
ROWS = 8192
GROUP_CHARS = 1 << 20
SLICE = 512
POLYNOMIAL = 0x9E3779B97F4A7C15
SCATTER = 0xD6E8FEB86659FD93
SPACE = "▁"
NEVER = 1 << 40
_CODECS: dict[int, Codec] = {}


def read_model(path: str = MODEL) -> bytes:
    """The model's bytes, when it is one that this operator encodes exactly."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} has over {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        raw = f.read()
    model = proto.ModelProto.FromString(raw)
    kinds = {p.type for p in model.pieces}
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path} is no BPE model with byte fallback")
    if kinds & {proto.ModelProto.SentencePiece.USER_DEFINED, proto.ModelProto.SentencePiece.UNUSED}:
        raise ValueError(f"{path} has user-defined or unused pieces")
    return raw


class Codec:
    """Tables of one model; made once per Python worker.

    A token is the id of a piece or, for a character that is no piece, ``size`` plus its code point."""

    def __init__(self, raw: bytes) -> None:
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size = size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.texts = ["" if special[i] else self.library.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.texts) if p}
        # Merges of a higher score come first; equal scores are equal ranks.
        order = {score: rank for rank, score in enumerate(sorted({self.library.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.ranks = {p: order[self.library.get_score(i)] for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.library.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        known = "".join(sorted({c for p in self.ids for c in p} - {SPACE}))
        self.lines = "\n" in known
        self.spaced = spaced = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        inside = f"[{re.escape(known)}{SPACE if spaced else ''}]"
        # Segments: spaces with what follows, known characters, or one character that is in no piece.
        self.cut = re.compile(f"{inside}+|." if spaced else f"{SPACE}+{inside}*|{inside}+|.", re.S).findall
        self.borders: dict[int, tuple[list, list] | None] = {}
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_answers = np.zeros(1 << PAIR_BITS, bool)
        self.second = np.zeros(size, np.uint64)
        self.lengths = np.array([len(t) for t in self.texts])
        self.by_length = {n: self._hashes([p for p in self.ids if len(p) == n]) for n in sorted({len(p) for p in self.ids})}
        self.longest = max(self.by_length)
        self.recent: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _hashes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of pieces of one length, with their ids, and which leading 16 bits they have.

        A second hash of each is kept beside its id."""
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).reshape(len(pieces), -1)
        h, ids = _prefix_sums(codes, POLYNOMIAL)[:, -1], np.array([self.ids[p] for p in pieces])
        self.second[ids] = _prefix_sums(codes, SCATTER)[:, -1]
        order, leading = np.argsort(h), np.zeros(1 << 16, bool)
        leading[h >> np.uint64(48)] = True
        return h[order], ids[order], leading

    def text(self, token: int) -> str:
        return self.texts[token] if token < self.size else chr(token - self.size)

    def merges(self, text: str) -> tuple[list[str], list, list]:
        """What merging makes of a short text, and how its first and last symbols grew: (symbol, rank that ended it)."""
        parts, now, first, last = list(text), -1, [], []
        while len(parts) > 1:
            joined = [(self.ranks[p], i) for i, p in enumerate(map(str.__add__, parts, parts[1:])) if p in self.ranks]
            if not joined:
                break
            rank, i = min(joined)
            now = max(now, rank)
            if i == 0:
                first.append((parts[0], now))
            if i == len(parts) - 2:
                last.append((parts[-1], now))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, [*first, (parts[0], NEVER)], [*last, (parts[-1], NEVER)]

    def history(self, token: int) -> tuple[list, list] | None:
        """How the border symbols of a token grew; None for a piece that merging never makes of its own text."""
        if token not in self.borders:
            text = self.text(token)
            parts, first, last = self.merges(text)
            self.borders[token] = (first, last) if parts == [text] else None
        return self.borders[token]

    def compatible(self, left: int, right: int) -> bool:
        """True when merging the joint text of two tokens gives these two: no merge crosses the border at any time.

        The symbols at the border change at known ranks. A merge of the two comes first if its rank is lower than that of the
        next merge to its left, which wins ties, and not higher than that of the next one to its right.
        """
        one, two = self.history(left), self.history(right)
        if one is None or two is None:
            return False
        ends, starts, i, j = one[1], two[0], 0, 0
        while True:
            (x, gone), (y, taken) = ends[i], starts[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < gone and rank <= taken and rank < NEVER:
                return False
            if gone == NEVER and taken == NEVER:
                return True
            if gone <= taken:
                i += 1
            else:
                j += 1

    def answers(self, keys: np.ndarray) -> np.ndarray:
        """The compatibility of pairs (token before + 1, token), packed as one number; answers are kept in a table of fixed size."""
        slots = (keys.astype(np.uint64) * np.uint64(SCATTER)) >> np.uint64(64 - PAIR_BITS)
        good = self.pair_answers[slots]
        new = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(new):
            asked, at = np.unique(keys[new], return_inverse=True)
            pairs = [divmod(key, self.size) for key in asked.tolist()]
            told = np.array([self.history(token) is not None if before == 0 else self.compatible(before - 1, token) for before, token in pairs])
            good[new] = told[at]
            self.pair_keys[slots[new]], self.pair_answers[slots[new]] = keys[new], good[new]
        return good

    def prefix_table(self, codes: np.ndarray) -> np.ndarray:
        """Last tokens of all prefixes of many short texts at once; one row a text, padded by zeros at its end.

        An automaton's matches of all texts at once: windows of every piece length, found among the pieces by their hash."""
        n, width = codes.shape
        powers, sums, matches = _powers(POLYNOMIAL, width), _prefix_sums(codes, POLYNOMIAL), {}
        for length, (hashes, tokens, leading) in self.by_length.items():
            if length <= width:
                windows = sums[:, length:] - sums[:, :-length] * powers[length]
                found = np.full(windows.shape, -1, np.int64)
                some = np.nonzero(leading[windows >> np.uint64(48)])
                at = np.minimum(np.searchsorted(hashes, windows[some]), len(hashes) - 1)
                found[some] = np.where(hashes[at] == windows[some], tokens[at], -1)
                matches[length] = found
        last = np.full((n, width + 1), -1, np.int64)
        for end in range(1, width + 1):
            free = np.ones(n, bool)
            for length in range(min(end, self.longest), 0, -1):
                if length in matches:
                    tokens = matches[length][:, end - length]
                    rows = np.flatnonzero((tokens >= 0) & free)
                    if len(rows):
                        rows = rows[self.answers((last[rows, end - length] + 1) * self.size + tokens[rows])]
                        last[rows, end] = tokens[rows]
                        free[rows] = False
            rows = np.flatnonzero(free)
            last[rows, end] = codes[rows, end - 1].astype(np.int64) + self.size
        return last

    def short_segments(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of many short segments, recovered backwards from their prefix tables."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(lengths.max())
        text = "".join([p.ljust(width, "\0") for p in parts]).encode("utf-32-le")
        codes = np.frombuffer(text, np.uint32).reshape(len(parts), width)
        last, sums, powers = self.prefix_table(codes), _prefix_sums(codes, SCATTER), _powers(SCATTER, width)
        out, at, filled = np.zeros((len(parts), width), np.int64), lengths.copy(), np.zeros(len(parts), np.int64)
        plain = np.ones(len(parts), bool)
        rows = np.arange(len(parts))
        while len(rows):
            end = at[rows]
            tokens = last[rows, end]
            filled[rows] += 1
            out[rows, width - filled[rows]] = tokens
            piece = np.minimum(tokens, self.size - 1)
            start = end - self.lengths[piece]
            # A character that is no piece, or a window that only shares a piece's first hash: left to the other way.
            same = (tokens < self.size) & (sums[rows, end] - sums[rows, start] * powers[end - start] == self.second[piece])
            plain[rows[~same]] = False
            at[rows] = start
            rows = rows[same & (start > 0)]
        coded = out.astype(np.int32).tobytes()
        for i, (part, first, ok) in enumerate(zip(parts, (width - filled).tolist(), plain.tolist())):
            yield coded[4 * (i * width + first):4 * (i + 1) * width] if ok else self.long_segment(part)

    def as_ids(self, token: int) -> list[int]:
        return [token] if token < self.size else [self.bytes[b] for b in chr(token - self.size).encode("utf-8")]

    def long_segment(self, text: str) -> bytes:
        """Ids of a segment of any length, from the automaton's matches in one pass."""
        last: list[int | None] = [None] * (len(text) + 1)
        filled = 0
        for at, token in self.automaton.iter(text):
            at += 1
            self.single(text, last, filled + 1, at)
            filled = at - 1
            before = last[at - len(self.texts[token])]
            if last[at] is None and (self.history(token) is not None if before is None else self.compatible(before, token)):
                last[at] = token
        self.single(text, last, filled + 1, len(text) + 1)
        at, out = len(text), []
        while at:
            out.append(last[at])
            at -= len(self.text(last[at]))
        return np.array([i for t in reversed(out) for i in self.as_ids(t)], np.int32).tobytes()

    def single(self, text: str, last: list[int | None], start: int, stop: int) -> None:
        """Prefixes that end with no compatible piece end with a character that is none."""
        for at in range(start, stop):
            if last[at] is None:
                last[at] = self.size + ord(text[at - 1])

    def learn(self, parts: set[str]) -> None:
        """Put the ids of these segments into the cache; short ones together, by width."""
        for low, high in zip((0, *WIDTHS), WIDTHS):
            some = [p for p in parts if low < len(p) <= high]
            for i in range(0, len(some), ROWS):
                batch = some[i:i + ROWS]
                self.recent.update(zip(batch, self.short_segments(batch)))
        self.recent.update((p, self.long_segment(p)) for p in parts if len(p) > WIDTHS[-1])

    def segments(self, text: str) -> list[str]:
        """A normalised text cut where no piece can span the border, and at line ends; empty strings count for nothing."""
        if self.spaced or SPACE * 2 in text or " " in text:
            return self.cut(text)
        text = text.replace(SPACE, " " + SPACE)
        return (text if self.lines else text.replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of whole texts as 32-bit numbers, each with the end id."""
        end = np.array([self.end], np.int32).tobytes()
        for group in _groups([self.library.normalize(t) for t in texts]):
            cut = [self.segments(t) for t in group]
            if len(self.recent) >= CACHE_SEGMENTS:
                self.older, self.recent = self.recent, {"": b""}
            missing = set().union(*cut) - self.recent.keys()
            again = missing & self.older.keys()
            self.recent.update((p, self.older[p]) for p in again)
            self.learn(missing - again)
            find = self.recent.__getitem__
            for parts in cut:
                yield b"".join(map(find, parts)) + end
            # Long segments do not come again.
            for p in [p for p in missing if len(p) > WIDTHS[-1]]:
                del self.recent[p]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of all prefixes of the rows of ``codes``."""
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        sums[:, i + 1] = sums[:, i] * np.uint64(base) + codes[:, i] + np.uint64(1)
    return sums


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts with about ``GROUP_CHARS`` characters; a longer text is a run of its own."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def codec(raw: bytes) -> Codec:
    key = hash(raw)
    if key not in _CODECS:
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _encoder(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in _slices(batches):
            ids = list(own.encode([t or "" for t in batch.column(len(keep)).to_pylist()]))
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.record_batch([*batch.columns[:len(keep)], lists], names=[*keep, "ids"])

    return run


def _decoder(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in _slices(batches):
            lists = batch.column(at)
            ends, ids = lists.offsets.to_pylist(), lists.values.to_numpy()
            texts = [own.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` without its text but with ``ids``, the ids of every whole text and the end id."""
    keep = [c for c in df.columns if c != text]
    refuse(keep, "ids")
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(keep, "text")))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encoder(shared, keep), schema)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with ``decoded``, the text of every list of ids, as the library's decode gives it; null gives the empty text."""
    refuse(df.columns, "decoded")
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    return df.mapInArrow(_decoder(shared, df.columns.index(ids)), schema)
