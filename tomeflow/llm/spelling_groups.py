"""Spelling variants: words one edit apart, met through one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, balanced by the letters of the vocabulary. Words that differ by one inserted, deleted or
replaced letter have reduced forms that are equal or differ by one edit too. So each word sends out its reduced form
and all that one edit makes of it, these meet the reduced vocabulary by an equi-join, and each meeting is verified on the
original strings. The fewer the symbols, the smaller a neighbourhood, and the more words share a reduced form: their number
grows with the sixth root of the vocabulary, so that the shortest words, of six letters, stay as crowded at every size.
A bitmap of fixed size of the reduced vocabulary is sent to the tasks first, so that forms that no word has are mostly not
shuffled.

Defined cases: a null or empty text has no words; a null id counts as an empty one; equal rows all count; letters outside
the pattern part words; other columns are ignored, whatever their names; an empty table has an empty vocabulary. Texts are
read in pieces that end between words, so a very long text needs no list of all its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix
from .storage import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LEAST_CHARS = 6
LEAST_COUNT = 5
FORM_RATIO = 5
NOISE = 199
PIECE_CHARS = 1 << 20
FLUSH_WORDS = 300_000
BATCH_KEYS = 1 << 21
LETTERS = 256
BITS = 27
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of about ``limit`` characters that end between words; a longer word is in a piece of its own."""
    start = 0
    while len(text) - start > limit:
        gap = GAP.search(text, start + limit)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def runs(text: str | None, limit: int = PIECE_CHARS) -> Counter[str]:
    """Runs of letters of a whole text with their counts; only A-Z are lower-cased."""
    out: Counter[str] = Counter()
    for piece in pieces(text or "", limit):
        out.update(RUN.findall(piece.encode("utf-8").lower().decode("utf-8")))
    return out


def _counts(least_chars: int, noise: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                prefix = crc32(((key.as_py() or "") + ":").encode("utf-8"))
                for word, n in runs(text.as_py()).items():
                    if len(word) < least_chars:
                        continue
                    if noise is not None:
                        h = crc32(word.encode("utf-8"), prefix)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_chars:
                                continue
                    total[word] += n
                if len(total) >= FLUSH_WORDS:
                    yield flush()
        yield flush()

    return run


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
                noise: int | None = NOISE) -> DataFrame:
    """(word, n): words of at least ``least_chars`` letters that occur at least ``least_count`` times in all texts.

    ``noise`` plants slips: a run whose CRC-32 with its document's id is divisible by it loses the letter that the CRC names; None plants
    none. Words are summed in each task before the shuffle.
    """
    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    parts = rows.mapInArrow(_counts(least_chars, noise), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbol_table(vocabulary: DataFrame, symbols: int) -> dict[str, int]:
    """The symbol of each of the most frequent letters: most frequent first, each to the symbol with the fewest letters yet."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    load, out = [0] * symbols, {}
    for c, n in letters.orderBy(F.desc("n"), "c").limit(LETTERS).collect():
        s = load.index(min(load))
        load[s] += n
        out[c] = s
    return out


def _reduced(words: list[str], table: dict[str, int], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of symbols, counted from 1) of the words of each length, in bounded batches."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    codes = (np.arange(1 + max((ord(max(w)) for w in words if w), default=0)) % symbols).astype(np.uint64)
    for c, s in table.items():
        if ord(c) < len(codes):
            codes[ord(c)] = s
    for length, at in by_length.items():
        step = max(1, BATCH_KEYS // (2 * (length + 1) * symbols))
        for i in range(0, len(at), step):
            some = at[i:i + step]
            chars = np.frombuffer("".join([words[j] for j in some]).encode("utf-32-le"), np.uint32).reshape(len(some), length)
            yield np.array(some), codes[chars] + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def own_keys(symbols: np.ndarray) -> np.ndarray:
    """One key per reduced word."""
    return mix((symbols * _powers(symbols.shape[1])).sum(axis=1, dtype=np.uint64))


def neighbour_keys(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of each reduced word and of all words one edit from it, each once."""
    n, length = symbols.shape
    powers, base, back = _powers(length + 1), np.uint64(_BASE), np.uint64(_INVERSE)
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum(symbols * powers[:length], axis=1, out=sums[:, 1:])
    full, every = sums[:, -1], np.arange(n)
    rows, keys = [every], [full]
    for i in range(length + 1):
        for c in range(1, alphabet + 1):
            c = np.array([c], np.uint64)
            # A symbol put beside its like: only in front of it, not also behind it.
            some = every if i == 0 else np.flatnonzero(symbols[:, i - 1] != c)
            rows.append(some)
            keys.append(sums[some, i] + c * powers[i] + (full[some] - sums[some, i]) * base)
            if i < length:
                some = np.flatnonzero(symbols[:, i] != c)
                rows.append(some)
                keys.append(full[some] + (c - symbols[some, i]) * powers[i])
        if i < length:
            some = every if i == 0 else np.flatnonzero(symbols[:, i] != symbols[:, i - 1])
            rows.append(some)
            keys.append(sums[some, i] + (full[some] - sums[some, i + 1]) * back)
    return np.concatenate(rows), mix(np.concatenate(keys))


def _own(table: dict[str, int], symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _reduced(batch.column(0).to_pylist(), table, symbols):
                at = pa.array(rows)
                yield pa.record_batch([pa.array(own_keys(matrix).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "near", "near_n"])

    return run


def _neighbours(table: dict[str, int], symbols: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = shared.value
        for batch in batches:
            for rows, matrix in _reduced(batch.column(0).to_pylist(), table, symbols):
                at, keys = neighbour_keys(matrix, symbols)
                slots = keys >> np.uint64(64 - BITS)
                some = np.flatnonzero((present[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1))
                at = pa.array(rows[at[some]])
                yield pa.record_batch([pa.array(keys[some].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "word", "n"])

    return run


def _bitmap(own: DataFrame) -> np.ndarray:
    """Which leading bits of keys occur: ``1 << BITS`` bits, at any size of the vocabulary."""
    slots = own.select(F.shiftrightunsigned("key", 64 - BITS).cast("int").alias("slot"))
    cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.uint64)
    got = cells.toArrow()
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def near_words(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of distinct words of the vocabulary exactly one edit apart."""
    spark = vocabulary.sparkSession
    vocabulary = vocabulary.select("word", "n")
    if symbols is None:
        symbols = max(4, int(np.ceil(vocabulary.count() ** (1 / LEAST_CHARS))))
    table = symbol_table(vocabulary, symbols)
    own = vocabulary.mapInArrow(_own(table, symbols), "key long, near string, near_n long")
    shared = spark.sparkContext.broadcast(_bitmap(own))
    asked = vocabulary.mapInArrow(_neighbours(table, symbols, shared), "key long, word string, n long")
    return asked.join(own, "key").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def forms(vocabulary: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its most frequent near word, the first in code-point order among equals,
    where that is at least ``ratio`` times as frequent."""
    none = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))))
    found = near_words(vocabulary).unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    return found.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``, the last word along the forms; the word itself if it has none.

    Pointers double, so rounds grow with the logarithm of the longest chain, which itself grows with the logarithm of the counts.
    A form has few words before it: those one edit away.
    """
    formed = written(formed, "forms")
    steps = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        moved = steps.join(ahead, "root", "left")
        steps = written(moved.select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("moved")), "steps")
        if steps.where("moved").limit(1).count() == 0:
            break
        steps = steps.select("word", "root")
    return formed.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of all texts."""
    vocabulary = written(word_counts(df, key, text), "vocabulary")
    return roots(forms(vocabulary)).select("word", "form", "root", "n", "n_near", "form_n")
