"""Language ID by prediction by partial matching.

For each language a tree of byte contexts of order 0 to ``order`` holds how often each byte followed. The code length of a
byte is that of its longest known context; an unseen byte pays that context's escape (method C: distinct followers over
distinct followers plus total) and goes to the next shorter context, and at last to a uniform byte. Statistics are frozen
after training, so code lengths add up over the text and the language with the shortest code wins.

Training counts byte n-grams of about ``PER_LANGUAGE`` whole texts per language in Spark tasks (a bounded sample, taken by
a hash of the id); only the counts, bounded by that sample, reach the driver. Scoring is one pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null languages are never learned; equal code
lengths go to the language that sorts first; with nothing to learn from every text is ``und``; equal rows get equal answers;
further columns are ignored. ``order`` is at most 3, so that a context and its byte fit in four bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import cut_lineage

ORDER = 3
PER_LANGUAGE = 2000
UNKNOWN = "und"
BROADCAST_LANGUAGES = 10_000
_BUILT: dict[str, "Scorer"] = {}


def sample(df: DataFrame, lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` rows of each language, or all of a rarer one: those whose id hash is lowest."""
    counts = df.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per language, with the share of its rows to take.
    shares = counts.select("_lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("_n")).alias("_share"))
    # Sent to the tasks if languages are few, so that texts stay where they are and a large language is not one task.
    shares = cut_lineage(shares)
    few = shares.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    return df.join(F.broadcast(shares) if few else shares, df[lang] == shares["_lang"]).where(draw < F.col("_share")).drop("_lang", "_n", "_share")


def _grams(order: int):
    schema = pa.schema([("lang", pa.string()), ("width", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, data, off in K.chunks(batch.column("text")):
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                owner = np.repeat(np.arange(b - a), np.diff(off))
                x = data.astype(np.int64)
                for width in range(1, order + 2):
                    n = len(x) - width + 1
                    if n <= 0:
                        continue
                    gram = np.zeros(n, np.int64)
                    for j in range(width):
                        gram = (gram << 8) | x[j:j + n]
                    whole = owner[:n] == owner[width - 1:]
                    packed, counts = np.unique((code[owner[:n][whole]].astype(np.int64) << 32) | gram[whole], return_counts=True)
                    yield pa.record_batch([pa.array(names[packed >> 32], pa.string()), pa.array(np.full(len(packed), width, np.int32)),
                                           pa.array(packed & 0xFFFFFFFF), pa.array(counts.astype(np.int64))], schema=schema)

    return run


def train(df: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Per language and n-gram width, the sorted packed n-grams with their counts."""
    if not 0 <= order <= 3:
        raise ValueError("order must be 0 to 3")
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInArrow(_grams(order), "lang string, width int, gram long, n long").groupBy("lang", "width", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names, widths = np.array(table.column("lang").to_pylist(), object), table.column("width").to_numpy()
    grams, counts = table.column("gram").to_numpy(), table.column("n").to_numpy()
    model: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for name in sorted(set(names)):
        model[name] = {}
        for width in range(1, order + 2):
            at = np.flatnonzero((names == name) & (widths == width))
            at = at[np.argsort(grams[at])]
            model[name][width] = (grams[at], counts[at])
    return model


class Scorer:
    """Code lengths in bits, worked out for every known context of every language.

    Contexts of all languages share one numbering. ``tables[w]`` has a row per context of ``w`` bytes and a column per
    next byte and language. A position looks up its longest context that any language knows; what a language does not
    know there is its escape chain, resolved when the table is made.
    """

    def __init__(self, model: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], order: int):
        self.names = sorted(model)
        self.order = order
        n = len(self.names)
        below = np.full((1, 256, n), 8.0)
        self.contexts = [np.zeros(1, np.int64)]
        self.tables = []
        for width in range(order + 1):
            known = np.zeros(1, np.int64) if width == 0 else np.unique(np.concatenate([model[x][width + 1][0] >> 8 for x in self.names] or [np.zeros(0, np.int64)]))
            if width == 0:
                table = np.repeat(below, 1, axis=0)
            else:
                # The next shorter context drops the first byte; it is known wherever the longer one is.
                shorter = known & ((1 << (8 * (width - 1))) - 1)
                table = below[np.searchsorted(self.contexts[-1], shorter)].copy() if len(known) else np.zeros((0, 256, n))
            for k, name in enumerate(self.names):
                gram, count = model[name][width + 1]
                if len(gram) == 0:
                    continue
                row, byte = np.searchsorted(known, gram >> 8), gram & 255
                total = np.bincount(row, count, minlength=len(known))
                kinds = np.bincount(row, minlength=len(known)).astype(float)
                here = np.flatnonzero(kinds > 0)
                table[here, :, k] += -np.log2(kinds[here] / (kinds[here] + total[here]))[:, None]
                table[row, byte, k] = -np.log2(count / (kinds[row] + total[row]))
            if width:
                self.contexts.append(known)
            self.tables.append(table.astype(np.float32).reshape(table.shape[0] * 256, n))
            below = table
        # Dense alphabets make the search for a context one lookup: bytes of the training texts, and one code for the rest.
        seen = np.unique(np.concatenate([model[x][1][0] for x in self.names] or [np.zeros(0, np.int64)]))
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.radix = len(seen) + 1
        self.nodes = [np.zeros(1, np.int32)]
        for width in range(1, order + 1):
            node = np.full(self.radix**width, -1, np.int32)
            c = self.contexts[width]
            dense = np.zeros(len(c), np.int64)
            for j in range(width):
                dense = dense * self.radix + self.code[(c >> (8 * (width - 1 - j))) & 255]
            node[dense] = np.arange(len(c), dtype=np.int32)
            self.nodes.append(node)

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each document in each language."""
        n, m = len(data), len(self.names)
        out = np.zeros((len(off) - 1, m))
        if n == 0 or m == 0:
            return out
        place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
        code, x = self.code[data], data.astype(np.int64)
        bits = np.empty((n, m), np.float32)
        open_ = np.ones(n, bool)
        for width in range(self.order, -1, -1):
            at = np.flatnonzero(open_ & (place >= width)) if width else np.flatnonzero(open_)
            dense = np.zeros(len(at), np.int64)
            for j in range(width, 0, -1):
                dense = dense * self.radix + code[at - j]
            node = self.nodes[width][dense]
            known = node >= 0
            at, node = at[known], node[known]
            bits[at] = self.tables[width][node.astype(np.int64) * 256 + x[at]]
            open_[at] = False
        full = np.flatnonzero(np.diff(off) > 0)
        out[full] = np.add.reduceat(bits, off[:-1][full], axis=0, dtype=np.float64)
        return out


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = ((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A))
    some = K.run_sums(ascii_letter.astype(np.int64), off) > 0
    for d in np.flatnonzero(~some & (np.diff(off) > 0)):
        some[d] = any(c.isalpha() for c in data[off[d]:off[d + 1]].tobytes().decode("utf-8", "replace"))
    return some


def _predict(shared, order: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _BUILT:
            _BUILT.clear()
            _BUILT[shared.id] = Scorer(shared.value, order)
        scorer = _BUILT[shared.id]
        for batch in batches:
            names, scores = [], []
            for _, _, data, off in K.chunks(batch.column("_text")):
                bits = scorer.code_lengths(data, off)
                letters = _has_letter(data, off)
                if not scorer.names:
                    names += [UNKNOWN] * len(letters)
                    scores.append(np.zeros(len(letters)))
                    continue
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0))
                scores.append(np.where(letters, 1.0 / odds.sum(axis=1), 0.0))
                names += [scorer.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield pa.record_batch([*[batch.column(k) for k in keep], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                  names=[*keep, "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: Column | None = None, order: int = ORDER) -> DataFrame:
    """(*keep, lang_pred, score): the language of the shortest code and its share of the likelihood."""
    rows = df.select(*[F.col(f"`{k}`") for k in keep], (F.col("text") if text is None else text).cast("string").alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = rows.drop("_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(_predict(_Shared(shared), order, list(keep)), schema)


class _Shared:
    """A broadcast with a name that Python workers can keep what they built from it under."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value
