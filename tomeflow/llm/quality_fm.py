"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words hashed into ``BUCKETS`` (weights log(1 + count), scaled to length one) and binned structure
statistics (length, symbol, capital, digit, repeated-word and line ratios) with the metadata length. The score is the
logistic of w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2): all pairwise interactions in time linear in the features.

Features are made in Spark tasks. Training takes at most ``TRAIN_ROWS`` labelled rows (a bounded sample, by a hash of the
id) to one task, and returns weights of a fixed size; scoring is one pass without a shuffle.

Defined cases: null labels are never learned; null or empty texts have structure features only and get a score; without
labelled rows of both classes every score is the share of ones, or 0.5 without any; equal rows get equal scores; repeated
label rows each count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 1 << 15
FACTORS = 8
TRAIN_ROWS = 12_000
EPOCHS = 6
_STATS = 16
_BINS = 8


def _stats(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, woff: np.ndarray, hashes: np.ndarray, known_length: np.ndarray) -> np.ndarray:
    """Structure statistics in [0, 1), one row per document."""
    n_bytes = np.maximum(np.diff(off), 1).astype(float)
    words = np.diff(woff).astype(float)
    some = np.maximum(words, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return K.run_sums(table[data].astype(np.int64), off) / n_bytes

    def among(chars: bytes) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return t

    upper, digit, high = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    upper[0x41:0x5B], digit[0x30:0x3A], high[0x80:] = True, True, True
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(woff[:-1], woff[1:])], float)
    width = K.run_sums((ends - starts).astype(np.int64), woff) / some
    newline = K.run_sums((data == 10).astype(np.int64), off)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    if len(hashes):
        first = woff[:-1][woff[:-1] < len(hashes)]
        again[first] = 0
    columns = [
        np.log1p(words) / 16, width / (width + 8), distinct / some, newline / (newline + some / 8 + 1),
        share(among(b"#*$%&<>")), share(among(b"!")), share(among(b"|")), share(among(b".,")), share(among(b"?;:'\"()-")),
        share(upper), share(digit), share(high), share(K.SPACE), K.run_sums(again, woff) / some,
        np.log1p(known_length) / 20, share(among(b"=/_\\~^@+{}[]")),
    ]
    return np.minimum(np.nan_to_num(np.stack(columns, axis=1)), 0.999999)


def features(texts: pa.Array, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, feature offsets, feature numbers, values) per chunk of whole texts."""
    for a, b, data, off in K.chunks(texts):
        starts, ends, woff = K.word_spans(data, off, K.NOT_SPACE)
        h = K.word_hashes(data, starts, ends)
        stats = _stats(data, off, starts, ends, woff, h, lengths[a:b])
        doc = np.repeat(np.arange(b - a), np.diff(woff)).astype(np.uint64)
        pairs, counts = np.unique((doc << np.uint64(15)) | (h % np.uint64(BUCKETS)), return_counts=True)
        owner, bucket = (pairs >> np.uint64(15)).astype(np.int64), (pairs & np.uint64(BUCKETS - 1)).astype(np.int64)
        x = np.log1p(counts)
        norm = np.sqrt(np.bincount(owner, x * x, minlength=b - a))
        x = x / np.maximum(norm[owner], 1e-9)
        # Each statistic is one of a few bins of its square root, and the value itself.
        bins = np.minimum((np.sqrt(np.maximum(stats, 0)) * _BINS).astype(np.int64), _BINS - 1)
        at = np.arange(_STATS)
        fixed = np.concatenate([BUCKETS + at * _BINS + bins, np.broadcast_to(BUCKETS + _STATS * _BINS + at, stats.shape)], axis=1)
        value = np.concatenate([np.full(stats.shape, 0.5), stats], axis=1)
        owner = np.concatenate([owner, np.repeat(np.arange(b - a), 2 * _STATS)])
        number, value = np.concatenate([bucket, fixed.ravel()]), np.concatenate([x, value.ravel()])
        order = np.argsort(owner, kind="stable")
        yield b - a, np.searchsorted(owner[order], np.arange(b - a + 1)), number[order], value[order]


N_FEATURES = BUCKETS + _STATS * (_BINS + 1)


def raw_scores(model: dict, off: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The machine's sum in linear time: half of (sum of v x) squared less the sum of squares, over the factors."""
    linear = np.add.reduceat(model["w"][number] * value, off[:-1])
    vx = model["v"][number] * value[:, None]
    total = np.add.reduceat(vx, off[:-1], axis=0)
    squares = np.add.reduceat(vx * vx, off[:-1], axis=0)
    return model["w0"] + linear + 0.5 * (total * total - squares).sum(axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> dict:
    """Weights by Adagrad over small batches in a fixed order."""
    model = {"w0": 0.0, "w": np.zeros(N_FEATURES), "v": np.random.default_rng(7).normal(0, 0.02, (N_FEATURES, FACTORS))}
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return {"constant": share}
    model["w0"] = float(np.log(share / (1 - share)))
    g0, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6)
    rng, size = np.random.default_rng(11), 64
    for _ in range(epochs):
        for batch in np.array_split(order := rng.permutation(len(y)), max(1, len(order) // size)):
            number = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch]).astype(float)
            off = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in batch])])
            err = (logistic(raw_scores(model, off, number, value)) - y[batch]) / len(batch)
            owner = np.repeat(np.arange(len(batch)), np.diff(off))
            v = model["v"][number]
            total = np.add.reduceat(v * value[:, None], off[:-1], axis=0)
            e = err[owner] * value
            used, inverse = np.unique(number, return_inverse=True)
            dw = np.bincount(inverse, e, minlength=len(used)) + decay * model["w"][used]
            slope = e[:, None] * (total[owner] - v * value[:, None])
            dv = np.stack([np.bincount(inverse, slope[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + decay * model["v"][used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += err.sum() ** 2
            model["w"][used] -= rate * dw / np.sqrt(gw[used])
            model["v"][used] -= 0.5 * rate * dv / np.sqrt(gv[used])
            model["w0"] -= rate * err.sum() / np.sqrt(g0)
    return {"w0": float(model["w0"]), "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("_length").fill_null(0).to_numpy(zero_copy_only=False).astype(float)
        first = 0
        for n, off, number, value in features(batch.column("_text"), np.maximum(lengths, 0)):
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, t)) for x, t in ((number, pa.int32()), (value, pa.float32()))]
            yield pa.record_batch([batch.column("_y").slice(first, n), batch.column("_order").slice(first, n), *lists], names=["y", "at", "number", "value"])
            first += n


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, y, at = [], [], []
    for batch in batches:
        y += batch.column("y").to_pylist()
        at += batch.column("at").to_pylist()
        for a, b in zip(batch.column("number"), batch.column("value")):
            rows.append((a.values.to_numpy(), b.values.to_numpy()))
    order = np.lexsort((y, at))  # the same rows in the same order, however the shuffle delivers them
    model = fit([rows[i] for i in order], np.array(y, float)[order])
    yield pa.record_batch([pa.array([model.get("constant")], pa.float64()), pa.array([model.get("w0")], pa.float64()),
                           pa.array([model["w"].tobytes() if "w" in model else b""]), pa.array([model["v"].tobytes() if "v" in model else b""])], names=["constant", "w0", "w", "v"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", length: str = "n_chars", rows: int = TRAIN_ROWS) -> dict:
    """Weights learned from at most ``rows`` labelled rows, those whose id hash is lowest."""
    order = F.xxhash64(F.col(key).cast("string"))
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), order.alias("_order"))
    chosen = chosen.orderBy("_order", "_key", "_y").limit(rows)
    # At most ``rows`` short rows: a bounded broadcast.
    found = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(length).cast("double").alias("_length")).join(F.broadcast(chosen), "_key")
    made = found.select("_text", "_length", "_y", "_order").mapInArrow(_featurise, "y double, at long, number array<int>, value array<float>")
    out = made.repartition(1).mapInArrow(_train, "constant double, w0 double, w binary, v binary").first()
    if out is None:
        return {"constant": 0.5}
    if out["constant"] is not None:
        return {"constant": out["constant"]}
    return {"w0": out["w0"], "w": np.frombuffer(bytes(out["w"]), np.float32), "v": np.frombuffer(bytes(out["v"]), np.float32).reshape(N_FEATURES, FACTORS)}


def _score(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lengths = np.maximum(batch.column("_length").fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0)
            parts = []
            for n, off, number, value in features(batch.column("_text"), lengths):
                parts.append(np.full(n, model["constant"]) if "constant" in model else logistic(raw_scores(model, off, number, value.astype(np.float32)).astype(float)))
            yield pa.record_batch([*[batch.column(k) for k in keep], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*keep, "score"])

    return run


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: Column | None = None) -> DataFrame:
    """(*keep, score): the likelihood of label 1 for every row."""
    n_chars = F.col("n_chars") if length is None else length
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("_text"), n_chars.cast("double").alias("_length"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.drop("_text", "_length").withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(_score(shared, list(keep)), schema)


def _good(shared, threshold: float, text: str, length: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lengths = np.maximum(batch.column(length).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), 0)
            parts = [np.full(n, model["constant"]) if "constant" in model else logistic(raw_scores(model, off, number, value.astype(np.float32)).astype(float))
                     for n, off, number, value in features(batch.column(text), lengths)]
            yield batch.filter(pa.array(np.concatenate(parts) >= threshold if parts else np.zeros(0, bool)))

    return run


def keep_good(docs: DataFrame, model: dict, threshold: float, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns. Nothing is shuffled."""
    return docs.mapInArrow(_good(docs.sparkSession.sparkContext.broadcast(model), threshold, text, length), docs.schema)
