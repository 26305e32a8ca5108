"""Token counts by an exact length histogram.

Each document is encoded whole by a byte-level BPE vocabulary (a file whose path is a parameter); documents are summed by
encoded length, and suffix sums over that histogram answer totals, quantiles and truncated totals for every context limit.

Defined cases: a null or empty text has 0 tokens; every row counts, equal rows too; an empty table has an empty histogram;
other columns are ignored; strings of special tokens are ordinary text. The vocabulary is sent to the tasks as bytes once
its size is checked, so executors need no copy of the file.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import running
from .storage import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20
# Fixed value: the splitting pattern that belongs to this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 512
_ENCODINGS: dict[int, object] = {}


def _encoding(raw: bytes):
    """The tokenizer, made once per Python worker."""
    key = hash(raw)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _count(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value)
        for batch in batches:
            lengths = [0 if t is None else len(enc.encode_ordinary(t)) for t in (x.as_py() for x in batch.column("_text"))]
            yield pa.record_batch([*[batch.column(k) for k in keep], pa.array(lengths, pa.int64())], names=[*keep, "n_tokens"])

    return run


def token_lengths(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """(*keep, n_tokens) of every row."""
    if os.path.getsize(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has over {VOCABULARY_BYTES} bytes")
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = rows.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_count(shared, list(keep)), schema)


def histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): rows per exact length, combined before the shuffle."""
    return lengths.groupBy(F.col(n_tokens).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per exact length L: documents and tokens at L or longer, tokens left when every document is cut at L, share of
    documents of length L or less. Sums run over blocks of lengths, so no task holds the whole histogram."""
    rows = cut_lineage(hist).withColumn("_neg", -F.col("n_tokens"))
    summed = running(rows, [], ["_neg"], {"docs_from": F.col("n_docs"), "tokens_from": F.col("n_docs") * F.col("n_tokens")}, F.floor(F.col("_neg") / BLOCK))
    total = rows.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")).first()
    docs, tokens = F.lit(total["docs"]).cast("long"), F.lit(total["tokens"]).cast("long")
    return summed.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (tokens - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        (tokens - F.col("tokens_from") + F.col("n_docs") * F.col("n_tokens")).alias("tokens_to"),
        ((docs - F.col("docs_from") + F.col("n_docs")) / docs).alias("docs_share_to"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least ``share`` of the documents do not exceed."""
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    return sums.select("n_tokens", "docs_share_to", at.alias("share")).where(F.col("docs_share_to") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens): tokens left when documents are cut at each limit: shorter ones whole, the limit for the rest."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    whole = F.when(F.col("n_tokens") <= F.col("context"), F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * F.col("context"))
    return sums.select("n_tokens", "n_docs", asked.alias("context")).groupBy("context").agg(F.sum(whole).alias("tokens"))
