"""Lives and rates of keyed requests over whole logs: what a cache and a limiter would have answered, without replaying them.

Requests are (key, id, ts). Those of one key are in (ts, id) order; equal (key, id, ts) are one request; requests without a key or a time
are left out. A key that holds most requests is split: pointers are followed by equi-joins on (key, id), and rates are folded per
stretch between two idle windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import carry, cut_lineage, running

# Windows (or lives) per block of an ordered scan.
SPANS_PER_BLOCK = 64


def _block(span: int) -> Column:
    return F.floor(F.col("us") / (span * SPANS_PER_BLOCK))


def _requests(requests: DataFrame, span: int) -> DataFrame:
    """(key, id, us, idle): distinct requests, and whether the key had none for a whole span before."""
    r = requests.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).distinct()
    r = carry(r, ["key"], ["us", "id"], {"_prev": F.col("us")}, _block(span), inclusive=False)
    return r.select("key", "id", "us", (F.col("_prev").isNull() | (F.col("us") - F.col("_prev") >= span)).alias("idle"))


def first_in_life(requests: DataFrame, seconds: float) -> DataFrame:
    """(key, id, us, verdict): ``miss`` for requests not within ``seconds`` of the last miss of their key, ``hit`` for others.

    Hits do not prolong a life, so the misses of a key are a chain: each is the first request at or after the end of the life before. That
    successor is found for every request by one forward as-of scan. Requests after an idle life begin a chain of their own; all
    chains are then followed at once by pointers that double, so rounds grow with the logarithm of the longest chain.
    """
    life = int(seconds * 1_000_000)
    r = cut_lineage(_requests(requests, life))
    at = F.struct("us", "id", "idle")
    rows = r.select("key", "id", "us", F.lit(1).alias("kind"), at.alias("here")).unionByName(
        r.select("key", "id", (F.col("us") + life).alias("us"), F.lit(0).alias("kind"), F.lit(None).cast(r.select(at.alias("s")).schema["s"].dataType).alias("here")))
    ahead = carry(rows, ["key"], ["us", "kind", "id"], {"ahead": F.col("here")}, _block(life), reverse=True)
    steps = ahead.where((F.col("kind") == 0) & F.col("ahead").isNotNull() & ~F.col("ahead.idle")).select("key", "id", F.col("us") - life, "ahead.id", "ahead.us")
    steps = cut_lineage(steps.toDF("key", "id", "us", "to_id", "to_us"))
    missed = r.where("idle").select("key", "id", "us")
    while not steps.isEmpty():
        # ``missed`` holds the first 2^k of each chain, ``steps`` leads 2^k further.
        further = missed.join(steps, ["key", "id", "us"]).select("key", F.col("to_id").alias("id"), F.col("to_us").alias("us"))
        missed = cut_lineage(missed.unionByName(further))
        onward = steps.select("key", F.col("id").alias("to_id"), F.col("us").alias("to_us"), F.col("to_id").alias("next_id"), F.col("to_us").alias("next_us"))
        steps = cut_lineage(steps.join(onward, ["key", "to_id", "to_us"]).select("key", "id", "us", F.col("next_id").alias("to_id"), F.col("next_us").alias("to_us")))
    flagged = r.join(missed.withColumn("_miss", F.lit(True)), ["key", "id", "us"], "left")
    return flagged.select("key", "id", "us", F.when(F.col("_miss"), "miss").otherwise("hit").alias("verdict"))


def _fold(limit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, times = None, deque()
        for batch in batches:
            verdicts, left = [], []
            for key, part, us in zip(*[batch.column(c).to_pylist() for c in ("key", "stretch", "us")]):
                if (key, part) != stretch:
                    stretch, times = (key, part), deque()
                while times and times[0] <= us - window:
                    times.popleft()
                accepted = len(times) < limit
                if accepted:
                    times.append(us)
                verdicts.append("accepted" if accepted else "rejected")
                left.append(limit - len(times))
            yield pa.record_batch([*[batch.column(c) for c in ("key", "id", "us")], pa.array(verdicts, pa.string()), pa.array(left, pa.int64())],
                                  names=["key", "id", "us", "verdict", "remaining"])

    return run


def rate_verdicts(requests: DataFrame, limit: int = 30, seconds: float = 60) -> DataFrame:
    """(key, id, us, verdict, remaining): at most ``limit`` accepted requests of a key in any trailing window, and how many more it had left.

    Refused requests leave no trace. What is accepted after a whole window without requests does not depend on anything before, so
    each stretch between two such pauses is folded on its own, from a sorted stream and with a queue of ``limit`` times.
    """
    window = int(seconds * 1_000_000)
    r = running(_requests(requests, window), ["key"], ["us", "id"], {"stretch": F.col("idle").cast("long")}, _block(window))
    schema = r.select("key", "id", "us").withColumn("verdict", F.lit("")).withColumn("remaining", F.lit(0).cast("long")).schema
    return r.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "us", "id").mapInArrow(_fold(limit, window), schema)
