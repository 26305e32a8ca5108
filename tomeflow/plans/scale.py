"""Physical care that Catalyst cannot infer: measured broadcasts, salts and blocked ordered scans."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 16


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Reads no more than that many plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table keeps the shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def hot_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, how: str = "inner",
             max_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join where one key of ``big`` may hold a large share of all rows.

    A measured small side is broadcast. Otherwise ``big`` is spread over ``salts`` sub-keys by a hash of
    ``spread`` (stable when a task is retried) and ``small`` is repeated once per sub-key.
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _ordered(cols: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in cols]


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], block: Column,
          inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """Add, for each name in ``values``, its last non-null value at or before the row.

    ``block`` must not fall along ``order``. Each (key, block) is scanned on its own; only one row per
    block goes through the second scan, so a key holding a large share of the rows is still split.
    With ``inclusive=False`` the row itself is left out; ``reverse=True`` looks ahead instead.
    """
    names = list(values)
    keys = list(keys)
    pos = _ordered(order, reverse)
    df = df.select("*", block.alias("_blk"), *[values[n].alias(f"_v_{n}") for n in names])
    here = Window.partitionBy(*keys, "_blk").orderBy(*pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    pick = F.min_by if reverse else F.max_by
    at = F.struct(*order)
    heads = df.groupBy(*keys, "_blk").agg(
        *[pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_h_{n}") for n in names]
    )
    blocks = Window.partitionBy(*keys).orderBy(*_ordered(["_blk"], reverse)).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*keys, "_blk", *[F.last(f"_h_{n}", ignorenulls=True).over(blocks).alias(f"_c_{n}") for n in names])
    out = df.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(here).alias(n) for n in names])
    out = out.join(carried, [*keys, "_blk"], "left")
    kept = [c for c in df.columns if c != "_blk" and not c.startswith("_v_")]
    return out.select(*kept, *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in names])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], block: Column,
            inclusive: bool = True) -> DataFrame:
    """Add running sums along ``order`` within ``keys``, scanned block by block like :func:`carry`."""
    names = list(sums)
    keys = list(keys)
    df = df.select("*", block.alias("_blk"), *[sums[n].alias(f"_v_{n}") for n in names])
    here = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = df.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_blk", *[F.sum(f"_t_{n}").over(blocks).alias(f"_c_{n}") for n in names])
    out = df.select("*", *[F.sum(f"_v_{n}").over(here).alias(n) for n in names])
    out = out.join(before, [*keys, "_blk"], "left")
    kept = [c for c in df.columns if c != "_blk" and not c.startswith("_v_")]
    zero = F.lit(0)
    return out.select(*kept, *[(F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in names])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark cuts each task to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked.where(F.col(rank) <= k)


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees: the session's ``spark.checkpoint.dir``.

    Only where none is set, and only on one machine (tests), is a fresh one made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise one step in the shared checkpoint folder, so that lost executors cost one step."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
