"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Native only. Every document gets an exponential key -ln(u) / weight, where u comes from a hash of its id, or of its text
where it has none, so reruns agree.
A source's target is met by complete epochs over all its documents first; the rest is filled by its documents in key order
up to the token budget, a prefix sum over blocks of keys, so that a source holding a third of all rows is still split. What
that leaves is one cut-off per source: each row then decides for itself, and texts are never shuffled.

Defined cases: null sources form one source, last in order; a null text has size 0; non-positive or null weights count as the
smallest weight; rows of one source with equal id and text are counted before they are ordered, and as many of them are taken
as fit; a source of size 0 has target 0; an empty table gives no rows; other columns of the input pass through, but for those
named like an output column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import running
from .storage import cut_lineage, free_name, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
LEAST_WEIGHT = 1e-3
BLOCK_ROWS = 50_000
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.05 as markup-like symbols come near one in five characters."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(raw)
    share = (n - F.length(F.translate(raw, "#*$%&|<>", ""))).cast("double") / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - 5.0 * share)


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key's text: 48 bits and a half."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source_key, source, source_size, target) from (source_key, source, source_size).

    Sources in order weigh ``weights``, repeating, and share ``share`` of all sizes. A target stops at ``most`` times its
    source's size and the excess is shared again by weight. That fixed point is found at once: with sources in order of
    cap per weight, the level is what is left over after the capped ones, per weight of the rest. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))).withColumn("_cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_rest"))
    )
    # The first source whose cap is not reached fixes the level for all after it.
    fixed = levels.withColumn("_fixed", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_level").alias("level")))).over(everything)["level"])
    return fixed.select("source_key", "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_fixed") * F.col("_w"), F.col("_cap"))).alias("target"))


class _Names:
    """Names for working columns that no column of the input has."""

    def __init__(self, columns: list[str]):
        self.key, self.source_key, self.size, self.draw, self.tie, self.row, self.number = (
            free_name(columns, c) for c in ("_key", "_source_key", "_size", "_draw", "_tie", "_row", "_number"))

    @property
    def group(self) -> list[str]:
        """Rows equal in these are told apart by nothing that the mixture sees."""
        return [self.source_key, self.draw, self.key, self.size, self.tie]


def _drawn(df: DataFrame, names: _Names, size: Column, weight: Column, key: str, source: str, text: str) -> DataFrame:
    """``df`` with its key, size, source key, exponential key and the hash of its text, which breaks ties."""
    w = F.greatest(F.coalesce(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    tie = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))
    id_, of = F.col(f"`{key}`"), F.col(f"`{source}`")
    return df.select(
        "*", id_.alias(names.key), F.coalesce(size, F.lit(0)).cast("long").alias(names.size), tie.alias(names.tie),
        F.concat(F.when(of.isNull(), "n").otherwise("s"), F.coalesce(of.cast("string"), F.lit(""))).alias(names.source_key),
        (-F.log(uniform(F.coalesce(id_.cast("string"), tie))) / w).alias(names.draw),
    )


def cut_offs(drawn: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(_source_key, source_size, target, _epochs, _cut, _some) per source, from (_source_key, source, _draw, _key, _size, _tie).

    ``_cut`` is the first group of equal rows, in key order, that does not fit whole into what complete epochs leave of the
    target, where a row fits if half of it does; ``_some`` of its rows fit. Without such a group ``_cut`` is null.
    """
    group = ["_source_key", "_draw", "_key", "_size", "_tie"]
    rows = drawn.groupBy(*group).agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("_n"))
    rows = written(rows, "mixture-groups")
    per_source = rows.groupBy("_source_key").agg(F.first("source").alias("source"), F.sum(F.col("_size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    wanted = targets(per_source.withColumnRenamed("_source_key", "source_key"), weights, share, most).withColumnRenamed("source_key", "_source_key")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    wanted = wanted.join(per_source.select("_source_key", "_rows"), "_source_key").select("_source_key", "source_size", "target", "_rows", epochs.alias("_epochs"))
    wanted = cut_lineage(wanted)
    left = F.col("target") - F.col("_epochs") * F.col("source_size")
    few = wanted.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.drop("source").join(F.broadcast(wanted) if few else wanted, "_source_key").withColumn("_left", left)
    # Blocks that follow key order. Whatever the weights, a unit of the draw's logarithm holds at most 1/e of the groups,
    # so no block is expected to hold more than BLOCK_ROWS.
    block = F.floor(F.log("_draw") * F.ceil(F.col("_rows") / BLOCK_ROWS))
    summed = running(joined, ["_source_key"], ["_draw", "_key", "_size", "_tie"], {"_before": F.col("_size") * F.col("_n")}, block, inclusive=False)
    # The last row of a group starts where the others end.
    last = F.col("_before") + F.col("_size") * (F.col("_n") - 1)
    fit = F.when(F.col("_size") > 0, F.floor((F.col("_left") - F.col("_before") - F.col("_size") / 2) / F.col("_size")) + 1).otherwise(0)
    some = F.greatest(F.lit(0), F.least(fit, F.col("_n") - 1)).cast("long")
    over = F.when(last + F.col("_size") / 2 > F.col("_left"), F.struct("_draw", "_key", "_size", "_tie", some.alias("_some")))
    cuts = summed.groupBy("_source_key").agg(F.min(over).alias("_at"))
    cut = F.when(F.col("_at").isNotNull(), F.struct("_at._draw", "_at._key", "_at._size", "_at._tie"))
    return cut_lineage(wanted.join(cuts, "_source_key", "left").select("_source_key", "source_size", "target", "_epochs", cut.alias("_cut"), F.coalesce("_at._some", F.lit(0)).alias("_some")))


def mix(df: DataFrame, size: Column, weight: Column, key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: float = MOST_EPOCHS, wide: bool = False, text: str = "text") -> DataFrame:
    """The rows with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of the row.

    A source's target holds ``floor(target / source_size)`` complete epochs; the rest takes rows in key order until less
    than half of the next one fits, so a source's words miss its target by at most half of one row. With ``wide`` all
    other columns stay (clashing ones are replaced); else the key and the source only.
    """
    n = _Names(df.columns)
    made = _drawn(df, n, size, weight, key, source, text)
    narrow = written(made.select(F.col(n.source_key).alias("_source_key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(n.draw).alias("_draw"),
                                 F.col(n.key).alias("_key"), F.col(n.size).alias("_size"), F.col(n.tie).alias("_tie"), F.col(f"`{source}`").alias("_source")), "draws")
    cuts = cut_offs(narrow.drop("_source"), weights, share, most)
    if not wide:
        made = narrow.select(F.col("_key").alias(key), F.col("_source").alias(source), "_source_key", "_draw", "_key", "_size", "_tie")
        n = _Names([key, source])
    # One row per source: sent to the tasks if few.
    few = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    decided = cuts.select(F.struct("_source_key", "source_size", "target", "_epochs", "_cut", "_some").alias(n.row))
    of = lambda c: F.col(f"{n.row}.{c}")
    rows = made.join(F.broadcast(decided) if few else decided, F.col(n.source_key) == of("_source_key"))
    place = F.struct(F.col(n.draw).alias("_draw"), F.col(n.key).alias("_key"), F.col(n.size).alias("_size"), F.col(n.tie).alias("_tie"))
    outputs = ["size", "source_size", "target", "taken"]
    kept = [c for c in (df.columns if wide else [key, source]) if c.lower() not in outputs]

    def taking(some: DataFrame, picked: Column) -> DataFrame:
        taken = F.col(n.size) * (of("_epochs") + F.when(picked, 1).otherwise(0))
        return some.select(*[F.col(f"`{c}`") for c in kept], F.col(n.size).alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), taken.cast("long").alias("taken"))

    before = of("_cut").isNull() | (place < of("_cut"))
    if cuts.where("_some > 0").isEmpty():
        return taking(rows, before)
    # Of a group of equal rows at the cut, the first ``_some`` go: numbered by place in the table that is written here.
    parted = of("_cut").isNotNull() & place.eqNullSafe(of("_cut")) & (of("_some") > 0)
    equal = written(rows.where(parted).withColumn(n.number, F.monotonically_increasing_id()), "equal-rows")
    held = equal.select(F.col(n.source_key).alias("_of"), F.col(n.number).alias("_id"), F.struct("*").alias("_held"))
    at = free_name(equal.columns, "_at")
    numbered = running(held, ["_of"], ["_id"], {"_at": F.lit(1)}, F.shiftright("_id", 33)).select("_held.*", F.col("_at").alias(at))
    return taking(rows.where(~parted), before).unionByName(taking(numbered, F.col(at) <= of("_some")))
