"""Where the operators of this subpackage keep what they must write: the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.scale import cut_lineage, shared_folder

__all__ = ["cut_lineage", "shared_folder", "fresh_folder", "written", "free_name", "refuse"]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: column pruning works on it, lost executors cost one step.

    ``tasks``, worked out from the rows to expect, keeps a small table from being hundreds of near-empty files."""
    path = fresh_folder(df.sparkSession, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it; Spark does not tell capitals apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse(columns: list[str], name: str) -> None:
    """An output's name that a column has already is an error, not a guess."""
    if name.lower() in {c.lower() for c in columns}:
        raise ValueError(f"the table has a column {name} already")
