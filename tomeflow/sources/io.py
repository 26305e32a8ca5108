"""Reading and writing artifacts: corpora, manifests, versioned vectors, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text


def scan_index(spark: SparkSession, root: str, schema: StructType, glob: str = "*", fmt: str = "parquet") -> DataFrame:
    """Union of every matching file at any depth below ``root``, itself a folder, a file or a pattern of these. The schema is
    given, never inferred."""
    return spark.read.format(fmt).schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def scan_artifacts(spark: SparkSession, root: str, parts: dict[str, tuple[StructType, str]], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Several kinds of artifact under one root, each by its own schema and the pattern of its file or folder of files."""
    return {name: scan_index(spark, f"{root}/{pattern}", schema, fmt=fmt) for name, (schema, pattern) in parts.items()}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, subject) rows of a JSON manifest ``{"books": [...]}``."""
    schema = "books array<struct<file:string,title:string,subject:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("books"))


def with_manifest(rows: DataFrame, manifest: DataFrame, key: str = "file") -> DataFrame:
    """Rows with the manifest's columns; rows of unlisted files keep nulls. AQE broadcasts a manifest that is small."""
    return rows.join(manifest, key, "left")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(id, vector) as JSON lines in global id order, so the same vectors always give the same lines. The number of files
    follows the session's shuffle partitions and their sizes."""
    vectors.select("id", "vector").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    return spark.read.schema(f"id {id_type}, vector array<double>").json(path)


def replace_books(rows: DataFrame, path: str, book: str = "book_id") -> None:
    """Replace the stored rows of the books present in ``rows`` and leave all other books alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(book).parquet(path)


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], deletes: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Later rows win by key; then keys in ``deletes`` go. Picking the winner combines before the shuffle.

    Rows of one key in the same batch go by ``order``, and then, or without one, by all their values: the largest wins.
    """
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    at = F.struct("_b", *(order or []), *rest)
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("w")).select(*keys, "w.*")
    return out if deletes is None else out.join(deletes.select(*keys), keys, "left_anti")


def latest_states(log: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Last row per key of a processing log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("w")).select(*keys, "w.*")


def version_uses(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Distinct versions with their last use."""
    return log.groupBy(*keys).agg(F.max(at).alias("last_used"))


def content_version(texts: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """One row: twelve hex digits naming a set of (id, text) rows under a model.

    Each row's SHA-256 is cut into four numbers of 60 bits; their sums and the row count, which combine before the shuffle
    and do not depend on row order, make the version.
    """
    h = F.sha2(F.concat(F.col("id").cast("string"), F.lit("="), F.col("text")), 256)
    rows = texts.select(*[F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    sums = rows.agg(F.count("p0").alias("n"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select(F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[f"s{i}" for i in range(4)], F.lit(provider), F.lit(model), F.lit(str(dimension))), 256), 1, 12).alias("version"))


def write_version(vectors: DataFrame, root: str, version: str) -> str:
    """Write a version once; an existing one is left as it is. ``current`` points to it afterwards."""
    path = f"{root}/version={version}"
    vectors.write.mode("ignore").parquet(path)
    vectors.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}_current")
    return path


def load_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Vectors of a named version, or of the current one. Only that version's folder is read."""
    if version is None:
        version = spark.read.schema("version string").json(f"{root}_current").first()["version"]
    return spark.read.parquet(root).where(F.col("version") == version).drop("version")


def vector_checksum(txt: Column, provider: str, model: str, dimension: int) -> Column:
    return text.checksum(txt, F.lit(provider), F.lit(model), F.lit(str(dimension)))
