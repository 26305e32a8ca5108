"""Tables that are folders of files, and values on which Spark's functions and SQL's part."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_queries import norm
from tomeflow.functions import text
from tomeflow.operators import concepts as cp

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLANK = "\u00a0"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small documents and conversations in folders of three files; some lines end in blanks that are no space."""
    root = str(tmp_path_factory.mktemp("folders"))
    for name in ("documents", "conversations", "labels"):
        df = spark.read.parquet(f"{MIDDLE if name == 'conversations' else SMALL}/{name}.parquet")
        if name == "documents":
            df = df.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(f"a = x^2 \u2211{BLANK}\n{BLANK}b = \\\\frac 2 \u221a{BLANK}\n"), "text")).otherwise(F.col("text")))
        df.repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


def same_as_sql(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall())
    return sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect()) == want and want


@pytest.mark.parametrize("name", ["scan_index_files", "scan_artifacts", "streamed_session_expiry", "streamed_embedding_refresh",
                                  "math_fragments", "embedding_texts", "checksums"])
def test_folders_of_files_and_blank_ends(spark, folder, name):
    assert same_as_sql(spark, folder, name)


def test_labels_of_a_streamed_folder(spark, folder):
    assert entry.queries()["streamed_query_labels"](spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_rounds_as_sql(spark):
    row = spark.range(1).select(text.round_half_up(F.lit(23) / F.lit(320.0), 5).alias("a"), text.round_half_up(F.lit(-23) / F.lit(320.0), 5).alias("b"),
                                text.round_half_up(F.lit(1) / F.lit(64.0), 5).alias("c")).first()
    assert tuple(row) == tuple(duckdb.execute("SELECT round(23 / 320.0::DOUBLE, 5), round(-23 / 320.0::DOUBLE, 5), round(1 / 64.0::DOUBLE, 5)").fetchone())


def test_structural_parents_by_given_norms(spark):
    norm_, section = "topic y ycon", "topic y ycon"
    assert spark.range(1).select(text.canonical_name(F.lit(norm_))).first()[0] != norm_
    rows = [("b", "p", norm_, None, None), ("b", "c", "topic other", section, norm_)]
    c = spark.createDataFrame(rows, "book string, concept_id string, norm string, section string, section_norm string")
    c = c.withColumn("subsection", F.lit(None).cast("string")).withColumn("subsection_norm", F.lit(None).cast("string"))
    assert [tuple(r) for r in cp.structural_parents(c, ["book"]).collect()] == [("c", norm_)]
