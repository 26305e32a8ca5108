"""Names of odd and of long headings, and how often a name is worked out."""

from pyspark.sql import functions as F
from tomeflow.functions import text
from tomeflow.operators import concepts as cp

NAMES = {
    # raw: (canonical, shown)
    "e lectric c harge": ("electric charge", "electric charge"), "a b cd e": ("bcd e", "a bcd e"), "x y": ("x y", "x y"), "é lan É lan": ("élan", "élan"),
    "Force force FORCE field": ("force field", "Force field"), "Σas σας": ("σas", "Σas σας"), "Σ σας": ("σσας", "Σσας"), "ab 3d AB": ("ab 3d ab", "ab 3d AB"), "a1 2.5 of a": ("a1", "a1 of a"), "  ": ("", ""), "": ("", ""), "7.2 COULOMB LAW 12": ("coulomb law", "Coulomb Law"),
    "wave wave": ("wave", "wave"), "1 wave wave": ("wave", "wave"), "field of field": ("field", "field of field"),
}


def test_names_by_hand(spark):
    rows = spark.createDataFrame([(r,) for r in NAMES] + [(None,)], "raw string")
    got = {r.raw: (r.norm, r.shown) for r in rows.select("raw", text.canonical_name(F.col("raw")).alias("norm"), text.display_name(F.col("raw")).alias("shown")).collect()}
    assert got.pop(None) == (None, None)
    assert {k: v for k, v in got.items() if v != NAMES[k]} == {}


def test_a_line_of_many_words_costs_its_length(spark):
    # Copies of the words before each word were a square of the line's length: some hours of this line.
    line = " ".join(["a bc", "de", "de", "f"] * 100_000)
    row = spark.createDataFrame([(line,)], "raw string").select(text.canonical_name(F.col("raw")).alias("norm"), text.display_name(F.col("raw")).alias("shown")).first()
    assert row.shown == " ".join(["abc", "de", "f"] * 100_000) and len(row.norm) > 100_000


def test_a_name_is_worked_out_once(spark):
    raw = spark.createDataFrame([("Chapter 3 e lectric c harge", "c"), ("State that x", "c"), (None, "c")], "raw string, chapter string")
    named = cp.resolve_names(raw)
    assert [tuple(r) for r in named.collect()] == [("Chapter 3 e lectric c harge", "c", "electric charge", "electric charge"), ("State that x", "c", "state that x", "State that x")]
    assert named._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
