"""Labels of odd queries and objects against SQL, and how often a text is read for them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tomeflow.functions import labels

# Ids that are 11 modulo 12 have no cue put before them.
TEXTS = [
    "évs flux", "  what is charge 　", "", None, "   ", "tell me about ", "Solve\nthe following\nmatrix", "why\t", "MATHS and physics", "matrix charge", "matrix matrix charge",
    "acid ébase", "“quoted words” a = 5", "how does it work", "compare vs. contrast " * 500, "x" * 30000 + " summary", "caféprove that", "2 + 3",
]
ROWS = [(11 + 12 * i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]


LINES = [
    "Fig 1", "FIGURE 2.1é", "Table 3 " + "x" * 200, "Example 1", "Example 1st", "solution: x", "Whatever is called as", "it is said to be so", "Definitioné", "PROPERTY", "proof", "Note",
    "See Example 4", "See Example 4" + "x" * 200, "2.1 Title", "2.1 Calculate", "1 X", "ABCD EF", "ABCD explain", "Chapter Two", "chapter 3 " + "y" * 80, "UNIT 5 why", "Exercise 1.1",
    "Ans: 5", "Box 3", "　Proof 　", " ", "ÉABCD", "Intext Question", "is called　as", "means that", "électron refers to", "WHAT IS THIS", "3.1  What", "4 Äh", "ABC", "A-B-C-D",
]


@pytest.mark.parametrize("name", ["query_features", "query_intents", "question_types", "query_profiles", "line_types_by_text"])
def test_odd_queries_are_labelled_as_in_sql(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    # Lines of which every one comes without a head at some place, and null.
    rows = [(i, "\n".join(LINES[i:] + LINES[:i]), "en", "s", 1) for i in range(12)] + [(12, None, "en", "s", 1)] if name == "line_types_by_text" else ROWS
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).select(*cols).collect()) == want


def test_a_query_is_read_once_for_all_cues(spark):
    q = spark.createDataFrame(ROWS, "query_id long, query string, lang string, source string, n_chars int").select("query_id", "query")
    plan = labels.profile(q).drop("quoted", "n_words")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan
    assert labels.profile(q).columns == [
        "query_id", "query", "is_comparison", "is_definition", "is_explanation", "is_math", "is_quoted", "quoted", "n_words", "intent", "question_type", "type_rule",
        "goal", "strategy", "teaching_goal", "depth", "scope", "subject"]
