"""Cited items, the evidence gate, grounded answers and chapters by name, on hand-worked tables."""

import pytest
from pyspark.sql import functions as F
from tomeflow.functions import vocab
from tomeflow.operators import concepts as cp, learning as ln, lessons as ls, rerank as rr

DOC = ("concept_id string, name string, aliases array<string>, subject string, definition_texts array<string>, example_texts array<string>, "
       "formula_latex array<string>, prerequisites array<string>, related_concepts array<string>, next_topics array<string>")
DOCS = [
    ("m1", "Matrix", ["Array"], "mathematics", ["A table of numbers", "Rows and columns"], ["e0", "e1", "e2"], ["A=[a]"], ["Number"], [], ["Determinant"]),
    ("m2", "array", ["Grid"], "mathematics", ["The same thing"], [], [], ["Set"], [], []),
    ("d1", "Determinant", [], "mathematics", [], ["d0"], ["ad-bc"], [], [], []),
]
OBJECTS = [("m1", "o1", "theorem", "AB is not BA"), ("m1", "o2", "proof", "by example"), ("m1", "o3", "note", "aside"), ("d1", "o4", "exercise", "not of the best result")]


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, rank int, concept_id string")


def test_section_items(spark):
    d = spark.createDataFrame(DOCS, DOC)
    o = spark.createDataFrame(OBJECTS, "concept_id string, object_id string, type string, text string")
    got = ls.section_items(results(spark, (1, 1, "m1"), (1, 2, "m2"), (1, 3, "d1"), (2, 1, "d1")), d, o).where("query_id = 1").collect()
    kind = lambda k: sorted((r["rank"], r.field, r.locator, r.concept_id, r.concept_name, r.text) for r in got if r.kind == k)
    assert kind("prerequisites") == [(1, "prerequisites", "0", None, "Number", "Number")]
    assert kind("related_concepts") == [] and kind("exercise") == []
    assert kind("next_topics") == [(1, "next_topics", "0", None, "Determinant", "Determinant")]
    assert kind("main_explanation") == [
        (1, "definition_texts", "0", "m1", "Matrix", "A table of numbers"), (1, "definition_texts", "1", "m1", "Matrix", "Rows and columns"),
        (1, "ir_object", "o1", "m1", "Matrix", "AB is not BA"), (2, "definition_texts", "0", "m2", "array", "The same thing")]
    assert kind("formula") == [(1, "formula_latex", "0", "m1", "Matrix", "A=[a]")]
    assert [r[-1] for r in kind("worked_example")] == ["e0", "e1"]
    assert kind("proof") == [(1, "ir_object", "o2", "m1", "Matrix", "by example")]
    # "array" has an alias nobody has met, and its own name is not looked up: it counts as another concept.
    assert kind("comparison") == [(1, "definition_texts", "0", "m1", "Matrix", "A table of numbers"), (2, "definition_texts", "0", "m2", "array", "The same thing"),
                                  (3, "concept", "d1", "d1", "Determinant", "Determinant")]
    assert kind("summary") == [(1, "concept", "m1", "m1", "Matrix", "Matrix")]


def test_section_items_of_one_concept(spark):
    same = [("a", "Matrix", [], "s", ["x"], [], [], [], [], []), ("b", "Table", ["MATRIX"], "s", ["y"], [], [], [], [], []), ("c", "Odd", None, "s", None, None, None, None, None, None)]
    d = spark.createDataFrame(same, DOC)
    got = ls.section_items(results(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "gone")), d).collect()
    assert not [r for r in got if r.kind == "comparison"]
    assert sorted((r.kind, r.text) for r in got if r.query_id == 2) == [("summary", "Odd")]
    assert ls.section_items(results(spark), d).count() == 0


def test_chapter_of_another_subject(spark):
    d = spark.createDataFrame(DOCS, DOC)
    ask = [(1, "matrix in Electric Fields", "explanation"), (2, "matrix of gas", "explanation"), (3, "matrix in Algebra", "explanation"),
           (4, "matrix and Motion", "explanation"), (5, "physics of a matrix", "explanation"), (6, "electric fields", "explanation")]
    q = spark.createDataFrame(ask, "query_id int, query string, intent string")
    r = results(spark, *[(i, 1, "m1") for i in range(1, 6)])
    chapters = spark.createDataFrame([("Electric Fields", "physics"), ("Gas", "chemistry"), ("Algebra", "Mathematics"), ("Motion", "physics"), ("Motion", "mathematics"), (None, "physics")], "chapter string, subject string")
    got = {x.query_id: x.verdict for x in ls.evidence(q, r, d, chapters).collect()}
    # Three letters name no chapter; a chapter of both subjects is another one's too.
    assert got == {1: "other_chapter", 2: "ok", 3: "ok", 4: "other_chapter", 5: "other_subject", 6: "no_results"}
    assert {x.query_id: x.verdict for x in ls.evidence(q, r, d).collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "other_subject", 6: "no_results"}


def test_answers_are_grounded_by_taught_subjects(spark):
    rows = [(1, "matrix rows", ["matrix rows"], ["Matrix"], ["mathematics"]), (2, "matrix rows", ["matrix rows"], ["Matrix"], ["history"]),
            (3, "matrix rows", ["matrix rows"], ["Matrix"], ["history", "physics"]), (4, "matrix rows", ["matrix rows"], ["Matrix"], [None]), (5, "matrix rows", [], [], [])]
    a = spark.createDataFrame(rows, "id int, answer string, sources array<string>, source_names array<string>, source_subjects array<string>")
    assert vocab.TAUGHT_SUBJECTS == ["mathematics", "physics", "chemistry"]
    assert {r.id: r.grounded for r in ln.answer_overlap(a, [], vocab.TAUGHT_SUBJECTS).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_chapters_by_name(spark):
    index = spark.createDataFrame([("s", "Chapter 1", 3), ("s", "Chapter 12", 4), ("s", "On chapter 1", 5), ("z", "Chapter 2", 6)], "subject string, chapter string, concept_count int")
    asked = spark.createDataFrame([("s", "Chapter 12"), ("s", "chapter 1"), ("s", "Chapter 2"), ("z", "CHAP"), ("q", "Chapter 1"), ("s", "On")], "subject string, asked string")
    got = {(r.subject, r.asked): (r.chapter, r.concept_count) for r in cp.chapters_by_name(index, asked).collect()}
    assert got == {("s", "Chapter 12"): ("Chapter 12", 4), ("s", "chapter 1"): ("Chapter 1", 3), ("z", "CHAP"): ("Chapter 2", 6), ("s", "On"): ("On chapter 1", 5)}


@pytest.mark.parametrize("job", ["sections", "rerank", "best_examples"])
def test_few_results_meet_documents_where_they_are_read(spark, job):
    d = spark.createDataFrame(DOCS, DOC).select("*", F.col("subject").alias("chapter"), F.lit(1).alias("n_proof"), F.lit(0).alias("n_exercise"))
    r = results(spark, (1, 1, "m1"), (1, 2, "d1"), (2, 1, "d1"), (3, 1, "gone")).withColumn("score", 1.0 / F.col("rank"))
    q = spark.createDataFrame([(1, "what is a matrix", "definition", "introduce_concept"), (2, "find e0 and d0", "formula", "revise"), (3, "none", "proof", "revise")],
                              "query_id int, query string, intent string, teaching_goal string")
    run = {"sections": lambda: ls.sections(r, d), "rerank": lambda: rr.rerank(r, d, q), "best_examples": lambda: cp.best_examples(r, d, q)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = run[job]()._jdf.queryExecution().executedPlan().toString()
        found = run[job]().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # No document is shuffled to meet its results.
    assert "hashpartitioning(concept_id" not in plan and "BroadcastHashJoin [concept_id" in plan
    if job == "sections":
        assert sorted((x.query_id, x.primary_id, x.n_main_explanation, x.n_worked_example, x.n_comparison) for x in found) == [(1, "m1", 2, 2, 2), (2, "d1", 0, 1, 0)]
    elif job == "rerank":
        assert sorted((x.query_id, x.concept_id) for x in found) == [(1, "d1"), (1, "m1"), (2, "d1")]
