import random

import __spark_entry__ as entry
from tomeflow.operators import containment as cn


def test_pieces_leave_a_task_only_as_hits(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeäß€") for _ in range(rnd.randint(1, 7)))
    texts = [(i % 2, i, " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(300)] + [(0, 300, None), (1, 301, "")]
    names = {(s, n) for s, _, t in texts[:200] if t for a in [rnd.randrange(len(t))] for n in (t[a:a + rnd.randint(1, 40)], t[a:a + 3])}
    df = spark.createDataFrame(texts, "scope int, id int, txt string")
    ns = spark.createDataFrame([*names, (0, None)], "scope int, name string")
    want = {(s, i, n) for s, i, t in texts if t is not None for s2, n in names if s == s2 and n in t}
    assert {tuple(r) for r in cn.contained_names(df, ns, ["scope"], ["id"]).collect()} == want
    held = cn.name_filter(ns.select("name").distinct())
    cut = df.selectExpr("id", "txt as _txt").mapInArrow(cn._cut(held), "id int, name string")
    either = {(i, n) for _, i, t in texts if t is not None for _, n in names if n in t}
    assert cut.count() < 1.02 * len(either) + 20


def test_empty_name_lies_in_every_text(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id int, txt string")
    names = spark.createDataFrame([("",), ("b",)], "name string")
    assert {tuple(r) for r in cn.contained_names(df, names, [], ["id"]).collect()} == {(1, ""), (1, "b"), (2, "")}
    assert cn.contained_names(df, names.where("name = 'zz'"), []).count() == 0


def test_only_runs_of_the_dictionary_leave_a_text(spark):
    texts = ["Ab cd, éf gh", "-ab cd ab", "zz", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "object_id int, text string").selectExpr(
        "object_id", r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+', 0) ps", r"lower(text) rlike '^[\\p{L}\\p{N}_]' opens")
    names = spark.createDataFrame([("ab cd", 3), ("éf", 1), ("cd, éf", 3), (" ab", 2)], "name string, n int")
    got = {tuple(r) for r in cn.held_runs(rows, names).collect()}
    assert got == {(0, 0, 3, "ab cd"), (0, 2, 3, "cd, éf"), (0, 4, 1, "éf"), (1, 1, 3, "ab cd")}


def test_documents_are_read_once(spark):
    for name in ("heading_tree", "reattributed_definitions"):  # from a stage that keeps what they need
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert "documents.parquet" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_few_results_meet_documents_without_a_shuffle_of_texts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large documents
    try:
        for name in ("section_items", "evidence_gate"):
            plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin [concept_id" in plan and "SortMergeJoin [concept_id" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_metrics_read_the_stored_results(spark):
    plan = entry.queries()["mean_retrieval_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_few_runs_pass_for_names_by_chance(spark):
    names = spark.range(40_000).selectExpr("concat('name of length ', sha1(cast(id as string))) as name", "7 as n")
    rows = spark.range(2_000).selectExpr("id as object_id", r"flatten(transform(sequence(1, 100), i -> array(sha1(concat(id, ':', i)), ' '))) as ps", "true as opens")
    chance = rows.unionByName(rows.selectExpr("object_id", "reverse(ps) as ps", "false as opens"))
    assert cn.held_runs(chance, names.unionByName(spark.createDataFrame([("one", 1)], "name string, n int"))).count() < 400
