"""Checks of produced text on hand-worked units, and what they shuffle."""

from tomeflow.operators import verification as vf

UNIT = "plan_id int, unit_id string, pos int, kind string, lines array<string>, citations array<string>"
SAID = "plan_id int, unit_id string, pos int, kind string, text string, citations array<string>"
UNITS = [
    (1, "a", 0, "main_part", ["charge moves charge", "fields bend"], ["x", "y"]), (1, "b", 1, "proof", ["momentum"], ["z"]),
    (2, "c", 0, "summary", ["entropy grows"], []), (3, "d", 0, "proof", ["lone"], []),
]
RENDERED = [
    # The same unit told twice at one place: each telling is judged by itself.
    (1, "a", 0, "main_part", "charge charge ghost moves ghost [1] concept=ghost field=f locator=2", ["y", "x"]),
    (1, "a", 0, "main_part", "fields bend main", ["x", "w"]),
    (2, "c", 0, "summary", "entropy grows", []), (2, "q", 1, "odd", "entropy odd", ["x"]),
]


def tables(spark):
    return spark.createDataFrame(UNITS, UNIT), spark.createDataFrame(RENDERED, SAID)


def test_each_rendered_unit_is_judged_by_itself(spark):
    got = sorted((r.plan_id, r.unit_id, r.n_terms, r.supported, r.unsupported, r.coverage, r.grounded) for r in vf.grounding(*tables(spark)).collect())
    assert got == [(1, "a", 3, 3, [], 1.0, True), (1, "a", 5, 3, ["ghost"], 0.6, False), (2, "c", 2, 2, [], 1.0, True), (2, "q", 2, 1, ["entropy"], 0.5, False)]
    ask = spark.createDataFrame([(2, "of entropy")], "plan_id int, query string")
    assert {(r.unit_id, r.grounded) for r in vf.grounding(*tables(spark), ask).where("plan_id = 2").collect()} == {("c", True), ("q", True)}
    lines = sorted((r.plan_id, r.unit_id, r.line_no, r.covered) for r in vf.completeness(*tables(spark)).collect())
    assert lines == [(1, "a", 0, False), (1, "a", 0, True), (1, "a", 1, False), (1, "a", 1, True), (2, "c", 0, True)]


def test_verdicts_count_the_issues(spark):
    found = [tuple(r) for r in vf.issues(*tables(spark)).collect()]
    assert sorted(found) == sorted([
        (1, "error", "SECTION_MISSING", "", "proof"), (1, "error", "SECTION_DUPLICATED", "", "main_part"), (1, "error", "ORDER_CHANGED", "", ""),
        (1, "warning", "CITATION_REORDERED", "a", ""), (1, "warning", "UNSUPPORTED_TERM", "a", "ghost"), (1, "error", "CONTENT_MISSING", "a", "1"),
        (1, "error", "CITATION_MISSING", "a", "y"), (1, "error", "CITATION_EXTRA", "a", "w"), (1, "error", "CONTENT_MISSING", "a", "0"),
        (2, "error", "SECTION_EXTRA", "", "odd"), (2, "warning", "UNSUPPORTED_TERM", "q", "entropy"), (3, "error", "SECTION_MISSING", "", "proof")])
    got = {r.plan_id: tuple(r)[1:] for r in vf.verdicts(*tables(spark)).collect()}
    assert got == {1: (7, 2, 0.5, 0.5, False), 2: (1, 1, 0.5, 1.0, False), 3: (1, 0, 1.0, 1.0, False)}
    assert {r.plan_id: set(r.codes) for r in vf.judged(*tables(spark)).collect()} == {p: {f[2] for f in found if f[0] == p} for p in (1, 2, 3)}


def test_no_word_is_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {f.__name__: f(*tables(spark))._jdf.queryExecution().executedPlan().toString() for f in (vf.grounding, vf.issues, vf.verdicts)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("word#" in line for p in plans.values() for line in p.splitlines() if "Exchange" in line or "Generate" in line)
    # Texts meet once: units and rendered; plans: their lists, and once more the counts of a plan's units.
    assert [plans[n].count("Exchange hashpartitioning") for n in ("grounding", "issues", "verdicts")] == [2, 4, 5]
