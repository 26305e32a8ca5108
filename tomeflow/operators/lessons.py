"""Lesson plans as table jobs: section availability, evidence, sufficiency, strategy and personalisation.

One row per query (or plan) holds a handful of sections, so their lists are folded inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.labels import first_match
from ..plans.scale import broadcast_if_small, fits, top_k
from .containment import contained_names

# Section kinds of each strategy, in order.
TEMPLATES = {
    "concept_explanation": ["main_explanation", "prerequisites", "formula", "worked_example", "related_concepts", "next_topics", "summary"],
    "formula_explanation": ["main_explanation", "formula", "worked_example", "related_concepts", "summary"],
    "worked_example_walkthrough": ["main_explanation", "worked_example", "formula", "exercise", "summary"],
    "compare_and_contrast": ["comparison", "related_concepts", "summary"],
    "step_by_step_derivation": ["main_explanation", "proof", "formula", "worked_example", "summary"],
    "revision_summary": ["main_explanation", "summary", "formula", "prerequisites", "next_topics"],
    "prerequisite_pathway": ["prerequisites", "next_topics", "related_concepts", "summary"],
}
# Strategies an intent may fall back to, in order.
FALLBACKS = {
    "definition": ["concept_explanation", "revision_summary"],
    "explanation": ["concept_explanation", "formula_explanation", "revision_summary"],
    "comparison": ["compare_and_contrast"],
    "prerequisite": ["prerequisite_pathway", "revision_summary"],
    "worked_example": ["worked_example_walkthrough", "concept_explanation"],
    "formula": ["formula_explanation", "concept_explanation"],
    "proof": ["step_by_step_derivation", "formula_explanation"],
    "application": ["worked_example_walkthrough", "concept_explanation"],
    "revision": ["revision_summary", "concept_explanation"],
}
# Sections a goal never shows, and goals that say so when evidence is thin.
BLOCKED = {
    "conceptual_understanding": [],
    "understand_principle": ["exercise", "comparison"],
    "exam_preparation": ["proof", "comparison"],
    "problem_solving": ["comparison", "proof"],
    "proof_and_derivation": ["worked_example", "comparison"],
    "quick_revision": ["comparison", "proof"],
    "learning_path": ["worked_example", "formula", "proof", "exercise", "comparison"],
    "structured_comparison": ["worked_example", "exercise", "proof"],
}
DISCLAIMED = ["understand_principle", "problem_solving", "proof_and_derivation", "learning_path", "structured_comparison"]
# Subjects a query may name, with the name they stand for.
NAMED_SUBJECTS = [("chemistry", "chemistry"), ("physics", "physics"), ("mathematics", "mathematics"), ("maths", "mathematics"),
                  ("math", "mathematics"), ("biology", "biology")]


def _table(values: dict[str, list[str]]) -> Column:
    arr = lambda v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), arr(v))])


def sections(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Per query: primary_id and the item count of every section kind, with ``supported`` kinds.

    ``docs`` carries definition_texts, example_texts, formula_latex, prerequisites, related_concepts, next_topics,
    aliases, name, n_proof and n_exercise (recoverable objects). Results are the top few of each query.
    """
    d = docs.select(
        "concept_id", F.struct(
            F.size("definition_texts").alias("defs"), F.size("example_texts").alias("ex"), F.size("formula_latex").alias("fm"),
            F.size("prerequisites").alias("pre"), F.size("related_concepts").alias("rel"), F.size("next_topics").alias("nxt"),
            "n_proof", "n_exercise", F.col("concept_id").cast("string").alias("id"), F.lower("name").alias("name"),
            F.transform("aliases", F.lower).alias("aliases")).alias("d"))
    # Few results meet many documents: these are not shuffled.
    r = d.join(broadcast_if_small(results.select("query_id", "rank", "concept_id")), "concept_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "concept_id", "d"))).alias("rs"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(0).alias("with_def"))

    def meet(acc: Column, x: Column) -> Column:
        again = F.array_contains(acc["seen"], x["d"]["id"]) | F.arrays_overlap(acc["seen"], x["d"]["aliases"])
        more = F.struct(
            F.concat(acc["seen"], F.array(x["d"]["id"], x["d"]["name"]), x["d"]["aliases"]).alias("seen"), (acc["n"] + 1).alias("n"),
            (acc["with_def"] + (x["d"]["defs"] > 0).cast("int")).alias("with_def"))
        return F.when(again, acc).otherwise(more)

    r = r.select("query_id", F.col("rs")[0].alias("p"), F.aggregate("rs", F.lit(0), lambda a, x: a + x["d"]["defs"]).alias("n_main"),
                 F.aggregate("rs", start, meet).alias("cmp"))
    counts = {
        "prerequisites": F.col("p.d.pre"), "related_concepts": F.col("p.d.rel"), "next_topics": F.col("p.d.nxt"),
        "main_explanation": F.col("n_main"), "formula": F.col("p.d.fm"), "worked_example": F.least(F.col("p.d.ex"), F.lit(2)),
        "proof": F.col("p.d.n_proof"), "exercise": F.col("p.d.n_exercise"),
        "comparison": F.when(F.col("cmp.n") >= 2, F.col("cmp.n")).otherwise(0), "summary": F.lit(1),
    }
    out = r.select("query_id", F.col("p.concept_id").alias("primary_id"), F.col("cmp.with_def").alias("n_compared"),
                   *[c.cast("int").alias(f"n_{k}") for k, c in counts.items()])
    kinds = F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in counts])
    return out.withColumn("supported", F.array_compact(kinds))


# Fixed value: chapter names up to this length are too common to tell what is asked.
LONGEST_VAGUE_CHAPTER = 3
# The fields items are cited from.
OBJECT_FIELD, CONCEPT_FIELD = "ir_object", "concept"
# Object types cited in a section.
OBJECTS_OF = {"theorem": "main_explanation", "property": "main_explanation", "proof": "proof", "exercise": "exercise"}
# Fixed value: examples cited for one concept.
MOST_EXAMPLES = 2


def _cited(kind: str, field: str, values: Column, of_concept: bool = True) -> Column:
    """Items of one list field; a name of the graph is cited without a concept id."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.when(F.lit(of_concept), F.col("concept_id")).alias("concept_id"), (F.col("name") if of_concept else x).alias("concept_name"),
        F.lit(field).alias("field"), i.cast("string").alias("locator"), x.alias("text")))


def section_items(results: DataFrame, docs: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, rank, concept_id, concept_name, field, locator, text): what each section of a query may cite.

    Items stay long: those of a section lie in the order of rank, then of the list they come from, then of its recovered
    objects. Definitions come from every result; names of the graph, formulas and the first examples from the best one;
    a comparison holds the first definition of each different concept, when there are two. ``objects``: (concept_id,
    object_id, type, text), from which theorems and properties explain, and proofs and exercises have sections of their own.
    """
    fields = ["name", "aliases", "definition_texts", "example_texts", "formula_latex", "prerequisites", "related_concepts", "next_topics"]
    # Few results meet many documents: texts stay where they are read.
    near = F.broadcast if fits(results) else lambda df: df
    r = docs.select("concept_id", *fields).join(near(results.select("query_id", "rank", "concept_id")), "concept_id")
    # Results that are the same concept by id, name or alias are met in order of rank; only keys are gathered, k a query.
    key = F.col("concept_id").cast("string")
    keys = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", key.alias("id"), F.lower("name").alias("name"), F.transform("aliases", F.lower).alias("aliases")))).alias("rs"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{dict(results.dtypes)['rank']}>").alias("ranks"))

    def meet(acc: Column, x: Column) -> Column:
        again = F.array_contains(acc["seen"], x["id"]) | F.coalesce(F.arrays_overlap(acc["seen"], x["aliases"]), F.lit(False))
        return F.when(again, acc).otherwise(F.struct(
            F.concat(acc["seen"], F.array(x["id"], F.coalesce(x["name"], x["id"])), F.coalesce(x["aliases"], F.array().cast("array<string>"))).alias("seen"),
            F.array_append(acc["ranks"], x["rank"]).alias("ranks")))

    compared = keys.select("query_id", F.aggregate("rs", start, meet)["ranks"].alias("compared"))
    r = r.join(compared, "query_id")
    best, none = F.col("rank") == 1, F.col("definition_texts").isNull() | (F.size("definition_texts") == 0)
    whole = lambda kind, field, locator, text: F.array(F.struct(
        F.lit(kind).alias("kind"), F.col("concept_id").alias("concept_id"), F.col("name").alias("concept_name"), field.alias("field"), locator.alias("locator"), text.alias("text")))
    head = whole("comparison", F.when(none, F.lit(CONCEPT_FIELD)).otherwise("definition_texts"), F.when(none, key).otherwise("0"),
                 F.when(none, F.col("name")).otherwise(F.col("definition_texts")[0]))
    of_best = F.concat(
        _cited("prerequisites", "prerequisites", F.col("prerequisites"), False), _cited("related_concepts", "related_concepts", F.col("related_concepts"), False),
        _cited("next_topics", "next_topics", F.col("next_topics"), False), _cited("formula", "formula_latex", F.col("formula_latex")),
        _cited("worked_example", "example_texts", F.slice("example_texts", 1, MOST_EXAMPLES)), whole("summary", F.lit(CONCEPT_FIELD), key, F.col("name")))
    items = F.concat(
        _cited("main_explanation", "definition_texts", F.col("definition_texts")),
        F.when(best, of_best).otherwise(F.slice(of_best, 1, 0)),
        F.when((F.size("compared") >= 2) & F.array_contains("compared", F.col("rank")), head).otherwise(F.slice(head, 1, 0)))
    out = r.select("query_id", "rank", F.explode(items).alias("i")).select("query_id", "i.kind", "rank", "i.concept_id", "i.concept_name", "i.field", "i.locator", "i.text")
    if objects is None:
        return out
    kinds = F.create_map(*[F.lit(x) for pair in OBJECTS_OF.items() for x in pair])
    found = objects.select("concept_id", "object_id", kinds[F.col("type")].alias("kind"), "text").where("kind is not null")
    top = r.where(best).select("query_id", "rank", "concept_id", "name")
    return out.unionByName(found.join(near(top), "concept_id").select(
        "query_id", "kind", "rank", "concept_id", F.col("name").alias("concept_name"), F.lit(OBJECT_FIELD).alias("field"), F.col("object_id").cast("string").alias("locator"), "text"))


def _chapter_elsewhere(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """query_id of the queries that hold the name of a chapter of another subject than ``d_subject``."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    named = chapters.where(F.length("chapter") > LONGEST_VAGUE_CHAPTER).select(F.lower("chapter").alias("name"), low("subject").alias("of")).distinct()
    q = asked.select("query_id", F.lower("query").alias("txt"), low("d_subject").alias("d_subject"))
    held = contained_names(q, named.select("name"), [], ["query_id", "d_subject"])
    # Of a chapter that two subjects have, either may be another one: the smallest and the largest tell.
    ends = named.groupBy("name").agg(F.min("of").alias("lo"), F.max("of").alias("hi"))
    return held.join(ends, "name").where("lo != d_subject or hi != d_subject").select("query_id").distinct()


def evidence(queries: DataFrame, results: DataFrame, docs: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(query_id, supported, verdict): the first failed check per query, ``ok`` without one.

    Checks in order: results, hollow top document, word overlap (waived when the document has content), example or
    formula asked for, subject named in the query, chapter of another subject named in the query (with ``chapters``:
    chapter, subject).
    """
    key = lambda c: text.content_tokens(c)
    body = F.array_join(F.concat(F.array("name"), "definition_texts", "example_texts"), " ")
    # Only the documents on top are tokenised.
    top = docs.join(broadcast_if_small(results.where("rank = 1").select("query_id", "concept_id")), "concept_id").select(
        "query_id", "concept_id", F.lower("subject").alias("d_subject"), F.size("definition_texts").alias("n_def"), F.size("example_texts").alias("n_ex"),
        F.size("formula_latex").alias("n_fm"), key(body).alias("doc_tokens"))
    j = queries.join(top, "query_id", "left").withColumn("q_tokens", key(F.col("query")))
    j = j.withColumn("overlap", F.arrays_overlap("q_tokens", "doc_tokens") | (F.size("q_tokens") == 0))
    low = F.lower("query")
    named = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{w}\b"), F.lit(s)) for w, s in NAMED_SUBJECTS]))
    j = j.withColumn("named", named).withColumn("elsewhere", F.lit(False))
    if chapters is not None:
        other = _chapter_elsewhere(j.where("concept_id is not null").select("query_id", "query", "d_subject"), chapters)
        j = j.drop("elsewhere").join(other.withColumn("elsewhere", F.lit(True)), "query_id", "left")
    verdict = first_match([
        ("no_results", F.col("concept_id").isNull()),
        ("hollow", F.col("n_def") + F.col("n_ex") + F.col("n_fm") == 0),
        ("no_overlap", ~F.col("overlap") & (F.col("n_def") + F.col("n_ex") == 0)),
        ("no_examples", (F.col("intent") == "worked_example") & (F.col("n_ex") == 0)),
        ("no_formulas", (F.col("intent") == "formula") & (F.col("n_fm") == 0)),
        ("other_subject", (F.size("named") > 0) & ~F.array_contains("named", F.col("d_subject"))),
        ("other_chapter", F.coalesce("elsewhere", F.lit(False))),
    ], "ok")
    return j.select("query_id", verdict.alias("verdict")).withColumn("supported", F.col("verdict") == "ok")


def sufficiency(planned: DataFrame) -> DataFrame:
    """Add sufficiency (supported, partial, insufficient) of the sections for the goal."""
    has = lambda k: F.array_contains("supported", F.lit(k))
    g = F.col("goal")
    three = lambda full, part: F.when(full, "supported").when(part, "partial").otherwise("insufficient")
    main = has("main_explanation")
    return planned.withColumn("sufficiency", (
        F.when(g == "understand_principle", F.when(~main, "insufficient").when(has("related_concepts") | has("formula") | has("worked_example"), "supported").otherwise("partial"))
        .when(g == "structured_comparison", three(F.col("n_compared") >= 2, (F.col("n_compared") == 1) | main))
        .when(g == "learning_path", three(has("next_topics"), has("prerequisites") | has("related_concepts")))
        .when(g == "problem_solving", three(has("worked_example"), main | has("formula")))
        .when(g == "proof_and_derivation", three(has("proof"), has("formula")))
        .when(g == "quick_revision", "supported").otherwise(F.when(main, "supported").otherwise("partial"))))


def lesson_plans(judged: DataFrame) -> DataFrame:
    """Add chosen strategy, whether it is a fallback, and the ordered sections with status.

    The goal's strategy stays when its lead section has content; else the intent's first permitted strategy whose
    lead has content. Blocked sections stay as empty slots. Thin evidence puts a disclaimer first, and empties the
    lead when it is insufficient (or only partial for comparisons).
    """
    templates, blocked, fallbacks = _table(TEMPLATES), _table(BLOCKED), _table(FALLBACKS)
    base = F.col("strategy")
    out = judged.withColumn("_b", F.coalesce(F.try_element_at(blocked, F.col("goal")), F.array().cast("array<string>")))
    lead = lambda s: F.try_element_at(F.filter(F.element_at(templates, s), lambda k: ~F.array_contains("_b", k)), F.lit(1))
    out = out.withColumn("_lead", lead(base))
    options = F.filter(F.try_element_at(fallbacks, F.col("intent")), lambda c: (c != base) & F.array_contains("supported", F.element_at(templates, c)[0]))
    kept = F.col("_lead").isNull() | F.array_contains("supported", F.col("_lead"))
    chosen = F.when(F.col("scope") == "chapter_level", "revision_summary").when(kept, base).otherwise(F.coalesce(F.try_element_at(options, F.lit(1)), base))
    out = out.withColumn("chosen", chosen).withColumn("is_fallback", F.col("chosen") != base)
    thin = (F.col("sufficiency") != "supported") & F.col("goal").isin(DISCLAIMED)
    hard = thin & ((F.col("sufficiency") == "insufficient") | (F.col("goal") == "structured_comparison"))
    out = out.withColumn("_hard", hard).withColumn("_lead2", lead(F.col("chosen")))
    emptied = lambda k: F.array_contains("_b", k) | (F.col("_hard") & ((k == F.col("_lead2")) | ((F.col("goal") == "structured_comparison") & (k == "main_explanation"))))
    slots = F.transform(F.element_at(templates, F.col("chosen")), lambda k: F.struct(
        k.alias("kind"), F.when(emptied(k) | ~F.array_contains("supported", k), "empty").otherwise("present").alias("status")))
    note = F.array(F.struct(F.lit("grounded_facts").alias("kind"), F.lit("present").alias("status")))
    out = out.withColumn("sections", F.when(thin, F.concat(note, slots)).otherwise(slots))
    return out.drop("_b", "_lead", "_lead2", "_hard")


def results_for_plans(scored: DataFrame, profiled: DataFrame, docs: DataFrame) -> DataFrame:
    """Per-query depth and subject filter: 15 for a chapter, 10 for revision, 5 otherwise; subject only when named."""
    k = first_match([(15, F.col("scope") == "chapter_level"), (5, F.col("scope") == "multi_concept"), (10, F.col("intent") == "revision")], 5)
    q = profiled.select("query_id", k.alias("k"), F.col("subject").alias("q_subject"))
    s = scored.join(q, "query_id").join(docs.select("concept_id", "subject"), "concept_id")
    s = s.where(F.col("q_subject").isNull() | (F.col("q_subject") == F.col("subject")))
    ranked = top_k(s, ["query_id"], [F.col("score").desc(), F.col("sort_name"), F.col("concept_id")], 15)
    return ranked.where(F.col("rank") <= F.col("k")).select("query_id", "rank", "concept_id", "score")


# --- personalisation -----------------------------------------------------------------------------------------------
LOW_MASTERY = 0.3
HIGH_MASTERY = 0.8


def personal_rules() -> list[tuple[str, int, str, Column, str, str, str]]:
    """(rule, priority, axis, condition, action, operation, section), in declaration order.

    Conditions read mastery, state, has_gaps, misconception, sections and the preference columns.
    """
    low = F.col("mastery") < LOW_MASTERY
    high = F.col("mastery") >= HIGH_MASTERY
    pref = lambda c, v: F.col(f"pref_{c}") == v
    return [
        ("prereq_gap_review", 10, "prereq", F.col("has_gaps") & F.array_contains("sections", F.lit("prerequisites")), "insert_prerequisite_review", "front", "prerequisites"),
        ("forgotten_recommend_revision", 20, "review", F.col("state").isin("forgotten", "needs_review"), "recommend_revision", "front", "summary"),
        ("misconception_review", 25, "review", F.col("misconception"), "recommend_revision", "front", "main_explanation"),
        ("low_mastery_lower_difficulty", 30, "difficulty", low | pref("difficulty", "easy"), "lower_difficulty", "suppress", "proof"),
        ("challenging_raise_difficulty", 30, "difficulty", pref("difficulty", "challenging") | high, "raise_difficulty", "front", "proof"),
        ("low_mastery_more_examples", 40, "examples", low | pref("example", "many"), "increase_worked_examples", "front", "worked_example"),
        ("few_examples_deemphasize", 45, "examples", pref("example", "few"), "adjust_emphasis", "none", ""),
        ("high_mastery_condense", 50, "depth:main", high | pref("pace", "fast"), "adjust_depth", "back", "prerequisites"),
        ("detailed_pref_expand", 55, "depth:main", pref("explanation", "detailed"), "adjust_depth", "none", ""),
        ("concise_pref_condense", 55, "depth:main", pref("explanation", "concise"), "adjust_depth", "none", ""),
    ]


def fired_rules(plans: DataFrame, rules: list | None = None) -> DataFrame:
    """Add fired: the rules that hold, by priority then declaration, as structs."""
    rows = [F.when(cond, F.struct(F.lit(p).alias("priority"), F.lit(i).alias("seq"), F.lit(axis).alias("axis"), F.lit(name).alias("rule"),
                                  F.lit(action).alias("action"), F.lit(op).alias("op"), F.lit(sec).alias("section")))
            for i, (name, p, axis, cond, action, op, sec) in enumerate(rules or personal_rules())]
    return plans.withColumn("fired", F.array_sort(F.array_compact(F.array(*rows))))


def one_per_axis(fired: DataFrame) -> DataFrame:
    """Split fired into applied (first of each axis) and skipped."""
    first = lambda arr: F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, F.lit(1), i), lambda y: y["axis"] == x["axis"]))
    out = fired.withColumn("applied", first(F.col("fired")))
    return out.withColumn("skipped", F.array_except("fired", "applied"))


def apply_operations(sections: Column, ops: Column) -> Column:
    """Section list after moving to front or back, or suppressing, in order; absent sections change nothing."""
    def step(acc: Column, o: Column) -> Column:
        k = o["section"]
        one = F.array(k)
        rest = F.array_remove(acc, k)
        return (
            F.when(~F.array_contains(acc, k), acc).when(o["op"] == "suppress", rest)
            .when(o["op"] == "front", F.concat(one, rest)).when(o["op"] == "back", F.concat(rest, one)).otherwise(acc))

    return F.aggregate(ops, sections, step)


def personalised(plans: DataFrame, rules: list | None = None) -> DataFrame:
    out = one_per_axis(fired_rules(plans, rules))
    return out.withColumn("new_sections", apply_operations(F.col("sections"), F.col("applied")))


def personal_case_checks(done: DataFrame) -> DataFrame:
    """Add decision_ok, priority_ok and invariants_ok against expected_actions, expected_suppressed and expected_front."""
    actions = F.transform("applied", lambda x: x["action"])
    prios = F.transform("applied", lambda x: x["priority"])
    return done.select(
        "*", (F.size(F.array_except("expected_actions", actions)) == 0).alias("decision_ok"), (prios == F.array_sort(prios)).alias("priority_ok"),
        ((F.size(F.array_except("new_sections", "sections")) == 0) & ~F.arrays_overlap("new_sections", "expected_suppressed")
         & (F.slice("new_sections", F.lit(1), F.size("expected_front")) == F.col("expected_front"))).alias("invariants_ok"))


