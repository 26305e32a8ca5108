"""Checks of produced text against its plan: coverage, citations, grounding, completeness and contract.

``units``: (plan_id, unit_id, pos, kind, lines array, citations array); ``rendered``: (plan_id, unit_id, pos, kind, text,
citations array). A plan is one answer: its sections fit in a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MIN_GROUNDING = 1.0
MIN_COMPLETENESS = 1.0
CITATION_MARK = r"\[.*?\] concept=.*? field=\S+ locator=\S+"


def _plan_lists(units: DataFrame, rendered: DataFrame, of_unit: Sequence[str] = (), of_rendered: Sequence[str] = ()) -> DataFrame:
    """(plan_id, us, rs): the sections of a plan in order, with the columns named and no others: no texts are gathered."""
    row = lambda df, name, extra: df.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", "unit_id", "kind", *extra))).alias(name))
    return row(units, "us", of_unit).join(row(rendered, "rs", of_rendered), "plan_id", "left")


def _kinds(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["kind"])


def coverage(units: DataFrame, rendered: DataFrame) -> DataFrame:
    """(plan_id, missing, extra, duplicated, order_preserved, coverage) with kinds as arrays."""
    p = _plan_lists(units, rendered)
    p = p.select("plan_id", _kinds("us").alias("e"), F.when(F.col("rs").isNull(), F.array().cast("array<string>")).otherwise(F.transform("rs", lambda x: x["kind"])).alias("r"))
    p = p.select("plan_id", "e", "r", F.array_except("e", "r").alias("missing"), F.array_except("r", "e").alias("extra"))
    again = F.filter("r", lambda k, i: F.array_contains(F.slice("r", F.lit(1), i), k))
    repeated = F.when(F.size(F.array_distinct("r")) == F.size("r"), F.array().cast("array<string>")).otherwise(again)
    in_both = lambda c, only: F.filter(c, lambda k: ~F.array_contains(only, k))
    return p.select(
        "plan_id", "missing", "extra", repeated.alias("duplicated"), (in_both("r", "extra") == in_both("e", "missing")).alias("order_preserved"),
        F.round(F.when(F.size("e") > 0, (F.size("e") - F.size("missing")) / F.size("e")).otherwise(1.0), 6).alias("coverage"))


def _met(units: DataFrame, rendered: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Every rendered unit beside the lines and citations (src) of the plan's unit, null where the plan knows none.

    The one step that shuffles texts: each is sent once, and all checks of a unit are made where the two have met.
    """
    j = rendered.join(units.select("plan_id", "unit_id", "lines", F.col("citations").alias("src")), ["plan_id", "unit_id"], "left")
    return j.join(queries, "plan_id", "left") if queries is not None else j.withColumn("query", F.lit(""))


def _words(met: DataFrame) -> DataFrame:
    """Add said, whole (the words with and without those of citation marks) and line_words, a list per line."""
    said = text.grounding_tokens(F.regexp_replace("text", CITATION_MARK, ""))
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    out = met.withColumn("said", said).withColumn("line_words", F.transform(lines, text.grounding_tokens))
    return out.withColumn("whole", F.when(F.col("text").rlike(CITATION_MARK), text.grounding_tokens(F.col("text"))).otherwise(F.col("said")))


def _times(listed: str, of: str) -> Column:
    """How many words of the list ``of``, repeats counted, are among the distinct words ``listed``: one pass over both, sorted."""
    mark = lambda c, flag: F.transform(c, lambda w: F.struct(w.alias("word"), F.lit(flag).alias("said")))
    step = lambda acc, x: F.struct(
        F.when(x["said"] == 0, x["word"]).otherwise(acc["word"]).alias("word"),
        (acc["n"] + F.when((x["said"] == 1) & (x["word"] == acc["word"]), 1).otherwise(0)).alias("n"))
    count = F.aggregate(F.sort_array(F.concat(mark(listed, 0), mark(of, 1))), F.struct(F.lit("").alias("word"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return F.when(F.size(listed) == 0, 0).otherwise(count)


def _unsupported(words: DataFrame) -> DataFrame:
    """Add unsupported: the distinct words said, in order, that neither the lines nor the heading nor the query have."""
    heading = F.replace("kind", F.lit("_"), F.lit(" "))
    return words.withColumn("unsupported", F.array_except("said", F.concat(F.flatten("line_words"), text.grounding_tokens(F.concat_ws(" ", heading, "query")))))


def _uncovered() -> Column:
    """Numbers of the lines that share no content word with the unit's text, though they have one."""
    numbered = F.transform("line_words", lambda ws, i: F.when((F.size(ws) > 0) & ~F.arrays_overlap(ws, "whole"), i))
    return F.array_compact(numbered)


def citation_changes(units: DataFrame, rendered: DataFrame) -> DataFrame:
    """(plan_id, unit_id, missing, extra, reordered) citations of every rendered unit that the plan knows."""
    u = units.select("plan_id", "unit_id", F.col("citations").alias("src"))
    j = rendered.select("plan_id", "unit_id", "pos", "citations").join(u, ["plan_id", "unit_id"])
    missing, extra, reordered = _cited()
    return j.select("plan_id", "unit_id", "pos", missing.alias("missing"), extra.alias("extra"), reordered.alias("reordered"))


def _cited() -> tuple[Column, Column, Column]:
    """Citations of the plan's unit (src) that the rendered one lacks, its own further ones, and whether they only changed places."""
    src, got = F.col("src"), F.col("citations")
    return F.array_except(src, got), F.array_except(got, src), (src != got) & (F.array_sort(src) == F.array_sort(got))


def grounding(units: DataFrame, rendered: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(plan_id, unit_id, pos, n_terms, supported, unsupported, coverage, grounded) of every rendered unit.

    Words may come from the unit's lines, its heading or the query. They meet inside the row, by hash and in sorted order, so a
    unit's cost grows with its length, not with its square, and no word is shuffled.
    """
    out = _unsupported(_words(_met(units, rendered, queries)))
    out = out.select("plan_id", "unit_id", "pos", F.size("said").alias("n_terms"), "unsupported", _times("unsupported", "said").alias("bad"))
    n, ok = F.col("n_terms"), F.col("n_terms") - F.col("bad")
    return out.select("plan_id", "unit_id", "pos", "n_terms", ok.alias("supported"), "unsupported",
                      F.round(F.when(n > 0, ok / n).otherwise(1.0), 6).alias("coverage"), (F.size("unsupported") == 0).alias("grounded"))


def completeness(units: DataFrame, rendered: DataFrame) -> DataFrame:
    """(plan_id, unit_id, pos, line_no, covered): a source line counts when it shares a content word or has none."""
    j = _words(_met(units, rendered)).withColumn("uncovered", _uncovered())
    lines = F.transform("line_words", lambda ws, i: ~F.array_contains("uncovered", i))
    return j.select("plan_id", "unit_id", "pos", F.posexplode(lines).alias("line_no", "covered"))


def contract(units: DataFrame, rendered: DataFrame) -> DataFrame:
    """(plan_id, nine booleans): no new, missing, repeated, reordered or empty sections; ids, kinds, citations unchanged."""
    told = rendered.withColumn("empty", text.trim("text") == "")
    p = _plan_lists(units, told, ["citations"], ["empty", "citations"]).where("rs IS NOT NULL")
    p = p.withColumn("e", F.transform("us", lambda x: x["kind"])).withColumn("r", F.transform("rs", lambda x: x["kind"]))
    unit_map = F.map_from_entries(F.transform("us", lambda x: F.struct(x["unit_id"], F.struct(x["kind"].alias("kind"), x["citations"].alias("citations")))))
    p = p.withColumn("um", unit_map)
    known = F.filter("rs", lambda x: F.map_contains_key(F.col("um"), x["unit_id"]))
    ids = lambda c: F.transform(c, lambda x: x["unit_id"])
    return p.select(
        "plan_id", (F.size(F.array_except("r", "e")) == 0).alias("no_new"), (F.size(F.array_except("e", "r")) == 0).alias("no_missing"),
        (F.size(F.array_distinct("r")) == F.size("r")).alias("no_duplicates"),
        (F.filter("r", lambda k: F.array_contains("e", k)) == F.col("e")).alias("no_reordered"),
        F.forall("rs", lambda x: ~x["empty"]).alias("no_empty"),
        (ids("us") == ids("rs")).alias("ids_unchanged"),
        F.forall(known, lambda x: F.element_at(F.col("um"), x["unit_id"])["kind"] == x["kind"]).alias("kinds_unchanged"),
        F.forall(known, lambda x: F.element_at(F.col("um"), x["unit_id"])["citations"] == x["citations"]).alias("citations_unchanged"))


# What a finding of each kind weighs, and the array that holds its details: of a plan, or of a rendered unit.
PLAN_FINDINGS = [("SECTION_MISSING", "error", "missing"), ("SECTION_EXTRA", "error", "extra"), ("SECTION_DUPLICATED", "error", "duplicated"), ("ORDER_CHANGED", "error", "changed")]
UNIT_FINDINGS = [("CITATION_MISSING", "error", "uncited"), ("CITATION_EXTRA", "error", "overcited"), ("CITATION_REORDERED", "warning", "moved"),
                 ("UNSUPPORTED_TERM", "warning", "unsupported"), ("CONTENT_MISSING", "error", "uncovered")]


def _blank_if(c: Column) -> Column:
    """One blank detail when ``c`` holds, else none."""
    return F.when(c, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))


def _plan_checks(units: DataFrame, rendered: DataFrame) -> DataFrame:
    """(plan_id, an array per kind of finding) of every plan."""
    return coverage(units, rendered).select("plan_id", "missing", "extra", "duplicated", _blank_if(~F.col("order_preserved")).alias("changed"))


def _unit_checks(units: DataFrame, rendered: DataFrame, queries: DataFrame | None) -> DataFrame:
    """(plan_id, unit_id, n_lines, an array per kind of finding) of every rendered unit: all its checks in one row."""
    uncited, overcited, moved = _cited()
    none = F.array().cast("array<string>")
    return _unsupported(_words(_met(units, rendered, queries))).select(
        "plan_id", "unit_id", F.size("line_words").alias("n_lines"), F.coalesce(uncited, none).alias("uncited"), F.coalesce(overcited, none).alias("overcited"),
        _blank_if(moved).alias("moved"), "unsupported", F.transform(_uncovered(), lambda i: i.cast("string")).alias("uncovered"))


def issues(units: DataFrame, rendered: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(plan_id, severity, code, unit_id, detail): every finding of every check as a row."""
    def rows(checks: DataFrame, kinds: list[tuple[str, str, str]], unit: Column) -> DataFrame:
        found = [F.transform(c, lambda x: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), x.alias("detail"))) for code, severity, c in kinds]  # noqa: B023
        return checks.select("plan_id", unit.alias("unit_id"), F.inline(F.concat(*found))).select("plan_id", "severity", "code", "unit_id", "detail")

    return rows(_plan_checks(units, rendered), PLAN_FINDINGS, F.lit("")).unionByName(rows(_unit_checks(units, rendered, queries), UNIT_FINDINGS, F.col("unit_id")))


def judged(units: DataFrame, rendered: DataFrame, queries: DataFrame | None = None, min_grounding: float = MIN_GROUNDING,
           min_completeness: float = MIN_COMPLETENESS) -> DataFrame:
    """(plan_id, n_errors, n_warnings, grounding, completeness, passed, codes): verdicts, with the codes raised.

    Findings are counted where they are made: a unit sends its counts to its plan, no finding is a row.
    """
    unit = _unit_checks(units, rendered, queries).groupBy("plan_id").agg(
        *[F.sum(F.size(c)).alias(code) for code, _, c in UNIT_FINDINGS], F.avg((F.size("unsupported") == 0).cast("int")).alias("g"), F.sum("n_lines").alias("n_lines"))
    out = _plan_checks(units, rendered).select("plan_id", *[F.size(c).cast("long").alias(code) for code, _, c in PLAN_FINDINGS]).join(unit, "plan_id", "left")
    kinds = [*PLAN_FINDINGS, *UNIT_FINDINGS]
    out = out.na.fill(0, [code for code, _, _ in UNIT_FINDINGS])
    total = lambda weight: reduce(add, [F.col(code) for code, severity, _ in kinds if severity == weight])
    whole = F.when(F.col("n_lines") > 0, (F.col("n_lines") - F.col("CONTENT_MISSING")) / F.col("n_lines"))
    out = out.select(
        "plan_id", total("error").alias("n_errors"), total("warning").alias("n_warnings"), F.coalesce(F.round("g", 6), F.lit(1.0)).alias("grounding"),
        F.coalesce(F.round(whole, 6), F.lit(1.0)).alias("completeness"), F.array_compact(F.array(*[F.when(F.col(code) > 0, code) for code, _, _ in kinds])).alias("codes"))
    passed = (F.col("n_errors") == 0) & (F.col("grounding") >= min_grounding) & (F.col("completeness") >= min_completeness)
    return out.select("plan_id", "n_errors", "n_warnings", "grounding", "completeness", passed.alias("passed"), "codes")


def verdicts(units: DataFrame, rendered: DataFrame, queries: DataFrame | None = None, min_grounding: float = MIN_GROUNDING,
             min_completeness: float = MIN_COMPLETENESS) -> DataFrame:
    """(plan_id, n_errors, n_warnings, grounding, completeness, passed)."""
    return judged(units, rendered, queries, min_grounding, min_completeness).drop("codes")


def tamper_rates(found: DataFrame, judged: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, n, verdict_accuracy, code_detection): ``expected``: (plan_id, case, code or null, expected_pass)."""
    raised = found.select("plan_id", "code").distinct().withColumn("hit", F.lit(1))
    j = expected.join(judged.select("plan_id", "passed"), "plan_id").join(raised, ["plan_id", "code"], "left")
    return j.groupBy("case").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("passed") == F.col("expected_pass")).cast("int")), 6).alias("verdict_accuracy"),
        F.round(F.avg((F.col("code").isNull() | F.col("hit").isNotNull()).cast("int")), 6).alias("code_detection"))


# --- citations -----------------------------------------------------------------------------------------------------
def invalid_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Cited concept ids that are not in the index or retrieved set."""
    return refs.where("concept_id IS NOT NULL").join(known.select("concept_id"), "concept_id", "left_anti")


def distinct_references(refs: DataFrame) -> DataFrame:
    """References once each at their first place; unresolved ones are dropped unless they name an object."""
    keep = refs.where("concept_id IS NOT NULL OR source_field = 'object'")
    return keep.groupBy("plan_id", "concept_id", "source_field", "locator", "object_type").agg(F.min("pos").alias("pos"))
