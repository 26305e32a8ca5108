"""Labels of queries, turns and objects by ordered rules. The first rule that holds decides."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import cues, text
from ..plans.scale import BROADCAST_ROWS, broadcast_if_small


def first_match(rules: Iterable[tuple[object, Column]], default: object) -> Column:
    """Value of the first rule whose condition holds. Values may be Columns."""
    out = None
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    for value, condition in rules:
        out = F.when(condition, lit(value)) if out is None else out.when(condition, lit(value))
    return lit(default) if out is None else out.otherwise(lit(default))


def any_of(col: Column, phrases: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(col, F.lit(p))
    return out


def lookup(mapping: dict[str, str], key: Column, default: str | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


# --- queries -----------------------------------------------------------------------------------------
# Queries may be whole documents. Java's engine tries every word of an alternation at every word of the text; Arrow's (RE2, as
# in SQL) reads the text once for a pattern. So a query goes to Arrow once and comes back with a number for each pattern.
_SEEN = list(dict.fromkeys([
    cues.COMPARISON, cues.DEFINITION_LEAD, cues.EXPLANATION_LEAD, cues.MATH_SYMBOL, cues.MATH_TOKEN, cues.QUOTED, *[p for _, p in cues.INTENT_RULES],
    cues.SOLVE_OVERRIDE, cues.WORKED_EXAMPLE, cues.TYPE_COMPARISON, cues.TYPE_CLASSIFICATION, *[p for _, _, p in cues.QUESTION_TYPE_RULES],
    *[p for _, p in cues.GOAL_RULES], *[p for _, p in cues.DEPTH_RULES]]))
_NAMED = {n: rf"\b{n}\b" for n, _ in cues.SUBJECT_NAMES}
_SEEN_LOW = [*[p for _, p in cues.SCOPE_RULES], *_NAMED.values()]
_COUNTED_LOW = list(cues.SUBJECT_KEYWORDS.values())
_PLACE = {p: i for i, p in enumerate([*_SEEN, *_SEEN_LOW, *_COUNTED_LOW])}


@F.arrow_udf(ArrayType(IntegerType()))
def cue_counts(query: pa.Array) -> pa.Array:
    """One number per pattern: 1 where the query holds it, or for the last ones how often its lower-case form does. Null for null."""
    low = pc.utf8_lower(query)
    found = [pc.match_substring_regex(query, p) for p in _SEEN] + [pc.match_substring_regex(low, p) for p in _SEEN_LOW]
    found += [pc.count_substring_regex(low, p) for p in _COUNTED_LOW]
    numbers = [pc.fill_null(x.cast(pa.int32()), 0).to_numpy(zero_copy_only=False) for x in found]
    ends = pa.array(np.arange(len(query) + 1) * len(found), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.stack(numbers, 1).ravel(), pa.int32()), mask=query.is_null())


def _count(pattern: str) -> Column:
    return F.get("_cues", F.lit(_PLACE[pattern]))


def _has(pattern: str) -> Column:
    return _count(pattern) > 0


def _with_features(queries: DataFrame) -> DataFrame:
    """The features of queries, and the numbers that rules read (_cues)."""
    comparison = _has(cues.COMPARISON)
    q = F.col("_q")
    return queries.withColumn("_q", text.trim("query")).withColumn("_cues", cue_counts("_q")).select(
        *queries.columns, "_cues",
        comparison.alias("is_comparison"),
        (~comparison & _has(cues.DEFINITION_LEAD)).alias("is_definition"),
        (~comparison & _has(cues.EXPLANATION_LEAD)).alias("is_explanation"),
        (_has(cues.MATH_SYMBOL) | _has(cues.MATH_TOKEN)).alias("is_math"),
        _has(cues.QUOTED).alias("is_quoted"),
        F.regexp_extract_all(q, F.lit(cues.QUOTED), 1).alias("quoted"),
        F.when(q.isNotNull(), F.size(text.lookup_tokens(q))).alias("n_words"),
    )


def query_features(queries: DataFrame) -> DataFrame:
    """Add is_comparison, is_definition, is_explanation, is_math, is_quoted, quoted, n_words."""
    return _with_features(queries).drop("_cues")


def _intent() -> Column:
    rules = [("comparison", F.col("is_comparison"))]
    rules += [(name, _has(p)) for name, p in cues.INTENT_RULES]
    return first_match([*rules, ("explanation", F.col("is_explanation"))], "definition")


def _question_type() -> Column:
    """struct(type, rule)."""
    pair = lambda t, r: F.struct(F.lit(t).alias("type"), F.lit(r).alias("rule"))
    solves = (_has(cues.SOLVE_OVERRIDE) | _has(cues.WORKED_EXAMPLE)) & ~_has(cues.TYPE_COMPARISON) & ~_has(cues.TYPE_CLASSIFICATION)
    rules = [(pair("worked_example", "solve_override"), solves)]
    rules += [(pair(t, r), _has(p)) for t, r, p in cues.QUESTION_TYPE_RULES]
    return first_match(rules, pair("definition", "fallback"))


def _goal() -> Column:
    return first_match([(g, _has(p)) for g, p in cues.GOAL_RULES], lookup(cues.GOAL_BY_TYPE, F.col("question_type"), "conceptual_understanding"))


def _depth() -> Column:
    return first_match([(d, _has(p)) for d, p in cues.DEPTH_RULES], "medium")


def _scope() -> Column:
    rules = [(s, _has(p)) for s, p in cues.SCOPE_RULES]
    return first_match([*rules, ("chapter_level", F.col("intent") == "revision")], "single_concept")


def _subject() -> Column:
    """Named subject, else the one with most keyword hits; null without hits or on a tie."""
    hits = {s: _count(p) for s, p in cues.SUBJECT_KEYWORDS.items()}
    rules = [(s, _has(_NAMED[name])) for name, s in cues.SUBJECT_NAMES]
    for s, n in hits.items():
        above = F.lit(True)
        for other, m in hits.items():
            if other != s:
                above = above & (n > m)
        rules.append((s, above))
    return first_match(rules, F.lit(None).cast("string"))


def profile(queries: DataFrame) -> DataFrame:
    """Add intent, question type and rule, goal, strategy, teaching goal, depth, scope and subject."""
    out = _with_features(queries).withColumn("intent", _intent())
    out = out.withColumn("qt", _question_type()).select("*", F.col("qt.type").alias("question_type"), F.col("qt.rule").alias("type_rule")).drop("qt")
    out = out.withColumn("goal", _goal())
    return out.select(
        "*", lookup(cues.STRATEGY_BY_GOAL, F.col("goal")).alias("strategy"),
        lookup(cues.TEACHING_GOAL_BY_INTENT, F.col("intent"), "introduce_concept").alias("teaching_goal"),
        _depth().alias("depth"), _scope().alias("scope"), _subject().alias("subject"),
    ).drop("_cues")


def exact_concepts(queries: DataFrame, docs: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, matched_concept): the query's words, or a quoted phrase's, are exactly a name's words.

    Names and aliases with the same words share one key; the first by document id gives the match.
    """
    names = docs.select("concept_id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "label"))
    names = names.withColumn("key", text.set_key(text.lookup_tokens(F.col("label")))).where("key <> ''")
    vocab = names.groupBy("key").agg(F.min_by("label", F.struct("concept_id", "pos")).alias("matched_concept"))
    asked = query_features(queries).select("query_id", F.posexplode(F.concat(F.array("query"), "quoted")).alias("pos", "part"))
    asked = asked.withColumn("key", text.set_key(text.lookup_tokens(F.col("part")))).where("key <> ''")
    hits = vocab.join(broadcast_if_small(asked.select("query_id", "pos", "key"), max_rows), "key")
    return hits.groupBy("query_id").agg(F.min_by("matched_concept", "pos").alias("matched_concept"))


def routing_flags(queries: DataFrame, docs: DataFrame) -> DataFrame:
    exact = exact_concepts(queries, docs)
    return query_features(queries).join(exact, "query_id", "left").withColumn("is_exact", F.col("matched_concept").isNotNull())


def route(flagged: DataFrame, rules: Iterable[tuple[str, Column, str]], default: str) -> DataFrame:
    """Add chosen_strategy and fired_rule by the first rule (name, condition, target) that holds."""
    pair = lambda t, r: F.struct(F.lit(t).alias("t"), F.lit(r).alias("r"))
    d = first_match([(pair(target, name), cond) for name, cond, target in rules], pair(default, "default"))
    return flagged.withColumn("_d", d).select("*", F.col("_d.t").alias("chosen_strategy"), F.col("_d.r").alias("fired_rule")).drop("_d")


def policy(name: str) -> tuple[list[tuple[str, Column, str]], str]:
    for n, rules, default in cues.ROUTING_POLICIES:
        if n == name:
            return [(r, F.col(flag), target) for r, flag, target in rules], default
    raise ValueError(f"unknown routing policy {name}")


# --- conversation turns --------------------------------------------------------------------------------
def follow_up(query: Column, active: Column) -> Column:
    """struct(rule, rewritten) of a follow-up turn given the session's active concept (may be null).

    A concept named in the turn wins over the active one.
    """
    q = F.lower(text.trim(query))
    named = text.trim(F.regexp_extract(q, cues.EXPLICIT_CONCEPT, 1))
    usable = (named != "") & ~F.split(named, r"\s+")[0].isin(cues.NOT_A_CONCEPT)
    concept = F.when(usable, named).otherwise(F.coalesce(active, F.lit("that concept")))
    pair = lambda r, t: F.struct(F.lit(r).alias("rule"), t.alias("rewritten"))
    computes = q.rlike(cues.FOLLOW_UP_OPERATION) & q.rlike(cues.FOLLOW_UP_NUMBER)
    rules = [(pair("computation", F.concat(F.lit("Solve this problem: "), query)), computes)]
    for name, pattern, phrases, (before, after) in cues.FOLLOW_UP_RULES:
        hit = q.isin(phrases) if phrases else F.lit(False)
        if pattern:
            hit = hit | q.rlike(pattern)
        rules.append((pair(name, F.concat(F.lit(before), concept, F.lit(after))), hit))
    opens = F.lit(False)
    for w in cues.QUESTION_OPENERS:
        opens = opens | q.startswith(w)
    n_words = F.size(F.filter(F.split(text.trim(query), r"\s+"), lambda w: w != ""))
    short = active.isNotNull() & (n_words <= 4) & ~opens
    rules.append((pair("short_query", F.concat(query, F.lit(" about "), active)), short))
    return first_match(rules, pair("none", query))


def replace_pronouns(query: Column, concept: Column) -> Column:
    """Put ``concept`` in place of pronouns and vague references."""
    out = query
    for phrase in [*cues.PRONOUNS, *cues.VAGUE_REFERENCES]:
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{phrase}\b"), concept)
    return out


def off_topic(query: Column) -> Column:
    return any_of(F.lower(query), cues.OFF_TOPIC)


def refusal(answer: Column) -> Column:
    return any_of(F.lower(answer), cues.REFUSALS)


def cache_key(query: Column, subject_: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(text.trim(query)), F.lit("|"), F.coalesce(subject_, F.lit(""))), 256), 1, 16)


# --- objects ---------------------------------------------------------------------------------------------
# Types by own text, in the order in which they are tried.
_OWN_TYPES = ["paragraph", *[name for name, _, _ in cues.OBJECT_RULES], "heading"]
_NOT_A_HEADING = f"^(?:{'|'.join(cues.NOT_A_HEADING)})"


@F.arrow_udf(IntegerType())
def own_type_number(t: pa.Array) -> pa.Array:
    """Place in ``_OWN_TYPES`` of the first rule that holds for a trimmed text, null when none does."""
    size = pc.fill_null(pc.utf8_length(t), 0).to_numpy(zero_copy_only=False)
    holds = lambda texts, p: pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False)
    last = len(_OWN_TYPES) - 1
    found = np.full(len(t), -1, np.int32)
    titles = np.flatnonzero((size < cues.HEADING_MAX) & (holds(t, cues.HEADING) | holds(t, cues.CHAPTER_MARKER)))
    rest = pc.replace_substring_regex(pc.utf8_lower(t.take(pa.array(titles))), "^[^ ]* ", "", max_replacements=1)
    found[titles[~holds(rest, _NOT_A_HEADING)]] = last
    for i in range(last - 1, 0, -1):
        _, pattern, longest = cues.OBJECT_RULES[i - 1]
        hit = holds(t, pattern)
        found[hit & (size < longest) if longest else hit] = i
    found[(size == 0) & t.is_valid().to_numpy(zero_copy_only=False)] = 0
    return pa.array(found, pa.int32(), mask=found < 0)


def own_type(txt: Column) -> Column:
    """Type an object has by its own text; null when its context must decide. Blank text is a paragraph."""
    return F.get(F.array(*[F.lit(t) for t in _OWN_TYPES]), own_type_number(text.trim(txt)))


def defines(txt: Column) -> Column:
    """True for a paragraph that reads like a definition."""
    return txt.rlike(cues.DEFINITION_PARAGRAPH)


def real_formula(txt: Column) -> Column:
    return ~any_of(F.lower(text.trim(txt)), cues.FORMULA_NOISE) & (F.length(txt) >= 10) & any_of(txt, cues.FORMULA_SIGNS)


def math_fragments(txt: Column) -> Column:
    """Trimmed lines of a text that hold a mathematical sign."""
    return F.transform(F.filter(F.split(txt, "\n"), lambda x: any_of(x, cues.MATH_FRAGMENT_SIGNS)), text.trim)


def named_entity(txt: Column) -> Column:
    """struct(name, cue) of a concept named inside prose, null without one."""
    line = text.trim(F.split(txt, "\n")[0])
    called = text.trim(F.regexp_extract(line, cues.CALLED_IF, 1))
    defined = text.trim(F.regexp_replace(F.regexp_extract(line, cues.DEFINED_IF, 1), cues.DEFINED_IF_SUFFIX, ""))
    law = F.replace(text.trim(F.regexp_extract(line, cues.NAMED_LAW, 1)), F.lit("’"), F.lit("'"))
    pair = lambda n, c: F.struct(n.alias("name"), F.lit(c).alias("cue"))
    return (
        F.when(called != "", pair(called, "called_if"))
        .when(defined != "", pair(defined, "defined_if"))
        .when(law != "", pair(law, "named_law"))
    )


def heading_candidates(heading: Column) -> Column:
    """Names offered by a heading: itself, and its parts when it joins relations or functions by ``and``."""
    t = text.trim(heading)
    parts = F.filter(F.transform(F.split(t, r"(?i)\s+and\s+"), text.trim), lambda p: p != "")
    key_words = F.split(text.canonical_name(t), " ")
    splits = (
        ~F.contains(t, F.lit(",")) & ~t.endswith(".")
        & F.arrays_overlap(key_words, F.array(*[F.lit(w) for w in cues.COMPOSITE_WORDS]))
        & (F.size(parts) > 1)
        & F.forall(parts, lambda p: F.length(p) >= 3)
        & ~F.exists(parts, lambda p: text.canonical_name(p).isin(cues.COMPOSITE_WORDS))
    )
    return F.when(t == "", F.array().cast("array<string>")).when(splits, F.concat(F.array(t), parts)).otherwise(F.array(t))
