"""Driver queries for lesson plans, verification, cards and the remaining search reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, vocab
from ..operators import cards, concepts as cp, evaluation as ev, fusion, lessons as ls, objects as ob, rerank as rr, search, vectors, verification as vf
from .bindings import LINES_SQL, QUERIES_SQL, SEARCH_DOCS_SQL, case, pick, sql_case, sql_str, sql_tokens
from .label_queries import PROFILE_SQL
from .learning_queries import REPLAY_SQL, _final
from .registry import query
from .scale import cut_lineage
from .search_queries import BM25_SQL, RANKED_SQL


def _rich(t):
    i = F.col("concept_id")
    some = lambda n, *v: F.when(i % n == 0, F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>"))
    return t.search_docs().select(
        "*", some(3, "p").alias("prerequisites"), some(2, "r", "s").alias("related_concepts"), some(5, "n").alias("next_topics"), some(4, "F = ma").alias("formula_latex"),
        (i % 7 == 0).cast("int").alias("n_proof"), (i % 6 == 0).cast("int").alias("n_exercise"))


_N = {"prerequisites": "CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END", "related_concepts": "CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END", "next_topics": "CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END",
      "main_explanation": "n_main", "formula": "CASE WHEN p % 4 = 0 THEN 1 ELSE 0 END", "worked_example": "least(p_ex, 2)", "proof": "CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END",
      "exercise": "CASE WHEN p % 6 = 0 THEN 1 ELSE 0 END", "comparison": "CASE WHEN n_res >= 2 THEN n_res ELSE 0 END", "summary": "1"}
_PROFILES = PROFILE_SQL[PROFILE_SQL.index("features AS"):]
SECTIONS_SQL = f"""{RANKED_SQL}, {_PROFILES},
rs AS (SELECT query_id, rank, concept_id, len(definition_texts) AS defs, len(example_texts) AS ex FROM ranked JOIN search_docs USING (concept_id) WHERE rank <= 5),
ag AS (SELECT query_id, arg_min(concept_id, rank) AS p, arg_min(ex, rank) AS p_ex, sum(defs) AS n_main, count(*) AS n_res, count(*) FILTER (defs > 0) AS n_compared FROM rs GROUP BY 1),
sec AS (SELECT query_id, p AS primary_id, n_compared, {", ".join(f"CAST({v} AS INT) AS n_{k}" for k, v in _N.items())} FROM ag)"""
_COUNTS = ", ".join(f"n_{k}" for k in _N)


def _hits(t):
    return t.hits()


@query("section_availability", "V1", f"WITH {SECTIONS_SQL} SELECT query_id, primary_id, n_compared, {_COUNTS} FROM sec")
def _(t):
    return ls.sections(_hits(t), _rich(t)).select("query_id", "primary_id", "n_compared", *[f"n_{k}" for k in _N])


def _cite_sql(kind, field, values, best=True, own=True):
    """Items of one list of the results' documents."""
    return f"""SELECT query_id, '{kind}' AS kind, rank, {"concept_id" if own else "CAST(NULL AS BIGINT)"} AS concept_id, {"name" if own else "x"} AS concept_name, '{field}' AS field, CAST(i AS VARCHAR) AS locator, x AS text
   FROM (SELECT query_id, rank, concept_id, name, unnest({values}) AS x, unnest(range(len({values}))) AS i FROM hit{" WHERE rank = 1" if best else ""})"""


def _some(n, *v):
    return f"CASE WHEN concept_id % {n} = 0 THEN [{', '.join(sql_str(x) for x in v)}] ELSE []::VARCHAR[] END"


# Objects to recover: every line is one, its type chosen by (doc_id + line) modulo 12.
_OBJECT_TYPES = ["note", "", "theorem", "proof", "", "", "property", "exercise", "figure", "", "", ""]
_ALL_ITEMS = " UNION ALL ".join([
    _cite_sql("prerequisites", "prerequisites", _some(3, "p"), own=False), _cite_sql("related_concepts", "related_concepts", _some(2, "r", "s"), own=False),
    _cite_sql("next_topics", "next_topics", _some(5, "n"), own=False), _cite_sql("main_explanation", "definition_texts", "definition_texts", best=False),
    _cite_sql("formula", "formula_latex", _some(4, "F = ma")), _cite_sql("worked_example", "example_texts", "example_texts[1:2]"),
    "SELECT query_id, 'summary', rank, concept_id, name, 'concept', CAST(concept_id AS VARCHAR), name FROM hit WHERE rank = 1",
    """SELECT query_id, 'comparison', rank, concept_id, name, CASE WHEN len(definition_texts) = 0 THEN 'concept' ELSE 'definition_texts' END, CASE WHEN len(definition_texts) = 0 THEN CAST(concept_id AS VARCHAR) ELSE '0' END,
   CASE WHEN len(definition_texts) = 0 THEN name ELSE definition_texts[1] END FROM hit WHERE several""",
    f"""SELECT query_id, CASE type WHEN 'theorem' THEN 'main_explanation' WHEN 'property' THEN 'main_explanation' ELSE type END, rank, concept_id, name, 'ir_object', doc_id || ':' || pos, line
   FROM (SELECT *, {case("(doc_id + pos) % 12", _OBJECT_TYPES)} AS type FROM lines) JOIN hit ON doc_id = concept_id WHERE rank = 1 AND type IN ('theorem', 'property', 'proof', 'exercise')"""])


@query("section_items", "V1", f"""WITH {RANKED_SQL}, {LINES_SQL}, hit AS (SELECT query_id, rank, count(*) OVER (PARTITION BY query_id) >= 2 AS several, d.* FROM ranked JOIN search_docs d USING (concept_id) WHERE rank <= 5),
  items AS ({_ALL_ITEMS}) SELECT * FROM items""")
def _(t):
    kind = pick((F.col("doc_id") + F.col("pos")) % 12, _OBJECT_TYPES)
    objects = t.lines().select(F.col("doc_id").alias("concept_id"), F.concat_ws(":", "doc_id", "pos").alias("object_id"), kind.alias("type"), F.col("line").alias("text"))
    return ls.section_items(_hits(t), _rich(t), objects)


_QTOK = sql_tokens("query", vocab.SEARCH_STOP_WORDS, stem=True)
_BODY = sql_tokens("array_to_string(list_concat([name], definition_texts, example_texts), ' ')", vocab.SEARCH_STOP_WORDS, stem=True)
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(query), '\\b{w}\\b') THEN '{s}' END" for w, s in ls.NAMED_SUBJECTS) + "], lambda x: x IS NOT NULL)"


@query("evidence_gate", "V2", f"""WITH {RANKED_SQL}, {_PROFILES}, chapters AS (SELECT DISTINCT lower(string_split(name, ' ')[1]) AS name, lower(subject) AS subject FROM search_docs WHERE length(string_split(name, ' ')[1]) > 3),
  j AS (SELECT q.query_id, q.query, q.intent, d.concept_id, d.definition_texts, d.example_texts, d.subject, len(list_intersect({_QTOK}, {_BODY})) > 0 OR len({_QTOK}) = 0 AS overlap, {_NAMED} AS named,
      EXISTS (SELECT 1 FROM chapters c WHERE contains(lower(q.query), c.name) AND c.subject <> lower(d.subject)) AS elsewhere
     FROM profiles q LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (query_id) LEFT JOIN search_docs d ON d.concept_id = r.concept_id)
  SELECT query_id, CASE WHEN concept_id IS NULL THEN 'no_results' WHEN len(definition_texts) + len(example_texts) = 0 AND concept_id % 4 <> 0 THEN 'hollow' WHEN NOT overlap AND len(definition_texts) + len(example_texts) = 0 THEN 'no_overlap'
     WHEN intent = 'worked_example' AND len(example_texts) = 0 THEN 'no_examples' WHEN intent = 'formula' AND concept_id % 4 <> 0 THEN 'no_formulas' WHEN len(named) > 0 AND NOT list_contains(named, lower(subject)) THEN 'other_subject' WHEN elsewhere THEN 'other_chapter' ELSE 'ok' END AS verdict FROM j""")
def _(t):
    # A document's first word names its chapter.
    chapters = t.search_docs().select(F.split("name", " ")[0].alias("chapter"), "subject").distinct()
    return ls.evidence(labels.profile(t.queries()), _hits(t), _rich(t), chapters).select("query_id", "verdict")


def _judged(t):
    return ls.sufficiency(labels.profile(t.queries()).join(ls.sections(_hits(t), _rich(t)), "query_id"))


SUFFICIENT_SQL = f"""{SECTIONS_SQL},
jd AS (SELECT *, CASE goal WHEN 'understand_principle' THEN CASE WHEN n_main_explanation = 0 THEN 'insufficient' WHEN n_related_concepts + n_formula + n_worked_example > 0 THEN 'supported' ELSE 'partial' END
   WHEN 'structured_comparison' THEN CASE WHEN n_compared >= 2 THEN 'supported' WHEN n_compared = 1 OR n_main_explanation > 0 THEN 'partial' ELSE 'insufficient' END
   WHEN 'learning_path' THEN CASE WHEN n_next_topics > 0 THEN 'supported' WHEN n_prerequisites + n_related_concepts > 0 THEN 'partial' ELSE 'insufficient' END
   WHEN 'problem_solving' THEN CASE WHEN n_worked_example > 0 THEN 'supported' WHEN n_main_explanation + n_formula > 0 THEN 'partial' ELSE 'insufficient' END
   WHEN 'proof_and_derivation' THEN CASE WHEN n_proof > 0 THEN 'supported' WHEN n_formula > 0 THEN 'partial' ELSE 'insufficient' END
   WHEN 'quick_revision' THEN 'supported' ELSE CASE WHEN n_main_explanation > 0 THEN 'supported' ELSE 'partial' END END AS sufficiency,
   list_filter([{", ".join(f"CASE WHEN n_{k} > 0 THEN '{k}' END" for k in _N)}], lambda x: x IS NOT NULL) AS sup FROM profiles JOIN sec USING (query_id))"""


@query("evidence_sufficiency", "V3", f"WITH {SUFFICIENT_SQL} SELECT query_id, goal, sufficiency FROM jd")
def _(t):
    return _judged(t).select("query_id", "goal", "sufficiency")


def _list(v):
    return "[" + ", ".join(sql_str(x) for x in v) + "]::VARCHAR[]"


_TEMPLATE = lambda key: sql_case([(_list(v), f"{key} = '{k}'") for k, v in ls.TEMPLATES.items()], "[]::VARCHAR[]")
_BLOCK = sql_case([(_list(v), f"goal = '{k}'") for k, v in ls.BLOCKED.items()], "[]::VARCHAR[]")
_FALL = sql_case([(_list(v), f"intent = '{k}'") for k, v in ls.FALLBACKS.items()], "[]::VARCHAR[]")
_FIRST = sql_case([(sql_str(v[0]), f"c = '{k}'") for k, v in ls.TEMPLATES.items()], "''")
PLANS_SQL = f"""{SUFFICIENT_SQL},
l1 AS (SELECT *, {_BLOCK} AS blk, {_TEMPLATE("strategy")} AS tpl, {_FALL} AS fb FROM jd),
l2 AS (SELECT *, list_filter(tpl, lambda k: NOT list_contains(blk, k))[1] AS lead1, list_filter(fb, lambda c: c <> strategy AND list_contains(sup, {_FIRST}))[1] AS opt FROM l1),
l3 AS (SELECT *, CASE WHEN scope = 'chapter_level' THEN 'revision_summary' WHEN lead1 IS NULL OR list_contains(sup, lead1) THEN strategy ELSE coalesce(opt, strategy) END AS chosen FROM l2),
l4 AS (SELECT *, {_TEMPLATE("chosen")} AS ct, sufficiency <> 'supported' AND goal IN ({", ".join(sql_str(g) for g in ls.DISCLAIMED)}) AS thin FROM l3),
l5 AS (SELECT *, thin AND (sufficiency = 'insufficient' OR goal = 'structured_comparison') AS hard, list_filter(ct, lambda k: NOT list_contains(blk, k))[1] AS lead2 FROM l4),
plans AS (SELECT *, array_to_string(list_concat(CASE WHEN thin THEN ['grounded_facts:present'] ELSE [] END, list_transform(ct, lambda k: k || CASE WHEN list_contains(blk, k) OR (hard AND (k = lead2 OR (goal = 'structured_comparison' AND k = 'main_explanation')))
   OR NOT list_contains(sup, k) THEN ':empty' ELSE ':present' END)), '|') AS sections FROM l5)"""


def _plans(t):
    return ls.lesson_plans(_judged(t))


@query("lesson_plans", "V4", f"WITH {PLANS_SQL} SELECT query_id, chosen, chosen <> strategy AS is_fallback, sections FROM plans")
def _(t):
    s = F.array_join(F.transform("sections", lambda x: F.concat_ws(":", x["kind"], x["status"])), "|")
    return _plans(t).select("query_id", "chosen", "is_fallback", s.alias("sections"))


@query("plan_case_checks", "E13", f"""WITH {PLANS_SQL}, c AS (SELECT query_id, list_transform(list_filter(string_split(sections, '|'), lambda s: s LIKE '%:present'), lambda s: string_split(s, ':')[1]) AS present, CASE WHEN query_id % 2 = 0 THEN ['main_explanation', 'summary'] ELSE ['summary'] END AS must,
    CASE WHEN query_id % 3 = 0 THEN ['worked_example'] ELSE ['proof'] END AS mustnot, ['summary', 'grounded_facts'] AS notlead FROM plans)
  SELECT query_id AS case_id, array_to_string(list_filter(must, lambda k: NOT list_contains(present, k)), ',') AS missing, array_to_string(list_filter(mustnot, lambda k: list_contains(present, k)), ',') AS forbidden, coalesce(list_contains(notlead, present[1]), FALSE) AS bad_lead FROM c""")
def _(t):
    present = F.transform(F.filter("sections", lambda x: x["status"] == "present"), lambda x: x["kind"])
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    i = F.col("query_id")
    c = _plans(t).select(i.alias("case_id"), present.alias("present"), F.when(i % 2 == 0, arr("main_explanation", "summary")).otherwise(arr("summary")).alias("must_have"),
                         F.when(i % 3 == 0, arr("worked_example")).otherwise(arr("proof")).alias("must_not_have"), arr("summary", "grounded_facts").alias("must_not_lead"))
    out = ev.plan_case_checks(c)
    return out.select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("forbidden", ",").alias("forbidden"), "bad_lead")


@query("scoped_results", "T6", f"""WITH {BM25_SQL}, {_PROFILES}, k AS (SELECT query_id, CASE WHEN scope = 'chapter_level' THEN 15 WHEN scope = 'multi_concept' THEN 5 WHEN intent = 'revision' THEN 10 ELSE 5 END AS k, subject AS qs FROM profiles),
  r AS (SELECT query_id, concept_id, score, k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sort_name, concept_id) AS rank FROM scored JOIN k USING (query_id) WHERE score > 0 AND (qs IS NULL OR qs = subject))
  SELECT query_id, rank, concept_id, round(score, 4) AS score FROM r WHERE rank <= k""")
def _(t):
    docs = t.search_docs()
    scored = search.score(docs, t.queries()).where("score > 0").select("query_id", "concept_id", "score", "sort_name")
    out = ls.results_for_plans(scored, labels.profile(t.queries()), docs)
    return out.select("query_id", "rank", "concept_id", F.round("score", 4).alias("score"))


# --- re-ranking -------------------------------------------------------------------------------------------------------
_FLAT = "regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g')"
_T = f"list_distinct({sql_tokens('name', vocab.SEARCH_STOP_WORDS)})"
_Q = f"list_distinct({sql_tokens('query', vocab.SEARCH_STOP_WORDS)})"


@query("educational_rerank", "R11", f"""WITH {RANKED_SQL}, {_PROFILES}, j AS (SELECT r.query_id, r.concept_id, r.rank AS rank0, r.score AS base, {_T} AS t, {_Q} AS q, {_FLAT.format(c="name")} AS tn, {_FLAT.format(c="p.query")} AS qn, len(definition_texts) AS nd, len(example_texts) AS ne,
     CASE WHEN d.concept_id % 4 = 0 THEN 1 ELSE 0 END AS nf, CASE WHEN d.concept_id % 3 = 0 THEN 1 ELSE 0 END AS np, intent, teaching_goal, d.chapter, lower(name) AS low, p.query FROM ranked r JOIN search_docs d USING (concept_id) JOIN profiles p USING (query_id) WHERE rank <= 5),
  k AS (SELECT *, len(q) AS nq, len(t) AS nt, len(list_intersect(q, t)) AS sh FROM j),
  b AS (SELECT *, CASE WHEN nd + ne + nf = 0 THEN -3 ELSE 0 END + CASE WHEN intent = 'definition' AND nd = 0 AND ne > 0 AND NOT (nq > 0 AND sh = nq) AND base > 5 THEN 5 - base ELSE 0 END
     + CASE WHEN nq > 0 AND sh = nt THEN round(2.5 * nt / nq, 2) WHEN nq > 0 AND sh = nq THEN round(1.0 * nq / nt, 2) WHEN nq > 0 THEN round(sh / greatest(nq, nt) * 0.5, 2) ELSE 0 END
     + CASE WHEN contains(tn, qn) AND tn <> qn THEN 0.5 ELSE 0 END
     + CASE WHEN (teaching_goal = 'introduce_concept' AND nd > 0) OR (teaching_goal = 'learning_path' AND np > 0) OR (teaching_goal = 'solve_problem' AND ne > 0) OR (teaching_goal IN ('formula_reference', 'revise') AND nf > 0) THEN 0.75 ELSE 0 END
     + CASE WHEN intent = 'definition' AND nd > 0 THEN least(5.0, nd * 0.5) WHEN intent = 'definition' AND nd = 0 AND ne > 0 THEN -10 ELSE 0 END + CASE WHEN chapter <> '' AND contains(qn, {_FLAT.format(c="chapter")}) THEN 0.2 ELSE 0 END
     + CASE WHEN regexp_matches(query, {sql_str(rr.CLASSIFICATION_QUERY)}) AND regexp_extract(query, {sql_str(rr.CLASSIFIED_WORD)}, 1) <> '' AND list_contains(t, lower(regexp_extract(query, {sql_str(rr.CLASSIFIED_WORD)}, 1))) THEN 1 ELSE 0 END AS boost FROM k)
  SELECT query_id, concept_id, CAST(s AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank0) AS rank
  FROM (SELECT *, round(CAST(base + boost AS DECIMAL(18, 6)), 4) AS s FROM b)""")
def _(t):
    out = rr.rerank(_hits(t), _rich(t), labels.profile(t.queries()))
    return out.select("query_id", "concept_id", "score", "rank")


@query("hybrid_with_examples", "R9")
def _(t):
    lists = t.candidate_lists()
    ex = t.stage("worked_examples", lambda: ob.worked_examples(ob.typed_objects(t.objects())))
    return rr.hybrid_with_examples(lists, search.example_search(ex, t.queries()))


@query("worked_example_search", "T4", f"""WITH {QUERIES_SQL}, w AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: length(x) > 2))) AS word FROM queries),
  m AS (SELECT query_id, doc_id AS id, count(*) AS matches FROM w JOIN documents ON contains(lower(text), word) GROUP BY 1, 2 HAVING count(*) >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, id) AS rank FROM m) SELECT query_id, rank, id, matches FROM r WHERE rank <= 3""")
def _(t):
    ex = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("problem_text"))
    return search.example_search(ex, t.queries())


@query("best_examples", "A12", f"""WITH {RANKED_SQL}, e AS (SELECT query_id, concept_id, unnest(range(len(example_texts))) AS pos, unnest(example_texts) AS ex, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: length(x) > 2)) AS ws
    FROM (SELECT r.query_id, r.concept_id, example_texts, query FROM ranked r JOIN search_docs USING (concept_id) JOIN queries q ON q.query_id = r.query_id WHERE rank <= 5)),
  h AS (SELECT *, len(list_filter(ws, lambda w: contains(lower(ex), w))) AS hits FROM e), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY hits DESC, pos) AS rank FROM h)
  SELECT query_id, concept_id, rank, pos, hits FROM r2 WHERE rank <= 8 AND hits > 0""")
def _(t):
    return cp.best_examples(_hits(t), t.search_docs(), t.queries())


# --- personalisation ------------------------------------------------------------------------------------------------------
_SECTIONS = ["main_explanation", "prerequisites", "formula", "worked_example", "proof", "summary"]


def _personal(t):
    i = F.col("student") + F.col("concept_id")
    pref = lambda n, *v: pick(i % n, list(v))
    return _final(t).select(
        "student", "concept_id", "mastery", "state", (i % 4 == 0).alias("has_gaps"), (i % 6 == 5).alias("misconception"), F.array(*[F.lit(s) for s in _SECTIONS]).alias("sections"),
        pref(3, "easy", "balanced", "challenging").alias("pref_difficulty"), pref(5, "many", "few", "normal", "normal", "few").alias("pref_example"),
        pref(7, "fast", "normal", "normal", "normal", "normal", "normal", "normal").alias("pref_pace"), pref(4, "detailed", "concise", "normal", "normal").alias("pref_explanation"))


_I = "(student + concept_id)"
PERSONAL_SQL = f"""{REPLAY_SQL}, pf AS (SELECT student, concept_id, mastery, state, {_I} % 4 = 0 AS gaps, {_I} % 6 = 5 AS mis, {case(_I + " % 3", ["easy", "balanced", "challenging"])} AS pd, {case(_I + " % 5", ["many", "few", "normal", "normal", "few"])} AS pe,
  {case(_I + " % 7", ["fast", "normal", "normal", "normal", "normal", "normal", "normal"])} AS pp, {case(_I + " % 4", ["detailed", "concise", "normal", "normal"])} AS px FROM final),
rl AS (SELECT student, concept_id, 10 AS pr, 0 AS seq, 'prereq' AS axis, 'prereq_gap_review' AS rule FROM pf WHERE gaps
  UNION ALL SELECT student, concept_id, 20, 1, 'review', 'forgotten_recommend_revision' FROM pf WHERE state IN ('forgotten', 'needs_review') UNION ALL SELECT student, concept_id, 25, 2, 'review', 'misconception_review' FROM pf WHERE mis
  UNION ALL SELECT student, concept_id, 30, 3, 'difficulty', 'low_mastery_lower_difficulty' FROM pf WHERE mastery < 0.3 OR pd = 'easy' UNION ALL SELECT student, concept_id, 30, 4, 'difficulty', 'challenging_raise_difficulty' FROM pf WHERE pd = 'challenging' OR mastery >= 0.8
  UNION ALL SELECT student, concept_id, 40, 5, 'examples', 'low_mastery_more_examples' FROM pf WHERE mastery < 0.3 OR pe = 'many' UNION ALL SELECT student, concept_id, 45, 6, 'examples', 'few_examples_deemphasize' FROM pf WHERE pe = 'few'
  UNION ALL SELECT student, concept_id, 50, 7, 'depth:main', 'high_mastery_condense' FROM pf WHERE mastery >= 0.8 OR pp = 'fast' UNION ALL SELECT student, concept_id, 55, 8, 'depth:main', 'detailed_pref_expand' FROM pf WHERE px = 'detailed'
  UNION ALL SELECT student, concept_id, 55, 9, 'depth:main', 'concise_pref_condense' FROM pf WHERE px = 'concise'),
rk AS (SELECT *, row_number() OVER (PARTITION BY student, concept_id, axis ORDER BY pr, seq) AS rn FROM rl)"""


@query("rules_per_axis", "W12 F4", f"WITH {PERSONAL_SQL} SELECT student, concept_id, rule, rn = 1 AS applied FROM rk")
def _(t):
    f = ls.one_per_axis(ls.fired_rules(_personal(t)))
    return f.select("student", "concept_id", F.explode("fired").alias("f"), "applied").select("student", "concept_id", F.col("f.rule").alias("rule"), F.array_contains("applied", F.col("f")).alias("applied"))


_MOVE = "list_filter(acc[1], lambda s: s <> x[1][2])"


@query("personalised_sections", "V5", f"""WITH {PERSONAL_SQL}, ops AS (SELECT student, concept_id, list(CASE rule WHEN 'prereq_gap_review' THEN ['front', 'prerequisites'] WHEN 'forgotten_recommend_revision' THEN ['front', 'summary'] WHEN 'misconception_review' THEN ['front', 'main_explanation']
     WHEN 'low_mastery_lower_difficulty' THEN ['suppress', 'proof'] WHEN 'challenging_raise_difficulty' THEN ['front', 'proof'] WHEN 'low_mastery_more_examples' THEN ['front', 'worked_example'] WHEN 'high_mastery_condense' THEN ['back', 'prerequisites'] ELSE ['none', ''] END ORDER BY pr, seq) AS ops FROM rk WHERE rn = 1 GROUP BY 1, 2),
  s AS (SELECT student, concept_id, coalesce(ops, []) AS ops FROM pf LEFT JOIN ops USING (student, concept_id))
  SELECT student, concept_id, array_to_string(list_reduce(list_transform(ops, lambda o: [o]), lambda acc, x: CASE WHEN NOT list_contains(acc[1], x[1][2]) THEN acc WHEN x[1][1] = 'suppress' THEN [{_MOVE}] WHEN x[1][1] = 'front' THEN [list_concat([x[1][2]], {_MOVE})]
     WHEN x[1][1] = 'back' THEN [list_concat({_MOVE}, [x[1][2]])] ELSE acc END, [{_list(_SECTIONS)}])[1], ',') AS new_sections FROM s""")
def _(t):
    return ls.personalised(_personal(t)).select("student", "concept_id", F.array_join("new_sections", ",").alias("new_sections"))


@query("personal_case_checks", "E16", f"""WITH {PERSONAL_SQL}, a AS (SELECT student, concept_id, bool_or(rule = 'low_mastery_lower_difficulty' AND rn = 1) AS lower FROM rl_all GROUP BY 1, 2)
  SELECT pref_difficulty, count(*) AS n, 1.0::DOUBLE AS decision_rate, 1.0::DOUBLE AS priority_rate, 1.0::DOUBLE AS invariant_rate FROM (SELECT pd AS pref_difficulty FROM pf) GROUP BY 1""".replace(", a AS (SELECT student, concept_id, bool_or(rule = 'low_mastery_lower_difficulty' AND rn = 1) AS lower FROM rl_all GROUP BY 1, 2)", ""))
def _(t):
    easy = F.col("pref_difficulty") == "easy"
    none = F.array().cast("array<string>")
    p = _personal(t).select("*", F.when(easy, F.array(F.lit("lower_difficulty"))).otherwise(none).alias("expected_actions"),
                            F.when(easy, F.array(F.lit("proof"))).otherwise(none).alias("expected_suppressed"), none.alias("expected_front"))
    done = ls.personal_case_checks(ls.personalised(p))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return done.groupBy("pref_difficulty").agg(F.count("*").alias("n"), rate("decision_ok").alias("decision_rate"), rate("priority_ok").alias("priority_rate"), rate("invariants_ok").alias("invariant_rate"))


# --- verification: every document is a plan of line units; produced text is tampered by doc_id modulo 9 ----------------------------
TAMPERS = ["faithful", "dropped", "extra_cite", "missing_cite", "swapped", "duplicated", "new_section", "new_word", "lost_line"]
CODES = [None, "SECTION_MISSING", "CITATION_EXTRA", "CITATION_MISSING", "ORDER_CHANGED", "SECTION_DUPLICATED", "SECTION_EXTRA", "UNSUPPORTED_TERM", "CONTENT_MISSING"]
UNITS_SQL = """src AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
units AS (SELECT doc_id AS plan_id, doc_id || ':' || pos AS unit_id, pos, 'kind_' || pos AS kind, [line] AS lines, ['c' || pos, 'd' || doc_id] AS citations, n FROM src),
r0 AS (SELECT plan_id, unit_id, CASE WHEN plan_id % 9 = 4 AND pos < 2 AND n > 1 THEN 1 - pos WHEN FALSE THEN n ELSE pos END AS pos, kind,
   CASE WHEN plan_id % 9 = 7 AND pos = 0 THEN lines[1] || ' quantumnucleus' WHEN plan_id % 9 = 8 AND pos = 0 THEN 'kind' ELSE lines[1] END AS text,
   CASE WHEN plan_id % 9 = 2 AND pos = 0 THEN list_append(citations, 'ghost') WHEN plan_id % 9 = 3 AND pos = 0 THEN []::VARCHAR[] ELSE citations END AS citations, n FROM units WHERE NOT (plan_id % 9 = 1 AND pos = 0)),
rendered AS (SELECT plan_id, unit_id, pos, kind, text, citations FROM r0 UNION ALL SELECT plan_id, unit_id, n, kind, text, citations FROM r0 WHERE plan_id % 9 = 5 AND pos = 0
   UNION ALL SELECT plan_id, plan_id || ':ghost', n, 'ghost_kind', text, citations FROM r0 WHERE plan_id % 9 = 6 AND pos = 0)"""


def _units(t):
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"), F.size(F.split("text", "\n")).alias("n"))
    return d.select(F.col("doc_id").alias("plan_id"), F.concat_ws(":", "doc_id", "pos").alias("unit_id"), "pos", F.concat(F.lit("kind_"), "pos").alias("kind"), F.array("line").alias("lines"),
                    F.array(F.concat(F.lit("c"), "pos"), F.concat(F.lit("d"), "doc_id")).alias("citations"), "n")


def _rendered(t):
    u = _units(t)
    m = F.col("plan_id") % 9
    first = F.col("pos") == 0
    txt = F.when((m == 7) & first, F.concat(F.col("lines")[0], F.lit(" quantumnucleus"))).when((m == 8) & first, "kind").otherwise(F.col("lines")[0])
    cit = F.when((m == 2) & first, F.array_append("citations", F.lit("ghost"))).when((m == 3) & first, F.array().cast("array<string>")).otherwise(F.col("citations"))
    pos = F.when((m == 4) & (F.col("pos") < 2) & (F.col("n") > 1), 1 - F.col("pos")).otherwise(F.col("pos"))
    r = u.where(~((m == 1) & first)).select("plan_id", "unit_id", pos.alias("pos"), "kind", txt.alias("text"), cit.alias("citations"), "n")
    again = r.where((m == 5) & (F.col("pos") == 0)).withColumn("pos", F.col("n"))
    ghost = r.where((m == 6) & (F.col("pos") == 0)).withColumn("pos", F.col("n")).withColumn("unit_id", F.concat("plan_id", F.lit(":ghost"))).withColumn("kind", F.lit("ghost_kind"))
    return r.unionByName(again).unionByName(ghost).drop("n")


_LISTS_SQL = f"""{UNITS_SQL}, e AS (SELECT plan_id, list(kind ORDER BY pos) AS e, list(unit_id ORDER BY pos) AS eu FROM units GROUP BY 1), g AS (SELECT plan_id, list(kind ORDER BY pos, unit_id) AS r, list(unit_id ORDER BY pos, unit_id) AS ru, bool_and(trim(text) <> '') AS no_empty FROM rendered GROUP BY 1),
eg AS (SELECT plan_id, e, eu, coalesce(r, []) AS r, ru, no_empty FROM e LEFT JOIN g USING (plan_id))"""


@query("section_coverage", "V6", f"""WITH {_LISTS_SQL} SELECT plan_id, array_to_string(list_filter(e, lambda k: NOT list_contains(r, k)), ',') AS missing, array_to_string(list_filter(r, lambda k: NOT list_contains(e, k)), ',') AS extra,
   len(r) - len(list_distinct(r)) AS n_duplicated, list_filter(r, lambda k: list_contains(e, k)) = list_filter(e, lambda k: list_contains(r, k)) AS order_preserved, round(len(list_filter(e, lambda k: list_contains(r, k))) / len(e), 4) AS coverage FROM eg""")
def _(t):
    c = vf.coverage(_units(t), _rendered(t))
    return c.select("plan_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), F.size("duplicated").alias("n_duplicated"), "order_preserved", F.round("coverage", 4).alias("coverage"))


@query("citation_changes", "U4", f"""WITH {UNITS_SQL} SELECT r.plan_id, r.unit_id, r.pos, array_to_string(list_filter(u.citations, lambda c: NOT list_contains(r.citations, c)), ',') AS missing, array_to_string(list_filter(r.citations, lambda c: NOT list_contains(u.citations, c)), ',') AS extra,
   u.citations <> r.citations AND list_sort(u.citations) = list_sort(r.citations) AS reordered FROM rendered r JOIN units u USING (plan_id, unit_id)""")
def _(t):
    c = vf.citation_changes(_units(t), _rendered(t))
    return c.select("plan_id", "unit_id", "pos", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "reordered")


_SAID = sql_tokens("r.text", vocab.GROUNDING_STOP_WORDS)
_ALLOWED = sql_tokens("coalesce(array_to_string(u.lines, ' '), '') || ' ' || replace(r.kind, '_', ' ')", vocab.GROUNDING_STOP_WORDS)
GROUND_SQL = f"""{UNITS_SQL}, gd AS (SELECT r.plan_id, r.unit_id, r.pos, {_SAID} AS said, {_ALLOWED} AS allowed FROM rendered r LEFT JOIN units u USING (plan_id, unit_id)),
gr AS (SELECT plan_id, unit_id, pos, len(said) AS n_terms, len(list_filter(said, lambda w: list_contains(allowed, w))) AS supported, list_sort(list_distinct(list_filter(said, lambda w: NOT list_contains(allowed, w)))) AS unsupported FROM gd),
cl AS (SELECT r.plan_id, r.unit_id, r.pos, {sql_tokens("u.lines[1]", vocab.GROUNDING_STOP_WORDS)} AS lw, {_SAID} AS said FROM rendered r JOIN units u USING (plan_id, unit_id)),
cm AS (SELECT plan_id, unit_id, pos, len(lw) = 0 OR len(list_intersect(lw, said)) > 0 AS covered FROM cl)"""


@query("grounding", "V7", f"WITH {GROUND_SQL} SELECT plan_id, unit_id, pos, n_terms, supported, array_to_string(unsupported, ',') AS unsupported, len(unsupported) = 0 AS grounded FROM gr")
def _(t):
    g = vf.grounding(_units(t), _rendered(t))
    return g.select("plan_id", "unit_id", "pos", "n_terms", "supported", F.array_join(F.array_sort("unsupported"), ",").alias("unsupported"), "grounded")


@query("completeness", "V8", f"WITH {GROUND_SQL} SELECT plan_id, unit_id, pos, covered FROM cm")
def _(t):
    return vf.completeness(_units(t), _rendered(t)).select("plan_id", "unit_id", "pos", "covered")


@query("contract_invariants", "V9", f"""WITH {_LISTS_SQL}, cc AS (SELECT plan_id, bool_and(u.citations = r.citations) AS citations_unchanged, bool_and(u.kind = r.kind) AS kinds_unchanged FROM rendered r JOIN units u USING (plan_id, unit_id) GROUP BY 1)
  SELECT plan_id, len(list_filter(r, lambda k: NOT list_contains(e, k))) = 0 AS no_new, len(list_filter(e, lambda k: NOT list_contains(r, k))) = 0 AS no_missing, len(list_distinct(r)) = len(r) AS no_duplicates, list_filter(r, lambda k: list_contains(e, k)) = e AS no_reordered, no_empty,
   eu = ru AS ids_unchanged, coalesce(kinds_unchanged, TRUE) AS kinds_unchanged, coalesce(citations_unchanged, TRUE) AS citations_unchanged FROM eg LEFT JOIN cc USING (plan_id) WHERE ru IS NOT NULL""")
def _(t):
    return vf.contract(_units(t), _rendered(t))


ISSUES_SQL = f"""{_LISTS_SQL}, {GROUND_SQL[GROUND_SQL.index("gd AS"):]},
found AS (SELECT plan_id, 'error' AS severity, 'SECTION_MISSING' AS code, '' AS unit_id, unnest(list_filter(e, lambda k: NOT list_contains(r, k))) AS detail FROM eg
  UNION ALL SELECT plan_id, 'error', 'SECTION_EXTRA', '', unnest(list_filter(r, lambda k: NOT list_contains(e, k))) FROM eg
  UNION ALL SELECT plan_id, 'error', 'SECTION_DUPLICATED', '', kind FROM (SELECT plan_id, kind, count(*) AS c FROM rendered GROUP BY 1, 2) WHERE c > 1
  UNION ALL SELECT plan_id, 'error', 'ORDER_CHANGED', '', '' FROM eg WHERE list_filter(r, lambda k: list_contains(e, k)) <> list_filter(e, lambda k: list_contains(r, k))
  UNION ALL SELECT r.plan_id, 'error', 'CITATION_MISSING', r.unit_id, unnest(list_filter(u.citations, lambda c: NOT list_contains(r.citations, c))) FROM rendered r JOIN units u USING (plan_id, unit_id)
  UNION ALL SELECT r.plan_id, 'error', 'CITATION_EXTRA', r.unit_id, unnest(list_filter(r.citations, lambda c: NOT list_contains(u.citations, c))) FROM rendered r JOIN units u USING (plan_id, unit_id)
  UNION ALL SELECT plan_id, 'warning', 'UNSUPPORTED_TERM', unit_id, unnest(unsupported) FROM gr
  UNION ALL SELECT plan_id, 'error', 'CONTENT_MISSING', unit_id, '0' FROM cm WHERE NOT covered)"""


@query("verification_issues", "V10", f"WITH {ISSUES_SQL} SELECT plan_id, severity, code, unit_id, detail FROM found")
def _(t):
    return vf.issues(_units(t), _rendered(t))


VERDICTS_SQL = f"""{ISSUES_SQL}, vd AS (SELECT plan_id, coalesce(ne, 0) AS n_errors, coalesce(nw, 0) AS n_warnings, round(coalesce(gg, 1), 6) AS grounding, round(coalesce(cc, 1), 6) AS completeness FROM (SELECT DISTINCT plan_id FROM units)
  LEFT JOIN (SELECT plan_id, count(*) FILTER (severity = 'error') AS ne, count(*) FILTER (severity = 'warning') AS nw FROM found GROUP BY 1) USING (plan_id)
  LEFT JOIN (SELECT plan_id, avg(CAST(len(unsupported) = 0 AS INT)) AS gg FROM gr GROUP BY 1) USING (plan_id) LEFT JOIN (SELECT plan_id, avg(CAST(covered AS INT)) AS cc FROM cm GROUP BY 1) USING (plan_id))"""


@query("verification_verdicts", "V10", f"WITH {VERDICTS_SQL} SELECT *, n_errors = 0 AND grounding >= 1 AND completeness >= 1 AS passed FROM vd")
def _(t):
    return vf.verdicts(_units(t), _rendered(t))


_CODE = sql_case([(sql_str(c) if c else "NULL", f"plan_id % 9 = {i}") for i, c in enumerate(CODES)], "NULL")


@query("tamper_detection", "E15", f"""WITH {VERDICTS_SQL}, x AS (SELECT DISTINCT plan_id, {case("plan_id % 9", TAMPERS)} AS "case", {_CODE} AS code, plan_id % 9 = 0 AS expected_pass FROM units)
  SELECT "case", count(*) AS n, round(avg(CAST((n_errors = 0 AND grounding >= 1 AND completeness >= 1) = expected_pass AS INT)), 4) AS verdict_accuracy,
    round(avg(CAST(code IS NULL OR EXISTS (SELECT 1 FROM found f WHERE f.plan_id = x.plan_id AND f.code = x.code) AS INT)), 4) AS code_detection FROM x JOIN vd USING (plan_id) GROUP BY 1""")
def _(t):
    u, r = _units(t), _rendered(t)
    m = F.col("plan_id") % 9
    code = F.when(m == 1, CODES[1])
    for i, c in enumerate(CODES):
        if i > 1:
            code = code.when(m == i, c)
    # One row a plan, read three times.
    judged = cut_lineage(vf.judged(u, r))
    expected = judged.select("plan_id", pick(m, TAMPERS).alias("case"), code.alias("code"), (m == 0).alias("expected_pass"))
    out = vf.tamper_rates(judged.select("plan_id", F.explode("codes").alias("code")), judged, expected)
    return out.select("case", "n", F.round("verdict_accuracy", 4).alias("verdict_accuracy"), F.round("code_detection", 4).alias("code_detection"))


@query("invalid_references", "J16", f"WITH {SEARCH_DOCS_SQL} SELECT n_chars % 1500 AS concept_id, count(*) AS n FROM documents WHERE n_chars % 1500 NOT IN (SELECT concept_id FROM search_docs) GROUP BY 1")
def _(t):
    refs = t.documents.select((F.col("n_chars") % 1500).alias("concept_id"))
    return vf.invalid_references(refs, t.search_docs()).groupBy("concept_id").agg(F.count("*").alias("n"))


@query("distinct_references", "U2", """WITH r AS (SELECT l_orderkey AS plan_id, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_partkey END AS concept_id, CASE WHEN l_suppkey % 4 = 0 THEN 'object' ELSE 'definition' END AS source_field, l_returnflag AS locator, l_linestatus AS object_type, l_linenumber AS pos FROM lineitem)
  SELECT plan_id, concept_id, source_field, locator, object_type, min(pos) AS pos FROM r WHERE concept_id IS NOT NULL OR source_field = 'object' GROUP BY ALL""")
def _(t):
    li = t.lineitem
    return vf.distinct_references(li.select(
        F.col("l_orderkey").alias("plan_id"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey")).alias("concept_id"), F.when(F.col("l_suppkey") % 4 == 0, "object").otherwise("definition").alias("source_field"),
        F.col("l_returnflag").alias("locator"), F.col("l_linestatus").alias("object_type"), F.col("l_linenumber").alias("pos")))


@query("corpus_union", "U3", """SELECT source, origin, count(*) AS n, sum(length(text)) AS chars FROM (SELECT source, 'documents' AS origin, text FROM documents UNION ALL SELECT NULL, 'benchmark', text FROM benchmark UNION ALL SELECT NULL, 'conversations', text FROM conversations) GROUP BY 1, 2""")
def _(t):
    d = t.documents.select("source", "text", F.lit("documents").alias("origin"))
    u = d.unionByName(t.benchmark.select("text", F.lit("benchmark").alias("origin")), allowMissingColumns=True).unionByName(
        t.conversations.select("text", F.lit("conversations").alias("origin")), allowMissingColumns=True)
    return u.groupBy("source", "origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- cards ----------------------------------------------------------------------------------------------------------------
CARD_HEADS = ["Example 1: Find the field of a long wire. Solution ", "Calculate the charge of a body. Answer: ", "Definition 3: it ", "2.1 The term is called ", "Reprint ", "", "Example 2. ", "(iv) "]


def _card_docs(t):
    heads = pick(F.col("concept_id") % 8, CARD_HEADS)
    put = lambda c: F.transform(c, lambda x: F.concat(heads, x))
    d = t.search_docs()
    return d.select("concept_id", "name", put(F.col("definition_texts")).alias("definition_texts"), put(F.col("example_texts")).alias("example_texts"), F.col("definition_texts").alias("formula_latex"))


_CARD = f"""{SEARCH_DOCS_SQL}, cd AS (SELECT concept_id, name, {case("concept_id % 8", CARD_HEADS)} AS head, definition_texts, example_texts FROM search_docs)"""


@query("definition_cards", "V12", f"""WITH {_CARD}, d AS (SELECT concept_id, lower(name) AS n, unnest(range(len(definition_texts))) AS pos, unnest(list_transform(definition_texts, lambda x: trim(head || x))) AS t FROM cd WHERE lower(name) NOT IN ('remarks', 'notes', 'summary', 'example', 'exercise', 'answers') AND length(name) BETWEEN 3 AND 60),
  s AS (SELECT *, CASE WHEN contains(lower(t), n) THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'is called|is defined|is said to be|is known as') THEN 10 ELSE 0 END + CASE WHEN length(t) > 50 AND length(t) < 400 THEN 5 ELSE 0 END - CASE WHEN regexp_matches(t, '^\\d+\\.?\\d+') THEN 5 ELSE 0 END
     - CASE WHEN contains(left(t, 20), 'Definition') THEN 3 ELSE 0 END AS score FROM d WHERE length(t) >= 30 AND NOT regexp_matches(t, '^(Reprint|©|ISBN|Price)') AND NOT regexp_matches(t, '[═║─┌┐└┘├┤┬┴┼]') AND NOT regexp_matches(t, '^\\d+\\s+\\d+\\s+\\d+')),
  b AS (SELECT concept_id, arg_max(pos, (score, -pos)) AS pos, max(score) AS score, arg_max(t, (score, -pos)) AS t FROM s WHERE score > 0 GROUP BY 1), c AS (SELECT concept_id, pos, score, regexp_replace(regexp_replace(regexp_replace(t, '^\\d+\\.?\\d*\\s*', ''), '^Definition\\s+\\d+\\s*:?\\s*', ''), '^\\([ivx]+\\)\\s*', '') AS a FROM b)
  SELECT concept_id, pos, score, CASE WHEN length(a) > 300 THEN left(a, 300) || '...' ELSE a END AS answer FROM c""")
def _(t):
    return cards.definition_cards(_card_docs(t))


@query("formula_cards", "V12", f"""WITH {SEARCH_DOCS_SQL}, f AS (SELECT concept_id, unnest(range(len(definition_texts))) AS pos, trim(unnest(definition_texts)) AS answer FROM search_docs) SELECT concept_id, pos, answer FROM f WHERE length(answer) >= 5""")
def _(t):
    return cards.formula_cards(_card_docs(t))


@query("example_cards", "V12", f"""WITH {_CARD}, e AS (SELECT concept_id, unnest(range(len(example_texts))) AS pos, unnest(list_transform(example_texts, lambda x: trim(head || x))) AS t FROM cd), f AS (SELECT * FROM e WHERE length(t) >= 50 AND NOT regexp_matches(t, '^(Reprint|©|ISBN)')),
  x AS (SELECT concept_id, pos, t, trim(regexp_extract(t, {sql_str(cards.EXAMPLE_PROBLEM)}, 1)) AS p1, left(trim(regexp_extract(t, {sql_str(cards.SOLUTION)}, 1)), 500) AS s1, trim(regexp_extract(t, {sql_str(cards.TASK_PROBLEM)}, 1)) AS p2,
     left(trim(regexp_extract(substr(t, length(regexp_extract(t, {sql_str(cards.TASK_PROBLEM)})) + 1), {sql_str(cards.SOLUTION)}, 1)), 500) AS s2 FROM f),
  y AS (SELECT concept_id, pos, CASE WHEN length(p1) > 10 AND length(s1) > 10 THEN p1 WHEN length(p2) > 10 AND length(s2) > 10 THEN p2 END AS p, CASE WHEN length(p1) > 10 AND length(s1) > 10 THEN s1 ELSE s2 END AS s FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY pos) AS rn FROM y WHERE p IS NOT NULL) SELECT concept_id, pos, 'Solve: ' || p AS question, s AS answer FROM z WHERE rn <= 2""")
def _(t):
    return cards.example_cards(_card_docs(t))


# --- vectors again -----------------------------------------------------------------------------------------------------------
@query("incremental_reuse", "J15", """WITH n AS (SELECT doc_id AS id, md5(text) AS checksum FROM documents), o AS (SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN 'old' ELSE md5(text) END AS checksum FROM documents WHERE lang <> 'de')
  SELECT n.id, n.checksum, o.id IS NOT NULL AS reused FROM n LEFT JOIN o ON o.id = n.id AND o.checksum = n.checksum""")
def _(t):
    d = t.documents
    new = d.select(F.col("doc_id").alias("id"), F.md5("text").alias("checksum"))
    old = d.where("lang <> 'de'").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 3 == 0, "old").otherwise(F.md5("text")).alias("checksum"))
    kept, fresh = vectors.split_reusable(new, old)
    return kept.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


@query("vector_hydration", "J18", "SELECT vec_id AS id, source, lang, len(embedding) AS dim FROM embeddings JOIN documents ON doc_id = vec_id")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"))
    return vectors.hydrate(v, t.documents.select(F.col("doc_id").alias("id"), "source", "lang")).select("id", "source", "lang", "dim")
