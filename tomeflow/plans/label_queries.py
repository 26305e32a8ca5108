"""Driver queries for the rule labels of queries, turns and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cues, formulas, labels, text, vocab
from .bindings import (
    ASKED_SQL, LINES_SQL, OBJECTS_SQL, SEARCH_DOCS_SQL, case, first_words, pick, sql_any, sql_case, sql_key, sql_map,
    sql_re, sql_str, sql_tokens, sql_words,
)
from .registry import query

_COMPARE = sql_re("trim(query)", cues.COMPARISON)
FEATURES_SQL = f"""{ASKED_SQL},
features AS (SELECT query_id, query, {_COMPARE} AS is_comparison,
  NOT {_COMPARE} AND {sql_re("trim(query)", cues.DEFINITION_LEAD)} AS is_definition,
  NOT {_COMPARE} AND {sql_re("trim(query)", cues.EXPLANATION_LEAD)} AS is_explanation,
  {sql_re("trim(query)", cues.MATH_SYMBOL)} OR {sql_re("trim(query)", cues.MATH_TOKEN)} AS is_math,
  {sql_re("trim(query)", cues.QUOTED)} AS is_quoted,
  regexp_extract_all(trim(query), {sql_str(cues.QUOTED)}, 1) AS quoted,
  len({sql_tokens("trim(query)", vocab.LOOKUP_STOP_WORDS)}) AS n_words FROM queries)"""

_INTENT = sql_case(
    [("'comparison'", "is_comparison")] + [(sql_str(n), sql_re("query", p)) for n, p in cues.INTENT_RULES]
    + [("'explanation'", "is_explanation")], "'definition'")
_SOLVES = (f"(({sql_re('trim(query)', cues.SOLVE_OVERRIDE)} OR {sql_re('trim(query)', cues.WORKED_EXAMPLE)}) AND NOT "
           f"{sql_re('trim(query)', cues.TYPE_COMPARISON)} AND NOT {sql_re('trim(query)', cues.TYPE_CLASSIFICATION)})")
_TYPE = sql_case([("'worked_example/solve_override'", _SOLVES)]
                 + [(sql_str(f"{t}/{r}"), sql_re("trim(query)", p)) for t, r, p in cues.QUESTION_TYPE_RULES], "'definition/fallback'")
_GOAL = sql_case([(sql_str(g), sql_re("trim(query)", p)) for g, p in cues.GOAL_RULES],
                 sql_map(cues.GOAL_BY_TYPE, "question_type", "'conceptual_understanding'"))
_DEPTH = sql_case([(sql_str(d), sql_re("query", p)) for d, p in cues.DEPTH_RULES], "'medium'")
_SCOPE = sql_case([(sql_str(s), sql_re("lower(trim(query))", p)) for s, p in cues.SCOPE_RULES]
                  + [("'chapter_level'", "intent = 'revision'")], "'single_concept'")
_HITS = {s: f"len(regexp_extract_all(lower(query), {sql_str(p)}))" for s, p in cues.SUBJECT_KEYWORDS.items()}
_SUBJECT = sql_case(
    [(sql_str(s), sql_re("lower(query)", rf"\b{n}\b")) for n, s in cues.SUBJECT_NAMES]
    + [(sql_str(s), " AND ".join(f"{h} > {h2}" for s2, h2 in _HITS.items() if s2 != s)) for s, h in _HITS.items()], "NULL")

PROFILE_SQL = f"""{FEATURES_SQL},
typed AS (SELECT *, {_INTENT} AS intent, string_split({_TYPE}, '/')[1] AS question_type, string_split({_TYPE}, '/')[2] AS type_rule FROM features),
goals AS (SELECT *, {_GOAL} AS goal FROM typed),
profiles AS (SELECT *, {sql_map(cues.STRATEGY_BY_GOAL, "goal")} AS strategy,
  {sql_map(cues.TEACHING_GOAL_BY_INTENT, "intent", "'introduce_concept'")} AS teaching_goal,
  {_DEPTH} AS depth, {_SCOPE} AS scope, {_SUBJECT} AS subject FROM goals)"""


@query("query_features", "P9", f"""WITH {FEATURES_SQL}
  SELECT query_id, is_comparison, is_definition, is_explanation, is_math, is_quoted, len(quoted) AS n_quoted, n_words FROM features""")
def _(t):
    f = labels.query_features(t.asked())
    return f.select("query_id", "is_comparison", "is_definition", "is_explanation", "is_math", "is_quoted",
                    F.size("quoted").alias("n_quoted"), "n_words")


@query("query_intents", "P10", f"WITH {PROFILE_SQL} SELECT query_id, intent FROM profiles")
def _(t):
    return labels.profile(t.asked()).select("query_id", "intent")


@query("question_types", "P11", f"WITH {PROFILE_SQL} SELECT query_id, question_type, type_rule FROM profiles")
def _(t):
    return labels.profile(t.asked()).select("query_id", "question_type", "type_rule")


@query("query_profiles", "P12", f"WITH {PROFILE_SQL} SELECT query_id, goal, strategy, teaching_goal, depth, scope, subject FROM profiles")
def _(t):
    return labels.profile(t.asked()).select("query_id", "goal", "strategy", "teaching_goal", "depth", "scope", "subject")


EXACT_SQL = f"""names AS (SELECT concept_id, name, {sql_key(sql_tokens("name", vocab.LOOKUP_STOP_WORDS))} AS key FROM search_docs),
vocabulary AS (SELECT key, arg_min(name, concept_id) AS matched_concept FROM names WHERE key <> '' GROUP BY key),
parts AS (SELECT query_id, 0 AS pos, query AS part FROM features
          UNION ALL SELECT query_id, unnest(range(1, len(quoted) + 1)), unnest(quoted) FROM features),
exact AS (SELECT query_id, arg_min(matched_concept, pos) AS matched_concept
          FROM (SELECT query_id, pos, {sql_key(sql_tokens("part", vocab.LOOKUP_STOP_WORDS))} AS key FROM parts) JOIN vocabulary USING (key)
          GROUP BY query_id),
flagged AS (SELECT f.*, matched_concept, matched_concept IS NOT NULL AS is_exact FROM features f LEFT JOIN exact USING (query_id))"""


@query("exact_concept_lookup", "J14", f"WITH {FEATURES_SQL}, {SEARCH_DOCS_SQL}, {EXACT_SQL} SELECT query_id, matched_concept FROM exact")
def _(t):
    return labels.exact_concepts(t.asked(), t.search_docs())


def _policy_sql(rules, default):
    return sql_case([(sql_str(f"{target}|{r}"), flag) for r, flag, target in rules], sql_str(f"{default}|default"))


ROUTED_SQL = " UNION ALL ".join(
    f"SELECT query_id, {sql_str(n)} AS policy, {_policy_sql(rules, d)} AS d FROM flagged" for n, rules, d in cues.ROUTING_POLICIES)


@query("routing_decisions", "R10 F3", f"""WITH {FEATURES_SQL}, {SEARCH_DOCS_SQL}, {EXACT_SQL}
  SELECT query_id, policy, string_split(d, '|')[1] AS chosen_strategy, string_split(d, '|')[2] AS fired_rule FROM ({ROUTED_SQL})""")
def _(t):
    flagged = labels.routing_flags(t.asked(), t.search_docs())
    # All policies are columns of one pass over the flags, then turned into rows.
    decided = [labels.route(flagged.select("query_id", "is_exact", "is_quoted", "is_math", "is_comparison", "is_explanation", "is_definition"),
                            *labels.policy(name)).select("query_id", F.lit(name).alias("policy"), "chosen_strategy", "fired_rule")
               for name, _, _ in cues.ROUTING_POLICIES]
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


# --- formulas ---------------------------------------------------------------------------------------------
# Notation put before each line, by (doc_id + pos) modulo 16.
FORMULA_HEADS = [
    "∆ = a11 A21 + ", "det(A) of ", "A = [1 2; 3 4] ", "∫ f(x) dx ", "d/dx of ", "lim x → 0 ", "H2O + NaOH -> ", "F = ma ",
    "α ≤ β ", "x^2 ", "PV = nRT ", "differential equation ", "integrate ", "solve the quadratic ", "matrix 1 2 3 4 inverse ", "",
]


def _formula_lines(t):
    return t.lines().select("doc_id", "pos", F.concat(pick((F.col("doc_id") + F.col("pos")) % 16, FORMULA_HEADS), F.col("line")).alias("query"))


FORMULA_LINES_SQL = f"""{LINES_SQL},
fl AS (SELECT doc_id, pos, {case("(doc_id + pos) % 16", FORMULA_HEADS)} || line AS query FROM lines)"""


def _stage(col, rules):
    return sql_case([(sql_str(o), sql_re(col, p)) for p, o in rules], col)


def _replaces(col, pairs):
    for sign, word in pairs:
        col = f"replace({col}, {sql_str(sign)}, {sql_str(word)})"
    return col


# RE2 has no look-around: each symbol is replaced between a start or non-word and an end or non-word, in two passes.
def _symbol_stages(src):
    """One CTE per few symbols keeps the text of the query short."""
    out, prev = [], src
    for i in range(len(formulas.SYMBOL_WORDS)):
        sign, word = formulas.SYMBOL_WORDS[i]
        pattern = rf"(^|[^\p{{L}}\p{{N}}_]){sign}($|[^\p{{L}}\p{{N}}_])"
        r = f"regexp_replace(w, {sql_str(pattern)}, {sql_str(chr(92) + '1' + word + chr(92) + '2')}, 'g')"
        out.append(f"y{i} AS (SELECT doc_id, pos, query, {r} AS w FROM {prev}), z{i} AS (SELECT doc_id, pos, query, {r} AS w FROM y{i})")
        prev = f"z{i}"
    return ", ".join(out), prev


_SYM, _LAST = _symbol_stages("s4")
_MATRIX_SIZE = (f"CAST(len(string_split(trim(regexp_extract(w, {sql_str(formulas.MATRIX_LITERAL)}), '[]'), ';')) AS VARCHAR) || 'x' || "
                f"CAST(len(regexp_extract_all(string_split(trim(regexp_extract(w, {sql_str(formulas.MATRIX_LITERAL)}), '[]'), ';')[1], '\\S+')) AS VARCHAR) || ' matrix'")


@query("formulas_to_words", "P13", f"""WITH {FORMULA_LINES_SQL},
  s1 AS (SELECT *, {sql_case([(sql_str(o), sql_re("query", p)) for p, o in formulas.DETERMINANT_NOTATIONS]
                            + [("'matrix cofactors and minors'", sql_re("query", formulas.COFACTOR_NOTATION) + " AND " + sql_any("lower(query)", ["cofactor", "minor"]))], "query")} AS w
         FROM fl WHERE ({" OR ".join(sql_re("query", p) for p in formulas.FORMULA_PRESENT)})),
  s2 AS (SELECT doc_id, pos, query, {sql_case([(_MATRIX_SIZE, sql_re("w", formulas.MATRIX_LITERAL))] + [(sql_str(o), sql_re("w", p)) for p, o in formulas.MATRIX_NOTATIONS], "w")} AS w FROM s1),
  s3 AS (SELECT doc_id, pos, query, {_stage("w", formulas.CALCULUS_NOTATIONS)} AS w FROM s2),
  s4 AS (SELECT doc_id, pos, query, {_replaces("w", formulas.CHEMICAL_NAMES + formulas.REACTION_SIGNS + formulas.PHYSICS_FORMULAS)} AS w FROM s3),
  {_SYM}
  SELECT doc_id, pos, w AS words FROM {_LAST}""")
def _(t):
    lines = _formula_lines(t).where(formulas.has_formula(F.col("query")))
    return lines.select("doc_id", "pos", formulas.to_words(F.col("query")).alias("words"))


def _rewrite_sql():
    q = "lower(trim(query))"
    f = formulas
    matrix = (f"len(regexp_extract_all(query, '-?\\d+\\.?\\d*')) >= 4 AND len(regexp_split_to_array(trim(query), '\\s+')) <= 20 "
              f"AND NOT {sql_any(q, f.NOT_MATRIX)} AND {sql_any(q, f.MATRIX_WORDS)}")
    task = sql_case([(sql_str(o), sql_any(q, w)) for w, o in f.MATRIX_TASKS], "'matrix operations example'")
    chem = (f"({sql_any('query', f.CHEMICALS_ASKED)} OR regexp_matches(query, '[A-Z][a-z]?\\d+[A-Z]') OR regexp_matches(query, '[A-Z][a-z]?[+-]')) "
            f"AND {sql_any(q, f.CHEMISTRY_WORDS)}")
    kind = sql_case([("'chemical reactions'", sql_any(q, ["reaction", "equation", "balance"])),
                     ("'acid base reactions'", sql_any(q, ["acid", "base", "ph"]))], "'chemical formulas and reactions'")
    calc = f"({sql_any(q, f.CALCULUS_WORDS)} OR {sql_any(q, f.CALCULUS_SIGNS)})"
    poly = f"{sql_any(q, ['quadratic', 'polynomial', 'equation'])} AND {sql_any(q, f.MATH_TASKS)}"
    rules = [("'EXERCISE: ' || query", f"(contains({q}, 'dy') AND contains({q}, 'dx')) OR contains({q}, 'differential equation') OR regexp_matches({q}, 'y\\s*=\\s*\\d+.*x\\s*=\\s*\\d+')")]
    rules += [(sql_str(o), sql_re("query", p)) for p, o in f.REWRITE_FORMULAS]
    rules += [(task, matrix), (kind, chem)]
    rules += [(sql_str(o), f"contains({q}, {sql_str(s)})") for s, o in f.PHYSICS_ASKED]
    rules += [("'integration by partial fractions'", f"contains({q}, 'partial fraction')"),
              ("'integration calculus'", f"{calc} AND {sql_any(q, ['integrate', 'integral', 'antiderivative'])}"),
              ("'differentiation calculus'", f"{calc} AND {sql_any(q, ['differentiate', 'derivative', 'differentiation'])}"),
              ("'limits calculus'", f"{calc} AND contains({q}, 'limit') AND {sql_any(q, ['x→', 'approaches', 'tends to', 'infinity'])}"),
              ("'quadratic equation formula'", f"{poly} AND contains({q}, 'quadratic')"), ("'polynomial equations'", poly)]
    rules += [(sql_str(f"formula for {w}"), f"{sql_any(q, f.FORMULA_ASKED)} AND contains({q}, '{w}')") for w in f.FORMULA_TOPICS]
    return sql_case(rules, "query")


@query("math_query_rewrites", "P14", f"WITH {FORMULA_LINES_SQL} SELECT doc_id, pos, ({' OR '.join(sql_re('query', p) for p in formulas.FORMULA_PRESENT)}) AS has_formula, {_rewrite_sql()} AS rewritten FROM fl")
def _(t):
    q = F.col("query")
    return _formula_lines(t).select("doc_id", "pos", formulas.has_formula(q).alias("has_formula"), formulas.rewrite(q).alias("rewritten"))


@query("real_formula_filter", "P15", f"""WITH {FORMULA_LINES_SQL}
  SELECT doc_id, pos FROM fl WHERE NOT {sql_any("lower(trim(query))", cues.FORMULA_NOISE)} AND length(query) >= 10 AND {sql_any("query", cues.FORMULA_SIGNS)}""")
def _(t):
    return _formula_lines(t).where(labels.real_formula(F.col("query"))).select("doc_id", "pos")


# Definition cues put before each line, by (doc_id + pos) modulo 8.
DEFINITION_HEADS = [
    "is defined as ", "refers to ", "is a type of ", "consists of ", "Matter is called ", "A map is said to be ", "This is known as Ohm''s law ", "",
]
_ENTITY_TAILS = ["", "", "", "", " relation, if it holds", " onto (or surjective), if it holds", "", ""]


def _definition_lines(t):
    c = (F.col("doc_id") + F.col("pos")) % 8
    heads = [h.replace("''", "'") for h in DEFINITION_HEADS]
    word = F.regexp_extract(F.col("line"), "[A-Za-z]{3,}", 0)
    named = F.when(c.isin(4, 5), F.concat(word, pick(c, _ENTITY_TAILS), F.lit(". "))).otherwise("")
    return t.lines().select("doc_id", "pos", F.concat(pick(c, heads), named, F.col("line")).alias("txt"))


DEFINITION_LINES_SQL = f"""{LINES_SQL},
dl AS (SELECT doc_id, pos, {case("(doc_id + pos) % 8", DEFINITION_HEADS)}
       || CASE WHEN (doc_id + pos) % 8 IN (4, 5) THEN regexp_extract(line, '[A-Za-z]{{3,}}') || {case("(doc_id + pos) % 8", _ENTITY_TAILS)} || '. ' ELSE '' END
       || line AS txt FROM lines)"""


@query("definition_like_lines", "P16", f"WITH {DEFINITION_LINES_SQL} SELECT (doc_id + pos) % 8 AS cue, {sql_re('txt', cues.DEFINITION_PARAGRAPH)} AS defines, count(*) AS n FROM dl GROUP BY ALL")
def _(t):
    d = _definition_lines(t)
    return d.groupBy(((F.col("doc_id") + F.col("pos")) % 8).alias("cue"), labels.defines(F.col("txt")).alias("defines")).agg(F.count("*").alias("n"))


@query("named_entities", "P17", f"""WITH {DEFINITION_LINES_SQL},
  x AS (SELECT doc_id, pos, trim(regexp_extract(txt, {sql_str(cues.CALLED_IF)}, 1)) AS called,
               trim(regexp_replace(regexp_extract(txt, {sql_str(cues.DEFINED_IF)}, 1), {sql_str(cues.DEFINED_IF_SUFFIX)}, '', 'g')) AS defined,
               replace(trim(regexp_extract(txt, {sql_str(cues.NAMED_LAW)}, 1)), '’', '''') AS law FROM dl)
  SELECT doc_id, pos, CASE WHEN called <> '' THEN called WHEN defined <> '' THEN defined ELSE law END AS name,
         CASE WHEN called <> '' THEN 'called_if' WHEN defined <> '' THEN 'defined_if' ELSE 'named_law' END AS cue
  FROM x WHERE called <> '' OR defined <> '' OR law <> ''""")
def _(t):
    d = _definition_lines(t).withColumn("e", labels.named_entity(F.col("txt"))).where("e IS NOT NULL")
    return d.select("doc_id", "pos", F.col("e.name").alias("name"), F.col("e.cue").alias("cue"))


def _own_type_sql(t="trim(text)"):
    rules = [("'paragraph'", f"{t} = ''")]
    for name, pattern, longest in cues.OBJECT_RULES:
        cond = sql_re(t, pattern) + (f" AND length({t}) < {longest}" if longest else "")
        rules.append((sql_str(name), cond))
    rest = f"regexp_replace(lower({t}), '^[^ ]* ', '')"
    no = " OR ".join(f"starts_with({rest}, '{w}')" for w in cues.NOT_A_HEADING)
    rules.append(("'heading'", f"({sql_re(t, cues.HEADING)} OR {sql_re(t, cues.CHAPTER_MARKER)}) AND length({t}) < {cues.HEADING_MAX} AND NOT ({no})"))
    return sql_case(rules, "NULL")


OWN_TYPE_SQL = f"""{OBJECTS_SQL},
own AS (SELECT *, {_own_type_sql()} AS own_type FROM objects)"""


@query("line_types_by_text", "P18", f"WITH {OWN_TYPE_SQL} SELECT id, coalesce(own_type, 'open') AS own_type FROM own")
def _(t):
    return t.objects().select("id", F.coalesce(labels.own_type(F.col("text")), F.lit("open")).alias("own_type"))


@query("math_fragments", "P19", f"""SELECT doc_id, len(f) AS n_fragments, md5(array_to_string(f, chr(10))) AS fragments_md5
  FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: {sql_any("x", cues.MATH_FRAGMENT_SIGNS)}), lambda x: trim(x)) AS f FROM documents)""")
def _(t):
    f = labels.math_fragments(F.col("text"))
    return t.documents.select("doc_id", F.size(f).alias("n_fragments"), F.md5(F.array_join(f, "\n")).alias("fragments_md5"))


# --- turns ----------------------------------------------------------------------------------------------------
# Openings of turns, by (conv_id + turn) modulo 16. The last three are turns of their own, put before the given one.
TURN_CUES = [
    "give me another example ", "explain that again ", "tell me more ", "what''s next ", "what does it mean ", "test me ",
    "show the solution ", "recap ", "calculate 2 ", "more examples of vectors. ", "who is the president of this ", "this concept and that part ", "",
    "clarify", "go back", "simplify",
]


def _turns(t):
    c = (F.col("conv_id") + F.col("turn")) % 16
    cue = pick(c, [x.replace("''", "'") for x in TURN_CUES])
    given = F.struct((F.col("turn") * 2 + 1).alias("turn"), F.when(c >= 13, F.col("text")).otherwise(F.concat(cue, F.col("text"))).alias("said"))
    alone = F.struct((F.col("turn") * 2).alias("turn"), cue.alias("said"))
    return t.conversations.select("conv_id", "role", F.explode(F.when(c >= 13, F.array(alone, given)).otherwise(F.array(given))).alias("t")).select("conv_id", "t.turn", "role", "t.said")


TURNS_SQL = f"""cued AS (SELECT *, (conv_id + turn) % 16 AS c, {case("(conv_id + turn) % 16", TURN_CUES)} AS cue FROM conversations),
turns AS (SELECT conv_id, turn * 2 + 1 AS turn, role, CASE WHEN c >= 13 THEN text ELSE cue || text END AS said FROM cued
  UNION ALL SELECT conv_id, turn * 2, role, cue FROM cued WHERE c >= 13)"""

_NAMED = f"trim(regexp_extract(lower(trim(said)), {sql_str(cues.EXPLICIT_CONCEPT)}, 1))"


def _follow_sql(active):
    q = "lower(trim(said))"
    out = [("'computation|Solve this problem: ' || said", f"{sql_re(q, cues.FOLLOW_UP_OPERATION)} AND {sql_re(q, cues.FOLLOW_UP_NUMBER)}")]
    for name, pattern, phrases, (before, after) in cues.FOLLOW_UP_RULES:
        conds = [sql_re(q, pattern)] if pattern else []
        if phrases:
            conds.append(f"{q} IN ({', '.join(sql_str(p) for p in phrases)})")
        out.append((f"{sql_str(name + '|' + before)} || concept || {sql_str(after)}", " OR ".join(conds)))
    opens = " OR ".join(f"starts_with({q}, '{w}')" for w in cues.QUESTION_OPENERS)
    out.append((f"'short_query|' || said || ' about ' || {active}",
                f"{active} IS NOT NULL AND len(regexp_extract_all(trim(said), '\\S+')) <= 4 AND NOT ({opens})"))
    return sql_case(out, "'none|' || said")


@query("follow_up_rewrites", "P28 F5", f"""WITH {TURNS_SQL},
  a AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'electric field' END AS active, {_NAMED} AS named FROM turns WHERE role = 'user'),
  b AS (SELECT *, CASE WHEN named <> '' AND regexp_split_to_array(named, '\\s+')[1] NOT IN ({', '.join(sql_str(w) for w in cues.NOT_A_CONCEPT)})
                       THEN named ELSE coalesce(active, 'that concept') END AS concept FROM a),
  c AS (SELECT conv_id, turn, {_follow_sql("active")} AS r FROM b)
  SELECT conv_id, turn, left(r, strpos(r, '|') - 1) AS rule, substr(r, strpos(r, '|') + 1) AS rewritten FROM c""")
def _(t):
    u = _turns(t).where("role = 'user'")
    active = F.when(F.col("conv_id") % 2 == 0, "electric field")
    return u.withColumn("f", labels.follow_up(F.col("said"), active)).select("conv_id", "turn", F.col("f.rule").alias("rule"), F.col("f.rewritten").alias("rewritten"))


def _pronoun_sql(col, concept):
    for p in [*cues.PRONOUNS, *cues.VAGUE_REFERENCES]:
        col = f"regexp_replace({col}, '(?i)\\b{p}\\b', {concept}, 'g')"
    return col


@query("pronoun_replacement", "P29", f"WITH {TURNS_SQL} SELECT conv_id, turn, {_pronoun_sql('said', sql_str('electric field'))} AS resolved FROM turns")
def _(t):
    return _turns(t).select("conv_id", "turn", labels.replace_pronouns(F.col("said"), F.lit("electric field")).alias("resolved"))


@query("off_topic_and_refusals", "P30", f"""WITH {TURNS_SQL} SELECT role, {sql_any("lower(said)", cues.OFF_TOPIC)} AS off_topic,
  {sql_any("lower(said)", cues.REFUSALS)} AS refusal, count(*) AS n FROM turns GROUP BY ALL""")
def _(t):
    s = F.col("said")
    return _turns(t).groupBy("role", labels.off_topic(s).alias("off_topic"), labels.refusal(s).alias("refusal")).agg(F.count("*").alias("n"))


@query("cache_keys", "P31", f"WITH {ASKED_SQL} SELECT query_id, left(sha256(lower(trim(query)) || '|' || lang), 16) AS cache_key FROM queries JOIN documents ON doc_id = query_id")
def _(t):
    q = t.asked().join(t.documents.select(F.col("doc_id").alias("query_id"), "lang"), "query_id")
    return q.select("query_id", labels.cache_key(F.col("query"), F.col("lang")).alias("cache_key"))
