"""Driver queries for learning state, turns and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import learning as ln
from .bindings import LEARNING_EVENTS_SQL, case, pick, sql_any, sql_str
from ..functions import cues
from .registry import query

_EFF = ", ".join(f"({sql_str(k)}, {v[0]}, {v[1]}, {sql_str(v[2]) if v[2] else 'NULL'}, {v[3]}, {v[4]}, {v[5]})" for k, v in ln.EFFECTS.items())
EFFECTS_SQL = f"""{LEARNING_EVENTS_SQL}, eff(type, dm, dc, signal, force, dr, ds) AS (VALUES {_EFF}), ev AS (SELECT * FROM learning_events JOIN eff USING (type))"""


@query("event_effects", "L1", f"""WITH {EFFECTS_SQL} SELECT type, signal, force, count(*) AS n, round(sum(dm), 4)::DOUBLE AS d_mastery, round(sum(dc), 4)::DOUBLE AS d_confidence, sum(dr) AS d_revisions, sum(ds) AS d_streak FROM ev GROUP BY 1, 2, 3""")
def _(t):
    e = ln.event_effects(t.learning_events())
    return e.groupBy("type", "signal", "force").agg(F.count("*").alias("n"), F.round(F.sum("d_mastery"), 4).alias("d_mastery"), F.round(F.sum("d_confidence"), 4).alias("d_confidence"),
                                                    F.sum("d_revisions").alias("d_revisions"), F.sum("d_streak").alias("d_streak"))


def _step(s, g):
    arms = " ".join(f"WHEN {s} = '{a}' AND {g} = '{b}' THEN '{n}'" for (a, b), n in ln.TRANSITIONS.items())
    return f"(CASE WHEN {g} = 'reset' THEN 'unseen' {arms} ELSE {s} END)"


_FOLD = "list_reduce(sigs, lambda s, g: " + _step("s", "g") + ", {start})"
DELTAS_SQL = f"""{EFFECTS_SQL}, deltas AS (SELECT student, session_id, concept_id, round(sum(dm), 6)::DOUBLE AS d_mastery, round(sum(dc), 6)::DOUBLE AS d_confidence, bool_or(force) AS force, sum(dr) AS d_revisions,
   coalesce(list(signal ORDER BY ts, seq) FILTER (signal IS NOT NULL), []) AS sigs, arg_min(seq, (ts, seq)) AS first_seq FROM ev GROUP BY 1, 2, 3)"""


@query("session_deltas", "L2", f"""WITH {DELTAS_SQL} SELECT student, session_id, concept_id, d_mastery, d_confidence, force, d_revisions, first_seq, {_FOLD.format(start="'unseen'")} AS from_unseen FROM deltas""")
def _(t):
    d = ln.session_deltas(t.learning_events())
    return d.select("student", "session_id", "concept_id", "d_mastery", "d_confidence", "force", "d_revisions", "first_seq", F.col("state_map")[0].alias("from_unseen"))


@query("state_machine", "L4", f"""WITH {DELTAS_SQL}, s AS (SELECT unnest(['unseen', 'introduced', 'practicing', 'mastered', 'forgotten', 'needs_review']) AS state)
  SELECT session_id, state, {_FOLD.format(start="state")} AS after, count(*) AS n FROM deltas, s GROUP BY 1, 2, 3""")
def _(t):
    d = ln.session_deltas(t.learning_events())
    pairs = F.arrays_zip(F.array(*[F.lit(s) for s in ln.STATES]).alias("state"), F.col("state_map").alias("after"))
    return d.select("session_id", F.inline(pairs)).toDF("session_id", "state", "after").groupBy("session_id", "state", "after").agg(F.count("*").alias("n"))


# One recursion step per session and (student, concept).
REPLAY_SQL = f"""RECURSIVE {DELTAS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY student, concept_id ORDER BY session_id) AS i FROM deltas),
st AS (SELECT DISTINCT student, concept_id, 0::BIGINT AS i, 0::DOUBLE AS mastery, 0::DOUBLE AS confidence, 'unseen' AS state, FALSE AS completed, 0::HUGEINT AS revisions FROM deltas
  UNION ALL SELECT student, concept_id, n.i, m, c, CASE WHEN m >= 0.8 THEN 'mastered' ELSE folded END, completed OR m >= 0.8, revisions FROM (
    SELECT o.student, o.concept_id, o.i, CASE WHEN o.force THEN greatest(greatest(0, least(1, round(mastery + d_mastery, 6))), 0.8) ELSE greatest(0, least(1, round(mastery + d_mastery, 6))) END AS m,
      greatest(0, least(1, round(confidence + d_confidence, 6))) AS c, {_FOLD.format(start="state")} AS folded, completed, revisions + d_revisions AS revisions
    FROM st JOIN o ON o.student = st.student AND o.concept_id = st.concept_id AND o.i = st.i + 1) n),
final AS (SELECT student, concept_id, arg_max(mastery, i) AS mastery, arg_max(confidence, i) AS confidence, arg_max(state, i) AS state, arg_max(completed, i) AS completed, arg_max(revisions, i) AS revisions FROM st GROUP BY 1, 2)"""


def _final(t):
    return ln.replay(ln.session_deltas(t.learning_events()))


@query("student_state", "L3", f"WITH {REPLAY_SQL} SELECT student, concept_id, round(mastery, 4) AS mastery, round(confidence, 4) AS confidence, state, completed, revisions::BIGINT AS revisions FROM final")
def _(t):
    return _final(t).select("student", "concept_id", F.round("mastery", 4).alias("mastery"), F.round("confidence", 4).alias("confidence"), "state", "completed", "revisions")


@query("derived_states", "L5", f"""WITH {DELTAS_SQL}, m AS (SELECT student, concept_id, greatest(0, least(1, sum(d_mastery))) AS mastery FROM deltas GROUP BY 1, 2)
  SELECT student, concept_id, CASE WHEN concept_id = 0 THEN 'unseen' WHEN round(mastery, 6) >= 0.8 THEN 'mastered' WHEN round(mastery, 6) >= 0.3 THEN 'practicing' ELSE 'introduced' END AS state FROM m""")
def _(t):
    m = ln.session_deltas(t.learning_events()).groupBy("student", "concept_id").agg(F.sum("d_mastery").alias("m"))
    m = m.withColumn("mastery", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m"))), 6))
    return m.select("student", "concept_id", ln.derived_state(F.col("mastery"), F.col("concept_id") != 0).alias("state"))


@query("session_summaries", "L6", f"""WITH {LEARNING_EVENTS_SQL} SELECT student, session_id, count(DISTINCT concept_id) AS studied, count(*) FILTER (type IN ('exercise_correct', 'exercise_incorrect')) AS attempted,
   count(*) FILTER (type = 'exercise_correct') AS correct, count(*) FILTER (type = 'exercise_incorrect') AS incorrect, count(*) FILTER (type = 'review_completed') AS reviews, count(*) FILTER (type = 'lesson_started') AS started,
   count(*) FILTER (type = 'concept_mastered') AS mastered_events, 0 AS streak, count(*) AS n_events FROM learning_events GROUP BY 1, 2""")
def _(t):
    return ln.session_summary(t.learning_events())


def _halves(t):
    d = ln.session_deltas(t.learning_events())
    return ln.replay(d.where("session_id < '2024-01-16'")), d.where("session_id >= '2024-01-16'")


@query("mastery_changes", "L6", f"""WITH {REPLAY_SQL}, h AS (SELECT st.student, st.concept_id, arg_max(mastery, st.i) AS mastery, arg_max(state, st.i) AS state FROM st JOIN o ON o.student = st.student AND o.concept_id = st.concept_id AND o.i = st.i WHERE session_id < '2024-01-16' GROUP BY 1, 2)
  SELECT student, concept_id, round(coalesce(h.mastery, 0), 4) AS before, round(f.mastery, 4) AS after, f.state = 'mastered' AND coalesce(h.state, 'unseen') <> 'mastered' AS newly_mastered, f.state IN ('forgotten', 'needs_review') AS needs_review
  FROM final f LEFT JOIN h USING (student, concept_id)""")
def _(t):
    first, later = _halves(t)
    c = ln.mastery_changes(first, ln.replay(later, first))
    return c.select("student", "concept_id", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "newly_mastered", "needs_review")


@query("replay_check", "L7", "SELECT count(*) AS n_states, 0 AS n_differences FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 FROM events)")
def _(t):
    first, later = _halves(t)
    once, twice = _final(t), ln.replay(later, first)
    diff = ln.table_difference(once, twice).agg(F.count("*").alias("n_differences"))
    return once.agg(F.count("*").alias("n_states")).join(F.broadcast(diff))


@query("completed_concepts", "L8", f"""WITH {DELTAS_SQL} SELECT DISTINCT student, concept_id FROM deltas WHERE force OR session_id = '2024-01-01'""")
def _(t):
    d = ln.session_deltas(t.learning_events())
    return ln.completed_concepts(d, d.where("session_id = '2024-01-01'"))


# --- turns: a turn names the concept of its first long word -----------------------------------------------------------
_TURN = "regexp_extract(text, '[A-Za-z]{9,}')"
_TURNS_SQL = f"turns AS (SELECT conv_id, turn, role, text, nullif({_TURN}, '') AS concept, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts FROM conversations)"


def _turns(t):
    c = F.nullif(F.regexp_extract("text", "[A-Za-z]{9,}", 0), F.lit(""))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return t.conversations.select("conv_id", "turn", "role", "text", c.alias("concept"), at.alias("ts"))


@query("active_concepts", "W6", f"WITH {_TURNS_SQL} SELECT conv_id, turn, last_value(concept IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active FROM turns")
def _(t):
    return ln.active_concepts(_turns(t), F.col("concept")).select("conv_id", "turn", "active")


@query("turn_context", "W7", """SELECT conv_id, turn, coalesce(len(c), 0) AS n, md5(array_to_string(c, chr(10))) AS context_md5 FROM (
   SELECT conv_id, turn, list(role || ': ' || left(text, 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c FROM conversations)""")
def _(t):
    c = ln.turn_context(t.conversations)
    return c.select("conv_id", "turn", F.coalesce(F.size("context"), F.lit(0)).alias("n"), F.md5(F.array_join("context", "\n")).alias("context_md5"))


@query("session_list", "A16", f"""WITH {_TURNS_SQL} SELECT conv_id, arg_min(left(text, 50), turn) FILTER (role = 'user') AS title, count(*) FILTER (role = 'user') AS n_turns, max(ts) AS updated, arg_max(concept, turn) FILTER (concept IS NOT NULL) AS active_concept
  FROM turns GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0""")
def _(t):
    return ln.session_list(_turns(t), F.col("concept"))


@query("expired_sessions", "ST8", f"""WITH {_TURNS_SQL} SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'empty' ELSE 'expired' END AS reason FROM turns GROUP BY 1
  HAVING max(ts) < (SELECT max(ts) FROM turns) - INTERVAL 24 HOUR OR count(*) FILTER (role = 'user') = 0""")
def _(t):
    turns = _turns(t)
    now = turns.agg(F.max("ts").alias("now"))
    return ln.expired_sessions(turns, now.scalar())


_COMMON = ", ".join(sql_str(w) for w in vocab.ANSWER_COMMON_WORDS)


def _ws(c):
    return f"list_filter(list_distinct(regexp_split_to_array(trim(lower({c})), '\\s+')), lambda w: w <> '' AND w NOT IN ({_COMMON}))"


# Subjects of the sources, by (conv_id + turn) modulo 4: the last is none of those taught.
_TAUGHT = ["mathematics", "physics", "chemistry", "history"]
_KNOWN = ", ".join(sql_str(s) for s in vocab.TAUGHT_SUBJECTS)


@query("answer_overlap", "V11", f"""WITH p AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src, role FROM conversations),
  a AS (SELECT *, {_ws("answer")} AS aw, {_ws("coalesce(src, '')")} AS sw, {sql_any("lower(answer)", cues.REFUSALS)} AS refusal, coalesce(src, '') AS nm FROM p WHERE role = 'assistant')
  SELECT conv_id, turn, round(CASE WHEN len(aw) > 0 AND len(sw) > 0 THEN len(list_intersect(aw, sw)) / len(aw) ELSE 0 END, 4) AS overlap, refusal,
   src IS NOT NULL AND {case("(conv_id + turn) % 4", _TAUGHT)} IN ({_KNOWN}) AND NOT refusal AND (CASE WHEN len(aw) > 0 AND len(sw) > 0 THEN len(list_intersect(aw, sw)) / len(aw) ELSE 0 END > 0.05 OR (nm <> '' AND contains(lower(answer), lower(nm)))) AS grounded FROM a""")
def _(t):
    c = t.conversations
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    a = c.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    none = F.array().cast("array<string>")
    a = a.select("conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("src").isNotNull(), F.array("src")).otherwise(none).alias("sources"),
                 F.when(F.col("src").isNotNull(), F.array("src")).otherwise(none).alias("source_names"),
                 F.array(pick((F.col("conv_id") + F.col("turn")) % 4, _TAUGHT)).alias("source_subjects"))
    return ln.answer_overlap(a, vocab.ANSWER_COMMON_WORDS, vocab.TAUGHT_SUBJECTS).select("conv_id", "turn", F.round("overlap", 4).alias("overlap"), "refusal", "grounded")


# Request log: an event is a request; its key is the event type, so keys are hot.
def _requests(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"))


@query("rate_window_counts", "W13", """SELECT event_id AS id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def _(t):
    return ln.rate_counts(_requests(t), seconds=3600).select("id", "in_window")


@query("repeat_gaps", "W14", """SELECT event_id AS id, round((epoch_us(ts) - epoch_us(p)) / 1e6, 3) AS gap_seconds, coalesce((epoch_us(ts) - epoch_us(p)) / 1e6 < 600, FALSE) AS within_ttl
  FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)""")
def _(t):
    return ln.repeat_gaps(_requests(t), 600).select("id", F.round("gap_seconds", 3).alias("gap_seconds"), "within_ttl")
