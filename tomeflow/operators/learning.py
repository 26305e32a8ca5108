"""Learning events folded into per-student state, and conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from ..plans.scale import carry, running

# Effect of an event: (mastery, confidence, signal, forces mastery, revisions, streak).
EFFECTS = {
    "lesson_started": (0.0, 0.0, "introduce", False, 0, 0),
    "lesson_completed": (0.0, 0.0, None, False, 0, 1),
    "exercise_attempted": (0.0, 0.0, None, False, 0, 0),
    "exercise_correct": (0.2, 0.15, "practice_success", False, 0, 0),
    "exercise_incorrect": (-0.1, -0.1, "practice_failure", False, 0, 0),
    "proof_completed": (0.15, 0.15, "practice_success", False, 0, 0),
    "proof_skipped": (0.0, 0.0, None, False, 0, 0),
    "review_completed": (0.05, 0.0, "review", False, 1, 0),
    "concept_mastered": (0.0, 0.0, "practice_success", True, 0, 0),
}
MASTERED_FLOOR = 0.8
PRACTICING_FLOOR = 0.3
STATES = ["unseen", "introduced", "practicing", "mastered", "forgotten", "needs_review"]
# Fixed values: (state, signal) -> next state. Reset leads to unseen; all other pairs change nothing.
TRANSITIONS = {
    ("unseen", "introduce"): "introduced",
    ("introduced", "practice_success"): "practicing",
    ("introduced", "practice_failure"): "introduced",
    ("introduced", "review"): "introduced",
    ("practicing", "practice_success"): "mastered",
    ("practicing", "practice_failure"): "practicing",
    ("practicing", "review"): "practicing",
    ("mastered", "practice_success"): "mastered",
    ("mastered", "decay"): "forgotten",
    ("mastered", "review"): "mastered",
    ("forgotten", "review"): "needs_review",
    ("forgotten", "introduce"): "introduced",
    ("needs_review", "practice_success"): "mastered",
    ("needs_review", "practice_failure"): "practicing",
    ("needs_review", "review"): "needs_review",
}
EVENTS_PER_BLOCK = 3600  # seconds of one session folded by one task


def event_effects(events: DataFrame) -> DataFrame:
    """Add mastery, confidence, signal, force, revisions and streak deltas of each event's type."""
    rows = [(k, *v) for k, v in EFFECTS.items()]
    table = events.sparkSession.createDataFrame(
        rows, "type string, d_mastery double, d_confidence double, signal string, force boolean, d_revisions int, d_streak int")
    return events.join(F.broadcast(table), "type")


def next_state(state: Column, signal: Column) -> Column:
    m = F.create_map(*[F.lit(x) for (s, g), n in TRANSITIONS.items() for x in (f"{s}/{g}", n)])
    return F.when(signal == "reset", F.lit("unseen")).otherwise(F.coalesce(F.try_element_at(m, F.concat_ws("/", state, signal)), state))


def _maps() -> Column:
    """Each signal as a whole map of states: the list of next states in the order of STATES."""
    signals = sorted({g for _, g in TRANSITIONS} | {"reset"})
    row = lambda g: F.array(*[F.lit("unseen" if g == "reset" else TRANSITIONS.get((s, g), s)) for s in STATES])
    return F.create_map(*[x for g in signals for x in (F.lit(g), row(g))])


def _then(first: Column, second: Column) -> Column:
    """Composition of two state maps."""
    names = F.array(*[F.lit(s) for s in STATES])
    return F.transform(first, lambda s: F.element_at(second, F.array_position(names, s).cast("int")))


def _compose(maps: Column) -> Column:
    identity = F.array(*[F.lit(s) for s in STATES])
    return F.aggregate(maps, identity, _then)


def session_deltas(events: DataFrame) -> DataFrame:
    """(student, session_id, concept_id, d_mastery, d_confidence, force, d_revisions, state_map, first_seq).

    Sums combine before the shuffle. The ordered signals of a block of time become one map from state to state;
    maps compose, so a session with very many events is folded block by block and never as one list.
    """
    keys = ["student", "session_id", "concept_id"]
    e = event_effects(events).where("concept_id IS NOT NULL").withColumn("blk", F.floor(F.unix_timestamp("ts") / EVENTS_PER_BLOCK))
    maps = _maps()
    part = e.groupBy(*keys, "blk").agg(
        F.sum("d_mastery").alias("m"), F.sum("d_confidence").alias("c"), F.bool_or("force").alias("force"), F.sum("d_revisions").alias("r"),
        F.min(F.struct("ts", "seq")).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("signal").isNotNull(), F.struct("ts", "seq", "signal")))).alias("signals"))
    part = part.withColumn("map", _compose(F.transform("signals", lambda x: maps[x["signal"]]))).drop("signals")
    out = part.groupBy(*keys).agg(
        F.round(F.sum("m"), 6).alias("d_mastery"), F.round(F.sum("c"), 6).alias("d_confidence"), F.bool_or("force").alias("force"),
        F.sum("r").alias("d_revisions"), F.min("first").alias("first"),
        _compose(F.transform(F.array_sort(F.collect_list(F.struct("blk", "map"))), lambda x: x["map"])).alias("state_map"))
    return out.withColumn("first_seq", F.col("first.seq")).drop("first")


def session_streaks(events: DataFrame) -> DataFrame:
    """(student, session_id, streak), counting events without a concept as well."""
    return event_effects(events).groupBy("student", "session_id").agg(F.sum("d_streak").alias("streak"))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def apply_delta(before: Column, delta: Column) -> Column:
    """State struct(mastery, confidence, state, completed, gap, revisions) after one session's delta.

    Clamped once per session; a forced concept has at least the mastered floor; at the floor it is completed
    and no longer a gap.
    """
    names = F.array(*[F.lit(s) for s in STATES])
    mastery = _clamp(F.round(before["mastery"] + delta["d_mastery"], 6))
    mastery = F.when(delta["force"], F.greatest(mastery, F.lit(MASTERED_FLOOR))).otherwise(mastery)
    state = F.element_at(delta["state_map"], F.array_position(names, before["state"]).cast("int"))
    done = mastery >= MASTERED_FLOOR
    return F.struct(
        mastery.alias("mastery"), _clamp(F.round(before["confidence"] + delta["d_confidence"], 6)).alias("confidence"),
        F.when(done, "mastered").otherwise(state).alias("state"), (before["completed"] | done).alias("completed"),
        (before["gap"] & ~done).alias("gap"), (before["revisions"] + delta["d_revisions"]).cast("long").alias("revisions"))


def blank_state() -> Column:
    return F.struct(
        F.lit(0.0).alias("mastery"), F.lit(0.0).alias("confidence"), F.lit("unseen").alias("state"), F.lit(False).alias("completed"),
        F.lit(False).alias("gap"), F.lit(0).cast("long").alias("revisions"))


STATE_TYPE = "struct<mastery:double,confidence:double,state:string,completed:boolean,gap:boolean,revisions:bigint>"


def replay(deltas: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(student, concept_id, mastery, confidence, state, completed, gap, revisions) after all sessions in order.

    Sessions are applied one after the other (clamping does not commute); a (student, concept) has one small
    delta per session, so the fold runs over session count, not event count. ``before`` has the output's shape.
    """
    keys = ["student", "concept_id"]
    d = F.struct("session_id", "d_mastery", "d_confidence", "force", "d_revisions", "state_map")
    g = deltas.groupBy(*keys).agg(F.array_sort(F.collect_list(d)).alias("ds"))
    start = blank_state().cast(STATE_TYPE)
    if before is not None:
        b = before.select(*keys, F.struct("mastery", "confidence", "state", "completed", "gap", "revisions").cast(STATE_TYPE).alias("b"))
        g = g.join(b, keys, "full")
        start = F.coalesce(F.col("b"), start)
        g = g.withColumn("ds", F.coalesce("ds", F.array().cast(g.schema["ds"].dataType)))
    out = g.select(*keys, F.aggregate("ds", start, lambda s, x: apply_delta(s, x).cast(STATE_TYPE)).alias("s"))
    return out.select(*keys, "s.*")


def derived_state(mastery: Column, seen: Column, needs_review: Column | None = None) -> Column:
    out = F.when(~seen, "unseen").when(mastery >= MASTERED_FLOOR, "mastered").when(mastery >= PRACTICING_FLOOR, "practicing").otherwise("introduced")
    return out if needs_review is None else F.when(needs_review, "needs_review").otherwise(out)


def session_summary(events: DataFrame) -> DataFrame:
    """Per session: concepts studied, event counters, attempts and streak."""
    t = F.col("type")
    n = lambda *ks: F.count_if(t.isin(*ks))
    return events.groupBy("student", "session_id").agg(
        F.countDistinct("concept_id").alias("studied"),
        n("exercise_attempted", "exercise_correct", "exercise_incorrect").alias("attempted"),
        n("exercise_correct").alias("correct"), n("exercise_incorrect").alias("incorrect"),
        n("review_completed").alias("reviews"), n("lesson_started").alias("started"), n("concept_mastered").alias("mastered_events"),
        n("lesson_completed").alias("streak"), F.count("*").alias("n_events"))


def mastery_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(student, concept_id, before, after, newly_mastered, needs_review) for every concept either side knows."""
    b = before.select("student", "concept_id", F.col("mastery").alias("before"), F.col("state").alias("b_state"))
    a = after.select("student", "concept_id", F.col("mastery").alias("after"), F.col("state").alias("a_state"))
    j = b.join(a, ["student", "concept_id"], "full")
    return j.select(
        "student", "concept_id", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", "before").alias("after"),
        ((F.coalesce("a_state", "b_state") == "mastered") & (F.coalesce("b_state", F.lit("unseen")) != "mastered")).alias("newly_mastered"),
        F.coalesce("a_state", "b_state").isin("forgotten", "needs_review").alias("needs_review"))


def completed_concepts(deltas: DataFrame, prior: DataFrame) -> DataFrame:
    """(student, concept_id): distinct completed concepts, prior ones included."""
    new = deltas.where("force").select("student", "concept_id")
    return prior.select("student", "concept_id").unionByName(new).distinct()


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only one side has; empty when a replay gives the same table."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# --- turns ------------------------------------------------------------------------------------------------------
TURNS_PER_BLOCK = 4096


def active_concepts(turns: DataFrame, concept: Column) -> DataFrame:
    """Add active: the last known ``concept`` of the conversation before each turn."""
    return carry(turns, ["conv_id"], ["turn"], {"active": concept}, F.floor(F.col("turn") / TURNS_PER_BLOCK), inclusive=False)


def turn_context(turns: DataFrame, k: int = 5, chars: int = 300) -> DataFrame:
    """Add context: the k turns before, oldest first, each cut at ``chars``.

    Turns are numbered without gaps, so the k before are met by an equi-join on their number and no
    conversation is held by one task.
    """
    said = turns.select("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.col("turn") + i)).alias("turn"),
                        F.struct(F.col("turn").alias("at"), F.concat_ws(": ", "role", F.substring("text", 1, chars)).alias("said")).alias("s"))
    context = said.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["said"]).alias("context"))
    return turns.join(context, ["conv_id", "turn"], "left")


def session_list(turns: DataFrame, concept: Column | None = None) -> DataFrame:
    """One row per conversation with user turns: title (first user text, 50 characters), turns, last update, active concept."""
    user = F.col("role") == "user"
    known = concept if concept is not None else F.lit(None).cast("string")
    g = turns.groupBy("conv_id").agg(
        F.min_by(F.substring("text", 1, 50), F.when(user, F.col("turn"))).alias("title"), F.count_if(user).alias("n_turns"),
        F.max("ts").alias("updated"), F.max_by(known, F.when(known.isNotNull(), F.col("turn"))).alias("active_concept"))
    return g.where("n_turns > 0")


def expired_sessions(turns: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Conversations past their time to live, or without a user turn."""
    g = turns.groupBy("conv_id").agg(F.max("ts").alias("updated"), F.count_if(F.col("role") == "user").alias("n_user"))
    old = F.col("updated") < now - F.make_interval(hours=F.lit(hours))
    return g.where(old | (F.col("n_user") == 0)).select("conv_id", F.when(F.col("n_user") == 0, "empty").otherwise("expired").alias("reason"))


def answer_overlap(answers: DataFrame, common: list[str], known: list[str], least: float = 0.05) -> DataFrame:
    """Add overlap (share of the answer's own words found in its sources), refusal and grounded.

    ``answers``: (answer, sources array<string>, source_names array<string>, source_subjects array<string>). Only an answer
    with a source of a ``known`` subject can be grounded.
    """
    ws = lambda c: F.filter(F.array_distinct(F.split(text.trim(F.lower(c)), r"\s+")), lambda w: (w != "") & ~w.isin(common))
    a, s = ws(F.col("answer")), ws(F.array_join("sources", " "))
    out = answers.withColumn("_a", a).withColumn("_s", s)
    overlap = F.when((F.size("_a") > 0) & (F.size("_s") > 0), F.size(F.array_intersect("_a", "_s")) / F.size("_a")).otherwise(0.0)
    named = F.exists("source_names", lambda n: (n != "") & F.contains(F.lower(F.col("answer")), F.lower(n)))
    out = out.withColumn("overlap", overlap).withColumn("refusal", labels.refusal(F.col("answer")))
    taught = F.coalesce(F.exists("source_subjects", lambda s: F.coalesce(s.isin(known), F.lit(False))), F.lit(False))
    return out.withColumn("grounded", (F.size("sources") > 0) & taught & ~F.col("refusal") & ((F.col("overlap") > least) | named)).drop("_a", "_s")


# --- request rates and repeats --------------------------------------------------------------------------------------
def rate_counts(requests: DataFrame, seconds: int = 60, block: int = 60) -> DataFrame:
    """Add in_window: requests of the key in the trailing window, this one included, and over_limit candidates.

    A request's window touches its own time block and the one before, so rows are repeated into two blocks and
    each (key, block) is scanned on its own.
    """
    t = F.unix_micros("ts")
    size = max(seconds, block) * 1_000_000
    b = F.floor(t / size)
    rows = requests.withColumn("_t", t).withColumn("_own", b).withColumn("_blk", F.explode(F.array(b, b + 1)))
    w = Window.partitionBy("key", "_blk").orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("in_window", F.count("*").over(w)).where("_blk = _own").drop("_t", "_own", "_blk")


def repeat_gaps(requests: DataFrame, ttl: int) -> DataFrame:
    """Add gap_seconds since the key was last asked and within_ttl. The carry is cut into hours."""
    out = carry(requests, ["key"], ["ts", "id"], {"_prev": F.col("ts")}, F.floor(F.unix_timestamp("ts") / 3600), inclusive=False)
    gap = (F.unix_micros("ts") - F.unix_micros("_prev")) / 1e6
    return out.withColumn("gap_seconds", gap).withColumn("within_ttl", F.coalesce(gap < ttl, F.lit(False))).drop("_prev")
