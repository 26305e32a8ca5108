import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from tomeflow.operators import learning as ln
from tomeflow.sources import io
from tomeflow.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)
EVENTS = "student long, session_id string, seq long, ts timestamp, type string, concept_id int"


def events(spark, *kinds, concept=1, session="s1", start=0):
    rows = [(1, session, start + i, T0 + dt.timedelta(minutes=start + i), k, concept) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, EVENTS)


def state(spark, e, before=None):
    return ln.replay(ln.session_deltas(e), before).first()


def test_transitions(spark):
    cases = [("unseen", "introduce", "introduced"), ("introduced", "practice_success", "practicing"), ("practicing", "practice_success", "mastered"), ("mastered", "decay", "forgotten"),
             ("forgotten", "review", "needs_review"), ("needs_review", "practice_success", "mastered"), ("mastered", "reset", "unseen"), ("practicing", "introduce", "practicing")]
    df = spark.createDataFrame(cases, "s string, g string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", ln.next_state(F.col("s"), F.col("g"))).collect())


def test_fold(spark):
    s = state(spark, events(spark, "lesson_started", "exercise_attempted", "exercise_correct", "exercise_correct", "proof_completed", "concept_mastered"))
    assert (s.state, s.mastery, s.completed) == ("mastered", 0.8, True)
    before = spark.createDataFrame([(1, 1, 0.5, 0.5, "practicing", False, False, 0)], "student long, concept_id int, mastery double, confidence double, state string, completed boolean, gap boolean, revisions long")
    assert state(spark, events(spark, "exercise_attempted", "exercise_incorrect"), before).mastery == 0.4
    assert state(spark, events(spark, "proof_skipped"), before).mastery == 0.5
    # Clamping happens once per session, so the order of sessions matters.
    two = events(spark, "exercise_incorrect").unionByName(events(spark, "exercise_correct", session="s2", start=10))
    assert state(spark, two).mastery == 0.2


def test_fold_across_blocks_equals_one_block(spark):
    kinds = ["lesson_started", "exercise_correct", "review_completed", "exercise_incorrect", "exercise_correct"] * 60
    e = events(spark, *kinds)
    one = e.withColumn("ts", F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(secs=F.col("seq") / 1000))
    assert state(spark, e) == state(spark, one)


def stream_of(spark, df, schema):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_mastery_stream_equals_batch(spark):
    e = events(spark, "lesson_started", "exercise_correct", "exercise_correct", "review_completed")
    e = e.unionByName(events(spark, "exercise_correct", "concept_mastered", session="s2", start=100)).unionByName(events(spark, "exercise_incorrect", concept=2, start=50))
    end = spark.createDataFrame([(9, "z", 999, T0 + dt.timedelta(days=2), "lesson_started", 9)], EVENTS)
    rows = drain(spark, st.mastery_stream(stream_of(spark, e.unionByName(end), e.schema)), "update", "mastery_test")
    last = {}
    for r in sorted(rows, key=lambda r: r.us):
        last[(r.student, r.concept_id)] = (r.mastery, r.confidence, r.state, r.revisions)
    want = {(r.student, r.concept_id): (r.mastery, r.confidence, r.state, r.revisions) for r in ln.replay(ln.session_deltas(e)).collect()}
    assert {k: v for k, v in last.items() if k[0] == 1} == want


def test_rate_limit_stream(spark):
    secs = [0, 10, 20, 30, 59, 60, 61, 65, 200, 201, 202, 203]
    rows = [("k", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)] + [("z", 99, T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    got = {r.id: r.verdict for r in drain(spark, st.rate_limit_stream(stream_of(spark, df, df.schema), limit=3, seconds=60), "append", "rate_test") if r.key == "k"}
    want, kept = {}, []
    for i, s in enumerate(secs):
        kept = [t for t in kept if t > s - 60]
        want[i] = "accepted" if len(kept) < 3 else "rejected"
        if want[i] == "accepted":
            kept.append(s)
    assert got == want


def test_turns(spark):
    t = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}", "c" if i == 2 else None) for i in range(8)], "conv_id long, turn long, role string, text string, concept string")
    ctx = {r.turn: r.context for r in ln.turn_context(t, 3).collect()}
    assert ctx[0] is None and ctx[5] == ["user: t2", "assistant: t3", "user: t4"]
    act = {r.turn: r.active for r in ln.active_concepts(t, F.col("concept")).collect()}
    assert act[2] is None and act[3] == act[7] == "c"


def test_manifest_and_versions(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{root}/m.json", "w") as f:
        json.dump({"books": [{"file": "a.pdf", "title": "A", "subject": "s"}]}, f)
    m = io.read_manifest(spark, f"{root}/m.json")
    rows = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "file string")
    assert {(r.file, r.title) for r in io.with_manifest(rows, m).collect()} == {("a.pdf", "A"), ("b.pdf", None)}
    t1 = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    version = lambda df: io.content_version(df, "p", "m", 4).first().version
    assert version(t1) == version(t1.orderBy(F.desc("id"))) != version(t1.withColumn("text", F.upper("text")))


class Store:
    """State of one key that counts its calls."""

    def __init__(self):
        self.lists, self.values, self.timers, self.calls = {}, {}, [], 0

    def getListState(self, name, schema):  # noqa: N802
        return Part(self, self.lists.setdefault(name, []))

    def getMapState(self, name, key, value):  # noqa: N802
        return Part(self, self.lists.setdefault(name, []))

    def getValueState(self, name, schema):  # noqa: N802
        return Part(self, self.values.setdefault(name, []))

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.remove(ms)


class Part:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def __getattr__(self, name):
        def call(*args):
            self.store.calls += 1
            if name == "appendList":
                self.held.extend(args[0])
            elif name == "put":
                self.held[:] = args[0]
            elif name == "update":
                self.held[:] = [args[0]]
            elif name == "clear":
                self.held.clear()
            elif name == "exists":
                return bool(self.held)
            elif name == "get":
                return iter(list(self.held)) if self.held and len(self.held[0]) > 1 else self.held[0]
        return call


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_state_calls_do_not_grow_with_the_rows_of_a_key():
    import pandas as pd

    def calls(n):
        store, p = Store(), st.MasteryProcessor()
        p.init(store)
        kinds = ["lesson_started", "exercise_correct"]
        rows = pd.DataFrame({"us": [i * 1000_000 for i in range(n)][::-1], "id": range(n)[::-1], "type": [kinds[i % 2] for i in range(n)], "session_id": ["s"] * n, "concept_id": [i % 5 for i in range(n)]})
        assert not list(p.handleInputRows((1,), iter([rows]), Clock(0)))
        out = list(p.handleExpiredTimer((1,), Clock(n * 1000 - 1500), None))
        assert len(out) == 1 and len(out[0]) == 5 and out[0].us.max() == (n - 2) * 1000_000 and store.timers[-1] == (n - 1) * 1000 + 1
        assert [r[:2] for r in store.lists["waiting"]] == [((n - 1) * 1000_000, n - 1)]
        return store.calls

    assert calls(200) == calls(20)
