"""Structured Streaming forms of the event, request and query-log jobs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import labels
from ..operators.learning import EFFECTS, MASTERED_FLOOR, TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Ordered(StatefulProcessor):
    """Keeps the rows of a key until the watermark has passed them, then hands them over in (time, id) order.

    State holds no more than the watermark's delay of rows. A key has one timer, set for its earliest waiting row; when it
    fires, all rows that the watermark has passed are handed over at once. Rows behind the watermark are told apart.
    Waiting rows are one list, added to once a batch and read once when due: a call to the state store costs more than a row.
    """

    row_schema = "x int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, id long, {self.row_schema}")
        self.armed = handle.getValueState("armed", "ms long")

    def row(self, r) -> tuple:
        return (1,)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, fresh = [], []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                us = int(r.us)
                if mark > 0 and us // 1000 < mark:
                    late.append((us, int(r.id), *self.row(r)))
                    continue
                fresh.append((us, int(r.id), *self.row(r)))
        if fresh:
            self.waiting.appendList(fresh)
            self._arm(min(r[0] for r in fresh))
        if late:
            yield self.late(key, late)

    def _arm(self, us: int) -> None:
        at = us // 1000 + 1
        old = self.armed.get()[0] if self.armed.exists() else None
        if old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        upto = timerValues.getCurrentWatermarkInMs()
        # A row that comes again with its time and id takes the place of the one before.
        rows = sorted({(int(r[0]), int(r[1])): tuple(r[2:]) for r in self.waiting.get()}.items(), key=lambda r: r[0])
        due = [r for r in rows if r[0][0] // 1000 < upto]
        rest = rows[len(due):]
        if rest:
            self.waiting.put([(*k, *r) for k, r in rest])
            self._arm(rest[0][0][0])
        else:
            self.waiting.clear()
        if due:
            yield self.apply(key, due)

    def close(self) -> None:
        pass


class MasteryProcessor(_Ordered):
    """Learning state per (student, concept). Deltas add up over a session and are clamped once, when it ends.

    A student is one key with all concepts: keys cost more than rows, and a student meets many concepts.
    """

    row_schema = "concept int, type string, session string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.states = handle.getListState(
            "states", "concept int, mastery double, confidence double, state string, revisions long, session string, dm double, dc double, forced boolean")

    def row(self, r) -> tuple:
        return (int(r.concept_id), r.type, r.session_id)

    def late(self, key, rows) -> pd.DataFrame:
        counts = Counter(r[2] for r in rows)
        return pd.DataFrame([[key[0], c, None, None, None, None, None, n] for c, n in counts.items()], columns=MASTERY_COLUMNS)

    def apply(self, key, events) -> pd.DataFrame:
        states = {int(s[0]): tuple(s[1:]) for s in self.states.get()} if self.states.exists() else {}
        last = {}
        for (us, _), (concept, kind, sid) in events:
            mastery, confidence, state, revisions, session, dm, dc, forced = states.get(concept, (0.0, 0.0, "unseen", 0, "", 0.0, 0.0, False))
            if sid != session:
                mastery, confidence = settle(mastery, confidence, dm, dc, forced)
                state = "mastered" if mastery >= MASTERED_FLOOR else state
                session, dm, dc, forced = sid, 0.0, 0.0, False
            m, c, signal, force, rev, _ = EFFECTS[kind]
            dm, dc, forced, revisions = dm + m, dc + c, bool(forced or force), revisions + rev
            if signal:
                state = TRANSITIONS.get((state, signal), state)
            states[concept] = (mastery, confidence, state, revisions, session, dm, dc, forced)
            last[concept] = us
        self.states.put([(c, *s) for c, s in states.items()])
        out = []
        for concept, us in last.items():
            mastery, confidence, state, revisions, _, dm, dc, forced = states[concept]
            m, c = settle(mastery, confidence, dm, dc, forced)
            out.append([key[0], concept, us, m, c, "mastered" if m >= MASTERED_FLOOR else state, revisions, 0])
        return pd.DataFrame(out, columns=MASTERY_COLUMNS)


MASTERY_COLUMNS = ["student", "concept_id", "us", "mastery", "confidence", "state", "revisions", "late"]
MASTERY_SCHEMA = "student long, concept_id int, us long, mastery double, confidence double, state string, revisions long, late long"


def settle(mastery: float, confidence: float, dm: float, dc: float, forced: bool) -> tuple[float, float]:
    """Close a session: add its sums, clamp, and lift forced concepts to the floor."""
    clamp = lambda x: max(0.0, min(1.0, round(x, 6)))
    m = clamp(mastery + round(dm, 6))
    return (max(m, MASTERED_FLOOR) if forced else m), clamp(confidence + round(dc, 6))


def mastery_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """State updates of every (student, concept); the last row by ``us`` per key is its state."""
    e = events.where("concept_id IS NOT NULL").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    e = e.select("student", "concept_id", "session_id", F.col("seq").alias("id"), "ts", "us", "type")
    return e.groupBy("student").transformWithStateInPandas(
        statefulProcessor=MasteryProcessor(), outputStructType=MASTERY_SCHEMA, outputMode="Update", timeMode="EventTime")


class RateLimitProcessor(_Ordered):
    """Accepts at most ``limit`` requests of a key in any trailing window; refused ones leave no trace."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "us long")

    def late(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame([[key[0], id_, us, "late"] for us, id_, *_ in rows], columns=RATE_COLUMNS)

    def apply(self, key, rows) -> pd.DataFrame:
        times = sorted(int(t[0]) for t in self.accepted.get()) if self.accepted.exists() else []
        out = []
        for (us, id_), _ in rows:
            times = [t for t in times if t > us - self.window]
            ok = len(times) < self.limit
            if ok:
                times.append(us)
            out.append([key[0], id_, us, "accepted" if ok else "rejected"])
        self.accepted.put([(t,) for t in times])
        return pd.DataFrame(out, columns=RATE_COLUMNS)


class TtlProcessor(_Ordered):
    """Lets a request through when its key was not let through within the life before it; hits do not prolong the life."""

    def __init__(self, seconds: float):
        self.life = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.missed = handle.getValueState("missed", "us long")

    def late(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame([[key[0], id_, us, "late"] for us, id_, *_ in rows], columns=RATE_COLUMNS)

    def apply(self, key, rows) -> pd.DataFrame:
        last = int(self.missed.get()[0]) if self.missed.exists() else None
        out = []
        for (us, id_), _ in rows:
            if last is None or us >= last + self.life:
                last = us
                out.append([key[0], id_, us, "miss"])
        if out:
            self.missed.update((last,))
        return pd.DataFrame(out, columns=RATE_COLUMNS)


RATE_COLUMNS = ["key", "id", "us", "verdict"]
RATE_SCHEMA = "key string, id long, us long, verdict string"


def rate_limit_stream(requests: DataFrame, limit: int = 30, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """(key, id, us, verdict) of requests (key, id, ts)."""
    r = requests.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).select("key", "id", "us", "ts")
    return r.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateLimitProcessor(limit, seconds), outputStructType=RATE_SCHEMA, outputMode="Append", timeMode="EventTime")


def session_rollup(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity gap: counters per student and session window. Works on batch and stream alike.

    ``concepts`` is exact: a session's distinct concepts are its state, and a stream takes no distinct count."""
    t = F.col("type")
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "student").agg(
        F.count("*").alias("n_events"), F.count_if(t.isin("exercise_attempted", "exercise_correct", "exercise_incorrect")).alias("attempted"),
        F.count_if(t == "exercise_correct").alias("correct"), F.size(F.collect_set("concept_id")).alias("concepts"),
    ).select("student", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "attempted", "correct", "concepts")


def first_in_ttl(requests: DataFrame, seconds: float = 600, delay: str = "1 minute") -> DataFrame:
    """(key, id, us, verdict) of the requests (key, id, ts) that find nothing alive for their key, in time order."""
    r = requests.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).select("key", "id", "us", "ts")
    return r.groupBy("key").transformWithStateInPandas(
        statefulProcessor=TtlProcessor(seconds), outputStructType=RATE_SCHEMA, outputMode="Append", timeMode="EventTime")


def request_counts(requests: DataFrame, size: str = "60 seconds", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Requests per key and tumbling or sliding window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return requests.withWatermark("ts", delay).groupBy(w.alias("w"), "key").agg(F.count("*").alias("n")).select(
        "key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def enriched_queries(queries: DataFrame, names: DataFrame, rules: list[tuple[str, Column, str]], default: str) -> DataFrame:
    """Labels and routing of a query stream. ``names``: static (key, matched_concept); the match is a stream-static join."""
    p = labels.profile(queries).withColumn("key", labels.text.set_key(labels.text.lookup_tokens(F.col("query"))))
    return labels.route(p.join(names, "key", "left").withColumn("is_exact", F.col("matched_concept").isNotNull()), rules, default)


def refresh_embeddings(stream: DataFrame, root: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Embed changed documents of a stream (id, text, checksum) and append them under ``root``, one folder per batch.

    A replayed batch overwrites its own folder, so it counts once. Rows whose (id, checksum) is already stored
    by an earlier batch are not embedded again.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = StructType.fromDDL("id bigint, checksum string, vector array<double>, batch int")
        stored = spark.read.schema(schema).option("basePath", root).parquet(f"{root}/batch=*").where(F.col("batch") < batch_id) if batch_id else None
        new = batch if stored is None else batch.join(stored.select("id", "checksum"), ["id", "checksum"], "left_anti")
        embed(new).select("id", "checksum", "vector").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def expiring_sessions(turns: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Conversations by inactivity: a session window closes when no turn came for ``ttl``."""
    return turns.withWatermark("ts", "1 minute").groupBy(F.session_window("ts", ttl).alias("w"), "conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user")).select("conv_id", F.col("w.end").alias("expired_at"), "n_turns", "n_user")
