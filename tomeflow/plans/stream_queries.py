"""Driver queries for sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import requests, vectors
from ..sources import io
from ..streaming import streams as st
from .bindings import LEARNING_EVENTS_SQL, Tables
from .learning_queries import REPLAY_SQL
from .registry import query
from .scale import shared_folder


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------------------------------------------
@query("scan_index_files", "S1", "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def _(t):
    d = io.scan_index(t.spark, f"{t.folder}/documents*.parquet", t.documents.schema, "*.parquet")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("scan_artifacts", "S2", "SELECT lang, count(*) AS n, sum(quality) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    parts = {n: (t.read(n).schema, f"{n}.parquet") for n in ("documents", "labels")}
    a = io.scan_artifacts(t.spark, t.folder, parts)
    return a["documents"].join(a["labels"], "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query("manifest_join", "S4", "SELECT source AS file, n_name AS title, count(*) AS n FROM documents LEFT JOIN nation ON source = 'src' || n_nationkey GROUP BY 1, 2")
def _(t):
    # The manifest is a JSON file, as books have; a row per nation.
    book = F.struct(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_name").alias("title"), F.lit("geography").alias("subject"))
    path = _folder(t)
    t.nation.agg(F.collect_list(book).alias("books")).write.json(path)
    manifest = io.read_manifest(t.spark, path).drop("subject")
    return io.with_manifest(t.documents.withColumnRenamed("source", "file"), manifest).groupBy("file", "title").agg(F.count("*").alias("n"))


@query("vector_round_trip", "S3", "SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def _(t):
    path = _folder(t)
    io.write_vectors(t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")), path)
    v = io.read_vectors(t.spark, path, "bigint")
    return v.select("id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("book_replace_export", "S5", "SELECT source AS book_id, count(*) AS n, sum(CASE WHEN source IN ('src1', 'src2') THEN n_chars + 1 ELSE n_chars END) AS chars FROM documents GROUP BY 1")
def _(t):
    path = _folder(t)
    d = t.documents.select(F.col("source").alias("book_id"), "doc_id", "n_chars")
    io.replace_books(d, path)
    io.replace_books(d.where("book_id IN ('src1', 'src2')").withColumn("n_chars", F.col("n_chars") + 1), path)
    return t.spark.read.parquet(path).groupBy("book_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("keyed_upsert", "S6", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS batch FROM documents UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE lang = 'fr'""")
def _(t):
    d = t.documents
    old = d.select("doc_id", F.lit("old").alias("batch"))
    new = d.where("lang = 'en'").select("doc_id", F.lit("new").alias("batch")).unionByName(d.where("lang = 'fr'").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("batch")))
    return io.upsert(old, new, ["doc_id"])


@query("processing_states", "S7", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return io.latest_states(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("version_uses", "S7", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS version, max(event_id) AS last_used FROM events GROUP BY 1, 2")
def _(t):
    return io.version_uses(t.events.select("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("version"), "event_id"), ["event_type", "version"], "event_id")


@query("content_version", "S8", """WITH r AS (SELECT sha256(doc_id || '=' || text) AS h FROM documents),
  s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS s{i}" for i in range(4)) + """ FROM r)
  SELECT left(sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3 || '|hashing|hashing-bow-256|256'), 12) AS version FROM s""")
def _(t):
    return io.content_version(t.documents.select(F.col("doc_id").alias("id"), "text"), "hashing", "hashing-bow-256", 256)


@query("versioned_load", "S9 S8", "SELECT vec_id AS id, label FROM embeddings")
def _(t):
    root = _folder(t)
    v = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    io.write_version(v.where("label < 3"), root, "aaaaaaaaaaaa")
    io.write_version(v, root, "bbbbbbbbbbbb")
    io.write_version(v.limit(0), root, "bbbbbbbbbbbb")
    return io.load_version(t.spark, root)


@query("vector_upsert", "S10", "SELECT vec_id AS id, CASE WHEN label = 1 THEN 100 ELSE label END AS label FROM embeddings WHERE label <> 2")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return io.upsert(v, v.where("label = 1").withColumn("label", F.lit(100)), ["id"], v.where("label = 2"))


# --- streams -------------------------------------------------------------------------------------------------------
END = "2200-01-01"


def _stream_events(t) -> DataFrame:
    """The events file as a stream. A last row far ahead, under a key of its own, ends the input: the watermark passes all
    other rows, and the row itself is never due."""
    end = _folder(t)
    last = t.events.limit(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for f in t.events.schema for v in [
        {"event_id": -1, "ts": END, "user_id": -1, "event_type": "end", "props": '{"k": -1}'}.get(f.name)]])
    last.write.parquet(end)
    src = t.stream("events").unionByName(t.spark.readStream.schema(t.events.schema).parquet(end))
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


class _StreamTables(Tables):
    """The same bindings over the streamed events."""

    def read(self, name: str) -> DataFrame:
        return _stream_events(Tables(self.spark, self.folder)) if name == "events" else super().read(name)


def _drain(t, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and give what it wrote."""
    out = _folder(t)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}_chk").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


def _ts_requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"))


_SEC = "CAST(epoch(ts) AS BIGINT)"


_SESSIONS_SQL = f"""WITH {LEARNING_EVENTS_SQL}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY student ORDER BY ts, seq) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY student ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS new FROM learning_events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY student ORDER BY ts, seq) AS sid FROM g)
  SELECT student, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n_events, count(*) FILTER (type IN ('exercise_correct', 'exercise_incorrect')) AS attempted,
    count(*) FILTER (type = 'exercise_correct') AS correct, count(DISTINCT concept_id) AS concepts FROM s GROUP BY student, sid"""


@query("session_windows", "ST2", _SESSIONS_SQL)
def _(t):
    e = t.learning_events().withColumn("ts", F.col("ts").cast("timestamp"))
    return st.session_rollup(e)


@query("tumbling_request_counts", "ST5", "SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 MINUTE, ts) AS started, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return st.request_counts(_ts_requests(t.events)).select("key", "started", "n")


@query("sliding_request_counts", "ST5", """SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * i) AS started, count(*) AS n FROM events, range(6) r(i) GROUP BY 1, 2""")
def _(t):
    return st.request_counts(_ts_requests(t.events), "60 seconds", "10 seconds").select("key", "started", "n")


@query("streamed_request_counts", "ST5", "SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 MINUTE, ts) AS started, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS ended, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return _drain(t, st.request_counts(_ts_requests(_stream_events(t))))


@query("streamed_session_windows", "ST2", _SESSIONS_SQL)
def _(t):
    e = _StreamTables(t.spark, t.folder).learning_events()
    return _drain(t, st.session_rollup(e))


# One recursion step per request of a key.
_IN_ORDER = """o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


@query("streamed_first_in_ttl", "ST3", f"""WITH RECURSIVE {_IN_ORDER},
  r AS (SELECT key, id, us, i, us AS last FROM o WHERE i = 1
    UNION ALL SELECT o.key, o.id, o.us, o.i, CASE WHEN o.us >= r.last + 600000000 THEN o.us ELSE r.last END FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
  SELECT key, id, us, 'miss' AS verdict FROM r WHERE last = us AND (i = 1 OR NOT EXISTS (SELECT 1 FROM r p WHERE p.key = r.key AND p.i = r.i - 1 AND p.last = r.last))""")
def _(t):
    st.use_state_store(t.spark)
    return _drain(t, st.first_in_ttl(_ts_requests(_stream_events(t)), 600))


_TTL_SQL = f"""{_IN_ORDER},
  r AS (SELECT key, id, us, i, us AS last FROM o WHERE i = 1
    UNION ALL SELECT o.key, o.id, o.us, o.i, CASE WHEN o.us >= r.last + 600000000 THEN o.us ELSE r.last END FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1),
  v AS (SELECT key, id, us, CASE WHEN last = us AND (i = 1 OR lag(last) OVER (PARTITION BY key ORDER BY i) <> last) THEN 'miss' ELSE 'hit' END AS verdict FROM r)"""


@query("first_in_life", "W14", f"WITH RECURSIVE {_TTL_SQL} SELECT key, id, us, verdict FROM v")
def _(t):
    return requests.first_in_life(_ts_requests(t.events), 600)


@query("rate_verdicts", "W13", f"""WITH RECURSIVE {_IN_ORDER},
  r AS (SELECT key, id, us, i, [us] AS times, 'accepted' AS verdict FROM o WHERE i = 1
    UNION ALL SELECT key, id, us, i, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END, CASE WHEN len(kept) < 3 THEN 'accepted' ELSE 'rejected' END FROM (
      SELECT o.*, list_filter(r.times, lambda x: x > o.us - 3600000000) AS kept FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1))
  SELECT key, id, us, verdict, 3 - len(times) AS remaining FROM r""")
def _(t):
    return requests.rate_verdicts(_ts_requests(t.events), limit=3, seconds=3600)


@query("streamed_mastery", "ST1", f"WITH {REPLAY_SQL} SELECT student, concept_id, round(mastery, 4) AS mastery, round(confidence, 4) AS confidence, state, revisions::BIGINT AS revisions FROM final")
def _(t):
    st.use_state_store(t.spark)
    e = _StreamTables(t.spark, t.folder).learning_events()
    rows = _drain_updates(t, st.mastery_stream(e))
    last = rows.where("late = 0").groupBy("student", "concept_id").agg(F.max_by(F.struct("mastery", "confidence", "state", "revisions"), "us").alias("s"))
    return last.select("student", "concept_id", F.round("s.mastery", 4).alias("mastery"), F.round("s.confidence", 4).alias("confidence"), "s.state", "s.revisions")


def _drain_updates(t, df: DataFrame) -> DataFrame:
    """Updates of a keyed stream, one folder per batch so that a replayed batch counts once."""
    out = _folder(t)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = df.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{out}_chk").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("streamed_rate_limit", "ST4", f"""WITH RECURSIVE {_IN_ORDER},
  r AS (SELECT key, id, us, i, [us] AS times, 'accepted' AS verdict FROM o WHERE i = 1
    UNION ALL SELECT key, id, us, i, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END, CASE WHEN len(kept) < 3 THEN 'accepted' ELSE 'rejected' END FROM (
      SELECT o.*, list_filter(r.times, lambda x: x > o.us - 3600000000) AS kept FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1))
  SELECT key, id, us, verdict FROM r""")
def _(t):
    st.use_state_store(t.spark)
    return _drain(t, st.rate_limit_stream(_ts_requests(_stream_events(t)), limit=3, seconds=3600))


@query("streamed_query_labels", "ST6")
def _(t):
    s = Tables(t.spark, t.folder)
    queries = t.stream("documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("what is "), F.col("text")).alias("query"))
    d = s.search_docs()
    names = d.select("concept_id", "name", text.set_key(text.lookup_tokens(F.col("name"))).alias("key")).where("key <> ''")
    names = names.groupBy("key").agg(F.min_by("name", "concept_id").alias("matched_concept"))
    rules, default = labels.policy("A_exact_to_bm25f")
    out = st.enriched_queries(queries, names, rules, default)
    return _drain(t, out.select("query_id", "intent", "question_type", "goal", "chosen_strategy", "fired_rule"))


@query("streamed_embedding_refresh", "ST7", "SELECT doc_id AS id, md5(text) AS checksum, 256 AS dim FROM documents")
def _(t):
    root = _folder(t)
    rows = t.stream("documents").select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("checksum"))
    embed = lambda b: vectors.hashing_vectors(b.select("id", "text")).join(b.select("id", "checksum"), "id")
    q = st.refresh_embeddings(rows, root, embed, f"{root}_chk").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(root).select("id", "checksum", F.size("vector").alias("dim"))


@query("streamed_session_expiry", "ST8", """WITH turns AS (SELECT conv_id, role, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts FROM conversations)
  SELECT conv_id, max(ts) + INTERVAL 24 HOUR AS expired_at, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user FROM turns GROUP BY 1
  HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM turns) - INTERVAL 1 MINUTE""")
def _(t):
    turns = t.stream("conversations").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60))
    return _drain(t, st.expiring_sessions(turns))
