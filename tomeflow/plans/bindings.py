"""Domain tables built from the given Parquet tables, each in Spark and as SQL text for DuckDB.

The prose is invented and holds no cue words, so objects and queries get a head chosen by id modulo 12.
Every line of every document stays whole: a head is a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, lexical_index, search
from .scale import cut_lineage, shared_folder

# Query openings, by id modulo 12. Index 11 has none.
QUERY_CUES = [
    "what is ", "explain ", "difference between energy and ", "prove that ", "formula for ", "solve 2 + 3 for ",
    "types of ", "prerequisites for ", "applications of ", "revise ", "why does electric charge need ", "",
]
# Heads of text objects, by (doc_id + line) modulo 12. Index 0 is a numbered heading; 10 and 11 have none.
LINE_HEADS = [
    "", "Definition 1", "Theorem 1", "Proof", "Example 1", "Solution", "Hence it follows", "Exercise 1.1",
    "Note", "Fig 1", "", "",
]


def case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {key} {arms} END)"


def pick(key: Column, values: list[str]) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(key == i, v) if out is None else out.when(key == i, v)
    return out


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")


_STAGED: dict[tuple, DataFrame] = {}
_INDEXES: dict[tuple, str] = {}
_SCAN_TASKS: dict[tuple[str, str, str], int] = {}
# Tables whose rows are heavy to work on, with the key that spreads them.
SPREAD_BY = {"documents": "doc_id", "conversations": "conv_id"}


class Tables:
    """Readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = SPREAD_BY.get(name)
        if key is None:
            return df
        # A small table in one file is read by one task. Only then are its rows spread over the cores; a large
        # table has tasks enough and is never shuffled here.
        cores = self.spark.sparkContext.defaultParallelism
        at = (self.spark.sparkContext.applicationId, self.folder, name)
        if at not in _SCAN_TASKS:
            _SCAN_TASKS[at] = df.rdd.getNumPartitions()
        return df.repartition(cores, key) if _SCAN_TASKS[at] < cores else df

    def stream(self, name: str) -> DataFrame:
        """A table as a stream: one file, or a folder of files. A pattern, as a stream's plain path must be a folder."""
        return self.spark.readStream.schema(self.read(name).schema).parquet(f"{self.folder}/{name}[.]parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def state(self, *names: str) -> tuple:
        """Path, size and time of every file of the tables: a changed table has another state. Only folders are listed."""
        files = self.spark.read.format("binaryFile").load([f"{self.folder}/{n}.parquet" for n in names])
        return tuple(sorted((r.path, r.length, r.modificationTime) for r in files.select("path", "length", "modificationTime").collect()))

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage table: written once to the checkpoint folder, then read by every query of the session while its tables stay
        as they are."""
        key = (self.spark.sparkContext.applicationId, self.folder, name, self.state("documents", "benchmark"))
        if key not in _STAGED:
            _STAGED[key] = cut_lineage(build())
        return _STAGED[key]

    def lexical_index(self) -> lexical_index.Index:
        """The stored index of :meth:`search_docs`."""
        key = (self.spark.sparkContext.applicationId, self.folder, self.state("documents"))
        if key not in _INDEXES:
            _INDEXES[key] = lexical_index.fresh_folder(shared_folder(self.spark))
            lexical_index.build(self.search_docs(), _INDEXES[key])
        return lexical_index.read(self.spark, _INDEXES[key])

    def candidate_lists(self) -> DataFrame:
        """Lexical and dense candidates of every benchmark query, written once."""
        return self.stage("lists", lambda: fusion.candidate_lists(self.queries(), self.search_docs()))

    def hits(self) -> DataFrame:
        """The first five lexical results of every benchmark query, written once."""
        return self.stage("hits5", lambda: search.bm25f_search(self.search_docs(), self.queries(), 5).select("query_id", "rank", "concept_id", "score"))

    # --- text ---------------------------------------------------------------
    def lines(self) -> DataFrame:
        """(doc_id, lang, source, pos, line): every line of every document."""
        d = self.read("documents")
        return d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))

    def search_docs(self) -> DataFrame:
        """One row per document: its first line's opening words name it. Every line is in a field: odd lines define, even
        lines, the first one too, give examples."""
        lines = F.split("text", "\n")
        return self.read("documents").select(
            F.col("doc_id").alias("concept_id"),
            first_words(lines[0], 6).alias("name"),
            F.array().cast("array<string>").alias("aliases"),
            F.col("lang").alias("subject"),
            F.col("source").alias("chapter"),
            F.filter(lines, lambda x, i: i % 2 == 1).alias("definition_texts"),
            F.filter(lines, lambda x, i: i % 2 == 0).alias("example_texts"),
        )

    def queries(self) -> DataFrame:
        """(query_id, query): whole benchmark items behind a cue."""
        cue = pick(F.col("item_id") % 12, QUERY_CUES)
        return self.read("benchmark").select(
            F.col("item_id").alias("query_id"), F.concat(cue, F.col("text")).alias("query")
        )

    def asked(self) -> DataFrame:
        """(query_id, query): every document's whole text behind a cue, for volume."""
        cue = pick(F.col("doc_id") % 12, QUERY_CUES)
        return self.read("documents").select(F.col("doc_id").alias("query_id"), F.concat(cue, F.col("text")).alias("query"))

    def objects(self) -> DataFrame:
        """Text objects in reading order: a head row where the line has one, then the line itself."""
        c = (F.col("doc_id") + F.col("pos")) % 12
        number = F.concat((F.floor(F.col("pos") / 24) + 1).cast("string"),
                          F.when(F.floor(F.col("pos") / 12) % 2 == 1, ".1").otherwise(""))
        heading = F.concat(number, F.lit(" Topic "), first_words(F.lower("line"), 3))
        head = F.when(c == 0, heading).otherwise(pick(c, LINE_HEADS))
        rows = self.lines().select(
            F.col("doc_id").alias("book"), F.col("lang").alias("subject"), F.col("source").alias("chapter"),
            (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"),
            F.explode(F.array(F.struct((F.col("pos") * 2).alias("reading_order"), head.alias("text")),
                              F.struct((F.col("pos") * 2 + 1).alias("reading_order"), F.col("line").alias("text")))).alias("o"),
        ).where((F.col("o.reading_order") % 2 == 1) | (F.col("o.text") != ""))
        return rows.select(
            F.concat_ws(":", F.col("book"), F.col("o.reading_order")).alias("id"),
            "book", "subject", "chapter", "page", F.col("o.reading_order").alias("reading_order"), F.col("o.text").alias("text"),
        )

    # --- people and time ----------------------------------------------------
    def learning_events(self) -> DataFrame:
        """(student, session_id, seq, ts, type, concept_id); a session is one student's day."""
        kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
        return self.read("events").select(
            F.col("user_id").alias("student"), F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
            F.col("event_id").alias("seq"), "ts", kind[F.col("event_type")].alias("type"),
            (F.get_json_object("props", "$.k").cast("int") % 20).alias("concept_id"),
        )

    # --- graphs -------------------------------------------------------------
    def tree_edges(self) -> DataFrame:
        """p depends on p div 2: a tree over all parts."""
        p = self.read("part").where("p_partkey >= 2")
        return p.select(F.col("p_partkey").alias("source_id"), F.floor(F.col("p_partkey") / 2).alias("target_id"))

    def parents(self) -> DataFrame:
        """(id, parent_id): a parent map with cycles, one self-parent class and dangling parents."""
        p = self.read("part")
        n = p.agg(F.count("*").alias("n"))
        return p.join(F.broadcast(n)).select(
            F.col("p_partkey").alias("id"),
            F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise((F.col("p_partkey") * 7 + 3) % (F.col("n") + 5)).alias("parent_id"),
        )


# Events of the given table as learning events.
EVENT_TYPES = {
    "signup": "lesson_started",
    "view": "review_completed",
    "click": "exercise_correct",
    "error": "exercise_incorrect",
    "purchase": "concept_mastered",
}

# --- the same tables as SQL text -------------------------------------------------------------------
def sql_words(text: str, n: int) -> str:
    return f"array_to_string(regexp_split_to_array({text}, '\\s+')[1:{n}], ' ')"


LINES_SQL = """lines AS (
  SELECT doc_id, lang, source, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents))"""

SEARCH_DOCS_SQL = f"""search_docs AS (
  SELECT doc_id AS concept_id, {sql_words("a[1]", 6)} AS name, lang AS subject, source AS chapter,
         list_filter(a, lambda x, i: i % 2 = 0) AS definition_texts,
         list_filter(a, lambda x, i: i % 2 = 1) AS example_texts
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents))"""

QUERIES_SQL = f"""queries AS (
  SELECT item_id AS query_id, {case("item_id % 12", QUERY_CUES)} || text AS query FROM benchmark)"""

ASKED_SQL = f"""queries AS (
  SELECT doc_id AS query_id, {case("doc_id % 12", QUERY_CUES)} || text AS query FROM documents)"""

OBJECTS_SQL = f"""{LINES_SQL},
heads AS (
  SELECT *, CASE WHEN (doc_id + pos) % 12 = 0
      THEN CAST(pos // 24 + 1 AS VARCHAR) || CASE WHEN (pos // 12) % 2 = 1 THEN '.1' ELSE '' END
           || ' Topic ' || {sql_words("lower(line)", 3)}
      ELSE {case("(doc_id + pos) % 12", LINE_HEADS)} END AS head FROM lines),
objects AS (
  SELECT doc_id || ':' || reading_order AS id, doc_id AS book, lang AS subject, source AS chapter,
         pos // 20 + 1 AS page, reading_order, text
  FROM (SELECT doc_id, lang, source, pos, pos * 2 AS reading_order, head AS text FROM heads WHERE head <> ''
        UNION ALL SELECT doc_id, lang, source, pos, pos * 2 + 1, line FROM heads))"""

LEARNING_EVENTS_SQL = """learning_events AS (
  SELECT user_id AS student, strftime(ts, '%Y-%m-%d') AS session_id, event_id AS seq, ts,
         CASE event_type WHEN 'signup' THEN 'lesson_started' WHEN 'view' THEN 'review_completed'
              WHEN 'click' THEN 'exercise_correct' WHEN 'error' THEN 'exercise_incorrect'
              WHEN 'purchase' THEN 'concept_mastered' END AS type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS concept_id
  FROM events)"""

TREE_EDGES_SQL = """tree_edges AS (
  SELECT p_partkey AS source_id, p_partkey // 2 AS target_id FROM part WHERE p_partkey >= 2)"""

PARENTS_SQL = """parents AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL
         ELSE (p_partkey * 7 + 3) % ((SELECT count(*) FROM part) + 5) END AS parent_id FROM part)"""


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_tokens(text: str, stop_words: list[str], stem: bool = False) -> str:
    """Token list of ``text`` as a DuckDB expression."""
    raw = f"string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    kept = f"list_filter({raw}, lambda w: length(w) > 1 AND w NOT IN ({_sql_list(stop_words)}))"
    return f"list_transform({kept}, lambda w: {sql_stem('w')})" if stem else kept


def sql_stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) <= 3 THEN {w} "
        f"WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN regexp_matches({w}, '(sses|shes|ches|xes|zes|ses)$') THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_re(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {sql_str(pattern)})"


def sql_any(col: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_str(p)})" for p in phrases) + ")"


def sql_case(rules: list[tuple[str, str]], default: str) -> str:
    """CASE over (value expression, condition) pairs."""
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for v, c in rules) + f" ELSE {default} END)"


def sql_map(mapping: dict[str, str], key: str, default: str = "NULL") -> str:
    return sql_case([(sql_str(v), f"{key} = {sql_str(k)}") for k, v in mapping.items()], default)


def sql_key(tokens: str) -> str:
    return f"array_to_string(list_sort(list_distinct({tokens})), ' ')"
