"""Driver queries for concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cues, labels, text, vocab
from ..operators import concepts as cp
from ..operators import search
from ..plans.scale import carry
from .bindings import LINES_SQL, OBJECTS_SQL, SEARCH_DOCS_SQL, case, first_words, pick, sql_any, sql_re, sql_str, sql_words
from .label_queries import OWN_TYPE_SQL
from .registry import query


def _in(values):
    return ", ".join(sql_str(v) for v in values)


def _fold(tokens, glue_cond, glued):
    """String fold over tokens: ``glued`` when ``glue_cond`` holds, else a blank and the token."""
    return f"ltrim(list_reduce({tokens}, lambda acc, x: CASE WHEN {glue_cond} THEN {glued} ELSE acc || ' ' || x END, ''))"


_MERGE = ("regexp_matches(acc, '(^| )\\p{L}$') AND regexp_matches(x, '^\\p{L}{2,}$')", "acc || x")
_SPLIT = "list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda w: w <> '')"


def name_ctes(src: str, raw: str = "raw") -> str:
    """CTEs ending in ``named``: ``src`` with norm and display added."""
    r = lambda c, p, by="''", g="": f"regexp_replace({c}, {sql_str(p)}, {by}{g})"
    start = r(r(r(r(f"trim({raw})", text.SECTION_NUMBER), text.CONTINUED_SUFFIX), text.ROMAN_PREFIX), text.LEADING_LABEL)
    quotes = r(f"translate({start}, '’‘“”', '''''\"\"')", r"(?i)\s+'\s*s\b", "'''s'", ", 'g'")
    plain = f"lower({r(r(quotes, chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's' + chr(92) + '-' + chr(39) + chr(93), chr(39) + ' ' + chr(39), ', ' + chr(39) + 'g' + chr(39)), text.NUMBER_TOKEN, chr(39) + ' ' + chr(39), ', ' + chr(39) + 'g' + chr(39))})"
    g = ", 'g'"
    blank = "' '"
    shown = r(r(r(f"trim({r(f'trim({r(raw, text.SECTION_NUMBER)})', text.CONTINUED_SUFFIX)})", text.LEADING_LABEL), text.NUMBER_TOKEN, blank, g), text.TRAILING_PAGE)
    same = "regexp_extract(acc, '[^ ]*$') = x"
    same_ci = "lower(regexp_extract(acc, '[^ ]*$')) = lower(x)"
    return f"""nm1 AS (SELECT *, {_fold(_SPLIT.format(c=plain), *_MERGE)} AS m, {_fold(_SPLIT.format(c=shown), *_MERGE)} AS d FROM {src}),
nm2 AS (SELECT *, rtrim({r("array_to_string(list_filter(string_split(m, ' '), lambda w: w NOT IN (" + _in(vocab.NAME_FILLER_WORDS) + ")), ' ')", text.TRAILING_PAGE)}, '.:;,') AS k,
        trim({_fold(_SPLIT.format(c="d"), same_ci, "acc")}, ' .:;,-') AS d2 FROM nm1),
nm3 AS (SELECT *, {_fold(_SPLIT.format(c="k"), same, "acc")} AS u FROM nm2),
named AS (SELECT * EXCLUDE (m, d, k, d2, u), CASE WHEN len(list_distinct(list_filter(string_split(u, ' '), lambda w: regexp_matches(w, '[a-z]')))) = 1
          THEN list_filter(string_split(u, ' '), lambda w: regexp_matches(w, '[a-z]'))[1] ELSE u END AS norm,
        CASE WHEN upper(d2) = d2 AND lower(d2) <> d2 AND length(d2) > 4
             THEN array_to_string(list_transform(string_split(d2, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE d2 END AS display FROM nm3)"""


def accepts_sql(chapter: str | None = None) -> str:
    w = "string_split(norm, ' ')"
    n = f"CASE WHEN norm = '' THEN 0 ELSE len({w}) END"
    sentence = (f"({n} >= 4 AND (regexp_matches(trim(raw), '^[•·\\-*]') OR {w}[1] IN ({_in(vocab.INSTRUCTION_WORDS + vocab.SENTENCE_OPENERS)})"
                f" OR ({n} >= 8 AND len(list_filter({w}, lambda x: x IN ({_in(vocab.SENTENCE_VERBS)}))) > 0)"
                f" OR (regexp_matches(trim(raw), '[.;:]$') AND {n} >= 6) OR {n} > 10))")
    out = (f"norm <> '' AND norm NOT IN ({_in(vocab.NAME_BLOCKLIST)}) AND NOT {sentence} AND regexp_matches(norm, '[a-z]{{2,}}')"
           f" AND length(regexp_replace(norm, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(norm) >= 0.7")
    if chapter:
        out += (f" AND ({chapter} <> 'Unknown Chapter' OR (len({w}) >= 2 AND upper(trim(raw)) = trim(raw) AND lower(trim(raw)) <> trim(raw)"
                f" AND len(list_filter({w}, lambda x: x IN ({_in(vocab.NAME_BLOCKLIST)}))) = 0))")
    return out


# Raw names: every whole line behind and before the noise that headings carry, by (doc_id + pos) modulo 12.
NAME_HEADS = ["7.2 ", "Chapter 3 ", "IV. ", "", "e lectric c harge ", "13.5.1 ", "COULOMB ''S LAW OF ", "• State that ", "Unit 4 ", "The the ", "If ", ""]
NAME_TAILS = ["", " (continued)", "", " 226", "", " (Contd.)", "", ".", " 12.5 ;", "", " is being known where it can follow on", ""]
RAW_SQL = f"""{LINES_SQL}, raws AS (SELECT doc_id, source, pos, {case("(doc_id + pos) % 12", NAME_HEADS)} || line || {case("(doc_id + pos) % 12", NAME_TAILS)} AS raw FROM lines)"""


def _raws(t):
    c = (F.col("doc_id") + F.col("pos")) % 12
    heads = [h.replace("''", "'") for h in NAME_HEADS]
    return t.lines().select("doc_id", "source", "pos", F.concat(pick(c, heads), F.col("line"), pick(c, NAME_TAILS)).alias("raw"))


@query("canonical_names", "P5", f"WITH {RAW_SQL}, {name_ctes('raws')} SELECT doc_id, pos, norm FROM named")
def _(t):
    return _raws(t).select("doc_id", "pos", text.canonical_name(F.col("raw")).alias("norm"))


@query("display_names", "P6", f"WITH {RAW_SQL}, {name_ctes('raws')} SELECT doc_id, pos, display FROM named")
def _(t):
    return _raws(t).select("doc_id", "pos", text.display_name(F.col("raw")).alias("display"))


@query("accepted_names", "P7", f"WITH {RAW_SQL}, {name_ctes('raws')} SELECT doc_id, pos, coalesce({accepts_sql()}, FALSE) AS accepted FROM named")
def _(t):
    n = _raws(t).withColumn("norm", text.canonical_name(F.col("raw")))
    return n.select("doc_id", "pos", F.coalesce(text.accepts_name(F.col("raw"), F.col("norm")), F.lit(False)).alias("accepted"))


@query("stutter_cleanup", "P8")
def _(t):
    from ..functions.stutter import clean_ocr

    noisy = F.concat(F.lit("E LECTRIC "), F.col("line"), F.lit(" "), F.col("line"))
    return t.lines().select("doc_id", "pos", clean_ocr(noisy).alias("clean"))


# --- the concept tables: headings of every document name its concepts -------------------------------------------
SCOPE = ["book", "chapter"]
NAMES_SQL = f"""{OWN_TYPE_SQL},
kinds AS (SELECT * EXCLUDE (own_type), coalesce(own_type, 'paragraph') AS type FROM own),
raw0 AS (SELECT book, chapter, page, reading_order, type, trim(text) AS raw FROM kinds WHERE type = 'heading'),
{name_ctes('raw0')},
resolved AS (SELECT * FROM named WHERE coalesce({accepts_sql('chapter')}, FALSE) AND length(norm) >= 3)"""
CONCEPTS_SQL = f"""{NAMES_SQL},
concepts AS (SELECT 'concept.' || left(sha1('concept|' || book || '|' || chapter || '|' || norm), 12) AS concept_id, book, chapter, norm, arg_min(display, reading_order) AS name,
   list_distinct(list(display)) AS spellings, 'heading' AS source_type, arg_min(page, reading_order) AS page, min(reading_order) AS reading_order FROM resolved GROUP BY book, chapter, norm)"""


def kinds(t):
    return t.stage("kinds", lambda: t.objects().withColumn("type", F.coalesce(labels.own_type(F.col("text")), F.lit("paragraph"))))


def concepts(t):
    # Only headings name concepts in this data: the other types here are numbered ("Definition 1").
    return t.stage("concepts", lambda: cp.build_concepts(cp.resolve_names(cp.raw_names(kinds(t).where("type = 'heading'"))), SCOPE))


@query("concept_candidates", "A3", f"""WITH {CONCEPTS_SQL} SELECT concept_id, book, chapter, norm, name, source_type, page, reading_order FROM concepts""")
def _(t):
    return concepts(t).select("concept_id", "book", "chapter", "norm", "name", "source_type", "page", "reading_order")


@query("concept_aliases", "A4", f"""WITH {RAW_SQL}, {name_ctes('raws')}, ok AS (SELECT * FROM named WHERE coalesce({accepts_sql()}, FALSE) AND length(norm) >= 3),
  g AS (SELECT source, norm, arg_min(display, (doc_id, pos)) AS name, list_distinct(list(display)) AS sp FROM ok GROUP BY 1, 2)
  SELECT source AS chapter, norm, name, array_to_string(list_sort(list_filter(list_distinct(list_append(sp, norm)), lambda a: a <> name)), '|') AS aliases FROM g""")
def _(t):
    raw = _raws(t).select(F.col("source").alias("chapter"), "raw", F.lit("paragraph").alias("type"), F.col("doc_id").alias("page"), F.col("pos").alias("reading_order"), F.lit(0).alias("k"))
    c = cp.build_concepts(cp.resolve_names(raw), ["chapter"])
    return c.select("chapter", "norm", "name", F.array_join("aliases", "|").alias("aliases"))


@query("forward_chapter_inference", "J6", f"""WITH {OWN_TYPE_SQL}, u AS (SELECT id, book, page, reading_order, coalesce(own_type, 'paragraph') AS type, CASE WHEN (book + page) % 3 = 0 THEN 'Unknown Chapter' ELSE chapter || '/' || page END AS chapter FROM own),
  n AS (SELECT *, first_value(CASE WHEN chapter <> 'Unknown Chapter' THEN {{'p': page, 'c': chapter}} END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, reading_order ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM u)
  SELECT id, CASE WHEN chapter = 'Unknown Chapter' AND type = 'heading' AND nx.p - page <= 1 THEN nx.c ELSE chapter END AS candidate_chapter FROM n""")
def _(t):
    o = kinds(t).withColumn("chapter", F.when((F.col("book") + F.col("page")) % 3 == 0, "Unknown Chapter").otherwise(F.concat_ws("/", "chapter", "page")))
    return cp.inferred_chapters(o).select("id", "candidate_chapter")


_LINKABLE = _in(cp.LINKABLE)
NEAREST_SQL = f"""{CONCEPTS_SQL},
links AS (SELECT concept_id, norm, id AS object_id, type, o.book, o.chapter, o.page, o.reading_order, text FROM kinds o ASOF JOIN concepts c
          ON o.book = c.book AND o.chapter = c.chapter AND o.reading_order >= c.reading_order WHERE type IN ({_LINKABLE}))"""


def nearest(t):
    return cp.nearest_links(kinds(t), concepts(t), SCOPE)


@query("nearest_concept_links", "J5", f"WITH {NEAREST_SQL} SELECT object_id, concept_id FROM links")
def _(t):
    return nearest(t).select(F.col("id").alias("object_id"), "concept_id")


# Sections: the title of the last sub-heading ("N.1 ...") before the object. Parents: the book's first concept.
SECTIONED_SQL = f"""{CONCEPTS_SQL},
sectioned AS (SELECT *, coalesce(last_value(CASE WHEN type = 'heading' AND contains(text, '.1 ') THEN regexp_replace(trim(text), '^[0-9.]+ ', '') END IGNORE NULLS) OVER (PARTITION BY book, chapter ORDER BY page, reading_order), '') AS section FROM kinds),
parented AS (SELECT *, CASE WHEN reading_order > min(reading_order) OVER (PARTITION BY book, chapter) THEN first_value(name) OVER (PARTITION BY book, chapter ORDER BY reading_order) END AS parent_name FROM concepts),
fits AS (SELECT s.id, arg_max(concept_id, c.reading_order) AS section_concept FROM sectioned s JOIN parented c ON s.book = c.book AND s.chapter = c.chapter AND c.reading_order <= s.reading_order
   AND (starts_with(lower(trim(section)), lower(trim(name))) OR starts_with(lower(trim(section)), lower(trim(parent_name))) OR starts_with(lower(trim(parent_name)), lower(trim(section)))) WHERE section <> '' GROUP BY 1),
nearest AS (SELECT id, concept_id FROM sectioned o ASOF JOIN concepts c ON o.book = c.book AND o.chapter = c.chapter AND o.reading_order >= c.reading_order),
full_links AS (SELECT coalesce(section_concept, n.concept_id) AS concept_id, s.id AS object_id, s.type, s.text, s.book, s.chapter, s.page, s.reading_order FROM sectioned s JOIN nearest n USING (id) LEFT JOIN fits USING (id) WHERE type IN ({_LINKABLE})),
reasoned AS (SELECT l.concept_id, object_id, CASE WHEN type = 'paragraph' AND {sql_re("text", cues.DEFINITION_PARAGRAPH)} THEN 'definition' ELSE type END AS object_type,
   CASE WHEN norm <> '' AND contains(lower(left(text, 120)), norm) THEN 'title_match' WHEN type IN ({_in(cp.AUTHORITY)}) THEN 'heading_match' ELSE 'section_scope' END AS link_reason,
   l.book, l.chapter, l.page, l.reading_order FROM full_links l JOIN concepts USING (concept_id))"""


def linked(t):
    o = kinds(t)
    title = F.when((F.col("type") == "heading") & F.contains("text", F.lit(".1 ")), F.regexp_replace(text.trim("text"), "^[0-9.]+ ", ""))
    o = carry(o, SCOPE, cp.ORDER, {"section": title}, F.floor(F.col("page") / 64)).na.fill("", ["section"])
    c = concepts(t)
    first = c.groupBy(*SCOPE).agg(F.min("reading_order").alias("r0"), F.min_by("name", "reading_order").alias("n0"))
    c = c.join(first, SCOPE).withColumn("parent_name", F.when(F.col("reading_order") > F.col("r0"), F.col("n0")))
    return cp.link_objects(o, c, SCOPE), c


@query("concept_object_links", "J5 P16", f"WITH {SECTIONED_SQL} SELECT concept_id, object_id, object_type, link_reason FROM reasoned")
def _(t):
    return linked(t)[0].select("concept_id", "object_id", "object_type", "link_reason")


# Links used below: nearest concept, types as they are.
def links(t):
    return t.stage("links", lambda: nearest(t).select(
        "concept_id", F.col("id").alias("object_id"), F.col("type").alias("object_type"), "text", "book", "chapter", *cp.ORDER))


_KIND = "CASE " + " ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in cp.LINK_KINDS.items()) + " ELSE 'other' END"
COUNTED_SQL = f"""{NEAREST_SQL},
cnt AS (SELECT concept_id, {", ".join(f"count(*) FILTER ({_KIND} = '{k}') AS n_{k}" for k in cp.KINDS)}, count(*) AS n_refs FROM links GROUP BY 1),
counted AS (SELECT c.*, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in [*cp.KINDS, "refs"])}, {" + ".join(f"coalesce(n_{k}, 0)" for k in cp.KINDS)} AS n_linked FROM concepts c LEFT JOIN cnt USING (concept_id))"""


def counted(t):
    return cp.link_counts(concepts(t), links(t))


@query("linked_object_counts", "A2", f"""WITH {COUNTED_SQL} SELECT concept_id, {", ".join(f"n_{k}" for k in cp.KINDS)}, n_refs, CAST(round(least(1.0, 0.3 + n_linked * 0.07), 4) AS DOUBLE) AS confidence FROM counted""")
def _(t):
    return counted(t).select("concept_id", *[f"n_{k}" for k in cp.KINDS], "n_refs", F.round("confidence", 4).alias("confidence"))


_WORDS = "list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> '')"
GRADED_SQL = f"""{COUNTED_SQL}, gr AS (SELECT concept_id, name, CASE WHEN ({" OR ".join(sql_re("name", p) for p in cp.JUNK_NAMES)}) OR len({_WORDS}) = 0 THEN 0 ELSE round(greatest(0, least(1,
   CASE WHEN len({_WORDS}) > 6 THEN -0.5 ELSE 0 END + CASE WHEN length(regexp_replace(name, '[\\p{{L}}\\p{{N}}_\\s]', '', 'g')) > 3 OR (length(regexp_replace(name, '[\\p{{L}}\\p{{N}}_\\s]', '', 'g')) > 1 AND len({_WORDS}) <= 2) THEN -0.5 ELSE 0 END
   + CASE WHEN len(list_filter({_WORDS}, lambda w: lower(w) IN ({_in(vocab.NAME_STOP_WORDS)}))) / len({_WORDS}) >= 0.5 THEN -0.4 ELSE 0 END
   + CASE WHEN lower(name[1]) = name[1] AND upper(name[1]) <> name[1] AND len({_WORDS}) > 2 THEN -0.2 ELSE 0 END + 0.6
   + CASE WHEN n_linked + n_definition > 0 THEN least(0.5, (n_linked + n_definition) * 0.1) ELSE -0.5 END + CASE WHEN n_refs > 1 THEN least(0.3, n_refs * 0.05) ELSE 0 END)), 9) END AS confidence FROM counted)"""


@query("concept_grades", "P27", f"""WITH {GRADED_SQL} SELECT concept_id, CAST(round(confidence, 4) AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.75 THEN 'accepted' WHEN confidence >= 0.5 THEN 'probable' ELSE 'rejected' END AS status FROM gr""")
def _(t):
    return cp.graded_concepts(counted(t)).select("concept_id", F.round("confidence", 4).alias("confidence"), "status")


@query("concept_descriptions", "A17", f"""WITH {NEAREST_SQL}, f AS (SELECT concept_id, arg_min(text, reading_order) AS text FROM links WHERE type = 'definition' GROUP BY 1) SELECT concept_id, left(text, 500) AS description FROM f""")
def _(t):
    l = links(t)  # noqa: E741
    return cp.descriptions(l, l.select("object_id", "text"))


@query("concept_report", "A8 J17", f"""WITH {COUNTED_SQL} SELECT count(*) AS total_concepts, count(*) FILTER (n_linked > 0 AND trim(name) <> '') AS valid_concepts, count(*) FILTER (n_linked = 0) AS orphan_concepts,
   count(*) FILTER (trim(name) = '') AS empty_names, (SELECT count(*) FROM kinds WHERE type = 'definition' AND id NOT IN (SELECT object_id FROM links)) AS unlinked_definitions, 0 AS unlinked_formulas,
   (SELECT count(*) FROM kinds WHERE type = 'worked_example' AND id NOT IN (SELECT object_id FROM links)) AS unlinked_examples FROM counted""")
def _(t):
    return cp.concept_report(counted(t), kinds(t), links(t))


@query("unlinked_objects", "J17", f"WITH {NEAREST_SQL} SELECT type, count(*) AS n FROM kinds WHERE id NOT IN (SELECT object_id FROM links) GROUP BY 1")
def _(t):
    return cp.unlinked(kinds(t), links(t)).groupBy("type").agg(F.count("*").alias("n"))


# --- names inside names and texts ---------------------------------------------------------------------------------
CHAPTER_NAMES_SQL = f"""{SEARCH_DOCS_SQL}, cn AS (SELECT DISTINCT chapter, lower(unnest([name, {sql_words("name", 2)}, {sql_words("name", 1)}])) AS norm FROM search_docs)"""


def _chapter_names(t):
    n = F.col("name")
    return t.search_docs().select("chapter", F.explode(F.array(F.lower(n), F.lower(first_words(n, 2)), F.lower(first_words(n, 1)))).alias("norm")).distinct()


@query("containment_parents", "J7", f"""WITH {CHAPTER_NAMES_SQL} SELECT c.chapter, c.norm, arg_max(p.norm, (length(p.norm), p.norm)) AS parent FROM cn c JOIN cn p ON c.chapter = p.chapter AND c.norm <> p.norm
   AND length(p.norm) >= 4 AND contains(c.norm, p.norm) GROUP BY 1, 2""")
def _(t):
    return cp.containment_parents(_chapter_names(t), ["chapter"])


@query("alias_mentions", "J8", f"""WITH {CHAPTER_NAMES_SQL}, {LINES_SQL}, d AS (SELECT norm AS gram, max(chapter) AS concept_id, len(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS n, regexp_extract(norm, '^([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+)') AS f
     FROM cn WHERE length(norm) > 4 GROUP BY norm),
  p AS (SELECT doc_id || ':' || pos AS object_id, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS ps FROM lines),
  e AS (SELECT object_id, ps, unnest(range(len(ps))) AS p0, unnest(ps) AS f FROM p),
  h AS (SELECT object_id, p0, d.n, concept_id, gram FROM e JOIN d USING (f) WHERE d.gram = array_to_string(ps[p0 + 1 : p0 + d.n], '') AND p0 + d.n <= len(ps) AND regexp_matches(ps[p0 + 1], '^[\\p{{L}}\\p{{N}}_]')),
  o AS (SELECT object_id, list({{'a': p0, 'e': p0 + n, 'c': concept_id, 'g': gram}} ORDER BY p0, n DESC) AS hs FROM h GROUP BY 1),
  k AS (SELECT object_id, unnest(list_reduce(hs, lambda acc, x: CASE WHEN x[1].a >= acc[len(acc)].e THEN list_concat(acc, x) ELSE acc END)) AS m
        FROM (SELECT object_id, list_transform(hs, lambda x: [x]) AS hs FROM o))
  SELECT object_id, m.c AS concept_id, min(m.g) AS evidence FROM k GROUP BY 1, 2""")
def _(t):
    aliases = _chapter_names(t).select(F.col("chapter").alias("concept_id"), F.col("norm").alias("alias"))
    objects = t.lines().select(F.concat_ws(":", "doc_id", "pos").alias("object_id"), F.col("line").alias("text"))
    return cp.mentions(objects, aliases)


@query("reattributed_definitions", "J9")
def _(t):
    # Concepts of a chapter: one per document, named by its first word. Each line is linked to its own document's concept.
    lines = t.lines()
    name = first_words(F.regexp_replace(F.lower(F.split("text", "\n")[0]), r"[^\p{L} ]", ""), 1)
    c = t.documents.select(F.col("source").alias("chapter"), F.col("doc_id").cast("string").alias("concept_id"), name.alias("name"))
    c = c.groupBy("chapter", "name").agg(F.min("concept_id").alias("concept_id"))
    heads = ["is called ", " consists of ", " in the ", ""]
    txt = F.concat(F.col("line").substr(1, 0), first_words(F.col("line"), 2), F.lit(" "), pick((F.col("doc_id") + F.col("pos")) % 4, heads), F.col("line"))
    ids = F.concat_ws(":", "doc_id", "pos")
    l = lines.select(F.col("source").alias("chapter"), F.col("doc_id").cast("string").alias("concept_id"), ids.alias("object_id"),  # noqa: E741
                     F.when(F.col("pos") % 2 == 0, "definition").otherwise("worked_example").alias("object_type"))
    return cp.reattributed_definitions(l, lines.select(ids.alias("object_id"), txt.alias("text")), c, ["chapter"])


ALIAS_HEADS = ["young ", "double slit ", "diffraction and diffraction ", "determinant ", "integration ", "probability vectors ", "ohm''s law ", ""]


@query("content_aliases", "A7", f"""WITH {LINES_SQL}, tx AS (SELECT doc_id AS concept_id, {case("doc_id % 8", ALIAS_HEADS)} || line AS text FROM lines),
  dict(i, j, kw, alias) AS (VALUES {", ".join(f"({i}, {j}, {sql_str(k)}, {sql_str(a)})" for i, (k, al) in enumerate(vocab.CONTENT_ALIASES.items()) for j, a in enumerate(al))}),
  kws AS (SELECT DISTINCT kw FROM dict),
  n AS (SELECT concept_id, kw FROM tx, kws WHERE contains(lower(text), kw) GROUP BY 1, 2 HAVING sum((length(lower(text)) - length(replace(lower(text), kw, ''))) // length(kw)) >= 2),
  r AS (SELECT concept_id, alias, row_number() OVER (PARTITION BY concept_id ORDER BY i, j) AS rank FROM n JOIN dict USING (kw) WHERE alias <> '' AND concept_id IS NOT NULL)
  SELECT concept_id, rank, alias FROM r WHERE rank <= 5""")
def _(t):
    heads = [h.replace("''", "'") for h in ALIAS_HEADS]
    tx = t.lines().select(F.col("doc_id").alias("concept_id"), F.concat(pick(F.col("doc_id") % 8, heads), F.col("line")).alias("text"))
    c = t.search_docs().select("concept_id", "name", "aliases")
    return cp.content_aliases(tx, c)


@query("structural_parents", "G10", f"""WITH {CONCEPTS_SQL}, l AS (SELECT *, lag(name) OVER w AS section, lag(name, 2) OVER w AS subsection, lag(norm) OVER w AS sn, lag(norm, 2) OVER w AS ssn FROM concepts WINDOW w AS (PARTITION BY book, chapter ORDER BY reading_order))
  SELECT concept_id, CASE WHEN norm LIKE '%law' THEN coalesce(nullif(ssn, norm), nullif(sn, norm)) ELSE coalesce(nullif(sn, norm), nullif(ssn, norm)) END AS parent_norm FROM l WHERE coalesce(nullif(sn, norm), nullif(ssn, norm)) IS NOT NULL""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy(*SCOPE).orderBy("reading_order")
    before = [F.lag(c, n).over(w).alias(at + end) for at, n in (("section", 1), ("subsection", 2)) for c, end in (("name", ""), ("norm", "_norm"))]
    c = concepts(t).select("*", *before)
    return cp.structural_parents(c, SCOPE)


# --- resolving -----------------------------------------------------------------------------------------------------
@query("resolved_text_lists", "J1", f"""WITH {NEAREST_SQL} SELECT concept_id, CASE WHEN type = 'worked_example' THEN 'example' ELSE 'definition' END AS field, CASE type WHEN 'theorem' THEN 1000000 WHEN 'proof' THEN 2000000 ELSE 0 END + reading_order AS pos, md5(text) AS text_md5
  FROM links WHERE type IN ('definition', 'theorem', 'proof', 'worked_example')""")
def _(t):
    l = links(t).where("object_type IN ('definition', 'theorem', 'proof', 'worked_example')")  # noqa: E741
    field = F.when(F.col("object_type") == "worked_example", "example").otherwise("definition")
    off = F.when(F.col("object_type") == "theorem", 1000000).when(F.col("object_type") == "proof", 2000000).otherwise(0)
    lists = l.select("concept_id", field.alias("field"), (off + F.col("reading_order")).alias("pos"), "object_id")
    return cp.resolve_texts(lists, t.objects().select(F.col("id").alias("object_id"), "text")).select("concept_id", "field", "pos", F.md5("text").alias("text_md5"))


@query("edge_target_names", "J2", """SELECT l_orderkey AS source_id, p_name AS name, min(l_linenumber) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def _(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("pos"))
    return cp.edge_target_names(e, t.part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name")))


@query("linked_formulas", "J3", f"""WITH {NEAREST_SQL}, fm AS (SELECT id AS formula_id, book || ':' || (reading_order - 1) AS pid, CASE WHEN reading_order % 3 = 0 THEN 'F = ma ' ELSE '' END || text AS latex FROM kinds)
  SELECT concept_id, md5(trim(latex)) AS latex_md5, min(l.reading_order) AS at FROM links l JOIN fm ON pid = object_id WHERE type = 'definition' AND NOT {sql_any("lower(trim(latex))", cues.FORMULA_NOISE)} AND length(latex) >= 10 AND {sql_any("latex", cues.FORMULA_SIGNS)} GROUP BY 1, 2""")
def _(t):
    f = t.objects().select(F.col("id").alias("formula_id"), F.concat_ws(":", "book", F.col("reading_order") - 1).alias("linked_paragraph_id"),
                           F.concat(F.when(F.col("reading_order") % 3 == 0, "F = ma ").otherwise(""), "text").alias("latex"))
    return cp.linked_formulas(links(t), f).select("concept_id", F.md5("latex").alias("latex_md5"), F.col("at.reading_order").alias("at"))


@query("figure_images", "J4", f"""WITH {NEAREST_SQL} SELECT concept_id, reading_order AS pos, CASE WHEN reading_order % 3 = 0 THEN 'img-' || object_id ELSE object_id END AS image_id FROM links WHERE type = 'caption'""")
def _(t):
    o = t.objects().select("id", F.when(F.col("reading_order") % 3 == 0, F.array(F.struct(F.lit("").alias("id")), F.struct(F.concat(F.lit("img-"), "id").alias("id")))).alias("images"))
    f = links(t).where("object_type = 'caption'").select("concept_id", F.col("reading_order").alias("pos"), F.col("object_id").alias("figure_id"))
    return cp.figure_images(f, o)


@query("recovered_objects", "J12", f"WITH {NEAREST_SQL} SELECT concept_id, CASE type WHEN 'proof' THEN 1 WHEN 'theorem' THEN 2 ELSE 3 END AS kind_pos, object_id, md5(text) AS text_md5 FROM links WHERE type IN ('proof', 'theorem', 'definition')")
def _(t):
    r = cp.recover_objects(links(t).drop("text"), t.objects().select(F.col("id").alias("object_id"), "text"), ["proof", "theorem", "definition"])
    return r.select("concept_id", "kind_pos", "object_id", F.md5("text").alias("text_md5"))


@query("citation_ids", "J13", f"""WITH {SEARCH_DOCS_SQL}, shown AS (SELECT chapter AS query_id, concept_id AS rank, concept_id, name AS raw FROM search_docs), {name_ctes("shown")},
  known AS (SELECT query_id, norm, min(concept_id) AS found FROM named WHERE norm <> '' GROUP BY 1, 2)
  SELECT n.query_id, n.rank AS ref_pos, CASE WHEN n.rank % 5 = 0 THEN n.concept_id ELSE found END AS concept_id FROM named n LEFT JOIN known USING (query_id, norm)""")
def _(t):
    d = t.search_docs()
    shown = d.select(F.col("chapter").alias("query_id"), F.col("concept_id").alias("rank"), "concept_id", "name", "aliases")
    refs = d.select(F.col("chapter").alias("query_id"), F.col("concept_id").alias("ref_pos"), F.col("name").alias("label"), F.when(F.col("concept_id") % 5 == 0, F.col("concept_id")).alias("concept_id"))
    return cp.citation_ids(refs, shown).select("query_id", "ref_pos", "concept_id")


# --- reasoning and catalogue -------------------------------------------------------------------------------------------
_PRIO = "CASE " + " ".join(f"WHEN type = '{k}' THEN {v}" for k, v in cp.TEACHING_ORDER.items()) + " ELSE 10 END"


@query("teaching_sequence", "W11", f"WITH {NEAREST_SQL} SELECT concept_id, row_number() OVER (PARTITION BY concept_id ORDER BY {_PRIO}, page, reading_order) AS pos, object_id FROM links")
def _(t):
    return cp.teaching_sequence(links(t)).select("concept_id", "pos", "object_id")


_SCORE = "round(1 + (length(norm) % 9) * 0.5 + (n_formula + n_theorem + n_property) * 0.2 + n_proof * 0.3 + greatest(n_exercise - 5, 0) * 0.1, 9)"


@query("concept_difficulty", "P25", f"WITH {COUNTED_SQL} SELECT concept_id, CAST(round({_SCORE}, 4) AS DOUBLE) AS difficulty_score, CASE WHEN {_SCORE} < 3 THEN 'Easy' WHEN {_SCORE} <= 6 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM counted")
def _(t):
    return cp.difficulty(counted(t), F.length("norm") % 9).select("concept_id", F.round("difficulty_score", 4).alias("difficulty_score"), "difficulty")


_COVER = "n_definition > 0 AS has_definition, n_formula + n_property + n_theorem > 0 AS has_formula, n_example > 0 AS has_examples, n_exercise > 0 AS has_exercises"


@query("concept_coverage", "P26", f"WITH {COUNTED_SQL} SELECT concept_id, {_COVER}, n_definition > 0 AND n_example > 0 AND n_exercise > 0 AS is_complete FROM counted")
def _(t):
    return cp.coverage(counted(t)).select("concept_id", "has_definition", "has_formula", "has_examples", "has_exercises", "is_complete")


@query("concept_skills", "P26", f"""WITH {COUNTED_SQL}, k AS (SELECT concept_id, name, list_filter([CASE WHEN n_formula + n_property + n_theorem > 0 THEN 'Calculation and Application' END, CASE WHEN n_proof > 0 THEN 'Mathematical Reasoning' END,
   CASE WHEN n_exercise > 0 THEN 'Problem Solving' END], lambda x: x IS NOT NULL) AS ks FROM counted)
  SELECT concept_id, unnest(CASE WHEN len(ks) > 0 THEN ks ELSE ['Conceptual Understanding'] END) || ': ' || name AS skill FROM k""")
def _(t):
    return cp.skills(cp.coverage(counted(t)))


_INDEX_SQL = """ix AS (SELECT lang AS subject, 'Chapter ' || substr(source, 4) AS chapter, doc_id AS concept_id, array_to_string(regexp_split_to_array(string_split(text, chr(10))[1], '\\s+')[1:6], ' ') AS name FROM documents)"""


def _indexed(t):
    return t.search_docs().select("subject", F.concat(F.lit("Chapter "), F.substring("chapter", 4, 10)).alias("chapter"), "concept_id", "name")


@query("chapter_index", "A6", f"""WITH {_INDEX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, chapter ORDER BY concept_id) AS r FROM ix)
  SELECT subject, chapter, count(*) AS concept_count, string_agg(name, '|' ORDER BY r) FILTER (r <= 10) AS topics FROM r GROUP BY 1, 2""")
def _(t):
    return cp.chapter_index(_indexed(t)).select("subject", "chapter", "concept_count", F.array_join("topics", "|").alias("topics"))


@query("chapter_by_number", "A6", f"""WITH {_INDEX_SQL}, c AS (SELECT DISTINCT subject, chapter FROM ix), n AS (SELECT DISTINCT lang AS subject, n_chars % 23 AS number FROM documents),
  m AS (SELECT c.subject, number, chapter, CASE WHEN chapter = 'Chapter ' || number THEN 0 WHEN contains(lower(chapter), 'chapter ' || number) THEN 1 WHEN chapter = CAST(number AS VARCHAR) THEN 2 WHEN contains(chapter, CAST(number AS VARCHAR)) THEN 3 END AS tier FROM c JOIN n USING (subject))
  SELECT subject, number, arg_min(chapter, (tier, chapter)) AS chapter FROM m WHERE tier IS NOT NULL GROUP BY 1, 2""")
def _(t):
    numbers = t.documents.select(F.col("lang").alias("subject"), (F.col("n_chars") % 23).alias("number")).distinct()
    return cp.chapters_by_number(cp.chapter_index(_indexed(t)), numbers)


@query("chapter_by_name", "A6", f"""WITH {_INDEX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, chapter ORDER BY concept_id) AS r FROM ix),
  c AS (SELECT subject, chapter, count(*) AS concept_count, string_agg(name, '|' ORDER BY r) FILTER (r <= 10) AS topics FROM r GROUP BY 1, 2),
  n AS (SELECT DISTINCT lang AS subject, CASE WHEN n_chars % 3 = 0 THEN 'Chapter ' || n_chars % 23 ELSE 'chapter ' || n_chars % 7 END AS asked FROM documents),
  m AS (SELECT n.asked, c.*, row_number() OVER (PARTITION BY n.subject, n.asked ORDER BY chapter <> n.asked, chapter) AS k FROM c JOIN n ON c.subject = n.subject AND contains(lower(chapter), lower(n.asked)))
  SELECT asked, subject, chapter, concept_count, topics FROM m WHERE k = 1""")
def _(t):
    n = F.col("n_chars")
    name = F.when(n % 3 == 0, F.concat(F.lit("Chapter "), n % 23)).otherwise(F.concat(F.lit("chapter "), n % 7))
    index = cp.chapter_index(_indexed(t)).withColumn("topics", F.array_join("topics", "|"))
    return cp.chapters_by_name(index, t.documents.select(F.col("lang").alias("subject"), name.alias("asked")).distinct())


@query("chapter_search", "A6", f"WITH {_INDEX_SQL} SELECT subject, chapter, count(*) AS concept_count FROM ix GROUP BY 1, 2 HAVING bool_or(contains(lower(chapter), 'eau') OR contains(lower(name), 'eau'))")
def _(t):
    return cp.chapter_search(_indexed(t), F.lit("Eau"))


@query("graph_statistics", "A10", """SELECT count(*) AS concepts, count(DISTINCT lang) AS subjects, count(DISTINCT source) AS chapters, (SELECT count(*) FROM lineitem) AS relationships FROM documents""")
def _(t):
    return cp.graph_statistics(t.search_docs(), t.lineitem)


@query("catalogue_counts", "A15", "SELECT lang AS subject, count(DISTINCT source) AS total_chapters, string_agg(DISTINCT source, ',' ORDER BY source) AS chapters, count(*) AS documents FROM documents GROUP BY 1")
def _(t):
    g = t.documents.groupBy(F.col("lang").alias("subject")).agg(F.countDistinct("source").alias("total_chapters"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("chapters"), F.count("*").alias("documents"))
    return g


# Edges between a book's concepts: each depends on the one before it and is related to the one two before.
EDGES_SQL = f"""{NEAREST_SQL},
ec AS (SELECT *, lag(concept_id) OVER w AS p1, lag(concept_id, 2) OVER w AS p2 FROM concepts WINDOW w AS (PARTITION BY book, chapter ORDER BY reading_order)),
edges AS (SELECT concept_id AS source_id, p1 AS target_id, 'depends_on' AS type FROM ec WHERE p1 IS NOT NULL UNION ALL SELECT concept_id, p2, 'related_to' FROM ec WHERE p2 IS NOT NULL)"""


def _edges(t):
    from pyspark.sql import Window

    w = Window.partitionBy(*SCOPE).orderBy("reading_order")
    c = concepts(t).withColumn("p1", F.lag("concept_id").over(w)).withColumn("p2", F.lag("concept_id", 2).over(w))
    e = c.select(F.col("concept_id").alias("source_id"), F.inline(F.array(F.struct(F.col("p1").alias("target_id"), F.lit("depends_on").alias("type")), F.struct(F.col("p2").alias("target_id"), F.lit("related_to").alias("type")))))
    return e.where("target_id IS NOT NULL")


PARTS_SQL = f"""{EDGES_SQL},
field AS (SELECT *, CASE WHEN type IN ('definition', 'theorem', 'proof') THEN 'definition' WHEN type = 'formula' THEN 'formula' WHEN {_KIND} = 'example' THEN 'example' END AS field,
          CASE type WHEN 'theorem' THEN 1 WHEN 'proof' THEN 2 ELSE 0 END AS a FROM links),
rel AS (SELECT source_id AS concept_id, 'prerequisite' AS field, t.name FROM edges JOIN concepts t ON t.concept_id = target_id WHERE type = 'depends_on'
  UNION SELECT target_id, 'next', s.name FROM edges JOIN concepts s ON s.concept_id = source_id WHERE type = 'depends_on'
  UNION SELECT source_id, 'related', t.name FROM edges JOIN concepts t ON t.concept_id = target_id WHERE type = 'related_to'
  UNION SELECT target_id, 'related', s.name FROM edges JOIN concepts s ON s.concept_id = source_id WHERE type = 'related_to'),
parts AS (SELECT concept_id, field, a * 1000000000 + reading_order AS pos, text AS value FROM field WHERE field IS NOT NULL UNION ALL SELECT concept_id, field, 0, name FROM rel)"""


def _parts(t):
    return cp.document_parts(concepts(t), links(t), t.objects(), _edges(t))


def _pos(col):
    return F.col(f"{col}.a") * 1000000000 + F.col(f"{col}.c")


@query("search_document_parts", "A11 G2", f"WITH {PARTS_SQL} SELECT concept_id, field, pos, md5(value) AS value_md5 FROM parts")
def _(t):
    return _parts(t).select("concept_id", "field", _pos("pos").alias("pos"), F.md5("value").alias("value_md5"))


@query("typed_passages", "A13", f"""WITH {PARTS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY pos) AS rank FROM parts WHERE field = 'example'),
  b AS (SELECT concept_id, field AS kind, pos, value FROM parts WHERE field IN ('definition', 'formula') UNION ALL SELECT concept_id, 'example', pos, value FROM e WHERE rank <= 5),
  x AS (SELECT * FROM b UNION ALL SELECT concept_id, 'combined/' || kind, pos, value FROM b WHERE kind <> 'example' UNION ALL SELECT concept_id, 'combined/example', pos, value FROM e WHERE rank <= 2)
  SELECT concept_id, kind, count(*) AS n_parts, sum(length(value)) AS n_chars FROM x GROUP BY 1, 2""")
def _(t):
    p = cp.passages(_parts(t), concepts(t).withColumn("subject", F.lit(""))).where("pos.a >= 0")
    return p.groupBy("concept_id", "kind").agg(F.count("*").alias("n_parts"), F.sum(F.length("value")).alias("n_chars"))


_REAL = f"list_filter(definition_texts, lambda d: {sql_any('lower(d)', cues.CONTEXT_CUES)} OR length(d) > 100)"


@query("retrieval_context", "A12", f"""WITH {SEARCH_DOCS_SQL}, r AS (SELECT concept_id, definition_texts, example_texts, {_REAL} AS rl FROM search_docs),
  u AS (SELECT concept_id, unnest(rl) AS d, unnest(range(1, len(rl) + 1)) AS i FROM r), c AS (SELECT concept_id, d, i, coalesce(sum(length(d)) OVER (PARTITION BY concept_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
  k AS (SELECT concept_id, string_agg(d, ' ' ORDER BY i) AS ctx FROM c WHERE i <= 20 AND before < 2000 GROUP BY 1)
  SELECT concept_id, len(rl) AS n_real, md5(CASE WHEN len(rl) > 0 THEN ctx WHEN len(definition_texts) > 0 THEN list_filter(definition_texts, lambda d: length(d) > 20)[1] ELSE array_to_string(example_texts[1:2], ' ') END) AS context_md5 FROM r LEFT JOIN k USING (concept_id)""")
def _(t):
    return cp.ready_context(t.search_docs()).select("concept_id", "n_real", F.md5("context").alias("context_md5"))
