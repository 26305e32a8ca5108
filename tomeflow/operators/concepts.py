"""Concepts: candidates, names, aliases, links to objects, parents, mentions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues, labels, text, vocab
from ..plans.scale import broadcast_if_small, carry, cut_lineage, hot_join, running, top_k
from .containment import contained_names, held_runs

ORDER = ["page", "reading_order"]
PAGES_PER_BLOCK = 64

# Authority of the object a name came from; others have 1.
AUTHORITY = {"heading": 3, "definition": 2, "theorem": 2, "property": 2, "concept": 2}
# Object types and the list of a concept that they fill.
LINK_KINDS = {
    "definition": "definition", "formula": "formula", "property": "property", "theorem": "theorem", "proof": "proof",
    "worked_example": "example", "example_question": "example", "example_solution": "example",
    "calculation_step": "example", "final_answer": "example", "exercise": "exercise", "exercise_question": "exercise",
    "exercise_answer": "exercise", "in_text_question": "exercise", "figure": "figure", "diagram": "figure", "table": "table",
}
KINDS = ["definition", "formula", "property", "theorem", "proof", "example", "exercise", "figure", "table"]
LINKABLE = sorted({*LINK_KINDS, "concept", "important_note", "warning", "summary", "caption", "paragraph"})
# Teaching order of object types; others come last with 10.
TEACHING_ORDER = {
    "concept": 1, "definition": 2, "theorem": 3, "property": 4, "formula": 5, "proof": 6, "worked_example": 7,
    "example": 7, "exercise": 8, "exercise_question": 8,
}
# Name patterns that can never be a concept.
FRONT_MATTER = r"(?i)(editorial committee|chief advisor|publication|acknowledgement|foreword|preface|contents|copyright|all rights reserved|ncert)"
STRUCTURAL = r"(?i)^(chapter \d+|summary|introduction|exercises?|conclusion|objectives?|appendix|answers?)$"
METADATA = r"(?i)^(isbn|pd \d+t|price :|reprint|edition|printed on|published at)"
JUNK_NAMES = [FRONT_MATTER, STRUCTURAL, METADATA]
# Leading-term patterns of a definition, in order; group 1 is the term. The one without a group names none.
LEADING_TERMS = [
    r"^([^,]+?)\s+is\s+(?:called|defined|said\s+to\s+be)\s+",
    r"^the\s+([^,]+?)\s+is\s+(?:called|defined|said\s+to\s+be)\s+",
    r"^([^,]+?)\s+consists\s+of\s+",
    r"^([^,]+?)\s+of\s+(?:a|an|the)\s+",
    r"^([^,]+?)\s+linked\s+with\s+",
    r"^([^,]+?)\s+in\s+(?:an|a|the)\s+",
    r"^having\s+(?:defined\s+)?([^,]+?)\s",
    r"^we\s+are\s+investigating\s+",
    r"^the\s+([^,]+?)\s+of\s+",
]
# Any of these in an example makes it define another concept.
EXAMPLE_DEFINES = [
    r"(?:are|is)\s+called\s+",
    r"(?:are|is)\s+defined\s+as\s+",
    r"(?:are|is)\s+said\s+to\s+be\s+",
    r"is\s+called\s+",
    r"refers\s+to\s+",
]


def any_match(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _map(values: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def concept_id(*parts: Column) -> Column:
    return F.concat(F.lit("concept."), F.substring(F.sha1(F.concat_ws("|", F.lit("concept"), *parts)), 1, 12))


def inferred_chapters(objects: DataFrame) -> DataFrame:
    """Add candidate_chapter: a heading of an unknown chapter takes the next known one within a page."""
    known = F.when(F.col("chapter") != "Unknown Chapter", F.struct("page", "chapter"))
    out = carry(objects, ["book"], ORDER, {"_next": known}, F.floor(F.col("page") / PAGES_PER_BLOCK), reverse=True)
    near = (F.col("chapter") == "Unknown Chapter") & (F.col("type") == "heading") & (F.col("_next.page") - F.col("page") <= 1)
    return out.withColumn("candidate_chapter", F.when(near, F.col("_next.chapter")).otherwise(F.col("chapter"))).drop("_next")


def raw_names(objects: DataFrame) -> DataFrame:
    """(book, chapter, raw, k, type, page, reading_order): names an object offers. A law named in prose counts as a definition."""
    txt = text.trim("text")
    entity = labels.named_entity(txt)
    prefix = r"(?i)^(Definition|Define|Theorem|Property|Key Concept|Concept)[ :.\-–—]*"
    rest = F.substring(F.split(F.regexp_replace(txt, prefix, ""), "\n")[0], 1, 80)
    prefixed = txt.rlike(prefix) & ~txt.rlike(cues.NUMBERED_DEFINITION) & (F.length(rest) >= 3)
    none = F.array().cast("array<string>")
    t = F.col("type")
    law = F.when(entity["cue"] == "named_law", F.array(entity["name"])).otherwise(none)
    named = (
        F.when(entity["cue"].isin("called_if", "defined_if"), F.array(entity["name"]))
        .when(prefixed, labels.heading_candidates(rest))
        .when(entity["cue"] == "named_law", F.array(entity["name"]))
        .when((t == "concept") & (txt != ""), labels.heading_candidates(F.substring(F.split(txt, "\n")[0], 1, 80)))
        .otherwise(none)
    )
    names = (
        F.when(t == "heading", labels.heading_candidates(txt))
        .when(t == "paragraph", law)
        .when(t == "calculation_step", F.when(entity["cue"].isin("called_if", "defined_if"), F.array(entity["name"])).otherwise(none))
        .when(t.isin("definition", "theorem", "property", "concept"), named)
        .otherwise(none)
    )
    return objects.select(
        "book", "subject", "chapter", F.posexplode(names).alias("k", "raw"), F.when(t == "paragraph", "definition").otherwise(t).alias("type"), *ORDER)


def resolve_names(raw: DataFrame) -> DataFrame:
    """Add norm (canonical name) and display; names that cannot be concepts are dropped."""
    # A name is worked out once, where it is judged, and shown only when it is kept: a filter over a column repeats the column.
    fits = lambda n: text.accepts_name(F.col("raw"), n, F.col("chapter")) & (F.length(n) >= 3)
    kept = F.filter(F.array(text.canonical_name(F.col("raw"))), fits)
    return raw.select("*", F.inline(F.transform(kept, lambda n: F.struct(n.alias("norm"), text.display_name(F.col("raw")).alias("display")))))


def build_concepts(resolved: DataFrame, scope: list[str]) -> DataFrame:
    """One row per (scope, norm): first display name, aliases, and the anchor.

    The anchor is the first occurrence of highest authority. Aliases are every other spelling met, sorted.
    """
    at = F.struct(*ORDER, "k")
    auth = _map(AUTHORITY, F.col("type"), 1)
    g = resolved.groupBy(*scope, "norm").agg(
        F.min_by("display", at).alias("name"),
        F.min_by(F.struct("type", *ORDER, "k"), F.struct((-auth).alias("a"), *ORDER, "k")).alias("anchor"),
        F.collect_set("display").alias("spellings"),
    )
    aliases = F.array_sort(F.array_except(F.array_union("spellings", F.array("norm")), F.array("name")))
    return g.select(
        concept_id(*[F.col(c).cast("string") for c in scope], F.col("norm")).alias("concept_id"), *scope, "norm", "name", aliases.alias("aliases"),
        F.col("anchor.type").alias("source_type"), F.col("anchor.page").alias("page"), F.col("anchor.reading_order").alias("reading_order"),
        F.col("anchor.k").alias("k"))


# --- parents ---------------------------------------------------------------------------------------------
def containment_parents(concepts: DataFrame, scope: list[str], least: int = 4) -> DataFrame:
    """(scope, norm, parent): the longest other name, of at least four characters, found inside the name."""
    names = concepts.select(*scope, F.col("norm").alias("name")).where(F.length("name") >= least)
    texts = concepts.select(*scope, F.col("norm").alias("txt")).distinct()
    hits = contained_names(texts, names, scope).where("name <> txt")
    best = hits.groupBy(*scope, F.col("txt").alias("norm")).agg(F.max_by("name", F.struct(F.length("name").alias("l"), "name")).alias("parent"))
    return best


def structural_parents(concepts: DataFrame, scope: list[str]) -> DataFrame:
    """(concept_id, parent_norm) from section then subsection names; subsection first for names ending in law.

    ``section_norm`` and ``subsection_norm``, where given, are the normal names of these: a normal name normalised again
    may be another."""
    norm = lambda c: F.col(f"{c}_norm") if f"{c}_norm" in concepts.columns else text.canonical_name(F.coalesce(c, F.lit("")))
    known = concepts.select(*scope, F.col("norm").alias("parent_norm")).distinct()
    law = F.col("norm").endswith("law")
    options = F.array(
        F.struct(F.when(law, 1).otherwise(0).alias("o"), norm("section").alias("parent_norm")),
        F.struct(F.when(law, 0).otherwise(1).alias("o"), norm("subsection").alias("parent_norm")))
    asked = concepts.select(*scope, "concept_id", "norm", F.inline(options)).where("parent_norm <> '' AND parent_norm <> norm")
    return asked.join(known, [*scope, "parent_norm"]).groupBy("concept_id").agg(F.min_by("parent_norm", "o").alias("parent_norm"))


# --- links ------------------------------------------------------------------------------------------------
def nearest_links(objects: DataFrame, concepts: DataFrame, scope: list[str]) -> DataFrame:
    """As-of join: each linkable object goes to the last concept anchored at or before it in its scope."""
    anchors = concepts.groupBy(*scope, *ORDER).agg(F.max_by("concept_id", "k").alias("_anchor"))
    rows = objects.join(anchors, [*scope, *ORDER], "left")
    out = carry(rows, scope, ORDER, {"concept_id": F.col("_anchor")}, F.floor(F.col("page") / PAGES_PER_BLOCK)).drop("_anchor")
    return out.where(F.col("concept_id").isNotNull() & F.col("type").isin(LINKABLE))


def section_links(objects: DataFrame, concepts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, position, section_concept): the last anchor before the object whose name fits the section.

    A name fits when the section starts with it, or when the section and the parent's name start alike.
    Prefixes meet names through equi-joins. ``concepts`` carries ``parent_name`` (null without one).
    """
    sections = objects.where("section <> ''").select(*scope, "section").distinct().withColumn("s", F.lower(text.trim("section")))
    prefix = lambda df, col: df.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.substring(F.col(col), F.lit(1), i))))
    c = concepts.select(*scope, "concept_id", "k", *ORDER, F.lower(text.trim("name")).alias("n"), F.lower(text.trim("parent_name")).alias("pn"))
    keep = [*scope, "section", "concept_id", "k", *ORDER]
    starts = prefix(sections, "s")
    by_name = starts.join(c.withColumn("p", F.col("n")), [*scope, "p"]).select(*keep)
    by_parent = starts.join(c.where("pn IS NOT NULL").withColumn("p", F.col("pn")), [*scope, "p"]).select(*keep)
    to_parent = prefix(c.where("pn IS NOT NULL AND pn <> ''"), "pn").join(sections.withColumn("p", F.col("s")), [*scope, "p"]).select(*keep)
    fits = by_name.unionByName(by_parent).unionByName(to_parent).distinct()
    at = fits.groupBy(*scope, "section", *ORDER).agg(F.max_by("concept_id", "k").alias("a"))
    rows = at.select(*scope, "section", *ORDER, "a", F.lit(0).alias("is_object")).unionByName(
        objects.where("section <> ''").select(*scope, "section", *ORDER, F.lit(None).cast("string").alias("a"), F.lit(1).alias("is_object")))
    out = carry(rows, [*scope, "section"], [*ORDER, "is_object"], {"section_concept": F.col("a")}, F.floor(F.col("page") / PAGES_PER_BLOCK))
    return out.where("is_object = 1 AND section_concept IS NOT NULL").select(*scope, *ORDER, "section_concept")


def link_objects(objects: DataFrame, concepts: DataFrame, scope: list[str]) -> DataFrame:
    """(concept_id, object_id, object_type, link_reason, position) of every linkable object.

    A concept that fits the section wins over the nearest one. Paragraphs that define count as definitions.
    """
    links = nearest_links(objects, concepts, scope)
    by_section = section_links(objects, concepts, scope)
    links = links.join(by_section, [*scope, *ORDER], "left").withColumn("concept_id", F.coalesce("section_concept", "concept_id"))
    links = links.join(concepts.select("concept_id", "norm"), "concept_id")
    kind = F.when((F.col("type") == "paragraph") & labels.defines(F.col("text")), "definition").otherwise(F.col("type"))
    reason = (
        F.when((F.col("norm") != "") & F.contains(F.lower(F.substring("text", 1, 120)), F.col("norm")), "title_match")
        .when(F.col("type").isin(list(AUTHORITY)), "heading_match").otherwise("section_scope"))
    return links.select("concept_id", F.col("id").alias("object_id"), kind.alias("object_type"), reason.alias("link_reason"), *scope, *ORDER)


def link_counts(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Linked-object counts per concept and kind with the first confidence; concepts without links count zero."""
    kind = _map(LINK_KINDS, F.col("object_type"), "other")
    sums = links.groupBy("concept_id").agg(*[F.count_if(kind == k).alias(f"n_{k}") for k in KINDS], F.count("*").alias("n_refs"))
    out = concepts.join(sums, "concept_id", "left").na.fill(0, [*[f"n_{k}" for k in KINDS], "n_refs"])
    total = F.lit(0)
    for k in KINDS:
        total = total + F.col(f"n_{k}")
    return out.withColumn("n_linked", total).withColumn("confidence", F.least(F.lit(1.0), 0.3 + F.col("n_linked") * 0.07))


def graded_concepts(counted: DataFrame) -> DataFrame:
    """Replace confidence by the filter score and add status accepted, probable or rejected."""
    name = F.col("name")
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    n = F.size(words)
    punct = F.length(F.regexp_replace(name, r"[\p{L}\p{N}_\s]", ""))
    stops = F.size(F.filter(words, lambda w: F.lower(w).isin(vocab.NAME_STOP_WORDS)))
    first = F.substring(name, 1, 1)
    s = F.col("source_type")
    linked = F.col("n_linked") + F.col("n_definition")
    score = (
        F.when(n > 6, -0.5).otherwise(0.0)
        + F.when((punct > 3) | ((punct > 1) & (n <= 2)), -0.5).otherwise(0.0)
        + F.when(stops / n >= 0.5, -0.4).otherwise(0.0)
        + F.when((F.lower(first) == first) & (F.upper(first) != first) & (n > 2), -0.2).otherwise(0.0)
        + F.when(s == "heading", 0.6).when(s.isin("definition", "theorem", "property", "concept"), 0.5).when(s == "paragraph", -0.1).otherwise(0.0)
        + F.when(linked > 0, F.least(F.lit(0.5), linked * 0.1)).otherwise(-0.5)
        + F.when(F.col("n_refs") > 1, F.least(F.lit(0.3), F.col("n_refs") * 0.05)).otherwise(0.0)
    )
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9)
    conf = F.when(any_match(name, JUNK_NAMES) | (n == 0), 0.0).otherwise(clamped)
    out = counted.withColumn("confidence", conf)
    c = F.col("confidence")
    return out.withColumn("status", F.when(c >= 0.75, "accepted").when(c >= 0.5, "probable").otherwise("rejected"))


def descriptions(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(concept_id, description): opening 500 characters of the first linked definition. ``texts``: (object_id, text)."""
    first = links.where("object_type = 'definition'").groupBy("concept_id").agg(F.min_by("object_id", F.struct(*ORDER)).alias("object_id"))
    return texts.join(first, "object_id").select("concept_id", F.substring("text", 1, 500).alias("description"))


def content_aliases(texts: DataFrame, concepts: DataFrame, most: int = 5) -> DataFrame:
    """(concept_id, alias): aliases of key words met at least twice in a concept's texts and not in its name.

    ``texts``: (concept_id, text). Counts are added up per text, so no concept's texts are ever joined together.
    """
    low = F.lower("text")
    entries = [(i, j, k, a) for i, (k, al) in enumerate(vocab.CONTENT_ALIASES.items()) for j, a in enumerate(al)]
    hits = F.array(*[F.struct(F.lit(k).alias("kw"), F.regexp_count(low, F.lit(k)).alias("n")) for k in vocab.CONTENT_ALIASES])
    counts = texts.select("concept_id", F.inline(F.filter(hits, lambda x: x["n"] > 0))).groupBy("concept_id", "kw").agg(F.sum("n").alias("n")).where("n >= 2")
    dictionary = counts.sparkSession.createDataFrame(entries, "i int, j int, kw string, alias string")
    c = concepts.select("concept_id", F.lower("name").alias("low"), "aliases")
    new = counts.join(F.broadcast(dictionary), "kw").join(c, "concept_id")
    new = new.where(~F.contains("low", "kw") & (F.col("alias") != F.col("low")) & ~F.array_contains("aliases", F.col("alias")))
    return top_k(new, ["concept_id"], [F.col("i"), F.col("j")], most).select("concept_id", "rank", "alias")


def mentions(objects: DataFrame, aliases: DataFrame) -> DataFrame:
    """(object_id, concept_id, evidence): whole-word mentions of any alias longer than four characters.

    The longest alias wins where several start, and a match uses up its words. ``aliases``: (concept_id, alias);
    an alias shared by concepts stands for the last by id. Word runs leave a text only when a bounded bitmap of the
    dictionary holds them, and meet the dictionary through an equi-join; then one object's own matches are put in order.
    """
    d = aliases.where(F.length("alias") > 4).groupBy(F.lower("alias").alias("gram")).agg(F.max("concept_id").alias("concept_id"))
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), 0)
    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(d.select("*", F.size(pieces(F.col("gram"))).alias("n")).repartition(tasks, "gram"))
    rows = objects.select("object_id", pieces(F.lower("text")).alias("ps"), F.lower("text").rlike(r"^[\p{L}\p{N}_]").alias("opens"))
    grams = held_runs(rows, d.select(F.col("gram").alias("name"), "n"))
    hits = hot_join(grams, d.select("gram", "concept_id"), ["gram"], F.col("object_id"))
    per = hits.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("m"), "concept_id", "gram"))).alias("ms"))
    kept = F.aggregate(
        "ms", F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<concept_id:string,gram:string>>").alias("out")),
        lambda acc, x: F.when(x["pos"] >= acc["end"], F.struct(
            (x["pos"] - x["m"]).alias("end"),
            F.concat(acc["out"], F.array(F.struct(x["concept_id"].cast("string").alias("concept_id"), x["gram"].alias("gram")))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"])
    found = per.select("object_id", F.inline(kept))
    return found.groupBy("object_id", "concept_id").agg(F.min("gram").alias("evidence"))


def reattributed_definitions(links: DataFrame, texts: DataFrame, concepts: DataFrame, scope: list[str]) -> DataFrame:
    """(object_id, concept_id, new_concept_id): definitions and examples that are about another concept of the scope.

    A definition moves when its leading term, or its opening 100 characters, holds another concept's name (over three
    characters), or the term lies inside such a name. An example of 50 characters or more moves when it mentions
    another name and reads like a definition. One move per object; the first name in order gets it.
    """
    c = cut_lineage(concepts.select(*scope, "concept_id", F.lower("name").alias("name")).where(F.length("name") > 3))
    o = links.where(F.col("object_type").isin("definition", "worked_example")).join(texts, "object_id").withColumn("t", F.lower(text.trim("text")))
    terms = F.filter(F.array(*[text.trim(F.regexp_extract("t", p, 1)) for p in LEADING_TERMS if "(" in p.replace("(?:", "")]), lambda x: x != "")
    tells = (F.length("t") >= 50) & any_match(F.col("t"), EXAMPLE_DEFINES)
    definition = F.col("object_type") == "definition"
    # Of the texts only those that can move an object are kept, with the part that is looked at; they are read several times.
    o = o.select(*scope, "object_id", "concept_id", "object_type", F.when(definition, F.substring("t", 1, 100)).when(tells, F.col("t")).alias("t"),
                 F.when(definition, terms).alias("terms"))
    o = cut_lineage(o.where((F.size("terms") > 0) | (~definition & F.col("t").isNotNull())))
    own = [*scope, "object_id", "concept_id"]
    d = o.where(definition)
    windows = d.select(*own, F.explode(F.concat("terms", F.array("t"))).alias("txt")).distinct()
    inside = contained_names(windows, c, scope, own)
    told = contained_names(o.where(~definition).select(*own, F.col("t").alias("txt")), c, scope, own)
    new = F.struct("name", F.col("concept_id").alias("new_concept_id"))
    met = inside.unionByName(told).distinct().join(c.select(*scope, "name", F.col("concept_id").alias("new_concept_id")), [*scope, "name"])
    # A term may lie in most names: of the names around it, the first is enough, and the first of another concept.
    wanted = d.select(*own, F.explode("terms").alias("term")).distinct()
    around = contained_names(c.select(*scope, F.col("name").alias("txt")).distinct(), wanted.select(*scope, F.col("term").alias("name")), scope)
    around = around.toDF(*[x if x in scope else {"txt": "name", "name": "term"}[x] for x in around.columns]).join(c, [*scope, "name"])
    around = around.groupBy(*scope, "term", "concept_id").agg(F.min(new).alias("at"))
    first = around.groupBy(*scope, "term").agg(F.min("at").alias("first"))
    second = around.join(first, [*scope, "term"]).where("concept_id <> first.new_concept_id").groupBy(*scope, "term").agg(F.min("at").alias("second"))
    best = wanted.join(first.join(second, [*scope, "term"], "left"), [*scope, "term"])
    at = F.when(F.col("first.new_concept_id") != F.col("concept_id"), F.col("first")).otherwise(F.col("second"))
    best = best.select(*own, at.alias("at")).where("at is not null").select(*own, "at.name", "at.new_concept_id")
    moves = met.select(*own, "name", "new_concept_id").unionByName(best).where("new_concept_id <> concept_id")
    return moves.groupBy("object_id", "concept_id").agg(F.min_by("new_concept_id", F.struct("name", "new_concept_id")).alias("new_concept_id"))


# --- resolving ids ------------------------------------------------------------------------------------------
def resolve_texts(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """(concept_id, field, pos, text): listed object ids turned into texts in list order, missing ids skipped.

    ``lists``: (concept_id, field, pos, object_id). Long form: a concept with very many objects stays spread out.
    """
    return lists.join(texts, "object_id").select("concept_id", "field", "pos", "text")


def edge_target_names(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(source_id, name, pos): names of edge targets, each once at its first place; unknown targets skipped."""
    named = edges.join(concepts.select(F.col("concept_id").alias("target_id"), "name"), "target_id")
    return named.groupBy("source_id", "name").agg(F.min("pos").alias("pos"))


def linked_formulas(links: DataFrame, formulas: DataFrame) -> DataFrame:
    """(concept_id, latex, pos): distinct real formulas tied to a concept's definitions by their paragraph, at first place.

    ``formulas``: (formula_id, linked_paragraph_id, latex).
    """
    real = formulas.where(labels.real_formula(F.col("latex")))
    d = links.where("object_type = 'definition'").select("concept_id", F.col("object_id").alias("linked_paragraph_id"), *ORDER)
    j = real.join(d, "linked_paragraph_id")
    return j.groupBy("concept_id", text.trim("latex").alias("latex")).agg(F.min(F.struct(*ORDER, "formula_id")).alias("at"))


def figure_images(figures: DataFrame, objects: DataFrame) -> DataFrame:
    """(concept_id, pos, image_id): figure ids resolved to the object's first image with an id, else kept as they are."""
    o = objects.select(F.col("id").alias("figure_id"), F.filter("images", lambda i: i["id"].isNotNull() & (i["id"] != "")).alias("with_id"), "images")
    j = figures.join(o, "figure_id", "left")
    bare = F.col("images").isNull() | (F.size("images") == 0)
    j = j.withColumn("image_id", F.when(bare, F.col("figure_id")).otherwise(F.try_element_at("with_id", F.lit(1))["id"]))
    return j.where("image_id IS NOT NULL").select("concept_id", "pos", "image_id")


def recover_objects(links: DataFrame, objects: DataFrame, kinds: list[str]) -> DataFrame:
    """(concept_id, kind_pos, page, reading_order, object_id, text): a concept's objects of chosen kinds, in declared order."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), _map(LINK_KINDS, F.col("object_type"), "other"))
    l = links.withColumn("kind_pos", order).where("kind_pos > 0").select("concept_id", "kind_pos", "object_id", *ORDER)  # noqa: E741
    return l.join(objects, "object_id")


def citation_ids(refs: DataFrame, shown: DataFrame) -> DataFrame:
    """Fill concept_id of references by canonical name or alias among the shown results; the first result wins.

    ``refs``: (query_id, ref_pos, label, concept_id or null); ``shown``: (query_id, rank, concept_id, name, aliases).
    """
    known = shown.select("query_id", "rank", F.col("concept_id").alias("found"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("k", "label"))
    known = known.withColumn("key", text.canonical_name(F.col("label"))).where("key <> ''")
    known = known.groupBy("query_id", "key").agg(F.min_by("found", F.struct("rank", "k")).alias("found"))
    asked = refs.withColumn("key", text.canonical_name(F.col("label")))
    out = asked.join(known, ["query_id", "key"], "left")
    return out.withColumn("concept_id", F.coalesce("concept_id", "found")).drop("key", "found")


def unlinked(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects that no concept claims."""
    return objects.join(links.select(F.col("object_id").alias("id")), "id", "left_anti")


# --- reasoning ----------------------------------------------------------------------------------------------
def teaching_sequence(links: DataFrame) -> DataFrame:
    """(concept_id, pos, object_id): a concept's objects by type priority, page and reading order, counted in blocks."""
    rows = links.withColumn("prio", _map(TEACHING_ORDER, F.col("object_type"), 10))
    block = F.col("prio").cast("long") * 1_000_000_000 + F.floor(F.col("page") / PAGES_PER_BLOCK)
    out = running(rows, ["concept_id"], ["prio", *ORDER], {"pos": F.lit(1)}, block)
    return out.select("concept_id", "pos", "object_id", "object_type")


def difficulty(counted: DataFrame, n_prereqs: Column) -> DataFrame:
    score = F.round(1 + n_prereqs * 0.5 + (F.col("n_formula") + F.col("n_theorem") + F.col("n_property")) * 0.2 + F.col("n_proof") * 0.3
                    + F.greatest(F.col("n_exercise") - 5, F.lit(0)) * 0.1, 9)
    out = counted.withColumn("difficulty_score", score)
    s = F.col("difficulty_score")
    return out.withColumn("difficulty", F.when(s < 3.0, "Easy").when(s <= 6.0, "Medium").otherwise("Hard"))


def coverage(counted: DataFrame) -> DataFrame:
    """Add has_* flags and is_complete."""
    has = lambda *ks: F.greatest(*[F.col(f"n_{k}") for k in ks], F.lit(0)) > 0
    return counted.select(
        "*", has("definition").alias("has_definition"), has("formula", "property", "theorem").alias("has_formula"),
        has("example").alias("has_examples"), has("exercise").alias("has_exercises"),
        (has("definition") & has("example") & has("exercise")).alias("is_complete"))


def skills(covered: DataFrame) -> DataFrame:
    """(concept_id, skill): one to three skills per concept, a general one when none applies."""
    s = lambda cond, label: F.when(cond, F.lit(label))
    found = F.array_compact(F.array(
        s(F.col("has_formula"), "Calculation and Application"), s(F.col("n_proof") > 0, "Mathematical Reasoning"),
        s(F.col("has_exercises"), "Problem Solving")))
    every = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Conceptual Understanding")))
    return covered.select("concept_id", F.explode(every).alias("kind"), "name").select("concept_id", F.concat_ws(": ", "kind", "name").alias("skill"))


# --- catalogue and reports ------------------------------------------------------------------------------------
def chapter_index(concepts: DataFrame, n_topics: int = 10) -> DataFrame:
    """(subject, chapter, concept_count, topics): the first topics are picked per task before they move."""
    keys = ["subject", "chapter"]
    counts = concepts.groupBy(*keys).agg(F.count("*").alias("concept_count"))
    first = top_k(concepts, keys, [F.col("concept_id")], n_topics, "r").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("topics"))
    return counts.join(first, keys)


def chapters_by_number(index: DataFrame, numbers: DataFrame) -> DataFrame:
    """Chapters asked for by (subject, number): exact title ``Chapter n`` or ``n`` first, then the first title holding it."""
    n = F.col("number").cast("string")
    j = index.join(broadcast_if_small(numbers), "subject")
    title = F.concat(F.lit("Chapter "), n)
    tier = (
        F.when(F.col("chapter") == title, 0).when(F.contains(F.lower("chapter"), F.lower(title)), 1)
        .when(F.col("chapter") == n, 2).when(F.contains("chapter", n), 3))
    j = j.withColumn("tier", tier).where("tier IS NOT NULL")
    return j.groupBy("subject", "number").agg(F.min_by("chapter", F.struct("tier", "chapter")).alias("chapter"))


def chapters_by_name(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the index asked for by (subject, asked): the chapter of that very name, else the first by name that holds it in any case."""
    at = index.select("subject", F.lower("chapter").alias("txt"), F.struct(*index.columns).alias("found"))
    wanted = asked.select("subject", "asked", F.lower("asked").alias("name")).distinct()
    held = contained_names(at.select("subject", "txt").distinct(), wanted.select("subject", "name"), ["subject"])
    j = at.join(held, ["subject", "txt"]).join(wanted, ["subject", "name"])
    order = F.struct((F.col("found.chapter") != F.col("asked")).alias("partial"), F.col("found.chapter").alias("chapter"))
    best = j.groupBy("subject", "asked").agg(F.min_by("found", order).alias("found"))
    return best.select("asked", "found.*")


def chapter_search(concepts: DataFrame, phrase: Column) -> DataFrame:
    """Chapters whose title, or one of whose topic names, holds the phrase."""
    low = F.lower(phrase)
    hit = F.contains(F.lower("chapter"), low) | F.contains(F.lower("name"), low)
    return concepts.groupBy("subject", "chapter").agg(F.count("*").alias("concept_count"), F.bool_or(hit).alias("hit")).where("hit").drop("hit")


def concept_report(counted: DataFrame, objects: DataFrame, links: DataFrame) -> DataFrame:
    """One row: concepts in all, valid, orphans, empty names, and unlinked key objects."""
    orphan, blank = F.col("n_linked") == 0, text.trim("name") == ""
    a = counted.agg(F.count("*").alias("total_concepts"), F.count_if(~orphan & ~blank).alias("valid_concepts"),
                    F.count_if(orphan).alias("orphan_concepts"), F.count_if(blank).alias("empty_names"))
    free = unlinked(objects, links).agg(
        F.count_if(F.col("type") == "definition").alias("unlinked_definitions"), F.count_if(F.col("type") == "formula").alias("unlinked_formulas"),
        F.count_if(F.col("type") == "worked_example").alias("unlinked_examples"))
    return a.join(F.broadcast(free))


def graph_statistics(concepts: DataFrame, edges: DataFrame, exact: bool = True) -> DataFrame:
    count = F.countDistinct if exact else F.approx_count_distinct
    c = concepts.agg(F.count("*").alias("concepts"), count("subject").alias("subjects"), count("chapter").alias("chapters"))
    return c.join(F.broadcast(edges.agg(F.count("*").alias("relationships"))))


def document_parts(concepts: DataFrame, links: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Search documents in long form: (concept_id, field, pos, value).

    Fields: definition (then theorems and proofs), formula, example, prerequisite, next, related. Names are told once
    at their first place. One row per part, so a concept linked to very many objects is never one task's work.
    """
    field = _map({"definition": "definition", "theorem": "definition", "proof": "definition", "formula": "formula", **{
        k: "example" for k, v in LINK_KINDS.items() if v == "example"}}, F.col("object_type"), "none")
    rank = _map({"definition": 0, "theorem": 1, "proof": 2}, F.col("object_type"), 0)
    txt = links.select("concept_id", "object_id", "object_type", *ORDER).withColumn("field", field).where("field <> 'none'").join(objects.select(F.col("id").alias("object_id"), "text"), "object_id")
    parts = txt.select("concept_id", "field", F.struct(rank.cast("long").alias("a"), F.col("page").cast("long").alias("b"), F.col("reading_order").cast("long").alias("c")).alias("pos"), F.col("text").alias("value"))
    named = concepts.select("concept_id", "name")
    e = edges.join(named.select(F.col("concept_id").alias("source_id"), F.col("name").alias("source_name")), "source_id").join(
        named.select(F.col("concept_id").alias("target_id"), F.col("name").alias("target_name")), "target_id")
    dep = e.where("type = 'depends_on'")
    rel = e.where("type = 'related_to'")
    relations = (
        dep.select(F.col("source_id").alias("concept_id"), F.lit("prerequisite").alias("field"), F.col("target_name").alias("value"), F.col("target_id").alias("o"))
        .unionByName(dep.select(F.col("target_id").alias("concept_id"), F.lit("next").alias("field"), F.col("source_name").alias("value"), F.col("source_id").alias("o")))
        .unionByName(rel.select(F.col("source_id").alias("concept_id"), F.lit("related").alias("field"), F.col("target_name").alias("value"), F.col("target_id").alias("o")))
        .unionByName(rel.select(F.col("target_id").alias("concept_id"), F.lit("related").alias("field"), F.col("source_name").alias("value"), F.col("source_id").alias("o"))))
    first = relations.groupBy("concept_id", "field", "value").agg(F.min("o").alias("o"))
    zero = F.lit(0).cast("long")
    return parts.unionByName(first.select("concept_id", "field", F.struct(zero.alias("a"), zero.alias("b"), zero.alias("c")).alias("pos"), "value"))


def passages(parts: DataFrame, concepts: DataFrame, examples: int = 5) -> DataFrame:
    """(concept_id, kind, pos, value): definition, example (first five), formula and combined passages in long form.

    The combined passage holds the definitions, the first two examples and the formulas. The head line of each
    passage comes as its position-zero row.
    """
    ex = parts.where("field = 'example'")
    first = top_k(ex, ["concept_id"], [F.col("pos")], examples)
    body = parts.where("field IN ('definition', 'formula')").select("concept_id", F.col("field").alias("kind"), "pos", "value").unionByName(
        first.select("concept_id", F.lit("example").alias("kind"), "pos", "value"))
    short = first.where("rank <= 2").select("concept_id", F.lit("example").alias("kind"), "pos", "value")
    combined = body.where("kind <> 'example'").unionByName(short).withColumn("kind", F.concat(F.lit("combined/"), "kind"))
    heads = body.select("concept_id", "kind").distinct().join(concepts.select("concept_id", "name", "subject", "chapter"), "concept_id")
    title = (
        F.when(F.col("kind") == "definition", F.concat(F.lit("Definition of "), "name")).when(F.col("kind") == "example", F.concat(F.lit("Examples of "), "name"))
        .otherwise(F.concat(F.lit("Formulas for "), "name")))
    zero = F.lit(-1).cast("long")
    at = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("c"))
    return body.unionByName(combined).unionByName(heads.select("concept_id", "kind", at.alias("pos"), title.alias("value")))


def ready_context(docs: DataFrame, most: int = 20, chars: int = 2000, least: int = 100) -> DataFrame:
    """(concept_id, context): definitions with a cue or over 100 characters, in order until 20 items or 2000 characters.

    The first definition over 20 characters, or the first two examples, stand in when none qualifies.
    Works inside each document's own list.
    """
    real = F.filter("definition_texts", lambda d: labels.any_of(F.lower(d), cues.CONTEXT_CUES) | (F.length(d) > least))
    start = F.struct(F.lit(0).alias("len"), F.array().cast("array<string>").alias("got"))
    fold = lambda arr: F.aggregate(
        arr, start,
        lambda acc, d: F.when((F.size(acc["got"]) < most) & (acc["len"] < chars),
                              F.struct((acc["len"] + F.length(d)).alias("len"), F.concat(acc["got"], F.array(d)).alias("got"))).otherwise(acc),
        lambda acc: acc["got"])
    out = docs.withColumn("real", real)
    context = (
        F.when(F.size("real") > 0, F.array_join(fold(F.col("real")), " "))
        .when(F.size("definition_texts") > 0, F.try_element_at(F.filter("definition_texts", lambda d: F.length(d) > 20), F.lit(1)))
        .otherwise(F.array_join(F.slice("example_texts", 1, 2), " ")))
    return out.select("concept_id", F.size("real").alias("n_real"), context.alias("context"))


def best_examples(results: DataFrame, docs: DataFrame, queries: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, concept_id, rank, example): a result's examples holding most query words of over two letters, up to eight."""
    q = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 2)).alias("ws"))
    j = docs.select("concept_id", "example_texts").join(broadcast_if_small(results.select("query_id", "concept_id")), "concept_id").join(q, "query_id")
    j = j.select("query_id", "concept_id", "ws", F.posexplode("example_texts").alias("pos", "example"))
    j = j.withColumn("hits", F.size(F.filter("ws", lambda w: F.contains(F.lower(F.col("example")), w))))
    return top_k(j, ["query_id", "concept_id"], [F.col("hits").desc(), F.col("pos")], most).where("hits > 0").select(
        "query_id", "concept_id", "rank", "pos", "hits")
