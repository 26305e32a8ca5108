"""Text objects in reading order: types, links, headings, worked examples and merging of parser outputs.

Ordered operators work per book (a book came out of one row or file). They scan blocks of pages, so one
book that holds a large share of all objects is still split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues, labels, text
from ..plans.scale import carry, cut_lineage

ORDER = ["page", "reading_order"]
PAGES_PER_BLOCK = 64


def _block() -> Column:
    return F.floor(F.col("page") / PAGES_PER_BLOCK)


def reading_links(objects: DataFrame) -> DataFrame:
    """Add previous_id and next_id within the book: neighbours inside a block, then the edges of the blocks."""
    rows = objects.withColumn("_blk", _block())
    at = F.struct(*ORDER)
    edges = rows.groupBy("book", "_blk").agg(F.min_by("id", at).alias("first"), F.max_by("id", at).alias("last"))
    blocks = Window.partitionBy("book").orderBy("_blk")
    edges = edges.select("book", "_blk", F.lag("last").over(blocks).alias("_p"), F.lead("first").over(blocks).alias("_n"))
    here = Window.partitionBy("book", "_blk").orderBy(*ORDER)
    out = rows.select("*", F.lag("id").over(here).alias("p"), F.lead("id").over(here).alias("n")).join(edges, ["book", "_blk"])
    return out.select(*objects.columns, F.coalesce("p", "_p").alias("previous_id"), F.coalesce("n", "_n").alias("next_id"))


def _context(objects: DataFrame) -> DataFrame:
    """Add own_type and the openers of the contexts an object stands in: example, exercise, theorem, solution.

    Contexts only open and close on objects whose type needs no context, so the last position of each kind of
    opener and closer before an object says what is open there. A solution counts when it comes after the open
    example: nothing can have closed that example in between.
    """
    # Written once: the scans of blocks read it several times, and own types cost more than reading them.
    typed = cut_lineage(objects.withColumn("own_type", labels.own_type(F.col("text"))))
    t = F.col("own_type")
    at = F.struct("page", "reading_order")
    mark = lambda *names: F.when(t.isin(*names), F.struct(at.alias("at"), F.col("id").alias("id")))
    values = {
        "_reset": mark("heading", "exercise", "in_text_question"),
        "_example": mark("worked_example"),
        "_solution": mark("example_solution"),
        "_exercise": mark("exercise"),
        "_exercise_end": mark("heading", "in_text_question"),
        "_theorem": mark("theorem", "property"),
    }
    out = carry(typed, ["book"], ORDER, values, _block(), inclusive=False)
    after = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(f"{a}.at") > F.col(f"{b}.at")))
    held = lambda a, b: F.when(after(a, b), F.col(a))
    inside = after("_example", "_reset") & after("_solution", "_example")
    return out.select(
        *typed.columns, held("_example", "_reset").alias("example"), held("_exercise", "_exercise_end").alias("exercise"),
        held("_theorem", "_reset").alias("theorem"), F.when(inside, F.col("_solution")).alias("solution"),
    )


def typed_objects(objects: DataFrame, bold: str | None = None, footnote: str | None = None) -> DataFrame:
    """Add ``type`` and ``parent_id``.

    Text decides first. Otherwise an open solution makes a step or final answer, an open example a question, an
    open exercise an exercise question; else the type before it on the page goes on, where such types may.
    ``bold`` and ``footnote`` name optional boolean columns for layout evidence that plain text lacks.
    """
    out = _context(objects)
    t = F.col("own_type")
    inside = (
        F.when(t.isNotNull(), t)
        .when(F.col("solution").isNotNull(), F.when(text.trim("text").rlike(cues.FINAL_ANSWER), "final_answer").otherwise("calculation_step"))
        .when(F.col("example").isNotNull(), "example_question")
        .when(F.col("exercise").isNotNull(), "exercise_question")
    )
    if bold:
        inside = F.when((inside == "heading") & ~F.col(bold), "paragraph").when(
            F.col(bold) & (inside == "paragraph") & (F.length("text") < 80), "concept").otherwise(inside)
    if footnote:
        inside = F.when((inside == "paragraph") & F.col(footnote), "footnote").otherwise(inside)
    out = out.withColumn("_known", inside)
    flows = F.when(F.col("_known").isin(cues.NON_BLEEDING), "paragraph").otherwise(F.col("_known"))
    # The flow stops at the page break; a printed page holds few objects.
    page = Window.partitionBy("book", "page").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("type", F.coalesce("_known", F.last(flows, ignorenulls=True).over(page), F.lit("paragraph")))
    k = F.col("type")
    parent = (
        F.when(k == "proof", F.col("theorem.id"))
        .when(k.isin("example_question", "example_solution"), F.col("example.id"))
        .when(k.isin("calculation_step", "final_answer"), F.col("solution.id"))
        .when(k.isin("exercise_question", "exercise_answer"), F.col("exercise.id"))
    )
    return out.withColumn("parent_id", parent).select(*objects.columns, "type", "parent_id")


def children(typed: DataFrame) -> DataFrame:
    """(parent_id, child_id, page, reading_order): child lists in long form, so no list can outgrow a task."""
    return typed.where("parent_id IS NOT NULL").select("parent_id", F.col("id").alias("child_id"), "book", *ORDER)


def heading_levels(objects: DataFrame, heading: Column, subject: Column) -> DataFrame:
    """Add chapter_no, section_no and subsection_no, carried forward from numbered headings.

    Headings that are page noise change nothing: fewer than three letters, the subject's own name, or a
    chapter number above the limit.
    """
    t = text.trim("text")
    marker = t.rlike(cues.CHAPTER_MARKER)
    bare = text.trim(F.regexp_replace(t, r"(?i)^(Unit|Chapter)\s+", ""))
    word = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)", 1))
    spelled = F.array_position(F.array(*[F.lit(w) for w in cues.NUMBER_WORDS]), word)
    bare = F.when(marker & (spelled > 0), F.concat(spelled.cast("string"), F.lit(" "), F.regexp_replace(bare, r"^[A-Za-z]+\s*", ""))).otherwise(bare)
    bare = F.when(marker & bare.rlike(r"^\d+$"), F.concat(bare, F.lit(" "))).otherwise(bare)
    rows = objects.withColumn("_bare", F.when(heading, bare))
    number = F.regexp_extract("_bare", r"^(\d+(\.\d+)*)\s", 1)
    title = text.trim(F.regexp_replace("_bare", r"^\d+(\.\d+)*\s+", ""))
    real = (number != "") & (F.split(number, r"\.")[0].cast("long") <= cues.MAX_CHAPTER_NUMBER)
    worded = (F.length(F.regexp_replace(title, r"[^A-Za-z]", "")) >= 3) & (F.lower(title) != F.lower(subject))
    rows = rows.withColumn("_no", F.when(heading & real & (marker | worded), number))
    parts = F.split("_no", r"\.")
    n = F.size(parts)
    level = lambda v: F.when(F.col("_no").isNotNull(), v)
    # Each level is carried with the empty string standing for "none", so that a higher heading clears it.
    chapter = level(parts[0])
    section = level(F.when(n == 1, "").when(n == 2, F.col("_no")))
    subsection = level(F.when(n <= 2, "").otherwise(F.col("_no")))
    out = carry(rows, ["book"], ORDER, {"chapter_no": chapter, "section_no": section, "subsection_no": subsection}, _block())
    return out.drop("_bare", "_no").withColumn("section_no", F.nullif("section_no", F.lit(""))).withColumn(
        "subsection_no", F.nullif("subsection_no", F.lit("")))


def proof_edges(typed: DataFrame) -> DataFrame:
    """Edges from a proof to the theorem, property or concept right before it; empty and figure objects are skipped."""
    real = F.when((text.trim("text") != "") & (F.col("type") != "figure"), F.struct(F.col("id").alias("id"), F.col("type").alias("type")))
    out = carry(typed.select("book", "id", "type", "text", *ORDER), ["book"], ORDER, {"_before": real}, _block(), inclusive=False)
    out = out.where((F.col("type") == "proof") & F.col("_before.type").isin("theorem", "property", "concept"))
    return out.select(F.col("id").alias("source_id"), F.col("_before.id").alias("target_id"), F.lit("explains").alias("type"), F.lit(0.8).alias("confidence"))


def worked_examples(typed: DataFrame) -> DataFrame:
    """(id, book, page, problem_text, solution_text, complete_text, n_fragments): examples put together again.

    Fragments run from an example header to the next header or exercise. Text goes to the solution once a
    solution has begun (or says ``we have``); short paragraphs belong to the example as well. An example's
    text is gathered per header, which is one example's worth of lines.
    """
    t = F.col("type")
    head = F.when(t == "worked_example", F.col("id"))
    stop = F.when(t.isin("worked_example", "exercise"), F.struct(F.struct(*ORDER).alias("at"), t.alias("t")))
    out = carry(typed, ["book"], ORDER, {"_head": head, "_stop": stop}, _block())
    # Right after a header an exercise ends the example only when it says so.
    out = out.where(F.col("_head").isNotNull() & (F.col("_stop.t") == "worked_example"))
    used = t.isin("worked_example", "example_question", "example_solution", "calculation_step", "definition", "paragraph")
    out = out.where(used)
    begun = F.when((t == "example_solution") & F.lower("text").contains("solution"), F.lit(1))
    before = Window.partitionBy("book", "_head").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_begun", F.max(begun).over(before))
    text_ok = (text.trim("text") != "") & ((t != "paragraph") | (F.length("text") < 200))
    in_solution = (t == "example_solution") | (
        (t != "worked_example") & (F.col("_begun").isNotNull() | ((t != "paragraph") & F.lower("text").contains("we have"))))
    out = out.select("book", "_head", *ORDER, t.alias("type"), "id", F.when(text_ok, F.col("text")).alias("text"), in_solution.alias("sol"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c & F.col("text").isNotNull(), F.struct(*ORDER, "text")))), lambda x: x["text"]), " ")
    ex = out.groupBy("book", F.col("_head").alias("id")).agg(
        F.min("page").alias("page"), clean_example(joined(~F.col("sol"))).alias("problem_text"),
        clean_example(joined(F.col("sol"))).alias("solution_text"), F.count("*").alias("n_fragments"))
    complete = F.when(F.col("solution_text") != "", F.concat("problem_text", F.lit("\n\nSolution: "), "solution_text")).otherwise(F.col("problem_text"))
    return ex.withColumn("complete_text", complete)


def clean_example(txt: Column) -> Column:
    """Blanks collapsed; reprint notes and running page heads removed."""
    t = text.trim(F.regexp_replace(txt, r"\s+", " "))
    return text.trim(F.regexp_replace(F.regexp_replace(t, r"Reprint 202[56]-2[67]", ""), r"(MATHEMATICS|PHYSICS|CHEMISTRY) (57|58|59|60)", ""))


def object_issues(objects: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, type, field, severity, message): none to several quality issues per object."""
    issue = lambda cond, field, sev, msg: F.when(cond, F.struct(
        F.lit(field).alias("field"), F.lit(sev).alias("severity"), F.lit(msg).alias("message")))
    t = F.col("type")
    issues = F.array(
        issue(F.col("confidence") < threshold, "confidence", "review", "low confidence"),
        issue((text.trim("text") == "") & ~t.isin("figure", "diagram"), "text", "warning", "empty text"),
        issue(t.isin("definition", "theorem", "property") & (F.length("text") < 10), "text", "review", "very short"),
        issue(F.col("page") < 1, "page", "warning", "no page number"),
    )
    return objects.select("id", "type", F.inline(F.array_compact(issues)))


def validation_report(objects: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Issue counts by field and severity with totals (rollup nulls shown as ``all``), and flagged objects."""
    r = object_issues(objects, threshold).rollup("field", "severity").agg(F.count("*").alias("n_issues"), F.countDistinct("id").alias("n_objects"))
    return r.select(F.coalesce("field", F.lit("all")).alias("field"), F.coalesce("severity", F.lit("all")).alias("severity"), "n_issues", "n_objects")


def merge_parsers(outputs: DataFrame) -> DataFrame:
    """Merge several parsers' rows per (book, type, page, reading_order, first 120 characters).

    ``outputs`` has parser_rank (0 is first) and confidence, latex array, coordinates. The most confident row
    wins, the earlier parser on a tie; losers add latex and, where it is missing, coordinates. Parsers are
    few, so a key has few rows.
    """
    key = F.sha1(F.concat_ws("|", "type", "page", "reading_order", F.substring("text", 1, 120)))
    win = F.struct((-F.col("confidence")).alias("c"), F.col("parser_rank"))
    row = F.struct("id", "text", "confidence", "parser", "latex", "coordinates")
    g = outputs.groupBy("book", "type", "page", "reading_order", key.alias("merge_key")).agg(
        F.min_by(row, win).alias("w"),
        F.array_sort(F.collect_list(F.struct(win.alias("o"), F.col("latex").alias("latex")))).alias("ls"),
        F.min_by("coordinates", F.when(F.col("coordinates").isNotNull(), win)).alias("xy"),
    )
    return g.select(
        "book", "type", "page", "reading_order", "w.id", "w.text", "w.confidence", "w.parser",
        F.array_distinct(F.flatten(F.transform("ls", lambda x: x["latex"]))).alias("latex"),
        F.coalesce("w.coordinates", "xy").alias("coordinates"),
    )


def collapse_duplicates(rows: DataFrame, key: list[str], rank: str = "parser_rank") -> DataFrame:
    """First parser's row per key. min_by combines before the shuffle, so a key with many copies is no hot spot."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(rank, "id")).alias("w"))
    return best.select(*key, "w.*")


def heading_tree(headings: DataFrame) -> DataFrame:
    """(book, chapter, section, page_start): first page of each chapter and section title; null section is the chapter."""
    at = F.struct(*ORDER)
    chapters = headings.where("chapter <> ''").groupBy("book", "chapter").agg(F.min_by("page", at).alias("page_start"))
    sections = headings.where("chapter <> '' AND section <> ''").groupBy("book", "section").agg(
        F.min_by(F.struct("chapter", "page"), at).alias("f"))
    return chapters.select("book", "chapter", F.lit(None).cast("string").alias("section"), "page_start").unionByName(
        sections.select("book", F.col("f.chapter").alias("chapter"), "section", F.col("f.page").alias("page_start")))


def nearest_on_page(figures: DataFrame, candidates: DataFrame, preferred: Column | None = None) -> DataFrame:
    """(figure_id, match_id): the nearest candidate on the same page by vertical distance.

    ``figures``: (figure_id, book, page, y0); ``candidates``: (match_id, book, page, y0, reading_order). Where any
    candidate on the page satisfies ``preferred``, only those count. A page bounds both sides of the join.
    """
    c = candidates.select("book", "page", "match_id", F.col("y0").alias("c_y0"), "reading_order",
                          (~(preferred if preferred is not None else F.lit(True))).cast("int").alias("other"))
    j = figures.join(c, ["book", "page"])
    return j.groupBy("figure_id").agg(F.min_by("match_id", F.struct("other", F.abs(F.col("c_y0") - F.col("y0")), "reading_order")).alias("match_id"))


def best_overlap(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(image_id, region_id, area): the region of the page with the largest common area, none when nothing overlaps.

    Both: (id, book, page, x0, y0, x1, y1).
    """
    r = regions.select("book", "page", F.col("id").alias("region_id"), *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    w = F.least("x1", "r_x1") - F.greatest("x0", "r_x0")
    h = F.least("y1", "r_y1") - F.greatest("y0", "r_y0")
    j = images.withColumnRenamed("id", "image_id").join(r, ["book", "page"]).where((w > 0) & (h > 0)).withColumn("area", w * h)
    best = j.groupBy("image_id").agg(F.max_by(F.struct("region_id", "area"), F.struct("area", (-F.col("region_id")).alias("i"))).alias("b"))
    return best.select("image_id", "b.region_id", "b.area")
