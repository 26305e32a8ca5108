"""Retrieval, extraction and ordering metrics as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.scale import broadcast_if_small, running

CUTS = (1, 3, 5)

# Metrics watched by the regression gate.
GATE_METRICS = [
    "concept_precision", "concept_recall", "concept_f1", "edge_precision", "edge_recall", "edge_f1",
    "hierarchy_accuracy", "formula_linking_accuracy", "figure_linking_accuracy", "proof_linking_accuracy",
    "learning_path_accuracy",
]


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def relevance(results: DataFrame, labels: DataFrame, qrels: DataFrame) -> DataFrame:
    """Add ``rel`` to ranked results: 1 when a label of the document is among the query's expected names.

    ``labels``: (concept_id, label), names and aliases in canonical form; ``qrels``: (query_id, expected).
    """
    wanted = qrels.select("query_id", F.col("expected").alias("label"))
    hit = results.join(labels, "concept_id").join(wanted, ["query_id", "label"], "left_semi")
    hit = hit.select("query_id", "rank").distinct().withColumn("rel", F.lit(1))
    return results.join(hit, ["query_id", "rank"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def retrieval_metrics(judged: DataFrame, expected: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per query: MRR, recall and precision at 1, 3, 5 and nDCG at 5.

    ``judged``: (query_id, rank, rel); ``expected``: (query_id, n_expected) for every query asked. A query
    without results scores 0. Recall and nDCG may pass 1 when several documents match one name.
    """
    group = group or []
    rel = F.col("rel")
    rank = F.col("rank")
    sums = judged.groupBy(*group, "query_id").agg(
        F.max(F.when(rel == 1, 1 / rank)).alias("mrr"),
        *[F.sum(F.when(rank <= k, rel)).alias(f"hits_{k}") for k in CUTS],
        F.sum(F.when(rank <= 5, rel / F.log2(rank + 1))).alias("dcg"),
    )
    asked = expected
    if group:
        cells = judged.select(*group).distinct()
        asked = expected.join(broadcast_if_small(cells))
    out = asked.join(sums, [*group, "query_id"], "left")
    n = F.col("n_expected")
    ideal = F.lit(0.0)
    for i in range(1, 6):
        ideal = ideal + F.when(n >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
    hits = lambda k: F.coalesce(F.col(f"hits_{k}"), F.lit(0))
    return out.select(
        *group, "query_id", F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
        *[ratio(hits(k), n).alias(f"recall_{k}") for k in CUTS],
        *[(hits(k) / k).alias(f"precision_{k}") for k in CUTS],
        F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_5"),
    )


def mean_metrics(per_query: DataFrame, group: list[str] | None = None) -> DataFrame:
    group = group or []
    names = [c for c in per_query.columns if c not in (*group, "query_id")]
    return per_query.groupBy(*group).agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in names])


def name_extraction_scores(found: DataFrame, gold: DataFrame, group: list[str]) -> DataFrame:
    """Precision, recall and F1 of found names against gold names and aliases, per ``group``.

    ``found``: (group, name); ``gold``: (group, gold_id, label), every name and alias a row of its own.
    Precision is over distinct found names, recall over distinct gold entries.
    """
    f = found.select(*group, "name").distinct()
    pairs = f.join(gold.withColumnRenamed("label", "name"), [*group, "name"])
    tp = pairs.groupBy(*group).agg(F.countDistinct("name").alias("matched_found"), F.countDistinct("gold_id").alias("matched_gold"))
    n_found = f.groupBy(*group).agg(F.count("*").alias("n_found"))
    n_gold = gold.groupBy(*group).agg(F.countDistinct("gold_id").alias("n_gold"))
    out = n_gold.join(n_found, group, "full").join(tp, group, "left").na.fill(0)
    p, r = ratio(F.col("matched_found"), F.col("n_found")), ratio(F.col("matched_gold"), F.col("n_gold"))
    return out.select(*group, "n_found", "n_gold", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def hierarchy_accuracy(gold: DataFrame, actual: DataFrame, group: list[str]) -> DataFrame:
    """Share of gold (name, parent) rows whose actual parent is the same; an absent child is wrong."""
    a = actual.select(*group, "name", F.col("parent").alias("actual_parent"))
    out = gold.join(a, [*group, "name"], "left")
    ok = F.coalesce((F.col("parent") == F.col("actual_parent")).cast("int"), F.lit(0))
    return out.groupBy(*group).agg(F.count("*").alias("n_checked"), F.avg(ok).alias("accuracy"))


def edge_sets(gold: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """Every distinct edge once with in_gold and in_inferred flags; the three set differences are filters."""
    g = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("i"))
    i = inferred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("i"))
    both = g.unionByName(i).groupBy(*keys).agg(F.max("g").alias("in_gold"), F.max("i").alias("in_inferred"))
    return both


def edge_scores(sets: DataFrame, group: list[str] | None = None) -> DataFrame:
    out = sets.groupBy(*(group or [])).agg(
        F.sum(F.col("in_gold") * F.col("in_inferred")).alias("true_positives"),
        F.sum("in_inferred").alias("n_inferred"), F.sum("in_gold").alias("n_gold"),
    )
    p, r = ratio(F.col("true_positives"), F.col("n_inferred")), ratio(F.col("true_positives"), F.col("n_gold"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(p, r))


def keyword_linking(expected: DataFrame, links: DataFrame, texts: DataFrame, group: list[str]) -> DataFrame:
    """Share of expected keywords found inside any text linked to their concept.

    ``expected``: (group, concept_id, keyword); ``links``: (concept_id, object_id); ``texts``: (object_id, text).
    Keywords of a concept are gathered into its row, so texts meet each concept once and never pair up.
    """
    words = expected.groupBy(*group, "concept_id").agg(F.collect_set(F.lower("keyword")).alias("keywords"))
    linked = links.join(words.select("concept_id", "keywords"), "concept_id").join(texts, "object_id")
    found = linked.select("concept_id", F.explode(F.filter("keywords", lambda k: F.contains(F.lower(F.col("text")), k))).alias("kw")).distinct()
    e = expected.withColumn("kw", F.lower("keyword"))
    hit = e.join(found.withColumn("hit", F.lit(1)), ["concept_id", "kw"], "left")
    return hit.groupBy(*group).agg(F.count("*").alias("n_expected"), F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))


def order_agreement(expected: DataFrame, actual: DataFrame, group: list[str], block: int = 4096) -> DataFrame:
    """Kendall agreement of two orders per group, rescaled to [0, 1], with the coverage of the expected items.

    ``expected`` and ``actual``: (group, item, pos), whole-number positions. Pairs are never listed:
    an item meets the items before it through the bits of its actual position, so a group of n items
    makes n rows per used bit, and the counting scan is cut into blocks of positions. Ties are discordant.
    """
    e = expected.select(*group, "item", F.col("pos").alias("e_pos"))
    both = e.join(actual.select(*group, "item", F.col("pos").alias("a_pos")), [*group, "item"])
    # Bit b splits positions that agree above b; the earlier one with bit 0 and the later with bit 1 is concordant.
    widths = both.groupBy(*group).agg(F.length(F.bin(F.max("a_pos"))).alias("bits"))
    levels = both.join(widths, group).select(
        *group, "e_pos", F.col("a_pos").cast("long").alias("v"), F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("b"))
    levels = levels.withColumn("prefix", F.expr("shiftright(v, b + 1)")).withColumn("bit", F.expr("shiftright(v, b) & 1"))
    zeros = running(levels, [*group, "b", "prefix"], ["e_pos"], {"zeros_before": 1 - F.col("bit")},
                    F.floor(F.col("e_pos") / block), inclusive=False)
    conc = zeros.groupBy(*group).agg(F.sum(F.when(F.col("bit") == 1, F.col("zeros_before")).otherwise(0)).alias("concordant"))
    n_expected = e.groupBy(*group).agg(F.countDistinct("item").alias("n_expected"))
    n_common = both.groupBy(*group).agg(F.count("*").alias("n"))
    out = n_expected.join(n_common, group, "left").join(conc, group, "left").na.fill(0)
    n = F.col("n")
    pairs = n * (n - 1) / 2
    return out.select(
        *group, "n_expected", n.alias("n_common"), (n / F.col("n_expected")).alias("coverage"),
        F.when(n >= 2, F.col("concordant") / pairs).when(n == 1, 1.0).otherwise(0.0).alias("agreement"),
    )


def path_details(expected: DataFrame, actual: DataFrame, group: list[str]) -> DataFrame:
    """Expected items that are missing from, or elsewhere in, the actual order."""
    e = expected.select(*group, "item", F.col("pos").alias("expected_pos"))
    a = actual.select(*group, "item", F.col("pos").alias("actual_pos"))
    status = F.when(F.col("actual_pos").isNull(), "missing").when(F.col("actual_pos") != F.col("expected_pos"), "misordered")
    return e.join(a, [*group, "item"], "left").withColumn("status", status).where("status IS NOT NULL")


def label_accuracy(cases: DataFrame, checks: list[str], n_refs: str = "n_refs", n_invalid: str = "n_invalid",
                   group: list[str] | None = None) -> DataFrame:
    """Accuracy per check column (null means unlabelled), citation validity and share of clean cases."""
    accs = [F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6).alias(f"{c}_accuracy") for c in checks]
    refs, bad = F.sum(n_refs), F.sum(n_invalid)
    return cases.groupBy(*(group or [])).agg(
        F.count("*").alias("n_cases"), *accs,
        F.round(F.when(refs > 0, (refs - bad) / refs).otherwise(1.0), 6).alias("citation_validity"),
        F.round(F.avg((F.col(n_invalid) == 0).cast("int")), 6).alias("clean_rate"),
    )


def regression_report(results: DataFrame, checks: list[str], by: str) -> DataFrame:
    """Rates in percent for each value of ``by`` and, through a rollup, for all rows (null ``by``)."""
    every = None
    for c in checks:
        every = F.col(c) if every is None else every & F.col(c)
    pct = lambda c: F.avg(c.cast("int")) * 100
    return results.rollup(by).agg(
        F.count("*").alias("total"), pct(every).alias("overall_accuracy"),
        *[pct(F.col(c)).alias(f"{c}_rate") for c in checks], F.avg("latency_ms").alias("avg_latency_ms"),
    )


def regression_gate(current: DataFrame, baseline: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Problems of (subject, metric, value, status) against a baseline of the same shape; no rows means pass."""
    b = baseline.select("subject", "metric", F.col("value").alias("baseline"), F.col("status").alias("b_status"))
    j = current.join(b, ["subject", "metric"], "left")
    problem = (
        F.when(F.col("status") != "ok", F.concat(F.lit("status "), F.col("status")))
        .when(F.col("b_status").isNull() | (F.col("b_status") != "ok"), "no usable baseline")
        .when(F.coalesce("value", F.lit(0.0)) + tolerance < F.coalesce("baseline", F.lit(0.0)), "regression")
    )
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select("subject", "metric", "value", "baseline", "problem")


def gold_issues(concepts: DataFrame, edges: DataFrame, path: DataFrame, versions: DataFrame) -> DataFrame:
    """One table of problems in reference data: (book, issue, entry).

    ``concepts``: (book, name, parent_name, required array); ``edges``: (book, source, target);
    ``path``: (book, name); ``versions``: (book, version).
    """
    names = concepts.select("book", "name").distinct()

    def absent(df: DataFrame, col: str, issue: str) -> DataFrame:
        rows = df.where(F.col(col).isNotNull()).select("book", F.col(col).alias("name"))
        return rows.join(names, ["book", "name"], "left_anti").select("book", F.lit(issue).alias("issue"), F.col("name").alias("entry"))

    dup = concepts.groupBy("book", "name").count().where("count > 1")
    semver = versions.where(~F.col("version").rlike(r"^\d+\.\d+\.\d+$"))
    bare = concepts.groupBy("book").agg(F.max(F.size("required")).alias("most")).where("most <= 0")
    return (
        dup.select("book", F.lit("duplicate name").alias("issue"), F.col("name").alias("entry"))
        .unionByName(absent(concepts, "parent_name", "unknown parent"))
        .unionByName(absent(edges, "source", "unknown source"))
        .unionByName(absent(edges, "target", "unknown target"))
        .unionByName(absent(path, "name", "unknown path entry"))
        .unionByName(semver.select("book", F.lit("bad version").alias("issue"), F.col("version").alias("entry")))
        .unionByName(bare.select("book", F.lit("no annotations").alias("issue"), F.lit("").alias("entry")))
    )


def _row_hash(cols: list[str]) -> Column:
    """A 32-bit row hash from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def content_hash(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Order-free content hash: row count and sum of row hashes, combined before the shuffle."""
    cols = [c for c in df.columns if c not in (keys or [])]
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n_rows"), F.sum(_row_hash(cols)).alias("hash_sum"))


def same_content(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Compare two runs key by key: (keys, deterministic)."""
    rename = lambda df, s: content_hash(df, keys).select(*keys, F.col("n_rows").alias(f"n_{s}"), F.col("hash_sum").alias(f"h_{s}"))
    j = rename(a, "a").join(rename(b, "b"), keys, "full")
    same = F.coalesce((F.col("h_a") == F.col("h_b")) & (F.col("n_a") == F.col("n_b")), F.lit(False))
    return j.select(*keys, same.alias("deterministic"))


def plan_case_checks(cases: DataFrame) -> DataFrame:
    """Check present section kinds of each case: required, forbidden and forbidden lead.

    ``cases``: (case_id, present array, must_have array, must_not_have array, must_not_lead array).
    """
    return cases.select(
        "*",
        F.array_except("must_have", "present").alias("missing"),
        F.array_intersect("must_not_have", "present").alias("forbidden"),
        F.coalesce(F.array_contains("must_not_lead", F.try_element_at("present", F.lit(1))), F.lit(False)).alias("bad_lead"),
    ).withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden") == 0) & ~F.col("bad_lead"))


def answer_quality(answers: DataFrame, keywords: list[str], by: str) -> DataFrame:
    """Rates by ``by``: long enough with a key word; long enough with sources.

    ``answers``: (answer, n_sources, by).
    """
    n = F.size(F.split(text.trim("answer"), r"\s+"))
    low = F.lower("answer")
    key = F.lit(False)
    for k in keywords:
        key = key | F.contains(low, F.lit(k))
    rated = answers.select(by, ((n > 50) & key).cast("int").alias("good"), ((n > 20) & (F.col("n_sources") > 0)).cast("int").alias("sourced"))
    return rated.groupBy(by).agg(F.count("*").alias("n"), F.avg("good").alias("quality_rate"), F.avg("sourced").alias("sourced_rate"))


def labels_of(docs: DataFrame) -> DataFrame:
    """(concept_id, label): canonical name and aliases of each document, one per row."""
    every = F.concat(F.array("name"), "aliases")
    return docs.select("concept_id", F.explode(every).alias("raw")).select("concept_id", text.canonical_name(F.col("raw")).alias("label"))
