"""URL filters by association rules.

FP-growth by conditional bases mines combinations of URL tokens (host labels, path segments, query keys, scheme) of
labelled pages: one base per token, each searched in its own task, over whole token sets and without a bound on length.
Rules "these tokens => low quality" that pass a support and a confidence bound, and are not implied by a shorter rule, are
kept. Pages meet rules through an inverted index token -> rules: a rule fits when all its tokens were met. Given rules
(host, path) go first: they meet the host's suffixes by an equi-join, and the longest that fits decides.

Both matches run over distinct URLs, so a URL that many pages share is judged once.

Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens; host letters A-Z are lower-cased;
pages without a label are not mined; with no usable rule everything that no given rule names is allowed; equal rows get
equal verdicts; equal-length rules that fit one URL are decided by their text; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut_lineage

MIN_SUPPORT = 0.001
MIN_PAGES = 10
MIN_CONFIDENCE = 0.5
BROADCAST_RULES = 200_000
BAD = "label=bad"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens. Host labels, and suffixes of two labels, then path segments, the extension, query keys, scheme."""
    raw = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    pair = F.when(F.size(labels) >= 2, F.concat(F.lit("site="), F.get(labels, F.size(labels) - 2), F.lit("."), F.get(labels, F.size(labels) - 1)))
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    keys = F.filter(F.split(F.regexp_extract(raw, r"(?s)://[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    made = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.array(pair, F.nullif(F.concat(F.lit("scheme="), F.regexp_extract(raw, r"(?s)^(.*?)://", 1)), F.lit("scheme=")),
                F.nullif(F.concat(F.lit("type="), F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)), F.lit("type="))),
        F.transform(segments, lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("query="), F.split(x, "=")[0])),
    )
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def _conditional(least: int, min_confidence: float):
    """Searches one token's conditional base depth first: sets of tokens that hold it and otherwise more frequent ones.

    A set is dropped only where a smaller set blocks whatever it and its extensions would block: if a token takes no good
    page from the rest of the set, the rest is as confident without it, and so for every extension. Subsets come first.
    """
    import numpy as np
    import pyarrow as pa

    def search(table: pa.Table) -> pa.Table:
        last, before = table["last"][0].as_py(), table["before"].combine_chunks()
        bad, good = table["bad"].to_numpy(), table["good"].to_numpy()
        minus, token = before.flatten().flatten()
        coded = token.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        ranks = np.zeros(len(names), np.int64)
        ranks[codes] = minus.to_numpy(zero_copy_only=False)
        order = sorted(range(len(names)), key=lambda i: (ranks[i], names[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = [names[i] for i in order]
        rows = np.repeat(np.arange(len(before)), before.value_lengths().to_numpy(zero_copy_only=False))
        found: list[tuple[list[str], int, int]] = []
        known: dict[frozenset[int], int] = {}

        def visit(held: frozenset[int], n_bad: int, n_good: int, at: np.ndarray, of: np.ndarray) -> None:
            if n_bad / (n_bad + n_good) >= min_confidence:
                found.append(([last["token"], *(tokens[i] for i in held)], n_bad, n_bad + n_good))
                return
            known[held] = n_good
            bads = np.bincount(of, bad[at], len(tokens))
            goods = np.bincount(of, good[at], len(tokens))
            for x in np.flatnonzero(bads >= least).tolist():
                longer, g = held | {x}, int(goods[x])
                if all(known.get(longer - {y}, -1) > g for y in longer):
                    inside = np.zeros(len(bad), bool)
                    inside[at[of == x]] = True
                    keep = inside[at] & (of < x)
                    visit(longer, int(bads[x]), g, at[keep], of[keep])

        if bad.sum() >= least:
            visit(frozenset(), int(bad.sum()), int(good.sum()), rows, place[codes])
        return pa.table({"tokens": pa.array([x[0] for x in found], pa.list_(pa.string())), "n_bad": pa.array([x[1] for x in found], pa.int64()), "n": pa.array([x[2] for x in found], pa.int64())})

    return search


def mine(pages: DataFrame, labels: DataFrame, label: str = "quality", min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, support, confidence) of rules that end in a low-quality label; labels' ``doc_id`` is a page's ``page_id``.

    Rules of any length over whole token sets: every rule that no shorter one implies is found, with its exact counts.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("page_id"), F.col(label).cast("int").alias("_label"))
    rows = pages.where("url is not null").select("page_id", tokens_of(F.col("url")).alias("tokens")).join(known, "page_id").select(
        F.monotonically_increasing_id().alias("_row"), "tokens", F.when(F.col("_label") == 0, 1).otherwise(0).cast("long").alias("bad"))
    rows = cut_lineage(rows)
    n = rows.count()
    schema = "rule_id long, tokens array<string>, support double, confidence double"
    if n < min_pages:
        return pages.sparkSession.createDataFrame([], schema)
    least = max(math.ceil(min_support * n), min_pages)
    # Tokens on too few bad pages can be in no rule. At most tokens per page / support rows: bounded.
    counts = rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg((-F.count(F.lit(1))).alias("n"), F.sum("bad").alias("_bad")).where(F.col("_bad") >= least)
    frequent = rows.select("_row", "bad", F.explode("tokens").alias("token")).join(F.broadcast(counts.drop("_bad")), "token")
    lists = frequent.groupBy("_row", "bad").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("items"))
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    baskets = lists.groupBy("items").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    # A token's conditional base: what comes before it, the most frequent first. Equal ones are summed before the shuffle.
    ends = F.transform("items", lambda x, i: F.struct(x.alias("last"), F.slice("items", F.lit(1), i).alias("before")))
    bases = baskets.select(F.inline(ends), "bad", "good").groupBy("last", "before").agg(*sums)
    found = bases.groupBy("last").applyInArrow(_conditional(least, min_confidence), "tokens array<string>, n_bad long, n long")
    found = found.select(F.array_sort("tokens").alias("tokens"), (F.col("n_bad") / F.lit(n)).alias("support"), (F.col("n_bad") / F.col("n")).alias("confidence"))
    found = cut_lineage(found.withColumn("rule_id", F.xxhash64("tokens")))
    return found.join(_implied(found), "rule_id", "left_anti").select("rule_id", "tokens", "support", "confidence")


def _index(rules: DataFrame) -> DataFrame:
    """(token, rule_id, size): the inverted index."""
    return rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("size"))


def _met(sets: DataFrame, key: str, index: DataFrame, small: bool) -> DataFrame:
    """(key, rule_id) where every token of the rule is in the row's ``tokens``."""
    asked = sets.select(key, F.explode("tokens").alias("token"))
    joined = asked.join(F.broadcast(index) if small else index, "token")
    return joined.groupBy(key, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n = size").select(key, "rule_id")


def _implied(rules: DataFrame) -> DataFrame:
    """Rules whose tokens include those of a shorter rule: whatever they block is blocked already."""
    asked = rules.select(F.col("rule_id").alias("longer"), "tokens")
    return _met(asked, "longer", _index(rules), False).where("longer != rule_id").select(F.col("longer").alias("rule_id")).distinct()


def given_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(_url, rule, rule_verdict) of URLs that a given (host, path, verdict) fits; the longest wins."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.where("host != ''").select("_url", "path", F.explode(suffixes).alias("rule_host"))
    fits = asked.join(table, "rule_host").where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), "rule_verdict"), F.struct(F.length(rule), rule))
    return fits.groupBy("_url").agg(best.alias("b")).select("_url", "b.rule", "b.rule_verdict")


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) per page row; ``mined``: number of mined rules that fit."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"))
    urls = rows.select("_url").distinct()
    urls = urls.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    small = mined.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = _met(urls.select("_url", tokens_of(F.col("_url")).alias("tokens")), "_url", _index(mined), small).groupBy("_url").agg(F.count(F.lit(1)).alias("mined"))
    marked = urls.join(given_rule(urls, rules), "_url", "left").join(hits, "_url", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("mined") > 0, "block").otherwise("allow"))
    marked = marked.select("_url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("mined", F.lit(0)).cast("long").alias("mined"))
    return rows.join(marked, "_url").drop("_url")
