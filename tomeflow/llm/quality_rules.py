"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Native only: every metric is a column expression over the row's own text, so a run is one scan without a shuffle.

Defined cases: a null text has no words, symbols or lines, so it fails the length rules; all ratios over nothing are 0;
equal rows are judged alike; ``text`` is the only input, other columns pass through unless a metric has their name.
Repeated three-word windows are matched by 64-bit hashes within one text: two different windows of a text of n words
meet by chance with odds below n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!"

# Frequent words of the four languages of the corpus, lower case. A parameter of `metrics`.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "at", "by", "an", "a",
    "der", "die", "und", "das", "den", "ist", "von", "mit", "zu", "für", "auf", "im", "dem", "nicht", "sich", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "dans", "est", "pour", "aux",
    "el", "los", "las", "del", "y", "por", "para", "con", "se", "su", "una", "al",
]


@dataclass(frozen=True)
class Rule:
    """Rows whose ``metric`` is outside [least, most] fail the rule."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None

    def fails(self) -> Column:
        bad = F.lit(False)
        if self.least is not None:
            bad = bad | (F.col(self.metric) < self.least)
        if self.most is not None:
            bad = bad | (F.col(self.metric) > self.most)
        return bad


# Ratios are per word, line or character. The limits are the operator's production parameters.
RULES = [
    Rule("too_short", "n_words", least=50),
    Rule("odd_word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("shouting", "shout_ratio", most=0.1),
    Rule("capitals", "capital_ratio", most=0.5),
    Rule("few_stop_words", "stop_word_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("repeated_words", "repeat_word_ratio", most=0.5),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more: windows sorted by hash, equal neighbours
    marked, the marked positions sorted and the lengths of their union summed. Linear but for the sorts."""

    def union_length(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(pairs, lambda p: F.filter(F.transform(p, lambda x, k: F.when(
            (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        return F.aggregate(F.sort_array(same), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, x: F.struct(
            x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")))["n"]

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        # Most texts repeat no window; only those that do are sorted.
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(union_length(h)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(of(words))


def metrics(df: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """All columns of ``df`` but clashing ones, with the metrics that rules may name."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "mean_word_chars",
             "symbol_ratio", "shout_ratio", "capital_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio"]
    kept = [c for c in df.columns if c not in names]
    parts = df.select(*kept, raw.alias("_raw"), F.filter(F.split(raw, GAP), lambda w: w != "").alias("_words"),
                      F.filter(F.split(raw, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("_lines"))
    counted = parts.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_raw", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_raw") - F.length(F.translate("_raw", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_raw") - F.length(F.translate("_raw", SHOUTS, ""))).cast("long").alias("_shouts"),
        F.regexp_count("_raw", F.lit(r"\p{Lu}")).cast("long").alias("_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.regexp_count(F.lower("_raw"), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(stop_words) + r")(?![^\x20\x09-\x0D])")).cast("long").alias("n_stop_words"),
    )
    return counted.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("_shouts"), F.col("n_words")).alias("shout_ratio"),
        _ratio(F.col("_capitals"), F.col("word_chars")).alias("capital_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def judge(df: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Rows with their metrics, ``failed`` (names of failed rules in table order) and ``kept``."""
    out = metrics(df, text)
    failed = F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return out.drop("failed", "kept").withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
