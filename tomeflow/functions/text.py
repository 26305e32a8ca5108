"""Token and name expressions. Every function takes Columns and gives a Column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab


# Blanks of every script (Unicode class Zs). SQL's trim takes all of these, Spark's only the first.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim(text: Column | str) -> Column:
    """``text`` without the blanks at its ends."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))


def round_half_up(x: Column, places: int) -> Column:
    """``x`` times a power of ten, rounded to a whole number with halves away from zero, and back: as SQL rounds, where
    Spark rounds the decimal digits of ``x``."""
    return F.round(x * 10.0**places) / 10.0**places


def words(text: Column) -> Column:
    """Lower-case words of ``text`` in order: everything but a-z, 0-9 becomes a break."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))
    return F.split(clean, " ")


def plural_stem(word: Column) -> Column:
    """Fold a plain English plural; words of up to three letters are left alone."""
    drop = lambda n: F.length(word) - F.lit(n)
    es = F.lit(False)
    for suffix in vocab.PLURAL_ES_SUFFIXES:
        es = es | word.endswith(suffix)
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(word.substr(F.lit(1), drop(3)), F.lit("y")))
        .when(es, word.substr(F.lit(1), drop(2)))
        .when(word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), drop(1)))
        .otherwise(word)
    )


def is_content(word: Column, stop_words: list[str]) -> Column:
    return (F.length(word) > 1) & ~word.isin(stop_words)


def content_tokens(text: Column) -> Column:
    """Ordered, stemmed search tokens of a short text."""
    kept = F.filter(words(text), lambda w: is_content(w, vocab.SEARCH_STOP_WORDS))
    return F.transform(kept, plural_stem)


def grounding_tokens(text: Column) -> Column:
    """Ordered content words for source checks, not stemmed."""
    return F.filter(words(text), lambda w: is_content(w, vocab.GROUNDING_STOP_WORDS))


def lookup_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: is_content(w, vocab.LOOKUP_STOP_WORDS))


def unstemmed_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: is_content(w, vocab.SEARCH_STOP_WORDS))


def set_key(tokens: Column) -> Column:
    """Order-free key of a token list."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def has_content(text: Column) -> Column:
    return F.exists(words(text), lambda w: is_content(w, vocab.SEARCH_STOP_WORDS))


def flat(text: Column) -> Column:
    """Lower-case text with every character outside a-z, 0-9 and blanks turned into a blank."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form. Spark has no built-in for it."""
    for s in batches:
        yield s.str.normalize("NFKC")


# The parts of a raw heading that are not part of its name.
SECTION_NUMBER = r"^\d+(\.\d+)*\s*"
CONTINUED_SUFFIX = r"(?i)\s*\((cont(inue)?d?\.?|contd\.?)\)\s*$"
ROMAN_PREFIX = r"(?i)^(I{1,3}|IV|VI{0,3}|IX|X)\.\s+"
LEADING_LABEL = r"(?i)^(unit|chapter)\s+\d+\s+"
NUMBER_TOKEN = r"\b\d+(\.\d+)*\b"
TRAILING_PAGE = r"\s+\d+$"


# A single letter, its blank, and a word after it; tokens have one blank between them.
SPLIT_LETTER = r"(^| )(\p{L}) (?=\p{L}{2,}(?![^ ]))"
# :data:`NUMBER_TOKEN`, which looks for the end of a word only where a digit stands.
NUMBER_FAST = r"(?=\d)" + NUMBER_TOKEN


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once. Expressions that name a nested value often would repeat it each time."""
    return F.transform(F.array(value), body)[0]


def _merge_split_letters(tokens: Column) -> Column:
    """Join a single letter with the word after it (``e lectric`` -> ``electric``)."""
    return F.split(F.regexp_replace(F.array_join(tokens, " "), SPLIT_LETTER, "$1$2"), " ")


def _drop_repeats(tokens: Column, key=lambda c: c) -> Column:
    """Keep the first of a run of equal neighbours."""
    return let(tokens, lambda ts: F.filter(ts, lambda t, i: (i == 0) | (key(F.get(ts, i - 1)) != key(t))))


def _blank_split(text: Column) -> Column:
    return F.filter(F.split(trim(text), r"\s+"), lambda w: w != "")


def canonical_name(raw: Column) -> Column:
    """Canonical lower-case concept name of a raw heading."""
    t = trim(raw)
    for pattern in (SECTION_NUMBER, CONTINUED_SUFFIX, ROMAN_PREFIX, LEADING_LABEL):
        t = F.regexp_replace(t, pattern, "")
    t = let(t, lambda t: F.when(t.rlike("[’‘“”]"), F.translate(t, "’‘“”", "''\"\"")).otherwise(t))
    t = F.regexp_replace(t, r"(?i)\s+'\s*s\b", "'s")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\-']", " ")
    t = F.lower(F.regexp_replace(t, NUMBER_FAST, " "))
    kept = F.filter(_merge_split_letters(_blank_split(t)), lambda w: ~w.isin(vocab.NAME_FILLER_WORDS))
    t = F.rtrim(F.regexp_replace(F.array_join(kept, " "), TRAILING_PAGE, ""), F.lit(".:;,"))
    # A name whose words with letters a-z are all the same is that word; the second other word decides.
    word = "[a-z]"
    first = lambda joined: F.regexp_extract(joined, r"(^| )([^ ]*[a-z][^ ]*)", 2)
    single = lambda parts, joined, one: F.when((one != "") & ~F.exists(parts, lambda w: (w != one) & w.rlike(word)), one).otherwise(joined)
    return let(_drop_repeats(_blank_split(t)), lambda parts: let(F.array_join(parts, " "), lambda joined: let(first(joined), lambda one: single(parts, joined, one))))


def display_name(raw: Column) -> Column:
    """Readable concept name: numbers and labels gone, split words joined, repeats dropped."""
    t = trim(F.regexp_replace(raw, SECTION_NUMBER, ""))
    t = trim(F.regexp_replace(t, CONTINUED_SUFFIX, ""))
    for pattern, by in ((LEADING_LABEL, ""), (NUMBER_FAST, " "), (TRAILING_PAGE, "")):
        t = F.regexp_replace(t, pattern, by)
    parts = _drop_repeats(_merge_split_letters(_blank_split(t)), F.lower)
    shouted = lambda t: (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 4)
    return let(F.trim(F.array_join(parts, " "), F.lit(" .:;,-")), lambda t: F.when(shouted(t), F.initcap(t)).otherwise(t))


def sentence_like(raw: Column, canonical: Column) -> Column:
    """True for bullets and prose that must not become concept names."""
    w = F.split(canonical, " ")
    n = F.when(canonical == "", 0).otherwise(F.size(w))
    t = trim(raw)
    return (n >= 4) & (
        (n > 10)
        | t.rlike(r"^[•·\-*]")
        | w[0].isin(vocab.INSTRUCTION_WORDS + vocab.SENTENCE_OPENERS)
        | ((n >= 8) & F.exists(w, lambda x: x.isin(vocab.SENTENCE_VERBS)))
        | (t.rlike(r"[.;:]$") & (n >= 6))
    )


def accepts_name(raw: Column, canonical: Column, chapter: Column | None = None) -> Column:
    """True when a heading may name a concept."""
    alnum = F.length(F.regexp_replace(canonical, r"[^\p{L}\p{N}\s]", ""))
    ok = (
        (canonical != "")
        & ~canonical.isin(vocab.NAME_BLOCKLIST)
        & ~sentence_like(raw, canonical)
        & canonical.rlike("[a-z]{2,}")
        & (alnum / F.length(canonical) >= 0.7)
    )
    if chapter is None:
        return ok
    w = F.split(canonical, " ")
    t = trim(raw)
    shout = (F.size(w) >= 2) & (F.upper(t) == t) & (F.lower(t) != t)
    shout = shout & ~F.exists(w, lambda x: x.isin(vocab.NAME_BLOCKLIST))
    return ok & ((chapter != "Unknown Chapter") | shout)


def checksum(*parts: Column) -> Column:
    """Sixteen hex digits over the parts joined with a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
