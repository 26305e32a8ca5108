"""The registered queries of the training-data operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_ppm, line_dedup, mixing, piece_codec, prefix_trie, quality_fm, quality_rules, spelling_groups, token_counts, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The rules of the URL filter's query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
QUALITY_THRESHOLD = 0.3


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """One id in five, by the CRC-32 of its text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_STOPS_SQL = ", ".join("'" + w + "'" for w in quality_rules.STOP_WORDS)
OP1_SQL = rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {_WORDS_SQL} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(t, '[^!]', '', 'g')) AS shouts, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS capitals,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS_SQL}))) AS n_stop_words
  FROM base LEFT JOIN covered USING (r)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR coalesce(word_chars / nullif(n_words, 0), 0) NOT BETWEEN 2 AND 15 OR coalesce(n_symbols / nullif(n_words, 0), 0) > 0.1
         OR coalesce(shouts / nullif(n_words, 0), 0) > 0.1 OR coalesce(capitals / nullif(word_chars, 0), 0) > 0.5
         OR coalesce(n_stop_words / nullif(n_words, 0), 0) < 0.02 OR coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.5
         OR coalesce(n_repeat_words / nullif(n_words, 0), 0) > 0.5 AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept
FROM j"""


@query(OP1_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule metrics and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM places JOIN windows USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
met AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN met USING (r)"""


@query(OP2_SQL)
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside verbatim windows of benchmark items."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'h' || source END AS site, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT r, site, unnest(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09\x0B-\x0D]')))) AS line FROM pages),
bad AS (
  SELECT site, line FROM (SELECT site, line, count(*) AS n FROM lines GROUP BY ALL) JOIN (SELECT site, count(*) AS pages FROM pages GROUP BY site) USING (site)
  WHERE n >= 5 AND n > 0.1 * pages),
sets AS (SELECT site, list(line) AS bad FROM bad GROUP BY site),
cleaned AS (
  SELECT doc_id, text, l, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09\x0B-\x0D]')) AS counted, coalesce(bad, []) AS bad
  FROM pages LEFT JOIN sets USING (site))
SELECT doc_id, CAST(coalesce(len(counted), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(counted, lambda x: list_contains(bad, x))), 0) AS BIGINT) AS n_dropped,
       CAST(coalesce(length(array_to_string(list_filter(l, lambda x: NOT list_contains(bad, x)), chr(10))), 0) AS BIGINT) AS n_chars_kept,
       md5(array_to_string(list_filter(l, lambda x: NOT list_contains(bad, x)), chr(10))) AS text_md5
FROM cleaned"""


@query(OP3_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines, as digests."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")
    return out.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exact encoded length with its suffix sums: the answer for every context limit."""
    return token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"))))


OP5_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r, r AS other FROM words UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, min(o.doc_id)) AS component_id
FROM words w LEFT JOIN sizes USING (r) JOIN reach ON reach.r = w.r JOIN words o ON o.r = reach.other GROUP BY w.r, w.doc_id, n"""


@query(OP5_SQL)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of shingle Jaccard 0.8 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    labels = table(spark, sf_dir, "labels")
    return quality_fm.train(table(spark, sf_dir, "documents"), labels.where(~held_out(F.col("doc_id"))))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_fm.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


@query()
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: given rules first, then mined association rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine(pages, table(spark, sf_dir, "labels"))
    return url_rules.judge(pages, mined, URL_RULES)


OP8_SQL = r"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM rows GROUP BY html),
hex AS (SELECT *, upper(h) AS x FROM rows JOIN firsts USING (html)),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789ABCDEF', x[i])]), '') AS b FROM hex)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(1, 6), lambda k: CAST(b[i * 5 + k] AS INTEGER) * CAST(2 ** (5 - k) AS INTEGER)))::INTEGER]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits"""


@query(OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, reads the archives back, and tells what they hold."""
    folder, manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the shortest code."""
    docs = table(spark, sf_dir, "documents")
    learned = language_ppm.sample(docs.where(~held_out(F.col("doc_id"))))
    model = language_ppm.train(learned)
    return language_ppm.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(coalesce(text, '')) AS n,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS sym, md5(coalesce(text, '')) AS tie FROM documents),
draws AS (
  SELECT doc_id, source, size, tie, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), tie)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / greatest(0.05::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (CAST(sym AS DOUBLE) / greatest(n, 1))) AS draw FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0)) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce(fixed.level * w, cap)) AS target FROM levels LEFT JOIN fixed ON true),
r AS (
  SELECT draws.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY draws.source ORDER BY draw, doc_id NULLS FIRST, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM draws JOIN targets ON draws.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0 > target - epochs * source_size THEN 0 ELSE 1 END) AS BIGINT) AS taken FROM r"""


@query(OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mixture to source weights takes of every document."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mixing.n_words(F.col("text")), mixing.quality_weight(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    coded = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _crc_step(byte: int) -> int:
    for _ in range(8):
        byte = 0xEDB88320 ^ byte >> 1 if byte & 1 else byte >> 1
    return byte


def crc_sql(text: str) -> str:
    """CRC-32 in DuckDB of a text of characters up to U+00FF, from the polynomial's table."""
    table = "([" + ", ".join(str(_crc_step(b)) for b in range(256)) + "]::BIGINT[])"
    units = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    data = f"flatten(list_transform({units}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, k, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
cut AS (SELECT DISTINCT s.word AS long, s.n AS long_n, v.word AS short, v.n AS short_n FROM shorter s JOIN vocabulary v ON v.word = s.s),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM cut UNION ALL SELECT short, short_n, long, long_n FROM cut),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
formed AS (SELECT word, near AS form, near_n AS form_n FROM near WHERE true QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1 AND near_n >= 5 * n),
up AS (SELECT word, form AS root, 1 AS step FROM formed UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN formed f ON f.word = up.root),
tops AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM vocabulary v LEFT JOIN best USING (word) LEFT JOIN formed USING (word) LEFT JOIN tops USING (word)"""


@query(OP12_SQL)
def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, its form and its root."""
    return spelling_groups.variants(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH turned AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
every AS (SELECT conv_id, conv_id - conv_id % 100 AS first, {crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turned)),
parts AS (
  SELECT e.conv_id, t.p, t.role, t.text FROM every e JOIN turned t ON t.conv_id = e.first AND t.p < e.h
  UNION ALL SELECT e.conv_id, t.p, t.role, t.text FROM every e JOIN turned t ON t.conv_id = e.conv_id AND t.p >= e.h),
whole AS (SELECT e.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY p) FILTER (p IS NOT NULL), []) AS turns FROM every e LEFT JOIN parts USING (conv_id) GROUP BY e.conv_id),
prefixes AS (
  SELECT conv_id, d AS depth, CAST(turns[1:d] AS VARCHAR) || d AS path, CAST(turns[1:d - 1] AS VARCHAR) || (d - 1) AS up, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars, d = len(turns) AS over
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256
  FROM prefixes GROUP BY path),
children AS (SELECT up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
below AS (
  SELECT a.path, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c ON c.path = n.path JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN nodes u ON u.path = n.up AND n.depth > 0"""


@query(OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))
