"""Quality rules, token counts, classifier, URL rules, WARC, language ID, mixing and the pipeline, against brute force,
round trips and held-out accuracy, with the edge cases they define."""

import base64
import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tomeflow.llm import jaccard_join, language_ppm, mixing, quality_fm, quality_rules, queries, token_counts, url_rules, warc

from .test_pairs_and_passages import docs, sentence

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules ---------------------------------------------------------------------------------------------------
def brute_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))


def test_rule_metrics_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "É# *\u00a0%&|<> é", "l\nl\n\nl\n \n", "a\x0bb\x0cc\rd"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))).replace("c ", "c\n") for _ in range(60)]
    got = quality_rules.metrics(docs(spark, list(enumerate(texts))).withColumn("n_words", F.lit("clash"))).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got] == [brute_base(t) for t in texts]


def test_rules_judge_and_name_what_failed(spark):
    plain = "the cat sat on the mat and saw that it was a good day to be in the sun " * 4
    rows = [(1, " ".join(f"{w}{chr(97 + i // 9)}" if i % 3 else w for i, w in enumerate(plain.split()))), (2, "the # " * 60), (3, "short"), (4, None), (5, "LOUD!! " * 60), (6, "xyzzy%d " * 60)]
    got = {r["doc_id"]: (r["kept"], r["failed"]) for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert got[1] == (True, []) and "symbols" in got[2][1] and "too_short" in got[3][1] and not got[4][0]
    assert {"shouting", "capitals"} <= set(got[5][1]) and "few_stop_words" in got[6][1]
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(100_000)) + " w0 w1 w2"
    r = quality_rules.metrics(docs(spark, [(1, text)])).first()
    assert (r["n_words"], r["n_repeat_words"]) == (100_003, 6)


# --- token counts ----------------------------------------------------------------------------------------------------
def test_token_lengths_and_sums(spark):
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>", "é ü 漢字 \U0001f600", "a" * 5000] + [sentence(rng, rng.randrange(60)) for _ in range(60)]
    lengths = [len(enc.encode_ordinary(t or "")) for t in texts]
    made = token_counts.token_lengths(docs(spark, list(enumerate(texts))))
    assert [r["n_tokens"] for r in made.orderBy("doc_id").collect()] == lengths
    sums = token_counts.suffix_sums(token_counts.histogram(made))
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n) and r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["tokens_to"] == sum(x for x in lengths if x <= n)
    asked = dict(token_counts.truncated_totals(sums, [0, 7, 64, 10**6]).collect())
    assert asked == {c: sum(min(x, c) for x in lengths) for c in (0, 7, 64, 10**6)}
    for share, n in token_counts.quantiles(sums, [0.5, 0.9, 1.0]).collect():
        assert n == sorted(lengths)[math.ceil(share * len(lengths)) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(docs(spark, [])))).count() == 0


# --- quality classifier ----------------------------------------------------------------------------------------------
def test_pairwise_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=quality_fm.N_FEATURES), "v": rng.normal(size=(quality_fm.N_FEATURES, 3))}
    number, value = np.array([1, 5, 9, 2, 4]), rng.normal(size=5)
    got = quality_fm.raw_scores(model, np.array([0, 3, 5]), number, value)
    for k, (a, b) in enumerate([(0, 3), (3, 5)]):
        want = 0.3 + sum(model["w"][number[i]] * value[i] for i in range(a, b))
        want += sum(model["v"][number[i]] @ model["v"][number[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[k] == pytest.approx(want)


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op6_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert len(got) > 40 and sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_classifier_edges(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "x " * 50_000), (3, "x"), (None, "y")]).withColumn("score", F.lit("clash"))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_fm.score(rows, quality_fm.train(rows, empty)).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (2, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_fm.score(rows, quality_fm.train(rows, one)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    model = quality_fm.train(rows, both)
    scores = quality_fm.score(rows, model).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    kept = quality_fm.keep_good(rows, model, 0.0)
    assert kept.columns == rows.columns and kept.count() == 5 and quality_fm.keep_good(rows.limit(0), model, 0.0).count() == 0


# --- URL rules -------------------------------------------------------------------------------------------------------
def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_given_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/en", "http://example.net/en/", "https://x.net", "https://x.net/", "ftp://net/a",
            "http://badexample.com/de/1", "http://example.com/de/1", "http://a.org/fr/", "http://a.org/FR/", "http://org/fr/x://y", "://", "x://h?a/b", "http://ex\nample.net/en/", "http://Ünet/", "http://a.b.net#/z"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[3:5])], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, support double, confidence double")
    got = url_rules.judge(pages, none, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [brute_url(u) for u in urls + urls[3:5]]
    assert url_rules.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def test_mined_rules(spark):
    rng = random.Random(4)
    rows, labels, tokens = [], [], {}
    for i in range(400):
        site, section = rng.choice(["a", "b", "c"]), rng.choice(["x", "y"])
        rows.append((i, f"http://{site}.test/{section}/{i}", "h"))
        bad = (site == "a" and section == "x") or rng.random() < 0.1
        tokens[i] = ({f"host={site}", "host=test", f"site={site}.test", "scheme=http", f"path={section}", f"path={i}"}, bad)
        labels.append((i, 0 if bad else 1))
    pages = spark.createDataFrame(rows + [(900, None, "h")], "page_id long, url string, html string")
    made = spark.createDataFrame(labels + [(1, None), (900, 0)], "doc_id long, quality int")
    mined = url_rules.mine(pages, made, min_confidence=0.9)
    for r in mined.collect():
        fits = [bad for t, bad in tokens.values() if set(r["tokens"]) <= t]
        assert r["confidence"] == pytest.approx(sum(fits) / len(fits)) and r["confidence"] >= 0.9 and sum(fits) >= 10
    rules = [set(r["tokens"]) for r in mined.collect()]
    assert rules and not any(a < b for a in rules for b in rules)
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, mined, [("nowhere", "/", "block")]).collect()}
    assert all((got[i] == "block") == any(r <= t for r in rules) for i, (t, _) in tokens.items()) and got[900] == "allow"
    assert sum(v == "block" for v in got.values()) > 40
    assert url_rules.mine(pages, made.limit(0)).count() == 0


def test_rules_of_rare_tokens_on_long_urls(spark):
    """The telling tokens come after 30 more frequent ones, and a rule needs two of them or three."""
    rng = random.Random(8)
    rows, labels, tokens = [], [], {}
    for i in range(600):
        keys = [f"k{j}" for j in range(30) if j > 2 or i % 20 != j] + [x for x in ("r1", "r2", "r3", "r4") if rng.random() < 0.4]
        bad = {"r1", "r2"} <= set(keys) or {"k2", "r3", "r4"} <= set(keys) and rng.random() < 0.95 or rng.random() < 0.1
        rows.append((i, "http://a.test/x?" + "&".join(f"{k}=1" for k in keys)))
        tokens[i] = ({"host=a", "host=test", "site=a.test", "scheme=http", "path=x"} | {f"query={k}" for k in keys}, bad)
        labels.append((i, 0 if bad else 1))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    mined = url_rules.mine(pages, spark.createDataFrame(labels, "doc_id long, quality int"), min_support=0.1, min_confidence=0.9)
    rules = {frozenset(r["tokens"]): r for r in mined.collect()}
    assert frozenset({"query=r1", "query=r2"}) in rules and not any(a < b for a in rules for b in rules)
    for t, r in rules.items():
        fits = [bad for held, bad in tokens.values() if t <= held]
        assert sum(fits) >= 60 and r["confidence"] == pytest.approx(sum(fits) / len(fits)) and r["support"] == pytest.approx(sum(fits) / 600)
    every = sorted(set().union(*(t for t, _ in tokens.values())))
    for size in (1, 2, 3):
        for t in map(frozenset, itertools.combinations([t for t in every if t[:7] != "query=k" or t in ("query=k0", "query=k2", "query=k9")], size)):
            fits = [bad for held, bad in tokens.values() if t <= held]
            if sum(fits) >= 60 and sum(fits) / len(fits) >= 0.9:
                assert any(r <= t for r in rules)
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, mined, [("nowhere", "/", "block")]).collect()}
    assert all((got[i] == "block") == any(r <= t for r in rules) for i, (t, _) in tokens.items())


# --- WARC ------------------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark):
    rng = random.Random(6)
    html = [None, "", "é" * 10, "same", "same", "same", "x" * 300_000] + ["".join(rng.choice(string.printable) for _ in range(rng.randrange(2000))) for _ in range(80)]
    rows = [(i * 7 % 101, f"http://h/{i}\r\n x" if i % 9 else None, h) for i, h in enumerate(html)] + [(None, "u", "same"), (21, "again", "same"), (3, "u", "A\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    folder, manifest = warc.write(pages, archive_bytes=40_000)
    got = warc.read(spark, folder, manifest, with_payload=True).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first[h or ""]
        want.append((str(p), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == f else "revisit", None if p == f else f, raw if p == f else None))
    key = lambda r: tuple(map(str, r))
    assert sorted([(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=key) == sorted(want, key=key)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_records_are_frames_of_their_own_and_lost_tasks_leave_nothing(spark):
    import zstandard as zstd

    records = [warc.record(i, f"http://a/{i}", b"<html>" + b"text %d " % i * 20, None) for i in range(40)]
    content, offsets = warc.archive(records)
    magic, size = int.from_bytes(content[:4], "little"), int.from_bytes(content[4:8], "little")
    assert magic == 0x184D2A5D and offsets[0] == 8 + size
    d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content[8:8 + size]))
    assert [d.decompress(content[a:b]) for a, b in zip(offsets, [*offsets[1:], len(content)])] == records
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    folder, manifest = warc.write(pages)
    warc._store(folder, "left-by-a-lost-task.warc.zst", content)
    assert warc.read(spark, folder, manifest).count() == 1
    folder, manifest = warc.write(pages.limit(0))
    assert warc.read(spark, folder, manifest).count() == 0


# --- language ID -----------------------------------------------------------------------------------------------------
def brute_bits(texts, text, order):
    """Code length of ``text`` by escape method C, context by context."""
    counts = {}
    for t in texts:
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    c = counts.setdefault(t[i - k:i], {})
                    c[t[i]] = c.get(t[i], 0) + 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -2, -1):
            if k < 0:
                bits += 8
                break
            c = counts.get(text[i - k:i])
            if c is None:
                continue
            if text[i] in c:
                bits -= math.log2(c[text[i]] / (sum(c.values()) + len(c)))
                break
            bits -= math.log2(len(c) / (sum(c.values()) + len(c)))
    return bits


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_code_lengths_equal_brute_force(spark, order):
    rows = [(1, "the cat and the hat", "en"), (2, "a then", "en"), (3, "die katze über der hut", "de"), (4, "", "de"), (5, None, "de"), (6, "zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scorer = language_ppm.Scorer(language_ppm.train(df, order=order), order)
    assert scorer.names == ["de", "en"]
    texts = ["the cat", "über", "", "qqq", "x", "hut hat"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = scorer.code_lengths(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, r in enumerate(raw):
        for k, name in enumerate(scorer.names):
            assert got[i, k] == pytest.approx(brute_bits([t.encode() for _, t, g in rows if g == name and t], r, order), rel=1e-5, abs=1e-4)


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)


def test_language_edges(spark):
    rows = [(1, None), (2, ""), (3, "123 --- !!"), (4, "漢字"), (5, "the " * 100_000), (5, "the"), (None, "le")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = language_ppm.predict(df, language_ppm.train(df)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)} and len(got) == 7
    taught = spark.createDataFrame([(1, "the hat", "en"), (2, "le chapeau", "fr")], "doc_id long, text string, lang string")
    got = language_ppm.predict(df, language_ppm.train(language_ppm.sample(taught))).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] != 4] == [(1, "und"), (2, "und"), (3, "und"), (5, "en"), (5, "en"), (None, "fr")]
    assert all(0 <= r["score"] <= 1 for r in got)


# --- mixing ----------------------------------------------------------------------------------------------------------
def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        got = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if got[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **got}
        capped |= over


@pytest.mark.parametrize("block_rows", [50_000, 7])
def test_mixture_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.choice([0, 3, 20, 80])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(1000, None, "z"), (1001, "", "zz"), (1002, "w " * 30_000, "b")]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    out = mixing.mix(df, mixing.n_words(F.col("text")), F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(1.0), wide=True)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    got = out.collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = {s: sum(size[i] for i, _, x in rows if x == s) for s in {x for *_, x in rows}}
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    draw = {i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / (0.2 if i % 5 == 0 else 1.0) for i in size}
    taken = {}
    for s, target in want.items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        left, before, open_ = target - epochs * sizes[s], 0, True
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (draw[i], i)):
            open_ &= before + size[i] / 2 <= left + 1e-9
            before += size[i]
            taken[i] = size[i] * (epochs + open_)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == taken[r["doc_id"]] <= 2 * r["size"]
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, mixing.n_words(F.col("text")), F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(1.0), wide=True).collect()))


def test_mixture_edges(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "d", "x"), (2, None, "x")]
    got = mixing.mix(docs(spark, rows), mixing.n_words(F.col("text")), F.lit(None).cast("double")).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) >= 7 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs(spark, []), mixing.n_words(F.col("text")), F.lit(1.0)).count() == 0
    assert mixing.mix(docs(spark, [(1, None)]), mixing.n_words(F.col("text")), F.lit(1.0)).first()["taken"] == 0


@pytest.mark.parametrize("wide", [False, True])
def test_mixture_parts_rows_without_ids_and_rows_that_are_equal(spark, monkeypatch, wide):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 11)
    rng = random.Random(3)
    # Sources without ids, one of different texts and one of equal rows, and one whose rows share an id.
    rows = [(None, sentence(rng, 10), "n") for _ in range(40)] + [(None, "one two three", "o") for _ in range(70)] + [(7, sentence(rng, 4), "p") for _ in range(90)]
    rows += [(i, sentence(rng, 9), "q") for i in range(100, 180)]
    df = docs(spark, rows).withColumn("_size", F.lit("x")).withColumn("_cut", F.lit(1)).withColumn("a.b", F.lit(2))
    got = mixing.mix(df, mixing.n_words(F.col("text")), F.lit(1.0), wide=wide).collect()
    assert len(got) == len(rows) and (not wide or {"_size", "_cut", "a.b"} <= set(got[0].__fields__))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "nopq"}
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2 + 1e-6


# --- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages_decide_as_their_operators(spark):
    from .test_pairs_and_passages import brute_components, brute_hits, brute_lines

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    made = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = made.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(docs(spark, [(None, "a b", None), (100_500, None, None), (100_501, "", "src0"), (100_502, items[0][1], "src0")]))
    made = made.unionByName(extra)
    columns, seen = made.columns, [made]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
        if name != "mixing sources":
            assert seen[-1].columns == columns
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in s.select("doc_id", "text", "source").collect()] for s in seen]
    key = lambda x: sorted(x, key=str)
    assert set(map(str, rows[1])) <= set(map(str, rows[0])) and len(rows[1]) < len(rows[0])
    assert key([(i, t) for i, t, _ in rows[2]]) == key([(i, t) for i, t, *_ in brute_lines(rows[1], 0.1, 5)])
    low = [c for _, _, c in brute_components(rows[2])]
    of = {i: c for i, _, c in brute_components(rows[2])}
    assert low and key([r for r in rows[2] if r[0] is None or of[str(r[0])] == str(r[0])]) == key(rows[3])
    assert key([r for r in rows[3] if brute_hits(r[1], items)[1] == 0]) == key(rows[4])
    last = seen[5].collect()
    assert last and all(0 < r["taken"] <= 2 * r["size"] for r in last)


def test_one_per_component_keeps_other_columns(spark):
    kept = jaccard_join.one_per_component(docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "q")]).withColumn("component_id", F.lit(9)))
    assert sorted((r["doc_id"], r["component_id"]) for r in kept.collect()) == [(1, 9), (3, 9)]
