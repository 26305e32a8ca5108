"""Jaccard join, decontamination, line dedup and components against brute force, with the edge cases they define."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import components, decontaminate, jaccard_join, line_dedup
from tomeflow.llm import kernels as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(low.get(find(i)))) for i, r in enumerate(rows))


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Chains of edits, copies, a passage shared by many, tiny texts, texts mostly made of the passage."""
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 40)
    for k in range(30):
        base = sentence(rng, rng.choice([3, 5, 6, 9, 14, 30, 60, 150]))
        rows.append(base)
        for _ in range(rng.randrange(5)):
            base = near(rng, base, rng.randrange(4))
            rows.append(base)
    rows += [passage + " " + sentence(rng, rng.choice([1, 2, 3, 6, 12, 40])) for _ in range(60)]
    template = sentence(rng, 120)
    rows += [near(rng, template, rng.randrange(1, 5)) for _ in range(50)]
    rows += [template.upper(), "", None, "   \t\n", "One two", "one TWO", "a b c d e f", "a b c d e f", "x"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,cold,names,block", [(1, 4, 10**6, 7), (2, 32, 10**6, 1000), (3, 3, 0, 16), (4, 2, 10**6, 5)])
def test_components_equal_brute_force(spark, seed, cold, names, block):
    rows = corpus(seed)
    got = jaccard_join.jaccard_components(docs(spark, rows), cold=cold, block=block, most_names=names, broadcast_sets=10 if seed == 3 else 10**6)
    assert sorted((str(a), n, str(c)) for a, n, c in got.collect()) == brute_components(rows)


def test_components_of_repeated_and_missing_ids_and_of_nothing(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s"), (2, None), (2, "")]
    got = jaccard_join.jaccard_components(docs(spark, rows).withColumn("sid", F.lit(1)).withColumn("n", F.lit("x")))
    assert sorted((str(a), n, str(c)) for a, n, c in got.collect()) == brute_components(rows)
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0
    kept = jaccard_join.one_per_component(docs(spark, rows + [(9, "a b c d e f g")]))
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == ["(2, '')", "(2, None)", "(5, 'a b c d e f g')", "(None, 'q r s')"]


def test_one_row_of_each_class_stays(spark):
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join(["x", *base])
    other = " ".join(reversed(base))
    rows = [(0, "q r s t u v"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (None, one), (None, two), (None, one),
            (7, other), (None, other), (7, other), (8, one + " z z z"), (9, "lone words of one row only"), (None, None), (3, "")]
    frame = docs(spark, rows).withColumn("_gone", F.lit("kept")).withColumn("_set", F.lit(4))
    kept = jaccard_join.one_per_component(frame)
    assert kept.columns == frame.columns
    got = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert got == sorted(str(x) for x in [(0, "q r s t u v"), (1, "a b c d e f"), (8, one + " z z z"), (7, other), (9, "lone words of one row only"), (None, None), (3, "")])
    assert jaccard_join.one_per_component(docs(spark, [])).count() == 0


def test_one_very_long_text(spark):
    rng = random.Random(8)
    long = sentence(rng, 60_000, 50_000)
    rows = [(1, long), (2, near(rng, long, 500)), (3, near(rng, long, 30_000)), (4, "z" * 300_000)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_hits(text, items):
    words, hit, met = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[i:i + n]:
                    hit.update(range(p, p + n))
                    met.add(str(item))
    return len(words), len(hit), sorted(met)


def contaminated_rows():
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.choice([3, 9, 10, 11, 25]), 30)) for i in range(12)] + [(77, "Über Straße! x"), (78, None), (79, "..."), (80, None)]
    items.append((81, items[0][1]))
    rows = []
    for i in range(80):
        text = sentence(rng, rng.randrange(0, 60), 30)
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(w))
            text += " " + " ".join(w[a:a + rng.randrange(1, 20)]).upper() + ", " + sentence(rng, 4, 30)
        rows.append((i, text))
    return rows + [(90, None), (91, ""), (92, "--- über straße X y"), (92, "--- über straße X y"), (None, items[4][1])], items


@pytest.mark.parametrize("shard,block", [(1 << 20, 8 << 20), (50, 8 << 20), (200, 60)])
def test_hits_equal_brute_force(spark, shard, block):
    rows, items = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs(spark, rows).withColumn("items", F.lit(1)), bench, shard_words=shard, block_bytes=block).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    assert all(sum(b - a for a, b in r["spans"]) == r["n_hit"] for r in got)
    clean = decontaminate.clean(docs(spark, rows), bench, shard_words=shard, block_bytes=block)
    assert clean.columns == docs(spark, rows).columns
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted(t or "" for i, t in rows if brute_hits(t, items)[1] == 0)


def test_no_items_no_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs(spark, [(1, "a b")]), bench).collect()] == [(2, 0)]
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.clean(docs(spark, [(1, "a b")]), bench).count() == 1


def test_longest_matches_equal_brute_force(spark):
    rows, items = contaminated_rows()
    rows = rows[:30]
    got = decontaminate.longest_matches(docs(spark, rows).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), least=4).collect()
    want = set()
    for item, t in items:
        w = words_of(t)
        for i in range(len(w)):
            best, at = 0, []
            for d, text in rows:
                x = words_of(text)
                for p in range(len(x)):
                    n = 0
                    while i + n < len(w) and p + n < len(x) and w[i + n] == x[p + n]:
                        n += 1
                    if n > best:
                        best, at = n, []
                    if n == best and n:
                        at.append((d, p))
            if best >= min(4, len(w)):
                want |= {(str(item), i, best, d, p) for d, p in at}
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_order(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 4, 400)
    tokens[rng.integers(0, 400, 12)] = 0
    tokens[-1] = 0
    sa = decontaminate.SuffixArray(tokens, 20)

    def suffix(p):
        end = p + int(np.argmax(tokens[p:] == 0))
        return tuple(tokens[p:end])[:20]

    order = [suffix(p) for p in sa.order]
    assert order == sorted(order) and sorted(sa.order) == list(range(400))


# --- line dedup ------------------------------------------------------------------------------------------------------
def brute_lines(rows, ratio, least):
    counted = lambda x: x.strip("\t\n\x0b\x0c\r ") != ""
    pages, held = {}, {}
    for _, text, host in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x for x in (text or "").split("\n") if counted(x)}:
            held[host, line] = held.get((host, line), 0) + 1
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        bad = [counted(x) and held[host, x] >= least and held[host, x] > ratio * pages[host] for x in lines]
        out.append((i, "\n".join(x for x, b in zip(lines, bad) if not b), sum(map(counted, lines)), sum(bad)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_lines_equal_brute_force(spark, broadcast):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [rng.choice(["Menu", " Menu", "Legal notice", "", "  ", f"own {i}", f"half {i % 7}"]) for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(lines), host))
    rows += [(400, None, "a"), (401, None, None), (402, "", "zz"), (403, "Menu\nMenu\nMenu", "a"), (403, "Menu\nMenu\nMenu", "a"), (404, "x" * 200_000, "a")]
    got = line_dedup.dedup_lines(docs(spark, rows).withColumn("n_lines", F.lit(1)), "source", ratio=0.2, least_pages=3, broadcast_bytes=broadcast)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_lines(rows, 0.2, 3)
    assert line_dedup.dedup_lines(docs(spark, []), "source").count() == 0


# --- kernels ---------------------------------------------------------------------------------------------------------
def test_words_and_hashes_do_not_depend_on_chunks():
    import pyarrow as pa

    texts = ["ab CD", "", None, "cd", "éa x9", "   ", "ab"] * 3
    whole = {}
    for limit in (1, 5, 1 << 20):
        found = []
        for _, _, data, off in K.chunks(pa.array(texts), limit):
            starts, ends, woff = K.word_spans(data, off, K.NOT_SPACE)
            h = K.word_hashes(data, starts, ends)
            raw = data.tobytes()
            for a, b in zip(woff[:-1], woff[1:]):
                found.append([(raw[s:e].lower(), int(x)) for s, e, x in zip(starts[a:b], ends[a:b], h[a:b])])
        assert [[w for w, _ in f] for f in found] == [(t or "").encode().lower().split() for t in texts]
        for w, x in itertools.chain(*found):
            assert whole.setdefault(w, x) == x
    assert len(set(whole.values())) == len(whole)
    assert hashlib.sha256(str(sorted(whole.items())).encode()).hexdigest()  # plain integers, so they can be told
