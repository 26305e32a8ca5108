"""Piece codec against the library, spelling variants and prefix trie against brute force, with the edge cases they define."""

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tomeflow.llm import piece_codec, prefix_trie, spelling_groups

# --- SentencePiece encoding and decoding ---


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.read_model())


def same_as_library(codec, texts):
    got = [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)]
    want = [codec.library.encode(t, add_eos=True) for t in texts]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_encoding_is_the_library_s(codec):
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "\t\na", "a\x00b", "▁x", "ﬁ", "😀x😀", "aaaaaaaaaa" * 50, "日本語テスト梦", "<s></s><unk><0x41>", "    " * 9 + "x", "\n\n a\n", "é"]
    texts += ["".join(rng.choice("abcdehtrs ▁in\n😀éßя.,0") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    same_as_library(codec, texts)


def test_long_words_take_the_automaton(codec):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdluаяß梦") for _ in range(n)) for n in (33, 64, 1000, 60_000)]
    same_as_library(codec, [*words, "a" * 100_000, "the" * 5000])


def test_small_caches_change_nothing(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_SEGMENTS", 3)
    monkeypatch.setattr(piece_codec, "GROUP_CHARS", 50)
    same_as_library(codec, [f"word{i} and more of word{i % 7}" for i in range(200)])


def test_a_pair_is_compatible_if_merging_keeps_it(codec):
    rng = random.Random(7)
    ids = list(codec.ids.values())
    short = [i for i in ids if len(codec.texts[i]) < 4]
    for k in range(6000):
        a, b = rng.choice(short if k % 2 else ids), rng.choice(short if k % 3 else ids)
        x, y = codec.texts[a], codec.texts[b]
        assert codec.compatible(a, b) == (codec.merges(x + y)[0] == [x, y]), (x, y)


def test_codec_rows(spark):
    rows = [(1, "Ab cd", "x"), (1, "Ab cd", "x"), (None, None, None), (2, "", "y"), (3, "a\nb " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_ string")
    out = piece_codec.decode(piece_codec.encode(df)).collect()
    model = piece_codec.codec(piece_codec.read_model()).library
    want = [(d, k, model.encode(t or "", add_eos=True)) for d, t, k in rows]
    assert sorted(((r.doc_id, r.text_, list(r.ids), r.decoded) for r in out), key=repr) == sorted(((d, k, i, model.decode(i)) for d, k, i in want), key=repr)
    assert piece_codec.decode(piece_codec.encode(df.limit(0))).count() == 0


def test_codec_refuses_clashing_outputs(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, IDS int")
    with pytest.raises(ValueError):
        piece_codec.encode(df)


# --- spelling variants ---


def brute_words(rows, noise):
    total = Counter()
    for key, text in rows:
        for run in spelling_groups.RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(vocabulary):
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary[form[w]] if form[w] else None))
    return sorted(out)


def random_words(rng, n, letters="abé"):
    return ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 6, 7, 8]))) for _ in range(n)]


@pytest.mark.parametrize("noise", [7, 199])
def test_variants_are_those_of_brute_force(spark, noise):
    rng = random.Random(noise)
    pool = random_words(rng, 150)
    weights = [rng.choice([1, 5, 30, 200]) for _ in pool]
    rows = [(rng.choice([None, i]), rng.choice([" ", "-", "9\n"]).join(rng.choices(pool, weights, k=rng.randrange(60)))) for i in range(120)]
    rows += [(7, None), (8, ""), rows[0], (9, "ÉABABAB ÉABABAB" + " Bababab" * 40), (10, "×÷×÷×÷ " * 20)]
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    vocabulary = spelling_groups.word_counts(df, noise=noise)
    assert {r.word: r.n for r in vocabulary.collect()} == brute_words(rows, noise)
    out = spelling_groups.roots(spelling_groups.forms(vocabulary)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, out.collect())) == brute_variants(brute_words(rows, noise))


@pytest.mark.parametrize("symbols", [2, 5, 11])
def test_any_alphabet_finds_all_near_words(spark, symbols):
    rng = random.Random(symbols)
    words = sorted(set(random_words(rng, 120, "abcdeλ")) | {"a", "ab", "b", "x" * 300, "x" * 299 + "y"})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted((r.word, r.near) for r in spelling_groups.near_words(df, symbols).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_neighbourhoods_are_full_and_without_repeats():
    rng = random.Random(3)
    word = np.array([[rng.randrange(3) + 1 for _ in range(6)]], np.uint64)
    own = "".join(map(str, word[0]))
    want = {own} | {own[:i] + own[i + 1:] for i in range(6)} | {own[:i] + c + own[i + 1:] for i in range(6) for c in "123"} | {own[:i] + c + own[i:] for i in range(7) for c in "123"}
    keys = {int(spelling_groups.own_keys(np.array([list(map(int, w))], np.uint64))[0]) for w in want}
    got = spelling_groups.neighbour_keys(word, 3)[1].tolist()
    assert len(got) == len(set(got)) and set(got) == keys


def test_long_chains_of_forms_and_empty_tables(spark):
    chain = [(f"w{i:05d}", 5 ** i) for i in range(1, 20)]
    links = [(w, n, 1, v[0] if v else None, v[1] if v else None) for (w, n), v in zip(chain, [*chain[1:], None])]
    df = spark.createDataFrame(links, "word string, n long, n_near long, form string, form_n long")
    assert {r.root for r in spelling_groups.roots(df).collect()} == {chain[-1][0]}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_groups.variants(none).count() == 0


def test_pieces_end_between_words():
    text = "abc déf" * 50 + "g" * 300 + " h"
    parts = list(spelling_groups.pieces(text, 20))
    assert "".join(parts) == text and len(parts) > 5
    assert spelling_groups.runs(text, 20) == Counter(spelling_groups.RUN.findall(text))


# --- conversation prefix trie ---


def brute_trie(rows, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % most
        whole[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(cs) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(k))))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations(rng, n, turns=6, words=3):
    rows = []
    for c in rng.sample(range(500), n):
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t if t else None, rng.choice(["user", "user", None]), rng.choice(["", None, "hé", "long text"][:words + 1]) if rng.random() < 0.7 else "same"))
    return rows


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string")
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, seed):
    rows = conversations(random.Random(seed), 120)
    assert trie_of(spark, [*rows, (None, 1, "user", "left out")]) == brute_trie(rows)


@pytest.mark.parametrize(("band", "shard"), [(7, 40), (8, 1 << 17), (4096, 10)])
def test_bands_and_shards_change_nothing(spark, monkeypatch, band, shard):
    # Workers read these from the functions' module, so the walks are run here, as one stream.
    for name, value in (("BAND", band), ("SHARD_ROWS", shard)):
        monkeypatch.setattr(prefix_trie, name, value)
    monkeypatch.setattr(prefix_trie, "_dealt", lambda rows: rows)
    rng = random.Random(band)
    rows = conversations(rng, 60, turns=40, words=0)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shared = prefix_trie.banded(prefix_trie.rebuilt(prefix_trie.turns(df))).orderBy("band", "conv_id", "p").toArrow().to_batches(max_chunksize=50)
    got = Counter()
    for batch in prefix_trie._first_walk(iter(shared)):
        for depth, k1, k2, n in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "n")]):
            got[depth, k1, k2] += n
    want = Counter((r[1], r[3]) for r in brute_trie(rows))
    assert Counter((d, n) for (d, _, _), n in got.items()) == want


def test_long_conversations_go_through_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 16)
    rng = random.Random(9)
    rows = []
    for c in [0, 1, 2, 3, 101, 102, 205]:
        rows += [(c, t, "user", "t" if t < 45 else rng.choice("tu")) for t in range(rng.choice([15, 16, 17, 50, 64]))]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_empty_and_turnless(spark):
    assert trie_of(spark, []) == []
    # The first of each span is absent and the turns are fewer than those replaced.
    rows = [(c, 0, "user", "a") for c in range(1, 40)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_a_hot_end_is_one_digest(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 3000) for t in range(2)]
    assert trie_of(spark, rows) == brute_trie(rows)
