import math
import random

import pytest
from tomeflow.operators import evaluation as ev
from tomeflow.operators import fusion, lexical_index, lexical_scan, search, vectors
from pyspark.sql import functions as F

DOC = "concept_id string, name string, aliases array<string>, subject string, chapter string, definition_texts array<string>, example_texts array<string>"


def docs(spark, rows):
    return spark.createDataFrame([(i, n, a, "s", "c", d, e) for i, n, a, d, e in rows], DOC)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


FIELDS = [
    ("1", "Electric Field Lines", [], ["Lines of the field"], []),
    ("2", "Electric Field", ["E field"], ["The field is a force per charge"], ["Find the field"]),
    ("3", "Field due to a charged shell", [], ["Field of a shell"], []),
]


def test_exact_name_wins(spark):
    hits = search.bm25f_search(docs(spark, FIELDS), ask(spark, "Electric Field Lines")).orderBy("rank").collect()
    assert hits[0].concept_id == "1" and hits[0].score > hits[1].score + 100


def test_alias_boost_and_tie_order(spark):
    boosts = {r.concept_id: r.boost for r in search.score(docs(spark, FIELDS), ask(spark, "e-field")).collect()}
    assert boosts["2"] == 500.0 and boosts["1"] == 100.0
    d = docs(spark, [("z", "Charge Z", [], [], []), ("a", "Charge A", [], [], []), ("m", "Charge M", [], [], [])])
    hits = search.bm25f_search(d, ask(spark, "charge")).orderBy("rank").collect()
    assert [h.concept_id for h in hits] == ["a", "m", "z"]
    assert search.bm25f_search(d, ask(spark, "what is the?")).count() == 0


def test_exact_hits_are_made_where_they_are_written(spark):
    rng = random.Random(8)
    words = ["field", "line", "charge", "the", "shell", "of"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3)))
    rows = [(f"n{i}", rng.choice(["Electric Field", name()]), [name() for _ in range(rng.randint(0, 2))] if i % 5 else None, [], []) for i in range(60)]
    rows += [("none", None, [], [], []), ("stop", "the of", [], [], [])]
    asked = [*[name() for _ in range(20)], *["electric fields"] * 15, "unknown field", "the", None]
    tokens = lambda t: [lexical_scan.plural_stem(w) for w in lexical_scan.WORD.findall((t or "").lower()) if len(w) > 1 and w not in lexical_scan.STOP]
    want = set()
    for q, query in enumerate(asked):
        for i, n, aliases, _, _ in rows:
            t, own = tokens(query), tokens(n)
            boost = 1000.0 if t == own else 500.0 if t in [tokens(a) for a in aliases or []] else 100.0 if set(t) <= set(own) else 0.0
            if t and own and boost:
                want.add((q, i, boost))
    got = search.exact_hits(docs(spark, rows), ask(spark, *asked), block=4, task_pairs=50)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # Pairs are quadratic where names repeat: none is aggregated, joined or dealt out.
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Aggregate" not in plan and "Join" not in plan and plan.rindex("Generate") < plan.index("Exchange")


def test_bm25_value(spark):
    d = docs(spark, FIELDS)
    got = {r.concept_id: r.bm25 for r in search.score(d, ask(spark, "shell")).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    # names: electric field line / electric field / field due charged shell; definitions: line field / field force per charge / field shell
    avg_name, avg_def = (3 + 2 + 4) / 3, (2 + 4 + 2) / 3
    wtf = 3.0 / (0.25 + 0.75 * 4 / avg_name) + 1.0 / (0.25 + 0.75 * 2 / avg_def)
    assert set(got) == {"3"} and got["3"] == pytest.approx(idf * wtf * 2.5 / (1.5 + wtf), abs=1e-9)


def test_batch_equals_single_and_salted_equals_broadcast(spark):
    d = docs(spark, FIELDS)
    batch = search.bm25f_search(d, ask(spark, "electric field", "shell", "charge")).collect()
    single = [r for i, q in enumerate(["electric field", "shell", "charge"]) for r in
              search.bm25f_search(d, spark.createDataFrame([(i, q)], "query_id int, query string")).collect()]
    assert sorted(map(tuple, batch)) == sorted(map(tuple, single))
    salted = search.bm25f_search(d, ask(spark, "electric field", "shell", "charge"), max_rows=0, salts=3).collect()
    assert sorted(map(tuple, salted)) == sorted(map(tuple, batch))


def test_example_and_name_search_brute_force(spark):
    ex = spark.createDataFrame([(1, "Find the FIELD of a long wire"), (2, "the wire and the field lines of wires"), (3, "nothing")], "id int, problem_text string")
    got = search.example_search(ex, ask(spark, "field of wire lines")).orderBy("rank").collect()
    assert [(r.id, r.matches) for r in got] == [(2, 3), (1, 2)]
    names = {r.concept_id for r in search.name_search(docs(spark, FIELDS), ask(spark, "shell")).collect()}
    assert names == {"3"}


def test_fusion_values(spark):
    def fuse(lists, weights, k=60):
        rows = [(0, f"l{i}", c, r + 1) for i, one in enumerate(lists) for r, c in enumerate(one)]
        df = spark.createDataFrame(rows, "query_id int, list string, concept_id string, rank int")
        return [(r.concept_id, r.score) for r in fusion.fuse(df, weights, k).orderBy("rank").collect()]

    both = 1 / 61 + 1 / 62
    assert [(c, pytest.approx(s, abs=1e-8)) for c, s in fuse([["a", "b"], ["b", "a"]], {"l0": 1.0, "l1": 1.0})] == [("a", both), ("b", both)]
    assert dict(fuse([["a", "a", "b"]], {"l0": 1.0}))["a"] == pytest.approx(1 / 61, abs=1e-8)
    w = dict(fuse([["a", "b"], ["b", "a"]], {"l0": 2.0, "l1": 1.0}))
    assert w["a"] == pytest.approx(2 / 61 + 1 / 62, abs=1e-8) and w["b"] == pytest.approx(2 / 62 + 1 / 61, abs=1e-8)
    with pytest.raises(ValueError):
        fuse([["a"]], {"l0": 1.0}, 0)


def test_hashing_bucket_and_vector_search(spark):
    cell = vectors.hashed_weights(spark.createDataFrame([(1, "matrix")], "id int, text string")).first()
    assert (cell.bucket, cell.weight) == (158, -1.0)
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id int, vector array<double>")
    q = v.where("id < 9").selectExpr("id AS query_id", "vector")
    a = vectors.vector_topk(v, q, 4).orderBy("query_id", "rank").collect()
    b = vectors.vector_topk(v, q, 4, max_query_bytes=2 * 24, max_vector_bytes=11 * 24, tile_bytes=24 * 7).orderBy("query_id", "rank").collect()
    c = vectors.vector_topk(v, q, 4, tile_bytes=24 * 7).orderBy("query_id", "rank").collect()
    assert a == b == c and len(a) == 36
    for n, m, size in [(10_000, 20_000, 48 << 20), (5, 3, 24), (1, 1, 1), (10**6, 10**6, 10_000)]:
        rows, cols = vectors.tile_shape(n, m, size)
        assert rows >= 1 and cols >= 1 and rows * cols * 24 <= max(size, 24)
    assert vectors.vector_topk(v, q, 0).count() == 0
    zero = vectors.hashing_vectors(spark.createDataFrame([(1, "")], "id int, text string")).first()
    assert set(zero.vector) == {0.0}


def test_provider_hook(spark):
    import numpy as np

    out = vectors.provider_vectors(spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, text string"), lambda: lambda ts: np.array([[len(x), 1.0] for x in ts]))
    assert {r.id: list(r.vector) for r in out.collect()} == {1: [2.0, 1.0], 2: [3.0, 1.0]}


def metrics(spark, rels):
    judged = spark.createDataFrame([(0, i + 1, r) for i, r in enumerate(rels)], "query_id int, rank int, rel int")
    return ev.retrieval_metrics(judged, spark.createDataFrame([(0, 1), (1, 1)], "query_id int, n_expected int")).where("query_id = 0").first()


def test_metrics(spark):
    m = metrics(spark, [0, 1, 0])
    assert (m.mrr, m.recall_1, m.recall_3) == (0.5, 0, 1) and m.precision_3 == pytest.approx(1 / 3) and m.ndcg_5 == pytest.approx(1 / math.log2(3))
    m = metrics(spark, [1, 0])
    assert m.mrr == m.recall_1 == m.precision_1 == m.ndcg_5 == 1
    assert metrics(spark, [0, 0]).mrr == 0


@pytest.mark.parametrize("perm", [[3, 1, 2, 0], [0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [5, 5, 1, 9, 9, 2, 7], [3]])
def test_order_agreement_brute_force(spark, perm):
    e = spark.createDataFrame([("g", i, i) for i in range(len(perm))], "g string, item int, pos long")
    a = spark.createDataFrame([("g", i, p) for i, p in enumerate(perm)], "g string, item int, pos long")
    n = len(perm)
    conc = sum(perm[i] < perm[j] for i in range(n) for j in range(i + 1, n))
    want = conc / (n * (n - 1) / 2) if n > 1 else 1.0
    assert ev.order_agreement(e, a, ["g"], block=2).first().agreement == pytest.approx(want)


def test_gate(spark):
    cols = "subject string, metric string, value double, status string"
    cur = spark.createDataFrame([("a", "m", 0.5, "ok"), ("a", "n", 0.9, "ok"), ("b", "m", 1.0, "failed")], cols)
    base = spark.createDataFrame([("a", "m", 0.6, "ok"), ("a", "n", 0.9, "ok"), ("b", "m", 1.0, "ok")], cols)
    got = {(r.subject, r.metric): r.problem for r in ev.regression_gate(cur, base).collect()}
    assert got == {("a", "m"): "regression", ("b", "m"): "status failed"}


def test_index_skips_and_agrees_with_full_scoring(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}k" for i in range(200)]
    some = lambda n: " ".join(words[min(int(rng.paretovariate(0.7)) - 1, 199)] for _ in range(n))
    rows = [(str(i), some(3), [some(1)], f"s{i % 3}", "c", [some(rng.randrange(0, 30))], [some(rng.randrange(0, 60))]) for i in range(600)]
    d = spark.createDataFrame(rows + [("x", "", [], "s0", "c", [], [])], DOC).cache()
    asked = [some(4) for _ in range(12)] + [rows[5][1], rows[9][2][0], "none of these", "", f"{words[0]} {words[150]}"]
    q = ask(spark, *asked)
    index = lexical_index.build(d, str(tmp_path / "index"))
    seen = lambda df: sorted((r.query_id, r.rank, r.concept_id, round(r.score, 5), r.boost) for r in df.collect())
    keep = F.col("subject") == "s1"
    assert seen(lexical_index.search_index(index, q, 1)) == seen(search.bm25f_search(d, q, 1))
    kept = seen(search.bm25f_search(d, q, 4, keep))
    assert seen(lexical_index.search_index(index, q, 4, keep)) == kept
    # Shuffled instead of broadcast, and read back from its folder.
    again = lexical_index.read(spark, str(tmp_path / "index"))
    assert seen(lexical_index.search_index(again, q, 4, keep, max_rows=0)) == kept
    # Documents are skipped: far fewer are scored than share a word.
    blocks = lexical_index._asked_levels(index, search.query_terms(q), 1000)
    assert lexical_index.candidates(index, q, blocks, 1).count() < 0.7 * search.score(d, q).count()


def test_index_of_no_documents(spark, tmp_path):
    index = lexical_index.build(docs(spark, []), str(tmp_path / "index"))
    assert lexical_index.search_index(index, ask(spark, "field")).count() == 0


def test_scan_in_blocks_is_scoring_by_joins(spark):
    """Queries in blocks of a few weights, copies that tie, exact names, aliases and a filter: the rows that joins give."""
    words = ["electric", "charges", "field", "lens", "boxes", "bodies", "the", "x"]
    rows = [(f"d{i % 40}-{i}", " ".join(words[(i + j) % 8] for j in range(2 + i % 3)), [words[i % 8]] if i % 4 == 0 else [], "ABC"[i % 3], "c",
             [" ".join(words[(i * j) % 8] for j in range(1, 9))], ["Lens? field"] if i % 2 else []) for i in range(80)]
    d = spark.createDataFrame(rows, "concept_id string, name string, aliases array<string>, subject string, chapter string, definition_texts array<string>, example_texts array<string>")
    q = ask(spark, "electric charges", "field", "boxes", "the", "bodies of the electric lens", "unheard", "charge field lens")
    keep = F.col("subject") != "B"
    for kept in (None, keep):
        joined = search.bm25f_search(d, q, 5, kept, max_rows=0).collect()
        for cells in (2, 1 << 20):
            scanned = lexical_scan.search_scan(d, search.query_terms(q), 5, kept, cells).collect()
            seen = lambda hits: sorted((r.query_id, r.rank, r.concept_id, round(r.score, 5), r.boost) for r in hits)
            assert seen(scanned) == seen(joined)
