import random
import re

from tomeflow.operators import concepts as cp
from tomeflow.operators import graph as gr
from tomeflow.operators import objects as ob

HEADS = ["1 Topic one", "Definition 1", "Theorem 2", "Proof of it", "Example 3", "Solution", "Hence done", "Exercise 1.1", "Note", "Fig 1", "plain words", "we have more words"]
OWN = ["heading", "definition", "theorem", "proof", "worked_example", "example_solution", None, "exercise", "important_note", "caption", None, None]
STOP = {"heading", "caption", "concept", "footnote", "calculation_step", "final_answer", "reference"}


def sequential(lines):
    """The rule as one pass with open contexts: (type, parent) per line; the flow restarts on every page."""
    out, ex, so, xr, th, prev, page0 = [], None, None, None, None, "paragraph", None
    for i, page, kind in lines:
        if page != page0:
            prev, page0 = "paragraph", page
        t = OWN[kind]
        if t is None:
            if so is not None:
                t = "final_answer" if kind == 6 else "calculation_step"
            elif ex is not None:
                t = "example_question"
            elif xr is not None:
                t = "exercise_question"
            else:
                t = prev if prev not in STOP else "paragraph"
        prev = t
        parent = None
        if t == "heading":
            ex = so = xr = th = None
        elif t == "theorem":
            th = i
        elif t == "proof" and th is not None:
            parent = th
        elif t == "worked_example":
            ex, so = i, None
        elif t == "example_question" and ex is not None:
            parent = ex
        elif t == "example_solution" and ex is not None:
            parent, so = ex, i
        elif t in ("calculation_step", "final_answer") and so is not None:
            parent = so
        elif t == "exercise":
            ex = so = th = None
            xr = i
        elif t == "exercise_question" and xr is not None:
            parent = xr
        out.append((i, t, parent))
    return out


def books(spark, seed, n_books=6, n=150):
    rnd = random.Random(seed)
    rows, want = [], {}
    for b in range(n_books):
        lines = [(f"{b}:{i}", 1 + i // 7 * 9, rnd.randrange(12)) for i in range(n)]
        want.update({i: (t, p) for i, t, p in sequential(lines)})
        rows += [(i, b, "c", page, k, HEADS[kind]) for k, (i, page, kind) in enumerate(lines)]
    return spark.createDataFrame(rows, "id string, book int, chapter string, page int, reading_order int, text string"), want


def test_types_and_parents_equal_a_sequential_pass(spark):
    df, want = books(spark, 1)
    got = {r.id: (r.type, r.parent_id) for r in ob.typed_objects(df).collect()}
    assert got == want


def test_links_across_blocks(spark):
    df, _ = books(spark, 2)
    got = {r.id: (r.previous_id, r.next_id) for r in ob.reading_links(df).collect()}
    assert got["0:0"] == (None, "0:1") and got["3:149"] == ("3:148", None)
    assert all(got[f"2:{i}"] == (f"2:{i-1}", f"2:{i+1}") for i in range(1, 149))


def test_worked_examples_brute_force(spark):
    df, want = books(spark, 3)
    typed = ob.typed_objects(df)
    rows = sorted(typed.collect(), key=lambda r: (r.book, r.page, r.reading_order))
    exp = {}
    i = 0
    while i < len(rows):
        r = rows[i]
        i += 1
        if r.type != "worked_example":
            continue
        prob, sol, j = [r.text], [], i
        while j < len(rows) and rows[j].book == r.book and rows[j].type not in ("worked_example", "exercise"):
            x = rows[j]
            j += 1
            if x.type in ("example_question", "example_solution", "calculation_step", "definition"):
                begun = "solution" in " ".join(sol).lower() or "we have" in x.text.lower()
                (sol if x.type == "example_solution" or begun else prob).append(x.text)
            elif x.type == "paragraph" and len(x.text) < 200:
                (sol if "solution" in " ".join(sol).lower() else prob).append(x.text)
        exp[r.id] = (" ".join(prob), " ".join(sol))
    got = {r.id: (r.problem_text, r.solution_text) for r in ob.worked_examples(typed).collect()}
    assert got == exp and got


def test_mentions_equal_a_longest_first_pattern(spark):
    aliases = ["electric field", "electric field lines", "field lines", "charge", "gauss law", "lines of force"]
    texts = ["Electric field lines of force", "The CHARGE, a charge-field linesman", "electric  field lines", "gauss law and electric field linesx", "recharge charged charge"]
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, aliases), key=lambda a: -len(a))) + r")\b", re.I)
    want = {(i, m.lower()) for i, t in enumerate(texts) for m in pattern.findall(t)}
    objects = spark.createDataFrame(list(enumerate(texts)), "object_id int, text string")
    a = spark.createDataFrame([(x, x) for x in aliases], "concept_id string, alias string")
    assert {(r.object_id, r.concept_id) for r in cp.mentions(objects, a).collect()} == want


def test_containment_parents_brute_force(spark):
    rnd = random.Random(5)
    words = ["abcd", "bcde", "field", "fields", "law", "electric", "ric fi"]
    names = {("c%d" % (k % 2), " ".join(rnd.sample(words, rnd.randint(1, 3)))) for k in range(60)}
    want = {}
    for c, n in names:
        inside = [p for d, p in names if d == c and p != n and len(p) >= 4 and p in n]
        if inside:
            want[(c, n)] = max(inside, key=lambda p: (len(p), p))
    df = spark.createDataFrame(sorted(names), "chapter string, norm string")
    assert {(r.chapter, r.norm): r.parent for r in cp.containment_parents(df, ["chapter"]).collect()} == want


def test_reattribution(spark):
    c = spark.createDataFrame([("ch", "1", "Relation"), ("ch", "2", "Domain"), ("other", "3", "Range")], "chapter string, concept_id string, name string")
    links = spark.createDataFrame([("ch", "1", "o1", "definition"), ("ch", "1", "o2", "definition"), ("ch", "1", "o3", "worked_example")], "chapter string, concept_id string, object_id string, object_type string")
    texts = spark.createDataFrame([("o1", "The domain is called the first set"), ("o2", "A relation is called a subset, range"), ("o3", "Sets with a domain of five members are called finite sets by all")], "object_id string, text string")
    got = {r.object_id: r.new_concept_id for r in cp.reattributed_definitions(links, texts, c, ["chapter"]).collect()}
    assert got == {"o1": "2", "o3": "2"}


def test_reattribution_of_a_term_in_many_names(spark):
    names = ["the empty ring", "ring", "ring of rings", "another ring", "a ring apart"]
    c = spark.createDataFrame([("ch", str(i), n) for i, n in enumerate(names)], "chapter string, concept_id string, name string")
    links = spark.createDataFrame([("ch", str(i), f"o{i}", "definition") for i in range(5)], "chapter string, concept_id string, object_id string, object_type string")
    texts = spark.createDataFrame([(f"o{i}", "Ring is called " + "long " * 30) for i in range(5)], "object_id string, text string")
    got = {r.object_id: r.new_concept_id for r in cp.reattributed_definitions(links, texts, c, ["chapter"]).collect()}
    assert got == {f"o{i}": "4" if i != 4 else "3" for i in range(5)}


def repaired(parents):
    """Sequential rule: walk from each id in order, clear the parent of the first node met twice."""
    p = {i: (q if q in parents else None) for i, q in parents.items()}
    for start in sorted(p):
        seen, cur = set(), start
        while cur is not None:
            if cur in seen:
                p[cur] = None
                break
            seen.add(cur)
            cur = p[cur]
    return p


def test_forest_repair(spark):
    rnd = random.Random(7)
    for n in (2, 9, 40):
        parents = {i: rnd.choice([None, *range(n + 2)]) if rnd.random() < 0.9 else None for i in range(n)}
        df = spark.createDataFrame(sorted(parents.items()), "id int, parent_id int")
        assert {r.id: r.parent_id for r in gr.repair_forest(df).collect()} == repaired(parents)
    loops = {1: 2, 2: 1, 3: 4, 4: 5, 5: 3, 6: 6, 7: 99}
    df = spark.createDataFrame(sorted(loops.items()), "id int, parent_id int")
    assert {r.id: r.parent_id for r in gr.repair_forest(df).collect()} == repaired(loops)


def cycles_by_walks(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for n in ahead:
        met, todo = set(), [n]
        while todo:
            new = ahead.get(todo.pop(), set()) - met
            met |= new
            todo += new
        reach[n] = met
    return {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in ahead if n in reach[n]}


def test_cycles_longer_than_any_round_limit(spark):
    """Rings of over a thousand nodes, alone, with chords, through one node, and behind a tail; and small random graphs."""
    rnd = random.Random(3)
    ring = lambda low, n: [(low + i, low + (i + 1) % n) for i in range(n)]
    edges = ring(0, 2000) + ring(3000, 1200) + [(3100, 3700), (3900, 3050), (3050, 3050)]
    edges += [(5000 + i, 5001 + i) for i in range(1100)] + [(6100, 3000), (3001, 6200), (6200, 6201)]
    edges += ring(7000, 30) + [(7010, 7100), (7100, 7101), (7101, 7010), (7105, 7104), (7104, 7105), (7105, 7000)]
    for k in range(10):
        low, n = 10_000 + 100 * k, rnd.choice([2, 3, 4])
        edges += [(low + rnd.randrange(n), low + rnd.randrange(n)) for _ in range(rnd.choice([n, n * 3 // 2, 2 * n]))]
    got = gr.cycles(spark.createDataFrame(edges, "src int, dst int")).collect()
    want = cycles_by_walks(edges)
    assert want[1999] == 0 and {r.node: r.cycle_id for r in got} == want and len(got) == len(want)
    assert gr.cycles(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")).count() == 0


def test_siblings_on_request(spark):
    c = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (5, 9)], "concept_id int, parent_id int")
    g = gr.sibling_groups(c)
    assert {(r.concept_id, r.n_siblings) for r in g.collect()} == {(2, 2), (3, 2), (4, 2), (5, 0)}
    asked = spark.createDataFrame([(3,)], "concept_id int")
    assert {r.sibling_id for r in gr.siblings_of(g, asked).collect()} == {2, 4}
