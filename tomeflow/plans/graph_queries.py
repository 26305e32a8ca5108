"""Driver queries for graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from .bindings import PARENTS_SQL, TREE_EDGES_SQL, case, pick
from .concept_queries import NEAREST_SQL, links
from .registry import query


def _tree(t):
    return t.tree_edges().withColumn("type", F.lit("depends_on"))


def _tree_pairs(t):
    return gr.dependency_pairs(_tree(t))


def _parent_pairs(t):
    return t.parents().where("parent_id IS NOT NULL").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))


@query("transitive_prerequisites", "G1", f"""WITH RECURSIVE {TREE_EDGES_SQL}, r AS (SELECT source_id AS src, target_id AS dst FROM tree_edges
  UNION SELECT r.src, e.target_id FROM r JOIN tree_edges e ON e.source_id = r.dst) SELECT src, dst FROM r""")
def _(t):
    return gr.closure(_tree_pairs(t))


# Rings of five among the first half of every ten parts; the others hang below as tails.
_RINGS_SQL = """rings AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 10 < 5 THEN CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END ELSE p_partkey // 2 END AS dst FROM part
  UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 97 = 7)"""


def _rings(t):
    p = F.col("p_partkey")
    ring = F.when(p % 5 == 4, p - 4).otherwise(p + 1)
    edges = t.part.select(p.alias("src"), F.when(p % 10 < 5, ring).otherwise(F.floor(p / 2)).alias("dst"))
    return edges.unionByName(t.part.where(p % 97 == 7).select(p.alias("src"), p.alias("dst")))


@query("dependency_cycles", "G3", f"""WITH RECURSIVE {_RINGS_SQL}, r AS (SELECT src, dst FROM rings UNION SELECT r.src, e.dst FROM r JOIN rings e ON e.src = r.dst)
  SELECT a.src AS node, min(a.dst) AS cycle_id FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""")
def _(t):
    return gr.cycles(_rings(t))


@query("broken_chains", "G4", f"WITH {PARENTS_SQL} SELECT id AS src, parent_id AS dst FROM parents WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM parents)")
def _(t):
    e = t.parents().where("parent_id IS NOT NULL").select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("depends_on").alias("type"))
    return gr.broken_chains(e, t.parents())


@query("orphan_nodes", "G5", f"WITH {PARENTS_SQL} SELECT id FROM parents p WHERE parent_id IS NULL AND NOT EXISTS (SELECT 1 FROM parents q WHERE q.parent_id = p.id)")
def _(t):
    e = t.parents().where("parent_id IS NOT NULL").select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"))
    return gr.orphans(t.parents(), e)


@query("repaired_forest", "G6")
def _(t):
    return gr.repair_forest(t.parents())


# Names with the words that type a hierarchy edge, by part key modulo 6.
_NAMES = ["types of ", "effect of ", "", "kind of ", "classification of ", ""]
_TAILS = ["", "", " law", "", "", ""]


def _named(t):
    k = F.col("p_partkey") % 6
    return t.part.select(F.col("p_partkey").alias("concept_id"), F.concat(pick(k, _NAMES), "p_name", pick(k, _TAILS)).alias("name"), F.floor(F.col("p_partkey") / 2).alias("parent_id"))


@query("hierarchy_edges", "G7", f"""WITH n AS (SELECT p_partkey AS id, {case("p_partkey % 6", _NAMES)} || p_name || {case("p_partkey % 6", _TAILS)} AS name, p_partkey // 2 AS parent_id FROM part)
  SELECT c.id AS source_id, p.id AS target_id, CASE WHEN regexp_matches(p.name, '^(types of |kinds of |kind of |classification of )') THEN 'related_to' WHEN regexp_matches(c.name, 'types of|kind of|classification') OR starts_with(c.name, 'effect of ') THEN 'related_to'
    WHEN c.name LIKE '% law' THEN 'explains' ELSE 'depends_on' END AS type, CAST(0.9 AS DOUBLE) AS confidence FROM n c JOIN n p ON p.id = c.parent_id WHERE c.id <> p.id""")
def _(t):
    return gr.hierarchy_edges(_named(t))


@query("object_edges", "G8", f"""WITH {NEAREST_SQL} SELECT concept_id AS source_id, object_id AS target_id, CASE WHEN type IN ('example', 'worked_example') THEN 'illustrated_by' ELSE 'tested_by' END AS type, CAST(0.9 AS DOUBLE) AS confidence
  FROM links WHERE type IN ('example', 'worked_example', 'exercise', 'exercise_question')""")
def _(t):
    return gr.object_edges(links(t))


@query("edge_dedupe", "A5", """SELECT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS type, max(l_discount) AS confidence, arg_min(l_orderkey * 10 + l_linenumber, (-l_discount, l_orderkey * 10 + l_linenumber)) AS seq
  FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3""")
def _(t):
    e = t.lineitem.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return gr.dedupe_edges(e)


@query("sibling_groups", "G9", "SELECT p_partkey AS concept_id, p_partkey // 2 AS sibling_group, count(*) OVER (PARTITION BY p_partkey // 2) - 1 AS n_siblings FROM part")
def _(t):
    return gr.sibling_groups(_named(t))


@query("one_hop_neighbours", "G11", """WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS d, l_returnflag AS r FROM lineitem WHERE l_returnflag IN ('A', 'R'))
  SELECT s AS node, r AS relation, 'out' AS direction, d AS neighbour FROM e UNION ALL SELECT d, r, 'in', s FROM e""")
def _(t):
    e = t.lineitem.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("type"))
    return gr.neighbours(e, ["A", "R"])


@query("next_topics", "G2", f"""WITH {TREE_EDGES_SQL}, rel AS (SELECT l_partkey AS s, l_suppkey AS d FROM lineitem)
  SELECT target_id AS node, 'next' AS relation, source_id AS neighbour FROM tree_edges UNION SELECT s, 'related', d FROM rel UNION SELECT d, 'related', s FROM rel""")
def _(t):
    rel = t.lineitem.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit("related_to").alias("type"))
    return gr.next_topics(_tree(t).unionByName(rel))


@query("bounded_dependencies", "G12", f"""WITH RECURSIVE {PARENTS_SQL}, pe AS (SELECT id AS src, parent_id AS dst FROM parents WHERE parent_id IS NOT NULL),
  r AS (SELECT src, dst, 1 AS depth FROM pe WHERE src <> dst UNION SELECT r.src, pe.dst, depth + 1 FROM r JOIN pe ON pe.src = r.dst WHERE depth < 5)
  SELECT src, dst, min(depth) AS depth FROM r WHERE src <> dst GROUP BY 1, 2""")
def _(t):
    return gr.bounded_reach(_parent_pairs(t), 5)


@query("shortest_paths", "G13", f"""WITH RECURSIVE {TREE_EDGES_SQL}, u AS (SELECT source_id AS a, target_id AS b FROM tree_edges UNION SELECT target_id, source_id FROM tree_edges),
  p AS (SELECT DISTINCT p_partkey AS start FROM part), w AS (SELECT p_partkey AS start, p_partkey + 1 AS goal FROM part),
  r AS (SELECT start, start AS node, [start] AS path FROM p UNION ALL SELECT start, b, list_append(path, b) FROM r JOIN u ON u.a = r.node WHERE len(path) <= 4 AND NOT list_contains(path, b))
  SELECT start, goal, array_to_string(arg_min(path, (len(path), path)), '>') AS path FROM r JOIN w USING (start) WHERE node = goal GROUP BY 1, 2""")
def _(t):
    pairs = t.part.select(F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1).alias("goal"))
    return gr.shortest_paths(t.tree_edges(), pairs, 4).select("start", "goal", F.array_join("path", ">").alias("path"))
