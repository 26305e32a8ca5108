"""Dependency graphs: closure, cycles, repair, edges and paths.

Loops write each round to the checkpoint folder and stop on a fixpoint; every round is a keyed join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import cut_lineage

# Opening words of taxonomy names.
TAXONOMY_PARENTS = ["types of ", "kinds of ", "kind of ", "classification of "]
TAXONOMY_WORDS = ["types of", "kind of", "classification"]


def dependency_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst): depends_on as it stands, prerequisite_of turned round, without duplicates."""
    t = F.col("type")
    ahead = edges.where(t == "depends_on").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = edges.where(t == "prerequisite_of").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return ahead.unionByName(back).distinct()


def closure(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst) for every node reachable in one or more steps; a node on a cycle reaches itself.

    Path lengths double each round, so a chain of n steps takes log n rounds, and only paths with a part found in the last
    round are joined. The result is all reachable pairs by definition: for a bound use :func:`bounded_reach`, for cycles
    :func:`cycles`, which never builds it.
    """
    reach = cut_lineage(pairs.select("src", "dst").distinct())
    fresh = reach
    for _ in range(max_rounds):
        ends = lambda df: df.select(F.col("src").alias("mid"), "dst")
        starts = lambda df: df.select("src", F.col("dst").alias("mid"))
        step = starts(fresh).join(ends(reach), "mid").unionByName(starts(reach).join(ends(fresh), "mid")).select("src", "dst").distinct()
        fresh = cut_lineage(step.join(reach, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = cut_lineage(reach.unionByName(fresh))
    raise RuntimeError("closure not finished; raise max_rounds")


def bounded_reach(pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """(src, dst, depth): nodes within ``max_depth`` steps, at their least depth, the start itself left out."""
    e = pairs.select(F.col("src").alias("mid"), F.col("dst").alias("to")).distinct()
    seen = cut_lineage(pairs.select("src", "dst").distinct().where("src <> dst").withColumn("depth", F.lit(1)))
    frontier = seen
    for d in range(2, max_depth + 1):
        step = frontier.select("src", F.col("dst").alias("mid")).join(e, "mid").select("src", F.col("to").alias("dst")).where("src <> dst").distinct()
        frontier = cut_lineage(step.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def _cut(df: DataFrame) -> DataFrame:
    """``cut_lineage`` without the size estimate that a checkpoint keeps: joins multiply it, and over many rounds its digits double."""
    df = cut_lineage(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), df.sparkSession)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out: one round."""
    kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return _cut(kept.select("src", "dst"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Each chain of nodes with one edge in and one out becomes one edge: (edges, chains, members, rings), or None without any.

    ``chains``: (root, a, b) with the ends and the last node of each; ``members``: (node, root); ``rings``: (node, cycle_id) of
    rings of such nodes only. Pointers double each round.
    """
    ahead = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next")).where("n = 1").select(F.col("src").alias("node"), "next")
    alone = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    chain = _cut(ahead.join(alone, "node"))
    if chain.isEmpty():
        return None
    inner = chain.select(F.col("node").alias("next"), F.lit(True).alias("goes"))
    at = chain.join(inner, "next", "left").select("node", F.when(F.col("goes"), F.col("next")).otherwise(F.col("node")).alias("to"), F.col("goes").isNull().alias("ended"), F.col("node").alias("low"))
    at = _cut(at)
    n_ended = at.where("ended").count()
    while True:
        far = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("ended").alias("ended2"), F.col("low").alias("low2"))
        step = at.join(far, "to").select("node", F.col("to2").alias("to"), F.col("ended2").alias("ended"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("sank"))
        step = _cut(step)
        now, sank = step.agg(F.count(F.when(F.col("ended"), 1)), F.count(F.when(F.col("sank"), 1))).first()
        at = step.drop("sank")
        # A chain still open ends some nodes each round, and a ring whose lows stay has been gone round.
        if now == n_ended and not sank:
            break
        n_ended = now
    members = _cut(at.where("ended").select("node", F.col("to").alias("root")))
    rings = at.where("not ended").select("node", F.col("low").alias("cycle_id"))
    nodes = chain.select("node")
    rest = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti")
    starts = rest.join(members.select(F.col("node").alias("dst"), "root"), "dst").select("root", F.col("src").alias("a"))
    chains = _cut(starts.join(chain.select(F.col("node").alias("root"), F.col("next").alias("b")), "root"))
    plain = rest.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    left = plain.unionByName(chains.where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
    return _cut(left), chains, members, rings


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, cycle_id) of groups of two nodes and more, by colours; runs until nothing changes."""
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("cycle_id")).limit(0)
    while not edges.isEmpty():
        colour = _cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            here = colour.select(F.col("node").alias("src"), "colour")
            better = edges.join(here, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
            new = _cut(colour.join(better, "node", "left").select("node", F.least("colour", "other").alias("colour"), (F.col("other") < F.col("colour")).alias("changed")))
            colour = new.select("node", "colour")
            if new.where("changed").isEmpty():
                break
        side = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"of_{c}"))
        inside = _cut(edges.join(side("src"), "src").join(side("dst"), "dst").where("of_src = of_dst").select("src", "dst", F.col("of_src").alias("colour")))
        group = _cut(colour.where("node = colour"))
        frontier = group
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = _cut(back.join(group.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            group = _cut(group.unionByName(frontier))
        several = group.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
        found = found.unionByName(group.join(several, "colour", "left_semi").select("node", F.col("colour").alias("cycle_id")))
        gone = group.select("node")
        rest = inside.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges, n = _cut(rest.select("src", "dst")), None
        while n != (n := edges.count()) and n:
            edges = _trimmed(edges)
    return _cut(found)


def cycles(pairs: DataFrame) -> DataFrame:
    """(node, cycle_id): nodes on a cycle; nodes that reach each other share the smallest id.

    Chains become single edges by doubling, and edges that no cycle can hold are trimmed off, in turn, so that long rings and
    tails take few rounds. In what is left the smallest id that reaches a node colours it; a colour's own node and all that
    lead back to it within the colour are one group. Groups and edges between colours go, and the rest follows; then chains
    whose ends are in one group join it. Every loop runs until nothing changes, without a limit. Rows never exceed the edges;
    rounds grow with the longest path between nodes that branch.
    """
    pairs = _cut(pairs.select("src", "dst").distinct())
    own_edges = pairs.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle_id"))
    edges, folded = _cut(pairs.where("src != dst")), []
    while not edges.isEmpty():
        n = edges.count()
        if short := _contracted(edges):
            edges = short[0]
            folded.append(short[1:])
        edges = _trimmed(edges)
        if short is None and edges.count() == n:
            break
    groups = _coloured(edges)
    for chains, members, rings in reversed(folded):
        groups = groups.unionByName(rings)
        # A chain that leads from a node back to it is a cycle whatever else the node is on.
        own = chains.where("a = b").select(F.col("a").alias("node")).distinct().join(groups, "node", "left_anti")
        groups = _cut(groups.unionByName(own.select("node", F.col("node").alias("cycle_id"))))
        end = lambda c: groups.select(F.col("node").alias(c), F.col("cycle_id").alias(f"of_{c}"))  # noqa: E731, B023
        closed = chains.join(end("a"), "a").join(end("b"), "b").where("of_a = of_b").select("root", F.col("of_a").alias("cycle_id"))
        every = _cut(groups.unionByName(members.join(closed, "root").select("node", "cycle_id")))
        lows = every.groupBy("cycle_id").agg(F.min("node").alias("low"))
        groups = _cut(every.join(lows, "cycle_id").select("node", F.col("low").alias("cycle_id")))
    return groups.unionByName(own_edges).groupBy("node").agg(F.min("cycle_id").alias("cycle_id"))


def broken_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dependency edges whose prerequisite end is no known node."""
    pairs = dependency_pairs(edges)
    return pairs.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))
    return nodes.select("id").join(ends, "id", "left_anti")


def repair_forest(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, parent_id) without dangling parents and cycles.

    Each cycle loses one parent link: that of the cycle node first met from the smallest id leading into the
    cycle. Pointers double each round. The nodes still pointed at stop getting fewer exactly when only cycle
    nodes are left.
    """
    ids = parents.select(F.col("id").alias("parent_id"))
    live = parents.select("id", "parent_id").join(ids, "parent_id", "left_semi").select("id", "parent_id")
    live = cut_lineage(live)
    jump = live.select("id", F.col("parent_id").alias("to"))
    size = None
    for _ in range(max_rounds):
        nxt = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        jump = cut_lineage(jump.join(nxt, "to").select("id", F.col("to2").alias("to")))
        n = jump.select("to").distinct().count()
        if n == size or n == 0:
            break
        size = n
    on_cycle = jump.select(F.col("to").alias("id")).distinct()
    named = cut_lineage(_cycle_names(live, on_cycle, max_rounds))
    entry = live.join(on_cycle.withColumn("hit", F.lit(1)), "id", "left").select("id", F.when(F.col("hit") == 1, F.col("id")).otherwise(F.col("parent_id")).alias("to"))
    entry = cut_lineage(entry)
    while True:
        open_ = entry.join(on_cycle.select(F.col("id").alias("to")), "to", "left_anti")
        nxt = entry.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        if open_.join(nxt, "to", "left_semi").isEmpty():
            break
        entry = cut_lineage(entry.join(nxt, "to").select("id", F.col("to2").alias("to")))
    leads = entry.join(named.select(F.col("id").alias("to"), "cycle_id"), "to")
    cut = leads.groupBy("cycle_id").agg(F.min_by("to", "id").alias("id"))
    kept = live.join(cut.select("id"), "id", "left_anti")
    return parents.select("id").join(kept, "id", "left")


def _cycle_names(live: DataFrame, on_cycle: DataFrame, max_rounds: int) -> DataFrame:
    """(id, cycle_id): the smallest id of each cycle, by doubling along the cycle alone."""
    ring = live.join(on_cycle, "id", "left_semi").select("id", F.col("parent_id").alias("to"), F.col("id").alias("low"))
    ring = cut_lineage(ring)
    total = None
    for _ in range(max_rounds):
        nxt = ring.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        ring = cut_lineage(ring.join(nxt, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
        now = ring.agg(F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return ring.select("id", F.col("low").alias("cycle_id"))


def child_links(forest: DataFrame) -> DataFrame:
    """(parent_id, child_id): child lists in long form."""
    return forest.where("parent_id IS NOT NULL").select("parent_id", F.col("id").alias("child_id"))


def hierarchy_edges(concepts: DataFrame) -> DataFrame:
    """Edges from children to parents, typed by their names. ``concepts``: (concept_id, name, parent_id)."""
    p = concepts.select(F.col("concept_id").alias("parent_id"), F.lower("name").alias("pn"))
    j = concepts.where("concept_id <> parent_id").join(p, "parent_id").withColumn("cn", F.lower("name"))
    any_ = lambda col, words, op: reduce(or_, [op(F.col(col), w) for w in words])
    kind = (
        F.when(any_("pn", TAXONOMY_PARENTS, lambda c, w: c.startswith(w)), "related_to")
        .when(any_("cn", TAXONOMY_WORDS, lambda c, w: F.contains(c, F.lit(w))) | F.col("cn").startswith("effect of "), "related_to")
        .when(F.col("cn").endswith(" law") | F.col("cn").endswith("'s law"), "explains")
        .otherwise("depends_on"))
    return j.select(F.col("concept_id").alias("source_id"), F.col("parent_id").alias("target_id"), kind.alias("type"), F.lit(0.9).alias("confidence"))


def object_edges(links: DataFrame) -> DataFrame:
    """Edges from concepts to the examples that illustrate and exercises that test them."""
    t = F.col("object_type")
    kind = F.when(t.isin("example", "worked_example"), "illustrated_by").when(t.isin("exercise", "exercise_question"), "tested_by")
    e = links.select(F.col("concept_id").alias("source_id"), F.col("object_id").alias("target_id"), kind.alias("type"), F.lit(0.9).alias("confidence"))
    return e.where("type IS NOT NULL AND source_id <> target_id")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, type): the most confident, the first on a tie."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "type")]
    best = edges.where("source_id <> target_id").groupBy("source_id", "target_id", "type").agg(
        F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), "seq")).alias("w"))
    return best.select("source_id", "target_id", "type", "w.*")


def sibling_groups(concepts: DataFrame) -> DataFrame:
    """(concept_id, sibling_group, n_siblings): concepts under one parent are related to each other.

    The relation is kept as membership: pairs of a large family would be quadratic. See :func:`siblings_of`.
    """
    c = concepts.where("parent_id IS NOT NULL")
    sizes = c.groupBy("parent_id").agg(F.count("*").alias("n"))
    return c.join(sizes, "parent_id").select("concept_id", F.col("parent_id").alias("sibling_group"), (F.col("n") - 1).alias("n_siblings"))


def siblings_of(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """(concept_id, sibling_id) for the concepts asked about only."""
    a = groups.join(asked, "concept_id", "left_semi").select("concept_id", "sibling_group")
    return a.join(groups.select(F.col("concept_id").alias("sibling_id"), "sibling_group"), "sibling_group").where(
        "concept_id <> sibling_id").select("concept_id", "sibling_id")


def neighbours(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, relation, direction, neighbour): both ends of every edge of the chosen types, distinct."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    both = F.array(
        F.struct(F.col("source_id").alias("node"), F.lit("out").alias("direction"), F.col("target_id").alias("neighbour")),
        F.struct(F.col("target_id").alias("node"), F.lit("in").alias("direction"), F.col("source_id").alias("neighbour")))
    return e.select(F.col("type").alias("relation"), F.inline(both)).select("node", "relation", "direction", "neighbour").distinct()


def next_topics(edges: DataFrame) -> DataFrame:
    """(node, related, neighbour): dependants of each node as next topics, and related_to read both ways."""
    dep = edges.where("type = 'depends_on'").select(F.col("target_id").alias("node"), F.lit("next").alias("relation"), F.col("source_id").alias("neighbour"))
    rel = edges.where("type = 'related_to'")
    a = rel.select(F.col("source_id").alias("node"), F.lit("related").alias("relation"), F.col("target_id").alias("neighbour"))
    b = rel.select(F.col("target_id").alias("node"), F.lit("related").alias("relation"), F.col("source_id").alias("neighbour"))
    return dep.unionByName(a).unionByName(b).distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, goal, path): shortest undirected path of each pair within ``max_depth`` steps, smallest node list on ties.

    The search grows from the starts, one kept path per (start, node); starts whose goals are all met stop growing.
    """
    e = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    frontier = pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    seen = frontier.select("start", "node")
    wanted = pairs.select("start", "goal").distinct()
    found = wanted.where("start = goal").select("start", "goal", F.array("start").alias("path"))
    wanted = wanted.where("start <> goal")
    for _ in range(max_depth):
        active = frontier.join(wanted.select("start").distinct(), "start", "left_semi")
        step = active.join(e, active.node == e.u).select("start", F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = cut_lineage(step.join(seen, ["start", "node"], "left_anti"))
        hits = frontier.withColumnRenamed("node", "goal").join(wanted, ["start", "goal"]).select("start", "goal", "path")
        found = cut_lineage(found.unionByName(hits))
        wanted = cut_lineage(wanted.join(found, ["start", "goal"], "left_anti"))
        if frontier.isEmpty() or wanted.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier.select("start", "node")))
    return found
