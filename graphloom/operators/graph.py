"""Traversals and rule inference.  Every loop is a level of joins over the whole frontier, not a walk from node to node."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.store import adjacency, canonical_pairs
from graphloom.session import shared_dir, stored


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _together(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, tables)


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, hop) of all pairs that edges (src, dst) connect, by shortest hop, in as many rounds as the longest one has binary digits.

    A round knows all pairs up to n hops and finds those up to 2n: a shortest path of more than n hops is one of exactly n to some node
    and one of at most n from there.  So only the pairs at exactly n hops are joined, to all that are known.  What a round finds is a table
    of its own and is never written again; pairs that are known already are left out, so cycles end.
    """
    found = [stored(edges.select("src", "dst").where("src <> dst").distinct().withColumn("hop", F.lit(1)), "closure")]
    n = 1
    while max_depth is None or n < max_depth:
        most = 2 * n if max_depth is None else min(2 * n, max_depth)
        new = _farther(found, n, most)
        if new.isEmpty():
            break
        found.append(new)
        n = most
    return _together(found)


def _farther(found: list[DataFrame], n: int, most: int) -> DataFrame:
    """(src, dst, hop), stored, of the pairs over n up to `most` hops apart; found holds all up to n.

    Merged joins: stored pairs are small as files and large as the rows that a broadcast sends through the driver.
    """
    known = _together(found)
    far, near = known.where(F.col("hop") == n).alias("f"), known.hint("merge").alias("k")
    met = far.join(near, F.col("f.dst") == F.col("k.src")).select(F.col("f.src").alias("src"), F.col("k.dst").alias("dst"), (F.col("f.hop") + F.col("k.hop")).alias("hop"))
    new = met.where((F.col("src") != F.col("dst")) & (F.col("hop") <= most)).groupBy("src", "dst").agg(F.min("hop").alias("hop")).join(known.hint("merge"), ["src", "dst"], "left_anti")
    return stored(new, "closure")


def reach(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(origin, id, hop) of all nodes that edges (src, dst) lead to from some nodes start (id), by shortest hop, the start at hop 0.

    Level by level, at most max_depth of them; a level is a table of its own.  For all nodes, or without a depth, there is `closure`.
    """
    pairs = edges.select("src", "dst").distinct()
    levels = [stored(start.select(F.col("id").alias("origin"), "id").distinct().withColumn("hop", F.lit(0)), "level")]
    for hop in range(1, max_depth + 1):
        front = levels[-1]
        new = front.join(pairs, front.id == pairs.src).select("origin", F.col("dst").alias("id")).distinct().join(_together(levels), ["origin", "id"], "left_anti")
        levels.append(stored(new.withColumn("hop", F.lit(hop)), "level"))
        if levels[-1].isEmpty():
            break
    return _together(levels)


def _reached(edges: DataFrame, start: DataFrame | None, nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """(origin, id, hop) from start, or from all nodes where there is none."""
    if start is not None and max_depth is not None:
        return reach(edges, start, max_depth)
    own = nodes if start is None else start
    pairs = closure(edges, max_depth).select(F.col("src").alias("origin"), F.col("dst").alias("id"), "hop")
    pairs = pairs.join(own.select(F.col("id").alias("origin")).distinct().hint("merge"), "origin", "left_semi")
    return own.select(F.col("id").alias("origin"), "id").distinct().withColumn("hop", F.lit(0)).unionByName(pairs)


def causal_chain(edges: DataFrame, objects: DataFrame, start: DataFrame | None = None, max_depth: int = 10, forward: bool = True) -> DataFrame:
    """(origin, id, hop): causes at negative hops, effects at positive ones; edges to missing objects end a branch.  Of all objects without a start."""
    ids = objects.select("id")
    live = edges.join(ids, edges.dst == ids.id, "left_semi")
    out = _reached(live.where("rel_type = 'causedBy'"), start, ids, max_depth).withColumn("hop", -F.col("hop"))
    if forward:
        out = out.unionByName(_reached(live.where("rel_type = 'ledTo'"), start, ids, max_depth).where("hop > 0"))
    return out


def evolution(edges: DataFrame, objects: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(origin, id, created_at): all that an object supersedes, it itself, and all that supersede it.  Of all objects without a start.

    One closure serves both ways: what supersedes a node are the other ends of the pairs that lead to it.
    """
    pairs = closure(edges.where("rel_type = 'supersedes'")).select("src", "dst")
    ids = (objects if start is None else start).select("id").distinct()
    both = pairs.select(F.col("src").alias("origin"), F.col("dst").alias("id")).unionAll(pairs.select(F.col("dst").alias("origin"), F.col("src").alias("id"))).join(ids.select(F.col("id").alias("origin")).hint("merge"), "origin", "left_semi")
    every = both.unionAll(ids.select(F.col("id").alias("origin"), "id")).distinct()
    return every.join(objects.select("id", "created_at").hint("merge"), "id").select("origin", "id", "created_at")


def contradiction_map(edges: DataFrame, objects: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(a, b, a_title, b_title); a pair counts when either end is in scope."""
    pairs = canonical_pairs(edges, "contradicts")
    if scope is not None:
        ids = scope.select("id")
        pairs = pairs.join(ids, F.col("a") == ids.id, "left_semi").unionByName(pairs.join(ids, F.col("b") == ids.id, "left_semi")).distinct()
    titles = objects.select("id", "title")
    out = pairs.join(titles.select(F.col("id").alias("a"), F.col("title").alias("a_title")), "a", "left")
    return out.join(titles.select(F.col("id").alias("b"), F.col("title").alias("b_title")), "b", "left").select("a", "b", "a_title", "b_title")


def neighbourhood(entity_ids: DataFrame, mentions: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(entity_id, id, hop, via, via_rel): objects that mention the entity, then what they relate to, by the first discoverer."""
    first = mentions.join(entity_ids, "entity_id", "left_semi").select("entity_id", F.col("obj_id").alias("id")).distinct()
    out = first.withColumns({"hop": F.lit(1), "via": F.lit(None).cast("string"), "via_rel": F.lit(None).cast("string")})
    if max_hops < 2:
        return out
    next_ = first.join(adjacency(edges), "id").select("entity_id", F.col("id").alias("via"), F.col("rel_type").alias("via_rel"), F.col("other").alias("id"))
    best = next_.groupBy("entity_id", "id").agg(F.min(F.struct("via", "via_rel")).alias("v"))  # the smallest discoverer, combined before the shuffle
    best = best.join(first, ["entity_id", "id"], "left_anti").select("entity_id", "id", F.lit(2).alias("hop"), "v.via", "v.via_rel")
    return out.unionByName(best)


def project_overview(objects: DataFrame, edges: DataFrame, mentions: DataFrame, entities: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, outgoing edges, mentioned entities) of a project."""
    own = objects.where(F.col("project") == project)
    ids = own.select("id")
    out = edges.join(ids, edges.src == ids.id, "left_semi").where("rel_type <> 'mentions'")
    seen = mentions.join(ids, mentions.obj_id == ids.id, "left_semi").select("entity_id")
    return own, out, entities.join(seen, entities.id == seen.entity_id, "left_semi")


@dataclass(frozen=True)
class Rule:
    """name, and the relationship that it adds; `kind`: transitive, symmetric or inverse of `source`."""

    name: str
    kind: str
    target: str
    source: str

    def derive(self, facts: DataFrame, delta: DataFrame) -> DataFrame:
        """(src, rel_type, dst) that follow when at least one premise is in delta."""
        pick = lambda df: df.where(F.col("rel_type") == self.source).select("src", "dst")
        if self.kind == "transitive":
            a, b = pick(facts), pick(delta)
            step = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))
            new = step(a, b).unionByName(step(b, a)).where("src <> dst")
        else:
            new = pick(delta).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return new.distinct().select("src", F.lit(self.target).alias("rel_type"), "dst")


RULES = (
    Rule("causedBy-inverse", "inverse", "ledTo", "causedBy"),
    Rule("ledTo-inverse", "inverse", "causedBy", "ledTo"),
    Rule("contradicts-symmetric", "symmetric", "contradicts", "contradicts"),
    Rule("supersedes-transitive", "transitive", "supersedes", "supersedes"),
)


def infer(edges: DataFrame, rules: Iterable[Rule] = RULES, max_iterations: int | None = None) -> tuple[DataFrame, list[dict[str, int]]]:
    """(inferred edges with their rule in inferred_by, counts per rule and iteration).

    Rules run in order, each on all that is known, until a round adds nothing, or max_iterations rounds where they are given.  A rule joins
    only what it has not seen (semi-naive): its delta is what was added since its own last turn.  A transitive rule on whose relation no other
    rule works doubles the hops as `closure` does, so a pair is not made again by each node between its ends; it adds the same in each turn.
    """
    key = ["src", "rel_type", "dst"]
    facts = cut(edges.select(*key).where("src <> dst").distinct())
    rules, rounds = list(rules), []
    pending = {r.name: facts for r in rules}
    alone = [r for r in rules if r.kind == "transitive" and r.target == r.source and all(o is r or o.target != r.source for o in rules)]
    found = {r.name: [stored(facts.where(F.col("rel_type") == r.source).select("src", "dst", F.lit(1).alias("hop")), "closure")] for r in alone}
    made: DataFrame | None = None
    while max_iterations is None or len(rounds) < max_iterations:
        counts = {}
        for r in rules:
            if r.name in found:
                n = 2 ** (len(found[r.name]) - 1)
                far = _farther(found[r.name], n, 2 * n)
                counts[r.name] = far.count()
                if counts[r.name]:
                    found[r.name].append(far)
                new = far.select("src", F.lit(r.target).alias("rel_type"), "dst")
            else:
                new = cut(r.derive(facts, pending[r.name]).join(facts, key, "left_anti"))
                counts[r.name] = new.count()
            pending[r.name] = new.limit(0)
            if counts[r.name]:
                facts = cut(facts.unionByName(new))
                tagged = new.withColumn("inferred_by", F.lit(r.name))
                made = tagged if made is None else made.unionByName(tagged)
                for other in rules:
                    pending[other.name] = pending[other.name].unionByName(new)
        rounds.append(counts)
        if not sum(counts.values()):
            break
    if made is None:
        made = facts.limit(0).withColumn("inferred_by", F.lit(""))
    return made, rounds


def pending(edges: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """(rule, n): edges that each rule alone would add to the graph as it is."""
    facts = edges.select("src", "rel_type", "dst").where("src <> dst").distinct()
    out = None
    for r in rules:
        one = r.derive(facts, facts).join(facts, ["src", "rel_type", "dst"], "left_anti").agg(F.count("*").alias("n")).select(F.lit(r.name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def connections(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, ratio, bucket): ends of edges per label of their node, against the largest."""
    from graphloom.functions.scoring import size_bucket

    ends = adjacency(edges, mentions=True).select("id").join(labels.select("id", "label"), "id").groupBy("label").agg(F.count("*").alias("n"))
    ratio = F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1)))  # one row per label
    return ends.withColumn("ratio", ratio).withColumn("bucket", size_bucket(F.col("ratio")))
