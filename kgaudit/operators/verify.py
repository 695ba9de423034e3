"""Scores a graph against a reference registry: seven checks, a gate, and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import fuzzy
from kgaudit.functions import text as tx
from kgaudit.operators import entities as en
from kgaudit.operators import graph as gr
from kgaudit.session import materialize


def coverage(entities: DataFrame, found: DataFrame) -> DataFrame:
    """total, found, missing, pct."""
    hit = entities.select(F.col("id").alias("entity_id")).join(found.select("entity_id", F.lit(1).alias("hit")).distinct(), "entity_id", "left")
    one = hit.agg(F.count("*").alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return one.select("total", "found", (F.col("total") - F.col("found")).alias("missing"), tx.percent(F.col("found"), F.col("total")).alias("pct"))


def missing(entities: DataFrame, found: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("entity_id")).join(found.select("entity_id"), "entity_id", "left_anti")


def homonym_collapse(entities: DataFrame, found: DataFrame) -> DataFrame:
    """norm_name, group_size, shared (nodes that all members match), nodes (of any), collapsed. Collapsed: a node is
    shared by all, or the whole group has a single node. A group without any node counts as separated."""
    groups = en.homonym_groups(entities).select("norm_name", "group_size", F.explode("ids").alias("entity_id"))
    per_node = groups.join(found.select("entity_id", "node_id").distinct(), "entity_id", "left").groupBy("norm_name", "group_size", "node_id").agg(F.count("*").alias("n"))
    shared = F.sum(F.when(F.col("node_id").isNotNull() & (F.col("n") == F.col("group_size")), 1).otherwise(0))
    out = per_node.groupBy("norm_name", "group_size").agg(shared.alias("shared"), F.count("node_id").alias("nodes"))
    return out.withColumn("collapsed", (F.col("shared") > 0) | (F.col("nodes") == 1))


def alias_splits(found: DataFrame) -> DataFrame:
    """entity_id, nodes of entities that match several nodes."""
    return found.groupBy("entity_id").agg(F.count_distinct("node_id").alias("nodes")).filter("nodes > 1")


def _pairs(links: DataFrame, found: DataFrame, a: str, b: str) -> DataFrame:
    """Each link with each pair of nodes that its ends match."""
    x = found.select(F.col("entity_id").alias(a), F.col("node_id").alias("x")).distinct()
    y = found.select(F.col("entity_id").alias(b), F.col("node_id").alias("y")).distinct()
    return links.join(x, a, "left").join(y, b, "left")


def _reach(pairs: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs with direct (an edge joins them), connected (same component or same node) and hops (shortest path)."""
    e = gr.canonical(edges).withColumn("edge", F.lit(True))
    cx, cy = parts.select(F.col("node").alias("x"), F.col("component").alias("cx")), parts.select(F.col("node").alias("y"), F.col("component").alias("cy"))
    out = pairs.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")}).join(e, (F.col("lo") == F.col("src")) & (F.col("hi") == F.col("dst")), "left")
    out = out.join(cx, "x", "left").join(cy, "y", "left")
    joined = F.coalesce((F.col("x") == F.col("y")) | (F.col("cx") == F.col("cy")), F.lit(False))
    out = materialize(out.withColumns({"direct": F.coalesce("edge", F.lit(False)), "connected": joined}).drop("src", "dst", "edge", "lo", "hi", "cx", "cy"), "reach")
    wanted = out.filter("connected").select(F.col("x").alias("source"), F.col("y").alias("node"))
    far = gr.distances(edges, wanted, wanted)
    return out.join(far.select(F.col("source").alias("x"), F.col("node").alias("y"), "hops"), ["x", "y"], "left")


def hierarchy(links: DataFrame, found: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """parent_id, child_id, level, covered, direct, collapsed_pairs, hops for each link. Pairs of one node don't cover
    a link; they are counted."""
    links = links.select("parent_id", "child_id", F.coalesce("level", F.lit(1)).alias("level"))
    each = _reach(_pairs(links, found, "parent_id", "child_id"), edges, parts)
    other = F.coalesce(F.col("x") != F.col("y"), F.lit(False))
    return each.groupBy("parent_id", "child_id", "level").agg(F.bool_or(other & F.col("connected")).alias("covered"), F.bool_or(other & F.col("direct")).alias("direct"), F.count_if(F.col("x") == F.col("y")).alias("collapsed_pairs"), F.min(F.when(other, F.col("hops"))).alias("hops"))


def hierarchy_summary(per_link: DataFrame) -> DataFrame:
    one = per_link.agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"), F.count_if("direct").alias("direct"), F.coalesce(F.sum("collapsed_pairs"), F.lit(0)).alias("collapsed_pairs"), F.count_if(F.col("collapsed_pairs") > 0).alias("collapsed_links"), F.coalesce(F.max(F.when(F.col("covered"), F.col("level"))), F.lit(0)).alias("max_level"))
    return one.withColumn("pct", tx.percent(F.col("covered"), F.col("total")))


def multi_hop(links: DataFrame, found: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """grandparent_id, parent_id, child_id, reachable, strict, hops. `strict` leaves out pairs of one node."""
    triples = gr.two_hops(links)
    each = _reach(_pairs(triples.select("grandparent_id", F.col("child_id")).distinct(), found, "grandparent_id", "child_id"), edges, parts)
    other = F.coalesce(F.col("x") != F.col("y"), F.lit(False))
    per = each.groupBy("grandparent_id", "child_id").agg(F.bool_or("connected").alias("reachable"), F.bool_or(F.col("connected") & other).alias("strict"), F.min(F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("hops"))).alias("hops"))
    return triples.join(per, ["grandparent_id", "child_id"])


def multi_hop_summary(per_triple: DataFrame) -> DataFrame:
    one = per_triple.agg(F.count("*").alias("total"), F.count_if("reachable").alias("reachable"), F.count_if("strict").alias("strict"))
    return one.withColumn("pct", tx.percent(F.col("reachable"), F.col("total"), 100.0))


def timeline(participants: DataFrame, found: DataFrame, parts: DataFrame) -> DataFrame:
    """event_id, nodes, connected (two of its nodes lie in one component), is_covered (connected), counted (connected,
    or a single node). No pairs: two nodes share a component iff there are fewer components than nodes."""
    hits = participants.join(found.select("entity_id", "node_id"), "entity_id", "left").select("event_id", "node_id").distinct()
    hits = hits.join(parts.select(F.col("node").alias("node_id"), "component"), "node_id", "left")
    per = hits.groupBy("event_id").agg(F.count("node_id").alias("nodes"), F.count_distinct(F.coalesce("component", "node_id")).alias("parts"))
    connected = F.col("nodes") > F.col("parts")
    return per.select("event_id", "nodes", connected.alias("is_covered"), (connected | (F.col("nodes") == 1)).alias("counted"))


def timeline_summary(per_event: DataFrame) -> DataFrame:
    one = per_event.agg(F.count("*").alias("total"), F.count_if("counted").alias("counted"), F.count_if("is_covered").alias("covered"))
    return one.withColumn("pct", tx.percent(F.col("counted"), F.col("total")))


def contributions(nodes: DataFrame, edges: DataFrame, narrators: DataFrame) -> DataFrame:
    """narrator, nodes, edges: how many distinct nodes and undirected edges its documents gave; `unknown` for files
    without narrator. narrators: file, narrator."""

    def per(df: DataFrame, key: list, name: str) -> DataFrame:
        files = df.select(*key, F.explode(tx.unpack("file_path")).alias("path")).withColumn("file", tx.basename("path"))
        return files.join(narrators, "file", "left").groupBy(F.coalesce("narrator", F.lit("unknown")).alias("narrator")).agg(F.count_distinct(F.struct(*[F.col(f"k{i}") for i in range(len(key))])).alias(name))

    n = per(nodes, [F.col("node_id").alias("k0")], "nodes")
    e = per(edges, [F.least("src", "dst").alias("k0"), F.greatest("src", "dst").alias("k1")], "edges")
    return n.join(e, "narrator", "full").select("narrator", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def mention_scores(mentions: DataFrame) -> DataFrame:
    """split, tp, fp, fn, precision, recall from rows (split, expected, actual) of booleans."""
    e, a = F.col("expected"), F.col("actual")
    one = mentions.groupBy("split").agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"))
    return one.withColumns({"precision": tx.percent(F.col("tp"), F.col("tp") + F.col("fp")), "recall": tx.percent(F.col("tp"), F.col("tp") + F.col("fn"))})


@dataclass
class Report:
    """One table for each check, and a summary row."""

    matches: DataFrame
    coverage: DataFrame
    missing: DataFrame
    homonyms: DataFrame
    splits: DataFrame
    hierarchy: DataFrame
    multi_hop: DataFrame
    isolated: DataFrame
    dead_ends: DataFrame
    timeline: DataFrame
    contributions: DataFrame
    summary: DataFrame

    def to_json(self) -> str:
        """The whole report as one JSON document; meant for reports of registry size."""
        import json

        return json.dumps({k: [json.loads(r) for r in getattr(self, k).toJSON().collect()] for k in self.__dataclass_fields__}, ensure_ascii=False, indent=2)

    def text(self, verbose: bool = False) -> str:
        """The report to read, in eight blocks: gate, coverage, homonyms, splits, hierarchy, multi-hop with sparse nodes,
        timeline, narrators. For reports of registry size; lists of single cases only with verbose."""
        rows = lambda df, *by: df.orderBy(*by).collect() if verbose else []
        s, c = self.summary.first().asDict(), self.coverage.first()
        h, m, t = hierarchy_summary(self.hierarchy).first(), multi_hop_summary(self.multi_hop).first(), timeline_summary(self.timeline).first()
        sparse = self.dead_ends.orderBy("node_id").limit(10).collect()
        out = [f"{'PASS' if s['passed'] else 'FAIL'}", *[f"{k}: {v}" for k, v in s.items() if k != "passed"]]
        out += ["", f"coverage: {c['pct']} % ({c['found']} of {c['total']})", *[f"  missing: {r['entity_id']}" for r in rows(self.missing, "entity_id")]]
        out += ["", f"homonym groups: {s['separated']} separated, {s['collapsed']} collapsed", *[f"  {r['norm_name']}: {r['group_size']} entities, {r['nodes']} nodes, {'collapsed' if r['collapsed'] else 'separated'}" for r in rows(self.homonyms, "norm_name")]]
        out += ["", f"entities of several nodes: {self.splits.count()}", *[f"  split: {r['entity_id']} ({r['nodes']} nodes)" for r in rows(self.splits, "entity_id")]]
        out += ["", f"hierarchy: {h['pct']} % ({h['covered']} of {h['total']}, {h['direct']} direct), deepest level {h['max_level']}, {h['collapsed_links']} links within a node", *[f"  open: {r['parent_id']} - {r['child_id']}" for r in rows(self.hierarchy.filter("not coalesce(covered, false)"), "parent_id", "child_id")]]
        out += ["", f"two hops: {m['pct']} % ({m['reachable']} of {m['total']}, {m['strict']} between different nodes)", *[f"  out of reach: {r['grandparent_id']} - {r['parent_id']} - {r['child_id']}" for r in rows(self.multi_hop.filter("not coalesce(reachable, false)"), "grandparent_id", "parent_id", "child_id")]]
        out += [f"  without edges: {self.isolated.count()}, with one: {self.dead_ends.count()}", *([f"  sparse: {r['node_id']} - {r['neighbour']}" for r in sparse] if verbose else [])]
        out += ["", f"timeline: {t['pct']} % ({t['counted']} of {t['total']}, {t['covered']} by connected nodes)", *[f"  open: {r['event_id']}" for r in rows(self.timeline.filter("not counted"), "event_id")]]
        out += ["", "narrators:", *[f"  {r['narrator']}: {r['nodes']} nodes, {r['edges']} edges" for r in self.contributions.orderBy("narrator").collect()]]
        return "\n".join(out)


def run(entities: DataFrame, links: DataFrame, participants: DataFrame, nodes: DataFrame, edges: DataFrame, narrators: DataFrame, threshold: float = fuzzy.THRESHOLD, least_coverage: float = 70.0, least_hierarchy: float = 50.0) -> Report:
    """All checks. The matches are written once, since six checks read them."""
    found = materialize(fuzzy.match(en.names(entities), nodes, threshold), "matches")
    parts = materialize(gr.components(edges, nodes.select(F.col("node_id").alias("node"))), "components")
    cover, homonyms = coverage(entities, found), homonym_collapse(entities, found)
    per_link, per_triple, per_event = hierarchy(links, found, edges, parts), multi_hop(links, found, edges, parts), timeline(participants, found, parts)
    one = cover.select(F.col("pct").alias("entity_pct")).crossJoin(homonyms.agg(F.count_if("collapsed").alias("collapsed"), F.count_if(~F.col("collapsed")).alias("separated")))  # rows of summaries
    one = one.crossJoin(hierarchy_summary(per_link).select(F.col("pct").alias("hierarchy_pct"), "max_level"))
    one = one.crossJoin(multi_hop_summary(per_triple).select(F.col("pct").alias("multi_hop_pct"))).crossJoin(timeline_summary(per_event).select(F.col("pct").alias("timeline_pct")))
    passed = (F.col("entity_pct") >= least_coverage) & (F.col("collapsed") == 0) & (F.col("hierarchy_pct") >= least_hierarchy)
    return Report(found, cover, missing(entities, found), homonyms, alias_splits(found), per_link, per_triple, gr.isolated(nodes, edges), gr.dead_ends(nodes, edges), per_event, contributions(nodes, edges, narrators), one.withColumn("passed", passed))
