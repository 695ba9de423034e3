"""Undirected graphs as edge tables: components, distances, degrees, expansion, node merge and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.session import discard, materialize


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each undirected edge once, the smaller end first."""
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """node, component: the least node that each node is connected with. Each round a node takes the least label
    around it and then the label of its label, so chains shorten by halves; a round's labels are a written table, so
    plans stay short and lost executors cost one round. Minima are summed up before the shuffle, so a node of very many
    edges is no hot group. Nodes without edges are their own component; loops are ignored."""
    pairs = materialize(both_ways(edges.filter("src is not null and dst is not null and src <> dst")), "edges")
    ends = pairs.select(F.col("src").alias("node"))
    ends = ends.unionByName(nodes.select("node").filter("node is not null")) if nodes is not None else ends
    # the first labels need no join: the least neighbour, or the node itself
    least = pairs.groupBy(F.col("src").alias("n")).agg(F.min("dst").alias("m"))
    labels = ends.distinct().join(least, F.col("node") == F.col("n"), "left").select("node", F.least("node", "m").alias("label"))
    labels = table = materialize(labels, "labels")
    for _ in range(max_rounds):
        seen = pairs.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("n")).agg(F.min("label").alias("m"))
        new = labels.join(seen, F.col("node") == F.col("n"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = new.join(up, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", "up_label").alias("label"))
        old, table = table, materialize(new, "labels")
        discard(old)
        if table.filter("label <> old").limit(1).count() == 0:
            discard(pairs)
            out = table.select("node", F.col("label").alias("component"))
            out.written_to = table.written_to  # so that it can be discarded
            return out
        labels = table.select("node", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree, neighbour (the least one): a loop counts twice, as is usual. Nodes without edges have 0."""
    e = canonical(edges)
    ends = e.select(F.col("src").alias("n"), F.col("dst").alias("m")).union(e.select(F.col("dst").alias("n"), F.col("src").alias("m")))
    per = ends.groupBy("n").agg(F.count("*").alias("degree"), F.min("m").alias("neighbour"))
    return nodes.select("node_id").join(per, F.col("node_id") == F.col("n"), "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "neighbour")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).filter("degree = 0").select("node_id")


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).filter("degree = 1").select("node_id", "neighbour")


def distances(edges: DataFrame, sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """source, node, hops: breadth-first distances from each source, level by level, until there are no new nodes. Each
    level is a written table and meets the graph in one join; nodes seen before are taken out by an anti join.

    With `wanted` (source, node) only those pairs are given, and a source goes no further once all of its own are
    found: the rows are those of the levels up to the farthest wanted node of each source, not all pairs."""
    pairs = materialize(both_ways(edges.filter("src <> dst")), "edges")
    pair = ["source", "node"]
    asked = None if wanted is None else materialize(wanted.select(*pair).distinct(), "bfs-asked")
    open_, start = asked, (sources if asked is None else asked).select("source").distinct()
    level = materialize(start.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")), "bfs")
    seen, hop = level, 0
    while level.limit(1).count():
        hop += 1
        if open_ is not None:
            open_ = materialize(open_.join(level.select(*pair), pair, "left_anti"), "bfs-open")
            level = level.join(open_.select("source").distinct(), "source", "left_semi")
        new = level.join(pairs, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        level = materialize(new.join(seen.select(*pair), pair, "left_anti").withColumn("hops", F.lit(hop)), "bfs")
        seen = seen.unionByName(level)
    discard(pairs)
    return seen if asked is None else seen.join(asked, pair, "left_semi")


def two_hops(links: DataFrame) -> DataFrame:
    """grandparent, parent, child of each pair of links that meet; doubles stay."""
    a, b = links.alias("a"), links.alias("b")
    return a.join(b, F.col("a.child_id") == F.col("b.parent_id")).select(F.col("a.parent_id").alias("grandparent_id"), F.col("a.child_id").alias("parent_id"), F.col("b.child_id").alias("child_id"))


#: Rows of split specifications up to which they are broadcast.
SMALL = 10_000
_PACKED = ("description", "keywords", "source_id", "file_path")


def _merged(column: str) -> Column:
    """Parts of packed lists of a group, in the order of `ord`, each once."""
    from kgaudit.functions.text import SEP, unpack

    sorted_rows = F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), unpack(column).alias("p"))))
    return F.array_join(F.array_distinct(F.flatten(F.transform(sorted_rows, lambda x: x["p"]))), SEP)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges made one: weights (1 if missing) add up, packed lists join. Loops are dropped. Needs `ord`."""
    packed = [c for c in _PACKED if c in edges.columns]
    e = edges.filter("src <> dst").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), *[_merged(c).alias(c) for c in packed])


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of one id made one: packed lists join, the first type that isn't empty stays. Needs `ord`."""
    packed = [c for c in _PACKED if c in nodes.columns]
    kind = F.min(F.when(F.coalesce("entity_type", F.lit("")) != "", F.struct("ord", "entity_type")))["entity_type"]
    return nodes.groupBy("node_id").agg(kind.alias("entity_type"), *[_merged(c).alias(c) for c in packed])


def merge_aliases(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges with alias nodes renamed to their canonical name (norm, canonical), and the renames made."""
    from kgaudit.functions.text import normalize

    rename = nodes.select("node_id", normalize("node_id").alias("norm")).join(aliases.select("norm", "canonical"), "norm").filter("node_id <> canonical").select(F.col("node_id").alias("old"), "canonical")
    to = lambda df, c: df.join(rename, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("canonical", c)).drop("old", "canonical")
    return merge_nodes(to(nodes, "node_id")), merge_edges(to(to(edges, "src"), "dst")), rename


def split_nodes(nodes: DataFrame, edges: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Homonym nodes split into targets. specs: norm, target, target_ord, keywords. An edge goes to the target of which
    most keywords occur in its text; of equals, and if none occurs, to the first. Targets of one node are tied by an
    edge `incident` of weight 1."""
    from kgaudit.functions.text import normalize

    homonyms = nodes.withColumn("norm", normalize("node_id")).join(specs.select("norm").distinct(), "norm", "left_semi")
    goals = homonyms.select("node_id", "norm").join(specs, "norm")
    new_nodes = nodes.join(homonyms.select("node_id"), "node_id", "left_anti").unionByName(nodes.join(goals.select("node_id", "target"), "node_id").withColumn("node_id", F.col("target")).drop("target"))

    # an edge meets one row for each homonym at its ends; edges may have columns of any name
    words = F.transform("keywords", lambda k: normalize(k))
    to = goals.groupBy(F.col("node_id").alias("__node")).agg(F.collect_list(F.struct((-F.col("target_ord")).alias("ord"), F.col("target").alias("target"), words.alias("words"))).alias("__goals"))
    if specs.limit(SMALL + 1).count() <= SMALL:  # then an edge needn't move to its homonym, which may be an end of very many
        to = F.broadcast(to)

    def redirect(e: DataFrame, end: str) -> DataFrame:
        text = normalize(F.concat_ws(" ", *[F.col(c) for c in _PACKED if c in e.columns], "src", "dst"))
        hits = lambda t, g: F.size(F.filter(g["words"], lambda k: F.contains(t, k)))
        best = lambda t: F.array_max(F.transform("__goals", lambda g: F.struct(hits(t, g).alias("n"), g["ord"].alias("ord"), g["target"].alias("target"))))["target"]
        near = e.join(to, F.col(end) == F.col("__node"), "left")
        moved = F.when(F.col("__goals").isNotNull(), F.transform(F.array(text), best)[0])  # the text is bound first: made once
        return near.withColumn(end, F.coalesce(moved, end)).select(e.columns)

    moved = redirect(redirect(edges, "src"), "dst")
    a, b = goals.alias("a"), goals.alias("b")
    tied = a.join(b, (F.col("a.node_id") == F.col("b.node_id")) & (F.col("a.target_ord") < F.col("b.target_ord"))).select(F.col("a.target").alias("src"), F.col("b.target").alias("dst"), F.lit(1.0).alias("weight"), F.lit("incident").alias("keywords"))
    return new_nodes, merge_edges(moved.unionByName(tied.withColumn("ord", F.lit(1 << 40)), allowMissingColumns=True))


def disambiguate(nodes: DataFrame, edges: DataFrame, specs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Homonyms split, then aliases merged: nodes, edges, one row of totals. Names that the split made are no aliases
    of what was split, so the merge can't undo it."""
    from kgaudit.functions.text import normalize

    made = specs.select(normalize("target").alias("norm")).union(specs.select("norm")).distinct()
    split, between = split_nodes(nodes, edges, specs)
    between = between.withColumn("ord", F.monotonically_increasing_id())
    out_nodes, out_edges, renames = merge_aliases(split, between, aliases.join(made, "norm", "left_anti"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    totals = count(specs.select("norm").distinct(), "homonyms").crossJoin(count(renames, "renamed")).crossJoin(count(out_nodes, "nodes")).crossJoin(count(out_edges, "edges"))  # a row each
    return out_nodes, out_edges, totals
