"""Graphs of similar items: edges between owned items, components, cluster report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.functions.text import url_key
from offerlens.operators.skew import join_once
from offerlens.sources.storage import discard, written, written_with_state


def owned_edges(similar: DataFrame, items: DataFrame, item: str = "item_id", url: str = "url") -> DataFrame:
    """Directed (src, dst) between owned items whose url a similar entry names; the last item of equal urls counts, no loops."""
    by_url = items.groupBy(url_key(F.col(url)).alias("__u")).agg(F.max(item).alias("dst"))
    out = similar.select(F.col(item).alias("src"), url_key(F.col(url)).alias("__u")).join(by_url, "__u")
    return out.where("src <> dst").select("src", "dst").distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, of edges that stand in both directions."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def cluster_edges(edges: DataFrame) -> DataFrame:
    """The mutual edges if there are any at all, else every edge without its direction. `edges` are written once, being read several times."""
    edges = written(edges.select("src", "dst"))
    both = mutual(edges).withColumn("mutual", F.lit(True))
    all_ = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("mutual", F.lit(False))
    any_mutual = both.limit(1).select(F.lit(True).alias("__any"), F.lit(1).alias("__k"))
    flag = all_.sparkSession.range(1).select(F.lit(1).alias("__k")).join(any_mutual, "__k", "left").select(F.coalesce("__any", F.lit(False)).alias("__any"), "__k")
    return both.unionByName(all_).withColumn("__k", F.lit(1)).join(F.broadcast(flag), "__k").where("mutual = __any").select("a", "b")


#: Edges up to which one node may have them all: a task sorts so many pairs of numbers with ease.
HUB_EDGES = 1_000_000


def _stars(edges: DataFrame, small: bool, hubs: bool) -> DataFrame:
    """Each node's neighbours (small: the smaller ones and itself; else the larger ones) get linked to the least of all."""
    meet = (lambda x, y: join_once(x, y, ["a"])) if hubs else (lambda x, y: x.join(y.drop("n"), "a"))
    ends = edges.select("a", "b") if small else edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:  # a > b: the least neighbour takes the others and the node itself
        least = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = meet(ends, least).select(F.col("b").alias("x"), "m").unionAll(least.select(F.col("a").alias("x"), "m"))
    else:
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        moved = meet(ends.where("b > a"), least).select(F.col("b").alias("x"), "m")
    return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


#: Edges of a graph that one task may have whole: two columns of a few megabytes.
FEW_EDGES = 100_000


def _components_of_few(edges: DataFrame) -> DataFrame:
    """(node, component) of at most FEW_EDGES edges, in one task: the greater root of an edge takes the smaller one, until all edges agree."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=object), *batches])
        if rows.empty:
            return
        names, at = np.unique(np.concatenate([rows["a"].to_numpy(object), rows["b"].to_numpy(object)]), return_inverse=True)
        x, y, root = at[: len(rows)], at[len(rows) :], np.arange(len(names))
        while (root[x] != root[y]).any():
            np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
            while (root[root] != root).any():
                root = root[root]
        yield pd.DataFrame({"node": names, "component": names[root]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(find, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge. Nodes are whole numbers, strings or bytes.

    Alternating large and small stars: only minima and joins on unique sides; where there are more than HUB_EDGES edges, the
    rows of a node with very many of them are not brought together (`join_once`). Rows with a null end and loops are ignored; an edge repeated or turned round counts
    once. A graph of no more than `few` edges (FEW_EDGES at most) is done in one task. Every round is written to the shared folder, the one before it deleted, and rounds end when the edges no longer change.
    """
    x, y = (F.col(c) if edges.schema[c].dataType.typeName() in ("binary", "string") else F.col(c).cast("long") for c in (a, b))
    first = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges, was = written_with_state(first, "a", "b")
    if was[0] <= min(few, FEW_EDGES):
        return _components_of_few(edges)
    while was[0]:
        before, hubs = edges, was[0] > HUB_EDGES
        edges, now = written_with_state(_stars(_stars(edges, False, hubs), True, hubs), "a", "b")
        discard(before)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def update_components(parts: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """`connected_components` after a change, from the one before it: `edges` are those before, `added` and `removed` undirected (a, b) edges.

    Components that lose an edge are computed again from their own edges alone; then the new edges join components by their labels, a graph as large as the
    change. A component's label is its smallest node, so the least label of those that join is the new one.
    """
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    lost = pair(removed).join(pair(added), ["a", "b"], "left_anti").join(pair(edges), ["a", "b"], "left_semi")
    broken = parts.join(lost.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    inside = parts.join(broken, "component", "left_semi").select("node")
    again = pair(edges).join(lost, ["a", "b"], "left_anti").join(inside.withColumnRenamed("node", "a"), "a", "left_semi")
    base = parts.join(broken, "component", "left_anti").select("node", "component").unionByName(connected_components(again))
    base = written_with_state(base, "node", "component")[0]
    label = lambda c: base.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    new = pair(added).join(label("a"), "a", "left").join(label("b"), "b", "left").select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
    joined = connected_components(new, "x", "y").withColumnRenamed("component", "__to")
    moved = base.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    ends = new.select(F.col("a").alias("node"), F.col("x").alias("label")).unionByName(new.select(F.col("b").alias("node"), F.col("y").alias("label"))).distinct()
    fresh = ends.join(base.select("node"), "node", "left_anti").join(joined.withColumnRenamed("node", "label"), "label", "left")
    return moved.unionByName(fresh.select("node", F.coalesce("__to", "label").alias("component")))


def cluster_report(edges: DataFrame, items: DataFrame, item: str = "item_id", name: str = "name", clusters: int = 6, nodes: int = 8) -> DataFrame:
    """The largest clusters (by edges, then members, then smallest node), with their nodes by degree, then name, both from above.

    Columns: cluster, component, members, edge_count, number, node, degree. Members and edges count the whole cluster.
    """
    edges = written(edges.select("a", "b"))
    parts = connected_components(edges, few=FEW_EDGES)
    degree = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    nodes_ = parts.join(degree, "node")
    sizes = nodes_.groupBy("component").agg(F.count("*").alias("members"), (F.sum("degree") / 2).cast("long").alias("edge_count"))
    top = sizes.orderBy(F.desc("edge_count"), F.desc("members"), "component").limit(clusters)
    top = top.withColumn("cluster", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("edge_count"), F.desc("members"), "component")))  # few rows
    named = nodes_.join(F.broadcast(top), "component").join(items.select(F.col(item).alias("node"), F.col(name).alias("__name")), "node")
    w = W.partitionBy("component").orderBy(F.desc("degree"), F.desc("__name"), "node")
    return named.withColumn("number", F.row_number().over(w)).where(F.col("number") <= nodes).select("cluster", "component", "members", "edge_count", "number", "node", "degree")


def visible_edges(report: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes that the report shows, by their numbers, in order."""
    r = report.select("cluster", "node", "number")
    out = edges.join(r.select(F.col("node").alias("a"), "cluster", F.col("number").alias("source_number")), "a")
    out = out.join(r.select(F.col("node").alias("b"), F.col("cluster").alias("__c"), F.col("number").alias("target_number")), "b").where("cluster = __c")
    return out.select("cluster", "a", "b", "source_number", "target_number").orderBy("cluster", "a", "b")
