"""Communities and bridges of small graphs, many graphs at a time.

A graph is what one person, source and window keeps: some thousand nodes at
most by construction of the kept terms. Graphs are spread over the cluster by their
key; each is solved in one Arrow-batched call.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def louvain(nodes: list[str], edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Communities of a weighted undirected graph by greedy modularity with aggregation.

    Nodes and edges are visited in sorted order, so the result is a function of
    the graph. Numbers go up from 0 in the order of the communities' first nodes.
    """
    names = sorted(set(nodes) | {x for a, b, _ in edges for x in (a, b)})
    index = {x: i for i, x in enumerate(names)}
    adjacent: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in sorted(edges):
        i, j = index[a], index[b]
        if i != j and w > 0:
            adjacent[i][j] = adjacent[i].get(j, 0.0) + w
            adjacent[j][i] = adjacent[j].get(i, 0.0) + w
    loops = [0.0] * len(names)
    member = list(range(len(names)))
    while True:
        degree = [sum(n.values()) + 2 * loops[i] for i, n in enumerate(adjacent)]
        total = sum(degree)
        if total == 0:
            break
        home = list(range(len(adjacent)))
        weight = degree[:]
        moved = True
        any_move = False
        while moved:
            moved = False
            for i, n in enumerate(adjacent):
                into: dict[int, float] = {}
                for j, w in n.items():
                    into[home[j]] = into.get(home[j], 0.0) + w
                weight[home[i]] -= degree[i]
                best, gain = home[i], into.get(home[i], 0.0) - weight[home[i]] * degree[i] / total
                for c in sorted(into):
                    g = into[c] - weight[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != home[i]:
                    home[i], moved, any_move = best, True, True
        if not any_move:
            break
        number = {c: k for k, c in enumerate(dict.fromkeys(home))}
        merged: list[dict[int, float]] = [{} for _ in number]
        merged_loops = [0.0] * len(number)
        for i, n in enumerate(adjacent):
            a = number[home[i]]
            merged_loops[a] += loops[i]
            for j, w in n.items():
                b = number[home[j]]
                if a == b:
                    merged_loops[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        member = [number[home[m]] for m in member]
        adjacent, loops = merged, merged_loops
    number = {c: k for k, c in enumerate(dict.fromkeys(member))}
    return {x: number[member[i]] for i, x in enumerate(names)}


def betweenness(edges: list[tuple[str, str]]) -> dict[str, float]:
    """Betweenness of every node of an unweighted undirected graph, each pair counted once."""
    adjacent: dict[str, set[str]] = {}
    for a, b in edges:
        if a != b:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
    score = dict.fromkeys(adjacent, 0.0)
    for source in sorted(adjacent):
        order, paths, depth = [], dict.fromkeys(adjacent, 0.0), {source: 0}
        before: dict[str, list[str]] = {}
        paths[source] = 1.0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in sorted(adjacent[x]):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
                    before.setdefault(y, []).append(x)
        share = dict.fromkeys(adjacent, 0.0)
        for x in reversed(order):
            for p in before.get(x, ()):
                share[p] += paths[p] / paths[x] * (1 + share[x])
            if x != source:
                score[x] += share[x] / 2
    return score


def communities(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, community) of each graph; nodes without an edge are communities of their own.

    ``nodes`` has (keys, node), ``edges`` (keys, s, t, count).
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    alone = nodes.select(*keys, F.col("node").alias("s"), F.col("node").alias("t"), F.lit(0.0).alias("count"))
    rows = edges.select(*keys, "s", "t", F.col("count").cast("double").alias("count")).unionByName(alone)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain(list(pdf["s"]), list(zip(pdf["s"], pdf["t"], pdf["count"])))
        return pd.DataFrame([(*key, x, c) for x, c in sorted(found.items())], columns=[*keys, "node", "community"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "node string", "community int"])
    return rows.groupBy(*keys).applyInPandas(solve, schema)


def bridges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, bridge): betweenness divided by the largest of the graph; 0 where all are 0."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = betweenness(list(zip(pdf["s"], pdf["t"])))
        top = max(found.values(), default=0.0)
        return pd.DataFrame([(*key, x, v / top if top else 0.0) for x, v in sorted(found.items())], columns=[*keys, "node", "bridge"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "node string", "bridge double"])
    return edges.select(*keys, "s", "t").groupBy(*keys).applyInPandas(solve, schema)


def community_edges(doc_terms: DataFrame, docs: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("person_id",), least: int = 2) -> DataFrame:
    """(keys, s, t, count): co-occurrence of the kept terms of each graph, all graphs at once.

    ``doc_terms`` (doc_id, term_id), ``docs`` (doc_id, keys), ``kept``
    (keys, term_id, node).
    """
    hits = docs.join(doc_terms, "doc_id").join(kept, [*keys, "term_id"]).select(*keys, "doc_id", "node")
    a, b = hits.withColumnRenamed("node", "s"), hits.withColumnRenamed("node", "t")
    pairs = a.join(b, [*keys, "doc_id"]).where("s < t")
    return pairs.groupBy(*keys, "s", "t").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
