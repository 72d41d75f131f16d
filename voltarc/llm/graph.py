"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import discard, settle

LOCAL_EDGES = 1 << 17  # edges that one task contracts to the end


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges of a task as stars."""
    return _contract(iter([pd.concat([pd.DataFrame(columns=["u", "v"]), *batches])]))


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a batch as stars around the least node of each of its parts."""
    for pdf in batches:
        head: dict = {}

        def find(x):
            while head.setdefault(x, x) != x:
                head[x] = x = head[head[x]]
            return x

        for u, v in zip(pdf["u"], pdf["v"]):
            x, y = find(u), find(v)
            if x != y:
                head[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in list(head)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v of any orderable type. Returns node, comp (the least node reachable) for
    every node of an edge.

    Tasks first contract their batches of edges to stars. Up to ``LOCAL_EDGES`` edges that are left
    then are contracted in one task. While there are more, large-star and small-star steps alternate
    until nothing changes: every node hangs its greater (then its lesser) neighbours on its
    least neighbour. A node's least neighbour is a grouped minimum, combined before the shuffle, and
    is joined back to the edges, a join that Spark splits where one node has very many; no node's
    neighbours are gathered. Each step is cut by a table in the shared folder, removed after use.
    """
    kinds = ", ".join(f"{n} {k}" for n, k in edges.select("u", "v").dtypes)
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                         F.least("u", "v").alias("v")).distinct()
    edges = settle(edges.sortWithinPartitions("v", "u").mapInPandas(_contract, kinds), "edges")
    before = None
    while True:
        if edges.count() <= LOCAL_EDGES:
            rest, edges = edges, settle(edges.coalesce(1).mapInPandas(_finish, kinds), "edges")
            discard(rest)
            break
        both = _both(edges)  # large star
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = settle(both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # small star: here always u > v
        edges = settle(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(least.select("u", F.col("m").alias("v")))
                       .where("u <> v").distinct(), "edges")
        discard(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                    .first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
