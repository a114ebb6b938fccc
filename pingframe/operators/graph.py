"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingframe.plans.tables import dropped, written

#: A task contracts so many links at a time (two numbers each), and that many in all are finished by one task.
CHUNK = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of the component of each): roots hook on to smaller ones, then paths are halved."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contracted(links: DataFrame, chunk: int) -> DataFrame:
    """(a, b): links with the same components, each from a node to the smallest of its own in up to `chunk` links of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= chunk:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        both = pd.concat(held)
        nodes, roots = _roots(both["a"].to_numpy(), both["b"].to_numpy())
        return pd.DataFrame({"a": nodes, "b": roots})[nodes != roots]

    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    return links.select("a", "b").mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}")


def connected(links: DataFrame, max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Connected components of links (a, b) as (node, root); root is the component's smallest node, nodes without a link are absent.

    Each partition first contracts its own links to stars. What is left is finished by one task if it has at most `chunk` links, and else
    by alternating large-star and small-star rounds: each round is two grouped minima and two joins, so no neighbour list meets in one
    task (minima combine before the shuffle, and adaptive execution can split a hot node of the joins). Links are written to the shared
    folder. Self-links, repeated links and either direction are allowed; nulls are ignored.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    now = written(_contracted(pairs, chunk), "links")
    if now.count() <= chunk:
        after = written(_contracted(now.coalesce(1), chunk), "links")
        dropped(now)
        return _labels(after)
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen:
            return _labels(now)
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        after = written(large.join(least, "a").select(turned).select("x.a", "x.b").where("a <> b").distinct(), "links")
        dropped(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labels(stars: DataFrame) -> DataFrame:
    """(node, root) of links that all lead from a node to the smallest of its component."""
    roots = stars.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
