"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum by node and a join on the node; no node's neighbours are gathered, and
a hub's edges are dealt out over many tasks. Each round is written to the shared folder, where a lost executor's
work survives. The rounds end when every edge points at a node that points at none.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import join_facts, materialise


def _large_star(edges: DataFrame, n: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = write(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    return join_facts(both, low, "u", "n", 2 * n, ["v"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = write(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = join_facts(down, low, "u", "n", n, ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved)


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int | None = None, small_plans: bool = False) -> DataFrame:
    """node, root for every node of edges (u, v) that isn't the least of its component; root is that least.

    task_edges: edges of a task at least, so that a small graph on many partitions takes few tasks a step.
    small_plans: what a round reads more than once is written, too, so that no plan holds a round: the driver needs less memory
    for plans, and nothing is computed twice.

    Nodes of any orderable type; edges with a null end and loops link nothing; repeated edges count once;
    no edges give an empty table.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    few = lambda df, n: df if task_edges is None else df.coalesce(max(8, n // task_edges))
    now = materialise(now, "edges")
    write = lambda df, n: materialise(few(df, n), "stars") if small_plans else df
    for _ in range(most_rounds):
        # a forest of stars: each node has one edge, and no root has one
        state = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if state["n"] == 0:
            break
        if state["n"] == state["d"] and few(now.join(now.select(F.col("u").alias("v")), "v", "left_semi"), state["n"]).isEmpty():
            break
        n = state["n"]
        step = functools.partial(write, n=n)
        large = step(few(_large_star(now, n, step), n))
        now = materialise(few(few(_small_star(large, n, step), n).distinct(), n), "edges")
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
