"""Recursive operators over directed edges: closure of supersession, nodes on cycles, greedy cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut


def superseded(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes (node) that are out of date: the seeds, and what follows from them.

    edges has source, target, relation. A source that is superseded takes its targets with it over any relation; a target
    that is superseded takes along the sources that amend or update it. Rounds run until no node is new; each round joins
    only the new nodes and its lineage is cut in the shared folder. Null ends are ignored; cycles end by themselves;
    there are at most as many rounds as nodes.
    """
    e = cut(edges.select("source", "target", "relation").where("source is not null and target is not null").distinct())
    known = new = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct())
    while True:
        down = new.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node"))
        up = new.join(e.where(F.col("relation").isin("amends", "focused_update")), F.col("node") == F.col("target")).select(F.col("source").alias("node"))
        new = cut(down.unionByName(up).distinct().join(known, "node", "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


def cyclic_nodes(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Nodes (node) that lie on a cycle or between two: what is left after nodes without edges in or out were taken away.

    Each round takes away an edge at least, so the rounds end.
    """
    left = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct())
    n = left.count()
    while True:
        both = left.select("s").distinct().join(left.select("t").distinct(), F.col("s") == F.col("t")).select(F.col("s").alias("node"))
        kept = left.join(both, F.col("s") == F.col("node"), "left_semi").join(both, F.col("t") == F.col("node"), "left_semi")
        left = cut(kept)
        m = left.count()
        if m == n:
            return left.select(F.col("s").alias("node")).distinct()
        n = m


def greedy_cover(scopes: DataFrame, item: str, scope: str, priority: str, limit: int = 100) -> list[tuple]:
    """Items (item, priority) that cover all scopes, chosen greedily: most new scopes, then priority, then name.

    Covers are chosen on the driver from at most limit items; more are refused, as the choice is one after another.
    """
    rows = scopes.groupBy(item).agg(F.min(priority).alias("p"), F.collect_set(scope).alias("s")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} items")
    left = {x for r in rows for x in r["s"]}
    chosen = []
    while left:
        best = min(rows, key=lambda r: (-len(left & set(r["s"])), r["p"], r[item]))
        left -= set(best["s"])
        chosen.append((best[item], best["p"]))
    return sorted(chosen, key=lambda c: (c[1], c[0]))
