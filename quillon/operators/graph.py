"""Graph traversal over edge tables by joins of a frontier.

Each level is a join of the frontier with the edges and an anti-join with what was
seen; levels are checkpointed to the shared folder, so plans stay short and survive
lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed as _kept

MAX_DEPTH, MAX_NODES = 32, 10_000


def directed(edges: DataFrame, direction: str = "out", labels: list[str] | None = None, weights: tuple[float, float] | None = None) -> DataFrame:
    """src, dst and weight of the edges that may be followed."""
    if labels is not None:
        edges = edges.where(F.col("label").isin(labels))
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    if weights:
        edges = edges.where(weight.between(*weights))
    out = edges.select("src", "dst", weight.alias("weight"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = MAX_DEPTH, max_nodes: int | None = None) -> DataFrame:
    """node and depth of what the seeds (column node) reach."""
    seen = frontier = _kept(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    total = seen.count()
    for depth in range(1, hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = _kept(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        n = frontier.count()
        if not n:
            break
        seen = seen.union(frontier)
        total += n
        if max_nodes and total >= max_nodes:
            return seen.orderBy("depth", "node").limit(max_nodes)
    return seen


def shortest_distances(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, distance and parent by relaxation; negative edges are not followed."""
    edges = edges.where("weight >= 0")
    best = _kept(seeds.select("node").distinct().select("node", F.lit(0.0).alias("distance"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")))
    changed = best
    for _ in range(rounds):
        reach = changed.join(edges, changed["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("parent"))
        reach = reach.groupBy("node").agg(F.min(F.struct("distance", "parent")).alias("s")).select("node", "s.distance", "s.parent")
        old = best.select("node", F.col("distance").alias("before"))
        changed = _kept(reach.join(old, "node", "left").where("before IS NULL OR distance < before").drop("before"))
        if not changed.count():
            return best
        best = _kept(best.join(changed, "node", "left_anti").unionByName(changed))
    return best


def shortest_path(edges: DataFrame, start, goal, rounds: int = 1000) -> list:
    """Nodes from start to goal; empty if there is no way.  The path alone is collected."""
    kind = edges.schema["src"].dataType
    seeds = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    best = shortest_distances(edges, seeds, rounds)
    parents = best.select("node", "parent")
    # The way back by doubling: after n steps a node knows the 2 ** n nodes before it.
    row = parents.where(F.col("node") == F.lit(goal)).first()
    if row is None:
        return []
    ways = _kept(parents.where("parent IS NOT NULL").select("node", F.array("parent").alias("way")))
    path = [goal] + ([row["parent"]] if row["parent"] is not None else [])
    while path[-1] != start and row["parent"] is not None:
        found = ways.where(F.col("node") == F.lit(path[-1])).first()
        if found is None:
            break
        path += found["way"]
        if path[-1] != start:
            back = ways.select(F.col("node").alias("mid"), F.col("way").alias("more"))
            ways = _kept(ways.join(back, F.element_at("way", -1) == F.col("mid"), "left").select("node", F.concat("way", F.coalesce("more", F.array().cast(ways.schema["way"].dataType))).alias("way")))
    return path[::-1]


def two_way_hops(edges: DataFrame, start, goal, limit: int = MAX_DEPTH) -> int | None:
    """Hops of the shortest way, searched from both ends."""
    kind = edges.schema["src"].dataType
    one = lambda x: edges.sparkSession.range(1).select(F.lit(x).cast(kind).alias("node"))
    if start == goal:
        return 0
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    sides = [[edges, _kept(one(start)), _kept(one(start)), 0], [back, _kept(one(goal)), _kept(one(goal)), 0]]
    while sides[0][3] + sides[1][3] < limit:
        side = min(sides, key=lambda s: s[3])
        graph, seen, frontier, depth = side
        step = frontier.join(graph, frontier["node"] == graph["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = _kept(step.join(seen, "node", "left_anti"))
        side[1:] = [seen.union(fresh), fresh, depth + 1]
        other = sides[1] if side is sides[0] else sides[0]
        if fresh.join(other[1], "node", "left_semi").limit(1).count():
            return sides[0][3] + sides[1][3]
        if not fresh.limit(1).count():
            return None
    return None


def centrality(edges: DataFrame, fallback: float = 0.2) -> DataFrame:
    """Weighted in-degree by its maximum."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("w"))
    top = degree.agg(F.max("w").alias("top"))
    return degree.crossJoin(F.broadcast(top)).select("node", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(fallback).alias("centrality"))


def reranked(hits: DataFrame, central: DataFrame, weight: float = 1.0, fallback: float = 0.2) -> DataFrame:
    """score = 1 / (1 + depth) * (1 + weight * centrality)."""
    weight = min(max(weight, 0.0), 4.0)
    df = hits.join(central, "node", "left")
    return df.select("node", "depth", (1 / (1 + F.col("depth")) * (1 + weight * F.coalesce("centrality", F.lit(fallback)))).alias("score"))


def graph_search(nodes: DataFrame, edges: DataFrame, query: str, hops: int = 2) -> DataFrame:
    """Nodes (node, title, text) whose title or text holds the query, and what they lead to."""
    low = F.lower(F.lit(query))
    hit: Column = F.lower(F.coalesce("title", F.lit(""))).contains(low) | F.lower(F.coalesce("text", F.lit(""))).contains(low)
    return bfs(edges, nodes.where(hit), hops)


def linked_by_name(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from mentions (src, name) to the nodes of that title."""
    return mentions.join(nodes.select(F.col("title").alias("name"), F.col("node").alias("dst")), "name").select("src", "dst")


def linked_by_vector(mentions: DataFrame, targets: DataFrame, k: int, least: float, cells: int = 16, probes: int | None = None) -> DataFrame:
    """Edges (src, dst, weight) from each mention to the ``k`` targets of the greatest cosine
    similarity (up to nine decimals, ties by id), if it is ``least`` or more; both have id and vector.
    With all cells probed, as is the default, every pair counts and no index is made; else targets
    are indexed by cells."""
    from .search import IvfIndex, knn_all

    mentions, targets = mentions.select("id", "vector"), targets.select("id", "vector")
    if probes is None or probes >= cells:
        near = knn_all(targets, mentions, k, "cosine", "id", "vector", 9)
    else:
        near = IvfIndex(targets, "id", "vector", cells).search_all(mentions, k, probes, "cosine")
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), (1 - F.col("distance")).alias("weight")).where(F.col("weight") >= least)


def ingest(table: DataFrame, id_col: str, kind: str, title_col: str | None, text_col: str, headings: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a table: a node per row or, by headings, one per section under it."""
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    rows = table.select(F.concat(F.lit(f"{kind}:"), F.col(id_col).cast("string")).alias("node"), F.lit(kind).alias("kind"), title.alias("title"), F.col(text_col).alias("text"))
    if not headings:
        return rows, rows.sparkSession.createDataFrame([], "src string, dst string, label string, weight double")
    parts = rows.select("node", F.posexplode(F.split("text", r"(?m)^(?=#+ )")).alias("n", "part")).where(F.length(F.trim("part")) > 0)
    sections = parts.select(F.concat_ws("#", "node", "n").alias("node"), F.lit("section").alias("kind"), F.regexp_extract("part", r"^#+ (.*)", 1).alias("title"), F.col("part").alias("text"), F.col("node").alias("of"))
    links = sections.select(F.col("of").alias("src"), F.col("node").alias("dst"), F.lit("has_section").alias("label"), F.lit(1.0).alias("weight"))
    return rows.unionByName(sections.drop("of")), links
