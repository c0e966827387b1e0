"""Connected components: edges are contracted in chunks, and what is left by alternating
large-star and small-star steps.

A task takes a chunk of at most about ``CHUNK`` edges and replaces them by those from each
vertex to the least one that they lead it to: components are the same, and a large group's
many links become one a member and chunk.  Then every step is a shuffle over edges; no vertex's
neighbours are gathered in one task (a vertex of very many edges is a skewed join key, which
adaptive execution splits), and each round's edges are written to the shared folder, so
lineage stays short.  Rounds grow with the logarithm of the number of vertices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

CHUNK = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices that edges lead to a lesser one, and the least each."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for k, p in enumerate(parent):  # parents are lesser, so they are settled before
        parent[k] = parent[p]
    root = np.array(parent, np.int64)
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            u, v = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    chunks = max(1, math.ceil(edges.count() / CHUNK))
    return edges.select("u", "v").coalesce(chunks).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour is linked to the least of the neighbourhood.
    Small: every smaller neighbour, and the vertex itself, are."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pairs = both if large else both.where("v < u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    far = pairs.where("v > u") if large else pairs
    out = far.join(least, "u").select(F.col("v").alias("x"), "m")
    if not large:
        out = out.union(least.select(F.col("u").alias("x"), "m"))
    return out.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge and leads to a root, which has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` for every vertex but the roots; a root is its component's least vertex.

    ``edges`` has columns u and v, in any direction; loops and repeats are ignored.  Rounds
    end when the edges are stars around roots: another would change nothing."""
    links = written(edges.where("u <> v").select("u", "v"), "links")
    edges = written(contracted(links), "edges")
    discard(links)
    while not _settled(edges):
        before, edges = edges, written(_star(_star(edges, True), False), "edges")
        discard(before)
    return edges.select("u", F.col("v").alias("root"))
