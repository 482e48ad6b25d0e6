"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.session import cut

#: Edge sets up to this many are joined on the driver, which takes one job instead of several a round.
FEW_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def star_edges(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(hi, lo): every vertex that isn't its component's smallest, with that smallest one.

    Each round is two grouped minima (partial results map-side) and joins on the
    vertex, so a vertex with most edges is split like any skewed join key. Rounds
    are logarithmic in the diameter, and each is written to the shared
    checkpoint folder before the next.
    """
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = cut(pairs.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).distinct())
    before, after = None, _state(now)
    while after != before:
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(now.select("lo", "hi"))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = cut(small.select("e.*").where("hi <> lo").distinct())
        before, after = after, _state(now)
    return now


def union_find(edges: list[tuple]) -> dict:
    """Each vertex that an edge names, with the smallest vertex of its component."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", few: int = FEW_EDGES, kept: bool = False) -> DataFrame:
    """(vertex, component) of every vertex that an edge names; the component is its smallest vertex. A self-loop makes a singleton; edges with a null end count for nothing.

    ``kept`` says that the edges are materialised and distinct already.
    """
    both = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right)
    kind = both.schema[left].dataType
    if few:
        both = both if kept else cut(both.distinct())
        rows = both.limit(few + 1).collect()
        if len(rows) <= few:
            schema = T.StructType([T.StructField("vertex", kind), T.StructField("component", kind)])
            return edges.sparkSession.createDataFrame(list(union_find([tuple(r) for r in rows]).items()), schema)
    found = star_edges(both, left, right)
    vertices = both.select(F.col(left).alias("vertex")).union(both.select(F.col(right))).distinct()
    return vertices.join(found, vertices["vertex"] == found["hi"], "left").select("vertex", F.coalesce("lo", "vertex").alias("component"))
