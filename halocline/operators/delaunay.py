"""Adjacency of cell centres: Delaunay edges, CSR form, placement on workers.

Centre sets are small by contract (pairs.FEW) and refused beyond, never cut; what
needs all of them at once runs on the driver.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.operators.pairs import FEW

#: Squared distances that differ by less than this share are equal: centres on a common sphere.
TIE = 1e-9
#: By how much a worker's share of cells may be larger than the mean.
IMBALANCE = 0.03


def collected(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by contract."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def edges(centers: DataFrame, d: int) -> DataFrame:
    """(u, v), u < v: pairs of cells on a sphere that holds no centre inside (all pairs of a common sphere). One dimension: neighbours in order. Sets too small for a simplex are complete graphs."""
    rows = sorted(collected(centers, FEW, "centres"), key=lambda r: r["cell"])
    cells, at = [r["cell"] for r in rows], np.array([r["center"] for r in rows], float)
    n = len(rows)
    if n and d > 1:
        at = _flat(at)
    if n and at.shape[1] == 1:
        order = np.argsort(at[:, 0], kind="stable")
        found = {(min(a, b), max(a, b)) for a, b in zip(order[:-1].tolist(), order[1:].tolist())}
    elif n <= d + 1:
        found = set(combinations(range(n), 2))
    else:
        found = _empty_spheres(at)
    return centers.sparkSession.createDataFrame(sorted((cells[a], cells[b]) for a, b in found), "u int, v int")


def _flat(at: np.ndarray) -> np.ndarray:
    """The same points in as many coordinates as they span."""
    middle = at - at.mean(0)
    _, size, axes = np.linalg.svd(middle, full_matrices=False)
    rank = int((size > size.max() * 1e-10).sum()) if len(size) else 0
    return at if rank == at.shape[1] else middle @ axes[: max(rank, 1)].T


def _foot(face: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(middle, squared radius, orthonormal directions) of the smallest sphere through a face's corners, and the face's span."""
    side = face[1:] - face[0]
    if not len(side):
        return face[0], 0.0, side
    span = np.linalg.qr(side.T)[0].T
    flat = side @ span.T
    middle = np.linalg.solve(2 * flat, (flat**2).sum(1)) @ span
    return face[0] + middle, float(middle @ middle), span


def _empty_spheres(at: np.ndarray) -> set:
    """Pairs of places on spheres that hold none inside, found from simplex to simplex.

    Beyond a facet, the next corner is the one whose sphere through the facet
    reaches least far, so nothing lies inside it. The first simplex grows the same
    way from a place and its nearest. Each step looks at all places at once.
    """
    n, d = at.shape
    found: set = set()

    def sphere(middle: np.ndarray) -> None:
        d2 = ((at - middle) ** 2).sum(1)
        on = np.flatnonzero(d2 <= d2.min() * (1 + TIE))
        found.update(combinations(on.tolist(), 2))

    simplex = [0]
    while len(simplex) <= d:
        middle, r2, span = _foot(at[simplex])
        off = at - middle
        beyond = off - off @ span.T @ span if len(span) else off
        height = np.sqrt((beyond**2).sum(1))
        level = height > 1e-9 * max(height.max(), 1e-300)
        level[simplex] = False
        step = np.where(level, np.abs((off**2).sum(1) - r2) / np.where(level, 2 * height, 1), np.inf)
        simplex.append(int(step.argmin()))
    sphere(_foot(at[simplex])[0])
    open_: dict[tuple, int] = {}
    done: set = set()

    def normal(facet: tuple, span: np.ndarray) -> np.ndarray:
        return np.linalg.svd(span)[2][-1]

    def add(simplex: list[int]) -> None:
        for k, corner in enumerate(simplex):
            facet = tuple(sorted(simplex[:k] + simplex[k + 1 :]))
            if facet in done:
                continue
            if facet in open_:
                middle, _, span = _foot(at[list(facet)])
                side = normal(facet, span)
                if (at[open_[facet]] - middle) @ side * ((at[corner] - middle) @ side) < 0:
                    del open_[facet]
                    done.add(facet)
            else:
                open_[facet] = corner

    add(simplex)
    while open_:
        facet, corner = open_.popitem()
        done.add(facet)
        middle, r2, span = _foot(at[list(facet)])
        side = normal(facet, span)
        if (at[corner] - middle) @ side > 0:
            side = -side
        off = at - middle
        height = off @ side
        level = height > 1e-9 * np.abs(height).max()
        level[list(facet)] = False
        if not level.any():
            continue  # the hull
        step = np.where(level, ((off**2).sum(1) - r2) / np.where(level, 2 * height, 1), np.inf)
        new = int(step.argmin())
        sphere(middle + step[new] * side)
        add([*facet, new])
    return found


def adjacency(edges_: DataFrame) -> DataFrame:
    """(u, neighbors), both ways, sorted; vertices without edges are absent."""
    both = edges_.select("u", "v").union(edges_.select("v", "u"))
    return both.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("neighbors"))


def csr(edges_: DataFrame) -> DataFrame:
    """(u, start, end, neighbors): each vertex' slice of the concatenated neighbour lists."""
    ahead = Window.orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = adjacency(edges_)
    return lists.withColumn("end", F.sum(F.size("neighbors")).over(ahead)).select("u", (F.col("end") - F.size("neighbors")).alias("start"), "end", "neighbors")


def place(edges_: DataFrame, workers: int, how: str = "balanced") -> DataFrame:
    """(cell, worker) of the vertices with edges. single: all on 0; round_robin: in order; balanced: parts of nearly equal size (IMBALANCE) with few edges between them."""
    cells = edges_.select(F.col("u").alias("cell")).union(edges_.select("v")).distinct()
    if how == "single":
        return cells.select("cell", F.lit(0).alias("worker"))
    if how == "round_robin":
        return cells.select("cell", ((F.row_number().over(Window.orderBy("cell")) - 1) % workers).cast("int").alias("worker"))
    lists = {r["u"]: r["neighbors"] for r in sorted(collected(adjacency(edges_), FEW, "cells"), key=lambda r: r["u"])}
    return edges_.sparkSession.createDataFrame(sorted(_balanced(lists, workers).items()), "cell int, worker int")


def _balanced(lists: dict[int, list[int]], workers: int) -> dict[int, int]:
    """Parts grown breadth-first one after the other, then cells moved or swapped while that lowers the cut."""
    order: dict[int, None] = {}
    for root in lists:
        line = deque([root])
        while line:
            x = line.popleft()
            if x not in order:
                order[x] = None
                line.extend(y for y in lists[x] if y not in order)
    n = len(order)
    part = {c: i * workers // n for i, c in enumerate(order)}
    most = math.floor((1 + IMBALANCE) * math.ceil(n / workers))
    load = Counter(part.values())

    def gain(x: int, to: int) -> int:
        return sum((part[y] == to) - (part[y] == part[x]) for y in lists[x])

    for _ in range(50):
        better = False
        for x in order:
            near = sorted({part[y] for y in lists[x]} - {part[x]}, key=lambda w, x=x: (-gain(x, w), load[w], w))
            for to in near[:1]:
                won = gain(x, to)
                if (won > 0 or (won == 0 and load[to] + 1 < load[part[x]])) and load[to] < most and load[part[x]] > 1:
                    load[part[x]] -= 1
                    load[to] += 1
                    part[x], better = to, True
                elif won > 0:  # full: swap with the cell of that part which loses least
                    mates = [y for y in order if part[y] == to]
                    y = max(mates, key=lambda y, x=x: (gain(y, part[x]) - 2 * (y in lists[x]), -y))
                    if won + gain(y, part[x]) - 2 * (y in lists[x]) > 0:
                        part[x], part[y], better = part[y], part[x], True
        if not better:
            break
    return part


def edge_cut(edges_: DataFrame, placed: DataFrame) -> int:
    """How many edges join cells of different workers."""
    a, b = placed.select(F.col("cell").alias("u"), F.col("worker").alias("wu")), placed.select(F.col("cell").alias("v"), F.col("worker").alias("wv"))
    return edges_.join(a, "u").join(b, "v").where("wu <> wv").count()


def merge_tasks(edges_: DataFrame, placed: DataFrame) -> DataFrame:
    """(u, v, worker): edges inside a worker stay there, others go to the less loaded end, in the order of (u, v)."""
    where = {r["cell"]: r["worker"] for r in collected(placed, FEW, "cells")}
    load = dict.fromkeys(where.values(), 0)
    rows = []
    listed = sorted((r["u"], r["v"]) for r in collected(edges_, FEW * 100, "edges"))
    for u, v in [e for e in listed if where[e[0]] == where[e[1]]] + [e for e in listed if where[e[0]] != where[e[1]]]:
        to = min((where[u], where[v]), key=lambda w: (load[w], w))
        load[to] += 1
        rows.append((u, v, to))
    return edges_.sparkSession.createDataFrame(rows, "u int, v int, worker int")
