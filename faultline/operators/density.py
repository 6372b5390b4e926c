"""Clusters and outliers by density: DBSCAN and the local outlier factor, exactly, on grids.

Points are rows of an id and numeric columns; rows with a null or non-finite coordinate or a null id
take no part.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.operators.graph import connected
from faultline.sources.scratch import saved

#: Pairs of points that are tried for two boxes; more points go into smaller boxes first.
TRIED = 4096


def _points(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(id, x): distinct ids are the caller's duty."""
    x = F.array(*[F.col(a).cast("double") for a in axes])
    return df.select(F.col(key).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))


def _square(a: str, b: str, dim: int) -> Column:
    """The squared distance of two points, axis by axis."""
    out = F.lit(0.0)
    for i in range(dim):
        d = F.col(a)[i] - F.col(b)[i]
        out = out + d * d
    return out


def _cell(x: str, side: float | Column) -> Column:
    return F.transform(x, lambda e: F.floor(e / side))


def _moved(cell: str, offsets: list[tuple[int, ...]]) -> Column:
    """The cell by each offset."""
    steps = F.lit([list(o) for o in offsets]).cast("array<array<long>>")
    return F.transform(steps, lambda o: F.zip_with(F.col(cell), o, lambda a, b: a + b))


def _touching(dim: int) -> list[tuple[int, ...]]:
    """Offsets of cells of diagonal eps that may hold points within eps."""
    reach = math.ceil(math.sqrt(dim))
    return [o for o in product(range(-reach, reach + 1), repeat=dim) if sum(max(abs(c) - 1, 0) ** 2 for c in o) <= dim]


def _boxes(points: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """For each value of keys: n, and the bounds low and high of its points."""
    end = lambda f: F.array(*[f(F.col("x")[i]) for i in range(dim)])
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), end(F.min).alias("low"), end(F.max).alias("high"))


def _joined_cells(cores: DataFrame, eps: float, side: float, dim: int) -> DataFrame:
    """(a, b), the pairs of neighbouring cells that hold core points within eps of each other.

    Pairs of boxes are decided by their bounds where these lie within eps or beyond it. Boxes with few points are tried point by point;
    others are halved along each axis, so crowded cells cost what lies near their eps border, not all of their pairs.
    """
    eps2, level = eps * eps, 0
    half = [o for o in _touching(dim) if o > (0,) * dim]
    gap = lambda i: F.greatest(F.col("low2")[i] - F.col("high")[i], F.col("low")[i] - F.col("high2")[i], F.lit(0.0))
    span = lambda i: F.greatest(F.col("high2")[i] - F.col("low")[i], F.col("high")[i] - F.col("low2")[i])
    least, most = (sum((f(i) * f(i) for i in range(dim)), F.lit(0.0)) for f in (gap, span))
    other = lambda b: b.select(F.col("cell").alias("cell2"), F.col("box").alias("box2"), F.col("n").alias("n2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    boxes = saved(_boxes(cores.withColumn("box", F.col("cell")), ["cell", "box"], dim), "boxes")
    pairs = boxes.withColumn("cell2", F.explode(_moved("cell", half))).join(other(boxes).drop("box2"), "cell2").withColumn("box2", F.col("cell2"))
    found = None
    while True:
        open_ = saved(pairs.withColumns({"__least": least, "__most": most}).where(F.col("__least") <= eps2), "box-pairs")
        within = open_.where(F.col("__most") <= eps2).select("cell", "cell2")
        few = open_.where((F.col("__most") > eps2) & (F.col("n") * F.col("n2") <= TRIED)).select("cell", "box", "cell2", "box2")
        own = cores.withColumn("box", _cell("x", side / 2**level) if level else F.col("cell"))
        tried = few.join(own.select("cell", "box", "x"), ["cell", "box"]).join(own.select(F.col("cell").alias("cell2"), F.col("box").alias("box2"), F.col("x").alias("x2")), ["cell2", "box2"]).where(_square("x", "x2", dim) <= eps2).select("cell", "cell2")
        now = saved(within.unionByName(tried).distinct(), "joined-cells")
        found = now if found is None else found.unionByName(now)
        left = open_.where((F.col("__most") > eps2) & (F.col("n") * F.col("n2") > TRIED)).select("cell", "box", "cell2", "box2").join(found, ["cell", "cell2"], "left_anti")
        left = saved(left, "open-boxes")
        if left.isEmpty():
            return found.select(F.col("cell").alias("a"), F.col("cell2").alias("b")).distinct()
        level += 1
        wanted = left.select("cell").union(left.select(F.col("cell2").alias("cell"))).distinct()
        finer = cores.join(wanted, "cell", "left_semi").withColumns({"up": _cell("x", side / 2 ** (level - 1)) if level > 1 else F.col("cell"), "box": _cell("x", side / 2**level)})
        boxes = saved(_boxes(finer, ["cell", "up", "box"], dim), "boxes")
        first = left.select("cell", F.col("box").alias("up"), "cell2", F.col("box2").alias("up2")).join(boxes, ["cell", "up"])
        pairs = first.join(other(boxes).withColumn("up2", F.transform("box2", lambda e: F.floor(e / 2))) if level > 1 else other(boxes).withColumn("up2", F.col("cell2")), ["cell2", "up2"]).drop("up", "up2")


def dbscan(df: DataFrame, key: str, axes: list[str], eps: float, min_points: int) -> DataFrame:
    """(key, core, cluster): cluster is the smallest id among its core points, null for noise; a border point belongs to the smallest cluster in reach.

    A point is core if min_points points, itself included, lie within eps. Cells have the diagonal eps: where one
    holds min_points points all are core, so only points of sparse cells count their neighbours, and clusters are components of cells.
    """
    dim = len(axes)
    side = eps / math.sqrt(dim) * (1 - 1e-12)  # rounding must not stretch a diagonal beyond eps
    near = _touching(dim)
    points = saved(_points(df, key, axes).withColumn("cell", _cell("x", side)), "points")
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    marked = saved(points.join(sizes, "cell").withColumn("dense", F.col("n") >= min_points).drop("n"), "points")
    asking = lambda rows: rows.select(F.col("id"), F.col("x"), F.explode(_moved("cell", near)).alias("to"))
    met = lambda rows, others: asking(rows).join(others, F.col("to") == F.col("cell2")).where(_square("x", "x2", dim) <= eps * eps)
    sparse = marked.where(~F.col("dense")).select("id", "x", "cell")
    counts = met(sparse, marked.select(F.col("cell").alias("cell2"), F.col("x").alias("x2"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    more = counts.where(F.col("n") >= min_points).select("id")
    cores = saved(marked.where("dense").select("id", "x", "cell").unionByName(sparse.join(more, "id", "left_semi")), "cores")
    comp = connected(_joined_cells(cores, eps, side, dim)).withColumnRenamed("id", "cell")
    of_cell = cores.groupBy("cell").agg(F.min("id").alias("low")).join(comp, "cell", "left").withColumn("comp", F.coalesce("comp", "cell"))
    named = of_cell.groupBy("comp").agg(F.min("low").alias("cluster"))
    of_cell = saved(of_cell.join(named, "comp").select("cell", "cluster"), "clusters")
    own = cores.join(of_cell, "cell").select("id", F.lit(True).alias("core"), "cluster")
    rest = saved(sparse.join(cores.select("id"), "id", "left_anti"), "not-core")
    held = cores.join(of_cell, "cell").select(F.col("cell").alias("cell2"), F.col("x").alias("x2"), "cluster")
    border = met(rest, held).groupBy("id").agg(F.min("cluster").alias("cluster"))
    out = own.unionByName(rest.select("id").join(border, "id", "left").select("id", F.lit(False).alias("core"), "cluster"))
    return out.withColumnRenamed("id", key)


def neighbours(points: DataFrame, k: int, dim: int) -> DataFrame:
    """(id, other, w, square, kth): of distinct places (id, x, w copies) the others within the distance (kth, squared) at which k copies are reached, ties included.

    Each place asks on the finest of a pyramid of grids where its cell and those around it hold k + 1 copies. These lie within two cells along each axis,
    which bounds the search. As finer cells around it hold k at most, few places of a cell ask on one level, so all tries together
    grow with the number of places, however crowded a cell is. Fewer than k others: all of them.
    """
    ends = points.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dim) for n, f in (("a", F.min), ("b", F.max))], F.count(F.lit(1)).alias("n")).first()
    low = [ends[f"a{i}"] or 0.0 for i in range(dim)]
    extent = max([(ends[f"b{i}"] or 0.0) - low[i] for i in range(dim)], default=0.0) or 1.0
    levels = math.ceil(math.log2(max(ends["n"], 2)) / dim) + 4

    def cells(x: str, level: Column) -> Column:
        n = F.pow(F.lit(2.0), level)
        return F.array(*[F.least(F.floor((F.col(x)[i] - low[i]) / extent * n), n.cast("long") - 1) for i in range(dim)])

    placed = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("cell", cells("x", F.col("level")))
    placed = saved(placed, "pyramid")
    held = saved(placed.groupBy("level", "cell").agg(F.sum("w").alias("n")), "cells")
    around = list(product((-1, 0, 1), repeat=dim))
    block = held.select("level", "n", F.explode(_moved("cell", around)).alias("cell")).groupBy("level", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    asks = placed.join(block.select("level", "cell"), ["level", "cell"]).groupBy("id").agg(F.max("level").alias("level"))
    asks = points.join(asks, "id", "left").withColumn("level", F.coalesce("level", F.lit(0))).withColumn("cell", cells("x", F.col("level")))
    reach = math.ceil(2 * math.sqrt(dim))
    ring = list(product(range(-reach, reach + 1), repeat=dim))
    asked = asks.select("id", "x", F.col("w").alias("own"), "level", F.explode(_moved("cell", ring)).alias("cell"))
    there = placed.select("level", "cell", F.col("id").alias("other"), F.col("x").alias("x2"), "w")
    pairs = asked.join(there, ["level", "cell"]).withColumn("square", _square("x", "x2", dim))
    pairs = pairs.where(F.col("id") != F.col("other")).select("id", "own", "other", "w", "square")
    # an own copy is a neighbour at distance 0
    upto = W.partitionBy("id").orderBy("square", "other").rowsBetween(W.unboundedPreceding, 0)
    counted = pairs.withColumn("upto", F.sum("w").over(upto) + F.col("own") - 1)
    enough = F.when(F.col("own") > k, F.lit(0.0)).otherwise(F.min(F.when(F.col("upto") >= k, F.col("square"))).over(W.partitionBy("id")))
    # where there are fewer than k others, all of them are neighbours
    return counted.withColumn("kth", F.coalesce(enough, F.max("square").over(W.partitionBy("id")))).where(F.col("square") <= F.col("kth")).select("id", "own", "other", "w", "square", "kth")


#: Added to mean reachability distances, so that copies have a density.
LEAST_REACH = 1e-10


def local_outlier_factor(df: DataFrame, key: str, axes: list[str], k: int) -> DataFrame:
    """(key, lof): how much sparser a point lies than its k nearest neighbours (ties included).

    Points of one place count as often as they are there; a point without any other is left out.
    """
    dim = len(axes)
    points = saved(_points(df, key, axes), "points")
    places = saved(points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "places")
    near = saved(neighbours(places, k, dim), "neighbours")
    copies = places.where("w > 1").select("id", F.col("w").alias("own"), F.col("id").alias("other"), (F.col("w") - 1).alias("w"), F.lit(0.0).alias("square"))
    kth = near.groupBy("id").agg(F.max("kth").alias("kth"))
    alone = places.where("w > 1").select("id", F.lit(0.0).alias("zero")).join(kth, "id", "left")
    kth = kth.unionByName(alone.where("kth is null").select("id", F.col("zero").alias("kth")))
    pairs = saved(near.drop("kth").unionByName(copies), "neighbours")
    reach = pairs.join(kth.withColumnRenamed("id", "other"), "other").withColumn("reach", F.sqrt(F.greatest("square", "kth")))
    density = saved(reach.groupBy("id").agg((1 / (F.sum(F.col("reach") * F.col("w")) / F.sum("w") + LEAST_REACH)).alias("lrd")), "densities")
    theirs = pairs.join(density.select(F.col("id").alias("other"), F.col("lrd").alias("theirs")), "other").groupBy("id").agg((F.sum(F.col("theirs") * F.col("w")) / F.sum("w")).alias("theirs"))
    factor = density.join(theirs, "id").select("id", (F.col("theirs") / F.col("lrd")).alias("lof"))
    return points.join(places.select("x", F.col("id").alias("place")), "x").join(factor.withColumnRenamed("id", "place"), "place").select(F.col("id").alias(key), "lof")
