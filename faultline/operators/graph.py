"""Connected components and reachability over edge tables; every step is a join, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.series import series
from faultline.sources.scratch import saved

#: Edges are broadcast up to this count, else joined by key.
BROADCAST_EDGES = 200_000
#: Rounds that one plan holds; after them the state is written and compared.
ROUNDS = 4
#: Strides of several edges are made while pairs of shorter ones are at most so many times the edges.
STRIDES = 16
#: Sources are sets of bits, so many words of 64 in a row.
WORDS = 16


def connected(links: DataFrame) -> DataFrame:
    """(id, comp) for links (a, b): the smallest id that can be reached. Labels take their neighbours' smallest one and then their label's own."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        now = saved(step.join(jump, "comp").select("id", "was", F.least("comp", "next").alias("comp")), "labels")
        labels = now.select("id", "comp")
        if now.where(F.col("was") != F.col("comp")).isEmpty():
            return labels


def reachable(starts: DataFrame, calls: DataFrame) -> DataFrame:
    """(start, node, hops): what each start (column start) reaches over the calls (src, dst), itself at 0 hops; cycles end where nothing new is found."""
    edges = saved(calls.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "calls")
    seen = saved(starts.where(F.col("start").isNotNull()).select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct(), "reached")
    frontier, hops = seen, 0
    while not frontier.isEmpty():
        hops += 1
        met = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = saved(met.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)), "reached")
        seen = seen.unionByName(frontier)
    return seen


def numbered_graph(edges: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, id) of edges (src, dst) and of marked (node), without nulls; the distinct edges by these ids."""
    known = saved(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "edges")
    every = known.select(F.col("src").alias("node")).unionByName(known.select(F.col("dst").alias("node"))).unionByName(marked.select("node"))
    nodes = saved(every.where("node is not null").distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    return nodes, saved(known.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "edges")


def _strides(steps: DataFrame, most: int | None) -> list[tuple[int, DataFrame]]:
    """(reach, steps (src, dst, hop)): the steps themselves, then all of at most 2, 4 ... hops, as long as these are few."""
    found, edges = [(1, steps)], steps.count()
    n = edges
    while most is None or 2 * found[-1][0] <= most:
        reach, last = found[-1]
        into = last.groupBy("dst").agg(F.count(F.lit(1)).alias("into"))
        pairs = into.join(last.groupBy("src").agg(F.count(F.lit(1)).alias("out")), F.col("dst") == F.col("src")).agg(F.sum(F.col("into") * F.col("out"))).first()[0]
        if (pairs or 0) > STRIDES * edges:
            break
        ahead = last.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("hop").alias("more"))
        longer = saved(last.join(ahead, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.min(F.col("hop") + F.col("more")).alias("hop")), "strides")
        before, n = n, longer.count()
        if n == before:  # these are all paths
            break
        found.append((2 * reach, longer))
    return [(reach, F.broadcast(s) if s.count() <= BROADCAST_EDGES else s) for reach, s in found]


def _spread(state: DataFrame, edges: DataFrame, by: list[str], moved: list[Column], merge: list[Column], size: list[Column], most: int | None) -> DataFrame:
    """What rows of state (id, ...) come to if they go along the edges (src, dst) and stay where they are; over `most` edges, none: until nothing changes.

    moved: a row's columns behind a path of `hop` edges (0 if it stays), merge: how rows of equal id and `by` meet, size: sums that change whenever a row does. A state is never more than a row for each id and `by`.
    """
    ends = edges.select("src").union(edges.select("dst")).union(state.select("id")).distinct()
    steps = saved(edges.where("src <> dst").select("src", "dst", F.lit(1).alias("hop")).unionByName(ends.select("src", F.col("src").alias("dst"), F.lit(0).alias("hop"))), "steps")
    strides = _strides(steps, most)
    was, done = None, 0
    while most is None or done < most:
        for _ in range(ROUNDS):
            reach, along = next(((r, s) for r, s in reversed(strides) if most is None or done + r <= most), (0, None))
            if not reach:
                break
            met = state.join(along, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), *by, *moved)
            state, done = met.groupBy("id", *by).agg(*merge), done + reach
        state = saved(state, "spread")
        now = state.agg(F.count(F.lit(1)).alias("n"), *size).first()
        if now == was:
            break
        was = now
    return state


def marks_ahead(marked: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, low, high): the smallest and the largest marked id (marked: id) that each id reaches over at most `most` edges, itself included; ids that reach none have no row."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    size = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "high")]
    start = marked.select("id", F.col("id").alias("low"), F.col("id").alias("high"))
    return _spread(start, back, [], [F.col("low"), F.col("high")], [F.min("low").alias("low"), F.max("high").alias("high")], size, most)


def sources_behind(sources: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, n, hops): how many of the sources (id) reach each id over at most `most` edges, itself at 0 hops included, and the fewest edges from one.

    Sources are bits, 1,024 in a row, and rows of one id meet by `or`: a row for each id and 1,024 sources, of which tasks hold what they merge.
    """
    words = [f"w{i}" for i in range(WORDS)]
    place = F.col("at") - 1
    word, bit = F.floor(place / 64) % WORDS, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    placed = series(saved(sources.select("id").distinct(), "sources"), [], ["id"]).running({"at": ("count", F.lit(1))}).plain
    start = saved(placed.select("id", F.floor(place / (64 * WORDS)).alias("block"), F.lit(0).alias("hops"), *[F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)]), "sources")
    count = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    moved = [(F.col("hops") + F.col("hop")).alias("hops"), *map(F.col, words)]
    merge = [F.min("hops").alias("hops"), *[F.bit_or(w).alias(w) for w in words]]
    found = _spread(start, edges, ["block"], moved, merge, [F.sum(count).alias("bits")], most)
    return found.groupBy("id").agg(F.sum(count).alias("n"), F.min("hops").alias("hops"))
