"""Conversation prefix trie by smallest-member ownership (operator 11).

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Turns become SHA-256 digests of role and text, so that texts are not shuffled. They are numbered
   in each conversation by series that are cut into parts where a conversation is long.
2. Rebuilding. A conversation takes its first turns from the first of its group of ids; these are
   `head` turns at most, which travel as one array.
3. Paths. The key of a path's first d turns is the running xor of 128 bits hashed from each turn's
   digest and depth. The node table proves the keys: all members of a node must come from one
   parent by one turn, or the query fails.
4. Ownership. A node belongs to its smallest member. Members of a node are members of all nodes
   above it, so what a conversation owns is a suffix of its path, told by the depth where it starts
   and by the turns' bytes before it. (The smallest member comes from a pre-aggregated minimum, not
   from a window by node, which would hold all conversations of the root in one task.)
5. One group-by of all paths' rows by node sums the bytes of a member's turns from the node on
   minus those it owns, the leaf flags and the steps into owned nodes.
6. The ids that end in a node are joined in pieces (one for each range of PIECE ids), and a task
   hashes a node's pieces in order as they stream by.

Result: a row for each node; see `prefix_trie`.

Defined results: null roles and texts are empty; equal turns of one conversation are ordered by their
digests, repeated rows are turns of their own; rows without conv_id take no part; conv_id % 5 is
that of SQL (the sign of conv_id); the root is there if any conversation is; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, saved
from faultline.operators.series import PART_ROWS, series

#: A conversation's head comes from the first conversation of its group of GROUP ids and has less than HEADS turns.
GROUP, HEADS = 5, 9
#: Ids that are joined to one string at most.
PIECE = 4096

NODE = ["depth", "k1", "k2"]


def _bits(digest: Column, depth: Column) -> tuple[Column, Column]:
    """128 bits of a turn at a depth."""
    return F.xxhash64(F.lit(1), depth, digest), F.xxhash64(F.lit(2), digest, depth)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(own: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, depth, digest, bytes) of the rebuilt conversations of `turns`; each has a row of depth 0 beside its turns."""
    placed = series(own, ["conv_id"], ["turn", "digest"], rows).running({"pos": ("count", F.lit(1))}).plain.select("conv_id", "pos", "digest", "bytes")
    first = placed.where(F.col("pos") < HEADS).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("first"))
    known = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int").alias("h"))
    none = F.array().cast("array<struct<pos:long,digest:binary,bytes:long>>")
    heads = known.join(first.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "h", F.slice(F.coalesce("first", none), F.lit(1), F.col("h")).alias("head"))
    top = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes")))
    upper = heads.select("conv_id", F.explode(F.concat(top, "head")).alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.bytes")
    lower = placed.join(heads.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("depth"), "digest", "bytes")
    return upper.unionByName(lower)


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes in which conversations end."""
    ids = paths.where("ends").select(*NODE, "conv_id", F.floor(F.col("conv_id") / PIECE).alias("piece"))
    pieces = ids.groupBy(*NODE, "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            cols = [pa.array([x], pa.int64()) for x in at]
            return pa.record_batch([*cols, pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])

        for b in batches:
            done = []
            for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node != at:
                    if at is not None:
                        done.append(row())
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if at is not None:
            yield row()

    in_order = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return in_order.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """For each node: conv_id, its smallest member; depth; parent_conv_id, the parent's conv_id (root: null); n_convs, members; n_children;
    n_leaves, childless nodes in its subtree; saved_tokens, over its subtree the bytes of a node's last text once for each member but one;
    ends_sha256, of the ids that end in it.
    """
    with Scratch(conversations.sparkSession) as tmp:
        own = tmp.saved(turns(conversations), "turns")
        b1, b2 = _bits(F.col("digest"), F.col("depth"))
        told = rebuilt(own, rows).withColumns({"b1": F.when(F.col("depth") > 0, b1).otherwise(0), "b2": F.when(F.col("depth") > 0, b2).otherwise(0)})
        path = series(tmp.saved(told, "rebuilt"), ["conv_id"], ["depth"], rows)
        path = path.running({"k1": ("xor", F.col("b1")), "k2": ("xor", F.col("b2")), "upto": ("sum", F.col("bytes"))}).whole({"length": F.max("depth"), "total": F.sum("bytes")})
        before = F.col("upto") - F.col("bytes")
        up = lambda k, b: F.col(k).bitwiseXOR(F.col(b))
        paths = tmp.saved(path.plain.select("conv_id", *NODE, "digest", up("k1", "b1").alias("p1"), up("k2", "b2").alias("p2"), before.alias("before"), "total", "length", (F.col("depth") == F.col("length")).alias("ends")), "paths")

        step = F.struct("p1", "p2", F.coalesce("digest", F.lit(b"")).alias("digest"))
        nodes = paths.groupBy(*NODE).agg(F.min(F.struct("conv_id", "before")).alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min(step).alias("step"), F.max(step).alias("other"))
        sound = F.when(F.col("step") == F.col("other"), F.col("owner")).otherwise(F.raise_error(F.lit("two paths have one key")))
        nodes = tmp.saved(nodes.select(*NODE, "step.p1", "step.p2", "n_convs", "n_ends", sound.alias("owner")).select("*", "owner.conv_id", "owner.before").drop("owner"), "nodes")

        held = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min(F.struct("depth", "before")).alias("first"), F.count_if(F.col("n_convs") == F.col("n_ends")).alias("leaves"))
        held = held.select("owner", F.col("first.depth").alias("first"), F.col("first.before").alias("shared"), "leaves")
        row = paths.join(held, F.col("conv_id") == F.col("owner"), "left")
        # the turns above what a conversation owns, from this one on
        extra = F.greatest(F.coalesce("shared", "total") - F.col("before"), F.lit(0))
        steps = F.coalesce(((F.col("first") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))).cast("long"), F.lit(0))
        sums = row.groupBy(*NODE).agg(F.sum(extra).alias("saved_tokens"), F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves"), F.sum(steps).alias("n_children"))

        over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(over, ["depth", "p1", "p2"], "left").join(sums, NODE).join(_ends(paths), NODE, "left")
        nothing = F.lit(hashlib.sha256().hexdigest())
        return saved(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")), "prefix-trie")


#: DuckDB has no crc32: a number's digits go through the polynomial 0xEDB88320, bit by bit.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"

ORACLE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
 l AS (SELECT c, list({{'r': role, 't': text}} ORDER BY pos) AS l FROM t GROUP BY c),
 h AS (SELECT c, l, {_CRC32} % {HEADS} AS h FROM l),
 p AS (SELECT h.c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS p FROM h LEFT JOIN l b ON b.c = h.c - h.c % {GROUP}),
 m AS (SELECT c, d, p[1:d] AS k, d = len(p) AS ends, CASE WHEN d > 0 THEN strlen(p[d].t) ELSE 0 END AS bytes FROM p, unnest(range(0, len(p) + 1)) AS u(d)),
 n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, count(*) FILTER (WHERE ends) AS n_ends, max(bytes) AS bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM m GROUP BY d, k),
 s AS (SELECT a.d, a.k, count(*) FILTER (WHERE b.n_ends = b.n_convs) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved, count(*) FILTER (WHERE b.d = a.d + 1) AS n_children FROM n a JOIN n b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.d, a.k)
 SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
 FROM n JOIN s ON s.d = n.d AND s.k = n.k LEFT JOIN n o ON o.d = n.d - 1 AND o.k = n.k[1:n.d - 1]"""
