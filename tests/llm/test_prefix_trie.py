"""The trie against a plain one in Python, and against SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from faultline.llm.prefix_trie import ORACLE, prefix_trie
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """rows: (conv_id, turn, role, text), in the order of equal turns that is wanted."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for k, ms in members.items():
        below = [x for x in members if x[: len(k)] == k]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((ms[0], len(k), members[k[:-1]][0] if k else None, len(ms), sum(len(x) == len(k) + 1 for x in below), len(childless), saved, digest))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, k1 int")


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(ORACLE)
    assert want.columns == COLUMNS
    assert got(prefix_trie(table(spark, SF, "conversations"))) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("rows", [1 << 20, 40])
def test_shared_starts_and_a_long_conversation(spark, rows):
    """Half of all conversations are copies; one has a third of all turns; the second way cuts it into parts."""
    said = [(c, t, "user" if t % 2 == 0 else None, "same" if c % 2 == 0 or t == 0 else f"é{c % 7}-{t // 3}") for c in range(-20, 60) for t in range(c % 6)]
    said += [(61, t, "user", f"x{t % 2}") for t in range(120)] + [(c, None, "user", "first") for c in (3, 7)] + [(100, 1, None, None), (105, 1, "", "")]
    said += [(8, 1, "user", "again")] * 3
    assert got(prefix_trie(frame(spark, said), rows)) == plain_trie(sorted(said, key=lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest()))


def test_odd_tables(spark):
    assert prefix_trie(frame(spark, []).limit(0)).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, "user", "lost")])).count() == 0
    one = [(1, 0, "user", "y" * 300_000), (1, 1, None, "")]
    assert got(prefix_trie(frame(spark, one))) == plain_trie(one)
