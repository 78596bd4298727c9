"""The prefix trie against a brute-force one, and running sums against Python's."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from aggrolens.llm import prefix_trie
from aggrolens.llm.queries import QUERIES
from aggrolens.llm.scan import scanned

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, c string"


def brute(rows, group=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % group if c >= 0 else -(-c % group))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    r = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        n = r.choice([1, 2, 3, 5, 9, 12, 40])
        for t in range(n):
            rows.append((c, t if t or c % 7 else None, r.choice(["user", "bot", None]), r.choice(["", None, "a", "é", "a:b", "b"]), 1, "x"))
    for c in range(100, 140):  # copies, and one that all others of its group begin with
        rows += [(c, t, "user", "same", 1, "x") for t in range(4)]
    rows += [(200, t, "u", f"long {t % 3}", 1, "x") for t in range(1500)]  # longer than a block of blocks
    rows += [(201, t, "u", f"long {t % 3}", 1, "x") for t in range(1400)]
    rows += rows[:5]  # repeated rows
    rows += [(None, 1, "user", "nobody's", 1, "x"), (300, None, None, None, 1, "x")]
    return rows


@pytest.mark.parametrize("block", [2, 32])
def test_trie_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rows = [x for x in odd_rows() if not (x[0] in (200, 201) and x[1] and x[1] >= 70)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = got.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr) == brute(rows)
    assert sorted(r.preorder for r in found) == list(range(1, len(found) + 1))
    at = {r.preorder: r for r in found}
    for r in found:  # what lies in the interval is deeper, what follows it isn't
        assert all(at[p].depth > r.depth for p in range(r.preorder + 1, r.subtree_end + 1))
        assert r.subtree_end == len(found) or at[r.subtree_end + 1].depth <= r.depth


def test_long_conversations(spark):
    rows = [x for x in odd_rows() if x[0] in (200, 201)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1501  # one is the other's beginning
    root = next(r for r in got if r.depth == 0)
    assert (root.n_convs, root.n_leaves, root.n_children) == (2, 1, 1) and root.saved_tokens == 1400 * 6


def test_small_tables(spark):
    d = spark.createDataFrame(odd_rows(), SCHEMA)
    assert prefix_trie.trie(d.limit(0)).count() == 0
    one = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(d.where("conv_id = 300")).collect()]
    assert sorted(one, key=repr) == brute([(300, None, None, None)])
    none = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(spark.createDataFrame([(1, 0, "u", "x", 1, "")], SCHEMA)).collect()]
    assert sorted(none, key=repr) == brute([(1, 0, "u", "x")])


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_prefix_trie"](spark, sf).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, 9]), i, r.randint(-5, 5), "t" * (i % 3)) for i in range(3000)]
    d = spark.createDataFrame(rows, "k long, i long, x long, note string").repartition(7)
    for key in (["k"], []):
        got = {x.i: x.run_x for x in scanned(d, key, [*key, "i"], ["x"]).collect()}
        held, want = defaultdict(int), {}
        for k, i, x, _ in sorted(rows, key=lambda z: (z[0], z[1]) if key else (z[1],)):
            held[k if key else 0] += x
            want[i] = held[k if key else 0]
        assert got == want
    assert scanned(d.limit(0), ["k"], ["k", "i"], ["x"]).select(F.sum("run_x")).first()[0] is None
