"""The prefix trie against a dictionary of prefixes; the sparse table against plain scans."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, side int"


def plain_sequences(rows):
    """(role, text) in the operator's order by conv_id."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[conv].append(((turn is not None, turn or 0, mark), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in by.items()}


def brute(found):
    """Nodes of (conv_id, turns) pairs."""
    members = defaultdict(list)
    for conv, said in found:
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append((conv, len(said)))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [total[c] for c in children[path]]
        total[path] = ((n - 1) * words + sum(x[0] for x in below), sum(x[1] for x in below) or 1)
    return [
        (
            min(c for c, _ in m),
            len(path),
            min(c for c, _ in members[path[:-1]]) if path else None,
            len(m),
            len(children[path]),
            total[path][1],
            total[path][0],
            hashlib.sha256(",".join(map(str, sorted(c for c, n in m if n == len(path)))).encode()).hexdigest(),
        )
        for path, m in members.items()
    ]


def corpus(seed):
    rnd = random.Random(seed)
    texts = ["", None, "one", "two words", " \t\n", "three words here", "long " * 5000, "é 🙂 x"]
    rows = []
    for conv in [*range(80), -3, 2**60]:
        for turn in range(rnd.choice([1, 2, 3, 5, 8])):
            rows.append((conv, turn, rnd.choice(["user", "user", "assistant", None]), rnd.choice(texts[: rnd.choice([2, 4, 8])])))
    same = [("user", "hello there"), ("assistant", "hi"), ("user", "tell me")]
    for conv in range(200, 320):  # copies, and ever longer ones
        rows += [(conv, k, *same[k % 3]) for k in range(conv % 5 if conv % 3 else 3)]
    rows += [(400 + c, k, "user", f"line {k}") for c in range(6) for k in range(60 - 7 * c)]
    rows += [(500, None, "user", "late"), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, None, "system", "x"), (None, 1, "user", "lost"), rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1), (1, 9), (2, 40), (3, 200), (4, 1 << 16)])
def test_nodes(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(5)
    out = trie.prefix_trie(trie.sequences(df), block).collect()
    want = brute(plain_sequences(rows).items())
    assert sorted(str(tuple(r)) for r in out) == sorted(map(str, want))


@pytest.mark.parametrize("block", [1, 30, 1 << 16])
def test_heads_of_other_conversations(spark, block):
    rows = [r for r in corpus(5) if r[0] not in (20, 40, None, -3)]
    rows = [r for r in rows if r[0] != 60 or r[1] == 0]
    said = plain_sequences(rows)
    found = []
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        found.append((c, said.get(c - c % 20, [])[:h] + own[h:]))
    assert any(not s for _, s in found)
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(2)
    conv = F.col("conv_id")
    made = trie.with_heads(trie.sequences(df), conv - F.pmod(conv, F.lit(20)), F.crc32(conv.cast("string")) % 4, 3)
    out = trie.prefix_trie(made, block).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(map(str, brute(found)))


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_repeated_conversations_and_one_root(spark, block):
    found = [(7, []), (7, []), (3, [("user", "a")]), (3, [("user", "a")])]
    one = "array<struct<turn:long,mark:string,words:int>>"
    mark = hashlib.sha256(b"4:usera").hexdigest()[:32]
    df = spark.createDataFrame([(c, [(0, mark, 1) for _ in s]) for c, s in found], f"conv_id long, turns {one}")
    out = trie.prefix_trie(df, block).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(map(str, brute(found)))
    assert trie.prefix_trie(df.where("false")).count() == 0


def test_extents():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 130):
        values = rng.integers(0, 5, n)
        table = trie._Minima(values)
        start, depth = rng.integers(0, n, 300), rng.integers(0, 6, 300)
        right, left = table.right(start, depth), table.left(start, depth)
        for i, d, r, a in zip(start, depth, right, left, strict=True):
            assert all(values[i + 1 : r + 1] >= d) and (r == n - 1 or values[r + 1] < d)
            assert all(values[a + 1 : i + 1] >= d) and (a == 0 or values[a] < d)
            assert table.least(np.array([a]), np.array([r]))[0] == values[a : r + 1].min()
