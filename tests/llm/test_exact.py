"""Exact dedup against grouping by hand."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from trafficloom.llm import exact
from trafficloom.llm.texts import arrow_schema, batch_of

SCHEMA = "doc_id long, text string, owner string, kept int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def expected(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = Counter()
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        owner = (max if keep == "largest" else min)(ids) if ids else None
        sha = hashlib.sha256(lower(t).encode()).hexdigest()
        out[i, owner, len(groups[lower(t)]), i == owner, sha] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("budget", [1, 5000, exact.BUDGET])
def test_groups(spark, monkeypatch, keep, budget):
    monkeypatch.setattr(exact, "BUDGET", budget)
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abAB", k=rnd.randint(0, 6))) for _ in range(150)] + ["É", "é", "x" * 9000, "X" * 9000, None, ""]
    rows = [(i * 31 % 997, t) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[4]), (None, "only without id"), (None, "only without ID")] + [(2000 + i, "hot") for i in range(100)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    assert found(exact.exact_dedup(df, keep=keep)) == expected(rows, keep)
    assert exact.exact_dedup(df.where("false")).count() == 0


def test_trie_keeps_every_string():
    rnd = random.Random(1)
    keys = [bytes(rnd.choices(b"ab\0", k=rnd.randint(0, 12))) for _ in range(3000)]
    trie = exact.Trie("smallest")
    want: dict = {}
    for i, k in enumerate(keys):
        trie.insert(k, i, 1)
        want.setdefault(k, [i, 0])[1] += 1
    assert {k: [o, n] for k, o, n in trie.terminals()} == want


def test_equal_heads_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.xxhash, "xxh64_digest", lambda text: b"\0" * 8)
    batches = [batch_of(arrow_schema("doc_id long, text binary"), [(1, b"ab"), (2, b"ba"), (3, b"AB")])]
    rows = [r for b in exact._local("largest")(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["text"], r["owner"], r["members"]) for r in rows) == [(b"ab", 3, 2), (b"ba", 2, 1)]
