"""Manifests, proofs and tampering against a tree of Python lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trafficloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _at int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def grow(nodes, fanout):
    """Root of a list of digests, and for every one of them its (left, right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            run = k // fanout * fanout
            path.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + fanout])))
        at = [k // fanout for k in at]
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees.append((mine, *grow([leaf_of(r, r[4]) for r in mine], fanout)))
    root, tops = grow([t[1] for t in trees], fanout)
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for row, path in zip(mine, paths, strict=True):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf_of(row, text)
            for left, right in [*path, *top]:
                now = h(left, now, right)
            proof = h(*[left + right for left, right in [*path, *top]])
            out.append((row[0], leaf_of(row, row[4]), subroot, root, proof, now, now == root))
    return out


def proved(spark, rows, fanout):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return [tuple(r) for r in merkle.verified(df, tampered, {"text": merkle.lowered("text")}, fanout).collect()]


def corpus(seed):
    rnd = random.Random(seed)
    texts = ["", None, "plain", "UPPER Ä", "é" * 50, "Mixed\nLines", "x" * 200_000, "X" * 70_000]
    langs = [None, "", "-", "en", "de", "ä", "z", "Z", *[f"l{k}" for k in range(9)]]
    rows = [(i, rnd.choice(["a", None, ""]), rnd.choice(langs) if i % 2 else "en", rnd.choice([0, 5, None]), rnd.choice(texts)) for i in range(140)]
    return [*rows, rows[3], rows[3], rows[6], (6, "b", "en", 1, "other"), (None, None, None, None, None), (None, "x", "en", 1, "A"), (-5, "x", "en", 1, "B")]


@pytest.mark.parametrize(("seed", "fanout"), [(1, 8), (2, 2), (3, 3), (4, 200)])
def test_proofs(spark, seed, fanout):
    rows = corpus(seed)
    assert sorted(map(str, proved(spark, rows, fanout))) == sorted(map(str, brute(rows, fanout)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_tree(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    out = proved(spark, rows, 8)
    assert sorted(map(str, out)) == sorted(map(str, brute(rows, 8)))
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 3 != 0) for r in out)
    if n == 1:
        assert out[0][1] == out[0][2] == out[0][3] and out[0][4] == h("")


def test_empty_and_other_fields(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).count() == 0
    rows = spark.createDataFrame([(2, "a", "x"), (1, "b", "x"), (3, "c", None)], "k long, v string, g string")
    out = {r["doc_id"]: r for r in merkle.manifest(rows, "k", "g", ["v"], {"shown": F.upper("v")}, fanout=2).collect()}
    a, b, c = (h(f"1:{x}") for x in "abc")
    assert [out[k]["leaf"] for k in (1, 2, 3)] == [b, a, c] and out[1]["shown"] == "B"
    assert {r["root"] for r in out.values()} == {h(c, h(b, a))}
    assert [tuple(s) for s in out[2]["path"]] == [(b, ""), (c, "")] and [tuple(s) for s in out[3]["path"]] == [("", h(b, a))]
