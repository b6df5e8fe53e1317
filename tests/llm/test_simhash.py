"""Fingerprints and their links against brute force."""

import random

import numpy as np
import pytest
import xxhash

from trafficloom.llm import simhash
from trafficloom.plans.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points):
    label = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for p in points:
            for q in points:
                if bin(p ^ q).count("1") <= 3 and label[q] < label[p]:
                    label[p], changed = label[q], True
    return label


def cloud(seed, centres, each):
    rnd = random.Random(seed)
    out = set()
    for _ in range(centres):
        p = rnd.getrandbits(64)
        for _ in range(each):
            out.add(p)
            for _ in range(rnd.randint(0, 4)):
                p ^= 1 << rnd.randrange(64)
    return sorted(out)


@pytest.mark.parametrize(("seed", "centres", "each"), [(1, 150, 1), (2, 20, 12), (3, 1, 250)])
@pytest.mark.parametrize(("shard", "split_rows"), [(8, 1 << 16), (8, 40), (2048, 1 << 16)])
def test_links(spark, monkeypatch, seed, centres, each, shard, split_rows):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split_rows)
    points = cloud(seed, centres, each)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = {r["node"] % (1 << 64): r["component"] for r in components(simhash.links(df, shard=shard), "a", "b").collect()}
    want = plain_components(points)
    groups = {}
    for p in points:
        groups.setdefault(want[p], []).append(p)
    for members in groups.values():
        labels = {found.get(p) for p in members}
        assert len(labels) == 1 and (len(members) > 1) == (None not in labels)
    assert len({found[p] for p in found}) == sum(len(m) > 1 for m in groups.values())


def test_local_splits_lose_nothing(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    points = np.array(cloud(5, 40, 10), dtype=np.uint64)
    label = {int(p): int(p) for p in points}
    for number in (0, 1):
        for a, b in simhash._within(points, simhash._halves(points)[number], 1, 3):
            assert (np.bitwise_count(a ^ b) <= 64).all()
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = label[x], label[y]
                label = {k: min(p, q) if v in (p, q) else v for k, v in label.items()}
    want = plain_components(points.tolist())
    assert {frozenset(k for k in label if label[k] == v) for v in label.values()} == {
        frozenset(k for k in want if want[k] == v) for v in want.values()
    }


def test_near_duplicates(spark):
    rnd = random.Random(7)
    words = ["Ab", "cd", "é", "x1", "Zz", "q", "ß"]
    texts = [rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), None, "", " \n\t", "one", "one two", "w " * 30000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (None, "one", None, 1)], "doc_id long, text string, fingerprint string, n int")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows) + 2
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    label = plain_components(sorted(set(prints.values())))
    first = {}
    for i, p in prints.items():
        first.setdefault(label[p], i)
    for r in out:
        p = plain_fingerprint("one") if r["doc_id"] is None else prints[r["doc_id"]]
        assert (r["fingerprint"], r["component_id"]) == (f"{p:016x}", first[label[p]])
    assert simhash.near_duplicates(docs.where("false")).count() == 0
