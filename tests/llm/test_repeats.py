"""Removed bytes and maximal repeats against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from trafficloom.llm import repeats

SCHEMA = "doc_id long, text string, n_bytes long, text_key string"


def brute(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        rank = repeats.NO_ID if i is None else i
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, rank), rank)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        rank = repeats.NO_ID if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < rank:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, alphabet="abcdé fgh"):
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choices(alphabet, k=k))
    passages = [make(rnd.randint(45, 300)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts += [make(rnd.randint(0, 60)), p[a : rnd.randint(a, len(p))] if rnd.random() < 0.5 else p]
        rows.append((i * 7 % 101, "".join(parts)))
    return rows


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 3, "clash") for i, t in rows], SCHEMA).repartition(parts)


def got(df):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 5])
def test_removed_bytes(spark, monkeypatch, seed, parts):
    rows = corpus(seed, 60)
    rows += [(200, rows[3][1]), (201, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (202, None), (203, ""), (204, "short")]
    rows += [(205, "a" * 3000), (206, "b" + "a" * 700 + "c"), (207, "ab" * 400), (208, "a" * 49), (209, "\0" * 120), (210, "\0" * 80)]
    assert got(repeats.remove_repeats(table(spark, rows, parts))) == brute(rows)


@pytest.mark.parametrize("bound", [0, 60, 400])
def test_groups_parted_by_longer_anchors(spark, monkeypatch, bound):
    """A bound so small that every group is parted, a frequent string with ever new surroundings among them."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", bound)
    rnd = random.Random(bound)
    make = lambda k: "".join(rnd.choices("abcdefgh ", k=k))
    frequent, longer = make(20), make(47)
    rows = corpus(9, 50)
    rows += [(400 + i, make(40) + frequent + make(40)) for i in range(60)]
    rows += [(500 + i, make(10) + longer + make(rnd.randint(3, 10))) for i in range(40)]
    rows += [(600 + i, make(5) + longer + "same" + make(5)) for i in range(10)]
    rows += [(700, "a" * 3000), (701, "b" + "a" * 700 + "c"), (702, "ab" * 400), (703, None), (None, rows[3][1])]
    assert got(repeats.remove_repeats(table(spark, rows, 3))) == brute(rows)


def test_covers_are_those_of_one_array(monkeypatch):
    rnd = random.Random(8)
    strings, base = {}, "".join(rnd.choices("abc", k=300))
    for rank in range(80):
        a, b = rnd.randint(0, 200), rnd.randint(40, 90)
        text = ("".join(rnd.choices("abc", k=20)) + base[a : a + b] + "".join(rnd.choices("abc", k=20))).encode()
        strings.setdefault(text, []).append((rank, rank, 5))

    def covered(bound):
        monkeypatch.setattr(repeats, "GROUP_BYTES", bound)
        covers, group = repeats._Covers(32), {}
        seen = defaultdict(set)
        known = [(k, r, a, a + len(c)) for c, places in strings.items() for p in places for r, k, a in repeats._placed(group, c, p)]
        for key, _, a, b in [*known, *covers.add(group), *covers.rest()]:
            seen[key] |= set(range(a, b))
        return seen

    whole = covered(1 << 30)
    assert whole and all(covered(bound) == whole for bound in (0, 100, 1000, 4000))


def test_low_variety(spark):
    rows = corpus(5, 40, "ab")
    rows += [(300 + i, "ab" * i) for i in range(20, 40)]
    assert got(repeats.remove_repeats(table(spark, rows))) == brute(rows)


def test_repeated_rows_and_nothing(spark):
    text = "".join(random.Random(1).choices("abcdef", k=200))
    rows = [(1, text), (1, text), (1, text[50:] + "x"), (2, "y" + text)]
    assert got(repeats.remove_repeats(table(spark, rows))) == brute(rows)
    assert repeats.remove_repeats(table(spark, rows).where("false")).count() == 0


def test_suffix_array():
    rnd = random.Random(3)
    strings = ["".join(rnd.choices("ab", k=rnd.randint(40, 120))).encode() for _ in range(12)]
    array = repeats.Array(strings, 40)
    suffixes = [strings[s][i:] for s, i in zip(array.string, array.inside, strict=True)]
    assert len(suffixes) == sum(len(s) - 39 for s in strings)
    for k, (x, y) in enumerate(zip(suffixes, suffixes[1:], strict=False)):
        common = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        assert array.common[k] == common
        assert common == min(len(x), len(y)) or x[common] < y[common]


def plain_maximal(strings, length):
    found = defaultdict(set)
    for s, text in enumerate(strings):
        for i in range(len(text) - length + 1):
            for j in range(i + length, len(text) + 1):
                found[text[i:j]].add((s, i))
    out = set()
    for w, places in found.items():
        left = {strings[s][i - 1] if i else -1 - s for s, i in places}
        right = {strings[s][i + len(w)] if i + len(w) < len(strings[s]) else -1 - s for s, i in places}
        if len(places) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(w), frozenset(places)))
    return out


def test_interval_tree_gives_maximal_repeats():
    rnd = random.Random(4)
    strings = ["".join(rnd.choices("ab", k=rnd.randint(34, 48))).encode() for _ in range(10)] + [b"ab" * 20, b"ba" * 19]
    for length in (32, 33):
        array = repeats.Array(strings, length)
        got = {
            (size, frozenset((int(array.string[k]), int(array.inside[k])) for k in range(a, b + 1)))
            for size, a, b, _ in array.repeats(np.arange(len(strings)))
        }
        assert {g for g in got if len(g[1]) > 1} >= plain_maximal(strings, length)


def test_groups_with_all_occurrences(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choices("abcdefgh", k=90))
    texts = ["".join(rnd.choices("ijklmn", k=29)) + f"{i}{passage}{i}" + "o" * (20 + i) for i in range(4)]
    rows = list(enumerate(texts))
    out = repeats.maximal_repeats(table(spark, rows)).collect()
    covered = defaultdict(set)
    for r in out:
        b = texts[r["doc_id"]].encode()
        assert r["length"] >= 50 and b[r["start"] : r["start"] + r["length"]] in passage.encode()
        covered[r["doc_id"]] |= set(range(r["start"] - 30, r["start"] - 30 + r["length"]))
    assert all(covered[i] == set(range(90)) for i in range(4))
    groups = defaultdict(set)
    for r in out:
        groups[r["repeat_id"]].add((r["doc_id"], r["start"]))
    assert all({d for d, _ in g} == {0, 1, 2, 3} for g in groups.values())
