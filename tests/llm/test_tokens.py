"""BPE, token counts and packing against the tokenizers library and by hand."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trafficloom.llm import bpe, packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [
    *"ab1_.中é²½ⅧßİΣ🙂'",
    *[" ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "​", "\x00", "\r\n"],
    *["the", "'s", "'ll", "...", "ﬁ", "é", "a" * 60, "<|endoftext|>", "<|startoftext|>", "<|end"],
]
SCHEMA = "doc_id long, text string, source string, ids string"


def library(path):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def rows(found):
    return [(i, t, f"s{i % 3}", "clash") for i, t in enumerate(found)]


def test_codec_equals_library():
    known, mine = library(BYTES), bpe.Codec(BYTES)
    for text in [*texts(3000), *(t.decode("utf-8", "ignore") for t in mine.tokens[::17]), "x" * 20000, " " * 3000]:
        ids = known.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(np.array(ids, dtype="<u4")).decode() == known.decode(ids, skip_special_tokens=False)


def test_long_pieces_take_time_in_proportion():
    """One piece of letters without a space, which the plain longest matches don't give."""
    codec, known = bpe.codec(BYTES), library(BYTES)
    for text in ("ab" * 3000, "xyzzyq" * 1000, "a" * 5000 + "b", "é" * 3000, "the" * 2000):
        assert codec.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids

    def spent(n):
        began = time.process_time()
        codec.piece("abcabd" * n)
        return time.process_time() - began

    spent(100)
    assert spent(80_000) < 8 * spent(20_000) + 0.5


def test_full_caches_change_nothing(monkeypatch):
    mine = bpe.Codec(BYTES)
    for cache in (mine.pieces, mine.chunks, mine.spaced, mine.borders):
        cache.limit = 3
    other = bpe.Codec(BYTES)
    for text in texts(200, 5):
        assert mine.encode(text).tolist() == other.encode(text).tolist()


def test_words_equal_library():
    known, mine = library(WORDS), packing.Words(WORDS)
    found = [*texts(3000), "Hello  World\nand\tMORE. A, b! İ, ß. É; don't. x... y., <|ENDOFTEXT|> <|endoftext|>. K, ſ!"]
    for text, packed in zip(found, mine.encode(found), strict=True):
        ids = np.frombuffer(packed, dtype=mine.kind).tolist()
        assert ids == [*known.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_forms_of_a_word_are_asked_for_once():
    """Case and the marks behind a word do not make it another one, with Latin accents or without."""
    known, mine, asked = library(WORDS), packing.Words(WORDS), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, joined, **options):
            asked.extend(x for text in joined for x in text.split(mine.mark))
            return self.tokenizer.encode_batch_fast(joined, **options)

    mine.library, mine.bare = Counted(mine.library), Counted(mine.bare)
    marks = ["", ".", ",%%%", "!?", "'"]
    found = [w + m for w in ("Étédon", "étéDON", "ÉTÉDON", "antionston", "Antionston") for m in marks]
    found += [" ".join(found), "étédon's x\u0301 étédon\u0301. a1b <|endoftext|>étédon"]
    for text, packed in zip(found, mine.encode(found), strict=True):
        assert np.frombuffer(packed, dtype=mine.kind).tolist() == [*known.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert sum("don" in x for x in asked) == 4 and asked.count("antionston") == 1


@pytest.mark.parametrize("n", [0, 1, packing.TOGETHER, packing.TOGETHER + 1, 2 * packing.TOGETHER])
def test_words_are_joined_in_arrow(n):
    known, mine = library(WORDS), packing.Words(WORDS)
    items = [("word", "", "anteston", "étédon")[i % 4] * (1 + i % 3) for i in range(n)]
    ids, sizes = mine._together(mine.bare, pa.array(items, pa.string()))
    want = [known.encode(x, add_special_tokens=False).ids for x in items]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_round_trip(spark):
    found = [*texts(50), None, ""]
    docs = spark.createDataFrame([*rows(found), rows(found)[0], (None, "abc", None, None)], SCHEMA)
    out = bpe.round_trip(docs, BYTES)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    known, want = library(BYTES), Counter()
    for i, t in [*enumerate(found), (0, found[0]), (None, "abc")]:
        ids = known.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want[i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(docs.where("false"), BYTES).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 16])
def test_token_counts(spark, block):
    found = [*texts(60, 9), None, "", "", "<|endoftext|>"]
    docs = spark.createDataFrame(rows(found), SCHEMA).repartition(3)
    files = token_counts.token_blocks(docs, BYTES, 50256, block=block).cache()
    counted = token_counts.count_tokens(files.where("tokens IS NOT NULL"), 50256)
    named = files.where("tokens IS NULL").select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id"))
    joined = counted.join(named.withColumn("doc_no", F.expr("first_doc + k")), ["file", "doc_no"])
    known = bpe.Codec(BYTES, True)
    assert {r["doc_id"]: r["n_tokens"] for r in joined.collect()} == {
        i: len(known.encode(t or "")) for i, t in enumerate(found)
    }
    assert counted.where("NOT terminated").count() == 0
    files.unpersist()


def test_token_counts_of_given_files(spark, tmp_path):
    streams = {"a": [1, 2, 9, 9, 3, 9, 4], "b": [], "c": [9], "d": [5, 5, 5]}
    for name, ids in streams.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
    out = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), block=2), 9)
    got = sorted((r["file"][-5], r["doc_no"], r["n_tokens"], r["terminated"]) for r in out.collect())
    assert got == [
        *[("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 1, True), ("a", 3, 1, False)],
        *[("c", 0, 0, True), ("d", 0, 3, False)],
    ]


def check_packing(out, docs, window):
    known = library(WORDS)
    ids_of = [[*known.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in docs]
    todo = defaultdict(list)
    for (i, *_), ids in zip(docs, ids_of, strict=True):
        todo[i].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == todo.keys()
    for i, group in todo.items():
        if len(group) == 1:
            at = 0
            for start, length, crc, doc_tokens in sorted(pieces[i]):
                assert start == at and length > 0 and doc_tokens == len(group[0])
                assert crc == zlib.crc32(np.array(group[0][start : start + length], dtype="<u4").tobytes())
                at += length
            assert at == len(group[0])
    total = sum(map(len, ids_of))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for s in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sum(sizes) == total and sizes[: total // window] == [window] * (total // window)
    assert all(n & (n - 1) == 0 for n in sizes)


@pytest.mark.parametrize(("window", "packet"), [(64, 16), (64, 64), (2048, 512)])
def test_packing(spark, window, packet):
    docs = [*rows([*texts(80, 11), None, "", "word " * 700]), (None, "no id", None, None)]
    out = packing.pack(spark.createDataFrame(docs, SCHEMA).repartition(3), WORDS, window=window, packet=packet)
    check_packing(out.collect(), docs, window)


def test_packing_of_nothing_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a", "s", "x"), (1, "a", "s", "x")], SCHEMA)
    assert packing.pack(docs.where("false"), WORDS).count() == 0
    assert sum(r["length"] for r in packing.pack(docs, WORDS).collect()) == 4


@pytest.mark.parametrize("targets", [None, {"s0": 2.0, "s1": 1.0, "s2": 1.0}])
def test_mixture_is_held(spark, targets):
    docs = [(i, "word " * 99, f"s{i % 4 % 3}", None) for i in range(200)]
    out = packing.pack(spark.createDataFrame(docs, SCHEMA), WORDS, window=512, packet=64, targets=targets).collect()
    share = targets or {"s0": 2, "s1": 1, "s2": 1}
    taken = Counter()
    last = max(r["sequence_id"] for r in out)
    for s in range(last // 2):
        taken.update({r["source"]: 0 for r in out})
        for r in out:
            if r["sequence_id"] == s:
                taken[r["source"]] += r["length"]
        for source, weight in share.items():
            assert abs(taken[source] - (s + 1) * 512 * weight / 4) <= 512
