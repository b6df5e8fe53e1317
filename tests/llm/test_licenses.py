"""Licence phrases and templates, the base ones against a plain scan."""

import math
import random
import re
import time

import pytest
from trafficloom.llm import licenses

SCHEMA = "doc_id long, text string, n_words string, score int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_scan(spark):
    rnd = random.Random(1)
    bits = ["mit", "License", "MIT-License", "cc", "BY", "cc.by", "Apache", "gnu general public license", "GNU General\nPublic", "é", "\x00", "x9", "[", "ſ", "K"]
    texts = [rnd.choice([" ", "_", "\x00", "—"]).join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "mit license mit license", "cc by cc by", "mit license " + "word " * 40_000 + "apache license"]
    notices = {label: t for label, (t, _) in licenses.TEMPLATES.items()}
    at = len(texts)
    texts += [f"some words before. {t.upper()}; and after" for t in notices.values()]
    texts += [" ".join(random.Random(3).sample(t.split(), len(t.split()))) for t in notices.values()]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[2], (None, "mit license", None, None)], SCHEMA).repartition(3)
    out = licenses.license_scan(df).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        text = "mit license" if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0.0 <= r["score"] <= 1.0
        if r["doc_id"] is not None and at <= r["doc_id"] < at + len(notices):
            assert list(notices)[r["doc_id"] - at] in r["labels"].split(",") and r["score"] > 0.9
        elif r["doc_id"] is not None and r["doc_id"] >= at + len(notices):
            assert r["labels"] == r["base_labels"]
    assert licenses.license_scan(df.where("false")).count() == 0


def test_counts_cover_all_documents(spark):
    df = spark.createDataFrame([(1, "the mit license the"), (2, None), (3, "THE")], "doc_id long, text string")
    counts = licenses.document_counts(licenses.narrow(df), frozenset([b"the", b"license"]))
    assert {r["word"] and bytes(r["word"]): r["n"] for r in counts.collect()} == {None: 3, b"the": 2, b"license": 1}


def test_every_notice_of_a_file_is_found(spark):
    notices = {label: t for label, (t, _) in licenses.TEMPLATES.items()}
    four = ["bsd", "isc", "mit-notice", "mpl"]
    scattered = " ".join(random.Random(5).sample([w for t in notices.values() for w in t.split()], 200))
    rows = [
        (0, " ".join(notices.values()), set(notices)),
        (1, " ".join(notices[label] for label in four), set(four)),
        *[(2 + k, f"{scattered} {t} {scattered}", {label}) for k, (label, t) in enumerate(notices.items())],
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for doc_id, _, labels in rows:
        assert set(out[doc_id]["labels"].split(",")) - set(licenses.BASE_PHRASES.values()) == labels
        assert out[doc_id]["score"] == pytest.approx(1.0)
    short = {"short": ("zebra quagga", ["zebra quagga"])}
    df = spark.createDataFrame([(1, "a zebra quagga b"), (2, "quagga zebra")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.license_scan(df, templates=short).collect()} == {1: "short", 2: ""}


def plain_templates(text, idf):
    """Labels and best score from every place where every template could stand."""
    found = licenses.words((text or "").encode())
    labels, best = set(), 0.0
    for label, (t, phrases) in licenses.TEMPLATES.items():
        template = licenses.words(t.encode())
        total = sum(idf[w] for w in template)
        for shift in range(1 - len(template), len(found)):
            window = found[max(0, shift) : max(0, shift + len(template))]
            agreed = [w for k, w in enumerate(template) if 0 <= k + shift < len(found) and found[k + shift] == w]
            line = b" " + b" ".join(window) + b" "
            inside = all(b" " + b" ".join(licenses.words(p.encode())) + b" " in line for p in phrases)
            score = sum(idf[w] for w in agreed) / total
            if len(agreed) >= licenses.MIN_VOTES and score >= licenses.MIN_SCORE and inside:
                labels.add(label)
                best = max(best, score)
    return labels, best


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_every_place(spark, seed):
    rnd = random.Random(seed)
    notices = [t for t, _ in licenses.TEMPLATES.values()]
    pool = [w for t in notices for w in t.split()]
    texts = [" ".join(rnd.choices(pool, k=rnd.randint(0, 120))) for _ in range(40)]
    for t in notices:
        w = t.split()
        for share in (0.1, 0.3, 0.45):
            texts.append(" ".join(rnd.choice(pool) if rnd.random() < share else x for x in w))
        cut = rnd.randint(1, len(w) - 1)
        texts += [" ".join(w[cut:]), " ".join(w[:cut]), " ".join([*w[:cut], "more", *w[cut:]]), f"{t} {t}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocabulary = {w for t in notices for w in licenses.words(t.encode())}
    has = {w: sum(w in licenses.words(t.encode()) for t in texts) for w in vocabulary}
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1e-9 for w, n in has.items()}
    several = 0
    for r in licenses.license_scan(df).collect():
        labels, best = plain_templates(texts[r["doc_id"]], idf)
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == labels | base, texts[r["doc_id"]]
        assert r["score"] == (1.0 if base else pytest.approx(min(1.0, best)))
        several += bool(labels)
    assert several >= 15


def test_only_rare_words_are_indexed():
    idf = {w: 5.0 if len(w) > 7 else 0.5 for t, _ in licenses.TEMPLATES.values() for w in licenses.words(t.encode())}
    index = licenses.Index(licenses.TEMPLATES, idf)
    for t, template in enumerate(index.texts):
        rare = {w for w, places in index.postings.items() if any(p[0] == t for p in places)}
        left = sum(idf[w] for w in template if w not in rare)
        assert left < licenses.MIN_SCORE * index.totals[t] and 0 < len(rare) < len(set(template))


def test_many_places_take_time_in_proportion():
    phrases = [(b" mit license ", "mit", 2)]

    def spent(n):
        words = [b"mit", b"license"] * n
        began = time.process_time()
        places, _ = licenses._base(words, phrases)
        assert places[:2] == [0, 2] and len(places) == n and places[-1] == 2 * n - 2
        return time.process_time() - began

    spent(100)
    assert spent(80_000) < 8 * spent(20_000) + 0.5
