"""SimHash near-dedup over vantage-point trees.

Fingerprints within 3 of 64 bits differ by at most one bit in their upper or in their lower half. Each half has a
vantage-point tree whose nodes split by the Hamming distance d to a vantage fingerprint: by the triangle inequality, two
halves one bit apart can only be parted at threshold t if their distances are t and t + 1. So the inner shard takes d <= t + 1,
the outer one d > t, and every link lies whole in some shard. Inside a shard the same split goes on until the points are few
enough to be compared with each other, in all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.blocks import spanning_edges
from trafficloom.llm.texts import LOWER, arrow_schema, emitted, narrow, rows_of
from trafficloom.plans.components import components
from trafficloom.plans.lookup import lookup
from trafficloom.plans.pinning import pin

SHINGLE = 3
RADIUS = 3
SAMPLE = 1 << 15
SHARD = 2048
SPLIT_ROWS = 1 << 16
SEED = 42
_PRINTS = "doc_id long, fingerprint long"
_SHARDED = "shard long, left long, right long, side int, fingerprint long"
_EDGES = "a long, b long"


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, 8192):
        pairs = zip(starts[at : at + 8192], ends[at : at + 8192], strict=False)
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint): a bit is 1 if it is set in over half of the hashes of the text's word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(_PRINTS, ((i, fingerprint(t, shingle)) for i, t in rows_of(batches, "doc_id", "text")))

    return narrow(docs, id_col, text_col).mapInArrow(run, _PRINTS)


def _halves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (points >> np.uint64(32)).astype(np.uint32), (points & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _split(values: np.ndarray, reach: int) -> tuple[np.uint32, int] | None:
    """Vantage and threshold with the least pairs left in the two sides; None if no split is worth it."""
    best, found = 0.9, None
    for vantage in values[np.linspace(0, len(values) - 1, 8).astype(np.int64)]:
        share = np.bincount(np.bitwise_count(values ^ vantage), minlength=34) / len(values)
        upto = np.cumsum(share)
        inner, outer = np.append(upto[reach:], [1.0] * reach), 1 - upto
        cost = inner**2 + outer**2
        t = int(np.argmin(cost))
        if cost[t] < best:
            best, found = cost[t], (vantage, t)
    return found


class Tree:
    """Vantage-point tree over 32-bit halves, fitted on a bounded sample; leaves are numbered."""

    def __init__(self, sample: np.ndarray, population: float, reach: int, shard: int = SHARD) -> None:
        self.reach = reach
        self.vantage, self.threshold, self.children, self.sizes = [], [], [], []
        self._grow(sample, population / max(1, len(sample)), shard)
        self.vantage, self.threshold = np.array(self.vantage, dtype=np.uint32), np.array(self.threshold)
        self.children = np.array(self.children).reshape(-1, 2)

    def _grow(self, sample: np.ndarray, each: float, shard: int) -> int:
        """Index of the node; leaves are given as -1 - number."""
        split = _split(sample, self.reach) if len(sample) * each > shard and len(sample) >= 16 else None
        if split is None:
            self.sizes.append(len(sample) * each)
            return -len(self.sizes)
        node = len(self.vantage)
        self.vantage.append(split[0])
        self.threshold.append(split[1])
        self.children.append((0, 0))
        d = np.bitwise_count(sample ^ split[0]).astype(np.int64)
        inner = self._grow(sample[d <= split[1] + self.reach], each, shard)
        self.children[node] = (inner, self._grow(sample[d > split[1]], each, shard))
        return node

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a value belongs to."""
        rows, node = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
        if not len(self.vantage):
            return rows, node
        done = []
        while len(rows):
            d = np.bitwise_count(values[rows] ^ self.vantage[node]).astype(np.int64)
            t, child = self.threshold[node], self.children[node]
            into, out = d <= t + self.reach, d > t
            rows, node = np.concatenate([rows[into], rows[out]]), np.concatenate([child[into, 0], child[out, 1]])
            leaf = node < 0
            done.append((rows[leaf], -1 - node[leaf]))
            rows, node = rows[~leaf], node[~leaf]
        return np.concatenate([r for r, _ in done]), np.concatenate([x for _, x in done])


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges between two sets of points, in blocks."""
    for i in range(0, len(left), SHARD):
        for j in range(0, len(right), SHARD):
            a, b = left[i : i + SHARD], right[j : j + SHARD]
            points = np.concatenate([a, b])
            x, y = spanning_edges(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            keep = points[x] != points[y]
            yield points[x][keep], points[y][keep]


def _within(points: np.ndarray, values: np.ndarray, reach: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges among the points of one shard, which is split further while that pays."""
    split = _split(values, reach) if len(points) > SHARD else None
    if split is None:
        yield from _close(points, points, radius)
        return
    d = np.bitwise_count(values ^ split[0]).astype(np.int64)
    for side in (d <= split[1] + reach, d > split[1]):
        yield from _within(points[side], values[side], reach, radius)


def links(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b): edges that connect distinct fingerprints exactly as all pairs within `radius` bits would.

    `points` (pinned by the caller) has distinct longs in `fingerprint`. The trees' upper part is fitted on at most `sample` of
    them (picked by hash), so what the driver holds is bounded; every point is put into its shards. A shard whose expected
    rows exceed SPLIT_ROWS is cut into blocks that meet pairwise. A shard gives a forest, never all its pairs.
    """
    reach = radius // 2
    known = points.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample).toArrow()
    values = known.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
    trees = [Tree(half, points.count(), reach, shard) for half in _halves(values)] if len(values) else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_SHARDED)
        for batch in batches:
            found = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)
            for number, (tree, half) in enumerate(zip(trees, _halves(found.view(np.uint64)), strict=True)):
                rows, leaf = tree.shards(half)
                blocks = np.ceil(np.array(tree.sizes) / SPLIT_ROWS).astype(np.int64)
                s = np.maximum(1, blocks)[leaf]
                own = (found[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % s
                at = np.repeat(np.arange(len(rows)), s)
                other = np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s)
                low, high = np.minimum(own[at], other), np.maximum(own[at], other)
                columns = (leaf[at] * 2 + number, low, high, (own[at] != low).astype(np.int32), found[rows][at])
                for k in range(0, len(at), 50_000):
                    parts = [pa.array(c[k : k + 50_000], f.type) for c, f in zip(columns, schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(parts, schema=schema)

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        found = group.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
        side = group.column("side").to_numpy()
        number = key[0].as_py() % 2
        if key[1].as_py() == key[2].as_py():
            edges = list(_within(found, _halves(found)[number], reach, radius))
        else:
            edges = list(_close(found[side == 0], found[side == 1], radius))
        a, b = (np.concatenate([e[k] for e in edges]).view(np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    placed = points.mapInArrow(place, _SHARDED)
    return placed.groupBy("shard", "left", "right").applyInArrow(joined, _EDGES)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs`.

    fingerprint as 16 hex digits; component_id is the smallest doc_id reachable over fingerprints within `radius` bits.
    Null and empty texts have fingerprint zero and are linked like any other. Null ids are no smallest id; a component of null
    ids only has a null component_id. Repeated rows give repeated results, an empty table an empty one.
    """
    prints = pin(fingerprints(docs, id_col, text_col, shingle))
    points = pin(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    found = components(links(points, radius), "a", "b")
    labels = pin(
        points.join(found, points.fingerprint == found.node, "left").select(
            "fingerprint", "n", "first_id", F.coalesce("component", "fingerprint").alias("label")
        )
    )
    smallest = pin(labels.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("parts")))
    of_print = pin(lookup(labels, smallest, "label", "parts", "fingerprint").select("fingerprint", "n", "component_id"))
    return lookup(prints, of_print, "fingerprint", "n", "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
