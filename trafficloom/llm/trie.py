"""The prefix trie of conversations, from sorted conversations and the common prefixes of neighbours.

Conversations are sorted by their turns; lcp[i] is the number of turns that i shares with the one before. A prefix is a run of
conversations between which no lcp is smaller than its depth. Range minima of the lcps stand in a sparse table, and every
candidate prefix finds the first and the last member by binary searches of its own, to the left and to the right. Prefixes are
never kept on a stack and don't wait for each other.

The sorted conversations are cut into blocks of bounded size. Inside a block everything is numpy on whole arrays. Prefixes that
touch a block's first or last row may go on in its neighbours: a block gives one part for each of these, at most twice as many
as a conversation has turns, and the parts are joined by depth, as gaps and islands. So a prefix may span any
number of blocks, and no task gets more than a block of conversations or one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.llm.texts import rows_of
from trafficloom.plans.ordered import range_pieces
from trafficloom.plans.pinning import pin

BLOCK = 1 << 16
UNIT = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"
# side 0: prefixes of the block's first row; side 1: later ones that reach the block's end; null: prefixes inside the block
_FOUND = pa.schema(
    [
        ("block", pa.int64()),
        ("side", pa.int32()),
        ("depth", pa.int64()),
        ("boundary", pa.int64()),
        ("reaches_end", pa.bool_()),
        ("conv_id", pa.int64()),
        ("parent_side", pa.int32()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved", pa.int64()),
        ("words", pa.int64()),
        ("ends", pa.string()),
    ]
)
_FOUND_SQL = (
    "block long, side int, depth long, boundary long, reaches_end boolean, conv_id long, parent_side int, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, words long, ends string"
)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, mark, words>>): the turns of every conversation in order.

    `mark` stands for role and text (128 bits of SHA-256), `words` counts the text's words. Turns go by `turn`, nulls first, ties
    by mark. Null role or text is empty. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.substring(marked, 1, 2 * UNIT).alias("mark"),
            F.regexp_count(text, F.lit(_WORD)).alias("words"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_heads(found: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Conversations whose first `taken` (at most `most`) turns are replaced by those of the conversation `base`.

    All of the base's turns if it has fewer, none if there is no such conversation; conversations stay even without a turn.
    """
    heads = found.where(F.col("conv_id") == base).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head")
    )
    named = found.select("conv_id", "turns", base.alias("_base"), taken.cast("int").alias("_taken"))
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_taken"))
    own = F.slice("turns", F.col("_taken") + 1, F.size("turns"))
    return named.join(heads, "_base", "left").select("conv_id", F.concat(head, own).alias("turns"))


class _Minima:
    """Sparse table over an array: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, size = [values], 1
        while 2 * size <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], both included."""
        k = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << level) + 1])
        return out

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest r such that no value in start+1..r is below depth."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            fits = at + 1 < len(table)
            ok = fits & (table[np.where(fits, at + 1, 0)] >= depth)
            at[ok] += 1 << k
        return at

    def left(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest l such that no value in l+1..start is below depth."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, to = self.levels[k], at - (1 << k)
            fits = to >= 0
            ok = fits & (table[np.where(fits, to + 1, 0)] >= depth)
            at[ok] = to[ok]
        return at


def shared(left: bytes, right: bytes) -> int:
    """Number of leading turns that two keys have in common."""
    size = min(len(left), len(right)) // UNIT
    a, b = (np.frombuffer(x, dtype="<u8", count=2 * size).reshape(-1, 2) for x in (left, right))
    differ = np.flatnonzero((a != b).any(axis=1))
    return int(differ[0]) if len(differ) else size


def _neighbours(keys: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Turns that each key shares with the one before; the first shares all of its own."""
    units = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = np.minimum(lengths, np.concatenate((lengths[:1], lengths[:-1])))
    size = out[1:]
    before = np.concatenate(([0], np.cumsum(size)))
    offset = np.arange(before[-1]) - np.repeat(before[:-1], size)
    mine = np.repeat(starts[1:], size) + offset
    last = np.repeat(starts[:-1], size) + offset
    differ = np.flatnonzero((units[mine] != units[last]).any(axis=1))
    np.minimum.at(out, np.searchsorted(before, differ, side="right"), offset[differ])
    return out


def _solve(block: int, keys: list[bytes], words: list[list[int]], ids: list[int], boundary: int | None) -> pa.RecordBatch:
    """All prefixes of a block of sorted conversations: whole ones, and the parts of those that may go on outside."""
    n = len(ids)
    lengths = np.array([len(k) // UNIT for k in keys], dtype=np.int64)
    conv = np.array(ids, dtype=np.int64)
    flat = np.array([w for each in words for w in each], dtype=np.int64)
    word_at = np.concatenate(([0], np.cumsum(lengths)))
    lcp = _neighbours(keys, lengths)
    minima, lowest = _Minima(lcp), _Minima(conv)

    # candidates: every prefix, at the first conversation that has it; those of row 0 are parts and come last
    new = lengths - lcp
    base = np.concatenate(([0], np.cumsum(new)))
    size = int(base[-1])
    rep = np.repeat(np.arange(n), new)
    depth = lcp[rep] + 1 + np.arange(size) - base[rep]
    last = minima.right(rep, depth)
    whole = last < n - 1
    front = np.arange(lengths[0] + 1)
    front_last = minima.right(np.zeros(len(front), dtype=np.int64), front)

    # where the shallowest new prefix of a row hangs: the prefix of depth lcp, from its own left extent
    hung = np.flatnonzero(new > 0)
    hung_left = minima.left(hung, lcp[hung])
    on_front = hung_left == 0
    parent = np.arange(size) - 1
    parent[base[hung]] = np.where(on_front, -1, base[hung_left] + lcp[hung] - lcp[hung_left] - 1)
    front_of = np.full(size, -1)
    front_of[base[hung[on_front]]] = lcp[hung[on_front]]
    inside = front_of < 0

    # children inside the block; parts are counted as children where parts are joined
    children = np.bincount(parent[inside & whole], minlength=size)[:size] if size else np.zeros(0, dtype=np.int64)
    front_children = np.bincount(front_of[~inside & whole], minlength=len(front))
    members = last - rep + 1
    spoken = flat[word_at[rep] + depth - 1]
    weight = np.where(whole, (members - 1) * spoken, 0)
    leaf = (whole & (children == 0)).astype(np.int64)
    weights, leaves = (np.concatenate(([0], np.cumsum(x))) for x in (weight, leaf))
    saved, n_leaves = (x[base[last + 1]] - x[:-1] for x in (weights, leaves))

    # conversations that end at a prefix: runs of equal ones, which stand at the prefix's beginning
    equal = np.concatenate(([False], (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])))
    begins = np.flatnonzero(~equal)
    ends: list[str | None] = [None] * size
    front_ends = ""
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True):
        text = ",".join(map(str, ids[a:b]))
        if a == 0:
            front_ends = text
        else:
            x = int(base[a + 1]) - 1
            ends[x] = hashlib.sha256(text.encode()).hexdigest() if whole[x] else text
    ends = [(NO_ENDS if w else "") if e is None else e for e, w in zip(ends, whole.tolist(), strict=True)]

    least = lowest.least(rep, last)
    parent_whole = np.zeros(size, dtype=bool)
    parent_whole[inside] = whole[parent[inside]]
    parent_conv = np.where(parent_whole, least[np.maximum(parent, 0)] if size else 0, 0)
    m, k = size, len(front)
    join = np.concatenate
    columns = [
        pa.array(np.full(m + k, block)),
        pa.array(join((np.ones(m, np.int32), np.zeros(k, np.int32))), mask=join((whole, np.zeros(k, bool)))),
        pa.array(join((depth, front))),
        pa.array(np.full(m + k, -1 if boundary is None else boundary), mask=join((np.ones(m, bool), np.full(k, boundary is None)))),
        pa.array(join((~whole, front_last == n - 1))),
        pa.array(join((least, np.minimum.accumulate(conv)[front_last]))),
        pa.array(join((inside.astype(np.int32), np.zeros(k, np.int32))), mask=join((parent_whole, np.zeros(k, bool)))),
        pa.array(join((parent_conv, np.zeros(k, np.int64))), mask=join((~parent_whole, np.ones(k, bool)))),
        pa.array(join((members, front_last + 1))),
        pa.array(join((children, front_children)).astype(np.int64)),
        pa.array(join((n_leaves, leaves[base[front_last + 1]]))),
        pa.array(join((saved, weights[base[front_last + 1]]))),
        pa.array(join((spoken, [0], flat[: k - 1])).astype(np.int64)),
        pa.array([*ends, *[""] * (k - 1), front_ends], pa.string()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _scan(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, piece, size = 0, None, 0, 0
        keys, words, ids = [], [], []

        def solved() -> pa.RecordBatch:
            known = None if before is None else shared(before, keys[0])
            return _solve((piece << 32) + number, keys, words, ids, known)

        for piece, key, counts, conv_id in rows_of(batches, "_piece", "key", "words", "conv_id"):
            keys.append(key)
            words.append(counts)
            ids.append(conv_id)
            size += 1 + len(counts)
            if size >= block:
                yield solved()
                number, before, size = number + 1, keys[-1], 0
                keys, words, ids = [], [], []
        if keys:
            yield solved()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(*(batch.column(c).to_pylist() for c in ("left", "right")), strict=True)
        met = pa.array([-1 if a is None else shared(a, b) for a, b in pairs], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_piece").cast(pa.int64()), met], names=["piece", "met"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the parts of each list, one part in memory at a time."""
    names, now, state, out = ("from_block", "from_side", "depth"), None, None, []
    for *at, text in rows_of(batches, *names, "ends"):
        if now != at:
            if state is not None:
                out.append((*now, state.hexdigest()))
            now, state = at, hashlib.sha256(text.encode())
        else:
            state.update(b"," + text.encode())
    if state is not None:
        out.append((*now, state.hexdigest()))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[*names, "digest"])


def prefix_trie(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix (node) of the conversations (conv_id, turns) that `sequences` gives.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest member, number of
    turns, the parent's smallest member (null at the root), members, children, childless nodes of the subtree, words that the subtree
    shares, i.e. the sum of (members - 1) * words in the last text, and the digest of the ids that end here, ascending.

    Every conversation is a member of the root, also one without turns. No conversations give no nodes. Equal conversations
    are told apart by their ids, equal ids by nothing: repeated rows of `found` are members of their own. A block has about
    `block` conversations and turns, or one conversation; what travels of a turn are its mark and the number of words.
    """
    ordered = range_pieces(
        found.select(
            F.unhex(F.array_join(F.col("turns.mark"), "")).alias("key"), F.col("turns.words").alias("words"), "conv_id"
        ),
        ["key", "conv_id"],
    )
    parts = pin(
        ordered.select("_piece", "key", "words", "conv_id")
        .sortWithinPartitions("_piece", "key", "conv_id")
        .mapInArrow(_scan(block), _FOUND_SQL)
    )
    # two keys per piece: what the first row of a piece shares with the last row of the one before
    outer = ordered.groupBy("_piece").agg(F.min("key").alias("right"), F.max("key").alias("_last"))
    met = outer.select("_piece", "right", F.lag("_last").over(Window.orderBy("_piece")).alias("left")).mapInArrow(
        _met, "piece long, met long"
    )
    cut = parts.where("side IS NOT NULL").withColumn("piece", F.shiftright("block", 32))
    known = cut.join(met, "piece").withColumn("boundary", F.coalesce("boundary", "met"))

    along = Window.partitionBy("depth").orderBy("block", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (F.col("side") == 1) | (F.col("depth") > F.col("boundary"))
    origin = F.last(F.when(starts, F.struct("block", "side")), ignorenulls=True).over(along)
    joined = pin(known.select(*_FOUND.names, starts.alias("starts"), origin.alias("o")).select(
        "*", F.col("o.block").alias("from_block"), F.col("o.side").alias("from_side")
    ).drop("o"))

    island, spot = ["from_block", "from_side", "depth"], ["block", "side", "depth"]
    begun = joined.where("starts")
    above = joined.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("from_block").alias("up_block"), F.col("from_side").alias("up_side"))
    linked = begun.join(above, ["block", "parent_side", "depth"], "left").select(*island, "up_block", "up_side", "words")
    born = linked.where("up_block IS NOT NULL").groupBy(
        F.col("up_block").alias("from_block"), F.col("up_side").alias("from_side"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count(F.lit(1)).alias("_born"))
    summed = joined.groupBy(*island).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("_inner")
    )
    islands = pin(
        summed.join(linked, island)
        .join(born, island, "left")
        .withColumn("n_children", F.col("_inner") + F.coalesce("_born", F.lit(0)))
        .drop("_inner", "_born")
        .withColumn("weight", (F.col("n_convs") - 1) * F.col("words"))
        .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    )

    # what islands that begin in a block add to the parts of that block which hold them
    own = islands.select(*[F.col(a).alias(b) for a, b in zip(island, spot, strict=True)], "weight", "leaf")
    deeper = Window.partitionBy("block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, -1)
    weighed = joined.join(own, spot, "left")
    totals = []
    for name, value in (("saved", "weight"), ("n_leaves", "leaf")):
        on_front, at_end = (F.coalesce(F.sum(F.when(F.col("side") == s, F.col(value))).over(deeper), F.lit(0)) for s in (0, 1))
        held = F.when(F.col("side") == 0, on_front).otherwise(0) + F.when(F.col("reaches_end"), at_end).otherwise(0)
        totals.append((F.col(name) + held + F.coalesce(F.col(value), F.lit(0))).alias(name))
    subtrees = weighed.select(*island, *totals).groupBy(*island).agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))

    ended = (
        joined.where("ends <> ''")
        .select(*island, "block", "side", "ends")
        .repartition(*island)
        .sortWithinPartitions(*island, "block", "side")
        .mapInArrow(_digests, "from_block long, from_side int, depth long, digest string")
    )
    named = islands.select(F.col("from_block").alias("up_block"), F.col("from_side").alias("up_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    spanning = (
        islands.join(subtrees, island)
        .join(ended, island, "left")
        .join(named, ["up_block", "up_side", "depth"], "left")
        .select(*_nodes("parent_conv_id", F.coalesce("digest", F.lit(NO_ENDS))))
    )
    inner = parts.where("side IS NULL")
    heads = joined.join(islands.select(*island, F.col("conv_id").alias("_head")), island).select(
        "block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "_head"
    )
    hung = inner.where("parent_side IS NOT NULL").join(heads, ["block", "parent_side", "depth"])
    return (
        inner.where("parent_side IS NULL").select(*_nodes("parent_conv_id", F.col("ends")))
        .unionByName(hung.select(*_nodes("_head", F.col("ends"))))
        .unionByName(spanning)
    )


def _nodes(parent: str, ends: Column) -> list[Column]:
    return [
        F.col("conv_id"),
        F.col("depth"),
        F.col(parent).alias("parent_conv_id"),
        F.col("n_convs"),
        F.col("n_children"),
        F.col("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        ends.alias("ends_sha256"),
    ]
